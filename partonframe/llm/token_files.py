"""Token ids in binary files of independent zstandard frames, and the reader of these files.

A file is a row of zstandard frames, so that any decoder of zstandard gives all its ids, one after another:

* for every document one frame of its ids, unsigned 32-bit little-endian; a document of over FRAME_IDS ids has several;
* the document table in a skippable frame (magic 0x184D2A50): compressed, the file's place (part, then number within the
  part), the number of documents n, n ids of 64 bits, n bytes that are 1 where there is an id, n counts of frames of 32 bits;
* the seek table in a skippable frame (magic 0x184D2A5E), as in zstandard's seekable format: for every frame before it the
  bytes compressed and decompressed and the low 32 bits of XXH64 of what it holds, then the number of frames, the flag
  that there are checksums, and the closing magic 0x8F92EAB1.

A reader looks at a file's end, finds the document in the table, and decompresses this document's frames only.

Documents are dealt by ranges of their id, sorted, encoded and compressed where they are; a task closes a file when
it has SHARD_BYTES. Spark's text writer puts every file where all can read it: rows are bytes, a file has one row, and
the line's end is the closing magic. So files of tasks that failed are never seen, on any file system that Spark writes.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _ids, _ragged, _tokenizer
from .scratch import Scratch, bound_batches
from .skew import running_total

#: Ids of a frame at most, and compressed bytes at which a file is closed.
FRAME_IDS, SHARD_BYTES = 1 << 20, 8 << 20
#: Words whose ids a worker keeps, and their characters, beyond which it starts anew.
KEPT_WORDS, KEPT_CHARACTERS = 1 << 18, 1 << 23
#: Fixed values of the format.
TABLE_MAGIC, SEEK_MAGIC, CLOSING_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
SKIPPABLE, ENTRY, FOOTER, PLACE = struct.Struct("<II"), np.dtype("<u4"), struct.Struct("<IBI"), struct.Struct("<qqq")
#: The same magic as the end of a line of text.
LINE_END = struct.pack("<I", CLOSING_MAGIC).decode("latin-1")

#: Stands between words that are encoded in one call; a character that tokenizers of this kind make one id of.
BETWEEN = "\x01"
#: A letter and punctuation after it, which these tokenizers part; but for the apostrophe, which may lead an ending.
LETTER_THEN_MARK = r"([A-Za-z])([!-&(-/:-@\[-`{-~])"
PLAIN = re.compile("[a-z]+").fullmatch


class WordIds:
    """Ids of words, kept for the words to come: a place for each word in flat arrays."""

    def __init__(self, spec: str):
        self.spec = spec
        read = json.loads(spec)
        between, suffix = _ids([BETWEEN], spec)[0], read["model"].get("end_of_word_suffix")
        self.between = np.isin(np.arange(_tokenizer(spec).get_vocab_size()), between) if len(between) == 1 else None
        self.closing = np.zeros(_tokenizer(spec).get_vocab_size(), bool)
        if suffix:
            self.closing[[i for piece, i in read["model"]["vocab"].items() if piece.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.characters, self.lengths, self.flat = 0, np.zeros(0, np.int64), np.zeros(0, "<u4")

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of each word's ids in an array of ids."""
        if len(self.place) > KEPT_WORDS or self.characters > KEPT_CHARACTERS:
            self.clear()
        kinds: tuple[list[str], list[str], list[str]] = ([], [], [])
        ends, parts = bool(self.closing.any()), self.between is not None
        for w in words:
            if w not in self.place:
                kinds[0 if ends and PLAIN(w) else 1 if parts and BETWEEN not in w else 2].append(w)
        for kind, encoded in zip(kinds, (self._letters(kinds[0]), self._joined(kinds[1]), self._alone(kinds[2])), strict=True):
            self.place.update(zip(kind, range(len(self.place), len(self.place) + len(kind)), strict=True))
            self.characters += sum(map(len, kind))
            self.flat, self.lengths = np.concatenate([self.flat, encoded[0]]), np.concatenate([self.lengths, encoded[1]])
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return (np.cumsum(self.lengths) - self.lengths)[at], self.lengths[at], self.flat

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, many at a time, and how many each has: a word's last id is one that ends words."""
        ids = self._texts([" ".join(words[at : at + 512]) for at in range(0, len(words), 512)])
        return ids, np.diff(np.flatnonzero(self.closing[ids]), prepend=-1)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of any characters, with an id of its own after each."""
        ids = self._texts(["".join(f"{w} {BETWEEN} " for w in words[at : at + 512]) for at in range(0, len(words), 512)])
        mark = self.between[ids] if len(ids) else np.zeros(0, bool)
        return ids[~mark], np.diff(np.flatnonzero(mark), prepend=-1) - 1

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = _ids(words, self.spec)
        return np.concatenate([np.zeros(0, "<u4"), *[np.array(x, "<u4") for x in found]]), np.array([len(x) for x in found], np.int64)

    def _texts(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *[np.array(x, "<u4") for x in _ids(texts, self.spec)]])


@lru_cache(maxsize=2)
def _word_ids(spec: str) -> WordIds:
    return WordIds(spec)


def _encoded(texts: pa.Array, spec: str) -> list[np.ndarray]:
    """Ids of every text; each distinct word of a batch is looked up or encoded once."""
    texts = pc.fill_null(texts, "")
    # fewer distinct words: the tokenizer folds case and parts letters and marks itself, but after it has looked for its special tokens
    texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.replace_substring_regex(pc.ascii_lower(texts), LETTER_THEN_MARK, r"\1 \2"))
    lists = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(lists).dictionary_encode()
    starts, lengths, flat = _word_ids(spec)(words.dictionary.to_pylist())
    codes = words.indices.to_numpy()
    ids = flat[_ragged(starts[codes], lengths[codes])] if len(codes) else flat[:0]
    ends = np.r_[0, np.cumsum(lengths[codes])][np.cumsum(pc.list_value_length(lists).to_numpy())]
    return np.split(ids, ends[:-1]) if len(ends) else []


class Shard:
    """A file in the making."""

    def __init__(self, part: int, number: int):
        self.place, self.frames, self.entries, self.size = (part, number), [], [], 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> None:
        parts = range(0, max(len(ids), 1), FRAME_IDS)
        for at in parts:
            body = ids[at : at + FRAME_IDS].astype("<u4").tobytes()
            self._frame(compressor.compress(body), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF)
        self.ids.append(doc_id)
        self.counts.append(len(parts))

    def _frame(self, data: bytes, size: int, checksum: int) -> None:
        self.frames.append(data)
        self.entries.append((len(data), size, checksum))
        self.size += len(data)

    def unclosed(self, compressor: zstandard.ZstdCompressor) -> bytes:
        """The file without its last four bytes, which the writer puts after every row."""
        known = np.array([i is not None for i in self.ids], "u1")
        named = np.array([i or 0 for i in self.ids], "<i8")
        table = compressor.compress(PLACE.pack(*self.place, len(self.ids)) + named.tobytes() + known.tobytes() + np.array(self.counts, "<u4").tobytes())
        self._frame(SKIPPABLE.pack(TABLE_MAGIC, len(table)) + table, 0, xxhash.xxh64_intdigest(table) & 0xFFFFFFFF)
        entries = np.array(self.entries, ENTRY).tobytes()
        tail = SKIPPABLE.pack(SEEK_MAGIC, len(entries) + FOOTER.size) + entries + FOOTER.pack(len(self.entries), HAS_CHECKSUMS, CLOSING_MAGIC)
        return b"".join([*self.frames, tail[:-4]])


def _shards(batches: Iterator[pa.RecordBatch], spec, end_id: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    compressor, shard = zstandard.ZstdCompressor(), Shard(part, number)
    closed = lambda: pa.RecordBatch.from_arrays([pa.array([shard.unclosed(compressor)], pa.binary())], ["body"])
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), _encoded(batch.column(1), spec.value), strict=True):
            shard.add(doc_id, np.append(ids, np.uint32(end_id)), compressor)
            if shard.size >= shard_bytes:
                yield closed()
                number += 1
                shard = Shard(part, number)
    if shard.ids:
        yield closed()


def write_token_files(docs: DataFrame, spec: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of every text under the tokenizer ``spec`` (its JSON; one that drops white space and folds case), ``end_id``
    after each, to files below ``path`` in ascending order of the id.

    Ids equal those of the tokenizers library with add_special_tokens=False. Defined cases: null text counts as
    empty and has the end id only; null ids come first; rows that repeat an id are ordered by their text and each
    written; ids are whole numbers of 64 bits; an empty table makes files without bytes, which readers skip; extra columns are
    ignored; a text of any length is in one file, its ids in frames of bounded size.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # an id that many rows have is dealt by the hash of the text
    mark = F.xxhash64("text")
    dealt = rows.withColumn("mark", mark).repartitionByRange("id", "mark").sortWithinPartitions("id", "mark", "text").select("id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    shards = dealt.mapInArrow(partial(_shards, spec=shared, end_id=end_id, shard_bytes=shard_bytes), "body binary")
    shards.select(F.col("body").cast("string")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", LINE_END).text(path)


class TokenFile:
    """Reads one file's bytes; only what is asked for is decompressed."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if len(data) < FOOTER.size or FOOTER.unpack(self.data[-FOOTER.size :])[1:] != (HAS_CHECKSUMS, CLOSING_MAGIC):
            raise ValueError("not a token file: it doesn't end with a seek table")
        n, start = FOOTER.unpack(self.data[-FOOTER.size :])[0], len(data) - FOOTER.size
        self.entries = np.frombuffer(self.data[start - 12 * n : start], ENTRY).reshape(n, 3).astype(np.int64)
        self.offsets = np.r_[0, np.cumsum(self.entries[:, 0])]
        table = bytes(self.data[self.offsets[n - 1] + SKIPPABLE.size : self.offsets[n]])
        self._check(n - 1, table)
        table = zstandard.ZstdDecompressor().decompress(table)
        self.part, self.number, docs = PLACE.unpack_from(table)
        at = PLACE.size
        ids, known = np.frombuffer(table, "<i8", docs, at), np.frombuffer(table, "u1", docs, at + 8 * docs)
        self.ids = pa.array(ids, pa.int64(), mask=known == 0)
        counts = np.frombuffer(table, "<u4", docs, at + 9 * docs).astype(np.int64)
        self.first = np.r_[0, np.cumsum(counts)]
        sizes = np.r_[0, np.cumsum(self.entries[:, 1] // 4)][self.first]
        self.starts, self.sizes = sizes[:-1], np.diff(sizes)

    def _check(self, frame: int, body: bytes) -> None:
        if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.entries[frame, 2]:
            raise ValueError(f"frame {frame} of part {getattr(self, 'part', '?')} doesn't have its checksum")

    def document(self, i: int) -> bytes:
        """Ids of the i-th document, four bytes each."""
        out = []
        for frame in range(self.first[i], self.first[i + 1]):
            try:
                body = zstandard.ZstdDecompressor().decompress(self.data[self.offsets[frame] : self.offsets[frame + 1]], max_output_size=int(self.entries[frame, 1]))
            except zstandard.ZstdError as e:
                raise ValueError(f"frame {frame} of part {self.part} can't be decompressed") from e
            self._check(frame, body)
            out.append(body)
        return b"".join(out)


FACTS = "path string, part bigint, number bigint, n_docs bigint, n_ids bigint, first_id bigint, last_id bigint"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            file = TokenFile(content.as_buffer())
            ends = [pc.min(file.ids).as_py(), pc.max(file.ids).as_py()]
            rows.append((path, file.part, file.number, len(file.ids), int(file.sizes.sum()), *ends))
        names = [f.split()[0] for f in FACTS.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _documents(batches: Iterator[pa.RecordBatch], wanted: frozenset | None, digests: bool) -> Iterator[pa.RecordBatch]:
    kind = pa.int64() if digests else pa.list_(pa.int64())

    def rows(file: TokenFile, chosen: list[int], values: list) -> pa.RecordBatch:
        n, take = len(chosen), np.array(chosen, np.int64)
        columns = [file.ids.take(pa.array(take)), pa.array(np.full(n, file.part)), pa.array(np.full(n, file.number)), pa.array(file.starts[take]), pa.array(file.sizes[take]), pa.array(values, kind)]
        return pa.RecordBatch.from_arrays(columns, ["id", "part", "number", "within", "n_tokens", "value"])

    for batch in batches:
        for content in batch.column(0):
            file, chosen, values, held = TokenFile(content.as_buffer()), [], [], 0
            for i, doc_id in enumerate(file.ids.to_pylist()):
                if wanted is not None and doc_id not in wanted:
                    continue
                body = file.document(i)
                chosen.append(i)
                values.append(zlib.crc32(body) if digests else np.frombuffer(body, "<u4"))
                held += 8 if digests else 2 * len(body)
                if held >= 1 << 20:
                    yield rows(file, chosen, values)
                    chosen, values, held = [], [], 0
            if chosen:
                yield rows(file, chosen, values)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    bound_batches(spark)
    return spark.read.format("binaryFile").load(paths).where("length > 0")


def token_file_facts(spark: SparkSession, path: str) -> DataFrame:
    """A row for every file below ``path``, from its end: path, part, number, n_docs, n_ids, first_id, last_id. No ids are decompressed."""
    return _files(spark, path).select("path", "content").mapInArrow(_facts, FACTS)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", digests: bool = False, ids: Iterable[int] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Every document of the files below ``path``, or those of the ``ids``: ``id_col``, start (ids of all documents
    before it), n_tokens and ids (array<bigint>), or with ``digests`` ids_crc32 of their bytes.

    With ``ids`` only files whose ids reach around one of them are read, and only these documents decompressed.
    ValueError in a task if a frame doesn't have its checksum. Null ids are read when all are.
    """
    scratch = scratch or Scratch(spark)
    facts = scratch.table(token_file_facts(spark, path))
    # the order of files is that of their parts; parts are summed before they are ordered
    bases = running_total(facts.select("part", "number", "n_ids"), [], "part", [F.col("number")], F.col("n_ids"), "base").select(F.col("part").alias("_part"), F.col("number").alias("_number"), "base")
    paths, wanted = path, None
    if ids is not None:
        wanted = frozenset(ids)
        asked = spark.createDataFrame([(i,) for i in sorted(wanted)], "asked bigint")
        near = facts.where("first_id is not null").join(F.broadcast(asked), F.col("asked").between(F.col("first_id"), F.col("last_id")), "left_semi")
        paths = [r.path for r in near.select("path").collect()]  # at most one or, where an id is repeated, a few for each id
    value = "ids_crc32" if digests else "ids"
    schema = f"id bigint, part bigint, number bigint, within bigint, n_tokens bigint, value {'bigint' if digests else 'array<bigint>'}"
    files = _files(spark, paths) if paths else facts.limit(0).select(F.lit(b"").alias("content"))
    rows = files.select("content").mapInArrow(partial(_documents, wanted=wanted, digests=digests), schema)
    placed = rows.join(bases, (F.col("part") == F.col("_part")) & (F.col("number") == F.col("_number")))
    return placed.select(F.col("id").alias(id_col), (F.col("base") + F.col("within")).alias("start"), "n_tokens", F.col("value").alias(value))
