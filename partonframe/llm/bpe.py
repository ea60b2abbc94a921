"""Byte-pair encoding and decoding through a table of distinct words.

A word is a maximal run of non-blanks with at most one space before it, or a run of blanks; byte-level BPE
never merges across such words, so a text's ids are its words' ids in order. The words of all documents are
split and counted in Spark; each distinct word is encoded once; ids go back to their positions by a join on
the word. Decoding looks every id up in the vocabulary's table of pieces.

The join has two arms. Frequent words, HEAD_WORDS of at most HEAD_BYTES bytes, go to every task as one table
(a broadcast of bounded size). For the other words there is a choice: ``rare="join"`` shuffles their
occurrences to the distinct-word table and back to their document, into the holes that the first arm left;
``rare="local"`` encodes each batch's distinct rare words in the task that meets them, and shuffles neither
words nor ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, bound_batches
from .skew import salted_join

#: Bounds of the table of frequent words that every task gets.
HEAD_WORDS, HEAD_BYTES = 1 << 19, 64
#: Steps in which counts are compared, to find how many words fit into that table.
STEPS = 4
#: Blanks as Unicode's White_Space has them, which the tokenizers' \s follows.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A blank run keeps all but its last character together before a word; the last one leads the word if it is a space.
WORDS = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]")
HOLE = np.uint32(0xFFFFFFFF)
PIECE = 1 << 20
#: Pieces of a vocabulary up to which its table is broadcast.
MOST_PIECES = 1 << 20


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _specials(spec: str) -> list[str]:
    return sorted((t["content"] for t in json.loads(spec)["added_tokens"]), key=len, reverse=True)


class Splitter:
    """Splits a text into words; strings of added tokens are words of their own."""

    def __init__(self, specials: list[str]):
        self.specials = specials
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.specials):
            return WORDS.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else WORDS.findall(part)
        return out


def _words(batch: pa.RecordBatch, column: int, split: Splitter) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a batch as a dictionary array, and the number of words of each text."""
    chunks, counts, pending, size = [], [], [], 0
    for x in batch.column(column):
        text = x.as_py() or ""
        found = split(text)
        counts.append(len(found))
        pending += found
        size += len(text)
        if size >= PIECE:
            chunks.append(pa.array(pending, pa.string()))
            pending, size = [], 0
    chunks.append(pa.array(pending, pa.string()))
    return pa.chunked_array(chunks).combine_chunks().dictionary_encode(), np.array(counts, np.int64)


def _count(batches: Iterator[pa.RecordBatch], split: Splitter) -> Iterator[pa.RecordBatch]:
    """(word, n): each batch's distinct words."""
    for batch in batches:
        words, _ = _words(batch, 0, split)
        n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(n)], ["word", "n"])


@lru_cache(maxsize=4)
def _tokenizer(spec: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _ids(words: list[str], spec: str) -> list[list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = _tokenizer(spec)
    return [e.ids for at in range(0, len(words), 4096) for e in tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]


def _encode(batches: Iterator[pa.RecordBatch], spec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.array(x, "<u4").tobytes() for x in _ids(batch.column(0).to_pylist(), spec.value)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])


class Head:
    """The frequent words and their ids, in flat arrays: words are found by hash and then compared."""

    def __init__(self, table: pa.Table):
        words = table.column("word").combine_chunks().cast(pa.string())
        hashes = self._hashes(words)
        # of words with one hash, the first stays; the others count as rare
        self.hashes, first = np.unique(hashes, return_index=True)
        self.words = words.take(pa.array(first))
        ids = table.column("ids").combine_chunks().cast(pa.binary()).take(pa.array(first))
        self.lengths = np.append(pc.binary_length(ids).to_numpy(zero_copy_only=False) // 4, 1).astype(np.int32)
        self.starts = (np.cumsum(self.lengths, dtype=np.int64) - self.lengths).astype(np.int32)
        # after the last word's ids, a hole
        self.ids = np.append(np.frombuffer(b"".join(ids.to_pylist()), "<u4"), HOLE).astype("<u4")

    @staticmethod
    def _hashes(words: pa.StringArray) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))

    def lookup(self, words: pa.StringArray) -> np.ndarray:
        """Entry of each word, or the hole's."""
        n = len(self.words)
        if not n:
            return np.zeros(len(words), np.int32)
        hashes = self._hashes(words)
        place = np.minimum(np.searchsorted(self.hashes, hashes), n - 1)
        hit = np.flatnonzero(self.hashes[place] == hashes)
        equal = pc.equal(self.words.take(pa.array(place[hit])), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        out = np.full(len(words), n, np.int32)
        out[hit[equal]] = place[hit[equal]]
        return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs: starts[i], starts[i] + 1, ... , lengths[i] of them."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _place(batch: pa.RecordBatch, column: int, split: Splitter, head: Head) -> tuple:
    """Ids of the texts with a hole for every word that isn't frequent: ids, ids of each text, each hole's text, and its word."""
    words, counts = _words(batch, column, split)
    entry = head.lookup(words.dictionary)[words.indices.to_numpy()]
    lengths = head.lengths[entry]
    text = np.repeat(np.arange(len(counts)), counts)
    per_text = np.bincount(text, lengths, len(counts)).astype(np.int64)
    rare = np.flatnonzero(entry == len(head.words))
    return head.ids[_ragged(head.starts[entry], lengths)], per_text, text[rare], words.take(pa.array(rare))


def _whole(batches: Iterator[pa.RecordBatch], spec, split: Splitter, head, digests: bool) -> Iterator[pa.RecordBatch]:
    """The result, with every batch's distinct rare words encoded where they stand."""
    for batch in batches:
        words, counts = _words(batch, 1, split)
        entry = head.value.lookup(words.dictionary)
        rare = np.flatnonzero(entry == len(head.value.words))
        own = _ids(words.dictionary.take(pa.array(rare)).to_pylist(), spec.value)
        own_lengths = np.array([len(x) for x in own], np.int64)
        pool = np.concatenate([head.value.ids, *[np.array(x, "<u4") for x in own]]) if own else head.value.ids
        starts, lengths = head.value.starts[entry], head.value.lengths[entry]
        starts[rare], lengths[rare] = len(head.value.ids) + np.cumsum(own_lengths) - own_lengths, own_lengths
        codes = words.indices.to_numpy()
        lengths = lengths[codes]
        ids = pool[_ragged(starts[codes], lengths)]
        ends = np.r_[0, np.cumsum(lengths, dtype=np.int64)][np.cumsum(counts)]
        yield _results(batch.column(0), np.split(ids, ends[:-1]) if len(ends) else [], spec.value, digests)


def _rare(batches: Iterator[pa.RecordBatch], split: Splitter, head) -> Iterator[pa.RecordBatch]:
    """(id, mark, hole, word): a row for every occurrence of a word that isn't frequent."""
    for batch in batches:
        _, _, text, word = _place(batch, 2, split, head.value)
        if not len(text):
            continue
        first = np.searchsorted(text, np.arange(len(batch.column(0))))
        hole = np.arange(len(text)) - first[text]
        take = pa.array(text)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(hole.astype(np.int32)), word.dictionary_decode()], ["id", "mark", "hole", "word"])


def _frequent(batches: Iterator[pa.RecordBatch], split: Splitter, head) -> Iterator[pa.RecordBatch]:
    """(id, mark, body): ids of every text, with holes; two bytes an id where all fit."""
    for batch in batches:
        ids, per_text, _, _ = _place(batch, 2, split, head.value)
        ends = np.cumsum(per_text)
        body = [_packed(ids[e - n : e]) for e, n in zip(ends, per_text, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(body, pa.binary())], ["id", "mark", "body"])


def _packed(ids: np.ndarray) -> bytes:
    """Ids in two bytes each after b"2", or in four after b"4"; the hole is the largest number."""
    real = ids[ids != HOLE]
    if not len(real) or real.max() < 0xFFFF:
        return b"2" + ids.astype("<u2").tobytes()
    return b"4" + ids.tobytes()


def _unpacked(body: bytes) -> np.ndarray:
    if body[:1] == b"4":
        return np.frombuffer(body, "<u4", offset=1)
    short = np.frombuffer(body, "<u2", offset=1)
    return np.where(short == 0xFFFF, HOLE, short).astype("<u4")


def _filled(body: bytes, fills: list[dict] | None) -> np.ndarray:
    ids = _unpacked(body)
    if not fills:
        return ids
    by_hole = sorted((f["hole"], f["ids"]) for f in fills)
    parts = [np.frombuffer(x, "<u4") for _, x in by_hole]
    holes = np.flatnonzero(ids == HOLE)
    out, at = [], 0
    for hole, part in zip(holes, parts, strict=True):
        out += [ids[at:hole], part]
        at = hole + 1
    return np.concatenate([*out, ids[at:]])


@lru_cache(maxsize=2)
def _pieces(spec: str) -> np.ndarray:
    """The vocabulary as a table id -> bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    read = json.loads(spec)
    found = {i: bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode() for piece, i in read["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in read["added_tokens"]}
    out = np.empty(max(found) + 1, object)
    out[:] = b""
    for i, piece in found.items():
        out[i] = piece
    return out


@lru_cache(maxsize=2)
def _decimals(size: int) -> np.ndarray:
    return np.array([str(i) for i in range(size)], object)


def _results(names: pa.Array, texts: list[np.ndarray], spec: str, digests: bool) -> pa.RecordBatch:
    """(id, n_tokens, first, second): ids and decoded texts, or their digests."""
    pieces = _pieces(spec)
    decimals = _decimals(len(pieces))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    one, two = [], []
    for ids in texts:
        text = b"".join(pieces[ids]).decode("utf-8", "replace")
        one.append(sha(",".join(decimals[ids]).encode()) if digests else ids.astype(np.int32))
        two.append(sha(text.encode()) if digests else text)
    kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
    return pa.RecordBatch.from_arrays([names, pa.array([len(x) for x in texts], pa.int64()), pa.array(one, kinds[0]), pa.array(two, kinds[1])], ["id", "n_tokens", "first", "second"])


def _finish(batches: Iterator[pa.RecordBatch], spec, digests: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_filled(body.as_py(), fills.as_py()) for body, fills in zip(batch.column(1), batch.column(2), strict=True)]
        yield _results(batch.column(0), texts, spec.value, digests)


def word_counts(docs: DataFrame, spec: str, text_col: str = "text") -> DataFrame:
    """(word, n): every distinct word of the texts and how often it occurs."""
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(partial(_count, split=Splitter(_specials(spec))), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(words: DataFrame, spec: str) -> DataFrame:
    """(word, n, ids): distinct words with their ids, four bytes each."""
    shared = words.sparkSession.sparkContext.broadcast(spec)
    return words.select("word", "n").mapInArrow(partial(_encode, spec=shared), "word string, n bigint, ids binary")


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, head_words: int = HEAD_WORDS, rare: str = "local", scratch: Scratch | None = None) -> DataFrame:
    """Ids of every text under the tokenizer ``spec`` (its JSON), and the text that they decode to:
    ``id_col``, n_tokens, ids and decoded, or with ``digests`` ids_sha256 and decoded_sha256.

    Ids equal those of the tokenizers library with add_special_tokens=False, for tokenizers that split as
    byte-level BPE does. Defined cases: null counts as empty; an empty text has no ids; strings of added tokens
    become their ids; texts without blanks are one word; repeated rows each get their row; null ids are kept;
    an empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    split, shared = Splitter(_specials(spec)), spark.sparkContext.broadcast(spec)
    words = scratch.table(word_counts(docs, spec, text_col))

    # as many frequent words as the table may have, whole steps of the count at a time; a word that occurs once saves no work
    small = words.where((F.col("n") > 1) & (F.octet_length("word") <= HEAD_BYTES))
    step = F.floor(F.log2("n") * STEPS).cast("int")
    least, room = 1 << 30, head_words
    for at, n in sorted(small.groupBy(step.alias("at")).count().collect(), reverse=True):
        if (room := room - n) < 0:
            break
        least = at
    head = spark.sparkContext.broadcast(Head(word_table(small.where(step >= least), spec).select("word", "ids").toArrow()))
    first, second = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    result = f"id {id_type}, n_tokens bigint, first {'string' if digests else 'array<int>'}, second string"

    # rows are named by id and text, so that both arms and a second run name them alike
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    if rare == "local":
        out = rows.select("id", "text").mapInArrow(partial(_whole, spec=shared, split=split, head=head, digests=digests), result)
    else:
        bodies = rows.mapInArrow(partial(_frequent, split=split, head=head), f"id {id_type}, mark bigint, body binary")
        places = rows.mapInArrow(partial(_rare, split=split, head=head), f"id {id_type}, mark bigint, hole int, word string")
        others = words.where((F.col("n") == 1) | (F.octet_length("word") > HEAD_BYTES) | (step < least))
        total = others.agg(F.sum("n")).first()[0] or 0
        filled = salted_join(places, word_table(others, spec), ["word"], "n", total, F.col("mark")).select("id", "mark", F.struct("hole", "ids").alias("fill"))
        fills = filled.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("fill").alias("fills"))
        joined = bodies.join(fills, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("id", "body", "fills")
        out = joined.mapInArrow(partial(_finish, spec=shared, digests=digests), result)
    return out.withColumnsRenamed({"id": id_col, "first": first, "second": second})


def decode(rows: DataFrame, spec: str, ids_col: str = "ids", out_col: str = "decoded", how: str = "lookup", scratch: Scratch | None = None) -> DataFrame:
    """``rows`` with the text of their ids (array<int>), special tokens included; null ids count as none.

    ``how="lookup"`` looks each batch's ids up in the table of pieces; ``how="join"`` joins every id with that
    table, which has a row for each id of the vocabulary, and puts the pieces together again by position.
    """
    if how == "join":
        return _decode_by_join(rows, spec, ids_col, out_col, scratch or Scratch(rows.sparkSession))
    shared = rows.sparkSession.sparkContext.broadcast(spec)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.names.index(ids_col))
            found = [b"".join(pieces[np.array(x or [], np.int64)]).decode("utf-8", "replace") for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, out_col])

    return rows.mapInArrow(texts, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))


def _decode_by_join(rows: DataFrame, spec: str, ids_col: str, out_col: str, scratch: Scratch) -> DataFrame:
    table = [(i, bytearray(p)) for i, p in enumerate(_pieces(spec))]
    pieces = rows.sparkSession.createDataFrame(table, "_pf_id int, _pf_piece binary")
    named = scratch.table(rows.withColumn("_pf_row", F.monotonically_increasing_id()))
    each = named.select("_pf_row", F.posexplode(ids_col).alias("_pf_at", "_pf_id"))
    joined = each.join(F.broadcast(pieces) if len(table) <= MOST_PIECES else pieces, "_pf_id")
    whole = joined.groupBy("_pf_row").agg(F.sort_array(F.collect_list(F.struct("_pf_at", "_pf_piece"))).alias("_pf_all"))
    text = F.aggregate("_pf_all", F.lit(b""), lambda a, x: F.concat(a, x["_pf_piece"]))
    whole = whole.select("_pf_row", F.make_valid_utf8(text.cast("string")).alias(out_col))
    return named.join(whole, "_pf_row", "left").drop("_pf_row").withColumn(out_col, F.coalesce(out_col, F.lit("")))
