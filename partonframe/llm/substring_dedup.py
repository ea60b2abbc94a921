"""Passages that repeat across documents, by content-defined chunking.

A gear hash rolls over the bytes of a text, one blank between words; a chunk ends where it is the least of
NEAR successive word ends. It sees WINDOW bytes only, so the same passage is cut alike wherever it stands, and
insertions before it shift nothing. Around each cut the LEAD words before it, which hold the hash's bytes, and
those after it make a gram of GRAM words. Every run of MIN_PASSAGE words holds NEAR successive grams whole, of which
one is at a cut wherever the run stands; so all passages of that length have a gram in common, which is
compared by digest. Consecutive grams that other documents have too make up a repeated passage. Its first and
last words, fewer than NEAR at each end, stay outside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches
from .skew import salted_join

#: Bytes that a cut depends on; a power of two.
WINDOW = 16
#: Words of a passage that is never missed, and word ends among which the one with the least hash is a cut.
MIN_PASSAGE, NEAR = 51, 9
#: Words of a gram, and how many of them stand before the cut: WINDOW bytes are of so many words at most.
GRAM, LEAD = MIN_PASSAGE - NEAR + 1, WINDOW // 2
#: Words in shared grams that make a passage.
MIN_WORDS = GRAM
#: Bytes cut at a time.
PIECE = 1 << 22

#: The gear: a random number for every byte value.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text's bytes."""
    parts = [_word_ends(data[max(0, at - WINDOW) : at + PIECE], min(at, WINDOW)) for at in range(0, len(data), PIECE)]
    found = np.zeros(0, np.int64)
    if parts:
        places = np.concatenate([p + at for (p, _), at in zip(parts, range(0, len(data), PIECE), strict=True)])
        values = np.concatenate([v for _, v in parts])
        if len(values) >= NEAR:
            least = np.lib.stride_tricks.sliding_window_view(values, NEAR).argmin(axis=1) + np.arange(len(values) - NEAR + 1)
            found = places[least[np.r_[True, least[1:] != least[:-1]]]]
    return found if len(found) and found[-1] == len(data) else np.append(found, len(data))


def _word_ends(data: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Places after the first blank behind each word, and the gear hash there; the first ``before`` bytes are context. Relative to the first byte after them."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        more = np.zeros_like(h)
        more[step:] = h[:-step] << np.uint64(step)
        h = h + more
        step *= 2
    blank = BLANK[data]
    at = np.flatnonzero((blank & ~np.r_[True, blank[:-1]])[before:])
    # the upper bits see all WINDOW bytes
    return at + 1, h[before:][at] >> np.uint64(16)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, words, starts, ends, digests) of every text: the first word of each gram, its bytes and digest."""
    for batch in batches:
        words, starts, ends, digests = [], [], [], []
        for x in batch.column(2):
            text = x.as_buffer().to_pybytes() if x.is_valid else b""
            plain = b" ".join(text.split())
            n = plain.count(b" ") + 1
            if n < GRAM:
                parts = [np.zeros(0, np.int64)] * 4
            else:
                data, blank = np.frombuffer(plain, np.uint8), BLANK[np.frombuffer(text, np.uint8)]
                # where the words begin and end in the text, and in the text with one blank between words
                begin, end = np.flatnonzero(~blank & np.r_[True, blank[:-1]]), np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
                begins = np.r_[0, np.flatnonzero(data == 32) + 1]
                first = np.searchsorted(begins, cuts(data)[:-1]) - LEAD
                first = first[(first >= 0) & (first + GRAM <= n)]
                froms, tos = begins[first], np.r_[begins[1:] - 1, len(data)][first + GRAM - 1]
                made = [xxhash.xxh3_64_intdigest(plain[a:b]) for a, b in zip(froms.tolist(), tos.tolist(), strict=True)]
                parts = [first, begin[first], end[first + GRAM - 1], np.array(made, np.uint64).view(np.int64)]
            for held, part in zip((words, starts, ends, digests), parts, strict=True):
                held.append(part)
        made = [*(_lists([p.astype(np.int32) for p in x], pa.int32()) for x in (words, starts, ends)), _lists(digests, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "mark", "words", "starts", "ends", "digests"])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def _passages(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`repeated_passages` from (id, mark, words, starts, ends, parts) of every text."""
    for batch in batches:
        docs, parts, rows = [], [], []
        offsets, flat = batch.column(5).offsets.to_pylist(), batch.column(5).values
        places = np.stack([flat.field(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        for doc, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            own = places[a:b]
            order = np.argsort(own[:, 0])
            words, starts, ends = (batch.column(i)[doc].values.to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            for k, *row in _stretches(own[order].tolist(), words.tolist(), starts.tolist(), ends.tolist(), min_words):
                docs.append(doc)
                parts.append(a + int(order[k]))
                rows.append(row)
        start, end, n_words, removed = zip(*rows, strict=True) if rows else ((),) * 4
        doc = pa.array(docs, pa.int32())
        made = [batch.column(0).take(doc), flat.field(3).take(pa.array(parts, pa.int32())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n_words, pa.int64()), pa.array(removed, pa.bool_()), batch.column(1).take(doc)]
        yield pa.RecordBatch.from_arrays(made, ["id", "other_id", "start", "end", "n_words", "removed", "mark"])


def _stretches(parts: list[list[int]], words: list[int], starts: list[int], ends: list[int], min_words: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """(part, start, end, words, removed) for a text's parts (first gram, last gram, later) in their order.

    What is removed leaves out the grams that stay, so that each is whole in its first document, and what an
    earlier part removes.
    """
    spans = [((words[first], starts[first]), (words[last] + GRAM, ends[last])) for first, last, _ in parts]
    stay: list[list[tuple[int, int]]] = []
    for (_, _, later), (low, high) in zip(parts, spans, strict=True):
        if later:
            continue
        if stay and low <= stay[-1][1]:
            stay[-1][1] = high
        else:
            stay.append([low, high])
    # neighbours make up a passage, whichever partners they have
    size, head = [0] * len(parts), 0
    for k in range(len(parts)):
        if k + 1 == len(parts) or parts[k + 1][0] > parts[k][1] + 1:
            size[head : k + 1] = [spans[k][1][0] - spans[head][0][0]] * (k + 1 - head)
            head = k + 1
    gone, near = (0, 0), 0
    for k, (low, high) in enumerate(spans):
        if size[k] < min_words:
            continue
        left = []
        if parts[k][2]:
            at = max(low, gone)
            while near < len(stay) and stay[near][1] <= at:
                near += 1
            next_one = near
            while next_one < len(stay) and stay[next_one][0] < high:
                a, b = stay[next_one]
                next_one += 1
                if at < a:
                    left.append((at, a))
                at = max(at, b)
            if at < high:
                left.append((at, high))
            gone = high
        for a, b in left or [(low, high)]:
            yield k, a[1], b[1], b[0] - a[0], bool(left)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """A row for every passage that another document has too: ``id_col``, other_id, start, end, n_words, removed, mark.

    start and end are bytes of the UTF-8 text; n_words counts its words. A passage has a row for each stretch of
    grams with the same other_id: the first document that has them, or the last one where this document is the
    first. ``removed`` is false there, and removed rows leave out the words of such grams and of each other, so
    every gram stays whole in its first document; ``min_words`` is of the passage. mark names the text (its hash).
    Defined cases: null and empty texts have no passages, nor have texts of fewer than GRAM words between blanks;
    blanks of any kind and number are alike; a passage that repeats within one document only is none; rows that
    repeat an id are one document; a null id is no other document; an empty table gives an empty result;
    extra columns are ignored; texts are cut to their end.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))
    facts = scratch.table(plain.mapInArrow(_chunks, f"id {id_type}, mark bigint, words array<int>, starts array<int>, ends array<int>, digests array<bigint>").withColumn("row", F.monotonically_increasing_id()))

    chunks = facts.select("row", "id", F.posexplode("digests").alias("at", "digest"))
    common = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = facts.agg(F.sum(F.size("digests"))).first()[0] or 0
    alike = scratch.table(salted_join(chunks, common, ["digest"], "n", total, F.col("row")).select("row", "id", "at", "digest"))
    spread = alike.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    shared = salted_join(alike, spread, ["digest"], "n", total, F.col("row"))
    other = F.when(F.col("id") == F.col("low"), F.col("high")).otherwise(F.col("low"))

    # consecutive grams of a document with the same partner, hence the same verdict, have the same difference of place and rank
    rank = F.row_number().over(Window.partitionBy("row", "other_id").orderBy("at"))
    parts = shared.select("row", "at", other.alias("other_id"), (F.col("id") > F.col("low")).alias("later")).withColumn("part", F.col("at") - rank)
    parts = parts.groupBy("row", "other_id", "part").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("later").alias("later"))
    parts = parts.groupBy("row").agg(F.collect_list(F.struct("first", "last", F.coalesce("later", F.lit(False)).alias("later"), "other_id")).alias("parts"))
    found = facts.join(parts, "row").select("id", "mark", "words", "starts", "ends", "parts")
    kinds = f"id {id_type}, other_id {id_type}, start bigint, end bigint, n_words bigint, removed boolean, mark bigint"
    return found.mapInArrow(partial(_passages, min_words), kinds).withColumnRenamed("id", id_col)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """``docs``, with all columns, without the passages that an earlier document has."""
    passages = repeated_passages(docs, id_col, text_col, min_words, scratch).where("removed")
    gone = passages.groupBy(F.col(id_col).alias("_pf_id"), F.col("mark").alias("_pf_mark")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_pf_gone"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col("_pf_id")) & (F.xxhash64(text) == F.col("_pf_mark")), "left")
    data = text.cast("binary")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("_pf_gone", lambda x: x["end"]))
    nexts = F.concat(F.transform("_pf_gone", lambda x: x["start"]), F.array(F.octet_length(text).cast("long")))
    parts = F.zip_with(edges, nexts, lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")))
    cleaned = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).cast("string")
    return joined.withColumn(text_col, F.when(F.col("_pf_gone").isNull(), F.col(text_col)).otherwise(cleaned)).select(*docs.columns)
