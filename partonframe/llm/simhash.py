"""Near duplicates by SimHash fingerprints, found through a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two that differ in at most two bits share at least six of them, so
among any seven positions at least five. The index posts every distinct fingerprint under each choice of
five of the first seven positions with their bytes (postings of single bytes would grow with the square of
the input); candidates in a posting list are tallied over all eight positions, those with at least six shared
bytes are kept, and their differing bits are counted.

Copies collapse before the index, so that a list holds distinct fingerprints only. A long list links its
members without pairing them: two members differ in bits of the three free bytes only, so each choice of two
free bits is cleared in turn and members that become equal are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, bound_batches
from .skew import salted_join

SHINGLE, SEED, MOST_BITS = 3, 42, 2
BYTES = 8
#: Shared positional bytes that MOST_BITS differing bits leave at least.
LEAST_SHARED = BYTES - MOST_BITS
#: Positions a posting key fixes, out of the first BYTES - LEAST_SHARED + INDEX_BYTES.
INDEX_BYTES = 5
POSITIONS = list(combinations(range(BYTES - LEAST_SHARED + INDEX_BYTES), INDEX_BYTES))
#: Length from which a posting list is linked by cleared bits instead of pairs.
LONG_LIST = 32
#: Hashes counted at a time.
PIECE = 1 << 16


def fingerprint_of(texts: list[bytes]) -> np.ndarray:
    """uint64 fingerprints of UTF-8 texts, A-Z counting as a-z."""
    votes, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes, owners = [], []

    def count() -> None:
        if not hashes:
            return
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who, starts, n = np.unique(np.array(owners), return_index=True, return_counts=True)
        votes[who] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        totals[who] += n
        hashes.clear()
        owners.clear()

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()
        joined = b" ".join(words)
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        n = max(1, len(words) - SHINGLE + 1) if words else 0
        for at in range(0, n, PIECE):
            end = min(n, at + PIECE)
            hashes += [digest(joined[a:b], SEED) for a, b in zip(starts[at:end], (x - 1 for x in starts[at + SHINGLE : end + SHINGLE] or starts[-1:]))]
            owners += [i] * (end - at)
            if len(hashes) >= PIECE:
                count()
    count()
    on = 2 * votes > totals[:, None]
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
        rest = [batch.column(i) for i in range(2, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprint_of(texts).view(np.int64)), *rest], ["id", "fp", *batch.schema.names[2:]])


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; parents are roots, before and after."""
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            higher = parent[parent]
            if np.array_equal(higher, parent):
                break
            parent = higher
    return parent


def linked(choice: np.ndarray, key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Place of the first fingerprint that each one is linked with inside its posting list; rows are sorted by (choice, key)."""
    parent = np.arange(len(fp))
    if len(fp) < 2:
        return parent
    new = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
    length = np.diff(np.r_[new, len(fp)])
    list_of = np.repeat(np.arange(len(new)), length)
    for d in range(1, min(LONG_LIST, int(length.max()))):
        i = np.flatnonzero((list_of[d:] == list_of[:-d]) & (length[list_of[d:]] <= LONG_LIST))
        differ = fp[i] ^ fp[i + d]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        good = (shared >= LEAST_SHARED) & (np.bitwise_count(differ) <= MOST_BITS)
        parent = _merge(parent, i[good], i[good] + d)
    for l in np.flatnonzero(length > LONG_LIST):
        own = np.arange(new[l], new[l] + length[l])
        free = [b for b in range(64) if b // 8 not in POSITIONS[choice[new[l]]]]
        for i, j in combinations(free, MOST_BITS):
            cleared = fp[own] & ~np.uint64(1 << i | 1 << j)
            order = np.argsort(cleared, kind="stable")
            equal = np.flatnonzero(cleared[order][1:] == cleared[order][:-1])
            parent = _merge(parent, own[order[equal]], own[order[equal + 1]])
    return parent


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each posting list; its rows come sorted by key, a list may span batches.

    A list has 2 ** 24 fingerprints at most, since its key leaves three bytes free.
    """
    held: list[list[np.ndarray]] = []  # parts of the list that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        others = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut or held and any(held[0][i][0] != rows[i][0] for i in range(2)):
            yield from _edges([*held, [x[:cut] for x in rows]])
            held = []
        held.append([x[cut:] for x in rows])
    if held:
        yield from _edges(held)


def _edges(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    choice, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    parent = linked(choice, key, fp.view(np.uint64))
    i = np.flatnonzero(parent != np.arange(len(parent)))
    if len(i):
        yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[parent[i]])], ["a", "b"])


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``id_col``, fingerprint (16 hex digits) and component_id (the least id that links lead to) of every row.

    Fingerprints link at MOST_BITS or fewer differing bits. Defined cases: a null, empty or wordless text has
    fingerprint zero and links like any other; fewer than three words are one shingle; repeated rows share
    their class; a null id is in its class but never names it, unless the class has no other; an empty table
    gives an empty result; extra columns are ignored.
    """
    out = _classes(docs, id_col, text_col, scratch, named=False)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _mark(text: Column) -> Column:
    """Hash of a text; with its id it names a row."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _classes(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch | None, named: bool) -> DataFrame:
    """(id, fp, component_id) of every row; if ``named``, also its mark and ``root``, which names the class where ids are null or repeat."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), *[_mark(F.col(text_col)).alias("mark")] * named)
    facts = scratch.table(plain.mapInArrow(_fingerprints, f"id {id_type}, fp bigint" + ", mark bigint" * named).withColumn("row", F.monotonically_increasing_id()))
    total = facts.count()
    distinct = scratch.table(facts.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))

    keys = [F.struct(F.lit(c).cast("smallint").alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for c, p in enumerate(POSITIONS)]
    posted = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.choice", "k.key", "fp")
    lists = posted.repartition("choice", "key").sortWithinPartitions("choice", "key")
    links = components(lists.mapInArrow(_link, "a bigint, b bigint"), scratch)

    # salted joins hold their sides several times, so these tables, small beside the texts, are written
    rooted = scratch.table(distinct.join(links, distinct["fp"] == links["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    classes = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
    labelled = scratch.table(salted_join(rooted, classes, ["root"], "members", total, F.col("fp")).select("fp", "n", "component_id", *["root"] * named))
    return salted_join(facts, labelled, ["fp"], "n", total, F.col("row")).select("id", "fp", "component_id", *["mark", "root"] * named)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row of ``docs`` of each class, with all columns: the row with the least id, and of rows that repeat it, one.

    Rows are told apart by id and text, so ids may be null or repeat; a null id stays only in a class that has no other.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    verdict = _classes(docs, id_col, text_col, scratch, named=True)
    names = verdict.groupBy(F.col("id").alias("_pf_id"), F.col("mark").alias("_pf_mark"), "root").agg(F.count(F.lit(1)).alias("_pf_n"), F.first("component_id").alias("component_id"))
    names = scratch.table(names.withColumn("first", F.col("_pf_id").eqNullSafe(F.col("component_id"))).drop("component_id"))
    # several texts with the id that names the class: the one with the least hash stays
    rivals = scratch.table(names.where("first").groupBy("root").agg(F.min("_pf_mark").alias("least"), F.count(F.lit(1)).alias("rivals")).where("rivals > 1"))
    gone = names.where("not first").select("_pf_id", "_pf_mark")
    if not rivals.isEmpty():
        ranked = salted_join(names.where("first"), rivals, ["root"], "rivals", names.count(), F.col("_pf_mark"))
        gone = gone.unionByName(ranked.where("_pf_mark != least").select("_pf_id", "_pf_mark"))
    match = docs[id_col].eqNullSafe(F.col("_pf_id")) & (_mark(docs[text_col]) == F.col("_pf_mark"))
    stay = docs.join(gone, match, "left_anti")
    again = names.where("first and _pf_n > 1").select("_pf_id", "_pf_mark")
    if again.isEmpty():
        return stay
    repeated = stay.join(again, match, "left_semi").withColumn("_pf_mark", _mark(F.col(text_col))).dropDuplicates([id_col, "_pf_mark"]).drop("_pf_mark")
    return stay.join(again, match, "left_anti").unionByName(repeated)
