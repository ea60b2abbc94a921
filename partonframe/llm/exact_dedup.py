"""Exact duplicates by distributed most-significant-digit radix partitioning.

A document's record is its byte length followed by its normalised bytes. Each round takes the next digit
of the record, a run of successive bytes, and splits every group by it; groups of one document leave, groups
whose bytes have ended are classes of equal texts. The first digit (the length and 32 bytes) separates nearly
everything and needs no text in the shuffle; later digits are longer, so that texts of any length end after a
few rounds. Equality is decided by bytes alone: the SHA-256 column is an output, and names a row when
verdicts are joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches
from .skew import HOT_PARTS, salted_join

HEAD = 32
FIRST_WIDTH, GROWTH, MOST_WIDTH = 1024, 32, 1 << 20


def _normalised(batch: pa.RecordBatch) -> pa.Array:
    """Texts with A-Z lower-cased; null counts as empty."""
    return pc.ascii_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), "")).cast(pa.large_binary())


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = _normalised(batch)
        sha = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in text], pa.string())
        head = pc.binary_slice(text, 0, HEAD).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(text).cast(pa.int64()), head, sha], ["id", "size", "head", "sha"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = _normalised(batch)
        sha = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in text], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), sha, batch.column(2), batch.column(3), text.cast(pa.binary())], ["id", "sha", "size", "salts", "body"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Class of equal texts of every row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays. Defined cases:
    null text counts as empty; null ids are smaller than all others and never win over one; rows that repeat
    an id and its text each count in group_size and share one verdict; an empty table gives an empty result;
    extra columns are ignored; texts may be of any length.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    facts = scratch.table(plain.mapInArrow(_facts, f"id {id_type}, size bigint, head binary, sha string").withColumn("row", F.monotonically_increasing_id()))
    total = facts.count()
    cut = max(1000, total // HOT_PARTS)
    salts = (F.floor(F.col("n") / F.lit(cut)) + 1).cast("int")

    # round 1: length and first bytes, without texts
    shared = facts.groupBy("size", "head").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    alike = salted_join(facts.select("id", "size", "head", "row"), shared, ["size", "head"], "n", total, F.col("row"))
    wanted = alike.select(F.col("id").alias("_id"), F.col("size").alias("_size")).distinct()
    # salts belong to a group, here to a size, never to a row; at most HOT_PARTS sizes have more than one
    hot = shared.where(F.col("n") >= cut).groupBy(F.col("size").alias("_hot")).agg(F.max("n").alias("n")).select("_hot", salts.alias("salts"))
    sized = plain.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    texts = sized.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size"))).join(F.broadcast(hot), F.col("size") == F.col("_hot"), "left")
    state = texts.select("id", "text", "size", F.coalesce("salts", F.lit(1)).alias("salts")).mapInArrow(_bodies, f"id {id_type}, sha string, size bigint, salts int, body binary")
    bodies = state = scratch.table(state.withColumn("row", F.monotonically_increasing_id()).withColumn("gid", F.col("size")))

    # later rounds: split every group by its next bytes
    members, offset, width = [], 0, FIRST_WIDTH
    while not state.isEmpty():
        keyed = state.withColumn("digit", F.substring("body", 1, width)).withColumn("salt", F.pmod("row", F.col("salts").cast("long")).cast("int"))
        groups = keyed.groupBy("gid", "digit").agg(F.max("salts").alias("salts"), F.count(F.lit(1)).alias("n"), F.min("row").alias("next_gid"), F.max("id").alias("keep_id")).where("n > 1")
        groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        ended = F.col("size") <= offset + width
        split = keyed.join(groups, ["gid", "digit", "salt"]).select(
            "id", "sha", "size", "row", F.col("next_gid").alias("gid"), salts.alias("salts"), "keep_id", F.col("n").alias("group_size"),
            F.when(~ended, F.expr(f"substring(body, {width + 1})")).alias("body"),
        )
        done = scratch.table(split)
        if not members:
            scratch.drop(bodies)
        members.append(done.where(F.col("body").isNull()).select("id", "sha", "keep_id", "group_size"))
        state = done.where(F.col("body").isNotNull()).select("id", "sha", "size", "salts", "body", "row", "gid")
        offset, width = offset + width, min(MOST_WIDTH, width * GROWTH)

    out = facts.select("id", "sha")
    if members:
        found = members[0]
        for more in members[1:]:
            found = found.unionByName(more)
        found = found.groupBy(F.col("id").alias("_id"), F.col("sha").alias("_sha")).agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        out = out.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    else:
        out = out.withColumn("keep_id", F.lit(None).cast(id_type)).withColumn("group_size", F.lit(None).cast("long"))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay; of rows that repeat an id and its text, one."""
    scratch = scratch or Scratch(docs.sparkSession)
    verdict = exact_duplicates(docs, id_col, text_col, scratch)
    named = scratch.table(verdict.select(F.col(id_col).alias("_pf_id"), F.col("text_sha256").alias("_pf_sha"), "kept"))
    # an id that names different texts is decided text by text; the digest is computed for matching ids only
    normal = F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    match = docs[id_col].eqNullSafe(F.col("_pf_id")) & (normal == F.col("_pf_sha"))
    stay = docs.join(named.where(~F.col("kept")).distinct(), match, "left_anti")
    again = named.where(F.col("kept")).groupBy("_pf_id", "_pf_sha").agg(F.count(F.lit(1)).alias("_pf_n")).where("_pf_n > 1")
    if again.isEmpty():
        return stay
    repeated = stay.join(again, match, "left_semi").withColumn("_pf_text", normal).dropDuplicates([id_col, "_pf_text"]).drop("_pf_text")
    return stay.join(again, match, "left_anti").unionByName(repeated)
