"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equal numbers of words. A source gets as many slots as its target needs
blocks; slot k goes to the source in whose interval of the cumulated block counts the golden-ratio point
frac((k + 1) * phi) falls, until it has its slots, so every stretch of the schedule holds the sources in their
shares. Each source's documents, shuffled by a hash, form a stream of words that is repeated as often as its
target needs and cut into blocks as long as a slot; the source's slot of rank r takes its block r. Slots and
blocks meet in a join on (source, rank). The mix is read in the order of its slots.

Points are integers modulo 2 ** POINT_BITS, so that they are exact for any number of slots. Nothing is
gathered by source: sources are rows, numbered and summed bucket by bucket, and a point finds its interval by
an equi-join on the cell of the axis that both are in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import in_order, running_total, salted_join

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating; null comes last.
CYCLE = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCK_WORDS = 1024
POINT_BITS = 48
#: The golden ratio's fraction on that axis; odd, so that the points meet every place.
GOLDEN = int((math.sqrt(5) - 1) / 2 * (1 << POINT_BITS)) | 1
#: Rows that one task orders at a time.
BUCKET_ROWS = 512
#: Sources up to which their tables are broadcast; with more they are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _mark(text: Column) -> Column:
    """Hash of a text; with its id and source it names a row."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


class Mix:
    """What a mix holds. ``facts``: a row per document; ``sources``: a row per source; ``pieces``: a row per
    document, slot and pass (slot, row, repeat, first, words: the words [first, first + words) of the text)."""

    def __init__(self, facts: DataFrame, sources: DataFrame, pieces: DataFrame, n_sources: int):
        self.facts, self.sources, self.pieces, self.n_sources = facts, sources, pieces, n_sources


def _few(df: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(df) if n_sources <= BROADCAST_SOURCES else df


def source_table(facts: DataFrame, block_words: int, scratch: Scratch) -> DataFrame:
    """A row per source: src (its number), _source, source_size, n (documents), target, limit (its whole words)
    and need (its slots); targets are shares of all words by weight.

    None is above MOST_REPEATS times its source's size; what one can't take goes to the others by weight. In
    order of size by weight, the sources up to some place are at their limit, and the words that the others
    share by weight are those of the first place where nobody else's share is above its limit.
    """
    found = facts.groupBy(F.col("source").alias("_source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = [F.col("_source").asc_nulls_last()]
    named = scratch.table(in_order(found, by_name, "_at"))
    numbered = running_total(named, [], "_at", by_name, F.lit(1), "src").withColumn("src", F.col("src").cast("long"))
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("src") % len(CYCLE) + 1).cast("int"))
    most = F.col("source_size") * MOST_REPEATS
    numbered = numbered.drop("_at").withColumns({"weight": weight, "ratio": most / weight})
    filled = numbered.where("source_size > 0")
    total, weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    by_ratio = [F.col("ratio").asc(), F.col("src").asc()]
    dealt = scratch.table(in_order(filled, by_ratio, "_at"))
    full = running_total(running_total(dealt, [], "_at", by_ratio, most, "taken"), [], "_at", by_ratio, F.col("weight"), "gone")
    unit = (F.lit(total) - F.col("taken")).cast("double") / (F.lit(weights) - F.col("gone"))
    share = full.select("ratio", unit.alias("unit")).where("unit <= ratio").agg(F.min_by("unit", F.struct("ratio", "unit"))).first()[0]
    target = F.least(most.cast("double"), F.lit(share).cast("double") * F.col("weight"))
    out = numbered.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0)).withColumn("limit", F.round("target").cast("long"))
    return scratch.table(out.withColumn("need", F.ceil(F.col("limit") / block_words)).drop("weight", "ratio"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = 42, scratch: Scratch | None = None) -> Mix:
    """Plan a mix of all documents, as many words in all as they have.

    Defined cases: null or empty texts have no words and are never taken; a null source is a source of its
    own, the last; documents are shuffled by the MD5 of seed and id, ties in order of size and text, so
    reruns agree; repeated rows are documents of their own; an empty table gives an empty mix; extra columns
    are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), _mark(F.col(text_col)).alias("mark"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    facts = scratch.table(rows.withColumns({"key": key, "row": F.monotonically_increasing_id()}))

    sources = source_table(facts, block_words, scratch)
    n_sources, n_slots = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("need"), F.lit(0))).first()
    table = sources.select(F.col("_source").alias("source"), "src", "source_size", "limit", "n")
    if n_sources <= BROADCAST_SOURCES:
        placed = facts.join(F.broadcast(table.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    else:
        placed = salted_join(facts, table, ["source"], "n", facts.count(), F.col("row"))

    # a place in its source's shuffled stream for every document with words
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BUCKET_ROWS))).cast("int")
    bucket = F.expr("shiftright(cast(conv(substring(key, 1, 8), 16, 10) as bigint), 32 - _bits)")
    order = [F.col("key"), F.col("size"), F.col("mark"), F.col("row")]
    stream = running_total(placed.where("size > 0").withColumn("_bits", bits).withColumn("bucket", bucket), ["src"], "bucket", order, F.col("size"), "start")
    again = stream.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1)))).withColumn("at", F.col("repeat") * F.col("source_size") + F.col("start"))
    again = again.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("limit"))).where("at < end")
    blocks = again.withColumn("rank", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(end - 1) div {block_words}"))))
    first = F.greatest(F.col("at"), F.col("rank") * block_words)
    words = F.least(F.col("end"), (F.col("rank") + 1) * block_words) - first
    blocks = blocks.select("src", "rank", "row", "repeat", (first - F.col("at")).alias("first"), words.alias("words"))

    pieces = blocks.join(schedule(spark, sources.select("src", "need"), n_sources, n_slots, scratch), ["src", "rank"])
    return Mix(facts.drop("key"), sources.select("_source", "source_size", "target", "n"), pieces.select("slot", "src", "row", "repeat", "first", "words"), n_sources)


def points(spark: SparkSession, n: int) -> DataFrame:
    """(slot, point): the first ``n`` golden-ratio points, multiplied in halves so that nothing overflows."""
    half, mask = POINT_BITS // 2, (1 << POINT_BITS // 2) - 1
    low, high = F.col("k").bitwiseAND(F.lit(mask)), F.shiftright("k", half).bitwiseAND(F.lit(mask))
    cross = (low * (GOLDEN >> half) + high * (GOLDEN & mask)).bitwiseAND(F.lit(mask))
    point = (low * (GOLDEN & mask) + F.shiftleft(cross, half)).bitwiseAND(F.lit((1 << POINT_BITS) - 1))
    return spark.range(n).select(F.col("id").alias("slot"), (F.col("id") + 1).alias("k")).select("slot", point.alias("point"))


def schedule(spark: SparkSession, sources: DataFrame, n_sources: int, n_slots: int, scratch: Scratch) -> DataFrame:
    """(src, rank, slot) for the sources (src, need): every source's slots in their order.

    Points of a source that has its slots already are passed over, so slots are numbered with gaps; the
    sequence goes on until every source has its own, which takes less than three times their number.
    """
    if not n_slots:
        return spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("rank"), F.col("id").alias("slot"))
    by_number = [F.col("src").asc()]
    dealt = scratch.table(in_order(sources.where("need > 0"), by_number, "_at"))
    ends = running_total(dealt, [], "_at", by_number, F.col("need"), "before")
    border = lambda x: f"cast((cast({x} as decimal(20, 0)) * {1 << POINT_BITS}) div {n_slots} as bigint)"
    ends = ends.select("src", "need", F.expr(border("before")).alias("low"), F.expr(border("before + need")).alias("high"))
    shift = POINT_BITS - max(0, math.ceil(math.log2(max(1, n_sources))))
    cells = F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift)))
    ends = scratch.table(ends.withColumn("cell", cells))

    def drawn(n: int) -> DataFrame:
        found = points(spark, n).withColumn("cell", F.shiftright("point", shift)).join(_few(ends, n_sources), "cell")
        return found.where("low <= point and point < high").select("slot", "src", "need")

    n = n_slots
    while True:
        there = drawn(n).groupBy("src").agg(F.count(F.lit(1)).alias("have"))
        lack = dealt.select("src", "need").join(there, "src", "left").select("need", (F.col("need") - F.coalesce("have", F.lit(0))).alias("lack")).where("lack > 0")
        more = lack.agg(F.max((F.col("lack") + 1) / F.col("need"))).first()[0]
        if more is None:
            break
        n += math.ceil(more * n_slots)
    ranked = running_total(drawn(n).withColumn("bucket", F.expr(f"slot div {BUCKET_ROWS}")), ["src"], "bucket", [F.col("slot")], F.lit(1), "rank")
    return ranked.where("rank < need").select("src", F.col("rank").cast("long").alias("rank"), "slot")


def taken(plan: Mix) -> DataFrame:
    """Of every document: id, size, source_size, target (of its source), taken (words, repeats counted),
    first_slot (where the mix first takes it, -1 if nowhere) and n_pieces (in how many pieces)."""
    sums = plan.pieces.groupBy(F.col("row").alias("_row")).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_pieces"))
    if plan.n_sources <= BROADCAST_SOURCES:
        rows = plan.facts.join(F.broadcast(plan.sources), F.col("source").eqNullSafe(F.col("_source")))
    else:
        rows = salted_join(plan.facts, plan.sources.withColumnRenamed("_source", "source"), ["source"], "n", plan.facts.count(), F.col("row"))
    rows = rows.join(sums, F.col("row") == F.col("_row"), "left")
    return rows.select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_slot", F.lit(-1)).alias("first_slot"), F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"))


def mixed_documents(docs: DataFrame, plan: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for every time that the mix takes a document, in
    the order of the slots where it begins to.

    The last document of a source's stream may be cut by the source's target; it is a row if at least half of
    its words are taken. Documents that the mix doesn't take are left out. Rows are told apart by id, source and
    text, so ids may be null or repeat; of rows that agree in all three, one stands for all, as often as they are taken together.
    """
    passes = plan.pieces.groupBy("row", "repeat").agg(F.sum("words").alias("words"), F.min("slot").alias("_pf_slot"))
    names = [F.col(c).alias(f"_pf_{c}") for c in ("id", "source", "mark")]
    whole = passes.join(plan.facts, "row").where(2 * F.col("words") >= F.col("size")).select(*names, "_pf_slot")
    match = docs[id_col].eqNullSafe(F.col("_pf_id")) & docs[source_col].cast("string").eqNullSafe(F.col("_pf_source")) & (_mark(docs[text_col]) == F.col("_pf_mark"))
    again = plan.facts.groupBy(*names).agg(F.count(F.lit(1)).alias("_pf_n")).where("_pf_n > 1").drop("_pf_n")
    if not again.isEmpty():
        named = docs.join(again, match, "left_semi").withColumns({"_pf_source": F.col(source_col).cast("string"), "_pf_mark": _mark(F.col(text_col))})
        single = named.dropDuplicates([id_col, "_pf_source", "_pf_mark"]).drop("_pf_source", "_pf_mark")
        docs = docs.join(again, match, "left_anti").unionByName(single)
        match = docs[id_col].eqNullSafe(F.col("_pf_id")) & docs[source_col].cast("string").eqNullSafe(F.col("_pf_source")) & (_mark(docs[text_col]) == F.col("_pf_mark"))
    found = docs.join(whole, match)
    return found.repartitionByRange("_pf_slot").sortWithinPartitions("_pf_slot").select(*docs.columns)


#: The same mix in DuckDB SQL.
ORACLE = f"""
    with f as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size, md5('42:' || doc_id) as key from documents),
        s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 src from f group by source),
        w as (select *, list_value(5e0, 2e0, 1e0)[src % 3 + 1] weight from s),
        c as (select *, {MOST_REPEATS} * source_size / weight as ratio, coalesce(sum({MOST_REPEATS} * source_size) over o, 0) spent, coalesce(sum(weight) over o, 0) gone
              from w where source_size > 0 window o as (order by {MOST_REPEATS} * source_size / weight, src rows between unbounded preceding and 1 preceding)),
        u as (select arg_min(unit, place) unit from (select ratio, row_number() over (order by ratio, src) place, ((select sum(source_size) from s) - spent)::double / ((select sum(weight) from c) - gone) unit from c) where unit <= ratio),
        t as (select w.*, least(({MOST_REPEATS} * source_size)::double, (select unit from u) * weight) target from w),
        l as (select *, round(target)::bigint lim, ceil(round(target) / {BLOCK_WORDS}.0)::bigint need from t),
        b as (select *, sum(need) over (order by src) - need before, sum(need) over () total from l),
        i as (select *, (before::hugeint * {1 << POINT_BITS}) // total low, ((before + need)::hugeint * {1 << POINT_BITS}) // total high from b where need > 0),
        p as (select k as slot, ((k + 1)::hugeint * {GOLDEN}) % {1 << POINT_BITS} point from (select unnest(range(3 * (select sum(need)::bigint from l) + 64)) k)),
        r as (select src, slot, need, row_number() over (partition by src order by slot) - 1 rank from p join i on point >= low and point < high),
        d as (select f.*, src, source_size, lim, sum(size) over (partition by src order by key, doc_id) - size as start from f join l on f.source is not distinct from l.source where size > 0),
        a as (select *, repeat * source_size + start as begin_at, least(repeat * source_size + start + size, lim) as stop from d, (select unnest(range({MOST_REPEATS})) repeat) where repeat * source_size + start < lim),
        k as (select *, unnest(range(begin_at::bigint // {BLOCK_WORDS}, (stop::bigint - 1) // {BLOCK_WORDS} + 1)) rank from a),
        g as (select doc_id, sum(least(stop, (k.rank + 1) * {BLOCK_WORDS}) - greatest(begin_at, k.rank * {BLOCK_WORDS})) taken, min(slot) first_slot, count(*) n_pieces from k join r on k.src = r.src and k.rank = r.rank where r.rank < need group by doc_id)
    select f.doc_id, size, source_size, case when source_size > 0 then target else 0e0 end as target, coalesce(taken, 0)::bigint taken, coalesce(first_slot, -1) first_slot, coalesce(n_pieces, 0) n_pieces
    from f join l on f.source is not distinct from l.source left join g on f.doc_id = g.doc_id"""
