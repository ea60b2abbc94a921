"""How filters interact: what each removes at each place of every order, and what it removes alone.

A document's failures are a mask of bits, one a filter. Documents are counted by part and mask, and a subset-zeta
transform turns these counts into the documents that survive every subset of the filters: ``within[m]`` adds up the
counts of all masks inside ``m``, and what survives a subset S is ``within`` of all filters but S. A step of an order
lies between two neighbouring subsets, so what it removes is the difference of two entries; the same holds for
labelled documents. No document is looked at again for any order.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import once

LETTERS = "ABCDE"
FULL = (1 << len(LETTERS)) - 1
#: Rows without an id are dealt by so many salts to the join with the labels, where none can match.
NULL_SALTS = 256
BLANK = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits of the filters that look at one text: few words, few distinct words, many capitals, special characters."""
    words = F.filter(F.split(text, BLANK, -1), lambda w: w != "")
    counts = once(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    tests = [
        lambda c: c["n"] < 100,
        lambda c: 100 * c["kinds"] < 80 * c["n"],
        lambda c: 100 * capitals > 10 * F.length(text),
        lambda c: text.rlike("[#$%&*|]"),
    ]
    return once(counts, lambda c: sum((F.when(t(c), 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, and how many of them have each label.

    Texts are sent as digests. Equal texts of one part are counted where they are before they are sent, so a
    text that a third of all documents share is a few rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    salt = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(text), F.lit(NULL_SALTS))).otherwise(0).cast("long")
    facts = docs.select(
        F.col(id_col).alias("id"), salt.alias("salt"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"),
    )
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("_salt")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = facts.join(marks, (F.col("id") == F.col("_id")) & (F.col("salt") == F.col("_salt")), "left")
    kind = ["digest", "part", "mask", "good", "toxic"]
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # rows that repeat an id are together after the join; of a text's documents, those with the least id are no copies, nor are those without one
    each = known.groupBy("id", "salt", *kind).agg(F.count(F.lit(1)).alias("n"))
    alike = each.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    least = alike.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    spared = F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0) + F.col("n_null")
    copy = 1 << LETTERS.index("E")
    split = F.array(F.struct(F.col("mask").alias("mask"), spared.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - spared).alias("n")))
    rows = least.select("part", "good", "toxic", F.explode(split).alias("x"))
    labelled = lambda flag: F.sum(F.when(F.col(flag), F.col("x.n")).otherwise(0)).alias(flag)
    return rows.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), labelled("good"), labelled("toxic"))


def _zeta(counts: Column) -> Column:
    """Of an array over all masks, the array whose entry m is the sum over the masks inside m, bit by bit."""
    for bit in range(len(LETTERS)):
        counts = once(counts, _add(1 << bit))
    return counts


def _add(bit: int) -> Callable[[Column], Column]:
    """Adds to every entry with the bit the one without it."""
    return lambda a: F.transform(a, lambda x, m: F.when(m.bitwiseAND(F.lit(bit)) != 0, x + F.get(a, m - bit)).otherwise(x))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, n, good, toxic): arrays over all subsets S of the filters, the documents of the part that pass all of S."""
    names = ("n", "good", "toxic")
    listed = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names)))).alias("by"))
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(FULL)), lambda m: F.coalesce(F.element_at("by", m)[c], F.lit(0).cast("long")))
    # what survives S has failures inside the complement of S, which stands at the mirrored place
    return listed.select("part", *[F.reverse(_zeta(dense(c))).alias(c) for c in names])


def audit(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``counts`` is :func:`mask_counts`. The 120 orders are a constant; each row reads a few entries of its part's arrays.
    """
    orders = [("".join(o), k + 1, LETTERS.index(o[k]), sum(1 << LETTERS.index(x) for x in o[:k])) for o in permutations(LETTERS) for k in range(len(o))]
    steps = counts.sparkSession.createDataFrame(orders, "filter_order string, step int, bit int, before int")
    own = F.expr("shiftleft(1, bit)")
    at = lambda c, subset: F.get(c, subset)
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("before") + own)
    rows = survivors(counts).join(F.broadcast(steps)).select(
        "part", "filter_order", "step", "bit", at("n", F.col("before") + own).alias("kept"), lost("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", own) - lost("n")).alias("redundant"), (at("n", F.lit(FULL) - own) - at("n", F.lit(FULL))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """:func:`audit` of five filters over whole texts, by part: A under 100 words; B distinct words below four fifths
    of the words; C capitals A-Z above a tenth of the characters; D any of ``#$%&*|``; E identical to the text of a
    smaller id.

    ``labels`` has doc_id, quality and toxic; a document has a label if any of its rows there says 1. Defined cases:
    null text counts as empty, a null part as the empty string; a document without id has no labels, is no copy and
    makes none; rows that repeat an id and its text are no copies of one another; an empty text fails A only (and E);
    an empty table gives an empty result; extra columns are ignored; texts may be of any length.
    """
    return audit(mask_counts(docs, labels, id_col, text_col, part_col))


_FAILS = {
    "A": "len(w) < 100", "B": "100 * len(list_distinct(w)) < 80 * len(w)", "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)",
    "D": "regexp_matches(t, '[#$%&*|]')", "E": "coalesce(doc_id > min(doc_id) over (partition by t), false)",
}
#: DuckDB SQL: every document is followed through every order, mask by mask, without subsets.
ORACLE = f"""
    with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
        w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from d),
        f as (select w.doc_id, part, {', '.join(f'{test} as {k}' for k, test in _FAILS.items())} from w),
        b as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
        m as (select part, {' || '.join(f"case when {k} then '{k}' else '' end" for k in LETTERS)} as fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from f left join b on f.doc_id = b.doc_id group by all),
        l as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
        o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s as (select filter_order, k::int as step, substr(filter_order, k, 1) as own, substr(filter_order, 1, k - 1) as earlier from o, range(1, 6) r(k)),
        p as (select distinct part from m),
        x as (select p.part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) as fails_own, len(list_filter(string_split(earlier, ''), lambda k: k <> '' and contains(fails, k))) > 0 as gone
              from p cross join s join m on m.part = p.part),
        r as (select part, filter_order, step, own, coalesce(sum(n) filter (not gone and not fails_own), 0)::bigint kept, coalesce(sum(n) filter (not gone and fails_own), 0)::bigint removed,
              coalesce(sum(n) filter (gone and fails_own), 0)::bigint redundant, coalesce(sum(n) filter (fails = own), 0)::bigint unique_fails,
              coalesce(sum(good) filter (not gone and fails_own), 0)::bigint good_lost, coalesce(sum(toxic) filter (not gone and fails_own), 0)::bigint toxic_lost from x group by all)
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r"""
