"""Cross-site boilerplate lines by their distinct-site spread.

A line that very many sites carry is boilerplate. Each line hash gets a HyperLogLog sketch of its sites;
sketches merge by aggregation, so neither a line nor a site is ever gathered in one place. Lines whose
estimate is near the threshold get an exact distinct count; the others are decided by the estimate, which is
off by more than the band only where the sketch's own error bound fails.

DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import once
from .scratch import Scratch
from .skew import salted_join

MIN_SITES = 10
#: Log2 of the sketch's buckets; relative standard error 1.04 / sqrt(2 ** SKETCH).
SKETCH = 12
#: Standard errors on either side of the threshold that count as near it, and sites at least.
BAND, BAND_SITES = 6.0, 2
BLANKS = " \t\n\x0b\x0c\r"
#: Near lines up to which they are broadcast; with more they are joined by a shuffle.
BROADCAST_LINES = 1 << 18


def boilerplate(lines: DataFrame, min_sites: int, total: int, scratch: Scratch) -> DataFrame:
    """(line, n): hashes of the lines that at least ``min_sites`` sites carry, and their occurrences.

    ``lines`` has ``total`` rows with line, site and row, a number that deals a common line's rows out.
    """
    width = max(BAND_SITES, BAND * 1.04 / math.sqrt(1 << SKETCH) * min_sites)
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", SKETCH).alias("sketch"), F.count(F.lit(1)).alias("n"))
    spread = spread.where("n >= 2" if min_sites > 1 else "true").select("line", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = scratch.table(spread.where(F.col("sites") >= min_sites - width))
    near = spread.where(F.col("sites") < min_sites + width).select("line", "n")
    # of all lines only the near ones move, and a common one's sites are combined before they do
    if near.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        few = lines.select("line", "site").join(F.broadcast(near.select("line")), "line", "left_semi")
    else:
        few = salted_join(lines, near, ["line"], "n", total, F.col("row")).select("line", "site")
    pairs = few.distinct()
    exact = pairs.where(F.col("site").isNotNull()).groupBy("line").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_sites)
    sure = spread.where(F.col("sites") >= min_sites + width).select("line", "n")
    return sure.unionByName(near.join(exact, "line", "left_semi"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, scratch: Scratch | None = None) -> DataFrame:
    """``id_col``, n_lines, n_removed and the cleaned ``text_col`` of every row.

    Lines are \\n-split and compared as they are; lines of blanks stay. Defined cases: a null text stays null
    and has no lines; a null site is no site; repeated rows each get their row; an empty table gives an empty
    result; extra columns are ignored; a text of any length is cut line by line.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    # rows are named by id and text: repeated rows have the same lines to remove
    rows = docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    split = rows.select("id", "mark", F.col("site").cast("string").alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("place", "raw"))
    # the site's hash is enough: it is only counted
    lines = split.where(F.btrim("raw", F.lit(BLANKS)) != "").select("id", "mark", "place", F.xxhash64("raw").alias("line"), F.when(F.col("site").isNotNull(), F.xxhash64("site")).alias("site"))
    lines = scratch.table(lines.withColumn("row", F.monotonically_increasing_id()))
    total = lines.count()
    common = scratch.table(boilerplate(lines.select("line", "site", "row"), min_sites, total, scratch))
    hits = salted_join(lines.select("id", "mark", "place", "line", "row"), common, ["line"], "n", total, F.col("row"))
    gone = hits.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.sort_array(F.collect_set("place")).alias("_gone"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    parts = F.split("text", "\n", -1)
    places = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_gone")
    kept = once(parts, lambda x: F.array_join(F.transform(places(x), lambda i: F.get(x, i)), "\n"))
    return joined.select(
        F.col("id").alias(id_col), F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias(text_col),
    )


ORACLE = """
    with l as (select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) i, unnest(string_split(text, chr(10))) line from documents),
         b as (select line from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by line having count(distinct source) >= 10)
    select doc_id, count(*) n_lines, count(*) filter (b.line is not null) n_removed,
           sha256(coalesce(string_agg(l.line, chr(10) order by i) filter (b.line is null), '')) text_sha256
    from l left join b on l.line = b.line group by doc_id"""
