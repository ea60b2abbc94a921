"""Pointers between the objects of an event, and fixes of detector columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import apply, flatten


def zero_based(refs: Column, depth: int = 1) -> Column:
    """One-based references as zero-based indices, at any depth; 0, a null reference, becomes -1."""
    return apply(refs, lambda x: x.cast("long") - 1, depth)


def reflect_references(source: DataFrame, target: DataFrame) -> DataFrame:
    """Back-pointers of references: (event_id, idx, ref) of every target, -1 without one; of several the last source wins.

    ``source`` has event_id, idx and ref (a target's idx, or a list of them), ``target`` event_id and idx.
    """
    kind = dict(source.dtypes)["ref"]
    flat = source.withColumn("ref", F.explode("ref")) if kind.startswith("array") else source
    back = flat.where("ref >= 0").groupBy("event_id", F.col("ref").alias("idx")).agg(F.max("idx").alias("ref"))
    return target.select("event_id", "idx").join(back, ["event_id", "idx"], "left").withColumn("ref", F.coalesce("ref", F.lit(-1)))


def objects(tables: Mapping[str, DataFrame], uid: str = "uid") -> DataFrame:
    """The typed pointer table (event_id, uid, kind, target) of several tables (event_id, idx, ``uid``) whose objects share one space of unique ids in an event."""
    each = [t.select("event_id", F.col(uid).cast("long").alias("uid"), F.lit(kind).alias("kind"), F.col("idx").cast("long").alias("target")) for kind, t in tables.items()]
    return reduce(DataFrame.unionByName, each)


def resolve(sources: DataFrame, objects: DataFrame, refs: str = "refs") -> DataFrame:
    """(event_id, idx, place, uid, kind, target): every reference of ragged lists and the object that it points to.

    ``sources`` has event_id, idx and ``refs``, unique ids in lists of lists of any depth; places count along the
    flattened list. A reference without an object in its event has kind null and target -1. One join answers for
    all kinds, by event and id; objects that share an id are all found.
    """
    each = sources.select("event_id", F.col("idx").cast("long").alias("idx"), F.posexplode(flatten(sources, refs)).alias("place", "uid")).withColumn("uid", F.col("uid").cast("long"))
    found = each.join(objects, ["event_id", "uid"], "left")
    return found.select("event_id", "idx", "place", "uid", "kind", F.coalesce("target", F.lit(-1).cast("long")).alias("target"))


def by_kind(sources: DataFrame, resolved: DataFrame, kinds: list[str], refs: str = "refs") -> DataFrame:
    """``sources`` with a list for each kind, as long as the flattened references: the targets of this kind in order of
    place, -1 where a reference points to another kind or nowhere. Sources without references have empty lists."""
    at = lambda k: F.transform("_all", lambda x: F.when(x["kind"].eqNullSafe(F.lit(k)), x["target"]).otherwise(F.lit(-1).cast("long"))).alias(k)
    listed = resolved.groupBy("event_id", "idx").agg(F.sort_array(F.collect_list(F.struct("place", "kind", "target"))).alias("_all"))
    none = F.array().cast("array<bigint>")
    listed = listed.select("event_id", "idx", *[at(k) for k in kinds])
    return sources.join(listed, ["event_id", "idx"], "left").withColumns({k: F.coalesce(k, none) for k in kinds})


def back_pointers(resolved: DataFrame, objects: DataFrame) -> DataFrame:
    """(event_id, kind, idx, ref) of every object: the last source that points to it, -1 without one."""
    back = resolved.where("kind is not null").groupBy("event_id", "kind", "target").agg(F.max("idx").alias("ref"))
    every = objects.select("event_id", "kind", "target").join(back, ["event_id", "kind", "target"], "left")
    return every.select("event_id", "kind", F.col("target").alias("idx"), F.coalesce("ref", F.lit(-1)).alias("ref"))


def reflected(refs: Column, size: Column, deep: bool) -> Column:
    """Back-pointers of an event that is one row: a list of ``size`` with the last place of ``refs``, or with ``deep``
    of its lists, that has this index; -1 without one. References outside of the list are left out."""
    pair = lambda ref, i: F.struct(ref.cast("long").alias("ref"), i.cast("long").alias("i"))
    pairs = F.flatten(F.transform(refs, lambda x, i: F.transform(x, lambda y: pair(y, i)))) if deep else F.transform(refs, pair)
    ordered = F.array_sort(F.filter(pairs, lambda p: p["ref"].isNotNull() & (p["ref"] >= 0) & (p["ref"] < size)))
    none = F.lit(-1).cast("long")
    gap = lambda a, b: F.array_repeat(none, (b - a - 1).cast("int"))

    def spread(a: Column) -> Column:
        """The last of each reference at its place, with what lies before it; no look-ups, so the work grows with the list."""
        each = lambda p, i: F.concat(gap(F.coalesce(F.get(a, i - 1)["ref"], none), p["ref"]), F.array(p["i"]))
        return F.concat(F.flatten(F.transform(a, each)), gap(F.coalesce(F.get(a, F.size(a) - 1)["ref"], none), F.greatest(size.cast("long"), F.lit(0))))

    last = lambda a: F.filter(a, lambda p, i: (F.get(a, i + 1)["ref"] != p["ref"]) | (i + 1 == F.size(a)))
    return F.transform(F.transform(F.array(ordered), last), spread)[0]


def birr(pt: Column, pz: Column) -> Column:
    """Momentum of a track whose own column is wrong."""
    return F.sqrt(pt * pt + pz * pz)


def hit_count(particles: Column) -> Column:
    """Time hits of a tower: the length of its list of particles."""
    return F.size(particles)


def kmeans_assign(points: DataFrame, centres: DataFrame, vector: str = "embedding") -> DataFrame:
    """(points' columns, centre, distance): the nearest of a few fixed centres (centre, position), ties by number.

    The centres are the state of a k-means step: k rows, broadcast.
    """
    from ..functions.arrays import embedding_distance2

    listed = F.broadcast(centres.agg(F.sort_array(F.collect_list(F.struct("centre", "position"))).alias("_c")))
    joined = points.join(listed)
    each = F.transform("_c", lambda c: F.struct(embedding_distance2(F.col(vector), c["position"]).alias("d"), c["centre"].alias("c")))
    return joined.withColumn("_b", F.array_min(each)).withColumns({"centre": F.col("_b.c"), "distance": F.sqrt("_b.d")}).drop("_c", "_b")


def parity(one: DataFrame, two: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(dim, parity): per dimension the sign of ``two`` that is nearest to ``one`` over shared keys, by absolute difference."""
    both = one.select(key, F.posexplode(vector).alias("dim", "a")).join(two.select(key, F.posexplode(vector).alias("dim", "b")), [key, "dim"])
    sums = both.groupBy("dim").agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("same"), F.sum(F.abs(F.col("a") + F.col("b"))).alias("flipped"))
    return sums.select("dim", F.when(F.col("flipped") < F.col("same"), -1).otherwise(1).alias("parity"))
