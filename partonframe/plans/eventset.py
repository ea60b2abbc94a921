"""A table of events with aliases and hyper-parameters, kept as Parquet with a JSON sidecar.

Everything stays lazy until :meth:`EventSet.save`. The event's number is the column ``event_id``; ragged
content is in array columns. Hyper-parameters are values of the whole set, in a name space of their own.
"""

from __future__ import annotations

import json
import re
import subprocess
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import file_system, read_text, write_text, written

EVENT = "event_id"
SIDECAR = "_event_set.json"


def provenance(folder: str = ".") -> dict[str, str]:
    """Branch, time and message of the code's last commit; outdated where they can't be read."""
    asked = {"branch": ["rev-parse", "--abbrev-ref", "HEAD"], "time": ["log", "-1", "--format=%cI"], "message": ["log", "-1", "--format=%s"]}
    try:
        return {k: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout.strip() for k, a in asked.items()} | {"outdated": "False"}
    except (OSError, subprocess.CalledProcessError):
        return {"outdated": "True"}


class EventSet:
    def __init__(self, df: DataFrame, hyper: Mapping[str, object] | None = None, aliases: Mapping[str, str] | None = None, path: str | None = None, provenance: Mapping[str, str] | None = None):
        if len(set(df.columns)) < len(df.columns):
            raise ValueError("columns have the same name")
        self.df, self.hyper, self.aliases, self.path = df, dict(hyper or {}), dict(aliases or {}), path
        self.provenance = dict(provenance or {})
        clash = set(self.hyper) & set(df.columns)
        if clash:
            raise KeyError(f"columns and hyper-parameters share {sorted(clash)}")

    # names
    @property
    def columns(self) -> list[str]:
        return [*self.aliases, *(c for c in self.df.columns if c != EVENT)]

    def _with(self, df: DataFrame | None = None, hyper=None, aliases=None) -> EventSet:
        return EventSet(self.df if df is None else df, self.hyper if hyper is None else hyper, self.aliases if aliases is None else aliases, self.path, self.provenance)

    def __getitem__(self, name: str) -> DataFrame | object:
        """A hyper-parameter's value, or (event_id, column) under the asked name."""
        if name in self.hyper:
            return self.hyper[name]
        target = self.aliases.get(name, name)
        if target not in self.df.columns:
            raise KeyError(name)
        return self.df.select(EVENT, F.col(target).alias(name))

    def event(self, event_id: int) -> DataFrame:
        return self.df.where(F.col(EVENT) == event_id)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, EventSet) and self.path is not None and self.path == other.path

    __hash__ = None  # type: ignore[assignment]

    def __str__(self) -> str:
        return f"EventSet at {self.path}: {len(self.columns)} columns, {len(self.hyper)} hyper-parameters"

    def add_alias(self, name: str, target: str) -> EventSet:
        if target not in self.df.columns or name in self.columns or name in self.hyper:
            raise KeyError(f"can't call {target} {name}")
        return self._with(aliases=self.aliases | {name: target})

    def remove_alias(self, name: str) -> EventSet:
        if name not in self.aliases:
            raise KeyError(name)
        return self._with(aliases={k: v for k, v in self.aliases.items() if k != name})

    # content
    def append(self, other: DataFrame | None = None, **columns: Column) -> EventSet:
        """More columns, or new content of old ones: expressions, or a table by event. New ones come in order of their names."""
        names = sorted([*columns, *(c for c in (other.columns if other is not None else []) if c != EVENT)])
        if set(names) & set(self.hyper):
            raise KeyError(f"hyper-parameters are called {sorted(set(names) & set(self.hyper))}")
        df = self.df
        if other is not None:
            df = df.drop(*[c for c in other.columns if c != EVENT]).join(other, EVENT, "left")
        df = df.withColumns({c: columns[c] for c in sorted(columns)}) if columns else df
        old = [c for c in self.df.columns]
        return self._with(df.select(*old, *[c for c in names if c not in old]))

    def append_hyperparameters(self, **values: object) -> EventSet:
        clash = set(values) & set(self.df.columns)
        if clash:
            raise KeyError(f"columns are called {sorted(clash)}")
        return self._with(hyper=self.hyper | {k: values[k] for k in sorted(values)})

    def remove(self, name: str) -> EventSet:
        if name in self.aliases:
            return self.remove_alias(name)
        if name in self.hyper:
            return self._with(hyper={k: v for k, v in self.hyper.items() if k != name})
        if name not in self.df.columns or name == EVENT:
            raise KeyError(name)
        return self._with(self.df.drop(name), aliases={k: v for k, v in self.aliases.items() if v != name})

    def remove_prefix(self, prefix: str) -> EventSet:
        found = [c for c in [*self.columns, *self.hyper] if c.startswith(prefix)]
        if not found:
            raise KeyError(f"nothing starts with {prefix}")
        return reduce(lambda s, c: s.remove(c) if c in s.columns or c in s.hyper else s, found, self)

    def rename(self, old: str, new: str) -> EventSet:
        if new in self.columns or new in self.hyper:
            raise KeyError(f"{new} is there")
        if old in self.aliases:
            return self._with(aliases={new if k == old else k: v for k, v in self.aliases.items()})
        if old in self.hyper:
            return self._with(hyper={new if k == old else k: v for k, v in self.hyper.items()})
        if old not in self.df.columns or old == EVENT:
            raise KeyError(old)
        return self._with(self.df.withColumnRenamed(old, new), aliases={k: new if v == old else v for k, v in self.aliases.items()})

    def rename_prefix(self, old: str, new: str) -> EventSet:
        found = [c for c in [*self.columns, *self.hyper] if c.startswith(old)]
        return reduce(lambda s, c: s.rename(c, new + c[len(old) :]), found, self)

    # files
    def _sidecar(self) -> str:
        return json.dumps({"columns": self.df.columns, "hyper": self.hyper, "aliases": self.aliases, "provenance": self.provenance})

    def save(self, path: str | None = None) -> EventSet:
        """Writes the set, also over the one that it was read from: the new one is complete before it takes the old one's name."""
        path = path or self.path
        if path is None:
            raise ValueError("no path")
        spark = self.df.sparkSession
        fs, target = file_system(spark, path)
        beside = lambda kind: str(file_system(spark, path)[1].suffix(f".{kind}-{uuid.uuid4().hex}"))
        fresh, old = beside("new"), beside("old")
        self.df.write.parquet(fresh)
        write_text(spark, f"{fresh}/{SIDECAR}", self._sidecar())
        there = fs.exists(target)
        if there and not fs.rename(target, file_system(spark, old)[1]):
            raise OSError(f"can't move {path}")
        if not fs.rename(file_system(spark, fresh)[1], target):
            raise OSError(f"can't move {fresh} to {path}; the set that was there is {old}")
        if there:
            fs.delete(file_system(spark, old)[1], True)
        spark.catalog.refreshByPath(path)
        return EventSet.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EventSet:
        side = json.loads(read_text(spark, f"{path}/{SIDECAR}"))
        return cls(spark.read.parquet(path).select(*side["columns"]), side["hyper"], side["aliases"], path, side["provenance"])

    @staticmethod
    def is_set(spark: SparkSession, path: str) -> bool:
        fs, target = file_system(spark, f"{path}/{SIDECAR}")
        return fs.exists(target)

    @classmethod
    def find(cls, spark: SparkSession, folder: str) -> list[EventSet]:
        """The event sets right in a folder, by name."""
        fs, target = file_system(spark, folder)
        if not fs.exists(target):
            return []
        names = sorted(f.getPath().toString() for f in fs.listStatus(target) if f.isDirectory() and not re.search(r"\.(new|old)-[0-9a-f]{32}$", f.getPath().getName()))
        return [cls.load(spark, n) for n in names if cls.is_set(spark, n)]

    # parts
    def split(self, lower: list[int], upper: list[int]) -> list[EventSet | None]:
        """Sets of the events lower[i] <= event_id < upper[i]; None for an empty range."""
        if len(lower) != len(upper) or any(a > b for a, b in zip(lower, upper, strict=True)):
            raise ValueError("a lower bound is above its upper bound")
        return [None if a == b else self._with(self.df.where((F.col(EVENT) >= a) & (F.col(EVENT) < b))) for a, b in zip(lower, upper, strict=True)]

    def pick(self, lists: list[list[int]]) -> list[EventSet | None]:
        """Sets of listed events."""
        return [self._with(self.df.where(F.col(EVENT).isin(ids))) if ids else None for ids in lists]

    def parts(self, n_fragments: int | None = None, fragment_length: int | None = None) -> DataFrame:
        """The table with ``part``: of ``n_fragments`` equal numbers of events in order of their ids (the last takes
        the remainder), or of ``fragment_length`` events each. Ranks are counted range by range."""
        if n_fragments is None and fragment_length is None:
            raise ValueError("n_fragments or fragment_length is needed")
        ids = written(self.df.select(EVENT).repartitionByRange(EVENT).withColumn("_range", F.spark_partition_id()))
        counts = ids.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
        rank = F.row_number().over(Window.partitionBy("_range").orderBy(EVENT)) - 1 + F.col("_before")
        ranked = ids.join(F.broadcast(counts), "_range").select(EVENT, rank.alias("_rank"))
        if n_fragments is not None:
            length = max(1, ids.count() // n_fragments)
            part = F.least(F.floor(F.col("_rank") / length), F.lit(n_fragments - 1))
        else:
            part = F.floor(F.col("_rank") / fragment_length)
        # rows that repeat an event have neighbouring ranks; the first decides
        ranked = ranked.groupBy(EVENT).agg(F.min("_rank").alias("_rank"))
        return self.df.join(ranked.select(EVENT, part.cast("int").alias("part")), EVENT)

    def fragment(self, path: str, n_fragments: int | None = None, fragment_length: int | None = None) -> None:
        """Writes the parts in one pass, partitioned by ``part``; :meth:`combine` reads them again."""
        self.parts(n_fragments, fragment_length).write.mode("overwrite").partitionBy("part").parquet(path)
        write_text(self.df.sparkSession, f"{path}/{SIDECAR}", self._sidecar())

    def split_unfinished(self, done: DataFrame) -> tuple[EventSet | None, EventSet | None]:
        """(finished, unfinished) by the events of ``done``; None for an empty side."""
        ids = done.select(EVENT).distinct()
        sides = [self._with(self.df.join(ids, EVENT, how)) for how in ("left_semi", "left_anti")]
        return tuple(None if s.df.isEmpty() else s for s in sides)  # type: ignore[return-value]

    @staticmethod
    def combine(sets: list[EventSet], averaged: Callable[[str], bool] = lambda name: False, wanted: Callable[[str], bool] = lambda name: True, drop_repeats: bool = False) -> EventSet:
        """One set of all; columns that a set lacks are null there. Hyper-parameters must agree, or are averaged by
        the sets' lengths where ``averaged`` says so; ``drop_repeats`` keeps one of equal rows."""
        if not sets:
            raise RuntimeError("nothing to combine")
        hyper: dict[str, object] = {}
        lengths = None
        for name in dict.fromkeys(k for s in sets for k in s.hyper):
            values = [(s.hyper[name], i) for i, s in enumerate(sets) if name in s.hyper]
            if averaged(name):
                lengths = lengths or [s.df.count() for s in sets]
                hyper[name] = sum(v * lengths[i] for v, i in values) / sum(lengths[i] for _, i in values)
            elif any(v != values[0][0] for v, _ in values):
                raise ValueError(f"hyper-parameter {name} differs")
            else:
                hyper[name] = values[0][0]
        frames = [s.df.select(EVENT, *[c for c in s.df.columns if c != EVENT and wanted(c)]) for s in sets]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        aliases = {k: v for s in sets for k, v in s.aliases.items() if v in df.columns}
        return EventSet(df.dropDuplicates() if drop_repeats else df, hyper, aliases)

    @classmethod
    def recursive_combine(cls, spark: SparkSession, folder: str, delete: bool = False, **how) -> EventSet:
        """All event sets below a folder as one; the parts are deleted only if asked for."""
        found, todo = [], [folder]
        while todo:
            fs, target = file_system(spark, todo[0])
            here = todo.pop(0)
            if cls.is_set(spark, here):
                found.append(cls.load(spark, here))
            else:
                todo += sorted(f.getPath().toString() for f in fs.listStatus(target) if f.isDirectory())
        out = cls.combine(found, **how)
        if delete:
            out = out.save(f"{folder.rstrip('/')}_joined")
            for s in found:
                fs, target = file_system(spark, s.path)
                fs.delete(target, True)
        return out
