"""Detector files in ROOT format as a Python data source; the default way to open one needs the package uproot on the executors.

A scan reads the branches of its schema only, entry range by entry range. Filters on event_id choose entries, and
with statistics of ranges filters on plain columns skip the ranges that can't have a row; Spark pushes filters
down to Python sources if the session has PUSHDOWN.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

#: Names that branches get.
RENAMED = {
    "E": "Energy", "P": "Birr", "ErrorP": "ErrorBirr", "T": "Time", "EtaOuter": "OuterEta", "PhiOuter": "OuterPhi", "TOuter": "OuterTime",
    "XOuter": "OuterX", "YOuter": "OuterY", "ZOuter": "OuterZ", "Xd": "dX", "Yd": "dY", "Zd": "dZ",
}
#: The session's setting for filters of Python data sources.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Entries that are looked at for the types of branches.
LOOKED_AT = 100


def branch_name(name: str, prefix: str = "") -> str:
    """A branch's name as a column: letters and digits, a capital first, x before a digit; known ones renamed."""
    leaf = re.sub(r"[^0-9A-Za-z]", "", name.split(".", 1)[-1])
    leaf = RENAMED.get(leaf, leaf)
    leaf = leaf[:1].upper() + leaf[1:]
    column = f"{prefix}_{leaf}" if prefix else leaf
    return f"x{column}" if column[:1].isdigit() else column


def wanted_branch(name: str) -> bool:
    """Branches whose leaf starts with a capital; the others are bookkeeping."""
    return name.split(".", 1)[-1][:1].isupper()


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get numbers."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}{seen[n]}")
    return out


def open_with_uproot(path: str):
    """A file as a mapping of trees; a tree has num_entries, keys() and, by key, array(entry_start=, entry_stop=) with tolist()."""
    try:
        import uproot
    except ImportError as e:
        raise RuntimeError("reading detector files needs the package uproot") from e
    return uproot.open(path)


def _named(reference: str) -> Callable:
    """The function that ``module:name`` names."""
    module, name = reference.split(":")
    return getattr(importlib.import_module(module), name)


class Entries(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class Branches:
    """A tree and the columns that its wanted branches become.

    Options: components, comma-separated (the first one's columns have no prefix unless ``all_prefixed`` is true); keys: how
    branches are chosen, a regular expression for the whole leaf or ``module:function`` of a branch's name, by default those
    with a capital; tree; opener, ``module:function``.
    """

    def __init__(self, options):
        self.options, self.path = options, options["path"]
        self.components = [c.strip() for c in options.get("components", options.get("component", "")).split(",") if c.strip()]
        if not self.components:
            raise ValueError("name the components to read")
        self.tree = _named(options.get("opener", f"{__name__}:open_with_uproot"))(self.path)[options.get("tree", "Delphes")]

    def columns(self) -> dict[str, str]:
        """Branch by column."""
        choice = self.options.get("keys")
        if choice is None:
            wanted = wanted_branch
        elif re.fullmatch(r"[\w.]+:\w+", choice):
            wanted = _named(choice)
        else:
            wanted = lambda k: re.fullmatch(choice, k.split(".", 1)[-1]) is not None
        out: dict[str, str] = {}
        for n, component in enumerate(self.components):
            keys = [k for k in self.tree.keys() if k.startswith(f"{component}.") and wanted(k)]
            prefix = component if n or self.options.get("all_prefixed", "false").lower() == "true" else ""
            for name, key in zip(unique_names([branch_name(k, prefix) for k in keys]), keys, strict=True):
                if name in out:
                    raise ValueError(f"{key} and {out[name]} both become the column {name}")
                out[name] = key
        return out

    def values(self, key: str, start: int, stop: int) -> list:
        return self.tree[key].array(entry_start=start, entry_stop=stop).tolist()


def _type(values: list) -> T.DataType | None:
    """Spark's type of plain or nested values; None if there are none to tell it from."""
    if any(isinstance(v, list) for v in values):
        inner = _type([x for v in values for x in v or []])
        return T.ArrayType(inner or T.LongType())
    for python, kind in ((str, T.StringType()), (float, T.DoubleType()), (bool, T.BooleanType()), (int, T.LongType())):
        if any(isinstance(v, python) for v in values):
            return kind
    return None


class DetectorReader(DataSourceReader):
    """Reads ranges of entries; only the branches of the schema."""

    def __init__(self, options, schema: T.StructType):
        self.options, self.schema, self.step = options, schema, int(options.get("entries", 10_000))
        self.bounds: tuple[float, float] = (0, float("inf"))
        self.chosen: set[int] | None = None
        self.tests: list[tuple[str, str, object]] = []
        #: {column: [[first entry, least, largest], ...]}; the ranges have ``entries`` entries
        self.statistics = json.loads(options.get("statistics", "{}"))

    def _may_have(self, start: int) -> bool:
        """Whether statistics leave room for a row in the range of a first entry."""
        for name, sign, value in self.tests:
            known = {first: (least, most) for first, least, most in self.statistics[name]}.get(start)
            if known is None:
                continue
            least, most = known
            if least is None:  # no values but nulls
                return False
            if (sign == "=" and not least <= value <= most) or (sign == ">" and most <= value) or (sign == ">=" and most < value) or (sign == "<" and least >= value) or (sign == "<=" and least > value):
                return False
        return True

    def partitions(self) -> list[Entries]:
        n = Branches(self.options).tree.num_entries
        low, high = max(0, self.bounds[0]), min(n, self.bounds[1])
        out = []
        for start in range(0, n, self.step):
            a, b = max(start, int(low)), min(start + self.step, int(high))
            if a >= b or not self._may_have(start):
                continue
            if self.chosen is not None:
                inside = [i for i in self.chosen if isinstance(i, int) and a <= i < b]
                if not inside:
                    continue
                a, b = min(inside), max(inside) + 1
            out.append(Entries(a, b))
        return out or [Entries(0, 0)]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        start, stop = partition.start, partition.stop
        if start >= stop:
            return
        branches = Branches(self.options)
        by_name = branches.columns()
        kinds = to_arrow_schema(self.schema)
        missing = [f for f in self.schema.fieldNames() if f != "event_id" and f not in by_name]
        if missing:
            raise ValueError(f"no branches become the columns {missing}")
        columns = {f: list(range(start, stop)) if f == "event_id" else branches.values(by_name[f], start, stop) for f in self.schema.fieldNames()}
        batch = pa.RecordBatch.from_arrays([pa.array(v, kinds.field(f).type) for f, v in columns.items()], schema=kinds)
        if self.chosen is not None:
            batch = batch.filter(pa.array([i in self.chosen for i in range(start, stop)]))
        yield batch


class FilteringReader(DetectorReader):
    """Narrows a scan by the filters that Spark pushes down. A class of its own, since Spark refuses readers that would
    take filters where the session doesn't push any."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what event_id may be, and looks at bounds of columns that have statistics; the latter stay for Spark to apply row by row."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if name == "event_id" and self._take(f):
                continue
            if name in self.statistics:
                value = getattr(f, "value", None)
                for kind, sign in ((EqualTo, "="), (GreaterThan, ">"), (GreaterThanOrEqual, ">="), (LessThan, "<"), (LessThanOrEqual, "<=")):
                    if isinstance(f, kind) and value is not None:
                        self.tests.append((name, sign, value))
            yield f

    def _take(self, f: Filter) -> bool:
        """Narrows the entries by a filter on event_id; whether that is all that it says."""
        low, high = self.bounds
        if isinstance(f, EqualTo):
            self._choose({f.value})
        elif isinstance(f, In):
            self._choose(set(f.value))
        elif isinstance(f, GreaterThan):
            self.bounds = (max(low, f.value + 1), high)
        elif isinstance(f, GreaterThanOrEqual):
            self.bounds = (max(low, f.value), high)
        elif isinstance(f, LessThan):
            self.bounds = (low, min(high, f.value))
        elif isinstance(f, LessThanOrEqual):
            self.bounds = (low, min(high, f.value + 1))
        else:
            return False
        return True

    def _choose(self, ids: set) -> None:
        self.chosen = ids if self.chosen is None else self.chosen & ids


class DetectorSource(DataSource):
    """``spark.read.format("detector").option("components", "Particle,Track").load(path)``; reading only. Options as in :class:`Branches`, besides
    ``entries`` of a range, ``statistics`` as :func:`range_statistics` gives them, and ``filters``, true where the session pushes filters down."""

    @classmethod
    def name(cls) -> str:
        return "detector"

    def schema(self) -> T.StructType:
        branches = Branches(self.options)
        some = min(LOOKED_AT, branches.tree.num_entries)
        fields = [T.StructField(name, _type(branches.values(key, 0, some)) or T.LongType()) for name, key in sorted(branches.columns().items())]
        return T.StructType([T.StructField("event_id", T.LongType()), *fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("filters", "false").lower() == "true" else DetectorReader)(self.options, schema)


def read_detector(spark: SparkSession, path: str, component: str | list[str], schema: str | T.StructType | None = None, **options: str) -> DataFrame:
    """Branches of one or several components as columns by event; the path is taken whole.

    ``schema`` chooses the columns that are read, all by default, with types from the first entries. Options go to the source.
    Filters are pushed down if the session has PUSHDOWN.
    """
    spark.dataSource.register(DetectorSource)
    options.setdefault("filters", spark.conf.get(PUSHDOWN, "false"))
    reader = spark.read.format("detector").options(components=component if isinstance(component, str) else ",".join(component), **options)
    return (reader.schema(schema) if schema else reader).load(path)


def range_statistics(events: DataFrame, columns: list[str], entries: int = 10_000) -> str:
    """The option ``statistics``: least and largest value of plain columns by range of ``entries`` entries. A row a range comes to the driver."""
    first = F.floor(F.col("event_id") / entries) * entries
    # NaN counts as larger than all numbers, in Spark's aggregates as in its comparisons; JSON has no number for it or infinity
    bounds = [f(c).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))]
    rows = events.groupBy(first.cast("long").alias("first")).agg(*bounds).orderBy("first").collect()
    return json.dumps({c: [[r["first"], r[f"min_{c}"], r[f"max_{c}"]] for r in rows] for c in columns})


def repaired(events: DataFrame, prefix: str = "Track") -> DataFrame:
    """List columns with the usual repairs: rapidities beyond 999 are infinite, the track momentum is recomputed."""
    from ..functions.arrays import apply, depth
    from ..functions.kinematics import big_to_inf
    from ..operators.references import birr

    new = {c: apply(F.col(c), big_to_inf, depth(events, c)) for c in events.columns if "Rapidity" in c}
    if {f"{prefix}_PT", f"{prefix}_Pz"} <= set(events.columns):
        new[f"{prefix}_Birr"] = F.zip_with(f"{prefix}_PT", f"{prefix}_Pz", birr)
    return events.withColumns(new) if new else events


def assembled(events: DataFrame) -> DataFrame:
    """Events of the components Particle (without prefix), Track and Tower with all that a detector file needs before use.

    References become indices from 0; Particle_Track and Particle_Tower point back from every particle, -1 without one; Birr is
    recomputed from PT and Pz; towers get their number of hits; rapidities beyond 999 are infinite; Track_Birr goes.
    """
    from ..operators.references import birr, hit_count, reflected, zero_based

    have = set(events.columns)
    events = events.withColumns({c: zero_based(F.col(c), d) for c, d in (("Track_Particle", 1), ("Tower_Particles", 2)) if c in have})
    size = F.size("Energy")
    new = {}
    if "Track_Particle" in have:
        new["Particle_Track"] = reflected(F.col("Track_Particle"), size, deep=False)
    if "Tower_Particles" in have:
        new["Particle_Tower"] = reflected(F.col("Tower_Particles"), size, deep=True)
        new["Tower_NTimeHits"] = F.transform("Tower_Particles", hit_count)
    if {"PT", "Pz"} <= have:
        new["Birr"] = F.zip_with("PT", "Pz", birr)
    return repaired(events.withColumns(new) if new else events, prefix="").drop("Track_Birr")
