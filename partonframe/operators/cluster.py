"""Clustering of every event: one shuffle by event, then a stream of events through the kernel of an algorithm.

A task reads its partition sorted by event, in Arrow batches of many events, and never holds more than a
batch and one event. Events are independent, so partitions are as even as events are small.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kinematics as K
from ..plans.params import check_params, jet_name, same_params
from ..schema import CLUSTERED, LIFETIMES, LIVED, NODE_FLOATS, NODE_INTS, NODES, PARTICLES
from ..shared import file_system, read_text, write_text, written
from .kernels import cone, genkt, spectral, wavelet
from .kernels.many import MOST_SMALL
from .kernels.physics import Nodes

#: Particles of an event up to which it is clustered where the caller names no bound: any number.
MOST_PARTICLES = float("inf")
INPUTS = ["event_id", "idx", "px", "py", "pz", "energy", "pt", "rapidity", "phi"]
KERNELS: dict[str, Callable[..., Nodes]] = {
    "GeneralisedKT": genkt.cluster, "Spectral": spectral.cluster, "SpectralMean": partial(spectral.cluster, embedding_update="mean"), "Wavelet": wavelet.cluster, "IterativeCone": cone.cluster,
}
KERNELS["CALE"] = KERNELS["CALECpp"] = KERNELS["Wavelet"]
#: Kernels of many small events at once, by the kernel of one.
MANY: dict[Callable, Callable[..., list]] = {genkt.cluster: genkt.many, spectral.cluster: spectral.many, KERNELS["SpectralMean"]: partial(spectral.many, embedding_update="mean"), cone.cluster: cone.many, wavelet.cluster: wavelet.many}
#: Algorithms whose memory grows with the number of particles only; that of the others grows with its square.
LINEAR = {"GeneralisedKT", "IterativeCone"}


def from_kinematics(particles: DataFrame) -> DataFrame:
    """Particles with pt, rapidity and phi, computed where one of them is missing."""
    if not {"pt", "rapidity", "phi"} <= set(particles.columns):
        particles = particles.withColumns({"pt": K.pt("px", "py"), "phi": K.phi("px", "py")})
        particles = particles.withColumn("rapidity", K.rapidity("pt", "pz", "energy"))
    return particles.select("event_id", "idx", *INPUTS[2:]).to(PARTICLES)


def _events(batches: Iterator[pa.RecordBatch], most: float) -> Iterator[tuple[int, np.ndarray, int]]:
    """(event, rows of its floats, number of particles); the rows of an event over ``most`` particles are cut, it isn't clustered."""
    event, parts, n = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        values = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, len(INPUTS))])
        edges = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if event is not None and ids[a] != event:
                yield event, np.concatenate(parts), n
                parts, n = [], 0
            event = ids[a]
            if n <= most:
                parts.append(values[a:b])
            n += b - a
    if event is not None:
        yield event, np.concatenate(parts), n


def _alone(event: np.ndarray, kernel: Callable[..., Nodes], params: dict) -> tuple[str, tuple | None]:
    """Status and (root, integers, floats, lifetimes) of one event."""
    try:
        made = kernel(Nodes(*event.T), **params)
        return "ok", (*made.table(), made.lifetimes())
    except np.linalg.LinAlgError:
        return "linalg_error", None


def _tables(events: list[tuple[int, np.ndarray, int]], kernel: Callable[..., Nodes], many: Callable[..., list] | None, params: dict, most: float) -> Iterator[tuple[str, float, tuple]]:
    """Status, seconds and (root, integers, floats, lifetimes) of each event; small ones go to ``many`` together and share its time."""
    made: dict[int, tuple | None] = {}
    small = [k for k, (_, _, n) in enumerate(events) if n <= min(most, MOST_SMALL)] if many else []
    each = 0.0
    if small:
        began = time.perf_counter()
        made = dict(zip(small, many([events[k][1] for k in small], **params), strict=True))
        each = (time.perf_counter() - began) / len(small)
    for k, (_, values, n) in enumerate(events):
        found, status, took = made.get(k), "ok", each
        if found is None:
            began = time.perf_counter()
            status, found = ("too_large", None) if n > most else _alone(values, kernel, params)
            took = time.perf_counter() - began if found else float("nan")
        yield status, took, found or (np.zeros(1, np.int64), np.zeros((1, len(NODE_INTS)), np.int64), np.zeros((1, len(NODE_FLOATS))), np.zeros((1, 2), np.int64))


def _cluster(batches: Iterator[pa.RecordBatch], kernel: Callable[..., Nodes], params: dict, most: float, lived: bool = False, many: Callable[..., list] | None = None, rows_out: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Events are held until they have so many rows, clustered and given out as one batch; one event is held at least."""

    def flush(held: list[tuple[int, np.ndarray, int]]) -> pa.RecordBatch:
        status, took, found = zip(*_tables(held, kernel, many, params, most), strict=True)
        root, ints, floats, lives = (np.concatenate(x) for x in zip(*found, strict=True))
        lengths = [len(x[0]) for x in found]
        spread = lambda x: np.repeat(np.asarray(x), lengths)
        null = ~spread([s == "ok" for s in status])
        columns = [pa.array(spread([e for e, *_ in held]), pa.int64()), pa.array(root, pa.int64(), mask=null)]
        columns += [pa.array(ints[:, k], pa.int64(), mask=null) for k in range(len(NODE_INTS))]
        columns += [pa.array(floats[:, k], pa.float64(), mask=null) for k in range(len(NODE_FLOATS))]
        columns += [pa.array(status, pa.string()).take(pa.array(spread(range(len(held))))), pa.array(spread(took), pa.float64())]
        if lived:
            columns += [pa.array(lives[:, k], pa.int64(), mask=null) for k in range(len(LIFETIMES))]
        return pa.RecordBatch.from_arrays(columns, (LIVED if lived else CLUSTERED).fieldNames())

    held: list[tuple[int, np.ndarray, int]] = []
    size = 0
    for event, values, n in _events(batches, most):
        held.append((event, values, n))
        size += len(values)
        if size >= rows_out:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def cluster(particles: DataFrame, algorithm: str, params: Mapping[str, object] | None = None, most_particles: int | None = None, kernel: Callable[..., Nodes] | None = None, partitions: int | None = None, clustered: bool = False, lived: bool = False) -> DataFrame:
    """Nodes of all events with status and duration (CLUSTERED), and if ``lived`` with the steps between which they are live (LIVED).

    ``algorithm`` is a name of the registry, or any name with a ``kernel`` of one's own (Nodes and parameters
    to Nodes). Events of any size are clustered, unless the caller names ``most_particles``: larger ones get status
    too_large then, a failed eigen-decomposition linalg_error: one row without node and duration NaN; the job goes on.
    ``clustered`` says that the rows of an event are in one partition already, as after a window or an aggregate by
    event; it saves the shuffle.
    """
    checked = dict(params or {}) if kernel else check_params(algorithm, params)
    if not kernel:
        kernel = KERNELS[algorithm]
        if algorithm.startswith("Spectral"):
            checked.pop("PhyDistance")
    if most_particles is None:
        most_particles = MOST_PARTICLES
    rows = from_kinematics(particles)
    dealt = rows if clustered else rows.repartition(partitions, "event_id") if partitions else rows.repartition("event_id")
    ordered = dealt.sortWithinPartitions("event_id", "idx", *INPUTS[2:])
    return ordered.mapInArrow(partial(_cluster, kernel=kernel, params=checked, most=most_particles, lived=lived, many=MANY.get(kernel)), LIVED if lived else CLUSTERED)


def _wavelets(batches: Iterator[pa.RecordBatch], sigma: float, rows_out: int = 20_000) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        values = np.concatenate(wavelet.first_scaled([v[:, [5, 6, 4]] for _, v, _ in held], sigma))
        sizes = [n for *_, n in held]
        columns = [np.repeat([e for e, *_ in held], sizes), np.concatenate([np.arange(n) for n in sizes]), values]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["event_id", "idx", "value"])

    held, size = [], 0
    for found in _events(batches, float("inf")):
        if found[2] < 2:
            continue
        held.append(found)
        size += found[2]
        if size >= rows_out:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def wavelet_values(particles: DataFrame, sigma: float = 0.1, clustered: bool = False) -> DataFrame:
    """(event_id, idx, value): the scaled heat wavelet at the first seed of each event of two particles or more, whose ``idx``
    count from 0; ``clustered`` is as in :func:`cluster`."""
    rows = from_kinematics(particles)
    ordered = (rows if clustered else rows.repartition("event_id")).sortWithinPartitions("event_id", "idx", *INPUTS[2:])
    return ordered.mapInArrow(partial(_wavelets, sigma=sigma), "event_id long, idx long, value double")


_TRACE = {"n_live": pa.int64(), "n_dims": pa.int64(), "mean_distance": pa.float64(), "min_distance": pa.float64(), "child1": pa.int64(), "child2": pa.int64(), "labels": pa.list_(pa.int64()), "laplacian": pa.list_(pa.float64()), "eigenvalues": pa.list_(pa.float64()), "embedding": pa.list_(pa.float64())}


def _trace(batches: Iterator[pa.RecordBatch], params: dict, steps: int | None, cells: int = 500_000) -> Iterator[pa.RecordBatch]:
    fields = {"event_id": pa.int64(), "step": pa.int64(), **_TRACE}
    out: list[tuple] = []
    held = 0
    for event, values, _ in _events(batches, float("inf")):
        rows: list[tuple] = []
        spectral.cluster(Nodes(*values.T), steps=steps, trace=rows, **params)
        out += [(event, k, *row) for k, row in enumerate(rows)]
        held += sum(len(row[7]) + len(row[9]) for row in rows)
        if held >= cells:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), fields.values(), strict=True)], list(fields))
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), fields.values(), strict=True)], list(fields))


def spectral_trace(particles: DataFrame, params: Mapping[str, object] | None = None, steps: int | None = None, clustered: bool = False) -> DataFrame:
    """Steps of spectral clustering: (event_id, step, n_live, n_dims, mean_distance, min_distance, child1, child2) and
    as lists the live labels, the Laplacian row by row, all its eigenvalues and the embedding row by row.

    ``steps`` gives the first so many of each event, and takes no others. ``clustered`` is as in :func:`cluster`."""
    checked = check_params("Spectral", params)
    checked.pop("PhyDistance")
    rows = from_kinematics(particles)
    ordered = (rows if clustered else rows.repartition("event_id")).sortWithinPartitions("event_id", "idx", *INPUTS[2:])
    lists = "labels array<long>, laplacian array<double>, eigenvalues array<double>, embedding array<double>"
    return ordered.mapInArrow(partial(_trace, params=checked, steps=steps), f"event_id long, step long, n_live long, n_dims long, mean_distance double, min_distance double, child1 long, child2 long, {lists}")


def nodes(clustered: DataFrame) -> DataFrame:
    """The nodes of events that were clustered."""
    return clustered.where("status = 'ok'").select(*NODES.fieldNames())


def run_log(clustered: DataFrame, name: str) -> DataFrame:
    """One row per event: duration_s (NaN for a failure) and status."""
    each = clustered.where("status != 'ok' or label = 0")
    return each.select("event_id", F.lit(jet_name(name)).alias("jet_name"), "duration_s", "status")


def unfinished(particles: DataFrame, finished: DataFrame) -> DataFrame:
    """Particles of the events that ``finished`` (anything with event_id) doesn't have."""
    return particles.join(finished.select("event_id").distinct(), "event_id", "left_anti")


def cluster_batch(particles: DataFrame, path: str, algorithm: str, params: Mapping[str, object] | None = None, name: str | None = None, batch_events: int | None = None, save_events: int | None = None) -> bool:
    """Clusters events that the table at ``path`` doesn't have yet and appends them; whether none is left.

    The table is partitioned by jet name. ``batch_events`` limits the events of a call, the least ids first.
    With ``save_events`` a call saves after some so many events, so that a call that fails has saved what came before;
    the next call does the rest. Each save is a job of its own that reads the particles again.
    The parameters of a name are stored beside the table; ValueError if they are others now.
    """
    spark = particles.sparkSession
    name = jet_name(name or algorithm)
    now, kept = {"algorithm": algorithm, **check_params(algorithm, params)}, f"{path.rstrip('/')}/_params_{name}.json"
    fs, target = file_system(spark, kept)
    if fs.exists(target):
        before = json.loads(read_text(spark, kept))
        if not same_params(before, now):
            raise ValueError(f"{name} was clustered with {before}, not with {now}")
    else:
        write_text(spark, kept, json.dumps(now))
    try:
        done = spark.read.schema(T.StructType([*CLUSTERED.fields, T.StructField("jet_name", T.StringType())])).parquet(path).where(F.col("jet_name") == name)
        todo = unfinished(particles, done)
    except Exception as e:  # the table isn't there before the first call
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        todo = particles
    chosen = todo
    if batch_events is not None:
        ids = todo.select("event_id").distinct().orderBy("event_id").limit(batch_events)
        chosen = todo.join(ids, "event_id", "left_semi")
    parts = 1
    if save_events is not None:
        # which events are to do is settled before the first save adds to the table
        chosen = particles.join(written(chosen.select("event_id").distinct()), "event_id", "left_semi")
        parts = max(1, -(-chosen.select("event_id").distinct().count() // save_events))
    for part in range(parts):
        some = chosen.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == part) if parts > 1 else chosen
        cluster(some, algorithm, params).withColumn("jet_name", F.lit(name)).write.mode("append").partitionBy("jet_name").parquet(path)
    if batch_events is None:
        return True
    spark.catalog.refreshByPath(path)
    after = spark.read.parquet(path).where(F.col("jet_name") == name)
    return unfinished(particles, after).isEmpty()
