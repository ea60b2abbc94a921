"""K-means over vectors: distributed for the usual distances, in one place for a distance of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written
from .kernels import kmeans as kernel


#: Squared distances that agree within this part of them are a tie, which moves no point.
TIE = 1e-9


def kmeans(points: DataFrame, k: int, vector: str = "embedding", distance: str = "euclidean", seed: int = 0, max_iter: int = 20, tolerance: float = 1e-4, settle: bool = False) -> DataFrame:
    """``points`` with ``cluster``; distance euclidean or cosine.

    The steps until no point moves grow with the points. ``settle`` (euclidean only) goes on after ``max_iter`` steps until none
    moves, with ``k`` clusters if there are as many different points.
    """
    if settle and distance != "euclidean":
        raise ValueError("only euclidean clusters are settled")
    ready = points.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tolerance, distanceMeasure=distance, featuresCol="_features", predictionCol="cluster").fit(ready)
    if not settle:
        return model.transform(ready).drop("_features")
    centres = settled(points.select(F.col(vector).cast("array<double>").alias("x")), np.array(model.clusterCenters()), k)
    each = points.withColumn("_x", F.col(vector).cast("array<double>"))
    return each.mapInArrow(partial(_labelled, centres=centres), T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType())]))


def settled(points: DataFrame, centres: np.ndarray, k: int) -> np.ndarray:
    """Centres by which no point (x, a list of doubles) is nearer to the mean of another cluster than to its own's.

    Lloyd's steps, each a job that returns the sums of k clusters; they end, since every move lowers the sum of squares.
    An empty or missing cluster gets the point that is farthest from its centre, unless every point is at one.
    """
    kept = written(points)
    before = centres
    while True:
        rows = kept.mapInArrow(partial(_sums, before=before, centres=centres), "cluster int, axis int, total double").groupBy("cluster", "axis").agg(F.sum("total").alias("total")).collect()
        table = np.zeros((len(centres), centres.shape[1] + 2))
        for r in rows:
            table[r["cluster"], r["axis"]] = r["total"]
        sums, counts, moved = table[:, :-2], table[:, -2:-1], table[:, -1].sum()
        empty = np.flatnonzero(counts[:, 0] == 0)
        if len(empty) or len(centres) < k:
            far = kept.mapInArrow(partial(_farthest, centres=centres), "gap double, x array<double>").orderBy(F.desc("gap"), "x").first()
            # what rounding leaves between a point and the mean of its copies is nothing
            if far is not None and far["gap"] > TIE * np.square(far["x"] - centres.mean(0)).sum():
                centres = before = np.vstack([np.delete(centres, empty[:1], axis=0), far["x"]])
                continue
        if centres is not before and not moved:
            return before
        before, centres = centres, np.where(counts > 0, sums / np.maximum(counts, 1), centres)


def _squares(batch: pa.RecordBatch, name: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Points, their squared distances from the middle of the centres, and a function that gives those to centres, a row each."""
    x = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
    middle = centres.mean(0)
    moved = x - middle
    size = np.einsum("ij,ij->i", moved, moved)
    return x, size, lambda of: np.maximum(size - 2 * ((of - middle) @ moved.T) + np.square(of - middle).sum(1)[:, None], 0.0)


def _sums(batches: Iterator[pa.RecordBatch], before: np.ndarray, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """By cluster of ``centres``, the sum of every axis, the number of points, and how many have left their cluster of ``before``."""
    k, width = centres.shape
    table = np.zeros((k, width + 2))
    for batch in batches:
        x, size, squares = _squares(batch, "x", centres)
        gaps = squares(centres)
        old, new = squares(before).argmin(0), gaps.argmin(0)
        inside = (new == np.arange(k)[:, None]).astype(float)
        least, own = gaps.min(0), np.take_along_axis(gaps, old[None], 0)[0]
        table += np.column_stack([inside @ x, inside.sum(1), inside @ (own > least * (1 + TIE) + TIE**1.5 * size)])
    cluster, axis = np.divmod(np.arange(table.size), width + 2)
    yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(axis, pa.int32()), pa.array(table.ravel())], ["cluster", "axis", "total"])


def _farthest(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of every batch the point that is farthest from its centre."""
    for batch in batches:
        if batch.num_rows:
            x, _, squares = _squares(batch, "x", centres)
            gaps = squares(centres).min(0)
            at = int(gaps.argmax())
            yield pa.RecordBatch.from_arrays([pa.array([gaps[at]]), pa.array([x[at].tolist()], pa.list_(pa.float64()))], ["gap", "x"])


def _labelled(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = _squares(batch, "_x", centres)[2](centres).argmin(0)
        names = [n for n in batch.schema.names if n != "_x"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(labels, pa.int32())], [*names, "cluster"])


def _by_event(batches: Iterator[pa.RecordBatch], width: int, run: Callable[[list[np.ndarray]], list[np.ndarray]], rows_out: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Events are held until they have so many rows and clustered together; one event is held at least."""

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, points = rows.column(0).to_numpy(), np.column_stack([rows.column(2 + c).to_numpy() for c in range(width)])
        labels = np.concatenate(run(np.split(points, np.flatnonzero(ids[1:] != ids[:-1]) + 1)))
        yield from rows.append_column("cluster", pa.array(labels, pa.int64())).combine_chunks().to_batches()

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows_out:
            rows = pa.Table.from_batches(held)
            ids = rows.column(0).to_numpy()
            # the last event may go on in the next batch
            whole = int(np.searchsorted(ids, ids[-1]))
            if whole:
                yield from flush(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                size = len(rows) - whole
    if held:
        yield from flush(pa.Table.from_batches(held))


def kmeans_by_event(points: DataFrame, k: int, columns: list[str], distance: Callable[[np.ndarray, np.ndarray], np.ndarray] = kernel.euclidean, seed: int = 0, patience: int = 5, clustered: bool = False) -> DataFrame:
    """(event_id, idx, ``columns``, cluster): k-means within each event by any distance of points to centres; fewer points than k get a cluster each.

    ``clustered`` says that the rows of an event are in one partition already."""
    rows = points.select(F.col("event_id").cast("long"), F.col("idx").cast("long"), *[F.col(c).cast("double") for c in columns])
    ordered = (rows if clustered else rows.repartition("event_id")).sortWithinPartitions("event_id", "idx")
    run = partial(kernel.many, k=k, distance=distance, patience=patience, seed=seed)
    return ordered.mapInArrow(partial(_by_event, width=len(columns), run=run), f"event_id long, idx long, {', '.join(f'`{c}` double' for c in columns)}, cluster long")
