"""Clustering as a table function of SQL.

    select * from cluster_events(table(particles) partition by event_id order by (idx), 'GeneralisedKT', '{"DeltaR": 0.4}')
    select * from cluster_events_together(table(select * from particles distribute by event_id sort by event_id, idx), 'GeneralisedKT', '{"DeltaR": 0.4}')

Of a table that is partitioned by event, Spark gives a function one event at a time. The second function takes a table whose
events are together in a task and sorted, as a whole task's stream of batches, so that small events take their steps together;
it is the one for large tables. Rows that aren't sorted by event end its query.

Events end as in ``operators.cluster.cluster``: those of any size are clustered, and one whose eigen-decomposition
fails has one row with its status and no node, and the query goes on.
"""

from __future__ import annotations

import json
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..operators.cluster import INPUTS, KERNELS, LINEAR, MANY, MOST_PARTICLES, _cluster
from ..operators.kernels.physics import Nodes, rapidity
from ..plans.params import check_params
from ..schema import CLUSTERED, NODES

#: Particles of whole events that are held before they are clustered, and the event of rows without one, the first in order.
ROWS, NO_EVENT = 20_000, -(2**63)


def _most(algorithm: str) -> float:
    return float("inf") if algorithm in LINEAR else MOST_PARTICLES


def _params(algorithm: str, text: str) -> dict:
    params = check_params(algorithm, json.loads(text))
    if algorithm.startswith("Spectral"):
        params.pop("PhyDistance")
    return params


class ClusterEvents:
    """Rows of a partition, one event at a time, in; nodes out."""

    def __init__(self):
        self.event, self.rows, self.n, self.how = None, [], 0, None

    def _nodes(self):
        if not self.n:
            return
        algorithm, text = self.how
        params = _params(algorithm, text)
        began, status, nodes = time.perf_counter(), "ok", ()
        if self.n > _most(algorithm):
            status = "too_large"
        else:
            px, py, pz, energy = np.array(self.rows, float).T
            pt = np.hypot(px, py)
            try:
                root, ints, floats = KERNELS[algorithm](Nodes(px, py, pz, energy, pt, rapidity(pt, pz, energy), np.arctan2(py, px)), **params).table()
                nodes = zip(root.tolist(), ints.tolist(), floats.tolist(), strict=True)
            except np.linalg.LinAlgError:
                status = "linalg_error"
        self.rows, self.n = [], 0
        if status != "ok":
            yield (self.event, *[None] * (len(NODES) - 1), status, float("nan"))
        seconds = time.perf_counter() - began
        for r, i, f in nodes:
            yield (self.event, r, *i, *f, status, seconds)

    def eval(self, row, algorithm: str, params: str):
        if self.event is not None and row["event_id"] != self.event:
            yield from self._nodes()
        self.event, self.how = row["event_id"], (algorithm, params)
        self.n += 1
        if self.n <= _most(algorithm):
            self.rows.append([row[c] for c in ("px", "py", "pz", "energy")])

    def terminate(self):
        yield from self._nodes()


class ClusterTogether:
    """Batches of rows that are sorted by event in; batches of the nodes of many events out.

    Whole events are held until they have ROWS rows. Of the event that may go on in the next batch all rows are held, but
    where MOST_PARTICLES is finite not many more.
    """

    def __init__(self):
        self.whole, self.n_whole, self.open, self.n_open, self.last, self.how = [], 0, [], 0, None, None

    def _nodes(self):
        if not self.whole:
            return
        algorithm, text = self.how
        kernel = KERNELS[algorithm]
        for made in _cluster(iter(self.whole), kernel, _params(algorithm, text), _most(algorithm), many=MANY.get(kernel), rows_out=2 * ROWS):
            event = made.column(0)
            yield made.set_column(0, "event_id", pc.if_else(pc.equal(event, NO_EVENT), pa.scalar(None, pa.int64()), event))
        self.whole, self.n_whole = [], 0

    def _close(self) -> None:
        self.whole += self.open
        self.n_whole += self.n_open
        self.open, self.n_open = [], 0

    def eval(self, batch: pa.RecordBatch, algorithm: pa.Array, params: pa.Array):
        if not batch.num_rows:
            return
        self.how = algorithm[0].as_py(), params[0].as_py()
        event = batch.column("event_id").cast(pa.int64()).fill_null(NO_EVENT)
        ids = event.to_numpy()
        if (ids[1:] < ids[:-1]).any() or (self.last is not None and ids[0] < self.last):
            raise ValueError("the rows of the table aren't sorted by event_id: distribute by event_id sort by event_id, idx")
        px, py, pz, energy = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("px", "py", "pz", "energy"))
        pt = np.hypot(px, py)
        values = [px, py, pz, energy, pt, rapidity(pt, pz, energy), np.arctan2(py, px)]
        rows = pa.RecordBatch.from_arrays([event, pa.nulls(len(ids), pa.int64()), *map(pa.array, values)], INPUTS)
        begins = int(np.searchsorted(ids, ids[-1]))
        if ids[-1] != self.last:
            if begins:
                self.open.append(rows.slice(0, begins))
                self.n_open += begins
            self._close()
        if self.n_open <= _most(self.how[0]):
            self.open.append(rows.slice(begins))
        self.n_open += len(ids) - begins
        self.last = ids[-1]
        if self.n_whole >= ROWS:
            yield from self._nodes()

    def terminate(self):
        self._close()
        yield from self._nodes()


def register(spark: SparkSession, name: str = "cluster_events", together: str = "cluster_events_together") -> None:
    spark.udtf.register(name, udtf(ClusterEvents, returnType=CLUSTERED))
    spark.udtf.register(together, arrow_udtf(ClusterTogether, returnType=CLUSTERED))
