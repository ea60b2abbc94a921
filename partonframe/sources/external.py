"""Text exchange with an external clustering program, and a bridge that runs one.

Input: a line of index, px, py, pz and energy per particle. Output: a header with parameters and column names,
rows of integers (id, label, parent, children), a line with ``#``, another header and rows of floats.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import NODE_FLOATS, NODE_INTS, NODES

ALGORITHMS = {"kt": 1.0, "cambridge": 0.0, "antikt": -1.0}
RETRIES = 5


def summary_lines(particles: DataFrame) -> DataFrame:
    """(event_id, value): the lines of every event."""
    return particles.select("event_id", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("idx", "px", "py", "pz", "energy")]).alias("value"))


def write_summary(particles: DataFrame, path: str) -> None:
    """The lines as text files, each after its event and a tab; the events of a file are whole and in order."""
    lines = summary_lines(particles).repartition("event_id").sortWithinPartitions("event_id")
    lines.select(F.concat_ws("\t", F.col("event_id").cast("string"), "value").alias("value")).write.mode("overwrite").text(path)


def parse_clusters(lines: list[str]) -> tuple[dict[str, object], np.ndarray, np.ndarray]:
    """(parameters, integer rows, float rows) of an answer; rows in the order of the node table.

    Internal nodes are numbered on from the highest input label, ranks follow from the children.
    """
    cut = next(i for i, line in enumerate(lines) if line.strip().startswith("#") and i > 0)
    head = lines[0].lstrip("#").split()
    params: dict[str, object] = {}
    for token in head:
        if "=" in token:
            k, v = token.split("=", 1)
            params[k] = float(v)
        elif token in ALGORITHMS:
            params["algorithm"], params["ExpofPTInput"] = token, ALGORITHMS[token]
    ints = np.array([[int(x) for x in line.split()] for line in lines[1:cut] if line.strip()], np.int64).reshape(-1, 5)
    rest = [line for line in lines[cut + 1 :] if line.strip()]
    floats = np.array([[float(x) for x in line.split()] for line in rest if line.split()[0][0] in "-+.0123456789ni"], float)
    ids, label, parent, one, two = ints.T
    new = np.flatnonzero(label < 0)
    label = label.copy()
    label[new] = label.max(initial=-1) + 1 + np.arange(len(new))
    of = dict(zip(ids.tolist(), label.tolist(), strict=True)) | {-1: -1}
    named = lambda x: np.array([of[i] for i in x.tolist()], np.int64)
    parent, one, two = named(parent), named(one), named(two)
    rank, place = np.full(len(ids), -1), {int(l): i for i, l in enumerate(label)}
    for i in _by_depth(one, two, place):
        if one[i] >= 0 or two[i] >= 0:
            rank[i] = 1 + max(rank[place[c]] for c in (int(one[i]), int(two[i])) if c >= 0)
    return params, np.column_stack([label, parent, one, two, rank]), floats


def _by_depth(one: np.ndarray, two: np.ndarray, place: dict[int, int]) -> list[int]:
    """Rows with every child before its parent."""
    order, seen = [], set()
    for start in range(len(one)):
        stack = [(start, False)]
        while stack:
            i, ready = stack.pop()
            if ready:
                order.append(i)
            elif i not in seen:
                seen.add(i)
                stack += [(i, True)] + [(place[int(c)], False) for c in (one[i], two[i]) if c >= 0]
    return order


def format_clusters(ints: np.ndarray, floats: np.ndarray, delta_r: float, algorithm: str) -> list[str]:
    """Lines of an answer, the inverse of :func:`parse_clusters`."""
    lines = [f"# deltaR={delta_r} {algorithm} pseudojet_id Label Parent Child1 Child2"]
    lines += [" ".join(map(str, (row[0], *row[:4]))) for row in ints.tolist()]
    lines.append("# " + " ".join(NODE_FLOATS[:7]))
    return lines + [" ".join(repr(float(x)) for x in row[:7]) for row in floats]


def check_tree(ints: np.ndarray) -> None:
    """ValueError unless parents and children agree."""
    parent = dict(zip(ints[:, 0].tolist(), ints[:, 1].tolist(), strict=True))
    for label, _, one, two, _ in ints.tolist():
        for child in (one, two):
            if child >= 0 and child != label and parent.get(child) != label:
                raise ValueError(f"node {child} doesn't have {label} as its parent")


def _run(program: list[str], lines: list[str], retries: int = RETRIES) -> list[str]:
    last = ""
    for _ in range(retries):
        done = subprocess.run(program, input="\n".join(lines) + "\n", capture_output=True, text=True)
        if done.returncode == 0 and done.stdout.strip():
            return done.stdout.splitlines()
        last = done.stderr
    raise RuntimeError(f"{program[0]} failed {retries} times: {last[-300:]}")


def _node_rows(event: int, lines: list[str]) -> pd.DataFrame:
    """The node table of an event's answer."""
    _, ints, floats = parse_clusters(lines)
    out = pd.DataFrame(ints, columns=NODE_INTS)
    for k, name in enumerate(NODE_FLOATS):
        out[name] = floats[:, k] if k < floats.shape[1] else (0.0 if name == "join_distance" else 1.0)
    up = dict(zip(out["label"], out["parent"], strict=True))

    def top(label: int) -> int:
        while up[label] >= 0:
            label = up[label]
        return label

    out.insert(0, "jet_id", [top(x) for x in out["label"]])
    out.insert(0, "event_id", event)
    return out


def cluster_externally(particles: DataFrame, program: list[str]) -> DataFrame:
    """Nodes by a program that reads an event's lines and writes an answer; it must be installed on the executors."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("idx")
        lines = [" ".join(map(str, r)) for r in rows[["idx", "px", "py", "pz", "energy"]].itertuples(index=False)]
        return _node_rows(group["event_id"].iloc[0], _run(program, lines))

    return particles.select("event_id", "idx", "px", "py", "pz", "energy").groupBy("event_id").applyInPandas(one, NODES)


def read_answers(answers: DataFrame, clustered: bool = False) -> DataFrame:
    """Nodes of the lines (event_id, place, value) of answers, one for each event; a line's place says where it stands.

    ``clustered`` says that the lines of an event are in one partition already. Whole events are parsed together, some thousands of lines at a time.
    """
    lines = answers.select("event_id", "place", "value")
    dealt = lines if clustered else lines.repartition("event_id")
    return dealt.sortWithinPartitions("event_id", "place").select("event_id", "value").mapInArrow(_parsed, NODES)


def _parsed(batches: Iterator[pa.RecordBatch], lines_held: int = 50_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def whole(last: bool) -> tuple[pa.Table | None, list[pa.Table]]:
        """The lines of the events that have ended, and those of the last one."""
        table = pa.Table.from_batches(held)
        ids = table["event_id"].to_numpy()
        cut = len(ids) if last else int(np.searchsorted(ids, ids[-1]))
        return table.slice(0, cut), table.slice(cut).to_batches()

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= lines_held:
            done, held = whole(False)
            size = sum(b.num_rows for b in held)
            if done.num_rows:
                yield _answered(done)
    if size:
        yield _answered(whole(True)[0])


def _answered(lines: pa.Table) -> pa.RecordBatch:
    """:func:`_node_rows` of all events of these lines, which are in order."""
    value = pc.utf8_trim_whitespace(lines["value"].combine_chunks())
    event = lines["event_id"].to_numpy()
    starts = np.flatnonzero(np.r_[True, event[1:] != event[:-1]])
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(event)]))
    at = np.arange(len(event)) - starts[of]
    sharp = pc.starts_with(value, "#").to_numpy(zero_copy_only=False) & (at > 0)
    second = np.flatnonzero(sharp)
    if len(np.unique(of[second])) < len(starts):
        raise ValueError("an answer has no second header")
    cut = np.full(len(starts), len(event))
    np.minimum.at(cut, of[second], at[second])
    filled = pc.greater(pc.utf8_length(value), 0).to_numpy(zero_copy_only=False)
    whole = (at > 0) & (at < cut[of]) & filled
    number = pc.match_substring_regex(value, "^[-+.0-9ni]").to_numpy(zero_copy_only=False)
    fraction = (at > cut[of]) & filled & number
    g, two_way = of[whole], of[fraction]
    if not np.array_equal(g, two_way):
        raise ValueError("an answer has other rows of integers than of floats")
    numbers = lambda mask, kind: np.array(" ".join(value.filter(pa.array(mask)).to_pylist()).split(), kind).reshape(int(mask.sum()), -1)
    ints, floats = numbers(whole, np.int64).reshape(-1, 5), numbers(fraction, np.float64)
    ids, label = ints[:, 0], ints[:, 1].copy()
    begins = np.searchsorted(g, np.arange(len(starts)))
    new = label < 0
    there = np.unique(g)
    top = np.full(len(starts), -1)
    top[there] = np.maximum(np.maximum.reduceat(label, begins[there]), -1)
    so_far = np.cumsum(new)
    label[new] = top[g[new]] + so_far[new] - (so_far - new)[begins[g[new]]]

    def rows_of(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Row of each asked key in its event, -1 for -1."""
        order = np.lexsort((keys, g))
        low = int(min(keys.min(), -1))
        wide = int(max(keys.max(), asked.max())) - low + 1
        place = np.searchsorted((g * wide + keys - low)[order], g * wide + asked - low)
        found = order[np.minimum(place, len(order) - 1)]
        missing = (asked != -1) & ((keys[found] != asked) | (g[found] != g))
        if missing.any():
            raise KeyError(int(asked[missing][0]))
        return np.where(asked == -1, -1, found)

    up, one, two = (rows_of(ids, ints[:, k]) for k in (2, 3, 4))
    named = lambda row: np.where(row < 0, -1, label[row])
    rank = _ranks(one, two, g, begins)
    root = np.where(up < 0, np.arange(len(up)), up)
    for _ in range(64):  # twice as far up each time
        above = root[root]
        if np.array_equal(above, root):
            break
        root = above
    else:
        raise ValueError("an answer's parents go in a circle")
    columns = [event[starts][g], label[root], label, named(up), named(one), named(two), rank]
    for k, name in enumerate(NODE_FLOATS):
        columns.append(floats[:, k] if k < floats.shape[1] else np.full(len(g), 0.0 if name == "join_distance" else 1.0))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NODES.fieldNames())


def _ranks(one: np.ndarray, two: np.ndarray, g: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One more than the greatest rank of the children, -1 for rows without; a row that is its own child has rank 0."""
    own = np.arange(len(one))
    rank = np.full(len(one), -1)
    one, two = np.where(one == own, -2, one), np.where(two == own, -2, two)
    left = np.flatnonzero((one != -1) | (two != -1))
    ready = np.ones(len(one), bool)
    ready[left] = False
    turns = 0
    while len(left):
        a, b = one[left], two[left]
        can = (ready[a] | (a < 0)) & (ready[b] | (b < 0))
        turns += 1
        if not can.any() or turns > 2000:  # circles, or one very deep tree
            for k in np.unique(g[left]):
                lo, hi = begins[k], begins[k + 1] if k + 1 < len(begins) else len(one)
                for i in lo + np.array(_by_depth(*(np.where(c[lo:hi] < 0, c[lo:hi], c[lo:hi] - lo) for c in (one, two)), dict(enumerate(range(hi - lo))))):
                    if one[i] != -1 or two[i] != -1:
                        rank[i] = 1 + max(rank[c] if c >= 0 else -1 for c in (one[i], two[i]))
            break
        now = left[can]
        rank[now] = 1 + np.maximum(np.where(a[can] < 0, -1, rank[a[can]]), np.where(b[can] < 0, -1, rank[b[can]]))
        ready[now] = True
        left = left[~can]
    return rank


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Particles of text files of :func:`write_summary`."""
    halves = F.split("value", "\t", 2)
    fields = F.split(halves[1], " ")
    return spark.read.text(path).select(halves[0].cast("long").alias("event_id"), fields[0].cast("long").alias("idx"), *[fields[i + 1].cast("double").alias(c) for i, c in enumerate(("px", "py", "pz", "energy"))])


def answer_lines(nodes: DataFrame, delta_r: float, algorithm: str) -> DataFrame:
    """(event_id, place, value): the answer's lines for node tables, to be ordered by place; the lines of an event are in one partition.

    Every node gives its two lines, the first one the headers too, so that the nodes are made once.
    """
    line = lambda place, *text: F.struct(place.cast("long").alias("place"), F.concat_ws(" ", *text).alias("value"))
    text = lambda columns: [F.col(c).cast("string") for c in columns]
    own = [line(F.col("label") + 1, *text(("label", *NODE_INTS[:4]))), line(F.col("label") + F.lit(1 << 40), *text(NODE_FLOATS[:7]))]
    heads = [line(F.lit(0), F.lit(f"# deltaR={delta_r} {algorithm} pseudojet_id Label Parent Child1 Child2")), line(F.lit((1 << 40) - 1), F.lit("# " + " ".join(NODE_FLOATS[:7])))]
    first = F.col("label") == F.min("label").over(Window.partitionBy("event_id"))
    each = nodes.withColumn("_first", first).select("event_id", F.explode(F.when(F.col("_first"), F.array(*heads, *own)).otherwise(F.array(*own))).alias("x"))
    return each.select("event_id", "x.*")


def draw_tree(ints: np.ndarray) -> str:
    """A merge tree in letters, a line per node, children under their parent."""
    children = {int(r[0]): [int(c) for c in r[2:4] if c >= 0 and c != r[0]] for r in ints}
    lines: list[str] = []

    def draw(label: int, depth: int) -> None:
        stack = [(label, depth)]
        while stack:
            node, deep = stack.pop()
            lines.append("  " * deep + str(node))
            stack += [(c, deep + 1) for c in reversed(children[node])]

    for row in ints:
        if row[1] < 0:
            draw(int(row[0]), 0)
    return "\n".join(lines)
