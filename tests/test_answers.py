"""Answers of many events parsed together against those of one event."""

import pandas as pd
import pyarrow as pa
import pytest

from partonframe.schema import NODES
from partonframe.sources import external

ONE = ["# deltaR=0.4 antikt", "7 0 3 -1 -1", "8 1 3 -1 -1", "", "3 -1 -1 7 8", "# pt", "1 2 3 4 5 6 7", "text", " -1 2 3 4 5 6 7", "nan 2 3 4 5 6 7"]
DEEP = ["# kt", "4 -5 -1 9 2", "9 -1 4 0 1", "0 0 9 -1 -1", "1 1 9 -1 -1", "2 2 4 -1 -1", "#", *["1.5 0 0 2.5 1 1 1"] * 5]
OWN = ["# x", "0 0 1 -1 -1", "1 1 -1 1 1", "#", *["1 0 0 2 1 1 1"] * 2]


def table(answers):
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([e] * len(a), pa.int64()), pa.array(a)], ["event_id", "value"]) for e, a in answers])


def test_answers_of_several_events():
    answers = [(3, ONE), (5, DEEP), (6, OWN), (9, DEEP)]
    got = external._answered(table(answers)).to_pandas()
    want = pd.concat([external._node_rows(e, a) for e, a in answers], ignore_index=True)[NODES.fieldNames()]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_a_deep_tree():
    n = 5000
    rows = [f"{i} {i} {n + max(i - 1, 0)} -1 -1" for i in range(n)] + [f"{n + k} {n + k} {n + k + 1 if k < n - 2 else -1} {n + k - 1 if k else 0} {k + 1}" for k in range(n - 1)]
    answer = ["# x", *rows, "#", *["1 0 0 2 1 1 1"] * len(rows)]
    assert external._answered(table([(1, answer)])).to_pandas()["rank"].max() == n - 2


@pytest.mark.parametrize("line, error", [("0 0 5 -1 -1", KeyError), ("0 0 -1 -1 -1\n", ValueError)])
def test_a_broken_answer(line, error):
    with pytest.raises(error):
        external._answered(table([(1, ["# x", line, "#", *(["1 2 3 4 5 6 7"] if error is KeyError else [])])]))


def test_batches_cut_events():
    whole = table([(3, ONE), (5, DEEP)])
    found = pa.Table.from_batches(external._parsed(whole.to_batches(max_chunksize=2), lines_held=3)).to_pandas()
    pd.testing.assert_frame_equal(found, external._answered(whole).to_pandas())
