"""The filter audit against a walk of every document through every order."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from partonframe.llm import filter_audit
from tests.llm.cases import ROWS, prose, table


def brute(rows, labels):
    """{(part, order, step): counts} by following each document."""
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang, *_ in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {k for k, bad in {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": re.search("[#$%&*|]", t), "E": i is not None and least[t] < i,
        }.items() if bad}
        docs.append((lang or "", fails, any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, k in enumerate(order, 1):
                gone, left = [d for d in left if k in d[1]], [d for d in left if k not in d[1]]
                fail = [d for d in docs if d[0] == part and k in d[1]]
                out[part, order, step] = [len(left), len(gone), len(fail) - len(gone), sum(d[1] == {k} for d in fail), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, k] += len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def result(spark, rows, labels):
    found = filter_audit.audit_filters(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}


def test_awkward_rows(spark):
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    assert result(spark, ROWS, labels) == brute(ROWS, labels)


def test_random_documents_with_copies(spark):
    rng = random.Random(12)
    texts = [prose(rng, n, v) for n in (5, 99, 100, 150) for v in (30, 4000)] + [prose(rng, 120).upper(), prose(rng, 130) + " |", "", None]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["a", "b", "", None]), "s") for _ in range(300)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 60, 2)]
    assert result(spark, rows, labels) == brute(rows, labels)


def test_zeta_counts_every_subset(spark):
    rng = random.Random(3)
    counts = [("p", m, rng.randrange(50), 0, 0) for m in range(32) if rng.random() < 0.8]
    got = filter_audit.survivors(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long")).first()
    assert got.n == [sum(n for _, m, n, _, _ in counts if not m & s) for s in range(32)]


def test_no_rows_and_no_labels(spark):
    assert result(spark, [], [(1, 1, 1)]) == {}
    assert result(spark, ROWS[:4], []) == brute(ROWS[:4], [])


def test_one_text_of_many_rows_is_counted_before_it_is_sent(spark):
    """A text that most rows share reaches the window over its copies as a row for each part, label and mask."""
    rows = [(i, "same text", f"l{i % 3}", "s") for i in range(3000)]
    counts = filter_audit.mask_counts(table(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    by_part = defaultdict(dict)
    for r in counts.collect():
        by_part[r.part][r["mask"]] = r.n
    assert by_part == {"l0": {1: 1, 17: 999}, "l1": {1: 0, 17: 1000}, "l2": {1: 0, 17: 1000}}
