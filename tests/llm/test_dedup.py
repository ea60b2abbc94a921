"""Exact, near, substring and line duplicates against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from partonframe.llm import exact_dedup, line_dedup, simhash, substring_dedup
from partonframe.llm.components import components
from partonframe.llm.scratch import Scratch
from tests.llm.cases import documents, prose, sentences, table

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(UPPER)].append(doc_id)
    out = []
    for doc_id, text in rows:
        normal = (text or "").translate(UPPER)
        keep = max((i for i in groups[normal] if i is not None), default=None)
        out.append((doc_id, keep, len(groups[normal]), doc_id == keep, hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(map(str, out))


def test_exact_on_awkward_rows(spark):
    df = table(spark)
    got = exact_dedup.exact_duplicates(df)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_exact([(r.doc_id, r.text) for r in df.collect()])
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_exact_rounds(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FIRST_WIDTH", 3)
    monkeypatch.setattr(exact_dedup, "GROWTH", 2)
    rng = random.Random(1)
    base = ["".join(rng.choice("ab") for _ in range(60)) for _ in range(4)]
    texts = [b[:40] + rng.choice("ab") + b[41:] for b in base for _ in range(30)] + base
    df = documents(spark, texts)
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_duplicates(df).collect()) == brute_exact(list(enumerate(texts)))


def test_exact_keeps_one_row_of_each_text(spark):
    df = table(spark)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    texts = [(r.text or "").translate(UPPER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r.text or "").translate(UPPER) for r in df.collect()})


def test_hot_exact_group(spark):
    texts = ["copy of a copy"] * 3000 + [f"text {i}" for i in range(3000)]
    got = exact_dedup.exact_duplicates(documents(spark, texts)).where("group_size = 3000 and keep_id = 2999")
    assert got.count() == 3000


def test_an_id_repeated_in_a_hot_group(spark):
    # texts of one length: those of a hot group and two others, one of them with an id of the group
    rows = [(i, "a" * 50) for i in range(1500)] + [(0, "b" * 50), (2000, "b" * 50), (3, "c" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_duplicates(df).collect()) == brute_exact(rows)
    kept = exact_dedup.drop_exact_duplicates(df).collect()
    assert sorted((r.doc_id, r.text[0]) for r in kept) == [(3, "c"), (1499, "a"), (2000, "b")]


def test_a_hot_group_without_ids(spark):
    rows = [(None, "a" * 50)] * 1500 + [(1, "b"), (None, "c" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in exact_dedup.exact_duplicates(df).collect()) == brute_exact(rows)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\x0b", max_size=30), max_size=6))
def test_fingerprints(texts):
    assert simhash.fingerprint_of([t.encode() for t in texts]).tolist() == [brute_fingerprint(t) for t in texts]


def near_texts():
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        words = prose(rng, 300).split()
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            words = words.copy()
            words[rng.randrange(300)] = "changed"
            texts.append(" ".join(words))
    return texts + ["", " ", texts[0]]


@pytest.mark.parametrize("long_list", [simhash.LONG_LIST, 1])
def test_near_duplicates(spark, monkeypatch, long_list):
    texts = near_texts()
    prints = [brute_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = brute_components(links, range(len(texts)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in range(len(texts))}


def test_posting_lists_of_any_length(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    free = [b for b in range(64) if b // 8 not in simhash.POSITIONS[0]]
    fps = set(base.tolist())
    for b in base:
        for _ in range(40):
            flips = rng.choice(free, rng.integers(1, 4), replace=False)
            fps.add(int(b) ^ sum(1 << int(f) for f in flips))
    fp = np.array(sorted(fps), np.uint64)
    key = fp & np.uint64(simhash._mask(simhash.POSITIONS[0]) % (1 << 64))
    order = np.argsort(key, kind="stable")
    fp, key = fp[order], key[order]
    roots = []
    for limit in (2, 1000):
        monkeypatch.setattr(simhash, "LONG_LIST", limit)
        roots.append(simhash.linked(np.zeros(len(fp), np.int16), key.view(np.int64), fp).tolist())
    links = [(i, j) for i in range(len(fp)) for j in range(i) if key[i] == key[j] and int(fp[i] ^ fp[j]).bit_count() <= 2]
    assert roots[0] == roots[1] == list(brute_components(links, range(len(fp))).values())


def test_posting_lists_that_span_batches():
    rng = np.random.default_rng(3)
    choice, key, fp = np.sort(rng.integers(0, 3, 400).astype(np.int16)), np.zeros(400, np.int64), rng.integers(0, 7, 400)
    key[choice == 1] = np.sort(rng.integers(0, 5, (choice == 1).sum()))
    key[choice == 2] = np.sort(rng.integers(0, 200, (choice == 2).sum()))
    table = pa.RecordBatch.from_arrays([pa.array(choice), pa.array(key), pa.array(fp)], ["choice", "key", "fp"])

    def links(size):
        found = [r for b in simhash._link(table.slice(i, size) for i in range(0, 400, size)) for r in zip(*b.to_pydict().values())]
        return sorted(found)

    assert links(1) == links(7) == links(400) and links(400)


def test_near_on_awkward_rows(spark):
    df = table(spark)
    assert simhash.near_duplicates(df).count() == df.count() and simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(df).columns == df.columns


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + rng.randrange(1, 300)) for _ in range(300)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    want = brute_components(pairs, {n for p in pairs for n in p})
    assert got == {n: r for n, r in want.items() if n != 5000}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_passages_that_repeat_are_found_and_others_left_alone(spark):
    rng = random.Random(7)
    passages = [sentences(rng, rng.randrange(51, 90)) for _ in range(40)]
    texts = [f"{prose(rng, 60)} {p} {sentences(rng, 33)}" for p in passages]
    copies = [f"{prose(rng, rng.randrange(5, 80))}\n{p}\n{prose(rng, 20)}" for p in passages]
    clean = [sentences(rng, 150) for _ in range(60)]
    found = substring_dedup.repeated_passages(documents(spark, texts + copies + clean)).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert pairs == {(i, 40 + i) for i in range(40)} | {(40 + i, i) for i in range(40)}
    assert all(r.removed == (r.doc_id >= 40) for r in found)
    for r in found:
        text = (texts + copies)[r.doc_id].encode()[r.start : r.end].decode()
        assert text.strip() in passages[r.doc_id % 40] and len(text.split()) == r.n_words
    kept = {r.doc_id: r.text for r in substring_dedup.drop_repeated_passages(documents(spark, texts + copies + clean)).collect()}
    assert [kept[i] for i in range(40)] == texts and [kept[80 + i] for i in range(60)] == clean
    assert all(len(kept[40 + i]) < len(copies[i]) for i in range(40))


@pytest.mark.parametrize("end", ["", "。"])
def test_no_passage_of_51_words_is_missed(spark, end):
    rng = random.Random(13)
    passages = [" ".join(w + end * (rng.random() < 0.1) for w in prose(rng, 51).split()) for _ in range(400)]
    texts = [f"{prose(rng, 30)} {p} {prose(rng, 30)}" for p in passages]
    copies = [f"{prose(rng, 30)}\n{p.replace(' ', rng.choice([' ', '  ', chr(10)]))} {prose(rng, 30)}" for p in passages]
    found = substring_dedup.repeated_passages(documents(spark, texts + copies)).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(i, (i + 400) % 800) for i in range(800)}
    for r in found:
        part = (texts + copies)[r.doc_id].encode()[r.start : r.end].decode()
        assert " ".join(part.split()) in passages[r.doc_id % 400] and len(part.split()) == r.n_words >= 43


@pytest.mark.parametrize("sizes", [(120, 60), (60, 120)])
def test_adjacent_passages_of_different_partners_stay_once_each(spark, sizes):
    rng = random.Random(9)
    one, two = (sentences(rng, n) for n in sizes)
    own = [sentences(rng, 40) for _ in range(6)]
    texts = [f"{own[0]} {one} {own[1]}", f"{own[2]} {one} {two} {own[3]}", f"{own[4]} {two} {own[5]}"]
    df = documents(spark, texts)
    found = substring_dedup.repeated_passages(df).collect()
    assert {(r.doc_id, r.other_id, r.removed) for r in found} == {(0, 1, False), (1, 0, True), (1, 2, False), (2, 1, True)}
    for r in found:
        part = texts[r.doc_id].encode()[r.start : r.end].decode().strip()
        assert part in (one if {r.doc_id, r.other_id} == {0, 1} else two)
    kept = [r.text for r in substring_dedup.drop_repeated_passages(df).orderBy("doc_id").collect()]
    middle = lambda p: " ".join(p.split()[20:-20])
    assert [sum(middle(p) in t for t in kept) for p in (one, two)] == [1, 1] and one in kept[0] and two in kept[1]


def test_every_gram_stays_in_its_first_document(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(3000)]
    starts = [rng.randrange(2600) for _ in range(60)]
    texts = [" ".join(words[a : a + rng.randrange(60, 400)]) for a in starts]
    df = documents(spark, texts)
    found = substring_dedup.repeated_passages(df).collect()
    kept = [r.text.split() for r in substring_dedup.drop_repeated_passages(df).orderBy("doc_id").collect()]
    assert set(words).intersection(*[" ".join(texts).split()]) == {w for t in kept for w in t}
    for i, t in enumerate(texts):
        mine = sorted((r.start, r.end, r.n_words) for r in found if r.doc_id == i and r.removed)
        assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:]))
        assert all(len(t.encode()[a:b].decode().split()) == n for a, b, n in mine)
        assert len(kept[i]) == len(t.split()) - sum(n for _, _, n in mine)
    stays = [set(k) for k in kept]
    for r in found:
        if not r.removed and r.other_id > r.doc_id:
            assert set(texts[r.doc_id].encode()[r.start : r.end].decode().split()) <= stays[r.doc_id]
    assert sum(map(len, kept)) < 0.5 * sum(len(t.split()) for t in texts)


def test_insertions_shift_only_nearby_chunks():
    rng = random.Random(1)
    text = prose(rng, 2000).encode()

    def cut(t):
        ends = substring_dedup.cuts(np.frombuffer(t, np.uint8)).tolist()
        return {t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    one, two = cut(text), cut(text[:5000] + b"inserted" + text[5000:])
    assert len(one - two) <= 2 and len(two - one) <= 3


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400), st.integers(20, 60))
def test_cuts_do_not_depend_on_the_piece(data, piece):
    whole = substring_dedup.cuts(np.frombuffer(data, np.uint8)).tolist()
    before, substring_dedup.PIECE = substring_dedup.PIECE, piece
    try:
        assert substring_dedup.cuts(np.frombuffer(data, np.uint8)).tolist() == whole
    finally:
        substring_dedup.PIECE = before


def test_passages_on_awkward_rows(spark):
    df = table(spark)
    assert {r.doc_id for r in substring_dedup.repeated_passages(df).collect()} == {6, 7}
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0
    assert substring_dedup.drop_repeated_passages(df).columns == df.columns and substring_dedup.drop_repeated_passages(df).count() == df.count()


def test_lines_of_many_sites(spark):
    rng = random.Random(2)
    lines = [f"line {i}" for i in range(30)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines[: 1 + rng.randrange(32)]) for _ in range(6)), "en", rng.choice([None, *[f"s{k}" for k in range(9)]])) for i in range(120)]
    spread = defaultdict(set)
    for _, text, _, site in rows:
        for line in text.split("\n"):
            spread[line] |= {site} - {None}
    gone = {x for x, s in spread.items() if len(s) >= 6 and x.strip()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df, min_sites=6).collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if x not in gone) for i, t, _, _ in rows} and gone


def test_near_lines_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    test_lines_of_many_sites(spark)


def test_lines_on_awkward_rows(spark):
    df = table(spark)
    got = line_dedup.drop_boilerplate(df).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in df.collect())
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0
