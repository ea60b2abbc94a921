"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from partonframe.llm import spelling
from partonframe.llm.scratch import Scratch
from tests.llm.cases import ROWS, table


def brute_counts(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    """One edit parts the words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        others = sorted((o for o in counts if near(w, o)), key=lambda o: (-counts[o], o))
        form = others[0] if others and counts[others[0]] >= 10 * n else None
        out[w] = [n, len(others), form, counts.get(form)]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def result(found):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found.collect()}


def variants(rng, word, letters, edits=1):
    for _ in range(edits):
        at = rng.randrange(len(word))
        word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])
    return word


def pairs_of(spark, words):
    return spelling.near_pairs(spelling.with_bands(spark.createDataFrame([(w, 2) for w in words], "word string, n long")))


def test_documents_with_planted_variants(spark):
    rng = random.Random(11)
    letters = "abcdefghéß×ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 13))) for _ in range(40)]
    rows = []
    for i in range(250):
        words = [rng.choice(base[: 1 + i % 40]) for _ in range(60)] + [variants(rng, rng.choice(base), letters, rng.randrange(1, 3)) for _ in range(12)]
        rows.append((rng.choice([i, i, None]), rng.choice([" ", "-", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in words), "en", "s"))
    rows += [(1000 + i, " ".join([base[0]] * 900 + [base[0] + "h"] * 60 + [base[0] + "hé"]), "en", "s") for i in range(8)]
    want = brute(brute_counts(rows))
    assert result(spelling.spelling_variants(table(spark, rows))) == want
    assert sum(v[2] is not None for v in want.values()) > 20 and any(v[2] and v[4] != v[2] for v in want.values())


def test_awkward_rows(spark):
    rows = ROWS * 2 + [(50, "a" * 300_000 + " " + "A" * 300_000 + " " + "a" * 299_999 + "b", "x", "y"), (51, "a" * 299_999 + "b", "x", "y"), (52, "Étéétés Étéétés", "x", "y")]
    counts = brute_counts(rows)
    got = result(spelling.spelling_variants(table(spark, rows)))
    assert {w: v[0] for w, v in got.items()} == counts
    long = [w for w in counts if len(w) > 1000]
    assert len(long) == 2 and all(got[w][1] == 1 for w in long)
    assert spelling.spelling_variants(table(spark, [])).count() == 0


def test_all_pairs_of_a_dense_vocabulary_once(spark):
    """Few letters, so that most pairs of words share masks, halves and lengths."""
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abà") for _ in range(rng.randrange(7, 11))) for _ in range(700)})
    found = pairs_of(spark, words).collect()
    pairs = sorted(tuple(sorted((r.word, r.other))) for r in found)
    assert pairs == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))


def test_every_position_and_kind_of_edit(spark):
    word = "abcdefghij"
    edited = {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for k in (0, 1) for c in ("", "x", "ÿ", word[i % 10])} - {word}
    found = pairs_of(spark, edited | {word}).where((F.col("word") == word) | (F.col("other") == word))
    assert {r.word if r.other == word else r.other for r in found.collect()} == {w for w in edited if near(w, word)}


def test_masks_have_a_bit_for_each_letter(spark):
    letters = [chr(c) for c in (*range(97, 123), *range(192, 256))]
    rows = spark.createDataFrame([(x,) for x in letters], "w string").select("w", F.array(*spelling.parity_bands(F.col("w"))).alias("b")).collect()
    assert len({tuple(r.b) for r in rows}) == 90 and all(sum(v.bit_count() for v in r.b) == 1 for r in rows)


def test_long_words_are_compared_without_squares(spark):
    rng = random.Random(13)
    word = "".join(rng.choice("abc") for _ in range(200))
    edited = [word[:i] + c + word[i + k :] for i in (0, 66, 67, 100, 133, 134, 199, 200) for k in (0, 1) for c in ("", "x", "a")] + [word[:50] + word[60:], "x" + word[1:-1] + "x"]
    words = sorted({word, *edited})
    got = sorted(tuple(sorted((r.word, r.other))) for r in pairs_of(spark, words).collect())
    assert got == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))


def test_chains_of_forms(spark):
    forms = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(19)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string"), Scratch(spark)).collect()}
    assert got == {w: "w19" for w, _ in forms}


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_pieces_keep_runs_whole(monkeypatch, size):
    monkeypatch.setattr(spelling, "PIECE", size)
    text = "abcdefgh abc, éééééééé abcdefghijklmn 1"
    assert "".join(spelling._pieces(text)) == text
    assert sorted(w for p in spelling._pieces(text) for w in spelling.RUN.findall(p)) == sorted(w for w in re.findall("[a-zÀ-ÿ]+", text) if len(w) >= 7)
