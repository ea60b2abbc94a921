"""The pipeline against a brute-force version, stage by stage."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from partonframe.llm.mixing import mix, mixed_documents
from partonframe.llm.queries import tokenizer_path
from partonframe.llm.simhash import drop_near_duplicates
from tests.llm.cases import prose, table
from tests.llm.test_dedup import UPPER, brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(20, 120)) for _ in range(60)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].upper(), "en", "s1") for i in range(8)]
    rows += [(200 + i, texts[i] + " tail", "de", "s2") for i in range(8, 30)]
    rows += [(300, "", "en", "s0"), (301, "123 456", "en", "s0"), (302, None, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def stages(spark, sf_dir, tmp):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{tmp}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp}/{name}")
    return out


def test_stages(spark, sf_dir, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    out = stages(spark, sf_dir, tmp_path)
    rows = {n: [r.asDict() for r in df.collect()] for n, df in out.items()}
    start = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids = lambda x: sorted(r["doc_id"] for r in x)

    assert ids(rows["language"]) == sorted(r["doc_id"] for r in start if any(c.isalpha() for c in r["text"] or ""))
    best = {}
    for r in rows["language"]:
        key = r["text"].translate(UPPER)
        best[key] = max(best.get(key, -1), r["doc_id"])
    assert ids(rows["exact"]) == sorted(best.values())
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows["exact"]}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert ids(rows["near"]) == sorted(set(brute_components(links, prints).values()))

    sizes = {r["doc_id"]: len(r["text"].split()) for r in rows["near"]}
    times = Counter(r["doc_id"] for r in rows["mixing"])
    assert set(times) <= set(sizes) and max(times.values()) <= 3
    assert sum(sizes[i] * n for i, n in times.items()) == pytest.approx(sum(sizes.values()), rel=0.1)
    for name in ("language", "exact", "near", "mixing"):
        assert out[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]
        texts = {r["doc_id"]: r["text"] for r in start}
        assert all(r["text"] == texts[r["doc_id"]] for r in rows[name])

    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in rows["mixing"]:
        found = tokenizer.encode(r["text"], add_special_tokens=False).ids
        want.append((r["doc_id"], len(found), sha(",".join(map(str, found))), sha(r["text"])))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows["tokens"]) == sorted(want)


def test_run_equals_the_stages(spark, sf_dir, tmp_path):
    want = stages(spark, sf_dir, tmp_path)["tokens"].collect()
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("rows", [None, []])
def test_stages_take_awkward_rows(spark, rows, tmp_path):
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")


def test_near_keeps_one_of_each_class_whatever_the_ids(spark):
    rng = random.Random(17)
    a, b, c, d, e, f = (prose(rng, 300) for _ in range(6))
    # a null id and a repeated one in classes that others name, and unique texts and names of classes with the same ids
    rows = [(1, a), (None, a.upper()), (None, b), (2, c), (2, d), (3, d.upper()), (None, e), (None, e.upper()), (5, f), (2, f), (2, f)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    got = sorted((r.text.lower(), -1 if r.doc_id is None else r.doc_id) for r in drop_near_duplicates(df).collect())
    assert got == sorted([(a, 1), (b, -1), (c, 2), (d, 2), (e, -1), (f, 2)])


def test_the_mix_takes_rows_of_any_ids_three_times_at_most(spark):
    rng = random.Random(19)
    rows = [(None if i % 2 else 7, prose(rng, rng.randrange(40, 60)), f"s{i % 3}") for i in range(90)]
    rows += [(7, rows[0][1], "s0")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = Counter(r.text for r in mixed_documents(df, mix(df, block_words=16)).collect())
    assert all(n <= 3 for t, n in times.items() if t != rows[0][1]) and times[rows[0][1]] <= 9
    assert sum(len(t.split()) * n for t, n in times.items()) == pytest.approx(sum(len(t.split()) for _, t, _ in rows), rel=0.1)
