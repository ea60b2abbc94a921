"""Personal data: texts that must not overflow the search, labelled seeds, and discovery on the given documents."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from partonframe.llm import pii
from tests.llm.cases import documents, prose

LONG = 1_000_000


@pytest.mark.parametrize("unit", ["1", "1-", "+", ".", "1.", "a@b.", "+1", 'token = "', "1)("])
def test_long_runs_neither_overflow_nor_take_forever(spark, unit):
    """A text of a million characters of any pattern's own characters, for every pattern and for the base query."""
    text = unit * (LONG // len(unit))
    docs = documents(spark, [text, f"{text} x", f"write to a.b@mail.example.com {text}"])
    assert pii.base_spans(docs).count() == 3
    # the same matches as Python's, whose search doesn't recurse, on a part that it can search in time
    short = unit * 40
    few = documents(spark, [short]).select(*[F.transform(pii._found(F.col("text"), p), lambda x: x["match"]).alias(k) for k, p in pii.PATTERNS.items()]).first()
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    assert {k: few[k] for k in plain} == {k: re.findall(p, short) for k, p in plain.items()}


@pytest.mark.parametrize(("text", "value"), [
    ('token = "9742a250"', "9742a250"), ("API_KEY:  abcd1234;", "abcd1234"), ("'password':'pa55w0rd!'", "pa55w0rd!"), ("secret=12345678", "12345678"), ("token=abcdefgh", None), ("token is 12345678", None),
    ("token = 1234", None), ("tokens = 12345678", None),
])
def test_labelled_seeds(spark, text, value):
    row = documents(spark, [text]).select(F.filter(pii._found(F.col("text"), pii.LABELLED), lambda x: pii._valid(F.lit("labelled"), x["match"])).alias("x")).first()
    assert [x.match for x in row.x] == ([value] if value else [])


def test_nothing_is_discovered_that_only_seeds_support(spark):
    """Values behind labels are context spans, but count as discovered only where no label stands."""
    rng = random.Random(5)
    code = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(12))
    labelled = [f'{prose(rng, 6)} grant token = "{code()}" {prose(rng, 3)}' for _ in range(12)]
    texts = labelled + [f"{prose(rng, 6)} serial of {code()} is old" for _ in range(12)]
    got = {r.doc_id: r for r in pii.find(documents(spark, texts)).collect()}
    assert all((got[i].n_context, got[i].n_discovered) == (1, 0) for i in range(12)) and not any(got[i].n_spans for i in range(12, 24))


SF = "/root/testdata/sf0.01"


def plant(rows, rng):
    """An identifier in every fifth document, behind one of four cues: three in four are cards, which a seed's pattern knows,
    the others codes that none does. (documents, {doc_id: (start, end, known)})."""
    out, where = [], {}
    cues = ["passport holder", "número de cliente", "Ausweis Nummer", "badge of"]
    for k, (doc_id, text) in enumerate(rows):
        if k % 5 == 0 and text and " " in text:
            known = k // 20 % 4 > 0
            at = text.index(" ", rng.randrange(len(text) // 2 + 1)) if " " in text[len(text) // 2 :] else text.rindex(" ")
            if known:
                digits = [4, *(rng.randrange(10) for _ in range(14))]
                total = sum(d if i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))
                value = "".join(map(str, digits)) + str(-total % 10)
            else:
                value = "".join(rng.choice("BCDFGHKLMNPQ") for _ in range(5)) + str(rng.randrange(1000))
            before = f"{text[:at]} {cues[k // 5 % 4]} "
            text, where[doc_id] = f"{before}{value} {text[at + 1 :]}", (len(before), len(before) + len(value), known)
        out.append((doc_id, text))
    return out, where


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_planted_identifiers_in_the_given_documents(spark):
    rng = random.Random(9)
    rows = [tuple(r) for r in spark.read.parquet(f"{os.environ.get('PII_SF', SF)}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    planted, where = plant(rows, rng)
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(planted, "doc_id long, text string")).collect()}
    unknown = {d: (a, b) for d, (a, b, known) in where.items() if not known}
    hit = sum(f"context:{a}:{b}" in got[d].spans.split(",") for d, (a, b) in unknown.items())
    every = sum(r.n_discovered for r in got.values())
    print(f"{len(unknown)} planted, {hit} found, {every} discovered: recall {hit / len(unknown):.3f}, precision {hit / max(every, 1):.3f}")
    assert hit >= 0.9 * len(unknown) and hit >= 0.9 * every
