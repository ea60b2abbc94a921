"""Language, quality, personal data, chats, mixing and tokens against brute force."""

import json
import math
import os
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from partonframe.llm import bpe, chat_format, language_id, mixing, pii, quality
from partonframe.llm.scratch import Scratch
from partonframe.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.cases import documents, prose, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    sort = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert sort(got).equals(sort(want))


# language
def brute_bits(text, grams):
    """PPM code length with escape C and exclusion, from counts of grams of 1 + ORDER bytes."""
    trees = [defaultdict(Counter) for _ in range(language_id.ORDER + 1)]
    for gram, n in grams.items():
        for k in range(language_id.ORDER + 1):
            trees[k][gram[language_id.ORDER - k : language_id.ORDER]][gram[-1]] += n
    data, bits = b"\n" * language_id.ORDER + text, 0.0
    for i in range(language_id.ORDER, len(data)):
        excluded, c = set(), data[i]
        for k in range(language_id.ORDER, -1, -1):
            seen = {b: n for b, n in trees[k][data[i - k : i]].items() if b not in excluded}
            total, kinds = sum(seen.values()), len(seen)
            if c in seen:
                bits -= math.log2(seen[c] / (total + kinds))
                break
            if kinds:
                bits -= math.log2(kinds / (total + kinds))
            excluded |= set(seen)
        else:
            bits += math.log2(256 - len(excluded))
    return bits


def test_code_lengths_equal_brute_force():
    rng = random.Random(1)
    grams = {}
    for lang, letters in (("aa", "abc "), ("bb", "bcdé ")):
        text = ("\n\n\n" + "".join(rng.choice(letters) for _ in range(400))).encode()
        grams[lang] = Counter(text[i : i + 4] for i in range(len(text) - 3))
    pack = lambda g: int.from_bytes(g, "big")
    model = language_id.fit({k: (np.array([pack(g) for g in v]), np.array(list(v.values()))) for k, v in grams.items()})
    texts = [b"abcabc", "bcdé xyz".encode(), b"", b"zzz", b"a"]
    got = model.code_lengths(texts)
    want = [[brute_bits(t, grams[k]) for k in ("aa", "bb")] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


@pytest.mark.parametrize("room", [1, 3000])
def test_contexts_without_a_row_in_the_table_are_exact(monkeypatch, room):
    monkeypatch.setattr(language_id, "DENSE_BYTES", room)
    test_code_lengths_equal_brute_force()


def test_long_texts_are_scored_in_pieces(monkeypatch):
    model = language_id.fit({"a": (np.array([int.from_bytes(b"\n\n\na", "big"), int.from_bytes(b"aaab", "big")]), np.array([1, 2]))})
    text = b"aaabab" * 500
    whole = model.code_lengths([text, b"ab"])
    monkeypatch.setattr(language_id, "PIECE", 17)
    assert np.allclose(model.code_lengths([text, b"ab"]), whole)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs, language_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert language_id.keep_identified(docs).count() == docs.count()


def test_language_on_awkward_rows(spark):
    df = table(spark)
    got = language_id.identify(df, language_id.learn(df)).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    texts = {r.doc_id: r.lang_pred for r in got}
    assert texts[3] == texts[4] == texts[5] == texts[9] == "und" and texts[6] != "und"
    assert language_id.identify(df.limit(0), None).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, language_id.learn(df.limit(0))).collect()} == {"und"}
    assert language_id.keep_identified(df).columns == df.columns


# quality
def test_quality_on_awkward_rows(spark):
    df = table(spark)
    got = quality.score(df).collect()
    assert len(got) == df.count() and quality.score(df.limit(0)).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[6].n_words == 9000 and by[6].n_repeat_words == 9000 and by[6].base_failed


def test_repeated_words_and_lines(spark):
    text = "a b c d a b c e\nx\ny\nx\n \n"
    row = quality.score(documents(spark, [text])).first()
    assert (row.n_words, row.n_repeat_words, row.n_dup_lines, row.word_chars) == (11, 6, 1, 11)


def votes(spark, rng, n, prior, rates):
    """Vote patterns of documents whose quality is known, with how many there are of each, and how often it is good."""
    found = defaultdict(lambda: [0, 0])
    for _ in range(n):
        good = rng.random() < prior
        pattern = tuple(0 if rng.random() < 0.2 else (1 if rng.random() < a else -1) if good else (-1 if rng.random() < b else 1) for a, b in rates)
        found[pattern][0] += 1
        found[pattern][1] += good
    return spark.createDataFrame([(*p, n) for p, (n, _) in found.items()], ", ".join([f"v{j} int" for j in range(len(rates))] + ["n long"])), found


def test_estimates_recover_known_rates(spark):
    rates = [(0.98, 0.9), (0.9, 0.3), (0.75, 0.8), (0.99, 0.5), (0.6, 0.45)]
    patterns, _ = votes(spark, random.Random(21), 20_000, 0.8, rates)
    prior, got = quality.estimate(patterns.coalesce(1), rounds=60)
    assert prior == pytest.approx(0.8, abs=0.03)
    assert np.allclose(got, rates, atol=0.06)


def test_the_posterior_overrules_the_count_of_votes(spark):
    rates = [(0.99, 0.95), (0.55, 0.5), (0.6, 0.45), (0.95, 0.6)]
    patterns, found = votes(spark, random.Random(22), 20_000, 0.7, rates)
    prior, got = quality.estimate(patterns.coalesce(1), rounds=60)
    posterior = quality.posterior_sql(f"{prior!r}D", [(f"{a!r}D", f"{b!r}D") for a, b in got])
    verdict = {tuple(r[f"v{j}"] for j in range(4)): r.p >= 0.5 for r in patterns.selectExpr("*", f"{posterior} as p").collect()}
    # one vote of the best rule against two or three of the others, both ways
    assert verdict[-1, 1, 1, 1] is False and verdict[1, -1, -1, 1] is True and verdict[1, -1, -1, 0] is True
    right = sum(good if verdict[p] else n - good for p, (n, good) in found.items())
    plain = sum(good if sum(p) >= 0 else n - good for p, (n, good) in found.items())
    assert right > plain + 1000


def test_junk_is_told_from_prose(spark):
    rng = random.Random(4)
    good = [". ".join(prose(rng, 12).replace("w", "wor").translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(12)) + "." for _ in range(60)]
    junk = [re.sub(" ", "### ", g) for g in good[:12]]
    kept = [r.kept for r in quality.score(documents(spark, good + junk)).orderBy("doc_id").collect()]
    assert all(kept[:60]) and not any(kept[60:])


# personal data
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def good(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(x) <= 255 for x in match.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    found = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if good(k, m.group()))
    return ",".join(f"{k}:{a}:{e}" for a, _, k, e in found)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(9)
    parts = ["a@b.cd", "x.y%z@h-1.org.uk", "@", "a@b.c@d.e", "a@b.com+x@y.com", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+1", "12", "é🙂", " ", "word", ".", "-", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    got = {r.doc_id: r for r in pii.find(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = brute_spans(text)
        assert got[i].base_sha256 == sha256(want.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want.split(",")) for k in BASE]


def test_contexts_discover_what_no_pattern_knows(spark):
    rng = random.Random(3)
    luhn = ["4111111111111111", "5500005555555559", "340000000000009", "6011000990139424", "3530111333300000", "4012888888881881"]
    known = [f"{prose(rng, 5)} my card number {c} thanks" for c in luhn]
    unknown = [f"{prose(rng, 5)} my card number {c} thanks" for c in ("1234567890123456",)]
    other = [f"{prose(rng, 5)} chapter 17 and room {i} upstairs" for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.find(documents(spark, known + unknown + other)).collect()}
    assert all(got[i].startswith("card:") and "context" not in got[i] for i in range(6))
    start = unknown[0].index("1234567")
    assert got[6] == f"context:{start}:{start + 16}" and not any(got[i] for i in range(7, 37))


def luhn_card(rng):
    digits = [4, *(rng.randrange(10) for _ in range(14))]
    total = sum(d if i % 2 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def planted(rng, cue, kinds=("code", "name")):
    """Texts with identifiers behind cues, and their spans by kind; two thirds are cards that a base pattern knows."""
    texts, spans = [], []
    for i in range(60):
        kind = kinds[i % len(kinds)]
        value = luhn_card(rng) if i % 3 else "".join(rng.choice("BCDFGHKLM") for _ in range(7)) + (str(rng.randrange(1000)) if kind == "code" else "")
        before = f"{prose(rng, rng.randrange(3, 30))} {cue} "
        texts.append(f"{before}({value}), {prose(rng, 10)}")
        spans.append((kind, len(before) + 1, len(before) + 1 + len(value), i % 3 > 0))
    return texts, spans


def test_recall_and_precision_of_contexts_by_kind(spark):
    rng = random.Random(31)
    texts, spans = planted(rng, "holder passport")
    clean = [f"{prose(rng, 20)} the holder of room {i} and {prose(rng, 8)}" for i in range(60)]
    # a word that follows the cue but is common elsewhere is none
    texts.append(f"{prose(rng, 9)} holder passport office {prose(rng, 4)}")
    clean += [f"post office {i} {prose(rng, 5)}" for i in range(30)]
    got = {r.doc_id: r for r in pii.find(documents(spark, texts + clean)).collect()}
    found = Counter()
    for i, (kind, a, b, known) in enumerate(spans):
        found[kind, known, got[i].spans == (f"card:{a}:{b}" if known else f"context:{a}:{b}")] += 1
    assert {k for k in found if not k[2]} == set() and found["name", False, True] == found["code", False, True] == 10
    assert not any(got[i].n_spans for i in range(60, len(got)))


def test_words_discovered_make_patterns_of_their_own(spark):
    rng = random.Random(32)
    texts, spans = planted(rng, "holder passport", ("code",))
    new = [t[a:b] for t, (_, a, b, known) in zip(texts, spans, strict=True) if not known]
    # the discovered codes behind another cue, and codes that stand behind that one only
    second = [f"{prose(rng, 12)} travel document ({c}), {prose(rng, 3)}" for c in new]
    third = [f"{prose(rng, 12)} travel document (XX{i}YY), {prose(rng, 3)}" for i in range(6)]
    got = {r.doc_id: r.n_context for r in pii.find(documents(spark, texts + second + third)).collect()}
    assert len(new) == 20 and all(got[60 + i] == 1 for i in range(26))


def test_seeds_of_several_words_and_at_the_ends(spark):
    phones = [f"+1 (212) 555-01{i:02d}" for i in range(12)]
    texts = [f"{p} reach me" if i % 2 else f"so call us {p}" for i, p in enumerate(phones)] + ["so call us maybe-KX17", "so call us KX18"]
    got = {r.doc_id: r.spans for r in pii.find(documents(spark, texts)).collect()}
    assert got[0] == "phone:11:28" and got[1] == "phone:0:17" and got[12] == "context:11:21" and got[13] == "context:11:15"


def test_personal_data_on_awkward_rows(spark):
    df = table(spark)
    got = pii.find(df).collect()
    assert len(got) == df.count() and not any(r.spans for r in got) and pii.find(df.limit(0)).count() == 0


# chats
SCHEMAS = {"sum": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}, "additionalProperties": False}}


def call(i, name="sum", **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def chat(spark, *turns):
    rows = [(1, i, role, text if isinstance(text, str) or text is None else json.dumps(text)) for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return [(r.kind, r.call_id, r.status) for r in chat_format.format_chats(df, SCHEMAS).orderBy("seq").collect()]


def test_calls_are_linked_ordered_and_validated(spark):
    got = chat(
        spark, ("user", "hi"), ("assistant", {"content": "x", "tool_calls": [call("2", a={"$ref": "1"}, b=1), call("1", a=1, b=2), call("3", a="x", b=2), call("4", name="no"), call("5", a=1, b={"$ref": "9"}), "bad"]}),
        ("tool", {"tool_call_id": "1", "content": "3"}), ("tool", {"tool_call_id": "2", "content": "4"}), ("tool", {"tool_call_id": "2", "content": "5"}), ("tool", {"tool_call_id": "7", "content": ""}), ("tool", "text"), ("user", "bye"),
    )
    place = {k: i for i, k in reversed(list(enumerate(x[:2] for x in got)))}
    assert place["call", "1"] < place["result", "1"] < place["call", "2"] < place["result", "2"]
    status = dict(((k, c), s) for k, c, s in reversed(got))
    assert status["call", "1"] == status["call", "2"] == status["result", "1"] == status["result", "2"] == "ok"
    assert status["call", "3"] == "invalid_arguments" and status["call", "4"] == "unknown_tool" and status["call", "5"] == "unmet" and status["result", "7"] == "orphan"
    assert Counter(s for _, _, s in got)["duplicate"] == 1 and Counter(s for _, _, s in got)["malformed"] == 2


def test_cycles_and_unanswered_calls(spark):
    got = dict(((k, c), s) for k, c, s in chat(spark, ("assistant", {"tool_calls": [call("1", a={"$ref": "2"}, b=1), call("2", a={"$ref": "1"}, b=1), call("3", a=1, b=1)]}), ("tool", {"tool_call_id": "1", "content": 1})))
    assert got["call", "1"] == got["call", "2"] == "cycle" and got["call", "3"] == "unanswered"


def test_long_chains(spark):
    calls = [call(str(i), a={"$ref": str(i + 1)} if i < 9 else 1, b=1) for i in range(10)]
    got = chat(spark, ("assistant", {"tool_calls": calls}), *(("tool", {"tool_call_id": str(i), "content": i}) for i in range(10)))
    assert [c for k, c, _ in got if k == "call"] == [str(i) for i in range(9, -1, -1)] and {s for _, _, s in got} == {"ok"}


@pytest.mark.parametrize("grouped", [chat_format.MOST_GROUPED, 0])
def test_chains_and_cycles_in_rounds_and_in_one_pass(spark, monkeypatch, grouped):
    monkeypatch.setattr(chat_format, "MOST_GROUPED", grouped)
    test_long_chains(spark)
    test_cycles_and_unanswered_calls(spark)
    test_calls_are_linked_ordered_and_validated(spark)
    # behind a cycle is on none, but can't be placed either
    got = dict(((k, c), s) for k, c, s in chat(spark, ("assistant", {"tool_calls": [call("1", a={"$ref": "1"}, b=1), call("2", a={"$ref": "1"}, b={"$ref": "3"}), call("3", a=1, b=1)]}), ("tool", {"tool_call_id": "2", "content": 1})))
    assert got["call", "1"] == got["call", "2"] == "cycle" and got["call", "3"] == "unanswered"


def test_a_conversation_with_most_rows(spark):
    rows = [(None, None if i % 2 else i // 4, "user", f"text {i}") for i in range(3000)] + [(1, i, "user", "x") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_chats(df).collect()
    own = sorted((r.seq, r.message) for r in got if r.conv_id is None)
    key = lambda r: (r[1] is not None, r[1] or 0, json.dumps({"content": r[3], "role": "user"}, separators=(",", ":")))
    want = [json.dumps({"content": r[3], "role": "user"}, separators=(",", ":")) for r in sorted(rows[:3000], key=key)]
    assert [m for _, m in own] == want and [s for s, _ in own] == list(range(3000))
    assert sorted(r.seq for r in got if r.conv_id == 1) == list(range(40))


def test_chats_on_awkward_rows(spark):
    rows = [(None, None, None, None, 1), (1, 0, "user", None, 1), (1, 0, "user", None, 1), (1, 1, "robot", "x", 1), (2, 0, "assistant", "{not json", 1), (2, 1, "assistant", "z" * 200_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = chat_format.format_chats(df).collect()
    assert len(got) == 6 and Counter(r.status for r in got) == {"ok": 4, "malformed": 2}
    assert sorted(r.seq for r in got if r.conv_id == 1) == [0, 1, 2] and json.loads(next(r.message for r in got if r.conv_id == 2 and r.seq == 1))["content"] == "z" * 200_000
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_schemas():
    assert chat_format.valid({"a": 1}, {"type": "object", "properties": {"a": {"enum": [1]}}}) and not chat_format.valid(True, {"type": "integer"})
    assert chat_format.valid([1, 2], {"type": "array", "items": {"type": "number"}}) and not chat_format.valid([1, "x"], {"items": {"type": "number"}})
    assert chat_format.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    good = [(3, {"minimum": 3, "maximum": 3, "multipleOf": 1.5}), ("ab", {"pattern": "^a", "minLength": 2, "maxLength": 2}), (1.0, {"type": "integer", "const": 1}), ([1, True], {"uniqueItems": True}), ({"a": {"$ref": "x"}}, {"properties": {"a": {"type": "string"}}, "required": ["a"]}), (1, {"oneOf": [{"type": "integer"}, {"minimum": 2}]}), ({"b": 1}, {"additionalProperties": {"type": "number"}})]
    bad = [(2, {"exclusiveMinimum": 2}), ("b", {"pattern": "^a"}), ([1, 1.0], {"uniqueItems": True}), (True, {"const": 1}), (3, {"oneOf": [{"type": "integer"}, {"minimum": 2}]}), ({}, {"minProperties": 1}), (1, {"not": {"type": "integer"}}), ({"b": "x"}, {"additionalProperties": {"type": "number"}}), (1, False)]
    assert all(chat_format.valid(*x) for x in good) and not any(chat_format.valid(*x) for x in bad)
    for schema in ({"$ref": "#/x"}, {"type": "date"}, {"properties": {"a": {"if": True}}}, {"pattern": "("}, 7):
        with pytest.raises(chat_format.Unsupported):
            chat_format.valid("a" if isinstance(schema, dict) and "pattern" in schema else {"a": 1}, schema)


# mixing
def targets(sizes, weights, most=3):
    """Shares of all words by weight, none above ``most`` times its size, the excess shared out again until none is above."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in full or free:
            out[i] = float(most * sizes[i]) if full else unit * weights[i]
        left -= sum(out[i] for i in full)
        free = [i for i in free if i not in full] if full else []
    return out


@pytest.mark.parametrize("few", [mixing.BROADCAST_SOURCES, 0])
@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 100, 100], [1, 1, 1000], [0, 5], [1, 2, 3, 900, 4, 50, 1, 1]])
def test_targets(spark, monkeypatch, sizes, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    df = spark.createDataFrame([(i, "w " * n, f"s{i}") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = {r.id: r for r in mixing.taken(mixing.mix(df, block_words=4)).collect()}
    want = targets(sizes, [5, 2, 1] * 3)
    assert [got[i].target for i in range(len(sizes))] == pytest.approx(want) and all(abs(got[i].taken - want[i]) <= 1 for i in range(len(sizes)))


@pytest.mark.parametrize("block", [7, 1024])
def test_mix_takes_its_targets(spark, block):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(60)), "en", rng.choice(["a", "b", "b", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = mixing.mix(df, block_words=block)
    got = mixing.taken(plan).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s), key=str) + [None]
    want = dict(zip(names, targets([sizes[s] for s in names], [5, 2, 1, 5]), strict=True))
    by = Counter()
    for r in got:
        text, source = rows[r.id][1], rows[r.id][3]
        assert r.size == len(text.split()) and r.source_size == sizes[source] and r.target == pytest.approx(want[source]) and r.taken <= 3 * r.size
        by[source] += r.taken
    assert all(abs(by[s] - want[s]) <= 1 for s in names)
    again = mixing.taken(mixing.mix(df.repartition(7), block_words=block)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


@pytest.mark.parametrize("few", [mixing.BROADCAST_SOURCES, 0])
def test_schedule_is_even(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    need = {0: 500, 1: 300, 2: 0, 3: 199, 4: 1}
    sources = spark.createDataFrame(list(need.items()), "src long, need long")
    order = [(r.src, r.rank) for r in mixing.schedule(spark, sources, len(need), 1000, Scratch(spark)).orderBy("slot").collect()]
    assert Counter(s for s, _ in order) == {s: n for s, n in need.items() if n} and all(r == k for s in need for k, r in enumerate(r for x, r in order if x == s))
    shares = lambda k: [abs([s for s, _ in order[:k]].count(s) - n / 1000 * k) for s, n in need.items()]
    assert max(max(shares(k)) for k in range(10, 1000, 10)) <= 4


def test_points_are_exact(spark):
    mask = (1 << mixing.POINT_BITS) - 1
    assert [r.point for r in mixing.points(spark, 1000).orderBy("slot").collect()] == [(k + 1) * mixing.GOLDEN & mask for k in range(1000)]


def test_the_schedule_decides_the_mix(spark, monkeypatch):
    rng = random.Random(18)
    df = documents(spark, [prose(rng, rng.randrange(5, 60)) for _ in range(600)])
    plan = mixing.mix(df, block_words=32)
    order = [r.source for r in mixing.mixed_documents(df, plan).collect()]
    for k in range(100, len(order), 100):
        assert abs(order[:k].count("s0") / k - order.count("s0") / len(order)) < 0.1
    slots = sorted((r.id, r.first_slot) for r in mixing.taken(plan).collect())
    monkeypatch.setattr(mixing, "GOLDEN", 3 << 30 | 1)
    assert slots != sorted((r.id, r.first_slot) for r in mixing.taken(mixing.mix(df, block_words=32)).collect())


def test_buckets_of_large_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    df = documents(spark, [f"w {i}" for i in range(500)])
    got = mixing.taken(mixing.mix(df, block_words=3)).collect()
    assert sum(r.taken for r in got) == pytest.approx(1000, abs=3)


def test_mix_on_awkward_rows(spark):
    df = table(spark)
    got = mixing.taken(mixing.mix(df)).collect()
    assert len(got) == df.count() and all(r.taken <= 3 * r.size for r in got) and mixing.taken(mixing.mix(df.limit(0))).count() == 0
    assert mixing.mixed_documents(df, mixing.mix(df)).columns == df.columns


# tokens
@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("how", [{}, {"head_words": 20}, {"head_words": 0}, {"rare": "join"}, {"rare": "join", "head_words": 20}])
def test_ids_equal_the_library(spark, tokenizer, how):
    spec = bpe.read_tokenizer(tokenizer_path())
    df = table(spark).unionByName(table(spark, [(10, "<|endoftext|> a  <|endoftext|>b\n\n\n  it's 12 it's", "en", "a"), (11, "\x00\x1c\x85 x　y", "en", "a")]))
    rows = df.select("doc_id", "text").collect()
    ids = {r.text: tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in rows}
    want = sorted((str(r.doc_id), len(ids[r.text]), ids[r.text], tokenizer.decode(ids[r.text], skip_special_tokens=False)) for r in rows)
    got = bpe.encode(df, spec, **how)
    assert sorted((str(r.doc_id), r.n_tokens, list(r.ids), r.decoded) for r in got.collect()) == want
    assert bpe.encode(df.limit(0), spec, **how).count() == 0


def test_words_are_split_where_the_library_may_be(tokenizer):
    rng = random.Random(2)
    split = bpe.Splitter(["<|endoftext|>"])
    for _ in range(3000):
        text = "".join(rng.choice([" ", "  ", "\n", "\t", "a", "B", "é", "1", "23", "'s", ".", "!!", "\xa0", "\x1c", "\x85", "<|endoftext|>", "日本", "🙂", "\r\n"]) for _ in range(rng.randrange(14)))
        words = split(text)
        assert "".join(words) == text
        assert [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids


def test_decoding_by_the_table_of_pieces(spark, tokenizer):
    spec = bpe.read_tokenizer(tokenizer_path())
    texts = ["Hello, Wörld 🙂", "", "<|endoftext|>"]
    rows = spark.createDataFrame([(tokenizer.encode(t).ids,) for t in texts] + [(None,)], "ids array<int>")
    rows = rows.unionByName(spark.createDataFrame([([tokenizer.token_to_id("Ã")],)], "ids array<int>"))
    for how in ("lookup", "join"):
        assert sorted(r.decoded for r in bpe.decode(rows, spec, how=how).collect()) == sorted([*texts, "", "\ufffd"])


def test_rare_words_beyond_the_head_do_not_matter(spark):
    docs = documents(spark, [prose(random.Random(i), 40) for i in range(20)])
    counts = bpe.word_counts(docs, bpe.read_tokenizer(tokenizer_path()))
    want = Counter(w for r in docs.collect() for w in bpe.Splitter([])(r.text))
    assert {r.word: r.n for r in counts.collect()} == want
    assert counts.agg(F.sum("n")).first()[0] == sum(want.values())
