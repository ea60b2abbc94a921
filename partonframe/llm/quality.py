"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at counts of a text and votes good, votes bad or abstains. Nobody labels documents; how
often a rule votes good on good documents and bad on bad ones, two rates for each rule, is estimated from how
the rules agree, by expectation-maximisation over the distinct vote patterns (3 ** rules at most, whatever the
input) of the documents that pass the base rules. A document is kept when it passes them and its posterior
probability of being good is at least one half; so a single vote of a rule that is hardly ever wrong on good
documents outweighs all others, and many votes of rules that often are don't.

DataFrame operations only. The rules and the update step are SQL text that Spark and other engines share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import once
from .scratch import Scratch

BLANKS = " \t\n\x0b\x0c\r"
#: name, condition of a vote for good, condition of a vote for bad, over the columns of :func:`counts`.
RULES = [
    ("marks", "50 * n_marks >= n_words and 4 * n_marks <= n_words", "10 * n_marks > 8 * n_words or 200 * n_marks < n_words"),
    ("word_length", "word_chars >= 3 * n_words and word_chars <= 8 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("plain_share", "100 * (n_symbols + n_marks + n_digits) <= 8 * word_chars", "5 * (n_symbols + n_marks + n_digits) > word_chars"),
    ("repeated_lines", "10 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    ("repeated_words", "20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    ("vocabulary", "n_distinct * n_distinct >= 16 * n_words", "n_distinct * n_distinct < 4 * n_words"),
    ("capitals", "10 * n_capitals <= word_chars", "10 * n_capitals > 4 * word_chars"),
    ("digits", "20 * n_digits <= word_chars", "5 * n_digits > word_chars"),
]
ROUNDS = 15
#: Before the first round: probability of a good document, of a vote for good on one, and of a vote for bad on a
#: bad one, which is low since junk of one kind looks sound to the rules for the others.
PRIOR, GOOD_RATE, BAD_RATE = 0.7, 0.95, 0.3
#: Documents' worth of those beliefs that every estimate keeps, so that none is 0 or 1.
SMOOTH = 2.0
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def counts(text: Column) -> Column:
    """Struct of the counts of a text: n_words, n_distinct, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_marks, n_digits."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def repeated(w: Column) -> Column:
        """Words in windows of three that occur twice or more: windows are sorted by hash to find equal ones, then by place to count their words."""
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        same = lambda s, i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        twice = once(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: same(s, i + 1, x) | same(s, i - 1, x)))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return once(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    number = lambda c: c.cast("long")
    return F.struct(
        once(words, lambda w: F.struct(
            number(F.size(w)).alias("n_words"), number(F.size(F.array_distinct(w))).alias("n_distinct"), number(F.length(F.array_join(w, ""))).alias("word_chars"),
            number(F.when(F.size(w) < 4, 0).otherwise(repeated(w))).alias("n_repeat_words"))).alias("w"),
        once(lines, lambda x: F.struct(number(F.size(x)).alias("n_lines"), number(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        number(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"), number(F.regexp_count(text, F.lit("[A-Z]"))).alias("n_capitals"),
        number(F.regexp_count(text, F.lit(r"[.,;:!?]"))).alias("n_marks"), number(F.regexp_count(text, F.lit("[0-9]"))).alias("n_digits"),
    )


def votes_sql() -> list[str]:
    """A vote of 1, 0 or -1 for every rule; texts without words get bad votes where a rule has one."""
    return [f"case when {bad} then -1 when {good} then 1 else 0 end as v{j}" for j, (_, good, bad) in enumerate(RULES)]


def posterior_sql(prior: str, rates: list[tuple[str, str]]) -> str:
    """Probability that a document is good given its votes v0, v1, ...; rates[j]: how often a vote of rule j is good on good documents, and bad on bad ones."""
    odds = [f"ln({prior} / (1e0 - {prior}))"]
    odds += [f"case v{j} when 1 then ln({a} / (1e0 - {b})) when -1 then ln((1e0 - {a}) / {b}) else 0e0 end" for j, (a, b) in enumerate(rates)]
    return f"(1e0 / (1e0 + exp(-({' + '.join(odds)}))))"


def update_sql(posterior: str, rules: int = len(RULES)) -> list[str]:
    """Estimates of one round over vote patterns with n documents each: prior, then a0, b0, a1, b1, ..."""
    out = [f"(sum(n * {posterior}) + {SMOOTH * PRIOR}e0) / (sum(n) + {SMOOTH}e0) as prior"]
    for j in range(rules):
        for name, vote, share, belief in (("a", 1, posterior, GOOD_RATE), ("b", -1, f"(1e0 - {posterior})", BAD_RATE)):
            hits = f"sum(case when v{j} = {vote} then n * {share} else 0e0 end)"
            out.append(f"({hits} + {SMOOTH * belief}e0) / (sum(case when v{j} <> 0 then n * {share} else 0e0 end) + {SMOOTH}e0) as {name}{j}")
    return out


def _literal(x: float) -> str:
    return f"{x!r}D"


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Prior and both rates of every rule after ``rounds`` rounds over the vote patterns (v0, v1, ..., n), a table of bounded size."""
    rules = sum(c[0] == "v" for c in patterns.columns)
    prior, rates = PRIOR, [(GOOD_RATE, BAD_RATE)] * rules
    for _ in range(rounds):
        posterior = posterior_sql(_literal(prior), [(_literal(a), _literal(b)) for a, b in rates])
        row = patterns.selectExpr(f"{posterior} as p", "*").selectExpr(*update_sql("p", rules)).first()
        if row is None or row["prior"] is None:
            break
        prior, rates = row["prior"], [(row[f"a{j}"], row[f"b{j}"]) for j in range(rules)]
    return prior, rates


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``id_col``, the counts, base_failed, good_probability and kept of every row.

    Defined cases: null counts as empty, an empty text has no words and fails the base rules; repeated rows
    each get their row and count in the estimates; a null id stays; an empty table gives an empty result;
    extra columns are ignored; texts may be of any length.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("id"), counts(F.col(text_col)).alias("c"))
    flat = found.select("id", "c.w.*", "c.l.*", "c.n_symbols", "c.n_capitals", "c.n_marks", "c.n_digits")
    facts = scratch.table(flat.selectExpr("*", *votes_sql()))
    names = [f"v{j}" for j in range(len(RULES))]
    patterns = scratch.table(facts.where(f"not ({BASE_FAILED})").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1).sortWithinPartitions(*names))
    prior, rates = estimate(patterns)
    posterior = posterior_sql(_literal(prior), [(_literal(a), _literal(b)) for a, b in rates])
    out = facts.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("good_probability", F.expr(posterior))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("good_probability") >= 0.5)).alias("kept"), "good_probability",
    )


def oracle_sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the query's columns: the same rules and rounds over counts made with DuckDB's functions."""
    blanks = r"[\x20\x09-\x0D]"
    strip = f"regexp_replace(regexp_replace(t, '^{blanks}+', ''), '{blanks}+$', '')"
    params = [(f"a{j}", f"b{j}") for j in range(len(RULES))]
    step = update_sql("p")
    begin = ", ".join([f"{PRIOR}e0 as prior", *(f"{rate}e0 as {x}" for p in params for x, rate in zip(p, (GOOD_RATE, BAD_RATE), strict=True))])
    posterior = posterior_sql("prior", params)
    ctes = [
        "d as (select doc_id, coalesce(text, '') t from documents)",
        f"w as (select doc_id, t, case when {strip} = '' then []::varchar[] else regexp_split_to_array({strip}, '{blanks}+') end ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d)",
        "g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] s from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w where len(ws) > 2))",
        "r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) c from g) where c > 1)",
        "q as (select doc_id, count(distinct i + k) n from r, (values (0), (1), (2)) x(k) group by doc_id)",
        "c as (select w.doc_id, len(ws) n_words, len(list_distinct(ws)) n_distinct, length(array_to_string(ws, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(ls) n_lines, "
        "len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(q.n, 0) n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) n_capitals, len(regexp_extract_all(t, '[.,;:!?]')) n_marks, "
        "len(regexp_extract_all(t, '[0-9]')) n_digits from w left join q on w.doc_id = q.doc_id)",
        f"v as (select *, {', '.join(votes_sql())} from c)",
        f"p as (select {', '.join(f'v{j}' for j in range(len(RULES)))}, count(*)::double n from v where not ({BASE_FAILED}) group by all)",
        f"e0 as (select {begin})",
    ]
    for k in range(rounds):
        ctes.append(f"e{k + 1} as materialized (select {', '.join(step)} from (select p.*, {posterior} p from p, e{k}))")
    names = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    return f"with {', '.join(ctes)} select {names}, {BASE_FAILED} as base_failed, not ({BASE_FAILED}) and {posterior} >= 0.5 as kept from v, e{rounds}"
