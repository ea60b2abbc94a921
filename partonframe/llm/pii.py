"""Personal data by patterns and by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. These are seeds; values behind a label
that names a secret (LABELS), which base patterns don't know, are labelled seeds. The words around a seed make lexical
patterns: the two words to its left, and the words on either side. Every word of the corpus that occurs in a
pattern is an instance of it. Spark scores the bipartite graph of patterns and instances: a pattern is as good
as the share of its distinct instances that are believed, an instance is believed as its best pattern is
good, for a few rounds. Patterns of high score and support discover their instances, but for words that occur
mostly elsewhere. The words discovered are seeds of another round, whose contexts make patterns of their own.

Labelled seeds are reported only where a pattern discovers them, and n_discovered counts what no seed's pattern
matches, so that the method's own share can be told. DataFrame operations only. Places of matches come
from the lengths of the pieces between them, since SQL's extraction functions give matches without places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import salted_join

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns. They start only where a run of their first characters does, or where the last match
#: ended, and repeat possessively: the same matches, without trying every place of a long run again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Names of secrets and documents of a person; a value with a digit behind one, a colon or equals sign and perhaps a quote is a labelled seed.
LABELS = ["access_key", "account", "api_key", "apikey", "iban", "passport", "passwd", "password", "secret", "ssn", "token"]
_NAMES = "|".join(LABELS)
LABELLED = rf"""(?i)(?<=(?:{_NAMES})["']{{0,1}}[\x20\t]{{0,3}}[:=][\x20\t]{{0,3}}["']{{0,1}})[^\x20\x09-\x0D"',;]{{8,}}+"""
BLANK = r"[\x20\x09-\x0D]"
#: A word with the blanks before it.
PIECE = rf"{BLANK}*+[^\x20\x09-\x0D]++"
#: Rounds of bootstrapping, and of belief in each.
BOOTSTRAPS, ROUNDS = 2, 3
#: A pattern discovers at this score, with so many distinct instances, so many of them seeds.
MIN_SCORE, MIN_INSTANCES, MIN_SEEDS = 0.8, 5, 3
#: Distinct instances' worth of doubt in every pattern.
DOUBT = 1.0
#: Share of a pattern's distinct instances, as a sketch estimates them, that seeds must be for it to be scored.
MIN_SHARE = 0.25
#: Share of a word's occurrences that must be in discovering patterns for it to be discovered.
MIN_SPECIFIC = 0.5
#: Patterns or words up to which they are broadcast to the scan of all words; with more they are joined by a shuffle.
BROADCAST_KEYS = 1 << 18


def _found(text: Column, pattern: str) -> Column:
    """Array of (gap: characters before the match since the last one, match)."""
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(gaps, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    return F.filter(pairs, lambda x: x["match"].isNotNull())


def _luhn(digits: Column) -> Column:
    last = F.length(digits)
    value = lambda i: F.substring(digits, last - i, F.lit(1)).cast("int")
    double = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(0), last - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, double(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    byte = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    card = F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "ip", match.rlike(rf"^{byte}(?:\.{byte}){{3}}$")).when(kind == "card", card).when(kind == "phone", F.length(digits).between(9, 15)).when(kind == "labelled", match.rlike("[0-9]")).otherwise(True)


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with start and end of every match, in characters; the gaps and matches of a row come in order of place."""
    before = Window.partitionBy(*by).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(before)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))


def _mark(text: Column) -> Column:
    """Hash of a text; with its id it names a row. Rows that share both have the same personal data."""
    return F.xxhash64(text)


def searched(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(facts, spans): id, mark and, where a seed may be, text of every row; and row, kind, start and end of every valid match."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digit = text.rlike("[0-9]")

    def kind(name: str, pattern: str) -> Column:
        there = F.contains(text, F.lit(NEEDS[name])) if name in NEEDS else digit
        return F.when(there & digit if name != "email" else there, _found(text, pattern)).alias(name)

    named = digit & text.rlike(f"(?i)(?:{_NAMES})[^A-Za-z]*[:=]")
    kinds = [kind(k, p) for k, p in PATTERNS.items()] + [F.when(named, _found(text, LABELLED)).alias("labelled")]
    found = docs.select(F.col(id_col).alias("id"), _mark(text).alias("mark"), F.monotonically_increasing_id().alias("row"), text.alias("text"), *kinds)
    some = F.greatest(*[F.coalesce(F.size(k), F.lit(0)) for k in (*KINDS, "labelled")]) > 0
    facts = scratch.table(found.withColumn("text", F.when(some, F.col("text"))))
    matches = None
    for name in (*KINDS, "labelled"):
        one = facts.select("row", F.lit(name).alias("kind"), F.posexplode(name).alias("place", "x")).select("row", "kind", "place", "x.gap", "x.match")
        matches = one if matches is None else matches.unionByName(one)
    spans = _placed(matches, ["row", "kind"]).where(_valid(F.col("kind"), F.col("match"))).select("row", "kind", "start", "end", "match")
    return facts.drop(*KINDS, "labelled"), scratch.table(spans)


def _patterns(two_left: Column, left: Column, right: Column) -> list[Column]:
    """Hashes of the patterns around a word: the two words to its left, and those on either side; null without them."""
    return [
        F.when(two_left.isNotNull(), F.xxhash64(F.lit("left"), two_left, left)),
        F.when(left.isNotNull() & right.isNotNull(), F.xxhash64(F.lit("sides"), left, right)),
    ]


def _seeds(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, value) of every seed: its patterns, and its word, or its text where it has several. Words and spans of a row are merged in order of place."""
    text = facts.where(F.col("text").isNotNull())
    pieces = text.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("place", "match")).withColumn("gap", F.lit(0))
    words = _placed(pieces, ["row"]).select("row", "place", F.lower(F.regexp_replace("match", rf"^{BLANK}+", "")).alias("word"), F.col("end").alias("at"))
    in_row = Window.partitionBy("row").orderBy("place")
    near = {"w1": F.lag("word", 1), "w2": F.lag("word", 2), "w3": F.lead("word", 1)}
    words = words.select("row", "at", F.struct("place", "word", *[c.over(in_row).alias(n) for n, c in near.items()]).alias("x"))
    # a span begins in the first word that ends after its start, and ends in the first that ends at or after its end
    starts = spans.select("row", (F.col("start") + 0.5).alias("at"), F.lit(0).alias("step"), "start", "match")
    marks = starts.unionByName(spans.select("row", (F.col("end") - 0.5).alias("at"), F.lit(1).alias("step"), "start", "match"))
    words = words.select("row", F.col("at").cast("double").alias("at"), F.lit(2).alias("step"), "x")
    # from the end on, so that the frame only grows
    after = Window.partitionBy("row").orderBy(F.col("at").desc(), F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    met = marks.unionByName(words, allowMissingColumns=True).withColumn("next", F.last("x", ignorenulls=True).over(after)).where("step < 2")
    pairs = met.groupBy("row", "start", "match").agg(F.max(F.when(F.col("step") == 0, F.col("next"))).alias("a"), F.max(F.when(F.col("step") == 1, F.col("next"))).alias("b"))
    value = F.when(F.col("a.place") == F.col("b.place"), F.col("a.word")).otherwise(F.lower("match"))
    keyed = pairs.select(F.explode(F.array(*_patterns(F.col("a.w2"), F.col("a.w1"), F.col("b.w3")))).alias("key"), F.xxhash64(value).alias("value"))
    return keyed.where(F.col("key").isNotNull())


class _Corpus:
    """Every word of the corpus, in lower case, with its patterns; each use is a scan, whose other side is broadcast if it is small.

    A text's words are zipped with their neighbours, so that a scan stays in generated code.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
        self.docs = docs.select(F.col(id_col).alias("id"), _mark(text).alias("mark"), F.split(F.when(bare != "", bare), rf"{BLANK}+", -1).alias("w"))

    def values(self) -> DataFrame:
        """(value) of every word."""
        return self.docs.select(F.explode("w").alias("word")).select(F.xxhash64("word").alias("value"))

    def keyed(self) -> DataFrame:
        """(id, mark, i, value, key) of every word i and pattern."""
        none = F.array(F.lit(None).cast("string"))
        near = F.arrays_zip(F.concat(none, none, "w").alias("w2"), F.concat(none, F.col("w")).alias("w1"), F.col("w").alias("word"), F.slice("w", 2, 1 << 30).alias("w3"))
        words = self.docs.select("id", "mark", F.posexplode(near).alias("i", "x")).where("x.word is not null")
        keys = F.array(*_patterns(F.col("x.w2"), F.col("x.w1"), F.col("x.w3")))
        return words.select("id", "mark", "i", F.xxhash64("x.word").alias("value"), F.explode(keys).alias("key")).where("key is not null")


def _scan(rows: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Those of the corpus's rows whose ``by`` is wanted; ``wanted`` is a scratch table with each once."""
    small = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(wanted) if small else wanted, by)


def discover(seeds: DataFrame, near: _Corpus, corpus: _Corpus, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """(hits, found): occurrences (id, mark, i, value, is_seed) that patterns of the ``seeds`` (key, value)
    discover, and (value) of the discovered words that aren't seeds; None if no pattern discovers.

    ``near`` is the part of the corpus with base matches. A pattern that has too many words there has too many in
    the whole, so common contexts are left out before the corpus is scanned.
    """
    edges = scratch.table(seeds.distinct())
    patterns = scratch.table(edges.groupBy("key").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= MIN_SEEDS))
    if patterns.isEmpty():
        return None
    # how many distinct words a pattern has, before any of them is listed
    for part in (near, corpus):
        spread = _scan(part.keyed(), patterns, "key").groupBy("key", "seeds").agg(F.approx_count_distinct("value").alias("spread"))
        patterns = scratch.table(spread.where(F.col("seeds") >= MIN_SHARE * F.col("spread")).select("key", "seeds"))
        if patterns.isEmpty():
            return None
    fair = patterns.select("key")
    known = edges.select("value").distinct().withColumn("is_seed", F.lit(True))
    hits = _scan(corpus.keyed(), fair, "key")
    hits = scratch.table(hits)
    # seeds of several words have no single word as an instance, so their edges are added
    graph = hits.select("key", "value").union(edges.join(fair, "key", "left_semi").select("key", "value")).distinct()
    graph = scratch.table(graph.join(known, "value", "left").select("key", "value", F.coalesce("is_seed", F.lit(False)).alias("is_seed")))
    total, belief, score = graph.count(), graph.withColumn("belief", F.col("is_seed").cast("double")), None

    def meet(many: DataFrame, one: DataFrame, key: str, n: str, spread: str) -> DataFrame:
        # neither side has more rows than the graph
        return many.join(F.broadcast(one), key) if total <= BROADCAST_KEYS else salted_join(many, one, [key], n, total, F.col(spread))

    for turn in range(ROUNDS):
        score = belief.groupBy("key").agg((F.sum("belief") / (F.count(F.lit(1)) + DOUBT)).alias("score"), F.count(F.lit(1)).alias("n"))
        if turn + 1 < ROUNDS:
            scored = meet(graph, score, "key", "n", "value").drop("n")
            best = scored.groupBy("value").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("k"))
            belief = meet(scored, best, "value", "k", "key")
            belief = scratch.table(belief.select("key", "value", "is_seed", F.when(F.col("is_seed"), 1.0).otherwise(F.col("best")).alias("belief")))
    good = scratch.table(score.where((F.col("score") >= MIN_SCORE) & (F.col("n") >= MIN_INSTANCES)).select("key"))
    if good.isEmpty():
        return None
    inside = hits.join(F.broadcast(good) if good.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else good, "key", "left_semi").select("id", "mark", "i", "value").distinct()
    inside = scratch.table(inside.join(known, "value", "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False))))
    # of the words that aren't seeds, those that occur mostly there
    asked = scratch.table(inside.where("not is_seed").groupBy("value").agg(F.count(F.lit(1)).alias("there")))
    if asked.isEmpty():
        return inside, asked.select("value")
    every = _scan(corpus.values(), asked, "value").groupBy("value", "there").agg(F.count(F.lit(1)).alias("n"))
    found = scratch.table(every.where(F.col("there") >= MIN_SPECIFIC * F.col("n")).select("value"))
    return inside.where("is_seed").unionByName(inside.join(found, "value", "left_semi").select(*inside.columns)), found


def _context_spans(docs: DataFrame, id_col: str, text_col: str, hits: DataFrame) -> DataFrame:
    """(id, mark, start, end) of the words that were hit, without the characters at their ends that are neither letters nor digits."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    listed = hits.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("i").alias("_hits"))
    named = docs.select(F.col(id_col).alias("id"), _mark(text).alias("mark"), text.alias("text"))
    met = named.join(listed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).dropDuplicates(["id", "mark"])
    pieces = met.select("id", "mark", "_hits", F.regexp_extract_all("text", F.lit(PIECE), F.lit(0)).alias("p"))
    # the characters before a word: only sums up to hits are kept
    pieces = pieces.select("id", "mark", "_hits", F.posexplode("p").alias("place", "match")).withColumn("gap", F.lit(0))
    hit = _placed(pieces.withColumn("hit", F.array_contains("_hits", F.col("place"))).drop("_hits"), ["id", "mark"]).where("hit")
    edge = r"[^\p{L}\p{N}]"
    head, tail = F.length(F.regexp_extract("match", f"^{edge}*", 0)), F.length(F.regexp_extract("match", f"{edge}*$", 0))
    whole = head == F.length("match")
    blanks = F.length(F.regexp_extract("match", f"^{BLANK}*", 0))
    return hit.select("id", "mark", (F.col("start") + F.when(whole, blanks).otherwise(head)).alias("start"), (F.col("end") - F.when(whole, 0).otherwise(tail)).alias("end"))


def _clear(first: Column, other: Column) -> Column:
    """Whether a span (row, start, end) overlaps none of the ``other`` spans; ``first`` is larger for spans that are asked about."""
    far = (Window.unboundedPreceding, -1)
    before = F.max(F.when(other, F.col("end"))).over(Window.partitionBy("row").orderBy("start", first, "end").rowsBetween(*far))
    after = F.min(F.when(other, F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc(), first.desc(), F.col("end").desc()).rowsBetween(*far))
    return (F.coalesce(before, F.col("start")) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))


def _apart(spans: DataFrame) -> DataFrame:
    """Base and context spans (row, kind, start, end, seeded) without context spans that overlap base spans; ``seeded`` says that a labelled seed overlaps it."""
    kind = F.col("kind")
    first = F.when(kind == "context", 1).otherwise(0)
    base, labelled = ~kind.isin("context", "labelled"), kind == "labelled"
    judged = spans.withColumns({"fits": base | _clear(first, base), "seeded": ~_clear(first, labelled)})
    return judged.where(F.col("fits") & ~labelled).drop("fits")


def _listed(facts: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    """A row for each of ``facts`` with its numbers and lists of spans."""
    spans = spans.withColumn("order", F.array_position(F.array(*map(F.lit, [*KINDS, "context"])), F.col("kind")))
    found = F.count_if((F.col("kind") == "context") & ~F.col("seeded")).alias("n_discovered") if "seeded" in spans.columns else F.lit(0).alias("n_discovered")
    listed = spans.groupBy("row").agg(found, F.sort_array(F.collect_list(F.struct("start", "order", "kind", "end"))).alias("all"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (*KINDS, "context")])
    text_of = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    joined = facts.select("id", "row").join(listed, "row", "left")
    return joined.select(
        F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(text_of(F.filter("all", lambda x: x["kind"] != "context")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(text_of(F.col("all")), F.lit("")).alias("spans"), F.coalesce("n_context", F.lit(0)).cast("long").alias("n_context"),
        F.coalesce("n_discovered", F.lit(0)).cast("long").alias("n_discovered"), F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_spans"),
    )


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """What the base patterns alone find: ``id_col``, n_email, n_ip, n_card, n_phone and base_sha256 as in :func:`find`."""
    facts, spans = searched(docs, id_col, text_col, scratch or Scratch(docs.sparkSession))
    return _listed(facts, spans.where("kind != 'labelled'").select("row", "kind", "start", "end"), id_col).drop("spans", "n_context", "n_discovered", "n_spans")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Every row's personal data: ``id_col``, n_email, n_ip, n_card, n_phone (of the base patterns), base_sha256,
    spans, a comma-joined list of kind:start:end by start and kind, discovered ones of kind context, n_context,
    n_discovered (those that no labelled seed overlaps) and n_spans (of all kinds).

    Places are code points, the end exclusive. Base matches are leftmost and don't overlap within a kind;
    matches that fail their check are dropped without another try. Discovered words don't overlap base spans.
    Defined cases: null counts as empty and has no spans; repeated rows each get their row; a null id stays;
    an empty table gives an empty result; extra columns are ignored; texts are searched to their end.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    facts, spans = searched(docs, id_col, text_col, scratch)
    base = spans.where("kind != 'labelled'").select("row", "kind", "start", "end")
    near, corpus = _Corpus(facts.where(F.col("text").isNotNull()), "id", "text"), _Corpus(docs, id_col, text_col)
    hits, seeds = None, scratch.table(_seeds(facts, spans))
    for turn in range(BOOTSTRAPS):
        made = discover(seeds, near, corpus, scratch)
        if made is None:
            break
        hits = made[0] if hits is None else hits.unionByName(made[0]).distinct()
        if turn + 1 < BOOTSTRAPS:
            if made[1].isEmpty():
                break
            fresh = _scan(corpus.keyed(), scratch.table(made[1]), "value").select("key", "value")
            seeds = scratch.table(seeds.unionByName(fresh).distinct())
    if hits is None:
        return _listed(facts, base, id_col)
    places = _context_spans(docs, id_col, text_col, scratch.table(hits.select("id", "mark", "i").distinct()))
    named = facts.select("row", F.col("id").alias("_id"), F.col("mark").alias("_mark"))
    more = places.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("row", F.lit("context").alias("kind"), "start", "end")
    labelled = spans.where("kind = 'labelled'").select("row", "kind", "start", "end")
    return _listed(facts, scratch.table(_apart(base.unionByName(more).unionByName(labelled))), id_col)


def _duck(kind: str, pattern: str, valid: str) -> str:
    """DuckDB: struct list of (kind, start, end) of a pattern's valid matches; the next match is the first place of its text after the last one."""
    step = "lambda a, m: {'at': a.at + strpos(substr(t, a.at + 1), m.m) - 1 + length(m.m), 'm': m.m, 'l': list_append(a.l, {'s': (a.at + strpos(substr(t, a.at + 1), m.m) - 1)::bigint, 'm': m.m})}"
    begin = "{'at': 0::bigint, 'm': '', 'l': []::struct(s bigint, m varchar)[]}"
    each = f"list_transform(regexp_extract_all(t, '{pattern}'), lambda m: {{'at': 0::bigint, 'm': m, 'l': []::struct(s bigint, m varchar)[]}})"
    return f"list_filter((list_reduce(list_prepend({begin}, {each}), {step})).l, lambda x: {valid.format(m='x.m', d='''regexp_replace(x.m, '[^0-9]', '', 'g')''')}) as {kind}"


_LUHN = "list_sum(list_transform(range(length({d})), lambda i: case when i % 2 = 0 then substr({d}, length({d}) - i, 1)::int else 2 * substr({d}, length({d}) - i, 1)::int - case when substr({d}, length({d}) - i, 1)::int > 4 then 9 else 0 end end)) % 10 = 0"
#: The base spans in DuckDB SQL.
BASE_ORACLE = f"""
    with d as (select doc_id, coalesce(text, '') t from documents),
        m as (select doc_id, {_duck("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "true")},
            {_duck("ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "len(list_filter(string_split({m}, '.'), lambda p: p::hugeint > 255)) = 0")},
            {_duck("card", "[0-9](?:[ -]?[0-9])+", "length({d}) between 12 and 19 and " + _LUHN)},
            {_duck("phone", "[+][0-9][ ().0-9-]+[0-9]", "length({d}) between 9 and 15")} from d),
        s as (select doc_id, unnest(list_concat({', '.join(f"list_transform({k}, lambda x: {{'s': x.s, 'o': {i}, 'k': '{k}', 'e': x.s + length(x.m)}})" for i, k in enumerate(KINDS))}), recursive := true) from m),
        j as (select doc_id, string_agg(k || ':' || s || ':' || e, ',' order by s, o) spans from s group by doc_id)
    select m.doc_id, {', '.join(f'len({k}) as n_{k}' for k in KINDS)}, sha256(coalesce(spans, '')) base_sha256 from m left join j on m.doc_id = j.doc_id"""
