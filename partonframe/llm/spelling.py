"""Spelling variants: words that differ by one edit, found through bands of their letter-parity masks.

A word's mask has a bit for every letter, set where the letter occurs an odd number of times. One inserted or
deleted letter flips one bit, one replaced letter two or none. The mask is cut into three bands, so a replacement
leaves a band as it is, and an insertion one of any two bands. An edit also leaves two thirds of a word as they are,
so every band is joined together with two thirds and the length, as one key: of a million words, a key has eight, a
band alone thousands. A pair counts under the first key that it shares only, and is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches

#: Code points of a word and its occurrences, at least; how many times as frequent a form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One run in so many loses a code point.
MISSPELT = 31
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
OTHER = re.compile("[^a-zÀ-ÿ]")
BANDS = 3
#: Characters of a text that are searched at a time, and words that a task counts before it sends them on.
PIECE, HELD_WORDS = 1 << 20, 1 << 17


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end between runs."""
    at = 0
    while at < len(text):
        cut = OTHER.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), each word once for some tens of thousands."""
    counts: defaultdict[str, int] = defaultdict(int)
    sent = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1)), strict=True):
            start = zlib.crc32(f"{name}:".encode())
            for piece in _pieces(text.as_py()):
                for run, n in Counter(RUN.findall(piece)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % MISSPELT == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    counts[run] += n
            if len(counts) >= HELD_WORDS:
                yield sent()
                counts.clear()
    if counts:
        yield sent()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LENGTH code points and LEAST_COUNT occurrences at least."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def with_bands(words: DataFrame) -> DataFrame:
    return words.withColumn("b", F.array(*parity_bands(F.col("word"))))


def parity_bands(word: Column) -> list[Column]:
    """The mask of a word's letters in bands of 30 bits."""
    code = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c))
    place = F.transform(code, lambda c: F.when(c < 128, c - 97).otherwise(c - 192 + 26))
    flip = lambda k: lambda m, i: F.when(i % BANDS == k, m.bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.floor(i / BANDS).cast("int")))).otherwise(m)
    return [F.aggregate(place, F.lit(0), flip(k)) for k in range(BANDS)]


#: Letters of a part up to which Spark's edit distance looks at it, whose time grows with the square of the length.
SHORT = 64
PARTS = 3


def _kept(word: Column, longer: Column, part: int) -> list[Column]:
    """What an edit in this third leaves of a word, by the length of the longer of the two words."""
    one, two = F.floor(longer / 3).cast("int"), F.floor(2 * longer / 3).cast("int")
    return [[F.right(word, longer - one)], [F.left(word, one), F.right(word, longer - two)], [F.left(word, two)]][part]


def _keys(words: DataFrame) -> DataFrame:
    """(key, role, part, band, word, n, m, m2): a word's keys. Role 0 is for words of equal length, 1 for the longer and 2 for the shorter of two."""
    size = F.length("word")
    kinds = [(role, part, band) for role in range(3) for part in range(PARTS) for band in range(BANDS if role == 0 else BANDS - 1)]

    def key(role: int, part: int, band: int) -> Column:
        longer = size + (1 if role == 2 else 0)
        hashed = F.xxhash64(F.lit(role > 0), F.lit(part), F.lit(band), longer, *_kept(F.col("word"), longer, part), F.get("b", F.lit(band)))
        return F.struct(hashed.alias("key"), F.lit(role).cast("byte").alias("role"), F.lit(part).cast("byte").alias("part"), F.lit(band).cast("byte").alias("band"))

    # two bands in one number, as rows of this table are the most that is sent
    two = F.shiftleft(F.get("b", F.lit(0)).cast("long"), 32) + F.get("b", F.lit(1))
    each = words.select("word", "n", two.alias("m"), F.get("b", F.lit(2)).alias("m2"), F.explode(F.array(*[key(*k) for k in kinds])).alias("k"))
    return each.select("k.*", "word", "n", "m", "m2")


def _one_edit(one: Column, two: Column) -> Column:
    """Whether one edit parts the words; the first is as long as the other or longer by one."""
    letters = lambda w: F.split(w, "")
    alike = F.zip_with(letters(one), letters(two), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(alike, False).cast("int")
    rest = lambda w, start: F.substring(w, start, F.length(w))
    long = (at > 0) & (rest(one, at + 1) == rest(two, at + F.when(F.length(one) == F.length(two), 1).otherwise(0)))
    return F.when(F.length(one) <= SHORT, F.levenshtein(one, two, 1) == 1).otherwise(long)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words (word, n, b: parity bands) that one edit parts, once; the longer first."""
    keys = _keys(words)
    one, two = keys.alias("a"), keys.alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    flipped = [F.shiftright(a("m"), 32) != F.shiftright(b("m"), 32), a("m").bitwiseAND(F.lit(0xFFFFFFFF)) != b("m").bitwiseAND(F.lit(0xFFFFFFFF)), a("m2") != b("m2")]
    bits = F.bit_count(a("m").bitwiseXOR(b("m"))) + F.bit_count(a("m2").bitwiseXOR(b("m2")))
    first_band = F.when(~flipped[0], 0).when(~flipped[1], 1).when(~flipped[2], 2)
    longer = F.length(a("word"))
    alike = [reduce(Column.__and__, [x == y for x, y in zip(_kept(a("word"), longer, k), _kept(b("word"), longer, k), strict=True)]) for k in range(PARTS)]
    first_part = F.when(alike[0], 0).when(alike[2], 2).when(alike[1], 1)
    roles = (a("role") == 0) & (b("role") == 0) & (a("word") < b("word")) | (a("role") == 1) & (b("role") == 2)
    lengths = longer - F.length(b("word")) == F.when(a("role") == 0, 0).otherwise(1)
    same_key = (a("key") == b("key")) & (a("part") == b("part")) & (a("band") == b("band"))
    met = one.join(two, same_key & roles & lengths & (bits <= 2) & (a("band") == first_band) & (a("part") == first_part) & _one_edit(a("word"), b("word")))
    return met.select(a("word").alias("word"), a("n").alias("n"), b("word").alias("other"), b("n").alias("other_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every (word, form): the last word that forms lead to. A form is TIMES as frequent as its word,
    so chains are short, and every round doubles the length that is covered."""
    state = scratch.table(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = scratch.table(state.join(onward, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Words of all texts and the words that they are likely variants of: word, n, n_near, form, form_n, root.

    Words are maximal runs of ``[A-Za-zÀ-ÿ]`` with A-Z lower-cased, of which one in MISSPELT, chosen by the CRC-32 of
    ``<id>:<run>``, loses a code point; of LEAST_LENGTH code points and LEAST_COUNT occurrences (n) at least. Two words
    are near if one inserted, deleted or replaced code point parts them. A word's form is its near word of largest n, of
    equal ones the smallest, if that is TIMES its own n; the root is the last of its forms, or the word itself.
    Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated rows count each
    time; an empty table gives an empty result; extra columns are ignored; texts and runs may be of any length.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    words = scratch.table(with_bands(word_counts(docs, id_col, text_col)))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct("word", F.col("other").alias("other"), F.col("other_n").alias("other_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )).alias("x")).select("x.*")
    none = [F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"), "n"]
    # the words themselves are rows of the same aggregate
    rows = both.withColumn("n", F.lit(None).cast("long")).unionByName(words.select("word", *none))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), "other"))).alias("best")
    facts = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best)
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    facts = scratch.table(facts.select("word", "n", "n_near", F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    with_form = facts.where("form is not null")
    found = with_form.join(roots(with_form, scratch), "word")
    return facts.where("form is null").withColumn("root", F.col("word")).unionByName(found)
