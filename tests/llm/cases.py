"""Small tables with the awkward cases that every operator must take."""

LONG = "lang wort satz " * 3000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog", "en", "b"),
    (3, None, None, None),
    (4, "", "de", "a"),
    (5, " \n\t ", "de", "a"),
    (6, LONG, "de", None),
    (7, LONG, "de", "b"),
    (7, LONG, "de", "b"),
    (None, "no identifier here at all", "en", "c"),
    (None, "no identifier here at all", "en", "c"),
    (8, "Ünïcödé Ä ä ß 日本 🙂", "xx", "🙂"),
    (8, "another text of the same id", "en", "a"),
    (9, "### $$$ 123", "en", "a"),
]
#: Columns of the table, and more whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, id string, size int, kept string, n long, row string, mark string, fp int, word string"


def table(spark, rows=None):
    return spark.createDataFrame([(*r, "x", 1, "k", 2, "r", "m", 3, "w") for r in (ROWS if rows is None else rows)], SCHEMA)


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def prose(rng, n, vocabulary=4000):
    """Words of an invented language."""
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def sentences(rng, n):
    """The same in sentences of some ten words."""
    words = prose(rng, n).split()
    ends = [w + "." if rng.random() < 0.1 else w for w in words]
    return " ".join([*ends[:-1], words[-1] + "."])
