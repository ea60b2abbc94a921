"""Language identification by prediction by partial matching (PPM).

Every language gets a context tree over bytes: how often each byte followed each context of up to three
bytes. A text's code length under a language is the exact PPM code length with escape method C and symbol
exclusion, the statistics frozen: bits of the byte in the longest known context, or of an escape and then of
the byte in the next shorter context without the bytes that the longer one has ruled out, down to a uniform
code. The language with the fewest bits wins.

Frozen statistics make a byte's cost a function of three bytes of context and the byte, so the trees are
flattened once into a table (context, byte, language) -> bits, and a text is scored by array lookups. The table
holds as many contexts as fit into DENSE_BYTES, the most frequent first; the bits of the others are made from
the counts when a text has them, so every length is exact, however many contexts and languages there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches

ORDER = 3
#: Documents of each language that are learned from, picked by a hash of the id; the bound of the sample.
SAMPLE_DOCS = 400
#: Characters that are learned from in each of them, from its start; with SAMPLE_DOCS it bounds the sample's size.
SAMPLE_CHARS = 16_384
#: Size of the table of bits.
DENSE_BYTES = 32 << 20
#: Bytes scored at a time; texts of any length pass through in such pieces.
PIECE = 1 << 18
PAD = 10
UNDETERMINED = "und"


def _padded(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The bytes 1..ORDER places back of every byte; line feeds before the start of a text."""
    back = []
    for k in range(1, ORDER + 1):
        x = np.full(len(data), PAD, data.dtype)
        x[k:] = data[:-k] if k < len(data) else data[:0]
        for j in range(k):
            at = starts + j
            x[at[at < len(data)]] = PAD
        back.append(x)
    return back


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): each text's grams of ORDER bytes and the next, packed with the oldest byte first."""
    for batch in batches:
        lang, text = batch.column(0), batch.column(1)
        for name in pc.unique(lang).to_pylist():
            bodies = [x.encode().lower() for x in text.filter(pc.equal(lang, name)).to_pylist() if x]
            if not bodies:
                continue
            data = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int64)
            starts = np.cumsum([0, *map(len, bodies[:-1])])
            one, two, three = _padded(data, starts)
            # a text shorter than the context must not mark places of the next text
            grams, n = np.unique((((three << 8 | two) << 8 | one) << 8) | data, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Tree:
    """A language's counts by context: for each order the known contexts, sorted, and the symbols that followed each."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, symbol: np.ndarray, wide: int):
        self.wide, self.orders = wide, []
        column = symbol[grams & 255]
        for order in range(ORDER + 1):
            pairs, place = np.unique(packed(grams, order, symbol, wide) * wide + column, return_inverse=True)
            known, starts = np.unique(pairs // wide, return_index=True)
            self.orders.append((known, np.append(starts, len(pairs)), (pairs % wide).astype(np.int16), np.bincount(place, n).astype(np.float32)))

    def counts(self, contexts: np.ndarray, order: int) -> np.ndarray:
        """A row of counts by symbol for each context; zeros for those that the language doesn't know."""
        known, starts, columns, n = self.orders[order]
        out = np.zeros((len(contexts), self.wide), np.float32)
        place = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        length = np.where(known[place] == contexts, starts[place + 1] - starts[place], 0)
        ends = np.cumsum(length)
        at = np.repeat(starts[place] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        out[np.repeat(np.arange(len(contexts)), length), columns[at]] = n[at]
        return out

    def bits(self, contexts: np.ndarray, order: int) -> np.ndarray:
        """Bits of every symbol in each of the contexts, of one order."""
        cost = np.zeros((len(contexts), self.wide))
        spent, free = np.zeros(len(contexts)), np.ones((len(contexts), self.wide), bool)
        for k in range(order, -1, -1):
            here = np.where(free, self.counts(contexts % self.wide**k, k), 0)
            hit = here > 0
            total, kinds = here.sum(1), hit.sum(1)
            cost = np.where(hit, spent[:, None] - np.log2(np.where(hit, here, 1) / np.maximum(total + kinds, 1)[:, None]), cost)
            spent = spent + np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0)
            free &= ~hit
        rest = 256 - (~free).sum(1)  # bytes that are still possible, each as likely
        return np.where(free, spent[:, None] + np.log2(np.maximum(rest, 1))[:, None], cost)


def packed(grams: np.ndarray, order: int, symbol: np.ndarray, wide: int) -> np.ndarray:
    """The last ``order`` bytes before a gram's last one, as a number of symbols, the oldest first."""
    out = np.zeros(len(grams), np.int64)
    for k in range(order, 0, -1):
        out = out * wide + symbol[grams >> (8 * k) & 255]
    return out


class Model:
    """Flattened context trees.

    Every known context has a number: ``one`` by a byte, ``two`` by two of them, ``three`` by the place of a known
    pair (``pair``) and the byte before it. ``row`` is its place in ``dense`` [rows, symbols, languages], or -1; then its
    bits are made from the trees, for which ``order`` and ``context`` say what it is.
    """

    def __init__(self, trees: dict[str, Tree], symbol: np.ndarray, wide: int, contexts: list[np.ndarray], weights: list[np.ndarray]):
        self.languages, self.trees, self.symbol, self.wide = sorted(trees), [trees[x] for x in sorted(trees)], symbol, wide
        base = np.cumsum([0, *map(len, contexts)])
        self.order, self.context = np.repeat(np.arange(ORDER + 1), np.diff(base)).astype(np.int8), np.concatenate(contexts)
        self.one = np.zeros(wide, np.int32)
        self.one[contexts[1]] = base[1] + np.arange(len(contexts[1]))
        self.two = np.tile(self.one, wide)
        self.two[contexts[2]] = base[2] + np.arange(len(contexts[2]))
        self.pair = np.zeros(wide * wide, np.int32)
        self.pair[contexts[2]] = 1 + np.arange(len(contexts[2]))
        self.three = np.zeros((len(contexts[2]) + 1) * wide, np.int32)
        self.three[self.pair[contexts[3] % (wide * wide)].astype(np.int64) * wide + contexts[3] // (wide * wide)] = base[3] + np.arange(len(contexts[3]))
        # short contexts come first, since all others fall back to them; then the most frequent ones
        weight = np.concatenate(weights)
        best = np.lexsort((np.arange(len(weight)), -weight, self.order > 1))
        rows = np.sort(best[: max(1, DENSE_BYTES // (4 * wide * len(trees)))])
        self.row = np.full(len(weight), -1, np.int32)
        self.row[rows] = np.arange(len(rows))
        self.dense = np.empty((len(rows), wide, len(trees)), np.float32)
        for at in range(0, len(rows), 4096):
            self.dense[at : at + 4096] = self._bits(rows[at : at + 4096])

    def _bits(self, numbers: np.ndarray) -> np.ndarray:
        """[contexts, symbols, languages] of some known contexts."""
        out = np.empty((len(numbers), self.wide, len(self.trees)), np.float32)
        for order in range(ORDER + 1):
            own = np.flatnonzero(self.order[numbers] == order)
            for l, tree in enumerate(self.trees):
                if len(own):
                    out[own, :, l] = tree.bits(self.context[numbers[own]], order)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text under every language."""
        out = np.zeros((len(texts), len(self.languages)))
        group, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), PIECE):
                piece = (i, text[max(0, at - ORDER) : at + PIECE], min(at, ORDER))
                if size + len(piece[1]) > PIECE and group:
                    self._score(group, out)
                    group, size = [], 0
                group.append(piece)
                size += len(piece[1])
        if group:
            self._score(group, out)
        return out

    def _score(self, group: list[tuple[int, bytes, int]], out: np.ndarray) -> None:
        """Adds the bits of each piece (text, bytes, bytes of context that are scored already)."""
        wide = self.wide
        data = self.symbol[np.frombuffer(b"".join(p[1] for p in group), np.uint8)].astype(np.int32)
        starts = np.cumsum([0, *(len(p[1]) for p in group[:-1])])
        fresh = np.array([s for s, p in zip(starts, group, strict=True) if not p[2]], np.int64)
        back = []
        for k in range(1, ORDER + 1):
            x = np.full(len(data), self.symbol[PAD], np.int32)
            x[k:] = data[:-k]
            for j in range(k):
                at = fresh + j
                x[at[at < len(data)]] = self.symbol[PAD]
            back.append(x)
        both = back[1] * wide + back[0]
        known = self.three[self.pair[both].astype(np.int64) * wide + back[2]]
        known = np.where(known > 0, known, self.two[both])
        row = self.row[known]
        cost = self.dense.reshape(-1, self.dense.shape[2])[np.maximum(row, 0).astype(np.int64) * wide + data]
        rare = np.flatnonzero(row < 0)
        if len(rare):
            numbers, place = np.unique(known[rare], return_inverse=True)
            for at in range(0, len(numbers), 1024):
                here = (place >= at) & (place < at + 1024)
                cost[rare[here]] = self._bits(numbers[at : at + 1024])[place[here] - at, data[rare[here]]]
        for s, p in zip(starts, group, strict=True):
            cost[s : s + p[2]] = 0
        np.add.at(out, [p[0] for p in group], np.add.reduceat(cost, starts, axis=0, dtype=np.float64))


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Model of the grams and their counts of each language."""
    grams = np.concatenate([counts[x][0] for x in sorted(counts)])
    totals = np.concatenate([counts[x][1] for x in sorted(counts)])
    seen = np.unique([PAD, *(b for k in range(ORDER + 1) for b in np.unique(grams >> (8 * k) & 255))]).astype(np.int64)
    wide = len(seen) + 1
    symbol = np.full(256, wide - 1, np.int64)  # the last symbol: any byte that was never seen
    symbol[seen] = np.arange(len(seen))
    contexts, weights = [], []
    for order in range(ORDER + 1):
        found, place = np.unique(packed(grams, order, symbol, wide), return_inverse=True)
        contexts.append(found)
        weights.append(np.bincount(place, totals))
    return Model({x: Tree(*counts[x], symbol, wide) for x in counts}, symbol, wide, contexts, weights)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; such documents are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Context trees of the labelled documents that aren't held out; None if there are none.

    The sample is bounded: the ids' hashes pick ``sample_docs`` documents of each language on average, or all
    there are, and of each the first SAMPLE_CHARS characters. It takes one count a language, and no language's
    rows meet in a task.
    """
    bound_batches(docs.sparkSession)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & (F.octet_length(text_col) > 0))
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 31))
    known = usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    below = F.lit(0)
    for row in known:
        below = F.when(F.col(lang_col) == row["lang"], F.lit(-(-(sample_docs << 31) // row["n"]))).otherwise(below)
    sample = usable.where(place < below).select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text"))
    grams = sample.mapInArrow(_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toArrow()
    if not table.num_rows:
        return None
    lang, gram, n = (table.column(c).combine_chunks() for c in ("lang", "gram", "n"))
    return fit({x: (gram.filter(pc.equal(lang, x)).to_numpy(zero_copy_only=False), n.filter(pc.equal(lang, x)).to_numpy(zero_copy_only=False)) for x in pc.unique(lang).to_pylist()})


def _scored(known: Model | None, text: pa.Array, lettered: pa.Array) -> tuple[list, list, list]:
    """Language, score and bits per byte of each text."""
    names, scores, lengths = [], [], []
    for at in range(0, len(text), 256):
        part = [x.as_buffer().to_pybytes().lower() if y else b"" for x, y in zip(text[at : at + 256], lettered[at : at + 256].to_pylist(), strict=True)]
        if known is None:
            names += [UNDETERMINED] * len(part)
            scores += [0.0] * len(part)
            lengths += [None] * len(part)
            continue
        bits = known.code_lengths(part)
        best = bits.argmin(1)
        odds = np.exp2(bits[np.arange(len(part)), best][:, None] - bits)
        for i, x in enumerate(part):
            names.append(known.languages[best[i]] if x else UNDETERMINED)
            scores.append(float(1 / odds[i].sum()) if x else 0.0)
            lengths.append(float(bits[i, best[i]] / len(x)) if x else None)
    return names, scores, lengths


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, held, lettered, text = (batch.column(i) for i in range(4))
        names, scores, lengths = _scored(model.value if model else None, text, lettered)
        yield pa.RecordBatch.from_arrays([ids, held, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.float64())], ["id", "held_out", "lang_pred", "score", "bits_per_byte"])


def _keep(batches: Iterator[pa.RecordBatch], model, column: int, min_score: float) -> Iterator[pa.RecordBatch]:
    """The rows that pass, without the last column, which says whether a text has a letter."""
    for batch in batches:
        names, scores, _ = _scored(model.value if model else None, batch.column(column), batch.column(batch.num_columns - 1))
        good = pa.array([n != UNDETERMINED and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(good)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, lang_pred, score (probability of the language among the learned ones, all as
    likely before) and bits_per_byte (its code length by the text's bytes).

    Only the text decides. Defined cases: a null text, an empty one or one without a letter is ``und`` with
    score 0 and null bits_per_byte, and so is every text where nothing could be learned; of languages with
    equal code lengths the first by code point wins; a null id isn't held out; repeated rows each get their
    row; extra columns are ignored; texts of any length are scored to their end.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model) if model else None
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), text.rlike(r"\p{L}").alias("lettered"), text.cast("binary").alias("text"))
    out = rows.mapInArrow(partial(_predict, model=shared), f"id {id_type}, held_out boolean, lang_pred string, score double, bits_per_byte double")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``min_score``, with all their columns; no row moves."""
    model = learn(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model) if model else None
    flagged = docs.withColumn("_pf_lettered", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return flagged.mapInArrow(partial(_keep, model=shared, column=docs.columns.index(text_col), min_score=min_score), docs.schema)
