"""Language identification by prediction by partial matching.

Each language has a context tree of bytes: counts of a byte after its last 0 to ``ORDER`` bytes, with escape
probabilities by method C (d distinct of n: escape d / (n + d)).  Contexts begin at the blank before a word, so the
exact code length of a word under the frozen counts does not depend on its neighbours: it is worked out once for each
distinct word, and a text's code length is a sum.  Letters are lower-cased, and what stands between words is left out.
Two limits follow: no context spans a blank, and digits and punctuation carry no code length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, column_type, map_arrow, materialize

ORDER = 4
#: The classifier is fitted on at most so many labelled rows of each language, those with the least hash of the id.
TRAIN_ROWS = 300
#: The model is built from at most so many words of each language, those most frequent in these rows.
TRAIN_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+")
NO_LETTER = re.compile(r"[\W\d_]")
CACHE = 400_000
UNKNOWN = "und"


def pack(gram: bytes) -> int:
    return int.from_bytes(gram, "big") | len(gram) << 48


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, n) of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in WORD.findall((text or "").lower()):
                    n[lang, w] += 1
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([n[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    return map_arrow(docs.select(F.col(lang_col).cast("string"), text_col), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Frozen statistics: for every byte string seen, by language, the cost of its last byte and of an escape after it."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.langs = sorted({c[0] for c in counts})
        by: list[dict[bytes, int]] = [defaultdict(int) for _ in self.langs]
        place = {lang: k for k, lang in enumerate(self.langs)}
        for lang, word, n in counts:
            own, raw = by[place[lang]], b" " + word.encode() + b" "
            for end in range(2, len(raw) + 1):
                for start in range(max(0, end - 1 - ORDER), end):
                    own[raw[start:end]] += n
        seen = {gram: np.zeros(len(by)) for own in by for gram in own}
        for k, own in enumerate(by):
            for gram, n in own.items():
                seen[gram][k] = n
        total = defaultdict(lambda: np.zeros(len(self.langs)))
        kinds = defaultdict(lambda: np.zeros(len(self.langs)))
        for gram, row in seen.items():
            total[gram[:-1]] += row
            kinds[gram[:-1]] += row > 0
        counts_of, totals, distinct = (np.array(x, float).reshape(len(x), len(by)) for x in (list(seen.values()), list(total.values()), list(kinds.values())))
        at = {c: i for i, c in enumerate(total)}
        above = np.array([at[g[:-1]] for g in seen], np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.where(counts_of > 0, -np.log2(counts_of / (totals + distinct)[above]), np.inf)
            leave = np.where(totals > 0, -np.log2(distinct / (totals + distinct)), 0.0)
        self.grams = np.array([pack(g) for g in seen], np.int64)
        self.cost = cost.astype(np.float32)
        self.contexts = np.array([pack(c) for c in total], np.int64)
        self.leave = leave.astype(np.float32)


class Scorer:
    """Code lengths of words under a model, in bits by language; words and byte costs already met are kept."""

    def __init__(self, model: Model):
        self.m = model
        self.gram = dict(zip(model.grams.tolist(), range(len(model.grams))))
        self.context = dict(zip(model.contexts.tolist(), range(len(model.contexts))))
        self.costs = _Costs(self)
        self.words: dict[str, int] = {}
        self.table = np.zeros((CACHE, len(model.langs)))

    def byte_cost(self, gram: bytes) -> np.ndarray:
        """Cost of the last byte of ``gram`` after the bytes before it."""
        shorter = self.costs[gram[1:]] if len(gram) > 1 else None
        lower = np.full(len(self.m.langs), 8.0) if shorter is None else self.costs.values[shorter]
        at = self.context.get(pack(gram[:-1]))
        out = lower if at is None else lower + self.m.leave[at]
        seen = self.gram.get(pack(gram))
        return out if seen is None else np.where(np.isinf(self.m.cost[seen]), out, self.m.cost[seen])

    def _learn(self, new: list[str]) -> None:
        grams: list[bytes] = []
        ends, wide = [], ORDER + 1
        for w in new:
            raw = b" " + w.encode("utf-8", "replace") + b" "
            n = len(raw)
            grams += [raw[:e] for e in range(2, min(wide, n + 1))]
            grams += [raw[i:i + wide] for i in range(n - ORDER)]
            ends.append(len(grams))
        if len(self.costs) + len(grams) > 4 * CACHE:
            self.costs.clear()
        at = np.fromiter(map(self.costs.__getitem__, grams), np.int64, len(grams))
        sums = np.add.reduceat(self.costs.values[at], [0, *ends[:-1]])
        first = len(self.words)
        self.table[first:first + len(new)] = sums
        self.words.update(zip(new, range(first, first + len(new))))

    def of_words(self, words: list[str]) -> np.ndarray:
        """Code lengths of distinct words, a row each."""
        out = np.empty((len(words), len(self.m.langs)))
        for at in range(0, len(words), CACHE // 2):
            part = words[at:at + CACHE // 2]
            new = [w for w in part if w not in self.words]
            if len(self.words) + len(new) > CACHE:
                self.words.clear()
                new = part
            for k in range(0, len(new), 1 << 14):
                self._learn(new[k:k + (1 << 14)])
            out[at:at + len(part)] = self.table[np.fromiter(map(self.words.__getitem__, part), np.int64, len(part))]
        return out

    def sums(self, words: list[str], sizes: list[int]) -> np.ndarray:
        """Code lengths of runs of ``words`` of these sizes, none of them empty; every distinct word is looked up once."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        each = self.of_words(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        return np.add.reduceat(each, np.cumsum([0, *sizes[:-1]]), axis=0)

    def lengths(self, words: list[str]) -> np.ndarray:
        return self.sums(words, [len(words)])[0] if words else np.zeros(len(self.m.langs))


def _slices(text: str, most: int = 1 << 20) -> Iterator[str]:
    """Parts of a long text, cut where no word is."""
    at = 0
    while at < len(text):
        m = NO_LETTER.search(text, at + most)
        stop = m.start() if m else len(text)
        yield text[at:stop]
        at = stop


class _Costs(dict):
    """Row of each gram in ``values``, worked out when it is first asked for."""

    def __init__(self, scorer: Scorer):
        super().__init__()
        self.scorer = scorer
        self.values = np.zeros((1 << 12, len(scorer.m.langs)))

    def __missing__(self, gram: bytes) -> int:
        row = self.scorer.byte_cost(gram)
        k = len(self)
        if k == len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[k] = row
        self[gram] = k
        return k


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> Model:
    """The model of the labelled rows of ``docs``: at most ``rows`` and ``words`` a language, so what the driver gathers is bounded."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("train_id"), F.col(lang_col).alias("train_lang")).withColumn("key", F.xxhash64("train_id"))
    # about four times as many rows as wanted lie below a language's cut, whatever the size of the corpus
    span = float(1 << 64)
    # (a row a language, written so that its size is known when the join is planned)
    cuts = labelled.groupBy("train_lang").agg(F.count("*").alias("n")).select(F.col("train_lang").alias("cut_lang"), (F.least(F.lit(1.0), 4.0 * rows / F.col("n")) * span - span / 2).alias("cut"))
    cuts = materialize(cuts)
    few = labelled.join(cuts, F.col("train_lang") == F.col("cut_lang")).where(F.col("key").cast("double") <= F.col("cut"))
    first = Window.partitionBy("train_lang").orderBy("key", "train_id")
    ids = few.withColumn("place", F.row_number().over(first)).where(F.col("place") <= rows).select("train_id", "train_lang").distinct()
    sample = docs.join(F.broadcast(ids), (F.col(id_col) == F.col("train_id")) & (F.col(lang_col) == F.col("train_lang")), "left_semi")
    counts = word_counts(sample, text_col, lang_col)
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    counts = counts.withColumn("place", F.row_number().over(most)).where(F.col("place") <= words).drop("place")
    return Model([tuple(r) for r in counts.orderBy("lang", "word").collect()])


def held_out(id_col: str):
    """Rows that are never learned from: crc32 of the id as text is a multiple of five (a null id counts so)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred`` and ``score``, from the text alone.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned.  Of languages with
    equal code lengths the first by name is taken.  The score is the posterior with code lengths taken per word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", column_type(docs, id_col)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        langs = scorer.m.langs
        for b in by_bytes(batches):
            bits, count = np.zeros((b.num_rows, len(langs))), np.zeros(b.num_rows, np.int64)
            words: list[str] = []
            sizes: list[int] = []
            whose: list[int] = []

            def add() -> None:
                if words and langs:
                    np.add.at(bits, whose, scorer.sums(words, sizes))  # noqa: B023
                np.add.at(count, whose, sizes)  # noqa: B023
                for x in (words, sizes, whose):
                    x.clear()

            for i in range(b.num_rows):
                for piece in _slices((b.column(1)[i].as_py() or "").lower()):
                    own = WORD.findall(piece)
                    if own:
                        words += own
                        sizes.append(len(own))
                        whose.append(i)
                    if len(words) > 1 << 19:
                        add()
            add()
            names, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            if langs:
                best = bits.argmin(axis=1)
                known = np.flatnonzero(count)
                for i in known.tolist():
                    names[i] = langs[best[i]]
                gap = (bits[known, best[known]][:, None] - bits[known]) / count[known][:, None]
                scores[known] = 1 / np.exp2(gap).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts every row: id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
