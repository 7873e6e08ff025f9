"""Quality rules as a ledger: every rule is evaluated once, and policies are bit masks over the stored failures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_type, map_arrow, texts

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 8
#: Rule names; a rule's bit is its place.
RULES = ("too_few_words", "repeated_windows", "symbol_ratio", "capitals", "adjacent_repeats", "duplicate_lines", "word_length")
BIT = {name: 1 << i for i, name in enumerate(RULES)}
#: Versioned policies: the failures that reject a document.
POLICIES = {
    "base": BIT["too_few_words"] | BIT["repeated_windows"],
    "v1": BIT["too_few_words"] | BIT["repeated_windows"] | BIT["symbol_ratio"] | BIT["capitals"] | BIT["adjacent_repeats"] | BIT["duplicate_lines"] | BIT["word_length"],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_adjacent")
#: When a rule fails, in SQL over the measurements.
FAILS = {
    "too_few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_ratio": "10 * n_symbols > n_words",
    "capitals": "n_upper > n_lower",
    "adjacent_repeats": "100 * n_adjacent > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 70 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 25 * n_words",
}
FAILURES = "cast(" + " | ".join(f"(case when {FAILS[r]} then {BIT[r]} else 0 end)" for r in RULES) + " as bigint)"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words covered by windows of ``width`` (a power of two) words that occur twice or more; exact, no hashing."""
    a, step = ids, 1
    while step < width:
        m = len(a) - step
        if m < 2:
            return 0
        key = a[:m] * (int(a.max()) + 1) + a[step:]
        _, first, count = np.unique(key, return_inverse=True, return_counts=True)
        if len(count) == m:
            return 0
        a, step = first, 2 * step
    twice = np.flatnonzero(np.bincount(a)[a] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # bytes are split at the six ASCII blanks only
    n, number = len(words), {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        n, len(text) - sum(text.count(c) for c in BLANKS), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(ids) if len(number) < n else 0, len(lines), len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER)),
        int((ids[1:] == ids[:-1]).sum()),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, the measurements and ``failures``, a bit per rule.

    A null or empty text has no words and fails ``too_few_words``; ids may be null or repeated; other columns are
    ignored.  A rule compares whole numbers only, so it gives the same answer in any engine.
    """
    schema = T.StructType([T.StructField("id", column_type(docs, id_col)), *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t) for t in texts(b.column(1))]
            columns = np.array(got, np.int64).reshape(len(got), len(MEASURES)).T
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in columns]], names=["id", *MEASURES])

    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema).withColumn("failures", F.expr(FAILURES)).withColumnRenamed("id", id_col)


def carried_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, measurements, failures): the ledger beside each whole row, as a struct, so that names cannot clash."""
    schema = T.StructType([T.StructField("row", docs.schema), *[T.StructField(m, T.LongType()) for m in MEASURES]])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [measure(t) for t in texts(b.column(0).field(place))]
            columns = np.array(got, np.int64).reshape(len(got), len(MEASURES)).T
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in columns]], names=["row", *MEASURES])

    return map_arrow(docs.select(F.struct("*").alias("row")), run, schema).withColumn("failures", F.expr(FAILURES))


def keep_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with the same columns."""
    return apply_policy(carried_ledger(docs, text_col), policy).where("kept").select("row.*")


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy, from the stored bits alone."""
    return book.withColumn("base_failed", F.col("failures").bitwiseAND(POLICIES["base"]) != 0).withColumn("kept", F.col("failures").bitwiseAND(POLICIES["base"] | POLICIES[policy]) == 0)


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only this rule rejects; one pass over the ledger."""
    mask = POLICIES[policy]
    used = F.col("failures").bitwiseAND(mask)
    counts = book.agg(
        F.count("*").alias("documents"),
        F.bit_or(used).alias("seen"),
        *[F.sum((used.bitwiseAND(BIT[r]) != 0).cast("long")).alias(f"fail_{r}") for r in RULES],
        *[F.sum((used == BIT[r]).cast("long")).alias(f"only_{r}") for r in RULES],
    )
    names = ", ".join(f"'{r}', fail_{r}, only_{r}" for r in RULES if mask & BIT[r])
    return counts.selectExpr("documents", f"stack({sum(bool(mask & BIT[r]) for r in RULES)}, {names}) as (rule, failed, only_this)").select("rule", "documents", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("only_this", F.lit(0)).alias("only_this"))
