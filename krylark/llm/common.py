"""Shared helpers: the folder all executors see, small Arrow utilities and an exact word cache for tokenizers."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import shared_root


def shared_dir(spark: SparkSession) -> str:
    """URI of a fresh folder below ``spark.checkpoint.dir``."""
    base = shared_root(spark)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    return f"{base.rstrip('/')}/krylark-{uuid.uuid4().hex}"


def materialize(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = where or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``materialize`` wrote and nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table read in fewer splits than there are cores is dealt over all cores; any other stays as it is."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # dealt by a shuffle of its own
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column without a copy of the bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Cuts that every supported pre-tokenizer makes too: before a blank between two characters that are surely not white
#: space, and between a Latin letter and one of these marks.
_TAIL = np.isin(np.arange(256), np.frombuffer(b".,;:!?$%&*#|)", np.uint8))
_GRAPH = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
#: First bytes of characters of two, three and four bytes among which there is no white space.
_LEADS = [(np.arange(256) >= 0xC3) & (np.arange(256) <= 0xDF), (np.arange(256) == 0xE0) | (np.arange(256) >= 0xE4) & (np.arange(256) <= 0xEE), (np.arange(256) >= 0xF0) & (np.arange(256) <= 0xF4)]
_OPENS = _GRAPH | _LEADS[0] | _LEADS[1] | _LEADS[2]


def _ends_word(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``at`` (at least 0) is surely not white space."""
    out = _GRAPH[raw[at]]
    rest = np.flatnonzero(raw[at] >= 0x80)
    for k, lead in enumerate(_LEADS, 1):
        place = at[rest] - k
        inside = (place >= 0) & lead[raw[np.maximum(place, 0)]]
        for j in range(1, k):  # the bytes between go on with the same character
            inside &= raw[np.maximum(place + j, 0)] >> 6 == 2
        out[rest[inside]] = True
    return out


def _ends_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``at`` is a Latin letter of one or two bytes."""
    last, before = raw[at], raw[np.maximum(at - 1, 0)]
    return _LETTER[last] | (before == 0xC3) & (at > 0) & (last >> 6 == 2) & (last != 0x97) & (last != 0xB7)


class WordCache:
    """Exact ids of whole texts from a `tokenizers` file, encoding each distinct piece once.

    Both supported kinds of pre-tokenizer (byte level with the space before a word; white space dropped) never join
    what stands on both sides of a single blank between two non-blank characters, nor a letter and the mark after it,
    so the ids of a text are the ids of its pieces in a row.  ``keep_space`` says that a piece after a space carries
    it and that line feeds have ids.  Texts are cut, their pieces made distinct and their ids laid out as Arrow and
    numpy columns; only a piece that is not known yet meets the library.  At most ``limit`` pieces are kept, those
    used most: that bounds memory and changes no result.  ``special``: strings of special tokens become these tokens.
    """

    #: Bytes of text that are worked on together, and the most pieces.
    CHUNK, PIECES = 4 << 20, 2 << 20

    def __init__(self, path: str, keep_space: bool, limit: int = 480_000, special: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        self.keep_space, self.limit = keep_space, limit
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())) if special and self.tok.get_added_tokens_decoder() else None
        self.kind = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()

        # GPT-2's bijection of bytes and printable characters, which byte-level vocabularies are written in
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        spare = iter(range(256, 512))
        self.shown = {b: b if b in shown else next(spare) for b in range(256)}
        trial = ["the", "Théorie", "straßenweise", "Über", "x", *([" the", " Ñandú", " rereading"] if keep_space else [])]
        self.direct = self._encoded(trial) == self._words_encoded(trial)

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.start, self.length, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _words_encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of words of Latin letters alone, which are one unit to the pre-tokenizer: straight from the model."""
        if not words:
            return []
        line = "\n".join(words)
        line = (line if self.keep_space else line.lower()).encode().decode("latin-1").translate(self.shown)
        tokenize = self.tok.model.tokenize
        return [[t.id for t in tokenize(w)] for w in line.split(chr(self.shown[10]))]

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(pieces), 2048) for e in self.tok.encode_batch_fast(pieces[at:at + 2048], add_special_tokens=False)]

    def _forget(self, needed: np.ndarray) -> None:
        """Drops pieces until half of the limit is left, but none of the places ``needed``."""
        keep = np.zeros(len(self.known), bool)
        best = np.argsort(-self.uses, kind="stable")[:self.limit // 2]
        keep[best[self.uses[best] > 1]] = True
        keep[needed] = True
        best = np.flatnonzero(keep)
        self.known, n = self.known.take(pa.array(best)), self.length[best]
        self.ids = _runs(self.ids, self.start[best], n)
        self.start, self.length, self.uses = np.cumsum(n) - n, n, self.uses[best] // 2

    def _learn(self, new: pa.Array) -> None:
        """Adds pieces that are not known yet, in their order."""
        pieces = new.to_pylist()
        plain = [bool(WORD.fullmatch(p, p[:1] == " ")) for p in pieces] if self.direct else [False] * len(pieces)
        words, rest = [p for p, x in zip(pieces, plain) if x], [p for p, x in zip(pieces, plain) if not x]
        if not self.keep_space:
            words = [p.lstrip(" ") for p in words]
        words, rest = iter(self._words_encoded(words)), iter(self._encoded(rest))
        got = [next(words) if x else next(rest) for x in plain]
        n = np.fromiter(map(len, got), np.int64, len(got))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), self.kind, int(n.sum()))])
        self.length, self.uses = np.concatenate([self.length, n]), np.concatenate([self.uses, np.zeros(len(n), np.int64)])
        self.known = pa.concat_arrays([self.known, new])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct pieces are kept; those not known yet are learned."""
        found = pa.compute.index_in(words, value_set=self.known)
        if found.null_count:
            if len(self.known) + found.null_count > self.limit and len(self.known):
                self._forget(found.drop_null().to_numpy())
                found = pa.compute.index_in(words, value_set=self.known)
            first = len(self.known)
            missing = found.is_null()
            self._learn(words.filter(missing))
            place = found.fill_null(-1).to_numpy().astype(np.int64)
            place[place < 0] = np.arange(first, len(self.known))
        else:
            place = found.to_numpy()
        self.uses[place] += 1
        return place

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places in ``raw`` where a piece begins, and its length at the end."""
        n = len(raw)
        begins = np.zeros(n + 1, bool)
        if n > 2:
            at = np.flatnonzero((raw[1:-1] == 0x20) | (raw[1:-1] == 0x0A)) + 1
            at = at[_OPENS[raw[at + 1]]]
            at = at[_ends_word(raw, at - 1)]
            begins[at] = True
            lines = at[raw[at] == 0x0A]
            if self.keep_space:
                begins[lines + 1] = True
            at = np.flatnonzero(_TAIL[raw[1:]]) + 1
            begins[at[_ends_letter(raw, at - 1)]] = True
        begins[offsets] = True
        return np.flatnonzero(begins)

    def encode_parts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has) of texts in one buffer of bytes."""
        if self.special is not None:
            return self._with_special(raw, offsets)
        cuts = self._cuts(raw, offsets)
        body = pa.py_buffer(raw)
        out, sizes = [], []
        for at in range(0, len(cuts) - 1, self.PIECES):
            part = np.ascontiguousarray(cuts[at:at + self.PIECES + 1])
            pieces = pa.LargeStringArray.from_buffers(len(part) - 1, pa.py_buffer(part), body)
            if not self.keep_space:  # a piece that begins with a line feed has the same ids as one that begins with a space
                pieces = pieces if not (raw[part[:-1]] == 0x0A).any() else _spaced(raw, part)
            coded = pieces.dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy()
            place = self._places(words)
            place = place[code]
            out.append(_runs(self.ids, self.start[place], self.length[place]))
            sizes.append(self.length[place])
        if not out:
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return out[0] if len(out) == 1 else np.concatenate(out), np.diff(before[np.searchsorted(cuts, offsets)])

    def _with_special(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a special string are encoded whole, the others as ever."""
        special, self.special = self.special, None
        try:
            ids, n = self.encode_parts(raw, offsets)
        finally:
            self.special = special
        ends = np.cumsum(n)
        parts = np.split(ids, ends[:-1]) if len(n) else []
        for k in range(len(n)):
            text = raw[offsets[k]:offsets[k + 1]].tobytes().decode()
            if special.search(text):
                parts[k] = np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)
                n[k] = len(parts[k])
        return (np.concatenate(parts) if parts else ids), n

    def encode_column(self, column: pa.Array, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some rows in a row, how many each has), a bounded part of the column at a time; ``end`` is added to each row."""
        raw, offsets = string_parts(column)
        at = 0
        while at < len(offsets) - 1:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.CHUNK, "right")) - 1)
            ids, n = self.encode_parts(raw[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at])
            if end is not None:
                ids, n = np.insert(ids if end <= np.iinfo(ids.dtype).max else ids.astype(np.uint32), np.cumsum(n), end), n + 1
            yield at, ids, n
            at = stop

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        out: list[bytes] = []
        for _, ids, n in self.encode_column(pa.array(batch, pa.large_string())):
            out.extend(x.astype(np.uint32).tobytes() for x in np.split(ids, np.cumsum(n)[:-1]))
        return out


def _runs(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``start``, one after the other."""
    before = np.cumsum(length) - length
    total = int(length.sum())
    at = np.repeat(start - before, length)
    at += np.arange(total)
    return values[at]


def _spaced(raw: np.ndarray, cuts: np.ndarray) -> pa.LargeStringArray:
    """The pieces between ``cuts``, with a space for a line feed at the beginning."""
    body = raw.copy()
    first = cuts[:-1]
    body[first[raw[first] == 0x0A]] = 0x20
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(body))


_WORD_CACHES: dict[tuple, WordCache] = {}


def word_cache(path: str, keep_space: bool, special: bool = False) -> WordCache:
    """The cache of this process, which tasks that run in it one after the other share."""
    key = (path, keep_space, special)
    if key not in _WORD_CACHES:
        _WORD_CACHES.clear()  # one vocabulary at a time
        _WORD_CACHES[key] = WordCache(path, keep_space, special=special)
    return _WORD_CACHES[key]


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = WordCache.CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes, so that what is worked out once for a batch is worth it and what is held stays bounded."""
    held, size = [], 0
    for b in batches:
        step = max(1, b.num_rows * most // max(b.nbytes, 1))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= most:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _release() -> None:
    """Gives memory that a task no longer uses back to the machine; its process waits for the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose processes hold little between tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(task, schema)


@contextmanager
def small_batches(spark: SparkSession, most: int = 1000) -> Iterator[None]:
    """At most ``most`` rows in an Arrow batch of what is run inside, as whole texts make long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lower_ascii(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
