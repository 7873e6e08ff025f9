"""Mixture-controlled packing by deficit round-robin over source queues.

1. Every input split tokenizes its texts where they are and writes one Arrow file to the shared folder, with batches of
   one source each; what comes back is a row for each split and source.  No text is shuffled.
2. The queue of a source is its tokens over all splits, in the order of the splits.  After T tokens of output a source
   should have had its target share of T, so its deficit is that less what it has got.  It is paid in turns of
   ``min_piece`` tokens as soon as the deficit allows one, so what each source has got at the end of every *round* of
   windows is a closed form: deficits carry over rounds and tasks although no task waits for another, and no queue is
   read ahead.  A source that runs out leaves its share to the others.
3. Inside a round the sources take turns too: each gets its share of a window at once, in the order in which its
   deficit reaches that share.
4. All windows hold exactly ``seq_len`` ids, also where a round or a task ends; the rest of the corpus fills windows of
   falling powers of two.  There is no padding, and how many rounds a task takes changes no row.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow, materialize, _runs, shared_dir, small_batches, spread, word_cache
from .token_store import Published, open_fs

SEQ_LEN = 1024
#: The least that a source is served at a time.
MIN_PIECE = 32
#: Windows in a round, and rounds that a task holds at a time (about four million tokens).
ROUND, BLOCK = 64, 64
#: Tokens in a batch of a split's file, and the most that all sources of a split hold before they are written.
BATCH, HELD = 1 << 16, 1 << 24

SHARD = pa.schema([("doc", pa.int64()), ("ids", pa.binary())])
STATS = "split int, source string, tokens long, numbers array<int>, sizes array<long>"
PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Targets:
    """How many tokens each source should have got when T tokens of all are out.

    Without ``weights`` every source goes on in proportion to what it has.  With them, sources go on by weight until
    they run out, and those without a weight follow after the rest.  ``totals``: the tokens of the weighted sources.
    """

    def __init__(self, total: int, weights: dict[str, float] | None = None, totals: dict[str, int] | None = None, min_piece: int = MIN_PIECE):
        self.total, self.min_piece = total, min_piece
        self.weights = {s: w for s, w in (weights or {}).items() if w > 0 and (totals or {}).get(s)}
        self.by_weight = bool(weights)
        #: (tokens out, units of weight served, weight of the sources left) where a source runs out, the weighted ones first
        self.steps: list[tuple[float, float, float]] = []
        left, out, level = sum(self.weights.values()), 0.0, 0.0
        for s in sorted(self.weights, key=lambda s: totals[s] / self.weights[s]):
            self.steps.append((out, level, left))
            end = totals[s] / self.weights[s]
            out, level, left = out + (end - level) * left, end, left - self.weights[s]
        self.weighted = sum(totals[s] for s in self.weights) if self.weights else 0

    def share(self, source: str, tokens: int, out: int) -> float:
        """The part of ``source``, which has ``tokens``, that should be out."""
        if out >= self.total:
            return 1.0
        if not self.by_weight:
            return out / self.total
        if source not in self.weights:
            return max(0, out - self.weighted) / max(self.total - self.weighted, 1)
        if out >= self.weighted:
            return 1.0
        at, level, left = self.steps[bisect_right(self.steps, out, key=lambda x: x[0]) - 1]
        return min(1.0, (level + (out - at) / left) * self.weights[source] / tokens)

    def rounds(self, first: int, last: int, size: int) -> list[int]:
        """Where rounds of ``size`` end after ``first`` and up to ``last``; one also ends where a source runs out."""
        ends = [round(out) for out, _, _ in self.steps] + [self.weighted]
        return sorted({e for e in ends if first < e < last} | {*range(first + size, last, size), last})

    def due(self, source: str, tokens: int, out: int) -> int:
        """Tokens of the turns that ``source`` has had when ``out`` are out; all of them when the corpus ends."""
        turns = -(-tokens // self.min_piece)
        late = (zlib.crc32(source.encode()) + 1) / (1 << 32)  # sources do not all take their turns at one time
        return min(tokens, self.min_piece * int(turns * self.share(source, tokens, out) + 1 - late))


def turns(quotas: list[int], seq_len: int = SEQ_LEN, min_piece: int = MIN_PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(source number, tokens) of the turns of a round in which each source has its quota.

    Deficits grow in proportion to the quotas; a source is served whenever its own has grown by its share of a window
    (``min_piece`` at least), so the k-th of its n turns comes at (k + 1/2) / n of the round.
    """
    total = max(sum(quotas), 1)
    who, size, when = [], [], []
    for s, quota in enumerate(quotas):
        if quota:
            n = max(1, round(quota / max(min_piece, quota * seq_len / total)))
            edges = np.arange(n + 1) * quota // n
            who.append(np.full(n, s))
            size.append(np.diff(edges))
            when.append((np.arange(n) + 0.5) / n)
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, size, when = map(np.concatenate, (who, size, when))
    order = np.lexsort((who, when))
    return who[order], size[order]


def tail_edges(total: int, seq_len: int) -> list[int]:
    """Where the sequences after the full windows begin, and the end: falling powers of two."""
    at, rest = total - total % seq_len, total % seq_len
    edges = [at]
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            edges.append(at)
    return edges


def tokenize_splits(docs: DataFrame, folder: str, tokenizer: str, end_id: int, keep_space: bool, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Writes a file for each split; a row for each split and source with its tokens, by batch of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words = TaskContext.get().partitionId(), word_cache(tokenizer, keep_space)
        kind = np.uint16 if max(words.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        held: dict[str, list[tuple]] = {}
        size: dict[str, int] = {}
        written: dict[str, list[tuple[int, int]]] = {}
        count = 0
        with Published(f"{folder}/split-{split:06d}.arrow") as sink, pa.ipc.new_file(sink, SHARD.with_metadata({"bits": str(8 * kind().itemsize)})) as out:

            def write(source: str) -> None:
                nonlocal count
                docs, n, ids = zip(*held.pop(source))
                n, ids = np.concatenate(n), np.concatenate(ids).astype(kind, copy=False)
                offsets = np.concatenate([[0], np.cumsum(n) * ids.itemsize]).astype(np.int32)
                body = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                out.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays(docs), body], schema=SHARD))
                written.setdefault(source, []).append((count, size.pop(source)))
                count += 1

            for b in by_bytes(batches):
                for at, ids, n in words.encode_column(b.column(2), end_id):
                    coded = b.column(1).slice(at, len(n)).cast(pa.string()).dictionary_encode()
                    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                    order = np.argsort(code, kind="stable")
                    starts = (np.cumsum(n) - n)[order]
                    ids, n = _runs(ids, starts, n[order]), n[order]
                    rows = b.column(0).slice(at, len(n)).take(pa.array(order))
                    edges, ends = np.searchsorted(code[order], np.arange(len(names) + 1)), np.concatenate([[0], np.cumsum(n)])
                    for k, s in enumerate(names):
                        lo, hi = int(edges[k]), int(edges[k + 1])
                        held.setdefault(s, []).append((rows.slice(lo, hi - lo), n[lo:hi], ids[ends[lo]:ends[hi]]))
                        size[s] = size.get(s, 0) + int(ends[hi] - ends[lo])
                        if size[s] >= BATCH:
                            write(s)
                    if sum(size.values()) > HELD:
                        for s in list(held):
                            write(s)
            for s in list(held):
                write(s)
        names = list(written)
        yield pa.RecordBatch.from_arrays([
            pa.array([split] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array([sum(x[1] for x in written[s]) for s in names], pa.int64()),
            pa.array([[x[0] for x in written[s]] for s in names], pa.list_(pa.int32())), pa.array([[x[1] for x in written[s]] for s in names], pa.list_(pa.int64())),
        ], names=["split", "source", "tokens", "numbers", "sizes"])

    df = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return map_arrow(df, run, STATS)


class _Queues:
    """The files of the splits, opened when they are first read; few at a time."""

    OPEN = 64

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def batch(self, split: int, number: int) -> tuple[pa.RecordBatch, type]:
        if split not in self.files:
            if len(self.files) >= self.OPEN:
                self.files.pop(next(iter(self.files)))
            fs, path = open_fs(f"{self.folder}/split-{split:06d}.arrow")
            source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
            self.files[split] = pa.ipc.open_file(source)
        file = self.files[split]
        return file.get_batch(number), np.uint16 if file.schema.metadata[b"bits"] == b"16" else np.uint32

    def read(self, segments: list[dict]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, where its part begins in it, tokens of that part, tokens of the document) and all ids of some segments in a row."""
        docs, starts, parts, sizes, ids = [], [], [], [], []
        for g in segments:
            skip, take = g["skip"], g["take"]
            for number in g["numbers"]:
                b, kind = self.batch(g["split"], number)
                body = b.column(1)
                offsets = np.frombuffer(body.buffers()[1], np.int32, len(body) + 1, 4 * body.offset).astype(np.int64) // kind().itemsize
                data = np.frombuffer(body.buffers()[2], kind)
                edges = offsets - offsets[0]
                lo, hi = skip, min(skip + take, int(edges[-1]))
                first, last = int(np.searchsorted(edges, lo, "right")) - 1, int(np.searchsorted(edges, hi, "left"))
                begin, end = np.maximum(edges[first:last], lo), np.minimum(edges[first + 1:last + 1], hi)
                docs += b.column(0).slice(first, last - first).to_pylist()
                starts.append(begin - edges[first:last])
                parts.append(end - begin)
                sizes.append(np.diff(edges[first:last + 1]))
                ids.append(data[offsets[0] + lo:offsets[0] + hi])
                skip, take = 0, take - (hi - lo)
        return docs, *map(np.concatenate, (starts, parts, sizes, ids))


def _segments(targets: Targets, step: int) -> callable:
    """Parts of (split, source) by the task that serves them; ``step``: tokens of output of a task."""
    tasks = -(-targets.total // step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                due = lambda k: targets.due(r["source"], r["of_source"], k * step)  # noqa: B023, E731
                sizes = np.concatenate([[0], np.cumsum(r["sizes"])])
                at, end = r["first"], r["first"] + r["tokens"]
                task = bisect_right(range(tasks + 1), at, key=due) - 1
                while at < end:
                    stop = min(end, due(task + 1))
                    if stop > at:
                        lo, hi = at - r["first"], stop - r["first"]
                        one, last = int(np.searchsorted(sizes, lo, "right")) - 1, int(np.searchsorted(sizes, hi, "left"))
                        out.append((task, r["source"], r["of_source"], at, r["split"], r["numbers"][one:last], lo - int(sizes[one]), hi - lo))
                    at, task = stop, task + 1
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.int64())
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], names=["task", "source", "of_source", "first", "split", "numbers", "skip", "take"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, keep_space: bool, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seq_len: int = SEQ_LEN, weights: dict[str, float] | None = None, min_piece: int = MIN_PIECE, block: int = BLOCK) -> DataFrame:
    """One row per piece: document, source, its place in the document and in the sequence, and its ids.

    ``weights`` are target token proportions by source; by default those of the whole corpus, so no source runs out
    early.  A source that is exhausted leaves its share to the others, and those without a weight are served when the
    rest is.  Null texts are empty (the end id alone), null sources count as the empty one, null ids stay null, and
    repeated rows are packed as often as they occur; an empty table gives no piece; other columns are ignored, whatever
    their names.  Every id lies in exactly one piece, of a text of any length.  ``block``: rounds that a task holds at a
    time; it bounds memory and changes no row.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    with small_batches(spark):
        stats = materialize(tokenize_splits(spread(docs), f"{folder}/splits", tokenizer, end_id, keep_space, id_col, source_col, text_col), f"{folder}/stats")
    row = stats.agg(F.sum("tokens").alias("total"), F.countDistinct("split").alias("splits")).first()
    total = row.total or 0
    if not total:
        return spark.createDataFrame([], PIECES)
    totals = {}
    if weights:  # a row for each weight given
        totals = {r.source: r.n for r in stats.where(F.col("source").isin(list(weights))).groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    targets = Targets(total, weights, totals, min_piece)
    round_size = ROUND * seq_len
    step = round_size * block

    own = Window.partitionBy("source")  # a row for each split
    queues = stats.withColumn("first", F.sum("tokens").over(own.orderBy("split")) - F.col("tokens")).withColumn("of_source", F.sum("tokens").over(own))
    parts = map_arrow(queues, _segments(targets, step), "task long, source string, of_source long, first long, split int, numbers array<int>, skip long, take long")
    plan = parts.groupBy("task").agg(F.sum("take").alias("tokens"), F.collect_list(F.struct("source", "first", "of_source", "split", "numbers", "skip", "take")).alias("segments"))
    plan = materialize(plan, f"{folder}/plan")
    # tokens before each task, by groups of tasks: few rows meet in the driver, and none of the windows is long
    group = F.expr("task div 4096")
    before, sums = 0, []
    for r in plan.groupBy(group.alias("g")).agg(F.sum("tokens").alias("n")).orderBy("g").collect():
        sums.append((r.g, before))
        before += r.n
    in_group = Window.partitionBy("g").orderBy("task")
    placed = plan.withColumn("g", group).withColumn("inside", F.sum("tokens").over(in_group) - F.col("tokens"))
    placed = placed.join(F.broadcast(spark.createDataFrame(sums, "g long, before_group long")), "g").select("task", "segments", (F.col("before_group") + F.col("inside")).alias("before"))

    edges = tail_edges(total, seq_len)
    full = total // seq_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues = _Queues(f"{folder}/splits")
        for b in batches:
            for k in range(b.num_rows):
                yield from pieces(b.slice(k, 1).to_pylist()[0], queues)

    def pieces(r: dict, queues: _Queues) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[dict]] = {}
        for g in sorted(r["segments"], key=lambda g: (g["source"], g["first"])):
            own.setdefault(g["source"], []).append(g)
        names = list(own)
        docs, starts, parts, sizes, ids, base = [], [], [], [], [], [0]
        for s in names:
            got = queues.read(own[s])
            docs += got[0]
            for x, y in zip((starts, parts, sizes, ids), got[1:]):
                x.append(y)
            base.append(base[-1] + len(got[4]))
        starts, parts, sizes, ids = map(np.concatenate, (starts, parts, sizes, ids))
        begins = np.cumsum(parts) - parts  # of documents, in all queues one after the other
        docs, base = pa.array(docs, pa.int64()), np.array(base)

        # turns of all rounds of the task
        had = [targets.due(s, own[s][0]["of_source"], r["task"] * step) for s in names]
        who, size = [], []
        for out in targets.rounds(r["task"] * step, (r["task"] + 1) * step, round_size):
            now = [targets.due(s, own[s][0]["of_source"], out) for s in names]
            for x, y in zip((who, size), turns([b - a for a, b in zip(had, now)], seq_len, min_piece)):
                x.append(y)
            had = now
        who, size = np.concatenate(who), np.concatenate(size)
        order = np.argsort(who, kind="stable")
        queue_at = np.empty(len(who), np.int64)  # place of a turn in all queues
        queue_at[order] = np.cumsum(size[order]) - size[order]
        out_at = r["before"] + np.cumsum(size) - size  # and in the output

        # cuts: where turns begin, where documents begin and where sequences begin
        turn_of = order[np.searchsorted(queue_at[order], begins, "right") - 1]
        first, last = r["before"], r["before"] + len(ids)
        windows = np.arange(-(-first // seq_len), min(-(-last // seq_len), full) + 1) * seq_len
        cuts = np.unique(np.concatenate([out_at, out_at[turn_of] + begins - queue_at[turn_of], windows, edges]))
        cuts = cuts[(cuts >= first) & (cuts < last)]
        length = np.diff(np.append(cuts, last))
        turn = np.searchsorted(out_at, cuts, "right") - 1
        place = queue_at[turn] + cuts - out_at[turn]
        doc = np.searchsorted(begins, place, "right") - 1
        in_tail = np.searchsorted(edges, cuts, "right") - 1
        tail = cuts >= edges[0]
        sequence = np.where(tail, full + in_tail, cuts // seq_len)
        offset = cuts - np.where(tail, np.array(edges)[np.maximum(in_tail, 0)], cuts // seq_len * seq_len)
        source = pa.array(names, pa.string())
        for at in range(0, len(cuts), 8192):
            x = slice(at, at + 8192)
            body = _runs(ids, place[x], length[x]).astype(np.uint32)
            ends = np.concatenate([[0], 4 * np.cumsum(length[x])]).astype(np.int32)
            d = doc[x]
            longs = [pa.array(v) for v in (starts[d] + place[x] - begins[d], length[x], sizes[d], sequence[x], offset[x])]
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(ends), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(d)), source.take(pa.array(who[turn[x]])), *longs, packed], names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    tasks = min(-(-total // step), max(row.splits, spark.sparkContext.defaultParallelism))
    return map_arrow(placed.repartition(int(tasks), "task"), run, PIECES)
