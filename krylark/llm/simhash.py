"""SimHash near-duplicates by anchor-point covering.

The 64 bits are dealt into six blocks.  Six *views* of three blocks (32 bits or so) are chosen so that every pair
of blocks lies in some view: if two fingerprints differ in four bits, at most four blocks differ, the other two lie
together in a view, and in that view at most one bit differs.  In each view the anchors are the words of a linear
code whose parity columns are all nonzero five-bit vectors: a Hamming code, covering radius R = 1.  A fingerprint
has one home anchor (within R) and is replicated to every anchor within R + 1, about seventeen; two linked
fingerprints therefore meet at the home anchor of either.  Fingerprints at an anchor are compared there, in blocks, and
only the links of a spanning forest leave it, never all pairs of a group.  An anchor with very many fingerprints is not held by
one task: its fingerprints are dealt into parts, and every pair of parts is compared by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_type, map_arrow, materialize, small_batches, texts
from .components import connected_components

BITS, BLOCKS, RADIUS, THRESHOLD = 64, 6, 1, 4
#: Six triples of six blocks that cover all fifteen pairs of blocks.
VIEWS = ((0, 1, 2), (0, 1, 3), (2, 3, 4), (2, 3, 5), (0, 4, 5), (1, 4, 5))
NGRAM, SEED = 4, 42
#: Fingerprints of an anchor that one task compares; a fuller anchor is compared by pairs of parts of about half as many.
ANCHOR_ROWS = 1 << 16
#: A fingerprint of more than one row in so many is hot; there are at most as many hot ones, so they are broadcast.
HOT_SHARE = 1000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str) -> int:
    """SimHash of the lower-cased word 4-grams, each hashed with XXH64."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").translate(_FOLD).split()
    n = len(words)
    if not n:
        return 0
    if n <= NGRAM:
        grams = [b" ".join(words)]
    else:
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[:n - NGRAM + 1].tolist()
        grams = [line[a:b] for a, b in zip(starts, ends[NGRAM - 1:].tolist())]
    total, count = np.zeros(64, np.int64), len(grams)
    for at in range(0, count, 1 << 16):  # a bounded part of a very long text at a time
        part = grams[at:at + (1 << 16)]
        h = np.fromiter((xxh64_intdigest(g, SEED) for g in part), np.uint64, len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fp: long) for every row; null and empty texts have fingerprint zero."""
    schema = T.StructType([T.StructField(id_col, column_type(docs, id_col)), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts(b.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=[id_col, "text_hash", "fp"])

    return map_arrow(docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("simhash_text")), run, schema)


def _view_bits() -> list[np.ndarray]:
    blocks = np.array_split(np.arange(BITS), BLOCKS)
    return [np.concatenate([blocks[b] for b in view]) for view in VIEWS]


def _codes() -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per view: its mask, the parity columns by bit, the home flip of each syndrome, and its flips within R + 1."""
    out = []
    for bits in _view_bits():
        columns = np.array([1 + i % 31 for i in range(len(bits))])
        masks = [1 << int(b) for b in bits]
        home = np.zeros(32, np.uint64)
        near: list[list[int]] = [[] for _ in range(32)]
        near[0].append(0)
        for i, c in enumerate(columns):
            home[c] = home[c] or masks[i]
            near[c].append(masks[i])
            for j in range(i):
                near[c ^ columns[j]].append(masks[i] | masks[j])
        width = max(map(len, near))
        flips = np.array([x + [x[0]] * (width - len(x)) for x in near], np.uint64)
        out.append((sum(masks), np.stack([bits, columns]), home, flips))
    return out


def _anchors(fp: np.ndarray, codes: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per view: its number, the home anchor of each fingerprint, and all its anchors (a row each, with repeats)."""
    for k, (mask, (bits, columns), home, flips) in enumerate(codes):
        syndrome = np.zeros(len(fp), np.int64)
        for b, c in zip(bits, columns):
            syndrome ^= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) * c
        view = fp & np.uint64(mask)
        yield k, view ^ home[syndrome], view[:, None] ^ flips[syndrome]


def _forest(x: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within the threshold that have a fingerprint at home.

    A search from the homes compares each fingerprint it reaches with those not reached yet, so a dense group, most of
    which is reached at once, costs far less than all its pairs.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(len(x))
    reached = np.zeros(len(x), bool)
    for start in np.flatnonzero(home).tolist():
        if reached[start]:
            continue
        reached[start] = True
        queue = [start]
        while queue:
            p = queue.pop()
            rest = rest[~reached[rest]]
            if not len(rest):
                return out
            others = rest if home[p] else rest[home[rest]]
            near = others[np.bitwise_count(x[others] ^ x[p]) <= THRESHOLD]
            reached[near] = True
            near = near.tolist()
            out.extend((p, q) for q in near)
            queue.extend(near)
    return out


def links(prints: DataFrame) -> DataFrame:
    """(u, v) links between distinct fingerprints (fp: long) that connect all within the threshold."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes()
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                fp = b.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                for k, home, near in _anchors(fp, codes):
                    near = np.sort(near, axis=1)
                    keep = np.concatenate([np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
                    anchor, who = near[keep], np.nonzero(keep)[0]
                    n = len(anchor)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int8)), pa.array(anchor.view(np.int64)), pa.array(fp[who].view(np.int64)), pa.array(anchor == home[who])], names=["view", "anchor", "fp", "home"])

    at = map_arrow(prints.select("fp").distinct(), spread, "view tinyint, anchor long, fp long, home boolean")
    at = at.repartition("view", "anchor").sortWithinPartitions("view", "anchor")
    found = materialize(map_arrow(at, _comparer(2, ANCHOR_ROWS), "u long, v long, view tinyint, anchor long, home boolean"))
    out = found.where("v is not null").select("u", "v").distinct()
    full = found.where("v is null").select("view", "anchor", F.col("u").alias("fp"), "home")
    sizes = full.groupBy("view", "anchor").agg(F.count("*").alias("n"))
    if sizes.isEmpty():
        return out
    # every pair of parts of a full anchor meets in one group
    own = full.join(sizes, ["view", "anchor"]).withColumn("parts", F.ceil(2 * F.col("n") / ANCHOR_ROWS).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("view", "anchor", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp", "home")
    pairs = pairs.repartition("view", "anchor", "low", "high").sortWithinPartitions("view", "anchor", "low", "high")
    return out.unionByName(map_arrow(pairs, _comparer(4, None), "u long, v long, view tinyint, anchor long, home boolean").select("u", "v")).distinct()


def _comparer(keys: int, most: int | None):
    """Links (u, v) of each group of rows (keys, fp, home), which come group by group; the rows of a group of more than ``most`` come back with v null."""
    names = ["u", "v", "view", "anchor", "home"]

    def batch(u, v, view=None, anchor=None, home=None) -> pa.RecordBatch:
        columns = [pa.array(u, pa.int64()), pa.array(v, pa.int64()) if v is not None else pa.nulls(len(u), pa.int64())]
        columns += [pa.array(x, k) if x is not None else pa.nulls(len(u), k) for x, k in ((view, pa.int8()), (anchor, pa.int64()), (home, pa.bool_()))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def linked(columns: list[np.ndarray]) -> pa.RecordBatch:
        fp, home = columns[keys], columns[keys + 1]
        differ = np.zeros(len(fp) - 1, bool)
        for x in columns[:keys]:
            differ |= x[1:] != x[:-1]
        first = np.concatenate([[0], np.flatnonzero(differ) + 1])
        size = np.diff(np.append(first, len(fp)))
        some = np.add.reduceat(home.astype(np.int64), first)
        u, v = [], []
        for at, n in zip(first[(size > 1) & (some > 0)].tolist(), size[(size > 1) & (some > 0)].tolist()):
            x = fp[at:at + n]
            for a, b in _forest(x.view(np.uint64), home[at:at + n]):
                u.append(int(x[a]))
                v.append(int(x[b]))
        return batch(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of one group
        full = None  # the keys of a group that is handed back

        def hand_back(columns: list[np.ndarray]) -> pa.RecordBatch:
            return batch(columns[keys], None, *columns[:2], columns[keys + 1])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(keys + 2)]
            if full is not None:  # the rest of a group that is too full
                same = np.ones(b.num_rows, bool)
                for x, y in zip(now, full):
                    same &= x == y
                n = int(same.sum())
                if n:
                    yield hand_back([x[:n] for x in now])
                    now = [x[n:] for x in now]
                    if not len(now[0]):
                        continue
                full = None
            if held and all((x == y[0]).all() for x, y in zip(now[:keys], held[0])):
                held.append(now)
            else:
                whole = [np.concatenate(x) for x in zip(*held, now)]
                other = np.zeros(len(whole[0]), bool)
                for x in whole[:keys]:
                    other |= x != x[-1]
                last = np.flatnonzero(other)
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:  # the last group may go on in the next batch
                    yield linked([x[:cut] for x in whole])
                held = [[x[cut:] for x in whole]]
            if most is not None and sum(len(x[0]) for x in held) > most:
                full = [x[0] for x in held[0][:keys]]
                for x in held:
                    yield hand_back(x)
                held = []
        if held:
            yield linked([np.concatenate(x) for x in zip(*held)])

    return run


def _written(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    with small_batches(docs.sparkSession):
        return materialize(fingerprints(docs, id_col, text_col))


def _named(prints: DataFrame, id_col: str) -> DataFrame:
    """``prints`` with ``component_id``, the smallest id reachable over links."""
    least = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("rows")))
    found = materialize(connected_components(links(least.select("fp"))))
    smallest = found.join(least, found.node == least.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.join(smallest, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("joined"))
    per_print = materialize(least.join(named, "fp", "left").select("fp", "rows", F.coalesce("joined", "least").alias("component_id")))
    total = per_print.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(per_print.where(F.col("rows") > total / HOT_SHARE).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")))
    marked = prints.join(hot, "fp", "left")
    rest = marked.where("hot is null").drop("hot", "hot_id").join(per_print.select("fp", "component_id"), "fp")
    return marked.where("hot").drop("hot").withColumnRenamed("hot_id", "component_id").unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Rows with equal fingerprints are linked, empty texts (fingerprint zero) among them.  Null ids keep their row and
    never name a component unless all its ids are null; repeated rows each get a row; an empty table gives an empty
    result; other columns are ignored.  Copies are reduced to one fingerprint before anything is compared.
    """
    named = _named(_written(docs, id_col, text_col), id_col)
    return named.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Of rows that share that id the one with the smallest hash of its text stays, and of rows with the same id and text the
    first; rows without an id cannot be named and stay, once for each text.  What goes is joined by id and hash, so
    texts are shuffled once at most, and not at all while few go.
    """
    named = _named(_written(docs, id_col, text_col), id_col).withColumnRenamed(id_col, "own_id")
    keys = materialize(named.groupBy("own_id", "text_hash").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")))
    # only rows with the id that names their group may stay: few a group, while the others go without a look at it
    first = keys.where("own_id = component_id")
    first = materialize(first.join(first.groupBy("component_id").agg(F.min("text_hash").alias("stays")), "component_id"))
    gone = materialize(keys.where("own_id <> component_id").select("own_id", "text_hash").unionByName(first.where("text_hash <> stays").select("own_id", "text_hash")))
    again = materialize(keys.where("own_id is null and rows > 1").select("own_id", "text_hash").unionByName(first.where("text_hash = stays and rows > 1").select("own_id", "text_hash")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("text_hash"))
    kept = row.join(gone, same, "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(row.join(again, same, "left_semi").dropDuplicates(["id", "hash"]))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
