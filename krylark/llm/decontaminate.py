"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of outer punctuation; numbers, names and units become typed placeholders.
Windows of eight canonical words are hashed on both sides, in two forms: the template, and the folded form, in which
names stand literally and without case, since a copy in capitals or lower case has no names to see.  A window most of
whose words are placeholders even then, and an item of fewer than five words, is hashed by its literal words.  A bit set of fixed size built from the benchmark lets a
scan of the documents pass only windows that may match; those are hash-joined to the benchmark's.  On every
alignment of a document with an item the fixed words must be equal and the placeholders' values must map one to one, and an item counts when such
alignments, in either form, cover half of its windows, so a question with other numbers and names is caught and loose overlap is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, column_type, map_arrow, materialize, small_batches, string_parts

#: Words in a window, and the fewest that have a template.
WIDTH, LEAST_WIDTH = 8, 5
#: Share of an item's windows that must be found.
COVER = 0.5
#: Bits of the window filter, two megabytes, and of the filter of the windows' first two words, 128 kilobytes, whatever the size of the benchmark.
FILTER_BITS, PAIR_BITS = 24, 20
#: Benchmark windows are broadcast up to this many (a counted bound); beyond it the join shuffles both sides.
BROADCAST_WINDOWS = 200_000

#: Unit words, number words, and words that are never names.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees kmh mph kwh watt watts meter meters metre metres kilometer kilometers kilometre kilometres".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
PLAIN = frozenset("a an the this that these those there here it its he she they we you i is are was were be been if when while where what which who whom whose why how and or but nor so for of in on at to from by with without as then than each every some any all no not only find calculate compute solve suppose given let does do did has have had can could will would shall should may might must".split())
NUMERIC = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|[a-zµ°/²³]{1,8})?")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%+-") + "“”„‘’«»…–—¿¡"
SLOTS = {"num": np.uint64(0x9E3779B97F4A7C15), "unit": np.uint64(0xC2B2AE3D27D4EB4F), "name": np.uint64(0x165667B19E3779F9)}
#: Kinds that stand literally in a form; the others are placeholders.
FORMS = {"template": ("word",), "folded": ("word", "name"), "literal": ("word", "name", "num", "unit")}
_FACTORS = np.array([pow(0x2545F4914F6CDD1D, k + 1, 1 << 64) for k in range(WIDTH)], np.uint64)


def canonical(word: str) -> tuple[str, str]:
    """(kind, value) of a word: ``num``, ``unit``, ``name``, ``word``, or an empty value for mere punctuation."""
    value = word.strip(_EDGES)
    low = value.lower()
    if not any(c.isalnum() for c in value):
        return "word", ""
    if low in NUMBERS or NUMERIC.fullmatch(low):
        return "num", low
    if low in UNITS:
        return "unit", low
    if low not in PLAIN and len(value) > 1 and value[0].isupper() and not value.isupper():
        return "name", low
    return "word", low


KINDS = ("", "word", "num", "unit", "name")
#: ``NUMERIC`` for words of ASCII characters alone.
_ASCII_NUMERIC = r"^[+-]?\$?[0-9][0-9.,:/]*(?:%|[a-z/]{1,8})?$"
_BASE = 0x9E3779B97F4A7C55


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A stable even 64-bit hash of every string, never zero: a polynomial of its bytes, mixed."""
    raw, offsets = string_parts(words)
    size = np.diff(offsets)
    longest = int(size.max()) if len(size) else 0
    powers = np.cumprod(np.full(longest + 1, _BASE, np.uint64), dtype=np.uint64)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[place], dtype=np.uint64)])
    h = _mixed(sums[offsets[1:]] - sums[offsets[:-1]] + size.astype(np.uint64))
    h &= ~np.uint64(1)
    h[h == 0] = 2
    return h


def _kinds(words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """``canonical`` of every word: the number of its kind (0 for what is dropped), its value, and that without case."""
    compute = pa.compute
    ascii_ = compute.string_is_ascii(words).to_numpy(zero_copy_only=False)
    plain, other = words.filter(pa.array(ascii_)), words.filter(pa.array(~ascii_)).to_pylist()
    value = compute.utf8_trim(plain, _EDGES)
    low = compute.ascii_lower(value)
    flag = lambda x: x.to_numpy(zero_copy_only=False)
    among = lambda names: flag(compute.is_in(low, value_set=pa.array(sorted(names), low.type)))
    name = flag(compute.match_substring_regex(value, "^[A-Z].*[a-z]")) & ~among(PLAIN)
    kind = np.where(name, 4, 1)
    kind[among(UNITS)] = 3
    kind[among(NUMBERS) | flag(compute.match_substring_regex(low, _ASCII_NUMERIC))] = 2
    kind[~flag(compute.match_substring_regex(value, "[A-Za-z0-9]"))] = 0
    rest = [canonical(w) for w in other]
    kinds = np.zeros(len(words), np.int8)
    kinds[ascii_], kinds[~ascii_] = kind, [KINDS.index(k) if v else 0 for k, v in rest]
    order = pa.array(np.argsort(np.argsort(~ascii_, kind="stable")))
    values = pa.concat_arrays([low, pa.array([v for _, v in rest], low.type)]).take(order)
    folded = pa.concat_arrays([low, pa.array([v.casefold() for _, v in rest], low.type)]).take(order)
    return kinds, values, folded


def codes(words: pa.Array) -> np.ndarray:
    """Stable 64-bit codes of words, a row for each form; zero for what is dropped, odd for placeholders."""
    kinds, values, folded = _kinds(words)
    exact, loose = _word_hashes(values), _word_hashes(folded)
    out = np.empty((len(FORMS), len(words)), np.uint64)
    for row, literal in enumerate(FORMS.values()):
        out[row] = loose if row else exact
        for k in range(1, len(KINDS)):
            if KINDS[k] not in literal:
                out[row, kinds == k] = SLOTS[KINDS[k]] | np.uint64(1)
        out[row, kinds == 0] = 0
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _pairs(code: np.ndarray, form: int) -> np.ndarray:
    """The hash of every two words in a row."""
    return _mixed(code[:-1] * _FACTORS[0] + code[1:] * _FACTORS[1] + np.uint64(form))


def _slots(code: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """How many of the ``width`` words from each place on are placeholders."""
    n = np.zeros(len(first), np.int8)
    for k in range(width):
        n += (code[first + k] & np.uint64(1)).astype(np.int8)
    return n


def _hashes(code: np.ndarray, first: np.ndarray, width: int, form: int) -> np.ndarray:
    h = np.full(len(first), np.uint64(width + 64 * form))
    for k in range(width):
        h += code[first + k] * _FACTORS[k]
    return _mixed(h)


class Words:
    """Canonical words of some texts in a row: the words, and of those that are kept the places, texts and codes by form."""

    def __init__(self, column: pa.Array):
        lists = pa.compute.utf8_split_whitespace(column.cast(pa.large_string()).fill_null(""))
        self.words = lists.flatten()
        coded = self.words.dictionary_encode()
        table, place = codes(coded.dictionary), coded.indices.to_numpy()
        self.kept = np.flatnonzero(table[0, place])
        owner = np.repeat(np.arange(len(column)), lists.value_lengths().to_numpy())
        self.owner, place = owner[self.kept], place[self.kept]
        self.code = [row[place] for row in table]

    def windows(self, width: int, maybe: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """First words of the windows of each form; ``maybe``: the places of each form that are worth a look."""
        n = len(self.kept) - width + 1
        if n <= 0:
            return [np.zeros(0, np.int64)] * len(FORMS)
        out = []
        for form in range(len(FORMS)):
            first = np.arange(n) if maybe is None else maybe[form][maybe[form] < n]
            first = first[self.owner[first] == self.owner[first + width - 1]]
            good = [(width - _slots(self.code[k], first, width) >= (width + 1) // 2) & (width >= LEAST_WIDTH) for k in ((form,) if form < 2 else (0, 1))]
            out.append(first[good[0] if form < 2 else ~(good[0] | good[1])])
        return out

    def texts(self, form: int, first: np.ndarray, width: int) -> tuple[list[str], list[list[str]]]:
        """The fixed words of windows, and the values of their placeholders."""
        fixed, values = [], []
        literal = FORMS[list(FORMS)[form]]
        flat = [canonical(w) for w in self.words.take(pa.array(self.kept[first[:, None] + np.arange(width)].ravel())).to_pylist()]
        for at in range(0, len(flat), width):
            own = flat[at:at + width]
            fixed.append(" ".join((v.casefold() if form else v) if k in literal else f"<{k}>" for k, v in own))
            values.append([f"{k}:{v}" for k, v in own if k not in literal])
        return fixed, values


BENCH = "id {}, at long, form int, hash long, pair long, fixed string, slots array<string>, plain boolean, of int, of_plain int, width int"
HITS = "id {}, text_hash long, at long, form int, hash long, fixed string, slots array<string>"


def _bench_windows(items: DataFrame, id_type) -> DataFrame:
    """All windows of (id, text), each text's of its own width, its length if that is less than ``WIDTH``.

    ``plain``: the window has a template; ``of``, ``of_plain``: how many windows, and how many plain ones, the whole text has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                words = Words(row.column(1))
                width = min(len(words.kept), WIDTH)
                if not width:
                    continue
                forms = words.windows(width)
                every, plain = np.unique(np.concatenate(forms)), set(forms[0].tolist())
                for form, first in enumerate(forms):
                    n = len(first)
                    code = words.code[form]
                    pair = _pairs(code, form)[first] if width > 1 else np.zeros(n, np.uint64)
                    fixed, values = words.texts(form, first, width)
                    columns = [row.column(0).take(pa.array(np.zeros(n, np.int64))), pa.array(first), pa.array([form] * n, pa.int32()), pa.array(_hashes(code, first, width, form).view(np.int64)), pa.array(pair.view(np.int64)), pa.array(fixed, pa.string()), pa.array(values, pa.list_(pa.string()))]
                    columns += [pa.array([f in plain for f in first.tolist()], pa.bool_()), *(pa.array([x] * n, pa.int32()) for x in (len(every), len(plain), width))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "at", "form", "hash", "pair", "fixed", "slots", "plain", "of", "of_plain", "width"])

    return map_arrow(items, run, BENCH.format(id_type.simpleString()))


def _document_windows(docs: DataFrame, id_type, widths: list[int], table: bytes, pairs: bytes) -> DataFrame:
    """The windows of (id, text, text_hash) that pass the filters: first their first two words, then all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pair_bits = np.frombuffer(table, np.uint8), np.frombuffer(pairs, np.uint8)

        def passes(h: np.ndarray, in_bits: np.ndarray, size: int) -> np.ndarray:
            cell = h >> np.uint64(64 - size)
            return np.flatnonzero(in_bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)

        for b in by_bytes(batches, 2 << 20):
            words = Words(b.column(1))
            maybe = [passes(_pairs(c, form), pair_bits, PAIR_BITS) if len(c) > 1 else np.zeros(0, np.int64) for form, c in enumerate(words.code)]
            for width in widths:
                for form, first in enumerate(words.windows(width, maybe if width > 1 else None)):
                    h = _hashes(words.code[form], first, width, form)
                    good = passes(h, bits, FILTER_BITS)
                    if not len(good):
                        continue
                    h, first = h[good], first[good]
                    fixed, values = words.texts(form, first, width)
                    who = pa.array(words.owner[first])
                    n = len(first)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(who), b.column(2).take(who), pa.array(first), pa.array([form] * n, pa.int32()), pa.array(h.view(np.int64)), pa.array(fixed, pa.string()), pa.array(values, pa.list_(pa.string()))], names=["id", "text_hash", "at", "form", "hash", "fixed", "slots"])

    return map_arrow(docs, run, HITS.format(id_type.simpleString()))


def _bit_table(hashes: DataFrame, size: int) -> bytes:
    """A bit for each cell that a hash (column h) falls into; at most as many rows come back as the table has bytes."""
    packed = hashes.groupBy(F.expr(f"cast(shiftrightunsigned(h, {67 - size}) as int)").alias("byte")).agg(F.expr(f"cast(bit_or(1 << cast(shiftrightunsigned(h, {64 - size}) % 8 as int)) as int)").alias("bits"))
    table = np.zeros(1 << (size - 3), np.uint8)
    for r in packed.toLocalIterator():
        table[r.byte] = r.bits
    return table.tobytes()


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cover: float = COVER) -> DataFrame:
    """(id, item, cover) of the documents that hold a benchmark item, literally or with other slot values."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    bench = materialize(_bench_windows(items, column_type(benchmark, item_col)))
    widths = {r.width: r.n for r in bench.groupBy("width").agg(F.count("*").alias("n")).collect()}
    table = _bit_table(bench.select(F.col("hash").alias("h")), FILTER_BITS)
    pairs = _bit_table(bench.where("width > 1").select(F.col("pair").alias("h")), PAIR_BITS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    hits = _document_windows(rows, column_type(docs, id_col), sorted(widths), table, pairs)
    right = bench.select(F.col("id").alias("item"), F.col("at").alias("item_at"), F.col("hash").alias("item_hash"), F.col("fixed").alias("item_fixed"), F.col("slots").alias("item_slots"), F.struct(F.col("at").alias("at"), "plain").alias("place"), F.struct("of", "of_plain").alias("size"))
    if sum(widths.values()) <= BROADCAST_WINDOWS:
        right = F.broadcast(right)
    met = hits.join(right, (F.col("hash") == F.col("item_hash")) & (F.col("fixed") == F.col("item_fixed")))
    met = met.select("id", "text_hash", "item", (F.col("at") - F.col("item_at")).alias("shift"), "form", "place", "size", F.arrays_zip("item_slots", "slots").alias("pairs"))
    # an alignment of a text has at most as many different rows as the item has windows; each form is judged alone
    aligned = met.groupBy("id", "text_hash", "item", "shift", "form").agg(
        F.collect_set("place").alias("places"),
        F.first("size").alias("size"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    n_item, n_doc = (F.expr(f"size(array_distinct(transform(pairs, p -> p.{side})))") for side in ("item_slots", "slots"))
    one_to_one = aligned.where(4 * F.size("pairs") <= 5 * F.least(n_item, n_doc))
    placed = one_to_one.select("id", "text_hash", "item", "size", F.explode("places").alias("place"))
    # of all windows or of those with a template, whichever is more: values that differ hide the others
    share = F.greatest(F.countDistinct("place") / F.first("size.of"), F.countDistinct(F.when(F.col("place.plain"), F.col("place"))) / F.nullif(F.first("size.of_plain"), F.lit(0)))
    covered = placed.groupBy("id", "text_hash", "item").agg(share.alias("cover")).where(F.col("cover") >= cover)
    return covered.groupBy("id", "item").agg(F.max("cover").alias("cover")).select(F.col("id").alias(id_col), "item", "cover")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cover: float = COVER) -> DataFrame:
    """Per row of ``docs``: id, ``contaminated``, ``n_items``, ``items`` (sorted) and the greatest ``cover``.

    Null and empty texts hold nothing; rows that share an id share the verdict, null ids too; items of fewer than
    five words count where they stand word for word; null ones, those without words and repeated ones add nothing; an empty benchmark leaves every document clean.  Other
    columns are ignored.
    """
    found = leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, cover).groupBy(F.col(id_col).alias("found_id")).agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("cover").alias("cover"))
    kind = column_type(benchmark, item_col).simpleString()
    out = docs.select(F.col(id_col).alias("id")).join(found, F.col("id").eqNullSafe(F.col("found_id")), "left")
    return out.select(F.col("id").alias(id_col), F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.expr(f"cast(array() as array<{kind}>)")).alias("items"), F.coalesce("cover", F.lit(0.0)).alias("cover"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cover: float = COVER) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the same columns."""
    # written first, so that its size is known when the join is planned: few leaks are broadcast and no text is shuffled
    with small_batches(docs.sparkSession):
        bad = materialize(leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, cover).select(F.col(id_col).alias("bad_id")).distinct())
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    return row.join(bad, F.col("id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")
