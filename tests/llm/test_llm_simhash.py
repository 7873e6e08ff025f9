import re

import numpy as np
import pytest
import xxhash

from krylark.llm import simhash
from krylark.llm.components import connected_components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(prints):
    """{id: smallest id reachable} over pairs of at most four differing bits."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 4):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_views_cover_all_pairs_of_blocks():
    pairs = {tuple(sorted((a, b))) for v in simhash.VIEWS for a in v for b in v if a != b}
    assert len(pairs) == 15


def test_the_anchors_are_a_covering_code():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 500, np.uint64)
    for k, home, near in simhash._anchors(fp, simhash._codes()):
        mask = np.uint64(simhash._codes()[k][0])
        assert (np.bitwise_count((fp & mask) ^ home) <= simhash.RADIUS).all()
        assert (np.bitwise_count((fp & mask)[:, None] ^ near) <= simhash.RADIUS + 1).all()
        assert (near == home[:, None]).any(axis=1).all()


def test_every_pair_within_four_bits_meets():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 3000, np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    met = np.zeros(3000, bool)
    codes = simhash._codes()
    for (_, home, _), (_, _, near) in zip(simhash._anchors(a, codes), simhash._anchors(b, codes)):
        met |= (near == home[:, None]).any(axis=1)
    assert met.all()


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    texts = [None, "", " \n", "one", "One TWO three", "A b c d"]
    for _ in range(40):
        base = list(rng.choice(words, 120))
        for copy in range(4):
            own = list(base)
            for _ in range(copy):
                own[rng.integers(len(own))] = str(rng.choice(words))
            texts.append(" ".join(own))
    texts += texts[-3:] + ["x " * 30000]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)
    assert got[0].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == 0
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(brute_components(prints).values())


def test_large_group_is_one_component(spark):
    """A chain of near copies and a hub with many neighbours."""
    base = 0x0123456789ABCDEF
    chain = [base ^ ((1 << (3 * k)) - 1) for k in range(20)]
    hub = [0xF0F0F0F0F0F0F0F0 ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    signed = [x - (1 << 64) if x >> 63 else x for x in chain + hub]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # anchors go over the edges of batches
    links = simhash.links(spark.createDataFrame([(x,) for x in set(signed)], "fp long")).persist()
    assert links.count() < 60 * len(signed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert len({roots[x] for x in signed[:20]}) == 1 and len({roots[x] for x in signed[20:]}) == 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + k] for k in range(50)} == {1000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f")]])
def test_empty_table_null_ids_and_repeated_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    if rows:
        assert {r.component_id for r in got if r.fingerprint != "0" * 16} == {3}
        assert sum(r.doc_id == 3 for r in simhash.drop_near_duplicates(df).collect()) == 1


def test_repeated_ids_with_other_texts(spark):
    rows = [(3, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "quite another text than that", 3), (5, "quite another text than that", 4), (7, "A B c d e f", 5), (None, "a b c d e f", 6), (None, "a b c d e f", 7), (9, None, 8), (9, "", 9)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, row int"))
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str)
    assert got == [(3, "a b c d e f"), (5, "quite another text than that"), (9, ""), (None, "a b c d e f")]


def test_full_anchors_are_compared_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, np.uint64)
    prints = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (25, 2))} | {1 << k for k in range(60)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    want = brute_components({x: x for x in prints})
    for most in (1 << 16, 6):
        monkeypatch.setattr(simhash, "ANCHOR_ROWS", most)
        roots = {r.node % (1 << 64): r.root for r in connected_components(simhash.links(df)).collect()}
        got = {}
        for x in prints:
            got.setdefault(roots.get(x, x), set()).add(x)
        groups = {}
        for x, r in want.items():
            groups.setdefault(r, set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
