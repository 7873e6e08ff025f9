"""Registered queries against DuckDB SQL, and every stage of the pipeline against brute force."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import same_rows
from test_llm_simhash import brute_components, brute_fingerprint

from krylark.llm import quality_rules
from krylark.llm.common import materialize
from krylark.llm.queries import ORACLE_SQL, QUERIES, vocabulary

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, sf_dir):
    left, right = same_rows(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])
    assert left == right


def whole_ids(texts, name, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary(name))
    return [np.array([*e.ids, end], np.uint32) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_store_query(spark, sf_dir, docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    want, at = [], 0
    for r, ids in zip(rows, whole_ids([r.text for r in rows], "word_bpe_49k.json", 2)):
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = QUERIES["op3_token_store"](spark, sf_dir)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def check_pieces(pieces, rows):
    ids = {r.doc_id: x for r, x in zip(rows, whole_ids([r.text for r in rows], "byte_bpe_50k.json", 0))}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert len(part) == p.length > 0 and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
    assert by_doc.keys() == ids.keys()
    for k, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[k])
    sizes = []
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert all(n <= 1024 and n & (n - 1) == 0 for n in sizes)
    return by_seq


def test_packing_query_mixes_and_pads_nothing(spark, sf_dir, docs):
    pieces = QUERIES["op5_packing"](spark, sf_dir).collect()
    by_seq = check_pieces(pieces, docs.collect())
    total = defaultdict(int)
    for p in pieces:
        total[p.source] += p.length
    everything = sum(total.values())
    gaps = []
    for own in by_seq.values():
        if sum(p.length for p in own) == 1024:
            mix = defaultdict(int)
            for p in own:
                mix[p.source] += p.length
            gaps.append(sum(abs(mix[s] / 1024 - total[s] / everything) for s in total) / 2)
    assert np.mean(gaps) < 0.05


def test_stages_of_the_pipeline(spark, sf_dir, docs):
    columns, now = docs.columns, docs
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before, now = now, materialize(stage(spark, now, sf_dir))
        kept[name] = (before.collect(), now.collect())
        assert k == len(pipeline.STAGES) - 1 or now.columns == columns
    before, after = kept["quality_rules"]
    fails = spark.createDataFrame([(r.doc_id, *quality_rules.measure(r.text or "")) for r in before], ["doc_id", *quality_rules.MEASURES]).where(f"{quality_rules.FAILURES} = 0")
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in fails.collect())
    before, after = kept["simhash_dedup"]
    prints = {r.doc_id: brute_fingerprint(r.text) for r in before}
    roots = brute_components(prints)
    assert sorted(r.doc_id for r in after) == sorted(set(roots.values()))
    before, after = kept["decontamination"]
    bench = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before if any(b in " ".join(r.text.split()) for b in bench)}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert leaked <= gone and len(gone - leaked) <= 1
    before, after = kept["pii"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    check_pieces(kept["packing"][1], after)


def test_run_gives_the_last_stage(spark, sf_dir):
    assert {"doc_id", "sequence_id", "offset"} <= set(pipeline.run(spark, sf_dir).columns)
    assert pipeline.ORACLE_SQL is None and 4 <= len(pipeline.STAGES) <= 5


def test_language_query_on_held_out_rows(spark, sf_dir, docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = QUERIES["op6_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
