"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, text_in string, component_id long, kept boolean, contaminated boolean"
GOOD = " ".join(f"word{k} and thing{k}," for k in range(30))


def rows():
    long = " ".join(f"token{k}" for k in range(60_000))
    texts = [(1, GOOD), (1, GOOD), (2, GOOD), (3, GOOD.replace("word7", "other")), (4, None), (5, ""), (None, GOOD + " more"), (None, GOOD + " more"), (6, f"{GOOD} write to bob@x.io now"), (7, long), (8, "too short")]
    return [(d, t, None, None if d == 2 else "s", len(t or ""), "mine", "own", 5, True, None) for d, t in texts]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, "an item that nobody has ever written down in any of these texts"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_take_odd_rows(spark, folder, name, stage):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = stage(spark, docs, folder)
    got = out.collect()
    if name != "packing":
        assert out.columns == docs.columns
        assert {(r.row, r.text_in, r.component_id, r.kept, r.contaminated) for r in got} == {("mine", "own", 5, True, None)}
    by = sorted((str(r.doc_id) for r in got), key=str)
    if name == "quality_rules":
        assert by == sorted(["1", "1", "2", "3", "None", "None", "6", "7"])
    elif name == "simhash_dedup":
        assert set(by) >= {"1", "4", "7", "8", "None"} and by.count("1") == by.count("None") == 1 and "2" not in by and "5" not in by
    elif name == "decontamination":
        assert len(got) == len(rows())
    elif name == "pii":
        texts = {r.doc_id: r for r in got}
        assert len(got) == len(rows()) and "bob@" not in texts[6].text and texts[6].n_chars == len(texts[6].text) and texts[4].text is None and texts[7].text == rows()[9][1]
    else:
        whole = {}
        for r in got:
            whole.setdefault((r.doc_id, r.doc_tokens), 0)
            whole[r.doc_id, r.doc_tokens] += r.length
        assert whole[4, 1] == whole[5, 1] == 1 and set(by) == {str(r[0]) for r in rows()}
        assert all(n % k == 0 for (_, k), n in whole.items())
    assert stage(spark, docs.where("false"), folder).count() == 0


def test_tables_between_stages_are_deleted(spark, sf_dir):
    from pathlib import Path

    from krylark.llm.common import materialize, read_table, shared_dir, discard

    path = shared_dir(spark)
    materialize(read_table(spark, sf_dir, "benchmark"), path)
    assert Path(path.removeprefix("file://")).exists()
    discard(spark, path)
    assert not Path(path.removeprefix("file://")).exists()
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(root.iterdir())
    assert pipeline.run(spark, sf_dir).count() > 0
    made = [p for p in set(root.iterdir()) - before if any(f.name.startswith("part-") for f in p.iterdir() if f.is_file())]
    texts = [p for p in made if {"text", "lang", "source"} <= set(spark.read.parquet(f"file://{p}").columns)]
    assert len(texts) == 1  # what the last stage read
