"""The pipeline over a small folder of tables."""

import corpus_pipeline
import pytest

from tests.llm.test_operators import DOCS, SCHEMA, prose


def test_stages_take_effect(spark, tmp_path):
    leak = prose(400, 30)
    texts = [(i, prose(i, 60), "en", f"s{i % 3}") for i in range(200, 260)]
    extra = [(300, prose(300, 20) + " " + leak, "en", "s0"), (301, prose(301, 30) + " mail me@x.org now", "en", "s1"),
             (302, "12 34 %%", "en", "s1")]
    df = spark.createDataFrame(DOCS + texts + extra, SCHEMA).selectExpr("*", "length(text) AS n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in docs.collect()})
        if name != "source_weights":
            assert docs.columns == df.columns
    raw, known, single, clean, private, mixed = ids
    assert raw - known >= {4, 5, 6, 9, 302}
    assert 2 not in single and None not in single and 1 in single
    assert single - clean == {300}
    assert private == clean and mixed <= private
    marked = spark.read.parquet(f"{tmp_path}/personal_data").filter("doc_id = 301").first()
    assert "me@x.org" not in marked.text and "<EMAIL>" in marked.text and marked.n_chars == len(marked.text)
    assert docs.filter("mix_times < 1").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


HIDDEN = ["__fp", "__lang", "__share", "__long", "__leaks", "__doc", "__print", "__source", "__goal", "__all", "__text",
          "__found", "__email", "_kept_0"]


@pytest.mark.parametrize("rows", ["none", "some"])
def test_stages_take_empty_tables_long_texts_and_clashing_names(spark, tmp_path, rows):
    """Columns named like those the operators use for a while come back as they were."""
    long = " ".join([prose(800, 500)] * 60)
    texts = DOCS + [(310, long, "en", "s0"), (311, long + " end", "en", "s1")] + [(i, prose(i, 40), "en", "b") for i in range(400, 420)]
    df = spark.createDataFrame(texts if rows == "some" else [], SCHEMA).selectExpr(
        "*", "length(text) AS n_chars", *[f"concat('{c}', doc_id) AS {c}" for c in HIDDEN])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, prose(900, 20)), (None, None), (2, "")] if rows == "some" else []
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns[: len(df.columns)] == df.columns
        kept = docs.collect()
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in kept for c in HIDDEN)
        assert bool(kept) == (rows == "some")
