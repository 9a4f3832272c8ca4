"""Every query over tables of edge cases, over empty tables, and twice over the same table."""

import pytest

from kerbline.llm.queries import QUERIES
from corpus_pipeline import STAGES, run

PER_DOCUMENT = [n for n in QUERIES if n not in ("op3_language_id", "op8_metric_topk", "op11_whitening", "op13_url_filter")]


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, edge_dir, edge_rows, name):
    got = QUERIES[name](spark, edge_dir).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in edge_rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_reruns_agree(spark, edge_dir, name):
    assert rows(QUERIES[name](spark, edge_dir)) == rows(QUERIES[name](spark, edge_dir))


def test_pages_keep_their_rows(spark, edge_dir):
    got = QUERIES["op3_language_id"](spark, edge_dir).collect()
    assert len(got) == 6
    assert {r["host"] for r in got} == {"a.example.de", "", "b.example.de"}


def test_addresses_keep_their_rows(spark, edge_dir):
    got = QUERIES["op13_url_filter"](spark, edge_dir).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(["1", "2", "None", "3", "1", "4"])


def test_pipeline_on_empty_tables(spark, empty_dir):
    assert run(spark, empty_dir).count() == 0


def test_pipeline_stages_keep_the_columns(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, edge_dir)
        assert out.columns == docs.columns, name
        docs = out
    last = STAGES[-1][1](spark, docs, edge_dir)
    assert all(r["decodes"] for r in last.select("decodes").collect())
