"""Every query with SQL gives the rows that DuckDB gives over the same tables."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from gleanery.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    if name not in catalog.SQL:
        assert rows
        return
    result = duck.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())


@pytest.mark.parametrize("files", [3, 1_001])
def test_the_shared_index_follows_rewritten_files(spark, tmp_path, files):
    (tmp_path / "documents.parquet").mkdir()
    for word in ("alpha", "gamma"):
        for i in range(files):
            pq.write_table(pa.table({"doc_id": [i], "text": [word]}), tmp_path / "documents.parquet" / f"{i}.parquet")
        found = catalog.tokens_tf(spark, str(tmp_path)).groupBy("term").count().collect()
        assert [tuple(r) for r in found] == [(word, files)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_relevant_documents_are_looked_for_once(spark):
    """measures read the relevant documents twice, and each time all texts were searched for all passages."""
    _, qrels = catalog.run_and_qrels(spark, SF)
    assert qrels.inputFiles() and all("/qrels-" in f for f in qrels.inputFiles())
