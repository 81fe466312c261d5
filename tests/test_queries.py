"""The registry: every query with SQL is a query, and the entry works without the training-data subpackage."""

import subprocess
import sys
import textwrap

import duckdb
import pytest

import __spark_entry__
from textloom import queries


def test_sql_has_its_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_patch_has_a_query():
    from textloom.plans.spec import FIELDS

    covered = {p["op"] for _, p, _ in (*queries.PATCHES, *queries.TEXT, *queries.FILES, *queries.JSON)} | {"plugin", "exec", "ai-transform"}
    assert covered == set(FIELDS)


def test_entry_without_the_subpackage():
    code = """
        import sys

        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name.startswith(("textloom.llm", "corpus_pipeline")):
                    raise ModuleNotFoundError(name)

        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert "flagship" in e.queries() and "pipeline" not in e.queries() and not any(k.startswith("op8") for k in e.oracle_sql())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True)


def test_flagship_runs(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["doc_id", "path", "content", "applied", "warnings", "errors"]
    assert out.filter("errors > 0 OR warnings <> 1").count() == 0


@pytest.mark.parametrize("name", ["streamed", "configured", "scanned", "cleaned", "recovered"])
def test_query_equals_its_sql(spark, name):
    """Of a query that lost rows, or whose reading and writing changed."""
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    out = queries.queries()[name](spark, folder)
    told = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, told)) == sorted(repr(tuple(r)) for r in out.collect())
    assert name != "streamed" or len(told) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
