"""Every query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from sheaf.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(name, spark, duck):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.sql(catalog.oracle_sql()[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=repr)


def test_every_query_has_sql_or_is_listed():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"rand_sample", "approximate_distinct"}


def test_split_blank_gives_the_words_of_every_document(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = [w for w in (r.text or "").replace("\t", " ").split(" ") if w]
        want += [(r.doc_id, k, w) for k, w in enumerate(words, 1)]
    got = catalog.queries()["split_blank"](spark, SF).collect()
    assert len({i for i, _, _ in want}) > 50
    assert sorted((r.doc_id, r.pos, r.word) for r in got) == sorted(want)


def test_the_estimate_of_distinct_keys(spark, duck):
    exact = duck.sql("select count(distinct o_custkey) from orders").fetchall()[0][0]
    assert abs(catalog.queries()["approximate_distinct"](spark, SF).first().n - exact) <= 0.15 * exact
