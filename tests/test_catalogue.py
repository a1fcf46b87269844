"""Every registered query with oracle SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from millrace.plans import catalogue

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def bag(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, small, sql, name):
    relation = sql.sql(catalogue.ORACLE[name])
    columns = sorted(relation.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = sql.sql(f"SELECT {quoted} FROM ({catalogue.ORACLE[name]}) q").fetchall()
    out = catalogue.QUERIES[name](spark, small)
    assert sorted(out.columns) == columns
    assert bag(out.select(*columns).collect()) == bag(expected)


#: Texts without a token, without anything, with headings of their own.
ODD_TEXTS = ["!!! ??? ---", "", None, "# Own\nwords", "  \n # Own words\n#\nmore", "# Own", "plain\n# Own\n", "x\r# Own", "|", "one two"]


@pytest.mark.parametrize("name", ["hashed_vectors", "titles"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(ODD_TEXTS * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    out = catalogue.QUERIES[name](spark, str(tmp_path))
    columns = sorted(out.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = con.sql(f"SELECT {quoted} FROM ({catalogue.ORACLE[name]}) q").fetchall()
    assert bag(out.select(*columns).collect()) == bag(expected)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0
