"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import glob
import math
import os
import random

import duckdb
import pytest

from quire.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _rows(columns, rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float, decimal.Decimal)):
            return f"{float(v):.9g}"
        return v.isoformat() if isinstance(v, datetime.datetime) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_escaped_texts_of_odd_rows(spark, tmp_path):
    """Null languages and sources, backslashes, texts that open with a fence: as in the SQL. No text has a soft line break."""
    texts = ["a\\b plain", "```\nx-\n``` more", "```json\n-x\n```", "``` open", "  ```", "x<y & 'z' \"q\"", "\\\\\\\\", None, "", "```", "`-\n```", "\x01\x7f/:*?\"<>|"]
    rows = [(i * len(texts) + j, t, lang, source, None) for i in range(3) for j, t in enumerate(texts) for lang, source in [(("en", "web"), (None, "a\\b"), ("zh", None))[(i + j) % 3]]]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    want = con.execute(ORACLES["escaped_texts"])
    columns = [d[0] for d in want.description]
    got = QUERIES["escaped_texts"](spark, str(tmp_path))
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def _compared(spark, tmp_path, name, table, schema, rows):
    path = str(tmp_path / f"{table}.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{path}/*.parquet')")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, str(tmp_path))
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def test_escaped_texts_keep_line_separators(spark, tmp_path):
    rows = [(i, "plain <text>", lang, "web", None) for i, lang in enumerate(["en", "a\u2028b", "\u2029"])]
    _compared(spark, tmp_path, "escaped_texts", "documents", "doc_id long, text string, lang string, source string, n_chars long", rows)


def test_page_gates_of_odd_rows(spark, tmp_path):
    """Nulls in any column, negative keys and quantities, none at all: as in the SQL."""
    rng = random.Random(3)
    odd = lambda value, share=0.15: None if rng.random() < share else value
    rows = [
        (odd(page, 0.03), odd(n, 0.05), odd(rng.randint(-40, 400)), odd(rng.randint(-20, 200)), odd(float(rng.choice([-9, 0, 1, 12, 50]))), odd(rng.choice(["A", "N", "RX", ""])), odd(rng.choice("FO")))
        for page in range(-60, 1200) for n in range(1, 2 + page % 4)
    ]
    _compared(spark, tmp_path, "page_gates", "lineitem", "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string", rows)
