"""What lets registered queries keep up with larger tables: files worked out once, and ties as SQL breaks them."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from glasspane.operators import archives, headers
from glasspane.plans.oracles import ORACLES
from glasspane.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headers_are_made_once(spark):
    got = plan(QUERIES["header_validation"](spark, DATA))
    assert got.count("regexp_replace(c_name") == 4 and "Repartition" in got  # one header has the name at four places; there were 704


def test_no_header_ends(spark):
    rows = spark.createDataFrame([(None,), (b"",)], "d binary").select(headers.header_fields(F.col("d")).alias("h"))
    assert [r.h.error for r in rows.collect()] == ["signed missing"] * 2


def test_payloads_are_split_once(spark):
    got = plan(QUERIES["exchange_payloads"](spark, DATA))
    assert got.count("split(") == 1 and "Repartition" in got  # 272 copies of the payload before


def test_ties_of_entries_are_as_in_sql(spark, tmp_path):
    lines = [(1, p, s, n) for n in (2, 1) for p in (9, 4) for s in (0, 1, 2, 3)] + [(7, 9, 0, 1)]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("zip_entries", "zip_findings"):
        want = con.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(repr(tuple(r[c] for c in columns)) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(map(repr, want.fetchall())), name


def test_members_walk_their_archive_once(spark):
    files = spark.createDataFrame([(1, b"PK")], "key int, content binary").repartition(1)
    got = plan(archives.members(files, "key"))
    assert got.count("no end record") == 1  # an inner explode brought a filter that walked the directory again
