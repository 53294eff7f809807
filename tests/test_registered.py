"""SQL functions: results and plans of the column forms."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from glasspane.functions import registered


@pytest.fixture(scope="module")
def names(spark):
    return registered.register(spark)


VALUES = {"BIGINT": "id * 977 + 200", "STRING": "CASE id % 4 WHEN 0 THEN 'home/me/a.txt' WHEN 1 THEN 'verified' WHEN 2 THEN 'complete' END", "BINARY": "CASE WHEN id % 5 > 0 THEN unhex(sha2(CAST(id AS STRING), 256)) END", "BOOLEAN": "id % 3 = 0", "INT": "CAST(id % 2 AS INT)"}


@pytest.mark.parametrize("name", sorted(registered.SCALAR))
def test_sql_equals_column(spark, names, name):
    parameters, _, expression = registered.SCALAR[name]
    columns = [p.split() for p in parameters.split(", ")]
    rows = spark.range(40).selectExpr(*[f"{VALUES[kind]} AS {c}" for c, kind in columns])
    rows.createOrReplaceTempView("given")
    by_name = spark.sql(f"SELECT {name}({', '.join(c for c, _ in columns)}) AS x FROM given")
    by_column = rows.select(expression().alias("x"))
    assert [r.x for r in by_name.collect()] == [r.x for r in by_column.collect()]
    plan = by_name._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Join|Aggregate", plan) and plan.count("Project") <= 2  # inlined, nothing but projections


def test_table_function(spark, names):
    got = spark.sql("SELECT * FROM path_leaks(array('home/x', 'a/b', 'C:\\\\x', NULL)) ORDER BY name").collect()
    assert [tuple(r) for r in got] == [("C:\\x", "absolute path with drive letter"), ("home/x", "unix home directory")]
    spark.createDataFrame([(1, ["users/a", "b"]), (2, [])], "id int, names array<string>").createOrReplaceTempView("archives")
    assert [tuple(r) for r in spark.sql("SELECT id, f.leak FROM archives, LATERAL path_leaks(names) f").collect()] == [(1, "windows user path")]
