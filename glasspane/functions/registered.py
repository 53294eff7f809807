"""The column functions as SQL functions of a session, so that SQL users call them by name.

Each is a temporary SQL function whose body is the SQL text of the column
expression; the optimizer puts the body where it is called, so a query with it
has the plan of the column form, without a Python node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glasspane.functions import keys, lengths, text, verdicts

_C = F.col
#: Name: parameters, result, and the expression over columns named like the parameters.
SCALAR: dict[str, tuple[str, str, Callable[[], Column]]] = {
    "size_class": ("length BIGINT", "BIGINT", lambda: lengths.size_class(_C("length"))),
    "size_padding": ("length BIGINT", "BIGINT", lambda: lengths.padding(_C("length"))),
    "chunk_count": ("length BIGINT", "BIGINT", lambda: lengths.chunk_count(_C("length"))),
    "cipher_length": ("length BIGINT", "BIGINT", lambda: lengths.cipher_length(_C("length"))),
    "key_fingerprint": ("enc BINARY, sig BINARY, pq BINARY", "BINARY", lambda: keys.fingerprint(_C("enc"), _C("sig"), _C("pq"))),
    "path_leak": ("name STRING", "STRING", lambda: text.path_leak(_C("name"))),
    "points_outside": ("reference STRING", "BOOLEAN", lambda: text.points_outside(_C("reference"))),
    "human_size": ("bytes BIGINT", "STRING", lambda: text.human_size(_C("bytes"))),
    "cleaned_name": ("name STRING", "STRING", lambda: text.cleaned_name(_C("name"))),
    "verdict_received": ("understood BOOLEAN, findings INT, readable BOOLEAN", "STRING", lambda: verdicts.received(_C("understood"), _C("findings"), _C("readable"))),
    "verdict_cleaning": ("outcome STRING", "STRING", lambda: verdicts.cleaning(_C("outcome"))),
    "verdict_sender": ("case_ STRING", "STRING", lambda: verdicts.sender(_C("case_"))),
    "verdict_contact": ("state STRING", "STRING", lambda: verdicts.contact(_C("state"))),
}
#: Table functions: parameters, result and query.
TABLE: dict[str, tuple[str, str, str]] = {
    "path_leaks": ("names ARRAY<STRING>", "name STRING, leak STRING", "SELECT name, path_leak(name) FROM (SELECT explode(names) AS name) WHERE path_leak(name) IS NOT NULL"),
}


def sql_text(spark: SparkSession, parameters: str, expression: Column) -> str:
    """The SQL text of an expression over columns that have the names and types of the parameters."""
    plan = spark.createDataFrame([], parameters).select(expression)._jdf.queryExecution().analyzed()
    alias = plan.expressions().head()
    return (alias.child() if alias.nodeName() == "Alias" else alias).sql()


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the functions in the session, anew where they exist; gives their names."""
    for name, (parameters, result, expression) in SCALAR.items():
        body = sql_text(spark, parameters, expression())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN CAST({body} AS {result})")
    for name, (parameters, result, body) in TABLE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({result}) RETURN {body.replace('path_leak(', f'{prefix}path_leak(')}")
    return [prefix + name for name in (*SCALAR, *TABLE)]
