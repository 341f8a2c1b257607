"""Functions of the library for use from SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fathomlake.operators.figures import figures_of

from .text import answer_key


@F.udtf(returnType="start int, unit string, amount double, display string, label string")
class Figures:
    """The figures of a text, a row each."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from figures_of(text) if text else ()


#: SQL functions by name: parameters, result and body; Catalyst inlines them.
SQL_FUNCTIONS = {
    "host_of": ("url STRING", "STRING", r"regexp_replace(lower(regexp_extract(coalesce(url, ''), r'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), r'^www\.', '')"),
    "collapsed": ("s STRING", "STRING", r"trim(regexp_replace(s, r'[ \t\n\r\f\x0b]+', ' '))"),
    "salted_hash": ("salt STRING, value STRING", "STRING", "sha2(concat(salt, value), 256)"),
    "round_cents": ("x DOUBLE", "DOUBLE", "floor(x * 100 + 0.5D) / 100D"),
    "chars_to_tokens": ("chars BIGINT", "BIGINT", "CASE WHEN chars > 0 THEN ceil(chars / 4) ELSE 0 END"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers answer_key, the table function figures, and the SQL functions for the session; their names."""
    spark.udf.register("answer_key", answer_key)
    spark.udtf.register("figures", Figures)
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return ["answer_key", "figures", *SQL_FUNCTIONS]
