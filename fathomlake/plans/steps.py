"""Queries over questions of several steps; registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.operators import hops
from fathomlake.plans.catalogue import query, table

NOW = "2024-01-01"


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def customers_asked(spark: SparkSession, d: str) -> DataFrame:
    """Customers as subjects of questions in four forms, with the sources that answer them and what these say."""
    k = F.col("c_custkey")
    letters = F.concat(*(F.substr(F.lit("abcdefghij"), F.floor(k / n) % 10 + 1, F.lit(1)) for n in (1000, 100, 10, 1)))
    name = _say("Ann ", F.initcap(F.concat(F.lit("m"), letters)))
    birth = F.date_add(F.lit("1950-01-15").cast("date"), (k * 13 % 9000).cast("int"))
    wed = F.date_add(F.lit("1985-06-01").cast("date"), (k * 7 % 5000).cast("int"))
    long = lambda c: F.date_format(c, "MMMM d, yyyy")
    kind = k % 4
    question = F.when(kind == 0, _say("How old was ", name, " when Tom and Ruth got married?")).when(kind == 1, _say("What year did ", name, " sell the shop?"))
    question = question.when(kind == 2, _say("If the ", name, " Run took place on the Harbour Wall how many rounds is it? Round to the nearest tenth.")).otherwise(_say("How long has ", name, " been the mayor?"))
    year, run, wall = (1960 + k % 50).cast("string"), (10 + k % 30).cast("string"), (2 + k % 3).cast("string")
    text = F.when(kind == 0, _say(name, " was born ", long(birth), ". Tom Reed and Ruth Vance married on ", long(wed), "."))
    text = text.when(kind == 1, _say("It was founded in 1901. She sold the shop in ", year, ".")).when(kind == 2, _say("The ", name, " Run covers ", run, ".5 miles. The Harbour Wall is ", wall, ".2 miles long."))
    text = text.otherwise(_say(name, " has been mayor since ", long(wed), "."))
    lead = F.when(kind == 0, F.floor(F.months_between(wed, birth) / 12).cast("string")).when(kind == 1, year)
    lead = lead.when(kind == 2, F.format_string("%.1f", F.round((10.5 + k % 30) / (2.2 + k % 3), 1))).otherwise(F.floor(F.months_between(F.lit(NOW).cast("date"), wed) / 12).cast("string"))
    rows = table(spark, d, "customer")
    return rows.select(k.alias("q_id"), question.alias("question"), F.concat_ws(" ", text, F.lit("More of"), "c_name", F.lit("here.")).alias("text"), lead.alias("lead"))


def expected(spark: SparkSession, d: str) -> DataFrame:
    return customers_asked(spark, d).select("q_id", "lead")


@query("""WITH c AS (SELECT c_custkey AS k, DATE '1950-01-15' + CAST(c_custkey * 13 % 9000 AS INTEGER) AS birth, DATE '1985-06-01' + CAST(c_custkey * 7 % 5000 AS INTEGER) AS wed FROM customer)
SELECT k AS q_id, CASE k % 4 WHEN 0 THEN 'age' WHEN 1 THEN 'year' WHEN 2 THEN 'ratio' ELSE 'tenure' END AS kind, CASE k % 4 WHEN 0 THEN CAST(date_sub('year', birth, wed) AS VARCHAR) WHEN 1 THEN CAST(1960 + k % 50 AS VARCHAR)
  WHEN 2 THEN format('{:.1f}', round((10.5::DOUBLE + k % 30) / (2.2::DOUBLE + k % 3), 1)) ELSE CAST(date_sub('year', wed, DATE '2024-01-01') AS VARCHAR) END AS lead FROM c""")
def hop_answers(spark: SparkSession, d: str) -> DataFrame:
    asked = customers_asked(spark, d)
    evidence = asked.select("q_id", F.lit(1).alias("source"), "text")
    questions = asked.select("q_id", "question", F.col("q_id").alias("scope"))
    return hops.answers(questions, evidence.withColumnRenamed("q_id", "scope"), "q_id", "question", "scope", "source", "text", F.lit(NOW).cast("date")).select("q_id", "kind", "lead")


@query("""SELECT c_custkey AS q_id, 'team captain of the club that won the cup ' || CAST(1950 + c_custkey % 60 AS VARCHAR) AS search FROM customer""")
def bound_searches(spark: SparkSession, d: str) -> DataFrame:
    """Questions about the year of a customer's birth, bound by what a source says of it."""
    k = F.col("c_custkey")
    name = _say("Ann Bell", k.cast("string"))
    rows = table(spark, d, "customer").select(k.alias("q_id"), k.alias("scope"), _say("Who was team captain of the club that won the cup the year ", name, " was born?").alias("question"), _say(name, " was born in ", (1950 + k % 60).cast("string"), ". She won in 2011.").alias("text"))
    return hops.next_searches(rows, rows.withColumn("source", F.lit(1)), "q_id", "question", "scope", "source", "text")
