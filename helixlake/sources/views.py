"""Workbench views over the star-schema tables, as DataFrames and as SQL of the same meaning.

The tables hold no laboratory data; each view reads columns of theirs as a workbench relation
(reads of a selection campaign, cells, omics rows, assays, runs, articles, sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign reads: (variant, family, round, replicate, reads) from event counts by week and user."""
    e = table(spark, sf_dir, "events")
    week = F.floor(F.date_diff(F.col("ts"), F.lit("2024-01-01")) / 7).cast("int")
    return e.groupBy(F.col("event_type").alias("variant"), week.alias("round"), (F.col("user_id") % 3).cast("int").alias("replicate")).agg(F.count("*").alias("reads")).withColumn("family", F.substring("variant", 1, 1))


READS = """reads AS (SELECT event_type AS variant, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) AS round,
  CAST(user_id % 3 AS INTEGER) AS replicate, count(*) AS reads, substr(event_type, 1, 1) AS family FROM events GROUP BY ALL)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells: (cell, cluster, v, x, y), expression in doubles and the first two as the place."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("cluster"), v.alias("v"))
    return e.withColumns({"x": F.element_at("v", 1), "y": F.element_at("v", 2)})


CELLS = "cells AS (SELECT vec_id AS cell, label AS cluster, CAST(embedding AS DOUBLE[]) AS v, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in long form: (cell, cluster, gene, value)."""
    return cells(spark, sf_dir).select("cell", "cluster", F.posexplode("v").alias("gene", "value"))


EXPRESSION = CELLS + ", expression AS (SELECT cell, cluster, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS gene, unnest(v) AS value FROM cells)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count matrix in long form: (cell, gene, count), users by event type."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("gene")).count()


COUNTS = "counts AS (SELECT user_id AS cell, event_type AS gene, count(*) AS count FROM events GROUP BY ALL)"


def omics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Omics rows by part: (gene, transcript, protein, metabolite, fold_change, p_value)."""
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(
        F.avg("l_quantity").alias("transcript"),
        (F.avg("l_extendedprice") / 1000).alias("protein"),
        (F.avg("l_discount") * 100).alias("metabolite"),
        F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("a"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)).alias("b"),
        F.count("*").alias("n"),
    )
    return q.select("gene", "transcript", "protein", "metabolite", F.log2((F.col("a") + 1) / (F.col("b") + 1)).alias("fold_change"), F.exp(-F.col("n") / 8.0).alias("p_value"))


OMICS = """omics AS (SELECT gene, transcript, protein, metabolite, log2((a + 1) / (b + 1)) AS fold_change, exp(-n / 8.0) AS p_value FROM (
  SELECT l_partkey AS gene, avg(l_quantity) AS transcript, avg(l_extendedprice) / 1000 AS protein, avg(l_discount) * 100 AS metabolite,
    sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END) AS a, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0.0 END) AS b, count(*) AS n
  FROM lineitem GROUP BY l_partkey))"""


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assay rows: (sample, strain, condition, yield, biomass) from orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("strain"), F.col("o_orderstatus").alias("condition"),
        F.col("o_totalprice").alias("yield"), ((F.col("o_custkey") % 10) / 10.0).alias("biomass"),
    )


ASSAYS = "assays AS (SELECT o_orderkey AS sample, o_orderpriority AS strain, o_orderstatus AS condition, o_totalprice AS yield, (o_custkey % 10) / 10.0 AS biomass FROM orders)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run artifacts: (project, tool, created, revision, status) from orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("tool"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("revision"), F.col("o_orderstatus").alias("status")
    )


RUNS = "runs AS (SELECT o_custkey AS project, o_orderpriority AS tool, o_orderdate AS created, o_orderkey AS revision, o_orderstatus AS status FROM orders)"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: (id, title, abstract, source); the title is the first line."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.trim(F.element_at(F.split("text", "\n"), 1)).alias("title"), F.col("text").alias("abstract"), "source")


ARTICLES = "articles AS (SELECT doc_id AS id, trim(string_split(text, chr(10))[1]) AS title, text AS abstract, source FROM documents)"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences: (id, seq), the letters A, C, G and T of a text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "").alias("seq"))


DNA = "dna AS (SELECT doc_id AS id, regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g') AS seq FROM documents)"


def uptake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uptake scenarios: (scenario, glucose, oxygen) from suppliers, both within 0 to 25."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scenario"), F.least(F.abs("s_acctbal") / 400, F.lit(25.0)).alias("glucose"), ((F.col("s_suppkey") * 7) % 26).cast("double").alias("oxygen"))


UPTAKE = "uptake AS (SELECT s_suppkey AS scenario, least(abs(s_acctbal) / 400, 25.0) AS glucose, CAST((s_suppkey * 7) % 26 AS DOUBLE) AS oxygen FROM supplier)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design variants: (variant, family, activity, stability, burden) from parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant"), F.col("p_brand").alias("family"), (F.col("p_size") * 2.0).alias("activity"), (F.col("p_retailprice") % 100).alias("stability"), (F.col("p_partkey") % 6).alias("burden"))


VARIANTS = "variants AS (SELECT p_partkey AS variant, p_brand AS family, p_size * 2.0 AS activity, p_retailprice % 100 AS stability, p_partkey % 6 AS burden FROM part)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controller signals: (run, step, value), a user's event values in their order of time."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), "value")


SIGNALS = "signals AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value FROM events)"
