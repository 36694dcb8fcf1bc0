"""The test tables seen as an index: entities, usage, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc_id, source, display_name, category, publisher, kind, launch_kind, launch_target, summary, tasks,
    synonyms, details, features, text; the details are the whole text."""
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    both = d.join(p, d.doc_id == p.p_partkey)
    squashed = F.regexp_replace("p_name", " ", "")
    return both.select(
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("id"), "doc_id", "source", F.col("p_name").alias("display_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("publisher"),
        (F.col("p_size") % 8).alias("kind"), (F.col("p_size") % 6).alias("launch_kind"), F.concat(F.when(F.col("p_size") % 5 == 0, "C:\\Windows\\").otherwise("D:\\Tools\\"), squashed, F.lit(".exe")).alias("launch_target"),
        F.regexp_extract("text", r"^([^.\n]*)", 1).alias("summary"), F.array(F.lower("p_type"), F.concat(F.lit("open "), "p_name")).alias("tasks"), F.array("p_brand", F.col("lang")).alias("synonyms"),
        F.col("text").alias("details"), F.concat_ws(", ", "p_type", "p_brand").alias("features"), "text",
    )


ENTITIES_SQL = r"""ents AS (SELECT d.source || ':' || d.doc_id AS id, d.doc_id, d.source, p.p_name AS display_name, p.p_type AS category, p.p_brand AS publisher, p.p_size % 8 AS kind, p.p_size % 6 AS launch_kind,
 CASE WHEN p.p_size % 5 = 0 THEN 'C:\Windows\' ELSE 'D:\Tools\' END || replace(p.p_name, ' ', '') || '.exe' AS launch_target, regexp_extract(d.text, '^([^.\n]*)', 1) AS summary,
 [lower(p.p_type), 'open ' || p.p_name] AS tasks, [p.p_brand, d.lang] AS synonyms, d.text AS details, p.p_type || ', ' || p.p_brand AS features, d.text FROM documents d JOIN part p ON p.p_partkey = d.doc_id)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, launch_count, last_launched_at) from clicks."""
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'")
    return clicks.groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("launch_count"), F.max("ts").cast("timestamp").alias("last_launched_at"))


USAGE_SQL = "usage AS (SELECT user_id AS doc_id, count(*) AS launch_count, max(ts) AS last_launched_at FROM events WHERE event_type = 'click' GROUP BY user_id)"
AS_OF = "2024-02-01 00:00:00"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 is a query against all."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
