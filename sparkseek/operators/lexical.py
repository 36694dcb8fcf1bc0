"""Full text: what is indexed, the phrases of queries, document frequencies.  Postings are in ``postings``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import porter
from ..functions.text import fold_compounds, indexable_summary, indexable_tasks, lexical_terms

# The fields' weights.
WEIGHTS = {"name": 1.0, "summary": 3.0, "tasks": 5.0, "synonyms": 2.0, "details": 0.25, "publisher": 0.75, "features": 1.9}
#: Runs of letters, digits and marks; the plain form leaves marks out.
TOKEN, PLAIN = r"([\p{L}\p{N}\p{Mn}\p{Mc}\p{Co}]+)", r"([\p{L}\p{N}]+)"


def _stemmed(texts: pa.Array) -> pa.Array:
    return pa.array([porter.stem(porter.fold(x)) if x else x for x in texts.to_pylist()], pa.string())


def stemmed(word: Column) -> Column:
    return arrow_udf(_stemmed, "string")(word)


def projection(entities: DataFrame, key: str, compounds: bool = True) -> DataFrame:
    """The text that is indexed, by field: summaries and tasks that say more than the name, and
    hyphenated compounds in both spellings (compounds: otherwise as they are written)."""
    fold = lambda c: fold_compounds(F.coalesce(c, F.lit(""))) if compounds else F.coalesce(c, F.lit(""))
    name = F.col("display_name")
    return entities.select(
        key, fold(name).alias("name"), fold(indexable_summary(F.col("summary"), name)).alias("summary"), fold(F.array_join(indexable_tasks(F.col("tasks"), name), ". ")).alias("tasks"),
        fold(F.array_join("synonyms", ", ")).alias("synonyms"), fold(F.col("details")).alias("details"), F.col("publisher"), fold(F.col("features")).alias("features"),
    )


def query_phrases(queries: DataFrame, stem: bool = False) -> DataFrame:
    """(qid, i, term, prefix, rest): terms of each query; the last is a prefix.  A term with
    underscores is a phrase: the words after its first are the rest."""
    terms = lexical_terms(F.col("query"))
    found = queries.select("qid", F.posexplode(terms).alias("i", "said"), F.size(terms).alias("n"))
    found = found.withColumn("words", F.filter(F.split("said", "_"), lambda w: w != "")).where(F.size("words") > 0)
    each = found.select("qid", "i", F.col("n") == F.col("i") + 1, F.posexplode("words")).toDF("qid", "i", "prefix", "j", "word")
    each = each.withColumn("term", stemmed(F.col("word")) if stem else F.col("word"))
    lists = each.groupBy("qid", "i", "prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "term"))), lambda x: x["term"]).alias("terms"))
    return lists.select("qid", "i", F.get("terms", 0).alias("term"), "prefix", F.slice("terms", 2, F.size("terms")).alias("rest"))


def document_frequency(rows: DataFrame, text: Column) -> DataFrame:
    """(word, df) over the distinct blank-separated words of each row."""
    w = F.array_distinct(F.filter(F.split(F.lower(text), " "), lambda x: x != ""))
    return rows.select(F.explode(w).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def idf(df: Column, total: Column | int) -> Column:
    return F.log(1 + (total if isinstance(total, Column) else F.lit(total)) / (1 + df))
