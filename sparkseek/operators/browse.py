"""Browsing: keyset pages, document budgets, statistics, usage, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ENTITY_KINDS
from ..sources.scratch import scratch_table
from .fusion import usage_boost


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def parse_kind(name: str) -> int:
    """Code of a kind's name, regardless of case."""
    known = {k.upper(): i for i, k in enumerate(ENTITY_KINDS)}
    if name.strip().upper() not in known:
        raise ValueError(f"unknown kind {name!r}; known: {', '.join(ENTITY_KINDS)}")
    return known[name.strip().upper()]


def list_entities(entities: DataFrame, *, after: str | None = None, name: str | None = None, kind: int | None = None, publisher: str | None = None, source: str | None = None, category: str | None = None, limit: int = 50) -> DataFrame:
    """A page of entities by id, after a given id; every given condition must hold."""
    has = lambda c, v: F.coalesce(F.upper(F.col(c)).contains(v.upper()), F.lit(False))
    rows = entities
    if after is not None:
        rows = rows.where(F.col("id") > after)
    for column, value in (("display_name", name), ("publisher", publisher), ("category", category)):
        if value:
            rows = rows.where(has(column, value))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if source:
        rows = rows.where(F.upper("source") == source.upper())
    return rows.orderBy("id").limit(clamp(limit, 1, 100))


def next_cursor(page: DataFrame, limit: int) -> DataFrame:
    """One row: the last id of a full page, else null."""
    return page.agg(F.when(F.count("*") >= clamp(limit, 1, 100), F.max("id")).alias("next_cursor"))


def get_entity(entities: DataFrame, wanted: str, with_launch: bool = False, with_metadata: bool = False) -> DataFrame:
    """One row, found or not; launch and raw columns only when asked for."""
    private = {"launch_kind", "launch_target", "launch_arguments"} if not with_launch else set()
    private |= {"raw_metadata"} if not with_metadata else set()
    shown = entities.where(F.col("id") == wanted).select(F.lit(True).alias("found"), *(c for c in entities.columns if c not in private))
    one = entities.sparkSession.range(1).select(F.lit(wanted).alias("wanted"))
    return one.join(shown, one.wanted == shown.id, "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("id").withColumnRenamed("wanted", "id")


def documents_within(documents: DataFrame, key: str, order: list[str], budget: int = 12_000, provider: str | None = None, online: bool | None = None) -> DataFrame:
    """Each entity's documents in order while characters are left; the last is cut.

    Every document takes a character at least, so only the first ``budget`` of an entity can be
    shown: those are kept by each task before an entity's rows meet.  The lengths alone are
    added up; texts are joined to what they show."""
    budget = clamp(budget, 1, 50_000)
    rows = documents.where(F.length("text") > 0)
    if provider:
        rows = rows.where(F.upper("provider") == provider.upper())
    if online is not None:
        rows = rows.where(F.col("is_online") == online)
    w = Window.partitionBy(key).orderBy(*order)
    sizes = rows.select(key, *order, F.length("text").alias("size")).withColumn("at", F.row_number().over(w)).where(F.col("at") <= budget)
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = sizes.withColumn("before", before).where(F.col("before") < budget).select(key, *order, "before")
    rows = rows.join(shown, [key, *order])
    return rows.withColumn("truncated", F.length("text") > F.lit(budget) - F.col("before")).withColumn("text", F.expr(f"substring(text, 1, cast({budget} - before as int))")).drop("before")


def upper_percentiles(rows: DataFrame, group: str, value: str, at: dict[str, str]) -> DataFrame:
    """Order statistics of each group.  at: name -> place (from 1) as SQL over n, the group's size.

    Values are counted first, so equal ones weigh once; then ranges of values, from a sample of
    them, are summed up and only the range that holds a place is looked into.  No group is sorted
    in one task."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranged = scratch_table(counts.repartitionByRange(F.col(group), F.col(value)).withColumn("part", F.spark_partition_id()), "percentiles")
    parts = ranged.groupBy(group, "part").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(group)
    parts = parts.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("part")))  # one row a range
    wanted = parts.select(group, "part", (F.col("upto") - F.col("c")).alias("before"), "upto", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.expr(e).cast("long").alias("place")) for k, e in at.items()))).alias("x"))
    wanted = wanted.select(group, "part", "before", "upto", "x.*").where("place > before and place <= upto")
    inner = ranged.join(wanted, [group, "part"])
    run = F.sum("c").over(Window.partitionBy(group, "part", "name").orderBy(value))
    hit = inner.withColumn("run", F.col("before") + run).where("run >= place and run - c < place")
    return hit.groupBy(group).agg(*(F.max(F.when(F.col("name") == k, F.col(value))).alias(k) for k in at))


def all_with_profiles(entities: DataFrame, profiles: DataFrame) -> DataFrame:
    return entities.join(profiles, entities.id == profiles.entity_id, "left").drop("entity_id")


def group_counts(rows: DataFrame, column: str, none: str = "none") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit(none)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def index_stats(entities: DataFrame) -> DataFrame:
    """Counts of applications, tools, settings and the rest."""
    k = F.col("kind")
    groups = {"apps": k.isin(0, 1), "tools": k.isin(4, 6), "settings": k.isin(2, 3)}
    rest = ~(groups["apps"] | groups["tools"] | groups["settings"])
    return entities.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in groups.items()), F.count_if(rest).alias("other"))


def most_used(entities: DataFrame, usage: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """Entities by usage boost: what a blank query shows."""
    rows = entities.join(usage, entities.id == usage.entity_id).withColumn("boost", usage_boost(F.col("launch_count"), F.col("last_launched_at"), as_of))
    return rows.where("boost > 0").orderBy(F.desc("boost"), "id").limit(limit).select("id", "boost", F.lit("frequently used").alias("reason"))


def record_launches(usage: DataFrame, launches: DataFrame) -> DataFrame:
    """Usage counts with a batch of launches (entity_id, at) added."""
    new = launches.groupBy("entity_id").agg(F.count("*").cast("int").alias("launch_count"), F.max("at").alias("last_launched_at"))
    both = usage.select("entity_id", "launch_count", "last_launched_at").unionByName(new)
    return both.groupBy("entity_id").agg(F.sum("launch_count").cast("int").alias("launch_count"), F.max("last_launched_at").alias("last_launched_at"))


def details_shown(summary: Column, details: Column, category: Column, badge: Column) -> tuple[Column, Column]:
    """Details without a leading summary; the category unless it repeats the badge."""
    lead = details.startswith(summary)
    shown = F.when(lead, F.nullif(F.trim(F.substr(details, F.length(summary) + 1)), F.lit(""))).otherwise(details)
    near = F.upper(category).contains(F.upper(badge)) | F.upper(badge).contains(F.upper(category))
    return shown, F.when(F.coalesce(near, F.lit(False)), F.lit(None)).otherwise(category)


def status_line(indexing: Column, count: Column, query: Column, hits: Column) -> Column:
    return (
        F.when(indexing & (count == 0), "Building the index")
        .when(indexing, "Refreshing the index")
        .when(hits > 0, "")
        .when(F.trim(F.coalesce(query, F.lit(""))) == "", "Type to search")
        .when(count == 0, "The index is empty")
        .otherwise("No match")
    )


def json_map(text: Column) -> Column:
    """A map of strings from JSON; null and what is no object give an empty one."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def hit(columns: list[str]) -> Column:
    """A row as JSON without nulls."""
    return F.to_json(F.struct(*columns))


def to_hits(rows: DataFrame, limit: int = 8, most: int = 50) -> DataFrame:
    """(id, hit): the first rows by place (or id) as JSON; a limit is always clamped to 1..``most``."""
    order = "place" if "place" in rows.columns else "id"
    return rows.orderBy(order).limit(clamp(limit, 1, most)).select("id", hit(rows.columns).alias("hit"))
