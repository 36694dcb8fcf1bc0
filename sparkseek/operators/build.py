"""Building the index: hashes, dedupe, absorbing, diff, refresh plan, retirement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..sources.scratch import scratch_table


def entity_id(source: Column, key: Column) -> Column:
    return F.concat(F.lower(F.trim(source)), F.lit(":"), F.lower(F.trim(key)))


def source_of(id_: Column) -> Column:
    """What stands before the first colon; null if nothing does."""
    return F.when(F.instr(id_, ":") > 1, F.substring_index(id_, ":", 1))


def _field(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("-1:|")).otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value, F.lit("|")))


def content_hash(fields: list[Column], metadata: Column | None = None) -> Column:
    """SHA-256 over length-prefixed fields, and the metadata by key."""
    parts = [_field(f.cast("string")) for f in fields]
    if metadata is not None:
        entries = F.transform(F.array_sort(F.map_entries(F.coalesce(metadata, F.create_map().cast("map<string,string>")))), lambda e: F.concat(_field(e["key"]), _field(e["value"])))
        parts.append(F.array_join(entries, ""))
    return F.sha2(F.concat(*parts), 256)


def dedupe_key(kind: Column, launch_kind: Column, target: Column, name: Column, scope: Column) -> Column:
    """Things that run are one by name (within a scope); others by what they open as well."""
    runs = kind.isin(0, 1, 6)
    plain = normalize_name(name)
    return F.when(runs, F.concat_ws("|", F.lit("app"), scope, plain)).otherwise(F.concat_ws("|", launch_kind.cast("string"), F.coalesce(target, F.lit("")), plain))


def exe_key(runs: Column, shared: Column, path: Column, arguments: Column) -> Column:
    return F.when(runs & ~shared & path.isNotNull(), F.concat_ws("|", F.lit("exe"), F.lower(path), F.lower(F.coalesce(arguments, F.lit("")))))


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Of the rows of each key the first by precedence; each task keeps its own first before the
    rows of a key meet, so a key of any number of rows costs one a task (by names, an aggregation;
    by other orders, a window with a limit, which Spark applies in each task first)."""
    if not all(isinstance(o, str) for o in order):
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*order)).alias("__first"))
    return first.select(*keys, *(F.col("__first").getField(c).alias(c) for c in rest)).select(*rows.columns)


def greedy_groups(rows: DataFrame, order: list[str], keys: str = "keys") -> DataFrame:
    """(id, survivor): discovery in order; a row whose key is claimed joins the survivor of
    its first claimed key, and its other keys are claimed for that survivor.

    A key is claimed by the first row that has it, so a row depends on one earlier row at most: the first
    row of the first of its keys (as listed) that begins before it.  Those pointers form a forest, whose
    roots are the survivors; they are found by doubling, among the rows that are pointed at alone.  No group
    of rows meets in a task.  Rows of equal order go by id."""
    place = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col("id").alias("who"))
    each = rows.select("id", place.alias("o"), F.posexplode(keys).alias("i", "k"))
    first = each.groupBy("k").agg(F.min("o").alias("first"))
    earlier = each.join(first, "k").where("first < o").groupBy("id").agg(F.min_by(F.col("first.who"), "i").alias("up"))
    point = scratch_table(earlier, "pointers")
    heads = point.select(F.col("up").alias("node")).distinct().join(point.withColumnRenamed("id", "node"), "node", "left")
    jump = scratch_table(heads.select("node", F.coalesce("up", "node").alias("up"), F.col("up").isNull().alias("done")), "heads")
    while not jump.where("not done").isEmpty():
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("done").alias("end"))
        jump = scratch_table(jump.join(far, "up").select("node", F.col("far").alias("up"), F.col("end").alias("done")), "heads")
    roots = jump.select(F.col("node").alias("up"), F.col("up").alias("root"))
    return rows.select("id").join(point, "id", "left").join(roots, "up", "left").select("id", F.coalesce("root", "id").alias("survivor"))


def absorb(survivor: Column, loser: Column) -> Column:
    """Metadata of the survivor and, where it has nothing, of the loser."""
    empty = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce(survivor, empty), lambda k, v: F.length(F.trim(v)) > 0)
    more = F.map_filter(F.coalesce(loser, empty), lambda k, v: (F.length(F.trim(v)) > 0) & ~F.coalesce(F.map_contains_key(own, k), F.lit(False)))
    return F.map_concat(own, more)


def fold_aliases(commands: DataFrame, hosts: DataFrame) -> DataFrame:
    """(alias_id, host_id): a command below a host's folder with the same plain name; the
    first host by discovery."""
    c = commands.select(F.col("id").alias("alias_id"), F.lower("exe").alias("exe"), normalize_name(F.col("display_name")).alias("plain"))
    h = hosts.select(F.col("id").alias("host_id"), F.lower("folder").alias("folder"), normalize_name(F.col("display_name")).alias("plain"), "position").where("folder is not null")
    # of one folder and name only the first host can win; beginnings of the lengths that folders have meet it by equality
    h = first_wins(h, ["plain", "folder"], ["position", "host_id"])
    lengths = h.agg(F.collect_set(F.length("folder")).alias("lengths"))
    begun = c.crossJoin(F.broadcast(lengths)).select("alias_id", "plain", "exe", F.explode(F.filter("lengths", lambda n: n <= F.length("exe"))).alias("n"))
    both = begun.select("alias_id", "plain", F.expr("substring(exe, 1, n)").alias("folder")).join(h, ["plain", "folder"])
    return first_wins(both, ["alias_id"], ["position", "host_id"]).select("alias_id", "host_id")


def diff(discovered: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, state) of a full join on id: unchanged, updated, added or stale.  A null hash is
    never unchanged."""
    d = discovered.select("id", F.col("content_hash").alias("new"), F.lit(True).alias("here"))
    s = stored.select("id", F.col("content_hash").alias("old"), F.lit(True).alias("there"))
    state = F.when(F.col("here").isNull(), "stale").when(F.col("there").isNull(), "added").when(F.coalesce(F.col("new") == F.col("old"), F.lit(False)), "unchanged").otherwise("updated")
    return d.join(s, "id", "full").select("id", state.alias("state"))


def to_process(plan: DataFrame, force: bool = False, refresh: bool = False, sources: list[str] | None = None) -> DataFrame:
    """What a run works on: all that is there when forced or refreshing, else what changed."""
    rows = plan.where("state <> 'stale'")
    if sources:
        rows = rows.where(source_of(F.col("id")).isin([s.lower() for s in sources]))
    return rows if force or refresh or sources else rows.where("state <> 'unchanged'")


def stale(discovered: DataFrame, stored: DataFrame, sources: list[str] | None = None) -> DataFrame:
    rows = stored if not sources else stored.where(source_of(F.col("id")).isin([s.lower() for s in sources]))
    return rows.join(discovered.select("id"), "id", "left_anti")


def provider_plan(entities: DataFrame, stored: DataFrame, providers: list[str], refresh: list[str], reuse_all: bool = False) -> DataFrame:
    """(entity_id, provider, action): run those named or without anything stored; carry the rest."""
    every = entities.select(F.col("id").alias("entity_id"), F.explode(F.array(*map(F.lit, providers))).alias("provider"))
    have = stored.select("entity_id", "provider").distinct().withColumn("have", F.lit(True))
    named = F.col("provider").isin(refresh) if refresh else F.lit(False)
    fresh = named | (F.lit(not reuse_all) & F.col("have").isNull())
    return every.join(have, ["entity_id", "provider"], "left").select("entity_id", "provider", F.when(fresh, "run").when(F.col("have"), "carry").otherwise("skip").alias("action"))


def merge_documents(carried: DataFrame, fresh: DataFrame) -> DataFrame:
    """Carried and fresh documents without blanks and repeats, offline first; ties by text."""
    rows = carried.unionByName(fresh).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''").dropDuplicates(["entity_id", "provider", "text"])
    w = Window.partitionBy("entity_id").orderBy("is_online", "provider", "text")
    return rows.withColumn("position", F.row_number().over(w))


def needs_embedding(now: DataFrame, before: DataFrame) -> DataFrame:
    """Entities whose embedding text differs from the stored one."""
    return now.join(before.select("id", F.col("text").alias("old")), "id", "left").where(~F.coalesce(F.col("text") == F.col("old"), F.lit(False))).drop("old")


def index_result(plan: DataFrame, failed: int = 0) -> DataFrame:
    """One row of counters."""
    count = lambda s: F.count_if(F.col("state") == s)
    return plan.agg(F.count_if(F.col("state") != "stale").alias("discovered"), count("added").alias("added"), count("updated").alias("updated"), count("unchanged").alias("unchanged"), count("stale").alias("removed"), F.lit(failed).cast("long").alias("failed"))
