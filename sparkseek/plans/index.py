"""One build of an index: discover, diff, enrich, synthesise, embed, publish, retire."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.synthesis import synthesize
from ..functions.text import embedding_text, normalize_name
from ..operators import build
from ..operators.embed import Embedder, embed
from ..schema import DOCUMENTS
from ..sources.scratch import scratch_table
from ..sources.store import IndexStore


@dataclass
class BuildOptions:
    """force: work on all that is there.  refresh: providers to run again.  sources: collectors to
    rescan; the others' entities stay as they are.  wave: entities that are published together, about."""

    force: bool = False
    refresh: list[str] = field(default_factory=list)
    sources: list[str] | None = None
    online: bool = False
    wave: int = 100_000


@dataclass(frozen=True)
class Provider:
    """A source of text.  enrich: entities -> documents (entity_id, text)."""

    name: str
    enrich: Callable[[DataFrame], DataFrame]
    online: bool = False


def keyed(entities: DataFrame) -> DataFrame:
    """The keys by which two entities are one: by name (within a scope) or by what they open, and by the
    program with its arguments."""
    meta = lambda k: F.try_element_at("raw_metadata", F.lit(k))
    runs = F.col("kind").isin(0, 1, 6)
    path = F.when(F.lower(F.coalesce(meta("targetPath"), F.col("launch_target"))).endswith(".exe"), F.coalesce(meta("targetPath"), F.col("launch_target")))
    keys = F.array(
        build.dedupe_key(F.col("kind"), F.col("launch_kind"), F.col("launch_target"), F.col("display_name"), meta("dedupeScope")),
        build.exe_key(runs, F.coalesce(meta("sharedLaunchTarget") == "true", F.lit(False)), path, F.col("launch_arguments")),
    )
    return entities.withColumn("keys", F.filter(keys, lambda k: k.isNotNull()))


def dedupe(found: DataFrame) -> DataFrame:
    """Discovered rows (with rank) -> one row a thing: the first by rank and id, which takes over
    what others know; its hash is made anew."""
    rows = keyed(found)
    groups = scratch_table(build.greedy_groups(rows.select("id", "rank", "keys"), ["rank", "id"]), "groups")
    told = rows.join(groups, "id")
    losers = told.where("id <> survivor")
    entries = losers.select("survivor", "rank", "id", "icon_source", "publisher", F.explode_outer(F.map_entries(F.coalesce("raw_metadata", F.create_map().cast("map<string,string>")))).alias("e"))
    first = entries.where(F.length(F.trim("e.value")) > 0).groupBy("survivor", "e.key").agg(F.min_by("e.value", F.struct("rank", "id")).alias("value"))
    more = first.groupBy("survivor").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("more"))
    lent = losers.groupBy("survivor").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("rank", "id"))).alias(f"lent_{c}") for c in ("icon_source", "publisher")))
    kept = told.where("id = survivor").join(more, "survivor", "left").join(lent, "survivor", "left")
    kept = kept.withColumn("raw_metadata", build.absorb(F.col("raw_metadata"), F.col("more")))
    for c in ("icon_source", "publisher"):
        kept = kept.withColumn(c, F.coalesce(c, f"lent_{c}"))
    return rehashed(kept).select(*found.columns)


def rehashed(entities: DataFrame) -> DataFrame:
    return entities.withColumn("content_hash", build.content_hash([F.col(c) for c in ("display_name", "kind", "launch_kind", "launch_target", "launch_arguments", "icon_source", "publisher")], F.col("raw_metadata")))


def with_executables(entities: DataFrame, packages: DataFrame) -> DataFrame:
    """Applications of the shell without a target learn their package's program.  packages: (id, executable)."""
    known = F.coalesce(F.try_element_at("raw_metadata", F.lit("targetPath")), F.lit("")) != ""
    rows = entities.join(packages.select("id", "executable"), "id", "left")
    told = F.map_concat(F.coalesce("raw_metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("targetPath"), F.col("executable")))
    return rehashed(rows.withColumn("raw_metadata", F.when((F.col("launch_kind") == 0) & ~known & F.col("executable").isNotNull(), told).otherwise(F.col("raw_metadata")))).select(*entities.columns)


def folded(entities: DataFrame) -> DataFrame:
    """Commands that belong to an installed program of their name go, and it takes over what they know."""
    target = F.coalesce(F.try_element_at("raw_metadata", F.lit("targetPath")), F.col("launch_target"))
    commands = entities.where("source = 'command'").select("id", "display_name", target.alias("exe"))
    folder = F.try_element_at("raw_metadata", F.lit("installLocation"))
    hosts = entities.where("source <> 'command'").select("id", "display_name", F.concat(F.regexp_replace(folder, r"[\\\\/]+$", ""), F.lit("\\")).alias("folder"), F.col("rank").alias("position")).where("folder is not null")
    pairs = scratch_table(build.fold_aliases(commands, hosts), "aliases")
    lent = entities.join(pairs.select(F.col("alias_id").alias("id"), "host_id"), "id").groupBy("host_id").agg(F.min_by("raw_metadata", "id").alias("lent")).withColumnRenamed("host_id", "id")
    kept = entities.join(pairs.select(F.col("alias_id").alias("id")), "id", "left_anti").join(lent, "id", "left")
    changed = kept.withColumn("raw_metadata", F.when(F.col("lent").isNotNull(), build.absorb(F.col("raw_metadata"), F.col("lent"))).otherwise(F.col("raw_metadata")))
    return rehashed(changed).select(*entities.columns)


def run_build(store: IndexStore, discovered: DataFrame, providers: list[Provider], embedder: Embedder, options: BuildOptions | None = None, packages: DataFrame | None = None, after_wave: Callable[[int, int], None] | None = None) -> dict:
    """Builds the index and returns its counters, durations and first failure.

    discovered: entities with rank.  New entities are published first with what their name tells, no
    hash and no vector, so a search finds them at once and an interrupted build works on them again.
    The rest goes in waves by a hash of the id, each published by itself: a build that is
    interrupted keeps the waves that are done, and the next one works on what has no hash yet.  after_wave: called with the
    number of waves done and of all.  Documents of providers that don't run are carried over.  An entity whose text is unchanged keeps
    its vector; one whose text can't be embedded is kept without hash and vector and counted."""
    o, began = options or BuildOptions(), time.monotonic()
    named = {p.name for p in providers}
    if set(o.refresh) - named:
        raise ValueError(f"unknown providers: {', '.join(sorted(set(o.refresh) - named))}")
    if not o.online and any(p.online and p.name in o.refresh for p in providers):
        raise ValueError("a provider of the network can be refreshed online only")
    spark = store.spark
    store.initialize(embedder.model, embedder.dimensions)
    found = dedupe(discovered)
    if packages is not None:
        found = with_executables(found, packages)
    found = scratch_table(folded(found), "discovered")
    stored = scratch_table(store.read("entities"), "stored")
    plan = build.diff(found.select("id", "content_hash"), stored.select("id", "content_hash"))
    if o.sources:
        inside = build.source_of(F.col("id")).isin([s.lower() for s in o.sources])
        plan = plan.where(inside | (F.col("state") != "stale"))
    plan = scratch_table(plan, "plan")
    todo = scratch_table(build.to_process(plan, o.force, bool(o.refresh), o.sources), "todo")
    discovered_in = time.monotonic() - began
    work = scratch_table(found.join(todo.select("id"), "id", "left_semi").drop("rank"), "work")
    old_documents, old_profiles = scratch_table(store.read("documents"), "old-documents"), scratch_table(store.read("profiles"), "old-profiles")
    no_text = spark.createDataFrame([], DOCUMENTS)
    seeds = work.join(todo.where("state = 'added'").select("id"), "id", "left_semi")
    if not seeds.isEmpty():
        blank = F.lit(None).cast("string")
        store.upsert(seeds.withColumn("content_hash", blank), no_text, _profiles(seeds, no_text))
    usable = [p for p in providers if o.online or not p.online]
    waves = max(1, -(-todo.count() // o.wave))
    failed, first, embedded = 0, None, 0
    for n in range(waves):
        part = work if waves == 1 else scratch_table(work.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == n), "wave")
        done, bad, said = _wave(store, part, stored, old_documents, old_profiles, usable, embedder, o)
        failed, embedded, first = failed + bad, embedded + done, first or said
        if after_wave is not None:
            after_wave(n + 1, waves)
    gone = plan.where("state = 'stale'").select("id")
    if not gone.isEmpty():
        store.remove(gone)
    counts = build.index_result(plan, failed).first().asDict()
    return counts | {"first_failure": first, "discover_seconds": discovered_in, "build_seconds": time.monotonic() - began - discovered_in, "seconds": time.monotonic() - began, "embedded": embedded, "waves": waves}


def _wave(store: IndexStore, work: DataFrame, stored: DataFrame, old_documents: DataFrame, old_profiles: DataFrame, usable: list[Provider], embedder: Embedder, o: BuildOptions) -> tuple[int, int, str | None]:
    """Enriches, synthesises, embeds and publishes some entities; how many were embedded, how many could not be,
    and the first reason."""
    no_text = store.spark.createDataFrame([], DOCUMENTS)
    # which providers run for which entity, and what is carried over
    plan_p = scratch_table(build.provider_plan(work.select("id"), old_documents, [p.name for p in usable], o.refresh, reuse_all=False), "providers")
    fresh = no_text
    for p in usable:
        asked = work.join(plan_p.where((F.col("provider") == p.name) & (F.col("action") == "run")).select(F.col("entity_id").alias("id")), "id", "left_semi")
        told = p.enrich(asked).select("entity_id", "text")
        fresh = fresh.unionByName(told.select("entity_id", F.lit(p.name).alias("provider"), F.lit(p.online).alias("is_online"), "text", F.lit(None).cast("string").alias("source_uri"), F.current_timestamp().alias("retrieved_at")))
    carried = old_documents.join(work.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    if o.refresh:
        carried = carried.where(~F.col("provider").isin(o.refresh))
    documents = scratch_table(build.merge_documents(carried, fresh).select(*DOCUMENTS.names), "documents")
    profiles = scratch_table(_profiles(work, documents), "profiles")
    # only texts that differ from the stored ones are embedded
    now = _texts(work, profiles)
    before = _texts(stored.where("vector_ordinal is not null"), old_profiles)
    vectors = store.read("vectors")
    due = scratch_table(build.needs_embedding(now, before), "due")
    done = scratch_table(embed(due, "id", "text", embedder), "embedded")
    failed = done.where("embedding is null")
    n_failed, first = failed.count(), failed.orderBy("id").select("error").first()
    good = done.where("embedding is not null").select("id", "embedding")
    reused = work.select("id").join(due.select("id"), "id", "left_anti").join(stored.where("vector_ordinal is not null").select("id", "vector_ordinal"), "id").join(vectors, "vector_ordinal").select("id", "embedding")
    out = work.join(failed.select("id", F.lit(True).alias("bad")), "id", "left").withColumn("content_hash", F.when(F.col("bad").isNull(), F.col("content_hash"))).drop("bad").withColumn("indexed_at", F.current_timestamp())
    if not work.isEmpty():
        store.upsert(out, documents, profiles, good.unionByName(reused))
    return done.count() - n_failed, n_failed, first[0] if first else None


def _profiles(entities: DataFrame, documents: DataFrame) -> DataFrame:
    return synthesize(entities, documents).select("entity_id", "summary", "tasks", "synonyms", "category", "details", "features", "generator")


def _texts(entities: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, text): what is embedded of each entity."""
    rows = entities.select("id", "display_name", "publisher").join(profiles.withColumnRenamed("entity_id", "id"), "id")
    said = embedding_text(F.col("display_name"), F.col("category"), F.col("summary"), F.col("tasks"), F.col("synonyms"), F.col("details"), F.col("publisher"))
    return rows.select("id", said.alias("text"))


def search_entities(store: IndexStore) -> DataFrame:
    """The stored index in the form that the search takes, from one snapshot."""
    tables = store.snapshot()
    rows = tables["entities"].join(tables["profiles"].withColumnRenamed("entity_id", "id"), "id", "left").join(tables["vectors"], "vector_ordinal", "left").join(tables["usage_stats"].withColumnRenamed("entity_id", "id"), "id", "left")
    return rows.withColumn("key", F.col("id")).withColumn("plain", normalize_name(F.col("display_name")))
