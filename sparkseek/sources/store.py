"""The index as tables of segments: a commit adds rows and keys that are gone, and rewrites nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from copy import deepcopy
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lexical, postings
from ..operators.browse import record_launches
from ..schema import SCHEMA_VERSION, TABLES
from .log import Conflict, Log
from .scratch import scratch_table

CONTENT = ("entities", "documents", "profiles", "vectors")
KEYS = {"entities": "id", "documents": "entity_id", "profiles": "entity_id", "vectors": "vector_ordinal", "usage_stats": "entity_id"}
#: The postings of the entities' texts, kept beside the tables: (docs, postings) in each segment.
TEXTS = "texts"
#: Segments of a table, and the share of its rows that may be superseded, beyond which it is compacted.
SEGMENTS, SUPERSEDED = 12, 0.3
#: Keys that are sent to every executor at most; attempts of a writer that others overtake.
SMALL, ATTEMPTS = 50_000, 5


@dataclass
class Edit:
    """rows: what a table gains.  gone: (key) of the rows that it loses, of those that were there before, or the
    segment that they were written to.  whole: nothing of what was there stays."""

    rows: DataFrame | None = None
    gone: DataFrame | dict | None = None
    whole: bool = False


def _met(keys: DataFrame, rows: int | None = None) -> DataFrame:
    """Keys, or rows by key, that a table is joined with: sent to every executor if they are few, else by a shuffle.
    Nothing is left to the sizes of files, which are a tenth of what the driver would hold."""
    return F.broadcast(keys) if (keys.count() if rows is None else rows) <= SMALL else keys.hint("merge")


def retried(change: Callable) -> Callable:
    """A writer that another overtakes begins again from the new state."""

    @wraps(change)
    def run(*args, **named):
        for left in reversed(range(ATTEMPTS)):
            try:
                return change(*args, **named)
            except Conflict:
                if not left:
                    raise

    return run


class IndexStore:
    """Tables under a root that any file system of Spark's can hold.

    Each table is a list of segments, and of keys that later commits took away (a row is live unless a
    later commit names its key).  A commit writes what changes and one entry of the log, for all tables at
    once; readers see the snapshot of one entry.  When a table has many segments or superseded
    rows, it is compacted by a commit of its own.  Usage survives an incompatible schema or model."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)

    # ----------------------------------------------------------------------- snapshots

    def manifest(self) -> dict | None:
        """Version, model and tables of the snapshot that is current."""
        state = self.log.latest()
        return state and state["meta"] | {"snapshot": state["version"], "tables": sorted(t for t in state["tables"] if t in CONTENT)}

    def _state(self) -> dict:
        return self.log.latest() or {"version": 0, "meta": {"schema_version": SCHEMA_VERSION, "embedding_model": None, "embedding_dimensions": 0}, "tables": {}}

    def compatible(self, model: str) -> bool:
        """Version and model agree and every table has the expected columns, of the expected types."""
        state = self.log.latest()
        if not state or state["meta"]["schema_version"] != SCHEMA_VERSION or state["meta"]["embedding_model"] != model:
            return False
        for table, schema in TABLES.items():
            kept = state["tables"].get(table, {}).get("segments", [])
            if table == "usage_stats" or not kept:
                continue
            have = {f.name: f.dataType.simpleString() for f in self.spark.read.parquet(*(f"{self.root}/{s['path']}" for s in kept)).schema}
            if any(have.get(f.name) != f.dataType.simpleString() for f in schema):
                return False
        return True

    @retried
    def initialize(self, model: str, dimensions: int) -> None:
        """Keeps compatible content, else begins anew; never migrates.  Usage stays."""
        if not self.compatible(model):
            state = self._state()
            usage = {t: e for t, e in state["tables"].items() if t == "usage_stats"}
            self.log.commit({"version": state["version"] + 1, "meta": {"schema_version": SCHEMA_VERSION, "embedding_model": model, "embedding_dimensions": dimensions}, "tables": usage, "added": [], "removed": sorted(set(state["tables"]) - set(usage))})

    def open_read_only(self, model: str, dimensions: int) -> None:
        said = self.manifest()
        if said is None:
            raise FileNotFoundError(f"no index at {self.root}")
        if not self.compatible(model) or said["embedding_dimensions"] != dimensions:
            raise ValueError("the index was made with another schema or model")

    def read(self, table: str) -> DataFrame:
        return self._table(self.log.latest(), table)

    def _gone(self, deletes: list[dict]) -> DataFrame:
        keys = self.spark.read.parquet(*(f"{self.root}/{d['path']}" for d in deletes))
        return _met(keys, sum(d["rows"] for d in deletes))

    def _table(self, state: dict | None, table: str) -> DataFrame:
        """The live rows of a table."""
        entry = (state or {"tables": {}})["tables"].get(table, {"segments": [], "deletes": []})
        out = self.spark.createDataFrame([], TABLES[table])
        by_deletes: dict[tuple, list[dict]] = {}
        for s in entry["segments"]:
            by_deletes.setdefault(tuple(d["path"] for d in entry["deletes"] if d["version"] > s["version"]), []).append(s)
        parts = []
        for later, segments in by_deletes.items():
            rows = self.spark.read.schema(TABLES[table]).parquet(*(f"{self.root}/{s['path']}" for s in segments))
            gone = [d for d in entry["deletes"] if d["path"] in later]
            parts.append(rows.join(self._gone(gone).withColumnRenamed("key", KEYS[table]), KEYS[table], "left_anti").select(*out.columns) if gone else rows)
        for p in parts:
            out = p if out is None or p is parts[0] else out.unionByName(p)
        return out

    def texts(self, state: dict | None = None) -> postings.Stored | None:
        """The stored postings of the entities' texts; none before the first upsert."""
        state = state or self.log.latest()
        entry = (state or {"tables": {}})["tables"].get(TEXTS)
        if not entry or not entry["segments"]:
            return None
        segments = []
        for s in entry["segments"]:
            later = [d for d in entry["deletes"] if d["version"] > s["version"]]
            segments.append((f"{self.root}/{s['path']}", self._gone(later) if later else None))
        return postings.Stored.open(self.spark, "string", True, segments)

    # ----------------------------------------------------------------------- commits

    def _segment(self, table: str, write: Callable[[str], object], version: int) -> dict:
        path = f"segments/{table}/{version:012d}-{uuid.uuid4().hex}"
        rows = write(f"{self.root}/{path}")
        return {"path": path, "version": version, "rows": self.spark.read.parquet(f"{self.root}/{path}").count() if rows is None else rows}

    def _written_keys(self, keys: DataFrame, version: int) -> dict:
        return self._segment("gone", lambda path: keys.toDF("key").distinct().write.parquet(path), version)

    def _commit(self, state: dict, edits: dict[str, Edit], meta: dict | None = None) -> int:
        """One commit on top of ``state``: writes what the edits add, and the entry of the log."""
        version, after = state["version"] + 1, deepcopy(state)
        after |= {"version": version, "meta": state["meta"] | (meta or {}), "added": [], "removed": []}
        for table, edit in edits.items():
            old = after["tables"].get(table, {"segments": [], "deletes": []})
            new = {"segments": [], "deletes": []} if edit.whole else old
            if edit.whole:
                after["removed"] += [s["path"] for k in ("segments", "deletes") for s in old[k]]
            if edit.gone is not None and new["segments"]:
                told = edit.gone if isinstance(edit.gone, dict) else self._written_keys(edit.gone, version)
                if told["rows"]:
                    new["deletes"].append(told)
                    after["added"].append(told["path"])
            if edit.rows is not None:
                if table == TEXTS:
                    told = self._segment(table, lambda path, rows=edit.rows: postings.write(rows, "key", list(lexical.WEIGHTS), True, path), version)
                else:
                    told = self._segment(table, lambda path, rows=edit.rows: rows.write.parquet(path), version)
                if told["rows"]:
                    new["segments"].append(told)
                    after["added"].append(told["path"])
            after["tables"][table] = new
        self.log.commit(after)
        return version

    def _needs_compacting(self, entry: dict) -> bool:
        rows = sum(s["rows"] for s in entry["segments"])
        return len(entry["segments"]) > SEGMENTS or len(entry["deletes"]) > SEGMENTS or sum(d["rows"] for d in entry["deletes"]) > SUPERSEDED * max(rows, 1)

    @retried
    def compact(self, force: bool = False) -> list[str]:
        """Rewrites the tables with many segments or superseded rows, each as one segment.  Returns their names."""
        state = self._state()
        due = [t for t, e in state["tables"].items() if (force and (len(e["segments"]) > 1 or e["deletes"])) or self._needs_compacting(e)]
        edits = {t: Edit(self._projected(state) if t == TEXTS else self._table(state, t), whole=True) for t in due}
        if due:
            self._commit(state, edits)
        return sorted(due)

    def vacuum(self, keep: int = 2) -> int:
        return self.log.vacuum(keep)

    def _projected(self, state: dict) -> DataFrame:
        return projected(self._table(state, "entities"), self._table(state, "profiles"))

    @retried
    def publish(self, batch: int | None = None, **tables: DataFrame) -> int:
        """Replaces whole tables; the others are untouched.  batch: the number of a stream's batch; one that
        has been published is not published again."""
        state = self._state()
        if batch is not None and batch <= state["meta"].get("batch", -1):
            return state["version"]
        edits = {t: Edit(df, whole=True) for t, df in tables.items()}
        if "entities" in tables or "profiles" in tables:
            rows = {t: tables[t] if t in tables else self._table(state, t) for t in ("entities", "profiles")}
            edits[TEXTS] = Edit(projected(**rows), whole=True)
        return self._commit(state, edits, None if batch is None else {"batch": batch})

    @retried
    def upsert(self, entities: DataFrame, documents: DataFrame, profiles: DataFrame, vectors: DataFrame | None = None) -> int:
        """Replaces the given entities with their documents and profiles.

        vectors: (id, embedding).  An entity with a vector keeps its ordinal or gets the next
        free one; one without keeps the ordinal it has."""
        state = self._state()
        ids = scratch_table(entities.select("id").distinct(), "ids")
        old = self._table(state, "entities")
        named = ids.count()  # no join below has more keys
        ordinals = scratch_table(old.join(_met(ids, named), "id", "left_semi").select("id", F.col("vector_ordinal").alias("was")), "ordinals")
        new = entities.withColumnRenamed("vector_ordinal", "own").join(_met(ordinals, named), "id", "left")
        edits = {}
        free = state["meta"].get("next_ordinal")
        if free is None:  # tables that were published whole
            free = 1 + max(-1 if x is None else x for x in (old.agg(F.max("vector_ordinal")).first()[0], self._table(state, "vectors").agg(F.max("vector_ordinal")).first()[0]))
        if vectors is not None:
            given = scratch_table(vectors.join(_met(ids, named), "id", "left_semi").join(_met(ordinals, named), "id", "left"), "given")
            fresh = given.where("was is null").select("id")
            # numbered by ranges of ids: counts of the ranges first, then places within each
            ranged = scratch_table(fresh.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "fresh")
            upto = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
            place = F.row_number().over(Window.partitionBy("part").orderBy("id"))
            numbered = ranged.withColumn("place", place).join(F.broadcast(upto), "part").select("id", (F.col("place") + F.col("base") + F.lit(free - 1)).cast("int").alias("next"))
            numbered = scratch_table(numbered, "numbered")
            own = given.join(_met(numbered, named), "id", "left").select("id", F.coalesce("was", "next").alias("vector_ordinal"), F.col("embedding").cast("array<float>").alias("embedding"))
            own = scratch_table(own, "vectors")
            edits["vectors"] = Edit(own.select("vector_ordinal", "embedding"), ordinals.where("was is not null").join(_met(own.select("id"), named), "id", "left_semi").select("was"))
            new = new.join(_met(own.select("id", F.col("vector_ordinal").alias("got")), named), "id", "left")
        else:
            new = new.withColumn("got", F.lit(None).cast("int"))
        new = scratch_table(new.withColumn("vector_ordinal", F.coalesce("got", "own", "was")).select(*old.columns), "new")
        last = new.agg(F.max("vector_ordinal")).first()[0]
        meta = {"next_ordinal": max(free, 0 if last is None else last + 1)}
        known = self._written_keys(ordinals.select("id"), state["version"] + 1)  # one for all tables
        edits |= {"entities": Edit(new, known), "documents": Edit(documents.select(*TABLES["documents"].names), known), "profiles": Edit(profiles.select(*TABLES["profiles"].names), known)}
        edits[TEXTS] = Edit(projected(new, profiles), known)
        version = self._commit(state, edits, meta)
        self.compact()
        return version

    @retried
    def remove(self, ids: DataFrame) -> int:
        """Drops entities with their documents and profiles; usage stays."""
        gone = scratch_table(ids.select("id").distinct(), "gone")
        state = self._state()
        told = self._written_keys(gone, state["version"] + 1)
        version = self._commit(state, {t: Edit(gone=told) for t in ("entities", "documents", "profiles", TEXTS)})
        self.compact()
        return version

    @retried
    def purge_online(self) -> int:
        """Drops what was fetched from the network; the other documents of those entities are written again."""
        state = self._state()
        rows = self._table(state, "documents")
        touched = scratch_table(rows.where("is_online").select("entity_id").distinct(), "touched")
        kept = rows.where("not is_online").join(_met(touched), "entity_id", "left_semi")
        return self._commit(state, {"documents": Edit(kept.select(*TABLES["documents"].names), touched)})

    def documents_by_entity(self) -> DataFrame:
        """(entity_id, documents): all of each entity, by provider and text."""
        rows = self.read("documents")
        return rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("provider", "text", "is_online", "source_uri", "retrieved_at"))).alias("documents"))

    def documents_of(self, entity_id: str) -> DataFrame:
        return self.read("documents").where(F.col("entity_id") == entity_id).orderBy("provider", "text")

    def vector_matrix(self) -> DataFrame:
        """(vector_ordinal, embedding) from 0 to the highest ordinal; what no entity has is zeros."""
        have = self.read("vectors")
        last = have.agg(F.max("vector_ordinal")).first()[0]
        dims = (self.manifest() or {}).get("embedding_dimensions", 0)
        every = self.spark.range(0 if last is None else last + 1).select(F.col("id").cast("int").alias("vector_ordinal"))
        return every.join(have, "vector_ordinal", "left").select("vector_ordinal", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dims)).alias("embedding"))

    def snapshot(self) -> dict[str, DataFrame]:
        """All tables of the snapshot that is current now: one entry of the log, so a commit in
        between changes none of them."""
        state = self.log.latest()
        return {n: self._table(state, n) for n in (*CONTENT, "usage_stats")}

    def status(self) -> dict:
        """Whether there is an index, of how many entities, by which model."""
        said = self.manifest()
        if said is None:
            return {"available": False, "count": 0, "model": None, "dimensions": 0, "snapshot": None}
        return {"available": True, "count": self.count(), "model": said["embedding_model"], "dimensions": said["embedding_dimensions"], "snapshot": said["snapshot"]}

    def content_hashes(self) -> DataFrame:
        return self.read("entities").where("content_hash is not null").select("id", "content_hash")

    @retried
    def record(self, launches: DataFrame) -> None:
        """Adds launches (entity_id, at) to the usage table; only the rows of what was launched are written."""
        state = self._state()
        touched = scratch_table(launches.select("entity_id").distinct(), "launched")
        before = self._table(state, "usage_stats").join(_met(touched), "entity_id", "left_semi")
        self._commit(state, {"usage_stats": Edit(record_launches(before, launches).select(*TABLES["usage_stats"].names), touched)})
        self.compact()

    def count(self) -> int:
        return self.read("entities").count()


def projected(entities: DataFrame, profiles: DataFrame) -> DataFrame:
    """The text of entities that is indexed, by field and key."""
    both = entities.select(F.col("id").alias("key"), "display_name", "publisher").join(profiles.withColumnRenamed("entity_id", "key").hint("merge"), "key", "left")
    return lexical.projection(both, "key")
