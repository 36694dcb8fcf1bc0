"""Stored postings, the log of commits, candidates of names and greedy claims."""

from __future__ import annotations

import math
import os
import random
import re
import threading
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import names
from sparkseek.operators import build, lexical, postings
from sparkseek.plans import search
from sparkseek.schema import DOCUMENTS, ENTITIES, PROFILES, RankingOptions
from sparkseek.sources import store as store_module
from sparkseek.sources.log import Conflict, Log
from sparkseek.sources.store import IndexStore

# --------------------------------------------------------------------------- postings

WORDS = "task manager edit text file list pipe logon session paint draw photo process running end see the of".split()
FIELDS = ["name", "details"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    text = lambda most: " ".join(rng.choice(WORDS) + rng.choice(["", "", "s"]) for _ in range(rng.randint(0, most)))
    return [(f"k{i:04d}", text(4) or None, text(rng.choice([5, 60]))) for i in range(n)]


def bm25_by_force(rows, query, limit):
    """Scores of one query by plain loops."""
    said = {k: {f: re.findall(r"\w+", (t or "").lower()) for f, t in zip(FIELDS, texts, strict=True)} for k, *texts in rows}
    sizes = {k: sum(map(len, d.values())) for k, d in said.items()}
    mean = sum(sizes.values()) / len(sizes)
    terms = [t for t in re.findall(r"\w+", query.lower())]
    out = Counter()
    for i, term in enumerate(terms):
        words, last = [w for w in term.split("_") if w], i == len(terms) - 1
        f = Counter()
        for k, fields in said.items():
            for name, ws in fields.items():
                for j in range(len(ws)):
                    here = ws[j : j + len(words)]
                    if len(here) == len(words) and here[:-1] == words[:-1] and (here[-1].startswith(words[-1]) if last else here[-1] == words[-1]):
                        f[k] += lexical.WEIGHTS[name]
        n = len(f)
        idf = math.log((len(said) - n + 0.5) / (n + 0.5)) if n else 0
        idf = idf if idf > 0 else 1e-6
        for k, x in f.items():
            out[k] += idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * sizes[k] / mean))
    return sorted(((-round(s, 6), k) for k, s in out.items()))[:limit]


QUERIES = ["task manag", "edit text fi", "list_pipe logon", "photo", "running_process see", "zebra", "s", "paint draw paint", "end_session task_manager_ed"]


def asked(spark, queries=QUERIES):
    return lexical.query_phrases(spark.createDataFrame(list(enumerate(queries)), "qid long, query string"))


def as_ranked(df):
    got = defaultdict(list)
    for r in df.orderBy("qid", "place").collect():
        got[r["qid"]].append((-r["score"], r["key"]))
    return got


@pytest.mark.parametrize("docs, first, queries", [(2048, 16, 20_000), (7, 1, 3), (1, 2, 20_000)])
def test_stored_scores(spark, monkeypatch, docs, first, queries):
    for name, value in (("DOCS", docs), ("FIRST", first), ("QUERIES", queries), ("BUCKETS", 5)):
        monkeypatch.setattr(postings, name, value)
    rows = corpus(120)
    stored = postings.indexed(spark.createDataFrame(rows, "key string, name string, details string"), "key", FIELDS)
    assert stored.docs.count() >= 120 // docs
    got = as_ranked(stored.bm25(asked(spark), 10, 6))
    for i, q in enumerate(QUERIES):
        assert got[i] == bm25_by_force(rows, q, 10), q


def test_bounds_leave_blocks_out(spark, monkeypatch):
    for name, value in (("DOCS", 5), ("FIRST", 2)):
        monkeypatch.setattr(postings, name, value)
    # short texts that say it often against long ones that say it once
    rows = [(f"a{i:03d}", "needle needle needle", "") for i in range(10)] + [(f"b{i:03d}", "", "needle " + "hay " * 200) for i in range(60)] + [(f"c{i:03d}", "hay", "") for i in range(400)]
    stored = postings.indexed(spark.createDataFrame(rows, "key string, name string, details string"), "key", FIELDS)
    tables = []
    keep = postings.scratch_table
    monkeypatch.setattr(postings, "scratch_table", lambda df, name: tables.append((name, keep(df, name))) or tables[-1][1])
    got = as_ranked(stored.bm25(asked(spark, ["needle hay"]), 5, 6))
    assert got[0] == bm25_by_force(rows, "needle hay", 5)
    seen = dict(tables)
    reached = -got[0][-1][0]
    assert 0 < seen["bounds"].where(F.col("bound") < reached).count() and seen["first"].count() >= 5


def test_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    """The words and the postings of texts are not tables of their own on the way: the task that reads a text writes them."""
    monkeypatch.setattr(postings, "scratch_table", lambda df, name: pytest.fail(f"{name} is written"))
    rows = corpus(60) + [("long", "", "pipe list " * 3000)]
    path = f"file://{tmp_path}/s"
    assert postings.write(spark.createDataFrame(rows, "key string, name string, details string"), "key", FIELDS, False, path) == 61
    kept = spark.read.parquet(path)
    assert kept.where("term is null").selectExpr("explode(keys)").count() == 61
    # two bytes a document, four a place
    row = kept.where("term = 'pipe'").selectExpr("sum(length(docs)) / sum(length(counts)) as docs", "sum(length(places)) as places").first()
    said = sum(len(re.findall(r"\bpipe\b", f"{a or ''} {b}")) for _, a, b in rows)
    assert row["docs"] == 0.5 and row["places"] == 4 * said


def test_batches_of_long_texts_are_bounded(spark, tmp_path, monkeypatch):
    """Texts come in the order of their lengths, so a batch of so many rows may hold nothing but the longest: with stems
    too, batches are bounded by bytes while texts are indexed, and as before afterwards."""
    monkeypatch.setattr(postings, "scratch_table", lambda df, name: pytest.fail(f"{name} is written"))
    monkeypatch.setattr(postings, "BATCH_BYTES", 4096)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), postings._small_batches(spark):
        assert spark.conf.get(name) == "4096"
        raise ValueError
    assert spark.conf.get(name) == before
    rows = [(f"k{i}", "", "editing files " * (10 * i)) for i in range(50)]
    path = f"file://{tmp_path}/s"
    postings.write(spark.createDataFrame(rows, "key string, name string, details string"), "key", FIELDS, True, path)
    got = {r["term"]: r["n"] for r in spark.read.parquet(path).where("term is not null").groupBy("term").agg((F.sum(F.length("places")) / 4).alias("n")).collect()}
    assert got == {"edit": 10 * 1225, "file": 10 * 1225}


def test_segments_and_superseded_documents(spark, tmp_path):
    rows = corpus(90)
    schema = "key string, name string, details string"
    parts = [rows[:40], rows[40:70], rows[70:]]
    changed = [(k, "pipe list", "edit the text files") for k, *_ in rows[:20]]
    paths = []
    for i, part in enumerate([*parts, changed]):
        paths.append(f"file://{tmp_path}/s{i}")
        postings.write(spark.createDataFrame(part, schema), "key", FIELDS, False, paths[-1])
    gone = spark.createDataFrame([(k,) for k, *_ in rows[:20]], "key string")
    stored = postings.Stored.open(spark, "string", False, [(paths[0], gone), (paths[1], None), (paths[2], None), (paths[3], None)], weights=[lexical.WEIGHTS[f] for f in FIELDS])
    live = rows[20:] + changed
    assert stored.totals()[0] == len(live)
    got = as_ranked(stored.bm25(asked(spark), 20, 6))
    for i, q in enumerate(QUERIES):
        assert got[i] == bm25_by_force(live, q, 20), q


def test_stored_postings_of_odd_texts(spark):
    rows = [("a", None, None), ("b", "", "--"), ("c", "word " * 30_000, "x"), ("d", "ünïcode word", "d_e")]
    stored = postings.indexed(spark.createDataFrame(rows, "key string, name string, details string"), "key", FIELDS)
    got = as_ranked(stored.bm25(asked(spark, ["word x", "ünïco"]), 10, 6))
    assert {k for _, k in got[0]} == {"c", "d"} and [k for _, k in got[1]] == ["d"]
    empty = postings.indexed(spark.createDataFrame([], "key string, name string, details string"), "key", FIELDS)
    assert empty.totals() == (0, 0.0) and empty.bm25(asked(spark), 10).count() == 0


# --------------------------------------------------------------------------- store


def tables_of(spark, ids, word="text"):
    ents = spark.createDataFrame([(i, 0, f"Thing {i}", 0, "t", None, None, None, "test", {"k": "v"}, word, None, None) for i in ids], ENTITIES)
    docs = spark.createDataFrame([(i, p, p == "web", f"{word} {i}", None, None) for i in ids for p in ("local", "web")], DOCUMENTS)
    profiles = spark.createDataFrame([(i, f"{word} of {i}", ["do it"], [], None, None, None, "h") for i in ids], PROFILES)
    vectors = spark.createDataFrame([(i, [1.0, float(len(i))]) for i in ids], "id string, embedding array<double>")
    return ents, docs, profiles, vectors


def size_of(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith((".parquet", ".json")))


def test_small_upserts_write_little(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/i")
    store.initialize("m", 2)
    rng = random.Random(1)
    ids = [f"t:{i:05d}" for i in range(3000)]
    ents, docs, profiles, vectors = tables_of(spark, ids)
    big = profiles.withColumn("details", F.concat_ws(" ", *(F.sha2(F.concat("entity_id", F.lit(str(j))), 512) for j in range(12))))
    store.upsert(ents, docs, big, vectors)
    before, written = size_of(tmp_path), {f for d, _, fs in os.walk(tmp_path) for f in (os.path.join(d, x) for x in fs)}
    some = rng.sample(ids, 30)
    e, d, p, v = tables_of(spark, some, "new")
    store.upsert(e, d, p, v)
    assert size_of(tmp_path) - before < 0.06 * before  # one in a hundred, and the files' own heads
    assert written <= {f for d, _, fs in os.walk(tmp_path) for f in (os.path.join(d, x) for x in fs)}  # nothing was rewritten
    now = {r["id"]: r for r in store.read("entities").collect()}
    assert len(now) == 3000 and {i for i, r in now.items() if r["content_hash"] == "new"} == set(some)
    assert store.read("vectors").count() == 3000 and sorted(r["vector_ordinal"] for r in now.values()) == list(range(3000))
    hits = store.texts().bm25(lexical.query_phrases(spark.createDataFrame([(0, "new thing")], "qid long, query string"), True), 100)
    assert {r["key"] for r in hits.collect() if r["place"] <= 30} == set(some)
    # compacting and dropping old files changes no row
    store.remove(spark.createDataFrame([(i,) for i in ids[:100]], "id string"))
    rows = {t: sorted(map(str, store.read(t).collect())) for t in ("entities", "documents", "profiles", "vectors")}
    assert store.compact(force=True) and store.vacuum(1) > 0 and len(store.log.numbers()) == 1
    assert rows == {t: sorted(map(str, store.read(t).collect())) for t in rows}
    assert store.texts().totals()[0] == 2900 and not store.log.latest()["tables"]["entities"]["deletes"]


def test_readers_see_whole_snapshots(spark, tmp_path):
    """A reader beside a writer sees the tables of one commit, at any time."""
    store = IndexStore(spark, f"file://{tmp_path}/i")
    store.initialize("m", 2)
    ids = [f"t:{i}" for i in range(20)]
    store.upsert(*tables_of(spark, ids, "0"))
    held = store.snapshot()  # before the changes: stays as it is
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            s = IndexStore(spark, f"file://{tmp_path}/i").snapshot()
            words = {r[0] for r in s["entities"].select("content_hash").collect()} | {r[0].split()[0] for r in s["documents"].select("text").collect()} | {r[0].split()[0] for r in s["profiles"].select("summary").collect()}
            seen.append((words, s["entities"].count(), s["documents"].count()))

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for i in range(1, 4):
            store.upsert(*tables_of(spark, ids, str(i)))
    finally:
        stop.set()
        reader.join()
    assert seen and all(len(words) == 1 and n == 20 and m == 40 for words, n, m in seen)
    assert {r[0] for r in held["entities"].select("content_hash").collect()} == {"0"}
    assert {r[0] for r in store.read("entities").select("content_hash").collect()} == {"3"}


def test_of_two_writers_one_begins_again(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    store = IndexStore(spark, root)
    store.initialize("m", 2)
    log = Log(spark, root)
    state = log.latest()
    log.commit(state | {"version": state["version"] + 1})
    with pytest.raises(Conflict):
        log.commit(state | {"version": state["version"] + 1})
    assert not [f for f in os.listdir(tmp_path / "i" / "commits") if "aside" in f and not f.endswith(".crc")]
    launches = lambda n: spark.createDataFrame([("x", f"2024-01-0{i + 1}") for i in range(n)], "entity_id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    threads = [threading.Thread(target=IndexStore(spark, root).record, args=(launches(2),)) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (row,) = store.read("usage_stats").collect()
    assert row["launch_count"] == 6
    store.initialize("other", 3)  # another model: content goes, usage stays
    assert store.read("usage_stats").count() == 1 and store.status()["model"] == "other"


def test_batches_are_published_once(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/i")
    store.initialize("m", 2)
    ents, docs, profiles, _ = tables_of(spark, ["a", "b"])
    first = store.publish(batch=4, entities=ents, documents=docs, profiles=profiles)
    assert store.publish(batch=4, entities=ents.limit(0)) == first and store.publish(batch=3, entities=ents.limit(0)) == first and store.count() == 2
    assert store.publish(batch=5, entities=ents.where("id = 'a'")) == first + 1 and store.count() == 1 and store.texts().totals()[0] == 1


def test_types_of_columns_decide_on_compatibility(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/i")
    store.initialize("m", 2)
    ents, docs, profiles, _ = tables_of(spark, ["a"])
    store.publish(entities=ents, documents=docs, profiles=profiles)
    assert store.compatible("m") and not store.compatible("n")
    store.publish(vectors=spark.createDataFrame([("0", [1.0])], "vector_ordinal string, embedding array<double>"))
    assert not store.compatible("m")


# --------------------------------------------------------------------------- names


def test_ordered_pairs(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 9))).strip() for _ in range(300)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", names.ordered_pairs(F.col("t"))).collect()}
    for t, pairs in got.items():
        c = t.replace(" ", "")
        assert sorted(pairs) == sorted({c[i] + c[j] for i in range(len(c)) for j in range(i + 1, len(c))} | set(c)), t


def test_names_meet_by_equality(spark):
    rng = random.Random(3)
    words = ["Visual", "Studio", "Code", "Task", "Manager", "Text", "x86", "Editor", "über", "Bar-Fly", "a", "Ab"]
    called = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(150)})
    queries = ["vsc", "vscode", "task", "t m", "tm", "e", "zz", "a", "visual studio code", "ub", "ÜBER", "bf", "barfly", " ", "tsk mngr"] + ["".join(rng.choice("vistaek m") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    q = spark.createDataFrame([(i, x) for i, x in enumerate(queries)], "qid long, query string")
    n = spark.createDataFrame([(x,) for x in called], "name string")
    found = search.name_matches(q, n, RankingOptions())
    got = {(r["qid"], r["name"]): (r["strength"], r["reason"]) for r in found.collect()}
    strength, reason = names.match_strength(F.col("query"), F.col("name"))
    every = {(r["qid"], r["name"]): (r["s"], r["r"]) for r in q.crossJoin(n).select("qid", "name", strength.alias("s"), reason.alias("r")).where("s > 0").collect()}
    assert got == every and len(got) > 300
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# --------------------------------------------------------------------------- greedy claims


def claims_by_force(rows):
    owner, out = {}, {}
    for id_, _, keys in sorted(rows, key=lambda r: (r[1], r[0])):
        survivor = next((owner[k] for k in keys if k in owner), None) or id_
        for k in keys:
            owner.setdefault(k, survivor)
        out[id_] = survivor
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_claims_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 200
    rows = [(f"r{i:03d}", rng.randint(0, 20), [f"k{rng.randint(0, n * (seed + 1) // 2)}" for _ in range(rng.randint(0, 3))]) for i in range(n)]
    got = {r["id"]: r["survivor"] for r in build.greedy_groups(spark.createDataFrame(rows, "id string, rank int, keys array<string>"), ["rank"]).collect()}
    assert got == claims_by_force(rows)


def test_greedy_claims_of_a_chain(spark):
    rows = [(f"r{i:03d}", i, [f"k{i}", f"k{i + 1}"]) for i in range(300)]
    got = {r["id"]: r["survivor"] for r in build.greedy_groups(spark.createDataFrame(rows, "id string, rank int, keys array<string>"), ["rank"]).collect()}
    assert got == claims_by_force(rows)


def test_one_large_group_is_spread_over_tasks(spark):
    n = 200_000
    rows = spark.range(n).select(F.format_string("r%07d", "id").alias("id"), F.lit(0).alias("rank"), F.array(F.concat(F.lit("a"), (F.col("id") % 997).cast("string")), F.concat(F.lit("b"), (F.col("id") % 991).cast("string"))).alias("keys"))
    out = build.greedy_groups(rows, ["rank"]).withColumn("task", F.spark_partition_id())
    assert out.count() == n and out.where("id < survivor").count() == 0
    assert out.groupBy("task").count().agg(F.max("count")).first()[0] < 0.8 * n


def test_many_keys_are_not_sent_to_the_driver(spark, tmp_path, monkeypatch):
    """Files of keys are small, their rows are not: beyond a number of rows tables meet by a shuffle."""
    monkeypatch.setattr(store_module, "SMALL", 3)
    store = IndexStore(spark, f"file://{tmp_path}/s")
    store.initialize("m", 2)
    ids = spark.range(40).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"))
    ents = lambda rows, said: rows.select("id", F.lit(said).alias("display_name"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in ENTITIES if f.name not in ("id", "display_name"))).select(*ENTITIES.names)
    docs, profiles = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], PROFILES)
    vectors = lambda rows: rows.select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    store.upsert(ents(ids, "old"), docs, profiles, vectors(ids))
    again = ids.where("id like 'e1%'")
    store.upsert(ents(again, "new"), docs, profiles, vectors(again))
    store.remove(ids.where("id like '%7'"))
    plan = store.read("entities")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan
    got = {r["id"]: (r["display_name"], r["vector_ordinal"]) for r in store.read("entities").collect()}
    assert {k: v[0] for k, v in got.items()} == {f"e{i}": "new" if str(i).startswith("1") else "old" for i in range(40) if i % 10 != 7}
    assert len({v[1] for v in got.values()}) == len(got) == 36 and store.read("vectors").count() == 40
