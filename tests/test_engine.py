"""Units of the retrieval engine against small literals."""

from __future__ import annotations

import random
import sqlite3
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseek.functions import names, porter, text
from sparkseek.operators import browse, build, fusion, lexical, vector
from sparkseek.operators.postings import indexed
from sparkseek.plans.search import literal_arm
from sparkseek.schema import DOCUMENTS, ENTITIES, PROFILES, RankingOptions
from sparkseek.sources import collectors
from sparkseek.sources.store import IndexStore
from sparkseek.streaming import usage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def strength(spark, query, name):
    return one(spark, names.match_strength(F.lit(query), F.lit(name))[0])


@pytest.mark.parametrize("query", ["vsc", "vsco", "vscod", "vscode"])
@pytest.mark.parametrize("name", ["Visual Studio Code", "Microsoft Visual Studio Code"])
def test_initials_reach_the_name(spark, query, name):
    assert strength(spark, query, name) >= 0.6


@pytest.mark.parametrize("query, name", [("vsco", "x86 Native Tools Command Prompt for VS 2022"), ("vsco", "Microsoft Visual C++ 2013 Redistributable (x86)"), ("vsc", "Windows Security")])
def test_initials_do_not_reach_others(spark, query, name):
    assert strength(spark, query, name) < 0.6


def test_name_order(spark):
    exact, prefix, acronym = strength(spark, "Task Manager", "task manager"), strength(spark, "task", "Task Manager"), strength(spark, "tm", "Task Manager")
    assert exact > prefix > acronym > 0
    assert strength(spark, "", "Task Manager") == 0 == strength(spark, "zzz", "Task Manager")


def test_initials_by_brute_force():
    def brute(q, words):
        return q == "" or any(q.startswith(w[:n]) and brute(q[n:], words[i + 1 :]) for i, w in enumerate(words) for n in range(1, len(w) + 1) if q.startswith(w[:n]))

    rng = random.Random(5)
    for _ in range(3000):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
        q = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        assert names.initials_prefix(q, words) == brute(q, words)


def test_stems_equal_sqlite():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    words = "processes process processing running files editing terminated relational conditional happiness hopeful electricity adjustable Café naïve flies sky controlling rolls".split()
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(words)))
    assert {d: t for t, d in con.execute("select term, doc from v")} == {i: porter.tokens(w)[0] for i, w in enumerate(words)}


def test_bm25_equals_sqlite(spark):
    rows = [(1, "task manager", "end a process and see processes"), (2, "text editor", "edit text files"), (3, "pipe list", "list pipes of each process"), (4, "logon sessions", "list sessions and running processes"), (5, "paint", "draw pictures"), (6, "photo viewer", "see photos")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(name, summary, tokenize='porter unicode61 remove_diacritics 2')")
    con.executemany("insert into t(rowid, name, summary) values (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id long, name string, summary string")
    postings = indexed(df, "id", ["name", "summary"], stem=True)
    for query, match in (("running process", '"running" OR "process"*'), ("edit file", '"edit" OR "file"*'), ("list processe", '"list" OR "processe"*'), ("task_manager text_fil", '"task_manager" OR "text_fil"*'), ("manager_task", '"manager_task"*')):
        asked = spark.createDataFrame([(0, query)], "qid long, query string")
        got = {r["id"]: r["score"] for r in postings.bm25(lexical.query_phrases(asked, True)).collect()}
        want = dict(con.execute("select rowid, -bm25(t, 1.0, 3.0) from t where t match ?", (match,)).fetchall())
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tiers(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([1.0, 0.97, 0.94, 0.93, 0.5])], "qid int, k int, score double")
    assert [r["tier"] for r in fusion.tiered_ranks(df, "k").orderBy("k").collect()] == [0, 0, 2, 2, 4]


def test_mean_pool(spark):
    states = F.lit([[1.0, 0.0], [100.0, 100.0], [3.0, 4.0]])
    got = one(spark, vector.mean_pool(states, F.lit([1, 0, 1])))
    assert got == pytest.approx([0.70710678, 0.70710678])


def test_scrub(spark):
    said = "Open https://a.b/c or mail x@y.org {01234567-89ab-cdef-0123-456789abcdef} HKEY_LOCAL_MACHINE\\Soft C:\\Temp\\x.txt %PATH% 0123456789abcdef0 at 3:30. Note: fine"
    got = one(spark, text.scrub(F.lit(said)))
    assert "3:30" in got and "Note: fine" in got
    assert not any(x in got for x in ("https", "x@y", "cdef", "HKEY", "Temp", "%PATH"))


def test_prose_and_listing(spark):
    prose = "This is the program that lets you see what runs on your computer and end it"
    assert one(spark, text.is_prose(F.lit(prose))) and not one(spark, text.is_listing(F.lit(prose)))
    titles = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda"
    assert one(spark, text.is_listing(F.lit(titles))) and not one(spark, text.is_prose(F.lit(titles)))


def test_html(spark):
    page = '<html><head><title>x</title><meta name="description" content="What it &amp; others do"></head><body><p>One</p><script>no</script><p>Two &lt;3</p></body>'
    assert one(spark, text.meta_description(F.lit(page))) == "What it & others do"
    assert "no" not in one(spark, text.strip_html(F.lit(page))) and "Two <3" in one(spark, text.strip_html(F.lit(page)))


def test_usage_and_penalty(spark):
    boost = lambda n, days: one(spark, fusion.usage_boost(F.lit(n), F.lit("2024-01-01").cast("timestamp"), F.lit(f"2024-01-{1 + days:02d}").cast("timestamp")))
    assert boost(0, 0) == 0 and boost(49, 0) == pytest.approx(0.014) and boost(49, 7) == pytest.approx(0.011)


def test_greedy_keeps_earlier_survivors_apart(spark):
    rows = spark.createDataFrame([("a", 0, ["x"]), ("b", 1, ["y"]), ("c", 2, ["y", "x", "z"]), ("d", 3, ["z"]), ("e", 4, ["w"])], "id string, rank int, keys array<string>")
    got = {r["id"]: r["survivor"] for r in build.greedy_groups(rows, ["rank"]).collect()}
    assert got == {"a": "a", "b": "b", "c": "b", "d": "b", "e": "e"}


def test_path_executables(spark):
    rows = [("d1", 1, "a.exe", 0), ("d2", 2, "A.EXE", 5), ("d2", 2, "b.exe", 7), ("d3", 3, "b.exe", 9), *[("big", 0, f"{i}.exe", 1) for i in range(513)]]
    got = collectors.path_executables(spark.createDataFrame(rows, "directory string, position int, file string, size long")).collect()
    assert [(r["directory"], r["file"]) for r in got] == [("d2", "b.exe")]


def test_catalogue(spark):
    cat = spark.createDataFrame([("Media", "Media Feature"), ("Print", "Print Feature"), ("None", "No Feature")], "prefix string, display_name string")
    packages = spark.createDataFrame([("Media~1", "Staged", 1), ("media-x~2", "Installed", 2), ("Media~3", "Staged", 3), ("Print~1", "A", 1), ("Print~2", "B", 2)], "name string, state string, position int")
    assert {r["prefix"]: r["state"] for r in collectors.catalogue_states(cat, packages).collect()} == {"Media": "Installed", "Print": "B", "None": None}


def test_discover_rejects_unknown(spark):
    rows = collectors.settings_pages(spark).where("display_name = 'Display'")
    assert collectors.discover({"mssettings": lambda: rows}).first()["id"] == "mssettings:ms-settings:display"
    with pytest.raises(ValueError):
        collectors.discover({"mssettings": lambda: rows}, ["other"])


def test_store_round_trip(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    with pytest.raises(FileNotFoundError):
        store.open_read_only("m", 3)
    store.initialize("m", 3)
    ents = spark.createDataFrame([(f"test:{i}", 0, f"Thing {i}", 0, "t", None, None, None, "test", {"k": "v"}, "h", i, None) for i in range(5)], ENTITIES)
    docs = spark.createDataFrame([(f"test:{i}", p, p == "web", f"text {i}", None, None) for i in range(5) for p in ("local", "web")], DOCUMENTS)
    profiles = spark.createDataFrame([(f"test:{i}", "sum", ["a"], [], None, None, None, "h") for i in range(5)], PROFILES)
    store.upsert(ents, docs, profiles)
    assert store.count() == 5 and store.read("documents").count() == 10 and store.compatible("m")
    again = ents.where("id = 'test:1'").withColumn("vector_ordinal", F.lit(None).cast("int")).withColumn("display_name", F.lit("New"))
    store.upsert(again, docs.where("entity_id = 'test:1' and not is_online"), profiles.where("entity_id = 'test:1'"))
    row = store.read("entities").where("id = 'test:1'").first()
    assert (row["display_name"], row["vector_ordinal"], store.count(), store.read("documents").count()) == ("New", 1, 5, 9)
    store.purge_online()
    assert store.read("documents").count() == 5
    at = spark.createDataFrame([("test:0", datetime(2024, 1, 1)), ("test:0", datetime(2024, 1, 2))], "entity_id string, at timestamp")
    store.record(at)
    store.remove(spark.createDataFrame([("test:0",)], "id string"))
    assert store.count() == 4 and store.read("usage_stats").first()["launch_count"] == 2
    store.initialize("other", 3)
    assert store.count() == 0 and store.read("usage_stats").first()["launch_count"] == 2
    with pytest.raises(ValueError):
        store.open_read_only("m", 3)


def test_refresh_due():
    start = datetime(2026, 9, 13, 9)
    state = lambda **x: usage.RefreshState(**({"now": start + timedelta(minutes=1), "started": start, "count": 583} | x))
    assert not usage.refresh_due(state()) and usage.refresh_due(state(now=start + timedelta(minutes=2)))
    late = {"now": start + timedelta(hours=3), "last_end": start}
    assert usage.refresh_due(state(**late)) and not usage.refresh_due(state(**late, running=True)) and not usage.refresh_due(state(**late, count=0)) and not usage.refresh_due(state(**late, enabled=False))
    changed = start + timedelta(minutes=10)
    assert not usage.refresh_due(state(now=changed + timedelta(seconds=44), last_end=start, last_change=changed))
    assert usage.refresh_due(state(now=changed + timedelta(seconds=45), last_end=start, last_change=changed))


def test_stream_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, i)) for i in range(4)] + [("b", datetime(2024, 1, 1))], "entity_id string, at timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    stream = usage.launch_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["entity_id"]: r["launch_count"] for r in spark.table("counts").collect()} == {"a": 4, "b": 1}


def test_browse(spark):
    ents = spark.createDataFrame([(f"s:{i}", i % 8, f"Name {i}", "x") for i in range(9)], "id string, kind int, display_name string, publisher string").withColumn("source", F.lit("s")).withColumn("category", F.lit(None).cast("string"))
    page = browse.list_entities(ents, limit=4)
    assert browse.next_cursor(page, 4).first()[0] == "s:3" and browse.next_cursor(browse.list_entities(ents, after="s:6", limit=4), 4).first()[0] is None
    assert browse.parse_kind("shelllocation") == 7
    with pytest.raises(ValueError):
        browse.parse_kind("nothing")
    assert not browse.get_entity(ents, "s:99").first()["found"] and browse.get_entity(ents, "s:1").first()["found"]


def test_options(spark):
    spark.conf.set("spark.hybrid.rrf_k", "10")
    try:
        assert RankingOptions.from_conf(spark).rrf_k == 10
    finally:
        spark.conf.unset("spark.hybrid.rrf_k")
    assert RankingOptions().without_floors().min_vector_score == 0


def test_literal_arm_keeps_every_match(spark):
    """More than a thousand entities of one name, and a name and query of more than 64 characters."""
    long = "tool " * 20 + "end"
    ents = spark.createDataFrame([(i, "Paint") for i in range(1200)] + [(5000, long)], "key long, display_name string")
    asked = spark.createDataFrame([(1, "paint"), (2, long)], "qid long, query string")
    got = literal_arm(asked, ents, RankingOptions()).select("qid", "key").collect()
    assert {r["key"] for r in got if r["qid"] == 1} == set(range(1200)) and [r["key"] for r in got if r["qid"] == 2] == [5000]


def test_many_values_are_told_apart_ignoring_case_in_linear_time(spark):
    """An expression used within a lambda is computed for each element: 6,000 compounds took minutes."""
    import time

    from sparkseek.functions import synthesis

    said = " ".join(f"Ab-c{i % 3000} aB-C{i % 3000}" for i in range(3000))
    start = time.time()
    folded = spark.createDataFrame([(said,)], "t string").select(text.fold_compounds(F.col("t")).alias("x")).first()[0]
    assert folded == said + " " + " ".join(f"Abc{i}" for i in range(3000)) and time.time() - start < 20
    values = spark.createDataFrame([(["b", "A", " ", "a", "B", None, "c"],)], "v array<string>")
    assert values.select(synthesis.distinct_ignoring_case(F.col("v"), 2).alias("x")).first()[0] == ["b", "A"]


def test_texts_of_an_array_are_cleaned_as_each_alone(spark):
    rows = spark.createDataFrame([("<p>a &amp;lt;b&gt;  c</p>", "x &amp; y\n\n z", None, "")], "a string, b string, c string, d string")
    each = rows.select(F.array(*(text.plain_text(F.col(c)) for c in "abcd")).alias("x")).first()[0]
    assert rows.select(text.plain_texts(F.array(*"abcd")).alias("x")).first()[0] == each


def test_aliases_meet_hosts_by_equal_beginnings(spark):
    """Many hosts of one folder and name: each command meets the first alone, not all of them."""
    commands = spark.createDataFrame([(1, "C:/A/x.exe", "Tool"), (2, "c:/a/B/y.exe", "tool"), (3, "c:/z", "tool"), (4, None, "tool")], "id int, exe string, display_name string")
    hosts = spark.range(2000).select(F.col("id"), F.when(F.col("id") == 1500, "c:/a/b/").otherwise("c:/A/").alias("folder"), F.lit("Tool").alias("display_name"), (2000 - F.col("id")).alias("position"))
    joined = build.fold_aliases(commands, hosts)
    assert sorted(map(tuple, joined.collect())) == [(1, 1999), (2, 1999)]
    plan = joined._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "startswith" not in plan  # no pairs by condition


def test_vector_scores_are_made_in_bounded_pieces(spark, monkeypatch):
    """A task makes ``SCORES`` scores at a time, with the same result."""
    rows = spark.range(300).select(F.col("id").alias("k"), F.array(F.cos(F.col("id")), F.sin(F.col("id"))).alias("v"))
    asked = rows.where("k % 3 = 0").withColumnRenamed("k", "qid")
    every = [sorted(map(tuple, vector.scores(rows, asked, "k", "v", k=k).collect())) for k in (None, 5)]
    monkeypatch.setattr(vector, "SCORES", 250)
    assert [sorted(map(tuple, vector.scores(rows, asked, "k", "v", k=k).collect())) for k in (None, 5)] == every
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["k"])
    cut = list(vector.pieces(iter([batch]), 100))
    assert max(x.num_rows for x in cut) == 2 and [k for x in cut for k in x.column(0).to_pylist()] == list(range(1000))


def test_nearest_by_id_reads_neighbours_in_order(spark):
    from sparkseek.plans import catalog

    rows = spark.range(0, 3000, 7).select(F.col("id").alias("vec_id"), (F.col("id") % 3).alias("label"))
    got = sorted(map(tuple, catalog._by_distance(rows, rows.where("vec_id % 100 = 0"), 100).collect()))
    both = rows.collect()
    want = []
    for q in both:
        if q[0] % 100 == 0:
            near = sorted((r[0] for r in both if r[1] == q[1]), key=lambda v, q=q: (abs(v - q[0]), v))
            want += [(q[0], v, i + 1) for i, v in enumerate(near[:100])]
    assert got == sorted(want)
