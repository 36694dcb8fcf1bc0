"""Manifests, probed articles, paced requests, builds in waves, functions of SQL."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkseek.functions import registry
from sparkseek.operators import fusion
from sparkseek.operators.embed import HashEmbedder
from sparkseek.plans import catalog, index
from sparkseek.sources import collectors, enrichers, manifests
from sparkseek.sources.store import IndexStore
from sparkseek.streaming import state

MANIFEST = """# comment
---
PackageIdentifier: Foo.Bar
PackageName: "Foo: \\"Bar\\"" # x
Publisher: 'It''s Foo'
Moniker: ~
Url: https://foo.example/a#b
Tags:
- one
- two # c
Installers:
  - Architecture: x64
    InstallerUrl: https://x/y
    Switches:
      Silent: /S
      Modes:
        - a
        - b
  - Architecture: arm64
    InstallerSha256: ABC
    Nested:
    - Path: z.exe
      Alias: z
    - Path: q.exe
Description: |
  line one
    deeper
  line two

ShortDescription: >-
  folded
  text
broken line here
PackageVersion: 1.0
Last:
"""
VALUES = [
    ("PackageIdentifier", "Foo.Bar"), ("PackageName", 'Foo: "Bar"'), ("Publisher", "It's Foo"), ("Moniker", None), ("Url", "https://foo.example/a#b"), ("Tags[0]", "one"), ("Tags[1]", "two"),
    ("Installers[0].Architecture", "x64"), ("Installers[0].InstallerUrl", "https://x/y"), ("Installers[0].Switches.Silent", "/S"), ("Installers[0].Switches.Modes[0]", "a"), ("Installers[0].Switches.Modes[1]", "b"),
    ("Installers[1].Architecture", "arm64"), ("Installers[1].InstallerSha256", "ABC"), ("Installers[1].Nested[0].Path", "z.exe"), ("Installers[1].Nested[0].Alias", "z"), ("Installers[1].Nested[1].Path", "q.exe"),
    ("Description", "line one\n  deeper\nline two"), ("ShortDescription", "folded text"), ("?", "broken line here"), ("PackageVersion", "1.0"),
]


def test_manifests(spark):
    assert manifests.parse(MANIFEST) == VALUES
    found = manifests.fields(spark.createDataFrame([(1, MANIFEST), (2, None), (3, ""), (4, "%$\n\t\n: x\n- - y")], "id long, text string"))
    got = {}
    for r in found.orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append((r["path"], r["value"]))
    assert got[1] == VALUES and set(got) == {1, 4} and got[4][0] == ("?", "%$")
    (package,) = manifests.packages(found.where("id = 1"), "id").collect()
    assert (package["name"], package["publisher"], package["version"], package["text"]) == ('Foo: "Bar"', "It's Foo", "1.0", "line one deeper line two Tags: one, two.")
    assert sorted((r["n"], r["architecture"], r["url"], r["sha256"]) for r in manifests.installers(found, "id").collect()) == [(0, "x64", "https://x/y", None), (1, "arm64", None, "ABC")]
    matched = enrichers.package_matches(spark.createDataFrame([("e", "Foo Bar", None)], "id string, display_name string, publisher string"), manifests.packages(found.where("id = 1"), "id"))
    assert matched.first()["text"].startswith("line one")


def test_manifests_of_any_text():
    rng = random.Random(1)
    bits = ["a:", "b: 1", "- ", "- x: 1", "  ", "    ", "|", ">", "\n", "\n", "#", '"', "'", ":", "\t", "- - z", "é"]
    for _ in range(3000):
        for path, value in manifests.parse("".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))):
            assert isinstance(path, str) and (value is None or isinstance(value, str))


def test_functions_of_sql_over_tables(spark):
    registry.register(spark)
    spark.createDataFrame([(1, MANIFEST), (2, None)], "id long, text string").createOrReplaceTempView("manifest_texts")
    rows = spark.sql("select id, path, value, position from manifest_texts, lateral manifest_fields(text) order by position").collect()
    assert [(r["path"], r["value"]) for r in rows] == VALUES and [r["position"] for r in rows] == list(range(len(VALUES)))
    rng = random.Random(2)
    scores = [(q, f"k{i}", round(rng.uniform(-0.2, 1), 3)) for q in range(4) for i in range(30)]
    df = spark.createDataFrame(scores, "qid long, key string, score double")
    df.createOrReplaceTempView("scored")
    got = {r["qid"]: r["t"] for r in spark.sql("select qid, tier_starts(score) as t from scored group by qid").collect()}
    tiers = fusion.tiered_ranks(df, "key").groupBy("qid", "tier").agg(F.max("score").alias("s")).collect()
    assert got == {q: sorted((r["s"] for r in tiers if r["qid"] == q), reverse=True) for q in range(4)}


def test_sibling_articles(spark):
    ents = spark.createDataFrame([("e", "Process Explorer"), ("f", "Run"), ("g", "Disk Tool")], "id string, display_name string")
    near = [("e", "https://Docs.example/en/tools/tcpview?x=1", 0), ("e", "https://Docs.example/en/tools/handle/", 1), ("e", "https://docs.example/en/", 2), ("e", "https://docs.example/en/other/a#b", 3), ("e", "https://docs.example/en/third/a", 4), ("f", "https://docs.example/en/tools/run-x", 0)]
    known = spark.createDataFrame([("https://docs.example/en/other/process-explorer",)], "url string")
    got = {(r["entity_id"], r["url"]): r["position"] for r in enrichers.sibling_candidates(ents, spark.createDataFrame(near, "entity_id string, url string, position int"), known).collect()}
    assert got == {("e", "https://Docs.example/en/tools/process-explorer"): 0, ("e", "https://Docs.example/en/tools/processexplorer"): 1, ("e", "https://docs.example/en/other/processexplorer"): 4}
    pages = spark.createDataFrame([(u, 0) for _, u, _ in near] + [("https://docs.example/en/third/b", 0)], "url string, n int")
    assert {(r["directory"], r["pages"]) for r in enrichers.url_templates(pages).collect()} == {("https://Docs.example/en/tools/", 2), ("https://docs.example/en/third/", 2)}
    html = lambda t: f"<html><title>{t}</title></html>"
    fetched = spark.createDataFrame([("e", "u1", 0, html("Docs home")), ("e", "u2", 1, html("Process Explorer - Tools | Docs")), ("e", "u3", 2, html("Process Explorer")), ("g", "u4", 0, None)], "entity_id string, url string, position int, html string")
    assert [(r["entity_id"], r["url"], r["how"]) for r in enrichers.probed_articles(ents, fetched).collect()] == [("e", "u2", "slug")]


def test_paced_requests(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b"]), i, t0 + timedelta(seconds=rng.randint(0, 600))) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = state.paced(spark.createDataFrame(rows, "host string, id long, at timestamp").repartition(7), 1500)
    got = {r["id"]: r["due"] for r in out.collect()}
    last = {}
    for host, i, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last[host] = at if host not in last else max(at, last[host] + timedelta(milliseconds=1500))
        assert got[i] == last[host]
    assert out.where("host = 'hot'").groupBy(F.spark_partition_id()).count().count() > 1  # not even one host is one task
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_builds_in_waves(spark, tmp_path):
    """Interrupted after its first wave, and resumed: the same index as one run makes."""
    rows = [(f"k{i}", f"Tool {i} {'abcdefgh'[i]}", f"Does the thing number {i} for you") for i in range(8)]
    df = spark.createDataFrame(rows, "key string, display_name string, description string")
    found = collectors.conform(df.select("key", "display_name", F.lit(0).alias("kind"), F.lit(1).alias("launch_kind"), F.concat(F.lit("D:\\p\\"), "key", F.lit(".exe")).alias("launch_target"), F.create_map(F.lit("description"), F.col("description")).alias("raw_metadata")), "startmenu").withColumn("rank", F.lit(0))
    model = HashEmbedder(16)
    whole, halves = (IndexStore(spark, f"file://{tmp_path}/{n}") for n in ("whole", "halves"))
    one = index.run_build(whole, found, [], model)
    assert (one["added"], one["waves"]) == (8, 1)

    class Stop(Exception):
        pass

    def stop(done, of):
        assert of == 3
        if done == 1:
            raise Stop

    with pytest.raises(Stop):
        index.run_build(halves, found, [], model, index.BuildOptions(wave=3), after_wave=stop)
    finished = halves.content_hashes().count()
    assert 0 < finished < 8 and halves.count() == 8  # all can be found, some are whole
    again = index.run_build(halves, found, [], model, index.BuildOptions(wave=3))
    assert (again["unchanged"], again["updated"], again["embedded"]) == (finished, 8 - finished, 8 - finished)
    same = lambda s: sorted((r["id"], r["content_hash"], r["display_name"]) for r in s.read("entities").collect())
    assert same(whole) == same(halves) and halves.read("vectors").count() == 8
    assert index.run_build(halves, found, [], model)["unchanged"] == 8
    by_id = lambda s: {r["id"]: [round(x, 5) for x in r["embedding"]] for r in s.read("entities").join(s.read("vectors"), "vector_ordinal").collect()}
    assert by_id(whole) == by_id(halves)


def test_manifests_are_parsed_in_batches(spark, sf):
    """The table function of SQL is one call of Python a batch, and the parts of one small file are several tasks."""
    rows = catalog.QUERIES["manifest_fields"](spark, sf)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "UDTF" not in plan and "Join" not in plan
    assert catalog._manifests(spark, sf).rdd.getNumPartitions() > 1
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "A: 1\nB: ~\n"), (4, "A: 2")], "id int, text string")
    got = spark.sql("SELECT id, path, value, position FROM {t}, LATERAL manifest_fields(text) ORDER BY id, position", t=texts).collect()
    assert [tuple(r) for r in got] == [(3, "A", "1", 0), (3, "B", None, 1), (4, "A", "2", 0)]
