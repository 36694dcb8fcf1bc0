"""Enrichers over small harvested tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkseek.functions import synthesis, text
from sparkseek.sources import enrichers


def texts(df):
    return {r["entity_id"]: r["text"] for r in df.collect()}


def test_local(spark):
    version = spark.createDataFrame([("a", "Thing", "Does things", "n/a"), ("b", "", None, "TODO")], "entity_id string, product_name string, file_description string, company string")
    assert texts(enrichers.version_resources(version)) == {"a": "Product name: Thing\nFile description: Does things"}
    links = spark.createDataFrame([("a", "Edit text", "Tools\\Text"), ("b", None, None)], "entity_id string, comment string, folder string")
    assert texts(enrichers.shortcuts(links)) == {"a": "Edit text Categorized under Tools, Text in the Start Menu."}
    files = spark.createDataFrame([("a", "README.md", 0, 10, "# Title\nBody"), ("a", "LICENSE.md", 0, 10, "x"), ("a", "other.md", 0, 10, "y"), ("a", "other.exe", 0, 1, ""), ("a", "big.md", 0, 300000, "z")], "entity_id string, file string, depth int, size long, text string")
    assert texts(enrichers.local_notes(files)) == {"a": "Title Body"}


def test_help(spark):
    usage = "Usage: thing [options]\n" + "\n".join(f"  -{c}  does something useful" for c in "abcdef")
    rows = [("a", 1, "unknown option\n", 1), ("a", 2, usage, 0), ("b", 1, usage, 1), ("c", 1, "Unhandled exception\n" + usage * 3, 0), ("d", 1, "x" * 500, 0)]
    assert texts(enrichers.command_help(spark.createDataFrame(rows, "entity_id string, switch_position int, text string, exit_code int"))) == {"a": usage}


def test_packages(spark):
    ents = spark.createDataFrame([("e", "Photo Viewer", "Acme Inc"), ("f", "Photo Viewer", "Other"), ("g", "a", None)], "id string, display_name string, publisher string")
    packs = spark.createDataFrame([("Acme Photo Viewer", "Acme", "1.2", "old"), ("Acme Photo Viewer", "Acme", "1.10", "new"), ("Photo", "Acme", "9", "no")], "name string, publisher string, version string, text string")
    assert texts(enrichers.package_matches(ents, packs)) == {"e": "new"}


def test_articles(spark):
    page = "<p>This is the page that tells you what the program does and how you use it.</p>"
    rows = [("e", "http://x/a", "title", page), ("e", "http://x/b", "toc", page), ("e", "http://x/c", "toc", page), ("e", "http://x/d", "toc", page), ("e", "http://x/", "collector", page)]
    got = enrichers.articles(spark.createDataFrame(rows, "entity_id string, url string, how string, html string")).collect()
    assert sorted(r["source_uri"] for r in got) == ["http://x/b", "http://x/c"] and "what the program does" in got[0]["text"]
    toc = spark.createDataFrame([("Task Manager", "u1", 1), ("task-manager", "u2", 2)], "title string, url string, position int")
    assert enrichers.toc_lookup(spark.createDataFrame([("e", "TaskManager")], "id string, display_name string"), toc).first()["url"] == "u1"
    leads = [("e", "Paint", "Acme Corp", "Paint (software)", "Paint is a program by Acme."), ("e", "Paint", "Acme Corp", "Paint", "Paint is a coating."), ("e", "Paint", "Acme Corp", "Acme Paint", "A drawing program by Acme.")]
    assert texts(enrichers.encyclopedia(spark.createDataFrame(leads, "entity_id string, display_name string, publisher string, title string, lead string"))) == {"e": "A drawing program by Acme."}


def test_feature_names(spark):
    got = spark.range(1).select(enrichers.feature_name(F.lit("Microsoft-Windows-MediaPlayer-Package")).alias("a"), enrichers.feature_name(F.lit("TFTP"), {"tftp": "TFTP Client"}).alias("b")).first()
    assert tuple(got) == ("Media Player", "TFTP Client")


def test_synthesis(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(synthesis.coded(F.lit("prodnorwayeastmmrns"))) and one(synthesis.coded(F.lit("whuok7nwdzy2s"))) and not one(synthesis.coded(F.lit("OutputDebugString")))
    assert one(synthesis.adds_information(F.lit("Clipchamp"), F.lit("Online video editor by Microsoft."))) and not one(synthesis.adds_information(F.lit("ZoomIt"), F.lit("ZoomIt Application display")))
    assert one(synthesis.distinctive(F.array(*map(F.lit, ("edit text", "edit text files", "print pages", "Edit Text"))))) == ["edit text", "print pages"]
    assert one(synthesis.intents(F.lit("Choose microphones and disks; PowerPoint"))) == ["choose the default microphone", "manage disks and storage"]
    assert "edit" in one(synthesis.action_verbs(text.word_set(F.lit("a video editor")), F.lit("Clipchamp")))
    assert synthesis.admit_captions(["Virtual Size", "Memory History", "Virtual Memory", "Some Tool", "Virtual Size"], "Some Tool", "") == ["Virtual Size", "Memory History", "Virtual Memory"]


def test_cut(spark):
    said = "One sentence. " * 60
    got = spark.range(1).select(synthesis.cut_sentence(F.lit(said)).alias("x")).first()[0]
    assert len(got) <= 600 and got.endswith(".") and said.startswith(got)


def test_launch_lines(spark):
    line = lambda k, t, a=None: spark.range(1).select(text.launch_command(F.lit(k), F.lit(t), F.lit(a).cast("string")).alias("x")).first()[0]
    assert line(0, "A!B") == "explorer.exe shell:AppsFolder\\A!B" and line(3, "ms-settings:x y") == "ms-settings:x y"
    assert line(1, "C:\\My App\\a.exe", "-x") == '"C:\\My App\\a.exe" -x' and line(5, "a.msc") == "mmc.exe a.msc" and line(1, " ") == ""


def test_tables_of_contents(spark):
    tree = '[{"toc_title": "Using Task Manager", "href": "tm?view=1#x", "children": [{"toc_title": "Out", "href": "https://other/x"}, {"toc_title": "Top", "href": "../top"}, {"toc_title": "Anchor", "href": "#a"}]}, {"toc_title": "Task Manager", "href": "other"}]'
    trees = spark.createDataFrame([(1, "https://site/docs/", tree), (2, "https://site/b/", '{"toc_title": "Task Manager", "href": "late"}'), (3, "https://site/", "no json")], "root int, base string, json string")
    toc = enrichers.toc_entries(trees)
    assert {(r["title"], r["url"]) for r in toc.collect()} == {("Using Task Manager", "https://site/docs/tm"), ("Task Manager", "https://site/docs/tm"), ("Task Manager", "https://site/docs/other"), ("Task Manager", "https://site/b/late")}
    found = enrichers.toc_lookup(spark.createDataFrame([("e", "task-manager")], "id string, display_name string"), toc)
    assert [tuple(r) for r in found.collect()] == [("e", "https://site/docs/tm")]


def test_package_manifests(spark):
    xml = '<Package xmlns="urn:a" xmlns:u="urn:u"><Properties><DisplayName>Suite</DisplayName><PublisherDisplayName>Co</PublisherDisplayName><Description>ms-resource:d</Description></Properties><Applications><Application Id="One" Executable="one.exe"><u:VisualElements DisplayName="Tool One" Description="Does  one thing"/></Application><Application Id="Two" Executable="two.exe"><u:VisualElements DisplayName="suite" Description="Does two"/></Application></Applications></Package>'
    apps = spark.createDataFrame([("a", "F", "one"), ("b", "F", "lost"), ("c", "G", None)], "entity_id string, family string, app string")
    got = {r["entity_id"]: r["text"] for r in enrichers.package_manifests(apps, spark.createDataFrame([("F", xml), ("G", "<broken")], "family string, xml string")).collect()}
    assert got == {"a": "Display name: Suite\nPublisher: Co\nApplication description: Does one thing\nApplication display name: Tool One", "b": "Display name: Suite\nPublisher: Co"}
    parts = enrichers.manifest_parts(spark.createDataFrame([("F", xml)], "family string, xml string")).first()["m"]
    assert [(a["id"], a["executable"]) for a in parts["apps"]] == [("One", "one.exe"), ("Two", "two.exe")]
