"""Collectors, embedding, and whole builds of an index."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.functions import registry, text
from sparkseek.operators.embed import HashEmbedder, OnnxEmbedder, WordPieces, embed, pool
from sparkseek.plans import index, search
from sparkseek.sources import collectors
from sparkseek.sources.catalogues import SETTINGS_PAGES, SUITE_UTILITIES, SYSTEM_TOOLS
from sparkseek.sources.store import IndexStore


def by(df, key="display_name"):
    return {r[key]: r for r in df.collect()}


def test_inline_catalogues(spark):
    pages = by(collectors.settings_pages(spark))
    assert len(pages) == len({p[0] for p in SETTINGS_PAGES}) and pages["Display"]["id"] == "mssettings:ms-settings:display" and pages["Display"]["kind"] == 2 and pages["Display"]["raw_metadata"]["description"]
    suite = collectors.suite_utilities(spark, "C:\\PT\\Runner.exe").collect()
    one = {r["display_name"]: r for r in suite}
    assert len(suite) == len(SUITE_UTILITIES) and one["Awake"]["launch_arguments"] == "--open-settings=Awake" and one["Awake"]["raw_metadata"]["fileName"] == "Runner.exe"
    assert "dedupeScope" in one["Awake"]["raw_metadata"] and "dedupeScope" not in one["Command Palette"]["raw_metadata"] and collectors.suite_utilities(spark, None).count() == 0
    files = spark.createDataFrame([("C:\\W\\System32\\PING.EXE",), ("C:\\W\\System32\\none.exe",)], "path string")
    tools = collectors.system_tools(spark, files).collect()
    assert [r["display_name"] for r in tools] == [next(n for f, n, _ in SYSTEM_TOOLS if f == "ping.exe")] and tools[0]["kind"] == 6
    items = by(collectors.control_items(spark, spark.createDataFrame([("C:\\S\\main.cpl", "Mouse and more"), ("C:\\S\\odd.msc", "Odd console"), ("C:\\S\\bare.msc", None), ("C:\\S\\x.exe", "no")], "path string, file_description string")))
    assert set(items) == {"Mouse Properties", "Odd console", "bare"} and items["Mouse Properties"]["launch_kind"] == 4 and items["bare"]["launch_kind"] == 5


def test_shell_apps_and_shortcuts(spark):
    apps = by(collectors.shell_apps(spark.createDataFrame([("Calc", "Fam_1!App"), ("Old", "C:\\o.exe"), ("", "x")], "name string, model_id string")))
    assert {n: r["kind"] for n, r in apps.items()} == {"Calc": 1, "Old": 0}
    links = spark.createDataFrame([("C:\\M\\Tools\\A b.lnk", "Tools", "C:\\a.exe", "C:\\", "Does a", None, "-x", None), ("C:\\M\\site.url", None, None, None, None, None, None, "https://a"), ("C:\\M\\n.txt", None, None, None, None, None, None, None)], "path string, folder string, target string, working_directory string, comment string, icon string, arguments string, url string")
    got = by(collectors.start_shortcuts(links))
    assert set(got) == {"A b", "site"} and got["A b"]["raw_metadata"] == {"comment": "Does a", "startMenuFolder": "Tools", "targetPath": "C:\\a.exe", "workingDirectory": "C:\\"} and got["A b"]["launch_arguments"] == "-x" and got["site"]["raw_metadata"] == {"url": "https://a"}


def test_uninstall_records(spark):
    files = spark.createDataFrame([(p,) for p in ("C:\\P\\app\\unins000.exe", "C:\\P\\app\\longer name.exe", "C:\\P\\app\\app.exe", "C:\\P\\i.exe")], "path string")
    rows = [
        ("hklm64", "a", "A", 0, '"C:\\P\\i.exe",0', None, "C:\\P\\app\\", None, None), ("hklm64", "b", "B", 0, "C:\\gone.exe,1", "Pub", "C:\\P\\app\\", "1.0", None), ("hkcu", "c", "C", 0, None, " ", None, None, '"C:\\u\\unins.exe" /S'),
        ("hkcu", "d", "D", 0, "C:\\pic.ico", None, None, None, None), ("hklm32", "e", "E", 0, None, None, None, None, None), ("hklm32", "f", "F", 1, None, None, None, None, None), ("hklm32", "g", " ", 0, None, None, None, None, None),
    ]
    got = by(collectors.uninstall_records(spark.createDataFrame(rows, "root string, key string, display_name string, system_component int, display_icon string, publisher string, install_location string, display_version string, uninstall_string string"), files))
    assert {n: r["launch_target"] for n, r in got.items()} == {"A": "C:\\P\\i.exe", "B": "C:\\P\\app\\app.exe", "C": "C:\\u\\unins.exe", "D": "C:\\pic.ico", "E": "E"}
    assert got["B"]["id"] == "uninstall:hklm64\\b" and got["C"]["publisher"] is None and got["B"]["raw_metadata"]["displayVersion"] == "1.0"


def test_commands_and_search_path(spark):
    rows = [("acc.exe", "C:\\t\\acc.exe", "Suite Acc", "Co", "Reports access", 3), ("x.exe", "C:\\t\\x.exe", "Operating System", None, None, 2), ("y.txt", "C:\\t\\y.txt", None, None, None, 3)]
    got = by(collectors.command_aliases(spark.createDataFrame(rows, "alias string, target string, product string, company string, file_description string, subsystem int")))
    assert {n: r["kind"] for n, r in got.items()} == {"Suite Acc": 6, "x": 0} and got["Suite Acc"]["raw_metadata"]["consoleSubsystem"] == "true"
    files = [("C:\\a", 1, "Tool.exe", 10), ("C:\\b", 2, "tool.exe", 10), ("C:\\a", 1, "stub.exe", 0), ("C:\\b", 2, "stub.exe", 5), ("C:\\Windows\\x", 0, "w.exe", 5), ("C:\\Windowsill", 3, "sill.exe", 5)]
    files += [("C:\\many", 0, f"m{i}.exe", 1) for i in range(513)]
    df = spark.createDataFrame([(*f, None, None, None, 3) for f in files], "directory string, position int, file string, size int, product string, company string, file_description string, subsystem int")
    got = collectors.path_entities(df).collect()
    assert sorted(r["launch_target"] for r in got) == ["C:\\Windowsill\\sill.exe", "C:\\a\\Tool.exe"] and all(r["id"] == f"path:{r['launch_target'].lower()}" for r in got)


def test_package_executables(spark):
    apps = spark.createDataFrame([("1", "shell:AppsFolder\\Fa!One"), ("2", "Fa!Two"), ("3", "Fb!Main"), ("4", "Fb"), ("5", "Fc!Zoom"), ("6", "Fc!Lost"), ("7", "Fd!x")], "id string, model_id string")
    manifests = spark.createDataFrame([("Fa", "One", "one.exe"), ("Fa", "Two", "bin\\two.exe"), ("Fb", "Main", "main.exe"), ("Fc", "Zoom", "stub.exe"), ("Fc", "Lost", "stub.exe")], "family string, app string, executable string")
    binaries = spark.createDataFrame([("Fc", "sub\\Zoom.exe"), ("Fc", "a\\b\\Lost.exe"), ("Fc", "stub.exe")], "family string, path string")
    assert {r["id"]: r["executable"] for r in collectors.package_executables(apps, manifests, binaries).collect()} == {"1": "one.exe", "2": "bin\\two.exe", "3": "main.exe", "4": "main.exe", "5": "sub\\Zoom.exe"}


def test_word_pieces():
    known = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "x", "hello", "world", "##ing", "play", ",", "caf", "##e"])}
    pieces = WordPieces(known, most=6)
    ids, mask = pieces.batch(["hello world", "Playing, caf\u00e9 zzz", ""])
    assert ids.tolist() == [[2, 5, 6, 3, 0, 0], [2, 8, 7, 9, 10, 3], [2, 3, 0, 0, 0, 0]] and mask.sum(1).tolist() == [4, 6, 2]
    got = pool(np.array([[[1.0, 0], [100, 100], [3, 4]]]), np.array([[1, 0, 1]]))
    assert got[0].tolist() == pytest.approx([0.70710678, 0.70710678]) and pool(np.zeros((1, 1, 2)), np.array([[0]])).tolist() == [[0.0, 0.0]]


def failing(dimensions):
    class Failing(HashEmbedder):
        """Fails on texts with a word, and gives a wrong size for another."""

        def embed(self, texts):
            if any("poison" in t.lower() for t in texts):
                raise RuntimeError("cannot embed")
            out = HashEmbedder.embed(self, texts)
            return out[:, :3] if any("short" in t for t in texts) else out

    return Failing(dimensions)


def test_embedding_failures_stay_alone(spark):
    rows = spark.createDataFrame([(i, f"text {i}" + (" poison" if i == 3 else " short" if i == 5 else "")) for i in range(10)] + [(10, None)], "id long, t string").coalesce(1)
    got = {r["id"]: r for r in embed(rows, "id", "t", failing(16)).collect()}
    assert {i for i, r in got.items() if r["embedding"] is None} == {3, 5} and "cannot embed" in got[3]["error"] and "dimensions" in got[5]["error"]
    assert sum(x * x for x in got[0]["embedding"]) == pytest.approx(1)


def catalogue(spark, rows):
    df = spark.createDataFrame(rows, "key string, display_name string, description string")
    return collectors.conform(df.select("key", "display_name", F.lit(0).alias("kind"), F.lit(1).alias("launch_kind"), F.concat(F.lit("D:\\p\\"), "key", F.lit(".exe")).alias("launch_target"), F.create_map(F.lit("description"), F.col("description")).alias("raw_metadata")), "startmenu").withColumn("rank", F.lit(0))


ROWS = [("one", "Text Editor", "Write and edit plain text files quickly"), ("two", "Photo Viewer", "Browse pictures and photographs from folders"), ("three", "Disk Cleaner", "Remove temporary files from drives")]
NOTES = index.Provider("notes", lambda e: e.select(F.col("id").alias("entity_id"), F.concat(F.lit("This is what you use to work with the "), "display_name", F.lit(" and it is good for you and your files.")).alias("text")))


def test_builds(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    model = HashEmbedder(32)
    first = index.run_build(store, catalogue(spark, ROWS), [NOTES], model)
    assert (first["discovered"], first["added"], first["unchanged"], first["failed"], first["embedded"]) == (3, 3, 0, 0, 3)
    assert store.status() == {"available": True, "count": 3, "model": "hash-32", "dimensions": 32, "snapshot": store.status()["snapshot"]}
    assert store.read("documents").count() == 3 and sorted(r[0] for r in store.read("entities").select("vector_ordinal").collect()) == [0, 1, 2]
    again = index.run_build(store, catalogue(spark, ROWS), [NOTES], model)
    assert (again["unchanged"], again["added"], again["updated"], again["embedded"]) == (3, 0, 0, 0)
    # one changes, one is new, one is gone; ordinals stay, the new one gets the next
    rows = [("one", "Text Editor", "Write and edit plain text files and notes"), ROWS[1], ("four", "Sound Mixer", "Change the volume of each program playing")]
    before = {r["id"]: r["vector_ordinal"] for r in store.read("entities").collect()}
    third = index.run_build(store, catalogue(spark, rows), [NOTES], model)
    assert (third["unchanged"], third["added"], third["updated"], third["removed"]) == (1, 1, 1, 1)
    after = {r["id"]: r["vector_ordinal"] for r in store.read("entities").collect()}
    assert after["startmenu:one"] == before["startmenu:one"] and after["startmenu:four"] == 3 and "startmenu:three" not in after
    matrix = {r["vector_ordinal"]: r["embedding"] for r in store.vector_matrix().collect()}
    assert len(matrix) == 4 and sum(map(abs, matrix[before["startmenu:three"]])) > 0 or len(matrix[0]) == 32
    # a provider is run again: its documents are replaced, equal texts are not embedded again
    fourth = index.run_build(store, catalogue(spark, rows), [NOTES], model, index.BuildOptions(refresh=["notes"]))
    assert fourth["embedded"] == 0 and store.documents_by_entity().count() == 3 and store.documents_of("startmenu:one").count() == 1
    with pytest.raises(ValueError):
        index.run_build(store, catalogue(spark, rows), [NOTES], model, index.BuildOptions(refresh=["nobody"]))
    found = search.hybrid_search(index.search_entities(store), spark.createDataFrame([(0, "text editor")], "qid long, query string").withColumn("embedding", F.array(*map(F.lit, model.embed(["text editor"])[0].tolist()))), F.lit("2024-01-01").cast("timestamp"))
    assert found.where("place = 1").first()["key"] == "startmenu:one"


def test_failed_embeddings_are_tried_again(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    rows = [ROWS[0], ("bad", "Poison Box", "Keeps poison away from pets and children")]
    got = index.run_build(store, catalogue(spark, rows), [], failing(32))
    assert got["failed"] == 1 and "cannot embed" in got["first_failure"]
    kept = by(store.read("entities"), "id")
    assert kept["startmenu:bad"]["content_hash"] is None and kept["startmenu:bad"]["vector_ordinal"] is None and kept["startmenu:one"]["content_hash"]
    again = index.run_build(store, catalogue(spark, rows), [], HashEmbedder(32))
    assert (again["unchanged"], again["updated"], again["failed"]) == (1, 1, 0) and by(store.read("entities"), "id")["startmenu:bad"]["vector_ordinal"] is not None


def test_duplicates_are_absorbed(spark):
    base = catalogue(spark, [("a", "My Tool", "Does this and that")])
    other = catalogue(spark, [("b", "my tool", "Another description")]).withColumn("rank", F.lit(1)).withColumn("publisher", F.lit("Pub")).withColumn("raw_metadata", F.map_concat("raw_metadata", F.create_map(F.lit("url"), F.lit("https://x"))))
    apart = catalogue(spark, [("c", "My Tool", "Scoped")]).withColumn("raw_metadata", F.map_concat("raw_metadata", F.create_map(F.lit("dedupeScope"), F.lit("suite"))))
    got = by(index.dedupe(base.unionByName(other).unionByName(apart)), "id")
    assert set(got) == {"startmenu:a", "startmenu:c"} and got["startmenu:a"]["publisher"] == "Pub" and got["startmenu:a"]["raw_metadata"] == {"description": "Does this and that", "url": "https://x"}
    assert got["startmenu:a"]["content_hash"] != base.first()["content_hash"]


def test_page_descriptions(spark):
    page = '<title>Thing - Docs</title><script type="application/ld+json">{"description": "It says \\"hello\\" to everyone\\u2014at once"}</script><meta content="Thing - Docs and other words here" property="og:description"><meta name="description" content="What the thing &amp; its parts are for">'
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(text.json_ld_description(F.lit(page))) == 'It says "hello" to everyone\u2014at once' and one(text.page_title(F.lit(page))) == "Thing - Docs"
    bare = page.replace("application/ld+json", "text/plain")
    assert one(text.structured_description(F.lit(bare))) == "What the thing & its parts are for" and one(text.meta_content(F.lit(bare), "og:description", "property")) == "Thing - Docs and other words here"
    for line, want in (("html: x", True), ("<div class=a>", True), ("&lt;b&gt;x", True), ("body { color: red }", True), ("Plain words & more", False), ("a < b", False), ("", False)):
        assert one(text.markup_line(F.lit(line))) == want, line
    assert one(text.decode_entities(F.lit("&eacute;&#x41;&#66;&apos;&nosuch;&amp;amp;"))) == "\u00e9AB'&nosuch;&amp;" and one(text.strip_html(F.lit("<p>a&amp;lt;b</p>"))) == ". a<b."


def test_functions_of_sql(spark):
    assert registry.register(spark, HashEmbedder(16)) == ["stem_terms", "decode_references", "initials_prefix", "tier_starts", "embed_text", "manifest_fields"]
    row = spark.sql("select stem_terms('Running cafés') as a, decode_references('a &amp; b') as b, initials_prefix('vsco', 'Visual Studio Code') as c, size(embed_text('some words')) as d").first()
    assert row["a"] == ["run", "cafe"] and row["b"] == "a & b" and row["c"] and row["d"] == 16


# --------------------------------------------------------------------------- a model file


def _field(number: int, value) -> bytes:
    """One field of a protocol buffer: a number, or bytes with their length."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _model(table: np.ndarray) -> bytes:
    """A model file that looks each token's state up in a table."""
    ints = lambda name: _field(1, name) + _field(2, _field(1, _field(1, 7) + _field(2, _field(1, _field(2, "rows")) + _field(1, _field(2, "tokens")))))
    states = _field(1, "last_hidden_state") + _field(2, _field(1, _field(1, 1)))
    weights = b"".join(_field(1, d) for d in table.shape) + _field(2, 1) + _field(8, "states") + _field(9, table.astype("<f4").tobytes())
    node = _field(1, "states") + _field(1, "input_ids") + _field(2, "last_hidden_state") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "lookup") + _field(5, weights) + _field(11, ints("input_ids")) + _field(12, states)
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def test_embedding_by_a_model_file(spark, tmp_path):
    """The session runs on the workers: token states of a model file, pooled over each text's own tokens."""
    pytest.importorskip("onnxruntime")
    known = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "open", "file", "##s", "task"])}
    table = np.random.default_rng(5).normal(size=(len(known), 6))
    (tmp_path / "model.onnx").write_bytes(_model(table))
    model = OnnxEmbedder(str(tmp_path / "model.onnx"), known, "lookup", 6)
    texts = ["open files", "Task", "open the file", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: r["embedding"] for r in embed(rows, "id", "t", model, 2).collect()}
    for i, ids in enumerate(([2, 4, 5, 6, 3], [2, 7, 3], [2, 4, 1, 5, 3], [2, 3])):
        mean = table[ids].astype(np.float32).mean(0)
        assert got[i] == pytest.approx((mean / np.linalg.norm(mean)).tolist(), abs=1e-5)
    wrong = OnnxEmbedder(str(tmp_path / "model.onnx"), known, "lookup", 5)
    assert {r["embedding"] for r in embed(rows, "id", "t", wrong).collect()} == {None}
