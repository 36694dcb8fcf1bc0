"""The hybrid search against a plain re-statement of it, and small indexes with known outcomes."""

from __future__ import annotations

import math
import os
import re
import time
from datetime import datetime

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from sparkseek.functions.names import initials_prefix
from sparkseek.functions.text import FRAMING_WORDS, MORE_STOPWORDS, STOPWORDS
from sparkseek.operators import fusion, lexical
from sparkseek.operators.lexical import WEIGHTS
from sparkseek.operators.postings import indexed
from sparkseek.plans import catalog, search
from sparkseek.schema import RankingOptions
from sparkseek.sources.scratch import scratch_table

O = RankingOptions()  # noqa: E741
NOW = datetime(2024, 2, 1)
COLUMNS = "key long, display_name string, summary string, tasks array<string>, synonyms array<string>, details string, features string, publisher string, source string, kind int, launch_kind int, launch_target string, embedding array<double>, launch_count long"


def unit(*v):
    a = np.array(v, float)
    return (a / np.linalg.norm(a)).tolist()


def norm(x):
    return regex.sub(r"[^\p{L}\p{Nd}]+", " ", (x or "").strip().lower()).strip()


def words(x):
    return regex.findall(r"[\p{L}\p{N}]+", (x or "").lower())


def strength(query, name):
    q, n = norm(query), norm(name)
    if not q or not n:
        return 0.0, None
    w = n.split(" ")
    if q == n:
        return 3.0, "exact name"
    if n.startswith(q):
        return 1.5, "name prefix"
    if any(x.startswith(q) for x in w):
        return 0.6, "word prefix"
    if len(w) > 1 and "".join(x[0] for x in w) == q:
        return 0.9, "acronym"
    if len(w) > 1 and initials_prefix(q, w):
        return 0.9, "acronym prefix"
    it = iter(n)
    return (0.24, "subsequence") if all(c in it for c in q) else (0.0, None)


def tiers(scores):
    out, leader, first = [], None, 0
    for i, s in enumerate(scores):
        if leader is None or s < leader * 0.95:
            leader, first = s, i
        out.append(first)
    return out


def says_more(text, name):
    return bool(set(words(text)) - set(words(name)) - set(FRAMING_WORDS)) if text else False


def plain_search(entities, query, vector, limit=10):
    """One query, entity by entity."""
    n = len(entities)
    by = {e["key"]: e for e in entities}
    cos = {e["key"]: round(float(np.dot(e["embedding"], vector)), 6) for e in entities if e["embedding"] and vector}
    ranked = sorted((k for k in cos if cos[k] >= O.min_vector_score), key=lambda k: (-cos[k], k))[:100]
    vec = {k: 1 / (60 + t + 1) + 0.02 * cos[k] for k, t in zip(ranked, tiers([cos[k] for k in ranked]), strict=True)}
    # BM25 over the index projection
    fold = lambda x: (x or "") + "".join(" " + c.replace("-", "") for c in dict.fromkeys(regex.findall(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)+", x or "")))
    index = {}
    for e in entities:
        name = e["display_name"]
        index[e["key"]] = {"name": fold(name), "summary": fold(e["summary"] if says_more(e["summary"], name) else ""), "tasks": fold(". ".join(t for t in e["tasks"] or [] if says_more(t, name))), "synonyms": fold(", ".join(e["synonyms"] or [])), "details": fold(e["details"]), "publisher": e["publisher"] or "", "features": fold(e["features"])}
    every = regex.findall(r"[\p{L}\p{Nd}_]+", query.lower())[:16]
    kept = [w for i, w in enumerate(every) if i == len(every) - 1 or w not in STOPWORDS] or every
    sizes = {k: sum(len(words(t)) for t in f.values()) for k, f in index.items()}
    mean = sum(sizes.values()) / n
    bm = {}
    for i, w in enumerate(kept):
        meets = (lambda x, w=w: x.startswith(w)) if i == len(kept) - 1 else (lambda x, w=w: x == w)
        f = {k: sum(WEIGHTS[c] * sum(map(meets, words(t))) for c, t in fields.items()) for k, fields in index.items()}
        f = {k: v for k, v in f.items() if v}
        idf = math.log((n - len(f) + 0.5) / (len(f) + 0.5)) if f else 0
        for k, v in f.items():
            bm[k] = bm.get(k, 0) + (idf if idf > 0 else 1e-6) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * sizes[k] / mean))
    best = sorted(bm, key=lambda k: (-bm[k], k))[:100]
    tier = dict(zip(best, tiers([bm[k] for k in best]), strict=True))
    # terms, weights, pairs
    terms = [w for w in dict.fromkeys(words(query)) if len(w) >= 3 and w not in STOPWORDS + MORE_STOPWORDS][:12]
    match = {k: " " + " ".join([e["display_name"], e["summary"] or "", *(e["tasks"] and [" ".join(e["tasks"])] or []), *(e["synonyms"] and [" ".join(e["synonyms"])] or [])]).lower() + " " for k, e in by.items()}
    df = lambda w: sum(w in m.split(" ") for m in match.values())
    weight = {t: math.log(1 + n / (1 + df(t))) for t in terms}
    pairs = list(zip(terms, terms[1:], strict=False))

    def stated(e):
        said = [" " + regex.sub(r"[^\p{L}\p{Nd}]+", " ", s).strip() + " " for t in (e["display_name"], e["summary"], e["details"], e["features"], *(e["tasks"] or []), *(e["synonyms"] or [])) if t for s in re.split(r"[,.;:!?()\[\]{}\"|/\\\r\n]", t.lower())]
        return [p for p in pairs if any(f" {p[0]} {p[1]} " in s for s in said)]

    # names
    credible = 1.0
    q = norm(query)
    if q and " " not in q and df(q):
        credible = 1 - min(max(df(q) / n / 0.05, 0), 1) * 0.85
    literal = []
    for e in entities:
        s, why = strength(query, e["display_name"])
        m = re.search(r"([^\\/]+)\.(?:exe|msc|cpl|bat|cmd|com|ps1|msi)$", e["launch_target"] or "", re.I)
        if m and e["launch_kind"] != 3 and m[1].lower() != e["display_name"].lower() and strength(query, m[1])[0] > s:
            s, why = strength(query, m[1])
        if why in ("word prefix", "subsequence"):
            s *= credible
        if s > 0:
            literal.append((-s, e["display_name"].upper(), e["key"], why))
    lit = {k: (-s, why, 4 * min(-s / 3, 1) / (60 + i + 1)) for i, (s, _, k, why) in enumerate(sorted(literal))}
    cand = {}
    lead = max(bm[k] for k in best) if best else 0
    for k in {*vec, *best, *lit}:
        e = by[k]
        c = cand[k] = {"cos": cos.get(k), "ranked": k in vec, "lex": bm[k] if k in tier else None, "lit": lit.get(k, (None, None, None))}
        c["cover"] = 1.0
        c["nol"] = False
        if c["lex"] is not None:
            if len(terms) >= 2:
                own = {w for p in stated(e) for w in p}
                c["cover"] = max(0.2, sum(weight[t] for t in terms if t in match[k] or t in own) / sum(weight.values()))
                name = e["display_name"].lower()
                said = " " + " ".join(x for x in [e["summary"] or "", " ".join(e["tasks"] or []), " ".join(s for s in e["synonyms"] or [] if s.lower() not in name), e["details"] or ""] if x).lower()
                c["nol"] = any(t in name for t in terms) and not any(regex.search(rf"(?<!\p{{L}}){regex.escape(t)}", said) for t in terms)
        c["vec"] = vec.get(k, 0.0)
        c["paid"] = c["cover"] / (60 + tier[k] + 1) if c["lex"] is not None and c["lex"] >= 0.45 * lead else 0.0
        c["nos"] = not says_more(e["summary"], e["display_name"]) and not any(says_more(t, e["display_name"]) for t in e["tasks"] or []) and not (e["details"] or "").strip()
    top_cos = max((c["cos"] or 0.0 for c in cand.values()), default=0.0)
    adj = {}
    if len(terms) >= 2:
        for k, c in cand.items():
            w = lambda p: min(weight[p[0]], weight[p[1]])
            s = sum(map(w, stated(by[k]))) / sum(map(w, pairs))
            s *= min(max((c["cos"] or 0.0) / top_cos, 0), 1) if top_cos > 0 else 1
            if s > 0:
                adj[k] = s
    order = sorted(adj, key=lambda k: (-adj[k], k))
    adj = {k: 1.25 * adj[k] / (60 + t + 1) for k, t in zip(order, tiers([adj[k] for k in order]), strict=True)}
    for k, c in cand.items():
        s = c["vec"] + c["paid"] + (c["lit"][2] or 0) + adj.get(k, 0)
        s *= {"command": 0.65, "uninstall": 0.65}.get(by[k]["source"], 1)
        used = by[k]["launch_count"] or 0
        c["score"] = s + (min(1, math.log(1 + used) / math.log(50)) * 0.008 if used > 0 else 0)
    top_lex, top = max((c["lex"] or 0 for c in cand.values()), default=0), max((c["score"] for c in cand.values()), default=0)
    floor = min(0.22, 0.8 * top_cos) if top_cos > 0 else 0.22

    def shown(c):
        lex, v, long = c["lex"], c["cos"], len(terms) >= 2
        if (c["lit"][0] or 0) >= 0.6:
            return True
        if lex is not None and lex >= 8 and (not long or c["cover"] >= 0.85):
            return True
        if top_lex > 0 and lex is not None and lex >= 0.95 * top_lex and (not c["ranked"] or v is None or v >= floor) and not (top_cos > 0 and v is not None and v < 0.15 * top_cos):
            return True
        if v is None:
            return False
        blank = long and c["nos"]
        both = v / top_cos * lex / top_lex if top_cos > 0 and top_lex > 0 and c["ranked"] and not blank and not c["nol"] and v >= floor and lex is not None else 0
        if c["score"] < 0.35 * top and both < 0.30:
            return False
        if lex is None:
            return not c["nos"] and v >= 0.35 and v >= 0.75 * top_cos
        return v >= floor and v >= 0.60 * top_cos and not blank or both >= 0.18

    def component(e):
        if e["kind"] in (2, 3, 4, 5, 6) or e["launch_kind"] in (4, 5):
            return True
        return (e["launch_target"] or "").lower().startswith("ms-settings:" if e["launch_kind"] == 3 else "c:\\windows\\")

    left = {k: c for k, c in cand.items() if shown(c)}
    best_score = max((c["score"] for c in left.values()), default=0)
    band = lambda c: math.floor(c["score"] / (best_score * 0.01)) if best_score > 0 else 0
    keys = sorted(left, key=lambda k: (-band(left[k]), not component(by[k]), -left[k]["score"], by[k]["display_name"].upper(), k))[:limit]

    def why(c):
        if c["lit"][1] and c["lit"][2] >= c["vec"] and c["lit"][2] >= c["paid"]:
            return c["lit"][1]
        return {(True, True): "hybrid semantic+lexical", (True, False): "semantic", (False, True): "lexical"}.get((c["cos"] is not None, c["lex"] is not None), c["lit"][1] or "usage")

    return [(k, round(left[k]["score"], 9), why(left[k])) for k in keys]


SMALL = [
    (1, "Task Manager", "See what runs on the computer and end a process.", ["end a task", "see memory usage"], ["tm"], "It lists every running process with its memory usage and lets you end the process.", "End Task, Memory Usage", "Contoso", "startmenu", 0, 1, "C:\\Windows\\taskmgr.exe", unit(1, 0.2, 0), 3),
    (2, "Tasklist", None, None, None, None, None, None, "command", 0, 1, "C:\\Windows\\tasklist.exe", unit(0.9, 0.1, 0.4), None),
    (3, "PipeList", "List the pipes of each process.", ["list pipes"], ["pipes"], "Lists named pipes in use by a process on this system.", None, "Contoso", "startmenu", 0, 1, r"D:\bin\pl.exe", unit(0.7, 0.6, 0), None),
    (4, "LogonSessions", "List sessions and the processes running in them.", None, None, None, None, None, "path", 0, 1, "D:\\bin\\logonsessions.exe", unit(0.6, 0, 0.7), None),
    (5, "Text Editor", "Edit text files.", ["edit a file", "write notes"], ["notes"], "A plain editor with which you can write and edit a text file.", "Open File, Save-As", "Fabrikam", "startmenu", 0, 1, "D:\\bin\\notepad.exe", unit(0, 1, 0.1), 10),
    (6, "DebugView", "Watch debug output.", None, ["view", "debug"], None, "View, View Options", "Contoso", "startmenu", 0, 1, "D:\\bin\\dbgview.exe", unit(0.1, 0.1, 1), None),
    (7, "Display Settings", "Change the view and size of the screen.", ["change the resolution"], None, None, None, None, "mssettings", 2, 3, "ms-settings:display", unit(0.1, 0.9, 0.5), None),
    (8, "Screen Sizer", "Change the view and size of the screen.", ["change the resolution"], None, None, None, None, "uninstall", 0, 1, "D:\\bin\\sizer.exe", unit(0.1, 0.9, 0.5), None),
    (9, "Screen Tool", "Change the view and size of the screen.", ["change the resolution"], None, None, None, None, "startmenu", 0, 1, "D:\\bin\\tool.exe", unit(0.1, 0.9, 0.5), None),
]
ASKED = [
    ("list process", unit(1, 0.1, 0.1)), ("list processe", unit(1, 0.1, 0.1)), ("list processes", unit(1, 0.1, 0.1)), ("view memory usage", unit(0.8, 0, 0.5)), ("edit file", unit(0, 1, 0)), ("notep", unit(0, 1, 0)), ("edit", unit(0, 1, 0)),
    ("taskmgr", None), ("tm", unit(1, 0, 0)), ("change the screen size", unit(0.1, 1, 0.5)), ("zzzz qqqq", None), ("view", unit(0, 0, 1)), ("save-as", None), ("the", None), ("", None), ("memory usage of the process", unit(1, 0, 0.2)),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(SMALL, COLUMNS)


def found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["qid"], r["place"])):
        out.setdefault(r["qid"], []).append((r["key"], round(r["score"], 9), r["why"]))
    return out


def asked(spark, queries=ASKED):
    return spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(queries)], "qid long, query string, embedding array<double>")


def test_search_equals_the_plain_one(spark, small):
    got = found(search.hybrid_search(small, asked(spark), F.lit(NOW).cast("timestamp"), stem=False))
    rows = [r.asDict() for r in small.collect()]
    for i, (query, vector) in enumerate(ASKED):
        want = plain_search(rows, query, vector)
        assert [(k, why) for k, _, why in got.get(i, [])] == [(k, why) for k, _, why in want], query
        assert [s for _, s, _ in got.get(i, [])] == pytest.approx([s for _, s, _ in want], abs=2e-9), query
    assert sum(map(len, got.values())) > 15


def test_typing_does_not_change_the_lexical_scores(spark, small):
    """A last word that is still being typed means the same as the whole one."""
    postings = indexed(lexical.projection(search.complete(small), "key"), "key", search.FIELDS, True)
    got = {}
    for r in postings.bm25(lexical.query_phrases(asked(spark, ASKED[:3]), True)).collect():
        got.setdefault(r["qid"], {})[r["key"]] = round(r["score"], 9)
    assert got[0] == got[1] == got[2] and 1 in got[0]


def test_components_lead_within_a_band(spark, small):
    got = search.hybrid_search(small, asked(spark, [("change the screen size", unit(0.1, 1, 0.5))]), F.lit(NOW).cast("timestamp")).orderBy("place").collect()
    keys = [r["key"] for r in got if r["key"] in (7, 9)]
    assert keys == [7, 9] and {r["key"]: r["component"] for r in got}[7]


def test_outcomes_of_cases(spark):
    none = []
    hits = spark.createDataFrame([(0, "Task Manager", 1), (0, "Tasklist", 2), (1, "Paint", 1), (3, "A", 1), (3, "B", 2)], "qid long, name string, place int")
    cases = spark.createDataFrame([(0, ["task manager pro"], none, ["Tasklist"], False, None, 3), (1, none, ["paint"], none, False, None, 3), (2, none, none, none, True, None, 3), (3, ["B"], none, none, False, 1, 3), (4, ["x"], none, none, False, None, 3), (5, none, none, ["x"], False, None, 3)], "qid long, acceptable array<string>, forbidden array<string>, required array<string>, expect_no_results boolean, max_results int, within_top_n int")
    got = {r["qid"]: (r["passed"], r["matched_rank"]) for r in search.evaluate(hits, cases).collect()}
    assert got == {0: (True, 1), 1: (False, None), 2: (True, None), 3: (False, 2), 4: (False, None), 5: (False, None)}
    assert search.exit_code(0.7) == 0 and search.exit_code(0.69) == 2


def test_stability_of_cases(spark, small):
    none = []
    cases = spark.createDataFrame([(0, "text editor", None, ["Text Editor"], none, none, False, None, 1), (1, "ab", None, ["x"], none, none, False, None, 1)], "qid long, query string, embedding array<double>, acceptable array<string>, forbidden array<string>, required array<string>, expect_no_results boolean, max_results int, within_top_n int")

    def run(q):
        return search.hybrid_search(small, q, F.lit(NOW).cast("timestamp")).join(small.select("key", F.col("display_name").alias("name")), "key").select("qid", "name", "place")

    got = search.typing_stability(run, cases, 3)
    assert sorted((r["qid"], r["dropped"], r["passed"]) for r in got.collect()) == [(0, 1, True), (0, 2, True), (0, 3, True)]
    assert search.first_unstable(got).count() == 0


def test_boilerplate_details_are_not_shown(spark, small):
    rows = small.withColumn("details", F.when(F.col("key") > 6, "The same words stand here. " * 6).otherwise(F.col("details")))
    hits = rows.select(F.lit(0).alias("qid"), "key")
    got = {r["key"]: r for r in search.with_text(hits, rows).collect()}
    assert got[7]["details"] is None and got[5]["details"] and got[5]["tasks"] == ["edit a file", "write notes"]


def test_cases_that_share_their_hits(spark):
    """Hits listed once for several cases give what hits listed for each give, and names count by their first place."""
    from sparkseek.plans import search

    listed = spark.createDataFrame([("x", "Blue bolt", 1), ("x", "red bolt", 2), ("x", "Blue bolt", 9), ("y", "red nut", 9)], "list string, name string, place int")
    cases = spark.createDataFrame(
        [(1, "x", ["red bolt"], ["blue BOLT"], [], False, None, 3), (2, "x", ["red bolt"], [], ["blue bolt"], False, 3, 3), (3, "y", ["red nut"], [], ["red nut"], False, None, 9), (4, "z", [], [], [], True, None, 3), (5, "x", ["red bolt"], [], [], False, 2, 3)],
        "qid int, list string, acceptable array<string>, forbidden array<string>, required array<string>, expect_no_results boolean, max_results int, within_top_n int",
    )
    got = sorted(map(tuple, search.evaluate(listed, cases, "list").collect()))
    assert got == [(1, False, 2, True, 3), (2, True, 2, True, 3), (3, False, 9, True, 1), (4, True, None, False, 0), (5, False, 2, True, 3)]
    each = cases.drop("list").join(cases.select("qid", "list").join(listed, "list").select("qid").distinct(), "qid", "left")
    assert sorted(map(tuple, search.evaluate(cases.select("qid", "list").join(listed, "list").drop("list"), each).collect())) == got


def test_lines_are_made_once_a_row(spark):
    """Not for every pair of words: made of Python, they couldn't be made within the function of a pair at all."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def lines(text):
        made.add(1)
        return text

    rows = spark.createDataFrame([(" a b c ", [("a", "b"), ("b", "a"), ("b", "c")]), (" b a ", [("a", "b"), ("b", "a")]), (None, [("a", "b")])], "text string, pairs array<struct<a:string,b:string>>")
    got = [r[0] for r in rows.select(fusion.stated_in(F.col("pairs"), lines("text"))).collect()]
    assert [[tuple(p) for p in x or []] for x in got] == [[("a", "b"), ("b", "c")], [("b", "a")], []]
    assert made.value == 3


def test_coverage_of_all_pairs(spark, monkeypatch):
    """By batches of texts as row by row, for any number of queries together; no pair is joined."""
    for name, value in (("QUERIES", 3), ("TOGETHER", 2)):
        monkeypatch.setattr(fusion, name, value)
    texts = [(i, None if i == 7 else " ".join(w for j, w in enumerate(("task", "edit", "tex", "of%", "zoo")) if i >> j & 1)) for i in range(32)]
    asked_for = {1: [("task", 0.5), ("edit", 1.25)], 2: [("te", 2.0), ("of%", 0.25), ("absent", 3.0)], 3: [("task", 1.0)], 4: [("zoo", 0.0), ("tex", 0.0)], 5: [("ask", 1.0), ("oo", 1.0)]}
    rows = spark.createDataFrame(texts, "id long, m string")
    weights = spark.createDataFrame([(q, t, w) for q, ts in asked_for.items() for t, w in ts], "qid long, t string, w double")
    found = fusion.coverages(rows, "id", "m", weights)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    queries = spark.createDataFrame([(q, [t for t, _ in ts], dict(ts)) for q, ts in asked_for.items()], "qid long, terms array<string>, idf map<string,double>")
    each = rows.crossJoin(queries).select("qid", "id", fusion.coverage(F.col("terms"), F.coalesce("m", F.lit("")), F.col("idf")).alias("coverage"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, each.collect()))


def test_candidates_meet_by_a_shuffle(spark, sf, monkeypatch):
    """A query may match the names of any share of the entities: beyond a number of rows the arms aren't sent anywhere."""
    plans, keep = [], search.scratch_table
    monkeypatch.setattr(search, "scratch_table", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    want = sorted(map(tuple, catalog.QUERIES["hybrid_search"](spark, sf).collect()))
    monkeypatch.setattr(search, "SMALL", 5)
    del plans[:]
    assert sorted(map(tuple, catalog.QUERIES["hybrid_search"](spark, sf).collect())) == want
    plan = dict(plans)["candidates"]
    assert "SortMergeJoin [qid" in plan and not re.search(r"BroadcastHashJoin \[qid#\d+L?, key#", plan)


def test_texts_do_not_go_with_candidates(spark, monkeypatch):
    """What a search shuffles does not grow by an entity's texts with each query that matches its name; the hits are those
    of tables that are sent."""
    n, n_queries = 60, 24
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{x:08x}" for x in rng.integers(0, 1 << 32, 1500)) + (". blue bolt of it." if k % 3 else ".") for k in range(n)]
    rows = [(k, f"blue bolt {k}", None, ["fit it"], None, texts[k], None, "a", "app", 0, 0, None, unit(1, k % 5, 0) if k % 4 == 0 else None, k % 3) for k in range(n)]
    entities = spark.createDataFrame(rows, COLUMNS)
    queries = spark.createDataFrame([(i, "blue bolt"[: 9 - i % 3], unit(1, 0.1 * i, 0.2) if i % 6 else None) for i in range(n_queries)], "qid long, query string, embedding array<double>")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    run = lambda: sorted((r["qid"], r["place"], r["key"], round(r["score"], 9), r["why"]) for r in search.hybrid_search(entities, queries, F.lit(NOW).cast("timestamp")).collect())
    expected = run()
    monkeypatch.setattr(search, "SMALL", 0)
    before, said = written(), sum(map(len, texts))
    assert run() == expected
    assert written() - before < 4 * said


def test_scratch_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    ours = lambda: {p for p in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in p}
    before = ours()
    assert scratch_table(spark.range(2000).groupBy((F.col("id") % 7).alias("k")).count(), "freed").count() == 7
    made = time.monotonic()
    while (left := {p for p in ours() - before if p.endswith(".data")}) and time.monotonic() - made < 5:
        time.sleep(0.1)
    # the count above has a shuffle of its own, of one row
    assert sum(os.path.getsize(p) for p in left) < 200
