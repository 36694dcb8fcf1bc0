"""Source divergence, vector codes and linked credentials against brute force, and their defined results."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import credentials, divergence, pii, queries, urlrules, vectorcodes

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --------------------------------------------------------------------------- 11


def audit_by_force(docs):
    """docs: (text, lang, source); everything with Python's integers."""
    counts, having, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))
        counts[lang, source].update(words)
        having[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in having[lang].items() if n >= 10]

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        own = {s: p(counts[lang, s]) for s in sources}
        whole = p(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(own[s][t], whole[t]), t) for t in kept if counts[lang, s][t] > 0 and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def audited(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_audit(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert audited(queries.op11_term_block_audit(spark, sf)) == audit_by_force([(r["text"], r["lang"], r["source"]) for r in docs.collect()])


def test_audit_odd(spark, monkeypatch):
    rng = random.Random(5)
    words = ["alpha", "Beta", "BETA", "ünder", "ÜNDER", "汉字", "x1y", "don't", "\U0001f600", "z" * 5000]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "é", None])) for i in range(150)]
    rows += [(1, None, "en", "a"), (None, "", "en", "empty"), (3, "alpha", "only", "one"), (3, "alpha", "only", "one"), (4, "12 34", "none", "p"), (5, None, "none", "q")] + [(9, "same words here", "t", s) for s in "abc" for _ in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n": F.lit(1), "term": F.lit("x"), "total": F.lit(2), "a.b": F.lit(0)})
    expected = audit_by_force([x[1:] for x in rows])
    assert audited(divergence.audit(docs)) == expected
    assert {x[:5] for x in expected if x[0] == "none"} == {("none", "p", "pair", "q", 0), ("none", "q", "pair", "p", 0)}
    assert not [x for x in expected if x[0] == "only"]
    assert {x[5] for x in expected if x[0] == "t" and x[2] == "pair"} == {1, 2}  # equal values, ranked by name
    # many small tiles, small flushes and several pieces of each matrix give the same rows
    for name, value in (("TERMS", 2), ("CELLS", 64), ("HELD", 5)):
        monkeypatch.setattr(divergence, name, value)
    assert audited(divergence.audit(docs)) == expected
    assert audited(divergence.audit(docs.where("false"))) == []


def test_shares_are_exact():
    rng = random.Random(6)
    for _ in range(300):
        total = rng.randint(1, 9 * 10**15 // rng.choice([1, 10**6, 10**12]))
        c = [rng.randint(0, total) for _ in range(3)]
        assert divergence.shares(np.array([c]), np.array([total]))[0].tolist() == [1 + 10**9 * (x + 2) // total for x in c]


def test_pair_tiles(monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 50)
    p = np.random.default_rng(0).integers(1, 10**9, (7, 23))
    got = {(g, h): v for a, b, s in divergence.pair_sums(p) for g, h, v in zip(a.tolist(), b.tolist(), s.tolist(), strict=True)}
    assert got == {(g, h): sum((int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in zip(p[g], p[h], strict=True)) for g in range(7) for h in range(g + 1, 7)}


# --------------------------------------------------------------------------- 12


def codes_by_force(rows):
    """rows: (vec_id, vector, label) that are kept, of one dimension; Python's integers alone."""
    ints = [[math.floor(Fraction(x) * 1024) for x in v] for _, v, _ in rows]
    ints = [v + [0] * (-len(v) % 4) for v in ints]
    w = len(ints[0]) // 4
    parts = [[v[p * w : p * w + w] for v in ints] for p in range(4)]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:256]
    books = [[parts[p][i] for i in first] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            held = defaultdict(list)
            for x in parts[p]:
                held[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(held[i]) for c in zip(*held[i], strict=True)] if i in held else e for i, e in enumerate(books[p])]
    found = [[nearest(parts[p][k], books[p]) for p in range(4)] for k in range(len(rows))]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    said = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], said) for r, f, e in zip(rows, found, errors, strict=True))


def coded(df):
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert coded(queries.op12_exponion_codes(spark, sf)) == codes_by_force(rows)


@pytest.mark.parametrize("size", [8, 6, 1])
def test_codes_of_ties_and_odd_rows(spark, size):
    rng = random.Random(size)
    rows = [(i // 2, [rng.choice([-1.0, 0.0, 0.5, 1.25]) for _ in range(size)], rng.choice([1, 2, None])) for i in range(300)]  # equal vectors, repeated ids
    rows += [(None, rows[0][1], 3), (7, rows[7][1], None), (400, [1.5] * size, 5)]
    bad = [(900, None, 1), (901, [None] * size, 1), (902, [float("nan")] * size, 1), (903, [float("-inf")] + [0.0] * (size - 1), 2)]
    docs = spark.createDataFrame(rows + bad, VECTORS).withColumns({"c0": F.lit(1), "code": F.lit("x"), "l": F.lit(1), "codes": F.lit("y"), "a.b": F.lit(0)})
    assert coded(vectorcodes.compress(docs)) == codes_by_force(rows)


def test_codes_of_few_large_and_other_vectors(spark):
    rows = [(i, [float((i * 7919) % 13) * 2.0**40, 1.0, -(2.0**45), float(i)], i % 2) for i in range(9)]
    other = [(50, [1.0], 0), (51, [2.0**60, 0.0, 0.0, 0.0], 9)]
    schema = "vec_id long, embedding array<double>, label int"
    got = coded(vectorcodes.compress(spark.createDataFrame(rows + other, schema)))
    expected = codes_by_force(rows)  # fewer vectors than entries: every error is 0
    (said,) = {k[4] for k in expected}
    assert got == expected + Counter({(50, None, None, 0, said): 1, (51, None, None, 0, said): 1})
    assert coded(vectorcodes.compress(spark.createDataFrame([], schema))) == Counter()
    assert coded(vectorcodes.compress(spark.createDataFrame([(1, None, 1)], schema))) == Counter()
    wide = [(i, [2.0**40 * math.sin(i), float(i % 7), 3.0, float(i % 5)], 1) for i in range(300)]
    assert {k[:2] for k in coded(vectorcodes.compress(spark.createDataFrame(wide, schema)))} == {k[:2] for k in codes_by_force(wide)}


def test_exponion_scans_the_radius_alone():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (256, 4)).astype(np.float64)
    x = centres[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 4))
    search = vectorcodes.Exponion(centres)
    far = ((x[:, None] - centres[None]) ** 2).sum(2)
    for before in (far.argmin(1), np.zeros(2000, np.int64), rng.integers(0, 256, 2000)):
        search.scanned = 0
        code, error = search.nearest(x, before)
        assert (code == far.argmin(1)).all() and (error == far.min(1)).all()
        if before is not None and (before == far.argmin(1)).all():
            assert search.scanned < 0.2 * 2000 * 256  # a good start leaves few entries


# --------------------------------------------------------------------------- 13


def base_by_force(text):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_patterns():
    rng = random.Random(8)
    bits = ["password", "PassWd", "secret", "tоken", "token", "api_key", "apikey", "API_Key", "K", "ſecret", '"', "'", " ", "  ", ":", "=", "abc123", "deadbeef" * 3, "AKIA", "ABCDEFGH12345678", "é", "\n", "0123456789abcdef", "AKIAAKIA" * 3]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert credentials.base_spans(text) == base_by_force(text)


def test_texts_with_spans_are_looked_at():
    rng = random.Random(9)
    bits = ["Password", "ecret=", "s", "token: ", "AKIA", "a" * 24, "0a" * 8, "Xy1" * 6, " ", "\n", "é", "bearer", "ABCDEF12" * 2]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(2000)]
    close = credentials.worth(*credentials.text_buffer(pa.array(texts)))
    for text, near in zip(texts, close.tolist(), strict=True):
        base = base_by_force(text)
        if base or any(k == credentials.SECRET for _, k, _ in credentials.weak_spans(text, base)):
            assert near or any(x in text.lower().encode() for x in credentials.NAMES)


def linked_by_force(text):
    """All pairs of parts."""
    base = base_by_force(text)
    parts = [(a, credentials.ROLE[k], b, True) for a, k, b in base] + [(a, k, b, False) for a, k, b in credentials.weak_spans(text, base)]
    scope = lambda x: len([m for m in re.finditer(r"\n[ \t\r]*\n", text) if m.start() <= x[0]])
    out = [(a, k, b) for a, k, b in base]
    for x in parts:
        near = {y[1] for y in parts if scope(x) == scope(y) and y[0] <= x[2] + credentials.REACH and y[2] >= x[0] - credentials.REACH}
        ok = {3: 4 in near, 4: bool(near & {3, 5}), 5: {3, 4} <= near}[x[1]]
        if not x[3] and ok:
            out.append(x[:3])
    return ",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_linked_parts(spark):
    rng = random.Random(10)
    bits = ["ABCD1234EFGH5678", "zY9xW8vU7tS6rQ5p", "https://db.example.com/x?y=1", "10.0.0.7:5432", "me@example.org", "client_id = app-77", "pwd: hunter22x", "0123456789abcdef01", "0123456789abcdef" * 2, "AKIA" + "Q7" * 8, "password=abcdef1", "host=db1.local", "\n\n", "\n \t\n", "é" * 40, "word " * 30, "word " * 70]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))) for i in range(400)]
    got = {r["doc_id"]: r for r in rows_of(credentials.find(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i]["spans"] == linked_by_force(text), text
        base = base_by_force(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[1] == k for x in base) for k in range(3)]
    added = Counter(k.split(":")[0] for r in got.values() for k in r["spans"].split(",") if k)
    assert min(added[k] for k in credentials.KINDS) > 5


def test_weak_parts_need_their_complement(spark):
    alone = ["see https://example.com/page today", "order ABCD1234EFGH5678 shipped", "id zY9xW8vU7tS6rQ5p only", "write to me@example.org", f"ABCD1234EFGH5678 {'word ' * 80} zY9xW8vU7tS6rQ5p", "ABCD1234EFGH5678\n\nzY9xW8vU7tS6rQ5p"]
    both = ["key ABCD1234EFGH5678 and zY9xW8vU7tS6rQ5p", "me@example.org password=abcdef1", "zY9xW8vU7tS6rQ5p at https://example.com/api"]
    got = {r["doc_id"]: r["spans"] for r in rows_of(credentials.find(spark.createDataFrame(list(enumerate(alone + both)), "doc_id long, text string")))}
    assert [got[i] for i in range(len(alone))] == [""] * len(alone)
    assert [got[len(alone) + i] for i in range(3)] == ["identifier:4:20,secret:25:41", "identifier:0:14,assign:15:31", "secret:0:16"]


def test_credentials_on_the_tables(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows_of(queries.op13_credential_links(spark, sf))
    assert len(got) == len(texts)
    for r in got:
        assert r["spans"] == linked_by_force(texts[r["doc_id"]] or "")


def test_credentials_odd(spark):
    token = "zY9xW8vU7tS6rQ5p"
    long = f"{token} ABCD1234EFGH5678 \n" * 20_000
    rows = [(1, None), (2, ""), (None, f"me@example.org {token}"), (3, f"me@example.org {token}"), (3, f"me@example.org {token}"), (4, "x" * 300_000), (5, "password" + " " * 200_000), (6, "@" * 100_000 + "a." * 50_000), (7, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rid": F.lit(1), "found": F.lit("x"), "parts": F.lit(2), "c0": F.lit(1), "a.b": F.lit(0)})
    began = time.monotonic()
    got = rows_of(credentials.find(docs))
    assert time.monotonic() - began < 60
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == len(rows) and by[1][0]["spans"] == by[2][0]["spans"] == by[4][0]["spans"] == by[5][0]["spans"] == ""
    assert {r["spans"] for r in by[3] + by[None]} == {"identifier:0:14,secret:15:31"} and len(by[3]) == 2
    assert by[7][0]["n_secret"] == by[7][0]["n_identifier"] == 20_000
    assert credentials.find(docs.where("false")).count() == 0


# --------------------------------------------------------------------------- earlier operators


def test_many_secrets_in_one_text_take_linear_time(spark):
    line = "token = 0123456789abcdef0123456789abcdef mail a@b.c 1.2.3.4 \n"
    took = []
    for n in (2_000, 8_000):
        began = time.monotonic()
        spans = pii.seed_spans(line * n)
        took.append(time.monotonic() - began)
        assert len(spans) == 3 * n
    assert took[1] < 8 * took[0] + 0.5
    docs = spark.createDataFrame([(1, line * 20_000), (2, "token = " + "0a" * 400)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(pii.find(docs))}
    assert got[1]["n_secret"] == 20_000 and got[2]["n_secret"] == 1 and {r["n_by_context"] for r in got.values()} == {0}


def test_overlaps_by_two_searches():
    rng = random.Random(4)
    for _ in range(300):
        spans = sorted((a := rng.randint(0, 60), 0, a + rng.randint(1, 15)) for _ in range(rng.randint(0, 6)))
        free = pii.Free(spans)
        for _ in range(20):
            a = rng.randint(0, 70)
            b = a + rng.randint(1, 10)
            assert free(a, b) == (not any(x < b and a < y for x, _, y in spans))


def test_labels_say_nothing_of_the_tables_urls(spark, sf):
    """The test tables' labels were not made from their urls: no set of one or two tokens stands out against labels
    that are dealt anew (so no rule is mined there, and none should be)."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", urlrules.tokens_of(F.col("url")).alias("t")).collect()
    labels = {r["doc_id"]: int(r["toxic"] == 1 or r["quality"] == 0) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [(set(r["t"]), labels[r["page_id"]]) for r in rows if r["page_id"] in labels]
    holds = defaultdict(list)
    for i, (tokens, _) in enumerate(known):
        for a in tokens:
            for b in tokens:
                if a <= b:
                    holds[a, b].append(i)
    sets = [np.array(x) for x in holds.values() if len(x) >= urlrules.COUNT]
    bad = np.array([b for _, b in known])
    rng = np.random.default_rng(7)

    def most(bad):
        rate = bad.mean()
        return max((bad[x].sum() - rate * len(x)) / math.sqrt(max(rate * (1 - rate) * len(x), 1e-9)) for x in sets)

    dealt = [most(rng.permutation(bad)) for _ in range(200)]
    assert np.mean([d >= most(bad) for d in dealt]) > 0.01
    assert queries.op7_association_rules(spark, sf).where("association is not null").count() == 0


def test_rarity_counts_every_document(spark):
    """No document is left out of the counts: a run of words that each document has once is seen in all of them."""
    import numpy as np

    from sparkseek.llm import linededup

    docs = spark.range(256).selectExpr("id as doc_id", "'one two three four' as text")
    level = linededup.rarity(docs)
    assert sorted(level[np.flatnonzero(level)].tolist()) == [9, 9, 9]  # three runs, 2^8 times each


def test_blocks_meet_within_edits_and_not_by_pairs_of_words():
    """Lines within the edits share a block; lines that share pairs of words, but no run of three, share none."""
    from sparkseek.llm import linededup

    def shown(lines):
        tokens = linededup._cut(pa.array(["\n".join(lines)]))[0]
        keys, rows, _ = linededup.first_grams(tokens, np.zeros(linededup.COUNTERS, np.uint8))
        return [set(keys[rows == i].tolist()) for i in range(len(lines))]

    rng = random.Random(33)
    for n in (7, 8, 12, 13, 14, 17, 20, 33, 60, 119, 250):
        lines = []
        for _ in range(40):
            line = [f"w{rng.randrange(40)}a" if rng.random() < 0.3 else "v" + "".join(rng.choice("bcdefg") for _ in range(6)) for _ in range(n)]
            other = list(line)
            for _ in range(linededup.EDITS * n // 100):
                at = rng.randrange(len(other))
                if rng.random() < 0.7:
                    other[at] = "new" + rng.choice("bcdefg")
                else:
                    del other[at]
            lines += [" ".join(line), " ".join(other)]
        keys = shown(lines)
        assert all(keys[i] & keys[i + 1] for i in range(0, len(lines), 2)), n
    pairs = [(f"p{chr(97 + i)}", f"q{chr(97 + i)}") for i in range(20)]
    lines = [" ".join(w for i, (a, b) in enumerate(pairs) for w in (a, b, f"own{chr(97 + k)}{chr(97 + i)}")) for k in range(2)]
    one, other = shown(lines)
    assert one and other and not one & other


def test_quality_batches_are_bounded_by_bytes(spark):
    """Long texts do not make Arrow batches of any size."""
    from sparkseek.llm import common, quality

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.range(2000).repartition(1).selectExpr("id as doc_id", "repeat(cast(id + 1000 as string), 3000) as text")
    quality.keep_good(docs)
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r["n"] for r in sizes) <= 2 * common.BATCH_BYTES


def test_counts_of_ngrams_leave_no_shuffles(spark, monkeypatch):
    """The shuffles of the counts go once their tables are written, before the next ones are made."""
    from sparkseek.llm import lmscore

    freed = []
    monkeypatch.setattr(lmscore, "free_shuffles", freed.append)
    docs = spark.createDataFrame([(i, "a b c a b c") for i in range(10)], "doc_id long, text string")
    assert lmscore.score(docs, F.lit(False)).count() == 10 and len(freed) == 2
