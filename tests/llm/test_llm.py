"""The training-data operators against brute force, and their defined results."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from sparkseek.llm import common, decontam, langid, linededup, lmscore, lookup, minhash, mixing, pii, quality, queries, rlindex, urlrules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, root string"
#: nulls in any column, empty, blank and very long texts, repeated rows, columns that clash
ODD = [
    (1, None, None, None, None, "k", 1, "r"),
    (2, "", "en", "a", 0, None, None, None),
    (3, " \n\t ", "en", "a", 4, "k", 1, "r"),
    (None, "one two three four five six", "en", "a", 5, "k", 1, "r"),
    (5, "word " * 40000, "en", "b", 200000, "k", 1, "r"),
    (6, "one two three", "fr", None, 13, "k", 1, "r"),
    (6, "one two three", "fr", None, 13, "k", 1, "r"),
    (7, "x" * 300000, "de", "b", 300000, "k", 1, "r"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


def unions(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --------------------------------------------------------------------------- parts


def test_tokens_equal_split():
    rng = random.Random(1)
    col = ["".join(rng.choice("abC \n\té") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, ""]
    t = common.Tokens.of(pa.array(col))
    seen = {}
    for i, x in enumerate(col):
        w = (x or "").translate(LOW).encode().split()
        got = t.hashes[t.first[i] : t.first[i + 1]].tolist()
        assert len(got) == len(w)
        for a, b in zip(w, got, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_tokens_do_not_depend_on_blocks(monkeypatch):
    col = pa.array(["alpha beta " * 50, "gamma", "x" * 700 + " y"])
    whole = common.Tokens.of(col)
    monkeypatch.setattr(common, "BLOCK", 16)
    cut = common.Tokens.of(col)
    assert (whole.hashes == cut.hashes).all() and (whole.first == cut.first).all()


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000).astype(np.uint64))
    find = lookup.Lookup(keys).find
    assert (find(keys) == np.arange(len(keys))).all() and (find(keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), find(keys + np.uint64(1)), -1)).all()
    assert (lookup.Lookup(np.zeros(0, np.uint64)).find(keys[:3]) == -1).all()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(30):
        pool = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = np.unique(pool[:200]), np.unique(pool[50:250])
        s = minhash.superminhash(np.concatenate([a, b]), np.array([len(a), len(b)]))
        errors.append((s[0] == s[1]).mean() - 150 / 250)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_superminhash_in_pieces():
    x = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64))
    whole, cut = minhash.superminhash(x, np.array([len(x)])), minhash.superminhash(x, np.array([len(x)]), together=100)
    assert (whole == cut).all()


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["root"] for r in common.components(common.Scratch(spark), spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    want = {n: r for n, r in unions(pairs, {x for p in pairs for x in p}).items() if n != r}
    assert got == want


# --------------------------------------------------------------------------- near duplicates


def near_by_force(texts):
    sets = {i: shingles(x) for i, x in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    links = []
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                links.append((i, j))
    return sets, unions(links, sets)


def test_near_duplicates(spark, sf, texts):
    sets, root = near_by_force(texts)
    got = rows_of(queries.op3_superminhash(spark, sf))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), root[i], root[i] == i) for i in texts}


def test_near_duplicate_chain(spark):
    """Items of one bucket that resemble each other, but not its least, are linked."""
    words = [f"w{i}" for i in range(400)]
    chain = {k: " ".join(words[20 * k : 20 * k + 160]) for k in range(8)}
    _, root = near_by_force(chain)
    got = minhash.near_duplicates(spark.createDataFrame(list(chain.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == root


def test_near_duplicates_odd(spark, odd):
    got = rows_of(minhash.near_duplicates(odd))
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == by[1] and by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[None] == [(2, None, True)] and by[5] == [(1, 5, True)] and by[6] == [(1, 6, True)] * 2 and by[7] == [(1, 7, True)]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_sketches_keep_every_similar_pair(spark):
    """The filter before verification loses no pair of 0.75, and tells most of 0.65 apart."""
    rng = np.random.default_rng(5)
    rows, want = [], []
    for n in (5, 40, 300, 1000):
        for same in (6 / 7, 0.79):  # of two sets of n elements: similarity 0.75 and 0.65
            for _ in range(20):
                k = math.ceil(n * same)
                x = rng.integers(0, 1 << 63, 2 * n - k).astype(np.uint64)
                a, b = np.unique(x[:n]), np.unique(np.append(x[:k], x[n:]))
                m = minhash.parity_words(np.concatenate([a, b]), np.array([len(a), len(b)])).view(np.int64).tolist()
                rows.append((len(rows), *m, len(a), len(b)))
                want.append(4 * k >= 3 * (2 * n - k))
    got = {r["id"] for r in spark.createDataFrame(rows, "id long, m_a array<long>, m_b array<long>, size_a long, size_b long").where(minhash.ALIKE).collect()}
    assert all(i in got for i, w in enumerate(want) if w) and len(got - {i for i, w in enumerate(want) if w}) < 10


# --------------------------------------------------------------------------- fuzzy lines


def test_edit_distance():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = random.Random(6)
    for _ in range(2000):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 8))] for _ in range(2))
        k = rng.randint(0, 8)
        assert linededup.within_edits(a, b, k) == (brute(a, b) <= k), (a, b, k)


def normal_lines(text):
    """(line number, words) by plain regular expressions."""
    for n, line in enumerate((text or "").lower().split("\n")):
        words = regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", line).split(" ")
        words = tuple(regex.sub("[0-9]", "0", w) for w in words if w)
        if len(words) >= linededup.MIN_WORDS:
            yield n, words


def edit_distance_within(a, b, most):
    """Plain table of the edit distance between word lists, in the band of ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, 9999) + 1, new.get(j - 1, 9999) + 1, row.get(j - 1, 9999) + (x != b[j - 1]) if j else i)
        row = new
    return row.get(len(b), 9999) <= most


def lines_by_force(texts):
    """All pairs of distinct normalised lines by the edit distance alone."""
    places = defaultdict(list)
    for i in sorted(texts):
        for n, words in normal_lines(texts[i]):
            places[words].append((i, n))
    keys = sorted(places, key=len)
    bags = [Counter(k) for k in keys]
    links = []
    for b, long in enumerate(keys):
        most = linededup.EDITS * len(long) // 100
        for a in range(b - 1, -1, -1):
            if len(keys[a]) < len(long) - most:
                break
            # an edit takes one word at most, so unlike bags need no table
            if (bags[a] & bags[b]).total() >= len(long) - most and edit_distance_within(keys[a], long, most):
                links.append((a, b))
    groups = defaultdict(list)
    for k, r in unions(links, range(len(keys))).items():
        groups[r] += places[keys[k]]
    gone = defaultdict(set)
    for g in groups.values():
        for i, n in set(g) - {min(g)}:
            gone[i].add(n)
    return gone


def test_fuzzy_lines(spark, sf, texts):
    gone = lines_by_force(texts)
    got = rows_of(queries.op10_fuzzy_lines(spark, sf))
    assert {r["doc_id"]: r["removed"] for r in got} == {i: sorted(gone[i]) for i in texts}
    assert sum(map(len, gone.values())) > 0


def test_fuzzy_lines_find_small_changes(spark):
    line = " ".join(f"token{i}" for i in range(200))
    other = line.replace("token7 ", "tokenX ")
    df = spark.createDataFrame([(1, line + "\nshort line"), (2, other.upper() + "\nshort line"), (3, "something else entirely different here")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linededup.clean(df).collect()}
    assert got == {1: line + "\nshort line", 2: "short line", 3: "something else entirely different here"}


def test_fuzzy_lines_find_every_pair_within_edits(spark):
    """Against edit distance alone, at each length, for the most edits that are allowed."""
    rng = random.Random(11)
    said = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, want = [], {}
    for n in (4, 6, 7, 8, 10, 12, 17, 20, 30, 50, 200):
        for _ in range(20):
            line = [rng.choice(said[: 20 if n > 8 else 300]) if rng.random() < 0.5 else rng.choice(said) for _ in range(n)]
            other = list(line)
            most = linededup.EDITS * n // 100
            for at in rng.sample(range(n), most):  # no insertions: the longer line stays the longer
                other[at] = "new" + rng.choice(said)
            far = list(line)
            for at in rng.sample(range(n), most + 1):
                far[at] = "far" + rng.choice(said)
            i = len(rows)
            rows += [(i, " ".join(line)), (i + 1, " ".join(other)), (i + 2, " ".join(far))]
            want |= {i: [], i + 1: [0], i + 2: []}
    got = {r["doc_id"]: r["removed"] for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = [t.split() for _, t in rows]
    for i in range(2, len(rows), 3):  # the third line may by chance be near the first after all
        near = any(linededup.within_edits(words[i], words[j], linededup.EDITS * len(words[i]) // 100) for j in (i - 1, i - 2))
        assert got[i] == ([0] if near else [])
        assert got[i - 1] == want[i - 1] and got[i - 2] == want[i - 2]


def test_fuzzy_lines_of_other_scripts_and_signs(spark):
    """Quotes, dashes and blanks outside ASCII separate words like those inside; letters of any script count."""
    rows = [(1, "\u201cthe quick\u2014brown fox\u201d jumps\u00a0over it"), (2, '"the quick-brown fox" jumps over it'), (3, "\u044d\u0442\u043e \u043f\u0440\u043e\u0441\u0442\u043e \u0442\u0435\u043a\u0441\u0442 \u0437\u0434\u0435\u0441\u044c"), (4, "\u042d\u0422\u041e \u043f\u0440\u043e\u0441\u0442\u043e, \u0442\u0435\u043a\u0441\u0442: \u0437\u0434\u0435\u0441\u044c!")]
    got = {r["doc_id"]: r["removed"] for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [0]}


def test_fuzzy_lines_ties_and_groups(spark):
    """The least place stays: of one document the first line, of rows with one doc_id all; a chain is one group."""
    word = [f"w{chr(97 + i)}" for i in range(20)]
    chain = [" ".join(word[:i] + [f"x{chr(97 + i)}"] * 1 + word[i + 1 :]) for i in range(4)]
    base = " ".join(word)
    rows = [(7, f"{base}\n{base}\nshort"), (7, f"{base}\n{base}\nshort"), (9, chain[1]), (8, chain[0]), (30, chain[2])]
    got = sorted((r["doc_id"], r["removed"]) for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(7, [1]), (7, [1]), (8, [0]), (9, [0]), (30, [0])]


def test_large_groups_make_few_pairs(spark):
    """A bucket of alike lines falls into one component after its first round."""
    rng = random.Random(21)
    base = [f"g{i}x" for i in range(40)]
    rows = []
    for i in range(400):
        line = list(base)
        line[rng.randrange(40)] = f"n{i}y"
        rows.append((i, " ".join(line)))
    got = linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 0").collect()
    assert [r["doc_id"] for r in got] == [0]


def test_keys_of_many_lines_lose_no_pair(spark):
    """Families of lines with 0 to 8 of 30 words changed, more than are paired at once, against all pairs."""
    rng = random.Random(24)
    texts, i = {}, 0
    for f in range(3):
        base = [f"f{chr(97 + f)}{chr(97 + k)}w" for k in range(30)]
        for _ in range(90):
            line = list(base)
            for at in rng.sample(range(30), rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8])):
                line[at] = f"n{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
            if rng.random() < 0.3:
                line.insert(rng.randrange(30), "more")
            texts[i] = " ".join(line)
            i += 1
    gone = lines_by_force(texts)
    got = {r["doc_id"]: r["removed"] for r in linededup.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {k: sorted(gone[k]) for k in texts} and any(got.values()) and len(texts) - sum(map(len, got.values())) > 3


def test_fuzzy_lines_odd(odd):
    got = linededup.clean(odd)
    assert got.columns == odd.columns and got.count() == len(ODD)
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(r[0], r[1]) for r in ODD}
    assert linededup.clean(odd.limit(0)).count() == 0 and linededup.report(odd.limit(0)).count() == 0


# --------------------------------------------------------------------------- decontamination


def contaminated_by_force(texts, items):
    def toks(x):
        t = decontam.tokens_of(pa.array([x]))
        return t.hashes

    out = set()
    bench = {i: toks(x) for i, x in items.items()}
    for d, x in texts.items():
        doc = toks(x or "")
        for i, item in bench.items():
            if len(item) < decontam.LEAST:
                continue
            for shift in range(-len(item) + 1, len(doc)):
                if decontam.overlap(doc, item, shift):
                    out.add((d, i))
                    break
    return out


def test_decontamination(spark, sf, texts):
    some = {i: x for i, x in texts.items() if len(x or "") < 3000}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = contaminated_by_force(some, items)
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_spaced_seeds(spark, sf).collect() if r["doc_id"] in some}
    assert got == want and want


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(8)
    item = [f"b{rng.randint(0, 999)}x" for _ in range(40)]
    docs = []
    for d in range(200):
        copy = [w if rng.random() > 0.1 else f"z{rng.randint(0, 9)}" for w in item]
        docs.append((d, " ".join(["pad"] * rng.randint(0, 9) + copy + ["tail"] * 5)))
    docs += [(1000 + d, " ".join(f"c{rng.randint(0, 999)}" for _ in range(60))) for d in range(100)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "two words"), (5, "pad pad pad pad pad tail")], "item_id long, text string")
    got = {r["doc_id"] for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect() if r["item_id"] == 1}
    assert len(got & set(range(200))) >= 198 and not any(d >= 1000 for d in got)


def test_every_overlap_is_hit():
    """Items of each length with as many substitutions as are allowed, against the plain comparison."""
    rng = random.Random(19)
    for n in [*range(5, 26), 33]:
        for _ in range(40):
            item = [rng.choice("abcdefgh") * 3 + str(rng.randint(0, 30)) for _ in range(n)]
            copy = list(item)
            for at in rng.sample(range(n), min(n, 20) * 20 // 100 + (rng.random() < 0.3)):
                copy[at] = "zz"
            doc = ["pad"] * rng.randint(0, 5) + copy + ["tail"] * rng.randint(0, 5)
            index = decontam.SeedIndex([1], [" ".join(item)])
            got = index.find(decontam.tokens_of(pa.array(["other words", " ".join(doc)])))
            have, said = (decontam.tokens_of(pa.array([" ".join(x)])).hashes for x in (doc, item))
            want = [w for shift in range(-n, len(doc)) if (w := decontam.overlap(have, said, shift))]
            assert not got[0] and [(x["begin"], x["end"], x["matched"]) for x in got[1]] == want


def test_decontamination_short_items_and_tables(spark, sf, monkeypatch):
    docs = spark.createDataFrame([(1, "aa the quick brown fox jumps bb"), (2, "the quick brown fox"), (3, None), (None, "\u201cThe quick \u2014 brown\u00a0fox jumps\u201d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The quick brown, fox jumps!"), (2, "one two three four five six seven"), (1, "The quick brown, fox jumps!"), (4, None)], "item_id long, text string")
    want = [(None, 1, 0, 5)] * 2 + [(1, 1, 1, 6)] * 2
    told = lambda: sorted(((r["doc_id"], r["item_id"], r["begin"], r["end"]) for r in decontam.contaminated(docs, bench).collect()), key=str)
    assert told() == sorted(want, key=str)
    every = sorted(map(tuple, queries.op1_spaced_seeds(spark, sf).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 16)  # too large to be broadcast: by tables
    assert told() == sorted(want, key=str)
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()) == [2, 3]
    assert sorted(map(tuple, queries.op1_spaced_seeds(spark, sf).collect())) == every


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd, bench).collect()] == [(None, 1)]
    left = decontam.decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == len(ODD) - 1
    assert decontam.decontaminate(odd.limit(0), bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0


# --------------------------------------------------------------------------- quality


def quality_by_force(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def bands_by_force(texts):
    """Whether the bands keep each text, by plain loops over all documents."""
    press = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    ratio = lambda b: len(press(b)) / len(b)
    seen, told = defaultdict(list), {}
    for i, x in texts.items():
        b = (x or "").encode()
        whole = ratio(b) if len(b) >= 64 else None
        parts, at = [], 0
        while len(b) - at >= 3072:
            parts.append(b[at : at + 2048])
            at += 2048
        full = [ratio(p) for p in parts]
        last = (len(b) - at, ratio(b[at:])) if parts else None
        told[i] = len(b), whole, full, last
        if whole is not None and not quality_by_force(x)[-1]:
            seen[math.floor(2 * math.log2(len(b)))].append(whole)
            seen["full"] += full
    fence = {}
    steps = {k: sorted(math.floor(x * 2000 + 0.5) for x in v) for k, v in seen.items() if v}
    for k, own in steps.items():
        v = [(x, 1.0) for x in own]
        lacking = 50 - len(own)
        for d in range(1, 80):
            near = [x for j in steps if j != "full" and k != "full" and abs(j - k) == d for x in steps[j]]
            if lacking > 1e-9 and near:
                w = min(1, lacking / len(near))
                v += [(x, w) for x in near]
                lacking -= w * len(near)
        if lacking > 1e-9:
            n, lo, hi = max(x for x in quality.BANDS if x[0] <= (2048 if k == "full" else max(64, 2 ** (k / 2))))
            v += [(round(lo * 2000), lacking / 2), (round(hi * 2000), lacking / 2)]
        v.sort()
        total = sum(w for _, w in v)
        quartile = lambda q, v=v, total=total: next(x for i, (x, _) in enumerate(v) if sum(w for _, w in v[: i + 1]) >= q * total - 1e-9)
        q1, q3 = quartile(0.25), quartile(0.75)
        fence[k] = (q1 - 3 * (q3 - q1)) / 2000, (q3 + 3 * (q3 - q1)) / 2000

    def bad(size, r, k):
        n, lo, hi = max(x for x in quality.BANDS if x[0] <= size)
        low, high = fence.get(k, (0, 9))
        return not (lo <= r <= hi and low <= r <= high)

    out = {}
    for i, (size, whole, full, last) in told.items():
        n_bad = sum(bad(2048, r, "full") for r in full) + (bad(*last, None) if last else 0)
        out[i] = (whole is None or not bad(size, whole, math.floor(2 * math.log2(size)))) and n_bad <= 0.5 * (len(full) + 1)
    return out


def test_quality(spark, sf, texts):
    bands = bands_by_force(texts)
    got = rows_of(queries.op6_compression_bands(spark, sf))
    for r in got:
        want = quality_by_force(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert r["kept"] == (bands[r["doc_id"]] and not r["base_failed"]), r
    assert len(got) == len(texts)


def test_quality_bands(spark):
    """Of prose with planted repetitive, symbol-laden and incompressible texts, the bands take those and nothing else."""
    rng = random.Random(9)
    parts = "an er on re ti the ing ou st ha ed nd sh ea or at".split()
    known = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(4000)]
    say = lambda n: " ".join(rng.choices(known, k=n))
    rows = [(i, say(rng.randint(150, 1500))) for i in range(600)]
    noise = [" ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(30)) for _ in range(100)) for _ in range(5)]
    lists = [" ".join(f"item {i % 7} of row {i // 7}" for i in range(1000)) for _ in range(5)]
    marked = [" ".join(w + rng.choice(["***", "&&&", "$$$"]) for w in say(900).split()) for _ in range(5)]
    rows += [(1000 + i, x) for i, x in enumerate(noise + lists + marked)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[1000 + i]["kept"] for i in range(15)) and not any(got[1000 + i]["base_failed"] for i in (*range(5), *range(10, 15)))
    assert sum(not got[i]["kept"] and not got[i]["base_failed"] for i in range(600)) <= 3


def test_quality_odd(odd):
    got = quality.judge(odd)
    assert all(r["base_failed"] and not r["kept"] for r in got.collect()) and got.count() == len(ODD)
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(odd).count() == 0
    assert quality.keep_good(odd.limit(0)).count() == 0


# --------------------------------------------------------------------------- mixing


def test_mixing_meets_its_targets(spark, sf, texts, docs):
    got = rows_of(queries.op8_temperature_mix(spark, sf))
    size = {i: len(WORD.findall(x or "")) for i, x in texts.items()}
    source = {r["doc_id"]: r["source"] or "" for r in docs.collect()}
    tokens, taken, copies = Counter(), Counter(), Counter()
    for i, n in size.items():
        tokens[source[i]] += n
    for r in got:
        assert r["mix_tokens"] == size[r["doc_id"]]
        taken[source[r["doc_id"]]] += size[r["doc_id"]]
        copies[r["doc_id"]] += 1
    total = sum(tokens.values())
    assert sum(taken.values()) <= total
    longest = {s: max(size[i] for i in size if source[i] == s) for s in tokens}
    # temperature: the realised shares are p^alpha / z for one alpha, but for a document a source
    def shares(alpha):
        z = sum((n / total) ** alpha for n in tokens.values())
        return {s: (n / total) ** alpha / z for s, n in tokens.items()}

    def entropy(alpha):
        return -sum(w * math.log(w) for w in shares(alpha).values())

    goal = entropy(1.0) + mixing.TOWARDS * (math.log(len(tokens)) - entropy(1.0))
    assert entropy(0.0) > goal > entropy(1.0)  # the target binds
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if entropy(mid) <= goal else (mid, high)
    w = shares(high)
    top = max(w[s] * total / tokens[s] for s in tokens)
    assert top <= mixing.MAX_REPEATS and 0 < high < 1
    assert max(abs(w[s] - tokens[s] / total) * len(tokens) for s in tokens) > 0.1  # and moves weight
    for s in tokens:
        assert -1 <= w[s] * total - taken[s] <= longest[s] + 1  # goals are rounded
    # blocks: copies within a source differ by one at most, and blocks are numbered from 0
    for s in tokens:
        n = [copies[i] for i in size if source[i] == s and size[i]]
        assert max(n) - min(n) <= 1
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["mix_block"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_mixing_repetition_limit(spark):
    rows = [(i, "big", "a b c d e f g h") for i in range(1000)] + [(5000 + i, "small", "a b") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.temperature_mix(df, towards=1.0, repeats=3.0)
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert 11 <= n["small"] <= 12 and n["big"] >= 990
    again = mixing.temperature_mix(df.repartition(7), towards=1.0, repeats=3.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_mixing_odd(odd):
    got = mixing.temperature_mix(odd)
    assert got.columns == [*odd.columns, "mix_tokens", "mix_block", "mix_order"] and got.count() > 0
    assert mixing.temperature_mix(odd.limit(0)).count() == 0
    assert mixing.temperature_mix(odd.where("doc_id < 4")).count() == 0  # no word anywhere
    clash = odd.withColumn("mix_tokens", F.lit("old")).withColumn("a.b", F.lit(1)).withColumn("s", F.lit("s")).withColumn("left", F.lit(2))
    want = [*odd.columns, "a.b", "s", "left", "mix_tokens", "mix_block", "mix_order"]
    assert mixing.temperature_mix(clash).columns == want and mixing.temperature_mix(clash.limit(0)).columns == want
    assert mixing.temperature_mix(clash).where("mix_tokens is null").count() == 0


def test_stages_pass_odd_columns_through(odd):
    """Names with dots, and those that the operators use themselves."""
    wide = odd.toDF("doc_id", "text", "lang", "source", "n_chars", "a.b", "id", "h").withColumn("label", F.lit(1)).withColumn("removed", F.lit(2)).withColumn("m", F.lit(3))
    bench = wide.sparkSession.createDataFrame([(9, "one two three four five six")], "item_id long, text string")
    for stage in (linededup.clean, quality.keep_good, minhash.deduplicate, lambda d: decontam.decontaminate(d, bench)):
        got = stage(wide)
        assert got.columns == wide.columns and got.count() <= len(ODD)


# --------------------------------------------------------------------------- personal data


BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def spans_by_force(text):
    out = []
    for k, p in enumerate(BASE):
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(10)
    for _ in range(20000):
        alphabet = rng.choice(["a.@-_", "0123456789 -", "12.", "+1 ()-0.a", "a@b.c1+ 2-.é"])
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == spans_by_force(t), t


def test_personal_data(spark, sf, texts):
    for r in rows_of(queries.op2_contextual_pii(spark, sf)):
        base = spans_by_force(texts[r["doc_id"]])
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r["spans"].split(",")) if said else True
        secrets = [f"secret:{m.start()}:{m.end()}" for m in re.finditer(r"\b(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}\b", texts[r["doc_id"]] or "")]
        assert set(secrets) <= set(r["spans"].split(",")) if secrets else r["n_secret"] == 0


def test_contexts_discover_new_identifiers(spark):
    rows = [(i, f"Hello there, please call me on +1 (555) 010-{1000 + i} before noon.") for i in range(12)]
    rows += [(100 + i, f"If not, please call me on 555-01{10 + i} before noon.") for i in range(5)]
    rows += [(200 + i, f"The part number is 555-02{10 + i} and it costs little.") for i in range(5)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i]["n_added"] == 1 and got[100 + i]["spans"] == "phone:26:34" and got[100 + i]["n_phone"] == 0 for i in range(5))
    assert all(got[200 + i]["spans"] == "" for i in range(5)) and all(got[i]["n_phone"] == 1 and got[i]["n_added"] == 0 for i in range(12))


def test_trusted_patterns_propose_and_common_words_do_not(spark):
    """Secrets in sure contexts are found whatever they look like; a word before a few seeds and many other words is no pattern."""
    rng = random.Random(22)
    hexes = lambda n: "0a" + "".join(rng.choice("0123456789abcdef") for _ in range(n - 2))
    rows = [(i, f'settings: \u00e9t\u00e9 api_token = "{hexes(40)}" end of the 4{i}th line') for i in range(10)]
    rows += [(100 + i, f'more: \u00e9t\u00e9 api_token = "Zq{i}-unseen_{i}" end of the line') for i in range(6)]
    rows += [(200 + i, f"we saw the {hexes(36)} there") for i in range(4)] + [(300 + i, f"we saw the number10{i} and the tree by the house {i}") for i in range(30)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        text = dict(rows)[100 + i]
        a = text.index("Zq")
        assert got[100 + i]["spans"] == f"secret:{a}:{text.index(chr(34), a)}"
    assert all(got[i]["n_secret"] == 1 for i in (*range(10), *range(200, 204))) and all(got[300 + i]["spans"] == "" for i in range(30))


def bootstrap_by_force(edges, against):
    """The graph's scores by plain dictionaries."""
    seed = {(k, i): False for k, _, i, _ in edges}
    for k, _, i, b in edges:
        seed[k, i] |= b
    own = {}
    for k, p, i, b in edges:
        own[k, p, i] = own.get((k, p, i), False) or b
    score = {e: 1.0 if b else 0.0 for e, b in own.items()}
    for n in range(pii.ROUNDS):
        by = defaultdict(list)
        for k, p, i in own:
            by[k, p].append((k, p, i))
        conf = {kp: sum(score[e] for e in es) / (len(es) + against.get(kp, 0) + pii.PRIOR) for kp, es in by.items()}
        seeds = {kp: sum(own[e] for e in es) for kp, es in by.items()}
        if n == pii.ROUNDS - 1:
            break
        miss = defaultdict(lambda: 1.0)
        for k, p, i in own:
            miss[k, i] *= 1 - (min(conf[k, p], 0.999) if seeds[k, p] else 0.0)
        score = {(k, p, i): 1.0 if any(own[k, q, i] for q in {e[1] for e in own if e[0] == k and e[2] == i}) else 1 - miss[k, i] for k, p, i in own}
    return {kp: c for kp, c in conf.items() if c >= pii.CONFIDENCE and seeds[kp] >= pii.SEEDS}


def test_bootstrap_by_force(spark):
    rng = random.Random(23)
    edges = [(rng.randint(0, 1), rng.randint(0, 12), f"i{rng.randint(0, 60)}", rng.random() < 0.6) for _ in range(400)]
    against = {(k, p): rng.randint(0, 12) for k in (0, 1) for p in range(0, 12, 3)}
    df = spark.createDataFrame(edges, "kind int, pattern long, instance string, base boolean")
    no = spark.createDataFrame([(*kp, n) for kp, n in against.items()], "kind int, pattern long, n long")
    got = {(r["kind"], r["pattern"]): r["confidence"] for r in pii.bootstrap(common.Scratch(spark), df, no).collect()}
    want = bootstrap_by_force(edges, against)
    assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(c) for k, c in want.items())


def test_personal_data_odd(spark, odd):
    assert all(r["spans"] == "" for r in pii.find(odd).collect()) and pii.find(odd).count() == len(ODD)
    assert pii.find(odd.limit(0)).count() == 0
    long = [(1, "@" * 200000), (2, "1" * 200000), (3, "1." * 100000), (4, "a" * 200000 + "@"), (5, "+1 " * 70000), (6, "1 " * 100000), (7, "x@ " * 400000), (8, "0" * 100000 + "a" * 100000)]
    assert pii.find(spark.createDataFrame(long, "doc_id long, text string")).count() == 8  # in linear time


# --------------------------------------------------------------------------- language


def test_language_on_held_out_documents(spark, sf, docs):
    got = rows_of(queries.op4_partial_matching(spark, sf))
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.97 * len(out) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_code_lengths_by_force(spark):
    train = [(1, "abracadabra", "x"), (2, "banana band", "y"), (3, "abba", "x")]
    table = langid.count(spark.createDataFrame(train, "doc_id long, text string, lang string"), 2).toArrow()
    trees = langid.Trees(table, 2)

    def force(lang, text):
        counts = Counter()
        for _, t, la in train:
            if la == lang:
                s = "\n\n" + t
                for i in range(2, len(s)):
                    for w in (1, 2, 3):
                        counts[s[i - w + 1 : i + 1]] += 1
        total = 0.0
        s = "\n\n" + text
        for i in range(2, len(s)):
            for w in (3, 2, 1, 0):
                if w == 0:
                    total += 8
                    break
                past = s[i - w + 1 : i]
                seen = {g: n for g, n in counts.items() if len(g) == w and g[:-1] == past}
                t, d, own = sum(seen.values()), len(seen), seen.get(s[i - w + 1 : i + 1], 0)
                if own:
                    total -= math.log2(own / (t + d))
                    break
                if t:
                    total -= math.log2(d / (t + d))
        return total

    for text in ("abracadabra", "bandana", "zebra", "a"):
        got = trees.lengths(pa.array([text]))[0]
        assert got == pytest.approx([force("x", text), force("y", text)], rel=1e-5)


def test_language_odd(odd):
    got = {r["doc_id"]: r for r in langid.predict(odd, F.lit(False)).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["score"] == 0
    assert got[7]["lang_pred"] == "de"
    assert langid.predict(odd.limit(0), F.lit(False)).count() == 0
    none = langid.predict(odd, F.lit(True)).collect()
    assert len(none) == len(ODD) and {r["lang_pred"] for r in none} == {"und"}


# --------------------------------------------------------------------------- language model


def test_base_scores(spark, sf, texts):
    toks = {i: WORD.findall((x or "").translate(LOW)) + [None] for i, x in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = rows_of(queries.op5_backoff_automaton(spark, sf))
    for r in got:
        t = toks[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # histories help on unseen documents


class PlainModel:
    """The model by plain dictionaries, straight from its definition."""

    def __init__(self, texts, least):
        toks = [["<s>", *WORD.findall((x or "").translate(LOW)), "</s>"] for x in texts]
        self.c = [Counter(tuple(t[i : i + n]) for t in toks for i in range(len(t) - n + 1)) for n in (1, 2, 3)]
        self.kept = [Counter({g: k for g, k in c.items() if k >= least}) for c in self.c[1:]]
        self.n = sum(k for g, k in self.c[0].items() if g != ("<s>",))
        self.v = len(self.c[0]) - 1 if texts else 0
        self.left = [defaultdict(float), defaultdict(float)]
        for i, kept in enumerate(self.kept):
            for g, k in kept.items():
                self.left[i][g[:-1]] += k - lmscore.DISCOUNT

    def p(self, w, past):
        if not past:
            return (self.c[0][w,] + 0.5) / (self.n + 0.5 * (self.v + 1))
        i = len(past) - 1
        low = self.p(w, past[1:])
        if past not in self.left[i]:
            return low
        n = self.c[i][past]
        own = (self.kept[i][*past, w] - lmscore.DISCOUNT) / n if (*past, w) in self.kept[i] else 0.0
        return own + (1 - self.left[i][past] / n) * low

    def score(self, text):
        t = ["<s>", *WORD.findall((text or "").translate(LOW)), "</s>"]
        return sum(math.log10(self.p(t[i], tuple(t[max(0, i - 2) : i]))) for i in range(1, len(t)))


def test_scores_by_a_plain_model(spark, monkeypatch):
    rng = random.Random(12)
    word = ["a", "b", "c", "d", "e", "f", "g"]
    text = lambda: " ".join(rng.choices(word, [8, 4, 2, 1, 1, 1, 1], k=rng.choice([0, 1, 2, 3, 40, 200])))
    rows = [(i, text(), i % 4 == 0) for i in range(200)] + [(900, "a zz b", True), (901, None, True), (902, "b c d " * 100, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, out boolean").repartition(3)
    monkeypatch.setattr(lmscore, "FLUSH", 1500)
    for least in (2, 5):
        model = PlainModel([x for _, x, out in rows if not out], least)
        got = {r["doc_id"]: r for r in lmscore.score(df, F.col("out"), least).collect()}
        assert len(got) == len(rows)
        for i, x, out in rows:
            assert got[i]["held_out"] == out and got[i]["score"] == pytest.approx(model.score(x), rel=1e-9), (i, x)
        # after any history the probabilities of all words and of an unseen one add up to 1
        for past in ((), ("a",), ("<s>",), ("a", "b"), ("b", "c"), ("zz",)):
            assert sum(model.p(w, past) for w in [*word, "</s>", "unseen"] + (["zz"] if model.c[0]["zz",] else [])) == pytest.approx(1)


def test_scores_on_the_tables_by_a_plain_model(spark, sf, texts):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    model = PlainModel([x for i, x in texts.items() if not held[i]], lmscore.LEAST)
    for r in rows_of(queries.op5_backoff_automaton(spark, sf)):
        assert r["score"] == pytest.approx(model.score(texts[r["doc_id"]]), rel=1e-9)
    assert sum(map(len, model.kept)) > 200


def test_language_model_odd(odd):
    got = lmscore.score(odd, F.lit(False)).collect()
    assert len(got) == len(ODD) and all(r["n_tokens"] >= 1 and math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert lmscore.score(odd.limit(0), F.lit(False)).count() == 0
    untrained = lmscore.score(odd, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in untrained)


# --------------------------------------------------------------------------- urls


def url_by_force(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOW)
    fits = [(len(t), t, v) for v, t in urlrules.RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark, sf):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op7_association_rules(spark, sf).collect():
        host, path, rule, verdict = url_by_force(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict)
        assert r["verdict"] in ("allow", "block")


def test_url_parts_odd(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.B/x?y#z", "a://Example.COM/en/7", "x://net", "ftp://net/de/?q", "q?u=http://org/es/1", "http://É.com/en/ \n#"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://com/en/1")] * 2, "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urlrules.judge(pages, labels).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = urls[r["page_id"]] if r["page_id"] is not None else "http://com/en/1"
        assert (r["host"], r["path"], r["rule"]) == url_by_force(url)[:3], url
    assert urlrules.judge(pages.limit(0), labels).count() == 0


def test_association_rules(spark):
    rng = random.Random(13)
    pages, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        host = "shop.spam.test" if bad else rng.choice(["a.good.test", "b.good.test"])
        pages.append((i, f"http://{host}/{rng.choice(['x', 'y'])}/{i}"))
        if i < 300:
            labels.append((i, 1, int(bad)))
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(400))


def test_association_rules_on_urls_held_out(spark):
    """Rules mined from two thirds of noisy labels, judged on the others: few good urls are blocked, most bad ones are."""
    rng = random.Random(25)
    pages, bad = [], {}
    for i in range(1500):
        bad[i] = rng.random() < 0.3
        host = rng.choice(["win.spam.test", "cheap.pills.test"]) if bad[i] and rng.random() < 0.9 else rng.choice(["news.good.test", "shop.good.test", "win.good.test"])
        pages.append((i, f"http://{host}/{rng.choice(['a', 'b', 'win'])}/{i}?{rng.choice(['id', 'ref'])}=1"))
    labels = [(i, 1, int(bad[i] != (rng.random() < 0.03))) for i in range(1000)]
    got = {r["page_id"]: r["verdict"] == "block" for r in urlrules.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    blocked = [i for i in range(1000, 1500) if got[i]]
    assert sum(bad[i] for i in blocked) >= 0.95 * len(blocked) and sum(bad[i] for i in blocked) >= 0.8 * sum(bad[i] for i in range(1000, 1500))


def test_few_labels_make_no_rule(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.test/x") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(i < 4)) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r["verdict"] for r in urlrules.judge(pages, labels).collect()} == {"allow"}


# --------------------------------------------------------------------------- repeated strings


def repeats_by_force(rows):
    first, out = {}, {}
    raws = sorted((i, (x or "").encode()) for i, x in rows)
    for i, b in raws:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def as_told(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_repeats(spark, sf, texts):
    assert as_told(queries.op9_run_length_index(spark, sf)) == repeats_by_force(texts.items())


@pytest.mark.parametrize("group", [rlindex.GROUP, 0])
def test_repeats_of_varied_copies(spark, group):
    """Copies with changes, periodic texts, and (group 0) the way of too large groups."""
    rng = random.Random(14)
    base = "".join(rng.choice("abcdé ") for _ in range(300))
    rows = [(i, base[rng.randint(0, 80) :] + rng.choice("xyz") + base[: rng.randint(0, 250)]) for i in range(40)]
    rows += [(100, "ab" * 100), (101, "ab" * 60), (102, "a" * 120), (103, "a" * 49), (104, "b" + "a" * 50), (105, base), (106, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_told(rlindex.remove_repeats(df, group)) == repeats_by_force(rows)


def test_index_by_force():
    rng = random.Random(15)
    for _ in range(60):
        alphabet = rng.choice([b"ab", b"abcd \xc3", bytes(range(256))])
        base = bytes(rng.choice(alphabet) for _ in range(120))
        texts = {bytes(base[(a := rng.randint(0, 60)) : a + rng.randint(1, 80)][: rng.randint(1, 80)]) + bytes([rng.choice(alphabet)]) * rng.randint(0, 2) for _ in range(rng.randint(1, 30))}
        texts, docs = list(texts), None
        docs = np.array([rng.randint(0, 9) for _ in texts])
        first = {}
        for t, d in zip(texts, docs, strict=True):
            for i in range(len(t) - 49):
                first[t[i : i + 50]] = min(first.get(t[i : i + 50], 99), d)
        want = [sum(1 << i for i in range(len(t) - 49) if first[t[i : i + 50]] < d) for t, d in zip(texts, docs, strict=True)]
        assert rlindex.masks(texts, docs).tolist() == want


def test_index_compresses_repetitive_text():
    rng = random.Random(16)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(70))
    texts = [base[:i] + bytes([rng.choice(b"xyz")]) + base[i + 1 :] for i in range(70)]
    index = rlindex.RunLengthIndex(list(dict.fromkeys(texts)), np.arange(len(set(texts))))
    assert len(index.start) < index.rows / 5


def test_repeats_odd(odd):
    got = rlindex.remove_repeats(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD) and all(r["n_removed"] == 0 for r in got)
    assert by[1]["n_bytes"] == 0 and by[1]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and by[7]["n_bytes"] == 300000
    assert rlindex.remove_repeats(odd.limit(0)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(17)
    text = "".join(rng.choice("abcdef ") for _ in range(3000))
    whole = rlindex.minimizers(np.frombuffer(text.encode(), np.uint8), np.array([0, 3000]))
    buf, off = common.text_buffer(pa.array([text]))
    assert (whole[2] == rlindex.runs_of(pa.array([text]))[2]).all() and len(buf) == off[-1]


# --------------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, sf, docs, tmp_path):
    """Each stage against its operator's own test version, on what the one before kept."""
    rows = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        before, after = {r["doc_id"]: r for r in rows.collect()}, {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "quality":
            bands = bands_by_force({d: r["text"] for d, r in before.items()})
            assert set(after) == {d for d, r in before.items() if bands[d] and not quality_by_force(r["text"])[-1]}
        elif name == "line dedup":
            gone = lines_by_force({d: r["text"] for d, r in before.items()})
            assert {d: r["text"] for d, r in after.items()} == {d: "\n".join(x for n, x in enumerate(r["text"].split("\n")) if n not in gone[d]) for d, r in before.items()}
        elif name == "near dedup":
            _, root = near_by_force({d: r["text"] for d, r in before.items()})
            assert set(after) == {d for d, r in root.items() if d == r}
        elif name == "decontamination":
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
            bad = {d for d, _ in contaminated_by_force({d: r["text"] for d, r in before.items() if len(r["text"]) < 3000}, items)}
            assert len(bad & set(after)) <= 0.01 * len(bad)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        rows = out
    assert rows.count() > 0


def test_pipeline_on_odd_and_empty_tables(spark, sf, odd):
    """Nulls, empty and very long texts, repeated rows, clashing columns; an empty table gives an empty mixture."""
    for rows in (odd, odd.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, sf)
            n = out.count()
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == rows.columns and n <= rows.count()
            elif not rows.isEmpty():
                assert n >= 0
            # every stage sees the odd rows, whatever the one before kept
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), sf).count() == 0
