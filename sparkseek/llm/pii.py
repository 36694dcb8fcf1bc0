"""Personal data: base patterns, and bootstrapped contextual extraction on top.

Base spans come from fixed patterns for four kinds; runs of 32 hexadecimal digits or more that are
neither all digits nor all letters are seeds of a fifth kind, ``secret``, and spans as well.

1. Seeds induce lexical patterns: the word before a seed with the signs between them (``token = "``),
   and the same with one more word before it.  A pattern that stands before ``SEEDS`` distinct seeds
   of a kind is a candidate for that kind.
2. Every place in every text where a candidate pattern stands proposes the token there, its
   instance.  Tokens that can't be of the kind at all (no digit, no @, too short) count against the
   pattern, wherever they are.
3. Pattern and instance form a bipartite graph per kind, scored for ``ROUNDS`` rounds: a pattern's
   confidence is the share of its instances' scores, smoothed; an instance that is no seed has the
   chance that at least one of its patterns is right.
4. Instances at patterns of ``CONFIDENCE`` become spans, of the kind of their surest pattern.

Defined results.  A null or empty text has no span.  Every row gives its row; repeated rows add
no weight in the graph, whose instances are distinct, and count as often where tokens count against
a pattern.  Added spans never overlap base spans or each other.  Offsets are code points, ends
exclusive; spans are sorted by start, then kind as listed.  Extra columns are ignored.

Every scan is linear in the text: runs are found by possessive patterns, or grown to the left
from an @ up to the one before, so no pattern is tried again at each place of a long run."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Held, Scratch, Tokens, lean, mix, powers, prefix_hash, signed, slices, text_buffer

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
ROUNDS, PRIOR, CONFIDENCE, SEEDS = 3, 1.0, 0.6, 3
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]+)++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,}+(?![0-9A-Za-z])")
#: Bytes that a word of a pattern, and a proposed token, don't hold; signs that a token doesn't end with.
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
NO_TOKEN = np.zeros(256, bool)
NO_TOKEN[[*range(9, 14), *b" \"'<>()[]{},;|"]] = True
END_SIGNS = np.zeros(256, bool)
END_SIGNS[[*b".:!?="]] = True
#: The most bytes between the words of a pattern, and between it and the token; the least of an instance.
GAP, SHORT = 6, 6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted.

    Leftmost matches without overlap per kind.  The local part of an address reaches left
    from its @ to the first other character or the end of the match before; four groups of a
    chain of digit groups are one match; a run of digits with single separators is one."""
    out = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = done + len(text[done:at].rstrip(LOCAL))
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, 0, done := m.end()))
        done = at = max(at + 1, done)  # no later local part reaches over this @
    for m in CHAIN.finditer(text):
        groups = m[0].split(".")
        place = m.start()
        for i in range(0, len(groups), 4):
            four = groups[i : i + 4]
            size = sum(map(len, four)) + len(four) - 1
            if len(four) == 4 and all(len(g.lstrip("0")) < 4 and int(g.lstrip("0") or 0) <= 255 for g in four):
                out.append((place, 1, place + size))
            place += size + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    at = 0
    while (at := text.find("+", at)) >= 0:
        if m := PHONE.match(text, at):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((at, 3, m.end()))
            at = m.end()
        else:
            at += 1
    return sorted(out)


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns and of the secrets that overlap none of them."""
    base = base_spans(text)
    free = Free(base)
    return sorted(base + [(m.start(), 4, m.end()) for m in SECRET.finditer(text) if free(m.start(), m.end())])


class Free:
    """Whether a stretch overlaps none of the given spans, by two searches."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [a for a, _, _ in spans]
        self.ends = list(accumulate((b for _, _, b in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return not before or self.ends[before - 1] <= start


class Contexts:
    """Words of a text column, and the patterns before given places of it."""

    def __init__(self, texts: pa.Array):
        self.buf, self.off = text_buffer(texts)
        self.words = Tokens(self.buf, self.off, break_=NO_WORD)
        self.sums = prefix_hash(self.buf)
        self.digits = np.concatenate(([0], np.cumsum((self.buf >= 48) & (self.buf < 58))))

    def _between(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the bytes from a to b, and whether they may stand in a pattern: few, and no digit."""
        _, inv = powers(len(self.buf) + 1)
        ok = (b > a) & (b - a <= GAP) & (self.digits[b] == self.digits[a])
        return mix((self.sums[b] - self.sums[a]) * inv[a] + (b - a).astype(U64)), ok

    def before(self, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the patterns of one and of two words that end at each place; 0: none."""
        w = self.words
        one, two = np.zeros(len(at), U64), np.zeros(len(at), U64)
        if not len(w.hashes):
            return one, two
        last = np.searchsorted(w.ends, at, "right") - 1
        here = last >= w.first[row]
        last = np.maximum(last, 0)
        sign, ok = self._between(w.ends[last], at)
        ok &= here
        one[ok] = mix(w.hashes[last[ok]] ^ sign[ok])
        prior = np.maximum(last - 1, 0)
        sign, near = self._between(w.ends[prior], w.starts[last])
        ok &= near & (last > w.first[row])
        two[ok] = mix(one[ok] * U64(0x9E3779B97F4A7C15) + mix(w.hashes[prior[ok]] ^ sign[ok]))
        return one, two

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and row of every token."""
        t = Tokens(self.buf, self.off, break_=NO_TOKEN)
        begin, end = t.starts, t.ends.copy()
        for _ in range(3):
            end -= END_SIGNS[self.buf[np.maximum(end - 1, 0)]] & (end > begin)
        return begin, end, t.rows


FOUND = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _instance(token: str, kind: int) -> str:
    return token.lower() if kind in (0, 4) else re.sub("[^0-9]", "", token)


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base_sha256, found, seeds) of every row: the spans of the base patterns and
    secrets, and the patterns before them."""
    seed = pa.struct([("kind", pa.int32()), ("pattern", pa.int64()), ("instance", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, found, where = [], [], []
                for i, value in enumerate(batch.column(2)):
                    text = value.as_py() or ""
                    spans = seed_spans(text) if "@" in text or re.search("[0-9]", text) else []
                    hashes.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < BASE).encode()).hexdigest())
                    found.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                    where += [(i, len(text[:a].encode("utf-8", "surrogatepass")), k, _instance(text[a:b], k)) for a, k, b in spans]
                told: list[list[dict]] = [[] for _ in hashes]
                if where:
                    c = Contexts(batch.column(2))
                    row = np.array([x[0] for x in where])
                    for p in c.before(c.off[row] + np.array([x[1] for x in where]), row):
                        for (i, _, k, said), h in zip(where, signed(p).tolist(), strict=True):
                            if h:
                                told[i].append({"kind": k, "pattern": h, "instance": said})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.string()), pa.array(found, pa.list_(FOUND)), pa.array(told, pa.list_(seed))], ["doc_id", "th", "base_sha256", "found", "seeds"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(lean(run), f"doc_id {kind}, th long, base_sha256 string, found {SPANS}, seeds array<struct<kind:int,pattern:long,instance:string>>")


def proposals(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(th, start, end, pattern, token, n): the tokens that patterns (pattern) propose, and for each
    pattern how many tokens (n; token null) can be of no kind, batch by batch."""
    shared = docs.sparkSession.sparkContext.broadcast(Held(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                c = Contexts(batch.column(1))
                begin, end, row = c.tokens()
                signs = np.concatenate(([0], np.cumsum((c.buf == 64) | (c.buf == 43))))
                like = c.digits[end] - c.digits[begin] + signs[end] - signs[begin] > 0  # every seed begins with such a token
                rows, against = [], []
                for p in c.before(begin, row):
                    hit = (p != 0) & shared.value(p)
                    against.append(p[hit & ~like])
                    rows += [(i, a, b, h) for i, a, b, h in zip(*(x[hit & like].tolist() for x in (row, begin, end, p.view(np.int64))), strict=True)]
                out, small = [], []
                texts: dict[int, tuple[str, Free, np.ndarray]] = {}
                for i, a, b, h in rows:
                    if i not in texts:
                        text = batch.column(1)[i].as_py()
                        raw = c.buf[c.off[i] : c.off[i + 1]]
                        # code points before each byte: bytes that continue none
                        texts[i] = text, Free(seed_spans(text)), np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    text, free, points = texts[i]
                    start, stop = int(points[a - c.off[i]]), int(points[b - c.off[i]])
                    if not free(start, stop):
                        continue
                    if b - a < SHORT:
                        small.append(h)
                    else:
                        out.append((batch.column(0)[i].as_py(), start, stop, h, text[start:stop], None))
                none, n = np.unique(np.concatenate([*against, np.array(small, np.int64).view(U64)]), return_counts=True)
                out += [(None, None, None, h, None, k) for h, k in zip(none.view(np.int64).tolist(), n.tolist(), strict=True)]
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["th", "start", "end", "pattern", "token", "n"])

    return docs.where("text is not null").select(F.xxhash64("text").alias("th"), "text").mapInArrow(lean(run), "th long, start int, end int, pattern long, token string, n long")


def _fits_kind() -> Column:
    """Whether a token can be of the kind."""
    digits = F.length(F.regexp_replace("token", "[^0-9]", ""))
    return F.when(F.col("kind") == 0, F.contains("token", F.lit("@"))).when(F.col("kind") == 4, (F.length("token") >= 8) & (digits > 0)).otherwise(digits >= 5)


def bootstrap(scratch: Scratch, edges: DataFrame, against: DataFrame) -> DataFrame:
    """(kind, pattern, confidence) of the patterns that are sure enough.  edges: (kind, pattern,
    instance, base), against: (kind, pattern, n)."""
    edges = scratch.write(edges.groupBy("kind", "pattern", "instance").agg(F.max("base").alias("base")), "edges")
    graph = edges.withColumn("score", F.col("base").cast("double"))
    for i in range(ROUNDS):
        rated = graph.groupBy("kind", "pattern").agg(F.sum("score").alias("s"), F.count("*").alias("k"), F.count_if("base").alias("seeds")).join(against, ["kind", "pattern"], "left")
        rated = scratch.write(rated.select("kind", "pattern", "seeds", (F.col("s") / (F.col("k") + F.coalesce("n", F.lit(0)) + PRIOR)).alias("confidence")), f"rated-{i}")
        if i == ROUNDS - 1:
            break
        trust = F.when(F.col("seeds") > 0, F.least("confidence", F.lit(0.999))).otherwise(0.0)
        said = edges.join(rated, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("base").alias("seed"), (1 - F.exp(F.sum(F.log1p(-trust)))).alias("s"))
        graph = edges.join(said.select("kind", "instance", F.when(F.col("seed"), 1.0).otherwise(F.col("s")).alias("score")), ["kind", "instance"])
    return rated.where((F.col("confidence") >= CONFIDENCE) & (F.col("seeds") >= SEEDS)).select("kind", "pattern", "confidence")


def discover(scratch: Scratch, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(th, added): the spans that trusted patterns add to each text."""
    seeds = rows.where(F.size("seeds") > 0).select(F.explode("seeds").alias("x")).select("x.*").distinct()
    able = scratch.write(seeds.groupBy("kind", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SEEDS).select("kind", "pattern"), "able")
    said = scratch.write(proposals(docs, able.select("pattern").distinct()), "proposals") if not able.isEmpty() else scratch.spark.createDataFrame([], "th long, start int, end int, pattern long, token string, n long")
    against = said.where("token is null").groupBy("pattern").agg(F.sum("n").alias("n")).join(able, "pattern").select("kind", "pattern", "n")
    told = said.where("token is not null").join(able, "pattern")
    unfit = told.where(~_fits_kind()).groupBy("kind", "pattern").agg(F.count("*").alias("n"))
    against = against.union(unfit).groupBy("kind", "pattern").agg(F.sum("n").alias("n"))
    name = F.when(F.col("kind").isin(0, 4), F.lower("token")).otherwise(F.regexp_replace("token", "[^0-9]", ""))
    told = scratch.write(told.where(_fits_kind()).withColumn("instance", name), "told")
    known = seeds.join(able, ["kind", "pattern"], "left_semi").withColumn("base", F.lit(True))
    edges = known.unionByName(told.select("kind", "pattern", "instance", F.lit(False).alias("base")))
    good = bootstrap(scratch, edges, against)
    best = told.join(good, ["kind", "pattern"]).groupBy("th", "start", "end").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    return best.groupBy("th").agg(F.collect_list(F.struct("start", (-F.col("b.k")).alias("kind"), "end")).cast(SPANS).alias("added"))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_added, n_found,
    n_by_context) of every row: counts by kind of base spans, all spans, how many are no base spans, and how many of
    those a trusted context found (the others are secrets by their form)."""
    scratch = Scratch(docs.sparkSession)
    told = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = scratch.write(extract(told), "found")
    added = scratch.write(discover(scratch, told, rows), "added")
    out = rows.join(added, "th", "left").withColumn("own", F.filter("found", lambda x: x["kind"] < BASE))
    spans = F.array_sort(F.concat("found", F.coalesce("added", F.array().cast(SPANS))))
    names = F.array(*map(F.lit, KINDS))
    said = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [_count(F.col("own"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    more = F.size(spans) - F.size("own")
    return out.select("doc_id", *counts, "base_sha256", said.alias("spans"), _count(spans, 4).alias("n_secret"), more.cast("long").alias("n_added"), F.size(spans).cast("long").alias("n_found"), F.size(F.coalesce("added", F.array().cast(SPANS))).cast("long").alias("n_by_context"))
