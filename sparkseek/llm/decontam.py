"""Benchmark decontamination by spaced seeds.

A fixed mask looks at some of a run of token positions and ignores the others, so its hash is the
same on both sides where a substituted word falls on an ignored position.  Hashes of the benchmark
are joined with those of every position of every document; each hit gives a diagonal (document
place - item place), along which the tokens are compared one by one.  A window of ``WINDOW``
tokens (of the whole item, if it is shorter) with at least ``PERCENT`` percent equal tokens is an
overlap.

The masks' positions are g apart, so masks laid at g places in a row look at disjoint positions:
g - 1 substitutions leave one of them whole.  For each length of item g is so large, and the mask
so short, that every overlap within ``PERCENT`` is hit: nothing is missed.  Insertions and
deletions are not looked for: what lies on both sides of one counts by itself.

Tokens are runs of letters, marks and digits of any script, lower-cased.  Items of fewer than
``LEAST`` tokens are no evidence and never match.

A benchmark of up to ``BLOCK_BYTES`` of text is indexed once and broadcast; no more is.  Of a larger
one the seeds are a table, joined with the documents' seeds by a shuffle, of which a bitmap of
fixed size lets only those through that the benchmark may hold.  Both ways give the same rows.

Defined results.  Null and empty texts (on either side) match nothing; an empty benchmark
matches nothing; rows with a null id are compared like others and carry the null.  Repeated
rows and items give their rows each.  Extra columns, whatever their names, are passed through by
:func:`decontaminate` and ignored by :func:`contaminated`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import U64, Held, Scratch, Tokens, letters, map_arrow, might_hold, mix, plain, powers, signed, slices
from .linededup import SEPARATORS

WINDOW, PERCENT, LEAST, BLOCK_BYTES = 20, 80, 5, 8 << 20
#: From so many tokens of an item on, its mask; 1 looks at a position, 0 ignores it.
MASKS = ((5, "101"), (6, "10101"), (8, "1010101"), (10, "1001001"), (12, "1001001001"), (15, "100010001"), (16, "1000100010001"), (20, "1000010000100001"))
MATCHES = "array<struct<item_id:long,begin:int,end:int,matched:int>>"
#: Hits that are compared at once.
TOGETHER = 1 << 14


def tokens_of(texts: pa.Array) -> Tokens:
    return Tokens.of(letters(texts), break_=SEPARATORS)


def mask_of(length: int) -> int:
    """Number of the mask for items of so many tokens."""
    return max(i for i, (n, _) in enumerate(MASKS) if n <= length)


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position where it fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    p, _ = powers(len(mask) + 1)
    out = np.zeros(n, U64)
    for j, on in enumerate(mask):
        if on == "1":
            out += h[j : j + n] * p[j + 1]
    return mix(out ^ U64(len(mask)))


def seeds_within(tokens: Tokens, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the place (among all tokens) wherever the mask fits into a row."""
    got = seeds(tokens.hashes, mask)
    at = np.arange(len(got))
    if len(at):
        at = at[at + len(mask) <= tokens.first[tokens.rows[at] + 1]]
    return got[at], at


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """The stretch of the document (begin, end, equal tokens) that the diagonal's windows
    with enough equal tokens cover."""
    size = min(WINDOW, len(item))
    lo, hi = max(0, shift), min(len(doc), shift + len(item))
    if hi - lo < size:
        return None
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    total = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(100 * (total[size:] - total[:-size]) >= PERCENT * size)
    if not len(good):
        return None
    begin, end = int(good[0]), int(good[-1]) + size
    return lo + begin, lo + end, int(total[end] - total[begin])


class SeedIndex:
    """Sorted seed hashes of a bounded set of items, and their tokens."""

    def __init__(self, ids: list, texts: list):
        self.ids = ids
        self.tokens = tokens_of(pa.array(texts, pa.string()))
        kind = np.array([mask_of(n) if n >= LEAST else -1 for n in self.tokens.counts.tolist()], np.int64)
        self.tables = []
        for i in sorted(set(kind[kind >= 0].tolist())):
            h, at = seeds_within(self.tokens, MASKS[i][1])
            own = kind[self.tokens.rows[at]] == i
            h, at = h[own], at[own]
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[h >> U64(44)] = True
            self.tables.append((MASKS[i][1], h[order], at[order], maybe))

    def hits(self, tokens: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the documents and in the items with the same hash, some at once."""
        for mask, h, place, maybe in self.tables:
            got, at = seeds_within(tokens, mask)
            some = maybe[got >> U64(44)]
            got, at = got[some], at[some]
            lo, n = np.searchsorted(h, got, "left"), np.zeros(len(got), np.int64)
            n = np.searchsorted(h, got, "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            ends = np.cumsum(n)
            for b in range(0, int(n.sum()), TOGETHER):
                which = np.arange(b, min(b + TOGETHER, int(ends[-1])))
                row = np.searchsorted(ends, which, "right")
                yield at[row], place[lo[row] + which - (ends[row] - n[row])]

    def find(self, tokens: Tokens) -> list[list[dict]]:
        """Overlaps of each row of ``tokens`` with the items."""
        found: list[np.ndarray] = []
        around = np.arange(1 - WINDOW, WINDOW + max(len(m) for _, m in MASKS))
        for doc, item in self.hits(tokens):
            row, own = tokens.rows[doc], self.tokens.rows[item]
            # enough equal tokens near the hit, before a diagonal is looked at by itself
            a, b = doc[:, None] + around, item[:, None] + around
            ok = (a >= tokens.first[row][:, None]) & (a < tokens.first[row + 1][:, None]) & (b >= self.tokens.first[own][:, None]) & (b < self.tokens.first[own + 1][:, None])
            same = tokens.hashes[np.where(ok, a, 0)] == self.tokens.hashes[np.where(ok, b, 0)]
            enough = 100 * (same & ok).sum(1) >= PERCENT * np.minimum(self.tokens.counts[own], WINDOW)
            shift = doc - tokens.first[row] - (item - self.tokens.first[own])
            found.append(np.unique(np.stack([row, own, shift], 1)[enough], axis=0))
        out: list[list[dict]] = [[] for _ in tokens.counts]
        if found:
            for row, own, shift in np.unique(np.concatenate(found), axis=0).tolist():
                doc, item = (t.hashes[t.first[i] : t.first[i + 1]] for t, i in ((tokens, row), (self.tokens, own)))
                if span := overlap(doc, item, shift):
                    out[row].append({"item_id": self.ids[own], "begin": span[0], "end": span[1], "matched": span[2]})
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def _fits(items: DataFrame) -> bool:
    """Whether all items together are small enough to be broadcast."""
    return (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BLOCK_BYTES


def _matcher(items: DataFrame):
    """UDF of the overlaps with the items, whose index is broadcast."""
    rows = items.orderBy("item_id", "text").collect()  # at most BLOCK_BYTES of text
    shared = items.sparkSession.sparkContext.broadcast(SeedIndex([r[0] for r in rows], [r[1] for r in rows]))

    @arrow_udf(MATCHES)
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for piece in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            out += shared.value.find(tokens_of(piece.column(0)))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("matched", pa.int32())]))
        return pa.array(out, kind)

    return find


def _seed_rows(rows: DataFrame, kinds: list[int], own: bool, held: Held | None = None) -> DataFrame:
    """(key, seed, at) of the texts (key, text): by each text's own mask, or by all ``kinds``."""
    shared = None if held is None else rows.sparkSession.sparkContext.broadcast(held)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = tokens_of(batch.column(1))
        keys, hashes, places = [], [], []
        kind = np.array([mask_of(n) if n >= LEAST else -1 for n in tokens.counts.tolist()], np.int64) if own else None
        for i in kinds:
            h, at = seeds_within(tokens, MASKS[i][1])
            use = kind[tokens.rows[at]] == i if own else (shared.value(h) if shared else np.ones(len(h), bool))
            row = tokens.rows[at[use]]
            keys.append(row)
            hashes.append(h[use])
            places.append(at[use] - tokens.first[row])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cat(keys, np.int64))), pa.array(signed(cat(hashes, U64))), pa.array(cat(places, np.int64))], ["key", "seed", "at"])

    return map_arrow(rows, run, "key long, seed long, at long")


def _by_tables(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, begin, end, matched) by a shuffle join of the seeds.  docs: (doc_id, text).

    Texts are known by their hash, so equal texts are searched once; two texts of one hash only
    try each other's diagonals, since every diagonal is compared."""
    scratch = Scratch(docs.sparkSession)
    keyed = docs.where("text is not null").withColumn("key", F.xxhash64("text"))
    said = scratch.write(items.select(F.xxhash64("text").alias("key"), "text").dropDuplicates(["key"]), "items")
    kinds = list(range(len(MASKS)))
    index = scratch.write(_seed_rows(said, kinds, True), "seeds")
    hits = _seed_rows(keyed.select("key", "text"), kinds, False, Held(index.select("seed"), 27))
    index = index.select("seed", F.col("key").alias("item"), F.col("at").alias("place"))
    lines = hits.join(index, "seed").groupBy("key", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    lines = scratch.write(lines, "diagonals")
    asked = lines.join(said.toDF("item", "said"), "item").groupBy("key").agg(F.collect_list(F.struct("item", "said", "shifts")).alias("asked"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, asked in zip(*(batch.column(i) for i in range(3)), strict=True):
                have = tokens_of(pa.array([text.as_py()], pa.string())).hashes
                for x in asked.as_py():
                    item = tokens_of(pa.array([x["said"]], pa.string())).hashes
                    rows += [(doc.as_py(), x["item"], *span) for s in sorted(x["shifts"]) if (span := overlap(have, item, s))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item", "begin", "end", "matched"])

    found = might_hold(keyed, "key", asked.select("key")).join(asked, "key").select("doc_id", "text", "asked").mapInArrow(compare, "doc_id long, item long, begin int, end int, matched int")
    return found.join(items.select("item_id", F.xxhash64("text").alias("item")), "item").select("doc_id", "item_id", "begin", "end", "matched")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, begin, end, matched): a row for each overlap."""
    items, rows = _items(benchmark), docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not _fits(items):
        return _by_tables(rows, items)
    return rows.select("doc_id", F.explode(_matcher(items)("text")).alias("x")).select("doc_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any overlap, with all columns."""
    items, rows = _items(benchmark), plain(docs)
    text = F.col(f"c{docs.columns.index('text')}").cast("string")
    if _fits(items):
        return rows.where(F.size(_matcher(items)(text)) == 0).toDF(*docs.columns)
    bad = _by_tables(docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), F.col("text").cast("string").alias("text")), items).select(F.col("doc_id").alias("bad")).distinct()
    return rows.join(bad, F.xxhash64(text) == F.col("bad"), "left_anti").toDF(*docs.columns)
