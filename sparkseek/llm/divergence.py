"""Source divergence audit: how far the term distributions of a language's sources lie apart.

Terms are runs of ASCII letters and of characters outside ASCII, A-Z lower-cased.  Each language keeps the
V terms that at least ``LEAST`` of its documents have.  A (lang, source) group with N kept occurrences
gives each kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and so does the language with its own
counts; f(p, q) = floor((p - q)^2 / (p + q)).

1. Each task counts terms by group and adds up what it has before anything is shuffled; one shuffle by
   (lang, term) adds the rest up and drops what too few documents have.
2. The kept terms of a language are dealt by hash into blocks of about ``TERMS`` (fewer where there are
   many groups).  A task holds a block as one dense int64 matrix, group by term, takes f of all pairs of
   groups by broadcasting, ``CELLS`` at a time, and hands on the block's matrix of pair sums and, for each
   group, a heap of its ``TOP`` terms above the language's share.
3. Pair sums are added up over the blocks, heaps are merged by rank.

All arithmetic is on integers: the division by N + 2 V goes in three steps of a factor of 1000, which no
sum of counts below 9 * 10^15 overflows.  Memory in a task is a block's matrix and ``CELLS`` numbers, at any number of
documents; the result itself has a row for each pair of a language's groups.

Defined results.  Null text, lang and source count as ''.  Repeated rows are separate documents.  Every
occurring group has its row for each other source of its language, also without a term (0 if V = 0).  A source that is alone
in its language has no pair.  Ties go by the item's UTF-8 bytes.  An empty table gives an empty
result.  Extra columns are ignored."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, plain

LEAST, TOP, UNIT_STEPS = 10, 10, 3
#: Terms of a block, numbers of a temporary matrix, numbers of a block's matrix, entries of a task's table of counts, languages that are sent.
TERMS, CELLS, MATRIX, HELD, LANGS = 1024, 1 << 20, 1 << 22, 200_000, 100_000
TERM = re.compile(rb"[a-z\x80-\xff]+")


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term, task by task; each group
    also has a row without a term.  docs: (lang, source, text), none null."""
    names = ["lang", "source", "term", "n", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in said.items():
                terms = [None, *n]
                cols = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
                text = pa.array(terms, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*cols, text, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())], names)
            said.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                n, d = said.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(TERM.findall(text.as_py().lower()))  # of bytes: A-Z alone
                size -= len(n)
                n.update(own)
                d.update(own.keys())
                size += len(n)
                if size > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(lean(run), "lang string, source string, term string, n long, d long")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total) of each row's counts."""
    total = np.maximum(total, 1)[:, None]
    whole, left = np.divmod(counts + 2, total)
    for _ in range(UNIT_STEPS):
        more, left = np.divmod(left * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pair_sums(p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(g, h, sum of f over the columns) of all pairs of rows g < h, tile by tile."""
    groups, terms = p.shape
    side = max(1, min(groups, int(CELLS**0.5) // 4))
    width = max(1, CELLS // (side * side))
    for a in range(0, groups, side):
        for b in range(a, groups, side):
            left, right = p[a : a + side], p[b : b + side]
            sums = np.zeros((len(left), len(right)), np.int64)
            for t in range(0, terms, width):
                sums += apart(left[:, None, t : t + width], right[None, :, t : t + width]).sum(2)
            g, h = np.nonzero(np.arange(a, a + len(left))[:, None] < np.arange(b, b + len(right))[None, :])
            yield g + a, h + b, sums[g, h]


def _tile(counts: pa.Table, groups: pa.Table) -> Iterator[pa.RecordBatch]:
    """One block of a language: counts (lang, block, source, term, n) and all its groups (lang, block,
    source, total, v)."""
    names = ["lang", "source", "part", "item", "value"]
    sources = sorted(groups.column("source").to_pylist())
    where = {s: i for i, s in enumerate(sources)}
    lang, v = groups.column("lang")[0].as_py(), groups.column("v")[0].as_py()
    total = np.zeros(len(sources), np.int64)
    total[[where[s] for s in groups.column("source").to_pylist()]] = groups.column("total").to_numpy()
    coded = counts.column("term").combine_chunks().dictionary_encode() if counts.num_rows else None
    terms = coded.dictionary.to_pylist() if coded is not None else []
    c = np.zeros((len(sources), len(terms)), np.int64)
    if terms:
        c[[where[s] for s in counts.column("source").to_pylist()], coded.indices.to_numpy()] = counts.column("n").to_numpy()
    p = shares(c, total + 2 * v)
    q = shares(c.sum(0)[None, :], np.array([total.sum() + 2 * v]))[0]

    def rows(source: list, part: str, item: list, value: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(item), pa.string()), pa.array(source, pa.string()), pa.array([part] * len(item), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names)

    for g, h, value in pair_sums(p):
        yield rows([sources[i] for i in g], "pair", [sources[i] for i in h], value)
    for i, source in enumerate(sources):
        above = np.flatnonzero((c[i] > 0) & (p[i] > q))
        value = apart(p[i, above], q[above])
        best = heapq.nsmallest(TOP, ((-int(x), terms[t]) for x, t in zip(value, above, strict=True)))
        yield rows([source] * len(best), "term", [t for _, t in best], [-x for x, _ in best])


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of each group from each other source
    of its language (part ``pair``), and its terms above the language's share (part ``term``)."""
    scratch = Scratch(docs.sparkSession)
    at = {c: F.col(f"c{docs.columns.index(c)}") for c in ("lang", "source", "text")}
    told = plain(docs).select(*(F.coalesce(at[c].cast("string"), F.lit("")).alias(c) for c in at))
    added = count_terms(told).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by_term = Window.partitionBy("lang", "term")
    kept = added.withColumn("all", F.sum("d").over(by_term)).where(f"term is null or all >= {LEAST}").select("lang", "source", "term", "n")
    kept = scratch.write(kept, "counts")
    groups = scratch.write(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), "groups")
    size = kept.where("term is not null").groupBy("lang", "term").agg(F.count("*").alias("k")).groupBy("lang").agg(F.count("*").alias("v"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("g")).join(size, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), "g")
    wide = F.greatest(F.lit(1), F.least(F.lit(TERMS), F.floor(F.lit(MATRIX) / F.col("g"))))
    langs = scratch.write(langs.select("lang", "v", F.greatest(F.lit(1), F.ceil(F.col("v") / wide)).cast("int").alias("blocks")), "langs")
    sent = F.broadcast(langs) if langs.count() <= LANGS else langs
    tiles = kept.where("term is not null").join(sent, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n")
    held = groups.join(sent, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "v")
    found = tiles.groupBy("lang", "block").cogroup(held.groupBy("lang", "block")).applyInArrow(lambda a, b: pa.Table.from_batches(_tile(a, b)), "lang string, source string, part string, item string, value long")
    found = scratch.write(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "found")  # a term has one block, a pair one sum a block
    half = found.where("part = 'pair'")
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = half.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.unionByName(terms)
