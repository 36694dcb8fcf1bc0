"""Stored postings: texts are tokenised once, when they are indexed; queries read blocks of postings.

Texts are shuffled once, as they are; what is made of them is written by the task that makes it.  Each task deals its
documents, in the order of their lengths, into blocks of bounded size, so the documents of a block are about equally
long.  A block has one row with its documents (keys in order, sizes), and one row for each of its terms: the documents
that have it, their field-weighted counts, their places (packed as bytes), and two bounds, the largest count and the least
size.  The rows of terms are written by bucket of the term, sorted by it within a file, so a query reads the buckets of
its terms; the rows of documents are a bucket of their own.

A batch of queries is answered in two steps over what its terms select.  The first counts the documents of
each phrase and takes the bounds by phrase and block.  With the frequencies known, the bounds say what the
best document of a block can score: each query is scored in its most promising blocks first, and then
only in those that can still reach the k-th best score found there.  No block that could change
the result is left out.

New documents are further segments; a document that is superseded stays in its block and is
left out of counts and scores by its key."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions import porter
from ..sources.scratch import freed_shuffles, scratch_path, scratch_table

# BM25's constants.
K1, B = 1.2, 0.75
#: Documents and tokens of a block at most (one larger document is a block by itself), and buckets of terms.
DOCS, TOKENS, BUCKETS = 2048, 1_000_000, 16
#: The bucket of the rows of documents; bytes of a batch of texts at most (one larger text is a batch by itself).
NO_TERM, BATCH_BYTES = -1, 16 << 20
#: Rows that are sent to every executor at most; queries answered together; blocks in which a query is scored first.
SMALL, QUERIES, FIRST = 500_000, 20_000, 16
#: What the packed columns hold.
STORED_AS = {"docs": np.uint16, "f": np.float64, "counts": np.int32, "places": np.uint32}
#: A place is a field's number and a position in it; with its document before it, it is a code.
FIELD_BITS, PLACE_BITS = 29, 32


@lru_cache(1 << 18)
def _stem(word: str) -> str:
    return porter.stem(porter.fold(word))


def _stemmed_lists(lists: pa.Array) -> pa.Array:
    """Each list's words stemmed, every distinct word of the batch once."""
    words = lists.flatten().dictionary_encode()
    terms = pa.array([_stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), terms)


def stemmed_lists(words: Column) -> Column:
    return arrow_udf(_stemmed_lists, "array<string>")(words)


# --------------------------------------------------------------------------- writing


def _block(block: int, keys: pa.Array, fields: list[pa.Array], weights: list[float]) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its documents (without a term), and its terms."""
    order = pc.sort_indices(keys)
    rank = np.empty(len(keys), np.int64)
    rank[np.asarray(order)] = np.arange(len(keys))
    docs, places, value, terms = [], [], [], []
    sizes = np.zeros(len(keys), np.int64)
    for f, lists in enumerate(fields):
        n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        sizes[rank] += n
        docs.append(np.repeat(rank.astype(np.int32), n))
        places.append(((f << FIELD_BITS) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint32))
        value.append(np.full(n.sum(), weights[f]))
        terms.append(lists.flatten())
    names = ["block", "term", "docs", "f", "counts", "places", "most", "least", "keys", "sizes"]
    none = lambda n, kind: pa.nulls(n, kind)

    def packed(x: np.ndarray, n: np.ndarray) -> pa.Array:
        """The numbers of each row as bytes: no engine between here and a query looks into them."""
        at = np.concatenate(([0], np.cumsum(n))) * x.itemsize
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])

    one = pa.array([0, len(keys)], pa.int32())
    raw, longs = pa.binary(), pa.list_(pa.int64())
    own = [pa.array([block]), none(1, pa.string()), *(none(1, raw) for _ in range(4)), none(1, pa.float64()), none(1, pa.int64()), pa.ListArray.from_arrays(one, keys.take(order)), pa.ListArray.from_arrays(one, pa.array(sizes))]
    yield pa.RecordBatch.from_arrays(own, names)
    said = pa.concat_arrays(terms).dictionary_encode()
    if not len(said):
        return
    by_name = pc.sort_indices(said.dictionary)
    place_of = np.empty(len(by_name), np.int64)
    place_of[np.asarray(by_name)] = np.arange(len(by_name))
    code, doc, place, value = place_of[np.asarray(said.indices)], np.concatenate(docs), np.concatenate(places), np.concatenate(value)
    at = np.argsort(code * len(keys) + doc, kind="stable")  # the places of a document are in order as they come
    code, doc, place, value = code[at], doc[at], place[at], value[at]
    first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))))  # of a term's document
    f, counts = np.add.reduceat(value, first), np.diff(np.append(first, len(code)))
    begin = np.flatnonzero(np.concatenate(([True], code[first][1:] != code[first][:-1])))  # of a term
    n_docs, n_places = np.diff(np.append(begin, len(first))), np.add.reduceat(counts, begin)
    most, least = np.maximum.reduceat(f, begin), np.minimum.reduceat(sizes[doc[first]], begin)
    n = len(begin)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block)), said.dictionary.take(by_name), packed(doc[first].astype(np.uint16), n_docs), packed(f, n_docs), packed(counts.astype(np.int32), n_docs), packed(place, n_places), pa.array(most), pa.array(least), none(n, pa.list_(keys.type)), none(n, longs)], names,
    )


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While a plan runs, its batches for Python are bounded by their bytes too: texts in the order of their lengths
    make batches of nothing but long ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write(rows: DataFrame, key: str, fields: list[str], stem: bool, path: str, weights: dict[str, float] | None = None) -> int:
    """Indexes rows (key, one column a field, eight at most) as a new segment at ``path``; returns the number of rows.
    Keys are distinct; null texts have no words."""
    from .lexical import PLAIN, TOKEN, WEIGHTS

    weigh = [(weights or WEIGHTS)[f] for f in fields]
    names = [f"w{i}" for i in range(len(fields))]
    texts = [F.coalesce(F.col(f), F.lit("")).alias(n) for f, n in zip(fields, names, strict=True)]
    dealt = rows.select(F.col(key).alias("key"), *texts).withColumn("size", sum((F.length(n) for n in names), F.lit(0))).repartition("key").sortWithinPartitions("size", "key")
    found = [F.regexp_extract_all(F.lower(n), F.lit(TOKEN if stem else PLAIN)).alias(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, docs, tokens = TaskContext.get().partitionId() << 24, [], 0, 0

        def full() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from _block(block, t.column("key").chunk(0), [t.column(n).chunk(0) for n in names], weigh)

        for batch in batches:
            lists = [_stemmed_lists(batch.column(n)) if stem else batch.column(n) for n in names]
            batch = pa.RecordBatch.from_arrays([batch.column("key"), *lists], ["key", *names])
            size = np.cumsum(sum(np.asarray(pc.list_value_length(x)).astype(np.int64) for x in lists))
            at = 0
            while at < batch.num_rows:
                base = size[at - 1] if at else 0
                end = min(batch.num_rows, at + DOCS - docs, int(np.searchsorted(size, base + TOKENS - tokens, "right")))
                if end <= at and not docs:
                    end = at + 1
                if end > at:
                    held.append(batch.slice(at, end - at))
                    docs, tokens = docs + end - at, tokens + int(size[end - 1] - base)
                    at = end
                if at < batch.num_rows or docs >= DOCS:
                    yield from full()
                    block, held, docs, tokens = block + 1, [], 0, 0
        if docs:
            yield from full()

    kind = dict(dealt.dtypes)["key"]
    bucket = F.when(F.col("term").isNull(), NO_TERM).otherwise(bucket_of(F.col("term")))
    blocks = dealt.select("key", *found).mapInArrow(run, f"{POSTINGS}, keys array<{kind}>, sizes array<long>").withColumn("bucket", bucket)
    spark = rows.sparkSession
    with _small_batches(spark), freed_shuffles(spark):
        blocks.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(path, compression="zstd")
    return _docs(spark, path, kind).agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]


POSTINGS = "block long, term string, docs binary, f binary, counts binary, places binary, most double, least long"


def _docs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"block long, keys array<{kind}>, sizes array<long>, bucket int").parquet(path).where(F.col("bucket") == NO_TERM).drop("bucket")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


# --------------------------------------------------------------------------- reading


def _numbers(col: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a packed column, and where each row begins."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64) // np.dtype(kind).itemsize
    parts = [_bytes(c) for c in col.chunks]
    return np.frombuffer(b"".join(parts) if len(parts) != 1 else parts[0], kind), np.concatenate(([0], np.cumsum(sizes)))


def _bytes(col: pa.Array) -> memoryview | bytes:
    _, offsets, data = col.buffers()
    if data is None or not len(col):
        return b""
    wide = pa.types.is_large_binary(col.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    return memoryview(data)[int(at[0]) : int(at[-1])]


class Held:
    """What a block has of the terms that a batch of queries selects."""

    def __init__(self, terms: pa.Table, dead: list[int] | None, n_docs: int, weights: list[float]):
        terms = terms.sort_by("term") if terms.num_rows else terms
        self.terms = terms.column("term").to_pylist()
        self.rows = {c: _numbers(terms.column(c), kind) for c, kind in STORED_AS.items()}
        self.weights, self.n_docs = np.array(weights), n_docs
        self.live = np.ones(n_docs, bool)
        self.live[dead or []] = False
        self.bound = list(zip(terms.column("most").to_pylist(), terms.column("least").to_pylist(), strict=True))

    def span(self, term: str, prefix: bool) -> range:
        low = bisect_left(self.terms, term)
        high = low
        while high < len(self.terms) and (self.terms[high].startswith(term) if prefix else self.terms[high] == term):
            high += 1
        return range(low, high)

    def _of(self, column: str, i: int) -> np.ndarray:
        x, at = self.rows[column]
        return x[at[i] : at[i + 1]]

    def find(self, terms: list[str], prefix: bool) -> tuple[np.ndarray, np.ndarray, float, int]:
        """Documents of a phrase, its weight in each, and the bounds of both (an upper one of the weight,
        a lower one of the sizes)."""
        spans = [self.span(t, prefix and j == len(terms) - 1) for j, t in enumerate(terms)]
        if not all(spans):
            return np.zeros(0, np.int64), np.zeros(0), 0.0, 0
        if len(terms) == 1:
            f = np.zeros(self.n_docs)
            for i in spans[0]:
                f[self._of("docs", i)] += self._of("f", i)
        else:
            codes = [np.concatenate([(np.repeat(self._of("docs", i).astype(np.int64), self._of("counts", i)) << PLACE_BITS) + self._of("places", i) for i in s]) for s in spans]
            at = codes[0]
            for j, c in enumerate(codes[1:], 1):
                at = at[np.isin(at + j, c)]
            f = np.bincount(at >> PLACE_BITS, self.weights[(at >> FIELD_BITS) & 7], self.n_docs)
        docs = np.flatnonzero((f > 0) & self.live)
        own = [self.bound[i] for i in spans[0]]
        return docs, f[docs], sum(m for m, _ in own), min(x for _, x in own)


@dataclass
class Stored:
    """Stored postings of one or more segments.  docs: (block, keys, sizes, dead); postings: (block, bucket,
    term, ..).  name: what the key is called in results."""

    docs: DataFrame
    postings: DataFrame
    stem: bool
    name: str = "key"
    weights: list[float] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, kind: str, stem: bool, segments: list[tuple[str, DataFrame | None]], name: str = "key", weights: list[float] | None = None) -> Stored:
        """segments: (path, keys (key) that are gone)."""
        from .lexical import WEIGHTS

        docs, terms = [], []
        for i, (path, gone) in enumerate(segments):
            here = F.col("block") + (i << 48)
            d = _docs(spark, path, kind).withColumn("block", here)
            dead = F.array().cast("array<int>")
            if gone is not None:
                lost = d.select("block", F.posexplode("keys").alias("doc", "key")).join(gone, "key", "left_semi").groupBy("block").agg(F.collect_list("doc").cast("array<int>").alias("dead"))  # of a block's documents
                d = d.join(lost, "block", "left")
                dead = F.coalesce("dead", dead)
            docs.append(d.select("block", "keys", "sizes", dead.alias("dead")))
            terms.append(spark.read.schema(f"{POSTINGS}, bucket int").parquet(path).where(F.col("bucket") != NO_TERM).withColumn("block", here))
        return cls(reduce(DataFrame.unionByName, docs), reduce(DataFrame.unionByName, terms), stem, name, weights or list(WEIGHTS.values()))

    def totals(self) -> tuple[int, float]:
        """Number and mean size of the live documents."""
        add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
        size = add("sizes") - add(F.transform("dead", lambda d: F.get("sizes", d)))
        n, total = self.docs.agg(F.sum(F.size("keys") - F.size("dead")), F.sum(size)).first()
        return n or 0, (total or 0) / n if n else 0.0

    def _selected(self, phrases: list[tuple[tuple, bool]]) -> DataFrame:
        """The postings that the phrases read."""
        spark = self.docs.sparkSession
        begun = sorted({t[-1] for t, prefix in phrases if prefix})
        exact = {w for t, prefix in phrases for w in (t[:-1] if prefix else t)}
        terms = spark.createDataFrame([(t,) for t in sorted(exact)], "term string")
        if begun:
            lengths = sorted({len(p) for p in begun})
            cut = F.array(*(F.when(F.length("term") >= n, F.substring("term", 1, n)) for n in lengths))
            meant = self.postings.select("term", F.explode(F.array_compact(cut)).alias("p")).join(F.broadcast(spark.createDataFrame([(p,) for p in begun], "p string")), "p", "left_semi")
            terms = scratch_table(terms.union(meant.select("term")).distinct(), "terms")
        buckets = [r[0] for r in terms.select(bucket_of(F.col("term"))).distinct().collect()]
        small = len(exact) <= SMALL if not begun else terms.count() <= SMALL
        rows = self.postings.where(F.col("bucket").isin(buckets)).drop("bucket")
        if all(len(t) == 1 for t, _ in phrases):  # places are read for phrases of several words alone
            rows = rows.withColumns({"counts": F.lit(None).cast("binary"), "places": F.lit(None).cast("binary")})
        return rows.join(F.broadcast(terms) if small else terms, "term", "left_semi")

    def _batches(self, phrases: DataFrame) -> Iterator[tuple[list[tuple[tuple, bool]], dict]]:
        """Distinct phrases, and the phrases of each query by number, for ``QUERIES`` queries at a time."""
        parts = max(1, -(-phrases.select("qid").distinct().count() // QUERIES))
        for part in range(parts):
            here = phrases if parts == 1 else phrases.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
            number: dict[tuple[tuple, bool], int] = {}
            asked: dict = {}
            for r in here.select("qid", "i", "term", "prefix", "rest").collect():  # the terms of some 20,000 queries
                asked.setdefault(r["qid"], []).append((r["i"], number.setdefault(((r["term"], *r["rest"]), r["prefix"]), len(number))))
            yield list(number), {q: sorted(x) for q, x in asked.items()}

    def _matched(self, phrases: list) -> tuple[DataFrame, DataFrame]:
        """The postings that the phrases read, written; and (pid, block, n, most, least) of them."""
        matched = scratch_table(self._selected(phrases), "matched")
        sent = self.docs.sparkSession.sparkContext.broadcast((phrases, self.weights))

        def count(terms: pa.Table, docs: pa.Table) -> pa.Table:
            said, weights = sent.value
            out = []
            if terms.num_rows:
                block = terms.column("block")[0].as_py()
                held = Held(terms, docs.column("dead")[0].as_py(), docs.column("n")[0].as_py(), weights)
                for pid, (words, prefix) in enumerate(said):
                    found, _, most, least = held.find(words, prefix)
                    if len(found):
                        out.append((pid, block, len(found), most, least))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["pid", "block", "n", "most", "least"])

        docs = self.docs.select("block", "dead", F.size("keys").alias("n"))
        stats = _by_block(matched, docs).applyInArrow(count, "pid int, block long, n long, most double, least long")
        return matched, scratch_table(stats, "stats")

    def phrase_hits(self, phrases: DataFrame) -> DataFrame:
        """(qid, i, key, f) of every phrase: the documents that have it, and its weight there."""
        kind, key = dict(self.docs.dtypes)["keys"][6:-1], self.name
        out = []
        for said, asked in self._batches(phrases):
            matched = self._selected(said)
            sent = self.docs.sparkSession.sparkContext.broadcast((said, self.weights))

            def found(terms: pa.Table, docs: pa.Table) -> pa.Table:
                said, weights = sent.value
                keys = docs.column("keys").combine_chunks().flatten()
                held = Held(terms, docs.column("dead")[0].as_py(), len(keys), weights) if terms.num_rows else None
                got = [(pid, *held.find(words, prefix)[:2]) for pid, (words, prefix) in enumerate(said)] if held else []
                where = np.concatenate([d for _, d, _ in got]) if got else np.zeros(0, np.int64)
                pids = np.repeat([p for p, _, _ in got], [len(d) for _, d, _ in got]) if got else np.zeros(0)
                return pa.table([pa.array(pids.astype(np.int32)), keys.take(pa.array(where)), pa.array(np.concatenate([f for _, _, f in got]) if got else np.zeros(0))], ["pid", key, "f"])

            hits = _by_block(matched, self.docs).applyInArrow(found, f"pid int, `{key}` {kind}, f double")
            each = self._frame([(q, i, p) for q, x in asked.items() for i, p in x], phrases, "i int, pid int")
            out.append(hits.join(F.broadcast(each), "pid").select("qid", "i", self.name, "f"))
        return reduce(DataFrame.unionByName, out)

    def _frame(self, rows: list, phrases: DataFrame, more: str) -> DataFrame:
        return self.docs.sparkSession.createDataFrame(rows, f"qid {dict(phrases.dtypes)['qid']}, {more}")

    def bm25(self, phrases: DataFrame, limit: int | None = 100, digits: int | None = None) -> DataFrame:
        """(qid, key, score, place): the best of each query of phrases (qid, i, term, prefix, rest)."""
        spark, kind, key = self.docs.sparkSession, dict(self.docs.dtypes)["keys"][6:-1], self.name
        total, mean = self.totals()
        out = []
        for said, asked in self._batches(phrases):
            matched, stats = self._matched(said)
            seen = {r["pid"]: r["n"] for r in stats.groupBy("pid").agg(F.sum("n").alias("n")).collect()}  # one number a phrase
            idf = [max(float(np.log((total - seen[p] + 0.5) / (seen[p] + 0.5))), 0.0) or 1e-6 if p in seen else 0.0 for p in range(len(said))]
            each = [(q, p, idf[p]) for q, x in asked.items() for _, p in x]
            terms = self._frame(each, phrases, "pid int, idf double")
            best = F.col("idf") * F.col("most") * (K1 + 1) / (F.col("most") + K1 * (1 - B + B * F.col("least") / F.lit(mean or 1.0)))
            bounds = stats.join(F.broadcast(terms) if len(each) <= SMALL else terms, "pid").groupBy("qid", "block").agg(F.sum(best).alias("bound"))
            bounds = bounds.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "block")))
            bounds = scratch_table(bounds, "bounds")
            sent = spark.sparkContext.broadcast((said, self.weights, idf, {q: [p for _, p in x] for q, x in asked.items()}))

            def score(terms: pa.Table, docs: pa.Table) -> pa.Table:
                said, weights, idf, asked = sent.value
                keys, sizes = docs.column("keys").combine_chunks().flatten(), docs.column("sizes").combine_chunks().flatten().to_numpy()
                held = Held(terms, docs.column("dead")[0].as_py(), len(keys), weights) if terms.num_rows else None
                parts, qids, where, scores = {}, [], [], []
                for q in sorted(docs.column("asked")[0].as_py()) if held else []:
                    sums, hit = np.zeros(len(keys)), np.zeros(len(keys), bool)
                    for p in asked[q]:
                        if p not in parts:
                            d, f, _, _ = held.find(*said[p])
                            parts[p] = d, idf[p] * f * (K1 + 1) / (f + K1 * (1 - B + B * sizes[d] / (mean or 1.0)))
                        d, part = parts[p]
                        sums[d] += part
                        hit[d] = True
                    d = np.flatnonzero(hit)
                    if limit is not None and len(d) > limit:
                        s = sums[d] if digits is None else np.round(sums[d], digits)
                        least = -np.partition(-s, limit - 1)[limit - 1] - (10.0**-digits if digits is not None else 0)
                        d = d[s >= least]
                    qids.append(pa.array([q] * len(d)))
                    where.append(d)
                    scores.append(sums[d])
                if not where:
                    return pa.table([pa.array([], docs.column("asked").type.value_type), keys[:0], pa.array([], pa.float64())], ["qid", key, "score"])
                return pa.table([pa.concat_arrays([x.cast(docs.column("asked").type.value_type) for x in qids]), keys.take(pa.array(np.concatenate(where))), pa.array(np.concatenate(scores))], ["qid", key, "score"])

            def scored(pairs: DataFrame, matched=matched, score=score) -> DataFrame:
                held = self.docs.join(pairs.groupBy("block").agg(F.collect_list("qid").alias("asked")), "block")
                rows = matched.join(pairs.select("block").distinct(), "block", "left_semi")
                return _by_block(rows, held).applyInArrow(score, f"qid {dict(phrases.dtypes)['qid']}, `{key}` {kind}, score double")

            rest = None if limit is None else bounds.where(F.col("rank") > FIRST)
            if rest is None or rest.isEmpty():
                out.append(scored(bounds))
                continue
            first = scratch_table(scored(bounds.where(F.col("rank") <= FIRST)), "first")
            order = Window.partitionBy("qid").orderBy(F.desc("score"))
            reached = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == limit).select("qid", F.col("score").alias("reached"))
            slack = 1e-9 if digits is None else 10.0**-digits
            able = rest.join(reached, "qid", "left").where(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - slack))
            out.append(first.unionByName(scored(able.select("qid", "block"))))
        rows = reduce(DataFrame.unionByName, out)
        rows = rows if digits is None else rows.withColumn("score", F.round("score", digits))
        ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key)))
        return ranked if limit is None else ranked.where(F.col("place") <= limit)


def _by_block(rows: DataFrame, docs: DataFrame):
    """Both by block, over as many tasks as a shuffle has: what a batch selects is small, its work isn't."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "block").groupBy("block").cogroup(docs.repartition(n, "block").groupBy("block"))


def indexed(rows: DataFrame, key: str, fields: list[str], stem: bool = False, path: str | None = None) -> Stored:
    """Rows indexed in a folder (a scratch one by default)."""
    from .lexical import WEIGHTS

    spark = rows.sparkSession
    path = path or scratch_path(spark, "postings")
    write(rows, key, fields, stem, path)
    return Stored.open(spark, dict(rows.dtypes)[key], stem, [(path, None)], key, [WEIGHTS[f] for f in fields])
