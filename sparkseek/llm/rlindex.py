"""Repeated byte strings by run-length indexes (the suffix-array deduplication of a corpus).

A byte goes if a string of ``LEAST`` bytes that covers it also starts in a document with a
smaller doc_id.  The work is cut up so that no index grows with the corpus:

1. Every string of ``LEAST`` bytes has a minimizer, the least hash among its ``GRAM``-byte
   substrings.  Equal strings have equal minimizers, so strings whose minimizer occurs in one
   document only are unique, and strings with different minimizers never match.
2. A segment is the text under a run of consecutive strings with one minimizer.  Segments
   whose minimizer occurs in two documents or more meet by it.
3. A task builds, for a block of such groups, a :class:`RunLengthIndex` over the distinct
   segments: the run-compressed Burrows-Wheeler transform with samples at the run ends, and
   the row intervals that share ``LEAST`` bytes with the least document of each.  Streaming a
   segment through it, one LF step a byte, gives for each of its strings the least document
   that holds it.
4. Marks return to their documents, whose bytes are then removed.

Groups of more than ``GROUP`` distinct segments (2 MB) don't go to one task: their strings are
aggregated one by one, with the same result.

Defined results.  A null text is an empty text, of no bytes and no spans.  Rows with a null
doc_id neither lose a byte nor take one from others.  Rows with the same doc_id are one document
to each other and never match among themselves.  Texts shorter than ``LEAST`` bytes lose
nothing.  Extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, free_shuffles, lean, mix, powers, prefix_hash, signed, slices, text_buffer

LEAST, GRAM, GROUP = 50, 20, 25_000
SPAN = LEAST - GRAM + 1
NEAR = (LEAST - GRAM) // 2
PLACE = 24  # bits of a place within a piece; the others order the hashes
FULL = (1 << SPAN) - 1
#: Bytes of an index: small enough for three ranks in a word, and for the cache.
BLOCK = 60_000


# --------------------------------------------------------------------------- minimizers


def minimizers(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with one minimizer: row, hash, place of the minimizer in the row, its
    distance from the run's first string, strings in the run.  len(buf) < 2^PLACE."""
    none = np.zeros(0, np.int64)
    n = len(buf) - LEAST + 1
    if n <= 0:
        return none, none.view(U64), none, none, none
    h = prefix_hash(buf)
    _, inv = powers(len(buf) + 1)
    h = mix((h[GRAM:] - h[:-GRAM]) * inv[: len(h) - GRAM])
    low = U64((1 << PLACE) - 1)
    q = (h & ~low) | np.arange(len(h), dtype=U64)
    width = 1
    while 2 * width <= SPAN:
        q = np.minimum(q[:-width], q[width:])
        width *= 2
    best = np.minimum(q[:n], q[SPAN - width :][:n])
    place = (best & low).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:n]
    at = np.flatnonzero(np.arange(n) + LEAST <= off[row + 1])
    if not len(at):
        return none, none.view(U64), none, none, none
    p, r = place[at], row[at]
    edge = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (r[1:] != r[:-1]))))
    count = np.diff(np.append(edge, len(at)))
    return r[edge], h[p[edge]], p[edge] - off[r[edge]], p[edge] - at[edge], count


def runs_of(col: pa.Array) -> tuple[np.ndarray, ...]:
    """:func:`minimizers` of a column; a very long text goes in pieces that overlap by
    ``LEAST`` - 1 bytes."""
    buf, off = text_buffer(col)
    piece = 1 << 22
    if len(buf) <= 2 * piece:
        return minimizers(buf, off)
    parts = []
    for i in range(len(off) - 1):
        for b in range(int(off[i]), max(int(off[i]) + 1, int(off[i + 1]) - LEAST + 1), piece):
            part = buf[b : min(int(off[i + 1]), b + piece + LEAST - 1)]
            row, h, p, a, c = minimizers(part, np.array([0, len(part)]))
            parts.append((row + i, h, p + b - off[i], a, c))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# --------------------------------------------------------------------------- index


def ranks_of(parts: list[np.ndarray], bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the places by their parts (ties by place), and each place's rank from 1 (equal
    parts: equal ranks).  Each part has at most ``bits`` bits; ``bits`` times the parts plus
    the bits of n are 64 at most, so places and keys are sorted in one word."""
    own = U64(n.bit_length())
    key = np.zeros(n, U64)
    for part in parts:
        key = (key << U64(bits)) | part.astype(U64)
    packed = np.sort((key << own) | np.arange(n, dtype=U64))
    order = (packed & U64((1 << int(own)) - 1)).astype(np.int32)
    packed >>= own
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return order, rank


class RunLengthIndex:
    """Run-compressed BWT of a collection of distinct short texts (2^21 bytes at most).

    Texts end in terminators that sort by text and before all bytes.  Kept are, by run of
    the transform: its symbol, its first row, the row that one maps to (so an LF step is a search among
    the runs, without a rank structure), and the text position at its last row (the sample).  Row intervals whose suffixes share ``least`` bytes are kept as runs
    too, each with its least document."""

    def __init__(self, texts: list[bytes], docs: np.ndarray, least: int = LEAST):
        self.sizes = np.array([len(t) for t in texts], np.int32)
        self.least = least
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        ends = np.cumsum(self.sizes + 1) - 1
        n = len(joined)
        of = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes + 1)
        rest = (ends[of] - np.arange(n)).astype(np.int32)  # bytes up to the terminator
        code = joined.astype(np.uint16) + np.uint16(1)
        code[ends] = 0
        bits, own = (8 if joined.max() < 255 else 9), n.bit_length()
        depth = (64 - own) // bits
        later = lambda x, k: np.where(rest > k, np.concatenate((x[k:], x[:k])), 0) if k else x
        held: dict[int, np.ndarray] = {}
        order, rank = ranks_of([later(code, j) for j in range(depth)], bits, n)
        longest = int(self.sizes.max(initial=0))
        while depth < longest:
            held[depth] = rank
            times = (64 - own) // own
            order, rank = ranks_of([later(rank, depth * j) for j in range(times)], own, n)
            depth *= times
        held[depth] = rank
        # rows that share ``least`` bytes with the row before: overlapping equal parts
        part = max(d for d in held if d <= least)
        long = rest[order] >= least
        same = np.zeros(n, bool)
        same[1:] = long[1:] & long[:-1]
        for shift in [*range(0, least - part, part), least - part]:
            r = held[part][np.minimum(order + shift, n - 1)]
            same[1:] &= r[1:] == r[:-1]
        self.block_start = np.flatnonzero(~same).astype(np.int32)
        self.block_doc = np.minimum.reduceat(docs[of[order]], self.block_start)
        before = code[order - 1]
        before[rest[order] == self.sizes[of[order]]] = 0
        self.start = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1]))).astype(np.int32)
        self.symbol, self.rows = before[self.start], n
        self.bound = np.append(self.start[1:], np.int32(n))
        length = self.bound - self.start
        self.sample = order[self.bound - 1]
        by = np.argsort(self.symbol, kind="stable")  # runs by symbol, then row: their images in order
        self.image = np.empty(len(by), np.int32)
        self.image[by] = np.concatenate(([0], np.cumsum(length[by])[:-1]))

    def step(self, row: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """LF: the row of the suffix one byte longer, and its run."""
        new = self.image[run] + row - self.start[run]
        return new, self.run_of(new)

    def run_of(self, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, row, "right") - 1

    def least_documents(self) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Streams all texts through the index from their ends: for each length of suffix
        from ``least`` on, the texts, the length, and the least document that holds the
        suffix's first ``least`` bytes."""
        text = np.arange(len(self.sizes), dtype=np.int32)
        row = text.copy()  # terminators come first, in order
        run = self.run_of(row)
        for size in range(1, int(self.sizes.max(initial=0)) + 1):
            go = self.sizes[text] >= size
            if not go.all():
                text, row, run = text[go], row[go], run[go]
            row, run = self.step(row, run)
            if size >= self.least:
                block = np.searchsorted(self.block_start, row, "right") - 1
                yield text, size, self.block_doc[block]


def masks(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each text the set of its strings (bit i: the one that starts at byte i) that a text
    of a smaller document holds."""
    out = np.zeros(len(texts), np.int64)
    if not texts:
        return out
    index = RunLengthIndex(texts, docs)
    for text, size, least in index.least_documents():
        hit = text[least < docs[text]]
        out[hit] |= np.int64(1) << (index.sizes[hit] - size)
    return out


# --------------------------------------------------------------------------- operator


def _occurrences(docs: DataFrame) -> DataFrame:
    """(h, doc, at) of every run of every document; at packs place, distance and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            done = 0
            for piece in slices(batch, "text", 1 << 20):
                row, h, p, a, c = runs_of(piece.column(1))
                at = (p << 12) | (a << 6) | c
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(ids[row + done]), pa.array(at)], ["h", "doc", "at"])
                done += piece.num_rows

    return docs.select("doc", "text").mapInArrow(lean(run), "h long, doc long, at long")


def _segments(docs: DataFrame) -> DataFrame:
    """(h, seg, doc, th, begin, n, a) of the shared runs.  docs: (doc, th, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 21):
                buf, off = text_buffer(piece.column(2))
                raw = buf.tobytes()
                lists = piece.column(3)
                per = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                at, h = np.asarray(flat.field(1)), flat.field(0)
                row = np.repeat(np.arange(len(per)), per)
                begin, count = (at >> 12) - ((at >> 6) & 63), at & 63
                b = off[row] + begin
                e = b + count + LEAST - 1
                fits = e <= off[row + 1]  # always, unless rows with different texts share a doc_id
                segs = pa.array([raw[x:y] for x, y in zip(b.tolist(), e.tolist(), strict=True)], pa.binary())
                take = pa.array(row)
                out = pa.RecordBatch.from_arrays([h, segs, piece.column(0).take(take), piece.column(1).take(take), pa.array(begin), pa.array(count), pa.array((at >> 6) & 63)], ["h", "seg", "doc", "th", "begin", "n", "a"])
                yield out if fits.all() else out.filter(pa.array(fits))

    return docs.select("doc", "th", "text", "runs").mapInArrow(lean(run), "h long, seg binary, doc long, th long, begin long, n long, a long")


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, s, doc, seg, a) sorted by h -> (h, s, first, mask) of each distinct segment, by
    indexes over blocks of whole groups."""
    block: list[tuple[int, int, bytes, int]] = []
    alone: list[tuple[int, int, bytes, int]] = []
    size, now, group = 0, None, {}

    def close() -> int:
        """The group's segments go to the block; those which can't share a string with
        another one (its minimizer with ``NEAR`` more bytes on one side at least) aside."""
        if len(group) == 1:
            alone.extend((now, k, t, d) for k, (t, d, _) in group.items())
            return 0
        sides = {k: (t[a - NEAR : a + GRAM] if a >= NEAR else None, t[a : a + GRAM + NEAR] if len(t) >= a + GRAM + NEAR else None) for k, (t, _, a) in group.items()}
        left, right = Counter(x for x, _ in sides.values() if x), Counter(x for _, x in sides.values() if x)
        added = 0
        for k, (t, d, _) in group.items():
            x, y = sides[k]
            if left[x] > 1 or right[y] > 1:
                block.append((now, k, t, d))
                added += len(t) + 1
            else:
                alone.append((now, k, t, d))
        return added

    def spill() -> pa.RecordBatch:
        rows = block + alone
        docs = np.array([x[3] for x in rows], np.int64)
        got = np.zeros(len(rows), np.int64)
        got[: len(block)] = masks([x[2] for x in block], docs[: len(block)])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array(docs), pa.array(got)], ["h", "s", "first", "mask"])

    for batch in batches:
        for h, s, doc, seg, a in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if h != now:
                size += close()
                now, group = h, {}
                if size > BLOCK or len(alone) > 10_000:
                    yield spill()
                    block.clear()
                    alone.clear()
                    size = 0
            known = group.get(s)
            if known is None or doc < known[1]:
                group[s] = (seg, doc, a)
    close()
    if block or alone:
        yield spill()


def _one_by_one(segments: DataFrame) -> DataFrame:
    """(h, s, first, mask) as :func:`_index` gives it, for groups too large for a task."""
    distinct = segments.groupBy("h", "s", "seg", "n").agg(F.min("doc").alias("first"))
    each = distinct.select("h", "s", "first", "seg", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i")).withColumn("w", F.expr(f"substring(seg, i + 1, {LEAST})"))
    least = each.groupBy("h", "w").agg(F.min("first").alias("least"))
    held = each.join(least, ["h", "w"])
    return held.groupBy("h", "s").agg(F.first("first").alias("first"), F.sum(F.when(F.col("least") < F.col("first"), F.expr("shiftleft(1L, i)")).otherwise(F.lit(0).cast("long"))).alias("mask"))


def _removed(text: bytes, begin: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes the marked strings cover."""
    hit, bit = np.nonzero((mask[:, None] >> np.arange(SPAN)) & 1)
    change = np.zeros(len(text) + 1, np.int32)
    starts = np.unique(begin[hit] + bit)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + LEAST, -1)
    return np.cumsum(change)[:-1] > 0


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text", 1 << 21):
            out = []
            for text, marks in zip(piece.column(1), piece.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                if not marks.is_valid or not len(marks.values):
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                gone = _removed(raw, np.asarray(marks.values.field(0)), np.asarray(marks.values.field(1)))
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
            cols = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([piece.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def marks(scratch: Scratch, docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc, th, marks): for each document the places and sets of its strings that start in a
    smaller one.  docs: (doc, th, text)."""
    spark = docs.sparkSession

    def shared_runs() -> DataFrame:
        both = "over (partition by h)"
        shared = _occurrences(docs).select("h", "doc", "at", F.expr(f"min(doc) {both}").alias("lo"), F.expr(f"max(doc) {both}").alias("hi")).where("lo < hi")
        return scratch.write(shared.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("runs")), "runs")

    def indexed(segments: DataFrame) -> DataFrame:
        many = segments.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > group).select("h")
        large = segments.select("h", "s").join(many, "h").groupBy("h").agg(F.countDistinct("s").alias("k")).where(F.col("k") > group).select("h")
        large = scratch.write(large, "large")
        small = segments
        if not large.isEmpty():
            small = segments.join(large, "h", "left_anti")
        found = small.select("h", "s", "doc", "seg", "a").repartition("h").sortWithinPartitions("h").mapInArrow(lean(_index), "h long, s long, first long, mask long")
        if small is not segments:
            found = found.unionByName(_one_by_one(segments.join(large, "h", "left_semi")))
        return scratch.write(found, "found")

    def by_document(segments: DataFrame, found: DataFrame) -> DataFrame:
        mask = F.when(F.col("doc") > F.col("first"), F.expr("shiftleft(1L, cast(n as int)) - 1")).otherwise(F.col("mask"))
        held = segments.select("h", "s", "doc", "th", "begin", "n").join(found, ["h", "s"]).select("doc", "th", "begin", mask.alias("mask")).where("mask <> 0")
        return scratch.write(held.groupBy("doc", "th").agg(F.collect_list(F.struct("begin", "mask")).alias("marks")), "marks")

    # each step's plan goes out of scope with its function, so its shuffle files can go too
    runs = shared_runs()
    free_shuffles(spark)
    segments = scratch.write(_segments(docs.join(runs, "doc")).withColumn("s", F.xxhash64("seg", F.length("seg"))), "segments", "zstd")
    scratch.drop("runs")
    free_shuffles(spark)
    found = indexed(segments)
    free_shuffles(spark)
    out = by_document(segments, found)
    scratch.drop("segments", "found", "large")
    free_shuffles(spark)
    return out


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("th", F.xxhash64("text"))
    found = marks(scratch, keyed.where(F.col("doc").isNotNull() & (F.octet_length("text") >= LEAST)), group)
    return keyed.join(found, ["doc", "th"], "left").select("doc", "text", "marks").mapInArrow(lean(_finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
