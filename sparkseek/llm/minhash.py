"""Near-duplicate documents: SuperMinHash signatures, banding, verification on the full
shingle sets, union-find groups.

Defined results.  Words are runs of bytes other than the six ASCII blanks, with A-Z
lower-cased; a document's set holds its distinct 5-word shingles.  A text of one to four
words has its whole sequence as its one shingle.  A null, empty or blank text has an empty
set and is linked with nothing.  Rows with a null doc_id are returned unlinked, with a null
component and kept.  Rows that share a doc_id are one node: they get one component, and all
of them are kept if it is theirs.  Extra columns are ignored by :func:`near_duplicates` and
passed through by :func:`deduplicate`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import link_buckets
from .common import U64, Scratch, Tokens, list_array, map_arrow, might_hold, mix, plain, shingle_sets, signed

SLOTS, BANDS, WIDTH, PERCENT = 200, 40, 5, 75
#: Words of a set's parity sketch.
MARKS = 32


def superminhash(elements: np.ndarray, counts: np.ndarray, slots: int = SLOTS, together: int = 1 << 15) -> np.ndarray:
    """One row of ``slots`` values for each set (SuperMinHash).

    Each element draws a random permutation of the slots, step by step, and at step j
    offers its j-th slot the value j + r, 0 <= r < 1 (fixed point: j in the top byte).  A
    set stops as soon as its largest value is below the next step, since later offers
    can't lower anything; large sets therefore take a few steps only."""
    out = np.full((len(counts), slots), ~U64(0), U64)
    ends = np.cumsum(counts)
    begin = 0
    while begin < len(counts):
        base = ends[begin] - counts[begin]
        end = max(begin + 1, int(np.searchsorted(ends, base + together, side="right")))
        for lo in range(int(base), int(ends[end - 1]), together * 4):  # pieces of one very large set meet in the minimum
            hi = min(int(ends[end - 1]), lo + together * 4)
            rows = np.repeat(np.arange(begin, end), np.diff(np.clip(np.concatenate(([base], ends[begin:end])), lo, hi)))
            _sketch(elements[lo:hi], rows, out, slots)
        begin = end
    return out


def _sketch(x: np.ndarray, rows: np.ndarray, out: np.ndarray, slots: int) -> None:
    deck = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
    at, flat = np.arange(len(x)), out.reshape(-1)
    for j in range(slots):
        if not len(at):
            return
        r = mix(x[at] + U64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = j + ((r >> U64(40)) % U64(slots - j)).astype(np.int64)
        slot = deck[at, k].astype(np.int64)
        deck[at, k] = deck[at, j]
        np.minimum.at(flat, rows[at] * slots + slot, (U64(j) << U64(56)) | (mix(r) >> U64(8)))
        first = int(rows[at[0]])
        done = out[first : int(rows[at[-1]]) + 1].max(1) < (U64(j + 1) << U64(56))
        at = at[~done[rows[at] - first]]


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, slots = signature.shape
    parts = signature.reshape(n, bands, slots // bands)
    key = np.zeros((n, bands), U64) + mix(np.arange(1, bands + 1, dtype=U64))
    for j in range(slots // bands):
        key = mix(key ^ parts[:, :, j])
    return key


def parity_words(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``MARKS`` words for each set: whether the elements that fall into a bit are odd in number.

    An element that two sets don't share turns one bit, so the bits in which two sketches differ
    never outnumber the elements in which the sets do."""
    wide = 64 * MARKS
    out = np.zeros((len(counts), MARKS), U64)
    ends = np.cumsum(counts)
    bit = (mix(elements) >> U64(20)).astype(np.int64) % wide
    for lo in range(0, len(counts), 256):
        some = counts[lo : lo + 256]
        part = bit[ends[lo] - counts[lo] : ends[lo + len(some) - 1]]
        odd = np.bincount(np.repeat(np.arange(len(some)), some) * wide + part, minlength=len(some) * wide).astype(np.uint8) & 1
        out[lo : lo + 256] = np.packbits(odd.reshape(len(some), wide), axis=1).view(U64)
    return out


#: At a similarity of 0.75 at least, a seventh of the two sizes' sum is the most in which sets differ.
ALIKE = f"{100 + PERCENT} * (" + " + ".join(f"bit_count(m_a[{i}] ^ m_b[{i}])" for i in range(MARKS)) + f") <= {100 - PERCENT} * (size_a + size_b)"
#: A pair that shares several bands is taken in the first of them.
FIRST = "not exists(zip_with(slice(g_a, 1, i_a), slice(g_b, 1, i_a), (x, y) -> x = y), z -> z)"


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, marks) of every row; the digest stands for the set."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, counts = shingle_sets(Tokens.of(batch.column(1)), WIDTH)
        slots = superminhash(sets, counts)
        bands, marks = band_keys(slots), parity_words(sets, counts)
        ends = np.cumsum(counts)
        digest = np.zeros((len(counts), 2), U64)
        some = np.flatnonzero(counts)
        if len(some):
            for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                digest[some, i] = np.add.reduceat(mix(sets ^ U64(salt)), (ends - counts)[some])
        names = [f"{a:016x}{b:016x}" if n else None for (a, b), n in zip(digest.tolist(), counts.tolist(), strict=True)]
        lists = list_array(signed(bands[some].reshape(-1)), np.where(counts > 0, BANDS, 0), pa.int64())
        words = list_array(signed(marks[some].reshape(-1)), np.where(counts > 0, MARKS, 0), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(names, pa.string()), lists, words], ["doc_id", "n_shingles", "digest", "bands", "marks"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), sign, "doc_id long, n_shingles long, digest string, bands array<long>, marks array<long>")


def shingle_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) of every row, the whole set."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, counts = shingle_sets(Tokens.of(batch.column(1)), WIDTH)
        return pa.RecordBatch.from_arrays([batch.column(0), list_array(signed(values), counts, pa.int64())], ["id", "set"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), sets, "id long, set array<long>")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Equal sets meet in a class by their digest before anything is compared, so that
    exact copies cost one aggregation.  The least document of each class goes on to the
    bands.  Candidates' sets are built anew from their texts and intersected in full.  Of the pairs
    that are left to be listed (see :mod:`buckets`) those go whose parity sketches prove them too
    unlike; no other filter stands before verification, so a pair of 0.75 is missed only if it
    shares no band, with probability (1 - 0.75^5)^40 = 2e-5, and the less the more alike it is."""
    scratch = Scratch(docs.sparkSession)
    signed_docs = scratch.write(signatures(docs), "signed")
    known = signed_docs.where("doc_id is not null and digest is not null")
    classes = scratch.write(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    heads = known.withColumnRenamed("doc_id", "id").join(classes.withColumnRenamed("rep", "id"), ["digest", "id"], "left_semi")
    keys = heads.select("id", F.col("n_shingles").alias("size"), F.posexplode("bands").alias("i", "key")).select("key", "id", "size", "i").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        sets = scratch.write(shingle_rows(might_hold(docs.where("doc_id is not null").select("doc_id", "text"), "doc_id", wanted)), "sets")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb") - common).alias("u")).where(f"100 * i >= {PERCENT} * u and i > 0").select("a", "b").distinct()

    near = f"100 * least(size_a, size_b) >= {PERCENT} * greatest(size_a, size_b)"
    marks = heads.select("id", F.col("marks").alias("m"), F.col("bands").alias("g"))
    roots = link_buckets(scratch, keys, verify, near, "near", marks, f"{ALIKE} and {FIRST}")
    named = scratch.write(classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root")), "named")
    out = signed_docs.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the least of their component, with all columns."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = plain(docs)
    return rows.join(gone, F.col(f"c{docs.columns.index('doc_id')}").cast("long") == F.col("gone"), "left_anti").toDF(*docs.columns)
