"""Vector code compression: product codes whose nearest entries are found by Exponion search.

A vector's integer components are cut into ``PARTS`` equal parts; each part position has a codebook of
``ENTRIES`` entries, which begins as the parts of the vectors with the smallest vec_ids and is refined by
``ROUNDS`` rounds of assigning every part to its nearest entry and replacing each entry by the floors of
its parts' means.

Nearest entries: a part at squared distance U from its entry a of the round before can only be as near to
an entry c with D(a, c) <= 4 U (|ac| <= |ax| + |xc| <= 2 |ax|, all squared).  Each entry's neighbours are
listed by distance, so those entries are a prefix of a's list; the parts of one entry are taken together,
in the order of their prefixes, and every block scans the longest prefix in it.  Distances are exact
integers (doubles while they are below 2^53, else Python's integers); equal ones go to the lower index.

Each round is a written table of (vector, codes), so lost executors cost a round at most; sums by entry are
added up in each task before the shuffle.  A codebook has ENTRIES x (dimension) integers at any number of
vectors, and is all that comes to the driver and goes to the tasks.

Defined results.  Rows whose vector is null or holds a null or a non-finite component go.  The dimension
is that of the first kept vector by vec_id; a vector of another dimension, or with a component of 2^51 or more,
has a null code and error, and adds nothing to the codebooks and label_error.  A dimension that is no multiple of PARTS is filled up with zeros.
Repeated vec_ids are separate vectors; ties among the first go by components.  A null vec_id comes last.  With fewer vectors
than ENTRIES the codebooks are as short.  An empty table gives an empty result.  Errors that no long
can hold are null.  Extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, plain

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors taken together in a task, vectors by neighbours in one block of distances, and the labels that are sent.
TOGETHER, BLOCK, LABELS = 1 << 15, 1 << 10, 100_000
EXACT = 1 << 53
#: Components beyond it have no code: their integers might leave the longs.
WIDEST = float(1 << 51)


def as_exact(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all that is computed of them stays below 2^53, else as Python's integers."""
    most = max((max(int(v.max()), -int(v.min())) for v in (x, c) if v.size), default=0)
    kind = np.float64 if 16 * x.shape[1] * (most + 1) ** 2 < EXACT else object
    return x.astype(kind), c.astype(kind)


class Exponion:
    """Nearest entries of one part position's codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        square = (entries * entries).sum(1)
        apart = square[:, None] + square[None, :] - 2 * entries.dot(entries.T)
        ids = np.arange(len(entries))
        self.near = np.array([np.array(sorted(ids, key=lambda j, row=row: (row[j], j))) for row in apart]) if apart.dtype == object else np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, 1)
        self.square = square
        self.scanned = 0

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part's nearest entry and its squared distance; before: where the search begins."""
        code = np.zeros(len(x), np.int64)
        error = np.zeros(len(x), x.dtype)
        own = self.entries[before]
        radius = 4 * ((x - own) * (x - own)).sum(1)
        square = (x * x).sum(1)
        order = np.argsort(before, kind="stable")
        at = np.searchsorted(before[order], np.arange(len(self.entries) + 1))
        for a in np.flatnonzero(np.diff(at)):
            rows = order[at[a] : at[a + 1]]
            reach = np.searchsorted(self.apart[a], radius[rows], side="right")
            by_reach = np.argsort(reach, kind="stable")
            for i in range(0, len(rows), BLOCK):
                block = rows[by_reach[i : i + BLOCK]]
                ids = np.sort(self.near[a][: reach[by_reach[min(i + BLOCK, len(rows)) - 1]]])  # by index: the first of equal ones is the lowest
                self.scanned += len(ids) * len(block)
                far = self.square[ids] - 2 * x[block].dot(self.entries[ids].T)
                best = far.argmin(1)
                code[block] = ids[best]
                error[block] = square[block] + far[np.arange(len(block)), best]
        return code, error


def parts_of(vectors: np.ndarray) -> list[np.ndarray]:
    """The equal parts of integer vectors, filled up with zeros."""
    more = -vectors.shape[1] % PARTS
    if more:
        vectors = np.concatenate([vectors, np.zeros((len(vectors), more), vectors.dtype)], 1)
    return np.split(vectors, PARTS, axis=1)


def assign(vectors: np.ndarray, before: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (one column a part) and errors of integer vectors."""
    codes, errors = [], 0
    for part, entries, code in zip(parts_of(vectors), books, before.T, strict=True):
        x, c = as_exact(part, entries)
        found, error = Exponion(c).nearest(x, code)
        codes.append(found)
        errors = errors + error
    return np.stack(codes, 1), errors


def _vectors(col: pa.Array, size: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), size)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches, taken together up to ``TOGETHER`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _step(rows: DataFrame, size: int, books: list[np.ndarray], kind: str, last: bool) -> DataFrame:
    """Rows with the codes (and, in the last step, errors) of these codebooks."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            v, c = t.column("vector").chunk(0), t.column("codes").chunk(0)
            before = np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
            codes, errors = assign(_vectors(v, size), before, shared.value)
            told = pa.array([x.tobytes() for x in codes.astype(np.uint8)], pa.binary())
            if last:
                told = pa.array([x.hex() for x in told.to_pylist()], pa.string())
                fits = [int(e) if e < 1 << 63 else None for e in errors.tolist()]
                out = {"vec_id": t.column("vec_id"), "label": t.column("label"), "code": told, "error": pa.array(fits, pa.int64())}
            else:
                out = {"vec_id": t.column("vec_id"), "label": t.column("label"), "vector": v, "codes": told}
            yield from pa.table(out).to_batches()

    return rows.mapInArrow(lean(run), f"{kind}, code string, error long" if last else f"{kind}, vector array<bigint>, codes binary")


def _means(rows: DataFrame, size: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: floors of the means of what is assigned to each entry."""
    n, width = len(books[0]), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, n, width), object), np.zeros((PARTS, n), np.int64)
        for t in _gathered(batches):
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p, part in enumerate(parts_of(_vectors(t.column("vector").chunk(0), size))):
                order = np.argsort(codes[:, p], kind="stable")
                ids, first = np.unique(codes[order, p], return_index=True)
                exact = part[order].astype(object if len(part) * max(int(part.max(initial=0)), -int(part.min(initial=0))) >= 1 << 62 else np.int64)
                sums[p, ids] += np.add.reduceat(exact, first, axis=0).astype(object)
                counts[p] += np.bincount(codes[:, p], minlength=n)
        p, e = np.nonzero(counts)
        said = [[str(v) for v in x] for x in sums[p, e]]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(said, pa.list_(pa.string()))], ["p", "e", "n", "s"])

    told = rows.select("vector", "codes").mapInArrow(lean(run), "p int, e int, n long, s array<string>")
    told = told.select("p", "e", "n", F.posexplode("s").alias("i", "s")).groupBy("p", "e", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [b.copy() for b in books]
    for p, e, i, k, s in told.collect():  # one number for each component of the codebooks at most
        out[p][e, i] = int(s) // k
    return out


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    at = {c: F.col(f"c{vectors.columns.index(c)}") for c in ("vec_id", "embedding", "label")}
    x = at["embedding"].cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = plain(vectors).where(x.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(at["vec_id"].alias("vec_id"), at["label"].alias("label"), x.alias("x"))
    kind = ", ".join(f"{c} {k}" for c, k in kept.dtypes[:2])
    wide = F.exists("x", lambda v: F.abs(v) >= WIDEST)
    order = F.col("vec_id").asc_nulls_last(), F.col("x")
    first = kept.where(~wide).orderBy(*order).limit(ENTRIES).select("x").collect()
    size = len(first[0]["x"]) if first else 0
    able = ~wide & (F.size("x") == size)
    if any(len(r["x"]) != size for r in first):
        first = kept.where(able).orderBy(*order).limit(ENTRIES).select("x").collect()
    fit = kept.where(able).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * float(SCALE))).alias("vector"))
    other = kept.where(~able).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    books = parts_of(np.floor(np.array([r["x"] for r in first], np.float64).reshape(len(first), size) * SCALE).astype(np.int64)) if first else []
    if not first:
        return other.select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    now = fit.withColumn("codes", F.lit(bytes(PARTS)))
    for i in range(ROUNDS):
        now = scratch.write(_step(now, size, books, kind, last=False), f"round-{i}")
        books = _means(now, size, books)
        scratch.drop(f"round-{i - 1}")
    done = scratch.write(_step(now, size, books, kind, last=True), "coded")
    scratch.drop(f"round-{ROUNDS - 1}")
    done = done.unionByName(other)
    sums = done.groupBy(F.col("label").alias("l")).agg(F.expr("try_cast(coalesce(sum(cast(error AS decimal(38,0))), 0) AS bigint)").alias("label_error"))
    sums = scratch.write(sums, "labels")
    sums = F.broadcast(sums) if sums.count() <= LABELS else sums
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.flat).encode()).hexdigest()
    return done.join(sums, F.col("label").eqNullSafe(F.col("l")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
