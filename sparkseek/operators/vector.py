"""Exact vector search for a set of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of one block of query vectors: 64 MB; scores that a task holds at once.
BLOCK_NUMBERS, SCORES = 8_000_000, 1 << 20


def dot(a: Column, b: Column) -> Column:
    """In double precision; null if the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the states whose mask is 1, then unit length."""
    used = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["s"])
    n = F.greatest(F.size(used), F.lit(1))
    first = F.get(states, 0)
    total = F.aggregate(used, F.transform(first, lambda x: F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return normalize(F.transform(total, lambda x: x / n))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def pieces(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that rows times queries are at most ``SCORES``."""
    step = max(1, SCORES // max(1, queries))
    return (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step))


def scores(rows: DataFrame, queries: DataFrame, key: str, vector: str, floor: float | None = None, k: int | None = None, digits: int = 6) -> DataFrame:
    """(qid, key, score): cosine of unit vectors.

    The queries go out in blocks of bounded size, one pass over the rows for each; a task
    multiplies matrices of so many rows that the scores are at most ``SCORES`` and, with k, hands on its
    own best k a query, so that neither its memory nor what is shuffled depends on the number of rows in a task.  Scores are rounded before they are
    compared, so that the order of summation decides nothing; ties go to the lesser key."""
    q = queries.select("qid", F.col(vector).cast("array<double>").alias("v"))
    dims, n = q.agg(F.max(F.size("v")), F.count("*")).first()
    parts = max(1, -(-(n or 0) * max(dims or 1, 8 * (k or 0)) // BLOCK_NUMBERS))
    spark = rows.sparkSession
    out = []
    for i in range(parts):
        table = (q if parts == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)).orderBy("qid").toArrow()
        ids, mat = table["qid"].combine_chunks(), _matrix(table["v"].combine_chunks())
        shared = spark.sparkContext.broadcast((ids, mat))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, mat = shared.value
            best: list[tuple[np.ndarray, ...]] = []

            def cut(parts):
                qi, key, s = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((key, -s, qi))
                qi, key, s = qi[order], key[order], s[order]
                first = np.searchsorted(qi, qi)
                keep = np.arange(len(qi)) - first < k
                return qi[keep], key[keep], s[keep]

            def emit(qi, key, s):
                return pa.RecordBatch.from_arrays([ids.take(pa.array(qi)), pa.array(key), pa.array(s)], ["qid", key_name, "score"])

            key_name = key
            for batch in pieces(batches, len(mat)):
                keys = np.asarray(batch.column(0))
                got = np.round(_matrix(batch.column(1)) @ mat.T, digits) if len(mat) else np.zeros((batch.num_rows, 0))
                r, qi = np.nonzero(got >= floor) if floor is not None else np.nonzero(np.ones(got.shape, bool))
                found = (qi, keys[r], got[r, qi])
                if k is None:
                    yield emit(*found)
                else:
                    best.append(found)
                    if sum(len(x[0]) for x in best) > SCORES + 2 * k * len(mat):
                        best = [cut(best)]
            if k is not None and best:
                yield emit(*cut(best))

        kind = dict(rows.dtypes)[key]
        out.append(rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"qid {dict(queries.dtypes)['qid']}, {key} {kind}, score double"))
    every = reduce(DataFrame.unionByName, out)
    if k is None:
        return every
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return every.withColumn("place", place).where(F.col("place") <= k)
