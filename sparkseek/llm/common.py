"""Shared plumbing: scratch tables in the shared folder, Arrow batches, vectorised
tokens and 64-bit hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
BLOCK = 1 << 18
#: Bytes of an Arrow batch.  Spark's own bound is 10,000 rows, which texts can make any size, in the JVM and in Python.
BATCH_BYTES = 4 << 20
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# --------------------------------------------------------------------------- scratch


class Scratch:
    """Written tables under ``spark.checkpoint.dir``: they cut lineage and, unlike
    executor-local storage, outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bound_batches(spark)
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder's owner removes it
            pass


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES``, unless the session has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs.  It learns of them when
    the driver's JVM collects what nothing refers to; the first collection finds the plans,
    the next what they held."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --------------------------------------------------------------------------- batches


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of each piece is about ``most`` bytes; one longer
    text makes a piece by itself."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    at = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        base = at[begin] - sizes[begin]
        end = max(begin + 1, int(np.searchsorted(at, base + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def trim() -> None:
    """Give freed memory back: idle Python workers would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """The function of batches, which trims memory when a task ends."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return out


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` with bounded pieces: ``fn`` sees a few MB of text at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                yield fn(piece)

    return df.mapInArrow(lean(run), schema)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


class Held:
    """A bitmap of 2^bits places: what it does not hold is not among the places it was made of.

    Its size is fixed (8 to 16 MB) at any number of places; a full bitmap only tells less apart,
    so what it lets through must be decided by a join or an aggregation."""

    def __init__(self, places: DataFrame, bits: int = 26):
        p = F.col(places.columns[0]).cast("long").bitwiseAND(F.lit((1 << bits) - 1))
        rows = places.select(p.alias("p")).groupBy(F.expr("p >> 15").alias("k")).agg(F.bitmap_construct_agg(F.expr("p & 32767")).alias("b")).collect()  # 2^(bits - 15) pieces of 4 KB at most
        self.bits = np.zeros(1 << (bits - 3), np.uint8)
        for k, b in rows:
            self.bits[k << 12 : (k + 1) << 12] = np.frombuffer(b, np.uint8)
        self.mask = U64((1 << bits) - 1)

    def __call__(self, places: np.ndarray) -> np.ndarray:
        p = places.view(U64) & self.mask
        return (self.bits[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8)) & 1 == 1


def might_hold(df: DataFrame, key: str, ids: DataFrame, bits: int = 26) -> DataFrame:
    """Rows of ``df`` whose key may be among ``ids``: none that is goes missing, few others stay.

    A join with few ids then need not shuffle all rows; the join decides."""
    shared = df.sparkSession.sparkContext.broadcast(Held(ids.select(F.xxhash64(F.col(ids.columns[0]).cast("long"))), bits))

    def holds(places: pa.Array) -> pa.Array:
        return pa.array(shared.value(np.asarray(places)))

    return df.where(arrow_udf(holds, "boolean")(F.xxhash64(F.col(key).cast("long"))))


def plain(df: DataFrame) -> DataFrame:
    """The same rows under the names c0, c1, ..: no name clashes, none needs quoting."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


#: Characters outside ASCII that are no letter, mark or digit.
NO_LETTER = r"[^\x00-\x7F\pL\pM\pN]"


def letters(texts: pa.Array) -> pa.Array:
    """Lower-cased texts (null: empty) in which dashes, quotes, blanks and other signs outside
    ASCII are blanks."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    odd = pc.match_substring_regex(low, NO_LETTER)
    return pc.replace_with_mask(low, odd, pc.replace_substring_regex(low.filter(odd), NO_LETTER, " ")) if pc.any(odd).as_py() else low


# --------------------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n-1 and their inverses modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_MULT, _INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(block: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = (hash of block[i:j]) times the multiplier's i-th power."""
    p, _ = powers(len(block) + 1)
    out = np.zeros(len(block) + 1, U64)
    np.cumsum((block.astype(U64) + U64(1)) * p[: len(block)], out=out[1:])
    return out


class Tokens:
    """Words of a text column: hash of each, and for each row where its words begin."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, break_: np.ndarray = WHITE, fold: np.ndarray = LOWER):
        n = len(offsets) - 1
        starts, ends, hashes = [], [], []
        begin, size = 0, len(buf)
        while begin < size:
            end = min(size, begin + BLOCK)
            if end < size:  # move on to a separator, so that no word is cut
                while end < size:
                    stop = np.flatnonzero(break_[buf[end : end + 4096]])
                    if len(stop):
                        end += int(stop[0])
                        break
                    end = min(size, end + 4096)
            block = fold[buf[begin:end]]
            word = np.concatenate(([False], ~break_[block], [False]))
            lo, hi = np.searchsorted(offsets, [begin, end])
            edge = offsets[lo:hi] - begin
            first = word[1:-1] & ~word[:-2]
            last = word[1:-1] & ~word[2:]
            edge = edge[edge < len(block)]
            first[edge] |= word[1:-1][edge]
            inner = edge[edge > 0] - 1
            last[inner] |= word[1:-1][inner]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            h = prefix_hash(block)
            _, inv = powers(len(block) + 1)
            hashes.append(mix(((h[e] - h[s]) * inv[s]) ^ ((e - s).astype(U64) * U64(0xD6E8FEB86659FD93))))
            starts.append(s + begin)
            ends.append(e + begin)
            begin = end
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.starts, self.ends, self.hashes = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, U64)
        self.first = np.searchsorted(self.starts, offsets)  # row i: words first[i]..first[i+1]
        self.counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(n), self.counts)

    @classmethod
    def of(cls, col: pa.Array, **how) -> Tokens:
        return cls(*text_buffer(col), **how)

    def keep(self, rows: np.ndarray) -> Tokens:
        """The same rows, of which only those marked have their words (hashes alone)."""
        out = object.__new__(Tokens)
        out.hashes = self.hashes[rows[self.rows]]
        out.counts = np.where(rows, self.counts, 0)
        out.first = np.concatenate(([0], np.cumsum(out.counts)))
        out.rows = np.repeat(np.arange(len(out.counts)), out.counts)
        return out


def fold_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (len(h)-width+1 values)."""
    p, _ = powers(width + 1)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(width):
        out += (h[j : j + n] ^ U64(width)) * p[j + 1]
    return mix(out)


def shingle_sets(tokens: Tokens, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within the row, and their number.

    A row with fewer words has its whole sequence as its one shingle; a row without
    words has none."""
    whole = fold_windows(tokens.hashes, width)
    sets, counts = [], np.zeros(len(tokens.counts), np.int64)
    for i, (b, n) in enumerate(zip(tokens.first.tolist(), tokens.counts.tolist(), strict=False)):
        if n >= width:
            one = np.unique(whole[b : b + n - width + 1])
        elif n:
            one = fold_windows(tokens.hashes[b : b + n], n)
        else:
            continue
        sets.append(one)
        counts[i] = len(one)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), counts


# --------------------------------------------------------------------------- graph


def components(scratch: Scratch, links: DataFrame, name: str, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the least node that it
    reaches.

    Union-find runs first within the partitions, which leaves a forest; then hooks to
    least neighbours alternate between larger and smaller neighbours until nothing
    changes.  Every round is a written table."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = up[p]
            return x

        def spill() -> pa.RecordBatch:
            rows = [(x, find(x)) for x in list(up)]
            return pa.RecordBatch.from_pydict({"a": pa.array([r for x, r in rows if x != r], pa.int64()), "b": pa.array([x for x, r in rows if x != r], pa.int64())})

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > 250_000:  # bounded memory: hand on this forest, begin another
                yield spill()
                up.clear()
        yield spill()

    edges = scratch.write(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(lean(forest), "a long, b long"), f"{name}-0")
    before = None
    for i in range(1, rounds + 1):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("b"), F.col("m").alias("a")).where("a <> b").distinct()
        edges = scratch.write(small.select("a", "b"), f"{name}-{i}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{i - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
