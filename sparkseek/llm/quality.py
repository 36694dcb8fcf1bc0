"""Quality rules by compression bands: zstandard ratios of the whole text and of fixed
chunks must lie within limits that depend on the length.

Two limits hold for each length.  Fixed ones (``BANDS``) bound what any text may have.  Fitted ones
follow the table: of all documents that pass the base rules, the quartiles of the ratio in each
length class (half an octave of bytes) and of full chunks; a ratio further than ``FENCE`` times their
distance below the first or above the third is an outlier.  Quartiles come from exact counts of
ratios rounded to 1 / ``STEPS``, so they are the same however the table is cut.  A class of fewer
than ``FEWEST`` ratios borrows what it lacks from its neighbours, nearest first (all that are equally near weigh alike, as
much as is lacking), and what they lack, too, from the two ends of its fixed band; so one ratio more or less
moves its limits a little, and a small table has the fixed limits only.  A document goes if its own ratio is outside, or more
than ``SHARE`` of its chunks are.

Defined results.  A null text is an empty text: no words, base failed, not kept.  Every
row gives one row, repeated or not; repeated rows weigh in the quartiles as often.  Lines are cut at
\\n alone; words at the six ASCII blanks.  A text below ``LEAST`` bytes has no ratio to judge and
passes the bands.  An empty table gives an empty result.  Extra columns, whatever their names, are
passed through by :func:`keep_good`."""

from __future__ import annotations

import math
import re
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Scratch, bound_batches, plain

#: From so many bytes on: the least and the largest ratio of compressed to plain size.
BANDS = ((64, 0.22, 1.40), (200, 0.25, 1.00), (500, 0.25, 0.85), (1000, 0.22, 0.74), (5000, 0.18, 0.72), (20000, 0.15, 0.70))
LEAST, CHUNK, LEVEL = 64, 2048, 3
#: A text goes if more than this share of its chunks is outside the band of their length.
SHARE = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
FENCE, STEPS, FEWEST = 3.0, 2000, 50
#: Class of a full chunk; documents have the class of their bytes.
FULL = -1
WORD = re.compile(r"[^\x20\x09-\x0D]")
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_bytes", pa.int64()), ("ratio", pa.float64()), ("chunks", pa.list_(pa.float64())), ("rest_bad", pa.bool_()), ("base_failed", pa.bool_())]
FORM = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_bytes:long,ratio:double,chunks:array<double>,rest_bad:boolean,base_failed:boolean>"
_zstd: list[zstandard.ZstdCompressor] = []


def within(size: int, ratio: float) -> bool:
    low, high = next(((lo, hi) for n, lo, hi in reversed(BANDS) if size >= n), (0.0, 9.9))
    return low <= ratio <= high


def compression(raw: bytes) -> tuple[float | None, list[float], bool]:
    """Ratio of the whole, ratios of its full chunks, and whether the last chunk is outside the fixed
    band.  A last chunk of less than half the length counts to the one before; a text of one chunk
    has none besides the whole."""
    if len(raw) < LEAST:
        return None, [], False
    if not _zstd:
        _zstd.append(zstandard.ZstdCompressor(level=LEVEL))
    press = _zstd[0].compress
    cuts = list(range(0, max(1, len(raw) - CHUNK // 2), CHUNK)) + [len(raw)]
    full, rest = [], False
    if len(cuts) > 2:
        full = [len(press(raw[a : a + CHUNK])) / CHUNK for a in cuts[:-2]]
        rest = not within(len(raw) - cuts[-2], len(press(raw[cuts[-2] :])) / (len(raw) - cuts[-2]))
    return len(press(raw)) / len(raw), full, rest


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    n = covered = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, covered)
            covered = i + 3
    return n


def measure(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(raw), *compression(raw), failed


def _measure(texts: pa.Array) -> pa.Array:
    rows = [measure(x.as_py()) for x in texts]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(FIELDS)], [n for n, _ in FIELDS])


def measures(text: Column) -> Column:
    """Struct of the measures of a text and the base rules' outcome."""
    return arrow_udf(_measure, FORM)(text.cast("string"))


def _class(n_bytes: Column) -> Column:
    return F.floor(2 * F.log2(n_bytes)).cast("int")


def fences(measured: DataFrame) -> dict[int, tuple[float, float]]:
    """Fitted limits by class.  measured: (m: the measures)."""
    ok = measured.where("m.ratio is not null and not m.base_failed")
    own = F.array(F.struct(_class(F.col("m.n_bytes")).alias("k"), F.col("m.ratio").alias("r")))
    each = ok.select(F.explode(F.concat(own, F.transform("m.chunks", lambda r: F.struct(F.lit(FULL).alias("k"), r.alias("r"))))).alias("x"))
    counts = each.groupBy("x.k", F.round(F.col("x.r") * STEPS).cast("int").alias("step")).agg(F.count("*").alias("n"))
    by: dict[int, list[tuple[int, int]]] = {}
    for k, step, n in counts.collect():  # a class has at most some 1.5 * STEPS steps, and there are some 60 classes
        by.setdefault(k, []).append((step, n))
    out = {}
    for k in by:
        steps = borrowed(by, k)
        total, ends, seen = sum(n for _, n in steps), [], Fraction(0)
        for step, n in sorted(steps):
            seen += n
            while len(ends) < 2 and 4 * seen >= (1, 3)[len(ends)] * total:
                ends.append(step)
        out[k] = ((ends[0] - FENCE * (ends[1] - ends[0])) / STEPS, (ends[1] + FENCE * (ends[1] - ends[0])) / STEPS)
    return out


def borrowed(by: dict[int, list[tuple[int, int]]], k: int) -> list[tuple[int, Fraction]]:
    """The ratios of a class with their weights, ``FEWEST`` in all at least."""
    out = [(step, Fraction(n)) for step, n in by[k]]
    lacking = FEWEST - sum(n for _, n in out)
    for far in range(1, 1 + max(abs(j - k) for j in by)) if k != FULL else ():
        near = [x for j in (k - far, k + far) if j != FULL for x in by.get(j, [])]
        if lacking <= 0:
            break
        if near:
            share = min(Fraction(1), lacking / sum(n for _, n in near))
            out += [(step, n * share) for step, n in near]
            lacking -= share * sum(n for _, n in near)
    if lacking > 0:
        size = CHUNK if k == FULL else max(LEAST, math.ceil(2 ** (k / 2)))
        _, low, high = max(b for b in BANDS if b[0] <= size)
        out += [(round(edge * STEPS), lacking / 2) for edge in (low, high)]
    return out


def _outside(ratio: Column, size: Column, cls: Column, limits: dict[int, tuple[float, float]]) -> Column:
    band = [F.when(size >= n, F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for n, lo, hi in reversed(BANDS)]
    fixed = F.coalesce(*band)
    bad = (ratio < fixed["lo"]) | (ratio > fixed["hi"])
    if limits:
        edge = F.try_element_at(F.create_map(*(x for k, (lo, hi) in sorted(limits.items()) for x in (F.lit(k), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))))), cls)
        bad = bad | F.coalesce((ratio < edge["lo"]) | (ratio > edge["hi"]), F.lit(False))
    return bad


def verdict(m: Column, limits: dict[int, tuple[float, float]]) -> tuple[Column, Column, Column]:
    """bad_chunks, n_chunks and kept of the measures under the fitted limits."""
    bad = F.size(F.filter(m["chunks"], lambda r: _outside(r, F.lit(CHUNK), F.lit(FULL), limits))) + m["rest_bad"].cast("int")
    n = F.size(m["chunks"]) + 1
    kept = ~m["base_failed"] & ~F.coalesce(_outside(m["ratio"], m["n_bytes"], _class(m["n_bytes"]), limits), F.lit(False)) & (bad <= SHARE * n)
    return bad.cast("long"), n.cast("long"), kept


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, the measures, bad_chunks, n_chunks, base_failed, kept) of every row of ``docs``."""
    rows = Scratch(docs.sparkSession).write(docs.select("doc_id", measures(F.col("text")).alias("m")), "measures")
    bad, n, kept = verdict(F.col("m"), fences(rows))
    plain_ones = [F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "ratio")]
    return rows.select("doc_id", *plain_ones, bad.alias("bad_chunks"), n.alias("n_chunks"), F.col("m.base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all columns."""
    bound_batches(docs.sparkSession)
    limits = fences(docs.select(measures(F.col("text")).alias("m")))
    rows = plain(docs)
    rows = rows.withColumn("m", measures(F.col(f"c{docs.columns.index('text')}")))
    return rows.where(verdict(F.col("m"), limits)[2]).drop("m").toDF(*docs.columns)
