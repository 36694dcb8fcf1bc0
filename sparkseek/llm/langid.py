"""Language identification by prediction by partial matching.

Per language a tree of byte contexts of 0 to ``ORDER`` bytes, counted on a sample of its
training texts and then frozen.  A symbol costs its code length under the longest context: the
share of its count if the context has seen it (count / (total + kinds)), else the escape
(kinds / (total + kinds)) and the cost under the context one byte shorter; a context that a
language has not seen costs nothing; below the empty context a byte costs 8 bits.  The language
of the shortest code wins (the least name of equals); the score is its posterior under equal
priors.

The sample is bounded: of each language's training texts those whose hash falls below a
threshold chosen for ``SAMPLE`` characters, each cut to ``SAMPLE`` characters at most.  Texts
are scored whole.

Defined results.  A null text and one without a letter give ``und`` with score 0, as does
everything if there is no training text.  Rows with a null lang are no training rows; a null
doc_id is not held out.  Repeated rows give their rows.  Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, slices, text_buffer
from .lookup import Lookup

ORDER, SAMPLE = 4, 3_000_000
PAD = b"\n" * ORDER


def padded(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with ``order`` line ends before each row, the positions of the text's
    own bytes, and each row's number of them."""
    buf, off = text_buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    sizes = np.diff(off)
    at = np.arange(len(buf)) + order * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    out = np.full(len(buf) + order * len(sizes), 10, np.uint8)
    out[at] = buf
    return out, at, sizes


def grams(buf: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes that end at each position, as one number."""
    out = np.zeros(len(at), U64)
    for j in range(width - 1, -1, -1):
        out = (out << U64(8)) | buf[at - j]
    return out


def count(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """(lang, width, gram, n) of the sample.  docs: (doc_id, text, lang)."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h")).where("lang is not null and length(text) > 0")
    size = rows.groupBy("lang").agg(F.sum(F.least(F.length("text"), F.lit(sample))).alias("size"))
    # a language's rows are thinned before they meet, so a group is a sample
    thin = rows.join(F.broadcast(size) if size.count() <= 10_000 else size, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("size"))

    def tally(table: pa.Table) -> pa.Table:
        buf, at, _ = padded(table["text"].combine_chunks(), order)
        lang, width, gram, n = [], [], [], []
        for w in range(1, order + 2):
            k, c = np.unique(grams(buf, at, w), return_counts=True)
            width.append(np.full(len(k), w))
            gram.append(k.astype(np.int64))
            n.append(c)
        lang = [table["lang"][0].as_py()] * sum(map(len, n))
        return pa.table({"lang": pa.array(lang, pa.string()), "width": np.concatenate(width).astype(np.int32), "gram": np.concatenate(gram), "n": np.concatenate(n).astype(np.int64)})

    return thin.select("lang", F.substring("text", 1, sample).alias("text")).groupBy("lang").applyInArrow(tally, "lang string, width int, gram long, n long")


class Trees:
    """Code lengths of all languages, looked up by the bytes that end at a position."""

    def __init__(self, counts: pa.Table, order: int = ORDER):
        self.order = order
        lang = counts["lang"].combine_chunks().dictionary_encode()
        self.langs = sorted(lang.dictionary.to_pylist())
        number = np.array([self.langs.index(x) for x in lang.dictionary.to_pylist()], np.int64)[np.asarray(lang.indices)] if len(lang) else np.zeros(0, np.int64)
        width, gram, n = (np.asarray(counts[c]) for c in ("width", "gram", "n"))
        self.cost, self.find, self.escape, self.context = [], [], [], []
        for w in range(1, order + 2):
            use = width == w
            keys, inverse = np.unique(gram[use], return_inverse=True)
            seen = np.zeros((len(keys), len(self.langs)))
            np.add.at(seen, (inverse, number[use]), n[use])
            past, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(past), len(self.langs))), np.zeros((len(past), len(self.langs)))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(seen / (total + kinds)[of])
            if w > 1:
                lower = self.cost[-1][self.find[-1].find((keys & ((1 << 8 * (w - 1)) - 1)).astype(U64))]
            else:
                lower = np.full(seen.shape, 8.0)
            self.cost.append(np.where(seen > 0, own, escape[of] + lower))
            self.find.append(Lookup(keys.astype(U64)))
            self.escape.append(escape)
            self.context.append(Lookup(past.astype(U64)))
        self.cost = [x.astype(np.float32) for x in self.cost]
        self.escape = [x.astype(np.float32) for x in self.escape]

    def code(self, gram: np.ndarray, w: int | None = None) -> np.ndarray:
        """Code length in bits of each position's last byte, by language."""
        w = self.order + 1 if w is None else w
        if w == 0:
            return np.full((len(gram), len(self.langs)), 8.0, np.float32)
        at = self.find[w - 1].find(gram)
        new = np.flatnonzero(at < 0)
        if not len(self.cost[w - 1]):
            return self.code(gram & U64((1 << 8 * (w - 1)) - 1), w - 1)
        out = self.cost[w - 1][at]
        if len(new):
            rest = gram[new]
            past = self.context[w - 1].find(rest >> U64(8))
            add = np.where((past >= 0)[:, None], self.escape[w - 1][past], np.float32(0))
            out[new] = add + self.code(rest & U64((1 << 8 * (w - 1)) - 1), w - 1)
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code length of every whole text, by language; long texts in pieces."""
        buf, at, sizes = padded(texts, self.order)
        out = np.zeros((len(sizes), len(self.langs)))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        for i in range(0, len(at), 1 << 18):
            some, of = at[i : i + (1 << 18)], rows[i : i + (1 << 18)]
            edge = np.flatnonzero(np.diff(of, prepend=-1))
            out[of[edge]] += np.add.reduceat(self.code(grams(buf, some, self.order + 1)), edge, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        bits = self.lengths(texts)
        names, scores = [], []
        for row, text in zip(bits, texts.to_pylist(), strict=True):
            if not self.langs or not text or not any(map(str.isalpha, text)):
                names.append("und")
                scores.append(0.0)
                continue
            best = int(row.argmin())
            names.append(self.langs[best])
            scores.append(float(1 / np.exp2(np.clip(row[best] - row, -1000, 0)).sum()))
        return names, scores


def predict(docs: DataFrame, out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang), by
    trees of the rows where ``out`` is false."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", out.alias("held_out"))
    trees = Trees(count(rows.where("not held_out")).toArrow())
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                names, scores = shared.value.predict(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "text", "held_out").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
