"""Embedding of texts: a protocol, word pieces, pooling, and batches with their failures."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, MAX_TOKENS = 8, 256


class Embedder(Protocol):
    """Turns texts into vectors.  ``model`` and ``dimensions`` name what made them; an instance is
    sent to the executors and loads what it needs there, once a worker."""

    model: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class WordPieces:
    """Ids of a lower-cased text by the longest known pieces of its words, between the start and
    end marks, cut to ``most`` and padded to the longest of a batch."""

    def __init__(self, vocabulary: dict[str, int], most: int = MAX_TOKENS, start: str = "[CLS]", end: str = "[SEP]", unknown: str = "[UNK]", pad: int = 0, longest: int = 100):
        self.vocabulary, self.most, self.pad, self.longest = vocabulary, most, pad, longest
        self.start, self.end, self.unknown = (vocabulary[x] for x in (start, end, unknown))

    @staticmethod
    def words(text: str) -> Iterator[str]:
        """Words and single signs; accents and control characters go."""
        word = ""
        for ch in unicodedata.normalize("NFD", text.lower()):
            kind = unicodedata.category(ch)
            if kind == "Mn" or (kind[0] == "C" and ch not in "\t\n\r"):
                continue
            sign = kind[0] == "P" or (ch.isascii() and ch.isprintable() and not ch.isalnum() and ch != " ") or 0x4E00 <= ord(ch) <= 0x9FFF
            if ch.isspace() or sign:
                if word:
                    yield word
                word = ""
                if sign:
                    yield ch
            else:
                word += ch
        if word:
            yield word

    def pieces(self, word: str) -> list[int]:
        out, at = [], 0
        while at < len(word) and len(word) <= self.longest:
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.vocabulary:
                    out.append(self.vocabulary[piece])
                    at = end
                    break
            else:
                return [self.unknown]
        return out or [self.unknown]

    def batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of equal width."""
        rows = [[self.start, *[i for w in self.words(t) for i in self.pieces(w)][: self.most - 2], self.end] for t in texts]
        wide = max(map(len, rows), default=0)
        ids, mask = np.full((len(rows), wide), self.pad, np.int64), np.zeros((len(rows), wide), np.int64)
        for i, row in enumerate(rows):
            ids[i, : len(row)], mask[i, : len(row)] = row, 1
        return ids, mask


def pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the states (row, token, dimension) whose mask is 1, at unit length."""
    total = (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return np.where(norm > 0, total / np.where(norm > 0, norm, 1), total)


class OnnxEmbedder:
    """A model file and a vocabulary, loaded on the worker; token states are pooled."""

    def __init__(self, path: str, vocabulary: dict[str, int], model: str, dimensions: int):
        self.path, self.pieces, self.model, self.dimensions = path, WordPieces(vocabulary), model, dimensions
        self._session = None

    def __getstate__(self):
        return self.__dict__ | {"_session": None}

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = options.inter_op_num_threads = 1
            self._session = onnxruntime.InferenceSession(self.path, options)
        ids, mask = self.pieces.batch(texts)
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        asked = {x.name for x in self._session.get_inputs()}
        return pool(self._session.run(None, {k: v for k, v in given.items() if k in asked})[0], mask)


class HashEmbedder:
    """Vectors from hashed words, the same everywhere: for tests and for indexes without a model."""

    def __init__(self, dimensions: int = 64):
        self.model, self.dimensions = f"hash-{dimensions}", dimensions

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, text in enumerate(texts):
            for w in WordPieces.words(text):
                h = hashlib.blake2b(w.encode(), digest_size=16).digest()
                out[i, int.from_bytes(h[:8], "little") % self.dimensions] += 1.0 if h[8] & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder, batch: int = BATCH) -> DataFrame:
    """(key, embedding, error) of every row.  A batch that fails is tried text by text, so one text
    fails alone; a result of another number or size is a failure."""

    def tried(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            got = np.asarray(embedder.embed(texts), dtype=np.float32)
            if got.shape != (len(texts), embedder.dimensions):
                raise ValueError(f"{got.shape} for {len(texts)} texts of {embedder.dimensions} dimensions")
            return [(v.tolist(), None) for v in got]
        except Exception as e:  # counted and kept with the row; the row is tried again next time
            if len(texts) > 1:
                return [r for t in texts for r in tried([t])]
            return [(None, f"{type(e).__name__}: {e}"[:500])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                part = whole.slice(i, batch)
                done = tried([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v for v, _ in done], pa.list_(pa.float32())), pa.array([e for _, e in done], pa.string())], ["key", "embedding", "error"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, embedding array<float>, error string").withColumnRenamed("key", key)
