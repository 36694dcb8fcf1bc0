"""The functions that SQL can call: scalars, a table function for manifests, and an aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..operators.embed import BATCH, Embedder
from ..sources import manifests
from . import porter
from .names import initials_prefix
from .text import _decoded


def register(spark: SparkSession, embedder: Embedder | None = None, tolerance: float = 0.05) -> list[str]:
    """Registers for SQL: stem_terms(text), decode_references(text), initials_prefix(query, name); the table function
    manifest_fields(text) (path, value, position); the aggregate tier_starts(score), the best score of each tier of a
    query's candidates; and, with an embedder, embed_text(text), which loads its model once a worker."""

    @pandas_udf("array<string>")
    def stem_terms(texts: pd.Series) -> pd.Series:
        return texts.map(porter.tokens)

    @pandas_udf("string")
    def decode_references(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else _decoded(x))

    @pandas_udf("boolean")
    def initials(queries: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([initials_prefix((q or "").lower(), (n or "").lower().split()) for q, n in zip(queries, names, strict=True)])

    @arrow_udf("array<double>")
    def tier_starts(scores: pa.Array) -> list[float]:
        out: list[float] = []
        for score in sorted((x for x in scores.to_pylist() if x is not None), reverse=True):
            if not out or score < out[-1] * (1 - tolerance):
                out.append(score)
        return out

    made = {"stem_terms": stem_terms, "decode_references": decode_references, "initials_prefix": initials, "tier_starts": tier_starts}
    if embedder is not None:

        @pandas_udf("array<float>")
        def embed_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                parts = [embedder.embed([t or "" for t in texts[i : i + BATCH]]) for i in range(0, len(texts), BATCH)]
                yield pd.Series(list(np.concatenate(parts).astype(np.float32)) if parts else [], dtype=object)

        made["embed_text"] = embed_text
    for name, f in made.items():
        spark.udf.register(name, f)
    manifests.register(spark)
    return [*made, "manifest_fields"]
