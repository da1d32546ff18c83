"""Embedding of texts: providers, pooling, batches that fail as a whole, late chunking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.helpers import hash_vector
from marlstone.session import ship


class Provider(Protocol):
    """What an embedder offers; made once per worker by a factory."""

    width: int
    context: int
    remote: bool
    most_items: int
    most_tokens: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashProvider:
    """Vectors that follow from the texts' digests; for tests and dry runs, without a model."""

    def __init__(self, width: int = 64) -> None:
        self.width, self.context, self.remote, self.most_items, self.most_tokens = width, 512, False, 256, 1 << 30

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([hash_vector(t, self.width) for t in texts], dtype=np.float32).reshape(len(texts), self.width)


class TokenProvider:
    """Mean of fixed pseudo-random token vectors, at length 1: texts that share words are near one another."""

    def __init__(self, width: int = 64) -> None:
        self.width, self.context, self.remote, self.most_items, self.most_tokens = width, 8192, False, 256, 1 << 30
        self._known: dict[str, np.ndarray] = {}

    def token_vectors(self, text: str) -> np.ndarray:
        import re
        import zlib

        out = []
        for w in re.findall(r"[^\W_]+", text.lower()):
            v = self._known.get(w)
            if v is None:
                if len(self._known) > 200_000:
                    self._known.clear()
                v = self._known[w] = np.random.default_rng(zlib.crc32(w.encode())).standard_normal(self.width).astype(np.float32)
            out.append(v)
        return np.array(out, dtype=np.float32).reshape(len(out), self.width)

    def embed(self, texts: list[str]) -> np.ndarray:
        return unit(np.array([pool(self.token_vectors(t), None, "mean") for t in texts], dtype=np.float32).reshape(len(texts), self.width))


PROVIDERS: dict[str, Callable[..., Provider]] = {"hash": HashProvider, "tokens": TokenProvider}


def provider(name: str, **settings) -> Callable[[], Provider]:
    """A factory by name; those of ``marlstone.operators.remote`` need a service."""
    import marlstone.operators.remote  # noqa: F401 - registers its providers

    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; there are {sorted(PROVIDERS)}")
    cls = PROVIDERS[name]
    return lambda: cls(**settings)


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return np.divide(m, n, out=m.copy(), where=n > 0)


def pool(tokens: np.ndarray, mask: np.ndarray | None = None, how: str = "mean") -> np.ndarray:
    """One vector of a text's token vectors: mean over the masked-in tokens, the first, or the last of them."""
    keep = np.ones(len(tokens), dtype=bool) if mask is None else mask.astype(bool)
    if not keep.any():
        return np.zeros(tokens.shape[-1], dtype=np.float32)
    if how == "mean":
        return tokens[keep].mean(axis=0)
    if how == "first":
        return tokens[keep][0]
    if how == "last":
        return tokens[keep][-1]
    raise ValueError(how)


def late_chunks(tokens: list[np.ndarray]) -> list[np.ndarray]:
    """Vectors of chunks encoded as one text: the token rows are sliced by running offsets, averaged and set to length 1."""
    whole = np.concatenate(tokens) if tokens else np.zeros((0, 1), dtype=np.float32)
    out, at = [], 0
    for t in tokens:
        out.append(unit(pool(whole[at:at + len(t)])[None])[0])
        at += len(t)
    return out


def embed(rows: DataFrame, make: Callable[[], Provider], text: str = "content", key: list[str] | None = None) -> DataFrame:
    """``rows`` with ``embedding`` and ``embed_error``.

    The provider is made once a task. Texts go in batches of its limits; when a batch fails, all its rows carry the
    error and no vector, and the task goes on. A null text has neither.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())])

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = make()
        for part in parts:
            texts = part[text].tolist()
            vectors: list = [None] * len(part)
            errors: list = [None] * len(part)
            at: list[int] = []
            held = 0

            def flush() -> None:
                nonlocal at, held
                if at:
                    try:
                        for i, v in zip(at, p.embed([texts[i] for i in at]), strict=True):
                            vectors[i] = np.asarray(v, dtype=np.float32)
                    except Exception as e:  # the batch fails as a whole
                        for i in at:
                            errors[i] = f"{type(e).__name__}: {e}"
                at, held = [], 0

            for i, t in enumerate(texts):
                if t is None:
                    continue
                n = len(t.encode("utf-8", "surrogatepass")) // 4
                if at and (len(at) >= p.most_items or held + n > p.most_tokens):
                    flush()
                at.append(i)
                held += n
            flush()
            yield part.assign(embedding=vectors, embed_error=errors)

    ship(rows.sparkSession)
    return rows.mapInPandas(work, schema)


def embed_late(rows: DataFrame, make: Callable[[], Provider], by: list[str], order: list[str], text: str = "content") -> DataFrame:
    """``rows`` with ``embedding`` from token vectors of their whole file: the chunks of a file, in order, are encoded together up to the
    provider's context, and each gets the mean of its own tokens. The provider must give token vectors. A null text has none."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def work(part: pd.DataFrame) -> pd.DataFrame:
        p = make()
        part = part.sort_values(order, ignore_index=True)
        vectors: list[np.ndarray | None] = [None] * len(part)
        run: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            for (i, _), v in zip(run, late_chunks([t for _, t in run])):
                vectors[i] = v.astype(np.float32)
            run.clear()

        for i, t in enumerate(part[text].tolist()):
            if t is None:
                continue
            own = p.token_vectors(t)
            if run and sum(len(x) for _, x in run) + len(own) > p.context:
                flush()
            run.append((i, own))
        flush()
        return part.assign(embedding=vectors)

    ship(rows.sparkSession)
    return rows.groupBy(*by).applyInPandas(work, schema)


def failed_files(embedded: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Files with a row in a failed batch, with the first error by text."""
    key = key or ["project_id", "file_path"]
    return embedded.filter("embed_error is not null").groupBy(*key).agg(F.min("embed_error").alias("error"))


def check_width(rows: DataFrame, width: int, column: str = "embedding") -> DataFrame:
    """``rows``, after making sure that no vector has another width."""
    bad = rows.filter(F.col(column).isNotNull() & (F.size(column) != width)).select(F.size(column).alias("n")).head(1)
    if bad:
        raise ValueError(f"a vector of width {bad[0][0]} in a table of width {width}")
    return rows
