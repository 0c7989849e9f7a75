"""Embedding adapters: the protocol, a registry, and an offline adapter for tests."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.errors import retried

BATCH = 32


class Adapter(Protocol):
    name: str
    kind: str
    dimensions: int

    def embed_query(self, text: str) -> list: ...


class TextAdapter(Adapter, Protocol):
    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...


class VisionAdapter(Adapter, Protocol):
    def embed_images(self, images: list[bytes]) -> list[list[list[float]]]: ...


_registry: dict[str, Adapter] = {}


def validate(adapter: Adapter) -> None:
    """An error that names what an adapter lacks."""
    needed = ["name", "kind", "dimensions", "embed_query", {"text": "embed_documents", "vision": "embed_images"}.get(getattr(adapter, "kind", ""), "kind of text or vision")]
    missing = [n for n in needed if not hasattr(adapter, n)]
    if missing:
        raise ValueError(f"an adapter needs {', '.join(missing)}")


def register(adapter: Adapter) -> None:
    validate(adapter)
    _registry[adapter.name] = adapter


def get(name: str) -> Adapter:
    if name not in _registry:
        raise KeyError(f"no adapter {name!r}; there are {sorted(_registry)}")
    return _registry[name]


def by_kind(kind: str) -> list[Adapter]:
    return [a for a in _registry.values() if a.kind == kind]


def names() -> list[str]:
    return sorted(_registry)


def clear() -> None:
    _registry.clear()


class HashingAdapter:
    """A deterministic bag of hashed words on the unit sphere: no model, the same on every machine."""

    kind = "text"

    def __init__(self, dimensions: int = 64, name: str = "hashing"):
        self.dimensions, self.name = dimensions, name

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out

    def embed_images(self, images: list[bytes]) -> list[list[list[float]]]:
        raise TypeError("a text adapter embeds no images")


def finite(values: list[float]) -> list[float]:
    """Components that are no numbers as 0."""
    return [0.0 if v != v or v in (math.inf, -math.inf) else v for v in values]


def embed(rows: DataFrame, text_col: str, adapter: TextAdapter, out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """`rows` with an embedding of each text; the adapter goes to the executors once a worker and sees batches of texts, again after connection errors."""

    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found: list[list[float]] = []
            for i in range(0, len(texts), batch):
                part = texts.iloc[i : i + batch].fillna("").tolist()
                found += [finite(v) for v in retried(lambda part=part: adapter.embed_documents(part))]
            yield pd.Series(found)

    vectors.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out, F.pandas_udf(vectors, "array<float>")(F.col(text_col)))


def embed_images(pages: DataFrame, image_col: str, adapter: VisionAdapter, batch: int = 2) -> DataFrame:
    """(all but the image, vector_index, embedding): the vectors of each page image, a few images at a time.

    A batch whose vectors are not all finite is embedded once more; components
    that still are not become 0.
    """
    names = [c for c in pages.columns if c != image_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != image_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i in range(0, len(pdf), batch):
                images = [bytes(x) for x in pdf[image_col].iloc[i : i + batch]]
                found = retried(lambda images=images: adapter.embed_images(images))
                if any(finite(v) != list(v) for vectors in found for v in vectors):
                    found = adapter.embed_images(images)
                for at, vectors in enumerate(found):
                    keys = [pdf[c].iloc[i + at] for c in names]
                    rows += [(*keys, n, finite(v)) for n, v in enumerate(vectors)]
            yield pd.DataFrame(rows, columns=[*names, "vector_index", "embedding"])

    return pages.mapInPandas(run, f"{kinds}, vector_index int, embedding array<float>")
