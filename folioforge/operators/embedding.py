"""Text to vectors: encoders, batched encoding, and embedding by way of the vector cache."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import fixed_values as fv
from folioforge.operators.vector_cache import EmbeddingCache


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


def embedding_model(model_key: str) -> dict:
    if model_key not in fv.EMBEDDING_MODELS:
        raise ValueError(f"Unknown model: {model_key}. Available: {list(fv.EMBEDDING_MODELS)}")
    return fv.EMBEDDING_MODELS[model_key]


def embedding_models() -> list[str]:
    """Keys of the catalog, in its order."""
    return list(fv.EMBEDDING_MODELS)


def model_dimension(model_key: str) -> int:
    """Length of the vectors of a catalog model, known without loading it."""
    return embedding_model(model_key)["dimension"]


def encoder_dimension(make_encoder: Callable[[], Encoder]) -> int:
    """Length of the vectors of any encoder: what it says of itself, else measured once."""
    encoder = make_encoder()
    stated = getattr(encoder, "dimension", None)
    return int(stated) if stated is not None else int(np.asarray(encoder.encode([""])).shape[1])


def sentence_encoder(model_key: str = "bge-small", normalize: bool = False) -> Callable[[], Encoder]:
    """Factory of a catalog model; the model is loaded once per Python worker."""
    name = embedding_model(model_key)["name"]

    def load() -> Encoder:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)

        class _Model:
            def encode(self, texts: list[str]) -> np.ndarray:
                return model.encode(
                    texts,
                    show_progress_bar=False,
                    convert_to_numpy=True,
                    normalize_embeddings=normalize,
                )

        return _Model()

    return load


#: Tokens that a Python worker remembers, some 400 bytes each.
REMEMBERED = 1 << 15


#: What parts the tokens of a text without other characters than ASCII.
_APART = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})
_TOKEN = re.compile(r"[^\W_]+")


@lru_cache(maxsize=REMEMBERED)
def _token_hash(token: str) -> int:
    """The first 33 bits of the digest: 32 that give the position, and one for the sign."""
    h = hashlib.md5(token.encode()).digest()
    return int.from_bytes(h[:4], "big") << 1 | h[4] >> 7


def _tokens(text: str) -> list[str]:
    text = text.lower()
    return text.translate(_APART).split() if text.isascii() else _TOKEN.findall(text)


class HashingEncoder:
    """Deterministic stand-in where no model can be loaded: signed token hashing."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            tokens = _tokens(text)
            if tokens:
                hashed = np.fromiter(map(_token_hash, tokens), np.int64, len(tokens))
                out[i] = np.bincount((hashed >> 1) % self.dimension, 1 - 2 * (hashed & 1), self.dimension)
        return out


def _lists(matrix: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as Arrow lists of single precision."""
    n, dimension = matrix.shape
    offsets = np.arange(n + 1, dtype=np.int32) * dimension
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix.astype("float32").ravel()))


def encode_column(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Encoder],
    out: str = "embedding",
    batch_size: int = 32,
) -> DataFrame:
    """Add vectors; the encoder is built once per task and fed ``batch_size`` texts."""

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        for texts in batches:
            values = texts.fill_null("").to_pylist()
            # Matrices become lists as they are, not vector by vector.
            lists = [_lists(encoder.encode(values[i : i + batch_size])) for i in range(0, len(values), batch_size)]
            yield pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.float32()))

    # Declared not deterministic, so that Spark never encodes a text twice to push a filter.
    return df.withColumn(out, encode.asNondeterministic()(F.col(text)))


def embed_chunks(
    chunks: DataFrame,
    make_encoder: Callable[[], Encoder],
    cache: EmbeddingCache | None = None,
    batch_size: int = 32,
) -> DataFrame:
    """Chunks with their ``embedding``; only texts without a cached vector are encoded.

    New vectors are appended to the cache before they are used, so an interrupted run
    loses at most the running job and the next one starts from what is there.
    """
    if cache is None:
        return encode_column(chunks, "content", make_encoder, batch_size=batch_size)
    cache.add(encode_column(cache.misses(chunks), "content", make_encoder, batch_size=batch_size))
    joined = cache.keyed(chunks).join(cache.table(), "cache_key", "left")
    lost = F.raise_error(F.concat(F.lit("No vector for chunk "), F.coalesce("id", F.lit("?"))))
    vector = F.coalesce("embedding", lost.cast("array<float>"))
    return joined.withColumn("embedding", vector).drop("cache_key")


def embedding_rows(chunks: DataFrame) -> DataFrame:
    """Embedded chunks in the layout of ``schemas.EMBEDDING``."""
    return chunks.select(
        F.col("id").alias("chunk_id"),
        "book_title",
        "page_number",
        "chunk_index",
        "content",
        "embedding",
        F.coalesce(F.size("embedding"), F.lit(0)).alias("embedding_dim"),
    )
