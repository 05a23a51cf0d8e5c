"""Where models come in: each is a Column function, with a deterministic default where there is no model."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


class Embedder(Protocol):
    """Vectors of texts, called with at most a batch of them."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Captioner(Protocol):
    """Descriptions of images given as bytes; None where there is none."""

    def __call__(self, images: list[bytes]) -> list[str | None]: ...


class Recognizer(Protocol):
    """Lines (distance from the top, text) that stand in images given as bytes."""

    def __call__(self, images: list[bytes]) -> list[list[tuple[float, str]]]: ...


Rewriter = Callable[[Column, Column], Column]
Scorer = Callable[[Column, Column], Column]


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """Unit vectors of signed word hashes."""
    out = []
    for text in texts:
        v = np.zeros(size)
        for w in text.lower().split():
            h = zlib.crc32(w.encode())
            v[h % size] += 1 if h >> 16 & 1 else -1
        out.append((v / max(1e-9, float(np.linalg.norm(v)))).tolist())
    return out


def keep_query(query: Column, history: Column) -> Column:
    """The rewriter where there is no model."""
    return query


def patiently(call: Callable, waits: tuple[float, ...]):
    """What a call gives; one that fails is tried again after each wait, then the task is, elsewhere."""
    for wait in waits:
        try:
            return call()
        except Exception:  # whatever a model's client raises
            time.sleep(wait)
    return call()


def embed(chunks: DataFrame, embedder: Embedder = hashed_words, p: Params = DEFAULT) -> DataFrame:
    """Adds ``embedding``. The embedder is called with at most batch_count texts or batch_chars characters, batches of a task across those of Arrow, with a pause between calls."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames: list[pd.DataFrame] = []  # not yet given back, as texts of theirs still wait
        held: list[str] = []
        out: list[list[float]] = []
        called = False

        def call() -> None:
            nonlocal held, called
            if called:
                time.sleep(p.embed_pause)
            out.extend(patiently(lambda: embedder(held), p.embed_waits))
            held, called = [], True

        for pdf in batches:
            frames.append(pdf)
            size = sum(map(len, held))
            for text in pdf["text"]:
                held.append(text or "")
                size += len(held[-1])
                if len(held) >= p.batch_count or size >= p.batch_chars:
                    call()
                    size = 0
            while frames and len(out) >= len(frames[0]):
                own = frames.pop(0)
                yield own.assign(embedding=out[: len(own)])
                del out[: len(own)]
        if held:
            call()
        for own in frames:
            yield own.assign(embedding=out[: len(own)])
            del out[: len(own)]

    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return chunks.mapInPandas(run, schema)


def caption(images: DataFrame, captioner: Captioner, p: Params = DEFAULT, batch: int = 16) -> DataFrame:
    """images: (..., content binary). Adds ``caption``, null where there is none or the captioner keeps failing: an image without a description fails no file."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content, out = [bytes(c) if c is not None else b"" for c in pdf["content"]], []
            for k in range(0, len(content), batch):
                try:
                    out += patiently(lambda own=content[k : k + batch]: captioner(own), p.embed_waits)
                except Exception:  # told by the missing caption
                    out += [None] * len(content[k : k + batch])
            yield pdf.assign(caption=out)

    return images.mapInPandas(run, T.StructType([*images.schema.fields, T.StructField("caption", T.StringType())]))


def recognize(images: DataFrame, recognizer: Recognizer, p: Params = DEFAULT, batch: int = 16) -> DataFrame:
    """images: (..., content binary). Adds ``lines``, array<struct<y, text>>; empty where nothing stands or the recognizer keeps failing."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            content, out = [bytes(c) if c is not None else b"" for c in pdf["content"]], []
            for k in range(0, len(content), batch):
                try:
                    out += patiently(lambda own=content[k : k + batch]: recognizer(own), p.embed_waits)
                except Exception:  # as an image without text
                    out += [[]] * len(content[k : k + batch])
            yield pdf.assign(lines=[[{"y": float(y), "text": t} for y, t in lines] for lines in out])

    line = T.StructType([T.StructField("y", T.DoubleType()), T.StructField("text", T.StringType())])
    return images.mapInPandas(run, T.StructType([*images.schema.fields, T.StructField("lines", T.ArrayType(line))]))


def no_lines(images: list[bytes]) -> list[list[tuple[float, str]]]:
    """The recognizer where there is no model."""
    return [[] for _ in images]


def described(images: list[bytes]) -> list[str | None]:
    """The captioner where there is no model: size and digest of what is not empty."""
    return [f"{len(c)} bytes, {zlib.crc32(c):08x}" if c else None for c in images]


def caption_summary(results: DataFrame) -> DataFrame:
    """results: (file_id, caption). file_id, total, ok, degraded."""
    return results.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("caption").isNotNull()).alias("ok"), F.count_if(F.col("caption").isNull()).alias("degraded"))
