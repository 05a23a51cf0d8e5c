"""Splitting, semantic merging, perceptual de-duplication and batching.

These depend on the order of rows inside one file or tenant buffer, so each
works on such a group by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..params import DEFAULT, Params
from ..sources import places, tables


def split_text(text: str, p: Params = DEFAULT) -> list[str]:
    """Pieces of at most chunk_size characters with some overlap, cut at the first separator that helps."""
    out: list[str] = []

    def pack(pieces: list[str]) -> None:
        """Greedy windows over small pieces; what a window shares with the next is at most the overlap."""
        first, size = 0, 0
        for k, piece in enumerate(pieces):
            if size + len(piece) > p.chunk_size and k > first:
                out.append("".join(pieces[first:k]))
                while first < k and (size > p.chunk_overlap or size + len(piece) > p.chunk_size):
                    size -= len(pieces[first])
                    first += 1
            size += len(piece)
        if first < len(pieces):
            out.append("".join(pieces[first:]))

    def cut(part: str, separators: tuple[str, ...]) -> None:
        at = next((i for i, s in enumerate(separators) if s == "" or s in part), len(separators) - 1)
        sep, finer = separators[at], separators[at + 1 :]
        if sep:
            head, *rest = part.split(sep)
            pieces = [x for x in (head, *(sep + r for r in rest)) if x]
        else:
            pieces = list(part)
        small: list[str] = []
        for piece in pieces:
            if len(piece) < p.chunk_size:
                small.append(piece)
                continue
            pack(small)
            small = []
            if finer:
                cut(piece, finer)
            else:
                out.append(piece)
        pack(small)

    cut(text, p.separators)
    return [s for s in (x.strip() for x in out) if s]


def split_chunks(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """pages: (user_id, md5, page, text). One row a chunk with its index across the file and its id."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, p) if t else [])

    tables.text_batches(pages.sparkSession)
    rows = pages.select("user_id", "md5", "page", F.posexplode(pieces("text")).alias("n", "text"))
    w = Window.partitionBy("user_id", "md5").orderBy("page", "n")
    rows = rows.withColumn("chunk_index", F.row_number().over(w) - 1)
    return rows.select("user_id", "md5", "page", "chunk_index", tx.chunk_id(F.col("user_id"), F.col("md5"), F.col("chunk_index"), p).alias("chunk_id"), "text")


def merge_chunks(chunks: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """chunks: (file_id, seq, text, page, image_paths, embedding). Neighbours that are alike become one.

    The current chunk takes in the next while both fit into merge_max_len and
    the cosine of its centre and the next is above merge_threshold; its centre
    then is the mean of the two. Pages become ranges, images a distinct list.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        groups: list[list[int]] = []
        centre, size = None, 0
        for i, (text, e) in enumerate(zip(pdf["text"], pdf["embedding"], strict=True)):
            e = np.asarray(e, float)
            if groups and size + len(text) <= p.merge_max_len:
                cos = float(centre @ e) / (np.linalg.norm(centre) * np.linalg.norm(e) + 1e-9)
                if cos > p.merge_threshold:
                    groups[-1].append(i)
                    centre, size = (centre + e) / 2, size + len(text)
                    continue
            groups.append([i])
            centre, size = e, len(text)
        rows = []
        for n, g in enumerate(groups):
            own = pdf.iloc[g]
            paths = list(dict.fromkeys(x for images in own["image_paths"] if images is not None for x in images))
            rows.append((own["file_id"].iloc[0], n, "".join(own["text"]), [int(x) for x in own["page"].dropna()], paths, len(g)))
        return pd.DataFrame(rows, columns=["file_id", "seq", "text", "pages", "image_paths", "n_merged"])

    merged = chunks.groupBy("file_id").applyInPandas(run, "file_id long, seq int, text string, pages array<int>, image_paths array<string>, n_merged int")
    return merged.select("file_id", "seq", "text", tx.page_ranges(F.col("pages")).alias("page_range"), "image_paths", (F.size("image_paths") > 0).alias("has_images"), "n_merged")


def phash_groups(images: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """images: (file_id, seq, hash long or null). rep_seq: the first image within the distance, first come first served; null hashes stand alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        firsts: list[tuple[int, int]] = []
        reps = []
        for seq, text in zip(pdf["seq"], pdf["hash"], strict=True):
            if text is None:
                reps.append(seq)
                continue
            h = int(text)
            found = next((s for s, f in firsts if ((h ^ f) & (2**64 - 1)).bit_count() <= p.hash_distance), None)
            if found is None:
                firsts.append((seq, h))
                found = seq
            reps.append(found)
        return pd.DataFrame({"file_id": pdf["file_id"], "seq": pdf["seq"], "rep_seq": reps})

    # as text: a column of longs with nulls would pass pandas as floating point, which has no room for 64 bits
    return images.select("file_id", "seq", F.col("hash").cast("string").alias("hash")).groupBy("file_id").applyInPandas(run, "file_id long, seq int, rep_seq int")


def batch_numbers(items: Column, p: Params = DEFAULT) -> Column:
    """array<struct<seq, n_chunks, n_chars>> in order, with the batch of each: a batch closes behind the item that fills it."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"))

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        n, c = a["n"] + x["n_chunks"], a["c"] + x["n_chars"]
        full = (n >= p.batch_count) | (c >= p.batch_chars)
        after = F.struct(F.when(full, a["batch"] + 1).otherwise(a["batch"]).alias("batch"), F.when(full, 0).otherwise(n).cast("long").alias("n"), F.when(full, 0).otherwise(c).cast("long").alias("c"))
        return after, F.struct(x["seq"].cast("long").alias("seq"), a["batch"].alias("batch"))

    return tx.scan(items, start, step, "struct<seq:bigint,batch:int>")


def next_starts(n: np.ndarray, c: np.ndarray, p: Params) -> np.ndarray:
    """For a batch that starts before each item of a range: the item behind the one that fills it, or -1 if the range ends first."""
    total_n, total_c = np.cumsum(n), np.cumsum(c)
    end = np.minimum(np.searchsorted(total_n, total_n - n + p.batch_count), np.searchsorted(total_c, total_c - c + p.batch_chars))
    return np.where(end < len(n), end + 1, -1)


def range_map(n: np.ndarray, c: np.ndarray, p: Params) -> pd.DataFrame:
    """What a range of items does to a batch that is open when it begins: rows (n, c, closed, open_n, open_c) in order.

    The batch is filled by the first row of which n or c, what came since the
    range began, is enough for it; closed is how many batches end in the range
    then, and open_n and open_c what the last one left open has. The last row
    is the whole range, for a batch that isn't filled in it (closed 0). Starts
    jump to the next start, twice as far in each round.
    """
    k = len(n)
    total_n, total_c = np.cumsum(n), np.cumsum(c)
    start = next_starts(n, c, p)
    jump = np.r_[np.where(start >= 0, start, np.arange(k)), k]
    closed = np.r_[(start >= 0).astype(np.int64), 0]
    while (jump[jump] != jump).any():
        closed, jump = closed + closed[jump], jump[jump]
    before_n, before_c = np.r_[0, total_n], np.r_[0, total_c]
    # the items up to the one that fills even an empty batch, of equal totals the first
    size = min(k, 1 + min(np.searchsorted(total_n, p.batch_count), np.searchsorted(total_c, p.batch_chars)))
    head = np.flatnonzero(np.r_[True, (n[1:size] > 0) | (c[1:size] > 0)])
    last = jump[head + 1]
    rows = {"n": total_n[head], "c": total_c[head], "closed": 1 + closed[head + 1], "open_n": total_n[-1] - before_n[last], "open_c": total_c[-1] - before_c[last]}
    out = pd.DataFrame(rows)
    out.loc[len(out)] = [total_n[-1], total_c[-1], 0, 0, 0]
    return out.astype("int64")


def through_range(rows: pd.DataFrame, n: int, c: int, p: Params) -> tuple[int, int, int]:
    """(batches closed, n, c) behind a range, for a batch with n and c before it."""
    fills = np.flatnonzero((rows["n"].to_numpy()[:-1] + n >= p.batch_count) | (rows["c"].to_numpy()[:-1] + c >= p.batch_chars))
    if not len(fills):
        whole = rows.iloc[-1]
        return 0, n + int(whole["n"]), c + int(whole["c"])
    at = rows.iloc[fills[0]]
    return int(at["closed"]), int(at["open_n"]), int(at["open_c"])


def assign_batches(items: DataFrame, p: Params = DEFAULT, range_items: int = 100_000) -> DataFrame:
    """items: (user_id, seq, n_chunks, n_chars). user_id, seq, batch: the batch of each item, in order; a batch closes behind the item that fills it.

    A tenant's items are dealt to ranges. Each range tells what it does to a
    batch that is open before it, by some rows; only these pass one task for
    each tenant, which tells every range what it begins with, and ranges number
    their own items. Counts are 0 or more, null counts 0; a null tenant is a
    tenant; items of equal seq stand in any order.
    """
    spark = items.sparkSession
    rows = items.select("user_id", F.col("seq").cast("long"), *[F.greatest(F.coalesce(F.col(x).cast("long"), F.lit(0)), F.lit(0)).alias(x) for x in ("n_chunks", "n_chars")])
    ranges = max(1, -(-rows.count() // range_items))
    path = places.fresh(spark, "batches")
    rows.repartitionByRange(ranges, F.coalesce("user_id", F.lit("")), "user_id", "seq").withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(f"{_ddl(rows)}, part int").parquet(path)

    def told(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        out = range_map(pdf["n_chunks"].to_numpy(), pdf["n_chars"].to_numpy(), p)
        return out.assign(user_id=key[0], part=key[1], place=range(len(out)))[["user_id", "part", "place", *out.columns[:5]]]

    def chained(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        batch, n, c, out = 0, 0, 0, []
        for part, own in pdf.sort_values(["part", "place"]).groupby("part"):
            out.append((key[0], part, batch, n, c))
            closed, n, c = through_range(own, n, c, p)
            batch += closed
        return pd.DataFrame(out, columns=["user_id", "part", "batch", "n", "c"])

    def numbered(own: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("seq", kind="stable")
        n, c = own["n_chunks"].to_numpy(copy=True), own["n_chars"].to_numpy(copy=True)
        batch, n[0], c[0] = int(begin["batch"].iloc[0]), n[0] + begin["n"].iloc[0], c[0] + begin["c"].iloc[0]
        start, at, opens = next_starts(n, c, p), 0, []
        while 0 <= at < len(n):
            opens.append(at)
            at = int(start[at])
        first = np.zeros(len(n), np.int64)
        first[opens[1:]] = 1
        return pd.DataFrame({"user_id": own["user_id"], "seq": own["seq"], "batch": batch + np.cumsum(first)})

    maps = dealt.groupBy("user_id", "part").applyInPandas(told, "user_id string, part int, place int, n long, c long, closed long, open_n long, open_c long")
    begins = maps.groupBy("user_id").applyInPandas(chained, "user_id string, part int, batch long, n long, c long")
    return dealt.groupBy("user_id", "part").cogroup(begins.groupBy("user_id", "part")).applyInPandas(numbered, "user_id string, seq long, batch int")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
