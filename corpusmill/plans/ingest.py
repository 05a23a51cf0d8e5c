"""The ingestion plan: fingerprint, de-duplicate, clean, split, annotate, batch, store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, management, uploads
from ..params import DEFAULT, Params
from ..sources import tables
from ..sources.store import Change, State, Store


def ingest(files: DataFrame, ledger: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """files: (user_id, file_id, original_filename, text). (chunks, new ledger rows) of the files that are new and not empty after cleaning."""
    fresh = uploads.new_files(files.withColumn("md5", F.md5("text")), ledger)
    pages = fresh.withColumn("text", tx.clean(F.col("text")) if p.clean_text else F.col("text")).where(F.col("text").isNotNull()).withColumn("page", F.lit(1))
    chunks = chunking.split_chunks(pages, p)
    names = pages.select("user_id", "md5", "original_filename")
    rows = names.withColumn("filename", F.col("original_filename"))
    return chunks.join(names, ["user_id", "md5"]), rows


def open_store(spark: SparkSession, root: str) -> Store:
    """Chunks, ledger and images of all tenants, which change together."""
    return Store(spark, root, {"chunks": ("user_id", "md5", "chunk_id"), "ledger": ("user_id", "md5"), "images": ("user_id", "md5")})


def record(store: Store, chunks: DataFrame, rows: DataFrame, transaction: tuple[str, int] | None = None) -> int:
    """Make the chunks of new documents and their ledger rows visible in one version, beside what is there.

    If any of both fails to be written, or the job is killed, the store stays
    as it was. Documents that another upload has recorded in the meantime are
    left out, so that an upload that is replayed, or races with another,
    leaves one copy. Both tables need (user_id, md5).
    """
    written: dict[str, tuple] = {}
    seen: list[int] = []

    def work(state: State) -> Change | None:
        if store.done(state, transaction):
            return None
        # on what another writer left the files are written anew, unless the ledger is as before
        ledger = sorted(f.path for f in state.of("ledger"))
        if not written or seen != ledger:
            seen[:] = ledger
            known = store.read("ledger", state).select("user_id", "md5").distinct() if "ledger" in state.schemas else None
            fresh = lambda df: df if known is None else df.join(known, ["user_id", "md5"], "left_anti")
            written.update({"chunks": store.write("chunks", fresh(chunks)), "ledger": store.write("ledger", fresh(rows))})
        nothing = not any(files for files, _ in written.values()) and set(written) <= set(state.schemas)
        return None if nothing and transaction is None else store.added(state, written, transaction)

    return store.commit(work)


def upload(store: Store, files: DataFrame, p: Params = DEFAULT, transaction: tuple[str, int] | None = None) -> int:
    """The whole plan for files (user_id, file_id, original_filename, text): the version in which their chunks and ledger rows are there."""
    state = store.state()
    ledger = store.read("ledger", state) if "ledger" in state.schemas else tables.empty(store.spark, "user_id string, md5 string")
    return record(store, *ingest(files, ledger.select("user_id", "md5"), p), transaction)


def remove(store: Store, gone: DataFrame) -> int:
    """Deletion of documents (user_id, md5), or of tenants (user_id): chunks, ledger and images in one version; a table that isn't there has nothing to delete."""
    have = store.state().schemas
    return store.delete({t: gone for t in ("chunks", "ledger", "images") if t in have})


def merge_into(store: DataFrame, chunks: DataFrame) -> DataFrame:
    return management.upsert(store, chunks, ["chunk_id"])
