"""What the operators of this package share: scratch tables and text helpers."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.plans.scratch import bounded, discard, scratch_path, stash

__all__ = ["bounded", "discard", "scratch_path", "stash"]

#: A word of the word-count contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)).cast("int")


def uniform(seed: int, *cols: Column) -> Column:
    """A double in (0, 1) that depends on the seed and the columns alone: 52 bits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def slices(batch: pa.RecordBatch, column: str, rows: int = 1000, size: int = 4 << 20):
    """Cut a batch so that no slice has more than so many rows or, but for single long texts, bytes."""
    text = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at, n = 0, batch.num_rows
    while at < n:
        done = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, done + size, "right"))), n)
        yield batch.slice(at, to - at)
        at = to


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, A-Z lowered, and where each text's words begin (one more entry than texts).

    Words are runs of anything but the six ASCII white-space bytes; a null text has none.
    """
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    return split_words(plain)


def split_words(plain: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Split texts without white space at their ends."""
    lists = pc.ascii_split_whitespace(plain)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    empty = pc.binary_length(plain).to_numpy(zero_copy_only=False) == 0
    if empty.any():  # the split of an empty text is one empty word
        starts = np.concatenate(([0], np.cumsum(counts)))
        keep = np.ones(len(flat), bool)
        keep[starts[:-1][empty]] = False
        flat = flat.filter(pa.array(keep))
        counts = np.where(empty, 0, counts)
    return flat, np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shared_write(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array as a .npy file into a shared folder; a second try of the same task replaces it whole."""
    if (local := _local(folder)) is not None:
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            np.save(out, array)
        os.replace(part, f"{local}/{name}.npy")
        return
    store, path = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        np.save(out, array)
    store.move(part, f"{path}/{name}.npy")


_fetched: dict[str, np.ndarray] = {}


def shared_array(folder: str, name: str) -> np.ndarray | None:
    """Map an array of a shared folder into memory; None where there is none.

    A folder that isn't mounted is read through its file system into a temporary file first, which has no name
    once it is mapped, so that its space is free with the mapping. A worker keeps the maps of one folder.
    """
    key = f"{folder}/{name}"
    if key not in _fetched:
        for other in [k for k in _fetched if not k.startswith(f"{folder}/")]:
            del _fetched[other]
        if (local := _local(folder)) is not None:
            if not os.path.exists(path := f"{local}/{name}.npy"):
                return None
            _fetched[key] = np.load(path, mmap_mode="r")
        else:
            store, remote = pa.fs.FileSystem.from_uri(f"{key}.npy")
            if store.get_file_info(remote).type == pa.fs.FileType.NotFound:
                return None
            with tempfile.NamedTemporaryFile(suffix=".npy") as copy:
                with store.open_input_stream(remote) as source:
                    shutil.copyfileobj(source, copy)
                copy.flush()
                _fetched[key] = np.load(copy.name, mmap_mode="r")
    return _fetched[key]


def _local(folder: str) -> str | None:
    parts = urlparse(folder)
    return parts.path if parts.scheme in ("", "file") else None


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside remove their shuffle files when they end, not when the driver
    happens to collect its garbage. Each must be run once."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was) if was is not None else spark.conf.unset(_CLEANUP)


Batches = Iterator[pa.RecordBatch]


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, which gives freed memory back to the system when a task's rows are done.

    Workers outlive their tasks and are used again by other stages; what the allocators hold would add up.
    """

    def task(batches: Batches) -> Batches:
        yield from run(batches)
        _give_back()

    return task


def frugal_group(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """The same for a function of groups, after each group."""

    def group(key: tuple, table: pa.Table) -> pa.Table:
        out = run(key, table)
        _give_back()
        return out

    return group


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)
