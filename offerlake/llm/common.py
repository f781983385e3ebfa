"""Helpers that several operators share: checkpoints, text keys, byte hashing in numpy."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def folder(spark: SparkSession) -> str:
    """The checkpoint folder, which every executor can read: the context's, else the one that spark.checkpoint.dir names.

    Only where neither is set is one made, and only on one machine (tests): on a cluster no other machine could read it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder; lineage ends there."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's function that gives freed memory back when the partition ends: Spark keeps its Python workers, and
    what one stage has used would else stay with them through the next ones."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return own


def fold(name: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % parts


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)


def powers(n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n, kept by the Python worker."""
    if base not in POWERS or len(POWERS[base][0]) <= n:
        size = ((n >> 18) + 1) << 18
        ones = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        for x in ones:
            x[0] = 1
        POWERS[base] = np.cumprod(ones[0]), np.cumprod(ones[1])
    return POWERS[base]


def prefix_hashes(values: np.ndarray, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes modulo 2**64: total and back, so that (total[b] - total[a]) * back[a] is the hash of values[a:b]."""
    up, back = powers(len(values), base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * MULTIPLIER * up[: len(values)], out=total[1:])
    return total, back


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns: those given, with as many underscores before them as it takes not to clash with any."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of `df` with the columns of a DDL string added, all nullable."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the folder of spark.checkpoint.dir, read again: smaller than a checkpoint, and as
    safe when executors are lost. Shuffle files of the write are let go where this Spark can do so. The table stays
    until that folder is cleared."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
