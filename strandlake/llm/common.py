"""What the corpus operators share: row keys, bounds of workers, hashes of stretches of bytes; written tables and components are the library's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.plans.tables import components as connected_components  # noqa: F401
from strandlake.plans.tables import new_path, remove, shared_folder, written  # noqa: F401

#: Code points that separate words and that are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def identity(seed: int = 0) -> Column:
    """128 bits of hash of a row's doc_id and text, as a struct (a, b): rows that repeat both are the same to it, others are not."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(0x5EED + seed), "doc_id", "text").alias("b"))


def read_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bounds what a Python worker holds at once by bytes, not by rows alone: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def _kept() -> dict:
    import sys
    import types

    return sys.modules.setdefault("_strandlake_worker", types.ModuleType("_strandlake_worker")).__dict__.setdefault("kept", {})


def kept_in_worker(key, make):
    """make(), or what it made before for this key in this worker process: workers outlive tasks, and what is kept here
    (caches of pure functions, bounded by themselves) saves later tasks from starting cold. Only the last key is kept."""
    kept = _kept()
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def forget_kept() -> None:
    """Frees what another operator kept in this worker process."""
    _kept().clear()


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores added if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, list[np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i < n."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        inverse = pow(base, -1, 1 << 64)
        held = _powers[base] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, 1 << 16) - 1, x, np.uint64))) for x in (base, inverse)]
    return held[0][:n], held[1][:n]


def stretch_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64 bits of hash of each codes[start:end], by prefix sums of a polynomial: a hash does not depend on what is around."""
    up, down = _powers_of(_BASES[which], len(codes) + 1)
    sums = np.append(np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1]))
    x = (sums[end] - sums[start]) * down[start]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
