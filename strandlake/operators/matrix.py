"""Labelled matrices in long form: (row, col, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.statistics import ranged
from strandlake.plans.tables import written


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def merge_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of both; the same column names are required, and a row name in both is an error."""
    both = a.select("row", "col", "value", F.lit(0).alias("__m")).unionByName(b.select("row", "col", "value", F.lit(1).alias("__m")))
    # each column of a non-empty operand must be in the other one, and each cell is there once
    cells = both.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
    names = both.groupBy("col").agg(F.count_distinct("__m").alias("k"))
    full = F.broadcast(both.agg(F.count_distinct("__m").alias("__both")))
    lone = names.crossJoin(full).where("k < __both").limit(1).select(F.lit(True).alias("__lone"))
    ok = cells.join(F.broadcast(lone), F.lit(True), "left")
    fault = F.when(F.col("__lone"), "column names differ").when(F.col("n") > 1, "a row name is in both")
    return ok.select("row", "col", F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("value")).alias("value"))


def _checked(df: DataFrame, a: DataFrame, b: DataFrame, what: str, covered: bool = False) -> DataFrame:
    """df, which is an error if the names a and b (one column each) differ, or, if covered, if b has one that a lacks."""
    named = a.toDF("k").distinct().withColumn("__a", F.lit(1)).join(b.toDF("k").distinct().withColumn("__b", F.lit(1)), "k", "full_outer")
    # one row, whatever the matrices
    lone = F.broadcast(named.agg(F.coalesce(F.bool_or(F.col("__a").isNull() if covered else F.col("__a").isNull() | F.col("__b").isNull()), F.lit(False)).alias("__lone")))
    value = F.when(F.col("__lone"), F.raise_error(F.lit(what)).cast("double")).otherwise(F.col("value"))
    return df.crossJoin(lone).withColumn("value", value).drop("__lone")


def times_vector(m: DataFrame, v: DataFrame, sparse: bool = False) -> DataFrame:
    """(row, value): the matrix times v (col, value). Entries that a sparse v lacks are 0; else v has all columns. An entry
    that is no column is an error."""
    out = m.join(v.select("col", F.col("value").alias("__v")), "col", "left").groupBy("row").agg(F.sum(F.col("value") * F.coalesce("__v", F.lit(0.0))).alias("value"))
    return _checked(out, m.select("col"), v.select("col"), "the vector's entries are not the matrix's columns", sparse)


#: Rows and columns of a tile.
TILE = 256


def _numbered(**names: DataFrame) -> dict[str, DataFrame]:
    """For each frame of one column, its distinct values (name) and their numbers from 0 (number), in order; written."""
    every = None
    for kind, x in names.items():
        x = x.toDF("name").select(F.lit(kind).alias("kind"), "name")
        every = x if every is None else every.unionByName(x)
    numbers = written(ranged(every.distinct(), F.asc("name"), F.lit(1).cast("long"), "kind").select("kind", "name", F.col("__before").alias("number")), "names")
    return {kind: numbers.where(F.col("kind") == kind).drop("kind") for kind in names}


def _tiles(m: DataFrame, rows: DataFrame, cols: DataFrame, size: int) -> DataFrame:
    """i, j, r, c, v: a row for each tile that has cells, with arrays of their places in it and their values."""
    x = m.where("value is not null").select("row", "col", F.col("value").cast("double").alias("value")).join(rows, "row").join(cols, "col")
    cell = F.struct((F.col("__r") % size).cast("int").alias("r"), (F.col("__c") % size).cast("int").alias("c"), F.col("value").alias("v"))
    x = x.groupBy(F.floor(F.col("__r") / size).alias("i"), F.floor(F.col("__c") / size).alias("j")).agg(F.collect_list(cell).alias("x"))
    return x.select("i", "j", F.col("x.r").alias("r"), F.col("x.c").alias("c"), F.col("x.v").alias("v"))


def _dense(r, c, v, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A tile's values and which of its cells are there."""
    out, there = np.zeros((size, size)), np.zeros((size, size), bool)
    with np.errstate(invalid="ignore"):
        np.add.at(out, (r, c), v)
    there[r, c] = True
    return out, there


def _tile_product(a, a_there, b, b_there) -> tuple[np.ndarray, np.ndarray]:
    """The product of two tiles, and which of its cells have a term. Cells that are not there give no term, even with infinities."""
    met = a_there.astype(np.float32) @ b_there.astype(np.float32) > 0
    if np.isfinite(a).all() and np.isfinite(b).all():
        return a @ b, met
    out = np.empty(a.shape)
    with np.errstate(invalid="ignore"):
        for i in range(len(a)):
            out[i] = np.where(a_there[i][:, None] & b_there, a[i][:, None] * b, 0.0).sum(axis=0)
    return out, met


def _partial_products(size: int, held_tiles: int = 64):
    """Sums of the tile products of a task; what is held is handed on when it is more than held_tiles tiles."""

    def flush(held):
        return pd.DataFrame([(i, j, x.ravel(), m.ravel()) for (i, j), (x, m) in held.items()], columns=["i", "j", "v", "met"])

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, m = _tile_product(*_dense(r.a_r, r.a_c, r.a_v, size), *_dense(r.b_r, r.b_c, r.b_v, size))
                before = held.get((r.i, r.j))
                held[r.i, r.j] = (x, m) if before is None else (before[0] + x, before[1] | m)
                if len(held) >= held_tiles:
                    yield flush(held)
                    held = {}
        if held:
            yield flush(held)

    return run


def _summed_tiles(size: int):
    """Cells of the sums of neighbouring rows of a tile: one tile is held at a time."""

    def cells(key, x, m):
        r, c = np.nonzero(m.reshape(size, size))
        # as Arrow: a NaN of a data frame would become a null
        return pa.record_batch([pa.array(key[0] * size + r), pa.array(key[1] * size + c), pa.array(x.reshape(size, size)[r, c])], ["__r", "__c", "value"])

    def run(batches):
        key = x = m = None
        for batch in batches:
            for t in batch.to_pandas().itertuples(index=False):
                if key == (t.i, t.j):
                    x, m = x + t.v, m | t.met
                    continue
                if key is not None:
                    yield cells(key, x, m)
                key, x, m = (t.i, t.j), np.asarray(t.v), np.asarray(t.met, bool)
        if key is not None:
            yield cells(key, x, m)

    return run


def times_matrix(a: DataFrame, b: DataFrame, size: int = TILE) -> DataFrame:
    """(row, col, value): a's columns meet b's rows by name, which must be the same. A cell is there if it has a term.

    Names are numbered and cells dealt to tiles of size * size; tiles meet at their inner number, so what is joined is smaller
    than cells meeting cells by the tile's area. A task sums the products of the tiles that it sees before it hands them
    on, so a small product of long matrices is no hot key; sums of a tile go through a task one after another.
    """
    number = _numbered(rows=a.select("row"), cols=b.select("col"), inner=a.select("col"))
    named = lambda kind, name, key: number[kind].select(F.col("name").alias(name), F.col("number").alias(key))
    left = _tiles(a, named("rows", "row", "__r"), named("inner", "col", "__c"), size).select("i", F.col("j").alias("k"), *(F.col(x).alias(f"a_{x}") for x in "rcv"))
    right = _tiles(b, named("inner", "row", "__r"), named("cols", "col", "__c"), size).select("j", F.col("i").alias("k"), *(F.col(x).alias(f"b_{x}") for x in "rcv"))
    parts = left.join(right, "k").select("i", "j", *(f"{of}_{x}" for of in "ab" for x in "rcv")).mapInPandas(_partial_products(size), "i long, j long, v array<double>, met array<boolean>")
    sums = parts.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_summed_tiles(size), "__r long, __c long, value double")
    out = sums.join(named("rows", "row", "__r"), "__r").join(named("cols", "col", "__c"), "__c").select("row", "col", "value")
    return _checked(out, a.select("col"), b.select("row"), "columns and rows have different names")


def from_vectors(df: DataFrame, row: str, vector: str) -> DataFrame:
    return df.select(F.col(row).cast("string").alias("row"), F.posexplode(vector).alias("i", "value")).select("row", F.concat(F.lit("c"), F.col("i").cast("string")).alias("col"), F.col("value").cast("double").alias("value"))


def wide(m: DataFrame) -> DataFrame:
    """row, cells: values in the order of their columns' names."""
    return m.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]).alias("cells"))
