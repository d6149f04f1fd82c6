"""Action lists, folded into one plan: transforms of reads, split registers, and commands run over blocks of lines."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import paths, records, trees
from strandlake.plans.tables import written
from strandlake.sources import matrices, newick

READ_ACTIONS = {
    "match": records.match, "rename": records.rename, "revcom": records.reverse_complement, "dropq": records.drop_qualities,
    "lint": records.lint, "compact": records.compact, "expand": records.expand,
}


def run_reads(reads: DataFrame, actions: Iterable[tuple]) -> DataFrame:
    """Reads through actions (name, *arguments), in order; nothing runs until the result is asked for."""
    for name, *args in actions:
        if name not in READ_ACTIONS:
            raise ValueError(f"unknown action {name!r}")
        reads = READ_ACTIONS[name](reads, *args)
    return reads


class Register:
    """A split register with the actions of the tree program."""

    def __init__(self, splits: DataFrame | None = None):
        self.splits, self.dropped = splits, None

    def add(self, splits: DataFrame) -> Register:
        self.splits = splits.select("mask", "weight") if self.splits is None else trees.merge_splits(self.splits, splits)
        return self

    def clear(self) -> Register:
        self.splits = self.dropped = None
        return self

    def drop_below(self, cutoff: float) -> Register:
        self.dropped, self.splits = self.splits.where(F.col("weight") < cutoff), trees.drop_below(self.splits, cutoff)
        return self


def run_command(lines: DataFrame, command: list[str], block: int = 10_000, column: str = "value") -> DataFrame:
    """The output lines of a command fed with blocks of lines; a non-zero exit is an error. Blocks are a partition's rows in
    their order, so a file's lines stay in order within it."""

    def run(batches):
        held: list[str] = []

        def flush(part: list[str]) -> pd.DataFrame:
            done = subprocess.run(command, input="".join(x + "\n" for x in part), capture_output=True, text=True)
            if done.returncode:
                raise RuntimeError(f"{command[0]} exited with {done.returncode}: {done.stderr[-500:]}")
            return pd.DataFrame({"value": pd.Series(done.stdout.splitlines(), dtype=object)})

        for pdf in batches:
            held += pdf[column].tolist()
            while len(held) >= block:
                yield flush(held[:block])
                held = held[block:]
        if held:
            yield flush(held)

    return lines.select(column).mapInPandas(run, "value string")


def cophenetic(spark: SparkSession, source: str, target: str, digits: int = 15) -> None:
    """The matrix of distances between the leaves of the tree in a text (one tree, over any lines), as tab-separated lines.

    Several trees are an error: a matrix has names once."""
    text = spark.read.text(source, wholetext=True).select(F.lit(0).cast("long").alias("tree_id"), "value")
    nodes = written(newick.read_trees(text), "cophenetic")
    if nodes.where("parent_idx < 0").count() != 1:
        raise ValueError("one tree is needed")
    matrices.write_matrix(paths.cophenetic(nodes).select("row", "col", "value"), target, digits)
