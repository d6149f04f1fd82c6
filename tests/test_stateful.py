"""Streams give what batches give, after a restart from the checkpoint too."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import graph, splits, statistics
from strandlake.streaming import stateful


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))


def read(spark, folder, columns, stream):
    raw = (spark.readStream if stream else spark.read).schema("value string").text(str(folder))
    p = F.split("value", "\t")
    return raw.select(*(p[i].cast(kind).alias(name) for i, (name, kind) in enumerate(columns)))


def test_classes_after_restarts(spark, tmp_path):
    rng = random.Random(1)
    columns = [("line", "long"), ("element", "string")]
    lines = list(range(60))
    rng.shuffle(lines)  # smaller lines may come later
    for part in range(2):
        put(tmp_path / "in", f"{part}.tsv", [(n, f"e{rng.randrange(150)}") for n in lines[30 * part : 30 * part + 30] for _ in range(rng.randint(1, 4))])
        held = stateful.ClassStream(spark, f"file://{tmp_path}/state")
        held.start(read(spark, tmp_path / "in", columns, True), f"file://{tmp_path}/check").awaitTermination()
        want = graph.equivalence_classes(read(spark, tmp_path / "in", columns, False))
        key = ["class", "element", "first_line"]
        assert sorted(map(tuple, held.classes().select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    # a batch that is run again changes nothing
    before = sorted(map(tuple, held.classes().collect()))
    last = held._versions()[-1]
    held.update(read(spark, tmp_path / "in/1.tsv", columns, False), last)
    assert sorted(map(tuple, held.classes().collect())) == before
    held.update(read(spark, tmp_path / "in", columns, False).limit(0), last + 1)
    assert sorted(map(tuple, held.classes().collect())) == before


@pytest.mark.parametrize("kind", ["moments", "weights"])
def test_sums_after_restarts(spark, tmp_path, kind):
    rng = random.Random(2)
    columns = [("g", "int"), ("x", "double")]

    def result(df):
        if kind == "moments":
            return stateful.stream_moments(df, "x", "g") if df.isStreaming else statistics.online(df, "x", "g")
        packed = df.select(splits.canonical(splits.pack(F.array("g"), 70), 70).alias("mask"), F.col("x").alias("weight"))
        return stateful.stream_split_weights(packed) if df.isStreaming else splits.merge(packed)

    for part in range(3):
        put(tmp_path / "in", f"{part}.tsv", [(rng.randrange(70), rng.randrange(-20, 20) / 4) for _ in range(200)])
        stream = result(read(spark, tmp_path / "in", columns, True))
        name = f"running_{kind}"
        stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        rows = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
        assert rows(spark.table(name)) == rows(result(read(spark, tmp_path / "in", columns, False)))
