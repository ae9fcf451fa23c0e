"""Nearest group means against plain Python, and odd vectors."""

import math
import random

import pytest

from brandweave.operators import vectors as op

SCHEMA = "vec_id long, embedding array<float>, label int, size int, best string"


def brute(rows, k):
    ok = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    means = {}
    for label in {(len(r[1]), r[2]) for r in ok if r[2] is not None}:
        own = [r[1] for r in ok if (len(r[1]), r[2]) == label]
        means[label] = [sum(c) / len(own) for c in zip(*own, strict=True)]
    out = []
    for key, v, *_ in ok:
        near = sorted((-round(sum(a * b for a, b in zip(v, m, strict=True)) / math.hypot(*v) / math.hypot(*m), 6), label) for (size, label), m in means.items() if size == len(v) and any(m))
        out += [(key, i + 1, label, -c + 0.0) for i, (c, label) in enumerate(near[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_values", [op.BLOCK_VALUES, 8])
def test_against_plain_python(spark, block_values):
    draw = random.Random(5)
    rows = [(i, [draw.randint(-8, 8) / 4 for _ in range(4 if i % 9 else 3)], draw.randint(0, 6) if i % 7 else None, 0, "") for i in range(80)]
    rows += [(None, [1.0, 0.0, 0.0, 0.0], 1, 0, ""), (7, [1.0, 0.0, 0.0, 0.0], 1, 0, ""), (7, [1.0, 0.0, 0.0, 0.0], 1, 0, "")]
    rows += [(90, None, 1, 0, ""), (91, [], 1, 0, ""), (92, [0.0] * 4, 1, 0, ""), (93, [1.0, None, 0.0, 0.0], 1, 0, ""), (94, [float("nan"), 1.0, 1.0, 1.0], 1, 0, ""), (95, [float("inf"), 1.0, 1.0, 1.0], 1, 0, ""), (96, [1.0, 2.0], None, 0, "")]
    rows += [(97, [1.0] * 5, 8, 0, ""), (98, [-1.0] * 5, 8, 0, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = op.nearest_groups(frame, 3, block_values=block_values)
    assert found.columns == ["vec_id", "rank", "label", "cosine"]
    got, want = sorted((tuple(r) for r in found.collect()), key=str), brute(rows, 3)
    assert [(a[0], a[1]) for a in got] == [(a[0], a[1]) for a in want]
    assert all(abs(a[3] - b[3]) <= 2e-6 and (a[2] == b[2] or abs(a[3] - b[3]) <= 2e-6) for a, b in zip(got, want, strict=True))


def test_vectors_are_not_shuffled(spark, sf_dir):
    frame = op.nearest_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    top = frame._jdf.queryExecution().executedPlan().toString().split("FileScan parquet")[0]
    assert "BroadcastHashJoin" in top and "BuildLeft" not in top and "NestedLoop" not in top and "SortMergeJoin" not in top
    assert op.nearest_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(0)).count() == 0
