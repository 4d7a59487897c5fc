"""Merged spans against merging in order, for cells of any size."""

from __future__ import annotations

import random

import pytest

from quietfield.operators import spans


def merged(rows):
    out = {}
    for c, a, b in sorted(rows):
        own = out.setdefault(c, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return sorted((c, a, b) for c, own in out.items() for a, b in own)


@pytest.mark.parametrize("cell", [1, 7, 10, 64, 1 << 20])
def test_merged_spans(spark, cell):
    rng = random.Random(cell)
    rows = []
    for c in "ab":
        for _ in range(150):
            a = rng.randrange(-50, 3000)
            rows.append((c, a, a + rng.choice([0, 1, 2, 5, 10, 20])))
    rows += [("long", 3, 500), ("long", 500, 900), ("long", 901, 905), ("edge", 10, 20), ("edge", 20, 30), ("edge", 0, 7), ("empty", 70, 70)]
    df = spark.createDataFrame(rows, "channel string, start long, stop long").repartition(3)
    assert sorted(tuple(r) for r in spans.merge_spans(df, cell).select("channel", "start", "stop").collect()) == merged(rows)
    assert spans.merge_spans(df.where("start > 9999"), cell).count() == 0
