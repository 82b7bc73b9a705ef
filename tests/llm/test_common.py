import random

import pytest

from fieldtrace.llm.common import components


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(40)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)],
        "none": [(5, 5)],
    }[shape]
    label = {v: v for e in edges for v in e}
    for _ in range(len(edges) + 1):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: r for v, r in label.items() if any(v in e and e[0] != e[1] for e in edges)}
