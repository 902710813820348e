"""Connected components of distributed edges against union-find."""

import numpy as np
import pytest

from skein.llm import components


@pytest.mark.parametrize("local", [300_000, 20])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (2000, 2001), (2000, 2001)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(8)).collect()))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in list(parent)}


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "u binary, v binary")).count() == 0
