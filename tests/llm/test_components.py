"""Components in one task and by stars are those of a plain search."""

import random

import numpy as np
import pytest

from quire.llm import components


def plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for x in sorted(near):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in root:
                root[y] = x
                todo += near[y]
    return root


def graphs():
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(-20, 60)]
    rng.shuffle(chain)
    return [chain, [(rng.randrange(300), rng.randrange(300)) for _ in range(170)], [(7, i) for i in range(8, 90)], [(1, 2), (1, 2), (3, 3), (2**62, -(2**62))]]


@pytest.mark.parametrize("edges", graphs())
def test_least_reached(edges):
    names, roots = components.least_reached(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert dict(zip(names.tolist(), roots.tolist())) == plain(edges)


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    edges = [e for x in graphs() for e in x]
    got = components.components(spark.createDataFrame(edges, "v long, u long")).collect()
    want = plain([e for e in edges if e[0] != e[1]])
    assert {r.v: r.root for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "v long, u long")).count() == 0
