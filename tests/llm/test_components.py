"""Components against union-find, and the number of rounds that a star takes."""

import random

import pytest

from seamline.llm import components

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def union_find(edges):
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[top(a)] = top(b)
    return {x: top(x) for x in up}


DRAWN = random.Random(3)
SHAPES = {
    "path": [(i, i + 1) for i in range(300)],
    "star": [(0, i) for i in range(1, 3000)],
    "random": [(DRAWN.randrange(900), DRAWN.randrange(900)) for _ in range(500)],
    "loops and repeats": [(5, 5), (7, 7), (1, 2), (2, 1), (1, 2)],
    "ends of the range": [(LEAST, 4), (4, MOST), (4, 4)],
    "none": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape):
    edges = SHAPES[shape]
    got = {r.node: r.label for r in components.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find([(a, b) for a, b in edges if a != b])
    assert set(got) == set(want)
    pairs = {(want[x], got[x]) for x in got}
    assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})


def test_a_star_takes_one_round(spark, monkeypatch):
    names, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or write(df, name))
    components.component_labels(spark.createDataFrame(SHAPES["star"], "a long, b long")).count()
    assert names.count("parents") == 1
