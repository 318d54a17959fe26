import numpy as np
import pytest

from cohortwise.llm.embedding_dedup import near_duplicate_vectors, tables_for
from cohortwise.llm.graph import connected_components

SCHEMA = "vec_id long, embedding array<{}>, label int, node long, links string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA.format(kind))


def brute(rows, threshold=0.9):
    usable = [k for k, (_, v) in enumerate(rows) if v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a in usable:
        for b in usable:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.float32(rows[k][1]).astype(float) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
    out = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((rows[k][0], len(links[k]), min(rows[j][0] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 8])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for group in range(6):
        centre = rng.normal(size=16)
        rows += [(len(rows) + j, (centre + rng.normal(size=16) * 0.12).tolist())
                 for j in range([1, 2, 3, 8, 90, 30][group])]
    rows += [(len(rows) + j, rows[4][1]) for j in range(5)]
    got = near_duplicate_vectors(table(spark, rows), recall=0.9999, block=block, bits=8).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_awkward_vectors(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.01]), (10, [1.0, 0.0, 0.0]),
            (11, [-1.0, 0.0])]
    got = near_duplicate_vectors(table(spark, rows, kind), recall=0.999).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    for i in (1, 2, 3, 4, 5, 6, 10, 11):
        assert by[i] == [(0, i, True)]
    assert by[7] == [(3, 7, True)] and by[8] == [(3, 7, False)] * 2 and by[None] == [(3, 7, False)]
    assert near_duplicate_vectors(table(spark, [], kind)).count() == 0


def test_tables_for():
    assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** 12) ** tables_for(12) >= 0.95


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}}
    assert connected_components(df.limit(0)).count() == 0
