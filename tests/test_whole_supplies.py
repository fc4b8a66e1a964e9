"""Queries over the supplier-part graph of all lines, against brute force on tables of their own."""

import random
from collections import Counter
from pathlib import Path

import pytest

from propgraph import queries

SF = Path("/root/testdata/sf0.001")
S, P = 4 * 10**12, 5 * 10**12


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with lines of which the sparse filter takes none; and their pairs."""
    folder = tmp_path_factory.mktemp("whole")
    for f in SF.glob("*.parquet"):
        if f.stem != "lineitem":
            (folder / f.name).symlink_to(f)
    rng = random.Random(5)
    pairs = {(rng.randrange(1, 11), rng.randrange(1, 41)) for _ in range(35)} | {(20, p) for p in (100, 101)} | {(21, p) for p in (101, 102, 103)} | {(22, 102)}
    lines = spark.read.parquet(str(SF / "lineitem.parquet"))
    rows = spark.createDataFrame([(s, p) for s, p in sorted(pairs) * 2], "l_suppkey long, l_partkey long")
    one = lines.limit(1).drop("l_suppkey", "l_partkey", "l_quantity", "l_discount").crossJoin(rows).selectExpr("*", "1 AS l_quantity", "0.0 AS l_discount")
    one.select(*[one[c].cast(lines.schema[c].dataType) for c in lines.columns]).write.parquet(str(folder / "lineitem.parquet"))
    return str(folder), sorted((S + s, P + p) for s, p in pairs)


def pieces(nodes, pairs):
    near = {n: set() for n in nodes}
    for a, b in pairs:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    root = {}
    for n in sorted(near):
        todo = [n] if n not in root else []
        while todo:
            v = todo.pop()
            if v not in root:
                root[v] = n
                todo += near[v]
    return root


def rows(spark, tables, name):
    return [tuple(r) for r in queries.queries()[name](spark, tables[0]).collect()]


def test_components_and_cuts(spark, tables):
    pairs = tables[1]
    nodes = {n for p in pairs for n in p}
    root = pieces(nodes, pairs)
    number = {r: i for i, r in enumerate(sorted(set(root.values())))}
    assert len(number) > 1
    assert dict(rows(spark, tables, "wcc_supplies")) == {n: number[r] for n, r in root.items()}
    assert dict(rows(spark, tables, "wcc_sizes_supplies")) == Counter(Counter(root.values()).values())
    assert rows(spark, tables, "is_connected_supplies") == [(False,)]
    bridges = {5 * 10**18 + (a - S) * 10**8 + b - P for a, b in pairs if len(set(pieces(nodes, [p for p in pairs if p != (a, b)]).values())) > len(number)}
    assert bridges and {r for (r,) in rows(spark, tables, "bridges_supplies")} == bridges
    points = {n for n in nodes if len(set(pieces(nodes - {n}, pairs).values())) > len(number)}
    assert points and {r for (r,) in rows(spark, tables, "articulation_points_supplies")} == points


@pytest.mark.parametrize("name", ["label_propagation", "louvain"])
def test_communities_cover_all_pairs(spark, tables, name):
    pairs = tables[1]
    root = pieces({n for p in pairs for n in p}, pairs)
    found = dict(rows(spark, tables, name))
    assert set(found) == set(root)
    assert all(root[a] == root[b] for a in found for b in found if found[a] == found[b])
