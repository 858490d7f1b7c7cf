"""Lineage walks against the closure of random graphs, cycles included."""

import random

import pytest

from flowkit.operators import lineage

EDGES = "pipeline string, node string, column string, in_node string, in_column string, derivation int, edge string"


def closure(edges):
    """(from, to, any hop indirect) -> the largest derivation of a path's hops, over all paths."""
    best = {}
    for x, y, d, k in edges:
        best[x, y, k] = max(best.get((x, y, k), -1), d)
    while True:
        more = dict(best)
        for (x, y, k), d in best.items():
            for a, b, e, m in edges:
                if a == y:
                    to = x, b, max(k, m)
                    more[to] = max(more.get(to, -1), d, e)
        if more == best:
            return best
        best = more


def frame(spark, edges):
    return spark.createDataFrame([("p", f"n{a:02d}", "c", f"n{b:02d}", "c", d, "indirect" if k else "direct") for a, b, d, k in edges], EDGES)


@pytest.mark.parametrize("seed", range(5))
def test_against_the_closure(spark, seed):
    r = random.Random(seed)
    n = r.randrange(6, 14)
    edges = []
    for _ in range(r.randrange(8, 18)):
        a = r.randrange(n)
        edges.append((a, r.randrange(n) if r.random() < 0.15 else r.randrange(max(a, 1)), r.randrange(4), int(r.random() < 0.25)))
    df, direct, name = frame(spark, edges), [e for e in edges if not e[3]], "n{:02d}".format
    made = {a for a, *_ in direct}
    assert {(x.node, x.in_node, x.derivation) for x in lineage.resolve(df).collect()} == {(name(x), name(y), d) for (x, y, _), d in closure(direct).items() if y not in made}
    made = {a for a, *_ in edges}
    assert {(x.node, x.in_node) for x in lineage.indirect(df).collect()} == {(name(x), name(y)) for x, y, k in closure(edges) if k and y not in made}
    origin = r.randrange(n)
    cut_off = closure([e for e in edges if e[0] != origin])
    assert {(x.node, x.derivation, x.kind) for x in lineage.impact(df, name(origin), "c").collect()} == {(name(x), d, k) for (x, y, k), d in cut_off.items() if y == origin}
    cuts, above = {a for a, _, d, _ in edges if d == 3}, closure(direct)
    expected = {}
    for x in range(n):
        if met := [c for c in cuts if c == x or (x, c, 0) in above]:
            expected[name(x)] = name(min(met))
    assert {x.node: x.unknown_at for x in lineage.unknown_at(df).collect()} == expected


def test_a_chain_of_a_thousand_hops_takes_a_dozen_steps(spark, monkeypatch):
    steps = []
    write = lineage._Folder.write
    monkeypatch.setattr(lineage._Folder, "write", lambda self, *a: steps.append(1) or write(self, *a))
    edges = spark.createDataFrame([("p", str(i), "c", str(i - 1), "c", int(i == 500), "direct") for i in range(1, 1001)], EDGES)
    found = {int(r.node): (r.in_node, r.derivation) for r in lineage.resolve(edges).collect()}
    assert found == {i: ("0", int(i >= 500)) for i in range(1, 1001)} and len(steps) <= 14


def test_rows_at_an_origin_go_no_further(spark, monkeypatch):
    """Else those of a whole tree would meet at its root, in one task."""
    sizes = []
    write = lineage._Folder.write

    def counted(self, *a):
        table, number = write(self, *a)
        sizes.append(table.count())
        return table, number

    monkeypatch.setattr(lineage._Folder, "write", counted)
    edges = spark.createDataFrame([("p", str(i), "c", str(i // 2), "c", 0, "direct") for i in range(2, 256)], EDGES)
    assert {(r.node, r.in_node) for r in lineage.resolve(edges).collect()} == {(str(i), "1") for i in range(2, 256)}
    assert sizes == [254, 254, 252, 248, 224, 0]


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert not lineage.resolve(none).count() and not lineage.indirect(none).count() and not lineage.unknown_at(none).count() and not lineage.impact(none, "a", "c").count()
