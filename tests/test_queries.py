"""Every registered query beside its SQL twin in DuckDB."""

from __future__ import annotations

import pytest

import oracle
from navgraph.plans import graph, live, play, registry, tasks  # noqa: F401

_graphs: dict = {}


@pytest.fixture(autouse=True)
def one_graph(monkeypatch):
    """The graph of a folder is built once for all tests."""
    build = graph.graph
    once = lambda spark, sf_dir: _graphs.setdefault(sf_dir, None) or _graphs.update({sf_dir: build(spark, sf_dir)}) or _graphs[sf_dir]
    monkeypatch.setattr(graph, "graph", once)
    monkeypatch.setattr(play, "graph", once)
    monkeypatch.setattr(tasks, "graph", once)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert oracle.differences(spark, oracle.connect(sf_dir), name, registry.QUERIES[name], registry.SQL[name], sf_dir) == ""


def test_solved_tasks(spark, sf_dir):
    found: dict = {}
    for r in registry.QUERIES["solved_tasks"](spark, sf_dir).collect():
        found.setdefault(r.query_id, []).append(r)
    assert found[3][0].status == "start_not_found" and found[4][0].status == "target_not_found"
    assert [(r.length, r.path) for r in found[5]] == [(0, "Item_8")]
    store = graph.graph(spark, sf_dir)
    named = {r.title: r.page_id for r in store.pages.collect()}
    edges = {(r.src_id, r.dst_id) for r in store.edges.collect()}
    for q in (1, 2):
        paths = [r.path.split(" -> ") for r in found[q]]
        assert len({tuple(p) for p in paths}) == len(paths) and len({len(p) for p in paths}) == 1
        assert all((named[a], named[b]) in edges for p in paths for a, b in zip(p, p[1:]))
