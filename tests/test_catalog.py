"""Every catalogue query against its SQL, and none without rows."""

import os

import duckdb
import pytest
from compare import compare, oracle

from loomgraph.plans import catalog
from loomgraph.plans.derived import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert compare(spark, duck, SF, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def _other(tmp_path, name, sql):
    """The tables of SF, but for one that DuckDB makes."""
    for t in TABLES:
        if t != name:
            os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


@pytest.mark.parametrize(
    ("name", "table", "sql"),
    [
        ("doc_community", "events", f"SELECT * REPLACE (user_id * 7 + 200 AS user_id) FROM '{SF}/events.parquet'"),
        ("unreachable", "orders", f"SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 5 THEN 7 WHEN o_custkey = 7 THEN 8 ELSE o_custkey END AS o_custkey) FROM '{SF}/orders.parquet'"),
    ],
)
def test_same_rows_of_other_tables(spark, tmp_path, name, table, sql):
    sf = _other(tmp_path, table, sql)
    assert compare(spark, oracle(sf), sf, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.queries()) <= set(e.queries())
    assert e.entry(spark).count() == 10


def test_whole_graph_is_clustered_and_measured(spark):
    from loomgraph.plans import derived

    nodes = {r["id"] for r in derived.nodes(spark, SF).select("id").collect()}
    found = dict(catalog.queries()["clusters"](spark, SF).collect())
    size = {c: list(found.values()).count(c) for c in set(found.values())}
    assert set(found) == nodes and any(i.startswith("o:") and size[c] > 1 for i, c in found.items()) and any(i.startswith("p:") and size[c] > 1 for i, c in found.items())
    scores = dict(catalog.queries()["betweenness"](spark, SF).collect())
    assert {i[0] for i, s in scores.items() if s > 0} >= {"o", "p", "c"}


def _rows(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def test_components_of_the_whole_graph(spark):
    from loomgraph.plans import derived

    above = {}

    def root(i):
        while above.setdefault(i, i) != i:
            i = above[i]
        return i

    for e in derived.edges(spark, SF).select("src", "dst").collect():
        a, b = sorted((root(e["src"]), root(e["dst"])))
        above[b] = a
    assert dict(_rows(spark, "connected_components")) == {i: root(i) for i in list(above)}


def test_cycles_of_all_rows(spark):
    near = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        near.setdefault(f"m{r[0] % 23}", set()).add(f"m{(r[0] + r[1]) % 19}")
    want = set()

    def walk(path):
        for to in near.get(path[-1], ()):
            if to == path[0]:
                want.add(" > ".join(path))
            elif to > path[0] and to not in path and len(path) < 5:
                walk([*path, to])

    for first in near:
        walk([first])
    got = [r["cycle"] for r in _rows(spark, "import_cycles")]
    assert len(got) == len(want) and set(got) == want and max(c.count(">") for c in got) == 4


def test_values_and_symbols_of_all_rows(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect()
    held = {}
    for o, p, s in lines:
        held.setdefault(f"unit{s}.v{p}", set()).add(o)
    want = sorted((f"n{a}", f"n{b}", f"shares_value:{v}") for v, os in held.items() if 2 <= len(os) <= 5 for a in os for b in os if f"f{a}.yaml" < f"f{b}.yaml")
    assert sorted(map(tuple, _rows(spark, "shared_values"))) == want
    local, everywhere = {}, {}
    for (p,) in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect():
        local.setdefault((p % 10, p * 7 % 350), []).append(f"S{p}")
        everywhere.setdefault(p * 7 % 350, []).append(f"S{p}")
    want = set()
    for o, d, s in {(o, o % 10, p % 400) for o, p, _ in lines}:
        here, all_ = local.get((d, s)), everywhere.get(s, [])
        want.add((f"o{o}", f"d{d}", f"sym{s}", min(here) if here else all_[0] if len(all_) == 1 else f"stub:sym{s}"))
    assert sorted((r["src"], r["target"]) for r in _rows(spark, "scip_relations")) == sorted((a, t) for a, _, _, t in want)


def test_pagerank_is_converged(spark):
    import numpy as np

    from loomgraph.plans import derived

    n, e, _ = derived.graph(spark, SF)
    ids = {r["id"]: i for i, r in enumerate(n.select("id").collect())}
    a, b = np.array([(ids[r["src"]], ids[r["dst"]]) for r in e.select("src", "dst").collect()]).T
    src, dst = np.r_[a, b[a != b]], np.r_[b, a[a != b]]
    out, rank = np.bincount(src, minlength=len(ids)), np.full(len(ids), 1 / len(ids))
    for _ in range(500):
        rank = (0.15 + 0.85 * rank[out == 0].sum()) / len(ids) + 0.85 * np.bincount(dst, rank[src] / out[src], len(ids))
    got = dict(_rows(spark, "pagerank_converged"))
    assert set(got) == set(ids) and sum(abs(got[i] - rank[k]) for i, k in ids.items()) < 1e-6 * 0.85 / 0.15


def test_merged_graphs_hold_every_edge(spark):
    from loomgraph.plans import derived

    edges, found = derived.edges(spark, SF), catalog.queries()["merged_graphs"](spark, SF)
    assert sorted(found.groupBy("relation").count().collect()) == sorted(edges.groupBy("relation").count().collect())
