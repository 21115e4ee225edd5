"""Operators on hand-made graphs."""

import time
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import rules, text
from loomgraph.operators import analysis, community, components, entities, feedback, graph, resolve, search, traversal
from loomgraph.plans import storage
from loomgraph.sources import extract, files, graph_json

NODE = "id string, label string, file_type string, source_file string, source_location string, seq long"
EDGE = "src string, dst string, relation string, confidence string"


def nodes(spark, *rows):
    return spark.createDataFrame([(*r, *("code", "a.py")[len(r) - 2 :], None, i) for i, r in enumerate(rows)], NODE)


def edges(spark, *pairs, relation="calls", confidence="EXTRACTED"):
    return spark.createDataFrame([(p[0], p[1], p[2] if len(p) > 2 else relation, p[3] if len(p) > 3 else confidence) for p in pairs], EDGE)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_ids_are_idempotent(value):
    assert text.plain_id(text.plain_id(value)) == text.plain_id(value)


def test_tokens_and_ids(spark):
    assert text.plain_tokens("getHTTPServer2Foo") == ["get", "http", "server", "2", "foo"]
    df = spark.createDataFrame([("Ünï-Code.Foo", "_a."), (None, "b")], "x string, y string")
    assert [r[0] for r in df.select(text.make_id(F.col("x"), F.col("y"))).collect()] == ["ünï_code_foo_a", "b"]


@pytest.mark.parametrize("a,b,d", [("ca", "abc", 2), ("abcd", "acbd", 1), ("", "ab", 2), ("same", "same", 0)])
def test_damerau(a, b, d):
    assert text.damerau(a, b) == d == text.damerau(b, a)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3)], "src long, dst long")
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}
    assert dict(got(components.connected_components(e))) == want
    assert got(components.connected_components(e.where("src < 0"))) == []


def test_fold_keeps_direction(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("c", "d"), ("c", "d", "imports"), ("d", "c"), ("x", "x"))
    assert [(r[0], r[1], r[2]) for r in got(graph.fold_pairs(e))] == [("a", "b", "calls"), ("d", "c", "calls"), ("x", "x", "calls")]


def test_build(spark):
    n = spark.createDataFrame([("A-1", "f()", "tool", "x\\a.py", None, 0, "ast"), ("g", "f()", None, "x/a.py", None, 1, None), ("b", "B", "weird", "b.go", None, 2, "ast")], NODE + ", origin string")
    e = edges(spark, ("a 1", "b"), ("g", "b", "uses"), ("nobody", "b"))
    kept, folded = graph.build(n, e)
    assert {(r["id"], r["file_type"]) for r in kept.collect()} == {("A-1", "code"), ("b", "concept")}
    assert [(r["src"], r["dst"]) for r in folded.collect()] == [("A-1", "b")]


def test_diff_with_itself_is_empty(spark):
    n, e = nodes(spark, ("a", "A"), ("b", "B")), edges(spark, ("a", "b"))
    assert got(graph.graph_diff(n, n, e, e)) == [] and graph.same_topology(e, e, ["src", "dst"])
    assert {r[0] for r in got(graph.graph_diff(n, n.where("id = 'a'"), e, e.limit(0)))} == {"node removed", "edge removed"}


def test_rationale_moves_to_its_target(spark):
    n = nodes(spark, ("a", "A"), ("why", "This sentence explains at some length what A is for."))
    kept, left = graph.drop_rationale(n, edges(spark, ("why", "a", "rationale_for")))
    assert [(r["id"], r["rationale"][:4]) for r in kept.collect()] == [("a", "This")] and left.isEmpty()


def test_hyperedges_need_two_members(spark):
    h = spark.createDataFrame([("h", "H", "form", ["b", "a", "b", "gone"]), ("i", "I", "form", ["a", "gone"]), (None, "J", "form", ["a", "b"])], "id string, label string, relation string, nodes array<string>")
    assert [(r["id"], r["nodes"]) for r in graph.clean_hyperedges(h, nodes(spark, ("a", "A"), ("b", "B"))).collect()] == [("h", ["b", "a"])]


def test_hubs_are_not_expanded(spark):
    e = edges(spark, ("s", "hub"), *[("hub", f"x{i}") for i in range(60)])
    seed = spark.createDataFrame([("s",)], "id string")
    assert {r["id"] for r in traversal.bfs(e, seed, 3)[0].collect()} == {"s", "hub"}
    assert traversal.hops(e, seed, 3).count() == 62


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), *[(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)]], "src string, dst string")
    assert sorted(map(tuple, traversal.import_cycles(e).collect())) == [("a > b", 2), ("a > b > c", 3), ("d", 1)]


def test_pagerank_sums_to_one(spark):
    n = nodes(spark, *[(c, c) for c in "abcde"])
    r = traversal.pagerank(n, edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")).withColumn("weight", F.lit(1.0)), rounds=100, tolerance=1e-9)
    ranks = {x["id"]: x["rank"] for x in r.collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == "a"


def test_path_avoids_costly_hubs(spark):
    e = edges(spark, ("s", "hub"), ("hub", "t"), *[("hub", f"x{i}") for i in range(30)], ("s", "m"), ("m", "t"))
    assert traversal.shortest_path(e, "s", "t") == ["s", "m", "t"]
    assert traversal.shortest_path(e, "s", "nowhere") == []


def test_dead_code(spark):
    n = nodes(spark, ("m", "main()"), ("u", "_used()"), ("d", "_dead()"), ("e", "_also()"))
    assert [r[0] for r in got(traversal.unreachable_functions(n, edges(spark, ("m", "u"), ("d", "e"), ("e", "d"), ("u", "m", "imports"))))] == ["d", "e"]


def test_clusters_cover_all_nodes(spark):
    n = nodes(spark, *[(c, c) for c in "abcdefz"])
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d"))
    assert dict(got(community.cluster(n, e))) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d", "z": "z"}


def modularity(pairs, found):
    degree, inside, total = {}, 0, {}
    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        inside += found[a] == found[b]
    for i, d in degree.items():
        total[found[i]] = total.get(found[i], 0) + d
    return inside / len(pairs) - sum((t / 2 / len(pairs)) ** 2 for t in total.values())


def test_large_components_are_clustered_as_well_as_small_ones(spark, monkeypatch):
    """A tree of stars: what is cut apart is never put together again unless the edges between are kept."""
    pairs = {(f"n{i // 3:04}", f"n{i:04}") for i in range(1, 400)} | {(f"n{i:04}", f"n{i + 1:04}") for i in range(0, 390, 5)}
    n, e = nodes(spark, *((i, i) for i in sorted({x for p in pairs for x in p}))), edges(spark, *sorted(pairs))
    in_task = modularity(pairs, dict(community.cluster(n, e).collect()))
    monkeypatch.setattr(community, "TASK_EDGES", 60)
    found = dict(community.cluster(n, e).collect())
    assert len(found) == n.count() and all(c == min(i for i in found if found[i] == c) for c in set(found.values()))
    assert modularity(pairs, found) > 0.95 * in_task


def test_numbered_communities():
    import numpy as np

    cliques = [(i, j) for base in (10, 20, 30) for i in range(base, base + 6) for j in range(i + 1, base + 6)] + [(15, 20), (25, 30)]
    ids, found = community._split(*np.array(cliques).T, 100)
    assert dict(zip(ids.tolist(), found.tolist(), strict=True)) == {i: i // 10 * 10 for b in (10, 20, 30) for i in range(b, b + 6)}
    rng = np.random.default_rng(1)
    a, b = np.array(sorted({(min(p), max(p)) for p in rng.integers(0, 200, (1500, 2)).tolist() if p[0] != p[1]})).T
    own, k = community._moves(a, b, np.ones(len(a)), 200, 1.0, 2000), np.bincount(np.r_[a, b], minlength=200)
    for v in range(200):  # none gains by moving, although only nodes beside moved ones were looked at again
        near = own[np.r_[b[a == v], a[b == v]]]
        gain = {c: (near == c).sum() - k[v] * (k[own == c].sum() - k[v] * (c == own[v])) / k.sum() for c in {*near.tolist(), int(own[v])}}
        assert max(gain.values()) <= gain[int(own[v])] + 1e-9


def test_betweenness(spark):
    found = community.betweenness(edges(spark, ("a", "b"), ("b", "c"), ("c", "d")))
    assert {k: v for k, v in got(found) if v} == {"b": 2.0, "c": 2.0}


def test_betweenness_of_graphs_too_large_for_names(spark, monkeypatch):
    pairs = sorted({(f"n{i // 3:02}", f"n{i:02}") for i in range(1, 40)} | {(f"n{i:02}", f"n{i + 7:02}") for i in range(0, 30, 3)})
    want, names = dict.fromkeys((x for p in pairs for x in p), 0.0), sorted({x for p in pairs for x in p})
    near = {x: [b if a == x else a for a, b in pairs if x in (a, b)] for x in names}
    for s in names:
        for v, _, share in community._shares(near, s):
            want[v] += share / 2 if v != s else 0

    def refuse(*_):
        raise ValueError("by name")

    monkeypatch.setattr(community, "_adjacency", refuse)
    found = dict(got(community.betweenness(edges(spark, *pairs, ("n01", "n01"), ("n03", "n01")))))
    assert {i: found.get(i, 0.0) for i in names} == pytest.approx(want)


def test_depth_first(spark):
    assert community.depth_first(edges(spark, ("a", "b"), ("b", "d"), ("a", "c")), ["a"], 1) == ["a", "b", "c"]


def test_remap_is_stable(spark):
    c = spark.createDataFrame([(str(i), i // 5) for i in range(15)], "id string, community long")
    moved = c.select("id", ((F.col("community") + 1) % 3).alias("community"))
    assert got(analysis.remap(c, moved)) == got(c)


@pytest.mark.parametrize("a,b,same,anchored,ok", [("graph extractor engine", "graph extractar engine", False, False, True), ("extractor", "extractar", True, False, False), ("extractor", "extratcor", True, False, True), ("m1", "m1 pro", True, False, False), ("product goals 31", "product goals 11", True, False, False), ("module docs", "module docs", False, False, False), ("django app config for users", "django app config for orders", False, True, False)])
def test_names_that_are_one(a, b, same, anchored, ok):
    assert entities.accepted(a, b, same, anchored) == ok


def test_entities_are_merged(spark):
    n = nodes(spark, ("x_c1", "Graph Extraction Pipeline", "concept", "a.md"), ("x", "graph extraction-pipeline", "concept", "a.md"), ("y", "Graph Extraction Pipelines!", "concept", "b.md"), ("z", "Something else entirely", "concept", "a.md"))
    kept, moved, mapping = entities.deduplicate(n, edges(spark, ("x_c1", "z"), ("x", "x_c1")))
    assert ("x_c1", "x") in got(mapping) and ("x", "z") in {(r["src"], r["dst"]) for r in moved.collect()} and kept.count() < 4


def test_search_terms():
    assert search.query_terms("How does the user log in to the API?")[:3] == ["user", "log", "api"]
    assert {"login", "authenticate"} <= set(search.query_terms("How does the user log in?"))
    assert search.question_contexts("what calls this module?") == ["call", "import"]


def test_search_ranks_and_corrects(spark):
    n = nodes(spark, ("a", "HttpServer"), ("b", "server()"), ("c", "Unrelated"))
    assert [r["id"] for r in search.score(n, ["server"]).collect()] == ["b", "a"]
    words = search.vocabulary(search.corpus(n))
    assert search.correct("sevrer", words).first()["word"] == "server"
    assert search.fuzzy_substring(n, "serwer").first()["distance"] == 1
    assert search.ask(n, edges(spark, ("a", "c")), "sevrer", 1).count() >= 1


def test_decay(spark):
    d = spark.createDataFrame([("q", "useful", datetime.fromisoformat("2024-01-31"), None, ["n", "n"]), ("q", "dead_end", None, None, ["n"]), ("r", "useful", datetime.fromisoformat("2030-01-01"), None, ["m"])], "question string, outcome string, date timestamp, correction string, source_nodes array<string>")
    s = {r["node"]: (round(r["score"], 6), r["pos"], r["neg"]) for r in feedback.node_scores(d, F.to_timestamp(F.lit("2024-03-01"))).collect()}
    assert s == {"n": (-0.5, 1, 1), "m": (1.0, 1, 0)}
    assert got(feedback.verdicts(feedback.node_scores(d, F.to_timestamp(F.lit("2024-03-01")))).select("node", "status")) == [("m", "tentative"), ("n", "contested")]


def test_python_extractor(spark):
    code = '"""What this module is about, at length."""\nimport os\nfrom a.b import c\nclass K(Base):\n    def run(self, cb):\n        helper(cb, other)\n\ndef helper(x, y):\n    return x\n'
    rows = extract.extract(spark.createDataFrame([("src/m.py", code), ("bad.py", "def ("), ("Dockerfile", "FROM img AS build\n"), ("x.unknown", None)], "path string, text string"))
    n, e, calls = extract.fragments(rows)
    labels = {r["label"] for r in n.collect()}
    assert {"m.py", "K", ".run()", "helper()", "bad.py", "Dockerfile", "build", "x.unknown"} <= labels
    links = {(r["src"], r["dst"], r["relation"]) for r in e.collect()}
    assert {("src_m", "os", "imports"), ("src_m", "a_b", "imports_from"), ("src_m_k", "src_m_k_run", "method"), ("src_m_rationale", "src_m", "rationale_for")} <= links
    assert {(r["callee"], r["relation"]) for r in calls.collect()} == {("Base", "inherits"), ("helper", "calls"), ("other", "indirect_call")}
    assert got(resolve.unique_calls(calls.where("relation = 'calls'"), n, e)) == [("src_m_k_run", "src_m_helper", "calls")]


@pytest.mark.parametrize("path,code,label", [("a.go", "func Run() {}", "Run()"), ("a.rs", "pub fn go() {}", "go()"), ("a.ts", "export class Foo {}", "Foo"), ("a.feature", "Feature: Login", "Login"), ("a.html", '<div id="top">', "#top"), ("a.sql", "CREATE TABLE t (x int)", "t"), ("a.toml", "[tool]\nx = 1", "tool"), ("a.json", '{"k": 1}', "k"), ("a.ex", "defmodule A.B do", "A.B"), ("a.css", ".box { }", ".box"), ("a.md", "# Title", "Title"), ("a.rb", "def go!", "go!()")])
def test_other_extractors(path, code, label):
    assert label in {r[2] for r in extract.one_file(path, code)}


def test_ignore_rules(spark):
    df = spark.createDataFrame([("a/b.log",), ("keep.log",), ("build/x/y.py",), ("src/z.py",), ("build/keep.py",)], "p string")
    rows = df.select("p", files.ignored(F.col("p"), ["*.log", "!keep.log", "build/", "!build/keep.py", "# no"]).alias("i")).collect()
    assert {r["p"]: r["i"] for r in rows} == {"a/b.log": True, "keep.log": False, "build/x/y.py": True, "src/z.py": False, "build/keep.py": True}


def test_slices_cover_the_text(spark):
    body = "# A\n\n" + "word " * 50 + "\n\n# B\n" + "more " * 80
    rows = files.slices(spark.createDataFrame([("p", body)], "path string, text string"), 120).orderBy("index").collect()
    assert "".join(body[r["start"] : r["end"]] for r in rows) == body and max(r["end"] - r["start"] for r in rows) <= 120


def test_model_json():
    assert files.parse_model_json('Sure!\n```json\n{"a": {"b": 1}} trailing') == '{"a": {"b": 1}}'
    assert files.parse_model_json("no { object") is None


def test_graph_json_round_trip(spark, tmp_path):
    n = nodes(spark, ("a", "A"), ("b", "B")).withColumn("community", F.lit(1))
    e = edges(spark, ("b", "a", "calls", "INFERRED")).withColumn("confidence_score", F.lit(None).cast("double"))
    graph_json.write_graph(n, e, f"{tmp_path}/g")
    n2, e2, _ = graph_json.read_graph(spark, f"{tmp_path}/g")
    assert {r["id"] for r in n2.collect()} == {"a", "b"}
    assert [(r["src"], r["dst"], r["confidence_score"]) for r in e2.collect()] == [("b", "a", 0.5)]
    with pytest.raises(ValueError):
        graph_json.write_graph(n.limit(1), e, f"{tmp_path}/g")


def test_memories(spark, tmp_path):
    (tmp_path / "m.md").write_text('---\nquestion: "why?"\noutcome: useful\ndate: 2024-01-02\nsource_nodes: ["a", "b"]\n---\nbody')
    (tmp_path / "n.md").write_text("no front matter")
    r = files.read_memories(spark, str(tmp_path)).collect()
    assert [(x["question"], x["outcome"], x["source_nodes"]) for x in r] == [("why?", "useful", ["a", "b"])]


def test_surprise_order_of_steps(spark):
    row = spark.createDataFrame([("semantically_similar_to", "INFERRED", "a/x.py", "b/y.md", 1, 2, 1, 9)], "r string, c string, fa string, fb string, ca int, cb int, da int, db int")
    assert row.select(rules.surprise(*map(F.col, row.columns))).first()[0] == int((2 + 2 + 2 + 1) * 1.5) + 1


def test_types_in_scope(spark):
    uses = spark.createDataFrame([("a", "f", "T"), ("a", "f", "U"), ("b", "g", "T")], "src string, file string, name string")
    scopes = spark.createDataFrame([("f", "N"), ("f", "M"), ("g", "X")], "file string, namespace string")
    defs = spark.createDataFrame([("t2", "N", "T"), ("t1", "N", "T"), ("u1", "N", "U"), ("u2", "M", "U")], "id string, namespace string, name string")
    assert got(resolve.types_in_scope(uses, scopes, defs)) == [("a", "T", "t1"), ("a", "U", "stub:U"), ("b", "T", "stub:T")]


def test_member_calls(spark):
    calls = spark.createDataFrame([("m", "Dog", None, "new"), ("m", "d", "Dog", "bark"), ("m", "c", "Cat", "run"), ("m", "Cat", None, "new")], "caller string, receiver string, receiver_type string, method string")
    classes = spark.createDataFrame([("dog", "Dog"), ("cat1", "Cat"), ("cat2", "Cat")], "id string, name string")
    methods = spark.createDataFrame([("dog_bark", "dog", "bark"), ("cat_run", "cat1", "run")], "id string, class_id string, name string")
    assert got(resolve.member_calls(calls, classes, methods)) == [("m", "dog"), ("m", "dog_bark")]


def test_import_targets(spark):
    imports = spark.createDataFrame([("src/a/x.ts", "./y"), ("src/a/x.ts", "../b"), ("src/a/x.ts", "@/lib/z"), ("src/a/x.ts", "react"), ("src/a/x.ts", "../../../out"), ("run.sh", "./lib.sh")], "file string, spec string")
    known = spark.createDataFrame([("src/a/y.js",), ("src/a/y.ts",), ("src/b/index.ts",), ("src/lib/z.tsx",), ("lib.sh",)], "path string")
    assert got(resolve.import_targets(imports, known, {"@/": "src"})) == [("run.sh", "./lib.sh", "lib.sh"), ("src/a/x.ts", "../b", "src/b/index.ts"), ("src/a/x.ts", "./y", "src/a/y.ts"), ("src/a/x.ts", "@/lib/z", "src/lib/z.tsx")]


def test_import_targets_are_merged(spark):
    imports = spark.createDataFrame([("a.ts", "./b"), ("a.ts", "./"), ("d/a.ts", "./a"), ("a.ts", "./b.ts")], "file string, spec string")
    known = spark.createDataFrame([("b/index.ts",), ("b.ts",), ("b.ts",), ("b.ts.js",), ("d/a.ts",), ("d/a.py",), (".ts",)], "path string")
    found = resolve.import_targets(imports, known)
    assert got(found) == [("a.ts", "./", ".ts"), ("a.ts", "./b", "b.ts"), ("a.ts", "./b.ts", "b.ts"), ("d/a.ts", "./a", "d/a.py")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_http_links_compare_only_pairs_that_may_repeat(spark):
    fetches = spark.createDataFrame([("f", "/a"), ("f", "/b"), ("f", "/b"), ("g", "/a"), ("g", "/a"), ("i", "/${x}"), ("i", None)], "id string, action string")
    handlers = spark.createDataFrame([("h", "/a"), ("h", "/b"), ("k", "/b"), ("k", "/b"), ("l", None)], "id string, action string")
    found = resolve.http_links(fetches, handlers)
    assert got(found) == [("f", "h", "http_calls"), ("f", "k", "http_calls"), ("g", "h", "http_calls")]
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # no rows are compared above both kinds of pairs


def test_large_graphs_are_merged(spark):
    n = spark.range(100_001).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("x").alias("label"))
    e = n.select(F.col("id").alias("src"), F.lit("n0").alias("dst"), F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    right = e.where("src = 'n7'").withColumn("confidence", F.lit("INFERRED"))
    merged, links = graph.merge_graphs((n, e), (n, right))
    assert merged.count() == links.count() == 100_001 and links.where("confidence = 'INFERRED'").count() == 1
    with pytest.raises(ValueError):
        graph.merge_graphs((n, e), (n, right), most_nodes=100_000)


def test_ranks_in_one_task_and_over_tables_agree(spark, monkeypatch):
    n = nodes(spark, *[(i, i) for i in "abcdefz"])
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "a"), ("a", "e"), ("f", "gone")).withColumn("weight", F.when(F.col("src") == "a", 2.5).otherwise(1.0))
    got_of = lambda: dict(got(traversal.pagerank(n, e, tolerance=1e-9).select("id", F.round("rank", 12))))
    written = []
    monkeypatch.setattr(traversal, "bucketed", lambda *a, f=traversal.bucketed: (written.append(a), f(*a))[1])
    in_task = got_of()
    assert not written  # no table of flows, no table a round
    monkeypatch.setattr(traversal, "TASK_EDGES", 0)
    assert in_task == got_of() and written and len(in_task) == 7


def test_token_cost(spark):
    from loomgraph.sources import report

    n = nodes(spark, ("a", "alpha"), ("b", "beta"), ("c", "gamma"))
    e = edges(spark, ("a", "b"))
    lines = "NODE alpha src=a.py loc=\nNODE beta src=a.py loc=\nEDGE alpha --calls--> beta"
    assert report.token_cost(n, e, "what is alpha?") == len(lines) // 4 and report.token_cost(n, e, "zzz") == 0


def test_samples_and_versions(spark):
    n = nodes(spark, ("a", "One()"), ("b", "one"), ("c", "Two"))
    c = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, community long")
    assert got(analysis.community_samples(n, c, n.where("id = 'c'"))) == [(1, "Two, One")]
    v = spark.createDataFrame([("p1", "2024-01-01"), ("p2", "2024-01-20")], "path string, day string")
    assert got(graph.expired(v, "2024-01-21").select("path")) == [("p1",)]
    a, b = graph.merge_fragments([(n.limit(1), edges(spark, ("a", "b"))), (n, edges(spark, ("b", "c")))])
    assert a.count() == 3 and b.count() == 2


def test_long_paths_and_disambiguation(spark):
    chain = edges(spark, *[(f"n{i:02d}", f"n{i + 1:02d}") for i in range(14)])
    assert traversal.shortest_path(chain, "n00", "n14") == [f"n{i:02d}" for i in range(15)]
    # Two nodes are called Stats; the first by id has no way to the target.
    n = nodes(spark, ("a", "Stats"), ("b", "Stats"), ("t", "Target"), ("u", "Alone"))
    e = edges(spark, ("b", "m"), ("m", "t"), ("a", "u"))
    n = n.union(nodes(spark, ("m", "Middle")))
    found = traversal.find_path(n, e, "Stats", "Target")
    assert found["path"] == ["b", "m", "t"] and found["tried"] == 2 and "ambiguous" in found["warnings"][0]
    assert "error" in traversal.find_path(n, e, "Target", "Target") and "error" in traversal.find_path(n, e, "nothing here", "Target")


def test_paths_go_around_hubs(spark):
    spokes = [("hub", f"x{i}") for i in range(30)]
    e = edges(spark, ("s", "hub"), ("hub", "t"), ("s", "p"), ("p", "q"), ("q", "t"), *spokes)
    n = nodes(spark, *[(i, i.upper()) for i in ("s", "t", "p", "q", "hub")])
    assert traversal.find_path(n, e, "S", "T")["path"] == ["s", "p", "q", "t"]
    assert traversal.find_path(n, e.where("src <> 'p'"), "S", "T")["used_noise"]


@pytest.mark.parametrize("a,b,d", [("ca", "abc", 3), ("abcd", "acbd", 1), ("", "ab", 2), ("same", "same", 0), ("serevr", "server", 1)])
def test_restricted_edits(a, b, d):
    assert search.osa(a, b) == d == search.osa(b, a)


def test_corrections_and_abbreviations(spark):
    words = spark.createDataFrame([("config", 1, False), ("confetti", 9, False), ("server", 1, False), ("seven", 5, False), ("configserver", 1, True)], "word string, n long, span boolean")
    best = lambda t: [r["word"] for r in search.correct(t, words).collect()]
    assert best("cfg") == ["config"] and best("sevrer") == ["server"] and best("server") == [] and best("xx") == [] and best("zzzzzz") == []
    assert search.abbreviation("cfg", "config") == 12 and search.abbreviation("gc", "config") is None and search.abbreviation("con", "config") == 87


def test_edge_betweenness_and_surprises_of_one_file(spark):
    # Two triangles joined by one edge: nine of fifteen pairs cross it.
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"))
    scores = {(r["a"], r["b"]): r["score"] for r in community.edge_betweenness(e).collect()}
    assert scores[("c", "d")] == pytest.approx(9 / 15) and scores[("a", "b")] == pytest.approx(1 / 15)
    n = nodes(spark, *[(i, i) for i in "abcdef"])
    assert tuple(analysis.surprising(n, e, None).first())[:2] == ("c", "d")
    c = spark.createDataFrame([(i, int(i > "c")) for i in "abcdef"], "id string, community long")
    assert [tuple(r)[:2] for r in analysis.surprising(n, e, c).collect()] == [("c", "d")]
    with pytest.raises(ValueError):
        community.edge_betweenness(e, most_nodes=3)


def test_questions(spark):
    n = nodes(spark, *[(i, i) for i in "abcdef"])
    c = spark.createDataFrame([(i, int(i > "c")) for i in "abcdef"], "id string, community long")
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), confidence="INFERRED")
    found = [tuple(r) for r in analysis.questions(n, e, c).collect()]
    assert ("bridge_node", "Why does `c` connect `Community 0` to `Community 1`?") in found and [t for t, _ in found][0] == "bridge_node"
    assert any(t == "verify_inferred" and "`c` (e.g. with `a` and `b`)" in q for t, q in found)
    sure = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))
    quiet = analysis.questions(n.where("id < 'd'"), sure, c.where("id < 'd'"))
    assert [tuple(r) for r in quiet.collect()] == [("no_signal", None)]


def test_merge_refuses_to_shrink(spark):
    n, e = nodes(spark, ("a", "A", "code", "x.py"), ("b", "B", "code", "y.py")).drop("seq", "source_location"), edges(spark, ("a", "b")).withColumn("source_file", F.lit("x.py"))
    fresh = n.where("id = 'a'").withColumn("label", F.lit("new"))
    kept, _ = graph.build_merge((n, e), (fresh, e))
    assert sorted(r["label"] for r in kept.collect()) == ["B", "new"]
    twins = n.where("id = 'b'").withColumn("id", F.lit(""))
    with pytest.raises(graph.Shrunk):
        graph.build_merge((n.union(twins), e), (fresh, e))


def test_hot_bands_lose_no_pair(spark):
    named = spark.createDataFrame([(f"n{i:03d}", f"common name of things {i % 7}") for i in range(60)], "id string, name string")
    whole, dealt = (got(entities.alike_pairs(named, chunk=c)) for c in (1000, 7))
    assert whole == dealt and len(whole) > 200


def test_several_repositories_are_refused(spark):
    n = nodes(spark, ("a", "A"), ("b", "B")).withColumn("repo", F.col("id"))
    with pytest.raises(ValueError):
        entities.deduplicate(n, edges(spark, ("a", "b")))


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_go_when_a_table_is_written(spark):
    before = _shuffle_files(spark)
    storage.materialize(spark.range(1000).groupBy("id").count(), "swept")
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left


def test_edges_are_joined_apart_from_their_folding(spark):
    n = spark.createDataFrame([("a", "A", "code", "x.py"), ("b", "B", "code", "y.py"), ("c_d", "C", "code", "z.go")], "id string, label string, file_type string, source_file string")
    e = spark.createDataFrame([("a", "b", "calls", "EXTRACTED"), ("b", "a", "calls", "EXTRACTED"), ("C-D", "a", "uses", "EXTRACTED"), ("a", "c_d", "calls", "INFERRED"), ("a", "gone", "uses", "EXTRACTED"), (None, "a", "uses", "EXTRACTED")], "src string, dst string, relation string, confidence string")
    folded = graph.build(n, e)[1]
    assert got(folded) == [("a", "b", "calls", "EXTRACTED"), ("c_d", "a", "uses", "EXTRACTED")]
    exact = graph.build(n, e.where("src IN ('a', 'b') AND dst IN ('a', 'b', 'c_d')"))[1]
    assert "Join" not in exact._jdf.queryExecution().optimizedPlan().toString()


def test_cross_cutting_writes_what_it_counts(spark):
    n = spark.createDataFrame([(i, i.upper(), "x.py") for i in "abcd"], "id string, label string, source_file string")
    e = edges(spark, ("a", "b"), ("b", "a"), ("a", "b"), ("a", "c"), ("d", "a"))
    found = analysis.cross_cutting(n, e, spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 3)], "id string, community long"))
    assert got(found)[0] == ("a", "A", 2, 5)
    assert any("cut-bridged" in f for f in found.inputFiles())
