"""Command line over graphs kept as Parquet (``nodes``, ``edges``, ``communities`` below one folder).

``python -m loomgraph.cli extract FOLDER GRAPH`` and so on; ``--help`` lists the commands.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import server
from loomgraph.functions import text
from loomgraph.operators import analysis, community, feedback, graph, resolve, traversal
from loomgraph.plans.storage import materialize
from loomgraph.sources import draw, extract, files, graph_json, report
from loomgraph.streaming import incremental


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tables of a graph folder, or those of a node-link document."""
    if (held := incremental.tables_of(spark, path)) is not None:
        return held
    if path.endswith(".json"):
        nodes, edges, _ = graph_json.read_graph(spark, path)
        return nodes, edges
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def communities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/communities")


def build(spark: SparkSession, root: str, path: str) -> None:
    """Scans a folder, extracts, resolves calls by unique names, folds, clusters and writes the tables."""
    texts = files.scan(spark, root).where("kind IN ('code', 'document')").select(F.col("rel").alias("path"), F.decode("content", "UTF-8").alias("text"))
    nodes, edges, calls = extract.fragments(extract.extract(texts))
    nodes = nodes.withColumn("seq", F.xxhash64("id"))
    found = resolve.unique_calls(calls.where("relation = 'calls'"), nodes, edges).select("src", "dst", "relation", F.lit("INFERRED").alias("confidence"))
    kept, folded = graph.build(nodes, edges.select("src", "dst", "relation", "confidence").union(found))
    folded.write.mode("overwrite").parquet(f"{path}/edges")
    kept.write.mode("overwrite").parquet(f"{path}/nodes")
    cluster(spark, path)


def cluster(spark: SparkSession, path: str) -> None:
    nodes, edges = load(spark, path)
    analysis.reindex(community.cluster(nodes, edges)).write.mode("overwrite").parquet(f"{path}/communities")


def one(spark: SparkSession, nodes: DataFrame, name: str) -> DataFrame:
    """The node a name stands for."""
    found = resolve.resolve_seed(nodes, name).select("id")
    if found.isEmpty():
        raise SystemExit(f"no single node is called {name!r}")
    return found


def show(df: DataFrame, limit: int = 50) -> None:
    for row in df.limit(limit).collect():
        print("\t".join("" if v is None else str(v) for v in row))


#: Commands and their arguments; a ``?`` marks one that may be left out.
COMMANDS = {
    "extract": ("root", "graph"), "cluster": ("graph",), "query": ("graph", "question"), "path": ("graph", "source", "target"), "explain": ("graph", "node"), "affected": ("graph", "node"),
    "dead-code": ("graph",), "gods": ("graph",), "stats": ("graph",), "cycles": ("graph",), "diff": ("old", "new"), "merge": ("left", "right", "out"), "report": ("graph",), "diagnose": ("graph",),
    "export": ("graph", "format", "out"), "blast-radius": ("graph", "node"), "update": ("root", "tables"), "watch": ("root", "tables"), "tree": ("graph", "out"), "merge-driver": ("base", "left", "right"),
    "benchmark": ("graph", "question", "words?"), "global-add": ("total", "graph", "repo"), "global-remove": ("total", "repo"), "global-list": ("total",), "cache-check": ("root", "cache"), "merge-chunks": ("out", "chunks*"),
    "save-result": ("memories", "question", "answer", "nodes*"), "reflect": ("memories", "graph"), "prs": ("prs", "graph"), "add": ("url", "folder"), "serve": ("graph",), "label": ("graph",),
}


def text_file(spark: SparkSession, path: str, value: str) -> None:
    """Writes a text where Spark writes, as one part below ``path``."""
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def export(spark: SparkSession, nodes: DataFrame, edges: DataFrame, c: DataFrame, kind: str, out: str) -> None:
    n = nodes.join(c, "id", "left")
    scored = edges.withColumn("confidence_score", graph_json.default_score(F.col("confidence")))
    labels = analysis.hub_labels(n, edges, c)
    tables = {
        "json": lambda: graph_json.graph_document(n, edges.withColumn("confidence_score", F.lit(None).cast("double"))), "cypher": lambda: graph_json.cypher(n, edges), "graphml": lambda: graph_json.graphml_elements(n, edges),
        "wiki": lambda: graph_json.wiki_articles(n, edges, c, labels).select(F.col("body").alias("value")).union(graph_json.wiki_index(n, edges, c, labels, analysis.god_nodes(n, edges)).select("body")),
    }
    texts = {"svg": lambda: draw.svg(n, edges, c), "html": lambda: draw.page(n, edges, c), "callflow-html": lambda: draw.call_flow(n, scored, n.select("id", F.coalesce(F.col("community").cast("string"), F.lit("none")).alias("section")))}
    if kind == "lines":
        graph_json.write_lines(n, edges.withColumn("confidence_score", F.lit(None).cast("double")), out)
    elif kind in tables:
        tables[kind]().write.mode("overwrite").text(out)
    elif kind in texts:
        text_file(spark, out, texts[kind]())
    else:
        raise SystemExit(f"no format {kind!r}: {', '.join([*tables, *texts, 'lines'])}")


def _global(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    held = incremental.tables_of(spark, path)
    none = spark.createDataFrame([], "id string, label string, source_file string, repo string, local_id string"), spark.createDataFrame([], "src string, dst string, relation string, confidence string")
    return held or none


def _publish(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame) -> int:
    def write(to: str) -> None:
        nodes.write.parquet(f"{to}/nodes")
        edges.write.parquet(f"{to}/edges")

    return incremental.publish(spark, path, write)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomgraph", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, names in COMMANDS.items():
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n.rstrip("?*"), nargs=n[-1] if n[-1] in "?*" else None)
        c.add_argument("--depth", type=int, default=2)
        c.add_argument("--by", default="degree")
        c.add_argument("--outcome")
        c.add_argument("--memories")
        c.add_argument("--prs")
        c.add_argument("--base", default="main")
        c.add_argument("--port", type=int)
        c.add_argument("--key")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    simple = {
        "extract": lambda: build(spark, a.root, a.graph), "update": lambda: print(incremental.refresh(spark, a.root, a.tables, 0)), "global-list": lambda: show(_global(spark, a.total)[0].groupBy("repo").agg(F.count("*").alias("n")).orderBy("repo")),
        "save-result": lambda: files.save_memory(spark, a.memories, a.question, a.answer, a.nodes, a.outcome), "add": lambda: add(spark, a.url, a.folder),
    }
    if a.command in simple:
        return simple[a.command]()
    if a.command == "watch":
        return incremental.start(spark, a.root, a.tables, f"{a.tables}/ticks").awaitTermination()
    if a.command == "diff":
        (n1, e1), (n2, e2) = load(spark, a.old), load(spark, a.new)
        return show(graph.graph_diff(n1, n2, e1, e2))
    if a.command == "merge":
        (n1, e1), (n2, e2) = load(spark, a.left), load(spark, a.right)
        graph.compose(n1, n2, ["id"]).write.mode("overwrite").parquet(f"{a.out}/nodes")
        return e1.unionByName(e2, allowMissingColumns=True).distinct().write.mode("overwrite").parquet(f"{a.out}/edges")
    if a.command == "merge-driver":
        # As version control calls it: the common ancestor says nothing that a union needs; the left folder gets the result.
        nodes, edges = graph.merge_graphs(load(spark, a.left), load(spark, a.right), most_nodes=100_000)
        nodes, edges = materialize(nodes, "merged")[0], materialize(edges, "merged")[0]
        nodes.write.mode("overwrite").parquet(f"{a.left}/nodes")
        return edges.write.mode("overwrite").parquet(f"{a.left}/edges")
    if a.command == "merge-chunks":
        parts = [load(spark, c) for c in a.chunks]
        nodes, edges = graph.merge_fragments([(n if "seq" in n.columns else n.withColumn("seq", F.lit(0)), e) for n, e in parts])
        nodes.write.mode("overwrite").parquet(f"{a.out}/nodes")
        return edges.write.mode("overwrite").parquet(f"{a.out}/edges")
    if a.command == "global-remove":
        n, e = _global(spark, a.total)
        return print(_publish(spark, a.total, n.where(F.col("repo") != a.repo), e.where(~F.col("src").startswith(f"{a.repo}::"))))
    if a.command == "cache-check":
        found = files.scan(spark, a.root).select("rel", files.content_hash(F.decode("content", "UTF-8"), F.col("rel")).alias("hash"))
        hit, miss = files.split_cache(found, spark.read.parquet(a.cache))
        return print(f"{hit.count()} files are in the cache, {miss.count()} are not")
    nodes, edges = load(spark, a.graph)
    if a.command in ("cluster", "label"):
        cluster(spark, a.graph)
        if a.command == "label":
            show(analysis.hub_labels(nodes, edges, communities(spark, a.graph)).orderBy("community"))
    elif a.command == "query":
        began = time.perf_counter()
        said = report.answer(nodes, edges, a.question, a.depth)
        print(said)
        if a.memories:
            files.log_query(spark, f"{a.memories}/log", "query", a.question, len(said.splitlines()), 1000 * (time.perf_counter() - began))
    elif a.command == "path":
        ends = [resolve.resolve_seed(nodes, x).select("id").first() for x in (a.source, a.target)]
        if all(ends):
            return print(" -> ".join(traversal.shortest_path(edges, *[e["id"] for e in ends])) or "no path")
        found = traversal.find_path(nodes, edges, a.source, a.target)
        if "error" in found:
            raise SystemExit(found["error"])
        print("\n".join([*found["warnings"], " -> ".join(found["path"] or []) or "no path"]))
    elif a.command == "explain":
        show(traversal.explain(edges, nodes, one(spark, nodes, a.node).first()["id"]))
    elif a.command == "affected":
        show(traversal.affected(edges, one(spark, nodes, a.node), depth=a.depth).orderBy("hop", "id"))
    elif a.command == "blast-radius":
        show(traversal.blast_radius(edges, one(spark, nodes, a.node), a.depth), 200)
    elif a.command == "dead-code":
        show(traversal.unreachable_functions(nodes, edges).orderBy("label", "id"), 15)
    elif a.command == "gods":
        show(analysis.god_nodes(nodes, edges, ranks=traversal.pagerank(nodes, edges.withColumn("weight", F.lit(1.0))) if a.by == "pagerank" else None))
    elif a.command == "cycles":
        show(traversal.import_cycles(edges.where("relation IN ('imports', 'imports_from', 're_exports')")), 20)
    elif a.command == "diagnose":
        show(analysis.diagnostics(edges))
        show(graph.validate(nodes, edges).groupBy("kind", "error").agg(F.count("*").alias("n")).orderBy("kind", "error"))
    elif a.command == "stats":
        show(analysis.graph_stats(nodes.join(communities(spark, a.graph), "id", "left"), edges))
    elif a.command == "report":
        c = communities(spark, a.graph)
        print(report.markdown(nodes.join(c, "id", "left"), edges, c))
    elif a.command == "benchmark":
        words = int(a.words or 50 * nodes.count())
        tokens = report.token_cost(nodes, edges, a.question)
        print(f"{words * 100 // 75} tokens of text, {tokens} for an answer" + (f", {words * 100 // 75 / tokens:.1f} times less" if tokens else ""))
    elif a.command == "tree":
        text_file(spark, a.out, draw.tree(nodes))
    elif a.command == "global-add":
        n, e = _global(spark, a.total)
        mark = graph.graph_hash(nodes, edges)
        known = f"{a.total}/hashes/{a.repo}"
        fs, at = incremental._fs(spark, known)
        if fs.exists(at) and spark.read.text(known).first()["value"] == mark:
            return print("unchanged")
        number = _publish(spark, a.total, *graph.add_graph_to_global(n, e, nodes, edges.select(*e.columns), a.repo))
        text_file(spark, known, mark)
        print(number)
    elif a.command == "reflect":
        scores = feedback.node_scores(files.read_memories(spark, a.memories), F.current_timestamp())
        feedback.overlay(nodes, feedback.verdicts(scores)).write.mode("overwrite").parquet(f"{a.graph}/learning")
        show(spark.read.parquet(f"{a.graph}/learning").orderBy(F.desc("score"), "id"))
    elif a.command in ("prs", "serve"):
        c = lambda: communities(spark, a.graph)
        prs = spark.read.schema("number long, title string, base string, ci string, review string, draft boolean, days_old int, path string").json(a.prs) if a.prs else None
        tools = server.Tools(spark, lambda: (*load(spark, a.graph), c()), a.memories, prs, a.base)
        if a.command == "prs":
            print(tools.triage_prs())
        elif a.port:
            server.http_server(tools, port=a.port, key=a.key).serve_forever()
        else:
            server.serve_lines(tools)
    elif a.command == "export":
        export(spark, nodes, edges, communities(spark, a.graph), a.format, a.out)


def add(spark: SparkSession, url: str, folder: str) -> None:
    """Notes an address among the sources, with its kind; fetching it is left to others."""
    kind = spark.range(1).select(text.url_type(F.lit(url)).alias("kind")).first()["kind"]
    body = f"---\nsource_url: {url}\ntype: {kind}\n---\n"
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("append").text(folder)
    print(kind)


if __name__ == "__main__":
    main()
