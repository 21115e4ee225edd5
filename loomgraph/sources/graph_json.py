"""Node-link JSON in and out, and text formats for other tools.

Graphs are kept as Parquet tables; JSON is for interchange. Writers use Spark's own sinks, a line or document a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import rules, text

_NODE = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("id", "label", "file_type", "source_file", "source", "source_location", "community")]))
_EDGE = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("source", "target", "from", "to", "relation", "confidence", "source_file", "context", "weight", "confidence_score")]))
_HYPER = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.StringType()), T.StructField("relation", T.StringType())] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("nodes", "members", "node_ids")]))
SCHEMA = T.StructType([T.StructField("directed", T.BooleanType()), T.StructField("nodes", _NODE), T.StructField("links", _EDGE), T.StructField("edges", _EDGE), T.StructField("hyperedges", _HYPER)])


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and hyperedges; other names for the same things are accepted. ``seq`` is the place in the file."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    nodes = raw.select(F.posexplode("nodes").alias("seq", "n")).select(F.col("n.id").alias("id"), F.coalesce("n.label", "n.id").alias("label"), "n.file_type", F.coalesce("n.source_file", "n.source").alias("source_file"), "n.source_location", F.try_to_number("n.community", F.lit("999999999")).cast("int").alias("community"), "seq")
    edges = raw.select(F.posexplode(F.coalesce("links", "edges")).alias("seq", "e")).select(
        F.coalesce("e.source", "e.from").alias("src"), F.coalesce("e.target", "e.to").alias("dst"), "e.relation", F.coalesce("e.confidence", F.lit("EXTRACTED")).alias("confidence"),
        "e.source_file", "e.context", F.coalesce(F.col("e.weight").try_cast("double"), F.lit(1.0)).alias("weight"), F.col("e.confidence_score").try_cast("double").alias("confidence_score"), "seq",
    )
    hyper = raw.select(F.explode("hyperedges").alias("h")).select("h.id", "h.label", "h.relation", F.coalesce("h.nodes", "h.members", "h.node_ids").alias("nodes"))
    return nodes, edges, hyper


def default_score(confidence: Column) -> Column:
    return F.when(confidence == "EXTRACTED", rules.DEFAULT_SCORES["EXTRACTED"]).when(confidence == "INFERRED", rules.DEFAULT_SCORES["INFERRED"]).otherwise(rules.DEFAULT_SCORES["AMBIGUOUS"])


def graph_document(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """One row ``(value)``: the whole node-link document. For graphs that fit one file; larger ones are written as tables."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "label", "file_type", "source_file", "community", F.lower("label").alias("norm_label")))).alias("nodes"))
    e = edges.select(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "confidence", F.coalesce("confidence_score", default_score(F.col("confidence"))).alias("confidence_score")).alias("e")).agg(F.array_sort(F.collect_list("e")).alias("links"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(directed).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links")).alias("value"))


def write_lines(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link records as JSON lines, ``nodes`` and ``links`` below ``path``: graphs of any size, a part a task."""
    nodes.select("id", "label", "file_type", "source_file", "source_location", F.col("community").cast("string").alias("community"), F.lower("label").alias("norm_label")).write.json(f"{path}/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "confidence", F.coalesce("confidence_score", default_score(F.col("confidence"))).alias("confidence_score")).write.json(f"{path}/links")


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``write_lines`` wrote, as ``read_graph`` gives it (no hyperedges)."""
    one = lambda t: T.StructType(t.elementType.fields)
    n = spark.read.schema(one(_NODE)).json(f"{path}/nodes")
    nodes = n.select("id", F.coalesce("label", "id").alias("label"), "file_type", F.coalesce("source_file", "source").alias("source_file"), "source_location", F.col("community").try_cast("int").alias("community"))
    e = spark.read.schema(one(_EDGE)).json(f"{path}/links")
    edges = e.select(F.coalesce("source", "from").alias("src"), F.coalesce("target", "to").alias("dst"), "relation", F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"), "source_file", "context", F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)).alias("weight"), F.col("confidence_score").try_cast("double").alias("confidence_score"))
    return nodes, edges, spark.createDataFrame([], "id string, label string, relation string, nodes array<string>")


#: Bytes of a node-link document that is read or written in one piece.
MOST_DOCUMENT = 512 << 20


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, force: bool = False) -> None:
    """Writes the document; refuses to replace a graph by a smaller one unless forced."""
    if not force:
        try:
            before = read_graph(nodes.sparkSession, path)[0].count()
        except Exception as error:  # nothing there yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            before = 0
        if nodes.count() < before:
            raise ValueError("the new graph has fewer nodes than the one it would replace")
    graph_document(nodes, edges).coalesce(1).write.mode("overwrite").text(path)


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(value)``: a MERGE statement for each node and edge."""
    q = lambda c: F.concat(F.lit("'"), text.escape_cypher(F.col(c)), F.lit("'"))
    kind = F.concat(F.upper(F.substring("file_type", 1, 1)), F.substring("file_type", 2, 100))
    n = nodes.select(F.concat(F.lit("MERGE (n:"), F.regexp_replace(kind, "[^A-Za-z0-9_]", ""), F.lit(" {id: "), q("id"), F.lit(", label: "), q("label"), F.lit("});")).alias("value"))
    rel = F.upper(F.regexp_replace("relation", "[^A-Za-z0-9_]", "_"))
    e = edges.select(F.concat(F.lit("MATCH (a {id: "), q("src"), F.lit("}), (b {id: "), q("dst"), F.lit("}) MERGE (a)-[:"), rel, F.lit(" {confidence: "), q("confidence"), F.lit("}]->(b);")))
    return n.union(e)


def graphml_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(value)``: the elements of a GraphML document; nulls are empty."""
    x = lambda c: text.escape_html(F.coalesce(F.col(c).cast("string"), F.lit("")))
    data = lambda *cs: F.concat(*[F.concat(F.lit(f'<data key="{c}">'), x(c), F.lit("</data>")) for c in cs])
    n = nodes.select(F.concat(F.lit('<node id="'), x("id"), F.lit('">'), data("label", "file_type", "source_file", "community"), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), x("src"), F.lit('" target="'), x("dst"), F.lit('">'), data("relation", "confidence"), F.lit("</edge>")))
    return n.union(e)


def wiki_articles(nodes: DataFrame, edges: DataFrame, community: DataFrame, labels: DataFrame, top: int = 25) -> DataFrame:
    """``(community, title, body)``: an article a community with its best-connected members and its links to others."""
    from pyspark.sql import Window

    from loomgraph.operators.analysis import community_links
    from loomgraph.operators.graph import degrees

    m = community.join(nodes.select("id", "label", "source_file"), "id").join(degrees(edges), "id", "left").fillna(0, ["degree"])
    first = m.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))).where(F.col("r") <= top)
    line = F.concat(F.lit("- **"), "label", F.lit("** ("), F.col("degree").cast("string"), F.lit(" connections) `"), "source_file", F.lit("`"))
    body = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]), "\n").alias("members"))
    size = community.groupBy("community").agg(F.count("*").alias("n"))
    links = community_links(edges, community)
    both = links.select(F.col("c1").alias("community"), F.col("c2").alias("other"), "n").union(links.select("c2", "c1", "n")).join(labels.toDF("other", "other_label"), "other")
    near = both.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "other_label"))), lambda x: F.concat(F.lit("- [["), x["other_label"], F.lit("]] ("), (-x["k"]).cast("string"), F.lit(")"))), "\n").alias("links"))
    j = body.join(size, "community").join(labels, "community").join(near, "community", "left")
    return j.select("community", F.col("label").alias("title"), F.concat(F.lit("# "), "label", F.lit("\n\n"), F.col("n").cast("string"), F.lit(" members\n\n"), "members", F.lit("\n\n## Links\n"), F.coalesce("links", F.lit("none"))).alias("body"))


def wiki_index(nodes: DataFrame, edges: DataFrame, community: DataFrame, labels: DataFrame, gods: DataFrame) -> DataFrame:
    """``(title, body)``: an article for each central entity with its connections by relation, and an index of all articles."""
    from loomgraph.operators.graph import symmetric

    own = gods.select("id", F.col("label").alias("title"), "degree")
    around = symmetric(edges.select("src", "dst", "relation")).join(own, F.col("src") == F.col("id")).join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("other")), "dst")
    line = F.concat(F.lit("- "), "relation", F.lit(": [["), "other", F.lit("]]"))
    told = around.groupBy("id", "title", "degree").agg(F.array_join(F.slice(F.array_sort(F.collect_set(line)), 1, 25), "\n").alias("lines"))
    where = told.join(community, "id", "left").join(labels.toDF("community", "home"), "community", "left")
    articles = where.select("title", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.col("degree").cast("string"), F.lit(" connections"), F.coalesce(F.concat(F.lit(", in [["), "home", F.lit("]]")), F.lit("")), F.lit("\n\n"), "lines").alias("body"))
    index = labels.select(F.lit(0).alias("part"), F.concat(F.lit("- [["), "label", F.lit("]]")).alias("line")).union(gods.select(F.lit(1), F.concat(F.lit("- [["), "label", F.lit("]]")))).orderBy("part", "line").limit(10_000)
    whole = index.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    return articles.union(whole.select(F.lit("index"), F.concat(F.lit("# Index\n\n"), "lines")))


def mermaid(edges: DataFrame, top: int = 40) -> DataFrame:
    """``(value)``: lines of a diagram of the strongest edges."""
    kept = edges.withColumn("score", rules.edge_score(F.col("relation"), F.col("confidence"), F.col("confidence_score"))).orderBy(F.desc("score"), "src", "dst", "relation").limit(top)
    return kept.select(F.concat(F.lit("  "), text.ascii_id(F.col("src")), F.lit(" -->|"), "relation", F.lit("| "), text.ascii_id(F.col("dst"))).alias("value"))
