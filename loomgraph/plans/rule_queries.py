"""Queries for the smaller rules: paths, scopes, limits, merging, cleaning and rankings, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import rules, text
from loomgraph.operators import analysis, feedback, graph, resolve, search, traversal
from loomgraph.plans.derived import DEGREE_SQL, GRAPH_SQL, SCORED_SQL
from loomgraph.plans.derived import edges as derived_edges
from loomgraph.plans.derived import graph as derived_graph
from loomgraph.plans.derived import nodes as derived_nodes
from loomgraph.plans.registry import query
from loomgraph.plans.storage import fresh_path
from loomgraph.sources import files as file_ops
from loomgraph.sources import graph_json, jdbc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Paths and scopes.

_FOLDERS = "CASE p_partkey % 8 WHEN 0 THEN 'credentials/' WHEN 1 THEN 'src/' WHEN 2 THEN '.secrets/x/' WHEN 3 THEN 'coverage/' WHEN 4 THEN 'my_venv/lib/' WHEN 5 THEN 'a/.claude/worktrees/b/' WHEN 6 THEN 'x.xcassets/' ELSE '' END"
_NAMES = "CASE p_size % 10 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN 'api_token.txt' WHEN 2 THEN 'token-economics-of-recall.md' WHEN 3 THEN 'icon.pdf' WHEN 4 THEN 'view.blade.php' WHEN 5 THEN 'go.sum' WHEN 6 THEN 'run' WHEN 7 THEN 'notes.qmd' WHEN 8 THEN 'secret_store.yaml' ELSE 'main.tf' END"
_TEXTS = "CASE p_size % 20 WHEN 6 THEN '#!/usr/bin/env python3' WHEN 16 THEN '#!/bin/cat' WHEN 7 THEN 'Abstract. We propose [1] a journal.' ELSE 'plain words' END"
_CLASSIFIED = f"SELECT p_partkey, concat({_FOLDERS}, {_NAMES}) AS path, {_TEXTS} AS body, p_partkey % 8 AS d, p_size % 10 AS f, p_size % 20 AS t FROM part"


@query(f"""SELECT p_partkey, CASE WHEN f IN (0, 4, 8, 9) OR t = 6 THEN 'code' WHEN f = 3 AND d <> 6 THEN 'paper' WHEN t = 7 THEN 'paper' WHEN f IN (1, 2, 7) THEN 'document' END AS kind,
d IN (0, 2) OR f IN (1, 8) AS secret, d IN (3, 4, 5) OR f = 5 AS noise FROM ({_CLASSIFIED})""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By name, extension, first line and marks of papers; folders and words for secrets; generated files."""
    _read(spark, sf_dir, "part").createOrReplaceTempView("part")
    p = F.col("path")
    return spark.sql(_CLASSIFIED).select("p_partkey", rules.doc_type(p, F.col("body")).alias("kind"), rules.is_sensitive(p).alias("secret"), rules.is_noise_path(p).alias("noise"))


@query("SELECT p_partkey, concat('src/', p_partkey % 7, '/', p_partkey, '.py') AS path FROM part")
def norm_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    raw = F.concat(F.lit("C:\\work\\src\\"), (F.col("p_partkey") % 7).cast("string"), F.lit("\\"), key, F.lit(".py"))
    return _read(spark, sf_dir, "part").select("p_partkey", text.norm_path(raw, "C:/work").alias("path"))


@query("SELECT p_partkey, p_partkey % 4 NOT IN (0, 1) AND p_partkey % 5 <> 0 OR p_partkey % 4 = 1 AS kept FROM part")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rule that matches wins, a folder's rule holds below it, ``!`` takes back."""
    p = _read(spark, sf_dir, "part")
    path = F.concat(F.lit("src/d"), (F.col("p_partkey") % 4).cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, ".log").otherwise(".py"))
    return p.select("p_partkey", (~file_ops.ignored(path, ["src/d0/", "*.log", "!src/d1/*"])).alias("kept"))


@query(f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE (source_file LIKE 'customer/%' OR source_file LIKE 'part/1%') AND NOT source_file LIKE 'customer/9%'")
def path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.path_scope(derived_nodes(spark, sf_dir), ("customer/", "part/1"), ("customer/9",)).select("id")


@query(f"WITH {GRAPH_SQL} SELECT src, dst, relation FROM edges WHERE relation IN ('calls', 'imports_from')")
def context_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of edges that a question's words ask for, by other names too."""
    kind = F.when(F.col("relation") == "calls", "call").when(F.col("relation") == "imports_from", "import").otherwise("field")
    e = derived_edges(spark, sf_dir).withColumn("context", kind)
    asked = search.question_contexts("Which module is called by it?")
    return search.filter_context(e, [*asked, "invoke"]).select("src", "dst", "relation")


@query(f"WITH {GRAPH_SQL} SELECT src, dst FROM edges WHERE relation IN ('calls', 'references')")
def prefixed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived_edges(spark, sf_dir).withColumn("relation", F.when(F.col("relation") == "references", F.concat(F.lit("shares:"), "dst")).otherwise(F.col("relation")))
    return e.where(rules.relation_matches(F.col("relation"), ("calls", "shares:*"))).select("src", "dst")


@query("SELECT doc_id, left(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), 256) AS label FROM documents")
def sanitized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.sanitize_label(F.col("text")).alias("label"))


@query("SELECT page_id, replace(replace(replace(replace(replace(left(regexp_replace(html, '[\\x00-\\x1f\\x7f]', '', 'g'), 512), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html, replace(url, '&', '&amp;') AS url FROM pages")
def sanitized_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.sanitize_metadata(F.create_map(F.lit("html"), F.col("html"), F.lit("url"), F.col("url")))
    return _read(spark, sf_dir, "pages").select("page_id", m.alias("m")).select("page_id", F.col("m")["html"].alias("html"), F.col("m")["url"].alias("url"))


@query(f"""WITH {GRAPH_SQL} SELECT 'unknown file_type gizmo' AS error FROM nodes WHERE id LIKE 'p:%9' UNION ALL SELECT 'bad node id' FROM nodes WHERE id LIKE 'c:%3' UNION ALL SELECT 'bad edge target' FROM edges WHERE relation = 'in_region'
UNION ALL SELECT concat('nodes has ', count(*), ' entries; max is 10000') FROM nodes HAVING count(*) > 10000 UNION ALL SELECT concat('edges has ', count(*), ' entries; max is 100000') FROM edges HAVING count(*) > 100000""")
def fragment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = derived_graph(spark, sf_dir)
    n = n.withColumns({"file_type": F.when(F.col("id").like("p:%9"), "gizmo").otherwise(F.col("file_type")), "id": F.when(F.col("id").like("c:%3"), F.repeat(F.lit("x"), 300)).otherwise(F.col("id"))})
    return analysis.fragment_errors(n, e.withColumn("dst", F.when(F.col("relation") != "in_region", F.col("dst"))))


# Merging and cleaning.


@query(f"WITH {GRAPH_SQL}, m AS (SELECT concat('o:', o_orderkey) AS old, concat('c:', o_custkey) AS new FROM orders) SELECT src, dst, relation FROM (SELECT coalesce(a.new, src) AS src, coalesce(b.new, dst) AS dst, relation FROM edges LEFT JOIN m a ON a.old = src LEFT JOIN m b ON b.old = dst) WHERE src <> dst")
def rewired_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders become their customers; the calls between them become self loops, which go."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    moved = _read(spark, sf_dir, "orders").select(key("o:", "o_orderkey").alias("old"), key("c:", "o_custkey").alias("new"))
    return graph.rewire(derived_edges(spark, sf_dir), moved).select("src", "dst", "relation")


@query(f"""WITH {GRAPH_SQL} SELECT 'node' AS kind, id AS a, CASE WHEN id LIKE 'c:%' THEN 'first' ELSE label END AS b FROM nodes UNION ALL SELECT 'edge', src, dst FROM edges UNION ALL SELECT 'edge', src, dst FROM edges WHERE relation = 'located_in'""")
def merged_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of an id wins, edges are concatenated."""
    n, e, _ = derived_graph(spark, sf_dir)
    n = n.select("id", "label", F.lit(0).alias("seq"))
    first = n.where("id LIKE 'c:%'").withColumn("label", F.lit("first"))
    nodes, edges = graph.merge_fragments([(first, e.where("relation = 'located_in'")), (n, e)])
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b")).union(edges.select(F.lit("edge"), "src", "dst"))


@query("SELECT CAST(sum(p_size) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END) AS BIGINT) AS output_tokens FROM part")
def fragment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.token_sums(_read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("input_tokens"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey").cast("long")).alias("output_tokens")))


@query(f"""WITH {GRAPH_SQL}, e2 AS (SELECT src, dst, relation, CASE WHEN relation = 'in_region' THEN 'INFERRED' ELSE confidence END AS confidence FROM edges) SELECT * FROM e2""")
def merged_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a graph: the right one's edges win, each once."""
    n, e, _ = derived_graph(spark, sf_dir)
    n = n.select("id", "label")
    return graph.merge_graphs((n, e), (n, e.where("relation = 'in_region'").withColumn("confidence", F.lit("INFERRED"))))[1]


@query("SELECT true AS same_order, false AS changed")
def topology_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, cols = derived_edges(spark, sf_dir), ["src", "dst", "relation"]
    same = graph.same_topology(e, e.orderBy(F.desc("dst")).withColumn("confidence", F.lit("x")), cols)
    return spark.createDataFrame([(same, graph.same_topology(e, e.where("src <> 'n:1'"), cols))], "same_order boolean, changed boolean")


_HYPER = "SELECT concat('h', o_custkey % 50) AS id, concat('h', o_custkey % 50) AS label, 'form' AS relation, CASE o_custkey % 50 % 3 WHEN 0 THEN 'old.md' ELSE 'kept.md' END AS source_file, concat('o:', o_orderkey) AS member FROM orders"


@query(f"""WITH {GRAPH_SQL}, h AS ({_HYPER}), kept AS (SELECT id, member FROM h WHERE source_file <> 'old.md' AND member NOT LIKE '%7'), fresh AS (SELECT concat('g', n_regionkey) AS id, concat('n:', n_nationkey) AS member FROM nation)
SELECT id, count(*) AS members, min(member) AS least FROM (SELECT * FROM kept UNION ALL SELECT * FROM fresh) GROUP BY id HAVING count(*) >= 2""")
def hyperedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old hyperedges are carried on unless their source is rebuilt; members that are gone go, and what has less than two."""
    for name in ("orders", "nation"):
        _read(spark, sf_dir, name).createOrReplaceTempView(name)
    n = derived_nodes(spark, sf_dir).where("id NOT LIKE 'o:%7'")
    old = spark.sql(_HYPER).groupBy("id", "label", "relation", "source_file").agg(F.collect_list("member").alias("nodes"))
    new = spark.table("nation").groupBy(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("id")).agg(F.collect_list(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string"))).alias("nodes"))
    new = new.select("id", F.col("id").alias("label"), F.lit("form").alias("relation"), F.lit("old.md").alias("source_file"), "nodes")
    carried = graph.attach_hyperedges(new, old.join(new.select("source_file"), "source_file", "left_anti").select(*new.columns))
    return graph.clean_hyperedges(carried, n).select("id", F.size("nodes").cast("long").alias("members"), F.array_min("nodes").alias("least"))


@query("""WITH t AS (SELECT item_id, text, (length(text) >= 80 OR len(regexp_split_to_array(trim(text), '\\s+')) >= 8) AND regexp_matches(text, '[.!?:]') AS why FROM benchmark) SELECT concat('t', item_id % 10) AS id, count(*) AS reasons FROM (SELECT DISTINCT item_id % 10 AS item_id, text FROM t WHERE why) GROUP BY 1""")
def rationale_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that are nodes of their own move to the nodes they explain."""
    b = _read(spark, sf_dir, "benchmark")
    key = F.col("item_id").cast("string")
    target = F.concat(F.lit("t"), (F.col("item_id") % 10).cast("string"))
    said = b.select(F.concat(F.lit("w"), key).alias("id"), F.col("text").alias("label"), F.lit("concept").alias("file_type"))
    nodes = said.union(b.select(target.alias("id"), target.alias("label"), F.lit("code").alias("file_type")).distinct())
    kept, _ = graph.drop_rationale(nodes, b.select(F.concat(F.lit("w"), key).alias("src"), target.alias("dst"), F.lit("rationale_for").alias("relation")))
    return kept.where("file_type = 'code' AND rationale IS NOT NULL").select("id", F.size(F.split("rationale", "\n\n")).cast("long").alias("reasons"))


@query("SELECT DISTINCT concat('backup/', CAST(o_orderdate AS DATE)) AS path, CAST(o_orderdate AS DATE) AS day FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 14")
def expired_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return graph.expired(_read(spark, sf_dir, "orders").select(F.concat(F.lit("backup/"), day.cast("string")).alias("path"), day.alias("day")).distinct(), "1998-01-01")


_SMALL = "trim(regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(f"WITH {GRAPH_SQL}, n AS (SELECT id, {_SMALL} AS name, row_number() OVER (PARTITION BY {_SMALL} ORDER BY CASE WHEN regexp_matches(id, '_c[0-9]+$') THEN 1 ELSE 0 END, length(id), id) AS r FROM nodes WHERE id LIKE 'p:%' OR id LIKE 'n:%') SELECT id FROM n WHERE r = 1")
def label_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and nations of one label made one."""
    n, e, _ = derived_graph(spark, sf_dir)
    n = n.where("id LIKE 'p:%' OR id LIKE 'n:%'").withColumn("seq", F.lit(0))
    return graph.by_label(n, e)[0].select("id")


_RAW_NODES = "SELECT CASE WHEN id LIKE 'o:%' THEN concat(regexp_replace(string_split(source_file, '/')[-1], '[.].*$', ''), '_', replace(id, ':', '_')) ELSE id END"


@query(f"""WITH {GRAPH_SQL}, long_ AS (SELECT id, CASE WHEN id LIKE 'o:%' THEN concat('orders_', string_split(string_split(source_file, '/')[-1], '.')[1], '_', replace(id, ':', '_')) ELSE id END AS new FROM nodes),
e AS (SELECT a.new AS src, b.new AS dst, relation FROM edges JOIN long_ a ON a.id = src JOIN long_ b ON b.id = dst WHERE NOT (relation = 'calls' AND confidence = 'INFERRED' AND src LIKE '%:%1'))
SELECT 'node' AS kind, new AS a, NULL AS b FROM long_ UNION ALL SELECT 'edge', src, dst FROM e""")
def built_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with short ids, unknown types, windows paths and loose ends become a graph; inferred calls to another language go."""
    n, e, _ = derived_graph(spark, sf_dir)
    ours = F.col("id").like("o:%")
    short = F.concat(F.regexp_replace(text.base_name(F.col("source_file")), r"\..*$", ""), F.lit("_"), F.replace("id", F.lit(":"), F.lit("_")))
    raw = n.select(F.when(ours, short).otherwise(F.col("id")).alias("id"), "label", F.lit("tool").alias("file_type"), F.replace(F.when(F.col("id").like("o:%1"), F.replace("source_file", F.lit(".py"), F.lit(".go"))).otherwise(F.col("source_file")), F.lit("/"), F.lit("\\")).alias("source_file"), F.when(~ours, "ast").alias("origin"), F.lit(0).alias("seq"), F.col("id").alias("was"))
    known = raw.select("was", F.col("id").alias("short"))
    ends = e.join(known.toDF("src", "s"), "src").join(known.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "relation", "confidence")
    loose = spark.createDataFrame([("nowhere", "n:1", "calls", "EXTRACTED")], ends.schema)
    nodes, folded = graph.build(raw.drop("was").union(raw.drop("was").limit(5).withColumn("id", F.lit(None).cast("string"))), ends.union(loose))
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).union(folded.select(F.lit("edge"), "src", "dst"))


@query(f"""WITH {GRAPH_SQL} SELECT 'node' AS kind, id AS a, CASE WHEN source_file = 'customer/1.py' THEN upper(label) ELSE label END AS b FROM nodes WHERE source_file <> 'part/3.py' UNION ALL
SELECT 'edge', src, dst FROM edges e JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst WHERE s.source_file <> 'part/3.py' AND d.source_file <> 'part/3.py' AND NOT (s.source_file = 'customer/1.py' AND relation = 'located_in') AND NOT (relation = 'calls' AND confidence = 'INFERRED' AND d.source_file NOT LIKE '%.py')""")
def merged_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file rebuilt without its edges, one removed: the rest of the graph stays as it is."""
    n, e, _ = derived_graph(spark, sf_dir)
    files = n.select("id", "source_file")
    n = n.select("id", "label", "file_type", "source_file")
    e = e.join(files.toDF("src", "source_file"), "src").select("src", "dst", "relation", "confidence", "source_file")
    fresh = n.where("source_file = 'customer/1.py'").withColumn("label", F.upper("label"))
    nodes, edges = graph.build_merge((n, e), (fresh, e.limit(0)), spark.createDataFrame([("part/3.py",)], "source_file string"))
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b")).union(edges.select(F.lit("edge"), "src", "dst"))


# Questions and rankings.


@query(f"WITH {GRAPH_SQL} SELECT DISTINCT id, unnest(list_transform(regexp_extract_all(label, '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda t: lower(t))) AS token FROM nodes")
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general tokeniser, accents and all."""
    return derived_nodes(spark, sf_dir).select("id", F.explode(text.search_tokens(F.col("label"))).alias("token")).distinct()


@query(f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE contains(lower(label), 'supplier#000000007')")
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A superset by letters, then what holds the needle itself."""
    n = derived_nodes(spark, sf_dir)
    some = search.trigram_candidates(n, ["supplier#000000007"], share=1.0)
    return n.join(some, "id", "left_semi").where(F.lower("label").contains("supplier#000000007")).select("id")


@query("""WITH d AS (SELECT o_orderkey AS number, CASE o_orderkey % 8 WHEN 0 THEN 'READY' WHEN 1 THEN 'WRONG-BASE' WHEN 2 THEN 'STALE' WHEN 3 THEN 'CI-FAIL' WHEN 4 THEN 'PENDING' WHEN 5 THEN 'DRAFT' WHEN 6 THEN 'APPROVED' ELSE 'OTHER' END AS status, o_custkey % 30 AS days_old FROM orders)
SELECT number, row_number() OVER (ORDER BY CASE status WHEN 'WRONG-BASE' THEN 1 WHEN 'CI-FAIL' THEN 2 WHEN 'DRAFT' THEN 4 WHEN 'STALE' THEN 5 WHEN 'PENDING' THEN 6 WHEN 'APPROVED' THEN 7 WHEN 'READY' THEN 8 ELSE 99 END, days_old, number) AS place FROM d""")
def pr_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 8
    status = F.element_at(F.array(*map(F.lit, ("READY", "WRONG-BASE", "STALE", "CI-FAIL", "PENDING", "DRAFT", "APPROVED", "OTHER"))), (k + 1).cast("int"))
    prs = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), status.alias("status"), (F.col("o_custkey") % 30).alias("days_old"))
    return analysis.pr_order(prs).select("number", F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT doc_id % 40 AS community, count(*) AS n, string_agg(lower(text), ' ') AS t FROM documents GROUP BY 1), h AS (SELECT *, len(regexp_extract_all(t, '\\b(the)\\b')) AS en, len(regexp_extract_all(t, '\\b(les)\\b')) + len(regexp_extract_all(t, '\\b(des)\\b')) AS fr FROM c)
SELECT community, CASE WHEN greatest(en, fr) >= 2 THEN CASE WHEN en >= fr THEN 'english' ELSE 'french' END ELSE 'plain' END AS section FROM h""")
def section_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    rows = d.select((F.col("doc_id") % 40).alias("community"), F.lit("plain").alias("label"), "text", F.lit(1).alias("n"))
    return analysis.section_ranking(rows, {"english": ("the",), "french": ("les", "des")}, 60).select("community", "section")


@query(f"""WITH {GRAPH_SQL}, {SCORED_SQL}, u AS (SELECT *, confidence_score + CASE WHEN confidence = 'EXTRACTED' THEN 2.0 ELSE 0.0 END + CASE WHEN relation IN ('calls', 'uses', 'method') THEN 1.0 WHEN relation IN ('imports', 'imports_from') THEN 0.6 ELSE 0.0 END AS score FROM scored WHERE (confidence = 'EXTRACTED' OR (confidence = 'INFERRED' AND confidence_score >= 0.85)) AND relation IN ('calls', 'uses', 'method', 'imports', 'imports_from')),
k AS (SELECT id, sum(o) AS o, sum(i) AS i FROM (SELECT src AS id, 1 AS o, 0 AS i FROM u UNION ALL SELECT dst, 0, 1 FROM u) GROUP BY id), entry AS (SELECT id, 0 AS part, row_number() OVER (ORDER BY o - i DESC, o DESC, id) AS r FROM k WHERE o > 0 ORDER BY r LIMIT 8),
strong AS (SELECT *, row_number() OVER (ORDER BY score DESC, src, dst, relation) AS r FROM u ORDER BY r LIMIT 24), ends AS (SELECT * FROM entry UNION ALL SELECT src, 1, 2 * r FROM strong UNION ALL SELECT dst, 1, 2 * r + 1 FROM strong),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, r) AS k FROM ends) WHERE k = 1) SELECT id, CAST(row_number() OVER (ORDER BY part, r) AS INTEGER) AS place FROM f ORDER BY part, r LIMIT 24""")
def diagram_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = derived_graph(spark, sf_dir)
    scored = e.withColumn("confidence_score", F.when(F.col("confidence") == "EXTRACTED", 1.0).when(F.col("confidence") == "INFERRED", 0.9).otherwise(0.2))
    return analysis.diagram_nodes(n, scored)


@query(f"WITH {GRAPH_SQL} SELECT count(*) AS n, round_even(avg(CASE WHEN src LIKE '%3' THEN 0.5 ELSE 0.9 END), 2) AS average FROM edges WHERE confidence = 'INFERRED'")
def inferred_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.inferred_average(derived_edges(spark, sf_dir).withColumn("confidence_score", F.when(~F.col("src").like("%3"), 0.9)))


@query(f"""WITH {GRAPH_SQL}, one AS (SELECT id, 'one.py' AS f, community FROM nodes), {DEGREE_SQL}, j AS (SELECT e.*, x.community AS ca, y.community AS cb FROM edges e JOIN one x ON x.id = src JOIN one y ON y.id = dst WHERE x.community <> y.community AND relation NOT IN ('imports', 'imports_from', 'contains', 'method')),
r AS (SELECT *, row_number() OVER (PARTITION BY least(ca, cb), greatest(ca, cb) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, src, dst, relation) AS k FROM j)
SELECT src, dst, relation, confidence FROM r WHERE k = 1 ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, src, dst, relation LIMIT 5""")
def surprising_in_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, c = derived_graph(spark, sf_dir)
    return analysis.surprising(n.withColumn("source_file", F.lit("one.py")), e, c).select("src", "dst", "relation", "confidence")


@query(f"""WITH RECURSIVE {GRAPH_SQL}, walk(id, hop) AS (SELECT DISTINCT concat('s:', s_suppkey), 0 FROM supplier WHERE s_suppkey % 13 = 5 UNION SELECT src, hop + 1 FROM walk JOIN edges ON dst = id AND relation IN ('calls', 'references', 'imports_from') WHERE hop < 2)
SELECT id, min(hop) AS hop FROM walk GROUP BY id HAVING min(hop) > 0""")
def changed_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the lines that changed in a file to the definitions they touch, and to all that these affect."""
    n, e, _ = derived_graph(spark, sf_dir)
    hunk = spark.createDataFrame([("supplier/5.go", 0, 1 << 30)], "file string, start int, end int")
    touched = resolve.changed_definitions(n, hunk).select("id").distinct()
    return traversal.affected(e, touched).select("id", "hop")


@query(f"WITH {GRAPH_SQL} SELECT id, label, source_file, CAST(community AS INTEGER) AS community FROM nodes UNION ALL SELECT concat(src, '>', dst), relation, confidence, CAST(NULL AS INTEGER) FROM edges")
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as node-link lines, a part a task, and read back."""
    n, e, _ = derived_graph(spark, sf_dir)
    path = fresh_path(spark, "node-link")
    graph_json.write_lines(n, e.withColumn("confidence_score", F.lit(None).cast("double")), path)
    nodes, edges, _ = graph_json.read_lines(spark, path)
    return nodes.select("id", "label", "source_file", "community").union(edges.select(F.concat("src", F.lit(">"), "dst"), "relation", "confidence", F.lit(None).cast("int")))


@query("""SELECT event_id, concat('question ', event_id) AS question, CASE event_type WHEN 'error' THEN 'dead_end' ELSE 'useful' END AS outcome, concat('u:', user_id, '|k:', event_id % 20) AS nodes FROM events""")
def memory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of answers, written as Markdown with front matter, parsed again."""
    e = _read(spark, sf_dir, "events")
    key = F.col("event_id").cast("string")
    docs = e.select(F.concat(F.lit("question "), key).alias("question"), F.when(F.col("event_type") == "error", "dead_end").otherwise("useful").alias("outcome"), F.col("ts").cast("timestamp").alias("date"), F.lit(None).cast("string").alias("correction"), F.array(F.concat(F.lit("u:"), F.col("user_id").cast("string")), F.concat(F.lit("k:"), (F.col("event_id") % 20).cast("string"))).alias("source_nodes"), F.lit("It is so.").alias("answer"))
    read = file_ops.parse_memories(docs.select(file_ops.memory_text().alias("value")))
    return read.select(F.substring("question", 10, 20).cast("long").alias("event_id"), "question", "outcome", F.array_join("source_nodes", "|").alias("nodes"))


@query("SELECT concat('fk', n_nationkey) AS name, n_name AS src, r_name AS dst, 'a,b' AS columns FROM nation JOIN region ON n_regionkey = r_regionkey")
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of several columns in their order, from rows as information schemas have them."""
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    name = F.concat(F.lit("fk"), F.col("n_nationkey").cast("string")).alias("name")
    columns = n.select(name, F.explode(F.array(F.struct(F.lit(2).alias("place"), F.lit("b").alias("column")), F.struct(F.lit(1).alias("place"), F.lit("a").alias("column")))).alias("c")).select("name", "c.*")
    return jdbc.foreign_keys(n.select(name, F.col("n_name").alias("table")), columns, n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(name, F.col("r_name").alias("target")))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('{"n": ', event_id, ', "t": "', event_type, '"}') WHEN 1 THEN concat('{"n": ', event_id, '}') END AS found FROM events""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first object in an answer: in a fence, after prose and a broken one, or none."""
    k, key = F.col("event_id") % 3, F.col("event_id").cast("string")
    fenced = F.concat(F.lit('```json\n{"t": "'), "event_type", F.lit('", "n": '), key, F.lit("}\n```"))
    raw = F.when(k == 0, fenced).when(k == 1, F.concat(F.lit("Well, {this is not it. {\"n\": "), key, F.lit("} indeed {}"))).otherwise("no object { at all")
    return _read(spark, sf_dir, "events").select("event_id", file_ops.first_object(raw).alias("found"))


@query("SELECT node, round(sum(s), 6) AS score, count(*) AS n FROM (SELECT concat('u:', user_id) AS node, CASE event_type WHEN 'error' THEN -1 ELSE 1 END * pow(0.5, greatest(0, epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 86400e6 / 30) AS s FROM events) GROUP BY node")
def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed scores by a stream over the events, as they stand when it has read them all."""
    path = fresh_path(spark, "signals")
    e = _read(spark, sf_dir, "events")
    signals = e.select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("node"), F.when(F.col("event_type") == "error", "dead_end").otherwise("useful").alias("outcome"), F.col("ts").cast("timestamp").alias("date"))
    signals.write.parquet(path)
    from loomgraph.streaming import incremental

    stream = incremental.streaming_scores(spark.readStream.schema(signals.schema).parquet(path), "2024-03-01 00:00:00")
    out = fresh_path(spark, "scores")
    done = stream.writeStream.outputMode("complete").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", fresh_path(spark, "scores-offsets")).trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(out).select("node", F.round("score", 6).alias("score"), "n")


@query("SELECT node FROM (SELECT concat('u:', user_id) AS node, count(*) FILTER (event_type = 'click') AS pos, count(*) FILTER (event_type = 'error') AS neg FROM events GROUP BY 1) WHERE pos > 0 AND neg > 0")
def contested_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "click", "useful").when(F.col("event_type") == "error", "dead_end").otherwise("seen")
    docs = e.select(outcome.alias("outcome"), F.col("ts").cast("timestamp").alias("date"), F.array(F.concat(F.lit("u:"), F.col("user_id").cast("string"))).alias("source_nodes"))
    return feedback.verdicts(feedback.node_scores(docs, F.to_timestamp(F.lit("2024-03-01")))).where("status = 'contested'").select("node")


# Names across files.


@query("""SELECT concat('src/a', p_partkey, '.ts') AS file, './b' || p_partkey AS spec, CASE WHEN p_partkey % 3 = 0 THEN concat('src/b', p_partkey, '.ts') ELSE concat('src/b', p_partkey, '/index.ts') END AS target FROM part WHERE p_partkey % 3 <> 2
UNION ALL SELECT concat('src/a', p_partkey, '.ts'), '@/c' || p_partkey, concat('lib/c', p_partkey, '.js') FROM part""")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative and aliased imports by the first ending that exists; some files are missing."""
    key, p = F.col("p_partkey").cast("string"), _read(spark, sf_dir, "part")
    file = F.concat(F.lit("src/a"), key, F.lit(".ts")).alias("file")
    imports = p.select(file, F.concat(F.lit("./b"), key).alias("spec")).union(p.select(file, F.concat(F.lit("@/c"), key)))
    own = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("src/b"), key, F.lit(".ts"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("src/b"), key, F.lit("/index.ts")))
    known = p.select(own.alias("path")).where("path IS NOT NULL").union(p.select(F.concat(F.lit("lib/c"), key, F.lit(".js"))))
    return resolve.import_targets(imports, known, {"@/": "lib"})


@query("""WITH d AS (SELECT concat('N', p_partkey % 3) AS namespace, concat('T', p_partkey % 101) AS name, min(concat('d', p_partkey)) AS id FROM part GROUP BY 1, 2), u AS (SELECT concat('u', p_partkey) AS src, concat('F', p_partkey % 10) AS file, concat('T', p_partkey % 120) AS name FROM part),
s AS (SELECT DISTINCT concat('F', f) AS file, concat('N', (f + i) % 3) AS namespace FROM generate_series(0, 9) a(f), generate_series(0, 1) b(i) WHERE f % 2 = 1 OR i = 0), h AS (SELECT src, u.name, count(DISTINCT id) AS n, min(id) AS id FROM u JOIN s USING (file) JOIN d ON d.namespace = s.namespace AND d.name = u.name GROUP BY 1, 2)
SELECT DISTINCT u.src, u.name, CASE WHEN n = 1 THEN id ELSE concat('stub:', u.name) END AS dst FROM u LEFT JOIN h ON h.src = u.src AND h.name = u.name""")
def types_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type's one definition in the namespaces that a file sees; with none or several a stub."""
    p, k = _read(spark, sf_dir, "part"), F.col("p_partkey")
    text_of = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    definitions = p.select(text_of("d", k).alias("id"), text_of("N", k % 3).alias("namespace"), text_of("T", k % 101).alias("name"))
    uses = p.select(text_of("u", k).alias("src"), text_of("F", k % 10).alias("file"), text_of("T", k % 120).alias("name"))
    f = spark.range(10).select(F.col("id").alias("f"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).where("f % 2 = 1 OR i = 0")
    scopes = f.select(text_of("F", F.col("f")).alias("file"), text_of("N", (F.col("f") + F.col("i")) % 3).alias("namespace"))
    return resolve.types_in_scope(uses, scopes, definitions)


@query("""SELECT concat('f', p_partkey) AS src, concat('class', p_partkey) AS dst FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 <> 0 UNION ALL SELECT concat('f', p_partkey), concat('m', p_partkey) FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 5 <> 0""")
def member_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Name.new`` and methods of a receiver whose type is known; every fifth class has a namesake, so nothing is told of it."""
    p, k = _read(spark, sf_dir, "part"), F.col("p_partkey")
    t = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    classes = p.select(t("class").alias("id"), t("C").alias("name")).union(p.where(k % 5 == 0).select(t("twin"), t("C")))
    calls = p.select(t("f").alias("caller"), t("C").alias("receiver"), t("C").alias("receiver_type"), F.when(k % 2 == 0, "new").otherwise("run").alias("method"))
    return resolve.member_calls(calls, classes, p.select(t("m").alias("id"), t("class").alias("class_id"), F.lit("run").alias("name")))
