"""The property graph that queries run on, derived from the star-schema tables.

Nodes: region, nation, customer, supplier, part, order. Edges: in_region, located_in, calls (order to customer),
references (order to part), imports_from (part to supplier). ``seq`` never depends on row order.
The same graph is stated once for Spark and once for any ANSI engine (``GRAPH_SQL``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators import graph as graph_ops
from loomgraph.operators import traversal
from loomgraph.plans.storage import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Node and edge views in SQL that Spark and DuckDB both read. Communities: of places, customers and suppliers their region, of parts and orders
#: what their number leaves, so edges run within communities and between them.
NODES_SQL = """
SELECT concat('r:', r_regionkey) AS id, r_name AS label, 'concept' AS file_type, concat('region/', r_regionkey % 2, '.md') AS source_file, concat('L', r_regionkey) AS source_location, CAST(r_regionkey AS BIGINT) AS community FROM region
UNION ALL SELECT concat('n:', n_nationkey), n_name, 'concept', concat('nation/', n_nationkey % 5, '.md'), concat('L', n_nationkey), CAST(n_regionkey AS BIGINT) FROM nation
UNION ALL SELECT concat('c:', c_custkey), c_name, 'code', concat('customer/', c_custkey % 97, '.py'), concat('L', c_custkey), CAST(n_regionkey AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('s:', s_suppkey), s_name, 'code', concat('supplier/', s_suppkey % 13, '.go'), concat('L', s_suppkey), CAST(n_regionkey AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('p:', p_partkey), p_name, 'code', concat('part/', p_partkey % 41, '.py'), concat('L', p_partkey), CAST(p_partkey % 7 AS BIGINT) FROM part
UNION ALL SELECT concat('o:', o_orderkey), concat('Order#', o_orderkey), 'code', concat('orders/', o_orderkey % 211, '.py'), concat('L', o_orderkey), CAST(o_orderkey % 5 AS BIGINT) FROM orders
"""

EDGES_SQL = """
SELECT concat('n:', n_nationkey) AS src, concat('r:', n_regionkey) AS dst, 'in_region' AS relation, 'EXTRACTED' AS confidence FROM nation
UNION ALL SELECT concat('c:', c_custkey), concat('n:', c_nationkey), 'located_in', 'EXTRACTED' FROM customer
UNION ALL SELECT concat('s:', s_suppkey), concat('n:', s_nationkey), 'located_in', 'EXTRACTED' FROM supplier
UNION ALL SELECT concat('o:', o_orderkey), concat('c:', o_custkey), 'calls', CASE o_orderstatus WHEN 'F' THEN 'EXTRACTED' WHEN 'O' THEN 'INFERRED' ELSE 'AMBIGUOUS' END FROM orders
UNION ALL SELECT concat('o:', l_orderkey), concat('p:', l_partkey), 'references', min(CASE l_returnflag WHEN 'A' THEN 'AMBIGUOUS' WHEN 'N' THEN 'EXTRACTED' ELSE 'INFERRED' END) FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL SELECT concat('p:', l_partkey), concat('s:', l_suppkey), 'imports_from', min(CASE l_returnflag WHEN 'A' THEN 'AMBIGUOUS' WHEN 'N' THEN 'EXTRACTED' ELSE 'INFERRED' END) FROM lineitem GROUP BY l_partkey, l_suppkey
"""

GRAPH_SQL = f"nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})"


#: Scores and contexts of edges, and communities, in both forms.
SCORED_SQL = "scored AS (SELECT *, CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.9 ELSE 0.2 END AS confidence_score FROM edges)"
COMMUNITY_SQL = "comm AS (SELECT id, community FROM nodes WHERE community IS NOT NULL)"
DEGREE_SQL = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the named tables; scans stay lazy and column-pruned."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


#: Derived tables that were written, by application, folder, table and the state of the files they come from.
_WRITTEN: dict[tuple, str] = {}


def _state(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """Sizes and times of the tables' files: what was derived from other files isn't used."""
    out = []
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    return tuple(out)


def _kept(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make: Callable[[], list[DataFrame]]) -> DataFrame:
    """The rows of ``make()``, written once, part by part, to shared storage for all queries of an application."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir, tables))
    if key not in _WRITTEN:
        register(spark, sf_dir, *tables)
        _WRITTEN[key] = materialize((made := make())[0], f"derived-{name}", *made[1:])[1]
    return spark.read.parquet(_WRITTEN[key])


_NODE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders")
_EDGE_TABLES = ("nation", "customer", "supplier", "orders", "lineitem")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "nodes", _NODE_TABLES, lambda: [spark.sql(NODES_SQL)])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "edges", _EDGE_TABLES, lambda: [spark.sql(part) for part in EDGES_SQL.split("UNION ALL")])


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, degree)`` of every node on an edge."""
    return _kept(spark, sf_dir, "degrees", _EDGE_TABLES, lambda: [graph_ops.degrees(edges(spark, sf_dir))])


def neighbourhood(spark: SparkSession, sf_dir: str) -> traversal.Neighbours:
    """Both directions of every pair, bucketed by their first end: what traversals walk on."""
    key = (spark.sparkContext.applicationId, sf_dir, "both", _state(spark, sf_dir, _EDGE_TABLES))
    if key not in _WALKED:
        _WALKED[key] = traversal.neighbours(edges(spark, sf_dir))
    return _WALKED[key]


_WALKED: dict[tuple, traversal.Neighbours] = {}


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and communities."""
    n = nodes(spark, sf_dir)
    return n, edges(spark, sf_dir), n.where("community IS NOT NULL").select("id", "community")
