"""Queries over the plain tables: names, search, feedback, changes, pages, entities, extraction, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import rules, text
from loomgraph.operators import analysis, entities, feedback, graph, resolve, search
from loomgraph.plans.derived import GRAPH_SQL
from loomgraph.plans.derived import graph as derived_graph
from loomgraph.plans.derived import nodes as derived_nodes
from loomgraph.plans.registry import query
from loomgraph.sources import extract as extractors
from loomgraph.sources import files as file_ops
from loomgraph.streaming import incremental

NOW = "2024-03-01 00:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Names and paths.


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS own_id FROM part")
def make_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", text.make_id(F.concat_ws(" ", "p_name", "p_brand")).alias("own_id"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'document' WHEN 'click' THEN 'code' WHEN 'signup' THEN 'concept' WHEN 'purchase' THEN 'paper' ELSE 'concept' END AS file_type FROM events""")
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", "markdown").when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "purchase", "paper").when(F.col("event_type") == "signup", "gizmo")
    return _read(spark, sf_dir, "events").select("event_id", rules.file_type(raw).alias("file_type"))


_PATHS = """SELECT p_partkey, concat(CASE p_size % 5 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/latest/' WHEN 2 THEN 'node_modules/x/' WHEN 3 THEN '.ssh/' ELSE 'src/' END, CASE p_partkey % 4 WHEN 0 THEN 'test_' ELSE 'm' END, p_partkey,
CASE p_partkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.png' WHEN 3 THEN '.pdf' WHEN 4 THEN '.mp4' ELSE '.bin' END) AS path, p_size, p_partkey AS k FROM part"""


@query(f"""SELECT p_partkey, CASE k % 6 WHEN 0 THEN 'code' WHEN 1 THEN 'document' WHEN 2 THEN 'image' WHEN 3 THEN 'paper' WHEN 4 THEN 'video' END AS kind, p_size % 5 = 0 OR (k % 4 = 0 AND k % 6 = 0) AS is_test, p_size % 5 = 2 AS is_noise, p_size % 5 = 3 AS is_sensitive FROM ({_PATHS})""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "part").createOrReplaceTempView("part")
    p = F.col("path")
    return spark.sql(_PATHS).select("p_partkey", rules.doc_type(p).alias("kind"), rules.is_test_path(p).alias("is_test"), rules.is_noise_path(p).alias("is_noise"), rules.is_sensitive(p).alias("is_sensitive"))


@query("SELECT doc_id, CASE WHEN trim(text, E' \\n\\t\\r') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, E' \\n\\t\\r'), '\\s+')) END AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("""SELECT p_partkey, round(list_sum(list_transform(list_distinct(c), lambda x: -(len(list_filter(c, lambda y: y = x)) / len(c)) * log2(len(list_filter(c, lambda y: y = x)) / len(c)))), 9) AS bits FROM (SELECT p_partkey, string_split(p_name, '') AS c FROM part)""")
def label_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", F.round(text.entropy(F.col("p_name")), 9).alias("bits"))


@query("SELECT item_id, (length(text) >= 80 OR len(regexp_split_to_array(trim(text), '\\s+')) >= 8) AND regexp_matches(text, '[.!?:]') AS sentence FROM benchmark")
def rationale_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select("item_id", rules.is_rationale_sentence(F.col("text")).alias("sentence"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'WRONG-BASE' WHEN o_orderpriority LIKE '1%' THEN 'CI-FAIL' WHEN o_orderstatus = 'P' THEN 'CHANGES-REQ' WHEN o_custkey % 5 = 0 THEN 'DRAFT' WHEN o_orderkey % 30 >= 14 THEN 'STALE'
WHEN o_orderstatus = 'F' THEN 'APPROVED' WHEN o_orderpriority LIKE '2%' THEN 'PENDING' ELSE 'READY' END AS status FROM orders""")
def pr_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("o_custkey") % 7 == 0, "old").otherwise("main")
    ci = F.when(F.col("o_orderpriority").like("1%"), "FAILURE").when(F.col("o_orderpriority").like("2%"), "PENDING").otherwise("SUCCESS")
    review = F.when(F.col("o_orderstatus") == "P", "CHANGES_REQUESTED").when(F.col("o_orderstatus") == "F", "APPROVED")
    return _read(spark, sf_dir, "orders").select("o_orderkey", rules.pr_status(base, ci, review, F.col("o_custkey") % 5 == 0, F.col("o_orderkey") % 30).alias("status"))


# Pages.


@query("""SELECT page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\f\\r\\v]+', ' ', 'g')), 8000) AS text FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("""SELECT page_id, CASE WHEN u LIKE '%twitter.com%' OR u LIKE '%x.com%' THEN 'tweet' WHEN u LIKE '%arxiv.org%' THEN 'arxiv' WHEN u LIKE '%github.com%' THEN 'github' WHEN u LIKE '%youtube.com%' OR u LIKE '%youtu.be%' THEN 'youtube'
WHEN p LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(p, '\\.(png|jpg|jpeg|webp|gif)$') THEN 'image' ELSE 'webpage' END AS kind FROM (SELECT page_id, lower(url) AS u, regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)""")
def url_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", text.url_type(F.col("url")).alias("kind"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<a href=)"), F.lit(1))).alias("links"))


@query("SELECT page_id, sha256(concat(html, chr(0), lower(url))) AS hash FROM pages")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", file_ops.content_hash(F.col("html"), F.col("url")).alias("hash"))


@query("""WITH o AS (SELECT url AS path, md5(html) AS hash FROM pages WHERE page_id % 5 <> 0), n AS (SELECT url AS path, md5(CASE WHEN page_id % 4 = 0 THEN concat(html, '!') ELSE html END) AS hash FROM pages WHERE page_id % 7 <> 0),
o1 AS (SELECT path, min(hash) AS hash FROM o GROUP BY path), n1 AS (SELECT path, min(hash) AS hash FROM n GROUP BY path)
SELECT coalesce(o1.path, n1.path) AS path, CASE WHEN o1.hash IS NULL THEN 'new' WHEN n1.hash IS NULL THEN 'deleted' WHEN o1.hash = n1.hash THEN 'unchanged' ELSE 'changed' END AS state FROM o1 FULL JOIN n1 ON o1.path = n1.path""")
def manifest_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    once = lambda d: d.groupBy("path").agg(F.min("hash").alias("hash"))
    old = p.where("page_id % 5 <> 0").select(F.col("url").alias("path"), F.md5("html").alias("hash"))
    new = p.where("page_id % 7 <> 0").select(F.col("url").alias("path"), F.md5(F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).alias("hash"))
    return graph.file_changes(once(old), once(new))


@query("""WITH k AS (SELECT concat('site/page', page_id, '.html') AS source_file, len(regexp_extract_all(html, '<\\w+[^>]*\\sid=["'']([^"'']+)["'']')) AS ids FROM pages) SELECT source_file, 'node' AS kind, 1 + ids AS n FROM k UNION ALL SELECT source_file, 'edge', ids FROM k WHERE ids > 0""")
def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select(F.concat(F.lit("site/page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return extractors.extract(pages).groupBy("source_file", "kind").agg(F.count("*").alias("n"))


# Search.

_TOK = "list_transform(regexp_extract_all(label, '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda t: lower(t))"
_CORPUS = f"base AS (SELECT id, label, source_file, {_TOK} AS t FROM nodes), corp AS (SELECT *, CASE WHEN array_to_string(t, '') <> '' AND NOT list_contains(t, array_to_string(t, '')) THEN list_append(t, array_to_string(t, '')) ELSE t END AS tokens FROM base)"


@query(f"WITH {GRAPH_SQL}, {_CORPUS} SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(tokens) AS term FROM corp) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_frequencies(search.corpus(derived_nodes(spark, sf_dir), text.ascii_tokens(F.col("label"))))


@query(f"""WITH {GRAPH_SQL}, {_CORPUS}, st AS (SELECT count(*) AS n, avg(len(tokens)) AS av FROM corp), terms AS (SELECT unnest(['customer', 'asia', '000000007']) AS term),
idf AS (SELECT term, greatest(0.01, ln(1 + (n - d + 0.5) / (d + 0.5))) AS w FROM (SELECT term, (SELECT count(*) FROM corp WHERE list_contains(tokens, term)) AS d FROM terms), st),
s AS (SELECT id, label, sum(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * greatest(len(tokens), 1) / av)) + CASE WHEN contains(lower(source_file), term) THEN 0.5 * w ELSE 0 END) AS score
FROM (SELECT corp.*, term, w, len(list_filter(tokens, lambda x: x = term)) AS f FROM corp, idf), st GROUP BY id, label) SELECT id, round(score, 6) AS score FROM s WHERE score > 0""")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.score(derived_nodes(spark, sf_dir), ["customer", "asia", "000000007"], ascii_only=True).select("id", F.round("score", 6).alias("score"))


_RANKED = "SELECT concat('c:', c_custkey) AS id, c_acctbal AS score FROM customer WHERE c_acctbal > 0"


@query(f"""WITH s AS ({_RANKED}), t AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 3) SELECT id, score FROM (SELECT *, min(CASE WHEN score >= 0.8 * (SELECT max(score) FROM t) THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, id) AS ok FROM t) WHERE ok = 1""")
def seeds_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return search.pick_seeds(spark.sql(_RANKED))


@query(f"WITH s AS ({_RANKED}) SELECT id, score FROM s WHERE ((SELECT max(score) FROM s) - score) / (SELECT max(score) FROM s) < 0.10")
def near_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return search.near_ties(spark.sql(_RANKED))


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v FROM e WHERE id = 0) SELECT e.id, round(greatest(0, list_sum(list_transform(list_zip(e.v, q.v), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(e.v, lambda x: x * x)) * list_sum(list_transform(q.v, lambda x: x * x)))), 6) AS similarity FROM e, q ORDER BY 2 DESC, 1 LIMIT 20""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.cosine_top(v, v.where("id = 0").first()["v"]).select("id", F.round("similarity", 6).alias("similarity"))


@query("""WITH a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS ra FROM customer ORDER BY ra LIMIT 50), b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY length(c_name) * c_nationkey DESC, c_custkey) AS rb FROM customer ORDER BY rb LIMIT 50)
SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0 / (60 + ra), 0) + coalesce(1.0 / (60 + rb), 0), 9) AS score FROM a FULL JOIN b ON a.id = b.id""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    top = lambda s: c.select(F.col("c_custkey").alias("id"), s.alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return search.fuse(top(F.col("c_acctbal")), top(F.length("c_name") * F.col("c_nationkey"))).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {GRAPH_SQL}, h AS (SELECT id, CASE WHEN lower(source_file) = 'supplier#000000001' THEN 0 WHEN lower(label) = 'supplier#000000001' THEN 1 WHEN lower(label) LIKE 'supplier#000000001%' THEN 2 WHEN contains(lower(label), 'supplier#000000001') THEN 3 END AS tier FROM nodes) SELECT id, tier FROM h WHERE tier = (SELECT min(tier) FROM h)")
def find_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_tiers(derived_nodes(spark, sf_dir), "Supplier#000000001")


@query(f"""WITH {GRAPH_SQL}, {_CORPUS}, w AS (SELECT unnest(tokens) AS word FROM corp UNION SELECT concat(t[i], t[i + 1]) FROM base, generate_series(1, 20) s(i) WHERE i < len(t) UNION SELECT concat(t[i], t[i + 1], t[i + 2]) FROM base, generate_series(1, 20) s(i) WHERE i + 1 < len(t))
SELECT word, CAST(damerau_levenshtein(word, 'suplier') AS INTEGER) AS distance FROM w WHERE damerau_levenshtein(word, 'suplier') <= 2 ORDER BY 2, 1 LIMIT 1""")
def typo_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = search.vocabulary(search.corpus(derived_nodes(spark, sf_dir), text.ascii_tokens(F.col("label"))))
    return search.correct("suplier", words)


@query()
def question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = derived_graph(spark, sf_dir)
    return search.ask(n, e, "which nation is in ASIA?", 1)


# Feedback.

_SIGNALS = "SELECT user_id % 40 AS q, concat('question ', user_id % 40) AS question, CASE event_type WHEN 'purchase' THEN 'useful' WHEN 'click' THEN 'useful' WHEN 'error' THEN 'dead_end' WHEN 'signup' THEN 'corrected' ELSE 'seen' END AS outcome, ts AS date, user_id, event_id FROM events"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_SIGNALS).withColumn("source_nodes", F.array(F.concat(F.lit("u:"), F.col("user_id").cast("string")), F.concat(F.lit("q:"), F.col("q").cast("string"))))


_SCORES = f"""sig AS (SELECT *, CASE WHEN outcome = 'useful' THEN 1 WHEN outcome IN ('dead_end', 'corrected') THEN -1 ELSE 0 END AS s, pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(date)) / 86400e6) / 30) AS w FROM ({_SIGNALS})),
ev AS (SELECT concat('u:', user_id) AS node, s, w, date FROM sig WHERE s <> 0 UNION ALL SELECT concat('q:', q), s, w, date FROM sig WHERE s <> 0), sc AS (SELECT node, sum(s * w) AS score, count(*) FILTER (s > 0) AS pos, count(*) FILTER (s < 0) AS neg, max(date) AS last FROM ev GROUP BY node)"""


@query(f"WITH {_SCORES} SELECT node, round(score, 6) AS score, pos, neg FROM sc")
def feedback_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.node_scores(_signals(spark, sf_dir), F.to_timestamp(F.lit(NOW))).select("node", F.round("score", 6).alias("score"), "pos", "neg")


@query(f"WITH {_SCORES} SELECT node, CASE WHEN pos > 0 AND neg > 0 THEN 'contested' WHEN pos >= 2 THEN 'preferred' ELSE 'tentative' END AS status, round(score, 6) AS score FROM sc WHERE pos > 0")
def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.verdicts(feedback.node_scores(_signals(spark, sf_dir), F.to_timestamp(F.lit(NOW)))).select("node", "status", F.round("score", 6).alias("score"))


@query(f"SELECT question, outcome, event_id FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY date DESC, outcome) AS r FROM ({_SIGNALS})) WHERE r = 1")
def question_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.latest_questions(_signals(spark, sf_dir)).select("question", "outcome", "event_id")


@query(f"""WITH s AS ({_SIGNALS}), e AS (SELECT concat('u:', user_id) AS node, date, question, outcome FROM s WHERE outcome <> 'seen' UNION ALL SELECT concat('q:', q), date, question, outcome FROM s WHERE outcome <> 'seen')
SELECT node, question, outcome FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY date DESC, question, outcome) AS r FROM e) WHERE r <= 5""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.provenance(_signals(spark, sf_dir)).select("node", "question", "outcome")


@query(f"""WITH v AS (SELECT DISTINCT event_id AS doc, x AS id FROM (SELECT event_id, unnest([user_id, q, (user_id + 1) % 150]) AS x FROM ({_SIGNALS}))), c AS (SELECT doc, id % 3 AS community, count(*) AS n FROM v GROUP BY 1, 2)
SELECT doc, community FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, community) AS r FROM c) WHERE r = 1""")
def doc_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source that a signal names has a community, however many users there are."""
    s = _signals(spark, sf_dir).select(F.col("event_id").alias("doc"), F.array("user_id", F.col("q"), (F.col("user_id") + 1) % 150).alias("source_nodes"))
    ids = s.select(F.explode("source_nodes").alias("id")).distinct().select("id", (F.col("id") % 3).alias("community"))
    return feedback.doc_community(s, ids)


# Resolution and change.


@query(f"""WITH {GRAPH_SQL}, sym AS (SELECT lower(label) AS name, min(id) AS dst FROM nodes WHERE file_type = 'code' AND label <> '' GROUP BY 1 HAVING count(*) = 1), calls AS (SELECT concat('o:', o_orderkey) AS caller, concat('Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS callee FROM orders)
SELECT DISTINCT caller AS src, dst, 'calls' AS relation FROM calls JOIN sym ON lower(callee) = name WHERE caller <> dst AND concat(caller, dst) NOT IN (SELECT concat(src, dst) FROM edges WHERE relation = 'calls' AND src LIKE '%7')""")
def unique_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e, _ = derived_graph(spark, sf_dir)
    calls = _read(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("caller"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("callee"))
    return resolve.unique_calls(calls, n, e.where("relation = 'calls' AND src LIKE '%7'"))


_CANDIDATES = "SELECT o_orderkey AS call, concat('a/b', o_custkey % 3, '/f', o_orderkey % 5, '.py') AS call_file, c.k AS id, concat('a/b', c.k % 3, '/f', c.k % 5, '.py') AS file FROM orders, (SELECT DISTINCT c_nationkey AS k FROM customer) c WHERE c.k % 11 = o_orderkey % 11"


@query(f"""WITH c AS (SELECT call, id, CASE WHEN file = call_file THEN 1000000 WHEN regexp_replace(file, '[^/]*$', '') = regexp_replace(call_file, '[^/]*$', '') THEN 500000 ELSE 1 END AS score FROM ({_CANDIDATES}))
SELECT call, min(id) AS id FROM c JOIN (SELECT call, max(score) AS score FROM c GROUP BY call) b USING (call, score) GROUP BY call HAVING count(*) = 1""")
def nearest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("orders", "customer"):
        _read(spark, sf_dir, name).createOrReplaceTempView(name)
    return resolve.nearest_candidates(spark.sql(_CANDIDATES))


_HUNKS = "SELECT DISTINCT concat('customer/', o_custkey % 97, '.py') AS file, CAST(o_custkey AS INT) AS start, CAST(o_custkey + 150 AS INT) AS \"end\" FROM orders"


@query(f"""WITH {GRAPH_SQL}, d AS (SELECT source_file AS file, CAST(substr(source_location, 2) AS INT) AS line, id FROM nodes), h AS ({_HUNKS}), b AS (SELECT h.file, h.start, h."end", d.id FROM h ASOF JOIN d ON h.file = d.file AND h.start >= d.line)
SELECT file, start, "end", id, 'before' AS how FROM b UNION SELECT h.file, start, "end", id, 'within' FROM h JOIN d ON h.file = d.file AND line BETWEEN start AND "end\"""")
def changed_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived_nodes(spark, sf_dir)
    hunks = _read(spark, sf_dir, "orders").select(F.concat(F.lit("customer/"), (F.col("o_custkey") % 97).cast("string"), F.lit(".py")).alias("file"), F.col("o_custkey").cast("int").alias("start"), (F.col("o_custkey") + 150).cast("int").alias("end")).distinct()
    return resolve.changed_definitions(n, hunks)


_CHANGED = "SELECT o_custkey % 50 AS pr, CASE WHEN o_orderkey % 2 = 0 THEN concat('repo/customer/', o_custkey % 97, '.py') ELSE concat(o_custkey % 97, '.py') END AS path FROM orders"
_HITS = f"ch AS (SELECT DISTINCT * FROM ({_CHANGED})), fs AS (SELECT DISTINCT source_file FROM nodes), m AS (SELECT pr, path, source_file FROM ch JOIN fs ON path = source_file OR path LIKE concat('%/', source_file) OR source_file LIKE concat('%/', path))"


@query(f"WITH {GRAPH_SQL}, {_HITS} SELECT * FROM m")
def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, changed = _changed(spark, sf_dir)
    return resolve.path_matches(n, changed)


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return derived_nodes(spark, sf_dir), spark.sql(_CHANGED)


@query(f"""WITH {GRAPH_SQL}, {_HITS}, h AS (SELECT DISTINCT pr, source_file FROM m), c AS (SELECT pr, string_agg(CAST(community AS VARCHAR), ',' ORDER BY community) AS communities FROM (SELECT DISTINCT pr, community FROM h JOIN nodes USING (source_file) WHERE community IS NOT NULL) GROUP BY pr)
SELECT pr, coalesce(communities, '') AS communities, n_nodes FROM (SELECT pr, count(*) AS n_nodes FROM h JOIN nodes USING (source_file) GROUP BY pr) LEFT JOIN c USING (pr)""")
def pr_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.pr_impact(*_changed(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, {_HITS} SELECT community, string_agg(CAST(pr AS VARCHAR), ',' ORDER BY pr) AS prs FROM (SELECT DISTINCT community, pr FROM m JOIN nodes USING (source_file) WHERE community IS NOT NULL) GROUP BY community HAVING count(*) > 1""")
def pr_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.pr_conflicts(*_changed(spark, sf_dir))


_VALUES = "SELECT concat('unit', l_suppkey, '.v', l_partkey) AS value, concat('n', l_orderkey) AS node_id, concat('f', l_orderkey, '.yaml') AS source_file FROM lineitem"


@query(f"""WITH v AS (SELECT value, source_file, min(node_id) AS id FROM ({_VALUES}) GROUP BY 1, 2), k AS (SELECT value FROM v GROUP BY value HAVING count(*) BETWEEN 2 AND 5)
SELECT a.id AS src, b.id AS dst, concat('shares_value:', value) AS relation FROM v a JOIN v b USING (value) JOIN k USING (value) WHERE a.source_file < b.source_file""")
def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return resolve.shared_values(spark.sql(_VALUES))


_RELATIONS = "SELECT DISTINCT concat('o', l_orderkey) AS src, concat('d', l_orderkey % 10) AS document, concat('sym', l_partkey % 400) AS symbol FROM lineitem"
_SYMBOLS = "SELECT concat('S', p_partkey) AS id, concat('d', p_partkey % 10) AS document, concat('sym', p_partkey * 7 % 350) AS symbol FROM part"


@query(f"""WITH r AS ({_RELATIONS}), s AS ({_SYMBOLS}), l AS (SELECT document, symbol, min(id) AS local FROM s GROUP BY 1, 2), u AS (SELECT symbol, min(id) AS alone FROM s GROUP BY 1 HAVING count(*) = 1)
SELECT src, coalesce(local, alone, concat('stub:', symbol)) AS target, CASE WHEN local IS NOT NULL THEN 'same document' WHEN alone IS NOT NULL THEN 'unique' ELSE 'stub' END AS how FROM r LEFT JOIN l USING (document, symbol) LEFT JOIN u USING (symbol)""")
def scip_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("lineitem", "part"):
        _read(spark, sf_dir, name).createOrReplaceTempView(name)
    return resolve.scip_relations(spark.sql(_RELATIONS), spark.sql(_SYMBOLS))


@query(f"WITH {GRAPH_SQL}, own AS (SELECT lower(label) AS low, min(id) AS new FROM nodes WHERE id NOT LIKE 'p:%' GROUP BY 1), ext AS (SELECT id AS old, lower(CASE WHEN id LIKE 'p:%1' THEN concat('supplier#', lpad(substr(id, 3), 9, '0')) ELSE label END) AS low FROM nodes WHERE id LIKE 'p:%') SELECT old, new FROM ext JOIN own USING (low)")
def merge_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = derived_nodes(spark, sf_dir)
    ours = F.col("id").startswith("p:")
    renamed = F.when(F.col("id").like("p:%1"), F.concat(F.lit("supplier#"), F.lpad(F.substring("id", 3, 20), 9, "0"))).otherwise(F.col("label"))
    return resolve.merge_external(n.select("id", renamed.alias("label"), F.when(~ours, F.col("source_file")).alias("source_file")))


@query("""SELECT CAST(floor(sum(w) * 100 / 75) AS BIGINT) AS corpus_tokens, (SELECT CAST(sum(floor(length(text) / 4.0)) AS BIGINT) FROM benchmark) AS answer_tokens, round(floor(sum(w) * 100 / 75) / (SELECT sum(floor(length(text) / 4.0)) FROM benchmark), 4) AS reduction
FROM (SELECT CASE WHEN trim(text, E' \\n\\t\\r') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, E' \\n\\t\\r'), '\\s+')) END AS w FROM documents)""")
def token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.token_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@query("""SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) WHERE used <= 4 * 100""")
def turns_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("place"), F.col("text").alias("line"))
    return analysis.within_budget(lines, 100).select(F.col("group").alias("conv_id"), F.col("place").alias("turn"), "used")


@query("""WITH RECURSIVE u AS MATERIALIZED (SELECT source AS folder, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, CAST(floor(length(text) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
w(folder, k, path, used, chunk) AS (SELECT folder, k, path, tokens, CAST(0 AS BIGINT) FROM u WHERE k = 1 UNION ALL SELECT u.folder, u.k, u.path, CASE WHEN used > 0 AND used + u.tokens > 60000 THEN u.tokens ELSE used + u.tokens END, chunk + CASE WHEN used > 0 AND used + u.tokens > 60000 THEN 1 ELSE 0 END FROM w JOIN u ON u.folder = w.folder AND u.k = w.k + 1)
SELECT folder, path, chunk FROM w""")
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.floor(F.length("text") / 4).alias("tokens"))
    return file_ops.pack_chunks(docs)


@query("""WITH RECURSIVE d AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
w(path, start, "end", index) AS (SELECT path, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT) FROM d UNION ALL SELECT path, pos, CASE WHEN stop = n THEN n WHEN h > 0 THEN pos + 2000 + (length(v) - h - 1) + 1 WHEN b > 0 THEN pos + 2000 + (length(v) - b - 1) + 2 WHEN l > 0 THEN pos + 2000 + (length(v) - l) + 1 ELSE stop END, index + 1 FROM (
SELECT *, strpos(reverse(v), '#' || chr(10)) AS h, strpos(reverse(v), chr(10) || chr(10)) AS b, strpos(reverse(v), chr(10)) AS l FROM (
SELECT w.path, w."end" AS pos, d.n, least(d.n, w."end" + 4000) AS stop, substr(d.text, w."end" + 2001, least(d.n, w."end" + 4000) - w."end" - 2000) AS v, index FROM w JOIN d USING (path) WHERE w."end" < d.n OR index = -1)))
SELECT path, start, "end", index FROM w WHERE index >= 0""")
def document_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_ops.slices(_read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), 4000)


# Entities.

_ENTITIES = "SELECT concat('e', p_partkey) AS id, p_name AS label, CASE p_size % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'code' ELSE 'concept' END AS file_type, concat('f', p_partkey % 3, '.md') AS source_file, p_partkey AS seq FROM part"
_NAME = "trim(regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT id, source_file, {_NAME} AS name FROM ({_ENTITIES}) WHERE file_type <> 'code'), l AS (SELECT name, source_file, min(id) AS b FROM n WHERE name <> '' GROUP BY 1, 2) SELECT id AS a, b FROM n JOIN l USING (name, source_file) WHERE id <> b""")
def exact_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "part").createOrReplaceTempView("part")
    return entities.exact_merges(spark.sql(_ENTITIES))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(jaro_winkler_similarity(a.p_name, b.p_name), 9) AS winkler, round(jaro_similarity(a.p_name, b.p_name), 9) AS jaro, damerau_levenshtein(a.p_name, b.p_name) AS edits FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name against its successor's."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    pairs = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"), (F.col("p_partkey") + 1).alias("b")).join(p.toDF("b", "y"), "b")
    return pairs.select("a", "b", F.round(text.jaro_winkler_similarity("x", "y"), 9).alias("winkler"), F.round(text.jaro_similarity("x", "y"), 9).alias("jaro"), text.damerau_distance("x", "y").cast("long").alias("edits"))


@query()
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "part").createOrReplaceTempView("part")
    nodes = spark.sql(_ENTITIES)
    return entities.merge_map(nodes, entities.exact_merges(nodes).union(entities.alike_merges(nodes)))


# Events.


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.event_windows(_read(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sessions(_read(spark, sf_dir, "events"))




@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'FAILURE' WHEN o_orderkey % 3 = 0 THEN 'PENDING' WHEN o_orderstatus = 'F' THEN 'SUCCESS' ELSE 'NONE' END AS ci FROM orders""")
def ci_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.array(F.when(F.col("o_orderstatus") == "P", "TIMED_OUT").when(F.col("o_orderstatus") == "F", "SUCCESS"), F.lit(None).cast("string"))
    running = F.array(F.when(F.col("o_orderkey") % 3 == 0, "QUEUED").otherwise("COMPLETED"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", rules.ci_status(done, running).alias("ci"))


@query(f"""WITH s AS ({_RANKED}), w AS (SELECT id, score * CASE WHEN id LIKE '%1' THEN 0.85 WHEN id LIKE '%2' THEN 0.9 ELSE 1 END AS score FROM s) SELECT id, round(score * (1 + 0.15 * length(id) / (SELECT max(length(id)) FROM w)), 6) AS score FROM w""")
def weighed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    scored = spark.sql(_RANKED)
    source = F.when(F.col("id").like("%1"), "").when(F.col("id").like("%2"), "a.md").otherwise("a.py")
    return search.weigh(scored, scored.select("id", source.alias("source_file")), scored.select("id", F.length("id").cast("double").alias("rank"))).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS ({_RANKED}), c AS (SELECT concat('c:', c_custkey) AS id, c_nationkey AS community FROM customer), t AS (SELECT *, 0 AS later FROM s ORDER BY score DESC, id LIMIT 2), used AS (SELECT community FROM t JOIN c USING (id)),
m AS (SELECT id, score, 1 AS later FROM (SELECT s.*, row_number() OVER (PARTITION BY community ORDER BY score DESC, id) AS r FROM s JOIN c USING (id) WHERE community NOT IN (SELECT community FROM used)) WHERE r = 1) SELECT id, score FROM (SELECT * FROM t UNION ALL SELECT * FROM m ORDER BY later, score DESC, id LIMIT 5)""")
def filled_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    scored = spark.sql(_RANKED)
    c = spark.table("customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_nationkey").alias("community"))
    return search.fill_communities(scored.orderBy(F.desc("score"), "id").limit(2), scored, c)


@query(f"WITH {GRAPH_SQL}, v AS (SELECT concat('v', x) AS node, x FROM generate_series(1, 9) t(x)), m AS (SELECT CASE WHEN x % 2 = 0 THEN concat('s:', x) ELSE concat('Supplier#', lpad(CAST(x AS VARCHAR), 9, '0')) END AS node, x FROM v) SELECT concat('s:', x) AS id, 'preferred' AS status, x / 2.0 AS score FROM m WHERE concat('s:', x) IN (SELECT id FROM nodes)")
def learning_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, x = derived_nodes(spark, sf_dir), F.col("id").cast("string")
    cited = spark.range(1, 10).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("s:"), x)).otherwise(F.concat(F.lit("Supplier#"), F.lpad(x, 9, "0"))).alias("node"), F.lit("preferred").alias("status"), (F.col("id") / 2.0).alias("score"))
    return feedback.overlay(n, cited)


@query(f"WITH {GRAPH_SQL} SELECT id, 0 AS tier FROM nodes WHERE id = 'n:4'")
def resolved_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_seed(derived_nodes(spark, sf_dir), "n:4")


@query("""SELECT DISTINCT concat('o', o_orderkey) AS src, concat('p', p_partkey) AS dst, 'http_calls' AS relation FROM orders JOIN part ON concat('act', o_custkey % 300) = concat('act', p_partkey % 280) WHERE o_orderkey % 10 <> 0""")
def http_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.concat(F.lit("act"), (F.col("o_custkey") % 300).cast("string"))
    sites = _read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 10 == 0, F.concat(action, F.lit("${x}"))).otherwise(action).alias("action"))
    handlers = _read(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("act"), (F.col("p_partkey") % 280).cast("string")).alias("action"))
    return resolve.http_links(sites, handlers)


@query(f"""WITH {GRAPH_SQL}, sym AS (SELECT regexp_replace(string_split(source_file, '/')[-1], '\\.[^.]*$', '') AS module, lower(label) AS name, min(id) AS dst FROM nodes WHERE file_type = 'code' GROUP BY 1, 2 HAVING count(*) = 1), k AS (SELECT o_orderkey, CAST(o_custkey % 97 AS VARCHAR) AS module, concat('customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS name FROM orders)
SELECT DISTINCT concat('o:', o_orderkey) AS src, dst FROM k JOIN sym USING (module, name)""")
def import_guided_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    file, alias = F.concat(F.lit("f"), key), F.concat(F.lit("a"), F.col("o_custkey").cast("string"))
    calls = o.select(F.concat(F.lit("o:"), key).alias("caller"), file.alias("file"), alias.alias("callee"))
    imports = o.select(file.alias("file"), alias.alias("alias"), (F.col("o_custkey") % 97).cast("string").alias("module"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name"))
    return resolve.import_guided_calls(calls, imports, derived_nodes(spark, sf_dir))
