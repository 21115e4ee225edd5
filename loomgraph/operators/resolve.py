"""Resolution of names to nodes, and the joins that locate changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules, text
from loomgraph.operators.graph import first_by


def unique_calls(calls: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(src, dst, relation)``: calls ``(caller, callee)`` whose name belongs to exactly one symbol; self calls and known edges are left out."""
    symbols = nodes.where("file_type = 'code'").select("id", text.callable_label(F.col("label")).alias("name"))
    one = symbols.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("dst")).where("n = 1 AND name <> ''")
    found = calls.select(F.col("caller").alias("src"), text.callable_label(F.col("callee")).alias("name")).join(one, "name")
    new = found.where("src <> dst").select("src", "dst", F.lit("calls").alias("relation")).distinct()
    return new.join(edges.select("src", "dst", "relation"), ["src", "dst", "relation"], "left_anti")


def _shared_parts(a: Column, b: Column) -> Column:
    """How many leading folders two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    return F.coalesce(F.array_position(same, False), F.lit(0)).cast("int") - 1


def nearest_candidates(candidates: DataFrame) -> DataFrame:
    """``(call, id)``: of candidates ``(call, call_file, id, file)`` the one left by: not a test unless the call is one; same file, same folder,
    longest shared path. A tie at the best tier resolves nothing."""
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    tests = rules.is_test_path(F.col("file")) & ~rules.is_test_path(F.col("call_file"))
    tier = F.when(F.col("file") == F.col("call_file"), 1_000_000).when(folder(F.col("file")) == folder(F.col("call_file")), 500_000).otherwise(_shared_parts(F.col("file"), F.col("call_file")))
    scored = candidates.select("call", "id", (F.when(tests, -1_000_000).otherwise(0) + tier).alias("score"))
    best = scored.groupBy("call").agg(F.max("score").alias("score"))
    return scored.join(best, ["call", "score"]).groupBy("call").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").select("call", "id")


def import_guided_calls(calls: DataFrame, imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(src, dst)``: calls ``(caller, file, callee)`` through imports ``(file, alias, module, name)`` to the unique symbol of that module's file."""
    stem = F.regexp_replace(text.base_name(F.col("source_file")), r"\.[^.]*$", "")
    symbols = nodes.where("file_type = 'code'").groupBy(stem.alias("module"), text.callable_label(F.col("label")).alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("dst")).where("n = 1")
    bound = calls.join(imports, (calls["file"] == imports["file"]) & (calls["callee"] == imports["alias"])).select(calls["caller"], imports["module"], F.lower(imports["name"]).alias("name"))
    return bound.join(symbols, ["module", "name"]).where("caller <> dst").select(F.col("caller").alias("src"), "dst").distinct()


def changed_definitions(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """``(file, start, end, id, how)``: definitions a hunk ``(file, start, end)`` touches: the nearest at or before its start, and all that begin within.

    Each hunk and definition of a file is a row of one sorted stream, so the nearest one comes from a window, not from a join.
    """
    line = F.try_to_number(F.regexp_extract("source_location", r"^L(\d+)", 1), F.lit("999999999")).cast("int")
    defs = nodes.select(F.col("source_file").alias("file"), line.alias("line"), "id").where("line IS NOT NULL")
    stream = defs.select("file", "line", F.lit(0).alias("kind"), "id", F.lit(None).cast("int").alias("end")).union(hunks.select("file", F.col("start").alias("line"), F.lit(1), F.lit(None).cast("string"), "end"))
    w = Window.partitionBy("file").orderBy("line", "kind", F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = stream.withColumn("near", F.last("id", ignorenulls=True).over(w)).where("kind = 1 AND near IS NOT NULL").select("file", F.col("line").alias("start"), "end", F.col("near").alias("id"), F.lit("before").alias("how"))
    within = hunks.join(defs, "file").where("line BETWEEN start AND end").select("file", "start", "end", "id", F.lit("within").alias("how"))
    return before.union(within).distinct()


def path_matches(graph_files: DataFrame, changed: DataFrame) -> DataFrame:
    """``(pr, path, source_file)``: equal paths, or one a ``/``-bounded suffix of the other. Suffixes are exploded, so it is an equi-join."""

    def suffixes(path: Column) -> Column:
        parts = F.split(path, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    g, c = graph_files.select("source_file").distinct(), changed.select("pr", "path").distinct()
    longer = c.select("pr", "path", F.explode(suffixes(F.col("path"))).alias("source_file")).join(g, "source_file").select("pr", "path", "source_file")
    shorter = g.select("source_file", F.explode(suffixes(F.col("source_file"))).alias("path")).join(c, "path").select("pr", "path", "source_file")
    return longer.union(shorter).distinct()


def pr_impact(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """``(pr, communities, n_nodes)``: what the files of each pull request hold."""
    hit = path_matches(nodes, changed).select("pr", "source_file").distinct()
    return hit.join(nodes, "source_file").groupBy("pr").agg(F.array_join(F.transform(F.array_sort(F.collect_set("community")), lambda c: c.cast("string")), ",").alias("communities"), F.count("*").alias("n_nodes"))


def pr_conflicts(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """``(community, prs)``: communities that more than one pull request touches."""
    hit = path_matches(nodes, changed).join(nodes, "source_file").select("pr", "community").distinct().where("community IS NOT NULL")
    return hit.groupBy("community").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("pr")), lambda p: p.cast("string")), ",").alias("prs")).where("n > 1").select("community", "prs")


def shared_values(values: DataFrame, most_files: int = 5) -> DataFrame:
    """``(src, dst, relation)``: files that share a dotted value ``(value, node_id, source_file)``; a value of too many files says nothing."""
    dotted = values.where(F.col("value").contains(".")).groupBy("value", "source_file").agg(F.min("node_id").alias("id"))
    kept = dotted.join(dotted.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n").between(2, most_files)), "value").drop("n")
    a, b = kept.toDF("value", "f1", "src"), kept.toDF("value", "f2", "dst")
    return a.join(b, "value").where("f1 < f2").select("src", "dst", F.concat(F.lit("shares_value:"), "value").alias("relation"))


def http_links(fetches: DataFrame, handlers: DataFrame) -> DataFrame:
    """``(src, dst, relation)``: literal actions of call sites ``(id, action)`` joined to handlers; interpolated ones are skipped.

    A pair can come twice only from a call site and a handler of several actions each, so only those pairs are compared; all others leave the join as they are.
    """

    def marked(df: DataFrame, name: str) -> DataFrame:
        once = df.select("id", "action").where("action IS NOT NULL").distinct()
        several = once.groupBy("id").agg(F.count("*").alias("n"), F.collect_list("action").alias("actions"))
        return several.select(F.col("id").alias(name), F.explode("actions").alias("action"), (F.col("n") > 1).alias(f"{name}_several"))

    both = marked(fetches.where(~F.col("action").rlike(r"[$`{}]")), "src").join(marked(handlers, "dst"), "action")
    clear, several = both.where("NOT (src_several AND dst_several)"), both.where("src_several AND dst_several")
    return clear.select("src", "dst").unionAll(several.select("src", "dst").distinct()).withColumn("relation", F.lit("http_calls"))


def scip_relations(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(src, target, how)``: a relation's target symbol in the same document, else the only one of that name anywhere, else a stub.

    ``relations (src, document, symbol)``, ``symbols (id, document, symbol)``.
    """
    local = symbols.groupBy("document", "symbol").agg(F.min("id").alias("local"))
    alone = symbols.groupBy("symbol").agg(F.count("*").alias("n"), F.min("id").alias("alone")).where("n = 1").drop("n")
    j = relations.join(local, ["document", "symbol"], "left").join(alone, "symbol", "left")
    how = F.when(F.col("local").isNotNull(), "same document").when(F.col("alone").isNotNull(), "unique").otherwise("stub")
    return j.select("src", F.coalesce("local", "alone", F.concat(F.lit("stub:"), "symbol")).alias("target"), how.alias("how"))


def resolve_seed(nodes: DataFrame, query: str) -> DataFrame:
    """``(id, tier)``: by id, label, bare name, source file, then part of a label; the first tier that leaves one node."""
    q = query.lower()
    tiers = [F.col("id") == query, F.lower("label") == q, text.callable_label(F.col("label")) == q, F.lower("source_file") == q, F.lower("label").contains(q)]
    marked = nodes.select("id", F.explode(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tiers)])).alias("tier")).where("tier IS NOT NULL")
    one = marked.groupBy("tier").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return one.orderBy("tier").limit(1).select("id", "tier")


def merge_external(nodes: DataFrame) -> DataFrame:
    """``(old, new)``: nodes without a source file that share a label with one that has (the smallest id)."""
    own = nodes.where("coalesce(source_file, '') <> ''").groupBy(F.lower("label").alias("low")).agg(F.min("id").alias("new"))
    return nodes.where("coalesce(source_file, '') = ''").select(F.col("id").alias("old"), F.lower("label").alias("low")).join(own, "low").select("old", "new")


def classify_sections(edges: DataFrame, section_of: DataFrame) -> DataFrame:
    """``edges`` with ``section``: intra, inter or orphan by the sections of both ends."""
    a, b = section_of.toDF("src", "section_a"), section_of.toDF("dst", "section_b")
    j = edges.join(a, "src", "left").join(b, "dst", "left")
    return j.withColumn("section", F.when(F.col("section_a").isNull() | F.col("section_b").isNull(), "orphan").when(F.col("section_a") == F.col("section_b"), "intra").otherwise("inter"))


def best_per_pair(edges: DataFrame, community: DataFrame) -> DataFrame:
    """One edge for each pair of communities: the least certain first."""
    a, b = community.toDF("src", "ca"), community.toDF("dst", "cb")
    j = edges.join(a, "src").join(b, "dst").where("ca <> cb").withColumns({"c1": F.least("ca", "cb"), "c2": F.greatest("ca", "cb")})
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    return first_by(j, ["c1", "c2"], rank, "src", "dst", "relation").select("c1", "c2", "src", "dst", "relation", "confidence")


def types_in_scope(uses: DataFrame, scopes: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(src, name, dst)``: a type named in a file ``(src, file, name)`` is the one definition ``(id, namespace, name)`` in the namespaces the file sees ``(file, namespace)``.

    Parts of one definition count as their smallest id. With no or several definitions in scope ``dst`` is a stub.
    """
    once = definitions.groupBy("namespace", "name").agg(F.min("id").alias("id"))
    seen = uses.join(scopes, "file").join(once, ["namespace", "name"]).groupBy("src", "name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1")
    return uses.select("src", "name").distinct().join(seen, ["src", "name"], "left").select("src", "name", F.coalesce("id", F.concat(F.lit("stub:"), "name")).alias("dst"))


def member_calls(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """``(src, dst)`` of calls ``(caller, receiver, receiver_type, method)``: ``Name.new`` is the only class of that name ``(id, name)``; another method is the only one
    of that name ``(id, class_id, name)`` in the only class of the receiver's type."""
    one = classes.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("class_id")).where("n = 1").drop("n")
    made = calls.where("method = 'new'").join(one, F.col("receiver") == F.col("name")).select(F.col("caller").alias("src"), F.col("class_id").alias("dst"))
    own = methods.groupBy("class_id", F.col("name").alias("method")).agg(F.count("*").alias("n"), F.min("id").alias("dst")).where("n = 1").drop("n")
    run = calls.where("method <> 'new'").join(one, F.col("receiver_type") == F.col("name")).join(own, ["class_id", "method"]).select(F.col("caller").alias("src"), "dst")
    return made.union(run).where("src <> dst").distinct()


def join_path(folder: Column, path: Column) -> Column:
    """A relative path from a folder, without ``.`` and ``..`` parts; null if it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, path), "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))

    def step(s: Column, p: Column) -> Column:
        up = p == ".."
        at = F.when(up, F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0)))).otherwise(F.concat(s["at"], F.array(p)))
        return F.struct(at.alias("at"), (s["ok"] & (~up | (F.size(s["at"]) > 0))).alias("ok"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["ok"], F.array_join(s["at"], "/")))


def import_targets(imports: DataFrame, known: DataFrame, aliases: dict[str, str] | None = None, endings: tuple[str, ...] = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".sh", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")) -> DataFrame:
    """``(file, spec, target)``: the file ``(path)`` an import ``(file, spec)`` means: relative to the importing file or below an alias, with the first ending that exists.

    Also resolves sourced shell files, whose paths are literals. Endings are taken off the known paths, so an import is one row of the join;
    both sides grow with the input and meet by a merge, never by broadcast.
    """
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    base = F.when(F.col("spec").rlike(r"^\.\.?(/|$)"), join_path(folder, F.col("spec")))
    for prefix, to in sorted((aliases or {}).items(), key=lambda a: len(a[0])):
        base = F.when(F.col("spec").startswith(prefix), join_path(F.lit(to), F.expr(f"substring(spec, {len(prefix) + 1})"))).otherwise(base)
    stems = F.array(*[F.when(F.col("path").endswith(e), F.substring("path", F.lit(1), F.length("path") - len(e))) for e in endings])
    have = known.select("path").distinct().select(F.col("path").alias("target"), F.posexplode(stems).alias("rank", "base")).where("base IS NOT NULL")
    j = imports.select("file", "spec", base.alias("base")).where("base IS NOT NULL").hint("merge").join(have, "base")
    return j.where("file <> target").groupBy("file", "spec").agg(F.min_by("target", "rank").alias("target"))
