"""Building and cleaning a property graph.

Nodes: ``id, label, file_type, source_file, source_location, seq``; edges: ``src, dst, relation, confidence, source_file, seq``.
``seq`` is the order of ingestion wherever the first or the last record wins. Undirected operators use a pair's
smaller and larger end; true direction is never lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules, text
from loomgraph.plans.storage import discard, materialize


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a self loop once."""
    return edges.unionByName(edges.where("src <> dst").select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns]))


def degrees(edges: DataFrame) -> DataFrame:
    """``(id, degree)``: ends of edges, so a self loop counts two."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def in_out_degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def simple(edges: DataFrame) -> DataFrame:
    """Distinct undirected pairs ``(a, b)``, a <= b."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; Spark limits ranks before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def nodes_first(nodes: DataFrame) -> DataFrame:
    """The first record of each id."""
    return first_by(nodes, ["id"], "seq")


def nodes_last(nodes: DataFrame) -> DataFrame:
    """The last record of each id, in the place of the first."""
    place = F.min("seq").over(Window.partitionBy("id"))
    return first_by(nodes.withColumn("place", place), ["id"], F.desc("seq")).drop("seq").withColumnRenamed("place", "seq")


def edges_first(edges: DataFrame) -> DataFrame:
    """The first record of each source, target and relation."""
    return first_by(edges, ["src", "dst", "relation"], "seq")


def merge_attributes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: of each attribute the last value that isn't null."""
    others = [c for c in rows.columns if c not in (*keys, "seq")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in others], F.min("seq").alias("seq"))


def fold_pairs(edges: DataFrame) -> DataFrame:
    """One edge for each undirected pair: in the order of (src, dst, relation) the last wins, but a reverse edge of the surviving relation is dropped."""
    item = F.struct((F.col("src") > F.col("dst")).alias("back"), "relation", "confidence")  # in the order of ends, without them
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.array_sort(F.collect_set(item)).alias("es"))
    last = F.aggregate(F.slice("es", 2, 1 << 30), F.element_at("es", 1), lambda kept, e: F.when((kept["relation"] == e["relation"]) & (kept["back"] != e["back"]), kept).otherwise(e))
    ends = [F.when(F.col("e.back"), y).otherwise(F.col(x)).alias(name) for name, x, y in (("src", "a", F.col("b")), ("dst", "b", F.col("a")))]
    return pairs.select("a", "b", last.alias("e")).select(*ends, "e.relation", "e.confidence")


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends by id, else by normalised id (the smallest id of those that share it); edges without a node at either end go."""
    exact = nodes.select("id")
    loose = nodes.groupBy(text.ascii_id(F.col("id")).alias("norm")).agg(F.min("id").alias("loose_id"))
    for end in ("src", "dst"):
        hit, norm = exact.withColumnRenamed("id", "exact_id"), loose
        edges = edges.join(hit, edges[end] == hit["exact_id"], "left").withColumn("end_norm", text.ascii_id(F.col(end)))
        edges = edges.join(norm, F.col("end_norm") == norm["norm"], "left").withColumn(end, F.coalesce("exact_id", "loose_id")).where(F.col(end).isNotNull()).drop("exact_id", "loose_id", "norm", "end_norm")
    return edges


def backfill_source(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge's source file, else its source node's, else its target node's, else empty."""
    s, d = nodes.select(F.col("id").alias("s_id"), F.col("source_file").alias("s_file")), nodes.select(F.col("id").alias("d_id"), F.col("source_file").alias("d_file"))
    joined = edges.join(s, edges["src"] == s["s_id"], "left").join(d, edges["dst"] == d["d_id"], "left")
    return joined.withColumn("source_file", F.coalesce("source_file", "s_file", "d_file", F.lit(""))).drop("s_id", "s_file", "d_id", "d_file")


def ghost_targets(nodes: DataFrame) -> DataFrame:
    """``(ghost, target)``: nodes without an origin that share base name and lower-case label with exactly one parsed node."""
    keyed = nodes.select("id", "origin", text.base_name(F.col("source_file")).alias("base"), F.lower("label").alias("low"))
    real = keyed.where("origin = 'ast'").groupBy("base", "low").agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1")
    return keyed.where("origin IS NULL").join(real, ["base", "low"]).select(F.col("id").alias("ghost"), "target")


def rewire(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ends replaced by ``mapping (old, new)``; what became a self loop goes."""
    for end in ("src", "dst"):
        m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        edges = edges.join(m, edges[end] == m["_old"], "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    return edges.where("src <> dst")


def drop_cross_language(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    s, d = nodes.select(F.col("id").alias("s_id"), F.col("source_file").alias("s_file")), nodes.select(F.col("id").alias("d_id"), F.col("source_file").alias("d_file"))
    joined = edges.join(s, edges["src"] == s["s_id"]).join(d, edges["dst"] == d["d_id"])
    return joined.where(~rules.dropped_at_build(F.col("relation"), F.col("confidence"), F.col("s_file"), F.col("d_file"))).select(*edges.columns)


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, id, error)`` of every violation; reports, never rejects."""
    ids = nodes.select("id").distinct()
    wrong = [
        nodes.where("id IS NULL OR id = ''").select(F.lit("node").alias("kind"), F.coalesce("label", F.lit("")).alias("id"), F.lit("missing id").alias("error")),
        nodes.where(~F.col("file_type").isin(*rules.FILE_TYPES)).select(F.lit("node"), "id", F.lit("invalid file_type")),
        nodes.where("label IS NULL OR source_file IS NULL").select(F.lit("node"), "id", F.lit("missing field")),
        edges.where(~F.col("confidence").isin(*rules.CONFIDENCES)).select(F.lit("edge"), F.concat_ws("->", "src", "dst"), F.lit("invalid confidence")),
        edges.join(ids, edges["src"] == ids["id"], "left_anti").select(F.lit("edge"), F.concat_ws("->", "src", "dst"), F.lit("dangling source")),
        edges.join(ids, edges["dst"] == ids["id"], "left_anti").select(F.lit("edge"), F.concat_ws("->", "src", "dst"), F.lit("dangling target")),
    ]
    out = wrong[0]
    for w in wrong[1:]:
        out = out.union(w)
    return out


def replace_by_source(old: DataFrame, new: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Rows of ``old`` whose source file isn't rebuilt in ``new`` nor in ``removed (source_file)``, and all of ``new``."""
    gone = new.select("source_file").distinct()
    gone = gone.union(removed.select("source_file")) if removed is not None else gone
    return old.join(gone, "source_file", "left_anti").select(*new.columns).union(new)


def unexplained_losses(old: DataFrame, new: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Old nodes that are gone although their source wasn't rebuilt: a write that loses them is refused."""
    return old.join(new.select("id"), "id", "left_anti").join(rebuilt.select("source_file").distinct(), "source_file", "left_anti")


def rekey(frame: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """Ids in ``columns`` replaced by ``mapping (old, new)``; self loops stay."""
    for c in columns:
        m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        frame = frame.join(m, frame[c] == m["_old"], "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
    return frame


def rekey_members(hyper: DataFrame, mapping: DataFrame) -> DataFrame:
    """Hyperedges whose members are replaced by ``mapping (old, new)``, in their order."""
    others = [c for c in hyper.columns if c != "nodes"]
    members = rekey(hyper.select(*others, F.posexplode("nodes").alias("place", "member")), mapping, "member")
    return members.groupBy(*others).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda m: m["member"]).alias("nodes"))


def _settled(edges: DataFrame, nodes: DataFrame, moved: DataFrame | None, ghosts: DataFrame | None) -> DataFrame:
    """Edges rekeyed by ``moved``, rewired by ``ghosts``, resolved, with sources and without impossible calls, as the functions of these names do it one after another.

    What becomes of an id is found among the nodes first, so edges are joined once an end, and written after each: two shuffles of them never lie on disk together.
    """
    spark, kept = edges.sparkSession, "source_file" in edges.columns
    held = nodes.select("id", "source_file")
    if moved is None:
        known = held.select(F.col("id").alias("key"), F.col("id").alias("new"), F.col("id").alias("at"), F.col("source_file").alias("file"))
    else:
        ids = held.select(F.col("id").alias("old")).union(moved.select("old")).union(ghosts.select("old")).distinct()
        first = ids.join(moved.toDF("old", "to"), "old", "left").select(F.col("old").alias("key"), F.coalesce("to", "old").alias("mid"))
        second = first.join(ghosts.toDF("mid", "to"), "mid", "left").select("key", F.coalesce("to", "mid").alias("new"))
        known = second.join(held.select(F.col("id").alias("at"), F.col("source_file").alias("file")), F.col("new") == F.col("at"), "left")
    known, known_path = materialize(known, "build-known")
    path = None
    for end in ("src", "dst"):
        k = known.toDF("key", f"{end}_new", f"{end}_at", f"{end}_file")
        edges, new = materialize(edges.join(k, edges[end] == k["key"], "left").withColumn(end, F.coalesce(f"{end}_new", end)).drop("key", f"{end}_new"), "build-edges")
        discard(spark, *filter(None, (path,)))
        path = new
    discard(spark, known_path)
    if ghosts is not None:
        edges = edges.where("src <> dst")
    sure = edges.where("src_at IS NOT NULL AND dst_at IS NOT NULL")
    open_ = edges.where("src_at IS NULL OR dst_at IS NULL")
    if not open_.isEmpty():
        loose = held.groupBy(text.ascii_id(F.col("id")).alias("norm")).agg(F.min(F.struct("id", "source_file")).alias("hit"))
        for end in ("src", "dst"):
            hit = loose.select("norm", F.col("hit.id").alias("loose_id"), F.col("hit.source_file").alias("loose_file"))
            lost = F.when(F.col(f"{end}_at").isNull(), text.ascii_id(F.col(end)))
            found = open_.withColumn("_norm", lost).join(hit, F.col("_norm") == hit["norm"], "left")
            open_ = found.withColumns({f"{end}_file": F.when(F.col(f"{end}_at").isNull(), F.col("loose_file")).otherwise(F.col(f"{end}_file")), f"{end}_at": F.coalesce(f"{end}_at", "loose_id")}).where(F.col(f"{end}_at").isNotNull()).drop("norm", "_norm", "loose_id", "loose_file")
        sure = sure.union(open_.select(*sure.columns))
    sure = sure.withColumns({"src": F.col("src_at"), "dst": F.col("dst_at")})
    if kept:
        sure = sure.withColumn("source_file", F.coalesce("source_file", "src_file", "dst_file", F.lit("")))
    return sure.where(~rules.dropped_at_build(F.col("relation"), F.col("confidence"), F.col("src_file"), F.col("dst_file"))).drop("src_at", "src_file", "dst_at", "dst_file")


def build(nodes: DataFrame, edges: DataFrame, hyper: DataFrame | None = None, root: str = "") -> tuple[DataFrame, DataFrame] | tuple[DataFrame, DataFrame, DataFrame]:
    """A graph from records as they come: canonical types and paths, records without an id dropped, short ids made whole, one record an id (the last of
    each attribute), ghosts merged, ends resolved, sources filled in, impossible calls dropped, pairs folded. With ``hyper`` also its hyperedges, cleaned.

    ``validate`` reports what is wrong with the records; nothing but a missing id or end drops one.
    """
    moved = None
    nodes = nodes.where("id IS NOT NULL AND id <> ''").withColumns({"file_type": rules.file_type(F.col("file_type")), "source_file": text.norm_path(F.col("source_file"), root)})
    if "origin" in nodes.columns:
        moved, _ = materialize(legacy_ids(nodes).groupBy("old").agg(F.min("new").alias("new")), "build-moved")
        nodes = rekey(nodes, moved, "id")
        hyper = rekey_members(hyper, moved) if hyper is not None else None
    nodes, _ = materialize(merge_attributes(nodes, ["id"]) if "seq" in nodes.columns else nodes.dropDuplicates(["id"]), "build-nodes")
    ghosts = None
    if "origin" in nodes.columns:
        ghosts = ghost_targets(nodes).select(F.col("ghost").alias("old"), F.col("target").alias("new"))
        hyper = rekey_members(hyper, ghosts) if hyper is not None else None
        nodes = nodes.join(ghosts, nodes["id"] == ghosts["old"], "left_anti")
    folded = fold_pairs(_settled(edges, nodes, moved, ghosts))
    return (nodes, folded) if hyper is None else (nodes, folded, clean_hyperedges(hyper, nodes))


def attach_hyperedges(old: DataFrame, new: DataFrame) -> DataFrame:
    """All of ``old`` and those of ``new`` with an id that it hasn't."""
    return old.unionByName(first_by(new.where("id IS NOT NULL"), ["id"], *[c for c in ("label", "relation") if c in new.columns]).join(old.select("id"), "id", "left_anti").select(*old.columns))


class Shrunk(ValueError):
    """A write would lose nodes that nothing explains."""


def build_merge(old: tuple[DataFrame, ...], new: tuple[DataFrame, ...], removed: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, ...]:
    """``new`` nodes and edges (and hyperedges) in place of what the same sources gave before; those of ``removed (source_file)`` go; all else stays. The
    whole is built again. Nodes that vanish without their source being rebuilt or removed are an error, unless forced.
    """
    rebuilt = new[0].select("source_file").where("coalesce(source_file, '') <> ''").distinct()
    gone = rebuilt.union(removed.select("source_file")) if removed is not None else rebuilt
    nodes, edges = (o.join(gone, "source_file", "left_anti").select(*n.columns).unionByName(n) for o, n in zip(old[:2], new[:2], strict=True))
    parts: list[DataFrame] = [nodes, edges]
    if len(old) > 2:
        parts.append(attach_hyperedges(new[2], old[2].join(gone, "source_file", "left_anti").select(*new[2].columns)))
    out = build(*parts)
    if not force and (lost := unexplained_losses(old[0], out[0], gone).count()):
        raise Shrunk(f"{lost} nodes would be lost although their sources were not rebuilt")
    return out


def merge_graphs(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], most_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Union of two versions of a graph of any size: of each attribute the right one's value wins, each edge once. Refused beyond ``most_nodes`` nodes only where these are given, as a merge driver does."""
    if most_nodes is not None and (n := left[0].select("id").union(right[0].select("id")).distinct().count()) > most_nodes:
        raise ValueError(f"the merged graph has {n} nodes; max is {most_nodes}")
    both = left[1].withColumn("seq", F.lit(0)).unionByName(right[1].withColumn("seq", F.lit(1)), allowMissingColumns=True)
    return compose(left[0], right[0], ["id"]), first_by(both, ["src", "dst", "relation"], F.desc("seq")).drop("seq")


def graph_diff(old_nodes: DataFrame, new_nodes: DataFrame, old_edges: DataFrame, new_edges: DataFrame, directed: bool = True) -> DataFrame:
    """``(change, a, b, relation)``: nodes (b null) and edges added or removed."""
    key = [F.col("src").alias("a"), F.col("dst").alias("b")] if directed else [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]

    def minus(x: DataFrame, y: DataFrame, what: str) -> DataFrame:
        return x.join(y, [x[c].eqNullSafe(y[c]) for c in x.columns], "left_anti").select(F.lit(what).alias("change"), "*")

    n_old, n_new = (n.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("relation")).distinct() for n in (old_nodes, new_nodes))
    e_old, e_new = (e.select(*key, "relation").distinct() for e in (old_edges, new_edges))
    return minus(n_new, n_old, "node added").union(minus(n_old, n_new, "node removed")).union(minus(e_new, e_old, "edge added")).union(minus(e_old, e_new, "edge removed"))


def compose(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two tables by key; of each attribute the right one's value wins unless it is null."""
    both = left.withColumn("seq", F.lit(0)).unionByName(right.withColumn("seq", F.lit(1)))
    return merge_attributes(both, keys).drop("seq")


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, state)`` from two manifests ``(path, hash)``: new, changed, unchanged, deleted."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return o.join(n, "path", "full").select("path", state.alias("state"))


def same_topology(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    """Whether two tables hold the same rows in these columns, repeats included."""
    x, y = a.select(*columns), b.select(*columns)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def drop_rationale(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentence-like rationale nodes go; their text is moved to the nodes they explain."""
    gone = nodes.where((F.col("file_type") == "rationale") | rules.is_rationale_sentence(F.col("label"))).select(F.col("id").alias("gone_id"), F.col("label").alias("why"))
    told = edges.where("relation = 'rationale_for'").join(gone, edges["src"] == gone["gone_id"]).groupBy("dst").agg(F.array_join(F.array_sort(F.collect_set("why")), "\n\n").alias("rationale"))
    kept = nodes.join(gone, nodes["id"] == gone["gone_id"], "left_anti")
    kept = kept.join(told, kept["id"] == told["dst"], "left").drop("dst")
    return kept, edges.join(gone, edges["src"] == gone["gone_id"], "left_anti").join(gone, edges["dst"] == gone["gone_id"], "left_anti")


def clean_hyperedges(hyper: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hyperedges with the members that exist, in order, once an id, where at least two are left."""
    members = hyper.where("id IS NOT NULL").select("id", "label", "relation", F.posexplode(F.array_distinct("nodes")).alias("place", "member"))
    held = members.join(nodes.select(F.col("id").alias("member")), "member", "left_semi")
    grouped = held.groupBy("id", "label", "relation").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda m: m["member"]).alias("nodes"))
    return first_by(grouped.where(F.size("nodes") >= 2), ["id"], "label", "relation")


def add_to_global(total: DataFrame, graph: DataFrame, repo: str) -> DataFrame:
    """Nodes of one repository under its prefix, in place of those it had."""
    own = graph.select(F.concat(F.lit(f"{repo}::"), F.col("id")).alias("id"), "label", "source_file", F.lit(repo).alias("repo"), F.col("id").alias("local_id"))
    return total.where(F.col("repo") != repo).unionByName(own)


def add_graph_to_global(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a global graph with one repository's in place of those it had; nodes without a source that are another's by label become that one."""
    kept = add_to_global(nodes, new_nodes, repo)
    own = new_edges.select(*[F.concat(F.lit(f"{repo}::"), F.col(c)).alias(c) if c in ("src", "dst") else F.col(c) for c in new_edges.columns])
    merged = edges.where(~F.col("src").startswith(f"{repo}::")).unionByName(own)
    owned = kept.where("coalesce(source_file, '') <> ''").groupBy(F.lower("label").alias("low")).agg(F.min("id").alias("new"))
    moved = kept.where("coalesce(source_file, '') = ''").select(F.col("id").alias("old"), F.lower("label").alias("low")).join(owned, "low").select("old", "new")
    return kept.join(moved, kept["id"] == moved["old"], "left_anti"), rewire(merged, moved)


def graph_hash(nodes: DataFrame, edges: DataFrame) -> str:
    """A digest of a graph's rows, whatever their order: equal graphs need not be added again."""
    parts = []
    for df in (nodes, edges):
        h = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)])
        parts += [str(v) for v in df.agg(F.count("*"), F.sum(F.shiftright(h, 24)), F.sum(h.bitwiseAND(F.lit(0xFFFFFF)))).first()]
    return "-".join(parts)


def legacy_ids(nodes: DataFrame) -> DataFrame:
    """``(old, new)``: ids that begin with a short form of their file (its name, or folder and name) get the whole path's form instead.

    Parsed nodes keep theirs. The longer short form is tried first.
    """
    bare = F.regexp_replace("source_file", r"\.[^./]+$", "")
    parts = F.split(bare, "/")
    stem, name = text.ascii_id(bare), text.ascii_id(F.element_at(parts, -1))
    parent = F.when(F.size(parts) > 1, text.ascii_id(F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), F.element_at(parts, -1))))
    begins = lambda short: (F.col("id") == short) | F.col("id").startswith(F.concat(short, F.lit("_")))
    moved = lambda short: F.concat(stem, F.expr("substring(id, 1)").substr(F.length(short) + 1, F.lit(1 << 30)))
    kept = nodes.where("origin IS NULL AND coalesce(source_file, '') <> '' AND NOT source_file LIKE '/%'").where(~begins(stem))
    new = F.when(parent.isNotNull() & begins(parent), moved(parent)).when(begins(name), moved(name))
    return kept.select(F.col("id").alias("old"), new.alias("new")).where("new IS NOT NULL AND new <> old")


def merge_fragments(fragments: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes of all fragments, the first record of an id first; edges concatenated."""
    nodes, edges = fragments[0]
    nodes = nodes.withColumn("part", F.lit(0))
    for i, (n, e) in enumerate(fragments[1:], 1):
        nodes, edges = nodes.unionByName(n.withColumn("part", F.lit(i)), allowMissingColumns=True), edges.unionByName(e, allowMissingColumns=True)
    return first_by(nodes, ["id"], "part", "seq").drop("part"), edges


def token_sums(fragments: DataFrame) -> DataFrame:
    """``(input_tokens, output_tokens)`` of all fragments; null counts as none."""
    return fragments.agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens")])


def by_label(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one normalised label made one, of any type (a coarse cleaning that nothing calls by itself): no chunk suffix, then the shortest id, then the first."""
    name = F.trim(F.regexp_replace(F.lower("label"), r"[^\p{L}\p{N}]+", " "))
    named = nodes.withColumn("_name", name).where("_name <> ''")
    winner = first_by(named.withColumn("_chunk", F.col("id").rlike(r"_c\d+$").cast("int")), ["_name"], "_chunk", F.length("id"), "seq", "id").select("_name", F.col("id").alias("new"))
    moved = named.join(winner, "_name").where("id <> new").select(F.col("id").alias("old"), "new")
    return nodes.join(moved, nodes["id"] == moved["old"], "left_anti"), rewire(edges, moved)


def expired(versions: DataFrame, today: str, keep_days: int = 14) -> DataFrame:
    """Dated snapshots ``(path, day)`` that are older than the days kept."""
    return versions.where(F.datediff(F.to_date(F.lit(today)), F.col("day")) > keep_days)
