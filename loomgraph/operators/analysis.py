"""Aggregates, rankings and reports over a graph with communities ``(id, community)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules, text
from loomgraph.operators.graph import degrees, first_by, simple, symmetric
from loomgraph.plans.storage import discard, materialize


def god_nodes(nodes: DataFrame, edges: DataFrame, top: int = 10, ranks: DataFrame | None = None) -> DataFrame:
    """The best-connected entities: no file, concept, JSON-key, builtin, module or namespace nodes. With ``ranks (id, rank)`` the most central ones."""
    n = nodes.join(degrees(edges), "id")
    real = n.where(~rules.is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) & ~rules.is_concept_node(F.col("source_file")) & ~F.col("label").isin(*rules.NOISE_LABELS) & ~rules.is_json_key(F.col("label"), F.col("source_file")))
    if "type" in nodes.columns:
        real = real.where(~F.coalesce(F.col("type").isin("module", "namespace"), F.lit(False)))
    if ranks is None:
        return real.orderBy(F.desc("degree"), "id").limit(top).select("id", "label", "degree")
    return real.join(ranks, "id").orderBy(F.desc("rank"), "id").limit(top).select("id", "label", "degree", "rank")


def confidence_breakdown(edges: DataFrame) -> DataFrame:
    """``(confidence, n, percent)``; percentages to whole numbers, halves to even."""
    counts = edges.groupBy("confidence").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("confidence", "n", F.bround(100.0 * F.col("n") / F.col("total"), 0).cast("int").alias("percent"))


def inferred_average(edges: DataFrame) -> DataFrame:
    """``(n, average)`` of the inferred edges' scores, 0.5 where there is none, to two places, halves to even."""
    inferred = edges.where("confidence = 'INFERRED'")
    return inferred.agg(F.count("*").alias("n"), F.bround(F.avg(F.coalesce(F.col("confidence_score"), F.lit(0.5))), 2).alias("average"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("community").alias("communities"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("confidence") == "EXTRACTED").alias("extracted"), F.count_if(F.col("confidence") == "INFERRED").alias("inferred"), F.count_if(F.col("confidence") == "AMBIGUOUS").alias("ambiguous"))
    return n.crossJoin(e)


def cohesion(edges: DataFrame, community: DataFrame) -> DataFrame:
    """``(community, n, cohesion)``: edges within over pairs; one for a single node."""
    a, b = community.toDF("a", "ca"), community.toDF("b", "cb")
    inside = simple(edges).where("a <> b").join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("m"))
    size = community.groupBy("community").agg(F.count("*").alias("n"))
    share = F.coalesce("m", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)
    return size.join(inside, "community", "left").select("community", "n", F.when(F.col("n") <= 1, 1.0).otherwise(share).alias("cohesion"))


def cross_cutting(nodes: DataFrame, edges: DataFrame, community: DataFrame, top: int = 10) -> DataFrame:
    """Nodes whose neighbours lie in the most communities other than their own."""
    # Both directions share the joins, and repeats don't change a count of distinct communities: edges are shuffled once an end, one at a time.
    left, path = materialize(edges.select("src", "dst").join(community.toDF("src", "own"), "src"), "cut-src")
    ends, ends_path = materialize(left.join(community.toDF("dst", "other"), "dst").where("own <> other").select("src", "own", "dst", "other"), "cut-both")
    discard(edges.sparkSession, path)
    seen = ends.select(F.col("src").alias("id"), F.col("other").alias("c")).union(ends.select("dst", "own")).distinct()
    bridged, _ = materialize(seen.groupBy("id").agg(F.count("*").alias("bridged")), "cut-bridged")
    discard(edges.sparkSession, ends_path)
    d = nodes.join(bridged, "id").join(degrees(edges), "id")
    real = d.where(~rules.is_file_node(F.col("label"), F.col("source_file"), F.col("degree")))
    return real.orderBy(F.desc("bridged"), F.desc("degree"), "id").limit(top).select("id", "label", "bridged", "degree")


def surprising(nodes: DataFrame, edges: DataFrame, community: DataFrame | None, top: int = 5) -> DataFrame:
    """Edges by how surprising they are: between files, by their score; in a graph of one file those that bridge communities (``score`` null), or without
    communities those of largest betweenness."""
    if nodes.where("coalesce(source_file, '') <> ''").select("source_file").distinct().limit(2).count() > 1:
        d = degrees(edges)
        info = nodes.select("id", "source_file").join(d, "id", "left")
        info = (info.join(community, "id", "left") if community is not None else info.withColumn("community", F.lit(None).cast("long"))).fillna(0, ["degree"])
        a, b = info.toDF("src", "fa", "da", "ca"), info.toDF("dst", "fb", "db", "cb")
        j = edges.where(~F.col("relation").isin("imports", "imports_from", "contains", "method")).join(a, "src").join(b, "dst").where("fa <> fb")
        scored = j.withColumn("score", rules.surprise(F.col("relation"), F.col("confidence"), F.col("fa"), F.col("fb"), F.col("ca"), F.col("cb"), F.col("da"), F.col("db")))
        return scored.orderBy(F.desc("score"), "src", "dst", "relation").limit(top).select("src", "dst", "relation", "confidence", "score")
    if community is None:
        from loomgraph.operators.community import edge_betweenness

        central = edge_betweenness(edges).join(edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}), ["a", "b"])
        return central.orderBy(F.desc("score"), "src", "dst", "relation").limit(top).select("src", "dst", "relation", "confidence", F.round("score", 6).alias("score"))
    return bridges(nodes, edges, community, top)


def bridges(nodes: DataFrame, edges: DataFrame, community: DataFrame, top: int = 5) -> DataFrame:
    """One edge for each pair of communities, the least certain first; no file nodes, no structure."""
    d = nodes.join(degrees(edges), "id", "left").fillna(0, ["degree"])
    real = d.where(~rules.is_file_node(F.col("label"), F.col("source_file"), F.col("degree"))).select("id")
    loose = edges.where(~F.col("relation").isin("imports", "imports_from", "contains", "method")).join(real.withColumnRenamed("id", "src"), "src", "left_semi").join(real.withColumnRenamed("id", "dst"), "dst", "left_semi")
    x, y = community.toDF("src", "ca"), community.toDF("dst", "cb")
    rank = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    j = loose.join(x, "src").join(y, "dst").where("ca <> cb").withColumns({"c1": F.least("ca", "cb"), "c2": F.greatest("ca", "cb"), "certain": rank})
    once = first_by(j, ["c1", "c2"], "certain", "src", "dst", "relation")
    return once.orderBy("certain", "src", "dst", "relation").limit(top).select("src", "dst", "relation", "confidence", F.lit(None).cast("double").alias("score"))


def community_links(edges: DataFrame, community: DataFrame) -> DataFrame:
    """``(c1, c2, n)``: edges between each two communities."""
    a, b = community.toDF("src", "ca"), community.toDF("dst", "cb")
    return edges.join(a, "src").join(b, "dst").where("ca <> cb").groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")).agg(F.count("*").alias("n"))


def hub_labels(nodes: DataFrame, edges: DataFrame, community: DataFrame) -> DataFrame:
    """``(community, label)``: the best-connected member's label without call brackets."""
    d = community.join(nodes.select("id", "label"), "id").join(degrees(edges), "id", "left").fillna(0, ["degree"])
    return first_by(d, ["community"], F.desc("degree"), "id").select("community", F.regexp_replace("label", r"\(\)$", "").alias("label"))


def member_signatures(community: DataFrame) -> DataFrame:
    """``(community, signature)``: 16 hex digits over the sorted ids, each ended by a zero character.

    The sorted list is the input of the digest, so a community's ids must fit one task.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: F.concat(i, F.lit("\0"))), "")
    return community.groupBy("community").agg(F.substring(F.sha2(ids, 256), 1, 16).alias("signature"))


def reindex(community: DataFrame) -> DataFrame:
    """``(id, community)`` numbered by size, largest first, ties by the smallest member."""
    size = community.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    order = size.select(F.col("community").alias("old"), (F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).alias("community"))
    return community.withColumnRenamed("community", "old").join(order, "old").select("id", "community")


def overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(old, new, n)``: members that communities of two runs share."""
    return old.toDF("id", "old").join(new.toDF("id", "new"), "id").groupBy("old", "new").agg(F.count("*").alias("n"))


def remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(id, community)``: new communities keep the number of the old one they overlap most, one to one; the others get the smallest free ones.

    Only counts reach the driver, a row at a time: those of the overlaps, then of the new communities.
    """
    taken: dict[int, int] = {}
    used: set[int] = set()
    for r in overlap(old, new).orderBy(F.desc("n"), "old", "new").toLocalIterator():
        if r["new"] not in taken and r["old"] not in used:
            taken[r["new"]] = r["old"]
            used.add(r["old"])
    free = 0
    for r in new.groupBy("community").agg(F.count("*").alias("n"), F.min("id").alias("least")).orderBy(F.desc("n"), "least").toLocalIterator():
        if r["community"] not in taken:
            while free in used:
                free += 1
            taken[r["community"]] = free
            used.add(free)
    table = new.sparkSession.createDataFrame(sorted(taken.items()) or [(-1, -1)], "was long, community long")
    return new.withColumnRenamed("community", "was").join(table, "was").select("id", "community")


def diagnostics(edges: DataFrame) -> DataFrame:
    """``(measure, value)``: what folding pairs would hide."""
    by_pair = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_distinct("relation").alias("relations"), F.count_distinct("confidence").alias("confidences"))
    exact = edges.groupBy("src", "dst", "relation", "confidence").agg(F.count("*").alias("n"))
    a = by_pair.agg(F.sum(F.col("n") - 1).alias("same_endpoints"), F.count_if(F.col("relations") > 1).alias("relation_variants"), F.count_if(F.col("confidences") > 1).alias("confidence_variants"))
    b = exact.agg(F.sum(F.col("n") - 1).alias("exact_duplicates"))
    row = a.crossJoin(b)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("value")) for c in row.columns])).alias("m")).select("m.*")


def directory_rollup(nodes: DataFrame) -> DataFrame:
    """``(prefix, n)``: nodes below each folder, at every depth."""
    parts = F.split("source_file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return nodes.where("source_file <> ''").select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def questions(nodes: DataFrame, edges: DataFrame, community: DataFrame, top: int = 7, central: DataFrame | None = None) -> DataFrame:
    """``(type, question)`` in the order ambiguous, bridge, to verify, isolated, low cohesion; ``no_signal`` (no question) if there are none.

    ``central (id, score)``: betweenness; by default it is measured, from 100 sources beyond 1,000 nodes. Ties go by id.
    """
    quoted = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    d = degrees(edges)
    n = nodes.join(d, "id", "left").fillna(0, ["degree"])
    file = rules.is_file_node(F.col("label"), F.col("source_file"), F.col("degree"))
    label = nodes.select("id", "label")
    a, b = label.toDF("src", "la"), label.toDF("dst", "lb")
    vague = edges.where("confidence = 'AMBIGUOUS'").orderBy("src", "dst", "relation").limit(top).join(a, "src").join(b, "dst")
    vague = vague.select(F.lit(0).alias("part"), F.concat_ws("|", "src", "dst", "relation").alias("key"), F.lit("ambiguous_edge").alias("type"), F.concat(F.lit("What is the exact relationship between "), quoted(F.col("la")), F.lit(" and "), quoted(F.col("lb")), F.lit("?")).alias("question"))
    if vague.count() >= top:  # the parts after it would not be shown
        return vague.orderBy("part", "key").limit(top).select("type", "question")
    if central is None:
        from loomgraph.operators.community import betweenness

        central = betweenness(edges, samples=100 if nodes.count() > 1000 else None)
    real = n.where(~file & ~rules.is_concept_node(F.col("source_file")))
    best = real.join(central, "id").where("score > 0").orderBy(F.desc("score"), "id").limit(3)
    own, other = community.toDF("src", "own"), community.toDF("dst", "other")
    around = symmetric(edges.select("src", "dst")).join(best.select(F.col("id").alias("src"), "label", "score"), "src").join(own, "src").join(other, "dst").where("own <> other")
    named = lambda c: F.concat(F.lit("`Community "), c.cast("string"), F.lit("`"))
    bridge = around.groupBy("src", "label", "score", "own").agg(F.array_sort(F.collect_set("other")).alias("others"))
    bridge = bridge.select(F.lit(1), F.concat(F.lpad(F.format_number(F.lit(1e15) - F.col("score"), 6), 32, "0"), "src"), F.lit("bridge_node"), F.concat(F.lit("Why does "), quoted(F.col("label")), F.lit(" connect "), named(F.col("own")), F.lit(" to "), F.array_join(F.transform("others", named), ", "), F.lit("?")))
    gods = n.where(~file).orderBy(F.desc("degree"), "id").limit(5)
    ends = symmetric(edges.where("confidence = 'INFERRED'").select("src", "dst")).join(gods.select(F.col("id").alias("src"), "label", "degree"), "src").join(label.toDF("dst", "with"), "dst")
    guessed = ends.groupBy("src", "label", "degree").agg(F.count("*").alias("guesses"), F.slice(F.array_sort(F.collect_list(F.struct("dst", "with"))), 1, 2).alias("two")).where("guesses >= 2")
    verify = guessed.select(F.lit(2), F.concat(F.lpad((F.lit(1 << 53) - F.col("degree")).cast("string"), 20, "0"), "src"), F.lit("verify_inferred"), F.concat(F.lit("Are the "), F.col("guesses").cast("string"), F.lit(" inferred relationships involving "), quoted(F.col("label")), F.lit(" (e.g. with "), quoted(F.col("two")[0]["with"]), F.lit(" and "), quoted(F.col("two")[1]["with"]), F.lit(") actually correct?")))
    few = real.where("degree <= 1").orderBy("id").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "label"))), lambda x: quoted(x["label"])), ", ").alias("names")).where("names <> ''")
    isolated = few.select(F.lit(3), F.lit(""), F.lit("isolated_nodes"), F.concat(F.lit("What connects "), "names", F.lit(" to the rest of the system?")))
    loose = cohesion(edges, community).where("n >= 5 AND cohesion < 0.15").select(F.lit(4), F.lpad(F.col("community").cast("string"), 12, "0"), F.lit("low_cohesion"), F.concat(F.lit("Should "), named(F.col("community")), F.lit(" be split into smaller, more focused modules?")))
    found = vague.union(bridge).union(verify).union(isolated).union(loose).orderBy("part", "key").limit(top).select("type", "question")
    return found if not found.isEmpty() else nodes.sparkSession.createDataFrame([("no_signal", None)], found.schema)


def weighted_degrees(edges: DataFrame) -> DataFrame:
    """``(id, score)``: sums of edge scores ``(relation, confidence, confidence_score)`` over both ends."""
    e = edges.select("src", "dst", rules.edge_score(F.col("relation"), F.col("confidence"), F.col("confidence_score")).alias("score"))
    return e.select(F.explode(F.array("src", "dst")).alias("id"), "score").groupBy("id").agg(F.sum("score").alias("score"))


def preferred_edges(edges: DataFrame) -> DataFrame:
    """Edges worth a diagram: calls, uses, methods, imports; all certain ones if there are none of these."""
    sure = edges.where(rules.edge_included(F.col("confidence"), F.col("confidence_score")))
    main = F.col("relation").isin("calls", "uses", "method", "imports", "imports_from")
    any_main = F.broadcast(sure.agg(F.coalesce(F.bool_or(main), F.lit(False)).alias("any_main")))
    return sure.crossJoin(any_main).where(main | ~F.col("any_main")).drop("any_main")


def section_summary(classified: DataFrame) -> DataFrame:
    """``(section_a, section_b, relation, n)`` of the edges between sections."""
    return classified.where("section = 'inter'").groupBy("section_a", "section_b", "relation").agg(F.count("*").alias("n"))


def keyword_archetypes(sections: DataFrame, keywords: dict[str, tuple[str, ...]]) -> DataFrame:
    """``(section, archetype)``: whose words occur most in the texts of a section ``(section, text)``, at least twice; ties by name.

    Words are counted where the texts are; only counts are shuffled.
    """
    rows = [F.struct(F.lit(name).alias("archetype"), sum((F.size(F.regexp_extract_all(F.lower("text"), F.lit(rf"\b({w})\b"), F.lit(1))) for w in words), F.lit(0)).alias("hits")) for name, words in keywords.items()]
    counted = sections.select("section", F.explode(F.array(*rows)).alias("r")).select("section", "r.*").groupBy("section", "archetype").agg(F.sum("hits").alias("hits"))
    return first_by(counted.where("hits >= 2"), ["section"], F.desc("hits"), "archetype").select("section", "archetype")


def section_keywords(labels: DataFrame, top: int = 5, stop: tuple[str, ...] = ("the", "and", "for", "with", "from")) -> DataFrame:
    """``(section, word, n)``: the most frequent words of ``(section, label)``, ties by word."""
    words = labels.select("section", F.explode(text.ascii_tokens(F.col("label"))).alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(*stop))
    counts = words.groupBy("section", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "word"))).where(F.col("r") <= top).drop("r")


def token_report(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """``(corpus_tokens, answer_tokens, reduction)``: words * 100 / 75 against characters / 4."""
    c = documents.agg(F.floor(F.sum(text.word_count(F.col("text"))) * 100 / 75).alias("corpus_tokens"))
    a = answers.agg(F.sum(F.floor(F.length("text") / 4)).alias("answer_tokens"))
    return c.crossJoin(a).select("corpus_tokens", "answer_tokens", F.round(F.col("corpus_tokens") / F.col("answer_tokens"), 4).alias("reduction"))


def risk_bands(reach: DataFrame) -> DataFrame:
    """``(seed, n, risk)`` from ``(seed, id)``: isolated, contained up to five, else high."""
    c = reach.groupBy("seed").agg(F.count("id").alias("n"))
    return c.select("seed", "n", F.when(F.col("n") == 0, "isolated").when(F.col("n") <= 5, "contained").otherwise("high").alias("risk"))


def within_budget(lines: DataFrame, tokens: int) -> DataFrame:
    """Lines ``(group, place, line)`` of each group while their running length stays within four characters a token."""
    w = Window.partitionBy("group").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("used", F.sum(F.length("line") + 1).over(w)).where(F.col("used") <= 4 * tokens)


def community_samples(nodes: DataFrame, community: DataFrame, gods: DataFrame, most: int = 100, top: int = 12, length: int = 60) -> DataFrame:
    """``(community, names)``: labels that stand for the largest communities, central entities first, each name once."""
    order = community.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(most)
    held = community.join(order, "community").join(nodes.select("id", "label"), "id").join(gods.select("id", F.lit(0).alias("god")), "id", "left")
    name = F.substring(F.regexp_replace(F.trim("label"), r"^[()]+|[()]+$", ""), 1, length)
    named = held.select("community", "n", name.alias("name"), F.coalesce("god", F.lit(1)).alias("god"), "id").where("name <> ''")
    once = first_by(named.withColumn("low", F.lower("name")), ["community", "low"], "god", "id")
    w = Window.partitionBy("community").orderBy("god", "id")
    ranked = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return ranked.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("names"))


def section_ranking(sections: DataFrame, archetypes: dict[str, tuple[str, ...]], most: int = 15) -> DataFrame:
    """``(community, section, place)`` of ``(community, label, text, n)``: communities go to the archetype whose words they have most, at least twice (of equals
    the first). Archetypes come in their order, then by size and name, all but one of the places; the largest communities without one fill the rest under their
    label, all others are ``other``.
    """
    order = {name: i for i, name in enumerate(archetypes)}
    hits = [F.struct(sum((F.size(F.regexp_extract_all(F.lower("text"), F.lit(rf"\b({w})\b"), F.lit(1))) for w in words), F.lit(0)).alias("hits"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for (name, words), i in zip(archetypes.items(), order.values(), strict=True)]
    best = F.array_max(F.array(*hits))
    own = sections.groupBy("community").agg(F.first("label").alias("label"), F.sum("n").alias("n"), F.array_join(F.collect_list("text"), " ").alias("text")).withColumn("best", best)
    own = own.select("community", "label", "n", F.when(F.col("best.hits") >= 2, F.col("best.name")).alias("kind"), F.when(F.col("best.hits") >= 2, -F.col("best.rank")).alias("priority"))
    kinds = own.where("kind IS NOT NULL").groupBy("kind", "priority").agg(F.sum("n").alias("size"))
    kinds = kinds.withColumn("place", F.row_number().over(Window.orderBy("priority", F.desc("size"), "kind"))).where(F.col("place") <= max(1, most - 1))  # no more rows than archetypes
    left = max(0, most - 1 - kinds.count())
    plain = own.where("kind IS NULL").orderBy(F.desc("n"), F.col("community").cast("string")).limit(left).select("community", F.lit(True).alias("alone"))
    j = own.join(kinds.select("kind", "place"), "kind", "left").join(plain, "community", "left")
    return j.select("community", F.when(F.col("place").isNotNull(), F.col("kind")).when(F.col("alone"), F.col("label")).otherwise("other").alias("section"), "place")


def diagram_nodes(nodes: DataFrame, edges: DataFrame, most: int = 24) -> DataFrame:
    """``(id, place)`` of the nodes of a readable diagram: entry points (more calls out than in), then ends of the strongest edges, then the best connected.

    ``edges (src, dst, relation, confidence, confidence_score)``; each node once, in its first place. Each of the three lists is a ranked, bounded one.
    """
    used = preferred_edges(edges).withColumn("score", rules.edge_score(F.col("relation"), F.col("confidence"), F.col("confidence_score")))
    ends = used.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), "score"), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), "score"))).alias("e")).select("e.*")
    known = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("score").alias("score")).join(nodes.select("id"), "id", "left_semi")
    entry = known.where("o > 0").orderBy(F.desc(F.col("o") - F.col("i")), F.desc("o"), "id").limit(max(3, most // 3))
    entry = entry.select("id", F.lit(0).alias("part"), F.row_number().over(Window.orderBy(F.desc(F.col("o") - F.col("i")), F.desc("o"), "id")).alias("r"))
    strong = used.orderBy(F.desc("score"), "src", "dst", "relation").limit(most).withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "src", "dst", "relation")))
    strong = strong.select(F.explode(F.array(F.struct(F.col("src").alias("id"), (2 * F.col("r")).alias("r")), F.struct(F.col("dst").alias("id"), (2 * F.col("r") + 1).alias("r")))).alias("e")).select("e.id", F.lit(1).alias("part"), "e.r").join(nodes.select("id"), "id", "left_semi")
    rest = nodes.select("id").join(known.select("id", "score"), "id", "left").fillna(0.0, ["score"]).orderBy(F.desc("score"), "id").limit(most)
    rest = rest.select("id", F.lit(2).alias("part"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("r"))
    first = first_by(entry.union(strong).union(rest), ["id"], "part", "r")
    return first.orderBy("part", "r").limit(most).select("id", F.row_number().over(Window.orderBy("part", "r")).alias("place"))


def pr_order(prs: DataFrame) -> DataFrame:
    """``prs (.., status, days_old, number)`` with their place: by what has to be done first, then the youngest."""
    rank = F.array_position(F.array(*map(F.lit, rules.PR_ORDER)), F.col("status"))
    return prs.withColumn("place", F.row_number().over(Window.orderBy(F.when(rank > 0, rank).otherwise(99), "days_old", "number")))


def fragment_errors(nodes: DataFrame, edges: DataFrame, hyper: DataFrame | None = None, payload_bytes: int | None = None) -> DataFrame:
    """``(error)`` of a fragment that is too large, or holds ids that are missing or too long, or unknown node types. None: it may be merged."""
    bad_id = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "") | (F.length(c) > rules.MOST_ID)
    most = lambda df, what, n: df.agg(F.count("*").alias("n")).where(F.col("n") > n).select(F.concat(F.lit(f"{what} has "), F.col("n").cast("string"), F.lit(f" entries; max is {n}")).alias("error"))
    wrong = [most(nodes, "nodes", rules.MOST_NODES), most(edges, "edges", rules.MOST_EDGES), nodes.where(bad_id("id")).select(F.lit("bad node id").alias("error"))]
    wrong.append(nodes.where(F.col("file_type").isNotNull() & ~F.col("file_type").isin(*rules.FILE_TYPES)).select(F.concat(F.lit("unknown file_type "), "file_type")))
    wrong += [edges.where(bad_id(c)).select(F.lit(f"bad edge {name}")) for c, name in (("src", "source"), ("dst", "target"))]
    if hyper is not None:
        wrong += [most(hyper, "hyperedges", rules.MOST_HYPEREDGES), hyper.where(F.size("nodes") > rules.MOST_MEMBERS).select(F.lit("hyperedge has too many nodes"))]
    if payload_bytes is not None and payload_bytes > rules.MOST_BYTES:
        wrong.append(nodes.sparkSession.createDataFrame([(f"payload is {payload_bytes} bytes; max is {rules.MOST_BYTES}",)], "error string"))
    out = wrong[0]
    for w in wrong[1:]:
        out = out.union(w)
    return out
