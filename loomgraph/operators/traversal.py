"""Traversals as frontier loops: one join a level, what was seen is anti-joined, each level is written to shared storage.

Depth is a small fixed number, so the loop's plans are few. Hubs are not expanded, which also keeps a level's join free of
hot keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators.graph import degrees, first_by, symmetric
from loomgraph.plans.storage import bucketed, discard, materialize

#: Edges whose ranks one task computes at most, at some 60 bytes each; those of more are computed over DataFrames.
TASK_EDGES = 12_000_000


def index_percentile(degree: DataFrame, share: float) -> int:
    """The degree at an index of the sorted list, not interpolated: found on the histogram of degrees."""
    counts = degree.groupBy("degree").agg(F.count("*").alias("n")).orderBy("degree").toPandas()
    if counts.empty:
        return 0
    total = int(counts["n"].sum())
    return int(counts["degree"][counts["n"].cumsum() > min(total - 1, int(total * share))].iloc[0])


def frontier(seeds: DataFrame, step: Callable[[DataFrame, int], DataFrame], depth: int) -> DataFrame:
    """``(id, hop)``: ``step(level, hop)`` gives the ids reached from a level; each id keeps its first hop."""
    spark = seeds.sparkSession
    seen, path = materialize(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "frontier")
    level = seen
    for hop in range(1, depth + 1):
        reached = step(level.select("id"), hop).select("id").distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        level, new = materialize(reached, "frontier")
        if level.isEmpty():
            discard(spark, new)
            break
        seen = seen.unionByName(level)
    return seen


class Neighbours:
    """A graph to be walked on, written once: both directions of every pair in buckets by ``src``, and the degrees of all nodes."""

    def __init__(self, edges: DataFrame):
        self.both = bucketed(symmetric(edges.select("src", "dst")), "walk-both", "src", distinct=True)
        self.degree, _ = materialize(degrees(edges), "walk-degrees")
        self._cuts: dict[float, int] = {}

    def cut(self, share: float) -> int:
        """The degree at an index of the sorted list of degrees."""
        if share not in self._cuts:
            self._cuts[share] = index_percentile(self.degree, share)
        return self._cuts[share]

    def hubs(self, least: int, share: float) -> DataFrame:
        """``(hub)``: nodes of at least that many ends and at least that degree."""
        return self.degree.where(F.col("degree") >= max(least, self.cut(share))).select(F.col("id").alias("hub"))


def neighbours(edges: DataFrame | Neighbours) -> Neighbours:
    return edges if isinstance(edges, Neighbours) else Neighbours(edges)


def hops(edges: DataFrame | Neighbours, seeds: DataFrame, depth: int) -> DataFrame:
    """``(id, hop)`` of all nodes within ``depth`` undirected steps."""
    both = neighbours(edges).both
    return frontier(seeds, lambda level, _: level.join(both, level["id"] == both["src"]).select(F.col("dst").alias("id")), depth)


def bfs(edges: DataFrame | Neighbours, seeds: DataFrame, depth: int = 3, least_hub: int = 50, share: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, hop)`` and edges ``(src, dst, hop)`` found; a hub is reached but not expanded, unless it is a seed.

    The edges are those from a level to nodes that no earlier level had.
    """
    walk = neighbours(edges)
    both, hubs = walk.both, walk.hubs(least_hub, share)

    def step(level: DataFrame, hop: int) -> DataFrame:
        open_ = level if hop == 1 else level.join(hubs, level["id"] == hubs["hub"], "left_anti")
        return open_.join(both, open_["id"] == both["src"]).select(F.col("dst").alias("id"))

    found = frontier(seeds, step, depth)
    a = found.select(F.col("id").alias("src"), F.col("hop").alias("from_hop"))
    b = found.select(F.col("id").alias("dst"), F.col("hop").alias("hop"))
    open_ = a.join(hubs, (a["src"] == hubs["hub"]) & (a["from_hop"] > 0), "left_anti").where(F.col("from_hop") < depth)
    return found, open_.join(both, "src").join(b, "dst").where("hop = from_hop + 1").select("src", "dst", "hop")


def affected(edges: DataFrame, seeds: DataFrame, relations: tuple[str, ...] = rules.AFFECTED_RELATIONS, depth: int = 2) -> DataFrame:
    """``(id, hop, relation)``: what a change of the seeds reaches against the direction of its relations, and by which one first."""
    e = bucketed(edges.where(rules.relation_matches(F.col("relation"), relations)).select("src", "dst", "relation").distinct(), "walk-affected", "dst")
    found = frontier(seeds, lambda level, _: level.join(e, level["id"] == e["dst"]).select(F.col("src").alias("id")), depth)
    before = found.select(F.col("id").alias("dst"), (F.col("hop") + 1).alias("hop"))
    first = e.join(before, "dst").select(F.col("src").alias("id"), "hop", "relation").groupBy("id", "hop").agg(F.min("relation").alias("relation"))
    return found.where("hop > 0").join(first, ["id", "hop"], "left")


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int = 6, direction: str = "callers", cap: int = 200) -> DataFrame:
    """``(id, hop)`` by direction (callers, callees, both), nearest first and then by id, as many as the report shows.

    Of edges with a ``confidence`` also the first parent, by id, and the confidence of the step from it.
    """
    e = edges.select("src", "dst", *[c for c in ("confidence",) if c in edges.columns])
    forward = {"callees": e, "callers": e.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in e.columns]), "both": symmetric(e)}[direction]
    walk = bucketed(forward.distinct(), "walk-blast", "src")
    found = frontier(seeds, lambda level, _: level.join(walk, level["id"] == walk["src"]).select(F.col("dst").alias("id")), depth)
    near = found.where("hop > 0").orderBy("hop", "id").limit(cap)
    if "confidence" not in e.columns:
        return near
    before = found.select(F.col("id").alias("src"), (F.col("hop") + 1).alias("hop"))
    first = near.join(walk.withColumnRenamed("dst", "id"), "id").join(before, ["src", "hop"]).groupBy("id", "hop").agg(F.min(F.struct("src", "confidence")).alias("first"))
    return near.join(first, ["id", "hop"]).select("id", "hop", F.col("first.src").alias("parent"), F.col("first.confidence").alias("confidence"))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(id)`` of everything reachable along the edges' direction; stops when a level adds nothing."""
    e = bucketed(edges.select("src", "dst").distinct(), "walk-reach", "src")
    return frontier(seeds, lambda level, _: level.join(e, level["id"] == e["src"]).select(F.col("dst").alias("id")), 1_000_000).select("id")


def unreachable_functions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes (id, label, source_file)`` never reached from an entry point by calls. An entry point isn't called and has a public or test name."""
    calls = edges.where(F.col("relation").isin("calls", "indirect_call"))
    degree = degrees(edges)
    functions = nodes.join(degree, "id", "left").where(~rules.is_file_node(F.col("label"), F.col("source_file"), F.coalesce("degree", F.lit(0))) & ~rules.is_concept_node(F.col("source_file")))
    name = F.regexp_replace("label", r"^[.()]+|[.()]+$", "")
    called = calls.select(F.col("dst").alias("id")).distinct()
    entries = functions.where(name.isin("main", "__main__") | ~name.startswith("_")).join(called, "id", "left_anti")
    return functions.join(reachable(calls, entries.select("id")), "id", "left_anti").select("id", "label", "source_file")


def import_cycles(file_edges: DataFrame, longest: int = 5) -> DataFrame:
    """``(cycle)``: simple directed cycles of files up to a length, each once, its smallest file first."""
    e = file_edges.select("src", "dst").distinct()
    paths = e.where("dst >= src").select(F.col("src").alias("first"), F.array("src").alias("path"), F.col("dst").alias("tip"))
    found, spark = paths.where("tip = first").select("path"), e.sparkSession
    paths = paths.where("tip > first")
    for _ in range(longest - 1):
        grown = paths.select("first", F.array_append("path", F.col("tip")).alias("path"), F.col("tip").alias("at"))
        step = grown.join(e, grown["at"] == e["src"]).where("dst >= first").select("first", "path", F.col("dst").alias("tip"))
        step, _ = materialize(step, "cycles")
        found = found.union(step.where("tip = first").select("path"))
        paths = step.where(~F.array_contains("path", F.col("tip")) & F.expr("tip > first"))
    return found.select(F.array_join("path", " > ").alias("cycle"), F.size("path").alias("length"))


def numbered(ids: DataFrame) -> tuple[DataFrame, str]:
    """``(id, at)`` with ``at`` from 0 without gaps, in the order in which ``ids (id)`` are, and its path; only counts of partitions come to the driver."""
    spark = ids.sparkSession
    kept, path = materialize(ids.select("id", F.monotonically_increasing_id().alias("place")), "numbered")
    part = F.shiftright("place", 33)
    base, bases = 0, []
    for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        bases.append((r["part"], base))
        base += r["n"]
    known = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    return kept.withColumn("part", part).join(known, "part").select("id", (F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("at")), path


def _ranks_in_task(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float, tolerance: float | None) -> DataFrame:
    """As ``pagerank``, with all rounds in one task, over numbers in place of ids."""
    spark = nodes.sparkSession
    at, at_path = numbered(nodes.select("id").distinct())
    at, all_path = materialize(at, "rank-nodes")
    n = at.count()
    no = F.lit(-1).cast("long")
    ends = edges.select("src", "dst", "weight").join(at.toDF("src", "a"), "src", "left").join(at.toDF("dst", "b"), "dst", "left")
    ends = ends.select(F.coalesce("a", no).cast("int").alias("a"), F.coalesce("b", no).cast("int").alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not parts:
            return
        a, b, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        apart = a != b
        src, dst, w = np.r_[a, b[apart]], np.r_[b, a[apart]], np.r_[w, w[apart]]
        known = src >= 0
        src, dst, w = src[known], dst[known], w[known]
        total, idle = np.bincount(src, w, n), np.bincount(src, minlength=n) == 0
        there = dst >= 0
        order = np.argsort(dst[there], kind="stable")
        src, dst, w = src[there][order], dst[there][order], w[there][order]
        share = np.divide(w, total[src], out=np.zeros(len(w)), where=total[src] > 0)
        rank = np.full(n, 1.0 / max(n, 1))
        for _ in range(rounds):
            new = (1 - damping) / n + damping * rank[idle].sum() / n + damping * np.bincount(dst, rank[src] * share, n)
            moved, rank = np.abs(new - rank).sum(), new
            if tolerance and moved < n * tolerance:
                break
        for i in range(0, n, 100_000):
            yield pa.record_batch([pa.array(np.arange(i, min(n, i + 100_000))), pa.array(rank[i : i + 100_000])], ["at", "rank"])

    ranks, _ = materialize(at.join(ends.repartition(1).mapInArrow(run, "at long, rank double"), "at", "left").select("id", F.coalesce("rank", F.lit(1.0 / max(n, 1))).alias("rank")), "ranks")
    discard(spark, at_path, all_path)
    return ranks


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """``(id, rank)`` by power iteration over weighted undirected edges; what has no neighbour gives its rank to all.

    ``edges (src, dst, weight)``. Ends early when the summed change is below ``tolerance`` times the number of nodes. Up to ``TASK_EDGES`` edges
    one task does all rounds; of more the flows stay in buckets by their source, so a round shuffles ranks and what they sum up to, never the edges.
    """
    spark = nodes.sparkSession
    if edges.count() <= TASK_EDGES:
        return _ranks_in_task(nodes, edges, rounds, damping, tolerance)
    both = symmetric(edges.select("src", "dst", "weight"))
    total, total_path = materialize(both.groupBy("src").agg(F.sum("weight").alias("total")), "flow-totals")
    flow = bucketed(both.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "flow", "src")
    has = total.select(F.col("src").alias("id"), F.lit(False).alias("none"))
    table = nodes.select("id").distinct().join(has, "id", "left").select("id", F.coalesce("none", F.lit(True)).alias("idle"))
    table, table_path = materialize(table, "rank-nodes")
    n = table.count()
    ranks, path = materialize(table.select("id", "idle", F.lit(1.0 / max(n, 1)).alias("rank")), "ranks")
    idle = table.where("idle").count() / max(n, 1)
    discard(spark, total_path)
    for _ in range(rounds if n else 0):
        given = ranks.where("NOT idle").join(flow, ranks["id"] == flow["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new, new_path = materialize(ranks.select("id", "idle", F.col("rank").alias("old")).join(given, "id", "left").select("id", "idle", (F.lit((1 - damping) / n + damping * idle / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), "old"), "ranks")
        told = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved"), F.sum(F.when(F.col("idle"), F.col("rank"))).alias("idle")).first()
        discard(spark, path)
        ranks, path, idle = new.select("id", "idle", "rank"), new_path, told["idle"] or 0.0
        if tolerance and told["moved"] < n * tolerance:
            break
    discard(spark, table_path)
    return ranks.select("id", "rank")


def path_costs(walk: Neighbours, source: str, avoid: DataFrame | None = None, keep: tuple[str, ...] = (), target: str | None = None) -> DataFrame:
    """``(id, cost)``: the cheapest undirected way from ``source`` to every node, a step costing one and both ends' degrees.

    Distances are improved level by level, from the nodes that the level before improved, until none is; a ``target``'s cost bounds
    which are still worth following. ``avoid (id)`` are nodes not entered, but for those in ``keep``. Any length, nothing on the driver but a number.
    """
    spark = walk.both.sparkSession
    none = F.lit(None).cast("long")
    start = walk.degree.select("id", "degree", F.when(F.col("id") == source, F.lit(0).cast("long")).otherwise(none).alias("cost"), (F.col("id") == source).alias("better"))
    best, path = materialize(start, "path-costs")
    end = walk.degree.where(F.col("id") == target).first() if target is not None else None
    open_, bound = walk.both.select("src", "dst").where("src <> dst"), None
    if avoid is not None:
        bad = avoid.where(~F.col("id").isin(source, *keep)).select(F.col("id").alias("dst"))
        open_ = open_.join(bad, "dst", "left_anti")
    while True:
        level = best.where("better").select(F.col("id").alias("src"), (F.col("cost") + 1 + F.col("degree")).alias("left"))
        step = level.join(open_, "src").groupBy(F.col("dst").alias("id")).agg(F.min("left").alias("left"))
        new = F.col("left") + F.col("degree")
        better = F.col("left").isNotNull() & (F.col("cost").isNull() | (new < F.col("cost")))
        if bound is not None:  # what is no target must still step to it
            better = better & ((F.col("id") == target) | (new + 1 + F.col("degree") + end["degree"] <= bound))
        told = best.select("id", "degree", "cost").join(step, "id", "left").withColumn("better", better)
        best, new_path = materialize(told.select("id", "degree", F.when(F.col("better"), new).otherwise(F.col("cost")).alias("cost"), "better"), "path-costs")
        discard(spark, path)
        path = new_path
        seen = best.agg(F.max("better").alias("more"), F.min(F.when(F.col("id") == target, F.col("cost")) if target is not None else none).alias("bound")).first()
        bound = seen["bound"]
        if not seen["more"]:
            return best.where("cost IS NOT NULL").select("id", "cost")


def shortest_path(edges: DataFrame | Neighbours, source: str, target: str, avoid: DataFrame | None = None) -> list[str]:
    """A cheapest undirected path, a step costing one and both ends' degrees; of several the one whose nodes, seen from the target, are smallest. Empty if there is none."""
    walk = neighbours(edges)
    cost = path_costs(walk, source, avoid, (target,), target)
    degree = walk.degree
    here = cost.join(degree, "id").where(F.col("id") == target).first()
    if here is None:
        return []
    path = [target]
    while path[-1] != source:
        into = walk.both.where(F.col("src") == path[-1]).select(F.col("dst").alias("id")).join(cost, "id").join(degree, "id")
        best = into.where(F.col("cost") + 1 + F.col("degree") + here["degree"] == here["cost"]).orderBy("id").first()  # a step of the path at a time
        path.append(best["id"])
        here = best
    return path[::-1]


def path_noise(nodes: DataFrame, walk: Neighbours, least_hub: int = 10, share: float = 0.95) -> DataFrame:
    """``(id)`` of nodes a path should not run through: modules, builtin names, and nodes of a degree that few have."""
    named = nodes.where(F.col("label").isin(*rules.NOISE_LABELS) | (F.col("type").isin("module", "namespace") if "type" in nodes.columns else F.lit(False))).select("id")
    return named.union(walk.hubs(least_hub, share).select(F.col("hub").alias("id"))).distinct()


def find_path(nodes: DataFrame, edges: DataFrame | Neighbours, source: str, target: str, source_path: str = "", target_path: str = "") -> dict:
    """The path between what two names stand for: every pair of near-tied candidates is tried, best ranks first, around noise and then through it.

    A dictionary with ``error``, or ``path`` (None if no pair is connected), ``warnings``, ``used_noise`` and ``tried``.
    Candidates and the path, few names each, are all that comes to the driver.
    """
    from loomgraph.operators.search import near_ties, score

    found = []
    for name, within in ((source, source_path), (target, target_path)):
        scored = score(nodes, [t.lower() for t in name.split()])
        if within:
            scored = scored.join(nodes.where(F.col("source_file").startswith(within)).select("id"), "id", "left_semi")
        tied = near_ties(scored).join(nodes.select("id", "label"), "id").orderBy(F.desc("score"), F.length("label"), "id")
        found.append([r["id"] for r in tied.select("id").toLocalIterator()])
        if not found[-1]:
            return {"error": f"no node matches {name!r}" + (f" under {within!r}" if within else "")}
    if found[0] == found[1] and len(found[0]) == 1:
        return {"error": f"{source!r} and {target!r} are one node: {found[0][0]}"}
    warnings = [f"{side} is ambiguous: {len(ids)} nodes match alike ({', '.join(ids[:5])})" for side, ids in zip(("source", "target"), found, strict=True) if len(ids) > 1]
    walk = neighbours(edges)
    noise, _ = materialize(path_noise(nodes, walk), "path-noise")
    pairs = sorted(((i, j) for i in range(len(found[0])) for j in range(len(found[1]))), key=sum)
    for tried, (i, j) in enumerate(pairs, 1):
        a, b = found[0][i], found[1][j]
        for avoid in (noise, None) if a != b else ():
            if path := shortest_path(walk, a, b, avoid):
                return {"path": path, "warnings": warnings, "used_noise": avoid is None, "tried": tried}
    return {"path": None, "warnings": warnings, "used_noise": False, "tried": len(pairs)}


def neighbors(edges: DataFrame, nodes: DataFrame, node_id: str, relation: str = "") -> DataFrame:
    """``(direction, relation, id, label)`` of a node's edges whose relation holds ``relation``."""
    e = edges.where(F.col("relation").contains(relation))
    out = e.where(F.col("src") == node_id).select(F.lit("out").alias("direction"), "relation", F.col("dst").alias("id"))
    into = e.where(F.col("dst") == node_id).select(F.lit("in").alias("direction"), "relation", F.col("src").alias("id"))
    return out.union(into).join(nodes.select("id", "label"), "id")


def explain(edges: DataFrame, nodes: DataFrame, node_id: str, limit: int = 20) -> DataFrame:
    """A node's connections by the neighbours' degree."""
    return neighbors(edges, nodes, node_id).join(degrees(edges), "id").orderBy(F.desc("degree"), "id", "direction", "relation").limit(limit)


def concept_anchor(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, anchor)``: for concept nodes the file of their best-connected neighbour that has one."""
    concepts = nodes.where(rules.is_concept_node(F.col("source_file"))).select("id")
    both = symmetric(edges.select("src", "dst"))
    real = nodes.where(~rules.is_concept_node(F.col("source_file"))).select(F.col("id").alias("dst"), "source_file").join(degrees(edges).withColumnRenamed("id", "dst"), "dst")
    ranked = concepts.join(both, concepts["id"] == both["src"]).join(real, "dst")
    return first_by(ranked, ["id"], F.desc("degree"), "dst").select("id", F.col("source_file").alias("anchor"))
