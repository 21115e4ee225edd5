"""Streams: watched folders that keep a graph up to date, decayed feedback, and windows over events.

A graph's tables are kept in versions ``v<n>`` below one folder; a version counts once it is marked as done, so a reader never sees half of one and
an interrupted write is written again. Watching works in micro-batches. Watermarks and windows over events are extensions.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions import rules
from loomgraph.operators import feedback, graph
from loomgraph.sources.extract import extract, fragments

#: Versions kept for readers that are still at them.
KEEP = 3


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, tables: str, kind: str = "v") -> list[int]:
    """Numbers of the finished versions, ascending."""
    fs, p = _fs(spark, f"{tables}/{kind}*/_DONE")
    return sorted(int(s.getPath().getParent().getName()[len(kind) :]) for s in fs.globStatus(p) or [])


def publish(spark: SparkSession, tables: str, write: Callable[[str], None], kind: str = "v") -> int:
    """Writes the next version with ``write(path)`` and marks it as done; versions older than the last few go."""
    have = versions(spark, tables, kind)
    number = have[-1] + 1 if have else 0
    path = f"{tables}/{kind}{number}"
    fs, p = _fs(spark, path)
    fs.delete(p, True)
    write(path)
    fs.create(_fs(spark, f"{path}/_DONE")[1]).close()
    for old in have[: 1 - KEEP]:
        fs.delete(_fs(spark, f"{tables}/{kind}{old}")[1], True)
    return number


def tables_of(spark: SparkSession, tables: str) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of the last version."""
    have = versions(spark, tables)
    return tuple(spark.read.parquet(f"{tables}/v{have[-1]}/{t}") for t in ("nodes", "edges")) if have else None


def update(spark: SparkSession, tables: str, nodes: DataFrame, edges: DataFrame, removed: DataFrame | None = None) -> int | None:
    """Nodes and edges in place of what the same sources gave before, without those of ``removed (source_file)``, as the next version. None, and nothing
    written, if the graph would be the same but for what changes with every run.
    """
    old = tables_of(spark, tables)
    if old:
        gone = nodes.select("source_file").distinct()
        gone = gone.union(removed.select("source_file")) if removed is not None else gone
        nodes, edges = (o.join(gone, "source_file", "left_anti").select(*n.columns).union(n) for o, n in zip(old, (nodes, edges), strict=True))
        if graph.same_topology(old[0], nodes, ["id", "label", "file_type", "source_file"]) and graph.same_topology(old[1], edges, ["src", "dst", "relation", "source_file"]):
            return None

    def write(path: str) -> None:
        nodes.write.parquet(f"{path}/nodes")
        edges.write.parquet(f"{path}/edges")

    return publish(spark, tables, write)


def watch(spark: SparkSession, folder: str, trigger: str = "3 seconds") -> DataFrame:
    """New text files of a folder as a stream ``(path, text)``, each path once. Changes and deletions are seen by ``refresh`` and ``start``."""
    del trigger  # set on the writer; named here so that callers see the quiet period's counterpart
    raw = spark.readStream.option("recursiveFileLookup", True).text(folder, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def route(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources, which are rebuilt at once, and other files, which only mark the graph as stale."""
    code = rules.doc_type(F.col("path")) == "code"
    return files.where(code), files.where(~F.coalesce(code, F.lit(False)))


def rebuild(tables: str) -> Callable[[DataFrame, int], None]:
    """A batch function: the files' nodes and edges replace those of the same files in the last version.

    A batch that runs twice, or a stream begun anew, finds the graph as it is and adds nothing that is there.
    """

    def run(files: DataFrame, batch: int) -> None:
        nodes, edges, _ = fragments(extract(files.dropDuplicates(["path"])))
        update(files.sparkSession, tables, nodes, edges)

    return run


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, changed, size)`` of all files below a folder; no content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", F.unix_micros("modificationTime").alias("changed"), F.col("length").alias("size"))


@dataclass
class Refreshed:
    version: int | None = None
    changed: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)
    #: Files that a rebuild of sources doesn't cover.
    stale: list[str] = field(default_factory=list)
    waiting: bool = False


def refresh(spark: SparkSession, folder: str, tables: str, quiet: float = 3.0, now: Callable[[], float] = time.time) -> Refreshed:
    """One look at a folder: new, changed and deleted files against the last look, and the graph brought up to date with them.

    Waits for the next look while a file changed less than ``quiet`` seconds ago, so a burst of changes is one rebuild. Files that were
    touched but hold the same text change nothing. Paths of changed files, not their texts, come to the driver.
    """
    have = versions(spark, tables, "m")
    known = spark.read.parquet(f"{tables}/m{have[-1]}") if have else spark.createDataFrame([], "path string, changed long, size long, hash string")
    seen = listing(spark, folder).where(~rules.is_noise_path(F.col("path")) & ~rules.is_sensitive(F.col("path")))
    if quiet and (latest := seen.agg(F.max("changed")).first()[0]) and now() - latest / 1e6 < quiet:
        return Refreshed(waiting=True)
    j = seen.join(known.select("path", F.col("changed").alias("was"), F.col("size").alias("was_size"), F.col("hash").alias("was_hash")), "path", "full")
    touched = [r["path"] for r in j.where("changed IS NOT NULL AND (was IS NULL OR changed <> was OR size <> was_size)").select("path").collect()]
    deleted = [r["path"] for r in j.where("changed IS NULL").select("path").collect()]
    queued = drain(spark, tables)
    again = [p for p in dict.fromkeys(queued) if p not in set(touched) | set(deleted)]
    if not touched and not deleted and not again:
        return Refreshed()
    texts = spark.createDataFrame([], "path string, text string")
    if touched or again:
        raw = spark.read.format("binaryFile").load([*touched, *again])
        texts = raw.select("path", F.decode("content", "UTF-8").alias("text"))
    hashed = texts.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    fresh = hashed.join(known.select("path", F.col("hash").alias("old")), "path", "left").where("old IS NULL OR old <> hash").select("path")
    changed = [r["path"] for r in fresh.collect()] + again
    code, other = route(texts.join(spark.createDataFrame([(p,) for p in changed], "path string"), "path", "left_semi"))
    out = Refreshed(None, sorted(set(changed)), sorted(deleted), sorted(r["path"] for r in other.select("path").collect()))
    if changed or deleted:
        nodes, edges, _ = fragments(extract(code))
        out.version = update(spark, tables, nodes, edges, spark.createDataFrame([(p,) for p in deleted], "source_file string"))
    kept = j.where("changed IS NOT NULL").join(hashed, "path", "left").select("path", "changed", "size", F.coalesce("hash", "was_hash").alias("hash"))
    publish(spark, tables, lambda path: kept.write.parquet(path), "m")
    return out


def start(spark: SparkSession, folder: str, tables: str, checkpoint: str, trigger: str = "3 seconds", quiet: float = 3.0) -> StreamingQuery:
    """Keeps ``tables`` up to date with a folder: a look at every tick. What was seen is kept beside the tables, so a new checkpoint loses nothing."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def look(batch: DataFrame, number: int) -> None:
        refresh(batch.sparkSession, folder, tables, quiet)

    return ticks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def queue(spark: SparkSession, tables: str, paths: list[str]) -> None:
    """Paths to be rebuilt by whoever looks next, as a file of its own: writers never wait for each other."""
    if paths:
        spark.createDataFrame([(time.time_ns(), i, p) for i, p in enumerate(paths)], "at long, place int, path string").coalesce(1).write.json(f"{tables}/pending/{time.time_ns()}-{uuid.uuid4().hex}")


def drain(spark: SparkSession, tables: str) -> list[str]:
    """All queued paths, each once, in the order they were queued. What is queued meanwhile stays for the next one."""
    fs, p = _fs(spark, f"{tables}/pending/*/_SUCCESS")
    done = [s.getPath().getParent() for s in fs.globStatus(p) or []]
    if not done:
        return []
    rows = spark.read.schema("at long, place int, path string").json([d.toString() for d in done]).orderBy("at", "place").collect()
    for d in done:
        fs.delete(d, True)
    return list(dict.fromkeys(r["path"] for r in rows))


class Latest:
    """A graph for readers: loaded again when a newer version is there, else as it was."""

    def __init__(self, spark: SparkSession, tables: str):
        self.spark, self.tables, self.version, self.held = spark, tables, None, None

    def __call__(self) -> tuple[DataFrame, DataFrame]:
        have = versions(self.spark, self.tables)
        if not have:
            raise FileNotFoundError(f"no graph in {self.tables}")
        if have[-1] != self.version:
            self.version, self.held = have[-1], tables_of(self.spark, self.tables)
        return self.held


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """``(start, event_type, n, total)``: tumbling windows with a bound on lateness."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``(user_id, start, n)``: a user's events without a longer pause."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, within the bound on lateness."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def streaming_scores(signals: DataFrame, now: str) -> DataFrame:
    """Decayed scores of cited nodes over a stream ``(node, outcome, date)``, updated as signals come."""
    weight = feedback.sign(F.col("outcome")) * feedback.decay(F.col("date"), F.to_timestamp(F.lit(now)))
    return signals.groupBy("node").agg(F.sum(weight).alias("score"), F.count("*").alias("n"))
