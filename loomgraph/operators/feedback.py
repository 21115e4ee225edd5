"""Lessons from past answers: decayed scores of the nodes they cite. ``docs (question, outcome, date, correction, source_nodes)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import first_by

# Half-life in days, confirmations that make a source preferred, provenance kept.
HALF_LIFE, CORROBORATION, PROVENANCE = 30.0, 2, 5


def decay(date: Column, now: Column, half_life: float = HALF_LIFE) -> Column:
    """A half for every half-life of age; undated and future signals count in full."""
    days = (F.unix_micros(now) - F.unix_micros(date.cast("timestamp"))) / 86_400e6
    return F.when(date.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / half_life))


def sign(outcome: Column) -> Column:
    return F.when(outcome == "useful", 1).when(outcome.isin("dead_end", "corrected"), -1).otherwise(0)


def node_scores(docs: DataFrame, now: Column) -> DataFrame:
    """``(node, score, pos, neg, last)``: each node once a document."""
    signed = docs.withColumns({"sign": sign(F.col("outcome")), "weight": decay(F.col("date"), now)}).where("sign <> 0")
    events = signed.select(F.explode(F.array_distinct("source_nodes")).alias("node"), "sign", "weight", "date")
    return events.groupBy("node").agg(F.sum(F.col("sign") * F.col("weight")).alias("score"), F.count_if(F.col("sign") > 0).alias("pos"), F.count_if(F.col("sign") < 0).alias("neg"), F.max("date").alias("last"))


def verdicts(scores: DataFrame, least: int = CORROBORATION) -> DataFrame:
    """``(node, status, score)``: contested, preferred or tentative; nodes with bad outcomes alone are left to the dead ends."""
    status = F.when((F.col("pos") > 0) & (F.col("neg") > 0), "contested").when(F.col("pos") >= least, "preferred").when(F.col("pos") > 0, "tentative")
    return scores.select("node", status.alias("status"), F.round("score", 9).alias("score"), "pos", "neg").where("status IS NOT NULL")


def latest_questions(docs: DataFrame) -> DataFrame:
    """The most recent record of each question, ties by outcome."""
    return first_by(docs, ["question"], F.desc("date"), "outcome")


def provenance(docs: DataFrame, most: int = PROVENANCE) -> DataFrame:
    """``(node, date, question, outcome)``: the most recent signals of each node."""
    events = docs.where(sign(F.col("outcome")) != 0).select(F.explode(F.array_distinct("source_nodes")).alias("node"), "date", "question", "outcome")
    w = Window.partitionBy("node").orderBy(F.desc("date"), "question", "outcome")
    return events.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def doc_community(docs: DataFrame, community: DataFrame) -> DataFrame:
    """``(doc, community)``: where most of a document's sources lie, ties to the smaller one. ``docs (doc, source_nodes)``."""
    votes = docs.select("doc", F.explode(F.array_distinct("source_nodes")).alias("id")).join(community, "id").groupBy("doc", "community").agg(F.count("*").alias("n"))
    return first_by(votes, ["doc"], F.desc("n"), "community").select("doc", "community")


def overlay(nodes: DataFrame, verdict: DataFrame) -> DataFrame:
    """``(id, status, score)``: verdicts of cited names on nodes: by id, else by a label that only one node has."""
    alone = nodes.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("by_label")).where("n = 1").drop("n")
    j = verdict.join(nodes.select(F.col("id").alias("by_id")), verdict["node"] == F.col("by_id"), "left").join(alone, verdict["node"] == alone["label"], "left")
    return j.select(F.coalesce("by_id", "by_label").alias("id"), "status", "score").where("id IS NOT NULL")
