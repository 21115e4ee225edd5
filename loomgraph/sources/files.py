"""Files of a corpus: scan, ignore rules, content hashes, manifests, slices and chunks for a model."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import rules, text

# Sizes of a corpus that call for a graph, or for a warning.
WARN_WORDS, UPPER_WORDS, UPPER_FILES = 50_000, 500_000, 500


def scan(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, rel, size, modified, content, kind)`` of readable, unprotected files outside of noise folders. Content is read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rel = F.regexp_replace(F.substring_index("path", root.rstrip("/").removeprefix("file://"), -1), "^/+", "")
    out = files.select("path", rel.alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return out.where(~rules.is_noise_path(F.col("rel")) & ~rules.is_sensitive(F.col("rel"))).withColumn("kind", rules.doc_type(F.col("rel"))).where("kind IS NOT NULL")


def corpus_summary(files: DataFrame) -> DataFrame:
    """``(kind, files, words)`` of ``(kind, text)``."""
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.sum(text.word_count(F.col("text"))).alias("words"))


def _pattern(rule: str) -> re.Pattern:
    """A gitignore rule as an expression over a relative path."""
    rooted, folder, body = rule.startswith("/") or "/" in rule.rstrip("/"), rule.endswith("/"), rule.strip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return re.compile(("" if rooted else "(?:.*/)?") + out + ("/.*" if folder else "(?:/.*)?"))


def ignored(path: Column, rules_: list[str]) -> Column:
    """Whether the last rule that matches a path, or a folder above it, ignores it; ``!`` takes a path back unless its folder is ignored."""
    parsed = [(r.startswith("!"), _pattern(r.removeprefix("!"))) for r in (x.strip() for x in rules_) if r and not r.startswith("#")]

    def one(p: str) -> bool:
        parts = p.split("/")
        for depth in range(1, len(parts) + 1):
            own, state = "/".join(parts[:depth]) + ("/" if depth < len(parts) else ""), False
            for negated, pattern in parsed:
                if pattern.fullmatch(own) or pattern.fullmatch(own.rstrip("/")):
                    state = not negated
            if state:
                return True
        return False

    return F.pandas_udf(lambda s: s.map(one).astype(bool), T.BooleanType())(path)


def content_hash(body: Column, rel: Column) -> Column:
    """Digest of a file's text without front matter, and of its path."""
    return F.sha2(F.concat(F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n", ""), F.lit("\0"), F.lower(rel)), 256)


def split_cache(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files ``(.., hash)`` whose hash the cache has, and the others."""
    return files.join(cache.select("hash"), "hash", "left_semi"), files.join(cache.select("hash"), "hash", "left_anti")


def slices(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """``(path, start, end, index)`` of ``(path, text)``: pieces of at most ``most`` characters, cut before a heading, after a blank line or a line where one is near."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, body in zip(part["path"], part["text"].fillna(""), strict=True):
                at = index = 0
                while at < len(body) or not index:
                    end = min(len(body), at + most)
                    if end < len(body):
                        window = body[at + most // 2 : end]
                        for mark, extra in (("\n#", 1), ("\n\n", 2), ("\n", 1)):
                            if (k := window.rfind(mark)) >= 0:
                                end = at + most // 2 + k + extra
                                break
                    rows.append((path, at, end, index))
                    at, index = end, index + 1
            yield pd.DataFrame(rows, columns=["path", "start", "end", "index"])

    return docs.select("path", "text").mapInPandas(run, "path string, start long, end long, index long")


def pack_chunks(units: DataFrame, budget: int = 60_000) -> DataFrame:
    """``(folder, path, chunk)`` of ``(folder, path, tokens)``: in the order of paths a chunk is closed when the next unit would exceed the budget. A task a folder."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, used, chunk, out = rows.sort_values("path"), 0, 0, []
        for tokens in rows["tokens"]:
            if used and used + tokens > budget:
                used, chunk = 0, chunk + 1
            used += tokens
            out.append(chunk)
        return rows.assign(chunk=out)[["folder", "path", "chunk"]]

    return units.groupBy("folder").applyInPandas(run, "folder string, path string, chunk long")


def parse_memories(raw: DataFrame) -> DataFrame:
    """``(question, outcome, date, correction, source_nodes)`` of Markdown records ``(value)`` with front matter; others are skipped."""
    raw = raw.where(F.col("value").rlike(r"\A---\n"))
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1)
    get = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(front, rf"(?m)^{k}:[ \t]*(.*)$", 1), r'^"|"$', "")), F.lit(""))
    listed = F.regexp_extract(front, r"(?m)^source_nodes:[ \t]*\[(.*)\]", 1)
    nodes = F.filter(F.transform(F.split(listed, ","), lambda n: F.regexp_replace(F.trim(n), r'^"|"$', "")), lambda n: n != "")
    return raw.select(get("question").alias("question"), get("outcome").alias("outcome"), F.try_to_timestamp(get("date")).alias("date"), get("correction").alias("correction"), nodes.alias("source_nodes"))


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    """The records below a folder, a file each."""
    return parse_memories(spark.read.text(path, wholetext=True))


def memory_text() -> Column:
    """A record's Markdown, from the columns ``question, outcome, date, correction, source_nodes, answer``."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.regexp_replace(c, r"[\r\n]+", " "), F.lit('"'), F.lit("'")), F.lit('"'))
    listed = F.concat(F.lit("["), F.array_join(F.transform("source_nodes", quoted), ", "), F.lit("]"))
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v))
    front = F.concat_ws("\n", line("type", F.lit("query")), line("date", quoted(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))), line("question", quoted(F.col("question"))), line("outcome", quoted(F.col("outcome"))), line("correction", quoted(F.col("correction"))), line("source_nodes", listed))
    return F.concat(F.lit("---\n"), front, F.lit("\n---\n\n# Q: "), "question", F.lit("\n\n"), F.coalesce("answer", F.lit("")), F.lit("\n"))


def save_memory(spark: SparkSession, path: str, question: str, answer: str, source_nodes: list[str], outcome: str | None = None, correction: str | None = None) -> None:
    """Adds one record below a folder."""
    row = spark.createDataFrame([(question, outcome, correction, source_nodes, answer)], "question string, outcome string, correction string, source_nodes array<string>, answer string").withColumn("date", F.current_timestamp())
    row.select(memory_text().alias("value")).coalesce(1).write.mode("append").text(path)


def log_query(spark: SparkSession, path: str, kind: str, question: str, nodes_returned: int, duration_ms: float) -> None:
    """Appends one record to the query log."""
    row = spark.range(1).select(F.current_timestamp().alias("ts"), F.lit(kind).alias("kind"), F.lit(question).alias("question"), F.lit(nodes_returned).alias("nodes_returned"), F.lit(duration_ms).alias("duration_ms"))
    row.coalesce(1).write.mode("append").json(path)


def first_object(value: Column) -> Column:
    """``parse_model_json`` of a column."""
    return F.pandas_udf(lambda s: s.fillna("").map(parse_model_json), T.StringType())(value)


def parse_model_json(value: str) -> str | None:
    """The first balanced object of a model's answer, without code fences; null if there is none that parses."""
    import json

    at = value.find("{")
    while at >= 0:
        try:
            return json.dumps(json.JSONDecoder().raw_decode(value[at:])[0], sort_keys=True)
        except ValueError:
            at = value.find("{", at + 1)
    return None
