"""Merging of entities that are one: same name, or names alike. ``nodes (id, label, file_type, source_file, seq)``.

Candidates come from min-hash bands, never from all pairs; similarity, vetoes and components follow.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text
from loomgraph.operators.components import connected_components
from loomgraph.operators.graph import first_by, rewire

# Bits of entropy, permutations, bands and rows (for a Jaccard index of 0.7), scores, length of a long label.
ENTROPY, PERMUTATIONS, BANDS, ROWS = 2.5, 128, 14, 9
ACCEPT, BONUS, LONG = 92.0, 5.0, 12
_PRIME, _MASK = np.uint64((1 << 61) - 1), np.uint64(0xFFFFFFFF)
_VARIANT = re.compile(r"(.*[a-z])(\d+[a-z]*|[a-z]{2,})")


def norm_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", " "))


def exact_merges(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: nodes that aren't code with one normalised label in one file, each with the smallest id."""
    named = nodes.where("file_type <> 'code' AND coalesce(source_file, '') <> ''").select("id", "source_file", norm_label(F.col("label")).alias("name")).where("name <> ''")
    least = named.groupBy("name", "source_file").agg(F.min("id").alias("b"))
    return named.join(least, ["name", "source_file"]).where("id <> b").select(F.col("id").alias("a"), "b")


def candidates(nodes: DataFrame) -> DataFrame:
    """The first node of each normalised label with enough entropy."""
    named = nodes.where("file_type <> 'code'").withColumn("name", norm_label(F.col("label"))).where("name <> ''")
    return first_by(named, ["name"], "seq", "id").where(text.entropy(F.col("name")) >= ENTROPY)


def signatures(names: list[str]) -> np.ndarray:
    """A min-hash signature a row: SHA-1's first four bytes of each run of three characters, under fixed random coefficients modulo 2^61 - 1."""
    rng = np.random.RandomState(1)
    a, b = rng.randint(1, int(_PRIME), PERMUTATIONS, dtype=np.uint64), rng.randint(0, int(_PRIME), PERMUTATIONS, dtype=np.uint64)
    out = np.empty((len(names), PERMUTATIONS), np.uint64)
    with np.errstate(over="ignore"):
        for i, name in enumerate(names):
            bare = name.replace(" ", "")
            grams = sorted({bare[k : k + 3] for k in range(max(1, len(bare) - 2))})
            h = np.array([int.from_bytes(hashlib.sha1(g.encode()).digest()[:4], "little") for g in grams], np.uint64)
            out[i] = (((h[:, None] * a + b) % _PRIME) & _MASK).min(0)
    return out


def _bands(names: pd.Series) -> pd.Series:
    out = []
    for least in signatures(names.tolist()):
        parts = (bytes([i]) + least[i * ROWS : (i + 1) * ROWS].tobytes() for i in range(BANDS))
        out.append([int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) for p in parts])
    return pd.Series(out)


#: Names in a band up to which all its pairs are looked at in one task; larger bands are dealt out as pairs of chunks.
BAND_CHUNK = 2000


def alike_pairs(named: DataFrame, chunk: int | None = None) -> DataFrame:
    """``(a, b)``: candidates that share a band, once. A hot band becomes pairs of chunks, each a join key of its own, so no task has it whole."""
    chunk = chunk or BAND_CHUNK
    bands = F.pandas_udf(_bands, T.ArrayType(T.LongType()))
    keyed = named.select("id", F.explode(bands("name")).alias("band"))
    size = keyed.groupBy("band").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.count("*").alias("n")).where("n > 1").select("band", "chunks")
    own = keyed.join(size, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = own.select("band", "id", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id")
    a, b = dealt.toDF("band", "lo", "hi", "x", "a"), dealt.toDF("band", "lo", "hi", "y", "b")
    return a.join(b, ["band", "lo", "hi"]).where("a < b AND (lo = hi OR x <> y)").select("a", "b").distinct()


def _numbers(name: str) -> list[str]:
    return sorted(t.lstrip("0") or "0" for t in re.findall(r"\d+", name))


def accepted(a: str, b: str, same_file: bool, anchored: bool, same_community: bool = False) -> bool:
    """Whether two different normalised labels name one entity."""
    longest = max(len(a), len(b))
    if a == b:
        return same_file
    if _numbers(a) != _numbers(b) or (anchored and not same_file):
        return False
    score = 100 * (text.jaro_winkler(a, b) if same_file or longest < LONG else text.jaro(a, b))
    if longest < LONG:
        x, y = _VARIANT.fullmatch(a), _VARIANT.fullmatch(b)
        variant = bool(x and y and x[1] == y[1] and x[2] != y[2])
        if variant or score < 97 or len(a) != len(b) or text.damerau(a, b) > 1:
            return False
    elif a.startswith(b) or b.startswith(a):
        return False
    return score + (BONUS if same_community and min(len(a), len(b)) >= LONG else 0) >= ACCEPT


def alike_merges(nodes: DataFrame, community: DataFrame | None = None) -> DataFrame:
    """``(a, b)`` of the candidates that are accepted; of one community ``(id, community)`` a little more readily."""
    named = candidates(nodes)
    pairs = alike_pairs(named)
    own = named.join(community, "id", "left") if community is not None else named.withColumn("community", F.lit(None).cast("long"))
    x, y = (own.select(F.col("id").alias(i), F.col("name").alias(f"name_{i}"), F.col("source_file").alias(f"file_{i}"), F.col("file_type").alias(f"type_{i}"), F.col("community").alias(f"community_{i}")) for i in ("a", "b"))

    @F.pandas_udf(T.BooleanType())
    def ok(p: pd.Series, q: pd.Series, same: pd.Series, anchored: pd.Series, together: pd.Series) -> pd.Series:
        return pd.Series([accepted(*v) for v in zip(p, q, same, anchored, together, strict=True)], dtype=bool)

    same = F.coalesce(F.col("file_a") == F.col("file_b"), F.lit(False))
    anchored = F.col("type_a").isin("rationale", "document") | F.col("type_b").isin("rationale", "document")
    together = F.coalesce(F.col("community_a") == F.col("community_b"), F.lit(False))
    return pairs.join(x, "a").join(y, "b").where(ok("name_a", "name_b", same, anchored, together)).select("a", "b")


def merge_map(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(old, new)``: each component's winner has no chunk suffix, then the shortest id, then comes first."""
    parts = connected_components(links, "a", "b").join(nodes.select("id", "seq"), "id")
    winner = first_by(parts.withColumn("chunk", F.col("id").rlike(r"_c\d+$").cast("int")), ["component"], "chunk", F.length("id"), "seq", "id").select("component", F.col("id").alias("new"))
    return parts.join(winner, "component").where("id <> new").select(F.col("id").alias("old"), "new")


def deduplicate(nodes: DataFrame, edges: DataFrame, community: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges after merging, and the map of merged ids. Nodes of more than one repository are an error: they are merged one by one."""
    if "repo" in nodes.columns and nodes.where("repo IS NOT NULL").select("repo").distinct().limit(2).count() > 1:
        raise ValueError("nodes of several repositories: merge each by itself")
    firsts = first_by(nodes, ["id"], "seq")
    moved = merge_map(firsts, exact_merges(firsts).union(alike_merges(firsts, community)))
    return firsts.join(moved, firsts["id"] == moved["old"], "left_anti"), rewire(edges, moved), moved
