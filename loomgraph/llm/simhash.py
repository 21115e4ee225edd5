"""SimHash near-duplicates: pivot distance tables discard pairs, survivors are verified.

Fingerprints of all texts are reduced to distinct values. Two values that differ in at most ``radius`` bits agree on
at least two of ``radius + 2`` blocks of bits, so they meet under one of the block pairs' keys; that only says which pairs
are looked at. Under a key, rows are ordered by their Hamming distance to the first of many fixed pivots. By the
triangle inequality a pair can link only if every pivot distance differs by ``radius`` at most: the first coordinate
bounds the window, the maximum difference over the other coordinates discards, an exclusive-or verifies. Each task
reports a spanning forest, not all pairs of a group; components over the forests are those over all links.

A key with more than ``CHUNK`` values is dealt out as pairs of chunks, so no task holds a whole hot key. No pair is lost.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other. Repeated
rows each get a row. A null id takes part, but a component is named by its smallest id that is not null (null if there is
none). An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded
from loomgraph.operators.components import connected_components
from loomgraph.plans.storage import materialize

CHUNK = 4096
SEED = 42
PIVOTS = np.random.default_rng(64).integers(0, 2**64, size=16, dtype=np.uint64)
#: Rows that a task looks at together at least; whole keys are added until it is reached.
BLOCK = 1 << 17
#: Hot keys up to this many are broadcast (three numbers each); more are joined by a shuffle.
BROADCAST_KEYS = 50_000


def simhash(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one whole text, unsigned."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash(t, words) for t in texts), np.uint64, len(texts)).view(np.int64))

    return of(text)


def _masks(radius: int) -> list[int]:
    """A mask for each pair of the radius + 2 blocks, as signed 64-bit numbers."""
    n = radius + 2
    cut = [64 * i // n for i in range(n + 1)]
    block = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(n)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(block, 2))]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the classes of a[i] and b[i] in place; a label is the smallest row of its class."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _forest(group: np.ndarray, side: np.ndarray, cross: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """The smallest row of each row's class, among links within a group; rows of a cross group link only to the other side."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :])
    order = np.lexsort((table[:, 0], group))
    g, d, f, s, c = group[order], table[order], fp[order], side[order], cross[order]
    label = np.arange(len(fp))
    first = d[:, 0].astype(np.int16)
    i, k = np.arange(len(fp) - 1), 1
    while len(i):
        j = i + k
        near = (g[i] == g[j]) & (first[j] - first[i] <= radius)
        i, j = i[near], j[near]
        ok = ~c[i] | (s[i] != s[j])
        a, b = i[ok], j[ok]
        for p in range(1, d.shape[1]):
            keep = np.abs(d[a, p].astype(np.int16) - d[b, p]) <= radius
            a, b = a[keep], b[keep]
        exact = np.bitwise_count(f[a] ^ f[b]) <= radius
        _join(label, order[a[exact]], order[b[exact]])
        k += 1
        i = i[i + k < len(fp)]
    return label


def _forests(radius: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        t, key, lo, hi, own, fp = (rows[c].to_numpy() for c in ("t", "key", "lo", "hi", "own", "fp"))
        new = np.ones(len(fp), bool)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.cumsum(new)
        shared = np.bincount(group)[group] > 1
        group, own, cross, fp = group[shared], own[shared], (lo != hi)[shared], fp[shared]
        label = _forest(group, own, cross, fp.view(np.uint64), radius) if len(fp) else np.zeros(0, int)
        moved = label != np.arange(len(label))
        return pa.record_batch([pa.array(fp[moved]), pa.array(fp[label[moved]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BLOCK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            last = [rows[c][-1].as_py() for c in ("t", "key", "lo", "hi")]
            same = np.logical_and.reduce([rows[c].to_numpy() == v for c, v in zip(("t", "key", "lo", "hi"), last, strict=True)])
            cut = len(same) - int(same.sum())
            if cut:
                yield solve(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def links(values: DataFrame, radius: int = 3, chunk: int | None = None) -> DataFrame:
    """``(src, dst)``: a forest over the distinct fingerprints in column ``fp`` whose components are those of all links."""
    chunk = chunk or CHUNK
    keyed = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(radius)])).alias("t", "key"))
    hot = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("t", "key", F.ceil(F.col("n") / chunk).cast("int").alias("g"))
    hot, _ = materialize(hot, "hot-keys")
    few = hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    own = F.pmod(F.xxhash64("fp"), F.coalesce("g", F.lit(1))).cast("int")
    dealt = keyed.join(F.broadcast(hot) if few else hot, ["t", "key"], "left").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1))
    dealt = dealt.select("t", "key", "own", "fp", other.alias("other")).select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "fp")
    by = ("t", "key", "lo", "hi")
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_forests(radius), "src long, dst long")


def classes(values: DataFrame, radius: int = 3, chunk: int | None = None) -> DataFrame:
    """``(fp, root)`` for every fingerprint that links to another one."""
    return connected_components(links(values, radius, chunk)).select(F.col("id").alias("fp"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, chunk: int | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``; the component is its smallest reachable id."""
    docs = bounded(docs).select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp"))
    docs, _ = materialize(docs, "simhash")
    first = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = classes(first.select("fp"), radius, chunk).join(first, "fp")
    linked, _ = materialize(linked, "simhash-linked")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    by_fp = first.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, chunk: int | None = None) -> DataFrame:
    """One row of each component with all its columns: that of the smallest id (null ids last), then of the smallest text hash.

    Of rows with the kept row's id and text, the one with the smallest hash of all columns stays.
    """
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = bounded(docs).select(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"), tie.alias("tie")).alias("row"), fingerprint(F.col(text_col), words).alias("fp"))
    rows, _ = materialize(rows, "simhash-rows")
    first, _ = materialize(rows.groupBy("fp").agg(F.min("row").alias("row")), "simhash-first")
    linked, _ = materialize(classes(first.select("fp"), radius, chunk), "simhash-classes")
    root = F.coalesce("root", "fp")
    kept = first.join(linked, "fp", "left").groupBy(root.alias("root")).agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("kept_id"), F.col("row.tie").alias("kept_tie"))
    kept, _ = materialize(kept, "simhash-kept")
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("all"), F.col(id_col).alias("own_id"), tie.alias("own_tie"))
    held = held.join(kept, held["own_id"].eqNullSafe(kept["kept_id"]) & (held["own_tie"] == kept["kept_tie"]), "left_semi")
    order = Window.partitionBy("own_id", "own_tie").orderBy(F.xxhash64("all"))
    return held.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("all.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
