"""Approximate nearest neighbours: inverted lists of coarse centroids with product-quantised residuals.

Fitting (k-means for the coarse centroids, then for each part of the residuals) takes at most ``FIT_ROWS`` vectors, those of smallest
hashed id. Every usable row is indexed: the number of its nearest centroid, and a code of one byte a part. A query looks into
its nearest lists, as many as the fit found to hold ``COVERED`` of the neighbours in its sample (clustered vectors need few, scattered
ones many), and into more while these hold too few rows; candidates are ranked by asymmetric distance (a table
for each query and list: exact query residual against coded parts); the best ``RERANK`` of a query are joined to their original vectors and measured
again in double precision. Only codes cross the search's shuffle.

Lists are dealt in bundles, and large ones in blocks, of about ``BLOCK_ROWS`` rows; queries on a bundle in turns of ``BLOCK_QUERIES``: a hot list
becomes many small tasks, each of which keeps its own best, so nothing is left out by splitting. Copies of a vector share a code; ties
go to the smaller id at every step, so the smallest ids among copies stay.

Defined cases: vectors that are null, zero, of another length than the first usable one, or hold null or non-finite parts take no
part, nor do rows with a null id. With fewer candidates than asked for, all are returned. Repeated ids are rows of their own (a query id given twice
answers for each of its vectors together); rows with the query's id are left out of its answer. An empty table gives no rows. Only id and vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.storage import materialize

FIT_ROWS = 65_536
#: Sampled vectors a list, up to ``FIT_ROWS``; the sample is no smaller than ``LEAST_SAMPLE``.
SAMPLE_A_LIST, LEAST_SAMPLE = 64, 20_000
#: Lists: the square root of the rows, up to this, so that the sample holds 8 vectors a list at least; beyond, lists grow and are dealt in more blocks.
MOST_LISTS = 8192
#: The fit finds how many lists must be probed so that this share of a sample's true neighbours lies in them.
COVERED, SAMPLE_QUERIES = 0.97, 256
PARTS, CODES = 16, 256
RERANK = 300
BLOCK_ROWS, BLOCK_QUERIES = 50_000, 128


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (half - x[at : at + 4096] @ centres.T).argmin(1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm; empty centres take random points."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)].astype(float)
    for _ in range(rounds):
        own = _nearest(x, centres)
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


@dataclass
class Index:
    centres: np.ndarray
    edges: list[tuple[int, int]]
    books: list[np.ndarray]
    probes: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row and its codes."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        return own, np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.edges, self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Squared distances of each query's residual parts to every code: (query, part, code)."""
        rest = queries - self.centres[lists]
        out = np.full((len(queries), len(self.books), CODES), np.inf)
        for p, ((a, b), book) in enumerate(zip(self.edges, self.books, strict=True)):
            out[:, p, : len(book)] = ((rest[:, None, a:b] - book[None]) ** 2).sum(2)
        return out


def fit(vectors: DataFrame, n: int) -> Index | None:
    """``vectors (id, v)``, all usable, ``n`` of them."""
    lists = max(1, min(MOST_LISTS, math.isqrt(n)))
    few = vectors.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(min(FIT_ROWS, max(LEAST_SAMPLE, SAMPLE_A_LIST * lists))).toPandas()
    if few.empty:
        return None
    x = np.array(few["v"].tolist(), float)
    centres = kmeans(x, min(lists, len(x)))
    rest = x - centres[_nearest(x, centres)]
    parts = min(PARTS, x.shape[1])
    edges = [(x.shape[1] * p // parts, x.shape[1] * (p + 1) // parts) for p in range(parts)]
    return Index(centres, edges, [kmeans(rest[:, a:b], CODES, seed=p) for p, (a, b) in enumerate(edges)], _needed(x, centres))


def _needed(x: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
    """Lists to probe for ``COVERED`` of the k nearest in the sample."""
    own, ranks = _nearest(x, centres), [0]
    for i in range(min(SAMPLE_QUERIES, len(x))):
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        near = np.argpartition(far, min(k, len(x) - 1))[: min(k, len(x) - 1)]
        place = np.empty(len(centres), int)
        place[((centres - x[i]) ** 2).sum(1).argsort(kind="stable")] = np.arange(len(centres))
        ranks += place[own[near]].tolist()
    return 1 + int(np.quantile(ranks, COVERED, method="higher"))


def build(vectors: DataFrame, index: Index) -> DataFrame:
    """``(id, v, list, codes)`` of every row."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own, codes = shared.value.encode(np.array(part["v"].tolist(), float)) if len(part) else (np.zeros(0, int), np.zeros((0, 1), np.uint8))
            yield part.assign(list=own, codes=[c.tobytes() for c in codes])

    return vectors.mapInPandas(run, "id long, v array<double>, list long, codes binary")


def _bundles(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list its bundle, and for each bundle its blocks: neighbouring small lists share a bundle, a list of over ``BLOCK_ROWS`` rows has its own and several blocks."""
    bundle, blocks, held = np.zeros(len(sizes), np.int64), [1], 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK_ROWS:
            blocks.append(1)
            held = 0
        bundle[i], held = len(blocks) - 1, held + n
        blocks[-1] = max(1, -(-held // BLOCK_ROWS))
    return bundle, np.array(blocks, np.int64)


def _probes(queries: DataFrame, index: Index, sizes: np.ndarray, bundle: np.ndarray, probes: int, k: int) -> DataFrame:
    """``(query_id, q, bundle, lists)``: a query's nearest lists by bundle, at least ``probes`` of those in use and until they hold k + 1 rows or more."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, sizes, bundle))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, size, of = shared.value
        used = np.nonzero(size)[0]
        for part in parts:
            rows = []
            for query_id, q in zip(part["query_id"], part["q"], strict=True):
                order = used[((centres[used] - np.asarray(q, float)) ** 2).sum(1).argsort(kind="stable")]
                enough = int(np.searchsorted(np.cumsum(size[order]), k + 1)) + 1
                wanted = order[: max(probes, enough)]
                rows += [(query_id, q, int(b), wanted[of[wanted] == b].tolist()) for b in np.unique(of[wanted])]
            yield pd.DataFrame(rows, columns=["query_id", "q", "bundle", "lists"])

    return queries.mapInPandas(run, "query_id long, q array<double>, bundle long, lists array<long>")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query row's k nearest rows found, by Euclidean distance, ties to the smaller id."""

    def clean(df: DataFrame, a: str, b: str) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(a), v.alias(b)).where(usable(F.col(b)))

    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows, asked = clean(vectors, "id", "v"), clean(queries, "query_id", "q")
    shape = rows.select(F.size("v").alias("d"), "id").agg(F.min_by("d", "id").alias("d")).first()["d"]
    if shape is None:
        return spark.createDataFrame([], out)
    rows, asked = rows.where(F.size("v") == shape), asked.where(F.size("q") == shape)
    index = fit(rows, rows.count())
    table, _ = materialize(build(rows, index), "ann-index")
    held = table.groupBy("list").agg(F.count("*").alias("n")).toPandas()  # at most MOST_LISTS rows
    sizes = np.zeros(len(index.centres), np.int64)
    sizes[held["list"].to_numpy(int)] = held["n"].to_numpy(int)
    bundle, blocks = _bundles(sizes)
    probed, _ = materialize(_probes(asked, index, sizes, bundle, probes or index.probes, k), "ann-probes")
    wanted = probed.groupBy("bundle").agg(F.count("*").alias("n")).toPandas()  # no more rows than lists
    turns = np.ones(len(blocks), np.int64)
    turns[wanted["bundle"].to_numpy(int)] = np.maximum(1, -(-wanted["n"].to_numpy(int) // BLOCK_QUERIES))
    plan = F.broadcast(spark.createDataFrame(pd.DataFrame({"list": np.arange(len(sizes)), "bundle": bundle, "blocks": blocks[bundle], "turns": turns[bundle]})))
    each = F.broadcast(spark.createDataFrame(pd.DataFrame({"bundle": np.arange(len(blocks)), "blocks": blocks, "turns": turns})))
    # A row's codes go to one block and to every turn; a query to one turn and to every block. Vectors stay where they are.
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    turn = F.pmod(F.xxhash64("query_id"), F.col("turns"))
    left = table.join(plan, "list").select("bundle", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "list", "id", "codes")
    right = probed.join(each, "bundle").select("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), turn.alias("turn"), "query_id", "q", "lists")
    shared, most = spark.sparkContext.broadcast(index), max(rerank, k)

    def best(key: tuple, held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asking):
            held = held.sort_values(["list", "id"], kind="stable")
            ids, codes, own = held["id"].to_numpy(), np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(held), -1), held["list"].to_numpy()
            parts = np.arange(codes.shape[1])
            for query_id, q, lists in zip(asking["query_id"], asking["q"], asking["lists"], strict=True):
                lists = np.sort(np.asarray(lists))
                begin, end = np.searchsorted(own, lists), np.searchsorted(own, lists, "right")
                tables = shared.value.tables(np.repeat(np.asarray(q, float)[None], len(lists), 0), lists)
                far = np.concatenate([t[parts, codes[a:b]].sum(1) for t, a, b in zip(tables, begin, end, strict=True)])
                near = np.concatenate([ids[a:b] for a, b in zip(begin, end, strict=True)])
                far = np.where(near == query_id, np.inf, far)
                first = np.lexsort((near, far)) if len(far) <= most else (lambda x: x[np.lexsort((near[x], far[x]))])(np.nonzero(far <= np.partition(far, most - 1)[most - 1])[0])
                first = first[far[first] < np.inf][:most]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": near[first], "far": far[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "far": []})

    by = ["bundle", "block", "turn"]
    near = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, "query_id long, vec_id long, far double")
    order = Window.partitionBy("query_id").orderBy("far", "vec_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    # The survivors, a fixed number a query, meet their vectors for the exact distance. A repeated id brings each of its vectors once.
    pairs = near.select("query_id", "vec_id").distinct().join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(asked.distinct(), "query_id")

    @F.pandas_udf("double")
    def exact(v: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt(((np.array(v.tolist(), float).reshape(len(v), -1) - np.array(q.tolist(), float).reshape(len(q), -1)) ** 2).sum(1)))

    found = pairs.select("query_id", "vec_id", exact("v", "q").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
