"""Document quality by a generalised additive model with pairwise interactions.

Features of a text are cut into at most ``BINS`` bins by quantiles of the training sample. Boosting goes round the features
in turn, each round adding a shallow tree over one feature's bins to that feature's lookup table; then the pairs that
explain most of what is left get tables of their own over a coarser grid, boosted in turn too. A text is scored by adding up its bins'
entries, vectorised, and a logistic function.

The fit takes at most ``FIT_ROWS`` labelled rows, those of smallest hashed id; features and scores cover all rows and
whole texts.

Defined cases: null text counts as empty; an empty text has features zero and still gets a score. Rows with a null id or label
train nothing; with one class only, every score is the share of label 1 (0.5 with no labels at all). Repeated
rows each get a row. Columns other than id, text and label are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded

FIT_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS = 300, 100
PAIRS = 10
RATE = 0.1
#: Cuts a tree makes at most, and the least second derivatives (about rows / 4) in a leaf.
CUTS, LEAF = 3, 2.0
THRESHOLD = 0.5
NAMES = (
    "words", "chars_a_word", "upper_share", "digit_share", "mark_share", "odd_share", "bar_words", "shout_words", "marked_words",
    "line_words", "lines_repeated", "words_distinct", "common_share", "top_word_share", "sentence_words", "long_words", "bigrams_distinct", "ends_closed",
)
_UPPER, _LOWER, _SENTENCE = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[a-zß-öø-ÿ]"), re.compile(r"[.!?]+(?:\s|$)")
_DROP = {c: None for c in range(128) if not (chr(c).isalnum() or chr(c).isspace())}
_MARKS = ".,;:!?'\"()-"


def features_of(text: str | None) -> list[float]:
    """One whole text's features, in the order of ``NAMES``."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    plain = text.translate(_DROP)
    marks = chars - len(plain)
    common = sum(text.count(m) for m in _MARKS)
    low = plain.lower()
    upper = sum(a != b for a, b in zip(plain, low, strict=True)) if len(low) == len(plain) else len(_UPPER.findall(plain))
    bare = low.split()
    counts = Counter(bare)
    lines = [x for x in text.split("\n") if x.strip()]
    last = [w[-1] for w in words]
    ends = Counter(last)
    shouted = sum(1 for w in words if len(w) > 2 and w.isupper())
    solid = sum(map(len, words))
    m = max(1, len(bare))
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    return [
        np.log1p(n), solid / n, upper / chars, sum(map(text.count, "0123456789")) / chars, common / chars, (marks - common) / chars,
        text.count("|") / n, shouted / n, sum(c for e, c in ends.items() if not e.isalnum()) / n,
        n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / m, short / m, max(counts.values(), default=0) / m,
        n / (1 + len(_SENTENCE.findall(text))), sum(c for w, c in counts.items() if len(w) > 12) / m,
        len(set(zip(bare, bare[1:], strict=False))) / max(1, len(bare) - 1), float(text.rstrip()[-1:] in ".!?"),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], float).reshape(len(texts), len(NAMES))


def _steps(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A shallow regression tree over ordered bins: the Newton step of each bin's leaf."""
    edges = [0, len(gradient)]
    g, w = np.concatenate([[0.0], np.cumsum(gradient)]), np.concatenate([[0.0], np.cumsum(weight)])

    def gain(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + 1, b)
        left, right = w[k] - w[a], w[b] - w[k]
        ok = (left >= LEAF) & (right >= LEAF)
        if not ok.any():
            return 0.0, a
        value = np.where(ok, (g[k] - g[a]) ** 2 / (left + 1) + (g[b] - g[k]) ** 2 / (right + 1) - (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1), 0)
        return float(value.max()), int(k[value.argmax()])

    for _ in range(CUTS):
        best, at = max(gain(a, b) for a, b in zip(edges, edges[1:], strict=False))
        if best <= 1e-9:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(gradient))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


@dataclass
class Additive:
    """Lookup tables by feature and by pair of features; ``cuts[j]`` are the edges of feature j's bins."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def _bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.tables:
            for table, b in zip(self.tables, self._bins(x, self.cuts), strict=True):
                total += table[b]
            coarse = self._bins(x, self.coarse)
            for i, j, table in self.pairs:
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total.clip(-500, 500)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Main tables first, then those of the pairs with the largest gain on what they leave."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Additive([], [], float(np.log((share + 1e-6) / (1 - share + 1e-6))), [], [])
    model = Additive([_cuts(c, BINS) for c in x.T], [_cuts(c, PAIR_BINS) for c in x.T], float(np.log(y.mean() / (1 - y.mean()))), [np.zeros(BINS) for _ in NAMES], [])
    bins = model._bins(x, model.cuts)
    raw = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-raw))
            step = RATE * _steps(np.bincount(bins[j], y - p, BINS), np.bincount(bins[j], p * (1 - p), BINS))
            table += step
            raw += step[bins[j]]
    coarse, p = model._bins(x, model.coarse), 1 / (1 + np.exp(-raw))
    cells = {(i, j): coarse[i] * PAIR_BINS + coarse[j] for i in range(len(NAMES)) for j in range(i)}
    size = PAIR_BINS * PAIR_BINS

    def gain(cell: np.ndarray) -> float:
        return float((np.bincount(cell, y - p, size) ** 2 / (np.bincount(cell, p * (1 - p), size) + 1)).sum())

    chosen = sorted(cells, key=lambda ij: (-gain(cells[ij]), ij))[:PAIRS]
    flat = {ij: np.zeros(size) for ij in chosen}
    for _ in range(PAIR_ROUNDS):
        for ij in chosen:
            p = 1 / (1 + np.exp(-raw))
            g, w = np.bincount(cells[ij], y - p, size).reshape(PAIR_BINS, PAIR_BINS), np.bincount(cells[ij], p * (1 - p), size).reshape(PAIR_BINS, PAIR_BINS)
            # A tree of depth two: one cut of either feature at a time, rows then columns within the halves.
            cut = 1 + max(range(PAIR_BINS - 1), key=lambda k: (g[: k + 1].sum() ** 2 / (w[: k + 1].sum() + 1) + g[k + 1 :].sum() ** 2 / (w[k + 1 :].sum() + 1)))
            step = np.vstack([np.tile(_steps(g[a:b].sum(0), w[a:b].sum(0)), (b - a, 1)) for a, b in ((0, cut), (cut, PAIR_BINS))]).ravel() * RATE
            flat[ij] += step
            raw += step[cells[ij]]
    model.pairs = [(i, j, t.reshape(PAIR_BINS, PAIR_BINS)) for (i, j), t in flat.items()]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Additive:
    """``docs (doc_id, text)`` and ``labels (doc_id, label)``: all rows given are training rows, ``FIT_ROWS`` of them used."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    few = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(FIT_ROWS)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([features_of(t) for t in texts])

    rows = bounded(docs).join(F.broadcast(few), "doc_id").select("y", measured("text").alias("x")).toPandas()
    return fit(np.array(rows["x"].tolist(), float).reshape(len(rows), len(NAMES)), rows["y"].to_numpy(float))


def with_score(docs: DataFrame, model: Additive, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the score of each whole text. A map without a shuffle."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.score(matrix(texts.tolist())))

    return bounded(docs).withColumn(name, score(F.col(text_col)))


def keep(docs: DataFrame, model: Additive, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows judged of good quality, with the columns they came with."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, model, text_col, name).where(F.col(name) >= threshold).drop(name)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> Additive:
    """Trained on the rows outside the held-out fold."""
    return train(docs.select("doc_id", "text"), labels.where(~held_out()))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return with_score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
