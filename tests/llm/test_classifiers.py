import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from helpers import ROWS, clashing, docs, table

from loomgraph.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
OPS = {"quality": (quality, quality.op3_quality, 3, 1, 0.5), "toxic": (toxicity, toxicity.op7_toxicity, 4, 2, 0.3)}


def area(y, score):
    a, b = score[y == 1], score[y == 0]
    return float(((a[:, None] > b) + 0.5 * (a[:, None] == b)).mean())


@pytest.mark.parametrize("label", OPS)
def test_held_out(spark, label):
    _, query, mod, rest, threshold = OPS[label]
    got = query(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    fold = np.array([zlib.crc32(str(i).encode()) % mod == rest for i in got["doc_id"]])
    assert (fold == got["held_out"]).all() and (got["predicted"] == (got["score"] >= threshold)).all() and got["score"].between(0, 1).all()
    known = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = known[known["held_out"]]
    assert area(held[label].to_numpy(), held["score"].to_numpy()) > 0.9


@pytest.mark.parametrize("label", OPS)
@pytest.mark.parametrize("labels,share", [([], 0.5), ([(3, 1, 1), (5, 1, 1)], 1.0), ([(None, 1, 1), (3, None, None)], 0.5), ([(9999, 0, 0)], None)])
def test_few_labels(spark, tmp_path, label, labels, share):
    module, query, mod, rest, _ = OPS[label]
    labels = [r for r in labels if r[0] is None or zlib.crc32(str(r[0]).encode()) % mod != rest]
    path = table(spark, tmp_path, documents=clashing(docs(spark)), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = query(spark, path).toPandas()
    assert len(got) == len(ROWS) and got["score"].between(0, 1).all()
    if share is not None and labels:
        assert np.allclose(got["score"], share, atol=1e-5) or share == 1.0


@pytest.mark.parametrize("label", OPS)
def test_empty_table(spark, tmp_path, label):
    path = table(spark, tmp_path, documents=docs(spark, []), labels=spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert OPS[label][1](spark, path).collect() == []


def test_keep_leaves_columns_alone(spark):
    df = clashing(docs(spark))
    x = quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0))
    assert quality.keep(df, x).columns == df.columns and quality.keep(df, x).count() == len(ROWS)
    assert toxicity.keep(df, toxicity.Model(None, None, 0.5)).columns == df.columns


def test_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(quality.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing but an interaction
    m = quality.fit(x, y)
    assert area(y, m.score(x)) > 0.95 and m.pairs
    total = np.full(len(x), m.intercept)
    for i, row in enumerate(x):
        for j, t in enumerate(m.tables):
            total[i] += t[np.searchsorted(m.cuts[j], row[j], "right")]
        for a, b, t in m.pairs:
            total[i] += t[np.searchsorted(m.coarse[a], row[a], "right"), np.searchsorted(m.coarse[b], row[b], "right")]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-total)))


def grams_of(spark, words):
    """Distinct n-grams with their counts by class and half, of rows (y, half, word, n)."""
    cells = pd.DataFrame([(w, *(n if 2 * y + h == i else 0 for i in range(4))) for y, h, w, n in words], columns=["word", "c0", "c1", "c2", "c3"])
    return toxicity.training_grams(spark.createDataFrame(cells.groupby("word", as_index=False).sum()))


def test_joined_counts_give_the_broadcast_scores(spark):
    """Beyond the bound on what is broadcast, n-grams and words meet their counts by joins: the same scores, row by row."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    text = d.select("doc_id", "text").union(docs(spark).select(F.col("doc_id") + 10**6, "text"))
    a, b = (toxicity.train(text, labels.where(~toxicity.held_out()), broadcast_grams=n) for n in (None, 0))
    assert a.tables is None and b.counts is None and np.allclose(a.link.weight, b.link.weight, atol=1e-6)
    df = clashing(text)
    got = [sorted(((r["doc_id"] is None, r["doc_id"], r["text"] or ""), r["own"]) for r in toxicity.with_score(df, m, name="own").collect()) for m in (a, b)]
    assert [k for k, _ in got[0]] == [k for k, _ in got[1]] and np.allclose([v for _, v in got[0]], [v for _, v in got[1]], atol=1e-9)
    assert toxicity.keep(df, b).columns == df.columns


def test_scores_against_a_plain_version(spark):
    """The whole query, recomputed with dictionaries and Newton's method written out."""
    from collections import Counter
    from math import exp, log

    sf = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None and r["doc_id"] in rows and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    half = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i in y], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("h")).collect()}
    n, d = toxicity.ORDER, toxicity.DISCOUNT

    def model(ids):
        levels = [Counter(), Counter()]
        for i in ids:
            for w in toxicity.words_of(rows[i]):
                levels[y[i]].update(toxicity._grams(w, n))
        level = set(levels[0]) | set(levels[1])
        for _ in range(n - 2):
            levels.append(Counter(g[1:] for g in level))
            level = set(levels[-1])
        follow = []
        for c in levels:
            t = {}
            for g, m in c.items():
                a, b = t.get(g[:-1], (0, 0))
                t[g[:-1]] = a + m, b + 1
            follow.append(t)

        def p(i, g, below):
            total, types = follow[i].get(g[:-1], (0, 0))
            return (max(levels[i][g] - d, 0) + d * types * below) / total if total else below

        def shared(g, i=2):
            return max(p(i, g, shared(g[1:], i + 1)), 1e-12) if i < len(levels) else 1 / (1 + len(levels[-1]))

        known = {}

        def word(w):
            if w not in known:
                known[w] = sum(log(max(p(1, g, low), 1e-12) / max(p(0, g, low), 1e-12)) for g in toxicity._grams(w, n) for low in [shared(g[1:])])
            return known[w]

        return word

    def said(word, text):
        v = [word(w) for w in toxicity.words_of(text)] or [0.0]
        k, beyond = min(toxicity.WINDOW, len(v)), sum(max(x - toxicity.MARGIN, 0) for x in v)
        second = sorted(v)[-2] if len(v) > 1 else -toxicity.MARGIN
        windows = [sum(v[i : i + k]) / k for i in range(len(v) - k + 1)]
        return [sum(v) / len(v), log(1 + beyond), log(1 + 100 * beyond / len(v)), min(max(max(v), -5), 15), min(max(second, -5), 15), max(windows), log(1 + len(v))]

    ids = sorted(y)
    of_half = [model([i for i in ids if half[i] == h]) for h in (0, 1)]
    x = np.array([said(of_half[1 - half[i]], rows[i]) for i in ids])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, weight, target = np.c_[np.ones(len(x)), (x - mean) / scale], np.zeros(8), np.array([y[i] for i in ids], float)
    ridge = np.diag([1e-6] + [1.0] * 7)
    for _ in range(50):
        q = 1 / (1 + np.exp(-z @ weight))
        weight -= np.linalg.solve(z.T @ (z * (q * (1 - q))[:, None]) + ridge, z.T @ (q - target) + ridge @ weight)
    every = model(ids)
    want = {i: 1 / (1 + exp(-(weight[0] + (np.array(said(every, t)) - mean) / scale @ weight[1:]))) for i, t in rows.items()}
    got = {r["doc_id"]: r["score"] for r in toxicity.op7_toxicity(spark, sf).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-5


def test_evidence_is_kneser_ney(spark):
    """The hashed, distributed counts give the probabilities of a plain model with dictionaries."""
    from collections import Counter
    from math import log

    words = [(0, 0, "calm", 5), (0, 1, "calmly", 3), (1, 0, "rude", 4), (1, 1, "ruder", 2), (0, 0, "rudder", 1)]
    model = toxicity.fit_counts(grams_of(spark, words))[2]
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    top = [Counter(), Counter()]
    for y, _, w, c in words:
        for g in toxicity._grams(w, n):
            top[y][g] += c
    level, low = set(top[0]) | set(top[1]), []
    for _ in range(n - 2):
        c = Counter(g[1:] for g in level)
        low.append(c)
        level = set(c)

    def p(counts, g, below):
        same = [x for x in counts if x[:-1] == g[:-1]]
        total = sum(counts[x] for x in same)
        return (max(counts[g] - d, 0) + d * len(same) * below) / total if total else below

    def shared(g, k=0):
        return p(low[k], g, shared(g[1:], k + 1)) if k < len(low) else 1 / (1 + len(low[-1]))

    for word in ("rude", "calm", "rudely", "zzz"):
        want = sum(log(p(top[1], g, shared(g[1:])) / p(top[0], g, shared(g[1:]))) for g in toxicity._grams(word, n))
        assert model.evidence([word])[0] == pytest.approx(want, abs=1e-4)


def test_evidence_of_many_ngrams(spark):
    """With more distinct n-grams than a table of 2^19 cells has room for, evidence still equals that of plain dictionaries."""
    from collections import Counter, defaultdict

    rng = np.random.default_rng(1)
    letters = rng.integers(0, 26, (70_000, 14))
    words = [(i % 2, i // 2 % 2, "".join(chr(97 + c) for c in row), 1 + i % 3) for i, row in enumerate(letters)]
    model = toxicity.fit_counts(grams_of(spark, words))[2]
    n, d = toxicity.ORDER, toxicity.DISCOUNT
    levels = [Counter(), Counter()]
    for y, _, w, c in words:
        for g in toxicity._grams(w, n):
            levels[y][g] += c
    assert len(set(levels[0]) | set(levels[1])) > 1 << 19
    level = set(levels[0]) | set(levels[1])
    for _ in range(n - 2):
        levels.append(Counter(g[1:] for g in level))
        level = set(levels[-1])
    totals, types = [defaultdict(int) for _ in levels], [defaultdict(int) for _ in levels]
    for i, c in enumerate(levels):
        for g, m in c.items():
            totals[i][g[:-1]] += m
            types[i][g[:-1]] += 1

    def p(i, g, below):
        total = totals[i].get(g[:-1])
        return (max(levels[i][g] - d, 0) + d * types[i][g[:-1]] * below) / total if total else below

    def shared(g, i=2):
        return p(i, g, shared(g[1:], i + 1)) if i < len(levels) else 1 / (1 + len(levels[-1]))

    some = [w for _, _, w, _ in words[:300]] + ["quietly", "zzz", "\u00e9t\u00e9"]
    want = [sum(np.log(p(1, g, shared(g[1:])) / p(0, g, shared(g[1:]))) for g in toxicity._grams(w, n)) for w in some]
    assert np.allclose(model.evidence(some), want, atol=1e-6)


@pytest.mark.parametrize("prior", [0.5, 1.0])
def test_keep_without_a_model_drops_nothing(spark, prior):
    assert toxicity.keep(docs(spark), toxicity.Model(None, None, prior)).count() == len(ROWS)
