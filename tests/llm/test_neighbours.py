import random

import numpy as np
import pytest
from helpers import ROWS, clashing, docs, table

import corpus_pipeline
from loomgraph.llm import ann, packing, quality, simhash, toxicity


def brute_components(rows):
    prints = [simhash.simhash(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(r[0], f"{prints[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)], key=repr)


def near_copies(n=150):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words), "en", "s", 0))
    return rows + [(1000 + i, " ".join(f"y{rng.randrange(500)}" for _ in range(40)), "en", "s", 0) for i in range(40)]


def test_op10(spark, tmp_path):
    rows = ROWS + near_copies()
    got = sorted(map(tuple, simhash.op10_simhash(spark, table(spark, tmp_path, documents=clashing(docs(spark, rows)))).collect()), key=repr)
    assert got == brute_components(rows)
    assert simhash.op10_simhash(spark, table(spark, tmp_path, documents=docs(spark, []))).collect() == []


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_split_hot_keys_lose_no_link(spark, chunk):
    rng = np.random.default_rng(chunk)
    centre = int(rng.integers(1 << 62))
    values = {centre}
    for _ in range(300):
        v = int(rng.choice(list(values)))
        for b in rng.choice(64, 4, replace=False)[: rng.integers(1, 5)]:
            v ^= 1 << int(b)
        values.add(v)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = {r["fp"]: r["root"] for r in simhash.classes(spark.createDataFrame([(v,) for v in values], "fp long"), chunk=chunk).collect()}
    x = np.array(values).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x) <= 3
    label = np.arange(len(x))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    alone = near.sum(1) == 1
    assert {v for v in got} == {v for v, a in zip(values, alone, strict=True) if not a}
    groups = {}
    for v, k in zip(values, label, strict=True):
        groups.setdefault(k, set()).add(v)
    for members in groups.values():
        if len(members) > 1:
            assert {got[m] for m in members} == {min(members)}


def test_keep_one(spark):
    rows = ROWS + near_copies(40)
    df = clashing(docs(spark, rows))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = brute_components(rows)
    prints = sorted([(r[0], f"{simhash.simhash(r[1]):016x}") for r in rows], key=repr)
    assert len(prints) == len(ids)
    named = {c for _, _, c in ids if c is not None}
    alone = {f for _, f, c in ids if c is None}
    got = kept.select("doc_id").collect()
    assert {r["doc_id"] for r in got if r["doc_id"] is not None} == named and sum(r["doc_id"] is None for r in got) == len(alone)


VECTORS = "vec_id long, embedding array<float>, label int"


def search(spark, rows, **kw):
    v = spark.createDataFrame(rows, VECTORS)
    got = ann.search(v, v.where("vec_id % 100 = 0"), **kw).collect()
    return {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}


def brute_search(rows, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return {i: sorted([(float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i])[:k] for i, v in good if i % 100 == 0}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(3000)]
    got, want = search(spark, rows), brute_search(rows)
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {j for _, j in want[q]}) / 10 for q in want]) >= 0.9
    exact = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    assert all(s == np.sqrt(((exact[q] - exact[i]) ** 2).sum()) for q, found in got.items() for i, s in found)


def test_awkward_vectors(spark):
    good = [float(x) for x in range(1, 9)]
    rows = [(0, good, 0), (1, good, 0), (2, [x + 1 for x in good], None), (3, None, 0), (4, [0.0] * 8, 0), (5, [None] + good[1:], 0), (6, [float("nan")] + good[1:], 0), (7, [float("inf")] + good[1:], 0), (8, good[:4], 0), (None, good, 0), (100, [float("nan")] * 8, 0)]
    assert search(spark, rows) == {0: [(1, 0.0), (2, float(np.sqrt(8)))]}
    assert search(spark, []) == {}


def test_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(2)
    common = [float(x) for x in rng.normal(size=8)]
    rows = [(i, common if i % 3 == 0 else [float(x) for x in rng.normal(size=8)], 0) for i in range(900)]
    got, want = search(spark, rows, probes=1000), brute_search(rows)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [j for _, j in f] for q, f in want.items()}


def test_pipeline_against_a_plain_version(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs(spark, [r for r in ROWS if r[0] is None or r[0] > 6]).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    path = table(spark, tmp_path, documents=documents.union(odd), labels=labels)
    got = sorted(map(tuple, corpus_pipeline.run(spark, path).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr)
    every = spark.read.parquet(f"{path}/documents.parquet")
    rows = [tuple(r) for r in every.collect()]
    toxic = toxicity.train_on(every, labels.select("doc_id", "toxic"))
    judge = toxicity.Judge(toxic.counts)
    rows = [r for r, s in zip(rows, toxic.scores(judge, [r[1] for r in rows]), strict=True) if s < toxicity.THRESHOLD]
    good = quality.train_on(docs(spark, rows), labels.select("doc_id", "quality"))
    rows = [r for r, s in zip(rows, good.score(quality.matrix([r[1] for r in rows])), strict=True) if s >= quality.THRESHOLD]
    named = brute_components(rows)
    wanted = {c for _, _, c in named if c is not None}
    lost = len({f for _, f, c in named if c is None})
    kept = [r for r in rows if r[0] in wanted]
    want = sorted(map(tuple, packing.op9_packing(spark, table(spark, tmp_path / "kept", documents=docs(spark, kept))).select("doc_id", "piece", "start", "length", "ids_crc32").collect()), key=repr)
    assert [g for g in got if g[0] is not None] == want and len({g for g in got if g[0] is None}) >= min(lost, 1)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "packing"]


def test_op8_against_brute_force(spark):
    """The query itself, with production parameters: exact scores and ranks, and nine of ten true neighbours."""
    sf = "/root/testdata/sf0.01"
    got, found = ann.op8_ann(spark, sf).collect(), {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = [(r["vec_id"], np.array(r["embedding"], np.float32).astype(float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = []
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, far))] if i != q][:10]
        assert [r for r, _, _ in found[q]] == list(range(1, 11)) and all(abs(s - far[ids == i][0]) < 1e-12 for _, i, s in found[q])
        assert [(s, i) for _, i, s in found[q]] == sorted((s, i) for _, i, s in found[q])
        hits.append(len(set(want) & {i for _, i, _ in found[q]}) / 10)
    assert np.mean(hits) >= 0.9


def test_pipeline_and_keep_one_of_nothing(spark, tmp_path):
    path = table(spark, tmp_path, documents=docs(spark, []), labels=spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert simhash.keep_one(docs(spark, [])).collect() == [] and corpus_pipeline.run(spark, path).collect() == []
