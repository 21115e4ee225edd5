import hashlib
import random
import re

import pytest
import xxhash
from helpers import ROWS, clashing, docs, table
from pyspark.sql import functions as F

from loomgraph.llm import fingerprint as op


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def plain_grams(text):
    words = [w for w in re.split("[ \\t\\n\\x0b\\f\\r]+", (text or "").lower()) if w]  # an ideographic space separates nothing
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def gram(hs):
        seed = 42
        for h in hs:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed

    return {gram(hashes[i : i + op.WORDS]) for i in range(max(1, len(hashes) - op.WORDS + 1))} if hashes else set()


def retained(grams):
    low = {g for g in grams if g >> (64 - op.FRACTION_BITS) == 0}
    return sorted(map(signed, low or ({min(grams)} if grams else set())))


def plain_sketch(text):
    return retained(plain_grams(text))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(plain_sketch, (text, edited, after))

        def like(x, y):
            return float(len(set(x) & set(y)) / min(len(x), len(y))) if x and y else float(len(x) == len(y))

        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), like(a, b), like(a, c)))
    return sorted(out, key=repr)


def result(spark, path):
    df = op.op1_fingerprint(spark, path).select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("keep", [lambda r: True, lambda r: r[0] is not None, lambda r: r[0] is None, lambda r: r[0] == 3])
def test_against_brute_force(spark, tmp_path, keep):
    rows = [r for r in ROWS if keep(r)]
    assert result(spark, table(spark, tmp_path, documents=clashing(docs(spark, rows)))) == brute(rows)


def test_runs_are_joined_at_their_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "RUN_ROWS", 1)
    rows = [(i * i, f"text {i} " * (i % 7), "en", "s", 0) for i in range(300)]
    assert result(spark, table(spark, tmp_path, documents=docs(spark, rows))) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert result(spark, table(spark, tmp_path, documents=docs(spark, []))) == []


@pytest.mark.parametrize("a,b", [("one two three four five six seven", "x x x six seven eight nine ten eleven"), ("", "one"), ("", ""), ("one", "two"), (" ".join(f"w{i}" for i in range(80)), "one")])
def test_merge_is_the_sketch_of_the_union(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(op.merge(op.sketch(F.col("a")), op.sketch(F.col("b"))).alias("m")).first()
    assert row["m"] == retained(plain_grams(a) | plain_grams(b))


def test_containment_between_unequal_documents(spark):
    long = [f"w{i}" for i in range(5000)]
    row = spark.createDataFrame([(" ".join(long), " ".join(long[1000:1600]))], "a string, b string").select(op.containment(op.sketch(F.col("b")), op.sketch(F.col("a"))).alias("c")).first()
    assert row["c"] > 0.95


def test_no_python_in_the_plan(spark, tmp_path):
    plan = op.op1_fingerprint(spark, table(spark, tmp_path, documents=docs(spark)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("bits", [2, 4, 6])
def test_error_follows_the_fraction(spark, bits):
    """Estimates stray from the true containment by about the square root of c (1 - c) / retained hashes."""
    rng = random.Random(bits)
    words = [f"w{rng.randrange(10**9)}" for _ in range(4000)]
    rows = [(" ".join(words), " ".join(words[: 2000 + 20 * i] + [f"x{i}_{k}" for k in range(2000 - 20 * i)])) for i in range(20)]
    got = spark.createDataFrame(rows, "a string, b string").select(op.containment(op.sketch(F.col("b"), fraction_bits=bits), op.sketch(F.col("a"), fraction_bits=bits))).collect()
    true = [len(plain_grams(b) & plain_grams(a)) / len(plain_grams(b)) for a, b in rows]
    off = [(g[0] - t) ** 2 for g, t in zip(got, true, strict=True)]
    assert (sum(off) / len(off)) ** 0.5 < 2 * (0.25 / (4000 / 2**bits)) ** 0.5
