"""Document fingerprints: threshold-scaled sketches over hashed word shingles, in built-in functions only.

A sketch keeps every shingle hash in the lowest ``1 / fraction`` of the 64-bit range, so its size follows the document's
and the sketch of a union is the union of sketches (``merge``). The smallest hash is kept too, even above the threshold:
it merges by minimum and leaves no text with shingles an empty sketch. The share of one sketch found in the other
estimates containment, also between very unequal documents; ``likeness`` takes it in the smaller of the two.

An estimate of a containment c strays from it by about the square root of c (1 - c) / m, with m retained hashes of the document: with one in four, 0.03 at
most for 1,000 words, 0.06 with one in sixteen (``fraction_bits=4``) and a quarter of the size.

Shingles are runs of five words (ASCII white space separates, letters lower-cased); a text of one to four words is one
shingle. Texts of any length are taken whole; their sketches grow with them. Null text counts as empty; an empty text has the empty sketch. Two empty sketches have likeness 1, an
empty and another 0. Equal texts have equal sketches. Repeated rows each get a row. Only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
#: One in 2**FRACTION_BITS shingle hashes is retained.
FRACTION_BITS = 2
#: Rows of a run of neighbouring ids that are sorted together, and the most runs; their first ids are all the driver sees.
RUN_ROWS, MOST_RUNS = 2000, 100_000
#: The runs' first rows are joined by broadcast up to this many, else by a shuffle.
BROADCAST_RUNS = 20_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != "")


def sketch(text: Column, words: int = WORDS, fraction_bits: int = FRACTION_BITS) -> Column:
    """Sorted array of the retained shingle hashes (unsigned order, as signed longs)."""

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - words, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        grams = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(words)]))
        return _only(F.transform(F.array(grams), lambda g: _retain(g, fraction_bits)))

    return _only(F.transform(F.array(F.transform(_words(text), lambda w: F.xxhash64(w))), of))


def _only(one: Column) -> Column:
    """The single element: a lambda over a one-element array evaluates its argument once."""
    return F.element_at(one, 1)


def _retain(grams: Column, fraction_bits: int) -> Column:
    flip = F.lit(-(1 << 63))
    low = F.filter(grams, lambda h: F.shiftrightunsigned(h, 64 - fraction_bits) == 0)
    least = F.array_min(F.transform(grams, lambda h: h.bitwiseXOR(flip))).bitwiseXOR(flip)
    return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(grams) > 0, F.array(least)).otherwise(F.array().cast("array<bigint>"))


def merge(a: Column, b: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """The sketch of the union of two documents' shingles."""
    return _retain(F.array_union(a, b), fraction_bits)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment in the smaller sketch, 0 to 1."""
    less = F.least(F.size(a), F.size(b))
    return F.when(less == 0, F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / less)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard index of the shingle sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def as_text(a: Column) -> Column:
    """Hashes as 16 lower-case hex digits each, dot-separated."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), ".")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sketch)`` of every row: a map without a shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), sketch(F.col(text_col)).alias("sketch"))


def _runs(ids: DataFrame) -> tuple[Column, list[tuple[int, int]]]:
    """The run of neighbouring ids that an id belongs to, and (run, largest id) of the runs in use, ascending.

    64 ranges of equal counts (approximate quantiles), each cut evenly; a null id is in run -1.
    """
    stats = ids.agg(F.count("doc_id").alias("n"), F.percentile_approx("doc_id", [i / 64 for i in range(65)], 10_000).alias("q")).first()
    if not stats["n"]:
        return F.lit(-1).cast("long"), []
    cuts = sorted(set(stats["q"]))
    per = max(1, min(MOST_RUNS // 64, math.ceil(stats["n"] / 64 / RUN_ROWS)))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    x = F.col("doc_id")
    coarse = F.size(F.filter(bounds, lambda b: b <= x))
    low, high = F.get(bounds, coarse - 1), F.get(bounds, coarse)
    part = F.when(low.isNull() | high.isNull(), 0).otherwise(F.least(F.lit(per - 1), F.floor((x.cast("double") - low) / (high.cast("double") - low) * per)))
    run = F.when(x.isNull(), F.lit(-1)).otherwise(coarse * per + part).cast("long")
    return run, sorted((r["run"], r["top"]) for r in ids.where(x.isNotNull()).groupBy(run.alias("run")).agg(F.max("doc_id").alias("top")).collect())


def with_next(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text)`` with ``next_text``: the text of the next row by descending id, after the last that of the first.

    ``run``, ``edge`` and ``place`` say where a row stands; rows with an edge over 0 are only there for a neighbour.

    Ties go by text. Rows without an id come last. Each text crosses one shuffle, in runs of neighbouring ids; the rows
    with a run's largest id also go to the run above it, whose last row needs them.
    """
    spark = docs.sparkSession
    run, tops = _runs(docs.select("doc_id"))
    own = docs.select("doc_id", "text", run.alias("run"), F.lit(0).alias("edge"))
    if not tops:
        edges = own.where(F.lit(False))
        wrap = own.select("text").agg(F.min("text").alias("text"), F.count("*").alias("n")).where("n > 0").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(-1).cast("long").alias("run"), F.lit(2).alias("edge"))
        edges = edges.union(wrap)
    else:
        above = {tops[i][1]: tops[i + 1][0] for i in range(len(tops) - 1)}
        nulls = bool(docs.where("doc_id IS NULL").limit(1).count())
        to = [(t, r, 1) for t, r in above.items()] + [(tops[-1][1], -1 if nulls else tops[0][0], 2)]
        sent = spark.createDataFrame(to, "top long, to_run long, to_edge int")
        sent = F.broadcast(sent) if len(to) <= BROADCAST_RUNS else sent
        edges = docs.join(sent, docs["doc_id"] == sent["top"]).select("doc_id", "text", F.col("to_run").alias("run"), F.col("to_edge").alias("edge"))
        if nulls:
            first_null = docs.where("doc_id IS NULL").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
            edges = edges.union(first_null.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(tops[0][0]).alias("run"), F.lit(1).alias("edge")))
    w = Window.partitionBy("run").orderBy("edge", F.desc_nulls_last("doc_id"), "text")
    return own.union(edges).withColumns({"next_text": F.lead("text").over(w), "place": F.row_number().over(w)})


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    both = pairs.select("run", "edge", "place", "doc_id", "n_chars", "text", edited.alias("edited"))
    # The sketches are made once each; a second pass over the same runs, without texts, brings the next one.
    made = both.select("run", "edge", "place", "doc_id", "n_chars", sketch(F.col("text")).alias("a"), sketch(F.col("edited")).alias("b"), F.sha2("edited", 256).alias("edited_sha256"))
    w = Window.partitionBy("run").orderBy("place")
    made = made.withColumn("c", F.lead("a").over(w)).where("edge = 0")
    return made.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), resemblance(F.col("a"), F.col("b")).alias("jaccard_edited"), resemblance(F.col("a"), F.col("c")).alias("jaccard_next"))
