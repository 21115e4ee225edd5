"""Best-two-fit packing of documents into sequences of bounded length.

Lengths are small whole numbers, so the packing is decided on their histogram, which has at most ``capacity`` rows at any
scale. A bin is filled greedily with the longest piece that still fits; then its smallest piece is replaced by two unpacked
ones whenever those fit the expanded gap more tightly. The same bin is repeated for as many pieces as there are, so each step
uses up a length and there are at most ``capacity`` kinds of bins. Pieces are then numbered within their length (from
counts per input partition, without a global sort) and each number names its bin and place in closed form.

Defined cases: null text counts as empty; an empty text is its end id alone. A null id is kept. Repeated rows are packed each.
Texts over ``capacity`` ids, and only those, are cut; only the last piece of a text may be shorter. An empty table gives
no rows. Extra columns are not read. Texts of any length are encoded whole. Pieces of equal length are alike; which goes where is no matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.batches import bounded
from loomgraph.llm.tokens import encoder, vocabulary
from loomgraph.plans.storage import materialize

CAPACITY = 2048


def _best_pair(left: np.ndarray, least: int, most: int) -> tuple[int, int] | None:
    """Two lengths still there with the largest sum in (least, most]."""
    there = left > 0
    for total in range(most, least, -1):
        a = np.arange(1, total // 2 + 1)
        a = a[total - a < len(left)]
        ok = there[a] & there[total - a] & ((2 * a < total) | (left[a] > 1))
        if ok.any():
            a = int(a[ok][0])
            return a, total - a
    return None


def bins(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """``(repeats, lengths)`` of the bins for ``counts[length]`` pieces of each length; ``len(counts) - 1`` is the capacity."""
    left, capacity, out = counts.astype(np.int64).copy(), len(counts) - 1, []
    while left.any():
        longest = int(np.nonzero(left)[0][-1])
        content, gap = [longest], capacity - longest
        left[longest] -= 1
        while gap and len(fits := np.nonzero(left[: gap + 1])[0]):
            content.append(int(fits[-1]))
            left[content[-1]] -= 1
            gap -= content[-1]
        while gap:
            small = content[-1]
            pair = _best_pair(left, small, gap + small)
            if not pair:
                break
            content.pop()
            left[small] += 1
            content = sorted([*content, *pair], reverse=True)
            left[list(pair)] -= 1 if pair[0] != pair[1] else 2
            gap += small - sum(pair)
        need = Counter(content)
        more = min(int(left[n]) // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= more * k
        out.append((1 + more, content))
    return out


def places(plan: list[tuple[int, list[int]]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: from which number on its pieces go to which first sequence, at which offset."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence = np.zeros(capacity + 1, np.int64), 0
    for repeats, content in plan:
        offset = 0
        for n in content:
            found.setdefault(n, []).append((int(used[n]), sequence, offset))
            used[n] += repeats
            offset += n
        sequence += repeats
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in found.items()}


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = 0, words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, part, number)``: ``number`` counts a partition's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encode = TaskContext.get(), encoder(vocabulary_path, words)
        part = context.partitionId() if context else 0
        end, step, seen = np.array([end_id], "<u4").tobytes(), 4 * capacity, Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some, rows = batch.slice(at, 500), []
                for doc_id, ids in zip(some["doc_id"].to_pylist(), encode(some["text"].to_pylist()), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), step)):
                        own = ids[start : start + step]
                        n = len(own) // 4
                        rows.append((doc_id, piece, start // 4, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"])

    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece long, start long, length long, ids_crc32 long, part long, number long")


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, end_id: int = 0, words: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece."""
    cut, _ = materialize(pieces(docs, vocabulary_path, capacity, end_id, words, id_col, text_col), "pieces")
    by_part, _ = materialize(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["n"]
    where = places(bins(counts), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.nonzero(length == n)[0]
                first, to, off = where[int(n)]
                k = np.searchsorted(first, number[own], "right") - 1
                sequence[own] = to[k] + number[own] - first[k]
                offset[own] = off[k]
            kept = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # As many rows as lengths times partitions: it grows with the input, so it is never broadcast.
    numbered = cut.hint("merge").join(base, ["length", "part"]).select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("number"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, vocabulary("word_bpe_49k.json"))
