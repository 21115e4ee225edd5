"""Toxicity by class-conditional Kneser-Ney models.

Two character models of order ``ORDER`` over words, one of toxic and one of ordinary documents, differ only in their
highest-order counts; all lower orders are Kneser-Ney continuation counts over both classes together, so a rare expression
is smoothed towards the same backoff in either. A word's evidence is the difference of its two log-likelihoods. A document is
judged by length-normalised evidence: its mean over all words, over its best window, and what single words have beyond a
margin; a logistic fit turns these into a score.

Counts cover every labelled training document: words are counted per class and half in Spark, n-grams of the highest order from the distinct words;
all lower orders follow from these. Every n-gram has a count of its own under a 64-bit hash, so what is gathered grows with the distinct n-grams of the training
words (far slower than the text). Up to ``BROADCAST_GRAMS`` of them the tables are broadcast; beyond, they stay on shared storage, and n-grams and words meet
their counts and evidence by joins, with the same scores. The logistic fit takes at most ``FIT_ROWS`` labelled documents (those of smallest hashed id); half of the
training documents are judged by the models of the other half, since a model's own documents look too certain.

Defined cases: null text counts as empty; a text without words has evidence zero and still gets a score. Texts of any length are read whole. Documents of one score are
judged alike (0.3 itself counts as toxic). Documents without a label
(or a null one) train nothing; if one class has no training document, every score is the share of label 1 there (0.5 with
no labels at all). Repeated rows each get a row and each count. Null ids take part in scoring, not in training. Columns other than id,
text and label are not read.
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
from loomgraph.plans.storage import discard, materialize

ORDER = 5
DISCOUNT = 0.75
MARGIN = 2.0
WINDOW = 8
FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Labels of up to this many documents are broadcast (three numbers each), so texts stay where they are; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Distinct n-grams that are collected and broadcast at most (about 30 bytes each on the way, 70 in a worker); more are looked up by joins.
BROADCAST_GRAMS = 4_000_000
#: Words remembered per worker.
REMEMBERED = 120_000
#: Counts by class and half of the training documents.
CELLS = "c0 long, c1 long, c2 long, c3 long"
_WORD = re.compile(r"[^\W\d_]+")
_PAD = "\x02"
_END = "\x03"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(word: str, order: int) -> list[str]:
    padded = _PAD * (order - 1) + word + _END
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def _codes(grams: list[str]) -> np.ndarray:
    """Code points, an n-gram a row; all of one length."""
    n = len(grams[0]) if grams else 0
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(grams), n).astype(np.uint64)


def _hashed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row: FNV-1a over its code points, with its high half mixed in, vectorised."""
    h = np.full(len(codes), 14695981039346656037 ^ codes.shape[1], np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k]) * np.uint64(1099511628211)
        h ^= h >> np.uint64(32)
    return h


class Table:
    """Values by 64-bit key: open addressing, at most half full, of a size that follows the keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        #: The last row is that of a key not found.
        self.values = np.vstack([values, np.zeros((1, values.shape[1]))])
        if not len(keys) or values.max() < 1 << 24:
            self.values = self.values.astype(np.float32)  # exact for such whole numbers
        bits = max(1, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        row, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(row):
            free = self.slots[at] < 0
            self.slots[at[free]] = row[free]
            left = self.slots[at] != row
            row, at = row[left], (at[left] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys) - 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """A row of values for each key; zeros for a key not in the table."""
        at = self._first(keys)
        row = self.slots[at]
        other = np.nonzero((row >= 0) & (self.keys[row] != keys))[0]
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            row[other] = self.slots[at[other]]
            other = other[(row[other] >= 0) & (self.keys[row[other]] != keys[other])]
        return self.values[row].astype(float)


@dataclass
class Counts:
    """``own``: of n-grams the counts in class 0 and 1; of contexts the counts in class 0 and 1, and the types after them likewise.
    ``shared[k]``: of order ORDER-1-k, continuation counts of n-grams; counts and types of contexts. ``base``: distinct last characters."""

    own: tuple[Table, Table]
    shared: list[tuple[Table, Table]]
    base: int = 1

    def evidence(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        grams = [_grams(w, ORDER) for w in words]
        size = np.array([len(g) for g in grams])
        flat = [g for gs in grams for g in gs]
        if not flat:
            return np.zeros(len(words))
        codes, low = _codes(flat), np.full(len(flat), 1.0 / self.base)
        for k in range(ORDER - 3, -1, -1):
            gram, context = self.shared[k][0](_hashed(codes[:, k + 1 :])), self.shared[k][1](_hashed(codes[:, k + 1 : -1]))
            low = _interpolate(gram[:, 0], context[:, 0], context[:, 1], low)
        gram, context = self.own[0](_hashed(codes)), self.own[1](_hashed(codes[:, :-1]))
        ordinary, toxic = (_interpolate(gram[:, c], context[:, c], context[:, 2 + c], low) for c in (0, 1))
        return np.add.reduceat(np.log(toxic / ordinary), np.cumsum(size) - size)


def _interpolate(count: np.ndarray, total: np.ndarray, types: np.ndarray, low: np.ndarray) -> np.ndarray:
    seen = total > 0
    divisor = np.where(seen, total, 1)
    return np.where(seen, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * types * low) / divisor, low).clip(1e-12)


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, y, half)`` of the labelled documents, marked for broadcast if they are few enough."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))
    return F.broadcast(known) if known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS else known


def training_words(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(word, c0, c1, c2, c3)`` of the labelled documents: counts by cell ``2 * y + half``, summed where the texts are before anything is shuffled."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        for part in parts:
            for text, cell in zip(part["text"], part["cell"], strict=True):
                for word, n in Counter(words_of(text)).items():
                    held.setdefault(word, [0, 0, 0, 0])[cell] += n
            if len(held) > REMEMBERED:
                yield _cells(held)
                held = {}
        yield _cells(held)

    rows = bounded(docs).join(known, "doc_id").select("text", (2 * F.col("y") + F.col("half")).alias("cell"))
    return _added(rows.mapInPandas(count, f"word string, {CELLS}"), "word")


def _cells(held: dict[str, list[int]], name: str = "word") -> pd.DataFrame:
    counts = np.array(list(held.values()), np.int64).reshape(len(held), 4)
    return pd.DataFrame({name: pd.Series(list(held), dtype=object)} | {f"c{i}": counts[:, i] for i in range(4)})


def _added(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(name).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)])


def training_grams(words: DataFrame) -> DataFrame:
    """``(gram, c0, c1, c2, c3)``: every distinct n-gram of the highest order. All lower orders follow from these."""

    def expand(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lists = [_grams(w, ORDER) for w in part["word"]]
            rows = np.repeat(np.arange(len(lists)), [len(g) for g in lists])
            cells = part[[f"c{i}" for i in range(4)]].to_numpy()[rows].reshape(len(rows), 4)
            yield pd.DataFrame({"gram": pd.Series([g for gs in lists for g in gs], dtype=object)} | {f"c{i}": cells[:, i] for i in range(4)})

    return _added(words.mapInPandas(expand, f"gram string, {CELLS}"), "gram")


def _grouped(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a row of each, and the columns' sums."""
    found, first, where = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.stack([np.bincount(where, c, len(found)) for c in columns], axis=1)
    return found, first, sums


def _counts(codes: np.ndarray, cells: np.ndarray, half: int) -> Counts:
    """The model of one half, or of both (2), from distinct n-grams and their counts by class and half."""
    by_class = cells.reshape(-1, 2, 2)[:, :, [0, 1] if half == 2 else [half]].sum(2)
    there = by_class.any(1)
    codes, by_class = codes[there], by_class[there].astype(float)
    context, _, sums = _grouped(_hashed(codes[:, :-1]), *by_class.T, *(by_class > 0).T.astype(float))
    own = Table(_hashed(codes), by_class), Table(context, sums)
    shared, level = [], codes
    for _ in range(ORDER - 2):
        level = level[:, 1:]
        keys, first, n = _grouped(_hashed(level), np.ones(len(level)))
        level = level[first]
        context, _, sums = _grouped(_hashed(level[:, :-1]), n[:, 0], np.ones(len(level)))
        shared.append((Table(keys, n), Table(context, sums)))
    return Counts(own, shared, 1 + len(shared[-1][0]))


def fit_counts(grams: DataFrame) -> list[Counts]:
    """The models of half 0, of half 1, and of all training documents, on the driver. Collected: a row for each distinct n-gram of the highest order."""
    found = grams.toArrow()
    codes, cells = _codes(found["gram"].to_pylist()), np.stack([found[f"c{i}"].to_numpy() for i in range(4)], axis=1)
    return [_counts(codes, cells, half) for half in range(3)]


class Tables:
    """The same counts as rows on shared storage, for n-grams too many to be broadcast: ``(number, key, n, types)``, and each half's ``base``."""

    def __init__(self, grams: DataFrame):
        halves = [grams.select("gram", F.lit(h).alias("half"), *[(F.col(f"c{2 * y}") + F.col(f"c{2 * y + 1}") if h == 2 else F.col(f"c{2 * y + h}")).alias(f"n{y}") for y in (0, 1)]) for h in range(3)]
        own = halves[0].union(halves[1]).union(halves[2]).where("n0 + n1 > 0")
        kinds = own.select(F.explode(F.array(*[F.struct(F.lit(y).alias("kind"), F.col("half"), F.col("gram"), F.col(f"n{y}").alias("n")) for y in (0, 1)])).alias("r")).select("r.*").where("n > 0")
        level = own.select("half", "gram")
        for k in range(ORDER - 2):
            lower = level.groupBy("half", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
            kinds, level = kinds.union(lower.select(F.lit(2 + k), "half", "gram", "n")), lower.select("half", "gram")
        grown = kinds.mapInPandas(_numbered, "number int, key long, n long, types long")
        self.rows, self.path = materialize(grown.groupBy("number", "key").agg(F.sum("n").alias("n"), F.sum("types").alias("types")), "toxicity-tables")
        last = {r["number"]: r["n"] for r in self.rows.groupBy("number").agg(F.count("*").alias("n")).collect()}  # a row for each table
        self.base = [1 + last.get(_number(ORDER - 1, h, 0), 0) for h in range(3)]

    def evidence(self, words: DataFrame) -> DataFrame:
        """``(word, half, evidence)`` of distinct ``words (word, half)``: every count is looked up by an equi-join, then added up by word."""

        def asked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if not len(part):
                    continue
                lists = [_grams(w, ORDER) for w in part["word"]]
                size = np.array([len(g) for g in lists])
                codes = _codes([g for gs in lists for g in gs])
                at = np.concatenate([np.arange(n) for n in size])
                word, half = np.repeat(part["word"].to_numpy(), size), np.repeat(part["half"].to_numpy(), size)
                for kind in range(ORDER):
                    own = codes[:, max(0, kind - 1) :]
                    for table, keys in ((0, _hashed(own)), (1, _hashed(own[:, :-1]))):
                        yield pd.DataFrame({"word": word, "half": half, "at": at, "field": kind * 2 + table, "number": _number(kind, half, table), "key": keys.view(np.int64)})

        rows = words.mapInPandas(asked, "word string, half int, at int, field int, number int, key long").join(self.rows, ["number", "key"], "left")
        wide = rows.groupBy("word", "half", "at").agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col(c))), F.lit(0)).alias(f"{c}{f}") for f in range(2 * ORDER) for c in (("n", "types") if f % 2 else ("n",))])

        def level(kind: int, low: Column) -> Column:
            count, total, types = (F.col(c).cast("double") for c in (f"n{2 * kind}", f"n{2 * kind + 1}", f"types{2 * kind + 1}"))
            some = F.when(total > 0, (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * types * low) / total).otherwise(low)
            return F.greatest(some, F.lit(1e-12))

        low = 1.0 / F.element_at(F.array(*[F.lit(float(b)) for b in self.base]), F.col("half") + 1)
        wide = wide.withColumn("low", low)
        for kind in range(ORDER - 1, 1, -1):
            wide = wide.withColumn("low", level(kind, F.col("low")))
        return wide.groupBy("word", "half").agg(F.sum(F.ln(level(1, F.col("low")) / level(0, F.col("low")))).alias("evidence"))

    def judged(self, docs: DataFrame, text_col: str, half: Column) -> DataFrame:
        """``(row, x)``: features of each row of ``docs``, which has a column ``row``. Words meet their evidence by a join; a text's own words come together again in one row, as its text did."""

        def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for row, text, h in zip(part["row"], part["text"], part["half"], strict=True):
                    words = words_of(text)
                    for at in range(0, len(words), 10_000):
                        some = words[at : at + 10_000]
                        yield pd.DataFrame({"row": row, "half": h, "word": some, "at": np.arange(at, at + len(some))})

        @F.pandas_udf("array<double>")
        def said(evidence: pd.Series) -> pd.Series:
            return pd.Series(list(features([np.asarray(v, float) for v in evidence])))

        words, _ = materialize(bounded(docs).select("row", F.col(text_col).alias("text"), half.cast("int").alias("half")).mapInPandas(split, "row long, half int, word string, at long"), "toxicity-judged")
        found = words.join(self.evidence(words.select("word", "half").distinct()), ["word", "half"])
        by_row = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence"))), lambda v: v["evidence"]).alias("evidence"))
        return docs.select("row").join(by_row, "row", "left").select("row", said(F.coalesce("evidence", F.array().cast("array<double>"))).alias("x"))


def _number(kind, half, table):
    """kind: class 0, class 1, then shared orders downwards; half: 0, 1, or 2 for both; table: n-grams, contexts."""
    return (kind * 3 + half) * 2 + table


def _numbered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of n-grams; counts of their contexts and types after them, summed within a batch first. A batch may hold several orders."""
    for part in parts:
        for _, some in part.groupby(part["gram"].str.len()):
            codes, n = _codes(some["gram"].tolist()), some["n"].to_numpy()
            kind, half = some["kind"].to_numpy(), some["half"].to_numpy()
            yield pd.DataFrame({"number": _number(kind, half, 0), "key": _hashed(codes).view(np.int64), "n": n, "types": 0})
            contexts = pd.DataFrame({"number": _number(kind, half, 1), "key": _hashed(codes[:, :-1]).view(np.int64), "n": n, "types": 1})
            yield contexts.groupby(["number", "key"], sort=False, as_index=False).sum()


def features(evidence: list[np.ndarray]) -> np.ndarray:
    """What a document's words say, a row each."""
    out = np.zeros((len(evidence), 7))
    for i, v in enumerate(evidence):
        v = v if len(v) else np.zeros(1)
        n = len(v)
        beyond = np.maximum(v - MARGIN, 0).sum()
        run, k = np.concatenate([[0.0], np.cumsum(v)]), min(WINDOW, n)
        second = np.partition(v, n - 2)[n - 2] if n > 1 else -MARGIN
        out[i] = v.mean(), np.log1p(beyond), np.log1p(100 * beyond / n), v.max().clip(-5, 15), np.clip(second, -5, 15), ((run[k:] - run[:-k]) / k).max(), np.log1p(n)
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weight
        return 1 / (1 + np.exp(-z.clip(-500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
    """Newton's method with a ridge."""
    model = Logistic(x.mean(0), x.std(0) + 1e-9, np.zeros(x.shape[1] + 1))
    z = np.c_[np.ones(len(x)), (x - model.mean) / model.scale]
    ridge = np.eye(z.shape[1]) * penalty
    ridge[0, 0] = 1e-6
    for _ in range(50):
        p = model(x)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ model.weight)
        model.weight -= step
        if np.abs(step).max() < 1e-8:
            break
    return model


class Judge:
    """Scores texts with one model; remembers words' evidence."""

    def __init__(self, counts: Counts):
        self.counts = counts
        self.known: dict[str, float] = {}

    def evidence(self, texts: list[str | None]) -> list[np.ndarray]:
        lists = [words_of(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*lists).difference(self.known)) if lists else []
        for at in range(0, len(new), 20_000):
            self.known.update(zip(new[at : at + 20_000], self.counts.evidence(new[at : at + 20_000]).tolist(), strict=True))
        get = self.known.__getitem__
        return [np.fromiter(map(get, ws), float, len(ws)) for ws in lists]


@dataclass
class Model:
    counts: Counts | None
    link: Logistic | None
    prior: float
    #: In place of ``counts`` where these would be too large to broadcast.
    tables: Tables | None = None

    def scores(self, judge: Judge | None, texts: list[str | None]) -> np.ndarray:
        if judge is None or self.link is None:
            return np.full(len(texts), self.prior)
        return self.link(features(judge.evidence(texts)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", broadcast_grams: int | None = None) -> Model:
    """``docs (doc_id, text)`` and ``labels (doc_id, label)``: all rows given are training rows."""
    spark, most = docs.sparkSession, BROADCAST_GRAMS if broadcast_grams is None else broadcast_grams
    known = known_labels(labels.select("doc_id", label), label)
    grams, path = materialize(training_grams(training_words(docs, known)), "toxicity-grams")
    totals = {r["y"]: r["n"] for r in docs.join(known, "doc_id").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        discard(spark, path)
        return Model(None, None, totals.get(1, 0) / sum(totals.values()) if totals else 0.5)
    prior = totals[1] / sum(totals.values())
    few = F.broadcast(known.select("doc_id", "y").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(FIT_ROWS))
    other = 1 - F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    if grams.count() > most:
        tables = Tables(grams)
        discard(spark, path)
        own, own_path = materialize(docs.join(few, "doc_id").select(F.monotonically_increasing_id().alias("row"), "doc_id", "y", "text"), "toxicity-fit")
        rows = tables.judged(own, "text", other).join(own.select("row", "y"), "row").select("y", "x").toPandas()
        discard(spark, own_path)
        return Model(None, fit_logistic(np.array(rows["x"].tolist()), rows["y"].to_numpy(float)), prior, tables)
    models = fit_counts(grams)
    discard(spark, path)
    cross = spark.sparkContext.broadcast(models[:2])

    @F.pandas_udf("array<double>")
    def judged(half: pd.Series, text: pd.Series) -> pd.Series:
        out: list = [None] * len(text)
        for h in (0, 1):
            own = np.nonzero(half.to_numpy() == h)[0]
            for i, row in zip(own, features(Judge(cross.value[h]).evidence([text.iloc[i] for i in own])), strict=True):
                out[i] = row
        return pd.Series(out)

    rows = bounded(docs).join(few, "doc_id").select("y", judged(other, "text").alias("x")).toPandas()
    cross.unpersist()
    return Model(models[2], fit_logistic(np.array(rows["x"].tolist()), rows["y"].to_numpy(float)), prior)


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the score of each whole text. A map without a shuffle, unless the model is too large to broadcast."""
    if model.tables is not None:
        return _with_joined_score(docs, model, text_col, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        judge = Judge(m.counts) if m.counts else None
        for texts in parts:
            texts = texts.tolist()
            yield pd.Series(np.concatenate([m.scores(judge, texts[at : at + 1000]) for at in range(0, len(texts), 1000)] or [np.zeros(0)]))

    return bounded(docs).withColumn(name, score(F.col(text_col)))


def _with_joined_score(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    link, names = model.link, docs.columns

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(link(np.array(x.tolist(), float).reshape(len(x), -1)))

    held, _ = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("all"), F.col(text_col).alias("text")), "toxicity-docs")
    found = model.tables.judged(held.select("row", "text"), "text", F.lit(2))
    return held.join(found.select("row", score("x").alias("own_score")), "row").select("all.*", F.col("own_score").alias(name))


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows judged not toxic, with the columns they came with; all rows if the labels were too few to train a model."""
    if model.link is None:
        return docs
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, model, text_col, name).where(F.col(name) < threshold).drop(name)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Trained on the rows outside the held-out fold."""
    return train(docs.select("doc_id", "text"), labels.where(~held_out()))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return with_score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
