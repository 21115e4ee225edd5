"""Ranked search over node labels: BM25 with bonuses, typo correction, seeds, fusion with vectors."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text
from loomgraph.operators.graph import first_by

# BM25, bonuses, penalties, seeds, fusion.
K1, B, IDF_FLOOR = 1.2, 0.75, 0.01
EXACT, PREFIX, SOURCE = 1000.0, 100.0, 0.5
CONCEPT, PROSE, RANK_BOOST, VECTOR_BOOST = 0.85, 0.9, 0.15, 0.15
MAX_SEEDS, SEED_GAP, MAX_COMMUNITIES, TIE_GAP = 3, 0.8, 5, 0.10
FUSION_K, FUSION_TOP, LEAST_COSINE = 60, 20, 0.35
# Words that say nothing in a question.
STOPWORDS = frozenset((
    "how", "does", "is", "are", "the", "a", "an", "to", "of", "in", "on", "for", "and", "or", "what", "which", "that", "do", "did", "will", "would",
    "should", "can", "could", "with", "from", "at", "by", "this", "why", "when", "where", "who", "whom", "whose", "was", "were", "be", "been",
    "being", "shall", "may", "might", "must", "has", "have", "had", "but", "not", "without", "into", "onto", "off", "these", "those", "there",
    "here", "its", "their", "them", "they", "about", "any", "all", "some", "work", "works", "working",
))
# Words for one thing.
SYNONYMS = (
    frozenset(("login", "signin", "logon", "authenticate", "auth")),
    frozenset(("logout", "signout")),
    frozenset(("register", "signup")),
    frozenset(("delete", "remove", "erase")),
    frozenset(("fetch", "retrieve", "get")),
    frozenset(("create", "add", "new")),
    frozenset(("update", "edit", "modify")),
    frozenset(("start", "begin", "launch", "init", "initialize")),
    frozenset(("stop", "halt", "terminate", "kill")),
    frozenset(("config", "configuration", "settings", "options")),
    frozenset(("error", "exception", "fail", "failure")),
    frozenset(("test", "spec", "check", "verify", "validate")),
    frozenset(("click", "tap", "press")),
    frozenset(("send", "submit", "dispatch")),
    frozenset(("show", "display", "render")),
    frozenset(("hide", "dismiss")),
)
# Verbs with a particle, up to three words apart, and what they mean.
PHRASES = {
    ("log", "in"): ("login", "authenticate",),
    ("log", "on"): ("login", "logon", "authenticate",),
    ("sign", "in"): ("login", "signin", "authenticate",),
    ("log", "out"): ("logout",),
    ("sign", "out"): ("logout", "signout",),
    ("sign", "up"): ("register", "signup",),
}
# Words of a question that restrict the kind of edge.
CONTEXT_WORDS = {
    "call": ("call", "calls", "called", "invoke", "invokes", "invoked"),
    "import": ("import", "imports", "imported", "module", "modules"),
    "field": ("field", "fields", "member", "members", "property", "properties"),
    "parameter_type": ("parameter", "parameters", "param", "params", "argument", "arguments"),
    "return_type": ("return", "returns", "returned"),
    "generic_arg": ("generic", "generics", "template", "templates"),
}


def query_terms(question: str) -> list[str]:
    """Words worth looking for, with synonyms behind them. Stop words go unless nothing else is there."""
    low = question.lower()
    words = [w for w in re.findall(r"\w+", low) if not (w.isascii() and len(w) <= 2)]
    terms = list(dict.fromkeys([w for w in words if w not in STOPWORDS] or words))
    more = [s for t in terms for g in SYNONYMS if t in g for s in sorted(g)]
    more += [s for (verb, particle), names in PHRASES.items() if re.search(rf"\b{verb}\b(?:\s+\w+){{0,3}}\s+\b{particle}\b", low) for s in names]
    return list(dict.fromkeys(terms + more))


def question_contexts(question: str) -> list[str]:
    """Kinds of edges that a question's words ask for."""
    words = set(re.sub("[?,]", " ", question.lower()).split())
    return [kind for kind, hints in CONTEXT_WORDS.items() if words & set(hints)]


# Other names of kinds of edges.
CONTEXT_NAMES = {
    "param": "parameter_type", "params": "parameter_type", "parameter": "parameter_type", "parameters": "parameter_type", "argument": "parameter_type", "arguments": "parameter_type", "arg": "parameter_type", "args": "parameter_type",
    "return": "return_type", "returns": "return_type", "returned": "return_type", "generic": "generic_arg", "generics": "generic_arg", "template": "generic_arg", "templates": "generic_arg",
    "annotation": "attribute", "annotations": "attribute", "decorator": "attribute", "decorators": "attribute", "calls": "call", "called": "call", "invoke": "call", "invocation": "call",
    "fields": "field", "property": "field", "properties": "field", "member": "field", "members": "field", "imports": "import", "imported": "import", "module": "import", "modules": "import", "exports": "export", "exported": "export",
}


def filter_context(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges of the kinds asked for, by any of their names; all of them if none is."""
    kinds = list(dict.fromkeys(CONTEXT_NAMES.get(k.strip().lower(), k.strip().lower()) for k in kinds if k.strip()))
    return edges.where(F.col("context").isin(*kinds)) if kinds else edges


def corpus(nodes: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``(id, tokens, dl)``: a label's tokens and, if new, all of them joined."""
    tokens = text.search_tokens(F.col("label")) if tokens is None else tokens
    t = nodes.select("id", tokens.alias("t")).withColumn("whole", F.array_join("t", ""))
    full = F.when((F.col("whole") != "") & ~F.array_contains("t", F.col("whole")), F.array_append("t", F.col("whole"))).otherwise(F.col("t"))
    return t.select("id", full.alias("tokens")).withColumn("dl", F.size("tokens"))


def term_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, df)`` over the whole corpus."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def score(nodes: DataFrame, terms: list[str], ascii_only: bool = False) -> DataFrame:
    """``(id, score)``, best first by score, label length and id: BM25 over labels, bonuses for the whole query and for file names.

    The terms are few literals, so the corpus is read once for its statistics and once for scores; nothing is joined.
    """
    wanted = [t for q in terms for t in text.plain_tokens(q)]
    if not wanted:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    docs = corpus(nodes, text.ascii_tokens(F.col("label")) if ascii_only else None)
    unique = sorted(set(wanted))
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.array_contains("tokens", t)).alias(f"df{i}") for i, t in enumerate(unique)]).first()
    n = stats["n"] or 1
    idf = {t: max(IDF_FLOOR, math.log(1 + (n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))) for i, t in enumerate(unique)}
    joined, weight = " ".join(wanted), max(idf.values())
    j = nodes.join(docs, "id")
    label, tokens = F.lower(F.col("label")), F.array_join("tokens", " ")
    bare = F.regexp_replace(label, r"[()]+$", "")
    exact = (label == joined) | (bare == joined) | (tokens == joined) | (F.lower("id") == joined)
    begins = label.startswith(joined) | bare.startswith(joined) | tokens.startswith(joined)
    total = F.when(exact, EXACT * 10 * weight).when(begins, PREFIX * 10 * weight).otherwise(0.0)
    norm = 1 - B + B * F.greatest(F.col("dl"), F.lit(1)) / (stats["avg"] or 1.0)
    for t in unique:
        f = F.size("tokens") - F.size(F.array_remove("tokens", t))
        total = total + F.lit(idf[t]) * f * (K1 + 1) / (f + K1 * norm) + F.when(F.lower("source_file").contains(t), SOURCE * idf[t]).otherwise(0.0)
    return j.select("id", "label", total.alias("score")).where("score > 0").orderBy(F.desc("score"), F.length("label"), "id").select("id", "score")


def weigh(scored: DataFrame, nodes: DataFrame, ranks: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """``(id, score)`` after small corrections: concepts and prose yield to code, central and similar nodes gain at most 15 % each."""
    from loomgraph.functions import rules

    source = F.coalesce("source_file", F.lit(""))
    factor = F.when(rules.is_concept_node(source), CONCEPT).when(text.suffix(source).isin(*rules.DOCS), PROSE).otherwise(1.0)
    out = scored.join(nodes.select("id", "source_file"), "id").withColumn("score", F.col("score") * factor).select("id", "score")
    for extra, name, boost in ((ranks, "rank", RANK_BOOST), (similar, "similarity", VECTOR_BOOST)):
        if extra is not None:
            top = F.broadcast(extra.agg(F.max(name).alias("top")))
            out = out.join(extra.select("id", name), "id", "left").crossJoin(top).withColumn("score", F.col("score") * (1 + boost * F.coalesce(F.col(name) / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0)))).select("id", "score")
    return out


def pick_seeds(scored: DataFrame, most: int = MAX_SEEDS, gap: float = SEED_GAP) -> DataFrame:
    """The first few of ``(id, score)`` that stay close to the best, by score and id."""
    top = scored.orderBy(F.desc("score"), "id").limit(most)
    w = Window.orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.first("score").over(w)
    return top.withColumn("ok", F.min((F.col("score") >= gap * best).cast("int")).over(w)).where("ok = 1").select("id", "score")


def fill_communities(seeds: DataFrame, scored: DataFrame, community: DataFrame, most: int = MAX_COMMUNITIES) -> DataFrame:
    """Seeds and the best of further communities, ``most`` in all."""
    c = scored.join(community, "id")
    used = c.join(seeds.select("id"), "id", "left_semi").select("community").distinct()
    more = first_by(c.join(used, "community", "left_anti"), ["community"], F.desc("score"), "id").select("id", "score")
    return seeds.select("id", "score", F.lit(0).alias("later")).union(more.select("id", "score", F.lit(1))).orderBy("later", F.desc("score"), "id").limit(most).select("id", "score")


def near_ties(scored: DataFrame, gap: float = TIE_GAP) -> DataFrame:
    """Candidates within a tenth of the best."""
    best = F.broadcast(scored.agg(F.max("score").alias("best")))
    return scored.crossJoin(best).where((F.col("best") - F.col("score")) / F.col("best") < gap).select("id", "score")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, no less than zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))


def cosine_top(vectors: DataFrame, query: list[float], top: int = FUSION_TOP, least: float = 0.0) -> DataFrame:
    """``(id, similarity)`` of the vectors ``(id, v)`` nearest to a query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", cosine(F.col("v"), q).alias("similarity")).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(top)


def fuse(a: DataFrame, b: DataFrame, k: int = FUSION_K) -> DataFrame:
    """``(id, score)``: reciprocal ranks of two short ranked lists ``(id, score)`` added up."""
    ranked = lambda d, n: d.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias(n))
    j = ranked(a, "ra").join(ranked(b, "rb"), "id", "full")
    return j.select("id", (F.coalesce(1.0 / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("rb")), F.lit(0.0))).alias("score"))


def find_tiers(nodes: DataFrame, query: str) -> DataFrame:
    """``(id, tier)`` of the best tier that has any: source file, label, beginning of a label, part of a label."""
    q = query.lower()
    label = F.lower("label")
    tier = F.when(F.lower("source_file") == q, 0).when((label == q) | (text.callable_label(F.col("label")) == q), 1).when(label.startswith(q), 2).when(label.contains(q), 3)
    hits = nodes.select("id", tier.alias("tier")).where("tier IS NOT NULL")
    return hits.join(F.broadcast(hits.agg(F.min("tier").alias("tier"))), "tier", "left_semi").select("id", "tier")


def vocabulary(docs: DataFrame) -> DataFrame:
    """``(word, n, span)``: tokens, whole labels, and runs of two or three tokens; ``span`` marks what is only such a run."""
    plain = F.when((F.size("tokens") > 2) & (F.element_at("tokens", -1) == F.array_join(F.slice("tokens", 1, F.size("tokens") - 1), "")), F.slice("tokens", 1, F.size("tokens") - 1)).otherwise(F.col("tokens"))

    def run(k: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.greatest(F.size("plain") - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice("plain", i, k), ""))
        return F.when(F.size("plain") >= k, joined).otherwise(F.array().cast("array<string>"))

    docs = docs.where(F.size("tokens") > 0).withColumn("plain", plain)
    words = F.transform(F.array_distinct("tokens"), lambda w: F.struct(w.alias("word"), F.lit(False).alias("span")))
    spans = F.transform(F.array_except(F.concat(run(2), run(3)), "tokens"), lambda w: F.struct(w.alias("word"), F.lit(True).alias("span")))
    return docs.select(F.explode(F.concat(words, spans)).alias("w")).groupBy("w.word").agg(F.count("*").alias("n"), F.min("w.span").alias("span"))


def osa(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no part edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + (x != y))
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def abbreviation(short: str, word: str) -> int | None:
    """How well the letters of ``short`` stand in ``word`` in their order: close together and at its beginning; None if they don't."""
    total, last = 0, -1
    for c in short:
        at = word.find(c, last + 1)
        if at < 0:
            return None
        skipped = at - last - 1
        # A letter right behind the one before is worth 9, any other 3 less what was skipped.
        total += 9 if not skipped else 3 - skipped
        last = at
    return total + (60 if word.startswith(short) else 0)


def correct(term: str, words: DataFrame) -> DataFrame:
    """``(word, distance)`` that a term no label has may stand for: the closest word by edits, ties by word; else, for up to five letters, the word it
    abbreviates best (distance null), ties by word. None for a known word or one of less than three letters."""
    most = 1 if len(term) <= 4 else 2
    none = words.select("word", F.lit(0).alias("distance")).limit(0)
    if len(term) < 3 or not words.where(F.col("word") == term).isEmpty():
        return none

    @F.pandas_udf(T.IntegerType())
    def far(values: pd.Series) -> pd.Series:
        return values.map(lambda w: osa(term, w)).astype("int32")

    @F.pandas_udf(T.IntegerType())
    def likely(values: pd.Series) -> pd.Series:
        return pd.Series([abbreviation(term, w) for w in values], dtype="Int32")

    near = words.where(F.abs(F.length("word") - len(term)) <= most).select("word", far("word").alias("distance")).where(F.col("distance") <= most)
    best = near.orderBy("distance", "word").limit(1)
    if len(term) > 5 or not best.isEmpty():
        return best
    short = words.where(~F.col("span") & (F.length("word") >= 2 * len(term))).select("word", likely("word").alias("score")).where("score IS NOT NULL")
    return short.orderBy(F.desc("score"), "word").limit(1).select("word", F.lit(None).cast("int").alias("distance"))


def fuzzy_substring(nodes: DataFrame, term: str, top: int = 5) -> DataFrame:
    """``(id, distance)``: labels that hold something like the term, within a third of its length."""
    most = max(1, len(term) // 3)

    @F.pandas_udf(T.IntegerType())
    def far(values: pd.Series) -> pd.Series:
        def one(label: str) -> int:
            row = [0] * (len(label) + 1)
            for i, c in enumerate(term, 1):
                new = [i]
                for j, x in enumerate(label, 1):
                    new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
                row = new
            return min(row)

        return values.fillna("").str.lower().map(one).astype("int32")

    return nodes.select("id", far("label").alias("distance")).where(F.col("distance") <= most).orderBy("distance", "id").limit(top)


def path_scope(nodes: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Nodes whose source file begins with one of ``include`` (if any) and none of ``exclude``."""
    begins = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.coalesce(F.col("source_file").startswith(p), F.lit(False)))
    out = nodes.where(begins(include)) if include else nodes
    return out.where(~begins(exclude)) if exclude else out


def fill_seeds(seeds: DataFrame, scored: DataFrame, community: DataFrame, covered: DataFrame, most: int = MAX_COMMUNITIES) -> DataFrame:
    """Seeds and the best of further communities, by how many of the question's terms they cover ``(id, coverage)``, then by score."""
    c = scored.join(community, "id").join(covered, "id", "left").fillna(0, ["coverage"])
    used = c.join(seeds.select("id"), "id", "left_semi").select("community").distinct()
    more = first_by(c.join(used, "community", "left_anti"), ["community"], F.desc("coverage"), F.desc("score"), "id").select("id", "score", F.lit(1).alias("later"), "coverage")
    both = seeds.select("id", "score", F.lit(0).alias("later"), F.lit(0).alias("coverage")).union(more)
    return both.orderBy("later", F.desc("coverage"), F.desc("score"), "id").limit(most).select("id", "score")


def coverage(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """``(id, coverage)``: how many of the terms a node's label or source file holds."""
    held = [(F.lower("label").contains(t) | F.lower(F.coalesce("source_file", F.lit(""))).contains(t)).cast("int") for t in terms]
    return nodes.select("id", sum(held, F.lit(0)).alias("coverage"))


def trigram_candidates(nodes: DataFrame, needles: list[str], share: float = 0.1) -> DataFrame | None:
    """``(id)`` of labels that have every three-letter run of some needle, or None where the rarest run of one is in too many labels to be worth it.

    A superset of the labels that hold a needle: it only narrows what is scored. The runs are few literals, so nothing is joined.
    """
    low = F.lower(F.coalesce("label", F.lit("")))
    runs = {n: sorted({n[i : i + 3] for i in range(len(n) - 2)}) for n in needles}
    if not needles or not all(runs.values()):
        return None
    every = sorted({r for rs in runs.values() for r in rs})
    seen = nodes.agg(F.count("*").alias("n"), *[F.count_if(low.contains(r)).alias(f"r{i}") for i, r in enumerate(every)]).first()
    if any(min(seen[f"r{every.index(r)}"] for r in rs) > share * seen["n"] for rs in runs.values()):
        return None
    hit = F.lit(False)
    for rs in runs.values():
        one = F.lit(True)
        for r in rs:
            one = one & low.contains(r)
        hit = hit | one
    return nodes.where(hit).select("id")


def find_seeds(nodes: DataFrame, terms: list[str], vectors: DataFrame | None = None, query: list[float] | None = None) -> tuple[DataFrame, str]:
    """Scored seeds and how they were found: by words, a correction, something similar in letters, or in meaning (``vectors (id, v)``)."""
    scored = score(nodes, terms)
    if not scored.isEmpty():
        return scored, "words"
    words = vocabulary(corpus(nodes))
    fixed = [r["word"] for t in terms for r in correct(t, words).collect()]  # one row each
    if fixed and not (scored := score(nodes, fixed)).isEmpty():
        return scored, "correction"
    long = [t for t in terms if len(t) >= 4]
    near = [fuzzy_substring(nodes, t).select("id", (1.0 / (1 + F.col("distance"))).alias("score")) for t in long]
    if near:
        together = near[0]
        for n in near[1:]:
            together = together.union(n)
        together = together.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(5)
        if not together.isEmpty():
            return together, "letters"
    if vectors is not None and query is not None:
        meant = cosine_top(vectors, query, 3, LEAST_COSINE).withColumnRenamed("similarity", "score")
        if not meant.isEmpty():
            return meant, "meaning"
    return scored, "none"


def ask(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 2, vectors: DataFrame | None = None, query: list[float] | None = None) -> DataFrame:
    """``(id, label, hop, score, degree)``: seeds and their surroundings, nearest first, then best, then best connected, then by id."""
    from loomgraph.operators.graph import degrees
    from loomgraph.operators.traversal import bfs

    terms = query_terms(question)
    scored, _ = find_seeds(nodes, terms, vectors, query)
    kept = filter_context(edges, question_contexts(question)) if "context" in edges.columns else edges
    found, _ = bfs(kept, pick_seeds(scored), depth)
    j = found.join(nodes.select("id", "label"), "id").join(scored, "id", "left").join(degrees(kept), "id", "left")
    return j.select("id", "label", "hop", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("degree", F.lit(0)).alias("degree")).orderBy("hop", F.desc("score"), F.desc("degree"), "id")
