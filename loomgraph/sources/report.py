"""Reports for readers: only ranked, bounded results are collected and rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import analysis, search


def markdown(nodes: DataFrame, edges: DataFrame, community: DataFrame, title: str = "Graph report") -> str:
    """Counts, certainty, central entities, surprises, communities and questions."""
    s = analysis.graph_stats(nodes, edges).first()
    out = [f"# {title}", "", f"{s['nodes']} nodes, {s['edges']} edges, {s['communities']} communities", "", "## Certainty"]
    out += [f"- {r['confidence']}: {r['n']} ({r['percent']}%)" for r in analysis.confidence_breakdown(edges).orderBy("confidence").collect()]
    out += ["", "## Central entities"] + [f"- `{r['label']}`: {r['degree']} connections" for r in analysis.god_nodes(nodes, edges).collect()]
    out += ["", "## Surprising connections"] + [f"- `{r['src']}` {r['relation']} `{r['dst']}` ({r['confidence']}, score {r['score']})" for r in analysis.surprising(nodes, edges, community).collect()]
    named = analysis.cohesion(edges, community).join(analysis.hub_labels(nodes, edges, community), "community").orderBy(F.desc("n"), "community").limit(50)
    out += ["", "## Communities"] + [f"- {r['label']}: {r['n']} members, cohesion {r['cohesion']:.2f}" for r in named.collect()]
    out += ["", "## Questions"] + [f"- {r['question']}" for r in analysis.questions(nodes, edges, community).collect()]
    return "\n".join(out)


def answer(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 2, tokens: int = 2000) -> str:
    """Lines of the surroundings of a question's best matches, nearest first, within a budget."""
    found = search.ask(nodes, edges, question, depth).join(nodes.select("id", "source_file", "source_location"), "id")
    line = F.concat(F.lit("NODE "), "label", F.lit(" ["), F.coalesce("source_file", F.lit("")), F.lit(" "), F.coalesce("source_location", F.lit("")), F.lit("]"))
    rows = found.select(F.lit(0).alias("group"), F.struct("hop", (-F.col("score")).alias("back"), "id").alias("place"), line.alias("line"))
    # Every line is a character at least, so no more than this many can fit.
    few = rows.orderBy("place").limit(4 * tokens)
    return "\n".join(r["line"] for r in analysis.within_budget(few, tokens).orderBy("place").collect())


def token_cost(nodes: DataFrame, edges: DataFrame, question: str, depth: int = 3) -> int:
    """Tokens (four characters each) of what a plain search from the three labels with most of a question's words reaches."""
    from loomgraph.operators import traversal

    terms = search.query_terms(question)
    hits = sum((F.col("low").contains(t).cast("int") for t in terms), F.lit(0))
    seeds = nodes.select("id", F.lower("label").alias("low")).select("id", hits.alias("n")).where("n > 0").orderBy(F.desc("n"), F.desc("id")).limit(3)
    found = traversal.hops(edges, seeds, depth)
    held = found.join(nodes.select("id", "label", "source_file", "source_location"), "id")
    line = F.length(F.concat_ws(" ", F.lit("NODE"), "label", F.concat(F.lit("src="), F.coalesce("source_file", F.lit(""))), F.concat(F.lit("loc="), F.coalesce("source_location", F.lit("")))))
    a, b = found.toDF("src", "ha"), found.toDF("dst", "hb")
    label = nodes.select("id", "label")
    links = edges.join(a, "src").join(b, "dst").where("abs(ha - hb) = 1").join(label.toDF("src", "la"), "src").join(label.toDF("dst", "lb"), "dst")
    text = F.length(F.concat(F.lit("EDGE "), "la", F.lit(" --"), "relation", F.lit("--> "), "lb"))
    total = held.agg(F.coalesce(F.sum(line + 1), F.lit(0))).first()[0] + links.agg(F.coalesce(F.sum(text + 1), F.lit(0))).first()[0]
    return max(0, total - 1) // 4
