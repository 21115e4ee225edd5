"""Pictures of a graph: a bounded part of it is collected, placed and drawn as SVG, or as a page that can be searched.

Graphs of more nodes than the bound are drawn by community: a circle each, lines for the edges between them.
"""

from __future__ import annotations

import html
import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import analysis
from loomgraph.operators.graph import degrees, simple

#: Nodes drawn one by one at most.
MOST_NODES = 1500
_COLOURS = ("#4e79a7", "#f28e2b", "#59a14f", "#e15759", "#76b7b2", "#edc948", "#b07aa1", "#9c755f", "#ff9da7", "#bab0ac")


def _part(nodes: DataFrame, edges: DataFrame, community: DataFrame, most: int) -> tuple[list[tuple], list[tuple]]:
    """(id, label, size, group, note) of what is drawn, and (a, b, weight) between."""
    if nodes.limit(most + 1).count() <= most:
        held = nodes.select("id", "label", "source_file").join(degrees(edges), "id", "left").join(community, "id", "left").orderBy("id").collect()
        dots = [(r["id"], r["label"] or r["id"], r["degree"] or 0, r["community"] or 0, r["source_file"] or "") for r in held]
        return dots, [(r["a"], r["b"], 1) for r in simple(edges).where("a <> b").join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi").orderBy("a", "b").collect()]
    size = community.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(most)
    named = size.join(analysis.hub_labels(nodes, edges, community), "community", "left").orderBy(F.desc("n"), "community").collect()
    keep = size.select("community")
    links = analysis.community_links(edges, community).join(keep.toDF("c1"), "c1", "left_semi").join(keep.toDF("c2"), "c2", "left_semi")
    dots = [(str(r["community"]), r["label"] or f"Community {r['community']}", r["n"], r["community"], f"{r['n']} members") for r in named]
    return dots, [(str(r["c1"]), str(r["c2"]), r["n"]) for r in links.orderBy(F.desc("n"), "c1", "c2").limit(5 * most).collect()]


def place(n: int, links: Sequence[tuple[int, int]], rounds: int = 60) -> np.ndarray:
    """Positions in the unit square: linked nodes draw each other near, all push each other away; the same graph is always placed alike."""
    if n < 2:
        return np.full((n, 2), 0.5)
    angle = np.arange(n) * 2.399963
    at = 0.5 + 0.45 * np.sqrt((np.arange(n) + 0.5) / n)[:, None] * np.c_[np.cos(angle), np.sin(angle)]
    pairs, k = np.array(links, int).reshape(-1, 2), 1 / math.sqrt(n)
    for step in range(rounds):
        away = at[:, None] - at[None]
        far = np.maximum((away**2).sum(2), 1e-6)
        move = (away / far[..., None]).sum(1) * k * k
        if len(pairs):
            pull = at[pairs[:, 1]] - at[pairs[:, 0]]
            force = pull * np.sqrt((pull**2).sum(1, keepdims=True)) / k
            np.add.at(move, pairs[:, 0], force)
            np.add.at(move, pairs[:, 1], -force)
        length = np.maximum(np.sqrt((move**2).sum(1, keepdims=True)), 1e-9)
        at += move / length * np.minimum(length, 0.1 * (1 - step / rounds))
    low, high = at.min(0), at.max(0)
    return 0.05 + 0.9 * (at - low) / np.maximum(high - low, 1e-9)


def svg(nodes: DataFrame, edges: DataFrame, community: DataFrame, most: int = MOST_NODES, width: int = 1200, height: int = 900) -> str:
    """A picture; circles grow with degree or members, colours tell communities."""
    dots, links = _part(nodes, edges, community, most)
    index = {d[0]: i for i, d in enumerate(dots)}
    at = place(len(dots), [(index[a], index[b]) for a, b, _ in links]) * (width, height)
    top = max((d[2] for d in dots), default=1) or 1
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">']
    for a, b, w in links:
        (x1, y1), (x2, y2) = at[index[a]], at[index[b]]
        out.append(f'<line x1="{x1:.1f}" y1="{y1:.1f}" x2="{x2:.1f}" y2="{y2:.1f}" stroke="#999" stroke-opacity="0.5" stroke-width="{min(6, 0.5 + math.log1p(w) / 2):.1f}"/>')
    for (i, label, size, group, note), (x, y) in zip(dots, at, strict=True):
        out.append(f'<circle id="{html.escape(i)}" cx="{x:.1f}" cy="{y:.1f}" r="{4 + 14 * math.sqrt(size / top):.1f}" fill="{_COLOURS[hash_colour(group)]}"><title>{html.escape(f"{label} {note}".strip())}</title></circle>')
    for (_, label, _, _, _), (x, y) in [p for _, p in sorted(enumerate(zip(dots, at, strict=True)), key=lambda p: (-p[1][0][2], p[0]))][:40]:
        out.append(f'<text x="{x + 6:.1f}" y="{y - 6:.1f}" font-size="11" font-family="sans-serif">{html.escape(label[:40])}</text>')
    return "\n".join([*out, "</svg>"])


def hash_colour(group) -> int:
    return (group if isinstance(group, int) else sum(map(ord, str(group)))) % len(_COLOURS)


def page(nodes: DataFrame, edges: DataFrame, community: DataFrame, title: str = "Graph", most: int = MOST_NODES, verdicts: DataFrame | None = None) -> str:
    """The picture in a page of its own, with a search field that dims what doesn't match. ``verdicts (id, status)`` are shown in the list."""
    picture = svg(nodes, edges, community, most)
    status = {r["id"]: r["status"] for r in verdicts.limit(most).collect()} if verdicts is not None else {}
    data = json.dumps(status).replace("</", "<\\/")
    script = """const s=%s;for(const c of document.querySelectorAll('circle'))if(s[c.id])c.firstChild.textContent+=' ['+s[c.id]+']';
document.getElementById('q').addEventListener('input',e=>{const t=e.target.value.toLowerCase();for(const c of document.querySelectorAll('circle'))c.style.opacity=!t||c.textContent.toLowerCase().includes(t)?1:0.1})""" % data
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><input id="q" placeholder="search">{picture}<script>{script}</script></body></html>'


def tree(nodes: DataFrame, title: str = "Files", most: int = 5000) -> str:
    """Folders and files with the number of nodes in each, as nested lists; the largest ``most`` prefixes."""
    rows = analysis.directory_rollup(nodes).orderBy(F.desc("n"), "prefix").limit(most).collect()
    below: dict[str, list] = {}
    for r in rows:
        below.setdefault(r["prefix"].rpartition("/")[0], []).append((r["prefix"], r["n"]))

    def shown(prefix: str) -> str:
        inner = "".join(f"<li>{html.escape(p.rpartition('/')[2])} ({n}){shown(p)}</li>" for p, n in sorted(below.get(prefix, []), key=lambda x: (-x[1], x[0])))
        return f"<ul>{inner}</ul>" if inner else ""

    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{shown("")}</body></html>'


def call_flow(nodes: DataFrame, edges: DataFrame, sections: DataFrame, most: int = 24) -> str:
    """A page with a diagram a section ``(id, section)``: its chosen nodes and the edges among them, then how many edges run between sections."""
    from loomgraph.operators import resolve

    out, names = [], [r["section"] for r in sections.groupBy("section").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section").limit(15).collect()]
    for name in names:
        own = sections.where(F.col("section") == name).select("id")
        inside = edges.join(own.toDF("src"), "src", "left_semi").join(own.toDF("dst"), "dst", "left_semi")
        chosen = analysis.diagram_nodes(nodes.join(own, "id", "left_semi"), inside, most).join(nodes.select("id", "label"), "id").orderBy("place").collect()
        kept = nodes.sparkSession.createDataFrame([(r["id"],) for r in chosen], "id string")
        lines = [f'  n{i}["{html.escape((r["label"] or r["id"])[:60])}"]' for i, r in enumerate(chosen)]
        number = {r["id"]: i for i, r in enumerate(chosen)}
        links = inside.join(kept.toDF("src"), "src", "left_semi").join(kept.toDF("dst"), "dst", "left_semi").select("src", "dst", "relation").distinct().orderBy("src", "dst", "relation").limit(3 * most).collect()
        lines += [f"  n{number[r['src']]} -->|{r['relation']}| n{number[r['dst']]}" for r in links]
        out.append(f"<h2>{html.escape(str(name))}</h2><pre class=\"mermaid\">flowchart LR\n" + "\n".join(lines) + "</pre>")
    between = analysis.section_summary(resolve.classify_sections(edges, sections)).orderBy(F.desc("n"), "section_a", "section_b", "relation").limit(100).collect()
    table = "".join(f"<tr><td>{html.escape(str(r['section_a']))}</td><td>{html.escape(str(r['section_b']))}</td><td>{html.escape(r['relation'])}</td><td>{r['n']}</td></tr>" for r in between)
    return f"<!doctype html><html><head><meta charset=\"utf-8\"><title>Call flow</title></head><body><h1>Call flow</h1>{''.join(out)}<h2>Between sections</h2><table>{table}</table></body></html>"
