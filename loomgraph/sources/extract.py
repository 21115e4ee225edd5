"""Extractors: a text becomes nodes and edges. Each is a function registered for suffixes; one map over files runs them all.

Sources are parsed with expressions or the standard library; a file that can't be parsed gives its file node alone.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import plain_id

NODE, EDGE, CALL, VALUE = "node", "edge", "call", "value"
SCHEMA = "kind string, id string, label string, file_type string, src string, dst string, relation string, source_file string, source_location string"
Extractor = Callable[[str, str], Iterator[tuple]]
_BY_SUFFIX: dict[str, Extractor] = {}
_BY_NAME: dict[str, Extractor] = {}


def register(*suffixes: str, names: tuple[str, ...] = ()) -> Callable[[Extractor], Extractor]:
    """Adds an extractor for file suffixes and names; a later one replaces an earlier one."""

    def add(f: Extractor) -> Extractor:
        _BY_SUFFIX.update(dict.fromkeys(suffixes, f))
        _BY_NAME.update(dict.fromkeys(names, f))
        return f

    return add


def file_id(path: str) -> str:
    """A file's id: its whole path without the extension."""
    return plain_id(re.sub(r"\.[^./]+$", "", path))


def _line(text: str, at: int) -> str:
    return f"L{text.count(chr(10), 0, at) + 1}"


def _child(path: str, name: str, line: str, owner: str | None = None, relation: str = "contains", kind: str = "code", label: str | None = None) -> Iterator[tuple]:
    owner = owner or file_id(path)
    own = plain_id(f"{owner}_{name}")
    yield (NODE, own, label or name, kind, None, None, None, path, line)
    yield (EDGE, None, None, None, owner, own, relation, path, line)


def _link(path: str, src: str, dst: str, relation: str, line: str) -> tuple:
    return (EDGE, None, None, None, src, dst, relation, path, line)


#: Marks of comments that say why.
_NOTE = re.compile(r"#\s*(NOTE|WHY|HACK|IMPORTANT|RATIONALE|TODO|FIXME):?\s*(.+)")


@register(".py", ".pyw", ".pyi")
def python(path: str, text: str) -> Iterator[tuple]:
    """Classes, functions, methods (nested ones too), imports, calls by name, functions named as values, docstrings and notes."""
    tree, me = ast.parse(text), file_id(path)

    def why(node: ast.AST, owner: str) -> Iterator[tuple]:
        doc = ast.get_docstring(node)
        if doc and len(doc) >= 20:
            own = f"{owner}_rationale"
            yield (NODE, own, doc.split("\n\n")[0][:80], "rationale", None, None, None, path, f"L{getattr(node, 'lineno', 1)}")
            yield _link(path, own, owner, "rationale_for", f"L{getattr(node, 'lineno', 1)}")

    scopes: list[tuple[int, int, str]] = []

    def own_nodes(body: list[ast.AST]) -> Iterator[ast.AST]:
        """All below, but not what belongs to a class or function within."""
        for x in body:
            yield x
            if not isinstance(x, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                yield from own_nodes(list(ast.iter_child_nodes(x)))
            else:
                yield from own_nodes(list(x.decorator_list))

    def uses(body: list[ast.stmt], owner: str, bound: set[str]) -> Iterator[tuple]:
        """Calls by name, and names that stand as values where a function may be meant: arguments, values of collections, assignments, results, attributes by name."""

        def named(value: ast.AST | None) -> Iterator[tuple]:
            if isinstance(value, ast.Name) and value.id not in bound:
                yield (CALL, None, value.id, None, owner, None, "indirect_call", path, f"L{value.lineno}")

        for n in own_nodes(body):
            if isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name and name not in bound:
                    yield (CALL, None, name, None, owner, None, "calls", path, f"L{n.lineno}")
                if name == "getattr" and len(n.args) > 1 and isinstance(n.args[1], ast.Constant) and isinstance(n.args[1].value, str):
                    yield (CALL, None, n.args[1].value, None, owner, None, "indirect_call", path, f"L{n.lineno}")
                for a in (*n.args, *(k.value for k in n.keywords)):
                    yield from named(a)
            elif isinstance(n, ast.Dict):
                for v in n.values:
                    yield from named(v)
            elif isinstance(n, (ast.List, ast.Tuple, ast.Set)) and isinstance(getattr(n, "ctx", ast.Load()), ast.Load):
                for v in n.elts:
                    yield from named(v)
            elif isinstance(n, (ast.Assign, ast.Return)):
                yield from named(n.value)

    def assigned(body: list[ast.stmt]) -> set[str]:
        return {n.id for n in own_nodes(body) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}

    def walk(body: list[ast.stmt], owner: str, in_class: bool, bound: set[str]) -> Iterator[tuple]:
        for x in own_nodes(body):
            if isinstance(x, ast.ClassDef):
                yield from _child(path, x.name, f"L{x.lineno}", owner)
                own = plain_id(f"{owner}_{x.name}")
                scopes.append((x.lineno, x.end_lineno or x.lineno, own))
                yield from why(x, own)
                for base in x.bases:
                    if isinstance(base, (ast.Name, ast.Attribute)):
                        yield (CALL, None, ast.unparse(base), None, own, None, "inherits", path, f"L{x.lineno}")
                yield from walk(x.body, own, True, bound)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield from _child(path, x.name, f"L{x.lineno}", owner, "method" if in_class else "contains", label=f".{x.name}()" if in_class else f"{x.name}()")
                own = plain_id(f"{owner}_{x.name}")
                scopes.append((x.lineno, x.end_lineno or x.lineno, own))
                yield from why(x, own)
                a = x.args
                local = bound | {v.arg for v in (*a.args, *a.kwonlyargs, *a.posonlyargs, *filter(None, (a.vararg, a.kwarg)))} | assigned(x.body)
                yield from uses(x.body, own, local)
                yield from walk(x.body, own, False, local)
            elif isinstance(x, ast.Import):
                for name in x.names:
                    yield _link(path, me, plain_id(name.name), "imports", f"L{x.lineno}")
            elif isinstance(x, ast.ImportFrom):
                folder = path.split("/")[: -x.level] if x.level else []
                module = [x.module.replace(".", "/")] if x.module else []
                for to in ["/".join(folder + module)] if module or not x.level else ["/".join([*folder, n.name]) for n in x.names]:
                    yield _link(path, me, plain_id(to), "imports_from", f"L{x.lineno}")

    yield from why(tree, me)
    yield from walk(tree.body, me, False, set())
    yield from uses(tree.body, me, assigned(tree.body))
    for number, line in enumerate(text.split("\n"), 1):
        if (m := _NOTE.search(line)) and len(m[2]) >= 20:
            owner = max(((a, own) for a, b, own in scopes if a <= number <= b), default=(0, me))[1]
            own = f"{owner}_rationale_{number}"
            yield (NODE, own, m[2].strip()[:80], "rationale", None, None, None, path, f"L{number}")
            yield _link(path, own, owner, "rationale_for", f"L{number}")


def by_patterns(*patterns: tuple[str, str, str], imports: str | None = None) -> Extractor:
    """An extractor of named things by line patterns ``(expression, label form, relation)``; the name is the last group that matched."""
    compiled = [(re.compile(p, re.M), form, relation) for p, form, relation in patterns]
    taken = re.compile(imports, re.M) if imports else None

    def run(path: str, text: str) -> Iterator[tuple]:
        for pattern, form, relation in compiled:
            for m in pattern.finditer(text):
                name = next(g for g in reversed(m.groups()) if g)
                yield from _child(path, name, _line(text, m.start()), relation=relation, label=form.format(name))
        for m in taken.finditer(text) if taken else ():
            yield _link(path, file_id(path), plain_id(next(g for g in m.groups() if g)), "imports_from", _line(text, m.start()))

    return run


register(".html", ".htm")(by_patterns((r"""<\w+[^>]*\sid=["']([^"']+)["']""", "#{}", "contains")))
register(".sql")(by_patterns((r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)", "{}", "contains"), imports=r"(?i)\breferences\s+([\w.\"]+)"))
register(".md", ".mdx", ".qmd")(by_patterns((r"^#{1,6}\s+(.+?)\s*$", "{}", "contains"), imports=r"\]\(([^)\s#]+\.md)"))


@register(".dockerfile", names=("Dockerfile", "Containerfile"))
def dockerfile(path: str, text: str) -> Iterator[tuple]:
    """Stages and their images."""
    for i, m in enumerate(re.finditer(r"(?im)^FROM\s+(\S+)(?:\s+AS\s+(\S+))?", text)):
        stage = m[2] or f"stage{i}"
        yield from _child(path, stage, _line(text, m.start()))
        yield _link(path, plain_id(f"{file_id(path)}_{stage}"), plain_id(m[1]), "depends_on", _line(text, m.start()))


@register(".toml")
def toml(path: str, text: str) -> Iterator[tuple]:
    """Tables and their keys."""
    data = tomllib.loads(text)
    for name, value in data.items():
        yield from _child(path, name, "L1")
        for key in value if isinstance(value, dict) else ():
            yield from _child(path, key, "L1", plain_id(f"{file_id(path)}_{name}"))


@register(".json")
def json_keys(path: str, text: str) -> Iterator[tuple]:
    """Top keys; servers, packages and variables of tool configurations."""
    data = json.loads(text)
    for key, value in data.items() if isinstance(data, dict) else ():
        yield from _child(path, key, "L1")
        for name, server in value.items() if key == "mcpServers" and isinstance(value, dict) else ():
            yield from _child(path, name, "L1", plain_id(f"{file_id(path)}_{key}"))
            own = plain_id(f"{file_id(path)}_{key}_{name}")
            for arg in server.get("args", []):
                if isinstance(arg, str) and not arg.startswith("-"):
                    yield _link(path, own, plain_id(f"pkg_{arg}"), "references", "L1")
            for variable in server.get("env", {}):
                yield _link(path, own, plain_id(f"env_{variable}"), "requires_env", "L1")


def one_file(path: str, text: str) -> list[tuple]:
    """All rows of one file, its own node first."""
    name = path.rsplit("/", 1)[-1]
    found = _BY_NAME.get(name) or next((f for s, f in sorted(_BY_SUFFIX.items(), key=lambda x: -len(x[0])) if name.lower().endswith(s)), None)
    rows = [(NODE, file_id(path), name, "document" if name.endswith((".md", ".mdx")) else "code", None, None, None, path, "L1")]
    try:
        return rows + list(found(path, text) if found else ())
    except (SyntaxError, ValueError, AttributeError, TypeError, RecursionError):
        return rows


def extract(files: DataFrame) -> DataFrame:
    """Nodes, edges and unresolved calls of files ``(path, text)`` as one table (see ``SCHEMA``); null text is empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for part in parts:
            yield pd.DataFrame([r for p, t in zip(part["path"], part["text"].fillna(""), strict=True) for r in one_file(p, t)], columns=names)

    return files.where("path IS NOT NULL").select("path", "text").mapInPandas(run, SCHEMA)


def fragments(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and calls ``(caller, callee, relation, file)`` of extracted rows."""
    nodes = rows.where(F.col("kind") == NODE).select("id", "label", "file_type", "source_file", "source_location").dropDuplicates(["id"])
    edges = rows.where(F.col("kind") == EDGE).select("src", "dst", "relation", F.lit("EXTRACTED").alias("confidence"), "source_file", "source_location").distinct()
    return nodes, edges, rows.where(F.col("kind") == CALL).select(F.col("src").alias("caller"), F.col("label").alias("callee"), "relation", F.col("source_file").alias("file")).distinct()


def values(rows: DataFrame) -> DataFrame:
    """``(value, node_id, source_file, line)``: values of extracted rows that name things elsewhere."""
    return rows.where(F.col("kind") == VALUE).select(F.col("label").alias("value"), F.col("src").alias("node_id"), "source_file", F.substring("source_location", 2, 12).cast("int").alias("line"))


from loomgraph.sources import formats  # noqa: E402, F401  it registers its extractors
