"""Extractors of languages by their declarations, and of configuration by its structure. Registered when ``extract`` is imported.

Declarations are found by patterns, their extent by braces or indentation; within it, calls by name are left for resolution.
"""

from __future__ import annotations

import posixpath
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

from loomgraph.functions.text import plain_id
from loomgraph.sources.extract import CALL, EDGE, NODE, VALUE, _child, _line, _link, file_id, register

_NAME = r"([A-Za-z_$][\w$]*)"
#: Words before a bracket that call nothing.
_KEYWORDS = frozenset((
    "if", "for", "while", "switch", "return", "catch", "function", "func", "fn", "def", "defp", "sizeof", "new", "and", "or", "not", "in", "elif", "else", "match", "when", "case", "do", "end",
    "super", "this", "self", "typeof", "await", "async", "throw", "unless", "until", "class", "struct", "trigger", "select", "try", "with", "assert", "print", "defmodule", "foreach", "using", "lock",
))


@dataclass
class Symbol:
    name: str
    kind: str
    at: int
    indent: int
    end: int = 0
    id: str = ""
    owner: Symbol | None = None


@dataclass
class Language:
    """Patterns with one group, the name: of containers and of functions; of imports; of bases of a container; braces or not."""

    containers: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()
    imports: str | None = None
    bases: str | None = None
    braces: bool = True
    call: str = r"(?<![\w$])([A-Za-z_$][\w$]*[?!]?)\s*\("
    receiver: str | None = None
    parsed: dict = field(default_factory=dict)

    def symbols(self, text: str) -> list[Symbol]:
        found: dict[int, Symbol] = {}
        for kind, patterns in (("container", self.containers), ("function", self.functions)):
            for p in patterns:
                for m in re.finditer(p, text, re.M):
                    name = next((g for g in m.groups() if g), None)
                    at = m.start() + len(m[0]) - len(m[0].lstrip())
                    if name and name not in _KEYWORDS and at not in found:
                        found[at] = Symbol(name, kind, at, at - text.rfind("\n", 0, at) - 1)
        out = [found[k] for k in sorted(found)]
        for s in out:
            s.end = _brace_end(text, s.at) if self.braces else _indent_end(text, s)
        for i, s in enumerate(out):
            s.owner = next((o for o in reversed(out[:i]) if o.at < s.at < o.end), None)
        return out

    def __call__(self, path: str, text: str) -> Iterator[tuple]:
        symbols, me = self.symbols(text), file_id(path)
        for s in symbols:
            within = s.owner and s.owner.kind == "container"
            owner = s.owner.id if s.owner else me
            s.id = plain_id(f"{owner}_{s.name}")
            label = s.name if s.kind == "container" else f".{s.name}()" if within else f"{s.name}()"
            yield from _child(path, s.name, _line(text, s.at), owner, "method" if within and s.kind == "function" else "contains", label=label)
            head = text[s.at : s.at + 400].split("{")[0].split("\n")[0]
            for base in re.findall(self.bases, head) if self.bases and s.kind == "container" else ():
                for name in re.split(r"\s*,\s*", base if isinstance(base, str) else next(b for b in base if b)):
                    if name := re.sub(r"<.*|\(.*", "", name.strip()):
                        yield (CALL, None, name, None, s.id, None, "inherits", path, _line(text, s.at))
        for m in re.finditer(self.imports, text, re.M) if self.imports else ():
            yield _link(path, me, plain_id(next(g for g in m.groups() if g)), "imports_from", _line(text, m.start()))
        functions, seen = [s for s in symbols if s.kind == "function"], set()
        for m in re.finditer(self.call, text) if functions else ():
            name = m[1]
            inside = [s for s in functions if s.at < m.start() < s.end]
            if inside and name not in _KEYWORDS and not any(s.at <= m.start() <= s.at + len(s.name) + 80 and s.name == name and text[m.start() - 1 : m.start()] in " \t&*" for s in symbols if _line(text, s.at) == _line(text, m.start())):
                caller = max(inside, key=lambda s: s.at)
                if (caller.id, name) not in seen:
                    seen.add((caller.id, name))
                    yield (CALL, None, name, None, caller.id, None, "calls", path, _line(text, m.start()))


def _brace_end(text: str, at: int) -> int:
    """Where the braces that open behind a declaration close; the end of its line if none do before it ends."""
    open_ = re.compile(r"[{;\n]").search(text, at)
    while open_ and open_[0] == "\n":
        rest = text[open_.end() :].lstrip()
        if not rest.startswith("{"):
            return open_.start()
        open_ = re.compile(r"\{").search(text, open_.end())
    if not open_ or open_[0] == ";":
        return open_.start() if open_ else len(text)
    depth = 0
    for m in re.compile(r"""[{}]|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])'|//[^\n]*""").finditer(text, open_.start()):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return len(text)


def _indent_end(text: str, s: Symbol) -> int:
    """The next line that isn't blank and is indented no more than the declaration."""
    at = text.find("\n", s.at)
    while at >= 0:
        line = text[at + 1 : (text.find("\n", at + 1) + len(text) + 1) % (len(text) + 1) or len(text)]
        if line.strip() and len(line) - len(line.lstrip()) <= s.indent:
            return at
        at = text.find("\n", at + 1)
    return len(text)


_MODS = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|sealed|override|async|virtual|global|pub(?:\([^)]*\))?|unsafe|open|data|partial|readonly|inline|const|extern|with sharing|without sharing)\s+)*"
GO = Language((rf"^type\s+{_NAME}\s+(?:struct|interface)",), (rf"^func\s+(?:\([^)]*\)\s*)?{_NAME}",), r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"\s]+)"\s*$')
RUST = Language((rf"^\s*{_MODS}(?:struct|enum|trait|impl(?:<[^>]*>)?(?:\s+\w+\s+for)?)\s+{_NAME}",), (rf"^\s*{_MODS}fn\s+{_NAME}",), r"^\s*(?:pub\s+)?use\s+([\w:]+)")
JAVA = Language((rf"^\s*(?:@\w+\s+)*{_MODS}(?:class|interface|enum|record|object|trait)\s+{_NAME}",), (rf"^\s+(?:@\w+\s+)*{_MODS}(?!new\b|return\b|throw\b|else\b)[\w<>\[\],.?]+\s+{_NAME}\s*\([^;{{]*\)\s*(?:throws [\w, .]+)?\{{", rf"^\s*{_MODS}(?:fun|def)\s+(?:<[^>]*>\s*)?{_NAME}"), r"^\s*(?:import|using)\s+(?:static\s+)?([\w.]+)", r"(?:extends|implements|:)\s+([\w<>., ]+?)(?=\s+(?:implements|where)|$|\s*\{)")
C = Language((rf"^\s*(?:typedef\s+)?(?:struct|class|enum|union|namespace)\s+{_NAME}\s*(?:[:{{]|$)",), (rf"^(?:[A-Za-z_][\w<>:*&]*\s+)+[*&]*(?:\w+::)?{_NAME}\s*\([^;{{]*\)\s*(?:const)?\s*\{{",), r'^\s*#\s*include\s+[<"]([^>"]+)[>"]', r":\s*(?:public|private|protected)?\s*([\w:]+)")
RUBY = Language((rf"^\s*(?:class|module)\s+{_NAME}",), (r"^\s*def\s+(?:self\.)?(\w+[?!]?)",), r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", r"<\s*([\w:]+)", False)
PHP = Language((rf"^\s*{_MODS}(?:class|interface|trait|enum)\s+{_NAME}",), (rf"^\s*{_MODS}function\s+&?{_NAME}",), r"^use\s+([\w\\]+)", r"(?:extends|implements)\s+([\w\\, ]+?)(?=\s+implements|$|\s*\{)")
SWIFT = Language((rf"^\s*{_MODS}(?:class|struct|enum|protocol|extension|actor)\s+{_NAME}",), (rf"^\s*{_MODS}func\s+{_NAME}",), r"^import\s+(\w+)", r":\s*([\w, ]+)")
ZIG = Language((r"^\s*(?:pub\s+)?const\s+(\w+)\s*=\s*(?:extern\s+|packed\s+)?(?:struct|enum|union)\b",), (r"^\s*(?:pub\s+)?(?:export\s+)?(?:inline\s+)?fn\s+(\w+)",), r'@import\("([^"]+)"\)')
ELIXIR = Language((r"^\s*defmodule\s+([\w.]+)",), (r"^\s*defp?\s+(\w+[?!]?)",), r"^\s*(?:alias|import|use|require)\s+([\w.]+)", None, False)
SHELL = Language((), (r"^\s*(?:function\s+)([\w.:-]+)", r"^([A-Za-z_][\w-]*)\s*\(\)\s*\{"), None, None, True, r"(?m)^\s+([A-Za-z_][\w-]*)(?=\s|$)")
FISH = Language((), (r"^\s*function\s+([\w.:-]+)",), None, None, False, r"(?m)^\s+([A-Za-z_][\w-]*)(?=\s|$)")
LUA = Language((), (r"^\s*(?:local\s+)?function\s+([\w.:]+)",), r"require\s*\(?\s*['\"]([\w./]+)['\"]", None, False)
JULIA = Language((r"^\s*(?:mutable\s+)?(?:struct|module)\s+(\w+)",), (r"^\s*function\s+(\w+!?)",), r"^\s*(?:using|import)\s+([\w.]+)", None, False)
DART = Language((rf"^\s*{_MODS}(?:class|mixin|enum|extension)\s+{_NAME}",), (rf"^\s*(?:[\w<>?]+\s+)+{_NAME}\s*\([^;{{]*\)\s*(?:async\s*)?\{{",), r"^import\s+['\"]([^'\"]+)['\"]", r"(?:extends|implements|with)\s+([\w, ]+?)(?=\s+(?:implements|with)|\s*\{|$)")
POWERSHELL = Language((rf"(?i)^\s*class\s+{_NAME}",), (r"(?i)^\s*function\s+([\w-]+)",), r"(?i)^\s*Import-Module\s+(\S+)", None, True, r"(?m)^\s+([A-Z]\w+-\w+)")
VERILOG = Language((r"^\s*(?:module|interface|package|class)\s+(\w+)",), (r"^\s*(?:function|task)\s+(?:automatic\s+)?(?:\[[^\]]*\]\s*)?(?:\w+\s+)?(\w+)\s*[(;]",), r'^\s*`include\s+"([^"]+)"', None, False)
FORTRAN = Language((r"(?i)^\s*(?:module|program)\s+(?!procedure\b)(\w+)",), (r"(?i)^\s*(?:pure\s+|elemental\s+|recursive\s+)*(?:subroutine|function)\s+(\w+)",), r"(?i)^\s*use\s+(\w+)", None, False, r"(?i)\bcall\s+(\w+)")
PASCAL = Language((r"(?i)^\s*(\w+)\s*=\s*(?:class|record|interface)\b",), (r"(?i)^\s*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+(?:\w+\.)?(\w+)",), None, r"(?i)class\s*\(([\w, ]+)\)", False)
OBJC = Language((rf"^@(?:interface|implementation|protocol)\s+{_NAME}",), (r"^[-+]\s*\([^)]*\)\s*(\w+)",), r'^\s*#\s*import\s+[<"]([^>"]+)[>"]', r":\s*(\w+)", True, r"\[\s*self\s+(\w+)")
GROOVY = Language((rf"^\s*{_MODS}(?:class|interface|enum|trait)\s+{_NAME}",), (rf"^\s*{_MODS}(?:def|void|\w+)\s+{_NAME}\s*\([^;{{]*\)\s*\{{",), r"^import\s+([\w.]+)", r"(?:extends|implements)\s+([\w, ]+?)(?=\s*\{|$)")
R_ = Language((), (r"^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\(",), r"^\s*(?:library|require)\((\w+)\)")
JS = Language((rf"^\s*{_MODS}(?:class|interface|enum)\s+{_NAME}",), (rf"^\s*{_MODS}function\s*\*?\s*{_NAME}", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", rf"^\s+{_MODS}{_NAME}\s*\([^;{{()]*\)\s*(?::\s*[\w<>\[\]| ]+)?\s*\{{"), r"""^\s*(?:import|export)\b[^'"\n]*['"]([^'"]+)['"]|require\(['"]([^'"]+)['"]\)""", r"(?:extends|implements)\s+([\w.<>, ]+?)(?=\s+implements|\s*\{|$)")

for suffixes, language in (
    ((".go",), GO), ((".rs",), RUST), ((".java", ".kt", ".kts", ".scala", ".cs"), JAVA), ((".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".cu", ".cuh", ".metal"), C), ((".rb",), RUBY), ((".php",), PHP), ((".swift",), SWIFT),
    ((".zig",), ZIG), ((".ex", ".exs"), ELIXIR), ((".fish",), FISH), ((".lua", ".luau"), LUA), ((".jl",), JULIA), ((".dart",), DART), ((".ps1", ".psm1"), POWERSHELL), ((".v", ".sv", ".svh"), VERILOG),
    ((".f", ".f90", ".f95", ".f03", ".f08"), FORTRAN), ((".pas", ".pp", ".dpr", ".lpr"), PASCAL), ((".m", ".mm"), OBJC), ((".groovy", ".gradle"), GROOVY), ((".r",), R_),
):
    register(*suffixes)(language)


@register(".js", ".jsx", ".mjs", ".ts", ".tsx", ".vue", ".svelte", ".astro", ".gs", ".ejs")
def javascript(path: str, text: str) -> Iterator[tuple]:
    """Classes, functions and calls; test blocks with a literal name; items of arrays of content (three or more objects of three or more keys, each with a name)."""
    yield from JS(path, text)
    for m in re.finditer(r"""(?m)^\s*(?:test|it|describe)(?:\.\w+)*\(\s*(['"])((?:(?!\1).)+)\1""", text):
        line = _line(text, m.start())
        yield from _child(path, f"test_{line}_{m[2]}", line, label=m[2])
    for m in re.finditer(rf"(?m)^(?:export\s+)?const\s+{_NAME}\s*(?::[^=]+)?=\s*\[", text):
        items, at, depth, begin = [], m.end(), 0, 0
        for t in re.compile(r"""[{}\]]|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`""").finditer(text, at):
            if t[0] == "{":
                begin, depth = (t.end() if not depth else begin), depth + 1
            elif t[0] == "}":
                depth -= 1
                if not depth:
                    items.append((begin, text[begin : t.start()]))
            elif t[0] == "]" and not depth:
                break
        named = [(b, re.findall(r"(?:^|[,{\n])\s*['\"]?(\w+)['\"]?\s*:", body), re.search(r"""(?:^|[,\s])['"]?(?:title|name|label|description|id)['"]?\s*:\s*(['"`])(.*?)\1""", body)) for b, body in items]
        if len(items) >= 3 and all(len(keys) >= 3 and label for _, keys, label in named):
            yield from _child(path, m[1], _line(text, m.start()))
            owner = plain_id(f"{file_id(path)}_{m[1]}")
            for i, (b, _, _) in enumerate(named):
                title = next((t[2] for k in ("title", "name", "label", "description", "id") if (t := re.search(rf"""(?:^|[,\s])['"]?{k}['"]?\s*:\s*(['"`])(.*?)\1""", items[i][1]))), "")
                yield from _child(path, str(i), _line(text, b), owner, label=title)


@register(".sh", ".bash")
def shell(path: str, text: str) -> Iterator[tuple]:
    """Functions, their calls, and the files that are sourced by a literal path, from the script's own folder."""
    yield from SHELL(path, text)
    for m in re.finditer(r"""(?m)^\s*(?:source|\.)\s+(["']?)([\w./-]+)\1\s*(?:$|[;&#])""", text):
        to = posixpath.normpath(m[2] if m[2].startswith("/") else posixpath.join(posixpath.dirname(path), m[2]))
        if not to.startswith(".."):
            yield _link(path, file_id(path), file_id(to), "imports_from", _line(text, m.start()))


@register(".cls", ".trigger")
def apex(path: str, text: str) -> Iterator[tuple]:
    """Classes, triggers on an object, methods, queried objects, and changes of data (what is changed can't be told from a name)."""
    language = Language((rf"(?i)^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:\w+\s+)*?(?:class|interface|enum)\s+{_NAME}",), (rf"(?i)^\s+(?:@\w+\s+)?(?:(?:public|private|global|protected|static|override|virtual)\s+)+[\w<>,\[\] ]+\s+{_NAME}\s*\(",), None, r"(?i)(?:extends|implements)\s+([\w, ]+?)(?=\s+implements|\s*\{|$)")
    yield from language(path, text)
    me = file_id(path)
    for m in re.finditer(rf"(?im)^\s*trigger\s+{_NAME}\s+on\s+(\w+)", text):
        yield from _child(path, m[1], _line(text, m.start()))
        yield _link(path, plain_id(f"{me}_{m[1]}"), plain_id(m[2]), "uses", _line(text, m.start()))
    functions = [s for s in language.symbols(text) if s.kind == "function"]

    def caller(at: int) -> str:
        inside = [s for s in functions if s.at < at < s.end]
        s = max(inside, key=lambda s: s.at) if inside else None
        return plain_id(f"{me}_{s.owner.name}_{s.name}" if s and s.owner else f"{me}_{s.name}" if s else me)

    for m in re.finditer(r"(?i)\[\s*SELECT\b[^\]]+?\bFROM\s+(\w+)", text):
        yield _link(path, caller(m.start()), plain_id(m[1]), "uses", _line(text, m.start()))
    for m in re.finditer(r"(?im)^\s*(insert|update|delete|upsert|merge|undelete)\s+\w", text):
        yield _link(path, caller(m.start()), plain_id(f"dml_{m[1]}"), "uses", _line(text, m.start()))


@register(".razor", ".cshtml")
def razor(path: str, text: str) -> Iterator[tuple]:
    """Components, injected and inherited types, routes, and the methods of code blocks."""
    me = file_id(path)
    for pattern, relation in ((r"<([A-Z][A-Za-z0-9]+)[\s/>]", "references"), (r"(?m)^@using\s+([\w.]+)", "imports"), (r"(?m)^@inject\s+([\w.<>]+)", "references"), (r"(?m)^@inherits\s+([\w.<>]+)", "inherits"), (r"(?m)^@model\s+([\w.<>]+)", "references")):
        for m in re.finditer(pattern, text):
            yield _link(path, me, plain_id(m[1]), relation, _line(text, m.start()))
    for m in re.finditer(r'(?m)^@page\s+"([^"]+)"', text):
        yield _link(path, me, plain_id(f"route_{m[1]}"), "references", _line(text, m.start()))
    for block in re.finditer(r"@code\s*\{", text):
        inside = text[block.end() : _brace_end(text, block.start())]
        for m in re.finditer(rf"(?m)^\s*(?:(?:public|private|protected|internal|static|async|override|virtual)\s+)+[\w<>\[\]?]+\s+{_NAME}\s*\(", inside):
            yield from _child(path, m[1], _line(text, block.end() + m.start()), label=f"{m[1]}()")


@register(".blade.php")
def blade(path: str, text: str) -> Iterator[tuple]:
    """Included views, components, and the methods that clicks are bound to."""
    for pattern, relation in ((r"@(?:include|extends|each)\(\s*['\"]([^'\"]+)['\"]", "includes"), (r"<(?:x-|livewire:)([\w.:-]+)", "uses_component"), (r"""wire:(?:click|submit|model)(?:\.\w+)*=["'](\w+)""", "binds_method")):
        for m in re.finditer(pattern, text):
            yield _link(path, file_id(path), plain_id(m[1]), relation, _line(text, m.start()))


@register(".robot", ".resource")
def robot(path: str, text: str) -> Iterator[tuple]:
    """Tests and keywords, resources and libraries, and the keywords that steps name."""
    me, section, owner = file_id(path), "", None
    for number, line in enumerate(text.split("\n"), 1):
        at = f"L{number}"
        if head := re.match(r"\*+\s*(\w[\w ]*?)\s*\**\s*$", line):
            section, owner = head[1].lower().rstrip("s"), None
        elif not line.strip() or line.lstrip().startswith("#"):
            continue
        elif section == "setting":
            if m := re.match(r"(Resource|Library|Variables)\s{2,}(\S+)", line):
                to = file_id(posixpath.normpath(posixpath.join(posixpath.dirname(path), m[2]))) if m[1] != "Library" or m[2].endswith(".py") else plain_id(m[2])
                yield _link(path, me, to, "imports_from", at)
        elif section in ("test case", "task", "keyword"):
            if not line[0].isspace():
                owner = plain_id(f"{me}_{line.strip()}")
                yield from _child(path, line.strip(), at, label=f"{line.strip()}()" if section == "keyword" else line.strip())
            elif owner:
                step = [c for c in re.split(r"\s{2,}|\t", line.strip()) if c]
                while step and re.fullmatch(r"[$@&]\{[^}]*\}\s*=?", step[0]):
                    step = step[1:]
                if step and not step[0].startswith("["):
                    yield (CALL, None, step[0], None, owner, None, "calls", path, at)


@register(".feature")
def gherkin(path: str, text: str) -> Iterator[tuple]:
    """Features and their scenarios."""
    owner = None
    for m in re.finditer(r"(?m)^\s*(Feature|Rule|Scenario(?: Outline| Template)?|Example):\s*(.+?)\s*$", text):
        line = _line(text, m.start())
        yield from _child(path, m[2], line, None if m[1] == "Feature" else owner)
        owner = plain_id(f"{file_id(path)}_{m[2]}") if m[1] == "Feature" else owner


@register(".css", ".scss")
def stylesheet(path: str, text: str) -> Iterator[tuple]:
    """Rule sets and at-rules, one within the other, and what is imported."""
    bare = re.sub(r"/\*.*?\*/|(?<!:)//[^\n]*", lambda m: " " * len(m[0]), text, flags=re.S)
    stack: list[str | None] = []
    for m in re.finditer(r"([^{};]*)\{|\}", bare):
        if m[0] == "}":
            stack = stack[:-1]
            continue
        head = " ".join((m[1] or "").split())
        if head:
            owner = next((o for o in reversed(stack) if o), None)
            at = m.start() + len(m[1]) - len(m[1].lstrip())
            yield from _child(path, head, _line(text, at), owner)
            stack.append(plain_id(f"{owner or file_id(path)}_{head}"))
        else:
            stack.append(None)
    for m in re.finditer(r"""@(?:import|use|forward)\s+(?:url\()?['"]([^'"]+)['"]""", bare):
        yield _link(path, file_id(path), plain_id(m[1]), "imports_from", _line(text, m.start()))


@register(".tf", ".tfvars", ".hcl")
def terraform(path: str, text: str) -> Iterator[tuple]:
    """Blocks by type and name, and the resources, modules and variables that they refer to."""
    blocks = list(re.finditer(r'(?m)^(resource|data|module|variable|output|provider|locals)\b((?:\s+"[^"]+")*)\s*\{', text))
    names = {}
    for m in blocks:
        words = re.findall(r'"([^"]+)"', m[2])
        names[m.start()] = name = ".".join(words if m[1] == "resource" else [{"variable": "var"}.get(m[1], m[1]), *words])
        yield from _child(path, name, _line(text, m.start()))
    known = set(names.values())
    for m in blocks:
        body = text[m.end() : _brace_end(text, m.start())]
        own = plain_id(f"{file_id(path)}_{names[m.start()]}")
        for ref in sorted(set(re.findall(r"\b((?:data\.)?[a-z]\w*\.\w+(?:\.\w+)?)", body))):
            hit = next((k for k in (ref, ".".join(ref.split(".")[:2]), ".".join(ref.split(".")[:3])) if k in known and k != names[m.start()]), None)
            if hit:
                yield _link(path, own, plain_id(f"{file_id(path)}_{hit}"), "references", _line(text, m.start()))


@register(".xaml", ".csproj", ".fsproj", ".vbproj")
def project_xml(path: str, text: str) -> Iterator[tuple]:
    """Named elements and classes of markup; referenced projects and packages."""
    me = file_id(path)
    for m in re.finditer(r'x:(?:Name|Class)="([^"]+)"', text):
        yield from _child(path, m[1], _line(text, m.start()))
    for m in re.finditer(r'<ProjectReference\s+Include="([^"]+)"', text):
        yield _link(path, me, file_id(posixpath.normpath(posixpath.join(posixpath.dirname(path), m[1].replace("\\", "/")))), "imports_from", _line(text, m.start()))
    for m in re.finditer(r'<PackageReference\s+Include="([^"]+)"', text):
        yield _link(path, me, plain_id(f"pkg_{m[1]}"), "depends_on", _line(text, m.start()))


@register(".sln")
def solution(path: str, text: str) -> Iterator[tuple]:
    """The projects of a solution."""
    for m in re.finditer(r'(?m)^Project\("[^"]*"\)\s*=\s*"([^"]+)",\s*"([^"]+)"', text):
        yield _link(path, file_id(path), file_id(posixpath.normpath(posixpath.join(posixpath.dirname(path), m[2].replace("\\", "/")))), "contains", _line(text, m.start()))


# Configuration.

# Keys that name an entry, and the forms of values that name things elsewhere.
_LABELS = ("alias", "name", "id", "description", "summary", "title")
_DOTTED, _SNAKE = re.compile(r"[a-z0-9_]+(\.[a-z0-9_]+)+"), re.compile(r"[a-z0-9_]{8,}")


@dataclass
class Entry:
    """A mapping's pair or a sequence's item: its key (None for an item), scalar, line and what it holds."""

    key: str | None
    scalar: str
    line: int
    children: list[Entry] = field(default_factory=list)


def _bare(value: str) -> str:
    """A scalar without its quotes or a comment behind it."""
    value = value.strip()
    if quoted := re.match(r"""(["'])(.*?)\1""", value):
        return quoted[2]
    return "" if value.startswith("#") else re.split(r"\s#", value, maxsplit=1)[0].strip()


def _tokens(text: str) -> Iterator[tuple[int, str | None, str, int] | None]:
    """(indent, key, scalar, line) of pairs, with the key ``-`` of items, and no key of other lines; None where a document begins."""
    block: int | None = None
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip()
        indent, rest = len(line) - len(line.lstrip()), line.strip()
        if block is not None and (not rest or indent > block):
            continue
        block = None
        if re.fullmatch(r"---(\s.*)?|\.\.\.", line):
            yield None
            continue
        if not rest or rest[0] in "#%":
            continue
        while rest == "-" or rest.startswith("- "):
            yield indent, "-", "", number
            inner = rest[1:].lstrip()
            indent, rest = indent + len(rest) - len(inner), inner
        pair = re.match(r"""("[^"]*"|'[^']*'|[^\s#:'"\[{][^:#]*?|[^\s:]+)\s*:(?:\s+(.*))?$""", rest)
        if pair:
            folded = re.fullmatch(r"[|>][+-]?\d*", (pair[2] or "").strip())
            block = indent if folded else None
            yield indent, _bare(pair[1]), "|" if folded else _bare(pair[2] or ""), number
        elif rest and not rest.startswith("#"):
            yield indent, None, _bare(rest), number


def _block(tokens: list[tuple[int, str | None, str, int]], i: int, items: bool = False) -> tuple[list[Entry], int]:
    """The entries of the block that begins with token ``i``, and where it ends; of ``items`` alone where a sequence stands as far out as its key."""
    out, indent = [], tokens[i][0]
    while i < len(tokens) and tokens[i][0] >= indent:
        own, key, scalar, line = tokens[i]
        if own > indent or key is None:
            i += 1
            continue
        if items and key != "-":
            break
        entry = Entry(None if key == "-" else key, scalar, line)
        out.append(entry)
        i += 1
        if i < len(tokens) and tokens[i][0] > indent:
            if tokens[i][1] is None:
                entry.scalar = entry.scalar or tokens[i][2]
                i += 1
            else:
                entry.children, i = _block(tokens, i)
        elif key != "-" and not scalar and i < len(tokens) and tokens[i][0] == indent and tokens[i][1] == "-":
            entry.children, i = _block(tokens, i, True)
    return out, i


def yaml_documents(text: str) -> list[list[Entry]]:
    """Block mappings and sequences by indentation; flow collections and folded text stay scalars."""
    documents: list[list[tuple]] = [[]]
    for token in _tokens(text):
        if token is None:
            documents.append([])
        else:
            documents[-1].append(token)
    return [_block(d, 0)[0] for d in documents if d] or [[]]


def _leaves(entries: list[Entry]) -> Iterator[tuple[str, int]]:
    for e in entries:
        if e.key is not None:
            yield e.key, e.line
        if e.scalar:
            yield e.scalar, e.line
        yield from _leaves(e.children)


def _named(entries: list[Entry]) -> str | None:
    return next((e.scalar for e in entries if e.key in _LABELS and e.scalar), None)


@register(".yaml", ".yml")
def yaml(path: str, text: str) -> Iterator[tuple]:
    """Top keys, their items and sub-keys under the names these carry, resources of manifests, and values that name things elsewhere."""
    me, documents, seen = file_id(path), yaml_documents(text), set()
    for value, line in (v for d in documents for v in _leaves(d)):
        if value not in seen and (_DOTTED.fullmatch(value) or "." not in value and _SNAKE.fullmatch(value)):
            seen.add(value)
            yield (VALUE, None, value, None, me, None, None, path, f"L{line}")
    for number, entries in enumerate(documents):
        stem = me if len(documents) == 1 else plain_id(f"{me}_{number}")
        top = {e.key: e for e in entries if e.key}
        if "apiVersion" in top and "kind" in top:
            name = next((e.scalar for e in top["metadata"].children if e.key == "name"), "") if "metadata" in top else ""
            own, line = plain_id(f"{stem}_resource"), f"L{entries[0].line}"
            yield (NODE, own, f"{top['kind'].scalar} {name}".strip(), "code", None, None, None, path, line)
            yield (EDGE, None, None, None, me, own, "contains", path, line)
        for e in entries:
            if not e.key:
                continue
            key = plain_id(f"{stem}_{e.key}")
            yield (NODE, key, e.key, "code", None, None, None, path, f"L{e.line}")
            yield (EDGE, None, None, None, me, key, "contains", path, f"L{e.line}")
            for i, c in enumerate(e.children):
                label = (_named(c.children) or f"{e.key}[{i}]") if c.key is None else (_named(c.children) or c.key)
                yield from _child(path, str(i) if c.key is None else c.key, f"L{c.line}", key, label=label)


@register(names=("kustomization.yaml", "kustomization.yml", "Kustomization"))
def kustomization(path: str, text: str) -> Iterator[tuple]:
    """The files and folders that an overlay is made of."""
    for entries in yaml_documents(text):
        for e in (e for e in entries if e.key in ("resources", "bases", "components")):
            for item in (c for c in e.children if c.key is None and c.scalar):
                to = posixpath.normpath(posixpath.join(posixpath.dirname(path), item.scalar))
                file = to if re.search(r"\.[A-Za-z]+$", to) else f"{to}/kustomization.yaml"
                yield _link(path, file_id(path), file_id(file), "imports", f"L{item.line}")


def _package(path: str, name: str, wanted: list[str]) -> Iterator[tuple]:
    own = plain_id(f"pkg_{name}")
    yield (NODE, own, name, "code", None, None, None, path, "L1")
    for d in dict.fromkeys(d for d in wanted if d):
        if (to := plain_id(f"pkg_{d}")) != own:
            yield _link(path, own, to, "depends_on", "L1")


@register(names=("pyproject.toml",))
def pyproject(path: str, text: str) -> Iterator[tuple]:
    """The package and what it needs, by either of the usual tables."""
    data = tomllib.loads(text)
    poetry = data.get("tool", {}).get("poetry", {})
    if name := data.get("project", {}).get("name") or poetry.get("name"):
        wanted = [re.split(r"[\s<>=!~;\[(@]", d)[0] for d in data.get("project", {}).get("dependencies", [])] + [d for d in poetry.get("dependencies", {}) if d.lower() != "python"]
        yield from _package(path, name, wanted)


@register(names=("apm.yml",))
def agent_package(path: str, text: str) -> Iterator[tuple]:
    """The package and what it needs: a list of names, or a mapping by name."""
    top = {e.key: e for d in yaml_documents(text) for e in d if e.key}
    if "name" in top and top["name"].scalar:
        wanted = [c.key or (c.children[0].key if c.children else None) or c.scalar for c in (top["dependencies"].children if "dependencies" in top else [])]
        yield from _package(path, top["name"].scalar, wanted)


@register(names=("go.mod",))
def go_module(path: str, text: str) -> Iterator[tuple]:
    if own := re.search(r"(?m)^module\s+(\S+)", text):
        yield from _package(path, own[1], re.findall(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+v\S+", text))


@register(names=("pom.xml",))
def maven(path: str, text: str) -> Iterator[tuple]:
    body = re.sub(r"<parent>.*?</parent>", "", text, flags=re.S)
    own = re.search(r"<artifactId>([^<]+)</artifactId>", re.sub(r"<(dependencies|build|dependencyManagement)>.*?</\1>", "", body, flags=re.S))
    if own:
        yield from _package(path, own[1].strip(), [d.strip() for d in re.findall(r"<dependency>.*?<artifactId>([^<]+)</artifactId>", body, flags=re.S)])


@register(names=("Cargo.toml",))
def cargo(path: str, text: str) -> Iterator[tuple]:
    """A crate, and the crates it depends on. Edges to crates that no manifest names are pruned with all that dangle."""
    data = tomllib.loads(text)
    name = data.get("package", {}).get("name") if isinstance(data.get("package"), dict) else None
    if isinstance(name, str):
        yield (NODE, f"crate:{name}", name, "code", None, None, None, path, "L1")
        for d in sorted(data.get("dependencies") or {}):
            yield _link(path, f"crate:{name}", f"crate:{d}", "crate_depends_on", "L1")
