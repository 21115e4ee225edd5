"""Classifications of nodes, edges, paths and pull requests as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.text import base_name, suffix, top_dir

# Node types and the names that stand for them.
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
FILE_TYPE_NAMES = {
    "markdown": "document", "text": "document", "tool": "code", "library": "code", "pattern": "concept", "principle": "concept", "constraint": "concept",
    "tech": "concept", "technology": "concept", "data-source": "concept", "data_source": "concept", "gotcha": "concept", "framework": "concept",
}
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
DEFAULT_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}
# Labels of builtin types that never count as entities of their own.
NOISE_LABELS = (
    "str", "int", "float", "bool", "bytes", "bytearray", "complex", "object", "True", "False",
    "MagicMock", "Mock", "AsyncMock", "NonCallableMock", "NonCallableMagicMock", "PropertyMock", "patch", "sentinel",
    "Path", "Any", "Optional", "List", "Dict", "Set", "Tuple", "Union", "Callable", "Type", "ClassVar", "Final", "Literal", "Protocol",
    "Counter", "defaultdict", "OrderedDict", "datetime", "Enum", "os", "sys", "re", "json", "io", "abc", "typing",
    "Int", "Int8", "Int16", "Int32", "Int64", "UInt", "UInt8", "UInt16", "UInt32", "UInt64", "Float", "Float32", "Float64", "Double", "Character", "Void",
    "String", "Bool", "AnyObject", "i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64", "f32", "f64", "rune", "byte",
)
# Keys of JSON files that never count as entities.
JSON_NOISE = (
    "start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version",
    "dependencies", "devdependencies", "peerdependencies", "optionaldependencies", "bundleddependencies", "bundledependencies",
    "scripts", "main", "bin", "engines", "keywords", "author", "license", "repository", "private", "workspaces",
)
# States of pull requests in the order they are worked on.
PR_ORDER = ("WRONG-BASE", "CI-FAIL", "CHANGES-REQ", "DRAFT", "STALE", "PENDING", "APPROVED", "READY")
# Limits of a fragment from outside.
MOST_BYTES, MOST_NODES, MOST_EDGES, MOST_HYPEREDGES, MOST_MEMBERS, MOST_ID = 25 * 1024 * 1024, 10_000, 100_000, 10_000, 256, 256
# Relations along which a change is felt.
AFFECTED_RELATIONS = ("calls", "indirect_call", "references", "imports", "imports_from", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds")
# Language families, for dropping calls at build time and for scoring.
BUILD_FAMILIES = {
    "py": (".py", ".pyi"), "js": (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"), "go": (".go",), "rs": (".rs",), "jvm": (".java", ".kt", ".scala", ".groovy"),
    "c": (".c", ".h", ".cc", ".cpp", ".hpp", ".cxx", ".hh", ".hxx", ".cu", ".cuh", ".metal", ".m", ".mm"), "rb": (".rb",), "php": (".php",), "cs": (".cs",), "swift": (".swift",), "lua": (".lua",),
}
SCORE_FAMILIES = {
    "python": (".py", ".pyw"), "js": (".js", ".jsx", ".mjs", ".ejs", ".ts", ".tsx", ".vue", ".svelte"), "go": (".go",), "rust": (".rs",), "jvm": (".java", ".kt", ".kts", ".scala"),
    "c": (".c", ".h", ".cpp", ".cc", ".cxx", ".hpp"), "ruby": (".rb",), "swift": (".swift",), "dotnet": (".cs",), "php": (".php",), "r": (".r",),
}
# File categories by extension.
PAPERS, IMAGES, DOCS = (".pdf",), (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"), (".md", ".mdx", ".txt", ".rst", ".html", ".docx", ".xlsx")


def _lookup(key: Column, table: dict[str, tuple[str, ...]]) -> Column:
    pairs = [(F.lit(x), F.lit(name)) for name, xs in table.items() for x in xs]
    return F.try_element_at(F.create_map(*chain.from_iterable(pairs)), key)


def file_type(value: Column) -> Column:
    """One of ``FILE_TYPES``: synonyms mapped, null and unknown become concept."""
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in FILE_TYPE_NAMES.items()))
    return F.when(value.isin(*FILE_TYPES), value).otherwise(F.coalesce(F.try_element_at(names, value), F.lit("concept")))


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """A file's own node, a method, or a function at the edge of the graph."""
    call = label.rlike(r"^.*\(\)$")
    return F.coalesce((label == base_name(source_file)) | (label.startswith(".") & call) | (call & (degree <= 1)), F.lit(False))


def is_json_key(label: Column, source_file: Column) -> Column:
    """A key that any JSON file may have."""
    return F.coalesce(F.lower(source_file).endswith(".json") & F.lower(F.trim(label)).isin(*JSON_NOISE), F.lit(False))


def is_concept_node(source_file: Column) -> Column:
    """No source, or a source without an extension."""
    return F.coalesce(source_file == "", F.lit(True)) | ~base_name(source_file).contains(".")


def file_category(path: Column) -> Column:
    s = suffix(path)
    return F.when(s.isin(*PAPERS), "paper").when(s.isin(*IMAGES), "image").when(s.isin(*DOCS), "doc").otherwise("code")


def cross_language(a: Column, b: Column) -> Column:
    """Both of a known language family, and not the same."""
    x, y = _lookup(suffix(a), SCORE_FAMILIES), _lookup(suffix(b), SCORE_FAMILIES)
    return F.coalesce(x != y, F.lit(False))


def dropped_at_build(relation: Column, confidence: Column, a: Column, b: Column) -> Column:
    """An inferred call between files of different families; an unknown extension is a family of its own kind."""
    x, y = (F.coalesce(_lookup(suffix(p), BUILD_FAMILIES), F.lit("?")) for p in (a, b))
    return (relation == "calls") & (confidence == "INFERRED") & (suffix(a) != "") & (suffix(b) != "") & (x != y)


def is_test_path(path: Column) -> Column:
    """A test folder among the parts, or a test file's name."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.coalesce(p.rlike(r"(^|/)(tests|test|spec|specs|__tests__)(/|$)") | base_name(p).rlike(r"^test_.*\.py$|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$|^conftest\.py$"), F.lit(False))


def is_sensitive(path: Column) -> Column:
    """Files that may hold secrets: by a folder above them, by name, or by a word for secrets that the name ends on, or that is one of two words."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    folders = p.rlike(r"(^|/)(\.ssh|\.gnupg|\.aws|\.gcloud|secrets|\.secrets|credentials)/")
    name = base_name(p)
    # Names of files that hold secrets, and words for secrets.
    named = name.rlike(r"(?i)(^|[\\/])\.(env|envrc)(\.|$)|\.(pem|key|p12|pfx|cert|crt|der|p8)$|(\.netrc|\.pgpass|\.htpasswd)$|aws_credentials|gcloud_credentials|service.account") | name.rlike(r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$")
    word = r"(?i)(?<![a-zA-Z0-9])((credential|secret|passwd|password|private_key)s?|tokens?)(?![a-zA-Z])"
    stem = F.element_at(F.split(F.regexp_replace(name, r"^\.+", ""), r"\."), 1)
    few = F.size(F.filter(F.split(stem, r"[-_\s]+"), lambda w: w != "")) <= 2
    return folders | named | stem.rlike(word + "$") | (stem.rlike(word) & few)


# Folders that are never walked, and files that are generated.
NOISE_DIRS = (
    "venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "site-packages", "lib64", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs",
    "coverage", "lcov-report", "visual-tests", "visual-test", "__snapshots__", "snapshots", "storybook-static", "dist-protected",
    ".next", ".nuxt", ".turbo", ".angular", ".idea", ".cache", ".parcel-cache", ".svelte-kit", ".terraform", ".serverless", ".worktrees",
)
NOISE_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "go.work.sum")


def is_noise_path(path: Column) -> Column:
    """Any folder that holds no sources of its own, or a generated file."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    own = F.exists(folders, lambda d: d.isin(*NOISE_DIRS) | d.endswith("_venv") | d.endswith("_env") | d.endswith(".egg-info"))
    return own | path.rlike(r"(^|/)\.[^/]+/worktrees/") | base_name(path).isin(*NOISE_FILES)


# Extensions of sources; names and interpreters that make a source of a file without one.
CODE = (
    ".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".gs", ".ejs", ".ets", ".go", ".rs", ".java", ".groovy", ".gradle", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".cu", ".cuh", ".metal", ".rb", ".swift", ".kt", ".kts", ".cs",
    ".scala", ".php", ".lua", ".luau", ".toc", ".zig", ".ps1", ".psm1", ".psd1", ".ex", ".exs", ".m", ".mm", ".jl", ".vue", ".svelte", ".astro", ".dart", ".v", ".sv", ".svh", ".sql", ".r", ".f", ".f90", ".f95", ".f03", ".f08",
    ".pas", ".pp", ".dpr", ".dpk", ".lpr", ".inc", ".dfm", ".lfm", ".lpk", ".sh", ".bash", ".fish", ".json", ".hook", ".toml", ".yaml", ".yml", ".css", ".scss", ".html", ".htm", ".robot", ".resource", ".feature", ".tf", ".tfvars", ".hcl",
    ".dm", ".dme", ".dmi", ".dmm", ".dmf", ".sln", ".slnx", ".csproj", ".fsproj", ".vbproj", ".xaml", ".razor", ".cshtml", ".cls", ".trigger",
)
TEXTS, OFFICE, VIDEOS = (".md", ".mdx", ".qmd", ".txt", ".rst"), (".docx", ".xlsx"), (".mp4", ".mov", ".webm", ".mkv", ".avi", ".m4v", ".mp3", ".wav", ".m4a", ".ogg")
MANIFESTS = ("apm.yml", "pyproject.toml", "go.mod", "pom.xml")
INTERPRETERS = ("python", "python3", "python2", "ruby", "perl", "node", "nodejs", "bash", "sh", "dash", "zsh", "fish", "ksh", "tcsh", "lua", "php", "julia", "Rscript")
ASSETS = (".imageset", ".xcassets", ".appiconset", ".colorset", ".launchimage")


def doc_type(path: Column, text: Column | None = None) -> Column:
    """What a file is, by name and extension; without an extension by the interpreter its first line names. A paper's marks make a paper of a document.
    Null for what isn't read."""
    s, name = suffix(path), base_name(path)
    named = F.lower(name).isin(*MANIFESTS) | name.rlike(r"^(Dockerfile|Containerfile)(\..+)?$|\.[Dd]ockerfile$") | F.lower(name).endswith(".blade.php")
    asset = F.exists(F.split(path, "/"), lambda d: d.rlike("(" + "|".join(a.replace(".", r"\.") for a in ASSETS) + ")$"))
    out = F.when(named | s.isin(*CODE), "code").when(s.isin(*PAPERS) & ~asset, "paper").when(s.isin(*IMAGES), "image")
    if text is not None:
        first = F.regexp_extract(text, r"\A#!\s*(\S+)(?:[ \t]+(\S+))?", 1)
        called = F.when(first.rlike("(^|/)env$"), F.regexp_extract(text, r"\A#!\s*(\S+)(?:[ \t]+(\S+))?", 2)).otherwise(base_name(first))
        out = out.when((s == "") & called.isin(*INTERPRETERS), "code").when(s.isin(*TEXTS) & (paper_signals(text) >= 3), "paper")
    return out.when(s.isin(*TEXTS, *OFFICE), "document").when(s.isin(*VIDEOS), "video")


def paper_signals(text: Column) -> Column:
    """How many marks of a paper the beginning of a text has; three make one."""
    # Marks of a paper.
    marks = (r"\barxiv\b", r"\bdoi\s*:", r"\babstract\b", r"\bproceedings\b", r"\bjournal\b", r"\bpreprint\b", r"\\cite\{", r"\[\d+\]", r"\[\n\d+\n\]", r"eq\.\s*\d+|equation\s+\d+", r"\d{4}\.\d{4,5}", r"\bwe propose\b", r"\bliterature\b")
    head = F.lower(F.substring(text, 1, 3000))
    return sum((head.rlike(m).cast("int") for m in marks), F.lit(0))


def is_rationale_sentence(label: Column) -> Column:
    """A label that is a sentence: long or wordy, and punctuated."""
    return ((F.length(label) >= 80) | (F.size(F.split(F.trim(label), r"\s+")) >= 8)) & label.rlike("[.!?:]")


def pr_status(base_branch: Column, ci: Column, review: Column, draft: Column, days_old: Column, base: str = "main", stale: int = 14) -> Column:
    return (
        F.when(base_branch != base, "WRONG-BASE").when(ci == "FAILURE", "CI-FAIL").when(review == "CHANGES_REQUESTED", "CHANGES-REQ").when(draft, "DRAFT")
        .when(days_old >= stale, "STALE").when(review == "APPROVED", "APPROVED").when(ci == "PENDING", "PENDING").otherwise("READY")
    )


def ci_status(conclusions: Column, statuses: Column) -> Column:
    """One state of a pull request's checks from arrays of their conclusions and states."""
    # Conclusions that are failures.
    failed = F.array(*map(F.lit, ("FAILURE", "CANCELLED", "TIMED_OUT", "ACTION_REQUIRED", "STARTUP_FAILURE")))
    running = F.array(F.lit("IN_PROGRESS"), F.lit("QUEUED"))
    has = lambda a, b: F.coalesce(F.arrays_overlap(F.array_compact(a), b), F.lit(False))
    return F.when(has(conclusions, failed), "FAILURE").when(has(statuses, running), "PENDING").when(has(conclusions, F.array(F.lit("SUCCESS"))), "SUCCESS").otherwise("NONE")


def edge_included(confidence: Column, score: Column) -> Column:
    return (F.upper(confidence) == "EXTRACTED") | ((F.upper(confidence) == "INFERRED") & (score >= 0.85))


def edge_score(relation: Column, confidence: Column, score: Column) -> Column:
    """Rank of an edge in a diagram."""
    bonus = F.when(relation.isin("calls", "uses", "method"), 1.0).when(relation.isin("imports", "imports_from"), 0.6).when(relation == "contains", -0.2).when(relation == "rationale_for", -0.6).otherwise(0.0)
    return score + F.when(F.upper(confidence) == "EXTRACTED", 2.0).otherwise(0.0) + bonus


def surprise(relation: Column, confidence: Column, source_a: Column, source_b: Column, community_a: Column, community_b: Column, degree_a: Column, degree_b: Column) -> Column:
    """How surprising an edge between files is; the steps' order matters."""
    cat_a, cat_b = file_category(source_a), file_category(source_b)
    mixed = ((cat_a == "code") & (cat_b == "doc")) | ((cat_a == "doc") & (cat_b == "code"))
    muted = (confidence == "INFERRED") & relation.isin("calls", "uses") & (cross_language(source_a, source_b) | mixed)
    loud = F.when(confidence == "AMBIGUOUS", 3).when(confidence == "INFERRED", 2).otherwise(1)
    structure = F.when(cat_a != cat_b, 2).otherwise(0) + F.when(top_dir(source_a) != top_dir(source_b), 2).otherwise(0) + F.when(community_a != community_b, 1).otherwise(0)
    base = F.when(muted, 0).otherwise(loud + structure)
    base = F.when(relation == "semantically_similar_to", F.floor(base * 1.5)).otherwise(base).cast("int")
    hub = F.when((F.least(degree_a, degree_b) <= 2) & (F.greatest(degree_a, degree_b) >= 5), 1).otherwise(0)
    return base + F.when(relation == "documents_bug_in", 4).otherwise(0) + hub


def relation_matches(relation: Column, wanted: tuple[str, ...] = AFFECTED_RELATIONS) -> Column:
    """Named outright, or by the part before its colon where ``name:*`` is wanted."""
    exact, open_ = [w for w in wanted if not w.endswith(":*")], [w[:-2] for w in wanted if w.endswith(":*")]
    found = relation.isin(*exact)
    return found | F.substring_index(relation, ":", 1).isin(*open_) if open_ else found
