"""Text expressions: identifiers, labels, tokens, escapes, and string distances.

Everything that Spark can express is a column expression. Arrow functions remain for Unicode normal forms and for the
distances that Spark lacks.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token pattern for camel case, acronyms, digits and other letters.
TOKEN = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_A-Za-z]+"


def plain_id(value: str) -> str:
    """Canonical identifier: compatibility form, runs of other characters as one underscore, folded case."""
    folded = re.sub(r"[\W_]+", "_", unicodedata.normalize("NFKC", value))
    return folded.strip("_").casefold()


def plain_tokens(value: str) -> list[str]:
    """Search tokens of a label, without accents."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return [t.lower() for t in re.findall(TOKEN, bare)]


@F.pandas_udf(T.StringType())
def normalize_id(values: pd.Series) -> pd.Series:
    return values.map(plain_id, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def search_tokens(values: pd.Series) -> pd.Series:
    return values.fillna("").map(plain_tokens)


@F.pandas_udf(T.StringType())
def strip_accents(values: pd.Series) -> pd.Series:
    return values.map(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)), na_action="ignore")


def make_id(*parts: Column) -> Column:
    """Parts without stray dots and underscores at their ends, joined, as an identifier; empty parts are skipped."""
    cleaned = F.transform(F.array(*parts), lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), r"^[_.]+|[_.]+$", ""))
    return normalize_id(F.array_join(F.filter(cleaned, lambda p: p != ""), "_"))


def ascii_id(value: Column) -> Column:
    """``normalize_id`` for text that is known to be ASCII, without leaving the JVM."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def ascii_tokens(value: Column) -> Column:
    """``search_tokens`` for ASCII text, without leaving the JVM."""
    return F.transform(F.regexp_extract_all(value, F.lit("([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), F.lit(1)), lambda t: F.lower(t))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def top_dir(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def norm_path(path: Column, root: str = "") -> Column:
    """Forward slashes, without the root."""
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(out.startswith(root.rstrip("/") + "/"), F.substring(out, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(out) if root else out


def callable_label(label: Column) -> Column:
    """Without call brackets and a leading dot, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(label), r"\(\)$", ""), r"^\.", ""))


def sanitize_label(label: Column, limit: int = 256) -> Column:
    """Without control characters, capped."""
    return F.substring(F.regexp_replace(label, r"[\x00-\x1f\x7f]", ""), 1, limit)


def escape_html(value: Column) -> Column:
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def sanitize_metadata(values: Column, length: int = 512, most: int = 50) -> Column:
    """A map of strings without control characters, each capped, then escaped; no more than ``most`` entries."""
    cleaned = F.transform_values(values, lambda k, v: escape_html(sanitize_label(v, length)))
    return F.map_from_entries(F.slice(F.map_entries(cleaned), 1, most))


def escape_cypher(value: Column) -> Column:
    """For a single-quoted literal: backslashes and quotes escaped, control characters gone."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x1f\x7f]", " ")
    return F.replace(F.replace(out, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def slug(value: Column, limit: int = 80) -> Column:
    """A file name of letters, digits, dashes and underscores."""
    return F.substring(F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9_-]+", "-"), "^-+|-+$", ""), 1, limit)


def html_text(html: Column, limit: int = 8000) -> Column:
    """Text of a page: scripts and styles gone, tags to spaces, white space collapsed, capped."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), r"\s+", " ")), 1, limit)


def url_type(url: Column) -> Column:
    low = F.lower(url)
    path = F.regexp_replace(F.regexp_extract(low, r"^[a-z]+://[^/?#]*([^?#]*)", 1), r"\s+$", "")
    return (
        F.when(low.contains("twitter.com") | low.contains("x.com"), "tweet")
        .when(low.contains("arxiv.org"), "arxiv")
        .when(low.contains("github.com"), "github")
        .when(low.contains("youtube.com") | low.contains("youtu.be"), "youtube")
        .when(path.endswith(".pdf"), "pdf")
        .when(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image")
        .otherwise("webpage")
    )


def word_count(text: Column) -> Column:
    """Pieces between white space."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))


def entropy(label: Column) -> Column:
    """Shannon entropy of a label's characters, in bits."""
    chars = F.split(label, "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(label) == 0, 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    m = len(matched)
    swapped = sum(x != y for x, y in zip(matched, [c for c, t in zip(b, taken, strict=True) if t], strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    base = jaro(a, b)
    shared = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return base + 0.1 * shared * (1 - base) if base > 0.7 else base


def damerau(a: str, b: str) -> int:
    """Edits with swaps of neighbours, each place edited once or more."""
    if a == b:
        return 0
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        same = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), same
            if x == y:
                same = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


@F.pandas_udf(T.DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.IntegerType())
def damerau_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")
