"""Scalar functions on names and texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone import schemas

#: Unicode white space; the plain class is ASCII only.
UNICODE_SPACE = r"(?U)\s+"
ASCII_SPACE = r"[ \t\n\r\f]+"
#: What is between such white space.
TOKENS = {UNICODE_SPACE: r"(?U)\S+", ASCII_SPACE: r"[^ \t\n\r\f]+"}


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


def collapse(text: Column, pattern: str = UNICODE_SPACE) -> Column:
    """White space runs become one space; none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, " "))


def valid_unicode(raw: Column) -> tuple[Column, Column]:
    """Text of raw bytes with invalid sequences as U+FFFD, and how many of these it has."""
    text = F.make_valid_utf8(raw.cast("string"))
    return text, F.regexp_count(text, F.lit("\ufffd")).cast("int")


def normal_name(name: Column, exact: bool = True, pattern: str = UNICODE_SPACE) -> Column:
    """Compatibility form (with ``exact``), dashes as hyphens, white space collapsed."""
    shaped = nfkc(F.coalesce(name, F.lit(""))) if exact else F.coalesce(name, F.lit(""))
    return collapse(F.translate(shaped, "–—−", "---"), pattern)


def name_key(name: Column, exact: bool = True, pattern: str = UNICODE_SPACE) -> Column:
    n = normal_name(name, exact, pattern)
    return casefold(n) if exact else F.lower(n)


def canonical_name(name: Column, exact: bool = True, names: dict[str, str] = schemas.CANONICAL_NAMES) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    n = normal_name(name, exact)
    return F.coalesce(F.element_at(table, F.lower(n)), n)


def entity_key(kind: Column, name: Column) -> Column:
    return F.concat_ws("::", kind, F.lower(F.trim(name)))


def paper_id(source_file: Column) -> Column:
    """The file name's stem, decomposed, other than word characters as single underscores, lower case, 80 at most."""
    stem = F.regexp_replace(source_file, r"\.[^.]*$", "")
    return F.substring(F.lower(F.regexp_replace(F.regexp_replace(nfkd(stem), r"(?U)[^\w]+", "_"), "^_+|_+$", "")), 1, 80)


def chunk_id(paper: Column, page: Column, index: Column) -> Column:
    return F.format_string("%s_p%03d_c%03d", paper, page, index)


def unfenced(text: Column) -> Column:
    """JSON without the Markdown fence around it."""
    inner = F.regexp_replace(text, r"^\s*(?:```(?:json)?)?\s*", "")
    return F.regexp_replace(inner, r"\s*(?:```)?\s*$", "")


def rewritten(answer: Column, question: Column) -> Column:
    """A rewritten question without quotes around it; the question itself where nothing is left."""
    bare = F.trim(F.regexp_replace(F.trim(answer), r'^"+|"+$', ""))
    return F.coalesce(F.when(bare != "", bare), question)


def is_noise(name: Column) -> Column:
    return F.coalesce((name == "") | name.rlike(r"(?i)\bet al\.?\b"), F.lit(True))


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def mentions(text: Column, name: Column) -> Column:
    """Whether a text mentions a name: an ASCII name not inside a longer run of letters and digits, any other name
    anywhere; an empty name never. Both are compared in lower case."""
    t, n = F.lower(text), F.lower(F.trim(name))
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), n, F.lit(r"\E(?![a-z0-9])"))
    ascii_only = n.rlike(r"^[\x00-\x7F]+$")
    return F.coalesce(F.when(n == "", False).when(ascii_only, F.regexp_like(t, quoted)).otherwise(F.contains(t, n)), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors; in doubles, component by component."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def html_text(html: Column) -> Column:
    """What a page shows: no scripts, styles, comments or tags; the five basic entities resolved."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return collapse(t, ASCII_SPACE)
