"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_tokens(q: Column) -> Column:
    """Distinct lower-case alphanumeric tokens, in order; anything else separates."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(q), "[^\\p{L}\\p{N}\\s]", " "), "\\s+"), lambda t: t != ""))


def comma_list(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), lambda t: F.trim(t)), lambda t: t != "")


def truncate(s: Column, n: int) -> Column:
    """At most n characters, the last three being dots where something was cut."""
    return F.when(F.char_length(s) > n, F.concat(F.left(s, F.lit(n - 3)), F.lit("..."))).otherwise(s)


def title_of(s: Column, n: int = 80) -> Column:
    return truncate(F.element_at(F.split(s, "\n"), 1), n)


def estimate_tokens(s: Column) -> Column:
    """A quarter of the bytes, at least one."""
    return F.greatest(F.floor(F.octet_length(s) / 4), F.lit(1)).cast("long")


def next_id(last: Column, step: Column, prefix: str = "TK-") -> Column:
    return F.format_string(prefix + "%03d", (last + step).cast("int"))


def cache_key(prefix: str, *args: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.md5(F.concat_ws(":", *args)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Accumulated in double; 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a character offset (0-based)."""
    before = F.left(text, offset)
    return 1 + F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))


def entity_ids(text: Column) -> Column:
    """Ids in square brackets, such as [RF-001]."""
    return F.regexp_extract_all(text, F.lit("\\[([A-Z]+-[0-9]+)\\]"), 1)


def type_prefix(id_: Column) -> Column:
    return F.regexp_extract(id_, "^(DP|RF|LAW|SMELL|TK)-", 1)


def strip_markdown(text: Column) -> Column:
    """Lower case without emphasis, code marks and repeated white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[*_`#>]+", ""), "\\s+", " "))
