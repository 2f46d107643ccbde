"""Column expressions over text and category strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cleaning patterns, applied in this order.
URL = r"http\S+|www\.\S+"
INLINE_MATH = r"\$.*?\$"
COMMAND = r"\\[a-zA-Z]+(\{.*?\})?"
NOT_ALNUM = r"[^a-z0-9]+"
NOT_ALPHA = r"[^a-z ]"
SPACES = r"\s+"
CLEANING_ORDER = (URL, INLINE_MATH, COMMAND, NOT_ALNUM, SPACES)


def joined_text(*parts: str, sep: str = " ") -> Column:
    return F.concat_ws(sep, *[F.col(p) for p in parts])


def clean(text: Column) -> Column:
    """Lower-case letters and digits only, after URLs, inline math and commands are blanked.

    Replacing runs of other characters already leaves single spaces, so the last pattern needs no pass of its own.
    """
    out = F.lower(text)
    for pattern in CLEANING_ORDER[:-1]:
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def clean_alpha(text: Column) -> Column:
    out = F.replace(F.lower(text), F.lit("\n"), F.lit(" "))
    out = F.regexp_replace(out, NOT_ALPHA, " ")
    return F.trim(F.regexp_replace(out, SPACES, " "))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def present(value: Column) -> Column:
    """Null and the empty string both count as missing."""
    return value.isNotNull() & (value != "")


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def category_list(categories: Column) -> Column:
    return F.split(categories, " ")


def primary_category(categories: Column) -> Column:
    return F.get(category_list(categories), F.lit(0))


def main_category(category: Column) -> Column:
    return F.substring_index(category, ".", 1)


def truncated(title: Column, width: int) -> Column:
    """Spaces collapsed, null as empty, longer titles cut to ``width`` characters ending in an ellipsis."""
    flat = F.coalesce(F.trim(F.regexp_replace(title, SPACES, " ")), F.lit(""))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    # The three escapes, the ampersand first.
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def link(doc_id: Column, base: str) -> Column:
    return F.concat(F.lit(base), doc_id.cast("string"))


def csv_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_")


def words(text: Column, pattern: str = r"\W+", min_length: int = 1) -> Column:
    """Lower-cased tokens of at least ``min_length`` characters."""
    return F.filter(F.split(F.lower(text), pattern), lambda t: F.length(t) >= min_length)


def word_grams(tokens: Column) -> Column:
    """Unigrams followed by the bigrams of adjacent tokens."""
    pairs = F.when(
        F.size(tokens) > 1,
        F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens)),
                   lambda a, b: F.concat_ws(" ", a, b)),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, pairs)


def hash_fraction(key: Column, seed: object, fraction: float) -> Column:
    """Predicate keeping about ``fraction`` of the keys, the same ones on every run and in every engine."""
    cut = format(int(round(fraction * 16 ** 8)), "08x") if fraction < 1 else "g"
    return F.substring(hash_order(key, seed), 1, 8) < F.lit(cut)


def hash_order(key: Column, seed: object) -> Column:
    """Pseudo-random sort key: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def exploded(df: DataFrame, tokens: str | Column, name: str, *keep: str) -> DataFrame:
    """One row per token. The outer form keeps the optimizer from evaluating an expensive token expression a
    second time as a filter below the explode."""
    return df.select(*keep, F.explode_outer(tokens).alias(name)).where(F.col(name).isNotNull())
