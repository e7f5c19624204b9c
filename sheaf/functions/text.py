"""Column expressions for text: splitting, stripping, counting, clipping.

All of them stay inside the JVM. ``SPACE`` spells out the characters Python's
``str.split`` treats as blank, because Java's ``\\s`` is ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
SENTENCE_END = "[.。！？\n]"
WORD = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: Column | str) -> Column:
    """Whitespace words, in order, blanks dropped."""
    return F.filter(F.split(col(c), SPACE + "+"), lambda x: x != "")


def terms(c: Column | str) -> Column:
    """Distinct lower-cased whitespace words."""
    return F.array_distinct(words(F.lower(col(c))))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def not_blank(c: Column | str) -> Column:
    return F.length(strip(c)) > 0


def token_count(c: Column | str) -> Column:
    """About four characters per token, never less than one."""
    return F.greatest(F.lit(1), (F.length(col(c)) / 4).cast("int"))


def message_cost(c: Column | str) -> Column:
    """Tokens of a one-message list: priming 3, overhead 4, content."""
    return token_count(c) + F.lit(7)


def clip(c: Column | str, limit: int, mark: str = "") -> Column:
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def first_sentence(c: Column | str) -> Column:
    return strip(F.regexp_extract(col(c), "^[^.。！？\n]*", 0))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a needle, 0 for an empty one. Byte lengths need no scan of the text."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))
    return F.coalesce(F.try_divide(removed, F.octet_length(needle)), F.lit(0)).cast("int")


def last_index(c: Column, needle: str) -> Column:
    """0-based position of the last single-character needle, -1 when absent."""
    at = F.instr(F.reverse(c), needle)
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(c) - at)


def cut_at_sentence(c: Column | str, limit: int = 2000) -> Column:
    """Cut at ``limit``, moved back to a period or newline lying past 80 % of the cut."""
    c = col(c)
    cut = F.substring(c, 1, limit)
    dot, newline = last_index(cut, "."), last_index(cut, "\n")
    past = F.length(cut) * 0.8
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit(""))
        .when(F.length(c) <= limit, c)
        .when(dot > past, F.substring(cut, F.lit(1), dot + 1))
        .when(newline > past, F.substring(cut, F.lit(1), newline))
        .otherwise(F.concat(cut, F.lit("...")))
    )


def joined(sep: str, text: Column | str, *order: Column | str) -> Column:
    """Aggregate: texts of a bounded group joined in the given order (nulls skipped)."""
    text = col(text)
    keys = [col(o).alias(f"k{i}") for i, o in enumerate(order)]
    rows = F.collect_list(F.when(text.isNotNull(), F.struct(*keys, text.alias("v"))))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["v"]), sep)


def any_of(c: Column, literals) -> Column:
    """True when the column contains one of the literals (one alternation, compiled once)."""
    return c.rlike("|".join(_quote(x) for x in literals))


def _quote(text: str) -> str:
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/" else ch for ch in text)
