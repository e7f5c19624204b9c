"""URL expressions.

Hosts and paths are cut out with patterns rather than a URL parser because the stored
links hold characters (``für``, ``|``) that strict parsers reject.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def scheme(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(u), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(u: Column | str) -> Column:
    """Network location, port included; '' when there is none."""
    return F.regexp_extract(col(u), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(u: Column | str) -> Column:
    return F.regexp_extract(col(u), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def bare_host(u: Column | str) -> Column:
    return F.replace(F.lower(host(u)), F.lit("www."), F.lit(""))


def depth(u: Column | str) -> Column:
    """Path segments after trimming slashes; inner empty segments count, as in a split on '/'."""
    trimmed = F.regexp_replace(path(u), "^/+|/+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "/"))).cast("int")


def fold_dots(path: Column) -> Column:
    """A path that starts with '/', its ``.`` and ``..`` segments folded at any depth; steps above the root are dropped."""
    segments = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda held, s: F.when(s == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))))
        .when(s == ".", held).otherwise(F.concat(held, F.array(s))))
    # A path that ends in a dot segment names a folder.
    folder = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), folder)
    return F.when(path.rlike(r"/\.\.?(/|$)"), folded).otherwise(path)


def resolve(base: Column | str, href: Column | str) -> Column:
    """Absolute form of ``href`` seen from ``base``: absolute, protocol-relative, root-relative, query-only, fragment-only and
    plain relative links, dot segments folded at any depth."""
    base, href = col(base), col(href)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path(base), "^/", "")), "[^/]*$", "")
    own, rest = F.regexp_extract(href, r"(?s)^[^?#]*", 0), F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, fold_dots(own), rest))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(root, fold_dots(F.concat(folder, own)), rest))
    )


def page_key(u: Column | str) -> Column:
    """Trailing slashes dropped, then cut at the first '?'."""
    return F.substring_index(F.regexp_replace(col(u), "/+$", ""), "?", 1)


def normalize(u: Column | str) -> Column:
    return F.when(col(u).startswith("www."), F.concat(F.lit("https://"), col(u))).otherwise(col(u))
