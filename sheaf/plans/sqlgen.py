"""Small builders for the SQL side of a check."""

from ..functions.text import SPACE


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{SPACE}+'), lambda x: x <> '')"


def terms(e: str) -> str:
    return f"list_distinct({words(f'lower({e})')})"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def tokens(e: str) -> str:
    return f"CAST(greatest(1, length({e}) // 4) AS INTEGER)"


def cost(e: str) -> str:
    return f"(7 + {tokens(e)})"


def clip(e: str, n: int, mark: str = "") -> str:
    return f"(CASE WHEN length({e}) > {n} THEN left({e}, {n}) || '{mark}' ELSE {e} END)"


def first_sentence(e: str) -> str:
    return strip(f"regexp_extract({e}, '^[^.。！？\n]*')")


def last_index(e: str, needle: str) -> str:
    return f"(CASE WHEN instr(reverse({e}), {needle}) = 0 THEN -1 ELSE length({e}) - instr(reverse({e}), {needle}) END)"


def cut_at_sentence(e: str, limit: int) -> str:
    cut = f"left({e}, {limit})"
    dot, nl = last_index(cut, "'.'"), last_index(cut, "chr(10)")
    return (f"(CASE WHEN coalesce({e}, '') = '' THEN '' WHEN length({e}) <= {limit} THEN {e} "
            f"WHEN {dot} > length({cut}) * 0.8 THEN left({cut}, CAST({dot} + 1 AS BIGINT)) "
            f"WHEN {nl} > length({cut}) * 0.8 THEN left({cut}, CAST({nl} AS BIGINT)) ELSE {cut} || '...' END)")


def text_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def contains_any(e: str, values) -> str:
    return "(" + " OR ".join(f"contains({e}, {lit(v)})" for v in values) + ")"


def host(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def bare_host(u: str) -> str:
    return f"replace(lower({host(u)}), 'www.', '')"


def depth(u: str) -> str:
    t = f"regexp_replace({path(u)}, '^/+|/+$', '', 'g')"
    return f"CAST(CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, '/')) END AS INTEGER)"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {inter}::DOUBLE / (len({a}) + len({b}) - {inter}) END)"
