"""HTML expressions: cleaning by tokens, text pieces, character references, head fields."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape as unescape_text
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .. import fixed_values as fixed
from .text import col, strip

ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
    ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&hellip;", "…"), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"), ("&euro;", "€"), ("&amp;", "&"),
)
_NOISY = "|".join(fixed.NOISE_CLASSES)
NOISE_ATTRIBUTE = "(?i)(<[a-z][^>]*?)\\s(?:on[a-z]*|style)\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s>]+)"
COMMENT = "(?s)<!--.*?-->"
TAG = "<[^>]*>"
MARK = "\x01"


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_FLAGS = re.IGNORECASE | re.DOTALL | re.ASCII
_OPENING = re.compile(r"<(?:!--|(/?)([a-z][^\s/>]*)[^>]*>|[!?][^>]*>)", _FLAGS)
_RAW_END = {name: re.compile(f"</{name}\\s*>", _FLAGS) for name in ("script", "style")}
_ATTRIBUTE = re.compile("\\s(?:on[a-z]*|style)\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s>]+)", _FLAGS)
_CLASS = re.compile("\\sclass\\s*=\\s*(?:\"([^\"]*)|'([^']*)|([^\\s>\"']+))", _FLAGS)
_NOISE = re.compile(_NOISY)


def clean(html: Column | str) -> Column:
    """The page without noise elements (by name, or a class that holds a noise word, on any element) and without event and style
    attributes. Null gives ''.

    Tags are read over a stack of open elements. An end tag closes the last open element of its name and all inside it;
    one that closes nothing is kept as it stands; what is never closed stays open to the end of the page. A stack is
    what column expressions lack: they would copy it at every tag. Pages go to Python in Arrow batches, and time is
    linear in a page's length, however its tags nest.
    """
    return _clean_pages(F.coalesce(col(html), F.lit("")))


@F.pandas_udf(StringType())
def _clean_pages(pages: pd.Series) -> pd.Series:
    return pages.map(clean_page)


def clean_page(html: str) -> str:
    kept: list[str] = []
    stack: list[str] = []
    held: Counter[str] = Counter()
    # Depth of the outermost noisy element that is open; behind the last '>' nothing is a tag.
    mute, at, last = 0, 0, html.rfind(">") + 1
    open_ended = set()
    while tag := _OPENING.search(html, at if at <= last else last, last):
        if not mute:
            kept.append(html[at:tag.start()])
        begin, at = tag.span()
        end, name = tag.group(1), (tag.group(2) or "").lower()
        if html.startswith("<!--", begin):
            close = -1 if "<!--" in open_ended else html.find("-->", begin + 4)
            if close < 0:
                open_ended.add("<!--")
                close = html.find(">", begin) - 2
            at = close + 3
        if not name:
            hidden = mute
        elif end:
            hidden = mute
            if held[name]:
                while True:
                    inner = stack.pop()
                    held[inner] -= 1
                    if inner == name:
                        break
                # An end tag belongs to the element it closes.
                hidden = 0 < mute <= len(stack) + 1
                if mute > len(stack):
                    mute = 0
        else:
            noisy = name in _NOISE_TAGS or _noisy_class(tag.group())
            hidden = mute or noisy
            raw = None
            if name in _RAW_END and name not in open_ended:
                # The text of these is no markup, as far as it ends.
                raw = _RAW_END[name].search(html, at)
                if raw:
                    at = raw.end()
                else:
                    open_ended.add(name)
            if name not in VOID and not raw:
                stack.append(name)
                held[name] += 1
                if noisy and not mute:
                    mute = len(stack)
        if not hidden:
            text = html[begin:at]
            kept.append(_ATTRIBUTE.sub("", text) if name and not end and "=" in text else text)
    if not mute:
        kept.append(html[at:])
    return "".join(kept)


_NOISE_TAGS = frozenset(fixed.NOISE_TAGS)


def _noisy_class(tag: str) -> bool:
    found = _CLASS.search(tag)
    return bool(found) and bool(_NOISE.search((found[1] or found[2] or found[3] or "").lower()))


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """A page as ("text", text, ""), ("open", name, tag) and ("close", name, "") in order; comments, scripts and styles out."""
    at, last, open_ended = 0, html.rfind(">") + 1, set()
    while tag := _OPENING.search(html, at if at <= last else last, last):
        begin, name = tag.start(), (tag.group(2) or "").lower()
        if begin > at:
            yield "text", html[at:begin], ""
        at = tag.end()
        if html.startswith("<!--", begin):
            close = -1 if "<!--" in open_ended else html.find("-->", begin + 4)
            if close < 0:
                open_ended.add("<!--")
                close = html.find(">", begin) - 2
            at = close + 3
        elif name and tag.group(1):
            yield "close", name, ""
        elif name:
            yield "open", name, tag.group()
            raw = None
            if name in _RAW_END and name not in open_ended:
                raw = _RAW_END[name].search(html, at)
                if raw:
                    at = raw.end()
                    yield "close", name, ""
                else:
                    open_ended.add(name)
    if at < len(html):
        yield "text", html[at:], ""


_PAIR = re.compile("\\s([^\\s=>/]+)\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))", _FLAGS)


def _marks(name: str, tag: str) -> tuple[frozenset, str]:
    """What selectors may call an element (its name, classes and id), and where it leads."""
    held = {m[1].lower(): unescape_text(m[2] or m[3] or m[4] or "") for m in _PAIR.finditer(tag)} if "=" in tag else {}
    marks = {name, *("." + c for c in held.get("class", "").split())}
    if "id" in held:
        marks.add("#" + held["id"])
    return frozenset(marks), held.get("href", "")


def select_results(html: str, layout: dict) -> list[tuple[str, str, str]]:
    """(title, href, snippet) of every result element of a page, in order, as far as it holds a title and a snippet.

    The first element inside a result that fits a selector counts; what it stands in may lie outside the result. Text nodes are
    stripped and put together. One walk over a stack of open elements: each tag is looked at once, a result takes one title
    and one snippet, so time is linear however results nest.
    """
    wanted = {part: [s.split() for s in layout[part]] for part in ("title", "snippet")}
    outer = {layout["within"]} | {s[0] for group in wanted.values() for s in group if len(s) > 1}
    fits = lambda part, marks: any(s[-1] in marks and (len(s) == 1 or inside[s[0]]) for s in wanted[part])
    stack: list[tuple[str, frozenset, list, list]] = []
    held, inside = Counter(), Counter()
    pieces: list[str] = []
    results: list[dict] = []
    lacking: dict[str, list[dict]] = {"title": [], "snippet": []}

    def shut() -> str:
        name, marks, spans, own = stack.pop()
        held[name] -= 1
        inside.subtract(marks & outer)
        for span in spans:
            span[1] = len(pieces)
        for result in own:
            for rows in lacking.values():
                if rows and rows[-1] is result:
                    rows.pop()
        return name

    for kind, value, tag in _tokens(html):
        if kind == "text":
            if text := unescape_text(value).strip():
                pieces.append(text)
        elif kind == "close":
            if held[value]:
                while shut() != value:
                    pass
        else:
            marks, href = _marks(value, tag)
            spans, own = [], []
            for part, rows in lacking.items():
                if rows and fits(part, marks):
                    span = [len(pieces), None, href]
                    spans.append(span)
                    for result in rows:
                        result[part] = span
                    rows.clear()
            if inside[layout["within"]] and any(s in marks for s in layout["result"]):
                own.append({})
                results.extend(own)
                for rows in lacking.values():
                    rows.extend(own)
            stack.append((value, marks, spans, own))
            held[value] += 1
            inside.update(marks & outer)
            if value in VOID:
                shut()
    text = lambda span: "".join(pieces[span[0]:span[1]])
    return [(text(r["title"]), r["title"][2], text(r["snippet"])) for r in results if len(r) == 2]


def results(html: Column | str, engine: Column | str) -> Column:
    """array<struct<title, href, snippet>> of stored results pages in their engine's layout; an unknown engine gives none."""
    return _select_pages(F.coalesce(col(html), F.lit("")), col(engine))


@F.pandas_udf(ArrayType(StructType([StructField(part, StringType()) for part in ("title", "href", "snippet")])))
def _select_pages(pages: pd.Series, engines: pd.Series) -> pd.Series:
    return pd.Series([
        [dict(zip(("title", "href", "snippet"), row)) for row in select_results(page, fixed.RESULT_LAYOUTS[engine])]
        if engine in fixed.RESULT_LAYOUTS else [] for page, engine in zip(pages, engines)], dtype=object)


#: References that most texts hold; the rest are looked up behind these.
COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "hellip": "…", "mdash": "—", "ndash": "–", "euro": "€"}


def _names() -> str:
    """Every named reference that ends in a semicolon, as a JSON map."""
    return json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


REFERENCE = "(?s)&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"


def _decoded(part: Column) -> Column:
    """The character of one reference; other pieces as they are. Numbers that name no character give U+FFFD."""
    body = F.substring(part, F.lit(2), F.length(part) - 2)
    names = F.from_json(F.lit(_names()), "map<string,string>")
    digits = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, F.lit(3), F.lit(9)), 16, 10)).otherwise(F.substring(body, F.lit(2), F.lit(18)))
    code = F.coalesce(digits.try_cast("long"), F.lit(0))
    good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(1))), 8, "0")), "UTF-32")).otherwise("\ufffd")
    # Numbers that pages mean as Windows-1252.
    windows = _literal_map({i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)})
    number = F.when(code.between(0x80, 0x9F), F.try_element_at(windows, code.cast("int"))).otherwise(char)
    return (F.when(~part.rlike("^&.+;$"), part).when(body.startswith("#"), number)
            .otherwise(F.coalesce(F.try_element_at(_literal_map(COMMON), body), F.try_element_at(names, body), part)))


def unescape(c: Column) -> Column:
    """Character references in one pass, so that nothing is decoded twice."""
    parts = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, _decoded), "")).otherwise(c)


def text_pieces(html: Column | str) -> Column:
    """Stripped, non-empty text nodes in order."""
    marked = F.regexp_replace(F.regexp_replace(col(html), COMMENT, ""), TAG, MARK)
    return F.filter(F.transform(F.split(marked, MARK), lambda x: strip(unescape(x))), lambda x: x != "")


def text_of(pieces: Column) -> Column:
    return F.regexp_replace(F.array_join(pieces, "\n"), "\n{3,}", "\n\n")


def first_group(html: Column | str, pattern: str) -> Column:
    return F.regexp_extract(col(html), pattern, 1)


def meta_content(html: Column | str, name: str) -> Column:
    tag = F.regexp_extract(col(html), f"(?is)<meta\\s[^>]*name\\s*=\\s*[\"']{name}[\"'][^>]*>", 0)
    return unescape(F.regexp_extract(tag, "(?is)\\scontent\\s*=\\s*[\"']([^\"']*)[\"']", 1))


def url_pattern(body: str, anchored: bool) -> str:
    return f"(?i)^{body}$" if anchored else f"(?i){body}"


def escape(text: str) -> str:
    return re.sub(r"([.\\+*?\[\]^$(){}|])", r"\\\1", text)
