"""Personal data, url rules and chat formatting against plain versions."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from sheaf.llm import chat, pii, url_rules

from helpers import DOCUMENTS, awkward, clashing

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x * 2 - 9 if i % 2 and x > 4 else x * (1 + i % 2) for i, x in enumerate(map(int, digits[::-1]))) % 10 == 0


def base(text):
    out = []
    for order, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "x-y", ".", "1", "22", "333", "5555 5555 5555 4444", "+", "+1 (", "555)", "-", " ", "é", "😀", "\n", "1.2.3.4", "256.1.1.1",
             "jo (at) mail (dot) com", "_", "a@b.co", "_d@e.f", "+1 (123) 555-1234"]
    made = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), None, None, None) for i in range(400)]
    return awkward(1, 30) + made + [(9998, "1" * 5000 + " " + "a" * 50_000 + "@", None, None, None),
                                    (9997, " ".join(f"12.{i % 300}.3.4" for i in range(600)), None, None, None)]


def test_base_spans_and_redaction(spark, rows):
    docs = clashing(spark.createDataFrame(rows, DOCUMENTS))
    model = pii.Model([], {})
    got = [tuple(r) for r in pii.report(docs, model).collect()]
    want = []
    for r in rows:
        b = base(r[1])
        s = ",".join(f"{k}:{a}:{e}" for a, _, e, k in b)
        want.append((r[0], *(sum(x[3] == k for x in b) for k in PLAIN), hashlib.sha256(s.encode()).hexdigest(), s))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    done = pii.redact(docs, model)
    assert done.columns == docs.columns
    clean = []
    for r in rows:
        out, at = [], 0
        for a, _, e, k in base(r[1]):
            if a >= at:
                out += [r[1][at:a], f"<{k}>"]
            at = max(at, e)
        clean.append((r[0], None if r[1] is None else "".join(out) + r[1][at:]))
    assert sorted(map(repr, ((x.doc_id, x.text) for x in done.collect()))) == sorted(map(repr, clean))
    assert pii.report(docs.limit(0), model).count() == 0


def test_learned_spans_are_added_and_base_stays(spark):
    rng = random.Random(9)
    def text(i):
        extra = rng.choice([f"{rng.choice(['mail', 'write to', 'see'])} {rng.choice(['jo', 'ann.lee', f'jo{i}'])}@{rng.choice(['mail', 'post', f'mail{i % 9}'])}.{rng.choice(['com', 'example.com', 'org'])}", f"host 10.{i % 255}.7.{i % 200}", f"call +1 ({100 + i % 800}) 555-{1000 + i}",
                            f"version {i}.2 of 2020", f"item {i} {i * 7} {i * 3}", "nothing"])
        return f"some words here {extra} and more words"
    made = [(i, text(i)) for i in range(1500)] + [(5000, "write to jo (at) mail (dot) com now"), (5001, "plain words only, chapter 3.2.1")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    model = pii.learn(docs, rounds=5)
    assert set(model.thresholds) >= {"email"}
    got = {r.doc_id: r for r in pii.report(docs, model).collect()}
    assert got[5000].spans == "email:9:31" and got[5000].n_email == 0 and got[5001].spans == ""
    for i, t in made[:1500]:
        b = {f"{k}:{a}:{e}" for a, _, e, k in base(t)}
        assert b <= set(got[i].spans.split(",")) | {""}
    assert pii.learn(docs.limit(0)).thresholds == {}


def url_brute(url):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    head = re.split(r"[?#]", rest)[0]
    host, slash, path = head.partition("/")
    host, path = host.translate(low), slash + path
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in url_rules.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    patterns = any(re.search(url_rules.pattern_regex(p), (url or "").translate(low)) for p in url_rules.PATTERNS)
    rule = max(fit, default=None)
    return host, path, rule and rule[2], rule[3] if rule else "block" if patterns else "allow"


def test_every_document_is_learned_from(spark, monkeypatch):
    """More documents than any sample once held: each candidate counts, and equal ones are one row."""
    docs = spark.range(20_500).selectExpr("id as doc_id", "concat('write to a', id % 7, '@b.cc or call 0', id % 10, '3 555 1234') as text")
    seen, keep = [], pii.saved

    def watched(df):
        seen.append(keep(df))
        return seen[-1]

    monkeypatch.setattr(pii, "saved", watched)
    pii.learn(docs, rounds=1)
    n, rows = seen[0].selectExpr("sum(n)", "count(*)").first()
    assert n == 2 * 20_500 and rows < 20


def test_url_rules(spark):
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.com", "m.www.example.com", "notexample.com", "casino-win.example.com", "a.net", "net", "free-bets.example.org", "com", "exÀmple.com", "", "u@x.com:80"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/?q=1", "/de/#x", "?a=://b", "#top", "/en/a://b", "/banner/1-ad-2"]
    urls = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', '://', ':/', ''])}{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "://", "a://b://c/en/", "x\n://y.com/"]
    made = [(i if i % 9 else None, u) for i, u in enumerate(urls)] + [(1, urls[1])] * 3
    pages = clashing(spark.createDataFrame(made, "page_id long, url string"))
    rules = url_rules.rule_table(spark, url_rules.HOST_RULES, url_rules.PATTERNS)
    got = [tuple(r) for r in url_rules.judge_urls(pages, rules).drop("patterns").collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *url_brute(u))) for i, u in made)
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    open_to_all = url_rules.judge_urls(pages, url_rules.rule_table(spark, [], []).limit(0))
    assert {r.verdict for r in open_to_all.collect()} == {"allow"}


def test_chat_round_trip(spark):
    rng = random.Random(1)
    parts = ["a", "\n", "\x1b", "n", chat.START, chat.END, "é", "😀", "<|", "assistant", "\x1bn", ""]
    roles = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(800)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    made = chat.assemble(pa.array(roles), pa.array(texts)).to_pylist()
    assert [chat.parse(m) for m in made] == list(zip(roles, texts))
    turns = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", None, *roles[:3]]), rng.choice([*texts[:20], None])) for _ in range(200)]
    turns += [turns[0]] * 3 + [(9, 0, "assistant", "x" * 500_000)]
    df = clashing(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    groups = collections.defaultdict(list)
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    for c, *t in sorted(turns, key=lambda r: tuple(map(order, r))):
        groups[c].append(t)
    want = []
    for c, ts in groups.items():
        loss = "".join(t[2] or "" for t in ts if t[1] == "assistant")
        want.append((c, len(ts), hashlib.sha256("".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = [tuple(r)[:5] for r in chat.digest(chat.format_turns(df)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0
