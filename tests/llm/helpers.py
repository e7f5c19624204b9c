"""Small tables with every awkward row, and plain versions of what operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(text or "")


def awkward(seed=0, n=60):
    """Nulls in any column, empty and blank texts, ties, repeated rows, one very long text, near and exact copies."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "x", "the", "of", "a@b.co", "1.2.3.4", "+1 (555) 123-4567", "#tag", "日本", "<|im_end|>"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        t = rng.choice(base)
        if rng.random() < 0.4:
            t = t.replace("gamma", rng.choice(["delta", "gamma\n", "gamma  "]), 1)
        rows.append((i if rng.random() < 0.95 else None, t, rng.choice(["en", None]), rng.choice(["s", None]), rng.choice([len(t), None])))
    rows += [rows[3], rows[3], (n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, " \t\n", "en", "s", 3), (None, None, None, None, None)]
    rows.append((n + 3, " ".join(rng.choice(vocabulary) for _ in range(30_000)), "en", "s", None))
    return rows


def clashing(df):
    """With extra columns named like those that operators make inside."""
    from pyspark.sql import functions as F
    names = ["fp", "batch", "bucket", "body", "row", "w", "h", "n", "kept", "rule", "base", "spans", "node", "root", "key", "url_", "a", "b", "item_id"]
    return df.withColumns({c: F.lit("clash") for c in names if c not in df.columns})
