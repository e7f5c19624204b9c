"""Personal data: strict patterns, and boosted trees over high-recall candidates.

Base spans are matches of strict patterns that pass their checks (octets, Luhn, digit counts). Generators then propose
spans of looser form: written-out at and dot signs, numbers with other separators, phone numbers without a country. Gradient
boosted trees, fitted on all of them with labels that come from the strict checks, score a candidate by its format
(after undoing the writing-out) and its context, never by the check itself. Per kind, a threshold with the asked precision on
held-out rows selects; what it selects is added where no base span lies. Everything is column expressions inside the
row: the trees become nested conditionals, so documents are read once and nothing is shuffled.

Patterns use possessive repeats and start only where a run starts or the last match ended. They find the same as the plain
forms but never try a long run again from each of its characters.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, saved, text_of

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this holds no match; saves most texts the longer pattern.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[({]\x20?at\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\x20?[\[(]\.[\])]\x20?)[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9.])[0-9]{3,4}+(?:[\x20./_-]?[0-9]{3,4}+){3,4}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]?[\x20.-]?)?\(?[0-9]{2,4}+\)?[\x20./-][0-9]{3,4}+[\x20./-][0-9]{3,5}+(?![0-9])",
}
LOOSE_HINT = {"email": r"@|[\[({]\x20?at\x20?[\])}]", "ip": r"[0-9][.\])]", "card": r"[0-9]{3}", "phone": r"[0-9][)\x20./-]+[0-9]"}
WORDS = {"mail": "mail|contact|write|correo|courriel", "call": "phone|tel|call|fax|mobil", "pay": "card|visa|pay|credit|iban|bank", "net": r"\bip\b|host|server|addr"}
#: More than a feature has values.
BINS = 1024
CONTEXT, PRECISION, LEAST_HELD = 24, 0.95, 20
FEATURES = ("kind_no", "n_chars", "n_digits", "n_letters", "n_dots", "n_gaps", "n_parts", "longest", "before_word", "before_mark", "after_word",
            "mail", "call", "pay", "net", "quoted")


def _length_sums(lengths: Column) -> Column:
    """Running sums of a short array."""
    return F.aggregate(lengths, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))


#: Length of the runs in which sums are made, so that a text with very many matches takes no quadratic time.
RUN = 256


def _runs(lengths: Column) -> Column:
    return F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(RUN)), lambda k: F.slice(lengths, k + 1, RUN))).otherwise(
        F.array().cast("array<array<int>>"))


def _ends(runs: Column, before: Column) -> Column:
    """Running sums over all runs, given the sums at the ends of runs."""
    return F.flatten(F.transform(runs, lambda r, i: F.transform(_length_sums(r), lambda x: x + F.coalesce(F.get(before, i - 1), F.lit(0)))))


def find(df: DataFrame, patterns: dict[str, str], hints: dict[str, str], out: str) -> DataFrame:
    """Adds array column ``out_<kind>`` of (start, end, match) per kind: leftmost non-overlapping matches, in code points."""
    kept = [F.col(c) for c in df.columns]
    text = F.col("text")
    step = df
    for k, p in patterns.items():
        near = text.rlike(hints[k]) if hints[k] != "@" else F.contains(text, F.lit("@"))
        none = F.array().cast("array<string>")
        step = step.withColumns({f"_m_{k}": F.when(near, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none)})
        # The pieces between matches give the starts.
        step = step.withColumn(f"_g_{k}", F.when(F.size(f"_m_{k}") > 0, F.split(text, p, -1)).otherwise(none))
    both = {k: F.zip_with(F.slice(f"_g_{k}", F.lit(1), F.size(f"_m_{k}")), F.col(f"_m_{k}"), lambda g, m: F.length(g) + F.length(m)) for k in patterns}
    step = step.select(*kept, *[f"_m_{k}" for k in patterns], *[_runs(b).alias(f"_r_{k}") for k, b in both.items()])
    base = {k: _length_sums(F.transform(f"_r_{k}", lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x))) for k in patterns}
    step = step.select("*", *[b.alias(f"_b_{k}") for k, b in base.items()])
    ends = {k: _ends(F.col(f"_r_{k}"), F.col(f"_b_{k}")) for k in patterns}
    spans = {k: F.zip_with(e, F.col(f"_m_{k}"), lambda x, m: F.struct((x - F.length(m)).alias("start"), x.alias("end"), m.alias("match"))) for k, e in ends.items()}
    return step.select(*kept, *[s.alias(f"{out}_{k}") for k, s in spans.items()])


def luhn(digits: Column) -> Column:
    d = F.split(F.reverse(digits), "")
    value = F.transform(d, lambda x, i: x.cast("int") * (i % 2 + 1))
    return F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda s: valid(kind, s["match"])


def _plain(spans: Column, order: int, kind: str, more=lambda s: []) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), *more(s)))


def _surrounded(s: Column) -> Column:
    text = F.col("text")
    plain = F.regexp_replace(F.regexp_replace(s["match"], r"\x20?[\[({]\x20?at\x20?[\])}]\x20?", "@"), r"\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?", ".")
    before = lower_ascii(F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))))
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), plain.alias("plain"), before.alias("before"),
                    F.substring(text, s["end"] + 1, F.lit(1)).alias("after"))


def _described(order: int):
    return lambda s: _features(s["plain"], s["before"], s["after"], order)


def base_spans(documents: DataFrame) -> DataFrame:
    """Adds ``base``: (start, order, end, kind) of all valid strict matches, in order of start, then kind as listed."""
    found = find(documents, BASE, HINT, "_f")
    kept = [_plain(F.filter(f"_f_{k}", _checked(k)), i, k) for i, k in enumerate(KINDS)]
    return found.select(*documents.columns, F.sort_array(F.concat(*kept)).alias("base"))


def candidates(documents: DataFrame) -> DataFrame:
    """Adds ``loose``: (start, order, end, kind, features) of all loose matches; spans of different kinds may overlap."""
    found = find(documents, LOOSE, LOOSE_HINT, "_l")
    # The surroundings are cut once per candidate, in a step of their own.
    found = found.select(*documents.columns, *[F.transform(f"_l_{k}", _surrounded).alias(f"_l_{k}") for k in KINDS])
    made = [_plain(F.col(f"_l_{k}"), i, k, _described(i)) for i, k in enumerate(KINDS)]
    return found.select(*documents.columns, F.sort_array(F.concat(*made)).alias("loose"))


def _features(plain: Column, before: Column, after: Column, order: int) -> list[Column]:
    parts = F.split(plain, r"[\x20().@/_-]+|\.")
    number = lambda c: c.cast("double")
    values = [
        F.lit(float(order)), number(F.length(plain)), number(F.length(F.regexp_replace(plain, "[^0-9]", ""))),
        number(F.length(F.regexp_replace(plain, "[^A-Za-z]", ""))), number(F.length(F.regexp_replace(plain, "[^.]", ""))),
        number(F.length(F.regexp_replace(plain, r"[^\x20()/_-]", ""))), number(F.size(parts)),
        number(F.aggregate(parts, F.lit(0), lambda a, x: F.greatest(a, F.length(x)))),
        number(before.rlike("[A-Za-z0-9]$")), number(before.rlike(r"[\"'=#$%&*|]\x20?$")), number(after.rlike("[A-Za-z0-9]")),
        *[number(before.rlike(w)) for w in WORDS.values()], number(before.rlike("\"[^\"]*$")),
    ]
    return [F.coalesce(v, F.lit(0.0)).alias(f) for v, f in zip(values, FEATURES)]


def overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


class Model:
    """Boosted trees as (weight, tree) pairs and a threshold per kind; empty when there was nothing to learn from."""

    def __init__(self, trees: list[tuple[float, tuple]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, s: Column) -> Column:
        """Probability, as the ensemble of regression trees gives it: 1 / (1 + exp(-2 * sum))."""
        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * _expression(tree, s)
        return 1 / (1 + F.exp(-2 * total))

    def selected(self, spans: Column) -> Column:
        """The spans that reach their kind's threshold; each is scored once."""
        def reaches(s):
            least = F.lit(2.0)
            for k, t in self.thresholds.items():
                least = F.when(s["kind"] == k, F.lit(t)).otherwise(least)
            return self.score(s) >= least

        return F.filter(spans, reaches)


def _expression(tree: tuple, s: Column) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    feature, threshold, left, right = tree
    return F.when(s[feature] <= threshold, _expression(left, s)).otherwise(_expression(right, s))


def _parsed(lines: list[str]) -> tuple:
    """A tree from its printed form: If (feature i <= t) .. Else .. Predict: v."""
    line = lines.pop(0).strip()
    if m := re.match(r"Predict: (\S+)", line):
        return (float(m[1]),)
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    left = _parsed(lines)
    lines.pop(0)  # Else
    return FEATURES[int(m[1])], float(m[2]), left, _parsed(lines)


def learn(documents: DataFrame, rounds: int = 10, depth: int = 3, precision: float = PRECISION) -> Model:
    """Fits on the candidates of all documents; half of the documents, by hash of the id, are held out for the thresholds.

    A candidate's label is whether it overlaps a base span of its kind. Without both labels the model selects nothing. Features are
    counts bounded by the loose patterns, so candidates are counted per distinct description, and trees and thresholds weigh each by its
    count. All of these fit in one task, which sums them in one order: the same table gives the same trees. ``BINS`` is so
    large that every value of a feature is a possible threshold and MLlib draws no sample to find them.
    """
    spans = candidates(base_spans(documents.select("doc_id", text_of("text").alias("text")))).select(
        "doc_id", "base", F.explode("loose").alias("s"))
    own = F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]) & (b["kind"] == F.col("s.kind")))
    held = F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit(1)) == 1
    described = spans.select(F.col("s.kind").alias("name"), own.cast("double").alias("label"), held.alias("held"), *[F.col(f"s.{f}").alias(f) for f in FEATURES])
    data = saved(described.groupBy(*described.columns).agg(F.count(F.lit(1)).cast("double").alias("n")))
    fit = data.filter("not held").groupBy("label", *FEATURES).agg(F.sum("n").alias("n"))
    if fit.select("label").distinct().count() < 2:
        return Model([], {})
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(fit.repartition(1).sortWithinPartitions("label", *FEATURES))
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=BINS, weightCol="n", seed=7).fit(rows.select("label", "features", "n"))
    trees = []
    for tree, weight in zip(fitted.trees, fitted.treeWeights):
        trees.append((float(weight), _parsed([x for x in tree.toDebugString.splitlines()[1:] if x.strip()])))
    model = Model(trees, {})
    bins = (data.filter("held").select("name", "label", "n", F.floor(model.score(F.struct(*FEATURES)) * 100).alias("bin"))
            .groupBy("name", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect())
    for kind in KINDS:
        good = n = 0
        for b, g, c in sorted(((r["bin"], r["good"], r["n"]) for r in bins if r["name"] == kind), reverse=True):
            good, n = good + g, n + c
            if n >= LEAST_HELD and good >= precision * n:
                model.thresholds[kind] = b / 100
    return model


def find_spans(documents: DataFrame, model: Model) -> DataFrame:
    """Input columns with ``base`` and ``spans``: all base spans, and selected candidates that overlap none.

    Null text counts as empty and has no spans; each row is judged by itself, so repeated rows and null ids are harmless.
    ``text`` comes back as read, null as empty.
    """
    read = candidates(base_spans(documents.withColumn("text", text_of("text"))))
    plain = lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))
    # Most selected candidates are base spans themselves: those go by hash, so that few are left to be compared with all.
    added = F.array_except(F.transform(model.selected(F.col("loose")), plain), "base") if model.thresholds else F.array().cast(
        "array<struct<start:int,order:int,end:int,kind:string>>")
    read = read.select(*documents.columns, "base", added.alias("added"))
    added = F.filter("added", lambda s: ~overlaps(F.col("base"), s))
    return read.select(*documents.columns, "base", F.sort_array(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_<kind> of base spans, base_sha256, spans."""
    found = find_spans(documents.select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """Same rows and columns; every span's characters give way to <kind>, overlapping spans to the first one's; n_chars follows."""
    names = documents.columns
    packed = documents.select("text", F.struct(*[F.col(c) for c in names]).alias("row"))
    found = find_spans(packed, model)
    fold = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["parts"], F.array(
                F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("parts"))))
    folded = found.select("row", "text", "spans", F.when(F.size("spans") > 0, fold).alias("f"))
    new = F.when(F.col("row.text").isNotNull(), F.when(F.col("f").isNull(), F.col("text")).otherwise(
        F.concat(F.array_join("f.parts", ""), F.substring(F.col("text"), F.col("f.at") + 1, F.length("text")))))
    done = folded.select("row", new.alias("new"), F.col("f").isNotNull().alias("changed"))
    out = {"text": F.col("new"), "n_chars": F.when(F.col("changed"), F.length("new").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in names else None}
    return done.select(*[(out[c] if c in out else F.col("row").getField(c)).alias(c) for c in names])
