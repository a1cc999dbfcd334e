"""Personal data by weak supervision, in DataFrame functions only.

Patterns find spans.  Four labelers (form, gazetteer, context, shape) vote for, against or not at all on every
span; expectation-maximisation over the counted vote patterns estimates how reliable each labeler is, without any
labels.  Its beliefs train a naive Bayes classifier over span features, which decides on the spans that only
the wider patterns find.  Spans of the four base patterns that pass their checks always stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .scan import id_and_text

KINDS = ("email", "ip", "card", "phone")
ADDED = ("phone", "secret")  # kinds of the wider patterns, after the base ones
NAMES = (*KINDS, *ADDED)
BLOCK = 256  # matches summed at once for positions
NEAR = 32  # characters before a span that count as its context
ROUNDS = 30
ACCEPT = 0.5

# Equal to the plain patterns, but linear: a match can only start where a run starts or the last match ended,
# and possessive repeats don't give back what could not help.
_RUN = "(?:(?<![{0}])|\\G)[{0}]++"
PATTERNS = (
    _RUN.format("A-Za-z0-9._%+-") + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    _RUN.format("0-9") + r"\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![0-9A-Za-z+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,128}+(?![A-Za-z0-9_/+-])",
)
# A cheap test that a text can match at all.
_NEEDS = ("@", ".", None, "+", None, None)

# Gazetteers of top-level domains, country codes, card issuers, key prefixes, and context words.
TOP_LEVEL = r"\.(com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl|ch|at|be|us|ca|au|jp|in|br)$"
COUNTRY = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[1-9]|42[01])(?![0-9]{14})"
ISSUER = r"^(3[47]|4|5[1-5]|2[2-7]|6)"
KEY_PREFIX = r"^(sk|pk|rk|ghp|gho|xox[abp]|AKIA|ASIA|AIza|eyJ)"
CONTEXT = (
    r"mail|contact|write to|from:|to:",
    r"\bip\b|host|server|address|login|from",
    r"card|visa|master|amex|payment|credit|pan\b",
    r"phone|tel|call|fax|mobile|contact|cell",
    r"phone|tel|call|fax|mobile|contact|cell",
    r"key|token|secret|passw|credential|auth|bearer",
)
AGAINST = r"version|release|isbn|issue|order|invoice|page|figure|section|sha|commit|checksum|hash|http"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the optimiser does."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(text: Column, kind: int) -> Column:
    """The text cut at the matches: array of ``(gap, hit)``, the last hit null.  Joined again it is the text."""
    pattern = F.lit(PATTERNS[kind])
    cut = F.zip_with(
        F.split(text, PATTERNS[kind], -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")),
    )
    if _NEEDS[kind] is None:
        return cut
    none = F.array(F.struct(text.alias("gap"), F.lit(None).cast("string").alias("hit")))
    return F.when(F.contains(text, F.lit(_NEEDS[kind])), cut).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def passes(hit: Column, kind: int) -> Column:
    """The check of a base kind; spans of wider patterns have none."""
    if kind == 1:
        return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == 2:
        return _let(_digits(hit), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == 3:
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, 1)
    return (vote if no is None else vote.when(no, 0)).otherwise(-1)


def votes(hit: Column, before: Column, kind: int) -> list[Column]:
    """For (1), against (0) or no vote (-1) by form, gazetteer, context and shape."""
    mixed_token = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    turns = F.length(F.regexp_replace(F.regexp_replace(hit, "[0-9]+", "0"), "[^0]", ""))
    form = (
        lambda: _vote(hit.rlike(r"^[^@]{1,64}@.*\.[A-Za-z]{2,}$"), ~hit.rlike(r"\.[A-Za-z]{2,}$")),
        lambda: _vote(~hit.rlike(r"(^|\.)0[0-9]"), hit.rlike(r"(^|\.)0[0-9]")),
        lambda: _vote(F.lit(True)),
        lambda: _vote(F.length(_digits(hit)).between(10, 15), F.lit(True)),
        lambda: _vote(hit.rlike(r"^(\([0-9]{3}\) ?|[0-9]{3}([ .-]))[0-9]{3}[ .-][0-9]{4}$"), F.lit(True)),
        lambda: _vote(mixed_token, ~mixed_token),
    )[kind]()
    listed = (
        lambda: _vote(F.lower(hit).rlike(TOP_LEVEL)),
        lambda: _vote(~hit.rlike(r"^(10|127|0|255|192\.168|169\.254)\."), F.lit(True)),
        lambda: _vote(hit.rlike(ISSUER), F.lit(True)),
        lambda: _vote(F.concat(F.lit("+"), _digits(hit)).rlike(COUNTRY), F.lit(True)),
        lambda: _vote(hit.rlike(r"^\(?[2-9]"), F.lit(True)),
        lambda: _vote(hit.rlike(KEY_PREFIX)),
    )[kind]()
    context = _vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST))
    shape = (
        lambda: _vote(hit.rlike(r"^[^@]*[A-Za-z]"), F.lit(True)),
        lambda: _vote(F.length(hit) >= 9),
        lambda: _vote(hit.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), F.lit(True)),
        lambda: _vote(hit.rlike("[ ().-]")),
        lambda: _vote(hit.rlike(r"\(|-")),
        lambda: _vote(mixed_token & (turns >= 4), turns <= 1),
    )[kind]()
    return [form, listed, context, shape]


def _features(hit: Column, before: Column, kind: int) -> list[Column]:
    """Kind, length, number of digits and what stands right before, each as a small number."""
    length = F.least(F.floor(F.length(hit) / 6), F.lit(9))
    digits = F.least(F.floor(F.length(_digits(hit)) / 3), F.lit(9))
    last = F.when(before.rlike(r"\s$"), 1).when(before.rlike("[\"'=]$"), 2).when(before.rlike("[:(<\\[]$"), 3).otherwise(0)
    return [F.lit(kind), length.cast("int"), digits.cast("int"), last]


def spans(text: Column, kind: int, evidence: bool = True) -> Column:
    """Array of ``(kind, start, stop)`` and with ``evidence`` votes and features: the matches that pass, in code
    points, the stop exclusive."""
    size = F.char_length

    def placed(ps: Column) -> Column:
        steps = F.transform(ps, lambda p: (size(p["gap"]) + F.coalesce(size(p["hit"]), F.lit(0))).cast("long"))

        def sums(both: Column) -> Column:
            steps, blocks = both["steps"], both["blocks"]

            def total(values: Column, start: Column, n: Column) -> Column:
                return F.aggregate(F.slice(values, start, n), F.lit(0).cast("long"), lambda a, x: a + x)

            def span(p: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                start = (
                    total(blocks, F.lit(1), block) + total(steps, block * BLOCK + 1, (i % BLOCK).cast("int")) + size(p["gap"])
                )
                fields = [F.lit(kind).alias("kind"), start.alias("start"), (start + size(p["hit"])).alias("stop")]
                if evidence:
                    before = F.lower(F.substring(p["gap"], -NEAR, NEAR))
                    fields.append(_let(before, lambda b: F.array(*votes(p["hit"], b, kind))).alias("votes"))
                    fields.append(_let(before, lambda b: F.array(*_features(p["hit"], b, kind))).alias("features"))
                return F.when(p["hit"].isNotNull() & passes(p["hit"], kind), F.struct(*fields))

            return F.filter(F.transform(ps, span), lambda s: s.isNotNull())

        def blocks(steps: Column) -> Column:
            every = F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int"))
            add = F.transform(
                every, lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("long"), lambda a, x: a + x)
            )
            return F.struct(steps.alias("steps"), add.alias("blocks"))

        return _let(_let(steps, blocks), sums)

    return _let(parts(text, kind), placed)


def found_spans(texts: DataFrame) -> DataFrame:
    """``text`` columns replaced by ``spans``: all spans with evidence.  Spans of wider patterns that touch a base
    span are left out."""
    n = len(KINDS)
    base = F.concat(*[spans(F.col("text"), k) for k in range(n)])
    more = F.concat(*[spans(F.col("text"), k) for k in range(n, len(NAMES))])

    def apart(both: Column) -> Column:
        clear = F.filter(
            both["more"],
            lambda m: ~F.exists(both["base"], lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])),
        )
        return F.concat(both["base"], clear)

    kept = [c for c in texts.columns if c != "text"]
    return texts.select(*kept, _let(F.struct(base.alias("base"), more.alias("more")), apart).alias("spans"))


def vote_counts(found: DataFrame) -> DataFrame:
    """``votes, features, n``: how often each combination occurs; its rows are bounded by the small value ranges."""
    one = found.select(F.explode("spans").alias("s")).select("s.votes", "s.features")
    return one.groupBy("votes", "features").agg(F.count(F.lit(1)).alias("n"))


def estimate(rows: list[tuple[list[int], list[int], int]]) -> tuple[list[float], list[tuple[float, float]]]:
    """Belief in each counted combination, and per labeler the chance of a vote for it on true and on false spans.

    Expectation-maximisation from reliabilities of 0.8; votes are independent given the truth, and no vote says nothing.
    """
    labelers = range(4)
    rates, prior = [(0.8, 0.2)] * 4, 0.5
    beliefs = [0.5] * len(rows)
    for _ in range(ROUNDS):
        for i, (vote, _, _) in enumerate(rows):
            odds = math.log(prior / (1 - prior))
            for k in labelers:
                if vote[k] >= 0:
                    yes, no = rates[k]
                    odds += math.log(yes / no) if vote[k] else math.log((1 - yes) / (1 - no))
            beliefs[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(n for _, _, n in rows)
        prior = min(0.99, max(0.01, (sum(b * n for b, (_, _, n) in zip(beliefs, rows)) + 1) / (total + 2)))
        rates = []
        for k in labelers:
            cast = [(b, v[k], n) for b, (v, _, n) in zip(beliefs, rows) if v[k] >= 0]
            yes = (sum(b * v * n for b, v, n in cast) + 4) / (sum(b * n for b, _, n in cast) + 5)
            no = (sum((1 - b) * v * n for b, v, n in cast) + 1) / (sum((1 - b) * n for b, _, n in cast) + 5)
            rates.append((min(0.999, max(0.001, yes)), min(0.999, max(0.001, no))))
    return beliefs, rates


def train(rows: list[tuple[list[int], list[int], int]], beliefs: list[float]) -> tuple[float, list[dict[int, float]]]:
    """Naive Bayes over votes and features, weighted by the beliefs: log odds of the prior, and of each value."""
    true, false = sum(b * n for b, (_, _, n) in zip(beliefs, rows)), sum((1 - b) * n for b, (_, _, n) in zip(beliefs, rows))
    weights: list[dict[int, float]] = []
    width = len(rows[0][0]) + len(rows[0][1]) if rows else 0
    for k in range(width):
        sums: dict[int, list[float]] = {}
        for b, (vote, features, n) in zip(beliefs, rows):
            at = sums.setdefault([*vote, *features][k], [0.0, 0.0])
            at[0] += b * n
            at[1] += (1 - b) * n
        size = len(sums)
        weights.append({v: math.log((t + 1) / (true + size) * (false + size) / (f + 1)) for v, (t, f) in sums.items()})
    return math.log((true + 1) / (false + 1)), weights


class Classifier:
    """The trained span classifier as an expression."""

    def __init__(self, found: DataFrame):
        rows = sorted((list(r["votes"]), list(r["features"]), r["n"]) for r in vote_counts(found).collect())
        beliefs, self.rates = estimate(rows)
        self.prior, self.weights = train(rows, beliefs)

    def accepts(self, span: Column) -> Column:
        odds = F.lit(self.prior)
        every = F.concat(span["votes"], span["features"])
        for k, values in enumerate(self.weights):
            term = F.lit(0.0)
            for value, weight in sorted(values.items()):
                term = F.when(every[k] == value, weight).otherwise(term)
            odds = odds + term
        return odds >= math.log(ACCEPT / (1 - ACCEPT))


def _line(found: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    rank = {n: i for i, n in enumerate(dict.fromkeys(NAMES))}
    order = F.array(*[F.lit(rank[n]) for n in NAMES])
    keyed = F.transform(found, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    The counts and the digest are of base spans; ``spans`` lists these and the ones the classifier adds, as
    kind:start:end.  A null or empty text has none.  Repeated rows and null ids stay; an empty table gives no rows.
    """
    found = stage(found_spans(id_and_text(docs, id_col, text_col)), "spans")
    classifier = Classifier(found)
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    every = F.filter("spans", lambda s: (s["kind"] < len(KINDS)) | classifier.accepts(s))
    of_kind = [F.expr(f"filter(spans, s -> s.kind = {k})") for k in range(len(KINDS))]
    counts = [F.size(of).cast("bigint").alias(f"n_{n}") for of, n in zip(of_kind, KINDS)]
    return found.select("doc_id", *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line(every).alias("spans"))


def _marker(kind: int, classifier: Classifier) -> Callable[[Column], Column]:
    """The text with a mark in place of the accepted matches of one kind."""

    def put(p: Column) -> Column:
        hit, take = p["hit"], passes(p["hit"], kind)
        if kind >= len(KINDS):
            before = F.lower(F.substring(p["gap"], -NEAR, NEAR))
            evidence = F.struct(
                F.array(*votes(hit, before, kind)).alias("votes"), F.array(*_features(hit, before, kind)).alias("features")
            )
            take = _let(evidence, classifier.accepts)
        return F.concat(p["gap"], F.when(hit.isNull(), "").when(take, F.lit(f"<{NAMES[kind]}>")).otherwise(hit))

    def marked(text: Column) -> Column:
        return F.when(text.isNull(), text).otherwise(F.array_join(F.transform(parts(text, kind), put), ""))

    return marked


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span in place of its text as ``<kind>``, kind after kind.

    The classifier is trained on these documents.  A null text stays null.
    """
    plain = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    classifier = Classifier(found_spans(plain.withColumn("row", F.lit(0))))
    text = F.col(text_col).cast("string")
    for kind in range(len(NAMES)):
        text = _let(text, _marker(kind, classifier))
    return docs.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
