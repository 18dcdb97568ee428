"""Personal data by weak supervision, in column expressions alone.

Patterns propose spans; labelers (shape, gazetteer, context, surroundings, variety,
length) vote on each; expectation-maximisation estimates how far each labeler can be
trusted; a logistic classifier trained on the resulting probabilities decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.common import unused_name

# What the four base kinds look like. Starts are tied to the beginning
# of a run, or to the end of the last match, and repetitions are possessive: the same
# matches as the plain patterns, in time that grows with the text alone.
_NAME = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Added kinds, proposed generously and left to the vote.
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)

# Words whose presence shortly before a span speaks for its kind.
GAZETTEER = {
    "email": "mail|contact|write|address", "ip": r"\bip\b|host|server|addr",
    "card": "card|visa|payment|credit|account", "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte", "local_phone": "phone|tel|call|mobile|fax",
    "secret": "token|secret|passw|api|auth|bearer|key|credential",
    "ssn": "ssn|social|security|insurance",
}
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at"
CONTEXT = 32
LABELERS = ("shape", "gazetteer", "context", "surroundings", "variety", "length")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = digits.substr(n - i, F.lit(1)).cast("int")
        doubled = 2 * d
        return F.when(i % 2 == 0, d).when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    """The exact condition of a base kind; for an added kind, what its strict form asks for."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return text.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(text)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    if kind == "secret":
        return text.rlike("^[0-9a-fA-F]+$") | (
            text.rlike("[0-9].*[0-9]") & text.rlike("[a-z]") & text.rlike("[A-Z]"))
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _worth_a_vote(kind: str, text: Column) -> Column:
    if kind == "secret":
        return text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    return F.lit(True) if kind not in BASE_KINDS else _valid(kind, text)


def _votes(kind: str, text: Column, before: Column, after: Column) -> Column:
    """One of -1 (against), 0 (no opinion), 1 (for) by each labeler."""
    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    never = F.lit(False)
    variety = F.size(F.array_distinct(F.split(F.lower(text), "(?<=.)(?=.)")))
    named = F.lower(before).rlike(f"(?:{GAZETTEER[kind]})[^\\n]*$")
    if kind == "email":
        named = named | F.lower(text).rlike(rf"\.(?:{DOMAINS})$")
    usual = {"email": (6, 60), "ip": (7, 15), "card": (13, 23), "phone": (10, 22), "iban": (15, 40),
             "local_phone": (12, 14), "secret": (24, 128), "ssn": (11, 11)}[kind]
    return F.array(
        vote(_valid(kind, text), ~_valid(kind, text)),
        vote(named, never),
        vote(before.rlike("[=:][ \"'<(]*$|[\"'<(]$"), never),
        vote(~before.rlike("[A-Za-z0-9_]$") & ~after.rlike("^[A-Za-z0-9_]"),
             before.rlike("[A-Za-z0-9_]$") & after.rlike("^[A-Za-z0-9_]")),
        vote(variety >= 5, variety <= 2),
        vote(F.length(text).between(*usual), F.length(text) > 2 * usual[1]))


def _spans(text: Column, kind: str) -> Column:
    """kind number, start, end (code points, end exclusive) and votes of the kind's proposals."""
    pattern = F.lit(PATTERNS[kind])
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    n = F.size(found)
    proposals = F.zip_with(
        F.arrays_zip(F.slice(pieces, 1, n).alias("before"), F.slice(pieces, 2, n).alias("after")), found,
        lambda around, match: F.struct(
            around["before"].alias("before"), F.left(around["after"], F.lit(1)).alias("after"),
            match.alias("match")))
    entry = "array<struct<start:int,match:string,before:string,after:string>>"

    def placed(state, p):
        start = state["at"] + F.length(p["before"])
        return F.struct(
            (start + F.length(p["match"])).alias("at"),
            F.concat(state["all"], F.array(F.struct(
                start.alias("start"), p["match"].alias("match"),
                F.right(p["before"], F.lit(CONTEXT)).alias("before"), p["after"].alias("after")))).alias("all"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(entry).alias("all"))
    spans = F.aggregate(proposals, start, placed, lambda state: state["all"])
    worth = F.filter(spans, lambda s: _worth_a_vote(kind, s["match"]))
    return F.transform(worth, lambda s: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"),
        (s["start"] + F.length(s["match"])).alias("end"),
        _votes(kind, s["match"], s["before"], s["after"]).alias("votes")))


SPAN_TYPE = "array<struct<kind:int,start:int,end:int,votes:array<int>>>"


def propose_spans(docs: DataFrame, text_column: str = "text", out: str = "proposals") -> DataFrame:
    """Adds ``out``: valid spans of the base kinds and generous ones of the others.

    Sorted by kind, then start. An added kind's proposal that overlaps a base span is
    left out. A null or empty text has none. Texts without a digit or an @ are not
    searched, since every kind needs one.
    """
    text = F.col(text_column)
    due = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    base = F.concat(*[_spans(text, k) for k in BASE_KINDS])
    added = F.concat(*[_spans(text, k) for k in KINDS if k not in BASE_KINDS])
    empty = F.array().cast(SPAN_TYPE)
    # Two steps, so that the regexes run once.
    ours, more = unused_name(docs, "_base"), unused_name(docs, "_added")
    split = docs.withColumns({ours: F.when(due, base).otherwise(empty),
                              more: F.when(due, added).otherwise(empty)})
    free = F.filter(more, lambda s: ~F.exists(
        ours, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return split.withColumn(out, F.concat(ours, free)).drop(ours, more)


@dataclass
class SpanModel:
    """Reliability of the labelers, and the weights of the final classifier."""

    reliabilities: list[dict[int, tuple[float, float]]]  # vote -> (if no span, if span)
    kind_weights: list[float]
    vote_weights: list[dict[int, float]]

    def logit(self, span: Column) -> Column:
        total = F.element_at(F.array(*map(F.lit, self.kind_weights)), span["kind"] + 1)
        for i, weights in enumerate(self.vote_weights):
            vote = F.get(span["votes"], F.lit(i))
            total = total + F.when(vote == 1, weights[1]).when(vote == -1, weights[-1]).otherwise(weights[0])
        return total


def estimate_labelers(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 40):
    """(reliabilities, probability of each pattern) by expectation-maximisation.

    A pattern is (kind, votes, number of spans). Votes are independent given the truth,
    with one table for each labeler and a share of true spans for each kind. Starts
    from the majority of votes; counts are smoothed by one vote of each sort.
    """
    belief = [1 / (1 + math.exp(-sum(votes))) for _, votes, _ in patterns]
    tables = []
    for _ in range(rounds):
        share = []
        for kind in range(len(KINDS)):
            own = [(b, n) for b, (k, _, n) in zip(belief, patterns) if k == kind]
            share.append((1 + sum(b * n for b, n in own)) / (2 + sum(n for _, n in own)))
        tables = []
        for i in range(len(LABELERS)):
            sums = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for b, (_, votes, n) in zip(belief, patterns):
                sums[votes[i]][0] += (1 - b) * n
                sums[votes[i]][1] += b * n
            totals = [sum(s[y] for s in sums.values()) for y in (0, 1)]
            tables.append({v: (s[0] / totals[0], s[1] / totals[1]) for v, s in sums.items()})
        new = []
        for kind, votes, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind]))
            for table, vote in zip(tables, votes):
                no, yes = table[vote]
                odds += math.log(yes / no)
            new.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        change = max((abs(a - b) for a, b in zip(new, belief)), default=0)
        belief = new
        if change < 1e-9:
            break
    return tables, belief


def train_classifier(patterns, belief, rounds: int = 400, rate: float = 0.5, decay: float = 1e-3):
    """Logistic weights of kinds and votes, fitted to the probabilities by gradient steps."""
    total = sum(n for _, _, n in patterns) or 1
    kinds, votes_weights = [0.0] * len(KINDS), [{v: 0.0 for v in (-1, 0, 1)} for _ in LABELERS]
    for _ in range(rounds):
        kind_step, vote_step = [0.0] * len(KINDS), [{v: 0.0 for v in (-1, 0, 1)} for _ in LABELERS]
        for (kind, votes, n), b in zip(patterns, belief):
            z = kinds[kind] + sum(w[v] for w, v in zip(votes_weights, votes))
            error = (b - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total
            kind_step[kind] += error
            for step, v in zip(vote_step, votes):
                step[v] += error
        kinds = [w + rate * (s - decay * w) for w, s in zip(kinds, kind_step)]
        for weights, step in zip(votes_weights, vote_step):
            for v in weights:
                weights[v] += rate * (step[v] - decay * weights[v])
    return kinds, votes_weights


def learn_spans(docs: DataFrame, text_column: str = "text") -> SpanModel:
    """The model from all proposals of all texts.

    Spans are counted by kind and votes before anything is shuffled; at most
    len(KINDS) x 3 ** len(LABELERS) rows reach the driver, whatever the input.
    """
    counted = (
        propose_spans(docs.select(F.col(text_column).alias("_text")), "_text")
        .select(F.explode("proposals").alias("s"))
        .groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"))
        .agg(F.count(F.lit(1)).alias("n")).collect())
    patterns = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in counted)
    tables, belief = estimate_labelers(patterns)
    return SpanModel(tables, *train_classifier(patterns, belief))


def find_pii(docs: DataFrame, model: SpanModel, text_column: str = "text",
             threshold: float = 0.5, out: str = "spans") -> DataFrame:
    """Adds ``out``: kind, start, end, base, score, sorted by kind then start.

    Spans of the base kinds stay whatever the score; of the added kinds, those with a
    probability of at least ``threshold``. Rows are independent and all are kept; a
    null or empty text has no spans; all other columns stay, but one named ``out`` is
    replaced.
    """
    threshold = math.log(threshold / (1 - threshold))
    proposals = unused_name(docs, "proposals")
    scored = F.transform(proposals, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        (s["kind"] < len(BASE_KINDS)).alias("base"), model.logit(s).alias("logit")))
    kept = F.filter(scored, lambda s: s["base"] | (s["logit"] >= threshold))
    names = F.array(*map(F.lit, KINDS))
    return propose_spans(docs, text_column, proposals).withColumn(out, F.transform(kept, lambda s: F.struct(
        F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        s["base"].alias("base"), (1 / (1 + F.exp(-s["logit"]))).alias("score")))).drop(proposals)


def mask_spans(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping ones become one."""
    kind = "array<struct<start:int,end:int,kind:string>>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def merge(done, s):
        last = F.element_at(done, -1)
        overlaps = F.when(F.size(done) > 0, s["start"] < last["end"]).otherwise(False)
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
            last["kind"].alias("kind"))))
        return F.when(overlaps, joined).otherwise(F.concat(done, F.array(s)))

    merged = F.aggregate(ordered, F.array().cast(kind), merge)
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
    parts = F.zip_with(F.slice(ends, 1, F.size(merged)), merged, lambda end, s: F.concat(
        text.substr(end + 1, s["start"] - end), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = text.substr(F.element_at(ends, -1) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)
