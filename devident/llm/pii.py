"""Personal data by weak supervision, with built-in functions only.

Base spans are what four fixed patterns find. Beyond them a wider pattern gives candidates, on which
regex, gazetteer, context, shape and overlap labelers vote. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is; its posteriors train a logistic span classifier, which is
compiled back into a Spark expression and decides which candidates are added.

Each text is read once. The driver sees counts of feature patterns only, whose number is fixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devident.session import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("handle", "number", "person", "secret")

# The contract's patterns. Possessive repeats and the look-behinds don't change what matches: the repeated
# classes exclude what follows them, and a run that fails from its start fails from within. They keep time
# linear and the stack flat on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# fixed values: what labelers know
GIVEN_NAMES = (
    "Anna Maria Peter Thomas Michael Julia Paul Laura Carlos Sofia Pierre Marie Jean Claire Hans Klaus Juan Ana "
    "James John Robert Mary Linda David Sarah Emma Lucas Pablo Lucia Elena Miguel Jose"
).split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Madame Monsieur Sr Sra Mme".split()
GOOD_CUES = "call tel telephone phone mobile fax contact mail email name ssn passport account iban card login user username password token secret key teléfono correo nombre téléphone courriel nom telefon name konto"
BAD_CUES = "version page pages chapter isbn issn figure table total sum line year section build release edition id no nr"

CANDIDATE = "|".join(
    (
        r"AKIA[0-9A-Z]{16}",
        r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?\"?[^\s\"]{6,}+",
        r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
        r"(?<![0-9(])\(?[0-9]{2,5}+\)?(?:[\x20.-][0-9]{2,5}+){2,6}+(?![0-9])",
        r"(?<![0-9])[0-9]{9,19}+(?![0-9])",
        r"(?<![\p{L}])(?:" + "|".join(TITLES) + r")\.?\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?",
    )
)


def _running(steps: str) -> str:
    """SQL for the sums before each element of an array of ints, in blocks, so that long arrays stay linear."""
    block = 256
    blocks = f"transform(sequence(0, (size({steps}) - 1) div {block}), b -> slice({steps}, b * {block} + 1, {block}))"
    before = (
        "aggregate({0}, named_struct('s', 0, 'all', CAST(array() AS array<int>)), "
        "(a, x) -> named_struct('s', a.s + x, 'all', array_append(a.all, a.s)), a -> a.all)"
    )
    inner = f"transform({blocks}, y -> {before.format('y')})"
    sums = f"transform({blocks}, y -> aggregate(y, 0, (a, x) -> a + x))"
    return f"flatten(zip_with({inner}, {before.format(sums)}, (y, o) -> transform(y, x -> x + o)))"


def _located(frame: DataFrame, text: str, pattern: str, name: str, only: Column) -> DataFrame:
    """Adds `name`: array<struct<value, before, first, last>> of the pattern's matches, in code points; `before` is the text
    since the match before. Texts for which `only` is false have none.

    Matches come from one function and the text between them from another; both scan for the same matches,
    so the running sum of their lengths is where they lie.
    """
    parts, found, steps = f"_{name}_parts", f"_{name}_found", f"_{name}_steps"
    frame = frame.withColumn(found, F.when(only, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    frame = frame.withColumn(parts, F.when(F.size(found) > 0, F.split(text, pattern, -1)))
    frame = frame.withColumn(
        steps, F.expr(f"transform({found}, (f, i) -> CAST(length(f) + length({parts}[i]) AS int))")
    )
    spans = (
        f"zip_with(zip_with({found}, slice({parts}, 1, size({found})), (f, p) -> named_struct('value', f, 'before', p)), "
        f"{_running(steps)}, (v, at) -> named_struct('value', v.value, 'before', right(v.before, 40), "
        "'first', at + length(v.before), 'last', at + length(v.before) + length(v.value)))"
    )
    empty = "CAST(array() AS array<struct<value: string, before: string, first: int, last: int>>)"
    return frame.withColumn(name, F.expr(f"CASE WHEN size({found}) > 0 THEN {spans} ELSE {empty} END")).drop(
        parts, found, steps
    )


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"),
        "card": F.length(digits).between(13, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds `base`: array<struct<kind, first, last>>, kinds in the order listed, then by start."""
    only = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    frame = docs
    for kind in BASE_KINDS:
        test = only.get(kind, F.col(text).rlike("[0-9][\\x20.-]?[0-9]"))
        if kind == "ip":
            test = F.col(text).rlike("[0-9]\\.[0-9]")
        frame = _located(frame, text, PATTERNS[kind], f"_base_{kind}", test)

    def spans(kind):
        kept = F.filter(f"_base_{kind}", lambda s: _valid(kind, s["value"]))
        return F.transform(
            kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["first"].alias("first"), s["last"].alias("last"))
        )

    return frame.withColumn("base", F.concat(*map(spans, BASE_KINDS))).drop(*[f"_base_{k}" for k in BASE_KINDS])


LABELERS = ("regex", "gazetteer", "context", "shape", "overlap")
FEATURES = ("kind", *LABELERS, "length", "digits")


def _cues(words_: str) -> str:
    return r"(?i)(?<!\p{L})(?:" + "|".join(words_.split()) + r")(?!\p{L})"


def _candidate(c: Column) -> Column:
    """A candidate's kind, the votes on it (1 personal, -1 not, 0 no opinion) and its shape in few classes."""
    value, before = c["value"], c["before"]
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    size = F.length(value)
    kind = (
        F.when(value.rlike(r"^(?:AKIA|[0-9a-f]{32,}$)|[=:]"), "secret")
        .when(value.rlike(r"(?i)[(\[\x20]at[)\]\x20]"), "handle")
        .when(value.rlike(r"^\p{L}"), "person")
        .otherwise("number")
    )
    regex = (
        F.when(value.rlike(r"^AKIA|^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|(?i)password"), 1)
        .when(value.rlike(r"^[0-9]{9,19}$"), -1)
        .otherwise(0)
    )
    gazetteer = F.when(
        value.rlike(r"(?<!\p{L})(?:" + "|".join(GIVEN_NAMES) + r")(?!\p{L})|(?i)(?:password|passwd|secret|token|example|mail)"), 1
    ).otherwise(0)
    near = F.right(before, F.lit(24))
    context = F.when(near.rlike(_cues(GOOD_CUES)), 1).when(near.rlike(_cues(BAD_CUES)), -1).otherwise(0)
    shape = (
        F.when(value.rlike(r"([0-9])(?:[^0-9]?\1){6}"), -1)
        .when((digits > 0) & value.rlike(r"[A-Za-z]{2}") & (size >= 8), 1)
        .when(digits > 15, -1)
        .otherwise(0)
    )
    overlap = F.when(F.exists("base", lambda b: (b["first"] < c["last"]) & (b["last"] > c["first"])), 1).otherwise(0)
    return F.struct(
        kind.alias("kind"), c["first"].alias("first"), c["last"].alias("last"),
        regex.alias("regex"), gazetteer.alias("gazetteer"), context.alias("context"), shape.alias("shape"), overlap.alias("overlap"),
        F.least(F.lit(4), (size / 8).cast("int")).alias("length"),
        F.when(digits == 0, 0).when(2 * digits < size, 1).otherwise(2).alias("digits"),
    )


def spans_of(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """`keep`, `base` and `candidates` of each row; a NULL text has none. One pass, written to the shared folder."""
    frame = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_pii_text"))
    frame = base_spans(frame, "_pii_text")
    # follows from every alternative of CANDIDATE
    frame = _located(frame, "_pii_text", CANDIDATE, "_pii_candidates", F.col("_pii_text").rlike(
        r"[0-9]{2}|AKIA|[0-9a-f]{32}|(?i)(?:password|passwd|pwd|token|secret|api[_-]?key)|[(\[\x20]at[)\]\x20]|(?<!\p{L})(?:" + "|".join(TITLES) + r")\.?\x20"
    ))
    # through a generator, so that the base spans aren't worked out again for each candidate
    frame = frame.select(*keep, F.inline(F.array(F.struct("base", "_pii_candidates"))))
    frame = frame.withColumn("candidates", F.transform("_pii_candidates", _candidate))
    return materialize(frame.select(*keep, "base", "candidates"))


@dataclass(frozen=True)
class Reliability:
    """`prior` of a candidate being personal; per labeler P(vote | class) as {(labeler, class, vote): p}."""

    prior: float
    votes: dict


def expectation_maximisation(counts: list[dict], rounds: int = 60) -> tuple[Reliability, list[float]]:
    """Reliabilities of the labelers from counted vote patterns, and each pattern's posterior.

    A two-class model with independent labelers, started from the majority of votes; counts are smoothed, so
    that labelers without a vote say nothing. No pattern: the prior alone.
    """
    posterior = [min(0.95, max(0.05, 0.5 + 0.25 * sum(c[v] for v in LABELERS))) for c in counts]
    total = sum(c["n"] for c in counts)
    prior, votes = 0.5, {}
    for _ in range(rounds if counts else 0):
        mass = {y: sum(c["n"] * (p if y else 1 - p) for c, p in zip(counts, posterior)) for y in (0, 1)}
        prior = (mass[1] + 1) / (total + 2)
        for v in LABELERS:
            for y in (0, 1):
                for vote in (-1, 0, 1):
                    # a vote is a little likelier for the class it names
                    bias = 2.0 if (vote == 1 and y) or (vote == -1 and not y) else 1.0
                    hits = sum(c["n"] * (p if y else 1 - p) for c, p in zip(counts, posterior) if c[v] == vote)
                    votes[v, y, vote] = (hits + bias) / (mass[y] + 4 + (bias - 1))
        for i, c in enumerate(counts):
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(votes[v, 1, c[v]] / votes[v, 0, c[v]]) for v in LABELERS
            )
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return Reliability(prior, votes), posterior


def _indicators(row: dict) -> list[tuple]:
    return [("bias", 1), *[(f, row[f]) for f in FEATURES]]


def train(counts: list[dict], posterior: list[float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Weights {(feature, value): w} of a logistic classifier, by gradient steps on the counted patterns."""
    weights: dict = {}
    total = sum(c["n"] for c in counts)
    known = [_indicators(c) for c in counts]
    for _ in range(rounds):
        slope: dict = {}
        for c, keys, p in zip(counts, known, posterior):
            z = sum(weights.get(k, 0.0) for k in keys)
            error = c["n"] / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            for k in keys:
                slope[k] = slope.get(k, 0.0) + error
        for k, g in slope.items():
            weights[k] = weights.get(k, 0.0) - rate * (g + decay * weights.get(k, 0.0))
    return weights


def learn(found: DataFrame) -> dict:
    """The classifier's weights from all candidates. Their patterns number at most 14,580, whatever the corpus."""
    rows = found.select(F.explode("candidates").alias("c")).select("c.*").groupBy(*FEATURES).agg(F.count("*").alias("n")).collect()
    counts = sorted((r.asDict() for r in rows), key=lambda c: [str(c[f]) for f in FEATURES])
    if not counts:
        return {}
    _, posterior = expectation_maximisation(counts)
    return train(counts, posterior)


def accepted(c: Column, weights: dict) -> Column:
    """Whether the classifier takes a candidate, as an expression; without weights it takes none."""
    if not weights:
        return F.lit(False)
    terms = [F.lit(weights.get(("bias", 1), 0.0))]
    terms += [F.when(c[f] == F.lit(value), w).otherwise(0.0) for (f, value), w in sorted(weights.items(), key=str) if f != "bias"]
    return reduce(lambda a, b: a + b, terms) > 0


def joined(spans: Column) -> Column:
    """`kind:first:last`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")


def find(docs: DataFrame, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """`keep`, `base` and `added` spans, array<struct<kind, first, last>>, of each row.

    Places are code points, `last` exclusive. Added spans don't overlap base spans and are ordered by kind, then
    start. NULL and empty texts have no span; repeated rows are rows of their own.
    """
    found = spans_of(docs, text, keep)
    weights = learn(found)
    order = F.array_sort(
        F.transform(
            F.filter("candidates", lambda c: (c["overlap"] == 0) & accepted(c, weights)),
            lambda c: F.struct(c["kind"].alias("kind"), c["first"].alias("first"), c["last"].alias("last")),
        )
    )
    return found.select(*keep, "base", order.alias("added"))
