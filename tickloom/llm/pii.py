"""Personal data by weak supervision, in native columns; only counts of vote patterns reach the driver.

Candidates are the matches of the base rules and of three looser ones. Four labelers vote on each
(1 yes, -1 no, 0 abstains): a strict regular expression, a gazetteer, the words before the span, and
the characters at its ends. Candidates are counted by kind, votes and coarse features over the whole
corpus; the number of such patterns is bounded by their definition. Expectation-maximisation on the
counts estimates each labeler's reliability and each pattern's chance to be personal data, and
those chances train the final classifier, a logistic model of kind, votes and features, which runs
as a native expression. Base spans always stay; candidates of the looser rules become spans where
the classifier says so.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .spans import apart, digits, how_many, listed, located, luhn, matches, surroundings

BASE = ("email", "ip", "card", "phone")
LOOSE = ("local_phone", "social", "iban")
#: Possessive forms of the base rules. ``\G`` lets a match begin where the last one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
STRICT = {
    "ip": r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$",
    "card": r"^[3-6][0-9]{3}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20.-]?\(?[0-9]{2,4}\)?([\x20.-]?[0-9]{2,4}){2,3}$",
    "local_phone": r"^(\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}$",
    "social": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
}
#: Fixed lists: domains' last labels, calling codes, card issuers' first digits, countries with IBAN.
DOMAINS = "com org net edu gov int info biz io de fr es it nl uk eu us ca ch at be pl se no dk fi pt ie".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 64 65 81 82 86 90 91".split()
ISSUERS = "34 37 4 51 52 53 54 55 6011 65".split()
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
CUES = {
    "email": r"(?i)(e-?mail|contact|write|reach|from|to)\W*$",
    "ip": r"(?i)(\bip|host|address|server|client)\W*$",
    "card": r"(?i)(card|visa|credit|payment|pay)\W*(no|number)?\W*$",
    "phone": r"(?i)(tel|phone|call|fax|mobile|cell|contact)\W*$",
    "local_phone": r"(?i)(tel|phone|call|fax|mobile|cell|contact)\W*$",
    "social": r"(?i)(ssn|social|security|tax)\W*(no|number|id)?\W*$",
    "iban": r"(?i)(iban|account|bank)\W*(no|number)?\W*$",
}
AGAINST = r"(?i)(version|isbn|issn|order|invoice|sku|serial|part|item|ticket|page|\bv|#)\W*(no|number)?\W*$"
LABELERS = ("strict", "gazetteer", "context", "ends")
CONTEXT = 24


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1, or 0; without ``no`` a failing rule votes against."""
    return F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(-1)


def _strict(kind: str, value: Column) -> Column:
    if kind == "email":  # by its ends, as a pattern over all labels would recurse once for each
        return _vote(value.rlike("^[A-Za-z0-9]") & F.substring_index(value, ".", -1).rlike("^[A-Za-z]{2,}$"))
    return _vote(value.rlike(STRICT[kind]))


def _gazetteer(kind: str, value: Column) -> Column:
    if kind == "email":
        last = F.lower(F.substring_index(value, ".", -1))
        return _vote(last.isin(*DOMAINS), F.length(last) < 2)
    if kind == "ip":
        head = F.substring_index(value, ".", 1).cast("int")
        return _vote((head > 0) & (head < 224) & (head != 127) & (head != 10), head.isin(0, 127) | (head > 239))
    if kind == "card":
        return _vote(digits(value).rlike("^(" + "|".join(ISSUERS) + ")"))
    if kind == "phone":
        return _vote(digits(value).rlike("^(" + "|".join(CALLING) + ")"))
    if kind == "iban":
        return _vote(F.substring(value, 1, 2).isin(*IBAN_COUNTRIES))
    return _vote(F.lit(False), F.lit(False))


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, base, loose``: rank, kind, start, end, votes v0-v3 and the classes of size and shape of every candidate."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = BASE + LOOSE
    rows = rows.withColumns({f"m_{k}": matches(F.col("text"), PATTERNS[k]) for k in kinds})
    rows = rows.withColumns({f"p_{k}": located(F.col("text"), F.col(f"m_{k}"), PATTERNS[k]) for k in kinds} | {f"c_{k}": surroundings(F.col("text"), F.col(f"m_{k}"), PATTERNS[k], CONTEXT) for k in kinds})
    both = lambda s, c: F.struct(*(s[x].alias(x) for x in ("start", "end", "value")), *(c[x].alias(x) for x in ("before", "after")))
    spans = {k: F.zip_with(f"p_{k}", f"c_{k}", both) for k in kinds}
    spans["ip"] = F.filter(spans["ip"], lambda s: F.forall(F.split(s["value"], r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)))
    spans["card"] = F.filter(spans["card"], lambda s: F.length(digits(s["value"])).between(16, 19) & luhn(digits(s["value"])))
    spans["phone"] = F.filter(spans["phone"], lambda s: F.length(digits(s["value"])).between(8, 15))

    def judged(k: str) -> Column:
        def one(s: Column) -> Column:
            before, value = s["before"], s["value"]
            ends = _vote(~F.right(before, F.lit(1)).rlike(r"[\p{L}\p{N}@_]") & ~s["after"].rlike(r"[\p{L}\p{N}@_]"))
            votes = (_strict(k, value), _gazetteer(k, value), _vote(before.rlike(CUES[k]), before.rlike(AGAINST)), ends)
            n = s["end"] - s["start"]
            size = F.when(n <= 12, 1).when(n <= 16, 2).when(n <= 24, 3).otherwise(0)
            shape = F.when(value.rlike(r"^[0-9]+$"), 1).when(~value.rlike(r"[A-Za-z]"), 2).when(value.rlike(r"[0-9]"), 3).otherwise(0)
            named = [v.cast("int").alias(f"v{i}") for i, v in enumerate(votes)]
            return F.struct(F.lit(kinds.index(k)).alias("rank"), F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *named, size.alias("size"), shape.alias("shape"))

        return F.when(F.size(f"m_{k}") > 0, F.transform(f"s_{k}", one)).otherwise(F.array().cast(_FOUND))

    rows = rows.withColumns({f"s_{k}": spans[k] for k in kinds})
    rows = rows.withColumn("base", F.concat(*(judged(k) for k in BASE)))
    for k in LOOSE:  # those that touch no base span
        rows = rows.withColumn(f"j_{k}", judged(k)).withColumn(f"l_{k}", apart(F.col(f"j_{k}"), F.col("base")))
    return rows.select("doc_id", "base", F.concat(*(F.col(f"l_{k}") for k in LOOSE)).alias("loose"))


_FOUND = "array<struct<rank:int,kind:string,start:int,end:int,v0:int,v1:int,v2:int,v3:int,size:int,shape:int>>"


@dataclass
class PiiModel:
    """Estimated reliabilities of the labelers (chance of a right vote), share by kind, weights of the classifier."""

    reliability: dict[str, float] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)


Pattern = tuple[str, tuple[int, ...], int, int, int]  # kind, votes, classes of size and shape, count


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _inputs(kind: str, votes: Sequence[int], size: int, shape: int) -> list[str]:
    return ["bias", f"kind={kind}", *(f"{name}={v}" for name, v in zip(LABELERS, votes, strict=True)), f"size={size}", f"shape={shape}"]


def estimate(patterns: Sequence[Pattern], rounds: int = 60) -> PiiModel:
    """EM over counted patterns, then the classifier on its posteriors; both start from fixed values.

    Labelers are taken to vote independently given the truth, with one reliability each for yes and
    for no votes; counts are smoothed, so that no reliability reaches 0 or 1.
    """
    model = PiiModel({name: 0.8 for name in LABELERS}, {k: 0.5 for k in BASE + LOOSE})
    if not patterns:
        return model
    patterns = sorted(patterns)
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (kind, votes, *_rest) in enumerate(patterns):
            z = math.log(model.share[kind] / (1 - model.share[kind]))
            for name, v in zip(LABELERS, votes, strict=True):
                z += v * math.log(model.reliability[name] / (1 - model.reliability[name]))
            posterior[i] = _sigmoid(z)
        for j, name in enumerate(LABELERS):
            right, cast = 8.0, 10.0
            for p, (_, votes, _, _, n) in zip(posterior, patterns, strict=True):
                if votes[j]:
                    cast += n
                    right += n * (p if votes[j] > 0 else 1 - p)
            model.reliability[name] = min(0.99, max(0.55, right / cast))  # a labeler is never taken to be worse than chance
        for kind in model.share:
            own = [(p, q[4]) for p, q in zip(posterior, patterns, strict=True) if q[0] == kind]
            model.share[kind] = min(0.99, max(0.01, (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))))
    names = sorted({x for q in patterns for x in _inputs(*q[:4])})
    inputs = np.array([[x in own for x in names] for own in (set(_inputs(*q[:4])) for q in patterns)], dtype=np.float64)
    share = np.array([q[4] for q in patterns], dtype=np.float64)
    share /= share.sum()
    w, target = np.zeros(len(names)), np.array(posterior)
    for _ in range(800):
        r = share * (1 / (1 + np.exp(-np.clip(inputs @ w, -40, 40))) - target)
        w -= 2.0 * (r @ inputs + 1e-4 * w)
    model.weights = dict(zip(names, w.tolist(), strict=True))
    return model


def _chance(model: PiiModel) -> str:
    """The classifier's value for a span ``s``, as SQL: one expression, however many weights there are."""
    w = model.weights

    def cases(field: str, name: str, values: Sequence[str | int]) -> str:
        known = " ".join(f"WHEN {v!r} THEN {w[f'{name}={v}']!r}D" for v in values if f"{name}={v}" in w)
        return f"CASE s.{field} {known} ELSE 0D END" if known else "0D"

    parts = [f"{w.get('bias', 0.0)!r}D", cases("kind", "kind", BASE + LOOSE), *(cases(f"v{i}", name, (-1, 0, 1)) for i, name in enumerate(LABELERS)), *(cases(x, x, range(4)) for x in ("size", "shape"))]
    return f"1D / (1D + exp(-({' + '.join(f'({p})' for p in parts)})))"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id``, counts by base kind, ``base_spans`` and ``spans``
    (``kind:start:end``), the number of added spans and the classifier's mean chance of all of them.

    A null or empty text has no spans, and a mean of null. Repeated rows give repeated results.
    """
    rows = stash(_candidates(docs, id_col, text_col), "candidates")
    each = rows.select(F.explode(F.concat("base", "loose")).alias("s")).select("s.*")
    counted = each.groupBy("kind", "v0", "v1", "v2", "v3", "size", "shape").agg(F.count("*").alias("n")).collect()  # bounded by the patterns' definition
    model = estimate([(r["kind"], (r["v0"], r["v1"], r["v2"], r["v3"]), r["size"], r["shape"], r["n"]) for r in counted])
    chance = _chance(model)
    rows = rows.withColumn("added", F.expr(f"filter(loose, s -> {chance} >= {float(threshold)!r}D)")).withColumn("all", F.concat("base", "added"))
    counts = [how_many("base", "rank", k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    mean = F.expr(f"aggregate(transform(`all`, s -> {chance}), 0D, (a, x) -> a + x) / CASE WHEN size(`all`) > 0 THEN size(`all`) END")
    return rows.select("doc_id", *counts, listed(F.col("base"), "kind").alias("base_spans"), listed(F.col("all"), "kind").alias("spans"), F.size("added").cast("long").alias("n_added"), mean.alias("mean_chance"))
