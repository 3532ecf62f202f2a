"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from patterns.  Four labelers vote on each candidate (+1 personal, -1 not, 0 no opinion):
the kind's own pattern rule, gazetteers, the words before the span, and its shape.  Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is; its posteriors train a logistic span
classifier over votes and span features.  Both work on a table of counts whose size is fixed by the number of
labelers and buckets, whatever the corpus holds, and that table covers every candidate of every document.

Spans of the base patterns always stay; the classifier decides on the others: looser forms of the same kinds
and ``national_id`` and ``iban``.  An added span never overlaps a base span or an earlier added one.

Defined cases: a null text counts as empty and has no spans; a table without candidates gives the default
model; positions count code points, ends are exclusive; rows that repeat are kept, each with its own spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone", "national_id", "iban")
BASE_KINDS = KINDS[:4]

# Possessive quantifiers and look-behinds keep every pattern linear and free of recursion on long runs; what
# they match, leftmost and non-overlapping, is what the plain forms in the comments match.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms: (kind, pattern, quick test).
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{](?i:at)[)\]}]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[{](?i:dot)[)\]}])\x20?[A-Za-z0-9-]{1,63}+){1,5}+", r"[(\[{](?i:at)[)\]}]"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])", r"[0-9][\x20.-][0-9]{3}"),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
)

# Gazetteers (fixed values).
TOP_DOMAINS = "com org net edu gov int mil info biz io co de fr es uk it nl eu us ca au ch at be pt pl se no dk fi jp cn in br mx ru".split()
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|30|35|6011|65|62)"
PHONE_STARTS = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[23568][0-9]{2})"
UNUSABLE_IP = r"^(?:0|127|22[4-9]|2[3-5][0-9])\."
IBAN_LANDS = "AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
# Words before a span that speak for or against its kind (fixed values).
CUES = {
    "email": r"e-?mail|contact|write|mailto|correo|courriel|address",
    "ip": r"\bip\b|host|server|address|client|login|from",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay",
    "phone": r"tel|phone|call|mobile|cell|fax|whatsapp|ruf|llam",
    "national_id": r"ssn|social|security|national|\bid\b",
    "iban": r"iban|account|bank|konto|compte|cuenta",
}
COUNTER_CUES = r"version|licen[sc]e|release|isbn|order|invoice|page|section|chapter|\bv$|build|serial"
CONTEXT = 32
LABELERS = ("rule", "gazetteer", "context", "shape")

SPAN = "struct<kind:string,s:int,e:int,base:boolean,votes:array<int>,size:int,digits:int>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _raw(text: Column, pattern: str, wanted=lambda m: F.lit(True)) -> Column:
    """Wanted matches with their places: array of (m, s, e).

    The pieces between matches and the matches alternate, so their running lengths are the places.  Only wanted
    matches are gathered: a long text of numbers has many matches and few candidates.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("g"), m.alias("m")))
    empty = F.array().cast("array<struct<m:string,s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["m"])
        one = F.array(F.struct(x["m"].alias("m"), start.alias("s"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(wanted(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _valid(kind: str, m: Column) -> Column:
    """The base rule beyond the pattern."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: F.when(F.length(q) <= 3, q.cast("int") <= 255).otherwise(False)))
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _considered(kind: str, m: Column) -> Column:
    """Failing matches that are still candidates for the classifier."""
    if kind == "card":
        return F.length(_digits(m)).between(13, 19)
    if kind == "phone":
        return F.length(_digits(m)).between(7, 15)
    return F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    if kind == "email":
        return vote(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)\z", 1)).isin(TOP_DOMAINS))
    if kind == "ip":
        return vote(F.lit(False), m.rlike(UNUSABLE_IP))
    if kind == "card":
        return vote(_digits(m).rlike(CARD_STARTS), ~_digits(m).rlike(CARD_STARTS))
    if kind == "phone":
        return vote(m.rlike(PHONE_STARTS))
    if kind == "iban":
        return vote(F.substring(m, 1, 2).isin(IBAN_LANDS), ~F.substring(m, 1, 2).isin(IBAN_LANDS))
    return vote(F.lit(False), m.rlike(r"^(?:000|666|9)"))


def _candidate(kind: str, text: Column, x: Column, base: Column, rule: Column) -> Column:
    before = F.lower(F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), x["s"])))
    digits = _digits(x["m"])
    context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(COUNTER_CUES), -1).otherwise(0)
    shape = F.when((F.length(digits) >= 6) & (F.length(F.regexp_replace(digits, r"([0-9])\1+", "$1")) <= 2), -1).otherwise(0)
    return F.struct(
        F.lit(kind).alias("kind"),
        x["s"].cast("int").alias("s"),
        x["e"].cast("int").alias("e"),
        base.alias("base"),
        F.array(rule, _gazetteer(kind, x["m"]), context, shape).cast("array<int>").alias("votes"),
        F.least(F.lit(4), F.floor(F.log2(F.greatest(F.lit(1), F.length(x["m"]))))).cast("int").alias("size"),
        F.least(F.lit(3), F.floor(4 * F.length(digits) / F.greatest(F.lit(1), F.length(x["m"])))).cast("int").alias("digits"),
    )


def candidates(text: Column) -> Column:
    """All candidate spans of a text, base ones first, each list in order of place."""
    none = F.array().cast(f"array<{SPAN}>")
    quick = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}

    def base(kind: str) -> Column:
        found = F.transform(
            _raw(text, PATTERNS[kind], lambda m: _considered(kind, m)),
            lambda x: let(_valid(kind, x["m"]), lambda ok: _candidate(kind, text, x, ok, F.when(ok, 1).otherwise(-1))),
        )
        return F.when(quick[kind], found.cast(f"array<{SPAN}>")).otherwise(none)

    def loose(kind: str, pattern: str, test: str) -> Column:
        found = F.transform(_raw(text, pattern), lambda x: _candidate(kind, text, x, F.lit(False), F.lit(0)))
        return F.when(text.rlike(test), found.cast(f"array<{SPAN}>")).otherwise(none)

    every = F.concat(*[base(k) for k in BASE_KINDS], *[loose(*x) for x in LOOSE])
    return F.when(text.isNull(), none).otherwise(every)


@dataclass(frozen=True)
class Model:
    """Reliabilities by labeler (share of votes +1, 0, -1 among personal and other spans) and classifier weights."""

    prior: float
    reliability: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]
    weights: tuple[tuple[str, float], ...]

    def weight(self, name: str) -> float:
        return dict(self.weights).get(name, 0.0)


#: Where nothing is known: a labeler is right three times in four when it speaks.
_KNOWN = ((0.45, 0.40, 0.15), (0.15, 0.40, 0.45))


def _features(kind: str, votes: tuple[int, ...], size: int, digits: int) -> list[str]:
    return ["bias", f"kind={kind}", f"size={size}", f"digits={digits}", *[f"{n}={v:+d}" for n, v in zip(LABELERS, votes, strict=True) if v]]


def fit(found: DataFrame, rounds: int = 25, steps: int = 150, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """Model from a table with a column ``cands``; only counts of patterns, a bounded table, reach the driver."""
    counts = (
        found.select(F.explode("cands").alias("c"))
        .groupBy("c.kind", "c.votes", "c.size", "c.digits")
        .agg(F.count("*").alias("n"))
        .orderBy("kind", "votes", "size", "digits")
        .collect()
    )
    rows = [(r["kind"], tuple(r["votes"]), r["size"], r["digits"], r["n"]) for r in counts]
    prior, rel = 0.5, [_KNOWN] * len(LABELERS)
    post = {}
    for _ in range(rounds if rows else 0):
        post = {}
        for kind, votes, size, digits, _n in rows:
            yes, no = math.log(prior), math.log(1 - prior)
            for j, v in enumerate(votes):
                yes += math.log(rel[j][0][1 - v])
                no += math.log(rel[j][1][1 - v])
            post[kind, votes, size, digits] = 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))
        total = sum(r[4] for r in rows)
        prior = min(0.99, max(0.01, (1 + sum(r[4] * post[r[:4]] for r in rows)) / (2 + total)))
        rel = []
        for j in range(len(LABELERS)):
            sides = []
            for side in (0, 1):
                mass = [5 * p for p in _KNOWN[side]]  # a few pseudo-counts keep a silent labeler at what is known
                for r in rows:
                    p = post[r[:4]]
                    mass[1 - r[1][j]] += r[4] * (p if side == 0 else 1 - p)
                sides.append(tuple(m / sum(mass) for m in mass))
            rel.append(tuple(sides))
    weights = {f"{n}={v:+d}": math.log(r[0][1 - v] / r[1][1 - v]) for n, r in zip(LABELERS, rel, strict=True) for v in (1, -1)} | {"bias": math.log(prior / (1 - prior))}
    total = max(1, sum(r[4] for r in rows))
    for _ in range(steps if rows else 0):
        grad: dict[str, float] = {}
        for r in rows:
            names = _features(*r[:4])
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(x, 0.0) for x in names)))))
            for x in names:
                grad[x] = grad.get(x, 0.0) + r[4] * (p - post[r[:4]]) / total
        for x, g in grad.items():
            weights[x] = weights.get(x, 0.0) - rate * (g + ridge * weights.get(x, 0.0))
    return Model(prior, tuple(rel), tuple(sorted(weights.items())))


def _of(kind: str):
    return lambda c: c["kind"] == kind


def score(c: Column, model: Model) -> Column:
    """The classifier's probability that a candidate is personal, as one expression of literals."""
    pick = lambda col, pre, values: F.coalesce(*[F.when(col == v, F.lit(model.weight(f"{pre}={v}"))) for v in values], F.lit(0.0))
    z = F.lit(model.weight("bias")) + pick(c["kind"], "kind", KINDS) + pick(c["size"], "size", range(5)) + pick(c["digits"], "digits", range(4))
    for j, n in enumerate(LABELERS):
        v = c["votes"][j]
        z = z + F.when(v == 1, F.lit(model.weight(f"{n}=+1"))).when(v == -1, F.lit(model.weight(f"{n}=-1"))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def decide(cands: Column, model: Model, least: float = 0.5) -> Column:
    """Base spans, and added ones of at least this score that overlap none of them; by kind as listed, then start."""

    def chosen(c: Column) -> Column:
        # An added span needs someone to vouch for it: no vote in favour, no span, whatever the corpus is like.
        extra = F.filter(c, lambda x: ~x["base"] & F.exists(x["votes"], lambda v: v == 1) & (score(x, model) >= least))
        ordered = F.array_sort(extra, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))
        clash = lambda held, x: F.exists(held, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
        return F.aggregate(ordered, F.filter(c, lambda x: x["base"]), lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))

    place = F.array(*map(F.lit, KINDS))
    by_kind = lambda a, b: F.when(a["kind"] != b["kind"], F.array_position(place, a["kind"]) - F.array_position(place, b["kind"])).otherwise((a["s"] - b["s"]).cast("bigint")).cast("int")
    return F.when(F.size(cands) == 0, cands).otherwise(F.array_sort(chosen(cands), by_kind))


def render(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))))


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; base spans of two kinds that overlap give one gap."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, c: F.when(c["e"] <= acc["at"], acc).otherwise(
            F.struct(
                c["e"].alias("at"),
                F.concat(acc["out"], F.array(F.when(c["s"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, c["s"] - acc["at"]), F.lit("["), F.upper(c["kind"]), F.lit("]"))).otherwise(F.lit("")))).alias("out"),
            )
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])),
    )
    return F.when(F.size(spans) == 0, text).otherwise(done)


def masked(text: Column, model: Model) -> Column:
    """The text without its personal data.  Candidates and spans are bound once: each names the one before many times."""
    found = lambda c: F.when(F.size(c) == 0, text).otherwise(let(decide(c, model), lambda spans: mask(text, spans)))
    return let(candidates(text), found)


def digest(cands: Column, model: Model) -> list[Column]:
    """The contract's columns for a row with these candidates."""
    base = F.filter(cands, lambda c: c["base"])
    counts = [F.size(F.filter(base, _of(k))).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    spans = decide(cands, model)
    return [
        *counts,
        F.sha2(render(base), 256).alias("base_sha256"),
        render(spans).alias("spans"),
        (F.size(spans) - F.size(base)).cast("bigint").alias("n_added"),
    ]
