"""Personal data by weak supervision, in SQL functions only.

Patterns of each kind give candidate spans. Five labelers vote on every candidate (the kind's checks, a
gazetteer, words before it, what touches it, the shape of its characters). Expectation-maximisation over
the counts of vote patterns estimates how reliable each labeler is for each kind; its posteriors train a
logistic span classifier. The strict spans of the four base kinds always stay; the classifier adds
others. Only tables of pattern counts, whose size the code fixes, reach the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsql.llm.common import cut_lineage

KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE_KINDS = 4
LABELERS = ("form", "gazetteer", "context", "touch", "shape")
SIZES = 6

#: The patterns of the base kinds. The quantifiers are possessive and the look-behinds keep a
#: long run from being tried at each of its characters; matches are those of the plain patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?:(?<=\G[0-9])|(?<![0-9][0-9]))[0-9]*+(?:\.[0-9]++){3}"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Looser candidates of the method's own.
LOOSE_PHONE = r"(?<![0-9+)] ?)(?<![A-Za-z0-9-])\(?0?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}(?![0-9A-Za-z-])"
LOOSE_EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,63} ?(?:\(dot\)|\[dot\]) ?[A-Za-z]{2,10}(?![A-Za-z0-9])"
SECRET = r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|secret|token|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_=-]{16,}"
IDENTITY = r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7})(?![A-Za-z0-9-])"

#: Gazetteers (top-level domains, issuer prefixes, reserved address blocks) and words of context.
DOMAINS = r"\.(?:com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|uk|us|nl|ch|at|be|pl|ca|au|jp|br|example|test)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65|62)"
RESERVED = r"^(?:0|127|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
COUNTRY = r"^\+?(?:1|2[07]|3[0-46-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
BEFORE = (
    r"(?:e-?mail|mail|contact|write|schreib|correo|courriel)\W{0,4}\w{0,8}\W{0,4}$",
    r"(?:\bip|address|host|server|from|adresse)\W{0,4}\w{0,8}\W{0,4}$",
    r"(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W{0,4}\w{0,8}\W{0,4}$",
    r"(?:phone|tel|call|fax|mobile|cell|telefon|appel|llam)\w{0,8}\W{0,4}$",
    r".*",
    r"(?:ssn|social|iban|passport|account|konto|compte|cuenta)\W{0,4}\w{0,8}\W{0,4}$",
)
AGAINST = r"(?:version|ver|isbn|issn|order|section|figure|fig|page|no|nr|ref|invoice)\W{0,3}$"


def located(text: Column, found: Column, pattern: str, build) -> Column:
    """build(match, start, gap before, gap after) for every match; starts count code points from 0."""
    gaps = F.split(text, pattern, -1)
    rows = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.element_at(gaps, i + 1).alias("g"), F.element_at(gaps, i + 2).alias("h")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,s:int,g:string,h:string>>").alias("out"))
    placed = F.aggregate(
        rows,
        empty,
        lambda acc, r: F.struct(
            (acc["at"] + F.length(r["g"]) + F.length(r["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(r["m"].alias("m"), (acc["at"] + F.length(r["g"])).alias("s"), r["g"].alias("g"), r["h"].alias("h")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.transform(placed, lambda p: build(p["m"], p["s"], p["g"], p["h"]))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    places = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    total = F.aggregate(
        F.transform(places, lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i"))),
        F.lit(0),
        lambda acc, x: acc + F.when(x["i"] % 2 == 0, x["d"]).otherwise(x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def strict(kind: int, m: Column) -> Column:
    """Whether a match of the base kind's pattern passes its checks."""
    if kind == 1:
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == 2:
        return F.length(digits(m)).between(16, 19) & _luhn(digits(m))
    if kind == 3:
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _span(kind: int, is_base: bool):
    def build(m: Column, start: Column, gap: Column, after: Column) -> Column:
        before, behind = F.lower(F.substring(gap, -32, 32)), F.substring(after, 1, 2)
        passes = strict(kind, m) if is_base else F.lit(kind == 4)
        number = digits(m)
        never = F.lit(False)
        gazetteer = {
            0: (F.lower(m).rlike(DOMAINS), never),
            1: (~m.rlike(RESERVED), m.rlike(RESERVED)),
            2: (number.rlike(ISSUERS), ~number.rlike(ISSUERS)),
            3: (m.rlike(COUNTRY), never),
            4: (m.rlike("[0-9]") & m.rlike("[A-Za-z]$|[0-9]$"), ~m.rlike("[0-9]")),
            5: (m.rlike("^[A-Z]{2}[0-9]{2}"), m.rlike("^(?:000|666|9)")),
        }[kind]
        glued = before.rlike(r"[a-z0-9_/\\=.-]$") | behind.rlike(r"^[A-Za-z0-9_/\\=]|^[.-][A-Za-z0-9]")
        votes = (
            _vote(passes, ~passes if is_base else never),
            _vote(*gazetteer),
            _vote(before.rlike(BEFORE[kind]), before.rlike(AGAINST)),
            _vote(never, glued),
            _vote(F.size(F.array_distinct(F.split(number, ""))) > 5, F.length(number).between(1, 99) & (F.size(F.array_distinct(F.split(number, ""))) <= 3)),
        )
        return F.struct(
            F.lit(kind).alias("kind"), start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"),
            (passes if is_base and kind < BASE_KINDS else F.lit(False)).alias("base"),
            F.array(*[v.cast("int") for v in votes]).alias("votes"), F.least(F.floor(F.length(m) / 6), F.lit(SIZES - 1)).cast("int").alias("size"),
        )

    return build


#: (kind, pattern, whether the base contract names it, what a text must hold to be worth a look)
SOURCES = (
    (0, EMAIL, True, "@"), (1, IP, True, "."), (2, CARD, True, ""), (3, PHONE, True, "+"),
    (0, LOOSE_EMAIL, False, "at"), (3, LOOSE_PHONE, False, ""), (4, SECRET, False, ""), (5, IDENTITY, False, ""),
)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _spans: every candidate with its votes. One narrow pass, no shuffle."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hits = []
    for _, pattern, _, needs in SOURCES:
        all_of = F.regexp_extract_all(body, F.lit(pattern), 0)
        hits.append(F.when(F.contains(body, F.lit(needs)), all_of).otherwise(F.array().cast("array<string>")) if needs else all_of)
    # numbers and marks are rare: a text without either skips every pattern
    look = body.rlike(r"[0-9@+]|\[at|\(at")
    spans = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<int>,size:int>>"
    found = docs.withColumn("_hits", F.when(look, F.array(*hits)).otherwise(F.array().cast("array<array<string>>")))
    parts = [
        F.when(F.size(F.get("_hits", F.lit(n))) > 0, located(body, F.get("_hits", F.lit(n)), pattern, _span(kind, is_base))).otherwise(F.array().cast(spans))
        for n, (kind, pattern, is_base, _) in enumerate(SOURCES)
    ]
    anything = F.exists("_hits", lambda h: F.size(h) > 0)
    return found.withColumn("_spans", F.when(anything, F.concat(*parts)).otherwise(F.array().cast(spans))).drop("_hits")


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def reliabilities(patterns: list[tuple[int, bool, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict, list[float]]:
    """EM over (kind, base, votes, count): ({(kind, labeler, vote, truth): probability}, posterior of each pattern).

    The first posteriors come from the sum of votes; strict base spans start, and so anchor, near 1.
    """
    post = [0.97 if base else _sigmoid(1.5 * sum(votes) - 1.0) for _, base, votes, _ in patterns]
    table: dict = {}
    for _ in range(rounds):
        mass: dict = defaultdict(lambda: 0.0)
        prior: dict = defaultdict(lambda: [1.0, 1.0])
        for (kind, _, votes, n), p in zip(patterns, post, strict=True):
            prior[kind][1] += n * p
            prior[kind][0] += n * (1 - p)
            for i, v in enumerate(votes):
                mass[kind, i, v, 1] += n * p
                mass[kind, i, v, 0] += n * (1 - p)
        table = {}
        for kind in prior:
            for i in range(len(LABELERS)):
                for truth in (0, 1):
                    # a labeler that votes is better than chance: what agrees with the truth has the larger pseudo-count
                    smooth = {v: 3.0 if v == 2 * truth - 1 else 1.0 for v in (-1, 0, 1)}
                    total = sum(mass[kind, i, v, truth] + smooth[v] for v in smooth)
                    for v in smooth:
                        table[kind, i, v, truth] = (mass[kind, i, v, truth] + smooth[v]) / total
        new = []
        for kind, base, votes, _ in patterns:
            z = math.log(prior[kind][1] / prior[kind][0]) + sum(math.log(table[kind, i, v, 1] / table[kind, i, v, 0]) for i, v in enumerate(votes))
            new.append(max(0.97, _sigmoid(z)) if base else _sigmoid(z))
        if max((abs(a - b) for a, b in zip(post, new, strict=True)), default=0) < 1e-6:
            break
        post = new
    return table, post


@dataclass(frozen=True)
class SpanModel:
    """Log-odds of a span: a bias by kind, a weight by kind, labeler and vote, and one by kind and size."""

    kind: tuple[float, ...]
    vote: tuple[float, ...]
    size: tuple[float, ...]

    @staticmethod
    def vote_at(kind: int, labeler: int, vote: int) -> int:
        return (kind * len(LABELERS) + labeler) * 3 + vote + 1

    def logit(self, span: Column) -> Column:
        votes = F.aggregate(
            F.transform(span["votes"], lambda v, i: F.element_at(F.lit(list(self.vote)), (span["kind"] * len(LABELERS) + i) * 3 + v + 2)), F.lit(0.0), lambda a, x: a + x
        )
        return F.element_at(F.lit(list(self.kind)), span["kind"] + 1) + votes + F.element_at(F.lit(list(self.size)), span["kind"] * SIZES + span["size"] + 1)


def fit(found: DataFrame, epochs: int = 300, rate: float = 1.0) -> SpanModel:
    """Train the span classifier on the vote patterns of all candidates (at most kinds x votes x sizes rows)."""
    rows = found.select(F.explode("_spans").alias("s")).groupBy("s.kind", "s.base", "s.votes", "s.size").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r["kind"], r["base"], tuple(r["votes"]), r["size"], r["n"]) for r in rows)
    merged: dict = defaultdict(int)
    for kind, base, votes, _, n in rows:
        merged[kind, base, votes] += n
    patterns = [(*k, n) for k, n in merged.items()]
    _, post = reliabilities(patterns)
    soft = {p[:3]: q for p, q in zip(patterns, post, strict=True)}
    wk, wv, ws = [0.0] * len(KINDS), [0.0] * (len(KINDS) * len(LABELERS) * 3), [0.0] * (len(KINDS) * SIZES)
    totals: dict = defaultdict(float)
    for kind, *_, n in rows:
        totals[kind] += n
    for _ in range(epochs):
        gk, gv, gs = [0.0] * len(wk), [0.0] * len(wv), [0.0] * len(ws)
        for kind, base, votes, size, n in rows:
            at = [SpanModel.vote_at(kind, i, v) for i, v in enumerate(votes)]
            slope = (n / totals[kind]) * (_sigmoid(wk[kind] + sum(wv[a] for a in at) + ws[kind * SIZES + size]) - soft[kind, base, votes])
            gk[kind] += slope
            gs[kind * SIZES + size] += slope
            for a in at:
                gv[a] += slope
        for w, g in ((wk, gk), (wv, gv), (ws, gs)):
            for i, x in enumerate(g):
                w[i] -= rate * (x + 1e-3 * w[i])
    return SpanModel(tuple(wk), tuple(wv), tuple(ws))


def _apart(span: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def find_pii(docs: DataFrame, text: str = "text", threshold: float = 2.0) -> DataFrame:
    """docs with pii_spans: array<struct<kind:int,start,end,base>> by kind, then start (code points, end exclusive).

    Base spans always stay; other candidates whose log-odds pass threshold are added if they touch no base
    span. A null text is empty and has no spans; repeated rows get equal spans; an empty table stays empty.
    """
    found = cut_lineage(candidates(docs.drop("_spans", "_hits", "pii_spans"), text))
    model = fit(found)
    base = F.filter("_spans", lambda s: s["base"])
    kept = found.withColumn("_base", base)
    added = F.filter("_spans", lambda s: ~s["base"] & (model.logit(s) > threshold) & _apart(s, F.col("_base")))
    every = F.array_sort(F.transform(F.concat("_base", added), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))
    return kept.withColumn("pii_spans", F.when(F.size("_spans") > 0, F.array_distinct(every)).otherwise(F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>"))).drop("_spans", "_base")


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by [KIND]; of overlapping spans the one that starts first is named."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        by_start,
        start,
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))).alias("out"))
        ),
        lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substring(text, acc["at"] + 1, F.length(text))),
    )
