"""Personal data by weak supervision [native].

Strict patterns give base spans. Wider patterns of every kind propose further candidates. Three labelers vote on base
spans and candidates alike: the form of the match, a gazetteer and the words before it. Expectation-maximisation over the
histogram of vote patterns estimates each labeler's reliability and every pattern's probability; a span classifier,
logistic in the votes, a mark against (words such as serial or version before the match) and the length, is trained on
those probabilities and alone decides which candidates are added. The histogram is all that leaves the cluster.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import written

KINDS = ("email", "ip", "card", "phone")

#: The strict patterns for Java's matcher. Possessive repeats and look-behinds keep them linear on long runs without
#: changing a match: a leftmost match begins where its first class does, or right after the match before it.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider proposals: written-out addresses, dots in brackets and long addresses, cards in groups with other separators, and
#: phone numbers without the international plus.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z]{2,24}){1,4}",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?[(\[](?:\.|dot)[)\]]\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}([._/]|\x20\x20|\x20-\x20)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9(]\x20)\(?[0-9]{2,4}[)\x20.-][\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])|(?<![0-9A-Za-z+.-])00[1-9][0-9]?[\x20.-][0-9\x20.-]{6,14}[0-9](?![0-9A-Za-z-])",
}
_OCTET = "(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
FORM = {
    "email": r"(?i)(?:@|[(\[]at[)\]]).*(?:[(\[]dot[)\]]|\.)\x20?[a-z]{2,24}$",
    "ip": rf"^{_OCTET}(?:(?:\.|\x20?[(\[](?:\.|dot)[)\]]\x20?){_OCTET}){{3}}$|^(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$",
    "phone": r"^(?:\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}|(?:\+|00)[1-9][0-9]{0,2}[\x20.(-].*)$",
}
#: Endings of addresses, first octets of unicast addresses, issuers' prefixes, and the beginnings of area and
#: country codes.
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])[^0-9A-Fa-f:]|^(?i:2[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-8]|30|6011|65)",
    "phone": r"^\(?[2-9][0-9]{1,3}|^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel)[^A-Za-z]*(?:[A-Za-z]+[^A-Za-z]+){0,2}$",
    "ip": r"(?i)\b(?:ip|address|addr|host|server|client|login|ping|from)[^A-Za-z]*(?:[A-Za-z]+[^A-Za-z]+){0,2}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte)[^A-Za-z0-9]*(?:[A-Za-z]+[^A-Za-z0-9]+){0,2}$",
    "phone": r"(?i)(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp|dial|ring|contact)[^A-Za-z0-9]*(?:[A-Za-z]+[^A-Za-z0-9]+){0,2}$",
}
AGAINST = r"(?i)\b(?:version|ver|serial|order|invoice|isbn|issn|item|part|build|ref|release|sku|model)[^A-Za-z0-9]{0,3}(?:no|nr|number)?[^A-Za-z0-9]{0,3}$"
#: Characters before a match, back to the match before it, in which context is looked for.
CONTEXT_CHARS = 32
ADD_AT = 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
WIDE_NEEDS = {
    "email": lambda t: t.rlike(r"[(\[]at[)\]]"),
    "ip": lambda t: t.rlike(r"[0-9]\x20?[(\[](?:\.|dot)[)\]]|:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"),
    "card": lambda t: t.rlike(r"[0-9]{4}(?:[._/]|\x20\x20|\x20-\x20)[0-9]{4}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{3}|00[1-9]"),
}

_SPANS = "array<struct<s:bigint,e:bigint,m:string,b:string>>"
#: Spans gathered before they are put away, so that adding one never copies all before it.
_SHELF = 256


def spans(text: Column, pattern: str, needs: Column) -> Column:
    """All leftmost non-overlapping matches as (s, e, m, b): code points, end exclusive, and the characters before.

    Native functions return matches without places; the pieces between matches, cut by the same pattern, give them.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    empty = F.array().cast(_SPANS)
    shelves = F.array().cast(f"array<{_SPANS}>")
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["m"])
        span = F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"), x["m"].alias("m"), F.right(x["b"], F.lit(CONTEXT_CHARS)).alias("b"))
        return F.struct(e.cast("bigint").alias("at"), F.concat(acc["out"], F.array(span)).cast(_SPANS).alias("out"), acc["done"].alias("done"))

    def put_away(acc: Column) -> Column:
        return F.struct(acc["at"].alias("at"), empty.alias("out"), F.concat(acc["done"], F.array(acc["out"])).cast(f"array<{_SPANS}>").alias("done"))

    zipped = F.arrays_zip(between.alias("b"), matches.alias("m"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _SHELF).cast("int")), lambda i: F.slice(zipped, i * _SHELF + 1, _SHELF))
    start = F.struct(zero.alias("at"), empty.alias("out"), shelves.alias("done"))
    walked = F.aggregate(parts, start, lambda acc, part: F.aggregate(part, acc, step, put_away), lambda acc: F.flatten(acc["done"]))
    return F.when(needs & (F.size(matches) > 0), walked).otherwise(empty)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(spans(text, BASE[kind], NEEDS[kind](text)), lambda x: VALID[kind](x["m"]))


def joined(parts: dict[str, Column]) -> Column:
    """kind:start:end of the spans by kind as listed, then start, joined by commas."""
    def written_as(kind: str):
        return lambda x: F.concat(F.lit(kind + ":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
    return F.array_join(F.concat(*[F.transform(parts[k], written_as(k)) for k in KINDS]), ",")


def votes(kind: str, m: Column, before: Column) -> dict[str, Column]:
    """1 or 0 by labeler, the mark against, and the length in steps of four characters, from 0 to 1."""
    form = VALID["card"](m) if kind == "card" else m.rlike(FORM[kind])
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {"v_form": bit(form), "v_gazetteer": bit(m.rlike(GAZETTEER[kind])), "v_context": bit(before.rlike(CONTEXT[kind])),
            "against": bit(before.rlike(AGAINST)), "length": F.floor(F.least(F.length(m), F.lit(40)) / 4) / 10}


LABELERS = ("v_form", "v_gazetteer", "v_context")
FEATURES = (*LABELERS, "against", "length")


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 100) -> tuple[float, list[tuple[float, float]], list[float]]:
    """(share of true spans, (hit rate, false alarm rate) by labeler, posterior by pattern) for vote patterns and counts.

    The Dawid-Skene model for binary votes, with a Beta prior on each rate that ranks labelers above chance. Before any
    vote a span is no likelier true than not: the share enters the posterior as a half at most.
    """
    n = len(LABELERS)
    share, rates = 0.5, [(0.8, 0.2)] * n
    posterior = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (v, _) in enumerate(patterns):
            a, b = min(share, 0.5), 1 - min(share, 0.5)
            for x, (hit, alarm) in zip(v, rates):
                a, b = a * (hit if x else 1 - hit), b * (alarm if x else 1 - alarm)
            posterior[i] = a / (a + b)
        true = sum(c * p for (_, c), p in zip(patterns, posterior))
        false = sum(c * (1 - p) for (_, c), p in zip(patterns, posterior))
        share = (true + 1) / (true + false + 2)
        rates = [((sum(c * p for (v, c), p in zip(patterns, posterior) if v[j]) + 8) / (true + 10),
                  (sum(c * (1 - p) for (v, c), p in zip(patterns, posterior) if v[j]) + 2) / (false + 10)) for j in range(n)]
        rates = [(hit, min(hit, alarm)) for hit, alarm in rates]  # a labeler's vote never speaks against a span
    return share, rates, posterior


def span_classifier(cells: list[tuple[tuple[float, ...], float, float]], ridge: float = 0.02, rounds: int = 60) -> list[float]:
    """Logistic weights (intercept first) from (features, weight, probability) cells by Newton's method with a ridge."""
    n = len(FEATURES) + 1
    w = [0.0] * n
    for _ in range(rounds):
        grad, hess = [-ridge * x for x in w], [[ridge * (i == j) for j in range(n)] for i in range(n)]
        for f, c, p in cells:
            x = (1.0, *f)
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for i in range(n):
                grad[i] += c * (p - q) * x[i]
                for j in range(n):
                    hess[i][j] += c * max(q * (1 - q), 1e-3) * x[i] * x[j]
        step = _solved(hess, grad)
        w = [a + max(-2.0, min(2.0, b)) for a, b in zip(w, step)]
        if max(map(abs, step)) < 1e-9:
            break
    return w


def _solved(m: list[list[float]], y: list[float]) -> list[float]:
    """The solution of a small positive definite system by elimination."""
    n = len(y)
    rows = [[*r, v] for r, v in zip(m, y)]
    for i in range(n):
        for k in range(i + 1, n):
            t = rows[k][i] / rows[i][i]
            rows[k] = [b - t * a for a, b in zip(rows[i], rows[k])]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def train(cells: list[tuple[tuple[float, ...], int]]) -> list[float]:
    """Classifier weights of a kind from counted cells of features.

    Every vote pattern counts once more than seen, with and without the mark against (which halves its odds four times
    over), so that patterns which no text shows have a place too. Cells weigh by the logarithm of their counts, so that
    the most common pattern does not drown the others.
    """
    every = list(itertools.product((0, 1), repeat=len(LABELERS)))
    seen = {v: 1.0 for v in every}
    for f, c in cells:
        seen[tuple(int(x) for x in f[:len(LABELERS)])] += c
    patterns = sorted(seen.items())
    _, _, posterior = expectation_maximisation(patterns)
    p = {v: q for (v, _), q in zip(patterns, posterior)}
    usual = sum(f[4] * c for f, c in cells) / (sum(c for _, c in cells) or 1) if cells else 0.4
    doubted = lambda q: q / (q + 16 * (1 - q))
    told = [((*map(float, f[:3]), float(f[3]), float(f[4])), 1 + math.log(c), doubted(p[tuple(int(x) for x in f[:3])]) if f[3] else p[tuple(int(x) for x in f[:3])]) for f, c in cells]
    told += [((*map(float, v), float(a), usual), 1.0, doubted(q) if a else q) for v, q in p.items() for a in (0, 1)]
    return span_classifier(told)


def fit(found: DataFrame) -> dict[str, list[float]]:
    """Classifier weights by kind from all base spans and candidates of ``found``."""
    cells = None
    for kind in KINDS:
        x = found.select(F.explode(F.concat("b_" + kind, "w_" + kind)).alias("x"))
        x = x.select(F.lit(kind).alias("kind"), *[c.alias(n) for n, c in votes(kind, F.col("x.m"), F.col("x.b")).items()])
        cells = x if cells is None else cells.unionByName(x)
    rows = cells.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")).collect()  # at most 176 cells a kind
    return {k: train(sorted((tuple(r[f] for f in FEATURES), r["n"]) for r in rows if r["kind"] == k)) for k in KINDS}


def _added(kind: str, weights: list[float]) -> Column:
    def accept(x: Column) -> Column:
        z = F.lit(weights[0])
        for w, c in zip(weights[1:], votes(kind, x["m"], x["b"]).values()):
            z = z + F.lit(w) * c
        clear = ~F.exists("b_" + kind, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return (1 / (1 + F.exp(-z)) >= ADD_AT) & clear
    return F.filter("w_" + kind, accept)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_email, n_ip, n_card, n_phone (base spans), base_spans, spans, n_added.

    Spans are written kind:start:end (code points, end exclusive) by kind, then start. Base spans are the strict
    patterns' valid matches and always stay; spans of the same kind that the classifier adds never overlap them. Null
    and empty texts have none. Repeated rows are searched each; whole texts are searched once, however long; extra
    columns are not read, whatever their names; an empty table gives an empty result.
    """
    t = F.col("text")
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cols = {f"b_{k}": base_spans(t, k) for k in KINDS} | {f"w_{k}": spans(t, WIDE[k], WIDE_NEEDS[k](t)) for k in KINDS}
    found = written(src.select("_id", *[c.alias(k) for k, c in cols.items()]), "pii-spans")
    models = fit(found)
    found = found.withColumns({"a_" + k: _added(k, models[k]) for k in KINDS})
    base = {k: F.col("b_" + k) for k in KINDS}
    every = {k: F.array_sort(F.concat(F.col("b_" + k), F.col("a_" + k))) for k in KINDS}
    n_added = sum((F.size("a_" + k) for k in KINDS), F.lit(0))
    return found.select(F.col("_id").alias(id_col), *[F.size(base[k]).cast("long").alias("n_" + k) for k in KINDS],
                        joined(base).alias("base_spans"), joined(every).alias("spans"), n_added.cast("long").alias("n_added"))
