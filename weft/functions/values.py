"""Value normalisation, dates, currencies and shapes as Column expressions, all inside code generation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft import config

Normalizer = Callable[[Column], Column]


def _latin_bases() -> tuple[str, str]:
    """Accented Latin letters and the base letters of their compatibility decompositions."""
    source, target = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            source.append(chr(point))
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _BASES = _latin_bases()


def unaccent(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _BASES), r"\p{M}+", "")


def nullif_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def basic(c: Column) -> Column:
    """Unaccented, trimmed, lower case, single spaces; ``12.0`` as ``12``; empty texts and numbers that are NaN as null.

    The text ``nan`` is a name like any other; a number that is NaN is no value, and is told by what it is cast to.
    """
    s = F.lower(unaccent(c.cast("string")))
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, r"^(-?\d+)\.0+$", "$1")
    return F.when(~(F.typeof(c).isin("double", "float") & (s == "nan")), nullif_empty(s))


def alnum(c: Column) -> Column:
    s = F.regexp_replace(basic(c), r"(?U)[^\w\s]", " ")
    return nullif_empty(F.trim(F.regexp_replace(s, r"\s+", " ")))


def identifier(c: Column) -> Column:
    """``CUST-00123`` and ``123`` as ``123``; what is no number after a letter prefix stays as ``basic`` gives it."""
    b = basic(c)
    bare = F.regexp_replace(b, r"^[a-z]+[-_ ]?", "")
    return F.when(bare.rlike(r"^\d+$"), F.regexp_replace(bare, r"^0+(?=\d)", "")).otherwise(b)


def digits(c: Column, keep_last: int = 10) -> Column:
    d = F.regexp_replace(c.cast("string"), r"\D", "")
    return F.when(F.length(d) >= 6, F.right(d, F.lit(keep_last)))


def geo(c: Column) -> Column:
    b = basic(c)
    for suffix in config.GEO_SUFFIXES:
        b = F.regexp_replace(b, suffix, "")
    return alnum(b)


def _alias(domain: str) -> Column:
    pairs = [F.lit(x) for kv in config.DOMAINS[domain].items() for x in kv]
    return F.create_map(*pairs)


def domain(name: str) -> Normalizer:
    """Aliases of one vocabulary; forms are tried raw, without a state suffix and as ``geo``; else the geo form."""
    def apply(c: Column) -> Column:
        aliases = _alias(name)
        raw, short, place = alnum(c), alnum(F.regexp_replace(basic(c), config.STATE_SUFFIX, "")), geo(c)
        return F.coalesce(*[F.try_element_at(aliases, x) for x in (raw, short, place)], place)
    return apply


def semantic(kind: str) -> Normalizer:
    """All vocabularies of one semantic type: the first that changes the value wins."""
    names = [d for d, t in config.DOMAIN_TYPES.items() if t == kind]

    def apply(c: Column) -> Column:
        plain = geo(c)
        mapped = [domain(n)(c) for n in names]
        return F.coalesce(*[F.when(~m.eqNullSafe(plain), m) for m in mapped], plain)
    return apply


_REGISTRY: dict[str, Normalizer] = {"basic": basic, "identity": basic, "alnum": alnum, "identifier": identifier, "digits": digits, "geo": geo}
_REGISTRY |= {f"domain:{d}": domain(d) for d in config.DOMAINS}
_REGISTRY |= {f"semantic:{t}": semantic(t) for t in {t for t in config.DOMAIN_TYPES.values() if sum(x == t for x in config.DOMAIN_TYPES.values()) > 1}}


def register_normalizer(name: str, fn: Normalizer) -> None:
    _REGISTRY[name] = fn


def normalizer(name: str | None) -> Normalizer:
    return _REGISTRY.get(name or "basic", basic)


def mapped(pairs: dict[str, str]) -> Normalizer:
    """A normaliser from an explicit value map (as verified crosswalks give), over ``alnum`` forms."""
    def apply(c: Column) -> Column:
        a = alnum(c)
        if not pairs:
            return a
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), a), a)
    return apply


# The date layouts that are understood, in order of trial.
ISO_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd", "yyyy/MM/dd")
DAY_FIRST = ("d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy")
MONTH_FIRST = ("M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy", "M-d-yyyy")
NAMED_MONTH = ("d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "yyyyMMdd")


def layouts(dayfirst: bool) -> tuple[str, ...]:
    first, second = (DAY_FIRST, MONTH_FIRST) if dayfirst else (MONTH_FIRST, DAY_FIRST)
    return (*ISO_LAYOUTS, *first, *second, *NAMED_MONTH)


_SYMBOLS = (("MMMM|MMM", r"\p{L}+\.?"), ("yyyy", r"\d{4}"), ("S+", r"\d{1,9}"), ("HH|mm|ss|MM|dd", r"\d{2}"), ("M|d", r"\d{1,2}"), ("'T'", "T"))


def layout_shape(layout: str) -> str:
    """A pattern that every text of a layout has: a text is parsed only where it may succeed, for failing costs most."""
    out, at = "", 0
    symbols = re.compile("|".join(f"({p})" for p, _ in _SYMBOLS))
    for m in symbols.finditer(layout):
        out += re.escape(layout[at:m.start()]) + _SYMBOLS[m.lastindex - 1][1]
        at = m.end()
    return f"^{out}{re.escape(layout[at:])}$"


def _read(t: Column, some: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(t.rlike(layout_shape(p)), F.try_to_timestamp(t, F.lit(p))) for p in some])


def parse_timestamp(c: Column, dayfirst: bool = False) -> Column:
    """The first layout that reads the trimmed text; time zones after the seconds are dropped; else null."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"(?<=:\d\d)(\.\d+)?(Z|[+-]\d\d:?\d\d)$", "$1")
    return _read(t, layouts(dayfirst)).cast("timestamp_ntz")


def parse_date(c: Column, dayfirst: bool = False) -> Column:
    return parse_timestamp(c, dayfirst).cast("date")


def is_dayfirst(c: Column) -> Column:
    """Aggregate: whether some value reads day-first and none of the month-first layouts reads it."""
    t = F.trim(c.cast("string"))
    reads = [_read(t, group).isNotNull() for group in (DAY_FIRST, MONTH_FIRST)]
    return F.coalesce(F.bool_or(reads[0] & ~reads[1]), F.lit(False))


def date_parse_rate(c: Column, dayfirst: bool = False) -> Column:
    """Aggregate: the share of non-empty values that read as dates."""
    filled = nullif_empty(F.trim(c.cast("string")))
    return F.avg(F.when(filled.isNotNull(), parse_timestamp(filled, dayfirst).isNotNull().cast("double")))


_AMOUNT = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"


def currency_amount(c: Column) -> Column:
    found = nullif_empty(F.regexp_extract(c.cast("string"), f"({_AMOUNT})", 1))
    return F.regexp_replace(found, ",", "").try_cast("double")


def currency_code(c: Column, default: Column | None = None) -> Column:
    """An ISO code as a word of its own, else a symbol (longest first), else ``default``."""
    text = F.upper(c.cast("string"))
    word = nullif_empty(F.regexp_extract(text, r"(?<![A-Z])(" + "|".join(sorted(config.FX_TO_USD)) + r")(?![A-Z])", 1))
    symbols = sorted(config.CURRENCY_SYMBOLS, key=lambda s: (-len(s), s))
    by_symbol = [F.when(c.cast("string").contains(s), F.lit(config.CURRENCY_SYMBOLS[s])) for s in symbols]
    return F.coalesce(word, *by_symbol, default if default is not None else F.lit(None).cast("string"))


def to_base(amount: Column, code: Column, base: str = "USD") -> Column:
    """``amount`` in ``base`` at the fixed rates, to four places; null for unknown codes."""
    rates = F.create_map(*[x for k, v in config.FX_TO_USD.items() for x in (F.lit(k), F.lit(v))])
    return F.round(amount * F.try_element_at(rates, F.upper(code)) / F.lit(config.FX_TO_USD[base]), 4)


def value_shape(c: Column, max_len: int = 12) -> Column:
    """The pattern of a value: digits 9, capitals A, letters a, repeated classes once, cut to ``max_len``."""
    s = F.substring(c.cast("string"), 1, 64)
    steps = ((r"\p{Lu}+", "A"), (r"[\p{L}&&[^\p{Lu}]]+", "a"), (r"\p{Nd}+", "9"), (r"\s+", " "), (r"(.)\1+", "$1"))
    return F.left(reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), steps, s), F.lit(max_len))


TITLES = r"^(mr|mrs|ms|miss|dr|prof|sir|shri|smt)\.?\s+"


def person_name(c: Column) -> Column:
    """``Doe, Dr. Jane`` as ``jane doe``: no titles, no punctuation, given name first."""
    b = basic(c)
    turned = F.when(b.contains(","), F.concat_ws(" ", F.trim(F.substring_index(b, ",", -1)), F.trim(F.substring_index(b, ",", 1)))).otherwise(b)
    bare = F.regexp_replace(F.trim(turned), TITLES, "")
    return nullif_empty(F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]", " "), r"\s+", " ")))


def logit(p: Column, cap: float = 12.0) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), F.log(q / (1 - q))))


def edge_cost(confidence: Column, mode: str = "neglog") -> Column:
    return -F.log(F.greatest(confidence, F.lit(1e-9))) if mode == "neglog" else 1 - confidence
