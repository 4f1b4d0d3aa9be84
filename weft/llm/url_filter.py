"""URL filtering by a character language-model ratio [native].

Two variable-order Markov models over the characters of host and path, one of accepted and one of rejected URLs, are
plain count tables of character n-grams. A URL's length-normalised log-likelihood difference comes from an explode, a
join with the table of differences and a sum, and is compared with a threshold calibrated on the known URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import written

#: (host suffix, path prefix, verdict). A rule fits its host and all subdomains if the path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The longest n-gram, and the weight of the shorter context in the interpolation of counts (Dirichlet smoothing).
ORDER = 5
PRIOR = 2.0
ALPHABET = 96
#: Up to so many n-grams, about 60 bytes each, the table of differences is broadcast; beyond, it is joined by shuffle.
MAX_BROADCAST_GRAMS = 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased;
    then the path up to ``?``, ``#`` or the end. Both are empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits (ties: the first by text), or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _grams(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each character of ``body``: the n-gram that ends in it, with ^ before the beginning.

    Runs of digits are one 0 and capitals small, so that numbers carry no identity.
    """
    t = F.concat(F.lit("^" * (ORDER - 1)), F.lower(F.regexp_replace("body", "[0-9]+", "0")), F.lit("$"))
    t = df.select(*keep, t.alias("_t")).withColumn("_n", F.length("_t"))
    places = F.explode(F.sequence(F.lit(1), F.col("_n") - (ORDER - 1)))
    return t.select(*keep, "_t", places.alias("_i")).select(*keep, F.substring(F.col("_t"), F.col("_i"), F.lit(ORDER)).alias("g"))


def train(urls: DataFrame) -> DataFrame:
    """(g, diff): log P(last character | context, accepted) less the same for rejected, by n-gram of ``urls``.

    ``urls`` has body and accepted (boolean, null for URLs that are not counted). Each order's probability is its count
    plus PRIOR times the next shorter order's, over its context's count plus PRIOR, down to the uniform distribution.
    N-grams of uncounted URLs are in the table with count 0, so that they get what their shorter suffixes and contexts
    say by the same interpolation.
    """
    none = F.lit(0.0)
    grams = written(_grams(urls, ["accepted"]).groupBy("g").agg(
        F.sum(F.coalesce(F.col("accepted").cast("double"), none)).alias("a"), F.sum(F.coalesce((~F.col("accepted")).cast("double"), none)).alias("r")), "url-grams")
    table = grams.select("g", F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pr"))
    for k in range(1, ORDER + 1):
        suffix, context = F.substring("g", ORDER - k + 1, k), F.substring("g", ORDER - k + 1, k - 1)
        of_suffix = grams.groupBy(suffix.alias("s")).agg(F.sum("a").alias("sa"), F.sum("r").alias("sr"))
        of_context = grams.groupBy(context.alias("c")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        table = (table.withColumns({"s": suffix, "c": context}).join(of_suffix, "s").join(of_context, "c")
                 .select("g", ((F.col("sa") + PRIOR * F.col("pa")) / (F.col("ca") + PRIOR)).alias("pa"),
                         ((F.col("sr") + PRIOR * F.col("pr")) / (F.col("cr") + PRIOR)).alias("pr")))
    return written(table.select("g", (F.log("pa") - F.log("pr")).alias("diff")), "url-model")


def mean_difference(urls: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and diff: the mean over a URL's characters; n-grams that are not in ``model`` (of no URL of ``train``) count 0."""
    small = model.count() <= MAX_BROADCAST_GRAMS
    scored = _grams(urls, keys).join(F.broadcast(model) if small else model, "g", "left")
    return scored.groupBy(*keys).agg((F.sum(F.coalesce("diff", F.lit(0.0))) / F.count("*")).alias("diff"))


def calibrated_threshold(known: DataFrame, width: float = 0.005) -> float:
    """The threshold on diff that errs least on (diff, accepted), the classes weighing the same; ties: nearest 0.

    Works on a histogram of bins of ``width`` from -5 to 5, so a bounded number of rows reaches the driver.
    """
    b = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("diff") / width))).cast("int")
    rows = known.groupBy(b.alias("b")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")).collect()
    total_a, total_r = max(1, sum(x["a"] for x in rows)), max(1, sum(x["r"] for x in rows))
    best, missed, passed = [(1.0, 0.0)], 0, sum(x["r"] for x in rows)
    for x in sorted(rows, key=lambda x: x["b"]):
        best.append((missed / total_a + passed / total_r, x["b"] * width))
        missed, passed = missed + x["a"], passed - x["r"]
    best.append((missed / total_a + passed / total_r, (max((x["b"] for x in rows), default=0) + 1) * width))
    return min(best, key=lambda p: (round(p[0], 12), abs(p[1])))[1]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule, verdict, difference.

    Of the URLs that a rule decides (each distinct host and path once), a fifth by hash calibrate the threshold and the
    others are counted; where that fifth is not of both kinds, all known URLs calibrate. The verdict of undecided URLs is
    allow if their difference reaches the threshold. Null URLs and URLs without ``://`` have empty host and path, fit no
    rule and are judged by the models like others. An empty table gives an empty result. Without known URLs of both kinds every difference is 0
    and the verdict allow. Equal URLs are judged once and joined back, so repeated rows and hot hosts cost nothing more.
    """
    host, path = split_url(F.col(url_col))
    src = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    urls = src.select("host", "path").distinct().withColumns({"rule": rule, "ruled": verdict, "body": F.concat("host", "path")})
    urls = written(urls, "urls")
    accepted, held = F.col("ruled") == "allow", F.pmod(F.xxhash64("body", F.lit(5)), F.lit(5)) == 0
    known = urls.where("ruled IS NOT NULL").select("host", "path", accepted.alias("accepted"), held.alias("held"))
    model = train(urls.select("body", F.when(~held, accepted).alias("accepted")))
    scored = written(mean_difference(urls, model, ["host", "path"]), "url-scores")
    both = known.where("held").agg(F.count_if("accepted"), F.count_if(~F.col("accepted"))).first()
    pairs = known.where("held" if all(both) else "true").join(scored, ["host", "path"]).select("diff", "accepted")
    threshold = calibrated_threshold(pairs)
    verdict = F.coalesce("ruled", F.when(F.coalesce("diff", F.lit(0.0)) >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    decided = urls.join(scored, ["host", "path"], "left").select("host", "path", "rule", verdict.alias("verdict"), F.coalesce("diff", F.lit(0.0)).alias("difference"))
    # Written, so that the join deals rows and verdicts out by themselves and a hot URL's rows can be split.
    return src.join(written(decided, "url-verdicts"), ["host", "path"]).select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict", "difference")
