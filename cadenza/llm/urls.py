"""URL filters: host rules, and a character language-model ratio for what no rule decides.

URLs that an allow or a block rule decides train two smoothed Markov models over characters.  A
character's probability mixes the counts of contexts of ``ORDER`` characters down to none, each
leaning on the shorter one and the shortest on equal shares of all code points; a context never seen
leaves the shorter one's estimate, so the order varies with what is known.  The probabilities after
any context sum to one.  A URL's score is the difference of its two log-likelihoods per character;
the threshold is the one that best tells held-out accepted from rejected URLs.

Only DataFrame functions.  Counts are exact, one row for each gram, however many; the grams that
occur in the URLs to be scored are looked up once each by equality joins, order by order, and a
URL's characters then join the finished log-ratios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_broadcast, kept

#: (rule, verdict); a rule is a host and a path prefix.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
ORDER, LEAN = 4, 4.0
#: Code points that a character may be.
ALPHABET = 0x110000
#: Grams whose log-ratios are broadcast (some 60 bytes each); more are joined by a shuffle.
BROADCAST_GRAMS = 50_000
#: One labelled URL in so many calibrates the threshold instead of training.
HELD_OUT = 5
#: Width and limit of the score bins of the calibration; their number reaches the driver.
BIN, FARTHEST = 0.01, 10.0
_START, _END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    tail = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(tail, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits (null if none): its host or a subdomain, and its path's start."""
    found = [F.lit(None).cast("string")]
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at, _, prefix = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + prefix)
        found.insert(0, F.when(fits, F.lit(rule)))
    return F.coalesce(*found)


def _grams(urls: DataFrame) -> DataFrame:
    """``urls`` (with ``s``) with a row for each character and the end mark: ``gram``, the character
    after the ``ORDER`` before it."""
    line = urls.withColumn("line", F.concat(F.lit(_START * ORDER), "s", F.lit(_END)))
    grams = F.transform(F.sequence(F.lit(1), F.length("line") - ORDER), lambda i: F.substring(F.col("line"), i, F.lit(ORDER + 1)))
    return line.select(*urls.columns, F.explode(grams).alias("gram"))


def train(labelled: DataFrame) -> DataFrame:
    """(gram, accepted, rejected): how often each character followed its ``ORDER`` predecessors in
    the URLs (s, ok) of either kind."""
    return _grams(labelled.select("s", "ok")).groupBy("gram").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


def probabilities(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, accepted, rejected): the two models' probabilities of each distinct gram's last
    character after the others.  Counts of shorter grams are sums of ``counts``."""
    sides = ["accepted", "rejected"]
    out = grams.select("gram").distinct().select("gram", *(F.lit(1.0 / ALPHABET).alias(x) for x in sides))
    for k in range(ORDER + 1):
        suffix = F.substring("gram", ORDER + 1 - k, k + 1)
        seen = counts.groupBy(suffix.alias("own")).agg(*(F.sum(x).alias(f"n_{x}") for x in sides))
        after = seen.groupBy(F.substring("own", 1, k).alias("context")).agg(*(F.sum(f"n_{x}").alias(f"c_{x}") for x in sides))
        out = out.withColumn("own", suffix).withColumn("context", F.substring("own", 1, k)).join(seen, "own", "left").join(after, "context", "left")
        mixed = [((F.coalesce(f"n_{x}", F.lit(0)) + LEAN * F.col(x)) / (F.coalesce(f"c_{x}", F.lit(0)) + LEAN)).alias(x) for x in sides]
        out = out.select("gram", *mixed)
    return out


def scores(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(s, score) for the distinct ``s`` of ``urls``; an empty s scores its end mark alone."""
    each = _grams(urls.select("s").distinct())
    found = probabilities(each, counts)
    ratio = kept(found.select(F.col("gram").alias("of"), (F.log("accepted") - F.log("rejected")).alias("d")), "url-grams")
    return each.join(bound_broadcast(ratio, BROADCAST_GRAMS), F.col("gram") == F.col("of")).groupBy("s").agg(F.avg("d").alias("score"))


def calibrated(scored: DataFrame) -> float:
    """Threshold that best tells ok from not ok (mean of both hit rates) over (ok, score) rows; 0
    if one kind is missing.  Scores are binned, so some thousand counts reach the driver."""
    at = F.round(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), "score")) / BIN).cast("int")
    bins = sorted(tuple(r) for r in scored.groupBy(at.alias("bin")).agg(F.count_if("ok"), F.count_if(~F.col("ok"))).collect())
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return 0.0
    best, edge, passed_good, passed_bad = -1.0, 0.0, good, bad
    for k, (bin_, ok, no) in enumerate(bins):
        # accept from this bin on; the edge lies midway to the bin before
        before = bins[k - 1][0] if k else bin_
        rate = passed_good / good + 1 - passed_bad / bad
        if rate > best:
            best, edge = rate, (before + bin_) / 2 * BIN
        passed_good, passed_bad = passed_good - ok, passed_bad - no
    return edge


def filtered(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, score (null where a rule decides) and verdict.

    Null URLs and those without ``://`` have empty host and path and are judged by the model.
    Columns of those names are replaced; repeated rows stay; an empty table gives no rows.  If the
    rules label no URL, or all alike, the model's threshold is 0."""
    made = ["host", "path", "rule", "score", "verdict"]
    host, path = host_path(F.col("url").cast("string"))
    row = pages.select(F.struct("*").alias("__row"), host.alias("host"), path.alias("path"))
    row = row.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    row = row.withColumn("said", F.try_element_at(said, F.col("rule"))).withColumn("s", F.concat("host", "path"))
    labelled = row.where("said IS NOT NULL").select("s", (F.col("said") == "allow").alias("ok"))
    held = F.pmod(F.xxhash64("s"), F.lit(HELD_OUT)) == 0
    model = kept(train(labelled.where(~held)), "url-model")
    aside = labelled.where(held)
    edge = calibrated(aside.join(scores(aside, model), "s"))
    known = scores(row.where("said IS NULL"), model)
    both = row.join(known, "s", "left")
    score = F.when(F.col("said").isNull(), F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("said", F.when(score >= F.lit(edge), "allow").otherwise("block"))
    own = [F.col(f"__row.`{c}`").alias(c) for c in pages.columns if c not in made]
    return both.select(*own, "host", "path", "rule", score.alias("score"), verdict.alias("verdict"))


def held_out_rates(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> dict[str, float]:
    """Hit rates of the method alone on the labelled URLs that do not train it: share of accepted
    ones that it allows (``allow``), of rejected ones that it blocks (``block``).  The threshold is
    fitted on half of them and judged on the other half, by a hash of the URL."""
    host, path = host_path(F.col("url").cast("string"))
    said = F.create_map(*[F.lit(x) for rule in rules for x in rule])
    row = pages.select(F.concat(host, path).alias("s"), F.try_element_at(said, rule_of(host, path, rules)).alias("said")).where("said IS NOT NULL")
    row = row.select("s", (F.col("said") == "allow").alias("ok")).distinct()
    held = F.pmod(F.xxhash64("s"), F.lit(HELD_OUT)) == 0
    aside = row.where(held)
    scored = aside.join(scores(aside, kept(train(row.where(~held)), "url-model")), "s").withColumn("half", F.pmod(F.xxhash64(F.lit(3), "s"), F.lit(2)))
    edge = calibrated(scored.where("half = 0"))
    good = F.avg(F.when(F.col("ok"), (F.col("score") >= edge).cast("double")))
    bad = F.avg(F.when(~F.col("ok"), (F.col("score") < edge).cast("double")))
    return dict(zip(("allow", "block"), scored.where("half = 1").agg(good, bad).first(), strict=True))
