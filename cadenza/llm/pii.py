"""Personal data: base patterns, and spans that boosted trees select among overlapping candidates.

Base spans are matches of one pattern for each kind that pass its test.  A greedy pattern swallows
neighbours and then fails (a phone number followed by a card number, two cards in a row), and people
write addresses so that patterns miss them.  Generators therefore propose every window of digit
groups that could be an IP address, card or phone number, and every word that stands in front of
something like ``[at]``; boosted trees judge each candidate by its form and by what stands around it,
and a candidate counts if its score passes its kind's threshold and no better candidate, and no base
span, overlaps it.

All in DataFrame functions: one projection finds, scores and selects, without a shuffle.  Patterns are
possessive or anchored, so that they are linear in the text and need no stack.

The trees learn from weak labels on all documents: base spans and rewritten forms of them in their
surroundings are positive; other windows over the same characters, forms with a wrong check digit or
odd groups, and candidates of other text that break their kind's format are negative.  A fourth of
them does not train and sets the thresholds.  Rows of equal features and label are one with a weight,
so that training works on the kinds of candidates, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

#: The kinds in the order in which spans are listed.
KINDS = ["email", "ip", "card", "phone"]
#: Kinds of labelled candidates in one partition of the training.
KINDS_EACH = 200_000
#: Trees, their depth, and the share of right spans that a threshold must reach on held-out rows.
TREES, DEPTH, PRECISION = 12, 4, 0.98
#: Width and limit of the score bins of the calibration.
BIN, FARTHEST = 0.02, 4.0
#: Digit groups in a window, and characters kept before and after a match.
MOST_GROUPS, BEFORE, AFTER = 6, 24, 8

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
#: Every IP address, card and phone number lies within one such run.
_RUN = r"[+(0-9][\x20+().0-9-]{6,}+"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_AT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20@\x20|\x20at\x20)"
_DOT = r"(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20)"
_WRITTEN = rf"(?i)(?:\G|(?<!{_LOCAL})){_LOCAL}++{_AT}{_LABEL}++(?:{_DOT}{_LABEL}++)++"
#: Words in front of a kind that speak for it.
_CUES = {0: "mail|contact|write", 1: r"\bip\b|addr|host|server", 2: "card|visa|master|amex|credit|account|payment", 3: "tel|phone|call|fax|mobile|cell|whatsapp"}
_ENDINGS = "(?i)^(?:com|org|net|edu|gov|info|biz|io|de|fr|es|uk|eu)$"
FEATURES = [
    "kind", "digits", "groups", "luhn", "plus", "paren", "seps", "longest", "shortest", "last", "left", "right", "prev", "next", "cue", "valid", "at", "dot", "tail", "known",
]
_SPAN = "struct<kind:int,s:int,e:int>"
_HIT = "array<struct<s:int,m:string,before:string,after:string>>"
_CANDIDATE = "array<struct<kind:int,s:int,e:int," + ",".join(f"{f}_:double" for f in FEATURES) + ">>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _sums_before(numbers: Column) -> Column:
    """For each number the sum of those before it; in blocks, as a growing array is copied each time."""
    block = 256

    def run(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("x"))
        return F.aggregate(x, start, lambda acc, v: F.struct((acc["n"] + v).alias("n"), F.concat(acc["x"], F.array(acc["n"])).alias("x")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")), lambda b: run(F.slice(numbers, b * block + 1, F.lit(block))))
    shift = lambda p: _let(run(F.transform(p, lambda b: b["n"]))["x"], lambda at: F.flatten(F.transform(p, lambda b, i: F.transform(b["x"], lambda v: v + F.get(at, i)))))
    return F.when(F.size(numbers) == 0, F.array().cast("array<int>")).otherwise(_let(blocks, shift))


def matches(text: Column, pattern: str) -> Column:
    """The pattern's matches in a text, leftmost first: start s (in code points), the match m, and
    some characters before and after it."""

    def hits(pieces: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        one = lambda at: lambda m, i: F.struct(
            (F.get(at, i) + F.length(F.get(pieces, i))).alias("s"), m.alias("m"), F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after")
        )
        return _let(_sums_before(steps), lambda at: F.transform(found, one(at)))

    found = lambda pieces: F.when(F.size(pieces) > 1, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: hits(pieces, f)))
    return F.coalesce(_let(F.split(text, pattern, -1), found), F.array().cast(_HIT))


def _digits(x: Column) -> Column:
    return F.translate(x, " ().-+", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda a, b: a + b) % 10 == 0


def _ip_ok(m: Column) -> Column:
    return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")


def _card_ok(m: Column) -> Column:
    return _let(_digits(m), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


def _base(mails: Column, runs: Column) -> Column:
    """Base spans with their match and surroundings."""
    span = lambda k, x, s, before, after: F.struct(F.lit(k).alias("kind"), s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), before.alias("before"), after.alias("after"))

    def within(k: int, pattern: str, ok: Callable[[Column], Column]) -> Column:
        sides = lambda r, x: (F.right(F.concat(r["before"], x["before"]), F.lit(BEFORE)), F.left(F.concat(x["after"], r["after"]), F.lit(AFTER)))
        each = lambda r: F.transform(F.filter(matches(r["m"], pattern), lambda x: ok(x["m"])), lambda x: span(k, x, r["s"] + x["s"], *sides(r, x)))
        return F.flatten(F.transform(runs, each))

    return F.concat(F.transform(mails, lambda x: span(0, x, x["s"], x["before"], x["after"])), within(1, _IP, _ip_ok), within(2, _CARD, _card_ok), within(3, _PHONE, _phone_ok))


def _side(c: Column) -> Column:
    """What stands beside a candidate: 0 nothing or space, 1 a letter, 2 a digit, 3 other marks of
    numbers, 4 quotes, brackets and colons, 5 anything else."""
    out = F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.rlike("^[.+/-]$"), 3).when(c.rlike(r"""^["'()\[\]{}<>:;,!?]$"""), 4)
    return out.otherwise(5)


def _candidate(kind: int, s: Column, e: Column, **features: Column) -> Column:
    values = {"kind": F.lit(kind), **features}
    return F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), *(values.get(f, F.lit(0)).cast("double").alias(f"{f}_") for f in FEATURES))


def _windows(run: Column) -> Column:
    """Candidates among the digit groups of a run: windows of up to ``MOST_GROUPS`` groups."""

    def proposals(groups: Column, i: Column, j: Column) -> Column:
        part = F.slice(groups, i + 1, j - i + 1)
        return _let(F.struct(part.alias("p"), F.array_join(F.transform(part, lambda g: g["m"]), "").alias("d"), F.transform(F.slice(part, F.lit(2), F.lit(MOST_GROUPS)), lambda g: g["before"]).alias("seps")), lambda w: kinds(groups, i, j, w))

    def kinds(groups: Column, i: Column, j: Column, w: Column) -> Column:
        first, last, n, size = F.get(w["p"], F.lit(0)), F.get(w["p"], F.size(w["p"]) - 1), F.length(w["d"]), F.size(w["p"])
        lead = F.length(F.regexp_extract(first["before"], r"(\+?\(|\+)$", 1))
        start, end = run["s"] + first["s"], run["s"] + last["s"] + F.length(last["m"])
        at_first, at_last = i == 0, j == F.size(groups) - 1
        outside = F.when(at_first, run["before"]).otherwise(F.lit("0"))
        right = F.when(at_last, F.concat(last["after"], run["after"])).otherwise(F.get(groups, j + 1)["before"])
        near = lambda at, x: (~at & (F.length(x) == 1)).cast("int")
        lengths = F.transform(w["p"], lambda g: F.length(g["m"]))

        def with_(kind: int, lead_: Column, **more: Column) -> Column:
            left = F.concat(outside, F.left(first["before"], F.length(first["before"]) - lead_))
            return _candidate(
                kind, start - lead_, end, digits=n, groups=size, seps=F.size(F.array_distinct(w["seps"])), longest=F.array_max(lengths), shortest=F.array_min(lengths), last=F.length(last["m"]),
                left=_side(F.right(left, F.lit(1))), right=_side(F.left(right, F.lit(1))), prev=near(at_first, first["before"]), next=near(at_last, right),
                cue=(at_first & F.lower(run["before"]).rlike(_CUES[kind])).cast("int"), **more,
            )

        every = lambda f: F.forall(w["seps"], f)
        ip = (size == 4) & every(lambda x: x == ".") & (F.array_max(lengths) <= 3)
        card = n.between(13, 19) & every(lambda x: x.isin(" ", "-", "."))
        phone = n.between(7, 15) & ((size > 1) | (lead > 0)) & every(lambda x: F.length(x) <= 3)
        none, luhn = F.lit(0), F.when(card, _luhn(w["d"])).otherwise(False)
        dotted = F.array_join(F.transform(w["p"], lambda g: g["m"]), ".")
        found = [
            F.when(ip, with_(1, none, valid=_ip_ok(dotted).cast("int"))), F.when(card, with_(2, none, luhn=luhn.cast("int"), valid=(luhn & n.between(16, 19)).cast("int"))),
            F.when(phone, with_(3, lead, plus=first["before"].rlike(r"\+\(?$").cast("int"), paren=(first["before"].endswith("(") | F.exists(w["seps"], lambda x: x.contains(")"))).cast("int"), valid=((lead > 0) & n.between(8, 15)).cast("int"))),
        ]
        return F.filter(F.array(*found), lambda c: c.isNotNull())

    def all_of(groups: Column) -> Column:
        ends = lambda i: F.sequence(i, F.least(i + MOST_GROUPS - 1, F.size(groups) - 1))
        return F.flatten(F.transform(groups, lambda _, i: F.flatten(F.transform(ends(i), lambda j: proposals(groups, i, j)))))

    return _let(matches(run["m"], "[0-9]++"), all_of)


def _written(text: Column) -> Column:
    """Candidates for addresses written out."""

    def one(x: Column) -> Column:
        m = x["m"]
        style = F.when(m.rlike(r"(?i)[(\[{]\x20?at"), 1).when(m.contains(" @ "), 2).otherwise(3)
        spelt = m.rlike(r"(?i)(?:[(\[{]\x20?dot|\x20dot\x20)")
        tail = F.regexp_extract(m, f"({_LABEL}+)$", 1)
        return _candidate(
            0, x["s"], x["s"] + F.length(m), at=style, dot=spelt.cast("int"), tail=F.length(tail), known=tail.rlike(_ENDINGS).cast("int"), cue=F.lower(x["before"]).rlike(_CUES[0]).cast("int"),
            left=_side(F.right(x["before"], F.lit(1))), right=_side(F.left(x["after"], F.lit(1))), groups=F.size(F.split(m, "(?i)" + _DOT)), valid=((style < 3) | spelt).cast("int"),
        )

    return F.transform(matches(text, _WRITTEN), one)


def proposed(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``t``, never null) with ``base`` (spans with their surroundings) and ``cand``
    (overlapping candidates with features)."""
    t = F.col("t")
    none = lambda kind: F.array().cast(kind)
    out = rows.withColumn("mails", F.when(F.contains(t, F.lit("@")), matches(t, _EMAIL)).otherwise(none(_HIT)))
    runs = F.filter(matches(t, _RUN), lambda r: F.length(F.regexp_replace(r["m"], "[^0-9]+", "")) >= 4)
    out = out.withColumn("runs", F.when(t.rlike("[0-9]"), runs).otherwise(none(_HIT)))
    spelt = F.when(t.rlike(r"(?i)[(\[{\x20](?:at|@)\x20?[)\]}\x20]"), _written(t)).otherwise(none(_CANDIDATE))
    out = out.withColumn("base", _base(F.col("mails"), F.col("runs")))
    return out.withColumn("cand", F.concat(spelt, F.flatten(F.transform("runs", _windows)))).drop("mails", "runs")


def _tree(node, value: Callable[[str], Column]) -> Column:
    """A fitted tree as a nested condition."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(value(FEATURES[split.featureIndex()]) <= float(split.threshold()), _tree(node.leftChild(), value)).otherwise(_tree(node.rightChild(), value))


class Judge:
    """Boosted trees and a threshold for each kind."""

    def __init__(self, model: GBTClassificationModel | None, thresholds: list[float]):
        self.thresholds = thresholds
        self._trees = [] if model is None else list(zip((t._java_obj.rootNode() for t in model.trees), model.treeWeights, strict=True))

    def score(self, value: Callable[[str], Column]) -> Column:
        return reduce(lambda a, b: a + b, [_tree(root, value) * F.lit(float(w)) for root, w in self._trees], F.lit(0.0))

    def accepted(self, cand: Column) -> Column:
        """(kind, s, e, p) of the candidates that pass their kind's threshold."""
        if not self._trees or min(self.thresholds) == float("inf"):
            return F.array().cast("array<struct<kind:int,s:int,e:int,p:double>>")
        edge = F.array(*[F.lit(x) for x in self.thresholds])
        scored = F.transform(cand, lambda c: F.struct(c["kind"], c["s"], c["e"], self.score(lambda f: c[f"{f}_"]).alias("p")))
        return F.filter(scored, lambda c: c["p"] >= F.get(edge, c["kind"]))


def _variants() -> Column:
    """(new text, right spans' kinds and places) for a base span (kind, m): rewritten, doubled and
    spoilt forms.  ``ok`` false: nothing in it is personal data."""
    m, kind, d = F.col("m"), F.col("kind"), _digits(F.col("m"))
    four = lambda sep: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substring(d, i * 4 + 1, F.when(i < 3, 4).otherwise(9))), sep)
    tail = F.right(d, F.lit(10))
    local = lambda sep: F.concat(F.left(tail, F.lit(3)), F.lit(sep), F.substring(tail, 4, 3), F.lit(sep), F.right(tail, F.lit(4)))
    spelt = lambda at, dot: F.concat(F.substring_index(m, "@", 1), F.lit(at), F.replace(F.substring_index(m, "@", -1), F.lit("."), F.lit(dot)))
    wrong = F.concat(F.left(d, F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    one = lambda x, ok=True: F.struct(x.alias("v"), F.lit(ok).alias("ok"), F.length(x).alias("first"))
    two = F.struct(F.concat(m, F.lit(" "), m).alias("v"), F.lit(True).alias("ok"), F.length(m).alias("first"))
    forms = {
        0: [one(m), one(spelt(" [at] ", ".")), one(spelt("(at)", "(dot)")), one(spelt(" at ", " dot ")), one(spelt(" at ", "."), False)],
        1: [one(m), two, one(F.concat(m, F.lit(".1")), False), one(F.concat(F.lit("3"), F.lpad(m, 15, "7")), False)],
        2: [one(m), two, one(four(" ")), one(four(".")), one(wrong, False)],
        3: [one(m), two, one(F.concat(F.lit("("), F.left(tail, F.lit(3)), F.lit(") "), F.substring(tail, 4, 3), F.lit("-"), F.right(tail, F.lit(4)))), one(local("-")), one(local(".")), one(F.concat(F.left(tail, F.lit(4)), F.lit("-"), F.substring(tail, 5, 2), F.lit("-"), F.right(tail, F.lit(4))), False)],
    }
    return reduce(lambda a, k: F.when(kind == k, F.array(*forms[k])).otherwise(a), forms, F.array().cast("array<struct<v:string,ok:boolean,first:int>>"))


def labelled(docs: DataFrame) -> DataFrame:
    """(o, kind_, ... features, label, aside) of the weak labels of all (t, d), d a hash."""
    found = kept(proposed(docs).select("d", "base", "cand"), "pii-proposed")
    chosen = found.select("d", F.explode("base").alias("b")).select("d", "b.*").withColumn("o", F.xxhash64("d", "s", "m"))
    forms = chosen.select("o", "kind", "before", "after", F.explode(_variants()).alias("f"))
    start = F.length("before")
    place = lambda s, e: F.struct(F.col("kind"), s.alias("s"), e.alias("e"))
    right = F.when(F.col("f.ok"), F.array(place(start, start + F.col("f.first")), place(start + F.length("f.v") - F.col("f.first"), start + F.length("f.v")))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    made = forms.select("o", right.alias("right"), F.col("f.ok").alias("ok"), start.alias("from"), (start + F.length("f.v")).alias("to"), F.concat("before", "f.v", "after").alias("t"))
    each = proposed(made).select("o", "right", "ok", "from", "to", "base", F.explode("cand").alias("c"))
    hit = F.exists("right", lambda r: (r["kind"] == F.col("c.kind")) & (r["s"] == F.col("c.s")) & (r["e"] == F.col("c.e")))
    inside = (F.col("c.s") < F.col("to")) & (F.col("c.e") > F.col("from"))
    own = each.where(inside).select("o", "c.*", hit.cast("double").alias("label"))
    clear = lambda: ~F.exists("base", lambda b: (b["s"] < F.col("c.e")) & (b["e"] > F.col("c.s")))
    others = found.select("d", "base", F.explode("cand").alias("c")).where((F.col("c.valid_") == 0) & clear())
    others = others.select(F.xxhash64("d", "c.s", "c.e", "c.kind").alias("o"), "c.*").withColumn("label", F.lit(0.0))
    both = own.unionByName(others)
    return both.select("o", *(f"{f}_" for f in FEATURES), "label", (F.pmod(F.xxhash64(F.lit(5), "o"), F.lit(4)) == 0).alias("aside"))


def fitted(sample: DataFrame) -> Judge:
    """Trees fitted to the rows that are not aside, thresholds to those that are: the lowest score
    from which on ``PRECISION`` of a kind's candidates are right; none if a kind has too few."""
    never = [float("inf")] * len(KINDS)
    names = [f"{f}_" for f in FEATURES]
    alike = sample.groupBy(*names, "label", "aside").agg(F.count("*").cast("double").alias("weight"))
    rows = kept(VectorAssembler(inputCols=names, outputCol="features").transform(alike), "pii-rows")
    if {r[0] for r in rows.where("NOT aside").select("label").distinct().collect()} != {0.0, 1.0}:
        return Judge(None, never)
    # in one order, and in one partition as long as there are few kinds: the same trees on every run
    train = rows.where("NOT aside")
    train = train.repartition(1 + train.count() // KINDS_EACH, *names).sortWithinPartitions(*names, "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, cacheNodeIds=False, checkpointInterval=-1, weightCol="weight").fit(train.select("features", "label", "weight"))
    judge = Judge(model, never)
    score = F.least(F.lit(FARTHEST), F.greatest(F.lit(-FARTHEST), judge.score(lambda f: F.col(f"{f}_"))))
    bins = rows.where("aside").groupBy(F.col("kind_").cast("int").alias("kind"), F.floor(score / BIN).alias("bin")).agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).collect()
    edges = list(never)
    for k in range(len(KINDS)):
        good = n = 0
        for r in sorted((r for r in bins if r["kind"] == k), key=lambda r: -r["bin"]):
            good, n = good + r["good"], n + r["n"]
            if good >= PRECISION * n and good >= 5:
                edges[k] = r["bin"] * BIN
    return Judge(model, edges)


#: Candidates beside one, in the order of their starts, that can overlap it: a window has up to
#: MOST_GROUPS groups, a base span up to 19, and at most some 40 candidates start at one group.
_NEAR = 40 * 20


def _selected(accepted: Column, base: Column) -> Column:
    """The accepted candidates that no base span and no better candidate overlaps: higher scores first,
    then longer, then earlier ones, then by kind."""
    fixed = F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["kind"].alias("kind"), F.lit(float("inf")).alias("p")))
    mine = F.transform(accepted, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), c["p"].alias("p")))

    def best(all_: Column) -> Column:
        rank = lambda x: F.struct(x["p"], x["e"] - x["s"], -x["s"], -x["kind"])
        beats = lambda x, y: (y["s"] < x["e"]) & (y["e"] > x["s"]) & (rank(y) > rank(x))
        alone = lambda x, i: (x["p"] != float("inf")) & ~F.exists(F.slice(all_, F.greatest(i + 1 - _NEAR, F.lit(1)), F.lit(2 * _NEAR)), lambda y: beats(x, y))
        return F.transform(F.filter(all_, alone), lambda x: F.struct(x["kind"], x["s"], x["e"]))

    return F.when(F.size(accepted) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(_let(F.array_sort(F.concat(fixed, mine)), best))


def found(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, s, e) by kind in the order of ``KINDS``,
    then start, in code points, the end exclusive.  Without a ``judge`` one is fitted on ``docs``.

    A null text counts as empty; rows that repeat are judged alike, whatever their order; a table
    without base spans gives no others; an empty one gives no rows.  Columns of the names made here
    are replaced."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if judge is None:
        judge = fitted(labelled(docs.select(text.alias("t"), F.xxhash64("doc_id", text).alias("d"))))
    rows = proposed(docs.select(F.struct("*").alias("__row"), text.alias("t")))
    rows = rows.select("__row", "base", judge.accepted(F.col("cand")).alias("accepted"))
    rows = rows.withColumn("more", _selected(F.col("accepted"), F.col("base")))
    plain = F.array_sort(F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e"))))
    own = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in ("base", "spans")]
    return rows.select(*own, plain.alias("base"), F.array_sort(F.concat(plain, "more")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``docs`` with ``redacted``: the text with each span replaced by its kind in brackets; where
    spans overlap, the one that starts first (then the longest) speaks for what they cover."""
    rows = found(docs, judge)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.when(x["s"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["kind"]))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.withColumn("redacted", F.when(F.col("text").isNotNull(), done))


def personal(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """``found`` with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans as a string;
    the text stays behind."""
    rows = found(docs, judge)
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    made = {"base", "spans", "text", "base_sha256", *(f"n_{k}" for k in KINDS)}
    return rows.select(*(c for c in rows.columns if c not in made), *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
