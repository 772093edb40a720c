"""Quality rules: per-text counts, and cross-document line frequency.

All in DataFrame functions.  Base rules look at one text.  The method looks across documents: lines
are normalised and hashed, and a line that more distinct texts of a host hold than the host's limit
allows is boilerplate there.  It is removed from all documents but the one with the smallest
doc_id (``cleaned``), and a document left with too small a share of its words is rejected.

Counting takes two steps, so that only frequent lines are counted by distinct text: lines are first
counted by host with partial sums (a line of a third of the corpus costs one row per task), and
the few above the limit are then joined back to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound_broadcast, kept

#: A line is frequent in a host if more than this many distinct texts hold it, and more than this
#: per cent of the host's documents.
LEAST_TEXTS, MOST_PER_CENT = 5, 1
#: A document must keep two of three words.
KEEP_OF = (2, 3)
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: Rows of frequent lines, or of documents that lose some, that are broadcast (some 50 bytes a row).
BROADCAST_ROWS = 50_000

_WS = "[ \\t\\n\\x0B\\f\\r]+"


def _words(text: Column) -> Column:
    core = F.btrim(text, F.lit(SPACE))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, _WS))


def base_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null texts count as empty.  Columns of those names in ``docs`` are replaced."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(F.struct("*").alias("__row"), text.alias("__t"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    step = row.select("*", _words(F.col("__t")).alias("__w"), lines.alias("__l"))
    # a hash for each window; Spark's hash of several columns chains them
    hashes = F.when(
        F.size("__w") >= WINDOW,
        F.expr(f"transform(sequence(0, size(__w) - {WINDOW}), i -> xxhash64({', '.join(f'get(__w, i + {k})' for k in range(WINDOW))}))"),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        "__row",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        hashes.alias("__h"),
    )
    # only texts with a repeated window sort their windows
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    step = step.withColumn("__s", F.when(repeats, F.expr("sort_array(transform(__h, (x, i) -> struct(x AS x, i AS i)))"))).drop("__h")
    starts = "array_sort(transform(filter(__s, (e, k) -> get(__s, k - 1).x <=> e.x OR get(__s, k + 1).x <=> e.x), e -> e.i))"
    step = step.withColumn("__p", F.expr(starts)).drop("__s")
    covered = f"aggregate(transform(__p, (p, k) -> if(k = 0, {WINDOW}, least({WINDOW}, p - get(__p, k - 1)))), 0, (a, b) -> a + b)"
    step = step.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("__p")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    own = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in made]
    return step.withColumn("base_failed", failed).select(*own, *made)


def _lines(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, digest (of the text), pos, line (hash) and words of each line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("digest"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    key = F.lower(F.btrim("raw", F.lit(SPACE)))
    return part.withColumn("key", key).where("key <> ''").select("doc_id", "host", "digest", "pos", F.xxhash64("key").alias("line"), F.size(F.split("key", _WS)).alias("words"))


def _boilerplate(docs: DataFrame, host: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences of often seen lines, and the lines (of, found) that are boilerplate in their host,
    with the document that keeps them."""
    sizes = docs.groupBy(F.col(host).cast("string").alias("of")).agg(F.count("*").alias("n_docs"))
    above = lambda n: (F.col(n) > LEAST_TEXTS) & (100 * F.col(n) > MOST_PER_CENT * F.col("n_docs"))
    counted = _lines(docs, host).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_TEXTS)
    often = counted.join(sizes, F.col("host").eqNullSafe(F.col("of"))).where(above("n")).select(F.col("host").alias("of"), F.col("line").alias("found"), "n_docs")
    often = kept(often, "lines-often")
    held = _lines(docs, host).join(bound_broadcast(often, BROADCAST_ROWS), F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("found")))
    held = kept(held.select("doc_id", "host", "digest", "pos", "line", "words", "n_docs"), "lines-held")
    texts = held.groupBy("host", "line", "n_docs", "digest").agg(F.min("doc_id").alias("least"))
    over = texts.groupBy("host", "line", "n_docs").agg(F.count("*").alias("n"), F.min("least").alias("keeper")).where(above("n"))
    return held, kept(over.select(F.col("host").alias("of"), F.col("line").alias("found"), "keeper"), "lines-over")


def frequent_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, digest, pos and words of every occurrence of a line that is boilerplate in its host,
    outside the document that keeps it."""
    return _gone(*_boilerplate(docs, host))


def _gone(held: DataFrame, over: DataFrame) -> DataFrame:
    gone = held.join(over, F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("found")) & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.select("doc_id", "digest", "pos", "words").distinct()


def _by_host(based: DataFrame, over: DataFrame, host: str) -> DataFrame:
    """``based`` with __lost and cleaned, by the few lines of each host, which are broadcast: no text
    is shuffled."""
    lines = over.groupBy("of").agg(F.collect_list(F.struct("found", "keeper")).alias("__lines"))
    both = based.join(F.broadcast(lines), F.col(host).cast("string").eqNullSafe(F.col("of")), "left")
    raw = F.split(F.col("text").cast("string"), "\n")
    key = lambda x: F.lower(F.btrim(x, F.lit(SPACE)))
    others = F.transform(F.filter("__lines", lambda x: ~x["keeper"].eqNullSafe(F.col("doc_id").cast("long"))), lambda x: x["found"])
    hashes = F.when(F.size("__lines") > 0, F.transform(raw, lambda x: F.when(key(x) != "", F.xxhash64(key(x)))))
    step = both.withColumn("__h", hashes).withColumn("__gone", F.array_intersect("__h", others))
    goes = lambda i: F.coalesce(F.array_contains("__gone", F.get("__h", i)), F.lit(False))
    words = F.filter(F.transform(raw, lambda x, i: F.when(goes(i), F.size(F.split(key(x), _WS)))), lambda n: n.isNotNull())
    cut = F.size("__gone") > 0
    step = step.withColumn("__lost", F.when(cut, F.aggregate(words, F.lit(0), lambda a, b: a + b)))
    left = F.array_join(F.filter(raw, lambda _, i: ~goes(i)), "\n")
    return step.withColumn("cleaned", F.when(cut, left).otherwise(F.col("text").cast("string"))).drop("of", "__lines", "__h", "__gone")


def judged(docs: DataFrame, host: str = "source", texts: bool = True) -> DataFrame:
    """``docs`` with the columns of ``base_rules``, n_left_words (words outside removed lines), kept
    and cleaned (the text without removed lines); without ``texts``, both ``text`` and ``cleaned``
    stay behind.

    The base counts are written out first: they are costly, and no filter on the result can make
    the optimizer work them out anew.  A null host is a host of its own.  Rows with equal doc_id and
    text are judged alike; several null doc_ids count as one document.  A null text stays null.  An
    empty table gives no rows; columns of the names made here are replaced."""
    held, over = _boilerplate(docs, host)
    digest = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    based = base_rules(docs.drop("cleaned", "kept", "n_left_words")).withColumn("__digest", digest)
    based = kept(based if texts else based.drop("text"), "quality-counts")
    id_ = F.col("doc_id").cast("long")
    named = F.struct(F.col(host).cast("string").alias("h"))
    # rows of one id and text in several hosts lose what is boilerplate in any of them
    spread = based.groupBy(id_.alias("i"), "__digest").agg(F.min(named).alias("a"), F.max(named).alias("z")).where(~F.col("a").eqNullSafe(F.col("z")))
    if texts and over.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and not spread.limit(1).count():
        both = _by_host(based, over, host)
    else:
        gone = _gone(held, over).groupBy("doc_id", "digest")
        lost = gone.agg(F.sum("words").alias("__lost"), F.collect_set("pos").alias("__pos") if texts else F.lit(None).alias("__pos"))
        lost = kept(lost.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of"), "__lost", "__pos"), "lines-lost")
        both = based.join(bound_broadcast(lost.drop("__pos"), BROADCAST_ROWS) if not texts else lost, id_.eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")), "left")
        if texts:
            lines = F.filter(F.split(F.col("text").cast("string"), "\n"), lambda _, i: ~F.array_contains("__pos", i))
            both = both.withColumn("cleaned", F.when(F.col("__pos").isNull(), F.col("text").cast("string")).otherwise(F.array_join(lines, "\n")))
        both = both.drop("__id", "__of", "__pos")
    left = F.col("n_words") - F.coalesce("__lost", F.lit(0))
    few, of = KEEP_OF
    out = both.withColumn("n_left_words", left).withColumn("kept", ~F.col("base_failed") & (of * F.col("n_left_words") >= few * F.col("n_words")))
    return out.drop("__lost", "__digest")
