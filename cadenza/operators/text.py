"""Plain text to markup: sentences, quotes, emphasis, pauses and lexical emotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import escape
from ..sources.shred import dealt

#: Lexicons of cue words.
POSITIVE = """love happy wonderful fantastic amazing great excellent beautiful brilliant awesome delightful pleased glad
thankful grateful excited thrilled cheerful joyful superb terrific magnificent""".split()
NEGATIVE = """hate angry terrible horrible awful disgusting miserable furious annoyed frustrated disappointed upset sad
depressed worried anxious dreadful pathetic ridiculous stupid worse worst""".split()
UNCERTAIN = """maybe perhaps possibly probably might could unsure uncertain wonder suppose guess somehow apparently
seemingly""".split()
#: What is stripped from words, and the version that predicted documents carry.
PUNCTUATION = ".,!?;:\"'()“”‘’…"
FEATURE_PUNCTUATION = ".,!?;:\"'()-"
VERSION = "0.1.0"
QUOTED = '"[^"]+"|“[^”]+”'
ELLIPSIS = r"\.{3,}|…"


def stripped(word: Column, characters: str = PUNCTUATION) -> Column:
    return F.btrim(word, F.lit(characters))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentences(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` without ``column``, with sent_idx and sentence: text cut after final punctuation
    followed by white space; blank texts give no row."""
    parts = F.filter(F.transform(F.split(F.btrim(F.col(column)), r"(?<=[.!?])\s+"), lambda s: F.btrim(s)), lambda s: s != "")
    keep = [c for c in docs.columns if c != column]
    return docs.select(*keep, F.posexplode(parts).alias("sent_idx", "sentence"))


def quotes(sentence: Column) -> tuple[Column, Column]:
    """The quoted spans of a sentence, without their marks, and what remains of it."""
    spans = F.transform(F.regexp_extract_all(sentence, F.lit(QUOTED), F.lit(0)), lambda q: q.substr(F.lit(2), F.length(q) - 2))
    rest = F.regexp_replace(F.btrim(F.regexp_replace(sentence, QUOTED, "")), r"\s{2,}", " ")
    return spans, rest


def _spaced(text: Column) -> Column:
    """The words of a text with single blanks between."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def _token(words: str, punctuation: str) -> str:
    """Pattern of a whole token that is one of ``words`` in ``punctuation``, where single blanks part
    tokens."""
    return f"(?<![^ ]){punctuation}(?:{words}){punctuation}(?![^ ])"


_PUNCTUATED = "[" + PUNCTUATION + "]*"


def with_cues(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with cues, the numbers of positive, negative and uncertain words in ``column``.  Each
    lexicon is one pattern over the lower-cased text."""
    lowered = _spaced(F.lower(F.col(column)))
    count = lambda lexicon: F.regexp_count(lowered, F.lit(_token("|".join(lexicon), _PUNCTUATED)))
    return rows.withColumn("cues", F.struct(count(POSITIVE).alias("pos"), count(NEGATIVE).alias("neg"), count(UNCERTAIN).alias("unc")))


def emotion_of(sentence: Column, cues: Column) -> tuple[Column, Column]:
    """Emotion and rule confidence from final punctuation and cue words (null without cues)."""
    pos, neg, unc = cues["pos"], cues["neg"], cues["unc"]
    loud = F.rtrim(sentence).endswith("!")
    frustrated, joyful = (neg > pos) & (neg > unc), (pos > neg) & (pos > unc)
    uncertain = (unc > 0) & (unc >= pos) & (unc >= neg)
    emotion = F.when(loud, F.when(neg > pos, "frustrated").otherwise("joyful")).when(frustrated, "frustrated").when(joyful, "joyful").when(uncertain, "uncertain")
    sure = F.when(loud, 0.55).when(frustrated | joyful, 0.45).when(uncertain, 0.40)
    return emotion, sure


def is_question(sentence: Column) -> Column:
    s = F.rtrim(sentence)
    return s.endswith("?") | (s.rlike(ELLIPSIS) & s.contains("?"))


#: ALL CAPS in escaped text, where a double quote is an entity.
_CAPITALS = "(?<![^ ])((?:[" + PUNCTUATION.replace('"', "") + "]|&quot;)*[A-Z]{2,}(?:[" + PUNCTUATION.replace('"', "") + "]|&quot;)*)(?![^ ])"


def words_markup(text: Column) -> Column:
    """A text's words, parted by single blanks, those in ALL CAPS emphasised."""
    plain = escape(_spaced(text))
    return F.when(text.rlike("[A-Z]{2}"), F.regexp_replace(plain, _CAPITALS, '<emphasis level="strong">$1</emphasis>')).otherwise(plain)


def inner_markup(sentence: Column) -> Column:
    """A sentence's words joined by blanks, with a pause where an ellipsis stood; an ellipsis before
    any word leaves no pause."""
    parts = F.transform(F.split(sentence, ELLIPSIS), lambda p: F.btrim(p))
    n = F.size(parts)
    broken = sentence.rlike(ELLIPSIS)

    def piece(p: Column, k: Column) -> Column:
        said = F.exists(F.slice(parts, F.lit(1), k), lambda q: q != "")
        body = F.when(p == "", "").otherwise(F.concat(F.when(said, " ").otherwise(""), words_markup(p)))
        pause = F.when((k < n - 1) & ((p != "") | said), '<pause duration="500"/>').otherwise("")
        return F.concat(body, pause)

    return F.when(broken, F.array_join(F.transform(parts, piece), "")).otherwise(words_markup(F.btrim(sentence)))


def utterance_markup(sentence: Column, inner: Column, cues: Column, default_confidence: float = 0.6) -> Column:
    """A sentence as an utterance: questions rise, exclamations are higher, cues give an emotion."""
    ask, loud = is_question(sentence), F.rtrim(sentence).endswith("!")
    body = (
        F.when(inner == "", "")
        .when(ask, F.concat(F.lit('<prosody pitch_contour="rise">'), inner, F.lit("</prosody>")))
        .when(loud, F.concat(F.lit('<prosody pitch="+5%">'), inner, F.lit("</prosody>")))
        .otherwise(inner)
    )
    emotion, sure = emotion_of(sentence, cues)
    shown = F.regexp_replace(F.format_string("%.2f", F.greatest(sure, F.lit(default_confidence))), "0$", "")
    head = F.coalesce(F.concat(F.lit('<utterance emotion="'), emotion, F.lit('" confidence="'), shown, F.lit('">')), F.lit("<utterance>"))
    return F.concat(head, body, F.lit("</utterance>"))


def spoken_parts(docs: DataFrame, column: str = "text") -> DataFrame:
    """Rows (keys, sent_idx, part_idx, spoken): what is left of each sentence without its quotes
    (part 0), then each quote."""
    cut = sentences(docs, column)
    spans, rest = quotes(F.col("sentence"))
    parts = F.concat(F.array(rest), spans)
    keys = [c for c in cut.columns if c != "sentence"]
    out = cut.select(*keys, F.posexplode(parts).alias("part_idx", "spoken"))
    return out.where((F.btrim("spoken") != "") | (F.col("part_idx") > 0))


def predicted(docs: DataFrame, key: str = "doc_id", column: str = "text", model: str = "rule-based", default_confidence: float = 0.6) -> DataFrame:
    """(key, markup) of every row; blank and null texts give one empty utterance."""
    if model != "rule-based":
        raise NotImplementedError(f"model {model!r} is not supported, only 'rule-based'")
    # dealt by key, by which a document's utterances meet: this exchange is the only one
    parts = with_cues(spoken_parts(dealt(docs.select(key, column), key), column), "spoken").withColumn("inner", inner_markup(F.col("spoken")))
    parts = parts.withColumn("u", utterance_markup(F.col("spoken"), F.col("inner"), F.col("cues"), default_confidence))
    bodies = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sent_idx", "part_idx", "u"))).alias("us"))
    body = F.array_join(F.transform("us", lambda x: x["u"]), "")
    out = docs.select(key).join(bodies, key, "left")
    return out.select(key, F.concat(F.lit(f'<iml version="{VERSION}">'), F.coalesce(body, F.lit("<utterance></utterance>")), F.lit("</iml>")).alias("markup"))


def word_features(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Seven features of every word: word_length, position_ratio, is_capitalized, has_punctuation,
    sentence_position, prev_word_length, next_word_length.  Neighbours come from the row's own array,
    so no shuffle is needed."""
    clean = F.transform(_words(F.col(column)), lambda w: F.struct(w.alias("raw"), stripped(w, FEATURE_PUNCTUATION).alias("clean")))
    rows = docs.select(key, clean.alias("ws")).select(key, "ws", F.posexplode("ws").alias("pos", "w"))
    length = lambda at: F.coalesce(F.length(F.get(F.col("ws"), at)["clean"]), F.lit(0)).cast("double")
    n = F.size("ws")
    first = F.substring("w.clean", 1, 1)
    return rows.select(
        key,
        F.col("pos").cast("long").alias("pos"),
        length(F.col("pos")).alias("word_length"),
        (F.col("pos").cast("double") / F.greatest(n - 1, F.lit(1))).alias("position_ratio"),
        ((F.upper(first) == first) & (F.lower(first) != first)).cast("double").alias("is_capitalized"),
        (F.col("w.raw") != F.col("w.clean")).cast("double").alias("has_punctuation"),
        F.col("pos").cast("double").alias("sentence_position"),
        F.when(F.col("pos") > 0, length(F.col("pos") - 1)).otherwise(0.0).alias("prev_word_length"),
        length(F.col("pos") + 1).alias("next_word_length"),
    )
