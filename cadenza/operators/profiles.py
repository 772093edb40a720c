"""Prosody profiles: loading, rules and the most specific mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pattern keys and what each may be.
PATTERN_VALUES = {
    "pitch": ["high", "low", "normal"],
    "pitch_contour": ["rise", "fall", "rise-fall", "fall-rise", "fall-sharp", "rise-sharp", "flat"],
    "volume": ["loud", "quiet", "normal", "spike"],
    "rate": ["fast", "slow", "normal"],
    "quality": ["modal", "breathy", "tense", "creaky", "whispery", "harsh"],
    "pause_frequency": ["high", "low", "normal"],
    "emphasis_frequency": ["high", "low", "normal"],
}

PROFILE = T.StructType(
    [
        T.StructField("profile_version", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField(
            "prosody_mappings",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("pattern", T.MapType(T.StringType(), T.StringType())),
                        T.StructField("interpretation", T.StructType([T.StructField("emotion", T.StringType()), T.StructField("confidence_boost", T.DoubleType())])),
                    ]
                )
            ),
        ),
    ]
)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile files, one JSON object each; a file of another shape fails the read."""
    return spark.read.schema(PROFILE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parse_profiles(rows: DataFrame, column: str) -> DataFrame:
    """Profiles from JSON text in ``column``; text of another shape fails the job."""
    return rows.select(F.from_json(column, PROFILE, {"mode": "FAILFAST"}).alias("p")).select("p.*")


def mappings(profiles: DataFrame) -> DataFrame:
    """(profile_version, user_id, mapping_idx, pattern, emotion, boost), a missing boost as 0."""
    one = profiles.select("profile_version", "user_id", F.posexplode_outer("prosody_mappings").alias("mapping_idx", "m"))
    return one.select(
        "profile_version", "user_id", "mapping_idx", F.col("m.pattern").alias("pattern"), F.col("m.interpretation.emotion").alias("emotion"),
        F.coalesce("m.interpretation.confidence_boost", F.lit(0.0)).alias("boost"),
    )


def profile_issues(profiles: DataFrame) -> DataFrame:
    """(user_id, mapping_idx, severity, rule, message) of profiles that break a rule."""
    version = ~F.coalesce(F.col("profile_version"), F.lit("")).rlike(r"^\d+\.\d+\.\d+(-[a-zA-Z0-9.]+)?$")
    issue = lambda rule, severity, message, bad: F.when(bad, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message")))
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    whole = F.array_compact(
        F.array(
            issue("P1", "error", text("not a version of three numbers: ", F.coalesce("profile_version", F.lit("nothing"))), version),
            issue("P2", "error", F.lit("the profile names no user"), F.coalesce("user_id", F.lit("")) == ""),
            issue("P3", "error", F.lit("the profile maps nothing"), F.coalesce(F.size("prosody_mappings"), F.lit(0)) <= 0),
        )
    )
    top = profiles.select("user_id", F.lit(-1).alias("mapping_idx"), F.explode(whole).alias("i"))
    m = mappings(profiles).where("mapping_idx IS NOT NULL").withColumn("at", F.concat(F.lit("prosody_mappings["), F.col("mapping_idx").cast("string"), F.lit("]")))
    domain = F.create_map(*[x for k, v in PATTERN_VALUES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = m.select("user_id", "mapping_idx", "at", F.explode("pattern").alias("key", "value")).withColumn("domain", F.try_element_at(domain, F.col("key")))
    keyed = F.coalesce(
        issue("P5", "warning", text(F.col("at"), ": no such pattern key: ", F.col("key")), F.col("domain").isNull()),
        issue("P6", "warning", text(F.col("at"), ": ", F.col("key"), " is never ", F.col("value")), ~F.array_contains("domain", F.col("value"))),
    )
    mapped = F.array_compact(
        F.array(
            issue("P4", "error", text(F.col("at"), ": the pattern asks for nothing"), F.coalesce(F.size("pattern"), F.lit(0)) <= 0),
            issue("P7", "error", text(F.col("at"), ": no emotion is given"), F.coalesce("emotion", F.lit("")) == ""),
            issue("P8", "error", text(F.col("at"), ": a boost outside 0 to 1: ", F.col("boost").cast("string")), (F.col("boost") < 0) | (F.col("boost") > 1)),
        )
    )
    rows = top.unionByName(m.select("user_id", "mapping_idx", F.explode(mapped).alias("i"))).unionByName(each.select("user_id", "mapping_idx", keyed.alias("i")).where("i IS NOT NULL"))
    return rows.select("user_id", "mapping_idx", "i.*")


def applied(observed: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """``observed`` (keys, labels MAP, base_emotion, base_confidence) with emotion and confidence of
    the most specific mapping whose whole pattern the labels match, the first of equals; its boost
    is added to the confidence, 1 at most.  Rows without a match keep their base.

    ``profile`` (mapping_idx, pattern, emotion, boost) is one user's mappings: its size does not
    follow the data and is bounded by the profile format, so it enters as one array."""
    listed = profile.where(F.size("pattern") > 0).groupBy().agg(
        F.sort_array(F.collect_list(F.struct((-F.size("pattern")).alias("rank"), "mapping_idx", F.map_entries("pattern").alias("entries"), "emotion", "boost"))).alias("ms")
    )
    fits = F.filter("ms", lambda m: F.forall(m["entries"], lambda e: F.try_element_at(F.col("labels"), e["key"]).eqNullSafe(e["value"])))
    out = observed.withColumn("ms", listed.select("ms").scalar()).withColumn("hit", F.get(fits, F.lit(0)))
    return out.select(
        *keys,
        F.coalesce("hit.emotion", "base_emotion").alias("emotion"),
        F.when(F.col("hit").isNull(), F.col("base_confidence")).otherwise(F.least(F.lit(1.0), F.col("base_confidence") + F.col("hit.boost"))).alias("confidence"),
        F.col("hit.mapping_idx").alias("mapping_idx"),
    )


def ranked(observed: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """The same by equality joins, for profile tables of any size: patterns exploded, matches
    counted, and the best mapping of each row ranked first."""
    pairs = profile.select("mapping_idx", "emotion", "boost", F.size("pattern").alias("n"), F.explode("pattern").alias("key", "value"))
    seen = observed.select(*keys, F.explode("labels").alias("key", "value"))
    hits = seen.join(pairs, ["key", "value"]).groupBy(*keys, "mapping_idx", "emotion", "boost", "n").agg(F.count("*").alias("c")).where("c = n")
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "mapping_idx"))).where("r = 1")
    best = best.select(*keys, F.col("emotion").alias("e"), "boost", "mapping_idx")
    out = observed.join(best, keys, "left")
    confidence = F.when(F.col("e").isNull(), F.col("base_confidence")).otherwise(F.least(F.lit(1.0), F.col("base_confidence") + F.col("boost")))
    return out.select(*keys, F.coalesce("e", "base_emotion").alias("emotion"), confidence.alias("confidence"), "mapping_idx")


#: Mappings of a user that a row is tested against one by one; those of users with more are looked up.
MOST_MAPPINGS = 32


def applied_by_user(observed: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """``applied`` with each row's own user: ``observed`` has user_id, ``profiles`` (user_id,
    mapping_idx, pattern, emotion, boost) any number of users and mappings.  ``keys`` tell rows apart.

    A user's mappings, up to ``MOST_MAPPINGS``, reach each of its rows as one array by one join.  Rows of
    users with more go by ``looked_up_by_user``.  Rows without a user, or whose user has no profile, keep
    their base; an empty pattern matches nothing; of equal mappings the first counts."""
    usable = profiles.where(F.size("pattern") > 0)
    many = usable.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_MAPPINGS).where("user_id IS NOT NULL").select("user_id")
    some_have_many = not many.isEmpty()
    few = usable.join(many, "user_id", "left_anti") if some_have_many else usable
    each = F.struct((-F.size("pattern")).alias("rank"), "mapping_idx", "emotion", "boost", F.map_entries("pattern").alias("entries"))
    listed = few.groupBy("user_id").agg(F.sort_array(F.collect_list(each)).alias("ms"))
    rows = observed.join(many, "user_id", "left_anti") if some_have_many else observed
    fits = F.filter("ms", lambda m: F.forall(m["entries"], lambda e: F.coalesce(F.try_element_at(F.col("labels"), e["key"]) == e["value"], F.lit(False))))
    out = rows.join(listed, "user_id", "left").withColumn("m", F.get(fits, F.lit(0)))
    out = out.select(
        "user_id", *keys, F.coalesce("m.emotion", "base_emotion").alias("emotion"),
        F.when(F.col("m").isNull(), F.col("base_confidence")).otherwise(F.least(F.lit(1.0), F.col("base_confidence") + F.col("m.boost"))).alias("confidence"), F.col("m.mapping_idx").alias("mapping_idx"),
    )
    if not some_have_many:
        return out
    return out.unionByName(looked_up_by_user(observed.join(many, "user_id", "left_semi"), usable.join(many, "user_id", "left_semi"), keys))


def looked_up_by_user(observed: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """``applied`` with each row's own user: ``observed`` has user_id, ``profiles`` (user_id,
    mapping_idx, pattern, emotion, boost) any number of users and mappings.

    A pattern is contained in a row's labels only if its rarest label is, so each mapping is looked up
    by that one (counted over ``observed`` by user), and the rest of its pattern is tested on the rows
    found.  A label that all rows have is looked up only for patterns that have no other.  Rows
    without a user, or whose user has no profile, keep their base; an empty pattern matches nothing;
    of equal mappings the first counts.  Rows with equal ``keys`` are taken as one."""
    labels = observed.select("user_id", F.explode("labels").alias("key", "value")).groupBy("user_id", "key", "value").agg(F.count("*").alias("n"))
    each = profiles.select("user_id", "mapping_idx", "pattern", "emotion", "boost", F.explode("pattern").alias("key", "value"))
    # a label that never occurs cannot match: the inner join drops it, and with it the mapping
    counted = each.join(labels, ["user_id", "key", "value"])
    whole = counted.groupBy("user_id", "mapping_idx").agg(
        F.count("*").alias("found"), F.min(F.struct("n", "key", "value")).alias("rarest"), F.first("pattern").alias("pattern"), F.first("emotion").alias("emotion"), F.first("boost").alias("boost")
    )
    usable = whole.where(F.col("found") == F.size("pattern")).select("user_id", "mapping_idx", F.map_entries("pattern").alias("entries"), "emotion", "boost", "rarest.key", "rarest.value")
    seen = observed.select("user_id", *keys, "labels", F.explode("labels").alias("key", "value"))
    near = seen.join(usable, ["user_id", "key", "value"])
    hit = near.where(F.forall("entries", lambda e: F.try_element_at(F.col("labels"), e["key"]).eqNullSafe(e["value"])))
    best = hit.groupBy("user_id", *keys).agg(F.min(F.struct((-F.size("entries")).alias("rank"), "mapping_idx", "emotion", "boost")).alias("m"))
    out = observed.join(best, ["user_id", *keys], "left")
    return out.select(
        "user_id", *keys, F.coalesce("m.emotion", "base_emotion").alias("emotion"),
        F.when(F.col("m").isNull(), F.col("base_confidence")).otherwise(F.least(F.lit(1.0), F.col("base_confidence") + F.col("m.boost"))).alias("confidence"), F.col("m.mapping_idx").alias("mapping_idx"),
    )
