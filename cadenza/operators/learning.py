"""Feature tables and classifiers for emotion, text prosody and pitch contours."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from . import metrics

#: Training features of the three tasks, and the labels that an emotion stands for.
SER = ["f0_mean", "f0_range", "intensity_mean", "speech_rate", "jitter", "shimmer", "hnr"]
TEXT = ["word_length", "position_ratio", "is_capitalized", "has_punctuation", "sentence_position", "prev_word_length", "next_word_length"]
CONTOUR = [f"f0_{k}" for k in range(20)]
PROFILES = {
    "neutral": [180.0, 40.0, 65.0, 4.0, 0.008, 0.04, 18.0],
    "angry": [250.0, 80.0, 75.0, 5.5, 0.018, 0.09, 12.0],
    "frustrated": [210.0, 55.0, 70.0, 4.5, 0.013, 0.07, 14.0],
    "joyful": [230.0, 90.0, 70.0, 5.0, 0.007, 0.04, 20.0],
    "sad": [140.0, 25.0, 58.0, 3.0, 0.010, 0.06, 15.0],
    "fearful": [240.0, 70.0, 68.0, 5.2, 0.017, 0.09, 11.0],
    "sarcastic": [195.0, 100.0, 66.0, 3.8, 0.009, 0.05, 17.0],
    "calm": [170.0, 30.0, 60.0, 3.5, 0.006, 0.03, 22.0],
}
PROSODY_LABELS = {
    "angry": "high_loud_fast", "frustrated": "high_loud_normal", "joyful": "high_normal_fast", "sad": "low_quiet_slow",
    "fearful": "high_normal_fast", "sarcastic": "mid_normal_slow", "calm": "low_quiet_slow", "neutral": "mid_normal_normal",
}
CONTOUR_LABELS = {
    "angry": "rise", "frustrated": "rise-fall", "joyful": "rise", "sad": "fall", "fearful": "rise-fall", "sarcastic": "fall-rise",
    "calm": "flat", "neutral": "flat",
}
#: A contour's rise over its length, the height of its arch, and its noise, by emotion.
CONTOUR_SHAPES = {
    "angry": [50.0, 0.0, 5.0], "frustrated": [0.0, 40.0, 5.0], "joyful": [60.0, 0.0, 5.0], "sad": [-40.0, 0.0, 5.0], "fearful": [0.0, 50.0, 5.0],
    "sarcastic": [0.0, -30.0, 5.0], "calm": [0.0, 0.0, 3.0], "neutral": [0.0, 0.0, 3.0],
}
CONTOUR_BASE, CONTOUR_POINTS = 180.0, 30
#: Required keys of a training configuration.
CONFIG = {"task", "model", "data", "training", "evaluation", "output"}


def load_config(path: str) -> dict:
    """A YAML mapping with all of ``CONFIG``'s keys."""
    import yaml

    with open(path) as f:
        config = yaml.safe_load(f)
    if not isinstance(config, dict) or CONFIG - config.keys():
        raise ValueError(f"configuration lacks {sorted(CONFIG - set(config or ()))}")
    return config


def looked_up(emotion: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, emotion), F.lit(default))


def _noise(key: Column, k: int, scale: float) -> Column:
    """Reproducible noise of about unit spread from a hash: the same row always gets the same."""
    parts = [F.pmod(F.xxhash64(key, F.lit(k), F.lit(j)), F.lit(1_000_003)) / 1_000_003.0 for j in range(4)]
    return (sum(parts[1:], parts[0]) - 2.0) * (scale * 3.0**0.5)


def emotion_features(entries: DataFrame, key: str, emotion: str) -> DataFrame:
    """(key, label, SER features): the emotion's typical values with 5 % noise."""
    table = F.create_map(*[x for e, v in PROFILES.items() for x in (F.lit(e), F.array(*map(F.lit, v)))])
    base = F.coalesce(F.try_element_at(table, F.col(emotion)), F.array(*map(F.lit, PROFILES["neutral"])))
    return entries.select(key, F.col(emotion).alias("label"), *((base[k] * (1.0 + _noise(F.col(key), k, 0.05))).alias(n) for k, n in enumerate(SER)))


def contour_features(entries: DataFrame, key: str, emotion: str) -> DataFrame:
    """(key, label, CONTOUR): a synthetic contour of the emotion's shape, drawn on
    ``CONTOUR_POINTS`` and resampled; an unknown emotion is flat and without noise."""
    label = looked_up(F.col(emotion), CONTOUR_LABELS, "flat")
    table = F.create_map(*[x for e, v in CONTOUR_SHAPES.items() for x in (F.lit(e), F.array(*map(F.lit, v)))])
    shape = F.coalesce(F.try_element_at(table, F.col(emotion)), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    rows = entries.select(key, label.alias("label"), shape.alias("__s"))

    def point(k: int) -> Column:
        t = k / (CONTOUR_POINTS - 1)
        return CONTOUR_BASE + F.col("__s")[0] * t + F.col("__s")[1] * math.sin(math.pi * t) + F.col("__s")[2] * _noise(F.col(key), k, 1.0)

    drawn = rows.select(key, "label", F.array(*map(point, range(CONTOUR_POINTS))).alias("__c"))
    drawn = drawn.select(key, "label", M.resampled(F.col("__c"), len(CONTOUR)).alias("__f"))
    return drawn.select(key, "label", *(F.col("__f")[k].alias(n) for k, n in enumerate(CONTOUR)))


#: What makes a task's features of entries; more may be registered.
PREPARERS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {"ser": emotion_features, "pitch_contour": contour_features}


def register_preparer(task: str, prepare: Callable[[DataFrame, str, str], DataFrame]) -> None:
    PREPARERS[task] = prepare


def _logistic(n_rows: int, c: float = 1.0, **options: object) -> Estimator:
    return LogisticRegression(regParam=1.0 / (c * max(1, n_rows)), standardization=False, maxIter=200, **options)


#: Estimators by task name; more may be registered.
REGISTRY: dict[str, tuple[list[str], bool, Callable[..., Estimator]]] = {
    "ser": (SER, True, _logistic),
    "text_prosody": (TEXT, False, lambda n, **o: DecisionTreeClassifier(maxDepth=10, seed=42, **o)),
    "pitch_contour": (CONTOUR, False, lambda n, **o: RandomForestClassifier(numTrees=50, maxDepth=8, seed=42, **o)),
}


def register(task: str, features: list[str], scaled: bool, build: Callable[..., Estimator]) -> None:
    REGISTRY[task] = (features, scaled, build)


def train(rows: DataFrame, task: str, **options: object) -> PipelineModel:
    """A fitted pipeline from features and ``label`` to ``predicted`` and ``probability``."""
    names, scaled, build = REGISTRY[task]
    labels = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    stages: list = [labels, VectorAssembler(inputCols=names, outputCol="raw")]
    if scaled:
        stages.append(StandardScaler(inputCol="raw", outputCol="vector", withMean=True))
    model = build(rows.count(), **options)
    model = model.copy({model.labelCol: "label_index", model.featuresCol: "vector" if scaled else "raw"})
    stages += [model, IndexToString(inputCol="prediction", outputCol="predicted", labels=labels.labels)]
    return Pipeline(stages=stages).fit(rows)


def evaluated(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(truth, predicted) of rows with features and label."""
    return model.transform(rows).select(F.col("label").alias("truth"), "predicted")


def training_report(model: PipelineModel, task: str, train: DataFrame, val: DataFrame | None = None) -> DataFrame:
    """One row: task, n_features, n_train, n_val, and accuracy and macro scores on both (null
    without ``val``), as ``tables.save_report`` writes them."""

    def scores(rows: DataFrame | None, name: str) -> DataFrame:
        none = ["accuracy", "macro_precision", "macro_recall", "macro_f1"]
        if rows is None:
            return train.sparkSession.range(1).select(F.lit(0).cast("long").alias(f"n_{name}"), *(F.lit(None).cast("double").alias(f"{name}_{c}") for c in none))
        found = evaluated(model, rows)
        one = found.agg(F.count("*").alias(f"n_{name}"), metrics.accuracy(F.col("truth") == F.col("predicted")).alias(f"{name}_accuracy"))
        whole = metrics.macro(metrics.class_report(found))
        return one.join(F.broadcast(whole.select(*(F.col(c).alias(f"{name}_{c}") for c in none[1:]))))

    both = scores(train, "train").join(F.broadcast(scores(val, "val")))
    return both.select(F.lit(task).alias("task"), F.lit(len(REGISTRY[task][0])).alias("n_features"), "*")


def export(model: PipelineModel, report: DataFrame, path: str) -> None:
    """The model under ``model`` and its report under ``metadata``."""
    save(model, f"{path}/model")
    report.write.mode("overwrite").json(f"{path}/metadata")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
