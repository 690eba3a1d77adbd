"""Training: join, clean, widen, prepare, validate, fit, save."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.operators import encoding, evaluation, fold_statistics, folds, merging, regression, selection
from cuesheet.session import materialise

DICT_COLUMNS = {"emotion_distribution": "emotion", "pos_distribution": "pos", "tense_distribution": "tense"}


@dataclass
class Widening:
    """Names learned from the training rows; scoring uses the same ones."""

    vocabulary: list[str]
    keys: dict[str, list[str]]
    topics: int = 5

    @classmethod
    def learn(cls, df: DataFrame, max_vocab_size: int = 500, topics: int = 5) -> Widening:
        keys = {c: encoding.map_key_names(df, c) for c in DICT_COLUMNS if c in df.columns}
        words = encoding.keyword_vocabulary(df, "tfidf_keywords", max_vocab_size) if "tfidf_keywords" in df.columns else []
        return cls(words, keys, topics)

    def apply(self, df: DataFrame) -> DataFrame:
        if "tfidf_keywords" in df.columns:
            df = encoding.multi_hot(df, self.vocabulary)
        for column, prefix in DICT_COLUMNS.items():
            if column in df.columns:
                df = encoding.expand_dict(df, column, prefix, self.keys.get(column, []))
        if "topic_distribution" in df.columns:
            df = encoding.expand_fixed(df, "topic_distribution", "topic", self.topics)
        return df


def fold_widenings(rows: DataFrame, n_splits: int, max_vocab_size: int, fold: str = "fold", topics: int = 5) -> dict[str, Widening]:
    """The names that each training part knows: '0', '1', ... without that fold, and 'all'."""
    cell, parts = F.col(fold), fold_statistics.leave_one_out(n_splits)
    words, keys = dict.fromkeys(parts, []), {name: {} for name in parts}
    if "tfidf_keywords" in rows.columns:
        words = fold_statistics.part_vocabularies(rows, cell, n_splits, parts, "tfidf_keywords", max_vocab_size)
    for column in DICT_COLUMNS:
        if column in rows.columns:
            for name, found in fold_statistics.part_keys(rows, cell, n_splits, parts, column, encoding.MAX_KEYS).items():
                keys[name][column] = found
    return {name: Widening(words[name], keys[name], topics) for name in parts}


def cross_validate(rows: DataFrame, widenings: dict[str, Widening], exclude: Sequence[str], n_splits: int, max_card: int, key: str,
                   estimator=None, target: str = "rating", fold: str = "fold", seed: int = 42) -> DataFrame:
    """Metrics per fold, in which nothing that is learned has seen the fold: vocabulary, keys, codes, medians and modes.

    The rows are widened once by the names of all parts; a part uses the columns of its own names.
    """
    union = Widening(sorted({w for v in widenings.values() for w in v.vocabulary}),
                     {c: sorted({k for v in widenings.values() for k in v.keys.get(c, [])}) for c in DICT_COLUMNS},
                     next(iter(widenings.values())).topics)
    table = materialise(union.apply(rows).withColumn(target, F.col(target).cast("double")))
    categorical, numeric = encoding.split_by_type(table, {*exclude, target})
    learned = fold_statistics.learn(table, F.col(fold), n_splits, fold_statistics.leave_one_out(n_splits), numeric, categorical)
    scored = None
    for i in range(n_splits):
        own = widenings[str(i)]
        unknown = {f"kw_{w}" for w in union.vocabulary} - {f"kw_{w}" for w in own.vocabulary}
        unknown |= {f"{p}_{k}" for c, p in DICT_COLUMNS.items() for k in set(union.keys[c]) - set(own.keys.get(c, []))}
        counts = learned.cardinalities.get(str(i), {})
        coded = [c for c in categorical if counts.get(c, 0) > max_card]
        few, numbers = [c for c in categorical if c not in coded], [c for c in numeric if c not in unknown]
        part = regression.apply_preparation(table, {c: materialise(learned.codes(str(i), c)) for c in coded}, [key])
        train = regression.in_parts(part.where(F.col(fold) != i))
        medians, modes = learned.fillings(str(i), numbers, few)
        medians |= regression.exact_medians(train, coded)  # codes are numbers of this part only
        model = regression.fit_model(train, numbers + coded, few, estimator, target, seed, (medians, modes))
        held = model.transform(part.where(F.col(fold) == i)).select(fold, target, "prediction")
        scored = held if scored is None else scored.unionByName(held)
    return evaluation.regression_metrics(scored, target, "prediction", [fold])


def training_table(metadata: DataFrame, features: DataFrame, key: str = "imdbID", group: str | None = "tv_show_name") -> DataFrame:
    """Joined and cleaned rows, with the group column kept for the folds."""
    return selection.clean_target(merging.merge_features(metadata, features, key, group))


@dataclass
class Scorer:
    """What scoring needs: the model, the codes of its columns and the names learned in training."""

    model: PipelineModel
    codes: dict[str, DataFrame]
    widening: Widening
    numeric: list[str]
    categorical: list[str]

    def importances(self, top_n: int = 15) -> DataFrame:
        return regression.importances(self.model, self.numeric, self.categorical, top_n)

    def save(self, path: str) -> None:
        regression.save_model(self.model, self.codes, path)
        names = {"vocabulary": self.widening.vocabulary, "keys": self.widening.keys, "topics": self.widening.topics,
                 "numeric": list(self.numeric), "categorical": list(self.categorical)}
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(names),)], "names string").write.mode("overwrite").text(f"{path}/names")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    """A saved model with everything it needs, in any session."""
    model, codes = regression.load_model(spark, path)
    names = json.loads(spark.read.text(f"{path}/names").first()["value"])
    return Scorer(model, codes, Widening(names["vocabulary"], names["keys"], names["topics"]), names["numeric"], names["categorical"])


@dataclass
class Trained:
    model: PipelineModel
    prepared: regression.Prepared
    widening: Widening
    fold_metrics: DataFrame
    summary: DataFrame

    @property
    def scorer(self) -> Scorer:
        return Scorer(self.model, self.prepared.codes, self.widening, self.prepared.numeric, self.prepared.categorical)

    def importances(self, top_n: int = 15) -> DataFrame:
        return self.scorer.importances(top_n)

    def save(self, path: str) -> None:
        self.scorer.save(path)


def train(metadata: DataFrame, features: DataFrame, key: str = "imdbID", group: str | None = "tv_show_name",
          n_splits: int = 5, seed: int = 42, max_card: int = 100, max_vocab_size: int = 500, estimator=None,
          model_out: str | None = None) -> Trained:
    """Cross-validate, by show where there is one, then fit on all rows and save."""
    rows = materialise(training_table(metadata, features, key, group))
    grouped = group is not None and group in rows.columns
    folded = materialise(folds.with_group_fold(rows, group, n_splits, spread=[key]) if grouped else folds.with_hash_fold(rows, [key], n_splits, seed))
    exclude: Sequence[str] = [*regression.LEAK_COLUMNS, "fold", *([group] if grouped else [])]
    widenings = fold_widenings(folded, n_splits, max_vocab_size)
    widening = widenings["all"]
    metrics = cross_validate(folded, widenings, exclude, n_splits, max_card, key, estimator, seed=seed)
    prepared = regression.prepare_features(widening.apply(folded), "rating", exclude, max_card, [key])
    model = regression.fit_model(regression.in_parts(prepared.table), prepared.numeric, prepared.categorical, estimator, "rating", seed)
    trained = Trained(model, prepared, widening, metrics, evaluation.cv_summary(metrics))
    if model_out:
        trained.save(model_out)
    return trained


def score_episodes(trained: Trained | Scorer, wanted: DataFrame, metadata: DataFrame, features: DataFrame, key: str = "imdbID") -> DataFrame:
    """Score the wanted ids from their metadata and text features: ``(key, missing, prediction)``.

    Training and scoring share one preparation. An id that is not in the metadata is flagged and has no score.
    """
    scorer = trained.scorer if isinstance(trained, Trained) else trained
    known = merging.lookup_ids(wanted.select(key), metadata, key)
    rows = scorer.widening.apply(merging.merge_features(known.where(~F.col("missing")).drop("missing"), features, key))
    scored = regression.score(scorer.model, rows, scorer.codes, [key]).select(key, "prediction")
    return known.select(key, "missing").join(scored, key, "left")
