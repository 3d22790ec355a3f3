"""M2–M9, M11, O2, O3, S5, S7 — TF-IDF text classifiers with Spark ML.

Featurizer (fitted on the training split only):
  RegexTokenizer (runs of >= 2 word characters, lower-cased) -> optional
  StopWordsRemover -> NGram(2) -> unigrams ++ bigrams -> counts over the
  vocabulary (top terms by corpus frequency, ties by term) -> tf * idf -> L2
  norm.
The vocabulary and its df come from ``features.top_terms``: CountVectorizer's
own fit keeps every distinct term of the corpus as an object in memory. The
smooth idf ln((n+1)/(df+1)) + 1 is applied with ElementwiseProduct.

Classifiers, with balanced class weights n / (k * n_c) as a weight column:
  logistic regression (multinomial, L2, regParam = 1/N: the C = 1 objective
  divided by the total weight), one-vs-rest linear SVM on the squared hinge
  (``squared_hinge``), multinomial naive Bayes.  Labels are indexed
  alphabetically, so arg-max ties go to the first label in alphabetical order.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, IndexToString, NGram, Normalizer, RegexTokenizer,
    SQLTransformer, StopWordsRemover, StringIndexer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtext.session import materialize, scratch_path

from jobtext.functions.scoring import blended_confidence, softmax
from jobtext.functions.text import WORD
from jobtext.operators import evaluate as E
from jobtext.operators import features as FT
from jobtext.operators import softmax as LR
from jobtext.operators import squared_hinge as SVM

MODEL_NAMES = ["logistic_regression", "linear_svc", "multinomial_nb"]


def fit_featurizer(train: DataFrame, max_features: int, stop_words: list[str] | None = None,
                   text_col: str = "text") -> PipelineModel:
    """TF-IDF featurizer fitted on ``train``; output column ``features``."""
    stages = [RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=f"{WORD}{{2,}}", gaps=False,
                             toLowercase=True, minTokenLength=1)]
    uni = "_tok"
    if stop_words:
        stages.append(StopWordsRemover(inputCol="_tok", outputCol="_uni", stopWords=stop_words, caseSensitive=True))
        uni = "_uni"
    vocab = FT.top_terms(train, max_features, text_col=text_col, stop_words=stop_words).orderBy(F.col("cf").desc(), "term").collect()
    n = train.count()
    scale = Vectors.dense([math.log((n + 1) / (r.df + 1)) + 1.0 for r in vocab])  # vocabulary-sized
    return PipelineModel(stages=stages + [
        NGram(n=2, inputCol=uni, outputCol="_bi"),
        SQLTransformer(statement=f"SELECT *, concat({uni}, _bi) AS _terms FROM __THIS__"),
        CountVectorizerModel.from_vocabulary([r.term for r in vocab], inputCol="_terms", outputCol="_tf"),
        ElementwiseProduct(scalingVec=scale, inputCol="_tf", outputCol="_tfidf"),
        Normalizer(p=2.0, inputCol="_tfidf", outputCol="features"),
    ])


def featurize(featurizer: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply the featurizer and drop its intermediate columns."""
    out = featurizer.transform(df)
    return out.drop(*[c for c in ("_tok", "_uni", "_bi", "_terms", "_tf", "_tfidf") if c in out.columns])


def with_class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Balanced weights joined from the class-sized weight table (A13). It is
    broadcast: dealt by label, the rows of a large class would go to one task."""
    w = E.class_weights(df, label_col).select(F.col("label").alias(label_col), F.col("weight").alias("_w"))
    return df.join(F.broadcast(w), label_col)


class DecisionScores(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Decision scores of one linear function for each class, and the class of
    the largest (the first of equal ones); ``weights`` holds the classes' weights
    one after the other, each with its intercept last."""

    weights = Param(Params._dummy(), "weights", "weights and intercept of each class in turn", typeConverter=TypeConverters.toListFloat)
    classes = Param(Params._dummy(), "classes", "number of classes", typeConverter=TypeConverters.toInt)

    @staticmethod
    def of(weights: np.ndarray) -> "DecisionScores":
        return DecisionScores()._set(weights=weights.ravel().tolist(), classes=len(weights))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        w = np.array(self.getOrDefault("weights")).reshape(self.getOrDefault("classes"), -1)

        def decide(indices: pa.Array, values: pa.Array) -> pa.Array:
            return pa.array(list(SVM.decisions(indices, values, w).T), pa.list_(pa.float64()))

        scores = F.arrow_udf(decide, "array<double>")(*SVM.entries("_x"))
        out = dataset.withColumn("_x", F.unwrap_udt("features")).withColumn("_scores", scores)
        best = F.array_position("_scores", F.array_max("_scores")) - 1
        return out.withColumn("rawPrediction", array_to_vector("_scores")).withColumn("_pred", best.cast("double")).drop("_x", "_scores")


def classifier(name: str, n_rows: int, label: str = "_label", weight: str = "_w"):
    if name == "logistic_regression":
        return LogisticRegression(featuresCol="features", labelCol=label, weightCol=weight, family="multinomial",
                                  regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False,
                                  maxIter=1000, tol=1e-4, predictionCol="_pred", probabilityCol="_prob",
                                  rawPredictionCol="_raw")
    if name == "multinomial_nb":
        return NaiveBayes(featuresCol="features", labelCol=label, modelType="multinomial", smoothing=1.0,
                          predictionCol="_pred", probabilityCol="_prob", rawPredictionCol="_raw")
    raise ValueError(name)


def fit_classifier(features: DataFrame, label_col: str, name: str, newton: bool = False) -> PipelineModel:
    """Label indexer (alphabetical) + classifier + label decoder, fitted on featurized
    rows. With ``newton``, logistic regression is fitted by ``softmax`` instead of
    Spark ML: the same objective, whose search does not slow down with rare terms."""
    # the classifiers keep their own blocks of the rows in memory: no second copy here
    data = with_class_weights(features.select(label_col, "features"), label_col)
    packed = {"linear_svc": SVM.fit} | ({"logistic_regression": LR.fit} if newton else {})
    if name in packed:
        x = data.select(label_col, "_w", F.unwrap_udt("features").alias("_x")).select(label_col, "_w", *SVM.entries("_x"))
        found = packed[name](x, data.select("features").first()[0].size, label_col=label_col, weight_col="_w")
        return PipelineModel(stages=[DecisionScores.of(found.weights), IndexToString(inputCol="_pred", outputCol="predicted_label", labels=found.labels)])
    n = data.count()
    indexer = StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc").fit(data)
    decode = IndexToString(inputCol="_pred", outputCol="predicted_label", labels=indexer.labels)
    model = classifier(name, n).fit(indexer.transform(data))
    return PipelineModel(stages=[model, decode])


def predict_with_confidence(model: PipelineModel, features: DataFrame, prefix: str) -> DataFrame:
    """O6 + F20: predicted label and the probability of the best class, 4
    decimals (softmax of the decision scores when a model has no probabilities)."""
    out = model.transform(features)
    if "_prob" in out.columns:
        p = vector_to_array("_prob")
    else:
        p = softmax(vector_to_array("_raw" if "_raw" in out.columns else "rawPrediction"))
    out = out.withColumn(f"{prefix}_confidence", F.round(F.array_max(p), 4))
    out = out.withColumnRenamed("predicted_label", prefix)
    return out.drop(*[c for c in ("_pred", "_prob", "_raw", "rawPrediction") if c in out.columns])


class TextModels:
    """Shared featurizer + category and level classifiers (the served bundle)."""

    def __init__(self, featurizer: PipelineModel, category: PipelineModel, level: PipelineModel, version: str):
        self.featurizer, self.category, self.level, self.version = featurizer, category, level, version

    @staticmethod
    def train(train: DataFrame, max_features: int, stop_words: list[str] | None, version: str,
              name: str = "logistic_regression") -> "TextModels":
        feat = fit_featurizer(train, max_features, stop_words)
        x = materialize(featurize(feat, train).select("category", "level", "features"))  # fitted twice below; cut lineage once
        return TextModels(feat, fit_classifier(x, "category", name), fit_classifier(x, "level", name), version)

    def score(self, texts: DataFrame) -> DataFrame:
        """M9 + F19: category, level and blended confidence per text."""
        x = featurize(self.featurizer, texts)
        x = predict_with_confidence(self.category, x, "category")
        x = predict_with_confidence(self.level, x, "level")
        x = x.withColumn("confidence", blended_confidence(F.col("category_confidence"), F.col("level_confidence")))
        return x.drop("features").withColumn("model_version", F.lit(self.version))

    def save(self, path: str) -> None:
        """The three fitted pipelines under one versioned folder."""
        self.featurizer.write().overwrite().save(f"{path}/featurizer")
        self.category.write().overwrite().save(f"{path}/category")
        self.level.write().overwrite().save(f"{path}/level")

    @staticmethod
    def load(path: str, version: str) -> "TextModels":
        return TextModels(PipelineModel.load(f"{path}/featurizer"), PipelineModel.load(f"{path}/category"),
                          PipelineModel.load(f"{path}/level"), version)


def saved_size_mb(spark, path: str) -> float:
    """Size of a saved model folder (sum of file lengths), 4 decimals."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    total = files.agg(F.sum("length")).first()[0] or 0
    return round(total / (1024 * 1024), 4)


def compare(spark, data: DataFrame, targets: list[str], max_features: int, model_dir: str,
            names: list[str] | None = None) -> DataFrame:
    """M7: fit every candidate per target on the stratified train split,
    evaluate on the test split; train seconds, ms per text, size, path.

    Times are of vectorizer and classifier together, taken one candidate after
    another. The vectorizer is fitted once per target and applied once to each part
    of the split, as it is the same for every candidate, and its time counts for each."""
    rows = []
    for target in targets:
        sp = materialize(E.stratified_split(data, target, "doc_id"))
        train, test = sp.filter(~F.col("is_test")), sp.filter(F.col("is_test"))
        t0 = time.perf_counter()
        feat = fit_featurizer(train, max_features)
        xtr = materialize(featurize(feat, train).select(target, "features"))
        feat_sec = time.perf_counter() - t0
        n_test = test.count()
        t0 = time.perf_counter()
        xte = materialize(featurize(feat, test).select(target, "features"))
        feat_test_sec = time.perf_counter() - t0
        for name in names or MODEL_NAMES:
            t0 = time.perf_counter()
            m = fit_classifier(xtr, target, name, newton=True)
            train_sec = feat_sec + time.perf_counter() - t0
            whole = PipelineModel(stages=[feat, m])
            t1 = time.perf_counter()
            pred = materialize(m.transform(xte).select(F.col(target).alias("true_label"), "predicted_label"))
            infer_ms = (feat_test_sec + time.perf_counter() - t1) / max(n_test, 1) * 1000
            met = E.metrics(pred).first()
            path = f"{model_dir}/{target}/{name}"
            whole.write().overwrite().save(path)
            rows.append((target, name, float(met["accuracy"]), float(met["f1_macro"]), float(met["f1_weighted"]),
                         round(train_sec, 4), round(infer_ms, 4), saved_size_mb(spark, path), path))
    schema = ("target string, model_name string, accuracy double, f1_macro double, f1_weighted double, "
              "train_time_sec double, inference_time_ms double, model_size_mb double, model_path string")
    return spark.createDataFrame(rows, schema)  # one row per fitted model


def leaderboard(results: DataFrame) -> DataFrame:
    """O2: target asc, f1_macro desc, inference time asc."""
    return results.orderBy("target", F.col("f1_macro").desc(), "inference_time_ms")


def best_models(results: DataFrame) -> DataFrame:
    """O3: best model per target by f1_macro, ties to the faster one."""
    from pyspark.sql import Window

    w = Window.partitionBy("target").orderBy(F.col("f1_macro").desc(), "inference_time_ms", "model_name")
    return results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def register(registry: DataFrame | None, best: DataFrame, version: str) -> DataFrame:
    """Append the winners as a model version. It becomes the active one of
    its targets; earlier versions of these targets stay, inactive."""
    new = best.select(
        F.lit(version).alias("version"), "target", "model_name", F.col("model_path").alias("path"),
        "accuracy", F.col("f1_macro").alias("f1_score"), F.lit(True).alias("is_active"),
        F.current_timestamp().alias("created_at"))
    if registry is None:
        return new
    replaced = new.select("target").distinct().withColumn("_new", F.lit(True))
    old = registry.join(replaced, "target", "left").withColumn("is_active", F.col("is_active") & F.col("_new").isNull())
    return old.drop("_new").unionByName(new)


def active_version(registry: DataFrame) -> DataFrame:
    """The active version of each target (the newest if several claim to be)."""
    return registry.filter("is_active").groupBy("target").agg(
        F.max_by("version", "created_at").alias("version"), F.max_by("path", "created_at").alias("path"))


def score_once(requests: DataFrame, key_col: str, order_col: str, scorer, keep: list[str] | None = None, again=None) -> DataFrame:
    """One row per distinct key (the first by ``order_col``, null last) goes
    through ``scorer``; its result columns are joined back to every request of
    the key, beside the request's columns ``keep`` (all, if not given).

    Keys, orders and ``keep`` are written once and settle which rows are first;
    the other columns, texts above all, are read again for these rows alone.
    ``again`` maps a table of orders to the requests that have them, so that a
    caller may pick them before it makes the columns; rows beyond do no harm."""
    keep = [c for c in (requests.columns if keep is None else keep) if c != key_col]
    spark, path = requests.sparkSession, scratch_path(requests.sparkSession, "requests")
    keyed = requests.select(key_col, *dict.fromkeys([order_col, *keep]))
    keyed.write.parquet(path)
    # a test of the written keys: before, the key would be made once for it and once more for the row
    keyed = spark.read.schema(keyed.schema).parquet(path).where(F.col(key_col).isNotNull())
    order = F.struct(F.col(order_col).isNull().alias("none"), F.col(order_col).alias("place"))
    least = keyed.groupBy(key_col).agg(F.min(order).alias("_o")).select(F.col("_o.place").alias(order_col))
    some = again(least) if again else requests.join(least.withColumnRenamed(order_col, "_place"), F.col(order_col).eqNullSafe(F.col("_place")), "left_semi")
    # rows that are first only by another key's order go here; the key comes from the kept row, as a
    # test of the grouping column would be pushed down to all requests
    first = some.groupBy(F.col(key_col).alias("_g")).agg(F.min_by(F.struct(*requests.columns), order).alias("_r"))
    scored = scorer(first.select("_r.*").where(F.col(key_col).isNotNull()))
    new = [c for c in scored.columns if c not in requests.columns]
    return keyed.select(key_col, *keep).join(scored.select(key_col, *new), key_col)
