"""Evaluation and text-feature queries: A10–A13, P10–P12, W4, M1, M2, M6, A17, O4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext import taxonomy as tx
from jobtext.operators import evaluate as E
from jobtext.operators import features as FT
from jobtext.operators import naive_bayes as NB
from jobtext.operators import squared_hinge as SVM
from jobtext.plans import standin_sql as S
from jobtext.plans.registry import query
from jobtext.sources import standins
from jobtext.session import shared_dir, materialize, scratch_path
from jobtext.sources.sinks import write_table
from jobtext.sources.tables import read

WORD = S.WORD_CHARS
TARGET_CLASS = "1"

# ------------------------------------------------------------------ SQL bits


def terms_sql(text: str, stop_words: list[str] | None = None) -> str:
    toks = f"regexp_extract_all(lower({text}), '[{WORD}]{{2,}}')"
    if stop_words:
        lst = "[" + ", ".join(f"'{w}'" for w in stop_words) + "]"
        toks = f"list_filter({toks}, lambda t: NOT list_contains({lst}, t))"
    return (f"(SELECT list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) "
            f"FROM (SELECT {toks} AS tk))")


def doc_terms_sql(source: str, stop_words: list[str] | None = None) -> str:
    return f"""SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({terms_sql('text', stop_words)}) AS term FROM {source}) GROUP BY doc_id, term"""


def split_sql(source: str, label: str) -> str:
    """Rows of ``source`` with is_test (largest remainder allocation, md5 order)."""
    return f"""(WITH c AS (SELECT {label} AS lab, count(*) AS n_c FROM {source} GROUP BY {label}),
  t AS (SELECT lab, n_c, sum(n_c) OVER () AS n, (sum(n_c) OVER () + 4) // 5 AS t_all FROM c),
  b AS (SELECT *, (n_c * t_all) // n AS base, (n_c * t_all) % n AS rem FROM t),
  r AS (SELECT *, t_all - sum(base) OVER () AS need, row_number() OVER (ORDER BY rem DESC, lab) AS rk FROM b),
  tc AS (SELECT lab, base + CASE WHEN rk <= need THEN 1 ELSE 0 END AS t_c FROM r),
  o AS (SELECT s.*, row_number() OVER (PARTITION BY s.{label} ORDER BY md5('{tx.SPLIT_SEED}' || CAST(s.doc_id AS VARCHAR)), s.doc_id) AS rn
        FROM {source} s)
  SELECT o.* EXCLUDE (rn), o.rn <= tc.t_c AS is_test FROM o JOIN tc ON tc.lab = o.{label})"""


def _metrics_sql(src: str) -> str:
    return f"""st AS (
  SELECT label, sum(is_true) AS support, sum(1 - is_true) AS predicted, sum(hit) AS tp FROM (
    SELECT true_label AS label, 1 AS is_true, CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END AS hit FROM {src}
    UNION ALL SELECT predicted_label, 0, 0 FROM {src}) GROUP BY label),
prf AS (
  SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM (
    SELECT label, support, predicted, tp,
           CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p,
           CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM st))"""


# ------------------------------------------------------------------ queries


def _pairs(spark, sf_dir):
    return standins.eval_pairs(spark, sf_dir)


@query("eval_metrics", sql=S.with_(S.EVAL_PAIRS, _metrics_sql("eval_pairs")) + """SELECT
  round(sum(tp) / sum(support), 4) AS accuracy, round(avg(p), 4) AS precision_macro, round(avg(r), 4) AS recall_macro,
  round(avg(f1), 4) AS f1_macro, round(sum(f1 * support) / sum(support), 4) AS f1_weighted,
  CAST(sum(support) AS BIGINT) AS samples FROM prf""")
def q_eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, macro precision/recall/F1 and weighted F1 of labelled predictions."""
    return E.metrics(_pairs(spark, sf_dir))


@query("classification_report", sql=S.with_(S.EVAL_PAIRS, _metrics_sql("eval_pairs")) + """
SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM prf
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4),
  round(sum(f1 * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM prf""")
def q_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-label and averaged precision, recall, F1 and support."""
    return E.report(_pairs(spark, sf_dir))


@query("confusion_matrix", sql=S.with_(S.EVAL_PAIRS) + """SELECT true_label,
  CAST(count(*) FILTER (WHERE predicted_label = '0') AS BIGINT) AS "0",
  CAST(count(*) FILTER (WHERE predicted_label = '1') AS BIGINT) AS "1"
FROM eval_pairs GROUP BY true_label""")
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: confusion matrix over the sorted union of labels."""
    p = _pairs(spark, sf_dir)
    return E.confusion(p, E.sorted_labels(p))


@query("class_weights", sql="""SELECT lang AS label, count(*) AS n_c,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM documents GROUP BY lang""")
def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced class weights of the document categories."""
    d = read(spark, sf_dir, "documents", "lang")
    return E.class_weights(d, "lang").withColumn("weight", F.round("weight", 6))


@query("error_table", sql=S.with_(S.EVAL_PAIRS) + """SELECT doc_id, text, true_label, predicted_label,
  true_label = predicted_label AS correct FROM eval_pairs""")
def q_error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 (projection): text, true and predicted label, correct flag."""
    return E.errors(_pairs(spark, sf_dir)).select("doc_id", "text", "true_label", "predicted_label", "correct")


@query("error_examples", sql=S.with_(S.EVAL_PAIRS) + f"""
SELECT 'hard' AS kind, doc_id, text, true_label, predicted_label, false AS correct FROM eval_pairs WHERE true_label <> predicted_label
UNION ALL SELECT 'false_positive', doc_id, text, true_label, predicted_label, false FROM eval_pairs
  WHERE true_label <> predicted_label AND predicted_label = '{TARGET_CLASS}'
UNION ALL SELECT 'false_negative', doc_id, text, true_label, predicted_label, false FROM eval_pairs
  WHERE true_label <> predicted_label AND true_label = '{TARGET_CLASS}'""")
def q_error_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10–P12 + S6: wrong rows, false positives and false negatives of one
    class, written as CSV and read back."""
    ex = E.error_examples(E.errors(_pairs(spark, sf_dir)), TARGET_CLASS)
    ex = ex.select("kind", "doc_id", "text", "true_label", "predicted_label", "correct")
    path = scratch_path(spark, "error-examples")
    write_table(ex, path, "csv")
    return spark.read.schema(ex.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query("stratified_split", sql=f"SELECT doc_id, lang, is_test FROM {split_sql('documents', 'lang')}")
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact stratified 80/20 split of the documents by category, seeded md5 order."""
    d = read(spark, sf_dir, "documents", "doc_id", "lang")
    return E.stratified_split(d, "lang", "doc_id").select("doc_id", "lang", "is_test")


@query("tokens_ngrams", sql=f"""SELECT doc_id, len(tk) AS n_terms, len(list_distinct(tk)) AS n_distinct, sha256(array_to_string(tk, '|')) AS terms_sha256 FROM (
  SELECT doc_id, {terms_sql('text', tx.STOP_WORDS)} AS tk FROM documents)""")
def q_tokens_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: unigrams without stop words plus bigrams, per document: counts and a digest of the whole list."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    t = FT.with_terms(d, "text", "t", tx.STOP_WORDS)
    return t.select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"),
                    F.sha2(F.array_join("t", "|"), 256).alias("terms_sha256"))


@query("term_stats", sql=f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM ({doc_terms_sql('documents')}) GROUP BY term")
def q_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and corpus frequency of every uni- and bigram."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return FT.term_stats(FT.doc_terms(d))


@query("top_terms", sql=f"""SELECT term, df, cf FROM (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM ({doc_terms_sql('documents', tx.STOP_WORDS)}) GROUP BY term)
ORDER BY cf DESC, term LIMIT {tx.VOCAB_TRAIN}""")
def q_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,000-term vocabulary (top corpus frequency, ties by term)."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return FT.top_terms(d, tx.VOCAB_TRAIN, stop_words=tx.STOP_WORDS)


_TFIDF_SQL = f"""WITH dt AS ({doc_terms_sql('documents', tx.STOP_WORDS)}),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM dt GROUP BY term ORDER BY cf DESC, term LIMIT {tx.VOCAB_TRAIN}),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM vocab),
w AS (SELECT dt.doc_id, dt.term, dt.tf * idf.idf AS w FROM dt JOIN idf ON idf.term = dt.term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


@query("tfidf", sql=_TFIDF_SQL)
def q_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: smooth-idf TF-IDF weights (L2-normalised) over the 5,000-term vocabulary."""
    shared_dir(spark)
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    idf = FT.idf_table(FT.top_terms(d, tx.VOCAB_TRAIN, stop_words=tx.STOP_WORDS), d.count())
    rows, terms = FT.tfidf_rows(d, idf, stop_words=tx.STOP_WORDS)
    return FT.by_term(rows, terms, "doc_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _split_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[str]]:
    """The stratified split's train and test rows, both parts' TF-IDF rows with their label, and the vocabulary of the train part."""
    shared_dir(spark)
    d = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    sp = materialize(E.stratified_split(d, "lang", "doc_id"))
    train = sp.filter(~F.col("is_test"))
    test = sp.filter(F.col("is_test"))
    idf = FT.idf_table(FT.top_terms(train, tx.VOCAB_COMPARE), train.count())
    x_train, terms = FT.tfidf_rows(train, idf, "lang")
    return train, test, x_train, FT.tfidf_rows(test, idf, "lang")[0], terms


def nb_split_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the stratified train split, predict the test split."""
    train, test, x_train, x_test, terms = _split_features(spark, sf_dir)
    weights = FT.by_term(x_train, terms, "doc_id", "lang").withColumnRenamed("lang", "label")
    model = NB.fit(weights, train.select("doc_id", F.col("lang").alias("label")), len(terms))
    pred = model.predict(test.select("doc_id"), FT.by_term(x_test, terms, "doc_id"))
    return test.select("doc_id", F.col("lang").alias("true_label")).join(pred, "doc_id")


@query("svm_predict")
def q_svm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: squared-hinge SVM with balanced weights on the train split; labels and
    largest decision value of the test split."""
    train, test, x_train, x_test, terms = _split_features(spark, sf_dir)
    classes = E.class_weights(train, "lang").select(F.col("label").alias("lang"), "weight")
    model = SVM.fit(x_train.join(F.broadcast(classes), "lang"), len(terms), label_col="lang", weight_col="weight")
    found = model.decide(x_test)
    found = found.select("doc_id", "predicted_label", F.round(F.array_max("scores"), 4).alias("score"))
    return test.select("doc_id", F.col("lang").alias("true_label")).join(found, "doc_id")


_NB_SQL = f"""WITH sp AS {split_sql('documents', 'lang')},
train AS (SELECT doc_id, text, lang FROM sp WHERE NOT is_test),
test AS (SELECT doc_id, text, lang FROM sp WHERE is_test),
dtr AS ({doc_terms_sql('train')}),
dte AS ({doc_terms_sql('test')}),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM dtr GROUP BY term ORDER BY cf DESC, term LIMIT {tx.VOCAB_COMPARE}),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM train)) / (1 + df)) + 1 AS idf FROM vocab),
wtr0 AS (SELECT d.doc_id, d.term, d.tf * i.idf AS w FROM dtr d JOIN idf i ON i.term = d.term),
wtr AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM wtr0),
wte0 AS (SELECT d.doc_id, d.term, d.tf * i.idf AS w FROM dte d JOIN idf i ON i.term = d.term),
wte AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM wte0),
fc AS (SELECT t.lang AS label, w.term, sum(w.w) AS fc FROM wtr w JOIN train t ON t.doc_id = w.doc_id GROUP BY t.lang, w.term),
cls AS (SELECT label, count(*) AS n_c FROM (SELECT lang AS label FROM train) GROUP BY label),
sc AS (SELECT label, sum(fc) AS s FROM fc GROUP BY label),
theta AS (SELECT c.label, v.term, ln(coalesce(f.fc, 0) + 1) - ln(coalesce(s.s, 0) + (SELECT count(*) FROM vocab)) AS th
          FROM cls c CROSS JOIN vocab v LEFT JOIN fc f ON f.label = c.label AND f.term = v.term LEFT JOIN sc s ON s.label = c.label),
prior AS (SELECT label, ln(n_c / (SELECT sum(n_c) FROM cls)) AS pr FROM cls),
score AS (SELECT t.doc_id, p.label, p.pr + coalesce((SELECT sum(w.w * th.th) FROM wte w JOIN theta th ON th.term = w.term
                                                        WHERE w.doc_id = t.doc_id AND th.label = p.label), 0) AS s
          FROM test t CROSS JOIN prior p)
SELECT t.doc_id, t.lang AS true_label, arg_min(s.label, (-s.s, s.label)) AS predicted_label
FROM test t JOIN score s ON s.doc_id = t.doc_id GROUP BY t.doc_id, t.lang"""


@query("nb_predict", sql=_NB_SQL)
def q_nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: naive Bayes (TF-IDF 20,000 terms, alpha 1, plain priors) trained on
    the train split, category predicted for the test split."""
    return nb_split_predict(spark, sf_dir)
