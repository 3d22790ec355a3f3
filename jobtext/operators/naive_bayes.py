"""M6 — multinomial naive Bayes on TF-IDF features, as joins and aggregates.

    theta[c,t] = log((fc[c,t] + a) / (S_c + a*V)),   prior[c] = log(n_c / N)

with fc the summed feature weight of class c, S_c its total and V the
vocabulary size (priors are the plain class shares).  Because
log(fc + a) = log(a) for the many zero cells, a document's score splits into

    prior[c] + W_d * (log a - log(S_c + a*V)) + sum_{t: fc[c,t] > 0} w_dt * (log(fc[c,t] + a) - log a)

so only the non-zero (class, term) cells are joined — at most classes x
vocabulary (capped), broadcast while they are few and shuffled by term
beyond — and the per-class constants are a class-sized parameter list, as in
any fitted model.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtext.operators.evaluate import MAX_CLASSES
from jobtext.session import materialize


#: Cells that are broadcast at most: about 50 MB.
MAX_CELLS = 1_000_000


class NaiveBayesModel:
    def __init__(self, classes: list[tuple[str, float, float]], cells: DataFrame, alpha: float, small: bool):
        self.classes = classes  # (label, prior, log-norm) per class, sorted by label
        self.cells = cells      # (label, term, lt) non-zero cells
        self.alpha = alpha
        self.small = small      # at most MAX_CELLS cells

    def predict(self, docs: DataFrame, weights: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(doc_id, predicted_label) for every row of ``docs``; ties go to the first label."""
        la = math.log(self.alpha)
        weights = materialize(weights)  # read twice below
        # up to MAX_CELLS the cells go to every task; beyond, both sides are shuffled by term, a hot
        # one split by AQE, and each task sums its part of a document before the next shuffle
        cells = F.broadcast(self.cells) if self.small else self.cells.hint("merge")
        sparse = weights.join(cells, "term") \
            .groupBy(id_col, "label").agg(F.sum(F.col("weight") * F.col("lt")).alias("s"))
        w_d = weights.groupBy(id_col).agg(F.sum("weight").alias("W"))
        base = docs.select(id_col).join(w_d, id_col, "left").fillna(0.0, subset=["W"])
        params = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(p).alias("prior"), F.lit(ln).alias("ln"))
                           for c, p, ln in self.classes])
        base = base.select(id_col, "W", F.explode(params).alias("c")).select(
            id_col, F.col("c.label").alias("label"),
            (F.col("c.prior") + F.col("W") * (F.lit(la) - F.col("c.ln"))).alias("s"))
        scores = base.unionByName(sparse).groupBy(id_col, "label").agg(F.sum("s").alias("score"))
        best = scores.groupBy(id_col).agg(F.min(F.struct((-F.col("score")).alias("neg"), "label")).alias("b"))
        return best.select(id_col, F.col("b.label").alias("predicted_label"))


def fit(weights: DataFrame, labels: DataFrame, vocab_size: int, alpha: float = 1.0,
        id_col: str = "doc_id", label_col: str = "label") -> NaiveBayesModel:
    """``weights``: (doc_id, term, weight) of the training documents;
    ``labels``: (doc_id, label), joined to the weights unless these carry the
    label.  Collects only the class-sized parameters."""
    lab = labels.select(id_col, F.col(label_col).alias("label"))
    # classes x vocabulary, read twice below
    known = weights if "label" in weights.columns else weights.join(lab, id_col)
    fc = materialize(known.groupBy("label", "term").agg(F.sum("weight").alias("fc")))
    la = math.log(alpha)
    cells = fc.select("label", "term", (F.log(F.col("fc") + F.lit(alpha)) - F.lit(la)).alias("lt"))
    s_c = fc.groupBy("label").agg(F.sum("fc").alias("S"))
    n_c = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    cls = n_c.join(s_c, "label", "left").fillna(0.0, subset=["S"]).limit(MAX_CLASSES + 1).collect()  # one row per class
    if len(cls) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    total = sum(r["n_c"] for r in cls)
    classes = sorted(
        (r["label"], math.log(r["n_c"] / total), math.log(r["S"] + alpha * vocab_size)) for r in cls
    )
    return NaiveBayesModel(classes, cells, alpha, fc.limit(MAX_CELLS + 1).count() <= MAX_CELLS)
