"""Quality classifier learned from positives and unlabelled text.

Trusted positives are rows marked good; everything else is unlabelled.  With an
estimated class prior p, a small network g minimises the non-negative unbiased
risk  p * E_pos[l(g)] + max(0, E_all[l(-g)] - p * E_pos[l(-g)])  with the
logistic loss, in numpy, on a bounded sample.  A text's features are shares and
ratios over its whole length.

The prior is estimated from the share of good marks among the rows whose labels
may be learned; marks of bad rows serve for nothing else.

Defined cases: null and empty texts have the features of an empty text and get
a score like any other; without a trusted positive every score is the prior (0
if unknown); several marks for one id count as their largest; equal texts get
equal scores; other columns are kept (result columns replace equal names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom.llm import common

FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "marks", "stops", "other_ascii",
            "non_ascii", "distinct", "adjacent", "line_repeats", "line_words", "long_words")
HIDDEN = 16
CLIP = 3            # standard deviations beyond which a feature no longer counts

_CLASS = np.zeros(256, np.int64)        # byte -> class
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"#*$%&|<>~^_=+{}[]\\@/", 3),
                   (b"!?", 4), (b".,;:", 5), (b"\"'()-`", 6), (b" \t\n\r\x0b\x0c", 7)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
_CLASS_ROWS = (_CLASS[:, None] == np.arange(9)[None, :]).astype(np.float64)


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS_ROWS
    inked = max(1.0, len(data) - counts[7])
    words = (text or "").split()
    n = max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    m = max(1, len(lines))
    lengths = list(map(len, words))
    # roots: a small share of odd signs beside none counts more than beside many
    shares = np.sqrt([*(counts[[1, 2, 3, 4, 5, 6, 8]] / inked), sum(map(eq, words, words[1:])) / n,
                      1 - len(set(lines)) / m, sum(x > 20 for x in lengths) / n]).tolist()
    return [float(np.log1p(len(words))), sum(lengths) / n, *shares[:7], len(set(words)) / n ** 0.75,
            shares[7], shares[8], float(np.log1p(len(words) / m)), shares[9]]


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float

    def margin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.w1 + self.b1)
        return hidden, hidden @ self.w2 + self.b2[0]

    def scores(self, raw: np.ndarray) -> np.ndarray:
        x = np.clip((raw - self.mean) / self.scale, -CLIP, CLIP)
        return sigmoid(self.margin(x)[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 5000,
        batch: int = 1024, rate: float = 6e-3, decay: float = 1e-4, seed: int = 3) -> Network:
    """Adam on the non-negative risk.  While the estimated risk of the negatives is
    below zero, its own gradient is ascended instead, as the estimator asks."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    net = Network(mean, scale, rng.normal(0, .3, (positive.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, .3, HIDDEN), np.zeros(1), prior)
    pos, unl = (np.clip((v - mean) / scale, -CLIP, CLIP) for v in (positive, unlabelled))
    names = ("w1", "b1", "w2", "b2")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    for step in range(1, steps + 1):
        p = pos[rng.integers(0, len(pos), batch)]
        u = unl[rng.integers(0, len(unl), batch)]
        x = np.concatenate([p, u])
        hidden, g = net.margin(x)
        gp, gu = g[:batch], g[batch:]
        bad = softplus(gu).mean() - prior * softplus(gp).mean()      # l(-g) = log(1 + e^g)
        d_good = np.r_[prior * (sigmoid(gp) - 1), np.zeros(batch)] / batch
        d_bad = np.r_[-prior * sigmoid(gp), sigmoid(gu)] / batch
        d = d_good + d_bad if bad >= 0 else -d_bad
        back = np.outer(d, net.w2) * (1 - hidden ** 2)
        grads = {"w1": x.T @ back + decay * net.w1, "b1": back.sum(0),
                 "w2": hidden.T @ d + decay * net.w2, "b2": np.array([d.sum()])}
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            move = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
            setattr(net, k, getattr(net, k) - rate * move)
    return net


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def feature_udf():
    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([features(t) for t in texts])
    return run


def train(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000,
          text: str = "text", key: str = "doc_id", mark: str = "quality") -> Network | None:
    """Fit on at most ``positives`` trusted and ``unlabelled`` other texts (parameters; all, if
    there are fewer), chosen by a hash of the text, copies once; only their features reach the driver."""
    common.python_ready(docs.sparkSession)
    marks = (labels.where(F.col(key).isNotNull() & F.col(mark).isNotNull())
             .groupBy(F.col(key).alias("_id")).agg(F.max(mark).alias("_mark")))
    good = (F.col("_mark") == 1).cast("double")
    share = marks.agg(F.avg(good), F.sum(good)).first()
    if not share[1]:
        return None
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), h.alias("h"))
    trusted = rows.select("id", "h").join(marks.where(F.col("_mark") == 1), F.col("id") == F.col("_id"), "left_semi")
    every = rows.select("h", F.lit(False).alias("good")).union(trusted.select("h", F.lit(True)))
    seen = common.cut(every.groupBy("h").agg(F.max("good").alias("good")), "pu-texts")

    def last(hashes: DataFrame, want: int) -> int | None:
        """The hash of the ``want``th distinct text, or of the last."""
        low = hashes.where(F.col("h") <= F.lit(common.low_bound(hashes.count(), want))).select("h").toPandas()["h"]
        return int(low.sort_values().iloc[:want].iloc[-1]) if len(low) else None
    to_pos, to_unl = last(seen.where("good"), positives), last(seen, unlabelled)
    if to_pos is None or to_unl is None:
        return None
    chosen = seen.select(F.col("h").alias("_h"), (F.col("good") & (F.col("h") <= to_pos)).alias("pos"),
                         (F.col("h") <= to_unl).alias("unl")).where("pos OR unl")
    # a bounded table: at most ``positives`` + ``unlabelled`` rows
    part = rows.join(F.broadcast(chosen), F.col("h") == F.col("_h")).dropDuplicates(["h"])
    got = part.select("h", "pos", "unl", feature_udf()("text").alias("f")).toPandas().sort_values("h")
    pos, unl = (np.array(got["f"][got[side]].tolist(), np.float64).reshape(-1, len(FEATURES)) for side in ("pos", "unl"))
    return fit(pos, unl, min(0.99, max(0.01, float(share[0]))))


def score(docs: DataFrame, net: Network | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Every row of ``docs`` with ``score`` and ``predicted``."""
    common.python_ready(docs.sparkSession)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            if net is None or not len(texts):
                yield pd.Series(np.zeros(len(texts)))
            else:
                yield pd.Series(net.scores(np.array([features(t) for t in texts])))
    out = common.put(docs, score=run(F.col(text)))
    return common.put(out, predicted=F.when(F.col("score") >= threshold, 1).otherwise(0))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(common.doc_hash(doc_id) % folds == fold, F.lit(False))


def learnable(df: DataFrame) -> DataFrame:
    return df.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
