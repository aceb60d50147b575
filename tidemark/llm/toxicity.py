"""Toxicity: a character n-gram linear classifier on naive-Bayes-scaled features.

Features are hashed character n-grams, present or absent in the whole text, each scaled by
its naive Bayes log-count ratio; a logistic regression on the scaled features gives the
score. The classifier is fitted on at most `max_rows` labelled rows (a documented bound,
chosen by a hash of doc_id); every text is scored whole.

Defined cases: null and empty texts have no features and get the score of the intercept;
null labels are not learnt from; several labels of one document count as their maximum;
of rows that repeat a labelled doc_id the first text in order is learnt from, so the bound holds;
without any label, or with labels of one class only, every score is the smoothed share of
toxic labels. Repeated rows are scored alike. Extra columns are kept and not read, but for one named
as the result, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, grams


@dataclass(frozen=True)
class Params:
    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 18
    max_rows: int = 20_000  # bound of the labelled documents that the fit reads
    features: int = 2048
    min_docs: int = 5
    l2: float = 1e-4
    rounds: int = 300
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    params: Params
    weights: np.ndarray  # float32 by bucket, zero where unused
    bias: float


def _present(column: pa.Array, p: Params, keep: np.ndarray | None):
    """For runs of documents: (first, last + 1, document of each feature, feature), each once."""
    for i, j, cps, starts, ends in grams.code_points(column):
        own = grams.owners(starts, ends, len(cps))
        docs, feats = [], []
        for n, b in grams.buckets(cps, p.orders, p.bits):
            ok = np.zeros(len(cps), bool)
            ok[: len(cps) - n + 1] = (own[: len(cps) - n + 1] >= 0) & (own[: len(cps) - n + 1] == own[n - 1 :])
            if keep is not None:
                ok &= keep[b]
            at = np.flatnonzero(ok)
            docs.append(own[at])
            feats.append(b[at])
        key = np.unique(np.concatenate(docs).astype(np.int64) << 32 | np.concatenate(feats).astype(np.int64))
        yield i, j, (key >> 32).astype(np.int64), (key & 0xFFFFFFFF).astype(np.int64)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, p: Params) -> DataFrame:
    """At most p.max_rows labelled texts (label, text), dealt evenly over a few tasks."""
    few = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label is not null")
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(p.max_rows)
    )
    src = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    # the labelled side has at most max_rows rows of two numbers: its broadcast is bounded
    return src.join(F.broadcast(few), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")


def _counts(sample: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Documents with each feature by class, and documents by class."""

    def run(batches):
        seen, total = np.zeros((2, 1 << p.bits), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            y = np.asarray(batch.column(0).to_pylist(), np.int64).clip(0, 1)
            total += np.bincount(y, minlength=2)
            for i, _, d, f in _present(batch.column(1), p, None):
                for c in (0, 1):
                    seen[c] += np.bincount(f[y[i + d] == c], minlength=1 << p.bits).astype(np.int32)
        yield pa.RecordBatch.from_arrays([common.binary_array([seen.tobytes()]), common.binary_array([total.tobytes()])], names=["seen", "total"])

    seen, total = np.zeros((2, 1 << p.bits), np.int64), np.zeros(2, np.int64)
    for r in sample.mapInArrow(common.tidy(run), "seen binary, total binary").collect():
        seen += np.frombuffer(r.seen, np.int32).reshape(2, -1)
        total += np.frombuffer(r.total, np.int64)
    return seen, total


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", params: Params = Params()) -> Model:
    """Learns from the given labelled rows; the caller has chosen them."""
    p = params
    spark = docs.sparkSession
    rows = _sample(docs, labels, id_col, label_col, p).repartition(12)
    with common.scratch(spark):
        return _fit(common.materialize(rows, "toxicity-sample").repartition(12), p)  # a fixed number of count vectors reaches the driver


def _fit(spark_sample: DataFrame, p: Params) -> Model:
    seen, total = _counts(spark_sample, p)
    prior = (total[1] + 1.0) / (total.sum() + 2.0)
    empty = Model(p, np.zeros(1 << p.bits, np.float32), float(np.log(prior / (1 - prior))))
    if not total.all():
        return empty
    share = (seen + 1.0) / (total[:, None] + 2.0)
    ratio = np.log(share[1] / share[0])
    support = seen.sum(0)
    gain = np.abs(ratio) * np.sqrt(support)
    gain[support < p.min_docs] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[: p.features])
    chosen = chosen[gain[chosen] > 0]
    if not len(chosen):
        return empty
    slot = np.full(1 << p.bits, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    keep = slot >= 0

    def rows_of(batches):
        for batch in batches:
            out = [b""] * batch.num_rows
            for i, _, d, f in _present(batch.column(1), p, keep):
                cut = np.searchsorted(d, np.arange(d.max(initial=-1) + 2))
                for k in range(len(cut) - 1):
                    out[i + k] = slot[f[cut[k] : cut[k + 1]]].astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), common.binary_array(out)], names=["label", "slots"])

    got = [(min(1, max(0, r.label)), np.frombuffer(r.slots, np.int32)) for r in spark_sample.mapInArrow(common.tidy(rows_of), "label int, slots binary").collect()]
    y = np.array([g[0] for g in got], np.float64)
    lens = np.array([len(g[1]) for g in got])
    cols = np.concatenate([g[1] for g in got]).astype(np.int64)
    r = ratio[chosen]
    weight, bias = _logistic(cols, lens, y, r, p)
    table = np.zeros(1 << p.bits, np.float32)
    table[chosen] = weight * r
    return Model(p, table, bias)


def _logistic(cols: np.ndarray, lens: np.ndarray, y: np.ndarray, r: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on present features scaled by r (Nesterov steps)."""
    n, m = len(lens), len(r)
    full = np.flatnonzero(lens)  # rows with a feature; the others only meet the intercept
    starts = (np.cumsum(lens) - lens)[full]
    r = r.astype(np.float32)
    x = r[cols]

    def rows_sum(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(full):
            out[full] = np.add.reduceat(v, starts)
        return out

    step = 4.0 / (np.mean(rows_sum(x * x)) + 1.0)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    vw, vb = w.copy(), b
    for t in range(p.rounds):
        z = rows_sum((r * vw).astype(np.float32)[cols]) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = r * np.bincount(cols, np.repeat(g, lens), minlength=m) / n + p.l2 * vw
        nw, nb = vw - step * gw, vb - step * g.mean()
        k = t / (t + 3.0)
        vw, vb = nw + k * (nw - w), nb + k * (nb - b)
        w, b = nw, nb
    return w, float(b)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Every column of docs and the score of its whole text; nothing is shuffled."""
    p = model.params
    docs = docs.drop(score_col)
    schema = docs.schema
    keep = np.abs(model.weights) > 1e-7
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            z = np.full(batch.num_rows, model.bias)
            for i, j, d, f in _present(batch.column(at), p, keep):
                z[i:j] += np.bincount(d, model.weights[f], minlength=j - i)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*names, score_col])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return docs.mapInArrow(common.tidy(run), f"{out}, `{score_col}` double")
