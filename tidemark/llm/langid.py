"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are learnt by follow-the-regularised-leader (proximal form) with L1 and L2 penalties;
a temperature fitted on rows left out of training calibrates the probabilities. Inverse
document frequencies are counted over all learnable documents; the classifier itself is
fitted on at most `max_rows` of them (a documented bound, chosen by a hash of doc_id).

Defined cases: null texts and texts without a letter are `und` with score 0; null languages
are not learnt from; if nothing can be learnt, every prediction is `und`. Rows repeat
independently; extra columns are kept as they are, but for columns named as the results, which
are replaced. Of equally likely languages the first by name is predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, grams

_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Params:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 13
    max_rows: int = 6_000  # bound of the rows that the classifier is fitted on
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    epochs: int = 6
    batch: int = 32


@dataclass(frozen=True)
class Model:
    params: Params
    langs: tuple[str, ...]
    weights: np.ndarray  # float32, bucket x language, idf included
    bias: np.ndarray
    temperature: float


def _grams(column: pa.Array, p: Params):
    """For runs of documents: (first, last + 1, own, [bucket by position with -1 for none])."""
    for i, j, cps, starts, ends in grams.code_points(column):
        own = grams.owners(starts, ends, len(cps))
        flat = []
        for n, b in grams.buckets(cps, p.orders, p.bits):
            last = own[n - 1 :]
            at = np.flatnonzero((own[: len(last)] >= 0) & (own[: len(last)] == last))
            flat.append((own[at], b[at]))
        yield i, j, flat


def idf(docs: DataFrame, params: Params) -> np.ndarray:
    """Smoothed inverse document frequency of each bucket over all given texts."""
    p, size = params, 1 << params.bits

    def run(batches):
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for i, j, flat in _grams(batch.column(0), p):
                seen = np.zeros((j - i) * size, bool)
                for own, b in flat:
                    seen[own.astype(np.int64) * size + b] = True
                df += seen.reshape(j - i, size).sum(0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], names=["bucket", "n"])

    # summed by bucket in the JVM: the driver gets at most 2**bits + 1 small rows
    rows = docs.select(F.col("text").cast("string")).mapInArrow(common.tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(size), 0
    for r in rows:
        if r.bucket < 0:
            n = r.n
        else:
            df[r.bucket] = r.n
    return np.log((1.0 + n) / (1.0 + df)) + 1.0


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", params: Params = Params()) -> Model:
    """Learns from the given documents (text, non-null lang); the caller has chosen them."""
    p, size = params, 1 << params.bits
    src = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), F.col(lang_col).alias("lang"))
    src = src.where("lang is not null and text is not null")
    weight = idf(src, p)
    few = src.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(p.max_rows)

    def run(batches):
        for batch in batches:
            out = [b""] * batch.num_rows
            for i, j, flat in _grams(batch.column(0), p):
                key = np.concatenate([o.astype(np.int64) * size + b for o, b in flat])
                key, n = np.unique(key, return_counts=True)
                cut = np.searchsorted(key, np.arange(j - i + 1) * size)
                for k in range(j - i):
                    a, b = cut[k], cut[k + 1]
                    out[i + k] = (key[a:b] % size).astype(np.uint16).tobytes() + n[a:b].astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), common.binary_array(out)], names=["id", "lang", "tf"])

    # at most max_rows ids are broadcast; texts become features where they are, and at most twice
    # max_rows sparse rows (an id may have several) reach the driver
    kind = dict(src.dtypes)["id"]
    sample = src.join(F.broadcast(few), "id").select("text", "id", "lang").mapInArrow(common.tidy(run), f"id {kind}, lang string, tf binary")
    sample = sample.orderBy(F.xxhash64("id"), "id", "lang", "tf").limit(2 * p.max_rows).select("lang", "tf").toArrow()
    got = []
    for lang, tf in zip(sample.column(0).to_pylist(), sample.column(1).to_pylist(), strict=True):
        if n := len(tf) // 6:
            got.append((lang, (np.frombuffer(tf, np.uint16, n).astype(np.int64), np.frombuffer(tf, np.float32, offset=2 * n))))
    langs = tuple(sorted({g[0] for g in got}))
    if not langs:
        return Model(p, (), np.zeros((size, 0), np.float32), np.zeros(0), 1.0)
    y = np.array([langs.index(g[0]) for g in got])
    rows = [(tf[0], tf[1] / tf[1].sum() * weight[tf[0]] * 30) for _, tf in got]
    held = np.arange(len(y)) % 5 == 4
    w, b = _ftrl(rows, y, np.flatnonzero(~held) if held.any() else np.arange(len(y)), len(langs), size, p)
    z = np.array([v @ w[c] + b for (c, v), h in zip(rows, held, strict=True) if h]).reshape(-1, len(langs))
    return Model(p, langs, (w * weight[:, None] * 30).astype(np.float32), b, _temperature(z, y[held]))


def _ftrl(rows, y, at, k: int, size: int, p: Params):
    """FTRL-proximal over mini-batches; the bias is an unpenalised last coordinate."""
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    rng = np.random.default_rng(7)

    def current(idx):
        zi, ni = z[idx], n[idx]
        l1 = np.where(idx == size, 0.0, p.l1)[:, None]
        w = -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(p.epochs):
        order = rng.permutation(at)
        for s in range(0, len(order), p.batch):
            part = order[s : s + p.batch]
            cols = np.concatenate([np.r_[rows[r][0], size] for r in part])
            vals = np.concatenate([np.r_[rows[r][1], 1.0] for r in part])
            own = np.repeat(np.arange(len(part)), [len(rows[r][0]) + 1 for r in part])
            idx, inv = np.unique(cols, return_inverse=True)
            x = np.zeros((len(part), len(idx)))
            x[own, inv] = vals
            w = current(idx)
            s_ = x @ w
            s_ = np.exp(s_ - s_.max(1, keepdims=True))
            s_ /= s_.sum(1, keepdims=True)
            s_[np.arange(len(part)), y[part]] -= 1
            g = x.T @ s_ / len(part)
            sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / p.alpha
            z[idx] += g - sigma * w
            n[idx] += g * g
    w = current(np.arange(size + 1))
    return w[:size], w[size]


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood on rows left out of training."""
    if not len(y):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 81):
        s = z / t
        s = s - s.max(1, keepdims=True)
        nll = float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())
        best = min(best, (nll, float(t)))
    return best[1]


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every column of docs, lang_pred and score of its whole text; nothing is shuffled."""
    docs = docs.drop("lang_pred", "score")
    p, names, k = model.params, docs.columns, len(model.langs)
    at = names.index(text_col)
    tables = [np.ascontiguousarray(model.weights[:, c]) for c in range(k)]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            z, total = np.zeros((n, max(k, 1))), np.zeros(n)
            letters = np.array([x.as_py() is not None and _LETTER.search(x.as_py()) is not None for x in batch.column(at)], bool)
            for i, j, flat in _grams(batch.column(at), p):
                for own, b in flat:
                    total[i:j] += np.bincount(own, minlength=j - i)
                    for c in range(k):
                        z[i:j, c] += np.bincount(own, tables[c][b], minlength=j - i)
            if k:
                z = (z / np.maximum(total, 1)[:, None] + model.bias) / model.temperature
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
            ok = letters & (k > 0)
            best = z.argmax(1)
            lang = [model.langs[c] if o else "und" for c, o in zip(best, ok, strict=True)]
            s = np.where(ok, z[np.arange(n), best], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(s)], names=[*names, "lang_pred", "score"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(common.tidy(run), f"{out}, lang_pred string, score double")
