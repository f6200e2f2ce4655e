"""Toxicity by a classifier chain over hashed word features.

The chain predicts the labelled categories in turn, toxic last: every link is a logistic
model of the text's features and of the probabilities of the links before it. Each link is
trained with out-of-fold probabilities of the earlier ones, so that it sees what it will see
of new texts. Folds go by the least hash of a text's features, so that near-copies share one.
A labels table with more categories makes a longer chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import U, chunks, mix, words

BITS = 18
PREFIXES = (4, 5, 6)
#: The label columns that the chain predicts, in order.
CATEGORIES = ("quality", "toxic")


def features(column: pa.Array):
    """(rows, features) in order of rows, of the distinct hashed words and word prefixes of each text."""
    size = U(1 << BITS)
    for lo, hi, data, bounds in chunks(column):
        h, row, length, heads = words(data, bounds, prefixes=PREFIXES)
        row = row.astype(np.int64)
        keys = [row << BITS | (h % size).astype(np.int64)]
        for k, head in zip(PREFIXES, heads):
            longer = length > k
            keys.append(row[longer] << BITS | (mix(head[longer] + U(k)) % size).astype(np.int64))
        key = np.unique(np.concatenate(keys))
        yield lo, hi, key >> BITS, key & ((1 << BITS) - 1)


def _sums(values: np.ndarray, starts: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Sums of runs of ``values`` that begin at ``starts``, at the places ``where`` of an array of ``n``."""
    out = np.zeros(n)
    if len(starts):
        out[where] = np.add.reduceat(values, starts)
    return out


def _logistic(rows, cols, n, extra, y, dims, *, steps=60, ridge=2e-4):
    """(weights, weights of extra, bias) of a binary sparse logistic model, by accelerated gradient steps; classes weigh alike. ``rows`` ascend."""
    w, v, b = np.zeros(dims), np.zeros(extra.shape[1]), 0.0
    share = max(y.mean(), 1e-6)
    weight = np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-6)) / n
    pw, pv, pb = w.copy(), v.copy(), b
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    # runs of a row's features, and in another order of a feature's rows
    own, by_row = np.unique(rows, return_index=True)
    order = np.argsort(cols, kind="stable")
    used, by_col = np.unique(cols[order], return_index=True)
    across = rows[order]
    rate = 4.0
    for t in range(1, steps + 1):
        m = (t - 1) / (t + 2)
        qw, qv, qb = w + m * (w - pw), v + m * (v - pv), b + m * (b - pb)
        s = _sums(qw[cols], by_row, own, n) * scale + extra @ qv + qb
        g = weight * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y)
        pw, pv, pb = w, v, b
        w = qw - rate * 4 * (_sums((g * scale)[across], by_col, used, dims) + ridge * qw / 4)
        v = qv - rate * 0.2 * (extra.T @ g + ridge * qv)
        b = qb - rate * 0.2 * g.sum()
    return w, v, b


def _predict(rows, cols, n, extra, model):
    w, v, b = model
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))
    s = np.bincount(rows, weights=w[cols], minlength=n) * scale + extra @ v + b
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def folds_of(rows: np.ndarray, cols: np.ndarray, n: int, folds: int) -> np.ndarray:
    """The fold of each document: the least hash of its features, which near-copies mostly share, mod ``folds``."""
    least = np.full(n, np.iinfo(np.uint64).max, U)
    np.minimum.at(least, rows, mix(cols.astype(U) + U(1)))
    return (least % U(folds)).astype(np.int64)


def _link(rows, cols, n, extra, y, dims, chosen):
    """A model of the ``chosen`` documents whose label is known; with one class only, a constant."""
    chosen = chosen & ~np.isnan(y)
    known = y[chosen]
    if not len(known) or known.min() == known.max():
        return np.zeros(dims), np.zeros(extra.shape[1]), (10.0 if len(known) and known[0] else -10.0)
    at, own = np.cumsum(chosen) - 1, chosen[rows]
    return _logistic(at[rows[own]], cols[own], int(chosen.sum()), extra[chosen], known, dims)


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The log odds at which out-of-fold probabilities part the classes with the best F-measure; 0 without both classes."""
    known = ~np.isnan(y)
    p, y = np.clip(p[known], 1e-9, 1 - 1e-9), y[known]
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(-p, kind="stable")
    s = np.log(p[order]) - np.log1p(-p[order])
    hit = np.cumsum(y[order])
    f = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f[:-1][s[:-1] == s[1:]] = 0  # equal scores stay together
    best = int(np.argmax(f))
    return float((s[best] + s[min(best + 1, len(s) - 1)]) / 2)


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, fold: np.ndarray, *, least: int = 5) -> dict:
    """The chain, from feature pairs of ``len(y)`` documents and their labels (a column a category, NaN: not known).

    Features of fewer than ``least`` documents are left out. The last link's bias is moved so
    that its probability is 0.5 where the out-of-fold ones part the classes best.
    """
    n = len(y)
    used = np.flatnonzero(np.bincount(cols, minlength=1 << BITS) >= least)
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    keep = place[cols] >= 0
    rows, cols = rows[keep], place[cols[keep]]
    chain, extra = [], np.zeros((n, 0))
    for c in range(y.shape[1]):
        out = np.zeros(n)
        for k in np.unique(fold):
            test = fold == k
            part = _link(rows, cols, n, extra, y[:, c], len(used), ~test)
            at, own = np.cumsum(test) - 1, test[rows]
            out[test] = _predict(at[rows[own]], cols[own], int(test.sum()), extra[test], part)
        chain.append(_link(rows, cols, n, extra, y[:, c], len(used), np.ones(n, bool)))
        extra = np.hstack([extra, out[:, None]])
    w, v, b = chain[-1]
    chain[-1] = (w, v, b - _cut(extra[:, -1], y[:, -1]))
    return {"place": place, "chain": chain, "oof": extra}


def probabilities(rows, cols, n, model) -> np.ndarray:
    at = model["place"][cols]
    keep = at >= 0
    rows, at = rows[keep], at[keep]
    extra = np.zeros((n, 0))
    for link in model["chain"]:
        extra = np.hstack([extra, _predict(rows, at, n, extra, link)[:, None]])
    return extra


def train(docs: DataFrame, labels: DataFrame, *, key: str, text: str, categories: tuple[str, ...], folds: int, sample: int, features_held: int, chain_folds: int = 4) -> dict | None:
    """A chain from labelled rows with a key hash mod ``folds`` other than 0; None without any.

    At most ``sample`` rows, those with the least hash of their key, and of these as many as
    hold ``features_held`` features together reach the driver.
    """
    last = F.col(categories[-1]).cast("int")
    kept = labels.select(F.col(key).alias("k"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)], last.alias("last"))
    order = (F.xxhash64("k"), "k", *[f"y{i}" for i in range(len(categories))])
    chosen = (
        kept.where("k IS NOT NULL AND last IN (0, 1)").where(F.expr(f"crc32(cast(cast(k as string) as binary)) % {folds} <> 0"))
        .orderBy(*order).limit(sample).drop("last")
    )
    ys = [f"y{i}" for i in range(len(categories))]
    rows = docs.select(F.col(key).alias("dk"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("dk") == F.col("k")).select(F.xxhash64("k").alias("h"), *ys, "t")

    def run(batches):
        for batch in batches:
            out = [b""] * batch.num_rows
            for lo, hi, row, col in features(batch.column(batch.num_columns - 1)):
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    out[lo + i] = col[ends[i] : ends[i + 1]].astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int32())], ["h", *ys, "x", "size"])

    scratch = Scratch(docs.sparkSession, "toxicity")
    made = scratch.save(rows.mapInArrow(run, f"h long, {', '.join(f'{c} int' for c in ys)}, x binary, size int"), "features")
    # rows that repeat a key could exceed the bound
    order = ("h", *ys, F.xxhash64("x"))
    sizes = made.orderBy(*order).limit(sample).select("size").toArrow().column("size").to_numpy()
    fits = int(np.searchsorted(np.cumsum(sizes, dtype=np.int64), features_held, "right"))
    got = made.orderBy(*order).limit(fits).select(*ys, "x").toArrow()
    scratch.drop(made)
    if not got.num_rows:
        return None
    sets = [np.frombuffer(x, np.int32) for x in got.column("x").to_pylist()]
    y = np.stack([got.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ys], 1)
    y[(y != 0) & (y != 1)] = np.nan
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    cols = np.concatenate(sets).astype(np.int64)
    model = fit(rows, cols, y, folds_of(rows, cols, len(sets), chain_folds))
    del model["oof"]
    return model


def toxicity(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", categories: tuple[str, ...] = CATEGORIES, folds: int = 5, sample: int = 6_000, features_held: int = 20_000_000, threshold: float = 0.5
) -> DataFrame:
    """(key, p_<category> of each category, toxic) of every row; ``categories`` are columns of ``labels``.

    toxic is 1 if the last category's probability is at least ``threshold``. Labelled rows with
    crc32(key as text) mod ``folds`` = 0 are never learned from; of the others at most
    ``sample`` rows and ``features_held`` features are. The key is of any type. Null and empty
    texts have no features and are never toxic; null keys stay null; equal texts get equal
    probabilities; other columns are ignored; without labels nothing is toxic (probabilities
    0); an empty table gives an empty result.
    """
    chain = train(docs, labels, key=key, text=text, categories=categories, folds=folds, sample=sample, features_held=features_held)
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in batches:
            p = np.zeros((batch.num_rows, len(categories)))
            for lo, hi, row, col in features(batch.column(1)):
                if model.value is not None:
                    p[lo:hi] = probabilities(row, col, hi - lo, model.value) * (np.bincount(row, minlength=hi - lo) > 0)[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p[:, c]) for c in range(len(categories))], pa.array((p[:, -1] >= threshold).astype(np.int32))],
                [key, *[f"p_{c}" for c in categories], "toxic"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"p_{c} double" for c in categories) + ", toxic int")
