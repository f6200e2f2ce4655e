"""Quality scores by Bradley-Terry pairwise ranking.

A document has a score w . x of dense features of its text; every labelled good and every
labelled bad document form a preference pair, and w minimises the logistic loss of all
pairs' feature differences. Each good text is also preferred to its own words in another
order and to its own letters in another order, so that sequence counts as well as looks.
The score where the share of bad documents lies (a quantile of all labelled documents'
scores) is the threshold, mapped to 0.3.

What a document's pairs add to the gradient depends on its score and on the other side's
scores alone, so the pairs are never made: the scores' counts on a fine grid stand for one
side, and the work grows with the documents, not with their pairs. Tasks add whole numbers
(products rounded row by row), so a model does not depend on how the rows are dealt.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small
from .textkit import SPACE, chunks, shingles, words

_GROUPS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "blank": b" ", "line": b"\n", "other_space": b"\t\x0b\x0c\r", "stop": b".", "comma": b",", "loud": b"!?",
    "symbol": b"#*$%&<>", "bar": b"|", "at": b"@", "slash": b"/\\:", "quote": b"'\"()[]{}", "dash": b"-_=+~^`;",
}
_CLASS = np.full(256, len(_GROUPS), np.int64)
for _i, _v in enumerate(_GROUPS.values()):
    _CLASS[list(_v)] = _i
N_CLASSES = len(_GROUPS) + 1
N_SHAPE = 9
#: How a word ends (a sentence, a part of one, plainly, its line) by how the next begins (capital, small letter, else).
N_STEPS = 4 * 3
N_FEATURES = N_CLASSES + N_SHAPE + N_STEPS + 2
FEW = 12
#: Buckets of hashed runs of three bytes.
BUCKETS = 1 << 16
_PART = 1 << 21
#: Nodes of the scores' grid a unit; nodes of the coarse grid that the curvature is taken on; rows of a block.
FINE = 64
COARSE = 64
BLOCK = 2048
#: Newton steps at most, and the length of a last one.
STEPS = 40
CLOSE = 1e-6

_BEGINS = np.full(256, 2, np.int64)
_BEGINS[65:91] = 0
_BEGINS[97:123] = 1
_ENDS = np.full(256, 2, np.int64)
_ENDS[list(b".!?")] = 0
_ENDS[list(b",;:")] = 1


def runs(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every run of three bytes within a text, some 2 MB at a time."""
    for at in range(0, max(len(data) - 2, 0), _PART):
        b = data[at : at + _PART + 2].astype(np.uint32)
        bucket = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        first = np.arange(at, at + len(bucket))
        row = np.searchsorted(bounds, first, "right") - 1
        own = first + 2 < bounds[row + 1]
        yield bucket[own], row[own]


def _steps(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shares of the twelve kinds of steps from a word to the next, for each text, as if ``FEW`` more steps were of no kind: short texts show little."""
    k = len(bounds) - 1
    count = np.zeros(k * N_STEPS)
    for at in range(0, len(data), _PART):
        b = data[max(at - 1, 0) : at + _PART]
        blank = SPACE[b]
        start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        end = np.flatnonzero(~blank[:-1] & blank[1:])
        if not len(start) or not len(end):
            continue
        before = np.searchsorted(end, start) - 1
        start, before = start[before >= 0], before[before >= 0]
        low = max(at - 1, 0)
        row = np.searchsorted(bounds, start + low, "right") - 1
        own = end[before] + low >= bounds[row]
        start, end_, row = start[own], end[before][own], row[own]
        kind = np.where(b[np.minimum(end_ + 1, len(b) - 1)] == 10, 3, _ENDS[b[end_]])
        count += np.bincount(row * N_STEPS + kind * 3 + _BEGINS[b[start]], minlength=k * N_STEPS)
    count = count.reshape(k, N_STEPS)
    return count / (count.sum(1) + FEW)[:, None]


def features(column: pa.Array, familiar: np.ndarray) -> np.ndarray:
    """A row of ``N_FEATURES`` for each text. Null: as empty.

    Shares of byte classes; shape and repetition of words and lines; shares of the steps from
    word to word; the mean of ``familiar``, a value for each bucket of three bytes running,
    and the share of runs for which it is low.
    """
    out = np.zeros((len(column), N_FEATURES))
    rare = float(familiar.min()) + 1.0
    for lo, hi, data, bounds in chunks(column):
        size = np.diff(bounds)
        k = hi - lo
        for at in range(0, len(data), _PART):
            part = data[at : at + _PART]
            row = np.searchsorted(bounds, np.arange(at, at + len(part)), "right") - 1 if k > 1 else np.zeros(len(part), np.int64)
            out[lo:hi, :N_CLASSES] += np.bincount(row * N_CLASSES + _CLASS[part], minlength=k * N_CLASSES).reshape(k, N_CLASSES)
        out[lo:hi, :N_CLASSES] /= np.maximum(size, 1)[:, None]
        h, row, length, _ = words(data, bounds)
        count = np.bincount(row, minlength=k)
        some = np.maximum(count, 1)
        f = out[lo:hi, N_CLASSES:]
        mean = np.bincount(row, weights=length, minlength=k) / some
        f[:, 0] = np.log1p(count)
        f[:, 1] = mean / 8
        f[:, 2] = np.sqrt(np.maximum(np.bincount(row, weights=length.astype(float) ** 2, minlength=k) / some - mean**2, 0)) / 8
        f[:, 3] = np.bincount(row, weights=length == 1, minlength=k) / some
        f[:, 4] = np.bincount(row, weights=length > 20, minlength=k) / some
        ends = np.cumsum(count)
        for i, u in enumerate(shingles(h, count)):
            if count[i] >= 5:
                f[i, 5] = 1 - len(u) / (count[i] - 4)
            if count[i]:
                f[i, 6] = len(np.unique(h[ends[i] - count[i] : ends[i]])) / count[i] ** 0.8
                lines = [x for x in data[bounds[i] : bounds[i + 1]].tobytes().split(b"\n") if x.strip()]
                f[i, 7] = 1 - len(set(lines)) / max(len(lines), 1)
                f[i, 8] = np.log1p(len(lines) / count[i] * 20)
        f[:, N_SHAPE : N_SHAPE + N_STEPS] = _steps(data, bounds)
        for bucket, row in runs(data, bounds):
            value = familiar[bucket]
            f[:, -2] += np.bincount(row, weights=value, minlength=k)
            f[:, -1] += np.bincount(row, weights=value < rare, minlength=k)
        f[:, -2:] /= np.maximum(size - 2, 1)[:, None]
    return out


def spoilt(text: str) -> list[str]:
    """The text with its words, and with each word's letters, in another order, which its own checksum decides."""
    rng = np.random.default_rng(zlib.crc32(text.encode()))
    parts = text.split()
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).copy()
    letters = np.flatnonzero(code > 64)
    word = np.cumsum(code <= 64)[letters]
    code[letters] = code[letters[np.lexsort([rng.random(len(letters)), word])]]
    return [" ".join(parts[i] for i in rng.permutation(len(parts))), code.tobytes().decode("utf-32-le")]


def fit(x: np.ndarray, good: np.ndarray, *, worse: np.ndarray | None = None, pairs: int | None = None, ridge: float = 1e-3, seed: int = 7, at: float = 0.3) -> dict:
    """Weights by Newton steps on the pairs' loss, of a few rows in memory; without both labels a constant score of 0.5.

    All pairs of a good and a bad row count (``pairs``: as many, drawn). ``worse`` holds, for
    each good row in order, rows of texts that it is preferred to, which weigh half as much
    together. The threshold is that of the labelled rows alone. ``fit_rows`` does the same
    for a table of any size, without making the pairs.
    """
    every = x if worse is None else np.vstack([x, worse.reshape(-1, x.shape[1])])
    mean, scale = every.mean(0) if len(x) else np.zeros(x.shape[1]), np.maximum(every.std(0), 1e-6) if len(x) else np.ones(x.shape[1])
    model = {"mean": mean, "scale": scale, "w": None, "cut": 0.0, "slope": 1.0, "shift": 0.0}
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(up) or not len(down):
        return model
    z = expand(x, model)
    rng = np.random.default_rng(seed)
    d = (z[up][:, None] - z[down]).reshape(-1, z.shape[1]) if pairs is None else z[rng.choice(up, pairs)] - z[rng.choice(down, pairs)]
    weight = np.full(len(d), 1 / len(d))
    if worse is not None:
        own = (z[up][:, None] - expand(worse.reshape(-1, x.shape[1]), model).reshape(len(up), -1, z.shape[1])).reshape(-1, z.shape[1])
        d, weight = np.vstack([d, own]), np.concatenate([weight * 2 / 3, np.full(len(own), 1 / 3 / len(own))])
    w = np.zeros(d.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d.T @ (p * weight)) + ridge * w
        curve = (d * (p * (1 - p) * weight)[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < CLOSE:
            break
    s = _weigh(z, w)
    cut = float(np.quantile(s, len(down) / (len(up) + len(down))))
    return model | {"w": w, "cut": cut, "slope": 4.0 / max(float(np.std(s)), 1e-6), "shift": float(np.log(at / (1 - at)))}


def expand(x: np.ndarray, model: dict) -> np.ndarray:
    """Standardised features, clipped, and their squares: both too little and too much can be bad."""
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return np.hstack([z, z * z / 3])


def score(x: np.ndarray, model: dict) -> np.ndarray:
    if model["w"] is None:
        return np.full(len(x), 0.5)
    s = (_weigh(expand(x, model), model["w"]) - model["cut"]) * model["slope"] + model["shift"]
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _weigh(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """z . w, row by row, so that a row's value does not depend on those beside it."""
    return (z * w).sum(1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of some rows' good texts, each followed by its two spoilt forms, and of their bad texts."""
    for lo in range(0, batch.num_rows, BLOCK):
        part = batch.slice(lo, BLOCK)
        sides = [[], []]
        for y, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            sides[y].append(np.frombuffer(x))
        yield np.array(sides[1]).reshape(-1, 3, N_FEATURES), np.array(sides[0]).reshape(-1, N_FEATURES)


def _joined(rows: DataFrame, part: Callable, how: np.ufunc = np.add) -> tuple[np.ndarray, np.ndarray]:
    """Places in order, and for each the sum (or maximum) of the whole numbers that ``part`` gives for blocks of rows as (places, numbers)."""

    def run(batches):
        at, value = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for up, down in _blocks(batch):
                places, numbers = part(up, down)
                at, own = np.unique(np.concatenate([at, places]), return_inverse=True)
                both, value = np.concatenate([value, numbers]), np.zeros(len(at), np.int64)
                how.at(value, own, both)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(value)], ["at", "part"])

    total = F.sum("part") if how is np.add else F.max("part")
    # every task gives all places: no more tasks than keep the cores busy
    few = rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)
    got = few.mapInArrow(run, "at long, part long").groupBy("at").agg(total.alias("part")).toArrow()
    order = np.argsort(got.column("at").to_numpy())
    return got.column("at").to_numpy()[order], got.column("part").to_numpy()[order]


def _whole(x: np.ndarray, bits: int) -> np.ndarray:
    return np.rint(x * 2.0**bits).astype(np.int64)


def _spread(s: np.ndarray, per: float) -> tuple[np.ndarray, np.ndarray]:
    """The node below each score on a grid of ``per`` nodes a unit, and how far beyond it the score lies."""
    low = np.floor(s * per)
    return low.astype(np.int64), s * per - low


def _between(values: np.ndarray, low: np.ndarray, over: np.ndarray) -> np.ndarray:
    return values[low] * (1 - over) + values[low + 1] * over


def _standard(rows: DataFrame, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of each feature over all texts and spoilt forms."""
    every = lambda up, down: np.vstack([up.reshape(-1, N_FEATURES), down])
    # as whole numbers, doubles from 0 keep their order
    most = _joined(rows, lambda up, down: (np.arange(N_FEATURES), np.abs(every(up, down)).max(0).view(np.int64)), np.maximum)[1].view(float)
    most = np.maximum(most, 1e-300)

    def part(up, down):
        u = every(up, down) / most
        return np.arange(2 * N_FEATURES), np.concatenate([_whole(u, bits).sum(0), _whole(u * u, bits).sum(0)])

    first, second = (_joined(rows, part)[1] / 2.0**bits / n).reshape(2, -1)
    return most * first, np.maximum(most * np.sqrt(np.maximum(second - first * first, 0)), 1e-6)


class _Grid:
    """Counts of the good and bad texts' scores on a grid, and what a text of a score meets on the other side."""

    def __init__(self, rows: DataFrame, model: dict, w: np.ndarray):
        def part(up, down):
            places, numbers = [], []
            for side, x in enumerate((up[:, 0], down)):
                low, over = _spread(_weigh(expand(x, model), w), FINE)
                beyond = _whole(over, 20)
                places += [2 * low + side, 2 * low + 2 + side]
                numbers += [(1 << 20) - beyond, beyond]
            return np.concatenate(places), np.concatenate(numbers)

        at, number = _joined(rows, part)
        node, side = at >> 1, at & 1
        self.every = FINE // 2 * max(1, -(-int(node[-1] - node[0]) // (FINE // 2 * COARSE)))
        self.low = int(node[0]) // self.every
        size = (int(node[-1]) // self.every + 1 - self.low) * self.every + 1
        count = np.zeros((2, size))
        count[side, node - self.low * self.every] = number
        count /= count.sum(1)[:, None]
        apart = np.clip(np.arange(1 - size, size) / FINE, -700, 700)
        lost = 1 / (1 + np.exp(-apart))
        #: Mean probability, over the other side, that a pair is taken the wrong way round: of a good text, of a bad one.
        self.wrong = np.convolve(count[1], lost[::-1], "valid"), np.convolve(count[0], lost, "valid")
        k = np.arange(size)
        self.size = size // self.every + 1
        thick = np.zeros((2, self.size + 1))
        for side in (0, 1):
            np.add.at(thick[side], k // self.every, count[side] * (1 - k % self.every / self.every))
            np.add.at(thick[side], k // self.every + 1, count[side] * (k % self.every / self.every))
        c = np.arange(self.size) * self.every / FINE
        p = 1 / (1 + np.exp(np.clip(np.abs(c[:, None] - c), 0, 700)))
        self.kernel = p * (1 - p)
        self.bend = self.kernel @ thick[1, :-1], self.kernel @ thick[0, :-1]


def _newton(rows: DataFrame, model: dict, w: np.ndarray, n_up: int, n_down: int, ridge: float, bits: int) -> np.ndarray:
    """The step from ``w`` to the least of the loss's second-order model: the gradient of all pairs, their curvature by the coarse grid."""
    grid, width = _Grid(rows, model, w), len(w)
    wrong, bend, low, every, size = grid.wrong, grid.bend, grid.low, grid.every, grid.size
    triangle = np.triu_indices(width)
    fine, rough = bits - 5, min(20, bits - 20)  # features are within 12, differences within 24

    def part(up, down):
        z = expand(up.reshape(-1, N_FEATURES), model)
        s, z = _weigh(z, w).reshape(-1, 3), z.reshape(-1, 3, width)
        sides = [(z[:, 0], s[:, 0]), ((zd := expand(down, model)), _weigh(zd, w))]
        pull, curve, sums = [], [], []
        for k, (own, value) in enumerate(sides):
            node, over = _spread(value, FINE)
            pull.append((own, _between(wrong[k], node - low * every, over)))
            node, over = _spread(value, FINE / every)
            curve.append((own, _between(bend[k], node - low, over)))
            # whole numbers below 2^53: their products are exact in any order
            hat, at, beyond = np.zeros((len(own), size)), np.arange(len(own)), np.rint(over * 1024)
            hat[at, node - low] = 1024 - beyond
            hat[at, node - low + 1] = beyond
            sums.append((hat.T @ np.rint(own * 64)).astype(np.int64).ravel())
        d = (z[:, :1] - z[:, 1:]).reshape(-1, width)
        p = 1 / (1 + np.exp(np.clip(s[:, :1] - s[:, 1:], -700, 700))).ravel()
        pull.append((d, p))
        curve.append((d, p * (1 - p)))
        first = [_whole(own * a[:, None], fine).sum(0) for own, a in pull]
        second = []
        for own, a in curve:
            q = np.rint(own * 64)
            second.append(((q * np.rint(a * 2.0**rough)[:, None]).T @ q)[triangle].astype(np.int64))
        numbers = np.concatenate([*first, *second, *sums])
        return np.arange(len(numbers)), numbers

    got = _joined(rows, part)[1]
    first, second, sums = np.split(got, [3 * width, 3 * width + 3 * len(triangle[0])])
    share = np.array([2 / 3 / n_up, 2 / 3 / n_down, 1 / 3 / (2 * n_up)])
    gradient = (share * [-1, 1, -1]) @ (first.reshape(3, -1) / 2.0**fine) + ridge * w
    curve = np.zeros((width, width))
    curve[triangle] = share @ (second.reshape(3, -1) / 2.0 ** (rough + 12))
    curve += np.triu(curve, 1).T
    good, bad = sums.reshape(2, size, width) / 2.0**16
    cross = good.T @ grid.kernel @ bad * (2 / 3 / n_up / n_down)
    return np.linalg.solve(curve - cross - cross.T + ridge * np.eye(width), gradient)


def _ranked(keys: DataFrame, rank: int) -> int:
    """The key of a rank from 0, sixteen bits at a time."""
    prefix = None
    for shift in (48, 32, 16, 0):
        own = keys if prefix is None else keys.where(F.shiftright("key", shift + 16) == prefix)
        for r in sorted(own.groupBy(F.shiftright("key", shift).alias("k")).count().collect()):
            if rank < r[1]:
                prefix = r[0]
                break
            rank -= r[1]
    return prefix


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order, and back (by ``view``)."""
    i = (x + 0.0).view(np.int64)
    return np.where(i >= 0, i, i ^ np.int64(2**63 - 1))


def fit_rows(rows: DataFrame, scratch: Scratch, *, ridge: float = 1e-3, at: float = 0.3) -> dict:
    """``fit`` of a table (y, x) of any size: x holds a row's features as bytes, a good row's followed by those of its two spoilt forms."""
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    n_up, n_down = counts.get(1, 0), counts.get(0, 0)
    n = 3 * n_up + n_down
    bits = 62 - n.bit_length()
    model = {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "w": None, "cut": 0.0, "slope": 1.0, "shift": 0.0}
    if not n_up or not n_down:
        return model
    model["mean"], model["scale"] = _standard(rows, n, bits)
    w = np.zeros(2 * N_FEATURES)
    for _ in range(STEPS):
        step = _newton(rows, model, w, n_up, n_down, ridge, bits)
        w = w - step
        if np.abs(step).max() < CLOSE:
            break
    own = lambda up, down: _weigh(expand(np.vstack([up[:, 0], down]), model), w)

    def run(batches):
        for batch in batches:
            for up, down in _blocks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_ordered(own(up, down)))], ["key"])

    keys = scratch.save(rows.mapInArrow(run, "key long"), "scores")
    back = lambda key: float(np.where(key >= 0, key, key ^ np.int64(2**63 - 1)).astype(np.int64).view(float))
    lowest, highest = (back(np.int64(v)) for v in keys.agg(F.min("key"), F.max("key")).first())
    place = n_down / (n_up + n_down) * (n_up + n_down - 1)
    below = int(place)
    a, b = (back(np.int64(_ranked(keys, min(r, n_up + n_down - 1)))) for r in (below, below + 1))
    scratch.drop(keys)
    most = max(abs(lowest), abs(highest), 1e-300)

    def part(up, down):
        u = own(up, down) / most
        return np.arange(2), np.array([_whole(u, bits).sum(), _whole(u * u, bits).sum()])

    first, second = _joined(rows, part)[1] / 2.0**bits / (n_up + n_down)
    std = most * float(np.sqrt(max(second - first * first, 0)))
    return model | {"w": w, "cut": a + (b - a) * (place - below), "slope": 4.0 / max(std, 1e-6), "shift": float(np.log(at / (1 - at)))}


def train(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, folds: int, sample: int | None = None) -> dict:
    """A model from all labelled rows of the learning folds (``sample``: of as many labels only, those with the least hash of their id)."""
    chosen = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
        .where("k IS NOT NULL AND y IN (0, 1)").where(F.expr(f"crc32(cast(cast(k as string) as binary)) % {folds} <> 0"))
    )
    if sample is not None:
        chosen = chosen.orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(docs.select(F.col(key).alias("dk"), F.col(text).alias("t")).join(small(chosen), F.col("dk") == F.col("k")).select("y", "t"), "texts")
    familiar = _familiar(rows.where("y = 1"))

    def run(batches):
        for batch in batches:
            out = [r.tobytes() for r in features(batch.column(1), familiar)]
            for i, (y, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                if y == 1:
                    out[i] += features(pa.array(spoilt(t.as_py() or "")), familiar).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["y", "x"])

    made = scratch.save(rows.mapInArrow(run, "y int, x binary"), "features")
    scratch.drop(rows)
    model = {"familiar": familiar} | fit_rows(made, scratch)
    scratch.drop(made)
    return model


def _familiar(rows: DataFrame) -> np.ndarray:
    """The logarithm of how much of the texts' runs falls into each bucket; a text counts the same whatever its length.

    At most ``BUCKETS`` whole numbers reach the driver, so their sums are the same in any order.
    """

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0), 1):  # a text at a time
                own = np.zeros(BUCKETS, np.int64)
                for bucket, _ in runs(data, bounds):
                    own += np.bincount(bucket, minlength=BUCKETS)
                total += np.rint(own * (1e9 / max(own.sum(), 1))).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "part"])

    got = rows.select("t").mapInArrow(run, "bucket long, part long").groupBy("bucket").agg(F.sum("part").alias("part")).toArrow()
    n = np.zeros(BUCKETS)
    n[got.column("bucket").to_numpy()] = got.column("part").to_numpy()
    return np.log((n + 1e-7 * max(n.sum(), 1)) / max(n.sum(), 1))


def quality_classifier(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int | None = None, threshold: float = 0.3, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, held_out, score, predicted) of every row.

    All labelled rows with crc32(key as text) mod ``folds`` other than 0 are learned from, and
    no others (``sample``: from as many labels at most); the score uses nothing but the text. The key is of any type. Null and empty texts are
    scored by the features of an empty text; null keys are not held out; equal texts get equal
    scores; labels other than 0 and 1 are left out; without both labels every score is 0.5.
    ``keep`` names further columns to carry, row by row; others are ignored; repeated rows all
    come back; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key=key, text=text, label=label, folds=folds, sample=sample))

    more = [c for c in keep if c != text]

    def run(batches):
        for batch in batches:
            s = score(features(batch.column(2), model.value["familiar"]), model.value)
            carried = {text: batch.column(2)} | {c: batch.column(3 + i) for i, c in enumerate(more)}
            columns = [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *[carried[c] for c in keep]]
            yield pa.RecordBatch.from_arrays(columns, [key, "held_out", "score", "predicted", *keep])

    held = F.coalesce(F.expr(f"crc32(cast(cast(`{key}` as string) as binary)) % {folds} = 0"), F.lit(False))
    kind = lambda c: docs.schema[c].dataType.simpleString()
    out = ", ".join([f"`{key}` {kind(key)}, held_out boolean, score double, predicted int", *[f"`{c}` {kind(c)}" for c in keep]])
    return docs.select(F.col(key), held, F.col(text), *more).mapInArrow(run, out)
