"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shares of character classes, word length, immediate word
repetition and length, of the line and of its two neighbours. The field is fitted on at most PER_LABEL documents of
each label, whose lines take the document's label, weighted back to the labels' true shares. A document's raw score is the mean of
its lines' forward-backward marginals of `good`, weighted by line length; a fifth of the sample, kept from the field, calibrates it.

Defined results: a null or empty text is one empty line and is scored like any other; without labelled rows, or with
one label only, every score is that label's share (1 without rows). Texts are read whole; repeated rows are each scored;
documents with contradictory labels teach nothing; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_of, text_batches
from .sampling import bounded_sample, one_each

#: Bound of the fitting sample, for each label.
PER_LABEL = 1500
#: Bound of the lines of a sampled document that the fit sees; scores are of all lines.
FIT_LINES = 5000
#: Bytes of text whose features are computed at a time; they take about 60 bytes each.
AT_ONCE = 1 << 20
ROUNDS = 150
RATE = 0.15
PENALTY = 1e-3
OWN = 10

#: Character classes: 0 letters and bytes beyond ASCII, 1 capitals, 2 digits, 3 white space, 4 sentence marks, 5 bars, 6 signs.
_CLASS = np.zeros(256, np.int64)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 1 if _c.isupper() else 0 if _c.isalpha() else 2 if _c.isdigit() else 3 if _b <= 32 else 4 if _c in ",.;:'\"()-?" else 5 if _c == "|" else 6


def line_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the number of lines of each text (one at least)."""
    breaks = np.flatnonzero(data == 10)
    texts = len(offs) - 1
    own = np.searchsorted(offs, breaks, side="right") - 1
    counts = np.bincount(own, minlength=texts)[:texts] + 1
    starts = np.sort(np.concatenate((offs[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((breaks, offs[1:])), kind="stable")
    return starts, ends, counts


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, features) with the neighbours' features, line lengths, number of lines of each text."""
    starts, ends, counts = line_bounds(data, offs)
    n, sizes = len(starts), ends - starts
    own = np.zeros((n, OWN))
    own[:, 0] = np.log1p(sizes) / 5
    own[:, 1] = sizes == 0
    if len(data):
        kind = _CLASS[data]
        line = np.repeat(np.arange(n), np.diff(np.append(starts, len(data))))
        shares = np.bincount(line * 8 + kind, minlength=8 * n).reshape(n, 8) / np.maximum(sizes, 1)[:, None]
        own[:, 2] = shares[:, 1]
        own[:, 3] = shares[:, 2]
        own[:, 4] = np.minimum(shares[:, 5] * 10, 2)
        own[:, 5] = np.minimum(shares[:, 6] * 5, 2)
        own[:, 6] = shares[:, 4] * 5
        # words: a start is a byte that isn't white space after one that is, or at a text's start
        inside = kind != 3
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offs[:-1][offs[:-1] < len(data)]
        first[edges] = inside[edges]
        at = np.flatnonzero(first)
        if len(at):
            within = np.arange(len(data), dtype=np.int64)
            which = np.cumsum(first) - 1
            which[which < 0] = 0
            within -= at[which]
            salt = np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
            mixed = (data.astype(np.uint64) + np.uint64(1)) * salt[within & 63]
            mixed[~inside] = 0
            words = np.add.reduceat(mixed, at)
            word_line = line[at]
            n_words = np.bincount(word_line, minlength=n)
            same = np.flatnonzero((words[1:] == words[:-1]) & (word_line[1:] == word_line[:-1])) + 1
            own[:, 7] = np.bincount(word_line[same], minlength=n) / np.maximum(n_words, 1)
            letters = np.bincount(line, weights=inside, minlength=n)
            own[:, 8] = letters / np.maximum(n_words, 1) / 10
            own[:, 9] = n_words <= 2
    first_line = np.cumsum(counts) - counts
    last_line = first_line + counts - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first_line], after[last_line] = 0, 0
    edge = np.zeros((n, 2))
    edge[first_line, 0] = 1
    edge[last_line, 1] = 1
    return np.hstack([np.ones((n, 1)), own, before, after, edge]), sizes, counts


WIDTH = 1 + 3 * OWN + 2


def marginals(emission: np.ndarray, counts: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line; the expected transitions (bad/good x bad/good) of each text.

    emission: log-odds of good; switch: 2 x 2 log potentials. All texts go forward and back together, longest first.
    """
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    base = (np.cumsum(counts) - counts)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    steps = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # texts with over t lines
    forward, backward = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    for t in range(longest):
        k = base[: steps[t]] + t
        e = np.stack([np.zeros(len(k)), emission[k]], axis=1)
        if t:
            p = forward[k - 1][:, :, None] + switch
            e += np.logaddexp(p[:, 0], p[:, 1])
        forward[k] = e - e.max(axis=1, keepdims=True)
    expected = np.zeros((len(counts), 2, 2))
    for t in range(longest - 2, -1, -1):
        k = base[: steps[t + 1]] + t
        onward = backward[k + 1].copy()
        onward[:, 1] += emission[k + 1]
        p = switch[None] + onward[:, None, :]
        b = np.logaddexp(p[:, :, 0], p[:, :, 1])
        joint = forward[k][:, :, None] + p
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        expected[order[: steps[t + 1]]] += joint / joint.sum(axis=(1, 2), keepdims=True)
        backward[k] = b - b.max(axis=1, keepdims=True)
    both = forward + backward
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), expected


@dataclass
class Model:
    theta: np.ndarray
    switch: np.ndarray
    share: float | None = None  # of label 1, where there is nothing to tell apart
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(offs) - 1, self.share)
        x, sizes, counts = line_features(data, offs)
        good, _ = marginals(x @ self.theta, counts, self.switch)
        weight = sizes + 1.0
        first = np.cumsum(counts) - counts
        return self.calibrated(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * log_odds(raw) + self.shift, -700, 700)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def calibrate(model: Model, x: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
    """Logistic fit of the labels on the raw scores' log-odds, by damped Newton steps with a ridge; the slope stays positive."""
    counts = np.array([len(r) for r in x])
    good, _ = marginals(np.vstack(x) @ model.theta, counts, model.switch)
    lengths = np.expm1(np.vstack(x)[:, 1] * 5) + 1
    first = np.cumsum(counts) - counts
    raw = np.add.reduceat(good * lengths, first) / np.add.reduceat(lengths, first)
    a = np.column_stack([log_odds(raw), np.ones(len(raw))])
    w, ridge = np.array([1.0, 0.0]), np.diag([1e-2, 1e-3]) * weight.sum()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (y - p)) - ridge @ (w - [1.0, 0.0]))
        step /= max(1.0, np.abs(step).max() / 0.2)
        w = w + step
        w[0] = max(w[0], 0.05)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(w[0]), float(w[1])


def fit_field(x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """Maximum likelihood by adaptive gradient steps; y and weight are of each text."""
    theta, switch = np.zeros(x.shape[1]), np.zeros((2, 2))
    line_y, text = np.repeat(y, counts), np.repeat(np.arange(len(counts)), counts)
    per_line = (weight / counts)[text]
    seen = np.zeros((len(counts), 2, 2))
    seen[np.arange(len(counts)), y, y] = counts - 1
    total = weight.sum()
    m1, m2 = np.zeros(len(theta) + 4), np.zeros(len(theta) + 4)
    for step in range(1, ROUNDS + 1):
        good, expected = marginals(x @ theta, counts, switch)
        g_theta = x.T @ ((line_y - good) * per_line) / total - PENALTY * theta
        g_switch = ((seen - expected) * (weight / counts)[:, None, None]).sum(axis=0) / total - PENALTY * switch
        g = np.append(g_theta, g_switch)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        theta, switch = theta + move[:-4], switch + move[-4:].reshape(2, 2)
    return Model(theta, switch)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL, folds: int = 5) -> Model:
    """Learns from labelled documents whose crc32 of the id modulo `folds` isn't 0."""
    agreed = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna().where(split_of("id", folds) != 0)
    agreed = agreed.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most AND label IN (0, 1)")
    sample, counts = bounded_sample(agreed, "id", "label", per_label)
    if len(counts) < 2:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), float(next(iter(counts), 1)))

    def run(batches):
        for batch, data, offs in text_batches(batches, limit=AT_ONCE):
            x, _, n = line_features(data, offs)
            cuts = np.concatenate(([0], np.cumsum(n)))
            rows = [x[a : min(b, a + FIT_LINES)].astype(np.float32).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("at"), pa.array(rows, pa.binary())], ["label", "at", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = one_each(texts.join(F.broadcast(sample), F.col("id") == F.col("sample_id")), "id", ["label", "text"]).select(F.col("label").cast("int").alias("label"), F.xxhash64("id").alias("at"), "text")
    rows = sorted(picked.mapInArrow(run, "label int, at long, x binary").collect(), key=lambda r: (r["at"], r["label"]))
    if len({r["label"] for r in rows}) < 2:
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), float(rows[0]["label"] if rows else 1))
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows]
    y = np.array([r["label"] for r in rows])
    drawn = np.bincount(y, minlength=2)
    weight = np.array([counts.get(k, 0) / drawn[k] for k in (0, 1)])[y]
    x = [r.astype(float) for r in x]
    last = np.arange(len(x)) % 5 == 0
    if len(set(y[last])) < 2 or len(set(y[~last])) < 2:  # too few to keep any apart
        return fit_field(np.vstack(x), np.array([len(r) for r in x]), y, weight)
    kept = [r for r, own in zip(x, ~last, strict=True) if own]
    model = fit_field(np.vstack(kept), np.array([len(r) for r in kept]), y[~last], weight[~last])
    calibrate(model, [r for r, own in zip(x, last, strict=True) if own], y[last], weight[last])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """id, the columns of `keep`, score (higher: better)."""
    columns = list(dict.fromkeys([id_col, *keep]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, data, offs in text_batches(batches, "__text", AT_ONCE):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(shared.value.scores(data, offs))], [*columns, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).mapInArrow(run, f"{kinds}, score double")


def judged(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """docs with one more column `name`, the score; only the text goes through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        scores = [shared.value.scores(data, offs) for _, data, offs in text_batches([batch], limit=AT_ONCE)]
        return pa.array(np.concatenate(scores) if scores else [], pa.float64())

    return docs.withColumn(name, judge(F.coalesce(F.col(text_col), F.lit(""))))
