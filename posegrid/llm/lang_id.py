"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams (orders 1 to 3) of the lower-cased characters; the value of a feature is its relative
frequency in the text times its inverse document frequency. Document frequencies are counted over all training rows;
the weights are fitted by follow-the-regularised-leader with elastic-net penalties on at most PER_LABEL texts of each
label, a fifth of which is kept for the temperature that calibrates the probabilities.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text when there is no labelled row.
Texts are read whole. Null labels teach nothing; repeated rows are each predicted; ties go to the label that
sorts first; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .sampling import bounded_sample, one_each

BITS = 16
ORDERS = (1, 2, 3)
SCALE = 30.0
#: Bound of the fitting sample, for each label.
PER_LABEL = 500
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 0.1, 0.02, 0.01, 4
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts by order (2**BITS where the n-gram would leave its text), text starts, n-grams a text."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    out, total = [], np.zeros(len(texts), np.int64)
    mixed = np.zeros(len(c), np.uint32)
    for order in ORDERS:
        if order > 1:
            mixed[: len(c) - order + 2] *= np.uint32(0x01000193)
        mixed[: max(0, len(c) - order + 1)] ^= c[order - 1 :] * np.uint32(0x85EBCA6B)
        h = ((mixed + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        h = h.astype(np.int32)
        for back in range(1, order):
            at = ends - back
            h[at[(at >= 0) & (sizes >= 1)]] = 1 << BITS
        # texts shorter than the order have no n-gram at all
        out.append(h)
        total += np.maximum(sizes - order + 1, 0)
    return out, ends - sizes, total


def decoded(data: np.ndarray, offs: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # (2**BITS + 1, labels), idf times weight, last row zero
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        hashed, starts, total = grams(texts)
        out = np.zeros((len(texts), len(self.labels)))
        full = total > 0
        if full.any():
            summed = self.table[hashed[0]]
            for h in hashed[1:]:
                summed += self.table[h]
            out[full] = np.add.reduceat(summed, starts[full], axis=0, dtype=np.float64) / total[full, None]
        return out * SCALE + self.bias

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of every feature, over all rows; each task sends one row per feature it saw, summed before and after the shuffle."""

    def run(batches):
        seen, df, n = np.zeros((1 << BITS) + 1, bool), np.zeros((1 << BITS) + 1, np.int64), 0
        for _, data, offs in text_batches(batches, limit=1 << 20):
            texts = decoded(data, offs)
            hashed, starts, total = grams(texts)
            ends = np.append(starts[1:], len(hashed[0]))
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                for h in hashed:
                    seen[h[a:b]] = True
                df += seen
                for h in hashed:
                    seen[h[a:b]] = False
            n += len(texts)
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["feature", "df"])

    rows = texts.mapInArrow(run, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros((1 << BITS) + 1, np.int64)
    df[rows["feature"].to_numpy()] = rows["df"].to_numpy()
    return df[:-1], int(df[-1])


def sparse_rows(sample: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, features, relative frequencies) of the sampled texts, by hash of the id."""

    def run(batches):
        for batch, data, offs in text_batches(batches):
            hashed, starts, total = grams(decoded(data, offs))
            ends = np.append(starts[1:], len(hashed[0]))
            feats, values = [], []
            for a, b, n in zip(starts.tolist(), ends.tolist(), total.tolist(), strict=True):
                all_ = np.concatenate([h[a:b] for h in hashed])
                f, k = np.unique(all_[all_ < 1 << BITS], return_counts=True)
                feats.append(f)
                values.append((k / max(n, 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("at"), pa.array(feats, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["label", "at", "f", "v"])

    rows = sample.mapInArrow(run, "label string, at long, f array<int>, v array<float>").collect()
    return [(r["label"], np.array(r["f"], np.int64), np.array(r["v"], np.float64)) for r in sorted(rows, key=lambda r: (r["at"], r["label"]))]


def follow_the_leader(rows, labels: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proximal follow-the-regularised-leader, one text at a time, per-coordinate rates, L1 and L2 penalties."""
    at = {x: i for i, x in enumerate(labels)}
    z, n = np.zeros((len(idf) + 1, len(labels))), np.zeros((len(idf) + 1, len(labels)))

    def weights(f):
        zf = z[f]
        return np.where(np.abs(zf) <= L1, 0.0, (np.sign(zf) * L1 - zf) / ((BETA + np.sqrt(n[f])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, f, v in rows:
            f, x = np.append(f, len(idf)), np.append(v * idf[f] * SCALE, 1.0)
            w = weights(f)
            error = softmax(x @ w)
            error[at[label]] -= 1
            g = x[:, None] * error
            grown = n[f] + g * g
            z[f] += g - (np.sqrt(grown) - np.sqrt(n[f])) / ALPHA * w
            n[f] = grown
    w = weights(np.arange(len(idf) + 1))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Least negative log-likelihood, by golden section on the logarithm."""
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-300).mean()
    lo, hi, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> Model | None:
    """None without labelled rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(train & F.col("label").isNotNull())
    sample, counts = bounded_sample(rows, "id", "label", per_label)
    labels = sorted(counts)
    if not labels:
        return None
    df, n = document_frequencies(rows.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    picked = one_each(rows.select("id", "text").join(F.broadcast(sample), F.col("id") == F.col("sample_id")), "id", ["label", "text"])
    sparse = sparse_rows(picked.select("label", F.xxhash64("id", F.lit(1)).alias("at"), "text"))
    held = sparse[::5] if len(sparse) >= 25 else sparse
    kept = [r for i, r in enumerate(sparse) if i % 5] if len(sparse) >= 25 else sparse
    w, bias = follow_the_leader(kept, labels, idf)
    table = np.vstack([idf[:, None] * w, np.zeros((1, len(labels)))]).astype(np.float32)
    logits = np.array([(v[:, None] * table[f]).sum(axis=0) * SCALE + bias for _, f, v in held])
    return Model(labels, table, bias, best_temperature(logits, np.array([labels.index(r[0]) for r in held])))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """id, the columns of `keep`, lang_pred, score."""
    columns = list(dict.fromkeys([id_col, *keep]))
    rows = docs.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    if model is None:
        return rows.select(*columns, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch, data, offs in text_batches(batches, "__text", max(1 << 16, (4 << 20) // len(m.labels))):
            texts = decoded(data, offs)
            best, p = m.predict(texts)
            found = [LETTER.search(t) is not None for t in texts]
            names = [m.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(names, pa.string()), pa.array(np.where(found, p, 0.0))], [*columns, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def judged(docs: DataFrame, model: Model | None, name: str, text_col: str = "text") -> DataFrame:
    """docs with one more column `name`, a struct of lang_pred and score; only the text goes through Python."""
    if model is None:
        return docs.withColumn(name, F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def judge(text: pa.Array) -> pa.Array:
        m, names, scores = shared.value, [], []
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        for _, data, offs in text_batches([batch], limit=max(1 << 16, (4 << 20) // len(m.labels))):
            texts = decoded(data, offs)
            best, p = m.predict(texts)
            found = [LETTER.search(t) is not None for t in texts]
            names += [m.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), found, strict=True)]
            scores.append(np.where(found, p, 0.0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(name, judge(F.coalesce(F.col(text_col), F.lit(""))))
