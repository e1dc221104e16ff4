"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives (quality = 1) and unlabelled text train a small network; explicit negatives are never used. The
class prior comes from best-bin estimation on a half of the sample that a first model, positives against unlabelled,
has not seen. The second model minimises

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

Null and empty texts get the score of all-zero features. Repeated rows are scored each, an empty table gives no rows;
without labels to learn from every score is 0.5. Extra columns are kept by
:func:`score` as they are, except that ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import fold, hash_below, unlike

SYMBOLS = b"!|#$%&*.,:;?@=/<>{}()[]_-\"'"
THRESHOLD = 0.3
#: Bounds of the training sample.
MAX_POSITIVE, MAX_UNLABELLED = 20_000, 40_000

_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[list(b" \t\r\x0b\x0c")], _KIND[10] = 5, 6
for _i, _b in enumerate(SYMBOLS):
    _KIND[_b] = 7 + _i
N_KINDS = 7 + len(SYMBOLS)
N_FEATURES = N_KINDS + 14


def features(raw: bytes) -> np.ndarray:
    """Shares of character kinds, of repeated words and lines, of short and capitalised words, and lengths."""
    out = np.zeros(N_FEATURES)
    if not raw:
        return out
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:N_KINDS] = np.bincount(_KIND, weights=by_byte, minlength=N_KINDS) / len(raw)
    words = raw.split()
    n = len(words)
    if not n:
        return out
    lines = raw.split(b"\n")
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = set(words)
    firsts = np.fromiter((w[0] for w in words), np.uint8, n)
    lasts = np.fromiter((w[-1] for w in words), np.uint8, n)
    out[N_KINDS:] = (
        np.log1p(n), np.log1p(len(raw)), len(distinct) / n, np.log1p(n / len(distinct)), sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n, len(set(lines)) / len(lines), len(lines) / n, lengths.mean() / 10, min(lengths.std() / 10, 5),
        (lengths <= 3).mean(), (lengths == 1).mean(), ((firsts >= 65) & (firsts <= 90)).mean(), ((lasts == 46) | (lasts == 44)).mean(),
    )
    return out


@dataclass
class Network:
    """One hidden layer on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit_network(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int = 40, hidden: int = 24, seed: int = 7) -> Network:
    """prior None: plain logistic loss of positives against unlabelled; else the non-negative risk."""
    rng = np.random.default_rng(seed)
    both = np.vstack([p, u])
    net = Network(both.mean(0), both.std(0) + 1e-3)
    net.w = [rng.normal(0, both.shape[1] ** -0.5, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    step, batches = 0, max(1, len(both) // 1024)
    for epoch in range(epochs):
        for part_p, part_u in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches), strict=True):
            if not len(part_p) or not len(part_u):
                continue
            x = np.vstack([p[part_p], u[part_u]])
            z = np.clip((x - net.mean) / net.scale, -6, 6)
            h = np.tanh(z @ net.w[0] + net.w[1])
            g = h @ net.w[2] + net.w[3]
            s, n_p, n_u = sigmoid(g), len(part_p), len(part_u)
            d = np.zeros(len(x))
            if prior is None:
                d[:n_p], d[n_p:] = (s[:n_p] - 1) / n_p, s[n_p:] / n_u
            else:
                negative = np.logaddexp(0, g[n_p:]).mean() - prior * np.logaddexp(0, g[:n_p]).mean()
                if negative >= 0:
                    d[:n_p], d[n_p:] = prior * (s[:n_p] - 1) / n_p - prior * s[:n_p] / n_p, s[n_p:] / n_u
                else:  # step back where the negative part went below its least value
                    d[:n_p], d[n_p:] = prior * s[:n_p] / n_p, -s[n_p:] / n_u
            dh = d[:, None] * net.w[2] * (1 - h * h)
            grads = [z.T @ dh + 1e-4 * net.w[0], dh.sum(0), h.T @ d + 1e-4 * net.w[2], np.array([d.sum()])]
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                net.w[k] = net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Best-bin estimation: least upper bound of (share of U above c) / (share of P above c) on the held half."""
    net = fit_network(p[::2], u[::2], None, epochs=20)
    sp, su = np.sort(net.logit(p[1::2])), np.sort(net.logit(u[1::2]))
    if len(sp) < 20 or len(su) < 20:
        return 0.5
    cuts = np.quantile(sp, np.linspace(0.02, 0.95, 200))
    above_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    above_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(40) / 2) * (len(su) ** -0.5 + len(sp) ** -0.5)
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x or b"") for x in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_pydict({"is_p": batch.column("is_p"), "is_u": batch.column("is_u"), "x": pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Network | None:
    """Train on rows outside the held fold. The sample is bounded by MAX_POSITIVE and MAX_UNLABELLED (about, by hash); only its features reach the driver. None without positives or documents."""
    known = docs.where(F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    positive = labels.where((F.col("quality") == 1) & (fold("doc_id", folds) != held)).select("doc_id").distinct()
    n_p, n_u = positive.count(), known.select("doc_id").count()
    if not n_p or not n_u:
        return None
    ids = positive.where(hash_below(F.col("doc_id"), MAX_POSITIVE / n_p)).withColumn("is_p", F.lit(True))
    is_u = hash_below(F.struct(F.col("doc_id"), F.lit("u")), MAX_UNLABELLED / n_u)
    sample = (
        known.select("doc_id", F.col("text").cast("binary").alias("raw"), is_u.alias("is_u"))
        .join(F.broadcast(ids), "doc_id", "left")  # at most about MAX_POSITIVE ids
        .select("raw", F.coalesce("is_p", F.lit(False)).alias("is_p"), "is_u")
        .where("is_p or is_u")
    )
    got = sample.mapInArrow(_sampled, "is_p boolean, is_u boolean, x array<double>").toArrow()
    if not got.num_rows:
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    # a fixed order, whatever the order of tasks was
    order = np.lexsort(x.T)
    x, is_p, is_u = x[order], got.column("is_p").to_numpy()[order], got.column("is_u").to_numpy()[order]
    mix = np.random.default_rng(1).permutation(len(x))
    x, is_p, is_u = x[mix], is_p[mix], is_u[mix]
    if is_p.sum() < 2 or is_u.sum() < 2:
        return None
    return fit_network(x[is_p], x[is_u], estimate_prior(x[is_p], x[is_u]))


def score(docs: DataFrame, network: Network | None, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (else all) of docs, with score and predicted. Without a network every score is 0.5."""
    kept = unlike(docs.columns if keep is None else keep, "score", "predicted")

    raw = "raw" + "_" * (1 + max((len(c) for c in docs.columns), default=0))  # no column's name

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(r or b"") for r in batch.column(raw).to_pylist()]).reshape(-1, N_FEATURES)
            s = network.score(x) if network else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = docs.select(*kept).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return docs.select(*kept, F.col("text").cast("binary").alias(raw)).mapInArrow(scored, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return score(rows, network, keep=["doc_id", "held_out"])
