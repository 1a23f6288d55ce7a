"""Soft-membership mixing of documents to target domain weights.

A classifier trained on the labelled table gives every document posteriors
over domains. Nonnegative document rates are then fitted so that the expected
tokens of each domain, sum of tokens x rate x posterior, match the targets. The
fit minimises the squared miss by projected gradient steps, each scaled by the
second moments of the documents that still have a rate: one small aggregate
over all documents a step. A document's rate follows from its posteriors and
the steps taken so far, so nothing but the steps is ever kept.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, text_bytes

DOMAINS = ("good", "poor", "toxic")
#: Production targets: shares of the expected tokens.
TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}
BUCKETS = 1 << 16
SHAPES = 8
MASK = BUCKETS - 1
EDGES = re.compile(rb"[!-/:-@\[-`{-~]+")


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of the distinct words, shares of shapes, and the number of words."""
    words = text.split()
    n = len(words)
    distinct = set(words)
    crc = zlib.crc32
    bare = {EDGES.sub(b"", w) for w in {w.lower() for w in distinct}}
    ids = np.unique(np.fromiter((crc(w) & MASK for w in bare), np.int64, len(bare)))
    shapes = np.zeros(SHAPES)
    if n:
        marks = sum(text.count(c) for c in (b"|", b"#", b"%", b"$", b"&", b"*"))
        upper = len(re.findall(rb"[A-Z]", text))
        lines = text.count(b"\n") + 1
        once = len(set(text.split(b"\n")))
        shapes[:] = [1, min(2.0, marks / n), min(2.0, text.count(b"!") / n), min(4.0, upper / n), len(distinct) / n, once / lines, np.log1p(n) / 8, min(2.0, len(text) / n / 10)]
    return ids, shapes, n


@dataclass
class Classifier:
    """Softmax regression on word presence and shapes."""

    words: np.ndarray  # BUCKETS x domains
    shapes: np.ndarray  # SHAPES x domains
    domains: tuple[str, ...]

    def posteriors(self, ids: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        z = self.words[ids].sum(axis=0) + shapes @ self.shapes
        z = np.exp(z - z.max())
        return z / z.sum()


def fit_classifier(rows: list[tuple[np.ndarray, np.ndarray, int]], target: np.ndarray, domains: tuple[str, ...], rounds: int = 150, ridge: float = 2e-3) -> Classifier:
    """Full-batch Adam on the regularised log loss. Domains without a row are left out."""
    n, K = len(rows), len(domains)
    words, shapes = np.zeros((BUCKETS, K)), np.zeros((SHAPES, K))
    if not n:
        return Classifier(words, shapes, domains)
    flat = np.concatenate([r[0] for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    owner = np.repeat(np.arange(n), sizes)
    used, place = np.unique(flat, return_inverse=True)
    dense = np.array([r[1] for r in rows])
    absent = np.bincount(target, minlength=K) == 0
    w = np.zeros((len(used) + SHAPES, K))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = dense @ w[len(used) :]
        for k in range(K):
            z[:, k] += np.bincount(owner, weights=w[place, k], minlength=n)
        z[:, absent] = -1e9
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(n), target] -= 1
        d /= n
        g = ridge * w / 100
        for k in range(K):
            g[: len(used), k] += np.bincount(place, weights=d[owner, k], minlength=len(used))
        g[: len(used)] += ridge * w[: len(used)]
        g[len(used) :] += dense.T @ d
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    words[used] = w[: len(used)]
    shapes[:] = w[len(used) :]
    shapes[0, absent] = -1e9
    return Classifier(words, shapes, domains)


def domain(quality: Column, toxic: Column) -> Column:
    """A label's domain; null where the labels are."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "good").when(quality == 0, "poor")


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Classifier:
    """A classifier from at most ``sample`` labelled documents, drawn by a hash of doc_id.

    A doc_id that several documents have teaches once (by the least of their
    features), so what reaches the driver is bounded by the drawn labels.
    """
    named = labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain")).where("domain is not null and doc_id is not null")
    named = named.groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = named.count()
    share = min(1.0, 1.1 * sample / max(1, n))
    drawn = named.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0].astype("<u2").tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())],
                ["doc_id", "domain", "ids", "shapes"],
            )

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(drawn, "doc_id").select("doc_id", "domain", "text")
    found = joined.mapInArrow(work, "doc_id long, domain string, ids binary, shapes binary")
    rows = found.groupBy("doc_id", "domain").agg(F.min(F.struct("ids", "shapes")).alias("f")).select("doc_id", "domain", "f.*").collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), bytes(r["ids"])))[:sample]
    found = [(np.frombuffer(r["ids"], "<u2").astype(np.int64), np.frombuffer(r["shapes"], np.float64), 0) for r in rows]
    return fit_classifier(found, np.array([DOMAINS.index(r["domain"]) for r in rows], np.int64), DOMAINS)


def posteriors(docs: DataFrame, net: Classifier) -> DataFrame:
    """(rid, doc_id, n_tokens, p array<double>) of every row; tokens are words."""
    handle = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in text_bytes(batch.column(2))]
            p = [handle.value.posteriors(f[0], f[1]).tolist() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[2] for f in found], pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["rid", "doc_id", "n_tokens", "p"])

    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(work, "rid long, doc_id long, n_tokens long, p array<double>")


def rate(p: Column, steps: list[np.ndarray]) -> Column:
    """A document's rate after projected steps, from 1: r <- max(0, r - p . step)."""
    out = F.lit(1.0)
    if not steps:
        return out
    table = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda s: sum((p[k] * s[k] for k in range(1, len(steps[0]))), p[0] * s[0])
    return F.aggregate(table, out, lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def fit_rates(rows: DataFrame, targets: np.ndarray, rounds: int = 60, tolerance: float = 1e-9) -> tuple[list[np.ndarray], float]:
    """Steps that bring the shares of expected tokens of ``rows`` (n_tokens, p) to ``targets``, and the largest miss left.

    Shares are of the tokens there are, so matched targets also keep their
    number. Each step is a projected gradient step on half the squared miss,
    scaled by the inverse second moments of the documents with a rate; it is
    halved until the miss falls. Where no rates meet the targets, such steps
    come to a halt and plain gradient steps approach the least miss for the
    rounds that are left. Without tokens no target can be met: no step, and all of the largest target is missed.
    """
    K = len(targets)
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not total:
        return [], float(np.max(targets))
    pairs = [(i, j) for i in range(K) for j in range(i, K)]

    def measure(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        held = rows.select("n_tokens", "p", rate(F.col("p"), steps).alias("r"))
        w, p, r = F.col("n_tokens") / float(total), F.col("p"), F.col("r")
        row = held.agg(*[F.sum(w * r * p[k]) for k in range(K)], *[F.sum(F.when(r > 0, w * p[i] * p[j]).otherwise(0.0)) for i, j in pairs]).first()
        moments = np.zeros((K, K))
        for (i, j), x in zip(pairs, row[K:], strict=True):
            moments[i, j] = moments[j, i] = x
        return np.array(row[:K], float), moments

    steps: list[np.ndarray] = []
    shares, moments = measure(steps)
    length, tries, scaled = 1.0, 0, True
    while tries < rounds and np.abs(shares - targets).max() > tolerance:
        tries += 1
        metric = moments + 1e-9 * np.eye(K) if scaled else np.trace(moments) * np.eye(K)
        step = length * np.linalg.solve(metric, shares - targets)
        now, then = measure([*steps, step])
        if np.square(now - targets).sum() < np.square(shares - targets).sum():
            steps.append(step)
            shares, moments, length = now, then, min(1.0, 2 * length)
        elif length > 1e-2:
            length /= 2
        elif scaled:
            length, scaled = 1.0, False
        else:
            break
    return steps, float(np.abs(shares - targets).max())


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = 6000, seed: int = 17) -> DataFrame:
    """doc_id, n_tokens, p_good, p_poor, p_toxic, rate, copies, miss of every row (and rid, the row's number).

    ``copies`` rounds the rate up or down by a hash of doc_id, so its
    expectation is the rate. ``miss`` is the largest distance of a domain's
    share from its target over all rows: above the fit's tolerance no
    nonnegative rates were found that meet the targets. Defined cases: a null or empty text has no tokens,
    the posteriors of an empty text and so some rate that weighs nothing. A
    label with a null key or null values teaches nothing; of several labels of
    one document the first domain by name counts. Without labels all
    posteriors are equal and the least miss is taken. Repeated rows are rows
    of their own. Empty table: empty result. Extra columns are ignored.
    """
    wanted = np.array([(targets or TARGETS).get(d, 0.0) for d in DOMAINS])
    rows = materialize(posteriors(docs, train(docs, labels, sample)), "posteriors")
    steps, miss = fit_rates(rows.select("n_tokens", "p"), wanted / wanted.sum())
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("rate", rate(F.col("p"), steps)).select(
        "rid", "doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", F.floor(F.col("rate") + uniform).cast("int").alias("copies"), F.lit(miss).alias("miss")
    )


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, sample: int = 6000, seed: int = 17, tolerance: float = 1e-3) -> DataFrame:
    """The documents as often as their ``copies`` (see ``mix``) say, with the columns of ``docs``.

    The posteriors are written beside the rows, so texts are classified once and not joined.
    A miss of the targets beyond ``tolerance`` is warned of.

    Defined cases: nulls, empty and long texts, labels and repeated rows as in
    ``mix``; repeated rows and rows with a null doc_id are rounded alike, as
    their hashes agree. Without labels all rows have one rate. Empty table:
    empty result. All columns return, whatever their names.
    """
    wanted = np.array([(targets or TARGETS).get(d, 0.0) for d in DOMAINS])
    names = docs.columns
    place = names.index("text")
    handle = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in text_bytes(batch.column(place))]
            p = [handle.value.posteriors(f[0], f[1]).tolist() for f in found]
            extra = [pa.array([f[2] for f in found], pa.int64()), pa.array(p, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *extra], [*names, n_tokens, p_of])

    n_tokens, p_of, copies, copy = fresh(names, "n_tokens", "p", "copies", "copy")
    schema = T.StructType([*docs.schema.fields, T.StructField(n_tokens, T.LongType()), T.StructField(p_of, T.ArrayType(T.DoubleType()))])
    rows = materialize(docs.mapInArrow(work, schema), "posteriors")
    steps, miss = fit_rates(rows.select(F.col(n_tokens).alias("n_tokens"), F.col(p_of).alias("p")), wanted / wanted.sum())
    if miss > tolerance:
        warnings.warn(f"no rates found that meet the target weights: a domain's share is {miss:.4f} off", stacklevel=2)
    uniform = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumn(copies, F.floor(rate(F.col(p_of), steps) + uniform).cast("int")).where(F.col(copies) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in names])
