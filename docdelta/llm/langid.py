"""Language identification with a byte convolutional network in numpy.

Bytes are embedded, convolved by filters of several widths, max-pooled over a
window of fixed length and classified by a softmax. The network is trained on
the driver from a bounded sample of labelled rows (``per_lang`` rows a
language); it is applied to all windows of every whole text, and the window
posteriors are averaged by the number of bytes that each window holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

LENGTH = 256
PAD = 256
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def windows(data: bytes, length: int = LENGTH, overlap: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text as rows of byte values (PAD beyond its end), and the bytes that each adds."""
    step = length - overlap
    n = max(1, -(-max(0, len(data) - overlap) // step))
    padded = np.full((n - 1) * step + length, PAD, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, length)[::step]
    held = np.minimum(length, len(data) - step * np.arange(n)).astype(np.float64)
    return rows, np.maximum(held, 1.0)


@dataclass
class ByteCNN:
    """Widths x filters convolutions over embedded bytes, max pooling, softmax."""

    classes: list[str]
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    dim: int = 8
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.p:
            return
        rng = np.random.default_rng(self.seed)
        self.p["emb"] = rng.normal(0, 0.5, (257, self.dim)).astype(np.float32)
        self.p["emb"][PAD] = 0
        for w in self.widths:
            self.p[f"w{w}"] = rng.normal(0, (w * self.dim) ** -0.5, (w * self.dim, self.filters)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(self.filters, np.float32)
        hidden = len(self.widths) * self.filters
        self.p["out"] = rng.normal(0, hidden**-0.5, (hidden, len(self.classes))).astype(np.float32)
        self.p["bias"] = np.zeros(len(self.classes), np.float32)

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Max-pooled activations of (n, length) windows; with ``where`` also the winning positions."""
        emb = self.p["emb"][rows.T]  # position first: pooling then runs over long contiguous rows
        length, n = rows.shape[1], rows.shape[0]
        found, at = [], []
        for w in self.widths:
            span = length - w + 1
            x = np.concatenate([emb[j : j + span] for j in range(w)], axis=2).reshape(-1, w * self.dim)
            a = (x @ self.p[f"w{w}"]).reshape(span, n, self.filters)
            if where:
                at.append(a.argmax(axis=0))
            found.append(np.maximum(a.max(axis=0) + self.p[f"b{w}"], 0))
        return np.concatenate(found, axis=1), at

    def posteriors(self, rows: np.ndarray, block: int = 128) -> np.ndarray:
        out = np.empty((len(rows), len(self.classes)), np.float64)
        for k in range(0, len(rows), block):
            z = self.pooled(rows[k : k + block])[0] @ self.p["out"] + self.p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[k : k + block] = z / z.sum(axis=1, keepdims=True)
        return out

    def gradients(self, rows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; each pooled unit passes its gradient to the position that won."""
        n = len(rows)
        hidden, at = self.pooled(rows, where=True)
        z = hidden @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(n), target] -= 1
        d /= n
        g = {"out": hidden.T @ d, "bias": d.sum(axis=0), "emb": np.zeros_like(self.p["emb"])}
        back = (d @ self.p["out"].T) * (hidden > 0)
        for i, w in enumerate(self.widths):
            e = back[:, i * self.filters : (i + 1) * self.filters]
            bytes_at = rows[np.arange(n)[:, None, None], at[i][:, :, None] + np.arange(w)]  # n, filters, width
            x = self.p["emb"][bytes_at].reshape(n, self.filters, -1)
            g[f"w{w}"] = np.einsum("nf,nfk->kf", e, x)
            g[f"b{w}"] = e.sum(axis=0)
            dx = e[:, :, None] * self.p[f"w{w}"].T[None]
            np.add.at(g["emb"], bytes_at.reshape(-1), dx.reshape(-1, self.dim))
        g["emb"][PAD] = 0
        return g

    def fit(self, rows: np.ndarray, target: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.005) -> None:
        """Adam over class-balanced batches."""
        rng = np.random.default_rng(self.seed + 1)
        members = [np.flatnonzero(target == c) for c in range(len(self.classes))]
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, steps + 1):
            classes = rng.integers(0, len(members), batch)
            pick = np.array([rng.choice(members[c]) for c in classes])
            for k, g in self.gradients(rows[pick], target[pick]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                step = mean[k] / (1 - 0.9**t) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
                self.p[k] -= (rate * (1 - t / (steps + 1)) * step).astype(np.float32)


def train(docs: DataFrame, per_lang: int = 400, seed: int = 7, pieces: int = 4, most: int = 512) -> ByteCNN | None:
    """A network from at most ``per_lang`` rows of each language of ``docs`` (doc_id, text, lang).

    The rows are drawn by a hash of doc_id, so the sample doesn't depend on the
    order of rows; of each drawn text, up to ``pieces`` windows at hashed
    places are learned from. Of more than ``most`` languages the most frequent
    are learned. None if no row has both a text and a language.
    """
    labelled = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("string")).alias("h")
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.3 * per_lang + 20) / n))])
    uniform = (F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    text = F.col("text")
    piece = lambda k: F.substring(text, (F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.length(text) - LENGTH, F.lit(1))) + 1).cast("int"), F.lit(LENGTH))
    drawn = labelled.where(uniform < share[F.col("lang")]).select("lang", "h", F.array(*[piece(k) for k in range(pieces)]).alias("pieces"))
    by_lang: dict[str, list] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["h"], r["pieces"])):
        kept = by_lang.setdefault(r["lang"], [])
        if len(kept) < per_lang:
            kept.append(r["pieces"])
    classes = sorted(by_lang)
    rows, target = [], []
    for c, lang in enumerate(classes):
        for drawn_pieces in by_lang[lang]:
            for text in sorted(set(drawn_pieces)):
                if LETTER.search(text):
                    rows.append(windows(text.encode()[:LENGTH])[0][0])
                    target.append(c)
    if not rows:
        return None
    net = ByteCNN([classes[c] for c in sorted(set(target))], seed=seed)
    names = {c: i for i, c in enumerate(sorted(set(target)))}
    if len(net.classes) > 1:
        net.fit(np.stack(rows), np.array([names[c] for c in target]))
    return net


def predictor(net: ByteCNN | None):
    """A function from texts to (language, score) lists."""

    def predict(texts: list[str | None], most: int = 2048) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if net is None:
            return langs, scores
        sums = np.zeros((len(texts), len(net.classes)))
        total = np.zeros(len(texts))
        owner: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        weight: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if rows:
                who, w = np.concatenate(owner), np.concatenate(weight)
                np.add.at(sums, who, net.posteriors(np.concatenate(rows)) * w[:, None])
                np.add.at(total, who, w)
            owner.clear(), rows.clear(), weight.clear()
            held = 0

        for i, text in enumerate(texts):
            if text is None or not LETTER.search(text):
                continue
            r, w = windows(text.encode())
            for k in range(0, len(r), most):
                rows.append(r[k : k + most])
                weight.append(w[k : k + most])
                owner.append(np.full(len(rows[-1]), i))
                held += len(rows[-1])
                if held >= most:
                    flush()
        flush()
        for i in np.flatnonzero(total):
            best = int(sums[i].argmax())
            langs[i], scores[i] = net.classes[best], float(min(1.0, sums[i, best] / total[i]))
        return langs, scores

    return predict


def identify(docs: DataFrame, net: ByteCNN | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row. ``keep`` must not name either of these."""
    schema = docs.select(*keep, "text").schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1])
    handle = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(handle.value)
        for batch in batches:
            langs, scores = predict(batch.column(len(keep)).to_pylist())
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(work, f"{fields}, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 5, per_lang: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    Defined cases: a null text or one without a letter is ``und`` with score 0,
    and so is every row if nothing can be learned. Rows with a null lang are
    predicted, never learned from. Repeated rows give repeated results. A null
    doc_id counts as the empty key. Empty table: empty result. Extra columns
    are ignored.
    """
    slim = docs.select("doc_id", "text", "lang")
    net = train(slim.where(remainder("doc_id", folds) != 0), per_lang)
    return identify(slim, net).select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, least: float = 0.4, folds: int = 5) -> DataFrame:
    """The documents with an identified language (posterior of at least ``least``).

    Defined cases: a null text or one without a letter has no language and
    goes; so does every row if nothing can be learned. A null lang becomes the
    predicted one, any other (the empty string, too) stays. Rows with a null
    doc_id and repeated rows are judged by their texts like all others. Empty
    table: empty result. All columns return, whatever their names.
    """
    net = train(docs.select("doc_id", "text", "lang").where(remainder("doc_id", folds) != 0))
    names = docs.columns
    handle = docs.sparkSession.sparkContext.broadcast(net)
    place = names.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(handle.value)
        for batch in batches:
            langs, scores = predict(batch.column(place).to_pylist())
            good = np.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], bool)
            lang = [b if a is None else a for a, b in zip(batch.column(names.index("lang")).to_pylist(), langs, strict=True)]
            columns = [pa.array(lang, pa.string()) if c == "lang" else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(good))

    return docs.mapInArrow(work, docs.schema)
