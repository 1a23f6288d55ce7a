"""Hidden Markov language model over whole documents.

Counts of all training tokens are aggregated across partitions. Latent states
emit symbols: each of the most frequent words is a symbol of its own, every
other word emits the class of its last three bytes, and a class gives its words
shares by their exact counts. Baum-Welch counts of every training document are
summed over partitions, a round a job; a scaled forward recursion then gives
the exact log likelihood of each whole text. Both run over whole texts: long
ones in segments, whose borders carry what lies before and after them.

The counts of the most frequent words, ``HEAD`` at most, are broadcast.
All other words, which are rare by construction, get their exact counts in a
join, a row for each document and word, so no vocabulary size is assumed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remainder, text_bytes
from .tokens import in_blocks
from .vectors import summed

HEAD = 1 << 17
WORDS = 1 << 13
CLASSES = 1 << 10
SEGMENT = 512
LONG = 4096
ROOM = 0.1


def token_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long) over all rows of ``docs`` (text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return batch

        for batch in batches:
            for block in in_blocks(text_bytes(batch.column(0))):
                for t in block:
                    held.update(t.lower().split())
                if len(held) > 400_000:
                    yield out()
        if held:
            yield out()

    slim = docs.select(F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


@dataclass
class Vocabulary:
    """Bounded statistics of the training tokens. Symbol 0 is a text's end, 1 to ``words`` are words, classes follow."""

    words: int
    classes: int
    rank: dict[bytes, int]  # of the most frequent words
    count: np.ndarray  # by rank
    symbol: np.ndarray  # by rank
    mass: np.ndarray  # by symbol: count and room for words not seen
    ends: int
    total: int
    distinct: int

    @property
    def log_mass(self) -> np.ndarray:
        """log10 of the mass of each class; 0 for symbols that are words."""
        out = np.zeros(len(self.mass))
        out[1 + self.words :] = np.log10(self.mass[1 + self.words :])
        return out


def vocabulary(counts: DataFrame, ends: int, most: int = HEAD, words: int = WORDS, classes: int = CLASSES) -> Vocabulary:
    sums = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    # The words of the highest counts, by steps of the logarithm: as many steps as hold at most ``most`` words.
    level = F.floor(F.log(F.col("c")) * 64).cast("int")
    least, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        held += r["n"]
        if held > most:
            break
        least = r["level"]
    head = [] if least is None else sorted(counts.where(level >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    rank = {bytes(r["word"]): i for i, r in enumerate(head)}
    count = np.array([r["c"] for r in head], np.int64)
    symbol = np.array([i + 1 if i < words else 1 + words + class_of(w, classes) for w, i in rank.items()], np.int64)
    tail = F.expr(f"CAST(crc32(CASE WHEN octet_length(word) > 3 THEN substring(word, octet_length(word) - 2, 3) ELSE word END) % {classes} AS INT)")
    mass = np.zeros(1 + words + classes)
    mass[0] = ends + ROOM
    for r in counts.groupBy(tail.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[1 + words + r["k"]] = r["c"] + ROOM * r["n"]
    for w, i in list(rank.items())[:words]:
        mass[1 + i] = count[i] + ROOM
        mass[1 + words + class_of(w, classes)] -= count[i] + ROOM
    mass[1 + words :] = np.maximum(mass[1 + words :], 0) + ROOM
    return Vocabulary(words, classes, rank, count, symbol, mass, ends, int(sums[1]) + ends, int(sums[0]) + (ends > 0))


def symbol_table(docs: DataFrame, vocab, folds: int) -> DataFrame:
    """Each row's symbols, what the head's counts give, and its other words with their numbers."""
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, part double, ids binary, words array<binary>, times array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        get = v.rank.get
        log_count = np.log10(v.count + ROOM)
        inner = v.symbol > v.words
        end_log = np.log10(v.ends + ROOM)
        for batch in batches:
            done = 0
            for block in in_blocks(text_bytes(batch.column(3))):
                out: list[list] = [[] for _ in range(7)]
                for t in block:
                    words = t.lower().split()
                    ranks = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                    ids = np.zeros(len(words) + 1, np.uint16)
                    known = ranks >= 0
                    at = ranks[known]
                    ids[:-1][known] = v.symbol[at]
                    missing = np.flatnonzero(~known).tolist()
                    for i in missing:
                        ids[i] = 1 + v.words + class_of(words[i], v.classes)
                    rare = Counter(words[i] for i in missing)
                    logs = log_count[at]
                    row = (len(words) + 1, len(at) + (v.ends > 0), float(logs.sum() + end_log), float(logs[inner[at]].sum()), ids.tobytes(), list(rare), list(rare.values()))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                kept = [batch.column(i).slice(done, len(block)) for i in range(3)]
                done += len(block)
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(out, types, strict=True))], [f.split()[0] for f in schema.split(", ")])

    slim = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        (remainder("doc_id", folds) == 0).alias("held_out"), F.col("text").cast("binary").alias("text"),
    )
    return slim.mapInArrow(work, schema)


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K, each column a distribution

    @property
    def states(self) -> int:
        return len(self.start)


def segments(ids: list[np.ndarray], length: int | None = None):
    """All texts in segments of at most ``length``: flat symbols, offsets, lengths, whether each begins and ends a text."""
    length = length or SEGMENT
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    sizes = np.array([len(x) for x in ids], np.int64)
    n = -(-sizes // length)
    starts = np.cumsum(sizes) - sizes
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    off = np.repeat(starts, n) + k * length
    lens = np.minimum(length, np.repeat(starts + sizes, n) - off)
    return flat, off, lens, k == 0, k == np.repeat(n, n) - 1


def _borders(model: Model, flat: np.ndarray, off: np.ndarray, lens: np.ndarray, first: np.ndarray, last: np.ndarray):
    """What lies before and after each segment, as the whole text has it.

    ``before``: the distribution of a segment's first state given all symbols
    before it; ``after``: the likelihood of all symbols after it by its last
    state, up to a factor. Also the expected moves across all borders. Segments
    of texts with several are reduced to products of their steps, which are
    put together from both ends: the forward and backward recursions of whole
    texts, associated differently.
    """
    K = model.states
    before, after, moved = np.tile(model.start, (len(off), 1)), np.ones((len(off), K)), np.zeros((K, K))
    several = np.flatnonzero(~(first & last))
    if not len(several):
        return before, after, moved
    products = np.empty((len(several), K, K))
    for at in range(0, len(several), 512):
        pick = several[at : at + 512]
        order = np.argsort(-lens[pick], kind="stable")
        o, n = off[pick][order], lens[pick][order]
        m = np.eye(K) * model.emit[flat[o]][:, None, :]
        active = np.searchsorted(-n, -np.arange(n[0]), side="left")
        for t in range(1, n[0]):
            a = active[t]
            m[:a] = (m[:a].reshape(-1, K) @ model.move).reshape(-1, K, K) * model.emit[flat[o[:a] + t]][:, None, :]
            if t % 16 == 0:
                m[:a] /= m[:a].max(axis=(1, 2), keepdims=True)
        products[at + order] = m / m.max(axis=(1, 2), keepdims=True)
    begins = np.flatnonzero(first[several])
    counts = np.diff(np.r_[begins, len(several)])
    ends = np.empty((len(several), K))  # filtered distribution at each segment's last symbol
    state = np.tile(model.start, (len(begins), 1))
    for j in range(counts.max()):
        live = np.flatnonzero(counts > j)
        at = begins[live] + j
        before[several[at]] = state[live]
        a = np.einsum("nk,nkl->nl", state[live], products[at])
        ends[at] = a / a.sum(axis=1, keepdims=True)
        state[live] = ends[at] @ model.move
    later = np.ones((len(begins), K))
    for j in range(counts.max() - 1, -1, -1):
        live = np.flatnonzero(counts > j)
        at = begins[live] + j
        after[several[at]] = later[live]
        w = np.einsum("nkl,nl->nk", products[at], later[live])
        w /= w.max(axis=1, keepdims=True)
        later[live] = w @ model.move.T
        if j:  # the border to the segment before
            joint = ends[at - 1][:, :, None] * model.move * w[:, None, :]
            moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return before, after, moved


def expected(model: Model, ids: list[np.ndarray], total: np.ndarray, block: int = 1 << 18) -> None:
    """Add the expected counts of all whole texts to ``total``: starts, moves, emissions, log likelihood.

    Segments advance together, about ``block`` symbols at a time.
    """
    K, S = model.states, len(model.emit)
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    flat, off, lens, first, last = segments(ids)
    if not len(off):
        return
    before, after, across = _borders(model, flat, off, lens, first, last)
    total[K : K + K * K] += across.ravel()
    order = np.argsort(-lens, kind="stable")
    emissions = total[K + K * K : -1].reshape(K, S)
    at = 0
    while at < len(order):
        pick = order[at : at + max(1, block // int(lens[order[at]]))]
        at += len(pick)
        o, n = off[pick], lens[pick]
        steps = int(n[0])
        active = np.searchsorted(-n, -np.arange(steps), side="left")
        alphas, scales, symbols = [], [], []
        a = before[pick].astype(np.float32)
        final = np.empty((len(pick), K))
        for t in range(steps):
            m = active[t]
            s = flat[o[:m] + t]
            a = (a[:m] if t == 0 else a[:m] @ move) * emit[s]
            c = a.sum(axis=1, keepdims=True)
            a /= c
            alphas.append(a), scales.append(c), symbols.append(s)
            final[:m] = a
        total[-1] += sum(float(np.log(c, dtype=np.float64).sum()) for c in scales)
        # What follows a segment weighs its last states; scaled so that each place's states add up to 1.
        tails = after[pick]
        tails = (tails / (final * tails).sum(axis=1, keepdims=True)).astype(np.float32)
        moved = np.zeros((K, K))
        beta = tails[: active[-1]]
        gammas = [alphas[-1] * beta]
        for t in range(steps - 2, -1, -1):
            m = active[t + 1]
            then = emit[symbols[t + 1]] * beta / scales[t + 1]
            moved += alphas[t][:m].T @ then
            beta = np.concatenate([then @ move.T, tails[m : active[t]]])
            gammas.append(alphas[t] * beta)
        total[K : K + K * K] += (moved * model.move).ravel()
        total[:K] += gammas[-1][first[pick]].sum(axis=0)
        gamma, s = np.concatenate(gammas[::-1]), np.concatenate(symbols)
        for k in range(K):
            emissions[k] += np.bincount(s, weights=gamma[:, k], minlength=S)


def maximized(total: np.ndarray, K: int, base: np.ndarray, prior: float = 50.0) -> Model:
    """The model of expected counts, with ``prior`` tokens of the base distribution in each state."""
    start = total[:K] + 0.1
    move = total[K : K + K * K].reshape(K, K) + 0.1
    emit = total[K + K * K : -1].reshape(K, -1) + prior * base
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), (emit / emit.sum(axis=1, keepdims=True)).T.copy())


def initial(sample: list[np.ndarray], K: int, base: np.ndarray, rounds: int = 20, seed: int = 11) -> Model:
    """Baum-Welch over a bounded sample of segments, from random emissions and states that tend to stay."""
    rng = np.random.default_rng(seed)
    emit = base[:, None] * rng.gamma(1.0, 1.0, (len(base), K))
    model = Model(np.full(K, 1 / K), np.full((K, K), 0.1 / K) + 0.9 * np.eye(K), emit / emit.sum(axis=0))
    for _ in range(rounds if sample else 0):
        total = np.zeros(K + K * K + K * len(base) + 1)
        expected(model, sample, total)
        model = maximized(total, K, base)
    return model


def drawn_segments(rows: DataFrame, share: float) -> DataFrame:
    """(order long, ids binary): segments of all texts of ``rows`` (rid, ids), wherever they lie, each with probability ``share``."""
    bound = np.uint64(min(1.0, share) * ((1 << 32) - 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x.as_py(), np.uint16) for x in b.column(1)]
            flat, off, lens, first, _ = segments(ids)
            n = np.array([-(-len(x) // SEGMENT) for x in ids], np.int64)
            h = np.repeat(b.column(0).to_numpy(), n).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h += (np.arange(len(off)) - np.maximum.accumulate(np.where(first, np.arange(len(off)), 0))).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for shift in (31, 29):
                h ^= h >> np.uint64(shift)
                h *= np.uint64(0xBF58476D1CE4E5B9)
            picked = np.flatnonzero((h >> np.uint64(32)) <= bound)
            out = [flat[off[i] : off[i] + lens[i]].tobytes() for i in picked.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array((h[picked] >> np.uint64(1)).astype(np.int64)), pa.array(out, pa.binary())], ["order", "ids"])

    return rows.select("rid", "ids").mapInArrow(work, "order long, ids binary")


def _transfer(model: Model, ids: np.ndarray, length: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Scaled products of the steps of each run of ``length`` symbols: (runs, K, K) and the logs of their scales."""
    K, runs = model.states, -(-len(ids) // length)
    a = np.tile(np.eye(K), (runs, 1, 1))
    logs = np.zeros((runs, K))
    for t in range(length):
        m = runs if (runs - 1) * length + t < len(ids) else runs - 1
        if not m:
            break
        a[:m] = (a[:m] @ model.move) * model.emit[ids[t::length][:m]][:, None, :]
        c = a[:m].sum(axis=2)
        a[:m] /= c[:, :, None]
        logs[:m] += np.log(c)
    return a, logs


def log_likelihoods(model: Model, ids: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of whole texts by the scaled forward recursion.

    Texts advance together, a step at a time. A text of over ``LONG`` symbols
    takes its steps in runs, one for each state that it may start from, which
    are then put together: the same recursion, associated differently.
    """
    out = np.zeros(len(ids))
    sizes = np.array([len(x) for x in ids], np.int64)
    short = np.flatnonzero((sizes <= LONG) & (sizes > 0))
    short = short[np.argsort(-sizes[short], kind="stable")]
    if len(short):
        flat = np.concatenate([ids[i] for i in short])
        n = sizes[short]
        off = np.r_[0, np.cumsum(n)[:-1]]
        active = np.searchsorted(-n, -np.arange(n[0]), side="left")
        a = np.tile(model.start, (len(short), 1))
        found = np.zeros(len(short))
        for t in range(n[0]):
            m = active[t]
            a = (a[:m] if t == 0 else a[:m] @ model.move) * model.emit[flat[off[:m] + t]]
            c = a.sum(axis=1)
            a /= c[:, None]
            found[:m] += np.log(c)
        out[short] = found
    for i in np.flatnonzero(sizes > LONG):
        a = model.start * model.emit[ids[i][0]]
        c = a.sum()
        a, log = a / c, np.log(c)
        for product, logs in zip(*_transfer(model, ids[i][1:]), strict=True):
            top = logs.max()
            a = (a * np.exp(logs - top)) @ product
            c = a.sum()
            a, log = a / c, log + top + np.log(c)
        out[i] = log
    return out / np.log(10)


def score(docs: DataFrame, folds: int = 10, states: int = 8, rounds: int = 3, sample: int = 1000, bounds: tuple[int, int, int] = (HEAD, WORDS, CLASSES)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from the rows of ``docs`` (doc_id, text) whose key's crc32 modulo
    ``folds`` is not 0. ``sample`` bounds the segments, drawn from all places
    of all training texts, from which Baum-Welch starts; its ``rounds`` over
    the corpus then use every token of every whole training text.

    Defined cases: a null or empty text has the end alone. Repeated rows are
    scored (and learned from) one by one. A null doc_id counts as the empty
    key. Without training rows every token has the probability of an unseen
    one. Empty table: empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text")
    training = slim.where(remainder("doc_id", folds) != 0)
    counts = materialize(token_counts(training), "counts")
    vocab = vocabulary(counts, training.count(), *bounds)
    known = spark.sparkContext.broadcast(vocab)
    rows = materialize(symbol_table(slim, known, folds), "symbols")

    base = vocab.mass / vocab.mass.sum()
    learn = rows.where("not held_out")
    drawn = drawn_segments(learn, 1.2 * sample / max(1, vocab.ends + vocab.total // SEGMENT))
    first = [np.frombuffer(r["ids"], np.uint16) for r in sorted(drawn.collect(), key=lambda r: (r["order"], bytes(r["ids"])))[:sample]]
    model = initial(first, states, base)
    for _ in range(rounds if vocab.ends else 0):
        now = spark.sparkContext.broadcast(model)

        def add(batch: pa.RecordBatch, total: np.ndarray, now=now) -> None:
            expected(now.value, [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(0)], total)

        total = summed(learn.select("ids"), add, states + states * states + states * len(base) + 1)
        model = maximized(total, states, base)

    final = spark.sparkContext.broadcast((model, vocab.log_mass))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, log_mass = final.value
        for batch in batches:
            ids = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(6)]
            found = log_likelihoods(m, ids) - np.array([log_mass[x].sum() for x in ids])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(found)], ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "s"])

    scored = rows.select("rid", "doc_id", "held_out", "n_tokens", "n_known", F.array("base", "part").alias("base"), "ids").mapInArrow(
        work, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base array<double>, s double"
    )
    rare = rows.select("rid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    joined = rare.join(counts, "word", "left")
    of_row = joined.groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ROOM))).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen")
    )
    log, seen = F.coalesce("log", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    room = float(np.log10(vocab.total + ROOM * (vocab.distinct + 1)))
    return scored.join(of_row, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base")[0] + log - F.col("n_tokens") * room).alias("base_score"), (F.col("s") + F.col("base")[1] + log).alias("score"),
    )
