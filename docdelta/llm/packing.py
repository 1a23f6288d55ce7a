"""Lexical retrieval packing of whole documents into training sequences.

Documents become token ids once. They are dealt into shards of bounded size by
a tree of cuts through their weighted terms (in a random projection), so that
lexical neighbours mostly meet; each shard holds a BM25 inverted index over its documents' token
ids, with document frequencies and the mean length counted over all documents.
A seed document opens a window; the index returns its best unused neighbours,
which fill the window greedily. A document that doesn't fit is cut and its rest
opens the next window, so inner sequences carry no padding at all; what is left
at a shard's end is laid out in sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_bytes
from .tokens import END, default_path, encoder, in_blocks, source_of
from .vectors import summed

WINDOW = 4096
K1, B = 1.2, 0.75
HEAD = 64
DIM = 64
SAMPLE, PER_SHARD = 1 << 16, 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id long, ids binary, n long) of every row; each document's ids end in id 2."""
    source = docs.sparkSession.sparkContext.broadcast(source_of(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(source.value)
        end = np.array([END], encode.dtype).tobytes()
        for batch in batches:
            done = 0
            for block in in_blocks(text_bytes(batch.column(1)), 1 << 24):
                ids = [x + end for x in encode.encode(block)]
                n = [len(x) // encode.dtype.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(block)), pa.array(ids, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "ids", "n"]
                )
                done += len(block)
                pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        work, "doc_id long, ids binary, n long"
    )


def counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids of each document in turn (ascending), how often each occurs there, and how many a document has."""
    found = [_counted(b) for b in in_blocks(docs, 1 << 20)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(docs) == 1:
        terms, tf = np.unique(docs[0], return_counts=True)
        return terms.astype(np.int64), tf, np.array([len(terms)])
    bits = 8 * docs[0].dtype.itemsize
    kind = np.uint32 if bits == 16 and len(docs) <= 1 << 16 else np.uint64
    keys = np.repeat(np.arange(len(docs), dtype=kind), [len(d) for d in docs]) << kind(bits) | np.concatenate(docs)
    keys.sort()  # one sort for all documents
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    tf = np.diff(np.r_[at, len(keys)])
    keys = keys[at]
    return (keys & kind((1 << bits) - 1)).astype(np.int64), tf, np.bincount((keys >> kind(bits)).astype(np.int64), minlength=len(docs))


class ShardIndex:
    """Inverted index of one shard; a document's terms are its distinct token ids."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.idf = idf
        term, tf, sizes = counted(docs)
        self.terms = np.split(term, np.cumsum(sizes)[:-1])
        doc = np.repeat(np.arange(len(docs)), sizes)
        length = np.repeat([len(d) for d in docs], sizes)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.at = doc[order].astype(np.int32), weight[order], term[order]
        self.starts = np.searchsorted(self.at, np.arange(len(idf) + 1))
        held = np.diff(self.starts)
        self.wide = {}  # weights of frequent terms in all documents
        for t in np.flatnonzero(8 * held > len(docs)).tolist():
            a, b = self.starts[t], self.starts[t + 1]
            self.wide[t] = np.zeros(len(docs))
            self.wide[t][self.doc[a:b]] = self.weight[a:b]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents of the shard against the seed's terms."""
        terms = self.terms[seed]
        spans = zip(terms.tolist(), self.starts[terms].tolist(), self.starts[terms + 1].tolist(), strict=True)
        wide, rare = [], []
        for t, a, b in spans:
            rare.append(slice(a, b)) if t not in self.wide else wide.append(self.wide[t])
        if not rare:
            return np.sum(wide, axis=0)
        out = np.bincount(np.concatenate([self.doc[s] for s in rare]), np.concatenate([self.weight[s] for s in rare]), len(self.terms))
        for row in wide:
            out += row
        return out

    def ranked(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """The unused documents that share a term with the seed, from best to worst; the first ones are sorted alone."""
        scores = self.scores(seed)
        scores[used] = 0
        if len(scores) > HEAD and (least := np.partition(scores, -HEAD)[-HEAD]) > 0:
            head = np.flatnonzero(scores >= least)
            yield from head[np.argsort(-scores[head], kind="stable")].tolist()
            scores[head] = 0
        order = np.argsort(-scores, kind="stable")
        yield from order[: np.count_nonzero(scores)].tolist()


def term_vectors(docs: list[np.ndarray], idf: np.ndarray, mean: float, plane: np.ndarray) -> np.ndarray:
    """Unit vectors of documents: their BM25 term weights through a random projection."""
    out = np.zeros((len(docs), plane.shape[1]), np.float32)
    rows = iter(out)
    for block in in_blocks(docs, 1 << 20):
        terms, tf, sizes = counted(block)
        length = np.repeat([len(d) for d in block], sizes)
        weight = (idf[terms] * tf / (tf + K1 * (1 - B + B * length / mean))).astype(np.float32)
        ends = np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            next(rows)[:] = weight[a:b] @ plane[terms[a:b]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Tree:
    """Cuts across the widest direction of a sample, to ``shards`` leaves of like weight.

    A leaf that equal documents make too heavy is dealt on over several shards.
    """

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, shards: int) -> None:
        self.directions, self.cuts, self.children, heavy = [], [], [], []
        fair = max(weights.sum() / shards, 1e-9)

        def grow(rows: np.ndarray, k: int) -> int:
            if k == 1 or len(rows) < 2:
                heavy.append(max(1, round(weights[rows].sum() / fair)))
                return -len(heavy)
            v = vectors[rows].astype(np.float64)
            direction = np.linalg.eigh(np.cov(v.T))[1][:, -1].astype(np.float32)
            along = np.einsum("ij,j->i", vectors[rows], direction)
            order = np.argsort(along, kind="stable")
            total = np.cumsum(weights[rows][order])
            cut = along[order[min(np.searchsorted(total, total[-1] * (k // 2) / k), len(rows) - 1)]]
            node = len(self.cuts)
            self.directions.append(direction)
            self.cuts.append(cut)
            self.children.append([0, 0])
            self.children[node] = [grow(rows[along <= cut], k // 2), grow(rows[along > cut], k - k // 2)]
            return node

        self.root = grow(np.arange(len(vectors)), shards)
        self.directions, self.cuts, self.children = np.array(self.directions), np.array(self.cuts), np.array(self.children)
        self.shards = np.array(heavy)
        self.first = np.cumsum(self.shards) - self.shards

    def shard(self, vectors: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        node = np.full(len(vectors), self.root)
        while len(at := np.flatnonzero(node >= 0)):
            along = np.einsum("ij,ij->i", vectors[at], self.directions[node[at]])
            node[at] = self.children[node[at], (along > self.cuts[node[at]]).astype(int)]
        leaf = -node - 1
        return self.first[leaf] + (hashes % self.shards[leaf].astype(np.uint64)).astype(np.int64)


def dealt_by_terms(tokens: DataFrame, docs: int, shards: int, idf, mean: float, dtype: np.dtype) -> DataFrame:
    """(shard, doc_id, ids): the token table with the shard of each document."""
    size = len(idf.value)

    def plane() -> np.ndarray:
        return np.random.default_rng(0).standard_normal((size, DIM), np.float32)

    def vectors(batch: pa.RecordBatch, plane: np.ndarray) -> np.ndarray:
        return term_vectors([np.frombuffer(x.as_py(), dtype) for x in batch.column("ids")], idf.value, mean, plane)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plane()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("n"), pa.array([v.tobytes() for v in vectors(b, p)], pa.binary())], ["n", "vector"])

    share = min(1.0, min(SAMPLE, PER_SHARD * shards) / docs)
    sample = tokens.where(F.pmod(F.xxhash64("ids", "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else tokens
    rows = sample.select("ids", "n").mapInArrow(sampled, "n long, vector binary").collect()
    rows = sorted((bytes(r.vector), r.n) for r in rows)  # the same tree whatever the order of rows
    found = np.frombuffer(b"".join(v for v, _ in rows), np.float32).reshape(-1, DIM)
    tree = tokens.sparkSession.sparkContext.broadcast(Tree(found, np.array([n for _, n in rows], float), shards))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plane()
        for b in batches:
            shard = tree.value.shard(vectors(b, p), b.column("hash").to_numpy().view(np.uint64) >> np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), b.column("doc_id"), b.column("ids")], ["shard", "doc_id", "ids"])

    # The row's number parts equal rows, which would else all meet in one shard.
    return tokens.select(F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("hash"), "doc_id", "ids").mapInArrow(deal, "shard long, doc_id long, ids binary")


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces in turn, as sequences of the powers of two that their sum consists of."""
    rest = sum(p[2] for p in pieces)
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for doc, start, length in pieces:
        while length:
            if not room:
                room = 1 << (rest.bit_length() - 1)
                rest -= room
                out.append([])
            take = min(room, length)
            out[-1].append((doc, start, take))
            start, length, room = start + take, length - take, room - take
    return out


def fill(lengths: list[int], neighbours, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every document whole.

    ``neighbours(seed, used)`` gives documents from best to worst. Where none is
    left, the first unused document in order stands in.
    """
    used = np.zeros(len(lengths), bool)
    sequences: list[list[tuple[int, int, int]]] = []
    free = 0

    def take_next(ranked) -> int | None:
        nonlocal free
        doc = next((d for d in ranked if not used[d]), None)
        if doc is None:
            while free < len(lengths) and used[free]:
                free += 1
            doc = free if free < len(lengths) else None
        if doc is not None:
            used[doc] = True
        return doc

    doc, start = take_next(iter(())), 0
    while doc is not None:
        now, room, ranked = [], window, None
        seed = doc
        while doc is not None and room:
            take = min(room, lengths[doc] - start)
            now.append((doc, start, take))
            room, start = room - take, start + take
            if start == lengths[doc]:
                if room and ranked is None:
                    ranked = iter(neighbours(seed, used))
                doc, start = take_next(ranked if ranked is not None else iter(())), 0
        sequences += [now] if not room else _powers(now)
    return sequences


def pack_shard(shard: int, doc_ids: list, ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> dict[str, list]:
    """The pieces of one shard. Documents are taken in the order given."""
    index = ShardIndex(ids, idf, mean)
    out: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}
    wide = [np.ascontiguousarray(x, "<u4") for x in ids]
    for k, sequence in enumerate(fill([len(x) for x in ids], index.ranked, window)):
        offset = 0
        for doc, start, length in sequence:
            row = (doc_ids[doc], start, length, zlib.crc32(wide[doc][start : start + length]), len(ids[doc]), (shard << 32) + k, offset)
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
            offset += length
    return out


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = 2_000_000) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Defined cases: a null or empty text is its end id alone. Repeated
    rows and a null doc_id are packed like any other row. A very long text is
    cut into as many pieces as it takes. Empty table: empty result. Extra
    columns are ignored. A shard is expected to hold ``shard_tokens`` ids, or
    one longer document.
    """
    spark = docs.sparkSession
    path = path or default_path()
    tokens = materialize(token_table(docs, path), "tokens")
    total = tokens.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if not total["docs"]:
        return spark.createDataFrame([], PIECES)
    encode = encoder(path)
    dtype, size = encode.dtype, encode.tokenizer.get_vocab_size()
    mean = total["n"] / total["docs"]

    def add(batch: pa.RecordBatch, df: np.ndarray) -> None:
        for x in batch.column(0):
            df[np.frombuffer(x.as_py(), dtype)] += 1  # an id that repeats counts once

    df = summed(tokens.select("ids"), add, size)
    idf = spark.sparkContext.broadcast(np.log(1 + (total["docs"] - df + 0.5) / (df + 0.5)))
    shards = max(1, -(-total["n"] // shard_tokens))

    def work(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        doc_ids = group.column("doc_id").to_pylist()
        ids = [np.frombuffer(x, dtype) for x in group.column("ids").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(doc_ids[i]).encode()), doc_ids[i] is None, doc_ids[i] or 0, ids[i].tobytes()))
        packed = pack_shard(shard, [doc_ids[i] for i in order], [ids[i] for i in order], idf.value, mean, window)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in packed.items()})

    if shards > 1:
        dealt = dealt_by_terms(tokens, total["docs"], shards, idf, mean, dtype)
    else:
        dealt = tokens.select(F.lit(0).cast("long").alias("shard"), "doc_id", "ids")
    return dealt.groupBy("shard").applyInArrow(work, PIECES)
