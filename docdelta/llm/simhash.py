"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``2 * r`` bits have a common
variant at no more than ``r`` bits from either. So every distinct fingerprint
emits all variants within ``r`` (half the radius), equal variants meet in a
shuffle, and the distinct members of a variant's group are linked to its least
member. For r = 1 any group holds at most 65 distinct fingerprints, whatever
the data, so no group is ever hot and no group is expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdelta.sources.tables import drop_since, mark

from .common import fresh, materialize, shuffle_partitions, text_bytes
from .components import components

SEED = 42
BLOCK = 1 << 16
BANDS, ROWS = 20, 5
SMALL = 8
HOT, DRAWN = 1 << 18, 1 << 10
BINS, CELL = 256, 1024


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the ``width``-word shingles of lower-cased (A-Z) UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    elif width == 3:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id long, fp long) for every row; a text without words has fingerprint 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in text_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(work, "doc_id long, fp long")


def _masks(radius: int) -> list[int]:
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) at most ``distance`` bits apart.

    Every pair within the distance is connected through links of this result:
    pairs that share a variant are both linked to (or are) its least member,
    and each emitted link is verified. Odd distances use the next even ball
    and the verification alone decides, with all members of a ball tried
    against each other there.
    """
    spark = fps.sparkSession
    half = (distance + 1) // 2
    masks = _masks(half)
    rows = fps.count() * len(masks)
    parts = max(shuffle_partitions(spark), -(-rows // 2_000_000))
    mask_array = F.array(*[F.lit(m) for m in masks])
    variants = fps.select("fp", F.explode(mask_array).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp"
    )
    exact = distance == 2 * half

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not kept:
            return
        variant = np.concatenate([k[0] for k in kept])
        fp = np.concatenate([k[1] for k in kept])
        order = np.lexsort((fp, variant))
        variant, fp = variant[order], fp[order]
        starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
        sizes = np.diff(np.r_[starts, len(variant)])
        first = np.repeat(starts, sizes)
        if exact:
            u, v = fp, fp[first]
        else:
            shifts = [(fp[k:], fp[:-k], first[k:] == first[:-k]) for k in range(1, int(sizes.max()))]
            u = np.concatenate([a[m] for a, _, m in shifts]) if shifts else fp[:0]
            v = np.concatenate([b[m] for _, b, m in shifts]) if shifts else fp[:0]
        near = np.bitwise_count((u ^ v).view(np.uint64)) <= distance
        pairs = np.unique(np.stack([u, v], 1)[near & (u != v)], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

    return variants.repartition(parts, "variant").mapInArrow(work, "u long, v long").distinct()


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of lower-cased (A-Z) UTF-8 text (fewer words: of all of them)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    return np.unique(np.fromiter(map(partial(xxhash.xxh3_64_intdigest, seed=SEED), shingles), np.uint64, len(shingles)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of MinHashes; sets of Jaccard similarity s agree in one with probability 1 - (1 - s ** 5) ** 20."""
    a, b = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 4096):
        mixed = shingles[at : at + 4096] * (a * np.uint64(2) + np.uint64(1)) + b
        least = np.minimum(least, mixed.min(axis=1))
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def bins(shingles: np.ndarray) -> np.ndarray:
    """How many of the hashes fall into each of ``BINS`` classes; sets share no more than the sum of the lesser counts."""
    return np.bincount((shingles % np.uint64(BINS)).astype(np.int64), minlength=BINS).clip(max=65535).astype(np.uint16)


def sketched(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, tid, fp, keys) of every row of ``docs`` (doc_id, text): hash of the text, SimHash and band keys (null without words)."""
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), F.col("text").cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = np.zeros(b.num_rows, np.uint64), []
            for i, text in enumerate(text_bytes(b.column(2))):
                fps[i] = fingerprint(text)
                shingles = shingle_set(text, width)
                keys.append(band_keys(shingles).view(np.int64) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "tid", "fp", "keys"])

    return texts.mapInArrow(work, "doc_id long, tid long, fp long, keys array<long>")


def first_pairs(key: np.ndarray, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v) to try at first, and the keys of bands with more than ``SMALL + 1`` texts.

    All pairs of a smaller band; in a larger one each text with the least alone, so pairs grow with the members.
    """
    order = np.lexsort((tid, key))
    key, tid = key[order], tid[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    first = np.repeat(starts, sizes)
    at = np.arange(len(key))
    few = np.repeat(sizes <= SMALL + 1, sizes)
    u, v = [tid[at > first]], [tid[first[at > first]]]
    for k in range(1, SMALL + 1):
        m = few & (at - k > first)
        u.append(tid[m])
        v.append(tid[at[m] - k])
    found = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1), axis=0)
    return found, key[starts[sizes > SMALL + 1]]


def cross_pairs(table: pa.Table, limit: int, similarity: float) -> pa.Table:
    """Pairs (u, v) of one cell of a band that may be ``similarity`` similar, of texts with different roots.

    Of two roots' pairs the ``limit`` with the highest bounds return; a last row
    of nulls says that there were more.
    """
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    own, tid, root, n = (table[c].to_numpy() for c in ("own", "tid", "root", "n"))
    counts = np.frombuffer(b"".join(x.as_py() for x in table["bins"]), np.uint16).reshape(len(own), -1)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found: list[tuple[np.ndarray, ...]] = []
    for a in left.tolist():
        b = right[(root[right] != root[a]) & (np.minimum(n[right], n[a]) >= similarity * np.maximum(n[right], n[a]))]
        if i == j:
            b = b[b > a]
        if not len(b):
            continue
        most = np.minimum(counts[b], counts[a]).sum(axis=1, dtype=np.int64)
        bound = most / np.maximum(1, n[b] + n[a] - most)
        bound[(n[b] > 65535) | (n[a] > 65535)] = 1.0  # a count of theirs may be cut off
        near = bound >= similarity
        found.append((np.full(int(near.sum()), a), b[near], bound[near]))
    if not found:
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    a, b, bound = (np.concatenate(x) for x in zip(*found, strict=True))
    low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
    order = np.lexsort((-bound, high, low))
    new = np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])][: len(order)]
    starts = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    kept = order[rank < limit]
    more = [None] if len(kept) < len(order) else []
    u, v = np.minimum(tid[a], tid[b])[kept], np.maximum(tid[a], tid[b])[kept]
    return pa.table({"u": pa.array([*u.tolist(), *more], pa.int64()), "v": pa.array([*v.tolist(), *more], pa.int64())})


def cells(members: DataFrame, block: int) -> DataFrame:
    """Members of bands with texts of several roots, dealt so that any two of different roots meet in a cell (key, i, j).

    ``members`` has key, tid, root and more. The texts of a band's most frequent
    root need not meet each other: they are cut into blocks that meet only the
    blocks of all other texts. No cell holds much over two blocks.
    """
    of_root = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    tops = of_root.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c")).where("top.c < c")
    tops = tops.select("key", F.col("top.root").alias("top"), F.ceil(F.col("top.c") / block).alias("kt"), F.ceil((F.col("c") - F.col("top.c")) / block).alias("kr"))
    at = members.join(tops, "key").withColumn("is_top", F.expr("root = top"))
    at = at.withColumn("own", F.expr("if(is_top, kr + pmod(xxhash64(tid), kt), pmod(xxhash64(tid), kr))"))
    meets = F.expr("if(is_top, sequence(0L, kr - 1), sequence(0L, kr + kt - 1))")
    at = at.withColumn("other", F.explode(meets)).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return at.drop("top", "kt", "kr", "is_top", "other")


def similar_roots(docs: DataFrame, sketches: DataFrame, near: DataFrame, similarity: float = 0.8, width: int = 5, limit: int = 8) -> DataFrame:
    """(node, root) of fingerprints: components of the links ``near`` and of texts whose ``width``-word shingles have Jaccard similarity ``similarity`` or more.

    Candidates share a band of MinHashes (at 0.8 with probability 0.9996) and
    are verified on all shingles. In a band of up to ``SMALL + 1`` texts all are
    tried. In a larger one each is first tried against the least; what is in
    one component by then needs no more trials.
    All pairs of texts of different components that exact upper bounds (of
    sizes, of counts by class of hash) leave are tried next, the likeliest
    ``limit`` of two components first and more after each merging of
    components, until none is left. So no pair that shares a band is missed.
    """
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"), F.col("text").cast("binary").alias("text"))
    held = sketches.where("keys is not null").groupBy("tid").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    held = materialize(held, "sketches")
    parts = max(shuffle_partitions(spark), -(-held.count() * BANDS // 2_000_000))
    keys = held.select(F.explode("keys").alias("key"), "tid")
    # Ids of texts are hashes: one in DRAWN of them finds the bands that one task should not hold, which are split.
    drawn = keys.where(f"pmod(tid, {DRAWN}) = 0").groupBy("key").agg(F.count("*").alias("c")).where(f"c * {DRAWN} > {HOT}")
    hot = materialize(drawn.select("key", F.expr(f"bigint(ceil(c * {DRAWN} / {HOT}))").alias("salts")), "hot")
    dealt, any_hot = keys.withColumnRenamed("key", "band"), not hot.isEmpty()
    if any_hot:
        dealt = keys.join(hot, "key", "left").select(F.expr("if(salts is null, key, xxhash64(key, pmod(xxhash64(tid), salts)))").alias("band"), "tid")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not kept:
            return
        key, tid = np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])
        found, large = first_pairs(key, tid)
        names = ["u", "v", "band"]
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.nulls(len(found), pa.int64())], names)
        if len(large):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(large), pa.int64()), pa.nulls(len(large), pa.int64()), pa.array(large)], names)

    candidates = materialize(dealt.repartition(parts, "band").mapInArrow(pairs, "u long, v long, band long").distinct(), "candidates")
    tried = candidates.where("band is null").select("u", "v")
    wanted = tried.select(F.col("u").alias("tid")).union(tried.select(F.col("v").alias("tid")))
    if any_hot:
        wanted = wanted.union(keys.join(hot, "key", "left_semi").select("tid"))
    wanted = wanted.distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, width) for t in text_bytes(b.column(2))]
            arrays = [pa.array([len(x) for x in found], pa.int64()), pa.array([bins(x).tobytes() for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], ["tid", "fp", "n", "bins", "shingles"])

    known = texts.join(wanted, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text")).join(held.select("tid", "fp"), "tid")
    known = materialize(known.select("tid", "fp", "text").mapInArrow(sets, "tid long, fp long, n long, bins binary, shingles binary"), "shingles")
    left = known.select(F.col("tid").alias("u"), F.col("fp").alias("fu"), F.col("shingles").alias("su"))
    right = known.select(F.col("tid").alias("v"), F.col("fp").alias("fv"), F.col("shingles").alias("sv"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= similarity for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    def merged(links: DataFrame, tried: DataFrame) -> DataFrame:
        joined = tried.join(left, "u").join(right, "v").where("fu <> fv").select("fu", "fv", "su", "sv")
        return materialize(components(links.unionByName(joined.mapInArrow(verify, "u long, v long").distinct())), "roots")

    def crossing(limit: int) -> Callable[[pa.Table], pa.Table]:
        def found(table: pa.Table) -> pa.Table:
            return cross_pairs(table, limit, similarity)

        return found

    roots = merged(near, tried)
    large = candidates.where("band is not null").select(F.col("band").alias("key")).union(hot.select("key")).distinct()
    members = materialize(keys.join(large, "key", "left_semi"), "members").join(known.select("tid", "fp", "n", "bins"), "tid")
    seen, more = tried, True
    while more:
        rooted = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        found = cells(rooted.select("key", "tid", "root", "n", "bins"), CELL).groupBy("key", "i", "j").applyInArrow(crossing(limit), "u long, v long").distinct()
        found = materialize(found, "candidates")
        more = not found.where("u is null").isEmpty()
        untried = materialize(found.where("u is not null").join(seen, ["u", "v"], "left_anti"), "untried")
        if not untried.isEmpty():
            roots = merged(roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")), untried)
            seen = seen.unionByName(untried)
        limit *= 8
    return roots


def _classes(fps: DataFrame) -> DataFrame:
    return materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")


def _grouped(fps: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_components(docs: DataFrame, distance: int = 2, width: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Defined cases: null or empty text, or text of white space only: fingerprint
    zero, linked like any other. Repeated rows: one result row each. Null
    doc_id: kept, never a component_id unless nothing else is reachable (then
    null). Empty table: empty result. Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, width=width), "fingerprints")
    classes = _classes(fps)
    return _grouped(fps, classes, components(ball_links(classes.select("fp"), distance)))


def keep_one(docs: DataFrame, distance: int = 2) -> DataFrame:
    """The documents that remain when one of each near-duplicate group stays.

    Near duplicates have SimHashes at most ``distance`` bits apart, or five-word
    shingles of Jaccard similarity 0.8 or more (``similar_roots``), or are joined by others.
    The row of the least doc_id (and then the least hash of its text) stays;
    only (doc_id, hash) pairs are grouped.

    Defined cases: null, empty and wordless texts have fingerprint zero and are
    near duplicates of each other. Repeated rows count as near duplicates of
    each other; of rows of one doc_id with different texts the one named above
    stays, if any does. Rows with a null doc_id stay. A text may have any
    length. Empty table: empty result. All columns return, whatever their names.
    """
    (h,) = fresh(docs.columns, "text_hash")
    since = mark(docs.sparkSession)
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    known = keyed.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(h).alias("h"))
    ids = known.select("doc_id", "h").groupBy("doc_id").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    sketches = materialize(sketched(known), "sketched")
    fps = sketches.select("doc_id", "fp")
    classes = _classes(fps)
    near = materialize(ball_links(classes.select("fp"), distance), "links")
    linked = _grouped(fps, classes, similar_roots(known, sketches, near)).select(F.col("component_id").alias("doc_id")).distinct()
    chosen = materialize(linked.join(ids, "doc_id"), "chosen")
    drop_since(docs.sparkSession, since, keep=chosen)
    kept = keyed.join(chosen.select("doc_id", F.col("h").alias(h)), ["doc_id", h], "left_semi")
    if not chosen.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", h])
    back = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*back).unionByName(docs.where("doc_id is null"))
