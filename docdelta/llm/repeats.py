"""Exact removal of long repeated substrings through run-length indexes.

A string of ``window`` bytes that starts at two places holds the same anchor
at the same offset there: the least hash of its ``core``-byte substrings.
Anchors are counted over the corpus; the bytes around anchors that occur once
can hold no repeat. Around the others lie regions, in which every window that
holds the anchor must be decided:

* Regions with equal bytes are kept once, with their count. Each window of a
  region that occurs twice is a repeat.
* The rest is dealt by anchor. A task cuts its regions to the pieces that share
  a long inner string with another one, joins what overlaps in a document, and
  builds a run-compressed Burrows-Wheeler transform of the pieces. The sampled
  run ends give each suffix's matching statistics in text order: between
  samples they fall by one a byte. Windows whose match is long enough are marked.

An anchor with more than ``hot`` different regions is dealt by its regions'
longer inner strings instead. Of such a region only the bytes on both sides of
the inner string are sent; regions of one inner string are compared window by
window in sorted order, so such a group takes neither an index nor pairs. It is
held by one task, so an anchor with more than ``huge`` different regions is not
dealt at all: its windows are counted over the cluster by hashes of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

WINDOW, CORE = 400, 200
BLOCK = 1 << 20
CUTS = 4
CHUNK = 1 << 20
HOT, HUGE = 4000, 100_000
BUFFER = 50_000

_FACTOR = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSE = _powers(_FACTOR, BLOCK), _powers(pow(_FACTOR, -1, 1 << 64), BLOCK)


def _block_anchors(data: np.ndarray, window: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[:n], out=total[1:])
    h = (total[core:] - total[:-core]) * _INVERSE[: n - core + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    m, w = len(h), window - core + 1
    rows = -(-m // w)
    held = np.full(rows * w, ~np.uint64(0))
    held[:m] = (h & ~_LOW) | np.arange(m, dtype=np.uint64)  # ties go to the left
    held = held.reshape(rows, w)
    ahead = np.minimum.accumulate(held, axis=1).ravel()
    behind = np.minimum.accumulate(held[:, ::-1], axis=1)[:, ::-1].ravel()
    count = m - w + 1
    least = np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])
    at = (least[np.r_[True, least[1:] != least[:-1]]] & _LOW).astype(np.int64)
    return at, h[at]


def anchors(text: bytes, window: int = WINDOW, core: int = CORE) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows of a text, by what each window holds alone."""
    if len(text) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    if len(data) <= BLOCK:
        return _block_anchors(data, window, core)
    found: dict[int, int] = {}
    for start in range(0, len(data) - window + 1, BLOCK - window + 1):
        at, h = _block_anchors(data[start : start + BLOCK], window, core)
        found.update(zip((at + start).tolist(), h.tolist(), strict=True))
    return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.uint64, len(found))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of an array of codes below 512: seven codes sort first, then ranks in threes (long arrays: in twos)."""
    n = len(text)
    padded = np.zeros(n + 7, np.int64)
    padded[:n] = text + 1
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | padded[j : j + n]
    depth, bits, ranks = (7, 21, 3) if n < (1 << 21) - 1 else (7, 31, 2)
    while True:
        order = np.argsort(key, kind="stable")
        change = np.r_[0, (key[order][1:] != key[order][:-1]).astype(np.int64)]
        classes = np.cumsum(change)
        if n == 0 or classes[-1] == n - 1:
            return order
        rank = np.zeros(n + 2 * depth, np.int64)
        rank[order] = classes + 1
        key = rank[:n]
        for j in range(1, ranks):
            key = (key << bits) | rank[j * depth : n + j * depth]
        depth *= ranks


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far the suffixes at ``a`` and ``b`` agree."""
    n = len(text)
    words = np.zeros(n + 16, np.uint16)
    words[:n] = text + 1
    packed = np.zeros(n + 8, np.uint64)
    for j in range(4):
        packed |= words[j : j + n + 8].astype(np.uint64) << np.uint64(16 * j)
    length = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    while len(active):
        x, y = np.minimum(a[active] + length[active], n), np.minimum(b[active] + length[active], n)
        same = (packed[x] == packed[y]) & (x < n) & (y < n)
        length[active[same]] += 4
        rest = active[~same]
        for _ in range(4):  # the last codes one by one
            x, y = np.minimum(a[rest] + length[rest], n), np.minimum(b[rest] + length[rest], n)
            rest = rest[(words[x] == words[y]) & (x < n) & (y < n)]
            length[rest] += 1
        active = active[same]
    return length


class RunIndex:
    """A run-compressed Burrows-Wheeler transform with what its run ends sample.

    ``heads`` are the last characters of the runs' rows and ``starts`` the rows
    where runs start. For each border between runs the suffixes on both sides
    are sampled, with the length on which they agree.
    """

    def __init__(self, text: np.ndarray) -> None:
        self.n = len(text)
        order = suffix_order(text)
        last = np.where(order > 0, text[order - 1].astype(np.int64), -1)
        border = np.flatnonzero(last[1:] != last[:-1]) + 1
        self.starts = np.r_[0, border]
        self.heads = last[self.starts]
        above, below = order[border - 1], order[border]
        agree = common_prefixes(text, above, below)
        # To the suffix before, at the rows where runs start; to the one after, where they end.
        self.before = self._samples(np.r_[below, order[:1]], np.r_[agree, 0])
        self.after = self._samples(np.r_[above, order[-1:]], np.r_[agree, 0])

    @staticmethod
    def _samples(at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(at, kind="stable")
        return at[by], length[by]

    def matching_statistics(self) -> np.ndarray:
        """For each place of the text, the longest match of what starts there with any other place."""
        out = np.zeros(self.n, np.int64)
        for at, length in (self.before, self.after):
            sizes = np.diff(np.r_[at, self.n])
            steps = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            streamed = np.zeros(self.n, np.int64)
            if len(at):
                streamed[at[0] :] = np.maximum(np.repeat(length, sizes) - steps, 0)
            out = np.maximum(out, streamed)
        return out


def marked(pieces: list[bytes], window: int) -> list[np.ndarray]:
    """For each of several texts, whether each place starts a string of ``window`` bytes that starts anywhere else, too."""
    sizes = np.array([len(p) for p in pieces])
    codes = np.frombuffer(b"\0".join(pieces), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    codes[ends[:-1]] = 0
    long = RunIndex(codes).matching_statistics() >= window
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        out.append(long[end - size : end] & (np.arange(size) <= size - window))
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open ranges where flags hold."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def shared_windows(keys: np.ndarray, sides: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For regions around inner strings, which of their windows another region of the same key holds at the same place.

    ``sides`` are the ``step`` bytes before each inner string and the ``step``
    after it, of which ``before`` and ``after`` exist. Window ``j`` leaves out the
    first ``j`` bytes before and takes ``j`` after. Equal hashes are verified.
    """
    n, step = len(sides), sides.shape[1] // 2
    tables = np.random.default_rng(0).integers(0, 1 << 63, (2 * step, 256), np.uint64) * np.uint64(2) + np.uint64(1)
    flags = np.zeros((n, step + 1), bool)
    h = (keys * np.array([_FACTOR, 0xD6E8FEB86659FD93], np.uint64)).sum(axis=1, dtype=np.uint64)
    for k in range(step):
        h += tables[k][sides[:, k]]
    for j in range(step + 1):
        at = np.flatnonzero((before >= step - j) & (after >= j))
        order = at[np.argsort(h[at], kind="stable")]
        near = h[order[1:]] == h[order[:-1]]
        a, b = order[:-1][near], order[1:][near]
        same = (keys[a] == keys[b]).all(axis=1) & (sides[a, j : j + step] == sides[b, j : j + step]).all(axis=1)
        if same.all():
            flags[a, j] = flags[b, j] = True
        else:  # different strings of one hash
            seen: dict[bytes, list[int]] = {}
            for i in np.union1d(a, b).tolist():
                seen.setdefault(keys[i].tobytes() + sides[i, j : j + step].tobytes(), []).append(i)
            for members in seen.values():
                if len(members) > 1:
                    flags[members, j] = True
        if j < step:
            h += tables[j + step][sides[:, j + step]] - tables[j][sides[:, j]]
    return flags


class Inner:
    """Decides regions of hot anchors, which come sorted by their inner strings, some whole groups at a time."""

    def __init__(self, window: int, core: int) -> None:
        self.window, self.step = window, -(-(window - core) // CUTS)
        self.held: list[pa.RecordBatch] = []
        self.size, self.limit = 0, BUFFER

    def add(self, batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            self.held.append(batch)
            self.size += batch.num_rows

    def full(self) -> bool:
        return self.size >= self.limit

    def decide(self, last: bool = False) -> tuple[np.ndarray, ...]:
        """did, tid, lo, hi of the repeats in all groups, or in all but the one that may go on."""
        batches, self.held, self.size = self.held, [], 0
        if batches and not last:
            group = batches[-1].column(0)[-1].as_py()
            cuts = [int(np.searchsorted(b.column(0).to_numpy(), group)) for b in batches]
            for b, cut in zip(batches, cuts, strict=True):
                self.add(b.slice(cut))
            batches = [b.slice(0, cut) for b, cut in zip(batches, cuts, strict=True) if cut]
        self.limit = max(BUFFER, 2 * self.size)  # a long group is not searched for its end at every batch
        if not batches:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
        group, did, tid, place, lo, hi, cut = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(7))
        decide = np.concatenate([b.column(8).to_numpy(zero_copy_only=False) for b in batches])
        data = np.frombuffer(b"".join(x.as_py() for b in batches for x in b.column(7)), np.uint8).reshape(len(group), -1)
        keys = np.stack([group.view(np.uint64), np.ascontiguousarray(data[:, :8]).view(np.uint64)[:, 0]], 1)
        first = place - cut * self.step - self.step  # where window 0 starts
        flags = shared_windows(keys, np.ascontiguousarray(data[:, 8:]), first + self.step - lo, hi - first - self.window)
        flags &= decide[:, None]
        edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, a), (_, b) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        return did[row], tid[row], (first[row] + a).astype(np.int32), (first[row] + b - 1 + self.window).astype(np.int32)


class Decider:
    """Collects groups of regions and decides them, about ``CHUNK`` bytes in one index."""

    def __init__(self, window: int, core: int, chunk: int = CHUNK) -> None:
        self.window, self.core, self.chunk = window, core, chunk
        self.held: list[tuple[tuple[int, int], int, bytes, bool]] = []
        self.size = 0

    def shared(self, group: list[tuple]) -> None:
        """Keep the parts of a group's regions whose inner strings another region shares.

        A region is (doc, place of the anchor, place of the region, bytes, whether to decide it).
        """
        extra = self.window - self.core
        step = -(-extra // CUTS)
        at: dict[tuple[int, bytes], list[int]] = {}
        for i, (_, anchor, lo, data, _) in enumerate(group):
            for c in range(CUTS):
                left, right = c * step, min(extra, (c + 1) * step)  # windows that start so far before the anchor
                a, b = anchor - left - lo, anchor - right + self.window - lo
                if a >= 0 and b <= len(data):
                    at.setdefault((c, data[a:b]), []).append(i)
        parts: dict[int, list[int]] = {}
        for (c, _), members in at.items():
            if len(members) > 1:
                for i in members:
                    parts.setdefault(i, []).append(c)
        for i, cuts in parts.items():
            doc, anchor, lo, data, decide = group[i]
            cuts.sort()
            for k, c in enumerate(cuts):
                if k and cuts[k - 1] == c - 1:
                    continue
                last = next((d for d in range(c, CUTS) if d + 1 not in cuts), CUTS - 1)
                start = max(lo, anchor - min(extra, (last + 1) * step))
                end = min(lo + len(data), anchor - c * step + self.window)
                if end - start >= self.window:
                    self.held.append((doc, start, data[start - lo : end - lo], decide))
                    self.size += end - start

    def full(self) -> bool:
        return self.size >= self.chunk

    def decide(self) -> list[tuple[tuple[int, int], int, int]]:
        """(doc, lo, hi) ranges of the repeats in what is held, which is then dropped."""
        found = []
        self.held.sort(key=lambda x: (x[0], x[1], -len(x[2])))
        joined: list[list] = []  # doc, start, bytes, spans to decide
        for doc, start, data, decide in self.held:
            end = start + len(data)
            if joined and joined[-1][0] == doc and start <= joined[-1][1] + len(joined[-1][2]):
                have = joined[-1][1] + len(joined[-1][2])
                if end > have:
                    joined[-1][2] += data[have - start :]
            else:
                joined.append([doc, start, bytearray(data), []])
            if decide:
                joined[-1][3].append((start, end))
        self.held, self.size = [], 0
        if len(joined) < 2 and not any(len(x[2]) > self.window for x in joined):
            return found
        for (doc, start, _, spans), flags in zip(joined, marked([bytes(x[2]) for x in joined], self.window), strict=True):
            for a, b in spans:
                found += [(doc, a + lo, a + hi - 1 + self.window) for lo, hi in runs(flags[a - start : b - start - self.window + 1])]
        return found


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, did (doc_id or the least long), tid (hash of the text) and the text's bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("did"), F.xxhash64(text).alias("tid"), text.cast("binary").alias("text"))


def packed(rows: DataFrame) -> DataFrame:
    """The texts compressed, for a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([press(x.as_py()) for x in b.column(3)], pa.binary())], b.schema.names)

    return rows.mapInArrow(work, rows.schema)


def occurrences(rows: DataFrame, window: int, core: int) -> DataFrame:
    """(key, region, did, tid, place): each anchor, and the hash of the bytes around it."""
    extra = window - core

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dids, tids = b.column(0).to_numpy(), b.column(1).to_numpy()
            for start in range(0, b.num_rows, 1024):
                keys, regions, places, sizes = [], [], [], []
                for value in b.column(2).slice(start, 1024):
                    text = value.as_py()
                    at, h = anchors(text, window, core)
                    sizes.append(len(at))
                    keys.append(h)
                    places.append(at)
                    regions += [xxhash.xxh3_64_intdigest(text[max(0, p - extra) : p + window], min(p, extra)) for p in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.array(regions, np.uint64).view(np.int64)),
                        pa.array(np.repeat(dids[start : start + 1024], sizes)), pa.array(np.repeat(tids[start : start + 1024], sizes)), pa.array(np.concatenate(places).astype(np.int32)),
                    ],
                    ["key", "region", "did", "tid", "place"],
                )

    return rows.select("did", "tid", "text").mapInArrow(work, "key long, region long, did long, tid long, place int")


def repeats(rows: DataFrame, window: int, core: int, hot: int, chunk: int, huge: int = HUGE) -> DataFrame:
    """(did, tid, lo, hi): ranges of bytes of documents that repeats cover, as they are found."""
    extra = window - core
    every = occurrences(rows, window, core)
    # Written first: a join of two plain shuffles is one whose hot keys adaptive execution can split.
    twice = materialize(every.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"), "keys")
    every = materialize(every.join(twice, "key"), "anchors")
    regions = every.groupBy("key", "region").agg(F.count("*").alias("times"), F.first("did").alias("did"), F.first("tid").alias("tid"), F.first("place").alias("place"))
    regions = materialize(regions, "regions")
    ranges = every.join(regions.where("times > 1").select("key", "region"), ["key", "region"], "left_semi").select(
        "did", "tid", (F.col("place") - extra).alias("lo"), (F.col("place") + window).alias("hi")
    )
    open_ = regions.groupBy("key").agg(F.count("*").alias("different"), F.min("times").alias("least")).where("different > 1 AND least = 1").select("key", "different")
    open_ = materialize(open_, "keys")
    wanted = regions.join(open_, "key").groupBy("did", "tid").agg(
        F.collect_list(F.struct("key", "place", (F.col("times") == 1).alias("decide"), (F.col("different") > hot).alias("hot"), (F.col("different") > huge).alias("huge"))).alias("wanted")
    )
    fetched = packed(rows).select("did", "tid", "text").join(wanted, ["did", "tid"])
    step = -(-extra // CUTS)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "did", "tid", "place", "lo", "hi", "cut", "data", "decide"]
        types = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.bool_()]
        open_text = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out: list[tuple] = []
            for did, tid, data, items in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = open_text(data)
                seen = set()
                for x in items:
                    place, key = x["place"], x["key"]
                    if (place, key) in seen:
                        continue
                    seen.add((place, key))
                    if x["huge"]:
                        continue
                    if not x["hot"]:
                        lo = max(0, place - extra)
                        out.append((key, did, tid, place, lo, place + window, -1, text[lo : place + window], x["decide"]))
                        continue
                    for c in range(CUTS):
                        a, e = place - c * step, place - (c + 1) * step + window
                        if a < 0 or e > len(text) or c * step > extra:
                            continue
                        lo, hi = max(0, a - step), min(len(text), e + step)
                        digest = xxhash.xxh3_128_digest(text[a:e], c + 1)
                        sides = text[lo:a].rjust(step, b"\0") + text[e:hi].ljust(step, b"\0")
                        out.append((int.from_bytes(digest[:8], "big", signed=True), did, tid, place, lo, hi, c, digest[8:] + sides, x["decide"]))
                if len(out) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    dealt = fetched.mapInArrow(fetch, "group long, did long, tid long, place int, lo int, hi int, cut int, data binary, decide boolean")
    parts = shuffle_partitions(rows.sparkSession)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decider, inner, group, size, now = Decider(window, core, chunk), Inner(window, core), [], 0, None

        def result(columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["did", "tid", "lo", "hi"])

        def out() -> pa.RecordBatch:
            found = decider.decide()
            return result([[f[0][0] for f in found], [f[0][1] for f in found], [f[1] for f in found], [f[2] for f in found]])

        for b in batches:
            hot_rows = pc.greater_equal(b.column(6), 0)
            inner.add(b.filter(hot_rows))
            if inner.full():
                yield result(inner.decide())
            b = b.filter(pc.invert(hot_rows))
            for key, did, tid, place, lo, data, flag in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 7, 8)), strict=True):
                if key != now:
                    if decider.size and decider.size + size > chunk:  # a large group gets an index of its own
                        yield out()
                    decider.shared(group)
                    if decider.full():
                        yield out()
                    group, size, now = [], 0, key
                group.append(((did, tid), place, lo, data, flag))
                size += len(data)
        if decider.size and decider.size + size > chunk:
            yield out()
        decider.shared(group)
        yield out()
        yield result(inner.decide(last=True))

    decided = dealt.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(decide, "did long, tid long, lo int, hi int")
    found = ranges.unionByName(decided)
    if open_.where(F.col("different") > huge).isEmpty():
        return found
    some = fetched.select("did", "tid", "text", F.filter("wanted", lambda x: x["huge"])["place"].alias("places")).where("size(places) > 0")
    return found.unionByName(counted_windows(some, window, core))


def counted_windows(fetched: DataFrame, window: int, core: int) -> DataFrame:
    """(did, tid, lo, hi) of the windows around ``places`` of packed texts that start at two places of them.

    A window that several places cover counts once. No task holds a group: the
    counts are combined before the shuffle, and the join back has one row a hash
    on one side, so that adaptive execution can split the other.
    """
    extra = window - core

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for did, tid, data, places in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = open_text(data)
                starts = sorted({s for p in places for s in range(max(0, p - extra), min(p, len(text) - window) + 1)})
                for at in range(0, len(starts), 1 << 16):
                    part = starts[at : at + (1 << 16)]
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[s : s + window]) for s in part), np.int64).reshape(-1, 2)
                    columns = [digests[:, 0].copy(), digests[:, 1].copy(), np.full(len(part), did), np.full(len(part), tid), np.array(part, np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "g", "did", "tid", "lo"])

    every = materialize(fetched.mapInArrow(hashes, "h long, g long, did long, tid long, lo int"), "windows")
    twice = materialize(every.groupBy("h", "g").agg(F.count("*").alias("times")).where("times > 1").select("h", "g"), "keys")
    return every.join(twice, ["h", "g"], "left_semi").select("did", "tid", "lo", (F.col("lo") + window).alias("hi"))


def remove(docs: DataFrame, window: int = WINDOW, core: int = CORE, hot: int = HOT, chunk: int = CHUNK, with_text: bool = False, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes that remain) of every row.

    Removed is each byte that a ``window``-byte string covers which also starts
    anywhere else in ``docs`` (doc_id, text). Defined cases: a null text is
    empty; texts of fewer bytes than the window lose nothing; repeated rows
    are copies of each other. Bytes are UTF-8, so a cut may split a character.
    Empty table: empty result. Extra columns are ignored.
    """
    rows = keyed(docs)
    found = repeats(rows, window, core, hot, chunk, huge).groupBy("did", "tid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = packed(rows.select("doc_id", "did", "tid", "text")).join(found, ["did", "tid"], "left").select("doc_id", "text", "ranges.lo", "ranges.hi")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for data, lo, hi in zip(b.column(1), b.column(2), b.column(3), strict=True):
                text = open_text(data.as_py())
                n, kept, spans, removed = len(text), text, 0, 0
                if lo.is_valid:
                    a = np.clip(lo.values.to_numpy(), 0, n)
                    e = np.clip(hi.values.to_numpy(), 0, n)
                    good = e - a >= window
                    depth = np.zeros(n + 1, np.int64)
                    np.add.at(depth, a[good], 1)
                    np.add.at(depth, e[good], -1)
                    gone = np.cumsum(depth[:n]) > 0
                    removed, spans = int(gone.sum()), len(runs(gone))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (n, removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    column.append(value)
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out[4], pa.binary())], [*names, "kept"]) if with_text else pa.RecordBatch.from_arrays(arrays, names)

    return joined.mapInArrow(work, schema)
