"""Alignment of the sections of two versions: by number, by title, then by similarity.

Numbers and titles are joins; what only one section wants is settled there.
Greedy order decides the rest, a pair at a time on rows of ids and scores.
Texts are scored in blocks of a pair's left-over sections, and only where the
lengths and the counts of characters leave room for the threshold.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from docdelta.functions import text as T
from docdelta.sources.tables import written

THRESHOLD = 0.72
BLOCK = 256
CHUNK = 1024
# Classes of length grow by this; so many left texts a cell, right ones a group of a pair, and right ones an index at most.
GROWTH, CELL, GROUP, INDEX = 1.35, 4096, 65536, 4096
BITS, BUCKETS = 31, 23
WIDTH = 6
MIX = np.uint64(0x9E3779B97F4A7C15)
NUMBER, TITLE, SIMILAR = "section number match", "normalized title match", "text/title similarity fallback"
FIELDS = "old_section_id string, new_section_id string, score double, reason string, phase int, ord int"


class Matcher:
    """The ratio of the standard library's sequence matcher, for one right text and many left ones.

    Only places of the left text whose character the right text keeps in its
    index are looked at; with popular characters dropped, these are few.
    """

    def __init__(self, right: str, autojunk: bool = True) -> None:
        self.right, self.places = right, {}
        for j, c in enumerate(right):
            self.places.setdefault(c, []).append(j)
        if autojunk and len(right) >= 200:
            most = len(right) // 100 + 1
            self.places = {c: js for c, js in self.places.items() if len(js) <= most}

    def runs(self, left: str, at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Equal places (i, j) of both texts that the index keeps, in order, and how long the run of such places is that ends there; none if few or very many."""
        sizes = [len(self.places[left[i]]) for i in at]
        if not 2000 <= sum(sizes) <= 8_000_000:
            return None
        arrays = {c: np.array(js, np.int64) for c, js in self.places.items()}
        i, j = np.repeat(np.array(at, np.int64), sizes), np.concatenate([arrays[left[k]] for k in at])
        diagonal = (j - i + len(left)) * (len(left) + 2) + i
        order = np.argsort(diagonal)
        steps = np.arange(len(order))
        starts = np.r_[True, np.diff(diagonal[order]) != 1]
        size = np.empty(len(order), np.int64)
        size[order] = steps - np.maximum.accumulate(np.where(starts, steps, 0)) + 1
        return i, j, size

    def ratio(self, left: str, least: float = 0.0) -> float:
        """0 stands for any ratio below ``least``."""
        right, places = self.right, self.places
        if not left or not right:
            return float(left == right)
        if left == right:
            return 1.0
        at = [i for i, c in enumerate(left) if c in places]
        matched, open_, runs = 0, [(0, len(left), 0, len(right))], self.runs(left, at)
        room, need = min(len(left), len(right)), least / 2 * (len(left) + len(right)) - 1e-6  # what all that is open could match
        while open_:
            if matched + room < need:
                return 0.0
            a0, a1, b0, b1 = open_.pop()
            room -= min(a1 - a0, b1 - b0)
            x, y, size = a0, b0, 0
            ending: dict[int, int] = {}  # length of the common run that ends at a place of the right text
            last = -2
            looked_at = at[bisect_left(at, a0) : bisect_left(at, a1)]
            if runs and len(looked_at) > 16:
                lo, hi = np.searchsorted(runs[0], (a0, a1))
                i, j, sizes = (r[lo:hi] for r in runs)
                inside = np.flatnonzero((j >= b0) & (j < b1))
                if len(inside):
                    i, j = i[inside], j[inside]
                    sizes = np.minimum(np.minimum(sizes[inside], i - (a0 - 1)), j - (b0 - 1))
                    best = int(sizes.argmax())
                    size = int(sizes[best])
                    x, y = int(i[best]) - size + 1, int(j[best]) - size + 1
                looked_at = []
            for i in looked_at:
                longer: dict[int, int] = {}
                for j in places[left[i]]:
                    if b0 <= j < b1:
                        n = longer[j] = (ending.get(j - 1, 0) if i == last + 1 else 0) + 1
                        if n > size:
                            x, y, size = i - n + 1, j - n + 1, n
                ending, last = longer, i
            while x > a0 and y > b0 and left[x - 1] == right[y - 1]:
                x, y, size = x - 1, y - 1, size + 1
            while x + size < a1 and y + size < b1 and left[x + size] == right[y + size]:
                size += 1
            if size:
                matched += size
                parts = [r for r in ((a0, x, b0, y), (x + size, a1, y + size, b1)) if r[0] < r[1] and r[2] < r[3]]
                open_ += parts
                room += sum(min(r[1] - r[0], r[3] - r[2]) for r in parts)
        return 2.0 * matched / (len(left) + len(right))


def similarity(left: str, right: str, autojunk: bool = True) -> float:
    """Ratio of matching characters; 1 for two empty texts, 0 if only one is."""
    return Matcher(right, autojunk).ratio(left)


def _renewed(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, as both sides of a cogroup may come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _keys(sections: DataFrame, *more: str) -> DataFrame:
    keys = sections.where("comparison_enabled").select("pair_id", "section_id", "number", T.title_key(F.col("title")).alias("key"), "order_index", *more)
    return _renewed(keys)


def _kind(df: DataFrame) -> str:
    return df.schema["pair_id"].dataType.simpleString()


def match_by_number(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, old_section_id, new_section_id, new_key): for each old section the first new one of its number."""
    first = _keys(new).where("number <> ''").groupBy("pair_id", "number").agg(F.min_by(F.struct("section_id", "key"), "order_index").alias("n"))
    rows = _keys(old).where("number <> ''").join(first, ["pair_id", "number"])
    return rows.select("pair_id", F.col("section_id").alias("old_section_id"), F.col("n.section_id").alias("new_section_id"), F.col("n.key").alias("new_key"))


def match_by_title(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, old_section_id, new_section_id): for each old section the first new one of its normalized title."""
    first = _keys(new).groupBy("pair_id", "key").agg(F.min_by("section_id", "order_index").alias("new_section_id"))
    return _keys(old).join(first, ["pair_id", "key"]).select("pair_id", F.col("section_id").alias("old_section_id"), "new_section_id")


@F.pandas_udf(DoubleType())
def title_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """The score of a match by number: the similarity of the titles, 0.9 at least."""
    return pd.Series([1.0 if x == y else max(0.9, similarity(x or "", y or "")) for x, y in zip(a, b, strict=True)], dtype="float64")


def indexed_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Phase one: in old order, claim the first new section of the number, else of the title. Old rows without a partner have a null new_section_id.

    A new section that one old section alone could claim is its own, whatever
    the order. Only old sections with a contested candidate run through the fold.
    """
    on = ["pair_id", "old_section_id"]
    numbered = match_by_number(old, new).withColumnsRenamed({"new_section_id": "by_number", "new_key": "by_number_key"})
    titled = match_by_title(old, new).withColumnRenamed("new_section_id", "by_title")
    wants = _keys(old).withColumnRenamed("section_id", "old_section_id").join(numbered, on, "left").join(titled, on, "left")
    wants = written(wants.select(*on, "key", F.col("order_index").alias("ord"), "by_number", "by_number_key", "by_title"), "candidates")
    each = wants.select(*on, F.explode(F.array_distinct(F.array_compact(F.array("by_number", "by_title")))).alias("new"))
    contested = each.groupBy("pair_id", "new").agg(F.count("*").alias("n")).where("n > 1")
    busy = each.join(contested, ["pair_id", "new"], "left_semi").select(*on).distinct()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        taken, by = set(), []
        for r in rows.sort_values("ord").itertuples():
            hit = next(((name, x) for name, x in (("n", r.by_number), ("t", r.by_title)) if x is not None and x not in taken), ("", None))
            taken.add(hit[1])
            by.append((r.pair_id, r.old_section_id, hit[0]))
        return pd.DataFrame(by, columns=["pair_id", "old_section_id", "how"])

    decided = wants.join(busy, on, "left_semi").select(*on, "ord", "by_number", "by_title").groupBy("pair_id").applyInPandas(fold, f"pair_id {_kind(old)}, old_section_id string, how string")
    rows = wants.join(decided, on, "left")
    how = F.coalesce("how", F.when(F.col("by_number").isNotNull(), "n").when(F.col("by_title").isNotNull(), "t").otherwise(""))
    rows = rows.withColumn("how", how).withColumn("title_score", title_score("key", "by_number_key"))
    return rows.select(
        *on, F.when(F.col("how") == "n", F.col("by_number")).when(F.col("how") == "t", F.col("by_title")).alias("new_section_id"),
        F.when(F.col("how") == "n", F.col("title_score")).when(F.col("how") == "t", 0.86).otherwise(0.0).alias("score"),
        F.when(F.col("how") == "n", NUMBER).when(F.col("how") == "t", TITLE).otherwise("").alias("reason"), F.lit(1).alias("phase"), "ord",
    )


def _counts(texts: list[str], width: int, bins: int) -> np.ndarray:
    """How often each substring of ``width`` characters occurs, folded into ``bins``: rows overlap no less than their texts do."""
    out = np.zeros((len(texts), bins), np.int32)
    for row, t in zip(out, texts, strict=True):
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(codes) >= width:
            mixed = codes[: len(codes) - width + 1]
            for k in range(1, width):
                mixed = mixed * np.uint64(0x9E3779B1) + codes[k : len(codes) - width + 1 + k]
            row += np.bincount((mixed % np.uint64(bins)).astype(np.int64), minlength=bins).astype(np.int32)
    return out


def _rare(texts: list[str], bins: int) -> np.ndarray:
    """``_counts`` of single characters, of those alone that the matcher keeps when it drops a text's popular ones."""
    out = np.zeros((len(texts), bins), np.int32)
    for row, t in zip(out, texts, strict=True):
        codes, times = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
        kept = times <= len(t) // 100 + 1
        np.add.at(row, codes[kept] % bins, times[kept].astype(np.int32))
    return out


def _substrings(text: str, bits: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the substrings of ``WIDTH`` characters, and how often each occurs."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(len(codes) - WIDTH + 1, 0)
    mixed = codes[:n]
    for k in range(1, WIDTH):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)
    found, times = np.unique(mixed.astype(np.int32), return_counts=True)
    return found, times.astype(np.int32)


class Substrings:
    """The substrings of many texts, by hash: a text's overlap with all of them is found in one pass over those it holds."""

    def __init__(self, texts: list[str]) -> None:
        held = [_substrings(t) for t in texts]
        hashes, self.times = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int32) for k in (0, 1))
        order = np.argsort(hashes, kind="stable")
        self.of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(h[0]) for h in held])[order]
        self.hashes, starts = np.unique(hashes[order], return_index=True)
        self.times, self.starts, self.n = self.times[order], np.r_[starts, len(hashes)], len(texts)

    def shared(self, text: str) -> np.ndarray:
        """How many substrings ``text`` has in common with each text, repeats included."""
        found, times = _substrings(text)
        if not len(found) or not len(self.hashes):
            return np.zeros(self.n)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        held = self.hashes[at] == found
        first, times = self.starts[at[held]], times[held]
        sizes = self.starts[at[held] + 1] - first
        each = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.of[each], np.minimum(self.times[each], np.repeat(times, sizes)), self.n)


def similarity_bounds(old: list[str], new: list[str], autojunk: bool = True) -> np.ndarray:
    """Upper bounds of ``similarity`` for all pairs of two lists: matched characters are common to both texts, as many times (``autojunk`` or not)."""
    a, b = _counts(old, 1, 256), _counts(new, 1, 256)
    sizes_a, sizes_b = a.sum(axis=1), b.sum(axis=1)
    if max(sizes_a.max(initial=0), sizes_b.max(initial=0)) < 2**15:
        a, b = a.astype(np.int16), b.astype(np.int16)
    held = np.flatnonzero(a.any(axis=0) & b.any(axis=0))  # other characters add nothing
    a, b = a[:, held], np.ascontiguousarray(b[:, held])
    out = np.empty((len(old), len(new)))
    for i in range(len(old)):
        total = sizes_a[i] + sizes_b
        out[i] = np.where(total == 0, 1.0, 2.0 * np.minimum(a[i], b).sum(axis=1, dtype=np.int32) / np.maximum(total, 1))
    return out


class Bounds:
    """Bounds sharper than ``similarity_bounds``, for one left text at a time and the right ones that are still open.

    Matched blocks stand in one order in both texts, so they are no longer than
    the longest common subsequence; for short texts it is found for all right
    ones at once, a bit a character. Where the matcher drops a long right
    text's popular characters, each matching block but one at the very start
    has one of its other characters; so the blocks are few, and of a block's n
    characters n - WIDTH + 1 begin a substring of ``WIDTH`` that both hold.
    """

    def __init__(self, right: list[str], autojunk: bool = True) -> None:
        self.sizes = np.array([len(x) for x in right], np.int64)
        self.short = self.sizes <= 64
        self.names: dict[str, int] = {}
        self.codes = np.zeros((len(right), int(self.sizes[self.short].max(initial=0))), np.int32)
        for row, x in zip(self.codes, right, strict=True):
            if len(x) <= 64:
                row[: len(x)] = [self.names.setdefault(c, len(self.names) + 1) for c in x]
        self.long = (self.sizes >= 200) & autojunk
        self.place = np.cumsum(self.long) - 1
        long = [right[j] for j in np.flatnonzero(self.long)]
        self.rare, self.index = _rare(long, 256), Substrings(long)

    def sharpen(self, left: str, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``bounds`` of the right texts ``at``, made smaller where they can be."""
        out = bounds[at].copy()
        if left and len(left) <= 64 and len(few := np.flatnonzero(self.short[at])):
            masks = np.zeros(len(self.names) + 1, np.uint64)
            for i, c in enumerate(left):
                if c in self.names:
                    masks[self.names[c]] |= np.uint64(1 << i)
            open_ = np.full(len(few), np.uint64(2 ** len(left) - 1))
            for step in self.codes[at[few]].T:
                met = open_ & masks[step]
                open_ = (open_ + met) | (open_ - met)
            common = len(left) - np.bitwise_count(open_ & np.uint64(2 ** len(left) - 1)).astype(np.int64)
            out[few] = np.minimum(out[few], 2.0 * common / (len(left) + self.sizes[at[few]]))
        if left and len(many := np.flatnonzero(self.long[at])):
            places = self.place[at[many]]
            counts = _counts([left], 1, 256)[0]
            held = np.flatnonzero(counts)
            blocks = np.minimum(counts[held], self.rare[np.ix_(places, held)]).sum(axis=1) + 1
            shared = self.index.shared(left)[places] + (WIDTH - 1) * blocks
            out[many] = np.minimum(out[many], 2.0 * shared / (len(left) + self.sizes[at[many]]))
        return out


def _dealt(old: DataFrame, new: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work`` over blocks of a pair's ``old`` rows, each with all ``new`` rows of the pair."""
    order = Window.partitionBy("pair_id").orderBy("order_index")
    left = _renewed(old.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK)).select("pair_id", "block", *columns))
    blocks = _renewed(left.select("pair_id", "block").distinct())
    right = _renewed(_renewed(new).join(blocks, "pair_id"))
    # Few bytes but much work a row: a given number of partitions keeps adaptive execution from merging them.
    parts = int(old.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    dealt = [df.repartition(parts, "pair_id", "block").groupBy("pair_id", "block") for df in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(work, f"pair_id {_kind(old)}, section_id string, {schema}")


def _items(text: str, width: int) -> np.ndarray:
    """A hash for each substring of ``width`` characters; the n-th time that one occurs has a hash of its own. Sorted."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(len(codes) - width + 1, 0)
    mixed = codes[:n]
    for k in range(1, width):
        mixed = mixed * MIX + codes[k : n + k]
    mixed = np.sort(mixed)
    new = np.r_[True, mixed[1:] != mixed[:-1]][:n]
    starts = np.flatnonzero(new)
    times = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    mixed += times.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)
    return np.sort(mixed.astype(np.int32))


class Index:
    """Upper bounds of how many substrings of ``width`` characters one text has in common with each of many.

    Buckets that hold most texts are left out of the lists, up to ``share`` of
    all places: there a pair has in common no more than either text has in them.
    """

    def __init__(self, texts: list[str], width: int, share: float) -> None:
        held = [_items(t, width) for t in texts]
        self.width, self.n = width, len(texts)
        items = np.concatenate(held) if held else np.zeros(0, np.int32)
        self.shift = BITS - min(max(len(items).bit_length(), 10), BUCKETS)
        items >>= self.shift
        of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(h) for h in held])
        sizes = np.bincount(items, minlength=1 << (BITS - self.shift))
        places = np.bincount(sizes) * np.arange(sizes.max(initial=0) + 1)
        self.frequent = sizes > np.searchsorted(-np.cumsum(places[::-1])[::-1], -share * len(items), "left")
        apart = self.frequent[items]
        self.common = np.bincount(of[apart], minlength=self.n)
        items, of = items[~apart], of[~apart]
        self.of = of[np.argsort(items, kind="stable")]
        sizes[self.frequent] = 0
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)

    def shared(self, items: np.ndarray) -> np.ndarray:
        items = items >> self.shift
        asked = items[~self.frequent[items]]
        first = self.starts[asked]
        sizes = self.starts[asked + 1] - first
        ends = np.cumsum(sizes)
        each = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
        return np.bincount(self.of[each], minlength=self.n) + np.minimum(len(items) - len(asked), self.common)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the sorted ``a`` are in ``b``."""
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0


def common_subsequence(left: str, right: str) -> int:
    """Length of the longest common subsequence, a bit a character of ``left``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(left):
        masks[c] = masks.get(c, 0) | 1 << i
    full = open_ = (1 << len(left)) - 1
    for c in right:
        met = open_ & masks.get(c, 0)
        open_ = ((open_ + met) | (open_ - met)) & full
    return len(left) - open_.bit_count()


def similar(old: list[str], new: list[str], threshold: float = THRESHOLD, autojunk: bool = True) -> Iterator[tuple[int, int, float]]:
    """(i, j, similarity) of all pairs of two lists that reach the threshold.

    Where the matcher drops a right text's popular characters, its other ones
    bound the number of matching blocks (see ``Bounds``), and so the substrings
    that two similar texts share. An index counts these, of eight characters
    where few blocks allow it, else of six. All others have the bounds of
    ``similarity_bounds`` and ``Bounds``, the first ones once for texts of the same characters.
    """
    sizes, rare = np.array([len(y) for y in new], np.int64), _rare(new, 256)
    blocks = rare.sum(axis=1, dtype=np.int64) + 1
    left_sizes = np.array([len(x) for x in old], np.int64)
    spare = lambda width: threshold - (width - 1) * blocks / np.maximum(sizes, 1)
    long = (sizes >= 200) & autojunk
    wide = long & (spare(8) >= 0.22)
    kinds = [(8, 0.12, np.flatnonzero(wide)), (6, 0.18, np.flatnonzero(long & ~wide & (spare(6) >= 0.2)))]
    matchers: dict[int, Matcher] = {}

    def ratio(i: int, j: int) -> Iterator[tuple[int, int, float]]:
        if old[i] == new[j]:
            score = 1.0
        else:
            if j not in matchers:
                if len(matchers) >= BLOCK:
                    matchers.clear()
                matchers[j] = Matcher(new[j], autojunk)
            score = matchers[j].ratio(old[i], threshold)
        if score >= threshold:
            yield i, j, score

    counts = _counts(old, 1, 256) if len(kinds[0][2]) + len(kinds[1][2]) else None
    for width, share, at in kinds:
        for start in range(0, len(at), INDEX):
            js = at[start : start + INDEX]
            index, theirs = Index([new[j] for j in js], width, share), rare[js]
            for i, left in enumerate(old):
                need = threshold / 2 * (left_sizes[i] + sizes[js]) - 1e-6
                fits = np.minimum(left_sizes[i], sizes[js]) >= need
                if not fits.any():
                    continue
                items = _items(left, width)
                shared = index.shared(items)
                still = np.flatnonzero(fits & (shared + (width - 1) * blocks[js] >= need))
                if len(still):
                    held = np.flatnonzero(counts[i])
                    fewer = np.minimum(counts[i][held], theirs[np.ix_(still, held)]).sum(axis=1) + 1
                    for k in np.flatnonzero(shared[still] + (width - 1) * fewer >= need[still]).tolist():
                        j = int(js[still[k]])
                        if old[i] == new[j] or _overlap(items, _items(new[j], width)) + (width - 1) * fewer[k] >= need[still[k]]:
                            yield from ratio(i, j)
    plain = np.setdiff1d(np.arange(len(new)), np.concatenate([k[2] for k in kinds]))
    names: list[dict[str, int]] = [{}, {}]
    for start in range(0, len(plain), INDEX):
        js = plain[start : start + INDEX]
        names[1].clear()
        of_old = np.array([names[0].setdefault("".join(sorted(x)), len(names[0])) for x in old], np.int64)
        of_new = np.array([names[1].setdefault("".join(sorted(new[j])), len(names[1])) for j in js], np.int64)
        reach = similarity_bounds(list(names[0]), list(names[1]), autojunk) >= threshold
        sharper, full = Bounds([new[j] for j in js], autojunk), np.ones(len(js))
        for i, left in enumerate(old):
            if len(still := np.flatnonzero(reach[of_old[i]][of_new])):
                still = still[sharper.sharpen(left, full, still) >= threshold]
            for j in js[still].tolist():
                # Texts of some length that are not dropped from: their longest common subsequence costs less than the matcher.
                most = len(left) + len(new[j])
                if 128 < most <= 2000 and left != new[j] and 2.0 * common_subsequence(left, new[j]) / most < threshold:
                    continue
                yield from ratio(i, j)


@F.pandas_udf(BinaryType())
def deflated(texts: pd.Series) -> pd.Series:
    return pd.Series([zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts], dtype=object)


def _similar_in(column: str, old: DataFrame, new: DataFrame, threshold: float, autojunk: bool) -> DataFrame:
    """(pair_id, section_id, candidates) by one column. Only texts whose lengths leave room for the threshold meet.

    Cells are left texts of one class of length and all right ones of the
    classes in reach, in several groups where a pair has many. Texts travel deflated.
    """
    size = F.length("text")
    kind = F.when(size == 0, -1000).otherwise(F.floor(F.log(size) / math.log(GROWTH))).cast("int") if threshold > 0 else F.lit(0)
    reach = int(math.log((2 - threshold) / threshold) / math.log(GROWTH) + 1e-9) + 1 if 0 < threshold <= 1 else 0
    rows = lambda df: _renewed(df.select("pair_id", "section_id", F.coalesce(column, F.lit("")).alias("text")).withColumn("kind", kind))
    spread = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    blocks = rows(old).groupBy("pair_id", "kind").agg(F.count("*").alias("n")).select("pair_id", "kind", spread("n", CELL).alias("blocks"))
    groups = rows(new).groupBy("pair_id").agg(F.count("*").alias("n")).select("pair_id", spread("n", GROUP).alias("groups"))
    packed = lambda df: df.select("pair_id", "section_id", "kind", deflated("text").alias("packed"))
    place = lambda n: F.pmod(F.xxhash64("section_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = packed(rows(old)).join(_renewed(blocks), ["pair_id", "kind"]).join(_renewed(groups), "pair_id")
    left = left.select("pair_id", "kind", place("blocks").alias("block"), every("groups").alias("group"), "section_id", "packed")
    right = packed(rows(new)).join(_renewed(groups), "pair_id").withColumn("group", place("groups"))
    right = right.withColumn("kind", F.explode(F.sequence(F.col("kind") - reach, F.col("kind") + reach))).join(_renewed(blocks), ["pair_id", "kind"])
    right = right.select("pair_id", "kind", every("blocks").alias("block"), "group", "section_id", "packed")
    schema = f"pair_id {_kind(old)}, section_id string, candidates array<struct<id:string,score:double>>"

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        inflated = lambda of: [zlib.decompress(t).decode("utf-8", "surrogatepass") for t in of]
        x, ids, found = inflated(a["packed"]) if len(b) else [], b["section_id"].tolist(), {}
        for at in range(0, len(b) if len(a) else 0, INDEX):
            for i, j, value in similar(x, inflated(b["packed"].iloc[at : at + INDEX]), threshold, autojunk):
                found.setdefault(i, []).append({"id": ids[at + j], "score": float(value)})
        pairs, mine = a["pair_id"].tolist(), a["section_id"].tolist()
        return pd.DataFrame([(pairs[i], mine[i], c) for i, c in found.items()], columns=["pair_id", "section_id", "candidates"])

    keys = ["pair_id", "kind", "block", "group"]
    # Few bytes but much work a row: a given number of partitions keeps adaptive execution from merging them.
    parts = int(old.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    dealt = [_renewed(df).repartition(parts, *keys).groupBy(*keys) for df in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(score, schema)


def similarity_scores(old: DataFrame, new: DataFrame, threshold: float = THRESHOLD, autojunk: bool = True) -> DataFrame:
    """(pair_id, section_id, candidates array<struct<id,score>>): the new sections that each old one is similar to.

    Both have pair_id, section_id, key, prefix (the text to compare, whole).
    One id may come twice, once by texts and once by keys; the larger similarity is
    its score. Bounds spare most comparisons, and change no result.
    """
    found = [_similar_in(c, old, new, threshold, autojunk) for c in ("prefix", "key")]
    both = written(found[0], "similar").unionByName(written(found[1], "similar"))
    return both.groupBy("pair_id", "section_id").agg(F.flatten(F.collect_list("candidates")).alias("candidates"))


def best_scores(old: DataFrame, new: DataFrame, autojunk: bool = True) -> DataFrame:
    """(pair_id, section_id, best): each old section's highest score among new ones that were free at its turn.

    ``new`` has ``until``: the order_index of the old section that took it, or null.
    """

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        until, orders = b["until"].fillna(np.inf).to_numpy(float), a["order_index"].tolist()
        best = [0.0] * len(a)
        # Keys are short and cheap; what they reach spares most of the prefixes.
        for c in ("key", "prefix"):
            x, y = a[c].fillna("").tolist(), b[c].fillna("").tolist()
            for at in range(0, len(y), CHUNK):
                bounds, sharper = similarity_bounds(x, y[at : at + CHUNK], autojunk), Bounds(y[at : at + CHUNK], autojunk)
                held: dict[int, Matcher] = {}
                for i, order in enumerate(orders):
                    still = np.flatnonzero((bounds[i] > best[i]) & (until[at : at + CHUNK] > order))
                    sharp = sharper.sharpen(x[i], bounds[i], still)
                    for n in np.argsort(-sharp, kind="stable").tolist():
                        if sharp[n] <= best[i]:
                            break
                        j = int(still[n])
                        if j not in held:
                            held[j] = Matcher(y[at + j], autojunk)
                        best[i] = max(best[i], held[j].ratio(x[i]))
        return pd.DataFrame({"pair_id": a["pair_id"].tolist(), "section_id": a["section_id"].tolist(), "best": best})

    return _dealt(old, new.select("pair_id", "key", "prefix", "until"), ["section_id", "key", "prefix", "order_index"], score, "best double")


def residual_matches(old: DataFrame, new: DataFrame, threshold: float = THRESHOLD, autojunk: bool = True) -> DataFrame:
    """Phase two over what is left on both sides (columns of ``_keys`` with prefix): number, title, then the most similar.

    The score of an old section without a partner is that of the best one that
    was left at its turn. Where ``old`` has a column ``exact`` it is found for
    those rows alone, and 0 for others.
    """
    if "exact" not in old.columns:
        old = old.withColumn("exact", F.lit(True))
    old, new = written(old, "left-old"), written(new, "left-new")
    narrow = old.drop("prefix").join(_renewed(similarity_scores(old, new, threshold, autojunk)), ["pair_id", "section_id"], "left")

    def assign(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("order_index")
        ids, keys, free, out = b["section_id"].tolist(), b["key"].tolist(), np.ones(len(b), bool), []
        place = {x: i for i, x in enumerate(ids)}
        by_number: dict[str, list[int]] = {}
        by_key: dict[str, list[int]] = {}
        for i, (number, key) in enumerate(zip(b["number"], keys, strict=True)):
            by_key.setdefault(key, []).append(i)
            if number:
                by_number.setdefault(number, []).append(i)

        def first(places: list[int]) -> int | None:
            while places and not free[places[0]]:
                places.pop(0)
            return places[0] if places else None

        for r in a.sort_values("order_index").itertuples():
            score, reason, hit = 0.0, NUMBER, first(by_number.get(r.number, []))
            if hit is not None:
                score = max(0.9, similarity(r.key, keys[hit], autojunk))
            elif (hit := first(by_key.get(r.key, []))) is not None:
                score, reason = 0.86, TITLE
            elif r.candidates is not None and (scored := [(-c["score"], place[c["id"]]) for c in r.candidates if free[place[c["id"]]]]):
                (score, hit), reason = min(scored), SIMILAR
                score = -score
            if hit is not None:
                free[hit] = False
            out.append((r.pair_id, r.section_id, ids[hit] if hit is not None else None, score, reason if hit is not None else "", 2, r.order_index))
        return pd.DataFrame(out, columns=["pair_id", *[f.split()[0] for f in FIELDS.split(", ")]])

    done = narrow.groupBy("pair_id").cogroup(_renewed(new.drop("prefix")).groupBy("pair_id")).applyInPandas(assign, f"pair_id {_kind(old)}, {FIELDS}")
    done = written(done, "matches")
    on = ["pair_id", "old_section_id"]
    alone = done.where("new_section_id is null").select("pair_id", F.col("old_section_id").alias("section_id"))
    taken = done.where("new_section_id is not null").select("pair_id", F.col("new_section_id").alias("section_id"), F.col("ord").alias("until"))
    best = best_scores(old.where("exact").join(_renewed(alone), ["pair_id", "section_id"], "left_semi"), new.join(_renewed(taken), ["pair_id", "section_id"], "left"), autojunk)
    return done.join(_renewed(best.withColumnRenamed("section_id", "old_section_id")), on, "left").select(*on, "new_section_id", F.coalesce("best", "score").alias("score"), "reason", "phase", "ord")


def found_keys(rows: Iterator[tuple[object, bytes | None, bytes]]) -> Iterator[tuple[object, bytes]]:
    """(pair, key) of every key that its pair's text holds, from rows of (pair, key or none, piece of text).

    A pair's rows follow each other: keys (8 bytes at least) first, then its text in order. The text
    passes in pieces of about a megabyte, each with the end of the one before it, so keys across pieces are
    found, and no more than that is held. A table of the first 8 bytes of the keys leaves few places to compare.
    """

    def scan(text: bytes) -> list[bytes]:
        if len(text) < 8 or not keys:
            return []
        starts = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
        hits = []
        for at in np.flatnonzero(table[(starts * MIX) >> np.uint64(44)]).tolist():
            if (asked := keys.get(text[at : at + 8])) is not None and (here := [x for x in asked if text.startswith(x, at)]):
                hits += here
                asked -= set(here)
        return hits

    def flush(keep: int) -> list[bytes]:
        text = b"".join(parts)
        parts[:] = [text[max(len(text) - keep, 0) :]] if keep else []
        return scan(text)

    pair, parts, held, longest = None, [], 0, 8
    keys: dict[bytes, set[bytes]] = {}
    table = np.zeros(1 << 20, bool)
    for of, key, piece in rows:
        if of != pair:
            yield from ((pair, x) for x in flush(0))
            pair, held, longest = of, 0, 8
            keys.clear()
            table[:] = False
        if key is not None:
            keys.setdefault(key[:8], set()).add(key)
            longest = max(longest, len(key))
            table[(np.frombuffer(key[:8], "<u8") * MIX) >> np.uint64(44)] = True
        elif keys:
            parts.append(piece)
            held += len(piece)
            if held >= max(1 << 20, longest):
                yield from ((pair, x) for x in flush(longest - 1))
                held = 0
    yield from ((pair, x) for x in flush(0))


def titles_present(left_over: DataFrame, sections: DataFrame) -> DataFrame:
    """``left_over`` (pair_id, title, ...) with ``present``: whether the title occurs in the other document's canonical text.

    That is the text of all sections, compared or not, titles included, one after the other. The distinct
    titles of a pair are looked up in one pass over it.
    """
    rows = left_over.withColumn("title_key", T.canonical_key(F.col("title")))
    asked = _renewed(rows.where("length(title_key) >= 8").select("pair_id", "title_key").distinct())
    text = T.canonical_key(F.concat_ws(" ", "full_title", "normalized_text"))
    order = F.col("order_index")
    body = _renewed(sections).join(_renewed(asked.select("pair_id").distinct()), "pair_id", "left_semi").select("pair_id", F.lit(1).alias("kind"), order, F.lit(None).cast("string").alias("key"), text.alias("text"))
    keys = asked.select("pair_id", F.lit(0).alias("kind"), F.lit(None).cast(sections.schema["order_index"].dataType).alias("order_index"), F.col("title_key").alias("key"), F.lit("").alias("text"))
    sorted_ = keys.unionByName(body).repartition("pair_id").sortWithinPartitions("pair_id", "kind", "order_index", "text")
    schema = StructType([StructField("pair_id", sections.schema["pair_id"].dataType), StructField("title_key", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[object, bytes | None, bytes]]:
            for batch in batches:
                pairs, ks, ts = (batch.column(n).to_pylist() for n in ("pair_id", "key", "text"))
                yield from ((p, k.encode() if k is not None else None, t.encode()) for p, k, t in zip(pairs, ks, ts, strict=True))

        hits = list(found_keys(each()))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in hits], to_arrow_type(schema[0].dataType)), pa.array([x.decode() for _, x in hits], pa.string())], schema.names)

    found = sorted_.mapInArrow(work, schema).withColumn("present", F.lit(True))
    return rows.join(_renewed(found), ["pair_id", "title_key"], "left").withColumn("present", F.coalesce("present", F.lit(False))).drop("title_key")


def match_sections(old: DataFrame, new: DataFrame, threshold: float = THRESHOLD, autojunk: bool = True) -> DataFrame:
    """One row an alignment: pair_id, match_id, status, old/new_section_id ("" if none), score, reason, phase, ord.

    status is matched, removed, added, or needs_review where a section has no
    partner but its title occurs in the other document.
    """
    first = written(indexed_matches(old, new), "matches")  # read several times below
    matched = first.where("new_section_id is not null")
    taken = matched.select("pair_id", F.col("new_section_id").alias("section_id"))
    open_ids = first.where("new_section_id is null").select("pair_id", F.col("old_section_id").alias("section_id"))
    texts = lambda df: df.withColumn("prefix", F.col("normalized_text"))
    open_old = titles_present(texts(old.join(open_ids, ["pair_id", "section_id"], "left_semi")), new)
    rest_old = written(_keys(open_old.withColumnRenamed("present", "exact"), "prefix", "exact"), "left-old")
    rest_new = _keys(texts(new.join(taken, ["pair_id", "section_id"], "left_anti")), "prefix")
    second = written(residual_matches(rest_old, rest_new, threshold, autojunk), "matches")
    pairs = matched.unionByName(second.where("new_section_id is not null"))
    done = pairs.select(
        "pair_id", F.concat_ws("_", F.lit("match"), "old_section_id", "new_section_id").alias("match_id"), F.lit("matched").alias("status"),
        "old_section_id", "new_section_id", "score", "reason", "phase", "ord",
    )

    def left_over(rows: DataFrame, is_old: bool) -> DataFrame:
        gone, where = ("removed", "new") if is_old else ("added", "old")
        status = F.when(F.col("present"), "needs_review").otherwise(gone)
        reason = F.when(F.col("present"), f"section title found in {where} document but could not be aligned").otherwise(
            "no matching section found" if is_old else "new section has no old counterpart"
        )
        sid = F.col("section_id")
        return rows.select(
            "pair_id", F.concat_ws("_", F.lit("match"), status, "section_id").alias("match_id"), status.alias("status"),
            (sid if is_old else F.lit("")).alias("old_section_id"), (F.lit("") if is_old else sid).alias("new_section_id"),
            F.when(F.col("present"), F.col("score")).otherwise(0.0).alias("score"), reason.alias("reason"), F.lit(2 if is_old else 3).alias("phase"), "ord",
        )

    no_new = second.where("new_section_id is null").select("pair_id", F.col("old_section_id").alias("section_id"), "score", "ord")
    no_new = no_new.join(_renewed(rest_old.select("pair_id", "section_id", F.col("exact").alias("present"))), ["pair_id", "section_id"])
    claimed = pairs.select("pair_id", F.col("new_section_id").alias("section_id"))
    no_old = new.where("comparison_enabled").join(claimed, ["pair_id", "section_id"], "left_anti").select("pair_id", "section_id", "title", F.lit(0.0).alias("score"), F.col("order_index").alias("ord"))
    return done.unionByName(left_over(no_new, True)).unionByName(left_over(titles_present(no_old, old), False))
