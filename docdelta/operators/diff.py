"""Edits between aligned sections, one row each.

Sections with equal canonical hashes are never diffed. Only the opcodes of the
others come from Python (those of the standard library's sequence matcher, in batches);
tokens, pages, classes, snippets and severities are Column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from docdelta.functions import text as T

CONTEXT = 6
TWO_LEVEL = 8000
# Ranges of so few items in all are left to the standard library; so few pairs of places are compared as they are.
SMALL, FEW = 48, 16

CHANGES = [
    "pair_id", "diff_id", "change_type", "old_section_id", "new_section_id", "section_number", "section_title", "page_v1", "page_v2",
    "deterministic_summary", "severity", "ai_summary", "old_snippet", "new_snippet",
    "old_prefix", "old_change", "old_suffix", "new_prefix", "new_change", "new_suffix", "phase", "ord", "edit",
]


def tokens_with_pages(section: str) -> Column:
    """array<struct<token,page>> of a section struct: of its page map, else of its text at its first page."""
    s = F.col(section)
    mapped = F.flatten(F.transform(s["page_map"], lambda x: F.transform(T.tokenize(x["text"]), lambda t: F.struct(t.alias("token"), x["page"].alias("page")))))
    plain = F.transform(T.tokenize(s["normalized_text"]), lambda t: F.struct(t.alias("token"), s["page_start"].cast("int").alias("page")))
    return T.let(mapped, lambda m: F.when(F.size(m) > 0, m).otherwise(plain))


def lines_of(section: str) -> Column:
    s = F.col(section)
    return F.when(F.size(s["page_map"]) > 0, F.transform(s["page_map"], lambda x: x["text"])).otherwise(F.array(s["normalized_text"]))


class Runs:
    """Longest common runs of ranges of two lists, as ``SequenceMatcher.find_longest_match`` finds them (no junk)."""

    def __init__(self, old: list[str], new: list[str]) -> None:
        names: dict[str, int] = {}
        self.old, self.new, self.cut = old, new, len(old)
        self.codes = np.array([names.setdefault(x, len(names)) for x in [*old, *new]], np.int64)
        self.sums: np.ndarray | None = None

    def hashes(self, lo: int, hi: int, size: int) -> np.ndarray:
        """A hash of each run of ``size`` that lies in [lo, hi) of both lists one after the other."""
        if self.sums is None:
            n, base = len(self.codes), np.uint64(0x9E3779B97F4A7C15)
            mixed = (self.codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            powers = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * powers(base)[:n])])
            self.back = powers(np.uint64(pow(int(base), -1, 2**64)))
        return (self.sums[lo + size : hi + 1] - self.sums[lo : hi + 1 - size]) * self.back[lo : hi + 1 - size]

    def first(self, a0: int, a1: int, b0: int, b1: int, size: int) -> tuple[int, int] | None:
        """The first place in the old range of a run of ``size`` that the new range holds too, and its first place there."""
        if (a1 - a0 - size + 1) * (b1 - b0 - size + 1) <= FEW:
            return next(((i, j) for i in range(a0, a1 - size + 1) for j in range(b0, b1 - size + 1) if self.old[i : i + size] == self.new[j : j + size]), None)
        mine, theirs = self.hashes(a0, a1, size), self.hashes(self.cut + b0, self.cut + b1, size)
        hits = np.flatnonzero(np.isin(mine, theirs))
        if not len(hits):
            return None
        return a0 + int(hits[0]), b0 + int((theirs == mine[hits[0]]).argmax())

    def longest(self, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """(i, j, size); of the longest runs the first one in the old list, then in the new one."""
        most = min(a1 - a0, b1 - b0)
        x, y = self.codes[a0:a1], self.codes[self.cut + b0 : self.cut + b1]
        same = lambda p, q: len(p) if (p == q).all() else int((p != q).argmax())
        ahead, behind = same(x[:most], y[:most]), same(x[::-1][:most], y[::-1][:most])
        # Nearly always the range begins or ends with its longest run, which one look at longer ones settles.
        low, step = max(ahead, behind), 1
        while low < most and self.first(a0, a1, b0, b1, min(low + step, most)):
            low, step = min(low + step, most), step * 2
        if low < most and step > 1:
            high = min(low + step, most)
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if self.first(a0, a1, b0, b1, mid) else (low, mid)
        if not low:
            return a0, b0, 0
        if low == ahead:
            return a0, b0, low
        at = self.first(a0, a1, b0, b1, low)
        if at is None or self.old[at[0] : at[0] + low] != self.new[at[1] : at[1] + low]:  # hashes of different runs were equal
            i, j, low = SequenceMatcher(None, self.old[a0:a1], self.new[b0:b1], autojunk=False).find_longest_match()
            return a0 + i, b0 + j, low
        return *at, low


def differing(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(i1, i2, j1, j2) of the spans that are not equal by ``SequenceMatcher(None, old, new, autojunk=False)``."""
    blocks, open_, runs = [], [(0, len(old), 0, len(new))], None
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 + b1 - b0 <= SMALL:
            blocks += [(a0 + i, b0 + j, n) for i, j, n in SequenceMatcher(None, old[a0:a1], new[b0:b1], autojunk=False).get_matching_blocks() if n]
            continue
        runs = runs or Runs(old, new)
        i, j, n = runs.longest(a0, a1, b0, b1)
        if n:
            blocks.append((i, j, n))
            open_ += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    out, a, b = [], 0, 0
    for i, j, n in [*sorted(blocks), (len(old), len(new), 0)]:
        if a < i or b < j:
            out.append((a, i, b, j))
        a, b = i + n, j + n
    return out


def opcodes(old: list[str], new: list[str], old_lines: list[str], new_lines: list[str], old_sizes: list[int], new_sizes: list[int], limit: int = TWO_LEVEL) -> list[list[int]]:
    """[i1, i2, j1, j2] of every span that differs; long sections differ by lines first."""
    if len(old) + len(new) <= limit:
        spans = [(0, len(old), 0, len(new))]
    else:
        offsets = []
        for sizes in (old_sizes, new_sizes):
            at = [0]
            for n in sizes:
                at.append(at[-1] + n)
            offsets.append(at)
        a, b = offsets
        spans = [(a[i], a[k], b[j], b[m]) for i, k, j, m in differing(old_lines, new_lines)]
    return [[i + i1, i + i2, j + j1, j + j2] for i, k, j, m in spans for i1, i2, j1, j2 in differing(old[i:k], new[j:m])]


def with_opcodes(rows: DataFrame, inputs: list[str], limit: int) -> DataFrame:
    """Rows with ``ops`` in place of the ``inputs`` of ``opcodes``. Batches of rows cross to Python and back by Arrow."""
    kept = [f for f in rows.schema if f.name not in inputs]
    schema = StructType([*kept, StructField("ops", ArrayType(ArrayType(IntegerType())))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ops = [opcodes(*row, limit) for row in zip(*[columns[c].to_pylist() for c in inputs], strict=True)]
            yield pa.RecordBatch.from_arrays([*(columns[f.name] for f in kept), pa.array(ops, pa.list_(pa.list_(pa.int32())))], schema.names)

    return rows.mapInArrow(work, schema)


def paired(matches: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Matched rows with both sections (structs o and n) whose canonical texts differ."""
    side = lambda df, name: df.select("pair_id", F.col("section_id").alias(f"{name}_section_id"), F.struct("*").alias(name[0]))
    joined = matches.where("status = 'matched'").join(side(old, "old"), ["pair_id", "old_section_id"]).join(side(new, "new"), ["pair_id", "new_section_id"])
    return joined.where("o.normalized_text_hash <> n.normalized_text_hash")


def edits(matches: DataFrame, old: DataFrame, new: DataFrame, two_level: int = TWO_LEVEL) -> DataFrame:
    """Edits inside matched sections."""
    rows = paired(matches, old, new).withColumns({"ot": tokens_with_pages("o"), "nt": tokens_with_pages("n")})
    names = lambda c: F.transform(c, lambda x: x["token"])
    sizes = lambda lines: F.transform(lines, lambda x: F.size(T.tokenize(x)))
    long = F.size("ot") + F.size("nt") > two_level
    none_text, none_int = F.array().cast("array<string>"), F.array().cast("array<int>")
    ol, nl = F.when(long, lines_of("o")).otherwise(none_text), F.when(long, lines_of("n")).otherwise(none_text)
    head = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in ("number", "title", "page_start")]).alias(s)
    inputs = {
        "_a": names(F.col("ot")), "_b": names(F.col("nt")), "_al": ol, "_bl": nl,
        "_as": F.when(long, sizes(lines_of("o"))).otherwise(none_int), "_bs": F.when(long, sizes(lines_of("n"))).otherwise(none_int),
    }
    rows = rows.select("pair_id", "old_section_id", "new_section_id", "phase", "ord", head("o"), head("n"), "ot", "nt", *[c.alias(k) for k, c in inputs.items()])
    rows = with_opcodes(rows, list(inputs), two_level)
    rows = rows.select("*", F.posexplode("ops").alias("pos", "op")).drop("ops")
    i1, i2, j1, j2 = (F.col("op")[k] for k in range(4))

    def span(tokens: str, a: Column, b: Column) -> Column:
        return F.transform(F.slice(F.col(tokens), a + 1, F.greatest(b - a, F.lit(0))), lambda x: x["token"])

    def around(tokens: str, a: Column, b: Column) -> list[Column]:
        lo, hi = F.greatest(a - CONTEXT, F.lit(0)), F.least(b + CONTEXT, F.size(tokens))
        return [T.join_tokens(span(tokens, lo, a)), T.join_tokens(span(tokens, a, b)), T.join_tokens(span(tokens, b, hi))]

    def page(tokens: str, at: Column, section: str) -> Column:
        found = F.get(F.col(tokens), F.least(at, F.size(tokens) - 1))["page"]
        return F.when(F.size(tokens) > 0, found).otherwise(F.col(f"{section}.page_start")).cast("string")

    parts = dict(zip(["old_prefix", "old_change", "old_suffix", "new_prefix", "new_change", "new_suffix"], [*around("ot", i1, i2), *around("nt", j1, j2)], strict=True))
    key = lambda tokens, a, b: T.canonical_key(F.array_join(span(tokens, a, b), " "))
    rows = rows.withColumns({"ok": key("ot", i1, i2), "nk": key("nt", j1, j2)}).where("ok <> nk")
    rows = rows.withColumns({**parts, "change_type": F.when(F.col("ok") == "", "added").when(F.col("nk") == "", "deleted").otherwise("changed"), "page_v1": page("ot", i1, "o"), "page_v2": page("nt", j1, "n")})
    # Tokens and texts end here, before the rows are numbered.
    rows = rows.select(
        "pair_id", "change_type", "old_section_id", "new_section_id", F.coalesce(F.nullif("n.number", F.lit("")), "o.number").alias("section_number"),
        F.coalesce(F.nullif("n.title", F.lit("")), "o.title").alias("section_title"), "page_v1", "page_v2", *parts, "phase", "ord", "pos",
    )
    order = Window.partitionBy("pair_id", "old_section_id", "new_section_id").orderBy("pos")
    joined = lambda s: T.join_tokens(F.array(f"{s}_prefix", f"{s}_change", f"{s}_suffix"))
    return rows.withColumn("edit", F.row_number().over(order)).withColumns(
        {
            "diff_id": F.concat_ws("_", F.lit("diff"), "change_type", F.coalesce(F.nullif("new_section_id", F.lit("")), "old_section_id"), F.col("edit").cast("string")),
            "deterministic_summary": F.concat(F.lit("Text "), "change_type", F.lit(".")), "severity": T.classify_severity(F.col("old_change"), F.col("new_change")),
            "ai_summary": F.lit(""), "old_snippet": joined("old"), "new_snippet": joined("new"),
        }
    ).select(*CHANGES)


def whole_sections(matches: DataFrame, sections: DataFrame, change_type: str) -> DataFrame:
    """One edit for each removed (``deleted``) or added section: its first words, always major."""
    status, side = ("removed", "old") if change_type == "deleted" else ("added", "new")
    body = sections.select("pair_id", F.col("section_id").alias(f"{side}_section_id"), "number", "title", "page_start", "normalized_text")
    rows = matches.where(F.col("status") == status).join(body, ["pair_id", f"{side}_section_id"])
    snippet, page, none = T.first_words(F.col("normalized_text")), F.col("page_start").cast("string"), F.lit("")
    old = side == "old"
    return rows.withColumns(
        {
            "diff_id": F.concat_ws("_", F.lit(f"diff_{change_type}_section"), f"{side}_section_id"), "change_type": F.lit(change_type), "section_number": F.col("number"),
            "section_title": F.col("title"), "page_v1": page if old else none, "page_v2": none if old else page, "deterministic_summary": F.lit(f"Section {change_type}."),
            "severity": F.lit("major"), "ai_summary": none, "old_snippet": snippet if old else none, "new_snippet": none if old else snippet, "old_prefix": none,
            "old_change": snippet if old else none, "old_suffix": none, "new_prefix": none, "new_change": none if old else snippet, "new_suffix": none, "edit": F.lit(1),
        }
    ).select(*CHANGES)


def diff(matches: DataFrame, old: DataFrame, new: DataFrame, two_level: int = TWO_LEVEL) -> DataFrame:
    """All edits; order of a pair: phase, ord, edit. Sections that need review give none."""
    inside = edits(matches, old, new, two_level)
    return inside.unionByName(whole_sections(matches, old, "deleted")).unionByName(whole_sections(matches, new, "added"))
