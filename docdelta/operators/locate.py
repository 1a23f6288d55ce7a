"""Where changes lie on their pages: highlight boxes of words.

Words: pair_id, side, page (from 1), word_no, x0, y0, x1, y1, word. A change is
searched in the letters and digits of its page, first with the words around
it, then without, then by ever shorter leads; the first hit in that order counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType
from pyspark.sql.window import Window

from docdelta.functions import text as T
from docdelta.operators.report import visual_groups

BOX = "array<struct<x0:double,y0:double,x1:double,y1:double>>"


def words_outside(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Words whose centre is in no region (pair_id, side, page, x0, y0, x1, y1) of their page."""
    cx, cy = (F.col("w.x0") + F.col("w.x1")) / 2, (F.col("w.y0") + F.col("w.y1")) / 2
    same = (F.col("w.pair_id") == F.col("r.pair_id")) & (F.col("w.side") == F.col("r.side")) & (F.col("w.page") == F.col("r.page"))
    inside = cx.between(F.col("r.x0"), F.col("r.x1")) & cy.between(F.col("r.y0"), F.col("r.y1"))
    return words.alias("w").join(regions.alias("r"), same & inside, "left_anti")


def page_index(words: DataFrame) -> DataFrame:
    """One row a page: its canonical text, and its words with the place of each in it."""
    order = Window.partitionBy("pair_id", "side", "page").orderBy("word_no")
    rows = words.withColumn("key", T.canonical_key(F.col("word"))).withColumn("end", F.sum(F.length("key")).over(order))
    pages = rows.groupBy("pair_id", "side", "page").agg(F.array_sort(F.collect_list(F.struct("word_no", "key", "end", "x0", "y0", "x1", "y1"))).alias("words"))
    return pages.withColumn("page_text", F.array_join(F.transform("words", lambda w: w["key"]), ""))


def _targets(prefix: Column, change: Column, suffix: Column) -> Column:
    """array<struct<target,skip,length>> in the order of search."""
    pre, core, post = T.canonical_key(prefix), T.canonical_key(change), T.canonical_key(suffix)
    one = lambda text, skip, length: F.struct(text.alias("target"), skip.alias("skip"), length.alias("length"))
    zero = F.lit(0)
    exact = F.array(
        one(F.concat(pre, core, post), F.length(pre), F.length(core)), one(F.concat(pre, core), F.length(pre), F.length(core)), one(F.concat(core, post), zero, F.length(core)), one(core, zero, F.length(core))
    )

    def leads(keys: Column) -> Column:
        n = F.size(keys)
        takes = F.filter(F.array(F.floor(n * 3 / 4).cast("int"), F.floor(n / 2).cast("int"), F.lit(12), F.lit(6), F.lit(3)), lambda t: t > 0)
        texts = F.transform(takes, lambda t: F.array_join(F.slice(keys, F.lit(1), t), ""))
        return F.flatten(F.transform(texts, lambda x: F.array(one(F.concat(pre, x), F.length(pre), F.length(x)), one(x, zero, F.length(x)))))

    keys = F.filter(F.transform(T.words(change), T.canonical_key), lambda k: k != "")
    return F.when(core == "", F.array().cast("array<struct<target:string,skip:int,length:int>>")).otherwise(F.filter(F.concat(exact, T.let(keys, leads)), lambda x: x["length"] > 0))


def located(changes: DataFrame, words: DataFrame, side: str) -> DataFrame:
    """Changes of one side with ``boxes``: the words that cover the changed text (none if it isn't found)."""
    name, page, types = ("old", "page_v1", ["deleted", "changed"]) if side == "v1" else ("new", "page_v2", ["added", "changed"])
    rows = changes.where(F.col("change_type").isin(types) & (T.strip(F.col(f"{name}_change")) != ""))
    rows = rows.withColumn("page", F.coalesce(F.trim(F.col(page)).try_cast("int"), F.lit(0)))
    pages = page_index(words.where(F.col("side") == side)).select("pair_id", "page", "words", "page_text")
    rows = rows.join(pages, ["pair_id", "page"], "left")
    targets = _targets(F.col(f"{name}_prefix"), F.col(f"{name}_change"), F.col(f"{name}_suffix"))
    hits = F.filter(F.transform(targets, lambda t: F.struct((F.instr(F.col("page_text"), t["target"]) - 1 + t["skip"]).alias("at"), (F.instr(F.col("page_text"), t["target"]) > 0).alias("hit"), t["length"].alias("length"))), lambda h: h["hit"])
    def covered(hit):
        a, b = hit["at"], hit["at"] + hit["length"]
        inside = F.filter("words", lambda w: (w["end"] > a) & (w["end"] - F.length(w["key"]) < b) & (F.length(w["key"]) > 0))
        boxes = F.transform(inside, lambda w: F.struct(*[w[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]))
        return F.when(hit.isNotNull(), boxes).otherwise(F.array().cast(BOX))

    return rows.withColumn("boxes", T.let(F.get(hits, F.lit(0)), covered)).drop("words", "page_text")


def highlights(changes: DataFrame, words: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """One row a box: pair_id, diff_id, side, page, kind, box_no, x0, y0, x1, y1."""
    if regions is not None:
        words = words_outside(words, regions)
    both = [located(changes, words, side).withColumn("side", F.lit(side)) for side in ("v1", "v2")]
    rows = both[0].unionByName(both[1])
    return rows.select("pair_id", "diff_id", "section_number", "section_title", "page_v1", "page_v2", "phase", "ord", "edit", "side", "page", F.col("change_type").alias("kind"), F.posexplode("boxes").alias("box_no", "box")).select("*", "box.*").drop("box")


def visual_diff(changes: DataFrame, words: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """The visual groups with their boxes on either side (arrays of page, kind and box)."""
    boxes = highlights(changes, words, regions)
    key = F.coalesce(F.nullif("section_number", F.lit("")), F.concat_ws("|", "page_v1", "page_v2", "section_title"))
    boxes = boxes.withColumn("group_key", key)
    rows = visual_groups(changes)
    for side in ("v1", "v2"):
        own = boxes.where(F.col("side") == side).groupBy("pair_id", "group_key").agg(
            F.array_sort(F.collect_list(F.struct("phase", "ord", "edit", "box_no", "page", "kind", "x0", "y0", "x1", "y1"))).alias("h")
        )
        listed = F.transform("h", lambda x: F.struct(*[x[c].alias(c) for c in ("page", "kind", "x0", "y0", "x1", "y1")]))
        rows = rows.join(own, ["pair_id", "group_key"], "left")
        rows = rows.withColumn(f"{side}_page", F.when((F.col(f"{side}_page") == 0) & (F.size("h") > 0), F.col("h")[0]["page"]).otherwise(F.col(f"{side}_page")))
        rows = rows.withColumn(f"{side}_highlights", listed).drop("h")
    assert not any(isinstance(f.dataType, NullType) for f in rows.schema)
    return rows


# Fill and stroke of each kind.
COLOURS = {"added": ("#4dcc66", "#1a8c33"), "deleted": ("#f77373", "#cc2626"), "changed": ("#ffb840", "#d9800d")}


def svg_overlays(boxes: DataFrame) -> DataFrame:
    """(pair_id, side, page, svg): the boxes of a page, a point wider on each side, to lay over its image."""
    fill = stroke = None
    for kind, (f, s) in COLOURS.items():
        fill = F.when(F.col("kind") == kind, f) if fill is None else fill.when(F.col("kind") == kind, f)
        stroke = F.when(F.col("kind") == kind, s) if stroke is None else stroke.when(F.col("kind") == kind, s)
    rect = F.format_string('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f" fill="%s" stroke="%s" fill-opacity="0.3" stroke-width="0.6"/>', F.col("x0") - 1, F.col("y0") - 1, F.col("x1") - F.col("x0") + 2, F.col("y1") - F.col("y0") + 2, fill.otherwise(COLOURS["changed"][0]), stroke.otherwise(COLOURS["changed"][1]))
    rows = boxes.groupBy("pair_id", "side", "page").agg(F.array_sort(F.collect_list(F.struct("phase", "ord", "edit", "box_no", rect.alias("r")))).alias("r"))
    return rows.select("pair_id", "side", "page", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), F.array_join(F.transform("r", lambda x: x["r"]), ""), F.lit("</svg>")).alias("svg"))
