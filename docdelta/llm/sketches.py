"""Document fingerprints: bottom-k sketches of word shingles, in SQL functions only.

A shingle is five successive words of the text in lower case (A-Z); a text of
fewer words is one shingle. Its hash is XXH64 chained over its words (each
word's hash seeds the next, the first seed is 42), of which the upper 48 bits
count. A sketch is the ``K`` least distinct hashes in ascending order. Sketches
of parts merge into the sketch of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

K = 128
WIDTH = 5
BITS = 48
MOST_BUCKETS = 1 << 16
SAMPLED = 8
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a text, array<long>; of a null text or one without words, an empty array."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACE), lambda w: w != "")

    def hashes(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.least(F.size(w), F.lit(1))))
        return F.transform(starts, lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, width)]), 64 - BITS))

    return F.slice(F.sort_array(F.array_distinct(let(words, hashes))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets, exact if neither sketch is full. Two empty sets: 1."""

    def of(union: Column) -> Column:
        return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)

    whole = F.array_union(a, b)
    least = F.when((F.size(a) < k) & (F.size(b) < k), whole).otherwise(F.slice(F.sort_array(whole), 1, k))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(let(least, of))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact if the sketch isn't full."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that lies in the second (1 for an empty first set)."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def merged(parts: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch a key, of the union of its parts. A hot key is cut to ``k`` ranks before the shuffle."""
    each = parts.select(*keys, F.explode(column).alias("_h"))
    ranked = each.withColumn("_r", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    found = ranked.groupBy(*keys).agg(F.sort_array(F.collect_set("_h")).alias(column))
    empty = parts.select(*keys).distinct().join(found.select(*keys), keys, "left_anti")
    return found.unionByName(empty.withColumn(column, F.array().cast("array<long>")))


def fingerprint(a: Column) -> Column:
    """A sketch as text, twelve hex digits a hash. Equal texts have equal fingerprints."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def with_next(docs: DataFrame, derive, per_bucket: int = 1024) -> DataFrame:
    """Every row with the columns that ``derive`` adds, and ``next``: a struct of the next row's.

    Rows go by doc_id (nulls first), then by a hash of the text; the last row's
    next is the first. Rows are dealt into ranges of about ``per_bucket`` rows
    (more where there would be over ``MOST_BUCKETS``), each of which also gets
    the first row of the range that follows, so no task sees all rows. Borders
    are quantiles of a sample of (doc_id, hash, number of the row): outlying,
    null and repeated ids crowd no range.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row")).withColumns(
        {"known": F.col("doc_id").isNotNull().cast("int"), "d": F.coalesce("doc_id", F.lit(0)), "h": F.xxhash64("text"), "u": F.xxhash64("row")}
    )
    order = ["known", "d", "h", "u"]
    n = rows.count()
    buckets = min(MOST_BUCKETS, n // per_bucket + 1)
    borders: list[tuple] = []
    if buckets > 1:
        share = min(1.0, SAMPLED * buckets / n)
        drawn = rows.select(*order).where(F.pmod("u", F.lit(1 << 30)) <= int(share * (1 << 30))).collect()
        drawn = sorted(map(tuple, drawn))
        borders = sorted({drawn[len(drawn) * i // buckets] for i in range(1, buckets)}) if drawn else []
    bucket = F.lit(0)
    if borders:
        # Constant arrays, searched by halves: the number of borders that are not above the row.
        arrays = [F.expr(f"CAST(split('{','.join(str(b[i]) for b in borders)}', ',') AS ARRAY<BIGINT>)") for i in range(4)]
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(borders).bit_length()))])

        def step(at: Column, by: Column) -> Column:
            reached = F.lit(True)
            for name, values in reversed(list(zip(order, arrays, strict=True))):
                border = F.get(values, at + by - 1)
                reached = (border < F.col(name)) | ((border == F.col(name)) & reached)
            return F.when((at + by <= len(borders)) & reached, at + by).otherwise(at)

        bucket = F.aggregate(steps, F.lit(0), step)
    rows = rows.withColumn("bucket", bucket)
    firsts = materialize(rows.groupBy("bucket").agg(F.min(F.struct(*order[:3])).alias("f")), "firsts")
    by = Window.orderBy("bucket")  # at most MOST_BUCKETS rows
    everything = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = firsts.select("f.known", "f.d", "f.h", F.coalesce(F.lag("bucket").over(by), F.max("bucket").over(everything)).alias("to"))
    extra = rows.drop("bucket").join(F.broadcast(before), ["known", "d", "h"]).withColumnRenamed("to", "bucket").dropDuplicates(["bucket", *order[:3]])
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))
    derived = derive(both.repartition("bucket"))
    helpers = ["bucket", "extra", "row", *order]
    names = [c for c in derived.columns if c not in helpers]
    window = Window.partitionBy("bucket").orderBy("extra", *order)
    return derived.withColumn("next", F.lead(F.struct(*names)).over(window)).where("not extra").drop(*helpers)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the text whose last floor(n_chars / 2) code points give
    way to the first as many (or all) of the next document. Defined cases: a
    null text is empty; an empty text or one without words has an empty
    fingerprint, like only to other empty ones (1, else 0). A table of one row
    is its own next. Repeated rows count one by one. Rows with a null doc_id
    come first. Empty table: empty result. Extra columns are ignored.
    """
    rows = with_next(docs, lambda df: df.withColumn("sketch", sketch(F.col("text"), k)))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sketch", edited.alias("edited"), F.col("next.sketch").alias("after"))
    rows = rows.select("doc_id", "n_chars", "sketch", "after", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), k).alias("other"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("other"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("after"), k).alias("near_next"),
    )
