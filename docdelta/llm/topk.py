"""Exact inner-product top-k with a pivot-distance index.

Vectors become integers floor(scale * x) and get one more coordinate that
gives all of them the same norm R, so that distance and inner product order
alike: d(q, x)^2 = |q|^2 + R^2 - 2 q.x. Each vector is keyed by its nearest
pivot and its distance to it. A query first searches the block where it lies
itself, which bounds its k-th score from below and so its search radius.
A pivot's rows are cut into blocks by ranges of that distance, and a query
visits only the blocks that the annulus of its radius meets, by the triangle
inequality. In a block the annulus around the query's own pivot distance is
expanded outwards and stops at the radius. Pivots and ranges are fitted on
bounded summaries; the answer is exact whatever they are.

Rows of equal vectors can't be told apart by distance. Where they crowd a
range, only the k + 1 that any query can have among its best are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

PIVOTS = 32
SAMPLE = 4096
BLOCK = 8192
QUERIES = 65536
RANGES = 4096
SLACK = 1e-9


def quantized(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(rid, vec_id, v array<double>) of the vectors that take part."""
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.where(F.col(vector_col).isNotNull()).where(F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), x.alias("v")
    )


def choose_pivots(sample: np.ndarray, n: int = PIVOTS, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Centres of a few rounds of Lloyd's algorithm, started by k-means++."""
    rng = np.random.default_rng(seed)
    centres = [sample[0]]
    near = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(n, len(sample)) and near.max() > 0:
        centres.append(sample[rng.choice(len(sample), p=near / near.sum())])
        near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(axis=1))
    out = np.array(centres)
    for _ in range(rounds):
        own = distances(sample, out).argmin(axis=1)
        for k in range(len(out)):
            if (own == k).any():
                out[k] = sample[own == k].mean(axis=0)
    return out


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T
    return np.sqrt(np.maximum(d, 0))


def lifted(v: np.ndarray, square: float) -> np.ndarray:
    """The vectors with the coordinate that brings their squared norms to ``square``."""
    return np.c_[v, np.sqrt(np.maximum(square - (v * v).sum(axis=1), 0))]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, filled with zeros up to ``dim``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), dim))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(flat) == out.size:
        return flat.reshape(out.shape).astype(np.float64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


STEP = 1024


def search(q: np.ndarray, q_rid: np.ndarray, q_dist: np.ndarray, tau: np.ndarray, v: np.ndarray, rid: np.ndarray, vec_id: np.ndarray, r: np.ndarray, square: float, k: int):
    """The best ``k`` of a block for each query: (query index, row index, score) arrays.

    ``r`` is ascending; ``tau`` bounds each query's k-th score from below (-inf:
    unknown). The annulus around the queries' pivot distances grows by ``STEP``
    rows a side and stops where |r - q_dist| exceeds the radius that every
    query's k-th score so far allows.
    """
    norms = (q * q).sum(axis=1)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(q_dist, kind="stable")
    for at in range(0, len(order), 256):
        pick = order[at : at + 256]
        dist, bound = q_dist[pick], tau[pick].copy()
        best = np.full((len(pick), k), -np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def score(a: int, b: int, pick=pick, kept=kept) -> None:
            nonlocal best, bound
            s = q[pick] @ v[a:b].T
            s[q_rid[pick][:, None] == rid[None, a:b]] = -np.inf
            both = np.concatenate([best, s], axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            bound = np.maximum(bound, best.min(axis=1))
            rows, columns = np.nonzero((s >= bound[:, None]) & (s > -np.inf))
            kept.append((rows, columns + a, s[rows, columns]))

        lo = hi = int(np.searchsorted(r, np.median(dist)))
        grown = True
        while grown:
            grown = False
            for left in (True, False):
                radius = np.sqrt(np.maximum(norms[pick] + square - 2 * bound, 0)) * (1 + SLACK) + 1e-6
                if left and lo > 0 and r[lo - 1] >= (dist - radius).min():
                    lo, end, grown = max(0, lo - STEP), lo, True
                    score(lo, end)
                elif not left and hi < len(r) and r[hi] <= (dist + radius).max():
                    start, hi, grown = hi, min(len(r), hi + STEP), True
                    score(start, hi)
        if not kept:
            continue
        rows, columns, s = (np.concatenate(x) for x in zip(*kept, strict=True))
        good = s >= bound[rows]
        rows, columns, s = rows[good], columns[good], s[good]
        by = np.lexsort((rid[columns], vec_id[columns], -s, rows))
        rows, columns, s = rows[by], columns[by], s[by]
        first = np.searchsorted(rows, np.arange(len(pick)))
        good = np.arange(len(rows)) - first[rows] < k
        parts.append((pick[rows[good]], columns[good], s[good]))
    if not parts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


LAST = np.iinfo(np.int64).max


def top_k(df: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """The ``k`` best rows of ``df`` for every row that meets the condition ``queries`` (of ``vec_id``).

    query_id, rank, vec_id, score. Candidates are all rows but the query's own;
    ties go to the smaller vec_id. Defined cases: a vector that is null or
    holds a null or non-finite component takes no part; shorter vectors are
    filled with zeros. Repeated ids are rows of their own. A null id can be
    found (last among ties) but not ask. Fewer than ``k`` others: all of them.
    Empty table: empty result. Extra columns are ignored.
    """
    spark = df.sparkSession
    rows = materialize(quantized(df, id_col, vector_col, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.coalesce(F.max(square), F.lit(0.0)).alias("square")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not stats["n"] or not stats["dim"]:
        return spark.createDataFrame([], schema)
    n, dim, R2 = stats["n"], stats["dim"], float(stats["square"])
    share = min(1.0, 1.2 * SAMPLE / n)
    drawn = rows.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("rid", "v").collect()
    sample = np.zeros((max(1, min(len(drawn), SAMPLE)), dim))
    for line, row in zip(sample, sorted(drawn, key=lambda x: x["rid"]), strict=False):
        line[: len(row["v"])] = row["v"]
    centres = choose_pivots(lifted(sample, R2), pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(2), dim)
            d = distances(lifted(v, R2), centres)
            own = d.argmin(axis=1)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), len(v), [None, pa.py_buffer(np.ascontiguousarray(v).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(v)), own]), packed], ["rid", "vec_id", "pivot", "r", "v"])

    keyed = materialize(rows.mapInArrow(key, "rid long, vec_id long, pivot int, r double, v binary"), "keyed")
    sizes = {s["pivot"]: s["n"] for s in keyed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    most = min(RANGES, max(-(-s // block) for s in sizes.values()))
    borders: dict[int, np.ndarray] = {p: np.zeros(0) for p in sizes}
    if most > 1:
        grid = keyed.groupBy("pivot").agg(F.percentile_approx("r", F.array(*[F.lit(i / most) for i in range(1, most)]), F.lit(4 * most)).alias("b")).collect()
        for s in grid:  # a smaller pivot takes every so many of the grid's borders
            wanted = min(most, -(-sizes[s["pivot"]] // block))
            borders[s["pivot"]] = np.unique(np.array(s["b"])[[round(i * most / wanted) - 1 for i in range(1, wanted)]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, r = b.column(2).to_numpy(), b.column(3).to_numpy()
            found = np.zeros(len(r), np.int32)
            for p in np.unique(pivot).tolist():
                found[pivot == p] = np.searchsorted(borders[p], r[pivot == p], side="left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*b.schema.names, "range"])

    fields = "rid long, vec_id long, pivot int, r double, v binary"
    index = keyed.mapInArrow(place, f"{fields}, range int")
    asking = index.where(queries)
    spot = F.struct("pivot", "range")

    def summed_up(df: DataFrame) -> dict:
        rows = df.groupBy("pivot", "range").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
        return {(x["pivot"], x["range"]): x for x in rows}

    summary = summed_up(index)
    crowded = [s for s, x in summary.items() if x["n"] > 2 * block]
    if crowded:
        full = spot.isin(*[F.struct(F.lit(p).alias("pivot"), F.lit(s).alias("range")) for p, s in crowded])
        copy = F.row_number().over(Window.partitionBy("v").orderBy(F.coalesce("vec_id", F.lit(LAST)), "rid"))
        thin = index.where(full).withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
        index = materialize(index.where(~full).unionByName(thin), "index")
        summary = summed_up(index)
    # What no border parts (the grid is bounded, and distances tie) is dealt over blocks that are all visited.
    parts = {s: -(-x["n"] // block) if x["n"] > 2 * block else 1 for s, x in summary.items()}
    split = {s: n for s, n in parts.items() if n > 1}
    salts = F.lit(1)
    if split:
        salts = F.coalesce(F.try_element_at(F.create_map(*[y for (p, s), n in split.items() for y in (F.lit(p * RANGES + s), F.lit(n))]), F.col("pivot") * RANGES + F.col("range")), F.lit(1))
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("rid"), salts).cast("int"))
    index, asking = salted(index), salted(asking)
    chunks = max(1, -(-asking.count() // QUERIES))
    asking = asking.withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(chunks)).cast("int"))

    def block_of(t: pa.Table):
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, dim)
        ids = np.array([LAST if x is None else x for x in t.column("vec_id").to_pylist()], np.int64)
        return v, t.column("rid").to_numpy(), ids, t.column("r").to_numpy()

    def run(left: pa.Table, right: pa.Table, tau_given: bool):
        q, q_rid, q_id, q_r = block_of(left)
        v, rid, ids, r = block_of(right)
        order = np.argsort(r, kind="stable")
        v, rid, ids, r = v[order], rid[order], ids[order], r[order]
        tau = left.column("tau").to_numpy() if tau_given else np.full(len(q), -np.inf)
        at, x, s = search(q, q_rid, q_r, tau, v, rid, ids, r, R2, k)
        return q_rid, q_id, at, ids[x], rid[x], s

    def home(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"rid": left.column("rid"), "tau": pa.array(np.full(left.num_rows, -np.inf))})
        q_rid, _, at, _, _, s = run(left, right, False)
        count = np.bincount(at, minlength=len(q_rid))
        least = np.full(len(q_rid), np.inf)
        np.minimum.at(least, at, s)
        return pa.table({"rid": pa.array(q_rid), "tau": pa.array(np.where(count >= k, least, -np.inf))})

    keys = ["pivot", "range", "salt"]
    bounds = asking.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(home, "rid long, tau double")
    asked = materialize(asking.join(bounds, "rid"), "queries")

    limits = {}
    for p in sizes:
        held = sorted(s for s in summary if s[0] == p)
        limits[p] = (np.array([s[1] for s in held]), np.array([summary[s]["lo"] for s in held]), np.array([summary[s]["hi"] for s in held]), np.array([parts[s] for s in held]))
    fields = "rid long, vec_id long, r double, v binary, tau double, chunk int, pivot int, range int, salt int"

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            q = np.frombuffer(b"".join(t["v"].to_pylist()), np.float64).reshape(-1, dim)
            tau = t["tau"].to_numpy()
            norms = (q * q).sum(axis=1)
            radius = np.sqrt(np.maximum(norms + R2 - 2 * tau, 0)) * (1 + SLACK) + 1e-6
            d = distances(np.c_[q, np.zeros(len(q))], centres)
            for p, (ranges, lo, hi, n) in limits.items():
                for at, part in enumerate(ranges.tolist()):
                    pick = pa.array(np.flatnonzero(np.maximum(lo[at] - d[:, p], d[:, p] - hi[at]) <= radius))
                    for s in range(n[at] if len(pick) else 0):
                        spots = [pa.array(np.full(len(pick), x, np.int32)) for x in (p, part, s)]
                        yield pa.RecordBatch.from_arrays(
                            [t["rid"].take(pick), t["vec_id"].take(pick), pa.array(d[pick.to_numpy(), p]), t["v"].take(pick), t["tau"].take(pick), t["chunk"].take(pick), *spots],
                            [f.split()[0] for f in fields.split(", ")],
                        )

    def rest(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            q_rid, q_id, at, ids, rid, s = run(left, right, True)
        else:
            q_rid = q_id = at = ids = rid = np.zeros(0, np.int64)
            s = np.zeros(0)
        return pa.table({"q": pa.array(q_rid[at]), "query_id": pa.array(q_id[at]), "vec_id": pa.array(ids), "x": pa.array(rid), "score": pa.array(s.astype(np.int64))})

    asked = asked.select("rid", "vec_id", "r", "v", "tau", "chunk").mapInArrow(visits, fields)
    copies = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    keys = [*keys, "chunk"]
    near = asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(rest, "q long, query_id long, vec_id long, x long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "x")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != LAST, F.col("vec_id")).alias("vec_id"), "score")
