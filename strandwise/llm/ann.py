"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is centred, normalised and rotated by ``ROTATIONS`` seeded random orthogonal
matrices; the signs of all rotated coordinates are its code, packed into 64-bit words.
With the norm, the inner product with the centre and the inner product of a vector with
its own code as correction scalars, the inner product with any query is estimated from
the code alone, and the estimate comes with an error bound that holds with high
probability. Queries are cut to ``QUERY_BITS`` bits a coordinate, so an estimate is a sum
of bit counts of (code and query plane).

1. Codes are made once and written. Of equal vectors only the ``k + 1`` smallest ids are
   candidates: ties go to the smaller id, so no other can be among the k nearest.
2. The stated query set meets the codes in blocks (a block of codes, a chunk of queries).
   The first words of a code give wide bounds; what can still reach the k-th largest
   lower bound is looked at with all words. A block returns, for each query, what its
   bounds leave and its k largest lower bounds.
3. The k-th largest lower bound over all blocks cuts each query's candidates again. Only
   vectors that are then left travel, once to each (block, chunk) that asks for them, and
   are compared in double precision.

How far it goes: codes are sent once per chunk of queries and queries once per block, so
this part of the shuffle grows with the square of the vectors, divided by the (large)
chunk; so does the search of all rows itself. The centre is the mean of a bounded sample
(``SAMPLE`` rows by smallest hash); every row is encoded and searched.

Edge cases: vectors that are null, zero, of another length than most of the sample, or
that hold null or non-finite components take no part; ties go to the smaller id; with
fewer candidates than k all are returned; of several rows with one id the smallest vector
(component by component) stands; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import list_array, stage

K = 20
#: Codes in a block and queries in a chunk.
BLOCK = 1 << 17
CHUNK = 1 << 14
SAMPLE = 4096
SEED = 29
#: Rotations, and how many of them the first look uses; a code has so many bits a component.
ROTATIONS, FIRST = 16, 4
QUERY_BITS = 4
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 2.0


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the vectors that take part, one per id."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """Seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotations(dim: int, n: int = ROTATIONS) -> np.ndarray:
    """``n`` rotations side by side, each padded to whole 64-bit words; the rows keep
    their length."""
    wide = -(-dim // 64) * 64
    return np.hstack([rotation(wide, SEED + i)[:dim] for i in range(n)]) / np.sqrt(n)


class Codes:
    """One-bit codes of some vectors (words of 64 signs) and their correction scalars."""

    def __init__(self, words: np.ndarray, norm: np.ndarray, own: np.ndarray, with_centre: np.ndarray):
        self.words, self.norm, self.own, self.with_centre = words, norm, own, with_centre
        #: a column for each word, so that one query meets all vectors word by word
        self.columns = np.ascontiguousarray(words.T)
        self.bits = 64 * words.shape[1]

    @classmethod
    def of(cls, vectors: np.ndarray, centre: np.ndarray, rotate: np.ndarray) -> Codes:
        residual = vectors - centre
        norm = np.linalg.norm(residual, axis=1)
        turned = (residual / np.where(norm > 0, norm, 1)[:, None]) @ rotate
        words = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)
        # inner product of the unit vector with its own code, for all words and for the first
        own = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
        first = turned.shape[1] // ROTATIONS * FIRST
        own_first = np.abs(turned[:, :first]).sum(axis=1) / np.sqrt(first) * np.sqrt(turned.shape[1] / first)
        return cls(words, norm, np.maximum(np.stack((own_first, own), axis=1), 1e-9), vectors @ centre)

    def take(self, at: np.ndarray) -> Codes:
        return Codes(self.words[at], self.norm[at], self.own[at], self.with_centre[at])


class Query:
    """A rotated query, cut to a few bits a coordinate and laid out in bit planes."""

    def __init__(self, query: np.ndarray, centre: np.ndarray, rotate: np.ndarray):
        residual = query - centre
        self.size = float(np.linalg.norm(residual))
        self.with_centre = float(query @ centre) - float(centre @ centre)
        # rows of all rotations together keep the length, so of some of them only a part
        self.levels = []
        turned = residual @ rotate
        for bits in (len(turned) // ROTATIONS * FIRST, len(turned)):
            part = turned[:bits] * np.sqrt(len(turned) / bits)
            low = part.min(initial=0.0)
            step = max((part.max(initial=0.0) - low) / (2**QUERY_BITS - 1), 1e-12)
            cut = np.floor((part - low) / step + 0.5).astype(np.uint8)
            planes = np.stack([np.packbits(cut >> b & 1, bitorder="little").view(np.uint64) for b in range(QUERY_BITS)])
            self.levels.append((bits, low, step, planes, float(low * bits + step * cut.sum())))

    def bounds(self, codes: Codes, level: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with all codes, and the width of their bounds."""
        bits, low, step, planes, total = self.levels[level]
        n = codes.columns.shape[1]
        ones, weighted = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for word in range(bits // 64):
            column = codes.columns[word]
            ones += np.bitwise_count(column)
            for b in range(QUERY_BITS):
                weighted += np.bitwise_count(column & planes[b, word]).astype(np.int32) << b
        # signs are 2 * bit - 1; coordinates are low + step * cut
        signed = (2 * (low * ones + step * weighted) - total) / np.sqrt(bits)
        own = codes.own[:, level]
        estimate = signed * codes.norm / own + codes.with_centre + self.with_centre
        spread = codes.norm * np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(bits - 1, 1))
        return estimate, epsilon * self.size * spread


def candidates(ids: np.ndarray, codes: Codes, query_id: int, query: Query, k: int, epsilon: float = EPSILON):
    """Places in a block that may hold one of the k nearest, with their upper bounds, and
    the k largest lower bounds."""
    at = np.flatnonzero(ids != query_id)
    for level in (0, 1):
        some = codes.take(at) if level else codes
        estimate, width = query.bounds(some, level, epsilon)
        if not level:
            estimate, width = estimate[at], width[at]
        lower, upper = estimate - width, estimate + width
        if len(at) > k:
            floor = np.partition(lower, len(lower) - k)[len(lower) - k]
            stay = upper >= floor
            at, lower, upper = at[stay], lower[stay], upper[stay]
    return at, upper, np.sort(lower)[::-1][:k]


def exact_best(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of some vectors in double precision; a row's sum does not depend on
    which rows it is computed with."""
    score = (vectors * query).sum(axis=1)
    best = np.lexsort((ids, -score))[:k]
    return ids[best], score[best]


def _matrix(values: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
    return np.asarray(values.flatten(), dtype=kind).reshape(len(values), -1)


def encoded(vectors: DataFrame, centre: np.ndarray, blocks: int, k: int) -> DataFrame:
    """``block, vec_id, words, norm, own_first, own, with_centre`` of all candidates."""
    same = Window.partitionBy("embedding").orderBy("vec_id")
    rows = vectors.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).select("vec_id", "embedding")
    names = ["vec_id", "words", "norm", "own_first", "own", "with_centre"]

    def run(batches):
        rotate = rotations(len(centre))
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = Codes.of(_matrix(batch.column(1), np.float64), centre, rotate)
            words = list_array(codes.words.view(np.int64).ravel(), np.full(batch.num_rows, codes.words.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), words, pa.array(codes.norm), pa.array(codes.own[:, 0].copy()), pa.array(codes.own[:, 1].copy()), pa.array(codes.with_centre)], names)

    out = rows.mapInArrow(run, "vec_id long, words array<long>, norm double, own_first double, own double, with_centre double")
    return out.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))


_LOOK = "block int, chunk int, query_id long, ids array<long>, uppers array<double>, lowers array<double>"


def _look(centre: np.ndarray, k: int, epsilon: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in ("query_id", "ids", "uppers", "lowers")}
        if left.num_rows and right.num_rows:
            rotate = rotations(len(centre))
            ids = left.column("vec_id").to_numpy()
            scalars = (left.column(c).to_numpy() for c in ("norm", "own_first", "own", "with_centre"))
            norm, own_first, own, with_centre = scalars
            codes = Codes(_matrix(left.column("words"), np.int64).view(np.uint64), norm, np.stack((own_first, own), axis=1), with_centre)
            for query_id, vector in zip(right.column("query_id").to_pylist(), _matrix(right.column("query"), np.float64), strict=True):
                at, upper, lower = candidates(ids, codes, query_id, Query(vector, centre, rotate), k, epsilon)
                for name, value in (("query_id", query_id), ("ids", ids[at]), ("uppers", upper), ("lowers", lower)):
                    out[name].append(value)
        n = len(out["query_id"])
        key = lambda c: pa.array(np.full(n, (left if left.num_rows else right).column(c)[0].as_py(), np.int32))
        lists = [pa.array(out[c], pa.list_(pa.int64() if c == "ids" else pa.float64())) for c in ("ids", "uppers", "lowers")]
        return pa.table([key("block"), key("chunk"), pa.array(out["query_id"], pa.int64()), *lists], ["block", "chunk", "query_id", "ids", "uppers", "lowers"])

    return run


def _compare(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        ids, vectors = left.column("vec_id").to_numpy(), _matrix(left.column("embedding"), np.float64)
        order = np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        parts = []
        for query_id, query, asked in zip(right.column("query_id").to_pylist(), _matrix(right.column("query"), np.float64), right.column("ids"), strict=True):
            found = np.searchsorted(ids, np.asarray(asked.values))
            best, score = exact_best(ids[found], vectors[found], query, k)
            parts.append((np.full(len(best), query_id), best, score))
        if not parts:
            return none
        q, v, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    return run


def looked_at(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, chunk: int = CHUNK, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame] | None:
    """The written vectors (``vec_id, embedding, query``), and per ``block, chunk,
    query_id`` the ``ids`` that are to be compared exactly."""
    rows = stage(usable(vectors).withColumn("query", is_query), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    # one row: the sample's usual length; then the mean of its vectors
    dim_row = sample.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dim_row is None:
        return None
    rows = rows.where(F.size("embedding") == dim_row["dim"])
    means = sample.where(F.size("embedding") == dim_row["dim"]).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
    centre = np.array([r["m"] for r in means])
    n, asked = rows.count(), rows.where("query").count()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-asked // chunk))
    codes = stage(encoded(rows, centre, blocks, k), "codes")
    queries = rows.where("query").select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = codes.withColumn("chunk", every(chunks))
    right = queries.withColumn("block", every(blocks))
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(_look(centre, k, epsilon), _LOOK)
    found = stage(found, "candidates")
    # k numbers per query and block
    tops = found.groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("lowers")), asc=False).alias("lowers"))
    floors = tops.select("query_id", F.coalesce(F.get("lowers", F.lit(k - 1)), F.lit(float("-inf"))).alias("floor"))
    stay = F.filter(F.arrays_zip("ids", "uppers"), lambda c: c["uppers"] >= F.col("floor"))
    cut = found.join(floors, "query_id").select("block", "chunk", "query_id", F.transform(stay, lambda c: c["ids"]).alias("ids"))
    return rows, stage(cut.where(F.size("ids") > 0), "asked")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, chunk: int = CHUNK, epsilon: float = EPSILON) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every query, nearest first."""
    looked = looked_at(vectors, is_query, k, block, chunk, epsilon)
    if looked is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = looked
    wanted = asked.select("block", "chunk", F.explode("ids").alias("vec_id")).distinct()
    left = wanted.join(rows.select("vec_id", "embedding"), "vec_id")
    right = asked.join(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id")
    right = right.select(F.col("block").alias("of_block"), F.col("chunk").alias("of_chunk"), "query_id", "ids", "query")
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("of_block", "of_chunk")).applyInArrow(_compare(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
