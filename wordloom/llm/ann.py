"""Nearest neighbours by multi-index hashing.

Learned codes: vectors are lifted by one component so that the largest inner product is the smallest angle,
then rotated by several orthogonal matrices, each learned by iterative quantisation on a bounded sample, and
the signs are the bits. A code is cut into m substrings of 16 bits and every substring has an index from its
value to the rows that hold it. If two codes differ in at most ``radius`` bits, then for limits that add up to
radius - m + 1 at least one substring differs in no more than its limit, so probing the buckets within the limits
retrieves every code within the radius. The full codes of these rows are then compared, and the vectors of those within the
radius, and of no others, are ranked by their inner product in double precision.

The radius is what holds ``target`` of the true neighbours of sample queries among the sample; neighbours
in the whole table are nearer, so it errs to the safe side. A query that finds fewer than k rows within it
is asked again with the radius of all bits.

Rows are dealt to blocks and queries to groups by a number of their own; every block meets every group in a task of its own,
which holds one block and one group. Each block answers with its k best, and the best of all blocks are the result.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, neither do rows without
vec_id; a product needs vectors of one length, so each length is searched for itself; every row counts, also rows that
repeat a vec_id: each is a candidate of its own and, if its id is asked for, a query of its own (with ranks of its own), for
which only the row itself is no candidate; a query with fewer candidates than k gets them all; equal scores are ordered by
vec_id; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Vectors that rotations and radius are fitted on.
SAMPLE = 8192
BITS = 256
SUB = 16
TARGET = 0.95
#: Rows of a block and queries of a group.
BLOCK = 16384
GROUP = 16384


def learn_rotations(x: np.ndarray, bits: int = BITS, steps: int = 20, seed: int = 5) -> np.ndarray:
    """Iterative quantisation from random starts, as one matrix of ``bits`` columns."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    out = []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(unit.T @ np.where(unit @ r >= 0, 1.0, -1.0))
            r = u @ v
        out.append(r)
    return np.concatenate(out, axis=1)[:, :bits]


class Coder:
    def __init__(self, rotations: np.ndarray, top_norm: float):
        self.rotations, self.top = rotations, top_norm

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Codes of candidates, as 16-bit substrings."""
        return self._bits(np.hstack([x, np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0.0))[:, None]]))

    def queries(self, x: np.ndarray) -> np.ndarray:
        return self._bits(np.hstack([x, np.zeros((len(x), 1))]))

    def _bits(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.rotations >= 0, axis=1).view(np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of every code of a to every code of b."""
    wide = lambda c: np.ascontiguousarray(c).view(np.uint64)
    a, b = wide(a), wide(b)
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def limits(radius: int, parts: int) -> list[int]:
    """Bits that may differ in each substring; they add up to radius - parts + 1."""
    near, more = divmod(radius - parts + 1, parts)
    return [near + (k < more) for k in range(parts)]


class MultiIndex:
    """One index per substring: from each value to the rows that hold it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            starts = np.searchsorted(codes[order, s], np.arange((1 << SUB) + 1))
            values = np.flatnonzero(np.diff(starts)).astype(np.uint16)
            self.tables.append((values, order, starts))

    def buckets(self, value: int, s: int, limit: int) -> np.ndarray:
        """Values of substring s that rows hold within ``limit`` bits of a value: enumerated, or looked for among those held,
        whichever are fewer."""
        values, _, starts = self.tables[s]
        masks = near_masks(limit)
        if len(masks) < len(values):
            found = masks ^ np.uint16(value)
            return found[starts[found.astype(np.int64) + 1] > starts[found]]
        return values[np.bitwise_count(values ^ np.uint16(value)) <= limit]

    def probe(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows in a bucket that the pigeonhole principle admits, of full distance <= radius."""
        admitted = np.zeros(len(self.codes), dtype=bool)
        for s, limit in enumerate(limits(radius, len(query))):
            if limit < 0:
                continue
            _, order, starts = self.tables[s]
            values = self.buckets(query[s], s, limit).astype(np.int64)
            first, count = starts[values], starts[values + 1] - starts[values]
            at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(values) else values
            admitted[order[at]] = True
            if 2 * np.count_nonzero(admitted) > len(admitted):
                # buckets that admit most rows tell less than the full codes, which are compared in any case
                admitted[:] = True
                break
        rows = np.flatnonzero(admitted)
        return rows[distances(query[None, :], self.codes[rows])[0] <= radius]


@lru_cache(None)
def near_masks(limit: int) -> np.ndarray:
    """All substrings with at most ``limit`` bits set."""
    every = np.arange(1 << SUB, dtype=np.uint32)
    return every[np.bitwise_count(every) <= limit].astype(np.uint16)


class Block:
    """Rows of one task and their index; ``scored`` counts the vectors that were multiplied."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, coder: Coder):
        self.numbers, self.ids, self.vectors, self.coder = numbers, ids, vectors, coder
        self.index = MultiIndex(coder.rows(vectors))
        self.scored = 0

    def nearest(self, numbers: np.ndarray, ids: np.ndarray, queries: np.ndarray, radius: int, k: int) -> pd.DataFrame:
        """The k nearest of the block for each query; rows and queries are numbered alike."""
        out = []
        for number, own, q, code in zip(numbers, ids, queries, self.coder.queries(queries), strict=True):
            rows = self.index.probe(code, radius)
            rows = rows[self.numbers[rows] != number]
            if not len(rows):
                continue
            score = (self.vectors[rows] * q).sum(axis=1)
            self.scored += len(rows)
            if len(rows) > k:
                top = score >= np.partition(score, -k)[-k]
                rows, score = rows[top], score[top]
            order = np.lexsort((self.numbers[rows], self.ids[rows], -score))[:k]
            out.append(pd.DataFrame({"asked": number, "query_id": own, "number": self.numbers[rows][order], "vec_id": self.ids[rows][order], "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.array([], dtype=float if c == "score" else np.int64) for c in ("asked", "query_id", "number", "vec_id", "score")})


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    return v.filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))


def fit(vectors: DataFrame, n: int, top: float, bits: int = BITS, sample: int = SAMPLE, target: float = TARGET, k: int = 20) -> tuple[Coder, int]:
    """Rotations and radius for n vectors of one length, the longest of squared norm ``top``, from at most about ``sample``
    distinct rows, chosen by a hash."""
    unit = F.pmod(F.xxhash64(F.lit("ann"), F.col("vec_id"), F.col("embedding")), F.lit(1 << 30))
    rows = vectors.filter(unit < int(min(1.0, sample / n) * (1 << 30))).select("vec_id", "embedding").distinct().orderBy("vec_id", "embedding").collect()
    rows = rows or vectors.limit(1).collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    # rounding must not lift the longest vector out of the sphere
    coder = Coder(np.zeros((0, 0)), float(top) ** 0.5)
    coder.rotations = learn_rotations(np.hstack([x, np.sqrt(np.maximum(coder.top**2 - (x * x).sum(axis=1), 0.0))[:, None]]), bits)
    asked = slice(0, None, max(1, len(x) // 256))
    scores = x[asked] @ x.T
    codes = coder.rows(x)
    away = distances(coder.queries(x[asked]), codes)
    scores[np.arange(len(scores)), np.arange(len(x))[asked]] = -np.inf
    nearest = np.argsort(-scores, axis=1, kind="stable")[:, : max(1, min(k, len(x) - 1))]
    radius = int(np.quantile(np.take_along_axis(away, nearest, axis=1), target)) + 1
    return coder, min(radius, bits)


def search(vectors: DataFrame, is_query, k: int = 20, bits: int = BITS, target: float = TARGET) -> DataFrame:
    """vectors(vec_id, embedding), is_query a condition on them -> query_id, rank, vec_id, score."""
    # numbers are unique, and final once the table is written
    rows = written(usable(vectors).withColumn("number", F.monotonically_increasing_id()), "ann-rows")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    kinds = rows.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"), F.count(F.when(is_query, 1)).alias("asked"))
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # one length, as a rule
    for kind in kinds.orderBy("length").collect():
        if kind["asked"] and kind["n"] > 1:
            out = out.unionByName(_search(rows.filter(F.size("embedding") == kind["length"]), is_query, kind, k, bits, target))
    return out


def _search(rows: DataFrame, is_query, kind, k: int, bits: int, target: float) -> DataFrame:
    n, asked = kind["n"], kind["asked"]
    coder, radius = fit(rows, n, kind["top"], bits, target=target, k=k)
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-asked // GROUP))

    def answer(queries: DataFrame, radius: int) -> DataFrame:
        h = lambda n: F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
        both = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.select("number", "vec_id", "embedding", h(blocks).alias("block"), both(groups).alias("group"))
        right = queries.select("number", "vec_id", "embedding", h(groups).alias("group"), both(blocks).alias("block"))

        def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            parts = [(x["number"].to_numpy(), x["vec_id"].to_numpy(), np.stack(x["embedding"].to_numpy())) for x in (a, b) if len(x)]
            if len(parts) < 2:
                return pd.DataFrame({c: np.array([], dtype=float if c == "score" else np.int64) for c in ("asked", "query_id", "number", "vec_id", "score")})
            return Block(*parts[0], coder).nearest(*parts[1], radius, k)

        pairs = left.groupBy("block", "group").cogroup(right.groupBy("block", "group"))
        found = pairs.applyInPandas(one, "asked long, query_id long, number long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "number"))
        return written(found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("asked", "query_id", "rank", "vec_id", "score"), "ann-found")

    queries = rows.filter(is_query)
    found = answer(queries, radius)
    if radius < bits:
        full = found.filter(F.col("rank") == min(k, n - 1)).select(F.col("asked").alias("number"))
        short = written(queries.join(full, "number", "left_anti"), "ann-short")
        if not short.isEmpty():
            again = answer(short, bits)
            found = found.join(short.select(F.col("number").alias("asked")), "asked", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def op4_ann(spark, sf_dir) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
