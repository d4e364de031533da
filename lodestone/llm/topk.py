"""Exact top-k search by a three-phase uniform threshold.

A score is an inner product of integer vectors, the sum of PARTS partial scores over slices of the components.
Phase 1: every group of candidates takes, for each query, its k best entries by the first slice alone and scores just these; the k-th
best of all these local lists is a safe cutoff t: at least k candidates reach it. Phase 2: whatever scores t or more has a
partial score of t / PARTS or more in some slice, so just the entries above that uniform threshold are collected. Slices
whose norms can't reach it aren't multiplied at all. Phase 3: the collected entries' remaining partial scores
are resolved, and those that reach t are ranked.

Queries and candidates meet in blocks, the stated queries against all rows. Candidate blocks are dealt into groups of about
GROUP_BYTES; a task holds one group at a time, in the smallest integers that hold it, and the blocks of queries stream past: each is sent once to every group
and neither side is joined, broadcast or gathered. Each group gives at most k entries for a query, the best by score and then by id, so that ties
(copies of a vector) can't flood a task.

Defined results: null vectors and vectors with null or non-finite components take no part. Vectors of unequal length are
compared over the shorter one. Rows with a null vec_id take no part. A query is its vec_id: of several rows with it, the vector smallest by
components. Candidates are rows, so repeated rows count each; a query's own vec_id is never its candidate. Scores are exact: products
that float64 might round go through integers of any size. A component or a score beyond 64 bits is refused with an error. An empty
table gives an empty result; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sliced, written

PARTS = 4
CANDIDATE_BLOCK, QUERY_BLOCK = 2048, 512
#: Bytes of a group's candidates, about.
GROUP_BYTES = 16 << 20
#: Numbers that entries are scored from at once.
GATHERED = 1 << 21


def integer_vectors(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    too_large = F.raise_error(F.lit("a component doesn't fit into 64 bits")).cast("long")
    whole = lambda e: F.when(F.abs(F.lit(scale) * e) < 2.0**63, F.floor(F.lit(scale) * e)).otherwise(too_large)
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """block long, ids array<long>, dims array<int>, data binary: up to size vectors a row, made where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            data = np.concatenate(vectors)
            kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or not data.size or np.iinfo(t).min <= data.min() <= data.max() <= np.iinfo(t).max)
            columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(v) for v in vectors]], pa.list_(pa.int32())), pa.array([data.astype(kind).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "dims", "data"])

        for batch in sliced(batches):
            column = batch.column("v")
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                ids.append(vec_id)
                vectors.append(np.asarray(column[i].values, dtype=np.int64))
                if len(ids) == size:
                    yield emit()
                    number, ids, vectors = number + 1, [], []
        if ids:
            yield emit()

    return rows.mapInArrow(run, "block long, ids array<long>, dims array<int>, data binary")


def _matrix(dims: list[int], data: bytes, width: int) -> np.ndarray:
    flat, lengths = np.frombuffer(data, f"<i{len(data) // max(1, sum(dims)) or 8}"), np.asarray(dims)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out, at = np.zeros((len(dims), width), dtype=np.int64), 0
    for r, d in enumerate(dims):
        out[r, : min(d, width)] = flat[at : at + min(d, width)]
        at += d
    return out


class _Pair:
    """A block of queries and one of candidates, as float64 where all sums are exact in it, else as integers of any size."""

    def __init__(self, row: dict):
        width = max([1, *row["q_dims"], *row["dims"]])
        q, c = _matrix(row["q_dims"], row["q_data"], width), _matrix(row["dims"], row["data"], width)
        largest = [max((abs(int(x.max())), abs(int(x.min())))) if x.size else 0 for x in (q, c)]
        kind = np.float64 if largest[0] * largest[1] * width < 1 << 53 else object
        # By way of int64, so that integers of any size are Python's own.
        self.q, self.c = q.astype(np.int64).astype(kind), c.astype(np.int64).astype(kind)
        self.qi, self.ci = np.asarray(row["q_ids"], dtype=np.int64), np.asarray(row["ids"], dtype=np.int64)
        self.cuts = [width * p // PARTS for p in range(PARTS + 1)]
        self.exact = kind is object

    def part(self, p: int, queries: np.ndarray | slice = slice(None)) -> np.ndarray:
        a, b = self.cuts[p], self.cuts[p + 1]
        return self.q[queries, a:b] @ self.c[:, a:b].T

    def norms(self, x: np.ndarray, p: int) -> np.ndarray:
        part = x[:, self.cuts[p] : self.cuts[p + 1]]
        return np.sqrt((part * part).sum(axis=1).astype(float))

    def own(self) -> np.ndarray:
        """Where a candidate is the query itself."""
        return self.qi[:, None] == self.ci[None, :]

    def scores(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of entries, each a query's and a candidate's place."""
        step = max(1, GATHERED // self.q.shape[1])
        found = [(self.q[q[i : i + step]] * self.c[c[i : i + step]]).sum(axis=1) for i in range(0, len(q), step)]
        if self.exact and any(not -(1 << 63) <= int(s) < 1 << 63 for x in found for s in x):
            raise OverflowError("a score doesn't fit into 64 bits")
        return np.concatenate([np.zeros(0), *found]).astype(np.int64) if not self.exact else np.array([int(s) for x in found for s in x], dtype=np.int64)

    def best_of_first(self, k: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries and candidates that may be among the k best by the first slice, and what they have there: above low, the k-th so far."""
        first = self.part(0).astype(float)
        first[self.own()] = -np.inf
        if first.shape[1] > k and not np.isfinite(low).all():
            low = np.maximum(low, np.nextafter(np.partition(first, -k, axis=1)[:, -k], -np.inf))
        q, c = np.nonzero(first > low[:, None])
        return q, c, first[q, c]

    def sufficient(self, cutoffs: list[int | None]) -> list[np.ndarray]:
        """For each query the candidates that have cutoff / PARTS in some slice; all, where there is no cutoff."""
        return [np.flatnonzero(x) for x in self._collected(cutoffs)]

    def reaching(self, cutoffs: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries and candidates, of those collected, that reach the cutoffs, and their scores."""
        enough = self._collected(cutoffs, None if self.exact else 8)
        least = np.array([-(1 << 63) if c is None else c for c in cutoffs], dtype=np.int64)
        if not self.exact and 8 * np.count_nonzero(enough) > enough.size:
            # So many that one product is cheaper than entry by entry; its sums are exact.
            whole = self.q @ self.c.T
            q, c = np.nonzero(enough & (whole >= least[:, None].astype(float)))
            scores = whole[q, c].astype(np.int64)
        else:
            q, c = np.nonzero(enough)
            scores = self.scores(q, c)
        at = scores >= least[q]
        return q[at], c[at], scores[at]

    def _collected(self, cutoffs: list[int | None], few: int | None = None) -> np.ndarray:
        """few: once more than one of so many entries is collected, the other slices aren't looked at and all are."""
        cutoff = np.array([-np.inf if c is None else c for c in cutoffs], dtype=float)
        # A hair lower: rounding may collect an entry more, never one less.
        least = cutoff / PARTS - 1e-9 * np.abs(cutoff)
        enough = np.zeros((len(self.qi), len(self.ci)), dtype=bool)
        enough[~np.isfinite(cutoff)] = True
        for p in range(PARTS):
            able = np.flatnonzero((self.norms(self.q, p) * self.norms(self.c, p).max(initial=0.0) * (1 + 1e-9) >= least) & np.isfinite(cutoff))
            if len(able):
                enough[able] |= (self.part(p, able) >= least[able][:, None]).astype(bool)
            if few and few * np.count_nonzero(enough) > enough.size:
                enough[:] = True
                break
        return enough & ~self.own()


def _leading(k: int, query: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of each query's first k entries, by query; the last of order counts first."""
    at = np.lexsort((*order, query))
    begins = np.searchsorted(query[at], query[at])
    return at[np.arange(len(at)) - begins < k]


def _local_lists(blocks: list[dict], asked: dict, k: int) -> pa.RecordBatch:
    """For each query the scores, best first, of its k best candidates of the group by the first slice."""
    n = len(asked["q_ids"])
    low, kept = np.full(n, -np.inf), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    for row in blocks:
        pair = _Pair(row | asked)
        q, c, first = pair.best_of_first(k, low)
        at = _leading(k, q, -first)
        q, c, first = q[at], c[at], first[at]
        kept = tuple(np.concatenate(x) for x in zip(kept, (q, first, pair.scores(q, c)), strict=True))
        at = _leading(k, kept[0], -kept[1])
        kept = tuple(x[at] for x in kept)
        full = np.bincount(kept[0], minlength=n) == k
        lowest = np.full(n, np.inf)
        np.minimum.at(lowest, kept[0], kept[1])
        low = np.where(full, lowest, -np.inf)
    at = np.lexsort((~kept[2], kept[0]))
    bounds = np.searchsorted(kept[0][at], np.arange(n + 1)).astype(np.int32)
    scores = pa.ListArray.from_arrays(pa.array(bounds), pa.array(kept[2][at]))
    return pa.RecordBatch.from_arrays([pa.array(asked["q_ids"], pa.int64()), scores], names=["query_id", "scores"])


def _resolved(blocks: list[dict], asked: dict, k: int) -> pa.RecordBatch:
    """For each query its k best entries of the group that reach its cutoff."""
    cutoffs = list(asked["cutoffs"])
    kept = tuple(np.zeros(0, np.int64) for _ in range(3))
    for row in blocks:
        pair = _Pair(row | asked)
        q, c, scores = pair.reaching(cutoffs)
        kept = tuple(np.concatenate(x) for x in zip(kept, (q, pair.ci[c], scores), strict=True))
        at = _leading(k, kept[0], kept[1], ~kept[2])
        kept = tuple(x[at] for x in kept)
        # Of the blocks still to come, only what reaches the k-th so far is asked for.
        begins = np.searchsorted(kept[0], np.arange(len(cutoffs) + 1))
        for r in np.flatnonzero(np.diff(begins) == k):
            cutoffs[r] = int(kept[2][begins[r + 1] - 1])
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(asked["q_ids"], dtype=np.int64)[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["query_id", "vec_id", "score"])


def _met(candidates: DataFrame, asked: DataFrame, groups: int, make: Callable[[list[dict], dict, int], pa.RecordBatch], k: int, schema: str) -> DataFrame:
    """make(a group's blocks, a block of queries, k) for all of them. asked: block, ids, dims, data, cutoffs."""
    held = candidates.select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"), F.lit(0).alias("asks"), "block", "ids", "dims", "data", F.lit(None).cast("array<long>").alias("cutoffs"))
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("g"), F.lit(1).alias("asks"), "block", "ids", "dims", "data", "cutoffs")
    parts = max(groups, candidates.sparkSession.sparkContext.defaultParallelism)
    dealt = held.unionByName(sent).repartition(parts, "g").sortWithinPartitions("g", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks = None, []
        for batch in sliced(batches, 1):
            for row in batch.to_pylist():
                if row["g"] != group:
                    group, blocks = row["g"], []
                if not row["asks"]:
                    blocks.append(row)
                elif blocks:
                    yield make(blocks, {"q_ids": row["ids"], "q_dims": row["dims"], "q_data": row["data"], "cutoffs": row["cutoffs"]}, k)

    return dealt.mapInArrow(run, schema)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products. rows, queries: vec_id, v array<long>."""
    spark = rows.sparkSession
    candidates = written(_blocks(rows, CANDIDATE_BLOCK), "topk-candidates")
    size = candidates.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("bytes")).first()
    groups = max(1, -(-(size["bytes"] or 0) // GROUP_BYTES), min(size["n"], spark.sparkContext.defaultParallelism))
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    query_blocks = written(_blocks(asked, QUERY_BLOCK), "topk-queries")
    lists = _met(candidates, query_blocks.withColumn("cutoffs", F.lit(None).cast("array<long>")), groups, _local_lists, k, "query_id long, scores array<long>")
    ranked = lists.select("query_id", F.explode("scores").alias("s")).groupBy("query_id", "s").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("s")))
    # The greatest score that k entries reach; without so many entries there is no cutoff.
    cutoffs = ranked.withColumn("above", above).where(F.col("above") >= k).groupBy("query_id").agg(F.max("s").alias("cutoff"))
    by_block = query_blocks.select("block", F.posexplode("ids").alias("at", "query_id")).join(cutoffs, "query_id", "left").groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "cutoff"))), lambda x: x["cutoff"]).alias("cutoffs"))
    known = query_blocks.join(written(by_block, "topk-cutoffs"), "block")
    entries = _met(candidates, known, groups, _resolved, k, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
