"""Exact top-k search by inner product with MaxScore over quantised vectors, within and across shards.

Components become floor(scale * x). A vector's dimensions are the terms of a
document; a term's score bounds come from the least and greatest value of its
postings (one column per dimension) in a shard. Rows are dealt to shards by the
signs of their first components, so that the bounds of a shard are tight.

1. Shards of a bounded size are written with the bounds of their terms.
2. Each shard searches itself for the queries that lie in it. The k-th best score
   found there is the first threshold of a query.
3. Blocks of queries meet the bounds of the shards (a few bytes per shard and
   term). A pair of a block and a shard in which no query can reach its threshold
   is dropped before any document moves.
4. In the pairs that are left, the terms of a block of queries are ordered by
   their spread. Essential terms are traversed for all queries that compete; the
   others are probed for the (query, document) pairs that still do, while
   thresholds rise. Each pair keeps its k best of a query; the lists are merged.

The shards and the queries are written while the plan is made. Scores are exact
integers; one beyond 64 bits raises an OverflowError.

Defined results: vectors that are null or hold null, NaN or infinite components,
and rows with a null id, take no part. Vectors of different lengths are padded
with zeros; an empty vector scores 0. Rows with the query's id are no
candidates. Of repeated query ids the least quantised vector is the query;
repeated candidates each count. Ties go to the smaller id. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, partitions_for, written

#: Vectors and values of a shard at most, queries of a block, bounds that meet a block together; documents scored at once, terms probed at once.
SHARD, VALUES, QUERIES, BOUNDS, BLOCK, PROBE = 4096, 2_000_000, 512, 256, 1024, 8
#: Components whose signs deal a row to a shard.
SIGNS = 16
EXACT = float(2**53)
LIMITS = np.iinfo(np.int64)


class Shard:
    """Postings of some documents: a column of values for each term, with its least and greatest."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(values[order].T)
        self.least, self.greatest = (self.columns.min(axis=1), self.columns.max(axis=1)) if len(ids) else (np.zeros(values.shape[1]),) * 2

    def search(self, query_ids: np.ndarray, queries: np.ndarray, threshold: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, id) that reach its threshold, best first."""
        low, high = bounds(queries, self.least, self.greatest)
        if len(queries) and np.maximum(np.abs(low), np.abs(high)).sum(axis=1).max() >= EXACT:
            return [self.search_big(int(i), q, t, k) for i, q, t in zip(query_ids, queries, threshold, strict=True)]
        out: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        live = np.flatnonzero(high.sum(axis=1) >= threshold)
        if not len(live) or not len(self.ids):
            return out
        low, high, threshold, query_ids = low[live], high[live], threshold[live].astype(np.float64), query_ids[live]
        terms = np.argsort(-(high - low).sum(axis=0), kind="stable")  # greatest spread first
        high, spread = high[:, terms], (high - low)[:, terms]
        query, columns, floor = np.ascontiguousarray(queries[live][:, terms]), self.columns[terms], low.sum(axis=1)
        after = lambda x: np.concatenate([np.cumsum(x[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
        rest, tail = after(high), after(spread)  # what the terms from the i-th on can add at most, and what they can add to the floor
        n, d = len(live), len(terms)
        best_query, best_score, best_id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for begin in range(0, len(self.ids), BLOCK):
            ids = self.ids[begin : begin + BLOCK]
            # a document at the floor of every essential term is not competitive for any query, even if all other terms give their most
            done = int((floor[:, None] + tail[:, :-1] >= threshold[:, None]).sum(axis=1).max(initial=0))
            part = columns[:, begin : begin + BLOCK]
            full = query[:, :done] @ part[:done]
            q, at = np.nonzero((full + rest[:, done, None] >= threshold[:, None]) & (ids[None, :] != query_ids[:, None]))
            score = full[q, at]
            while done < d and len(q):
                more = slice(done, done + PROBE)
                if len(q) * 8 > n * len(ids):
                    score = score + (query[:, more] @ part[more])[q, at]
                else:
                    score = score + np.einsum("ij,ji->i", query[q, more], part[more, at])
                done = min(d, done + PROBE)
                stay = score + rest[q, done] >= threshold[q]
                q, at, score = q[stay], at[stay], score[stay]
            if len(q):
                best_query, best_score, best_id = (np.concatenate(x) for x in ((best_query, q), (best_score, score), (best_id, ids[at])))
                order = np.lexsort((best_id, -best_score, best_query))
                best_query, best_score, best_id = best_query[order], best_score[order], best_id[order]
                fresh = np.flatnonzero(np.concatenate([[True], best_query[1:] != best_query[:-1]]))
                place = np.arange(len(best_query)) - np.repeat(fresh, np.diff(np.append(fresh, len(best_query))))
                last = np.flatnonzero(place == k - 1)
                threshold[best_query[last]] = np.maximum(threshold[best_query[last]], best_score[last])
                keep = place < k
                best_query, best_score, best_id = best_query[keep], best_score[keep], best_id[keep]
        for q, s, i in zip(live[best_query].tolist(), best_score.tolist(), best_id.tolist(), strict=True):
            out[q].append((int(s), i))
        return out

    def search_big(self, query_id: int, query: np.ndarray, threshold: float, k: int) -> list[tuple[int, int]]:
        """The same result with unbounded integers, for values whose sums a double cannot hold."""
        whole = np.array([int(x) for x in query], dtype=object)
        columns = np.array([[int(x) for x in c] for c in self.columns], dtype=object).reshape(self.columns.shape)
        scores = whole @ columns if len(whole) else np.zeros(len(self.ids), dtype=object)
        scored = sorted(((int(s), int(i)) for s, i in zip(scores, self.ids, strict=True) if i != query_id and s >= threshold), key=lambda x: (-x[0], x[1]))[:k]
        if any(not LIMITS.min <= s <= LIMITS.max for s, _ in scored):
            raise OverflowError("an inner product does not fit 64 bits")
        return scored


def bounds(queries: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest that each term can add to each query's score."""
    a, b = queries * least, queries * greatest
    return np.minimum(a, b), np.maximum(a, b)


def reaches(queries: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
    """The upper bound of each query (row) in each shard (column)."""
    return np.maximum(queries, 0) @ greatest.T + np.minimum(queries, 0) @ least.T


def padded(rows: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for r, v in enumerate(rows):
        out[r, : len(v)] = v
    return out


def widened(values: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, dims - values.shape[1])))


SHARDS = "shard long, n int, dims int, small boolean, ids binary, asks binary, vals binary, least binary, greatest binary"
ASKED = "query_id long, vector array<double>, under double, home long"
BLOCKS = "block long, n int, dims int, ids binary, vals binary, under binary"


def batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def unpacked(n: int, dims: int, small: bool, ids: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(values, np.int16 if small else np.float64).reshape(n, dims).astype(np.float64)


def make_shards(scale: float):
    """(id, asks, vector) -> rows of SHARDS, in the order of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, asks, rows, dims = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, asks, rows, dims
            values = padded(rows, dims)
            small = bool(np.abs(values).max(initial=0) < 2**15)
            least, greatest = values.min(axis=0), values.max(axis=0)
            row = (number, len(ids), dims, small, np.array(ids, np.int64).tobytes(), np.array(asks, bool).tobytes(), values.astype(np.int16 if small else np.float64).tobytes(), least.tobytes(), greatest.tobytes())
            number, ids, asks, rows, dims = number + 1, [], [], [], 0
            return batch(SHARDS, [row])

        for b in batches:
            for i, a, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v = np.floor(np.array(v, dtype=np.float64) * scale)
                if not np.isfinite(v).all():
                    raise OverflowError("a component is too great to be scaled")
                if len(ids) >= SHARD or (ids and (len(ids) + 1) * max(dims, len(v)) > VALUES):
                    yield flush()
                ids.append(i)
                asks.append(a)
                rows.append(v)
                dims = max(dims, len(v))
        if ids:
            yield flush()

    return run


def first_thresholds(k: int):
    """Shards -> ASKED: each query with the k-th best score in its own shard, negated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for number, n, dims, small, ids, asks, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                i, v = unpacked(n, dims, small, ids, values)
                shard, chosen = Shard(i, v), np.flatnonzero(np.frombuffer(asks, bool))
                for a in range(0, len(chosen), QUERIES):
                    own = chosen[a : a + QUERIES]
                    for x, found in zip(own.tolist(), shard.search(i[own], v[own], np.full(len(own), -np.inf), k), strict=True):
                        out.append((int(i[x]), v[x].tolist(), -float(found[-1][0]) if len(found) == k else np.inf, number))
            yield batch(ASKED, out)

    return run


def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ASKED -> blocks of queries."""
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 32, []

    def block(rows: list[tuple]) -> pa.RecordBatch:
        nonlocal number
        dims = max(len(v) for _, v, _ in rows)
        number += 1
        values = padded([np.array(v) for _, v, _ in rows], dims)
        return batch(BLOCKS, [(number, len(rows), dims, np.array([i for i, _, _ in rows], np.int64).tobytes(), values.tobytes(), np.array([-u for _, _, u in rows]).tobytes())])

    for b in batches:
        for i, v, u in zip(*(b.column(c).to_pylist() for c in (0, 1, 2)), strict=True):
            held.append((i, v, u))
            if len(held) == QUERIES or sum(len(v) for _, v, _ in held[-1:]) * len(held) > VALUES:
                yield block(held)
                held = []
    if held:
        yield block(held)


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, n, dims, vals, under, the shards' numbers, dims and bounds as lists) -> the pairs (block, shard) in which some query competes."""
    for b in batches:
        blocks, shards = [], []
        for number, n, dims, values, under, listed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            wide = max([dims, *(s["dims"] for s in listed)])
            q = widened(np.frombuffer(values, np.float64).reshape(n, dims), wide)
            least, greatest = (padded([np.frombuffer(s[c], np.float64) for s in listed], wide) for c in ("least", "greatest"))
            some = (reaches(q, least, greatest) >= np.frombuffer(under, np.float64)[:, None]).any(axis=0)
            own = [s["shard"] for s, x in zip(listed, some.tolist(), strict=True) if x]
            blocks += [number] * len(own)
            shards += own
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(shards, pa.int64())], names=["block", "shard"])


def search_pairs(k: int):
    """Rows of a shard and a block -> each query's k best in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for b in batches:
            out = []
            for number, n, dims, small, ids, values, m, wide, asked, vectors, under in zip(*(c.to_pylist() for c in b.columns), strict=True):
                both = max(dims, wide)
                if (number, both) != last:
                    i, v = unpacked(n, dims, small, ids, values)
                    last, shard = (number, both), Shard(i, widened(v, both))
                query_ids = np.frombuffer(asked, np.int64)
                found = shard.search(query_ids, widened(np.frombuffer(vectors, np.float64).reshape(m, wide), both), np.frombuffer(under, np.float64), k)
                out += [(q, i, s) for q, own in zip(query_ids.tolist(), found, strict=True) for s, i in own]
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

    return run


def valid(vector: Column) -> Column:
    """A vector of finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))


def prepared(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shards, blocks of queries with thresholds, and the pairs of them that compete."""
    n = partitions_for(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("i"), F.coalesce(is_query, F.lit(False)).alias("a"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("i").isNotNull() & valid(F.col("v")))
    signs = F.array_join(F.transform(F.slice("v", 1, SIGNS), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    shards = written(rows.repartitionByRange(n, signs, F.xxhash64("i")).sortWithinPartitions(signs, "i").mapInArrow(frugal(make_shards(scale)), SHARDS), "shards")
    asked = shards.select("shard", "n", "dims", "small", "ids", "asks", "vals").mapInArrow(frugal(first_thresholds(k)), ASKED)
    least = asked.groupBy("query_id").agg(F.min(F.struct("vector", "under", "home")).alias("x")).select("query_id", "x.vector", "x.under", "x.home")
    blocks = written(least.repartitionByRange(n, "home").sortWithinPartitions("home", "query_id").mapInArrow(frugal(make_blocks), BLOCKS), "queries")
    edges = shards.select(F.struct("shard", "dims", "least", "greatest").alias("s"), F.expr(f"CAST(shard % 4294967296 AS LONG) div {BOUNDS}").alias("g"), F.expr("shard div 4294967296").alias("p"))
    listed = edges.groupBy("p", "g").agg(F.collect_list("s").alias("listed"))  # of one task and at most BOUNDS each
    # the stated queries, in blocks, against all shards' bounds
    pairs = blocks.select("block", "n", "dims", "vals", "under").crossJoin(listed.select("listed")).mapInArrow(frugal(meet), "block long, shard long")
    return shards, blocks, pairs


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): the k best of all other rows for each row that ``is_query`` selects.

    What is moved is each row once into its shard, then a shard once for each
    block of queries of which some can compete in it.
    """
    shards, blocks, pairs = prepared(vectors, is_query, k, id_col, vector_col, scale)
    asked = blocks.select("block", F.col("n").alias("m"), F.col("dims").alias("wide"), F.col("ids").alias("asked"), F.col("vals").alias("vectors"), "under")
    met = shards.join(pairs, "shard").join(asked, "block")
    found = met.select("shard", "n", "dims", "small", "ids", "vals", "m", "wide", "asked", "vectors", "under").mapInArrow(frugal(search_pairs(k)), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
