"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors are kept in blocks. In a block, each dimension has its postings in
order of their value, cut into segments of equal quantised value. A query
adds up segments in descending impact, over all dimensions at once, until the
rest cannot lift any other vector into the best k; the possible members are
then scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import write_table

#: Vectors of a block of the index, and queries scored together in one task.
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
#: Levels of impact that a query passes through, and queries whose segments are added together.
LEVELS, GROUP = (0.3, 0.1, 0.03, 0.0), 64
#: Possible members up to which a query stops adding and scores them exactly.
FEW = 512
#: Components are floors of this many times a number, a power of two.
SCALE = 256
#: Components below which a product is a long, and bound of a score's terms up to which all sums fit one; scores from there on are made of Python integers.
LARGE, SAFE = 2.0**31, 2.0**60


def integer_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, v): v holds floor(SCALE * x) / SCALE, which a double holds exactly whatever x.

    Vectors that are null or hold a null or non-finite component take no
    part; nor do rows without id, which could not be named in a result.
    """
    whole = lambda x: F.floor(x * F.lit(float(SCALE))).cast("double") / F.lit(float(SCALE))
    exact = F.transform(vector_col, lambda x: F.when(F.abs(x.cast("double")) < 2.0**52, whole(x.cast("double"))).otherwise(x.cast("double")))
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), exact.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one matrix of doubles, shorter vectors filled with zeros, which add nothing to a product."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if not len(sizes):
        return np.zeros((0, 0))
    out = np.zeros((len(sizes), int(sizes.max())))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _in_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == rows:
                t = pa.Table.from_batches(held).combine_chunks()
                yield t.column("id").chunk(0).to_numpy(), _matrix(t.column("v").chunk(0))
                held, n = [], 0
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t.column("id").chunk(0).to_numpy(), _matrix(t.column("v").chunk(0))


def _bytes(x: np.ndarray) -> bytes:
    """A matrix as integers of four bytes a component if all fit, else as doubles."""
    small = not x.size or np.abs(x).max() < LARGE / SCALE
    return (x * SCALE).astype("<i4").tobytes() if small else x.astype("<f8").tobytes()


def _opened(data: bytes, n: int, dims: int) -> np.ndarray:
    """The matrix of ``_bytes``: longs, or doubles if a component may be too large for one."""
    if len(data) == 8 * n * dims and data:
        return np.frombuffer(data, "<f8").reshape(n, dims)
    return np.frombuffer(data, "<i4").reshape(n, dims).astype(np.int64)


def _integers(row: np.ndarray) -> list[int]:
    return [int(x) * SCALE if abs(x) >= 2.0**52 else int(x * SCALE) for x in row.tolist()] if row.dtype == np.float64 else row.tolist()


def _wide(score: int) -> tuple[int, bytes | None]:
    """(0, None) for a score that a long holds, else its sign and bytes that compare as such scores of one sign do."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, None
    size = (abs(score).bit_length() + 7) // 8
    data = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (1, data) if score > 0 else (-1, bytes(255 - b for b in data))


def build_index(vectors: DataFrame) -> DataFrame:
    """Index blocks of ``vectors`` (id, v): rows (place, n, dims, ids, matrix, postings), about 2 + 4 bytes a component, 2 + 8 with large ones.

    Each block is made of rows as they are read, without a shuffle.
    ``postings`` holds, by dimension, the block's rows in ascending order of
    value, and ``place`` is the number of the task plus that of the block in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, (ids, x) in enumerate(_in_blocks(batches, BLOCK_ROWS), TaskContext.get().partitionId()):
            order = np.argsort(x, axis=0, kind="stable").astype("<u2")
            yield pa.RecordBatch.from_pydict(
                {"place": [place], "n": [x.shape[0]], "dims": [x.shape[1]], "ids": [ids.astype("<i8").tobytes()], "matrix": [_bytes(x)], "postings": [order.T.copy().tobytes()]}
            )

    return vectors.mapInArrow(run, "place long, n long, dims long, ids binary, matrix binary, postings binary")


def pack_queries(vectors: DataFrame) -> DataFrame:
    """Query blocks: rows (q_n, q_dims, q_ids, q_matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _in_blocks(batches, QUERY_ROWS):
            yield pa.RecordBatch.from_pydict({"q_n": [x.shape[0]], "q_dims": [x.shape[1]], "q_ids": [ids.astype("<i8").tobytes()], "q_matrix": [_bytes(x)]})

    return vectors.mapInArrow(run, "q_n long, q_dims long, q_ids binary, q_matrix binary")


class Block:
    """An index block, opened for queries."""

    def __init__(self, n: int, dims: int, ids: bytes, matrix: bytes, postings: bytes):
        self.n, self.dims = n, dims
        self.ids = np.frombuffer(ids, "<i8")
        self.x = _opened(matrix, n, dims)
        self.postings = np.frombuffer(postings, "<u2").reshape(dims, n)
        self.sorted = np.take_along_axis(self.x.T, self.postings.astype(np.int64), axis=1)

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of each query's best k rows of this block, its own row left out; ties to smaller ids."""
        found = []
        for at in range(0, len(queries), GROUP):
            i, q = query_ids[at : at + GROUP], queries[at : at + GROUP]
            dims = min(q.shape[1], self.dims)
            whole = self.x.dtype != np.float64 and q.dtype != np.float64
            reach = np.abs(self.sorted[:dims, [0, -1]].astype(np.float64)).max(axis=1, initial=0)
            small = whole and (np.abs(q[:, :dims].astype(np.float64)) @ reach).max(initial=0) < SAFE
            found += self._top(i, q, k) if small else self._large(i, q[:, :dims], k)
        return found

    def _large(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """As ``_top`` for scores of any size: doubles, with a bound on their error, prove rows out; members are scored in Python integers.

        Rows and queries are scaled to at most one, so that no product leaves the doubles.
        """
        dims = queries.shape[1]

        def scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            exponent = np.frexp(np.abs(m).max(axis=1, initial=1e-300))[1]
            return np.ldexp(m.astype(np.float64), -exponent[:, None]), exponent

        (x, ex), (q, _) = scaled(self.x[:, :dims]), scaled(queries)
        about, error = x @ q.T, (np.abs(x) @ np.abs(q).T) * ((dims + 8) * 2.0**-51) + 1e-300
        top = int(ex.max(initial=0))
        near = np.maximum(ex - top, -1000)[:, None]  # all rows of a query on one scale; what is lost below it is less than the error
        low, high = np.ldexp(about - error, near) - 1e-290, np.ldexp(about + error, near) + 1e-290
        found = []
        for j, (i, v) in enumerate(zip(query_ids, map(_integers, queries), strict=True)):
            others = np.flatnonzero(self.ids != i)
            if len(others) > k:
                least = low[others, j]
                others = others[high[others, j] >= np.partition(least, len(least) - k)[len(least) - k]]
            scored = sorted((-sum(map(mul, v, _integers(self.x[r, :dims]))), int(self.ids[r])) for r in others)[:k]
            found.append((np.array([n for _, n in scored], np.int64), np.array([-s for s, _ in scored], object)))
        return found

    def _top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """A group of queries, whose segments of one impact level are added together.

        A dimension's contribution is split into its least value in the
        block, which all rows get, and a rest of at least zero. ``partial``
        holds the rests added so far and ``remaining`` bounds what any row
        can still get; so a row whose partial sum and ``remaining`` stay
        below the k-th partial sum is no member: that is the proof. Segments
        are entered from the large values down by positive weights and from
        the small ones up by negative ones.
        """
        dims, n = min(queries.shape[1], self.dims), self.n
        q = queries[:, :dims]
        low, high = self.sorted[:dims, 0], self.sorted[:dims, -1]
        largest = (np.abs(q) * (high - low)).max(axis=1, initial=0)
        small = int((np.abs(q) * (high - low)).sum(axis=1).max(initial=0)) < 1 << 31
        kind = np.int32 if small else np.int64
        partial = np.zeros((n, len(q)), kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        taken = {True: np.zeros(dims, np.int64), False: np.zeros(dims, np.int64)}
        own = np.array([[row, j] for j, i in enumerate(query_ids) for row in np.flatnonzero(self.ids == i)], np.int64).reshape(-1, 2)
        members = [np.arange(n)] * len(q)
        for level in LEVELS:
            cut = level * largest  # segments of at least this impact come next
            remaining = np.zeros(len(q), np.int64)
            for d in range(dims):
                values, order = self.sorted[d], self.postings[d]
                for rising, weights in ((True, up[:, d]), (False, down[:, d])):
                    some = weights != 0
                    if not some.any() or low[d] == high[d]:
                        continue
                    start = int(taken[rising][d])
                    if rising:
                        least = low[d] + (cut[some] / weights[some]).min()
                        stop = max(start, n - int(np.searchsorted(values, least, "left")))
                        part = slice(n - stop, n - start)
                        rest = values[part] - low[d]
                        left = int(values[n - stop - 1] - low[d]) if stop < n else 0
                    else:
                        most = high[d] + (cut[some] / weights[some]).max()
                        stop = max(start, int(np.searchsorted(values, most, "right")))
                        part = slice(start, stop)
                        rest = values[part] - high[d]
                        left = int(values[stop] - high[d]) if stop < n else 0
                    if stop > start:
                        partial[order[part]] += rest.astype(kind)[:, None] * weights.astype(kind)
                    remaining += weights * left
                    taken[rising][d] = stop
            if n - 1 <= k:
                break
            seen = partial
            if len(own):
                seen = partial.copy()
                seen[own[:, 0], own[:, 1]] = -1
            best = np.partition(seen, n - k, axis=0)[n - k]
            possible = seen + remaining >= best
            members = [np.flatnonzero(possible[:, j]) for j in range(len(q))]
            if max(map(len, members)) <= FEW or not remaining.any():
                break
        return [self._exact(int(i), v, m, k) for i, v, m in zip(query_ids, q, members, strict=True)]

    def _exact(self, query_id: int, q: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        members = members[self.ids[members] != query_id]
        scores = self.x[members, : len(q)] @ q
        if len(members) > k:
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            members, scores = members[near], scores[near]
        best = np.lexsort((self.ids[members], -scores))[:k]
        return self.ids[members[best]], scores[best]


def _lane_keys(spark: SparkSession, lanes: int) -> list[int]:
    """Numbers whose hashes fall to different partitions of ``lanes``, so that no two lanes share a task."""
    slots = spark.range(64 * lanes, numPartitions=1).groupBy(F.pmod(F.hash("id"), F.lit(lanes)).alias("slot")).agg(F.min("id").alias("key"))
    return sorted(r["key"] for r in slots.collect())


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of ``vectors`` for every row of ``queries``, both (id, v).

    All rows but those with the query's own id are candidates; fewer than k
    give all of them. Ties go to the smaller id, repeated rows are ranked
    each. Vectors of different lengths are compared over the shorter one.
    An empty side gives no rows. Repeated rows of ``queries`` are one query;
    rows that share an id but not the vector are queries of their own, each
    with ranks from 1. Scores of any size are ranked exactly; one that a
    long cannot hold is shown as null.

    Index blocks are dealt round to lanes, one a task, and query blocks are copied to all
    of them; so every query block meets every index block once, in an
    equality join of blocks, and neither side is broadcast. Each pair of
    blocks returns k rows a query.
    """
    spark = vectors.sparkSession
    index = write_table(build_index(vectors), "topk-index")
    lanes = max(1, min(index.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keys = F.array(*map(F.lit, _lane_keys(spark, lanes)))
    dealt = index.withColumn("lane", F.element_at(keys, (F.pmod("place", F.size(keys)) + 1).cast("int")))
    packed = pack_queries(queries.distinct()).withColumn("lane", F.explode(keys))
    met = dealt.repartition(lanes, "lane").join(packed.repartition(lanes, "lane"), "lane").drop("lane", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["n"], row["dims"], row["ids"], row["matrix"], row["postings"])
                ids = np.frombuffer(row["q_ids"], "<i8")
                q = _opened(row["q_matrix"], row["q_n"], row["q_dims"])
                got = block.top(ids, q, k)
                if not got:
                    continue
                scores = [x for _, s in got for x in s.tolist()]
                wide = [_wide(x) for x in scores]
                sizes = [len(a) for a, _ in got]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array(np.repeat(ids, sizes)),
                        "vector": pa.array(np.repeat([xxhash.xxh3_128_hexdigest(v.tobytes()) for v in q], sizes), pa.string()),
                        "vec_id": pa.array(np.concatenate([a for a, _ in got])),
                        "score": pa.array([x if w is None else None for x, (_, w) in zip(scores, wide, strict=True)], pa.int64()),
                        "side": pa.array([x for x, _ in wide], pa.int32()),
                        "wide": pa.array([x for _, x in wide], pa.binary()),
                    }
                )

    found = met.mapInArrow(run, "query_id long, vector string, vec_id long, score long, side int, wide binary")
    rank = F.row_number().over(Window.partitionBy("query_id", "vector").orderBy(F.desc("side"), F.desc("wide"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
