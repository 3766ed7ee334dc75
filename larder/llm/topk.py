"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, in blocks.  Histograms of the scores are summed over all tasks and refined
round by round, eight bits a round, until each query's k-th score is known exactly; then one more pass keeps what lies
above it and breaks ties at it by the smaller id.  Scores are 64-bit integers, so all rounds agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, fresh_path, list_parts, written

BITS = 8
BINS = 1 << BITS
QUERY_BYTES = 16 << 20
QUERY_ROWS = 8192
BLOCK = 512
_U = np.uint64


def integer_vectors(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of every component, as long; rows with a null id, a null vector, or null or non-finite components are left out."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return df.where(fine).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def exact_kind(dim: int, most: int):
    """The fastest number type in which all inner products of such vectors are exact; ValueError if 64 bits do not hold them."""
    top = dim * most * most
    if top >= 1 << 63:
        raise ValueError(f"inner products of {dim} components up to {most} do not fit into 64 bits")
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def _blocks(batch: pa.RecordBatch, rows: int = 2 * BLOCK):
    """(ids, matrix) for runs of the batch's vectors of one length."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    offsets, flat = list_parts(batch.column(1))
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        for i in range(0, len(own), rows):
            at = own[i : i + rows]
            yield int(dim), ids[at], flat[offsets[at][:, None] + np.arange(dim)[None, :]]


class _Queries:
    """One chunk of queries, by vector length and id.  A score s counts as the unsigned number s + top.

    low: where a query's k-th score is known to begin; need: the rows at exactly that score that are wanted.
    """

    def __init__(self, rows: list[tuple[int, list[int]]], most: int, k: int):
        rows = sorted(rows, key=lambda r: (len(r[1]), r[0]))
        self.ids = np.array([i for i, _ in rows], np.int64)
        dims = np.array([len(v) for _, v in rows])
        self.top = max((int(d) * most * most for d in dims), default=0)
        self.groups = {}
        for dim in np.unique(dims).tolist():
            a, b = np.searchsorted(dims, [dim, dim + 1])
            matrix = np.array([v for _, v in rows[a:b]], np.int64).reshape(b - a, dim)
            self.groups[dim] = (int(a), self.ids[a:b], matrix.astype(exact_kind(dim, most)))
        self.low, self.need, self.all = np.zeros(len(rows), _U), np.full(len(rows), k), np.zeros(len(rows), bool)

    def scores(self, batches):
        """(first query, candidate ids, shifted scores, own pairs) of each pair of blocks of equal length."""
        for batch in batches:
            for dim, ids, matrix in _blocks(batch):
                if dim not in self.groups:
                    continue
                base, queries, q = self.groups[dim]
                matrix = matrix.astype(q.dtype).T
                for i in range(0, len(queries), BLOCK):
                    own = queries[i : i + BLOCK]
                    with np.errstate(over="ignore"):
                        s = (q[i : i + BLOCK] @ matrix).astype(np.int64).view(_U) + _U(self.top)
                    at = np.minimum(np.searchsorted(own, ids), len(own) - 1)
                    hit = np.flatnonzero(own[at] == ids)
                    yield base + i, ids, s, (at[hit], hit)


def _histograms(rows: DataFrame, queries: _Queries, shift: int, k: int) -> DataFrame:
    """(query, bin, n): a query's scores from low on, in bins of 2^shift, summed over all tasks; bin BINS counts the scores above.

    query is its place in the chunk.  A task sends a query's bins from the top down to where they hold k scores: lower ones
    cannot hold the k-th of all.
    """

    def run(batches):
        counts = np.zeros((len(queries.ids), BINS + 2), np.int64)
        for first, _, s, own in queries.scores(batches):
            low = queries.low[first : first + len(s), None]
            bins = np.minimum((s - low) >> _U(shift), _U(BINS)).astype(np.int64) + 1
            bins[s < low] = 0
            bins[own] = 0
            counts[first : first + len(s)] += np.bincount((bins + np.arange(len(s))[:, None] * (BINS + 2)).ravel(), minlength=len(s) * (BINS + 2)).reshape(len(s), BINS + 2)
        counts = counts[:, :0:-1]  # from the top; what is below the range goes
        query, at = np.nonzero((counts > 0) & (np.cumsum(counts, axis=1) - counts < k))
        for i in range(0, len(query), 20_000):
            q, b = query[i : i + 20_000], at[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array((BINS - b).astype(np.int32)), pa.array(counts[q, b])], names=["query", "bin", "n"])

    return rows.mapInArrow(run, "query int, bin int, n bigint").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _find_kth(rows: DataFrame, queries: _Queries, k: int) -> None:
    """Sets low, need and all (fewer than k candidates: all are wanted) of the chunk; a row a query reaches the driver each round."""
    shift = (2 * queries.top).bit_length()
    while shift:
        shift = max(0, shift - BITS)
        window = Window.partitionBy("query").orderBy(F.desc("bin"))
        found = _histograms(rows, queries, shift, k).withColumn("held", F.sum("n").over(window))
        reached = found.where((F.col("held") >= k) & (F.col("held") - F.col("n") < k)).select("query", "bin", (k - F.col("held") + F.col("n")).alias("need")).toArrow()
        query = reached.column("query").to_numpy()
        queries.all[:] = True
        queries.all[query] = False
        queries.low[query] += reached.column("bin").to_numpy().astype(_U) << _U(shift)
        queries.need[query] = reached.column("need").to_numpy()


def _selected(rows: DataFrame, queries: _Queries) -> DataFrame:
    """(query_id, vec_id, score): rows above each query's k-th score, and at that score the smallest ids of each task that may be needed."""

    def batch(q, ids, s):
        with np.errstate(over="ignore"):
            score = (s - _U(queries.top)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    def run(batches):
        ties: dict[int, np.ndarray] = {}
        for first, ids, s, own in queries.scores(batches):
            span = slice(first, first + len(s))
            low, every = queries.low[span, None], queries.all[span, None]
            above, equal = (s > low) | every, (s == low) & ~every
            above[own] = equal[own] = False
            q, c = np.nonzero(above)
            if len(q):
                yield batch(first + q, ids[c], s[q, c])
            for i in np.flatnonzero(equal.any(axis=1)):
                need = queries.need[first + i]
                near = np.concatenate([ties.get(first + i, ids[:0]), ids[equal[i]]])
                ties[first + i] = np.sort(near)[:need] if len(near) > need else near
        if ties:
            q = np.repeat(np.array(list(ties)), [len(x) for x in ties.values()])
            yield batch(q, np.concatenate(list(ties.values())), queries.low[q])

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(df: DataFrame, queries: DataFrame, *, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the highest integer inner product with each query.

    df and queries: (id, v) of integer_vectors().  A query's own id is no candidate of it; a repeated query id is asked
    once, repeated candidates count as often as they are there; vectors of another length than the query's take no part.
    Ties go to the smaller id.  Fewer than k candidates: all of them.  Empty tables give no row.  Scores that do not fit
    into 64 bits are refused with a ValueError.

    Queries go in chunks of QUERY_ROWS rows and QUERY_BYTES at most, one after another: a chunk's results are written before
    the next begins, so neither the driver nor a plan holds more than one.
    """
    spark = df.sparkSession
    rows = written(df, "vectors")
    asked = written(queries.dropDuplicates(["id"]), "queries")
    most = max((abs(int(x)) for x in rows.agg(F.max(F.array_max("v")), F.min(F.array_min("v"))).first() if x is not None), default=0)
    longest = asked.agg(F.max(F.size("v"))).first()[0] or 1
    share = max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * max(1, longest))))
    chunks = max(1, -(-asked.count() // share))
    asked = asked.withColumn("__chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    out, kind = fresh_path(spark, "top"), "query_id bigint, rank int, vec_id bigint, score bigint"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for c in range(chunks):
        chunk = _Queries([(r["id"], r["v"]) for r in asked.where(F.col("__chunk") == c).select("id", "v").collect()], most, k)
        _find_kth(rows, chunk, k)
        found = _selected(rows, chunk).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.select("query_id", "rank", "vec_id", "score").write.parquet(f"{out}/part={c}")
    drop_written(rows)
    drop_written(asked)
    return spark.read.schema(f"{kind}, part int").parquet(out).drop("part")
