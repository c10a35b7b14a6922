"""Approximate nearest neighbours by multiprobe p-stable hashing.

``tables`` tables hash unit vectors by ``k`` functions ``floor((a . v + b) / w)``. A query
looks into its own bucket of each table and into perturbed ones, in the order of their
estimated success: the sum over changed functions of the squared distance to the boundary
crossed. Buckets of index and queries meet in a shuffle; each is one small matrix product,
of which the best rows per query remain. Candidates of all tables are merged and ranked by
exact cosine.

``k`` follows the number of vectors, ``w`` the distances in a bounded sample, and the number
of probes is the least that finds the sample's own neighbours at ``TARGET`` recall. Every
vector is indexed. Equal vectors are one index entry with their least ids, so a very common
vector costs one entry; a bucket that is still large is split and its probes are repeated
for each part. Queries that found too few are compared with all vectors, in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Workspace, materialize
from tidemark.llm.suffix_dedup import _batch

TABLES = 12
#: Vectors and queries of the sample that ``w`` and the probes are fitted on.
SAMPLE, SAMPLE_QUERIES = 4000, 150
TARGET, MAX_PROBES = 0.97, 400
#: Index entries of a bucket part.
PART = 4096
#: Queries compared at once.
BLOCK = 1000


@dataclass(frozen=True)
class Index:
    a: np.ndarray  # tables x k x dimension
    b: np.ndarray  # tables x k
    w: float
    probes: int

    def places(self, unit: np.ndarray) -> np.ndarray:
        return np.einsum("tkd,nd->ntk", self.a, unit) / self.w + self.b


def bucket_ids(cells: np.ndarray) -> np.ndarray:
    """One number for the last axis of integers; a chance collision only adds candidates."""
    h = np.zeros(cells.shape[:-1], dtype=np.uint64)
    for i in range(cells.shape[-1]):
        h = (h ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def probe_order(fraction: np.ndarray, limit: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The ``limit`` likeliest perturbations, best first: (estimated cost, changed functions and by what).

    ``fraction`` is where in its cell each function's value lies. Perturbations grow from the
    cheapest single change by shifting or extending the dearest one, in a heap.
    """
    moves = sorted([(x * x, i, -1) for i, x in enumerate(fraction)] + [((1 - x) ** 2, i, 1) for i, x in enumerate(fraction)])
    out: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    heap: list[tuple[float, tuple[int, ...]]] = [(moves[0][0], (0,))]
    while heap and len(out) < limit:
        cost, chosen = heapq.heappop(heap)
        if len({moves[m][1] for m in chosen}) == len(chosen):
            out.append((cost, tuple(moves[m][1:] for m in chosen)))
        last = chosen[-1]
        if last + 1 < len(moves):
            step = moves[last + 1][0]
            heapq.heappush(heap, (cost - moves[last][0] + step, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + step, (*chosen, last + 1)))
    return out


def fit(sample: np.ndarray, size: int, near: int, tables: int = TABLES, seed: int = 7) -> Index:
    """Hash functions for ``size`` vectors, fitted on unit vectors of a sample."""
    rng = np.random.default_rng(seed)
    dimension = sample.shape[1]
    asked = np.arange(min(SAMPLE_QUERIES, len(sample)))
    likeness = sample[asked] @ sample.T
    likeness[asked, asked] = -2
    best = np.argsort(-likeness, axis=1, kind="stable")[:, : min(near, len(sample) - 1)]
    gaps = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(likeness, best, axis=1)))
    w = max(0.05, 1.9 * float(np.median(gaps)) if gaps.size else 1.0)
    for k in range(min(16, max(4, round(math.log2(max(2, size)) / 2))), 0, -1):
        index = Index(rng.normal(size=(tables, k, dimension)), rng.uniform(size=(tables, k)), w, MAX_PROBES)
        at = index.places(sample)
        cells = np.floor(at)
        ranks = []
        for q, found in zip(asked, best, strict=True):
            orders = [{frozenset(c): r for r, (_, c) in enumerate(probe_order(at[q, t] - cells[q, t], MAX_PROBES))} for t in range(tables)]
            for v in found:
                change = (cells[v] - cells[q]).astype(int)
                ranks.append(min(orders[t].get(frozenset((i, int(d)) for i, d in enumerate(change[t]) if d), MAX_PROBES) for t in range(tables)))
        needed = int(np.quantile(ranks, TARGET)) + 1 if ranks else 1
        if needed < MAX_PROBES or k == 1:
            return Index(index.a, index.b, w, min(MAX_PROBES, needed))
    raise AssertionError


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


_ROW = pa.schema([("t", pa.int32()), ("bucket", pa.int64()), ("probe", pa.bool_()), ("id", pa.int64()), ("vector", pa.list_(pa.float64()))])
_HIT = pa.schema([("query_id", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])


def _best(query_ids: np.ndarray, queries: np.ndarray, nodes: np.ndarray, vectors: np.ndarray, near: int) -> pa.RecordBatch:
    """The ``near`` nodes of highest cosine for each query, ties to the smaller node."""
    order = np.argsort(nodes)
    nodes, vectors = nodes[order], vectors[order]
    score = (queries @ vectors.T) / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :])
    top = np.argsort(-score, axis=1, kind="stable")[:, :near] if len(nodes) > near else np.tile(np.arange(len(nodes)), (len(queries), 1))
    return _batch(_HIT, np.repeat(query_ids, top.shape[1]), nodes[top].ravel(), np.take_along_axis(score, top, axis=1).ravel())


def _compact(hits: list[pa.RecordBatch], near: int) -> pa.RecordBatch:
    """The ``near`` best nodes of each query among all of a task's hits."""
    t = pa.Table.from_batches(hits)
    query, node, score = (t[n].to_numpy() for n in ("query_id", "node", "score"))
    order = np.lexsort((node, -score, query))
    query, node, score = query[order], node[order], score[order]
    new = np.ones(len(query), dtype=bool)
    new[1:] = (query[1:] != query[:-1]) | (node[1:] != node[:-1])  # a node met in several buckets has one score
    query, node, score = query[new], node[new], score[new]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return _batch(_HIT, query[place < near], node[place < near], score[place < near])


def nearest(vectors: DataFrame, queries: DataFrame, near: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``near`` rows of highest cosine found, itself left out.

    Null ids, and vectors that are null, zero or hold null or non-finite components, take no
    part. A vector is compared with those of its own length: of the commonest length through the
    index, of others with all. Rows that repeat
    an id with another vector are candidates of their own, with the same id a query never
    finds itself. Ties go to the smaller id. No usable vectors give no rows.
    """
    spark, work = vectors.sparkSession, Workspace(vectors.sparkSession)

    def clean(rows: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))

    few = Window.partitionBy("print", "vector").orderBy("id")
    # of equal vectors only the least ids can be among the nearest
    entries = clean(vectors).distinct().withColumn("print", F.xxhash64("vector")).withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= near + 1)
    every = work.keep(entries.groupBy("print", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "vector"), "nodes")
    asked = work.keep(clean(queries).distinct(), "queries")
    common = every.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, size = common["n"], common["count"]
    nodes, same = every.where(F.size("vector") == dimension), F.size("vector") == dimension
    share = SAMPLE / size
    picked = nodes if share >= 1 else nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = np.array([r["vector"] for r in picked.select("vector").collect()], dtype=np.float64).reshape(-1, dimension)
    index = fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), size, near)
    hits = work.keep(_search(index, nodes, asked.where(same), near), "hits")
    found = hits.join(every.select("node", F.size("ids").alias("k")), "node").groupBy("query_id").agg(F.sum("k").alias("k"))
    # of other lengths, and of those that met fewer than they ask for (themselves aside), all nodes are compared
    lacking = asked.join(found, asked["id"] == found["query_id"], "left").where(~same | (F.coalesce("k", F.lit(0)) <= near)).select("id", "vector")
    short = work.keep(lacking, "lacking")
    if not short.isEmpty():
        hits = work.keep(hits.unionByName(_exact(every, short, near)), "all_hits")
    return work.result(_ranked(hits, every, near))


def _ranked(hits: DataFrame, nodes: DataFrame, near: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.groupBy("query_id", "node")
        .agg(F.max("score").alias("score"))
        .withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node")))
        .where(F.col("_n") <= near + 1)
        .join(nodes.select("node", "ids"), "node")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .where(F.col("vec_id") != F.col("query_id"))
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= near)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _exact(nodes: DataFrame, asked: DataFrame, near: int) -> DataFrame:
    """The best nodes of each query among all of its length: nodes are dealt to blocks, and every query goes to each block."""
    blocks = max(1, math.ceil(nodes.count() / (8 * PART)))
    own, every = F.pmod(F.xxhash64("node"), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    entries = nodes.select(F.size("vector").alias("t"), own.alias("bucket"), F.lit(False).alias("probe"), F.col("node").alias("id"), "vector")
    looks = asked.select(F.size("vector").alias("t"), every.alias("bucket"), F.lit(True).alias("probe"), "id", "vector")
    together = entries.unionByName(looks).withColumn("part", F.lit(0))
    return together.repartition("t", "bucket").sortWithinPartitions("t", "bucket", "part").mapInArrow(_meet(near), _HIT_DDL)


_KINDS = "t int, bucket long, probe boolean, id long, vector array<double>"
_HIT_DDL = "query_id long, node long, score double"


def _meet(near: int):
    """The best nodes of each query among those that share its (t, bucket, part); the rows come sorted by these."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: list[pa.RecordBatch] = []
        for out in meetings(batches):
            hits.append(out)
            if sum(h.num_rows for h in hits) > 400_000:
                hits = [_compact(hits, near + 1)]
                if hits[0].num_rows > 200_000:
                    yield hits.pop()
        if hits:
            yield _compact(hits, near + 1)

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare() -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(held).combine_chunks()
            probe = rows["probe"].to_numpy()
            if probe.all() or not probe.any():
                return None
            ids, m = rows["id"].to_numpy(), _matrix(rows["vector"].combine_chunks())
            asked = np.flatnonzero(probe)
            found = [_best(ids[some], m[some], ids[~probe], m[~probe], near + 1) for some in np.split(asked, range(BLOCK, len(asked), BLOCK))]
            return found[0] if len(found) == 1 else _compact(found, near + 1)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("t", "bucket", "part")]
            turn = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            begin = 0
            if held and any(k[0] != held[-1].column(c)[-1].as_py() for c, k in zip(("t", "bucket", "part"), keys, strict=True)):
                turn = np.concatenate([[0], turn])
            for end in turn:
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
                if held and (out := compare()) is not None:
                    yield out
                held, begin = [], end
            held.append(batch.slice(begin))
        if held and (out := compare()) is not None:
            yield out

    return met


def _search(index: Index, nodes: DataFrame, asked: DataFrame, near: int) -> DataFrame:
    tables = len(index.a)

    def unit(batch: pa.RecordBatch) -> np.ndarray:
        m = _matrix(batch.column("vector"))
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = bucket_ids(np.floor(index.places(unit(batch))))
                for t in range(tables):
                    yield _batch(_ROW, np.full(len(ids), t), ids[:, t], np.zeros(len(ids), dtype=bool), batch.column("id"), batch.column("vector"))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = index.places(unit(batch))
            cells = np.floor(at)
            for i in range(batch.num_rows):
                t_of, wanted = [], []
                for t in range(tables):
                    for _, changes in probe_order(at[i, t] - cells[i, t], index.probes):
                        cell = cells[i, t].copy()
                        for f, d in changes:
                            cell[f] += d
                        t_of.append(t), wanted.append(cell)
                same = pa.array([i] * len(wanted))
                yield _batch(_ROW, np.array(t_of), bucket_ids(np.array(wanted)), np.ones(len(wanted), dtype=bool), batch.column("id").take(same), batch.column("vector").take(same))

    entries = nodes.select(F.col("node").alias("id"), "vector").mapInArrow(stored, _KINDS)
    looks = asked.mapInArrow(probed, _KINDS)
    sizes = entries.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    large = materialize(sizes.where(F.col("parts") > 1), "large")
    if large.isEmpty():
        entries, looks = entries.withColumn("part", F.lit(0)), looks.withColumn("part", F.lit(0))
    else:
        entries = entries.join(large, ["t", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        looks = looks.join(large, ["t", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    together = entries.unionByName(looks)
    return together.repartition("t", "bucket", "part").sortWithinPartitions("t", "bucket", "part").mapInArrow(_meet(near), _HIT_DDL)
