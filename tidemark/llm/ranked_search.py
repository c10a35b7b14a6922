"""Ranked lexical search: documents are grouped by the mask of the query terms they hold, and masks are scored from the highest possible score down."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.ascii_words import word_numbers, words_of
from tidemark.llm.scratch import materialize, small_batches

TOP = 10
#: Pairs of a query and a term that are sent to every executor at once (some 20 MB); more queries are dealt to several passes.
BROADCAST_PAIRS = 200_000
#: Documents whose masks are formed at once.
BLOCK = 16_384


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct pairs of ``item`` and ``term``."""
    return items.select(F.col(id_col).alias("item"), F.explode(words_of(F.col(text_col))).alias("term")).distinct()


def postings(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with any term: ``id``, its number ``n`` of terms, and numbers (from 1) and occurrences of those in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): i for i, w in enumerate(sent.value, 1)}
        for batch in batches:
            at, sizes, terms, times, ends = [], [], [], [], [0]
            for i, text in enumerate(batch["text"].cast(pa.large_binary())):
                ids = word_numbers(text.as_buffer().to_pybytes(), number) if text.is_valid else ()
                if len(ids):
                    own, n = np.unique(ids[ids > 0], return_counts=True)
                    at.append(i)
                    sizes.append(len(ids))
                    terms.append(own)
                    times.append(n)
                    ends.append(ends[-1] + len(own))
            flat = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0), kind)) for x, kind in ((terms, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), *flat], names=["id", "n", "terms", "times"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(count, "id long, n long, terms array<int>, times array<long>")


def term_weight(documents: int, holding: int) -> int:
    """floor(1000 ln((2N + 2) / (2df + 1)))"""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class BestDocuments:
    """The best documents of each query among those seen: by score, then by id, an id of null last."""

    def __init__(self, queries: list[list[int]], top: int):
        self.queries, self.top = queries, top
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in queries]
        self.evaluated = self.matched = 0

    def bound(self, q: int) -> int:
        """A score that a document must reach to be among the best."""
        scores = self.best[q][0]
        return max(1, int(scores[-1])) if len(scores) == self.top else 1

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        scores, ids, nameless = (np.concatenate(x) for x in zip(self.best[q], (scores, ids, nameless)))
        order = np.lexsort((ids, nameless, -scores))
        order = order[scores[order] > 0][: self.top]
        self.best[q] = (scores[order], ids[order], nameless[order])

    def visit(self, ids: np.ndarray, nameless: np.ndarray, rows: np.ndarray, terms: np.ndarray, parts: np.ndarray) -> None:
        """A block of documents: for each posting its row, term and part of the score."""
        order = np.lexsort((rows, terms))
        rows, terms, parts = rows[order], terms[order], parts[order]
        present, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        most = np.maximum.reduceat(parts, starts) if len(starts) else parts
        place = {int(t): i for i, t in enumerate(present)}
        for q, query in enumerate(self.queries):
            own = [place[t] for t in query if t in place and most[place[t]] > 0]
            if not own or most[own].sum() < self.bound(q):
                continue
            # bit j of a document's mask is its bit in the bitmap of the query's j-th term
            width = -(-len(own) // 8)
            masks = np.zeros((len(ids), width), np.uint8)
            for j, t in enumerate(own):
                masks[rows[starts[t] : ends[t]], j >> 3] |= np.uint8(1 << (j & 7))
            self._by_mask(q, masks, most[own], [(rows[starts[t] : ends[t]], parts[starts[t] : ends[t]]) for t in own], ids, nameless)

    def _by_mask(self, q: int, masks: np.ndarray, most: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, nameless: np.ndarray) -> None:
        width = masks.shape[1]
        wide = 8 if width <= 8 else width
        keys = np.zeros((len(masks), wide), np.uint8)
        keys[:, :width] = masks
        keys = keys.view(np.uint64 if wide == 8 else f"V{wide}").ravel()
        distinct, first, group, sizes = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        bits = np.unpackbits(masks[first], axis=1, count=len(most), bitorder="little")
        bounds = bits.astype(np.int64) @ most
        self.matched += int(sizes[bounds > 0].sum())
        order = np.argsort(-bounds, kind="stable")
        members = np.argsort(group, kind="stable")
        begins = np.concatenate([[0], np.cumsum(sizes)])
        done, step = 0, 1
        while done < len(order) and bounds[order[done]] >= self.bound(q):
            chosen = order[done : done + step]
            chosen = chosen[bounds[chosen] >= self.bound(q)]
            rows = np.sort(np.concatenate([members[begins[g] : begins[g + 1]] for g in chosen]))
            scores = np.zeros(len(rows), np.int64)
            for j in np.flatnonzero(bits[chosen].any(axis=0)):
                holding, parts = lists[j]
                at = np.minimum(np.searchsorted(holding, rows), len(holding) - 1)
                scores += np.where(holding[at] == rows, parts[at], 0)
            self.evaluated += len(rows)
            self.add(q, scores, ids[rows], nameless[rows])
            done, step = done + step, step * 2


def _search_block(docs: DataFrame, pairs: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame:
    spark, kind = docs.sparkSession, pairs.schema["item"].dataType
    number: dict[str, int] = {}
    by_item: dict = {}
    for item, term in pairs.select("item", "term").collect():  # at most about BROADCAST_PAIRS
        by_item.setdefault(item, []).append(number.setdefault(term, len(number) + 1))
    names, queries = [*by_item], [*by_item.values()]
    with small_batches(spark):
        posted = materialize(postings(docs, [*number], id_col, text_col), f"postings-{uuid.uuid4().hex[:6]}")
    documents, total = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(number) + 1, np.int64)
    for r in posted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most a row for each term of the queries
        weight[r["term"]] = term_weight(documents, r["count"])
    sent = spark.sparkContext.broadcast((queries, names, weight))
    arrow_kind = to_arrow_type(kind)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_queries, of_names, w = sent.value
        found = BestDocuments(of_queries, top)
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                n = batch["n"].to_numpy()
                lengths = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(len(n)), lengths)
                terms, times = batch["terms"].flatten().to_numpy(), batch["times"].flatten().to_numpy()
                m = 10 + (90 * n * documents) // total
                nameless = batch["id"].is_null().to_numpy(zero_copy_only=False)
                ids = batch["id"].fill_null(0).to_numpy()
                found.visit(ids, nameless, rows, terms, w[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[rows])))
        kept = [(of_names[q], *x) for q, (scores, ids, gone) in enumerate(found.best) for x in zip(ids.tolist(), gone.tolist(), scores.tolist())]
        columns = [pa.array([x[0] for x in kept], arrow_kind), pa.array([None if x[2] else x[1] for x in kept], pa.int64()), pa.array([x[3] for x in kept], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return posted.mapInArrow(best, f"item_id {kind.simpleString()}, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", pairs_at_once: int = BROADCAST_PAIRS) -> DataFrame:
    """Each item's ``top`` documents of highest score: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``.

    One pass over the texts leaves postings of the queries' terms, and the counts that weights
    need. A task then takes its documents in blocks: a query's terms have bitmaps over the block,
    which, turned, are the documents' masks; a mask's bound is the sum of its terms'
    highest parts in the block; masks are scored in descending order of bounds until
    none can reach the ``top`` found by this task so far. Every task hands on ``top`` rows a query.
    Bitmaps don't grow with how often a term or a text occurs, and equal masks are ruled out together.
    Queries of over ``pairs_at_once`` pairs of item and term are dealt by hash to several passes.

    Items sharing an id (null is one) are one query of all their terms. Null and wordless
    texts of documents have no terms and count for nothing; items without terms, or whose
    terms no document holds, give no rows. Repeated rows rank each for itself, ids of null
    after equal scores of others. Other columns aren't read; empty tables give no rows.
    """
    pairs = query_terms(items, item_col)
    blocks = max(1, -(-pairs.count() // pairs_at_once))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    parts = [_search_block(docs, pairs.where(F.col("block") == b).select("item", "term"), top, id_col, text_col) for b in range(blocks)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
