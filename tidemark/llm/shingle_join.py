"""Exact similarity join on word shingles: classes of texts whose Jaccard similarity reaches a threshold.

Identical sets are one node from the start. Then

1. Links found cheaply: nodes that agree on a band of least hashes are paired with the
   band's most central node and verified; what links joins a class.
2. Links that could be missing: in a global order of shingles (rare before frequent, long
   before short) two sets of similarity t share one of their first ``n - ceil(t n) + 1``
   shingles. Nodes of different classes that share such a shingle meet in a bucket of like
   size, where a signature tree finds the pairs that can still reach t: its nodes hold the OR of bitmaps of
   shingles, the least count of set bits and the range of set sizes, and two subtrees are
   traversed together only while their largest possible overlap suffices. A bucket hands on
   a spanning forest of its pairs, so never more rows than it was given.
3. What those forests connect is a cluster. Its sets come together once, a signature tree
   leaves the pairs that may link, and each is checked on the sets themselves unless its
   ends are already in one class; again a spanning forest goes on.

Large buckets and clusters are dealt to blocks, and each two blocks meet in a task.

Any order and any choice of bands gives the same classes; they only decide how little work
is left for the second step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.scratch import Workspace, small_batches
from tidemark.llm.suffix_dedup import _BASE, _U, _batch, _bytes, _ddl, _mix, _prefix

WORDS = 5
THRESHOLD = (80, 100)
BANDS = 4
#: A shingle counts as frequent from so many occurrences; so many, the commonest, are told apart.
FREQUENT, FREQUENT_KEPT = 16, 200_000
#: What one task reports of its own frequent shingles.
LOCAL_MIN, LOCAL_KEPT = 2, 65_536
LEAF = 8
#: Sets, and shingles of sets, of a block; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 512, 1_500_000
#: Buckets are gone through in so many passes that one sends each bitmap about so many times, or so many bytes if that is more.
PASS_COPIES, PASS_LEAST = 4, 64 << 20
#: Bytes of a bucket's row besides its bitmap.
ROW_BYTES = 64
#: Distinct keys up to which a selection of rows is broadcast.
BROADCAST_KEYS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = [_U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(64)]
#: No shingle is told apart as frequent.
_NONE = (np.zeros(0, _U), np.zeros(0, _U))


def shingle_ids(texts: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, id) of every shingle in turn. An id is 8 bits of inverse length, then 50 of hash."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.full(ends[-1], 32, dtype=np.uint8)
    for t, e in zip(texts, ends, strict=True):
        data[e - 1 - len(t) : e - 1] = t
    data = _LOWER[data]
    turn = np.diff(_SPACE[data].astype(np.int8), prepend=1)
    start, stop = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    sums, inverse = _prefix(data, _BASE)
    size = stop - start
    word = _mix((sums[stop] - sums[start]) * inverse[start] + size.astype(_U))
    doc = np.searchsorted(ends, start, "right")
    per_doc = np.bincount(doc, minlength=len(texts))
    n = max(0, len(word) - words + 1)
    whole = doc[:n] == doc[words - 1 : words - 1 + n] if n else np.zeros(0, bool)
    h, length = np.zeros(n, dtype=_U), np.zeros(n, dtype=np.int64)
    for j in range(words):
        h += word[j : j + n] * _STEP[j]
        length += size[j : j + n]
    docs, hashes, lengths = [doc[:n][whole]], [h[whole]], [length[whole]]
    begin = np.cumsum(per_doc) - per_doc
    for d in np.flatnonzero((per_doc > 0) & (per_doc < words)):
        s = slice(begin[d], begin[d] + per_doc[d])
        docs.append([d])
        hashes.append(np.add.reduce(word[s] * np.array(_STEP[: per_doc[d]], dtype=_U), keepdims=True) + _U(per_doc[d]))
        lengths.append([size[s].sum()])
    doc, h, length = np.concatenate(docs), np.concatenate(hashes).astype(_U), np.concatenate(lengths)
    ids = (255 - np.minimum(length, 255)).astype(_U) << _U(50) | _mix(h) >> _U(14)
    return doc.astype(np.int64), ids


def ordered_sets(texts: list[np.ndarray], words: int, frequent: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Each text's distinct shingles in the global order: the level of frequency comes first."""
    doc, ids = shingle_ids(texts, words)
    known, level = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        ids = ids | np.where(known[at] == ids, level[at], _U(0)) << _U(58)
    order = np.lexsort((ids, doc))
    doc, ids = doc[order], ids[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
    return np.split(ids[new], np.searchsorted(doc[new], np.arange(1, len(texts))))


def _in_chunks(batches: Iterator[pa.RecordBatch], size: int = 250_000) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """The other columns' values, and the texts, of some rows at a time."""
    for batch in batches:
        rows, texts, held = [], [], 0
        others = zip(*(batch.column(c).to_pylist() for c in batch.schema.names if c != "text"), strict=True)
        for row, text in zip(others, _bytes(batch, "text"), strict=True):
            rows.append(row), texts.append(text)
            held += len(text)
            if held > size:
                yield rows, texts
                rows, texts, held = [], [], 0
        if rows:
            yield rows, texts


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of frequent shingles, sorted, and their level; every task reports its commonest, the sums are cut to ``FREQUENT_KEPT``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, held, waiting = np.zeros(0, _U), np.zeros(0, np.int64), [], 0

        def fold():
            got, times = np.unique(np.concatenate([np.zeros(0, _U), *held]), return_counts=True)
            got, times = np.concatenate([ids, got[times > 1]]), np.concatenate([n, times[times > 1]])
            both, inverse = np.unique(got, return_inverse=True)
            return both, np.bincount(inverse, weights=times, minlength=len(both)).astype(np.int64)

        for _, texts in _in_chunks(batches):
            held.append(shingle_ids(texts, words)[1])
            waiting += len(held[-1])
            if waiting > 500_000:
                ids, n = fold()
                held, waiting = [], 0
        ids, n = fold()
        top = np.argsort(-n, kind="stable")[:LOCAL_KEPT]
        top = top[n[top] >= LOCAL_MIN]
        yield _batch(pa.schema([("id", pa.int64()), ("n", pa.int64())]), ids[top].view(np.int64), n[top])

    rows = docs.select("row", "text").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "id").limit(FREQUENT_KEPT).toPandas()
    ids, n = rows["id"].to_numpy(dtype=np.int64).view(_U), rows["n"].to_numpy(dtype=float)
    order = np.argsort(ids)
    level = np.minimum(40, 1 + np.floor(np.log2(np.maximum(n, FREQUENT) / FREQUENT))).astype(_U)
    return ids[order], level[order]


def bitmap(ids: np.ndarray) -> bytes:
    """One bit a shingle among at least four times as many; wider ones fold onto narrower ones."""
    width = max(64, 1 << (4 * len(ids) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[((ids & _U((1 << 50) - 1)) & _U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


_SIGNATURE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
_PREFIX = pa.schema([("node", pa.int64()), ("prefix", pa.list_(pa.int64()))])
_BITMAP = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary())])
_SET = pa.schema([("node", pa.int64()), ("ids", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PAIR_DDL = "a long, b long"


def _node(ids: np.ndarray) -> int:
    """Number of a set: its fingerprint."""
    low = ids & _U((1 << 58) - 1)  # levels aside
    both = np.array([np.add.reduce(_mix(low)), np.bitwise_xor.reduce(_mix(low + _U(7)))], dtype=_U)
    return int(_mix(np.add.reduce(both * np.array([3, 1], dtype=_U), keepdims=True) + _U(len(ids)))[0].astype(np.int64)) if len(ids) else 0


def prefix_length(n: int, threshold: tuple[int, int]) -> int:
    """Shingles of a set of ``n`` of which any similar set holds one."""
    num, den = threshold
    return n - (num * n + den - 1) // den + 1 if n else 0


def _signatures(words: int, seeds: np.ndarray) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _in_chunks(batches):
            sets = ordered_sets(texts, words, _NONE)
            bands = []
            for ids in sets:
                if len(ids):
                    least = np.array([[_mix(ids ^ s).min() for s in band] for band in seeds], dtype=_U)
                    bands.append(_mix(np.add.reduce(least * np.array(_STEP[: seeds.shape[1]], dtype=_U), axis=1) + np.arange(len(seeds), dtype=_U)).view(np.int64))
                else:
                    bands.append(np.zeros(0, np.int64))
            row, doc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array([_node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), _lists(bands)], schema=_SIGNATURE)

    return sign


def _prefixes(words: int, frequent: tuple[np.ndarray, np.ndarray], threshold: tuple[int, int]) -> Callable:
    """Of each set, the shingles of which any similar set holds one."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _in_chunks(batches):
            if sets := [x for x in ordered_sets(texts, words, frequent) if len(x)]:
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), _lists([x[: prefix_length(len(x), threshold)].view(np.int64) for x in sets])], schema=_PREFIX)

    return first


def _bitmaps(words: int) -> Callable:
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _in_chunks(batches):
            sets = [x for x in ordered_sets(texts, words, _NONE) if len(x)]
            yield _batch(_BITMAP, [_node(x) for x in sets], [len(x) for x in sets], [bitmap(x) for x in sets])

    return draw


def _lists(each: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(np.concatenate(each)))


def _packed(ids: np.ndarray) -> bytes:
    """The low 48 bits of each id, sorted, as six bytes: two sets of n shingles seem to share one too many at odds of n * n in 2**48."""
    return np.unique(ids & _U((1 << 48) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _sets(words: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _in_chunks(batches):
            found = ordered_sets(texts, words, _NONE)
            yield _batch(_SET, [_node(x) for x in found], [_packed(x) for x in found])

    return sets


def _fold(rows: list[bytes]) -> np.ndarray:
    """Bitmaps as a matrix of words, folded to the narrowest."""
    width = min(map(len, rows))
    out = np.zeros((len(rows), width // 8), dtype=_U)
    for i, r in enumerate(rows):
        out[i] = np.bitwise_or.reduce(np.frombuffer(r, dtype="<u8").reshape(-1, width // 8), axis=0)
    return out


def tree_pairs(n: np.ndarray, bits: np.ndarray, threshold: tuple[int, int], differ: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of sets, given sizes and bitmaps, that may reach the threshold: dual traversal of a signature tree.

    They come some at a time; ``differ`` says, just before, which of them are still wanted.
    The bound of two subtrees: of a set in one, the bits outside the other's OR are not
    shared, so at most ``max size - (least bits - common bits)`` shingles are.
    """
    num, den = threshold
    order = np.argsort(n, kind="stable")
    levels = [(n[order], n[order], np.bitwise_count(bits[order]).sum(axis=1).astype(np.int64), bits[order])]
    while len(levels[-1][0]) > LEAF:
        low, high, ones, ors = levels[-1]
        cut = np.arange(0, len(low), LEAF)
        levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(ones, cut), np.bitwise_or.reduceat(ors, cut, axis=0)))
    i, j = np.triu_indices(len(levels[-1][0]))
    at_once = max(256, 4_000_000 // max(1, bits.shape[1]))  # so that the words compared stay within some tens of megabytes
    stack = [(len(levels) - 1, i, j)]
    while stack:
        depth, i, j = stack.pop()
        if len(i) > at_once:
            half = len(i) // 2
            stack += [(depth, i[half:], j[half:]), (depth, i[:half], j[:half])]
            continue
        low, high, ones, ors = levels[depth]
        if depth == 0:
            wanted = (i < j) & differ(order[i], order[j])
            i, j = i[wanted], j[wanted]
        common = np.bitwise_count(ors[i] & ors[j]).sum(axis=1).astype(np.int64)
        most = np.minimum(high[i] - np.maximum(0, ones[i] - common), high[j] - np.maximum(0, ones[j] - common))
        # overlap >= t / (1 + t) * (|a| + |b|), and sizes within t of each other
        good = (most * (num + den) >= num * (low[i] + low[j])) & (high[i] * den >= num * low[j]) & (high[j] * den >= num * low[i])
        i, j = i[good], j[good]
        if not len(i):
            continue
        if depth == 0:
            yield order[i], order[j]
        else:
            below = len(levels[depth - 1][0])
            a = (i[:, None] * LEAF + np.repeat(np.arange(LEAF), LEAF)).ravel()
            b = (j[:, None] * LEAF + np.tile(np.arange(LEAF), LEAF)).ravel()
            fits = (a < below) & (b < below) & (a <= b)
            stack.append((depth - 1, a[fits], b[fits]))


def similar_pairs(n: np.ndarray, bitmaps: list[bytes], threshold: tuple[int, int], differ: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs as ``tree_pairs`` gives them, one tree for each class of sizes and its next, so that bitmaps of like width are compared."""
    num, den = threshold
    of = np.floor(np.log(n) / math.log(den / num)).astype(np.int64)
    for size in np.unique(of):
        some = np.flatnonzero((of == size) | (of == size + 1))
        if len(some) > 1:
            home = of[some] == size
            for a, b in tree_pairs(n[some], _fold([bitmaps[i] for i in some]), threshold, lambda i, j: (home[i] | home[j]) & differ(some[i], some[j])):
                yield some[a], some[b]


class _Forest:
    """Union of members; remembers the pairs that joined two of its parts."""

    def __init__(self, label: np.ndarray):
        self._up = np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]].tolist()
        self.part = np.array(self._up)
        self.joined: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self._up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray, linked: Callable[[int, int], bool]) -> None:
        """Join the pairs that are linked; of those already in one part nobody asks."""
        apart, before = self.part[a] != self.part[b], len(self.joined)
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            x, y = self.root(i), self.root(j)
            if x != y and linked(i, j):
                self._up[max(x, y)] = min(x, y)
                self.joined.append((i, j))
        if len(self.joined) > before:
            self.part = np.array([self.root(i) for i in range(len(self._up))])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of one key after the other; they come sorted by key."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and any(r[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _joined(forest: _Forest, node: np.ndarray) -> pa.RecordBatch | None:
    if not forest.joined:
        return None
    a, b = np.array(forest.joined).T
    return _batch(_PAIR, node[a], node[b])


def _candidates(threshold: tuple[int, int]) -> Callable:
    """Per (token, size, cell), pairs that may reach the threshold, as few as keep together what they connect."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("token", "size", "cell")):
            label, node, home = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("label", "node", "home"))
            if (label == label[0]).all():
                continue
            forest = _Forest(np.arange(len(rows)))
            for a, b in tree_pairs(np.array([r["n"] for r in rows]), _fold([r["bitmap"] for r in rows]), threshold, lambda i, j: ((home[i] | home[j]) > 0) & (label[i] != label[j]) & (forest.part[i] != forest.part[j])):
                forest.add(a, b, lambda i, j: True)
            if (out := _joined(forest, node)) is not None:
                yield out

    return meet


def _checked(threshold: tuple[int, int]) -> Callable:
    """Per (cluster, cell), links between sets of different labels, as few as connect the same sets."""
    num, den = threshold

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("cluster", "cell")):
            label, node = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("label", "node"))
            sets = [_unpacked(r["ids"]) for r in rows]
            forest = _Forest(label)

            def linked(i: int, j: int) -> bool:
                both = np.concatenate([sets[i], sets[j]])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                return common * den >= (len(both) - common) * num

            for a, b in similar_pairs(np.array([len(x) for x in sets]), [bitmap(x) for x in sets], threshold, lambda i, j: forest.part[i] != forest.part[j]):
                forest.add(a, b, linked)
            if (out := _joined(forest, node)) is not None:
                yield out

    return check


def _star_links(threshold: tuple[int, int]) -> Callable:
    """Per (leader, salt), the members that the leader links with; the leader's own row comes first."""
    num, den = threshold

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, held = None, np.zeros(0, _U)
        for batch in batches:
            found = []
            for name, node, ids in zip(batch.column("leader").to_pylist(), batch.column("node").to_pylist(), batch.column("ids"), strict=True):
                own = _unpacked(ids.as_py())
                if name == node:
                    leader, held = name, own
                elif name == leader:
                    common = int(np.isin(own, held, assume_unique=True).sum())
                    if common * den >= (len(own) + len(held) - common) * num:
                        found.append((node, name))
            if found:
                yield _batch(_PAIR, *zip(*found, strict=True))

    return check


def row_number_of(key: Column, text: Column) -> Column:
    """One number for rows alike in key and text; a null text counts as empty."""
    return F.xxhash64(key.cast("string"), F.coalesce(text.cast("string"), F.lit("")))


def _cells(rows: DataFrame, parts: Column) -> DataFrame:
    """Each row in the cells where it meets others: one for a small group; else its block with each other block."""
    block = F.pmod(F.xxhash64("node"), F.col("_parts"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), lambda j: j != block)
    cells = F.when(F.col("_parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(other, lambda j: F.least(block, j) * F.col("_parts") + F.greatest(block, j)))
    return rows.withColumn("_parts", parts.cast("long")).withColumn("cell", F.explode(cells)).drop("_parts")


def _picked(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted. Up to ``BROADCAST_KEYS`` distinct keys, of eight bytes, go to the rows; beyond that the rows are shuffled to the keys."""
    few = wanted.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(wanted) if few else wanted, key, "left_semi")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, row, class): one row for each row of ``docs``.

    ``component_id`` is the least id reachable by links, the row's own included. Null texts
    and texts without words have no shingles and link with nothing, not even with each
    other. Repeated rows are in one class. A null id takes part in links but is never the
    least; a class of null ids only has a null ``component_id``. ``row`` numbers rows alike
    in id and text. ``class`` tells classes apart even where ids are null or shared; it is
    null without shingles. An empty table gives no rows.

    Exact but for hashes: sets are numbered by 64 bits (odds of any collision among m
    distinct sets: m * m in 2**65), shingles are compared by 48.
    """
    with small_batches(docs.sparkSession):
        return _classes(docs, id_col, text_col, words, threshold)


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: tuple[int, int]) -> DataFrame:
    work = Workspace(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row_number_of(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.encode(text, "UTF-8").alias("text"))
    num, den = threshold
    seeds = _mix(np.arange(1, BANDS * (3 if num * 20 >= 17 * den else 2) + 1, dtype=_U) * _U(0x632BE59BD9B4E019)).reshape(BANDS, -1)
    # prefixes and bitmaps are wide: they are made of the texts again where they are used, not kept beside everything between
    signed = work.keep(rows.mapInArrow(_signatures(words, seeds), _ddl(_SIGNATURE)), "signatures")
    nodes = work.keep(signed.where(F.col("n") > 0).groupBy("node").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("doc_id").alias("least"), F.any_value("bands").alias("bands")), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, ids) of the wanted nodes, from their texts."""
        chosen = nodes.join(wanted, "node", "left_semi").select("row")
        return _picked(rows.select("row", "text"), chosen, "row").dropDuplicates(["row"]).mapInArrow(_sets(words), _ddl(_SET))

    # 1. pairs with the most central node of each band
    banded = nodes.select("node", F.explode("bands").alias("band"))
    met = work.keep(banded.withColumn("crowd", F.count(F.lit(1)).over(Window.partitionBy("band"))).where(F.col("crowd") > 1), "bands")
    central = met.groupBy("node").agg(F.sum("crowd").alias("weight"))
    leaders = met.join(central, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("top")).select("band", F.col("top.node").alias("leader"))
    stars = work.keep(met.join(leaders, "band").where(F.col("node") != F.col("leader")).select("leader", "node").distinct(), "stars")
    salts = work.keep(stars.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts")), "salts")
    members = stars.join(salts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), "node")
    heads = salts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("node"))
    sets = work.keep(sets_of(stars.select(F.explode(F.array("leader", "node")).alias("node")).distinct()), "sets")
    spread = members.unionByName(heads).join(sets, "node").repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("node") != F.col("leader"))
    links = work.keep(spread.mapInArrow(_star_links(threshold), _PAIR_DDL), "links")
    work.drop("bands", "stars", "salts", "sets")
    labels = components(links, work)

    # 2. prefix shingles shared by nodes of different classes
    frequent = frequent_shingles(rows, words)
    prefixes = rows.select("row", "text").mapInArrow(_prefixes(words, frequent, threshold), _ddl(_PREFIX)).groupBy("node").agg(F.any_value("prefix").alias("prefix"))
    labelled = prefixes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("label"), F.explode("prefix").alias("token"))
    same = Window.partitionBy("token")
    spread = labelled.select("token", "node", "label", F.min("label").over(same).alias("low"), F.max("label").over(same).alias("high"), F.count(F.lit(1)).over(same).alias("times"), F.bit_xor(F.xxhash64("node")).over(same).alias("who"))
    meeting = work.keep(spread.where(F.col("low") != F.col("high")).drop("low", "high"), "meeting")
    # shingles with the same nodes lead to the same pairs: one of them is enough
    several = meeting.groupBy("times", "who").agg(F.min("token").alias("token")).select("token")
    meeting = meeting.join(several, "token", "left_semi")
    # each node in the bucket of its size, and as a guest in the next; a bucket of one label or of guests only has no pair
    size = F.floor(F.log("n") / F.lit(math.log(den / num)))
    placed = meeting.join(nodes.select("node", "n"), "node").select("token", "node", "label", F.explode(F.array(F.struct(size.alias("size"), F.lit(1).alias("home")), F.struct((size + 1).alias("size"), F.lit(0).alias("home")))).alias("in")).select("token", "in.*", "node", "label")
    bucket = Window.partitionBy("token", "size")
    counted = placed.select("*", F.min("label").over(bucket).alias("low"), F.max("label").over(bucket).alias("high"), F.max("home").over(bucket).alias("homes"), F.count(F.lit(1)).over(bucket).alias("times"))
    kept = work.keep(counted.where((F.col("low") != F.col("high")) & (F.col("homes") > 0)).drop("low", "high", "homes"), "placed")
    bitmaps = work.keep(_picked(rows.select("row", "text").mapInArrow(_bitmaps(words), _ddl(_BITMAP)), kept.select("node").distinct(), "node").groupBy("node").agg(F.min("n").alias("n"), F.any_value("bitmap").alias("bitmap")), "bitmaps")
    work.drop("meeting")
    cells = _cells(kept, F.ceil(F.col("times") / BLOCK)).select("token", "size", "cell", "home", "node", "label")
    width = F.length("bitmap") + ROW_BYTES
    once = bitmaps.agg(F.sum(width)).first()[0] or 0
    sent = cells.select("node").join(bitmaps.select("node", width.alias("width")), "node").agg(F.sum("width")).first()[0] or 0
    passes = max(1, math.ceil(sent / max(PASS_LEAST, PASS_COPIES * once)))
    found = [f"candidates-{i}" for i in range(passes)]
    candidates = []
    for i, name in enumerate(found):
        buckets = cells.where(F.pmod(F.xxhash64("token", "size"), F.lit(passes)) == i).join(bitmaps, "node")
        candidates.append(work.keep(buckets.repartition("token", "size", "cell").sortWithinPartitions("token", "size", "cell").mapInArrow(_candidates(threshold), _PAIR_DDL), name))
    work.drop("placed", "bitmaps")
    clusters = components(reduce(DataFrame.unionByName, candidates), work).withColumnRenamed("component", "cluster")
    work.drop(*found)
    sized = clusters.join(nodes.select("node", "n"), "node").groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    placed = _cells(clusters.join(sized, "cluster"), F.col("parts")).join(labels, "node", "left").select("cluster", "cell", "node", F.coalesce("component", "node").alias("label"))
    sets = work.keep(sets_of(clusters.select("node")), "sets")
    checked = placed.join(sets, "node").repartition("cluster", "cell").sortWithinPartitions("cluster", "cell").mapInArrow(_checked(threshold), _PAIR_DDL)
    joined = components(links.unionByName(checked), work)
    final = nodes.select("node", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = final.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = final.join(least, "component").select("node", "component_id", F.col("component").alias("class"))
    out = signed.join(by_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row", F.when(F.col("n") > 0, F.col("class")).alias("class"))
    return work.result(out)
