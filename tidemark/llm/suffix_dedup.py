"""Removal of repeated passages: every byte under a ``span``-byte string that also starts elsewhere.

Sorting the suffixes of all bytes would ship each byte ``span`` times. Only sampled suffixes
are sorted, and still no repeat is lost:

1. Every ``span``-byte window has an anchor, the ``GRAM``-byte gram in it with the least hash
   (leftmost of equals). Equal windows have their anchors at the same place, so a window can
   only recur among windows whose anchor is the same gram. Neighbouring windows share an
   anchor; a maximal run of them is a *stretch*, about one for 85 bytes.
2. Stretches meet by gram, in one shuffle; those whose gram occurs once are dropped.
3. Stretches with equal content recur as a whole: all their windows are repeats. One of each
   kind goes on, and only where its gram has stretches of different content.
4. Those are range-partitioned by the leading bytes of the suffix at the anchor, with
   splitters that Spark samples; each bucket sorts the suffixes of all their windows by a
   multikey quicksort on eight-byte words and compares neighbours. Equal leading bytes fall
   between the same two splitters, so no repeat lies across a bucket boundary.
5. A gram with more than ``HOT_STRETCHES`` different stretches would overfill a bucket. Its
   windows are compared as rows, by 128-bit fingerprints, in an aggregation and a join whose
   large partitions Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Workspace, small_batches

SPAN = 200
GRAM = 32
#: Windows handled at once; the low bits of a hash hold a window's place among them.
CHUNK_BITS = 20
#: Different stretches of one gram that a bucket may sort.
HOT_STRETCHES = 4096
#: Row numbers, of eight bytes each, that are sent to every executor.
BROADCAST_ROWS = 1_000_000
#: Stretches that a bucket sorts at once, and bytes of them in a bucket.
SORTED_AT_ONCE = 6_000
BUCKET_STRETCHES = 40_000

_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_U = np.uint64


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of ``base`` and of its inverse modulo 2**64; one table a base, grown as needed."""
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=_U)
            p[0] = 1
            out.append(np.cumprod(p, dtype=_U))
        _TABLES[base] = (out[0], out[1])
    return _TABLES[base]


def _prefix(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash; with the inverse powers they give any substring's hash."""
    power, inverse = _powers(1 << max(16, (len(data) + 1).bit_length()), base)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=sums[1:])
    return sums, inverse


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def stretches(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, content hash, anchor, first window, last window) of each stretch, as four arrays; the last holds pairs."""
    keys, wholes, anchors, ends = [], [], [], []
    step = 1 << CHUNK_BITS
    for c in range(0, max(0, len(data) - span + 1), step - span):
        part = data[c : c + step - 1]
        if len(part) < span:
            break
        sums, inverse = _prefix(part, _BASE)
        h = _mix((sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1])
        place = (h >> _U(CHUNK_BITS) << _U(CHUNK_BITS)) | np.arange(len(h), dtype=_U)
        at = (_sliding_min(place, span - gram + 1) & _U(step - 1)).astype(np.int64)
        n = min(len(at), step - span)  # the rest belongs to the next chunk
        at = at[:n]
        turn = np.flatnonzero(at[1:] != at[:-1]) + 1
        lo, hi = np.concatenate([[0], turn]), np.concatenate([turn - 1, [n - 1]])
        a = at[lo]
        keys.append(h[a])
        wholes.append(_mix((sums[hi + span] - sums[lo]) * inverse[lo] + (hi - lo).astype(_U)))
        anchors.append(a + c)
        ends.append(np.stack([lo + c, hi + c], axis=1))
    if not keys:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    return np.concatenate(keys), np.concatenate(wholes), np.concatenate(anchors), np.concatenate(ends)


def repeated_windows(key: np.ndarray, left: np.ndarray, windows: np.ndarray, content: list[bytes], span: int = SPAN) -> np.ndarray:
    """For the windows of all stretches in turn: does another one hold the same bytes?

    ``left`` is the anchor's distance from the first window. Windows are grouped by gram and
    anchor distance, then sorted by a multikey quicksort on eight-byte words, all groups a
    step at a time: a group is parted by a pivot word into less, equal and greater, of which
    the equal part goes on to the next word. A window alone in its part is done.
    """
    sizes = np.array([len(x) for x in content])
    buffer = np.frombuffer(b"".join(content) + bytes(8), dtype=np.uint8).astype(_U)
    word, size = buffer, 1
    while size < 8:
        word = (word[:-size] << _U(8 * size)) | word[size:]
        size *= 2
    total = int(windows.sum())
    of = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    start = (np.cumsum(sizes) - sizes)[of] + nth
    depths = np.array([*range(0, span - 7, 8), *([span - 8] if span % 8 else [])])
    group = np.unique(key, return_inverse=True)[1][of] * (span + 1) + (left[of] - nth)
    active = np.argsort(group, kind="stable")
    group, level, found = group[active], np.zeros(total, dtype=np.int64), np.zeros(total, dtype=bool)
    while True:
        turn = np.flatnonzero(group[1:] != group[:-1]) + 1
        first = np.concatenate([[0], turn]) if len(group) else turn
        many = np.diff(np.append(first, len(group)))
        kept = np.repeat(many > 1, many)
        ended = level == len(depths)
        found[active[kept & ended]] = True
        kept &= ~ended
        active, group, level = active[kept], group[kept], level[kept]
        if not len(active):
            return found
        first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        many = np.diff(np.append(first, len(group)))
        now = word[start[active] + depths[level]]
        pivot = np.repeat(now[first + many // 2], many)
        part = np.repeat(np.arange(len(first)), many) * 3 + (now >= pivot) + (now > pivot)
        order = np.argsort(part, kind="stable")
        active, group, level = active[order], part[order], level[order]
        level += group % 3 == 1


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def merge(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans, sorted; touching ones are joined."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[first, 0], reach[last]], axis=1)


def _bytes(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    for x in batch.column(column):
        yield np.frombuffer(x.as_buffer(), dtype=np.uint8) if x.is_valid and len(x.as_buffer()) else np.zeros(0, np.uint8)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_STRETCH = pa.schema([("key", pa.int64()), ("whole", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("more", pa.list_(pa.int64()))])
_SNIPPET = pa.schema([("lead", pa.binary()), ("key", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("left", pa.int32()), ("windows", pa.int32()), ("alone", pa.bool_()), ("content", pa.binary())])
_PLACE = pa.schema([("row", pa.int64()), ("span", pa.int64())])  # start << 16, and the length
_SPANS = pa.schema([("row", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
_PRINT = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("row", pa.int64()), ("start", pa.int64())])
#: ``at`` of a stretch: its anchor, and how far its first and last window start before it.
_AT = (16, 8, 0xFF)


def _find_stretches(span: int, gram: int) -> Callable:
    """A row for each stretch; those of one text that have equal contents share a row, which lists the others in ``more``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, others, size = batch.column("row").to_numpy(), [], [], 0
            for row, data in zip(rows, _bytes(batch, "text"), strict=True):
                if len(data) < span:
                    continue
                key, whole, a, ends = stretches(data, span, gram)
                at = (a << _AT[0]) | ((a - ends[:, 0]) << _AT[1]) | (a - ends[:, 1])
                _, first, of, times = np.unique(_mix(key) + whole, return_index=True, return_inverse=True, return_counts=True)
                more: list[np.ndarray | None] = [None] * len(first)
                if len(first) < len(key):
                    order = np.argsort(of, kind="stable")
                    for i, group in enumerate(np.split(order, np.cumsum(times)[:-1])):
                        if len(group) > 1:
                            more[i] = at[group[1:]]
                held.append((key[first].view(np.int64), whole[first].view(np.int64), np.full(len(first), row), at[first]))
                others += more
                size += len(key)
                if size > 50_000:
                    yield _batch(_STRETCH, *map(np.concatenate, zip(*held, strict=True)), others)
                    held, others, size = [], [], 0
            if held:
                yield _batch(_STRETCH, *map(np.concatenate, zip(*held, strict=True)), others)

    return find


def _cut_snippets(span: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _SNIPPET]
            for row, data, wanted in zip(batch.column("row").to_pylist(), _bytes(batch, "text"), batch.column("wanted"), strict=True):
                for w in wanted.as_py():
                    a, lo, hi = w["at"] >> _AT[0], 0, 0
                    lo, hi = a - (w["at"] >> _AT[1] & _AT[2]), a - (w["at"] & _AT[2])
                    for column, x in zip(out, (data[a : a + 16].tobytes(), w["key"], row, lo, a - lo, hi - lo + 1, w["n"] == 1, data[lo : hi + span].tobytes()), strict=True):
                        column.append(x)
            if out[0]:
                yield _batch(_SNIPPET, *out)

    return cut


def _sort_bucket(span: int) -> Callable:
    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        windows, lo = t["windows"].to_numpy().astype(np.int64), t["lo"].to_numpy()
        found = repeated_windows(t["key"].to_numpy(), t["left"].to_numpy().astype(np.int64), windows, t["content"].to_pylist(), span)
        of = np.repeat(np.arange(len(windows)), windows)
        first, last = _runs(found & t["alone"].to_numpy()[of])
        begin = np.cumsum(windows) - windows
        # a run may go on into the next stretch of another document: cut it there
        rows, spans = [], []
        for f, e in zip(first.tolist(), last.tolist(), strict=True):
            while f <= e:
                i = of[f]
                g = min(e, begin[i] + windows[i] - 1)
                rows.append(i), spans.append((lo[i] + f - begin[i]) << 16 | (g - f + span))
                f = g + 1
        return _batch(_PLACE, t["row"].to_numpy()[np.array(rows, dtype=np.int64)], np.array(spans, dtype=np.int64))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            turn = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            # rows come sorted by key: all up to the last turn is complete
            if held and (len(turn) or keys[0] != held[-1].column("key")[-1].as_py()) and size >= SORTED_AT_ONCE:
                split = 0 if keys[0] != held[-1].column("key")[-1].as_py() else int(turn[0])
                if split:
                    held.append(batch.slice(0, split))
                yield compare(held)
                held, size, batch = [], 0, batch.slice(split)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield compare(held)

    return sort


def _fingerprints(span: int) -> Callable:
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, wanted in zip(batch.column("row").to_pylist(), _bytes(batch, "text"), batch.column("wanted"), strict=True):
                for w in wanted.as_py():
                    a = w["at"] >> _AT[0]
                    lo, hi = a - (w["at"] >> _AT[1] & _AT[2]), a - (w["at"] & _AT[2])
                    each = []
                    for base in (_BASE, _BASE2):
                        sums, inverse = _prefix(data[lo : hi + span], base)
                        each.append(_mix((sums[span:] - sums[:-span]) * inverse[: hi - lo + 1]).view(np.int64))
                    yield _batch(_PRINT, *each, np.full(hi - lo + 1, row), np.arange(lo, hi + 1))

    return prints


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, span) rows sorted by row to a row each with its merged spans."""

    def merged(row: np.ndarray, span: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], row[1:] != row[:-1]])
        shift = (np.cumsum(new) - 1) << 40  # so that spans of different rows stay apart
        start = shift + (span >> 16)
        both = merge(np.stack([start, start + (span & 0xFFFF)], axis=1))
        ends = np.searchsorted(both[:, 0] >> 40, np.arange(new.sum() + 1))
        values = pa.StructArray.from_arrays([pa.array(both[:, 0] & ((1 << 40) - 1)), pa.array(both[:, 1] - (both[:, 0] >> 40 << 40))], names=["start", "stop"])
        return pa.RecordBatch.from_arrays([pa.array(row[new]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], schema=_SPANS)

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        row, span = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("row", "span"), strict=True))
        done = np.flatnonzero(row != row[-1]) if len(row) else row  # the last row may go on
        last = int(done[-1]) + 1 if len(done) else 0
        if last:
            yield merged(row[:last], span[:last])
        held = row[last:], span[last:]
    if len(held[0]):
        yield merged(*held)


def repeated_spans(docs: DataFrame, row: str = "row", text: str = "text", span: int = SPAN, gram: int = GRAM, hot: int = HOT_STRETCHES) -> DataFrame:
    """(row, spans): for each row with repeats, the half-open byte spans that repeated windows cover.

    ``row`` must tell apart rows of different text.
    """
    if span - gram > _AT[2] or gram < 8 or span < gram:
        raise ValueError("span must be at least gram, and at most 255 more")
    with small_batches(docs.sparkSession):
        return _repeated_spans(docs, row, text, span, gram, hot)


def _repeated_spans(docs: DataFrame, row: str, text: str, span: int, gram: int, hot: int) -> DataFrame:
    work = Workspace(docs.sparkSession)
    docs = docs.select(F.col(row).cast("long").alias("row"), F.encode(F.col(text), "UTF-8").alias("text"))
    same_gram = Window.partitionBy("key")
    same_content = Window.partitionBy("key", "whole").orderBy("row", "at")
    whole = same_content.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one shuffle by gram serves all of these; a common gram's rows are read from disk where they don't fit
    here = F.lit(1) + F.coalesce(F.array_size("more"), F.lit(0))
    every = docs.mapInArrow(_find_stretches(span, gram), _ddl(_STRETCH)).withColumn("times", F.sum(here).over(same_gram)).where(F.col("times") > 1)
    counted = every.select("key", "row", "at", "more", F.sum(here).over(whole).alias("n"), F.row_number().over(same_content).alias("nth")).withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(same_gram))
    found = work.keep(counted.select("row", "at", "more", "n", F.when((F.col("nth") == 1) & (F.col("kinds") > 1), F.col("key")).alias("key"), "kinds").where((F.col("n") > 1) | F.col("key").isNotNull()), "stretches")
    copied = found.where(F.col("n") > 1).select("row", F.explode(F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<long>")))).alias("at")).select("row", _span_of("at", span))
    wanted = found.where(F.col("key").isNotNull())

    def listed(some: DataFrame) -> DataFrame:
        # dealt by row first: lists that are begun before a shuffle take more room than their entries
        return some.select("row", "key", "n", "at").repartition("row").groupBy("row").agg(F.collect_list(F.struct("key", "n", "at")).alias("wanted"))

    top = wanted.agg(F.max("kinds"), F.count(F.lit(1))).first()
    buckets = max(1, int(top[1] // BUCKET_STRETCHES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    snippets = docs.join(listed(wanted.where(F.col("kinds") <= hot)).hint("merge"), "row").mapInArrow(_cut_snippets(span), _ddl(_SNIPPET))
    sorted_in = snippets.repartitionByRange(buckets, "lead", "key").sortWithinPartitions("lead", "key")
    places = [copied, sorted_in.mapInArrow(_sort_bucket(span), _ddl(_PLACE))]
    if (top[0] or 0) > hot:
        common = wanted.where(F.col("kinds") > hot)
        rows = common.select("row").distinct()  # few texts hold such a gram: only those are shuffled, unless they are too many to be named
        held = docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "row", "left_semi")
        prints = work.keep(held.join(listed(common).hint("merge"), "row").mapInArrow(_fingerprints(span), _ddl(_PRINT)), "prints")
        twice = prints.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("p", "q")
        places.append(prints.join(twice, ["p", "q"]).select("row", F.shiftleft("start", 16).bitwiseOR(F.lit(span)).alias("span")))
    spans = places[0]
    for more in places[1:]:
        spans = spans.unionByName(more)
    return work.result(spans.repartition("row").sortWithinPartitions("row").mapInArrow(_merge_sorted, "row long, spans array<struct<start:long,stop:long>>"))


def _span_of(at: str, span: int) -> Column:
    anchor = F.shiftright(F.col(at), _AT[0])
    before = F.shiftright(F.col(at), _AT[1]).bitwiseAND(F.lit(_AT[2]))
    length = before - F.col(at).bitwiseAND(F.lit(_AT[2])) + span
    return F.shiftleft(anchor - before, 16).bitwiseOR(length).alias("span")


def _clean(span: int, whole_characters: bool) -> Callable:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for data, spans in zip(_bytes(batch, "_sd_text"), batch.column("_sd_spans"), strict=True):
                held = np.array([(s["start"], s["stop"]) for s in spans.as_py()], dtype=np.int64) if spans.is_valid else np.zeros((0, 2), np.int64)
                keep = np.ones(len(data), dtype=bool)
                for s, e in held:
                    keep[s:e] = False
                rest = data[keep].tobytes()
                text = rest
                if whole_characters:
                    inner = (data & 0xC0) == 0x80  # bytes inside a character share the fate of its first and last
                    head = np.flatnonzero(~inner)
                    gone = np.minimum.reduceat((~keep).astype(np.uint8), head) if len(head) else np.zeros(0, np.uint8)
                    text = data[~np.repeat(gone.astype(bool), np.diff(np.append(head, len(data))))].tobytes()
                for column, x in zip(out, (len(data), len(data) - len(rest), len(held), hashlib.sha256(rest).hexdigest(), text.decode("utf-8", "replace") if whole_characters else None), strict=True):
                    column.append(x)
            rest = batch.drop_columns(["_sd_text", "_sd_spans"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())],
                names=[*rest.schema.names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "_sd_kept"],
            )

    return clean


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, keep_text: bool = True, hot: int = HOT_STRETCHES) -> DataFrame:
    """``docs`` without repeated bytes, and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` added.

    Every occurrence goes, the first one too; strings are judged on the input. A null text
    counts as empty and comes back empty. Repeated rows are repeats of each other. Texts
    shorter than ``span`` bytes stay whole. The returned text keeps a character of which only
    some bytes are covered, while counts and digest are of bytes; without ``keep_text`` the
    text column is gone. Columns with the added names are replaced, all others pass
    unchanged, and an empty table gives no rows.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # rows alike in key and text have the same repeats, so they may share a number
    rows = docs.drop(*added).withColumn("_sd_row", F.xxhash64(F.col(id_col).cast("string"), text)).withColumn(text_col, text)
    spans = repeated_spans(rows, "_sd_row", text_col, span, hot=hot).withColumnsRenamed({"row": "_sd_row", "spans": "_sd_spans"})
    # merged at every size, so that the plan stays the same
    joined = rows.join(spans.hint("merge"), "_sd_row", "left").withColumn("_sd_text", F.encode(text_col, "UTF-8")).drop("_sd_row", text_col)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("_sd_text", "_sd_spans")]
    schema = ", ".join([*kept, "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "_sd_kept string"])
    out = joined.mapInArrow(_clean(span, keep_text), schema)
    if keep_text:
        out = out.withColumnRenamed("_sd_kept", text_col)
        return out.select(*docs.drop(*added).columns, *added)
    return out.drop("_sd_kept")
