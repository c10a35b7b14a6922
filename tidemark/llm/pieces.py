"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into units at places that no piece crosses. Of each distinct unit all
substrings up to the longest piece's length are exploded and equi-joined to the piece table;
the matches, grouped by unit, are the edges of its lattice, and a fold with the
higher-order function ``aggregate`` picks the path:

* ``unigram`` tables: Viterbi, the path of highest summed score;
* ``bpe`` tables: the same edges, folded by best merge: in each step the edge of highest
  score (leftmost of equals) that spans exactly two parts joins them. A byte-pair model's
  ids are defined by its merges, and the path of highest summed score is another one.

Everything runs on DataFrame functions, but for units longer than ``LONG`` characters of a
``bpe`` table: the fold's cost is quadratic there, and a helper with a heap takes over.

``transcode`` is for whole corpora: it gives the same ids and texts without a shuffle, by the
same heap over every distinct unit that a worker meets.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
LONG = 48
#: Units that a worker gathers before it forgets those not met since, and ids handed back at once.
REMEMBERED = 300_000
CHUNK_IDS = 250_000

_UNITS = re.compile(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n")


def piece_table(spark: SparkSession, model_file: str) -> DataFrame:
    """(piece, id, score, bytes): the model's pieces; ``bytes`` is the hex text that a piece decodes to, null for control pieces.

    As many rows as the model has pieces, whatever the data, so the table may be broadcast.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            rows.append((None, i, None, None))
        elif model.is_byte(i):
            rows.append((None, i, None, piece[3:5]))
        else:
            rows.append((piece, i, float(model.get_score(i)), piece.replace(SPACE, " ").encode().hex().upper()))
    return spark.createDataFrame(rows, "piece string, id int, score double, bytes string")


def units(text: Column) -> Column:
    """Units of a text with spaces shown as in pieces, a leading one added: white space runs with what follows, line ends alone."""
    shown = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(shown, F.lit(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n"), F.lit(0)))


def lattices(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): for each distinct unit its pieces by (start, stop, id, score)."""
    n = F.length("unit")
    starts = F.sequence(F.lit(0), n - 1)
    spans = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i)), lambda k: F.struct(i.alias("start"), (i + k).alias("stop"), F.substring(F.col("unit"), i + 1, k).alias("piece")))))
    edges = words.select("unit", F.explode(spans).alias("e")).select("unit", "e.*").join(F.broadcast(table.where(F.col("piece").isNotNull())), "piece")
    found = edges.groupBy("unit").agg(F.collect_list(F.struct("start", "stop", "id", "score")).alias("edges"))
    return words.join(found, "unit", "left").select("unit", F.coalesce("edges", F.array().cast("array<struct<start:int,stop:int,id:int,score:double>>")).alias("edges"))


def best_merges(unit: Column, edges: Column) -> Column:
    """Cuts left after folding the merges of a byte-pair table; ``n - 1`` steps suffice."""
    n = F.length(unit)
    every = F.sequence(F.lit(0), n)

    def step(cuts: Column, _: Column) -> Column:
        def two(e: Column) -> Column:
            at = F.array_position(cuts, e["start"])
            return (e["stop"] - e["start"] >= 2) & (at > 0) & (F.get(cuts, (at + 1).cast("int")) == e["stop"])

        fits = F.transform(F.filter(edges, two), lambda e: F.struct(e["score"], (-e["start"]).alias("first"), F.get(cuts, F.array_position(cuts, e["start"]).cast("int")).alias("cut")))
        best = F.array_max(fits)
        return F.when(best.isNull(), cuts).otherwise(F.array_remove(cuts, best["cut"]))

    return F.aggregate(F.slice(every, 1, n - 1), every, step)


def best_path(unit: Column, edges: Column, unknown: float = -100.0) -> Column:
    """Cuts of the path of highest summed score; a character that is no piece costs ``unknown``. Of equals the earliest start wins."""
    n = F.length(unit)
    empty = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("back")))

    def step(best: Column, stop: Column) -> Column:
        into = F.transform(F.filter(edges, lambda e: e["stop"] == stop), lambda e: F.struct((F.get(best, e["start"])["score"] + e["score"]).alias("score"), (-e["start"]).alias("first")))
        alone = F.array(F.struct((F.get(best, stop - 1)["score"] + F.lit(unknown)).alias("score"), (1 - stop).alias("first")))
        top = F.array_max(F.concat(into, alone))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), (-top["first"]).alias("back"))))

    forward = F.aggregate(F.sequence(F.lit(1), n), empty, step)
    # from the end back over the best starts
    return F.sort_array(F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda cuts, _: F.when(F.array_min(cuts) > 0, F.concat(cuts, F.array(F.get(forward, F.array_min(cuts))["back"]))).otherwise(cuts)))


def path_ids(unit: Column, edges: Column, cuts: Column, byte_zero: int) -> Column:
    """Piece ids along the cuts; a character that is no piece becomes the ids of its bytes."""

    def ids(k: Column) -> Column:
        start, stop = F.get(cuts, k - 1), F.get(cuts, k)
        known = F.transform(F.filter(edges, lambda e: (e["start"] == start) & (e["stop"] == stop)), lambda e: e["id"])
        code = F.hex(F.encode(F.substring(unit, start + 1, stop - start), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda b: F.conv(F.substring(code, b * 2 + 1, F.lit(2)), 16, 10).cast("int") + byte_zero)
        return F.when(F.size(known) > 0, F.slice(known, 1, 1)).otherwise(raw)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), ids))


def merge_long(unit: str, pieces: dict[str, tuple[int, float]], byte_zero: int) -> list[int]:
    """The merges of one long unit, with a heap of neighbouring parts."""
    parts: list[str | None] = list(unit)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < len(parts) and (both := parts[i] + parts[after[i]]) in pieces:
            heapq.heappush(heap, (-pieces[both][1], i, both))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, both = heapq.heappop(heap)
        if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
            continue
        j = after[i]
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [x for p in parts if p is not None for x in ([pieces[p][0]] if p in pieces else [b + byte_zero for b in p.encode()])]


def encode_units(words: DataFrame, table: DataFrame, kind: str) -> DataFrame:
    """(unit, ids) for distinct units."""
    bound = table.agg(F.max(F.length("piece")), F.min(F.when(F.col("bytes") == "00", F.col("id"))).alias("zero")).first()
    longest, zero = bound[0], bound["zero"]
    if zero is None:
        raise ValueError("the piece table has no byte pieces")
    fold = best_merges if kind == "bpe" else best_path
    short = words.where(F.length("unit") <= LONG) if kind == "bpe" else words
    ids = lattices(short, table, longest).select("unit", "edges", fold(F.col("unit"), F.col("edges")).alias("cuts")).select("unit", path_ids(F.col("unit"), F.col("edges"), F.col("cuts"), zero).alias("ids"))
    if kind != "bpe":
        return ids
    pieces = {r["piece"]: (r["id"], r["score"]) for r in table.where(F.col("piece").isNotNull()).collect()}

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"unit": batch["unit"], "ids": [merge_long(u, pieces, zero) for u in batch["unit"]]})

    return ids.unionByName(words.where(F.length("unit") > LONG).mapInPandas(merge, "unit string, ids array<int>"))


def encode(rows: DataFrame, table: DataFrame, text_col: str = "text", ids_col: str = "ids", kind: str = "bpe") -> DataFrame:
    """``rows`` with the ids of their texts in ``ids_col`` (replaced if there).

    Equal texts are encoded once, equal units of all texts too. A null text has null ids, an
    empty one no ids. Repeated rows keep their number, other columns pass unchanged, and an
    empty table gives no rows.
    """
    keyed = rows.withColumn("_sp_text", F.xxhash64(F.col(text_col)))
    texts = keyed.where(F.col(text_col).isNotNull()).select("_sp_text", F.col(text_col).cast("string").alias("_sp_s")).groupBy("_sp_text").agg(F.min("_sp_s").alias("_sp_s"))
    placed = texts.select("_sp_text", F.posexplode(units(F.col("_sp_s"))).alias("at", "unit"))
    coded = encode_units(placed.select("unit").distinct(), table, kind)
    by_text = placed.join(coded, "unit").groupBy("_sp_text").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("_sp_ids"))
    none = F.when(F.col(text_col).isNotNull(), F.array().cast("array<int>"))
    return keyed.drop(ids_col).join(by_text, "_sp_text", "left").withColumn(ids_col, F.coalesce("_sp_ids", none)).drop("_sp_text", "_sp_ids")


def decode(rows: DataFrame, table: DataFrame, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids in ``text_col`` (replaced if there); control ids and unknown ones decode to nothing, the added leading space goes.

    Null ids give null, no ids an empty text. Invalid UTF-8 is replaced as Java's decoder does.
    """
    keyed = rows.drop(text_col).withColumn("_sp_ids", F.xxhash64(ids_col))
    lists = keyed.where(F.size(ids_col) > 0).groupBy("_sp_ids").agg(F.any_value(ids_col).alias("_sp_list"))
    parts = lists.select("_sp_ids", F.posexplode("_sp_list").alias("at", "id")).join(F.broadcast(table.select("id", "bytes")), "id", "left")
    joined = parts.groupBy("_sp_ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bytes", F.lit("")).alias("bytes")))), lambda x: x["bytes"]), "").alias("_sp_hex"))
    whole = F.regexp_replace(F.decode(F.unhex("_sp_hex"), "UTF-8"), "^ ", "")
    return keyed.join(joined, "_sp_ids", "left").withColumn(text_col, F.when(F.col(ids_col).isNotNull(), F.coalesce(whole, F.lit("")))).drop("_sp_ids", "_sp_hex")


class _Merger(dict):
    """Ids of a unit, remembered for repeated units."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_zero: int):
        super().__init__()
        self._pieces, self._zero = pieces, byte_zero
        self._before: dict[str, array] = {}  # what was remembered until there was too much of it

    def __missing__(self, unit: str) -> array:
        ids = self._before.get(unit)
        if ids is None:
            ids = array("i", merge_long(unit, self._pieces, self._zero))
        if len(unit) < LONG:
            self[unit] = ids
        return ids

    def encode(self, text: str) -> array:
        ids = array("i")
        if text:
            if len(self) > REMEMBERED:
                self._before = self.copy()
                self.clear()
            for unit in _UNITS.findall(SPACE + text.replace(" ", SPACE)):
                ids += self[unit]
        return ids


def transcode(rows: DataFrame, table: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``rows`` with the ids of their texts under a ``bpe`` table, and with the text that these ids decode to.

    Equal to ``decode(encode(rows, table), table)``, but for the order of columns. Nothing is
    shuffled, so neither a hot unit nor a group of copies gathers anywhere.
    """
    entries = table.collect()  # as many rows as the model has pieces
    pieces = {r["piece"]: (r["id"], r["score"]) for r in entries if r["piece"] is not None}
    raw = {r["id"]: bytes.fromhex(r["bytes"] or "") for r in entries}
    zero = min((r["id"] for r in entries if r["bytes"] == "00" and r["piece"] is None), default=None)
    if zero is None:
        raise ValueError("the piece table has no byte pieces")
    shared = rows.sparkSession.sparkContext.broadcast((pieces, raw, zero))
    kept = rows.drop(ids_col, decoded_col).withColumn(text_col, F.col(text_col).cast("string"))
    names = [*kept.columns, ids_col, decoded_col]  # the frame itself stays out of the function below

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, raw, zero = shared.value
        merger = _Merger(pieces, zero)
        for batch in batches:
            texts, begin = batch.column(text_col), 0
            flat, starts, decoded = array("i"), [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                if text is None:
                    starts.append(None), decoded.append(None)
                else:
                    ids = merger.encode(text)
                    starts.append(len(flat)), decoded.append(b"".join([raw[x] for x in ids]).decode("utf-8", "replace").removeprefix(" "))
                    flat += ids
                if len(flat) >= CHUNK_IDS or i + 1 == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array([*starts, len(flat)], pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32)))
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, i + 1 - begin).columns, lists, pa.array(decoded, pa.string())], names=names)
                    flat, starts, decoded, begin = array("i"), [], [], i + 1

    kinds = T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())])
    return kept.mapInArrow(code, kinds)
