"""Benchmark decontamination: a broadcast hash set of the items' word windows, against which the windows of all documents are held."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.ascii_words import FOLD, PATTERN, UPPER, stretches, word_numbers, words_of
from tidemark.llm.scratch import materialize, small_batches

WORDS = 10
#: Pairs of a window and an item that are sent to every executor at once (some 20 MB); more are dealt to several passes over the documents.
BROADCAST_PAIRS = 200_000
#: Odd multipliers' base of the rolling hash.
BASE = 0x9E3779B97F4A7C15
#: Word numbers that are hashed at once.
AT_ONCE = 1 << 20


def windows(items: DataFrame, words: int = WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct pairs of ``window`` (words joined by spaces) and ``item``. An item of fewer words is one window; one of none has none."""
    split = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(1)))
    return split.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, words), " "))).alias("window")).distinct()


@dataclass
class Lexicon:
    """A set of windows by the numbers of their words: for each length, sorted hashes to rule windows out, and the windows themselves to verify hits."""

    number: dict[bytes, int]
    hashes: dict[int, np.ndarray]
    entries: dict[bytes, list[int]]

    @classmethod
    def of(cls, window_list: list[tuple[str, list[int]]]) -> Lexicon:
        number: dict[bytes, int] = {}
        entries, by_length = {}, defaultdict(list)
        for window, owners in window_list:
            ids = np.array([number.setdefault(w, len(number) + 1) for w in window.encode().split(b" ")], np.int32)
            entries[ids.tobytes()] = owners
            by_length[len(ids)].append(ids)
        return cls(number, {n: np.unique(_hashes(np.concatenate(x), np.arange(0, n * len(x), n), n)) for n, x in by_length.items()}, entries)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Start, length and owners of every window of the set that occurs in ``ids``; number 0 is no word of the set."""
        for n, hashes in self.hashes.items():
            for begin in range(0, max(0, len(ids) - n + 1), AT_ONCE):
                part = ids[begin : begin + AT_ONCE + n - 1]
                strange = np.concatenate([[0], np.cumsum(part == 0, dtype=np.int64)])
                at = np.flatnonzero(strange[n:] == strange[:-n])
                if not len(at):
                    continue
                own = _hashes(part, at, n)
                place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                for i in at[hashes[place] == own]:
                    owners = self.entries.get(part[i : i + n].tobytes())
                    if owners is not None:
                        yield begin + int(i), n, owners


def _hashes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    own = np.zeros(len(at), np.uint64)
    for j in range(n):
        own = own * np.uint64(BASE) + ids[at + j].astype(np.uint64)
    return own


#: The set that this Python worker built last, by the number of its broadcast.
_BUILT: dict[str, Lexicon] = {}


def _scanner(pairs: DataFrame, id_col: str, text_col: str):
    """A function for ``mapInArrow`` over rows of id and text, holding one broadcast block of windows; and the type of its ``items``."""
    spark, kind = pairs.sparkSession, pairs.schema["item"].dataType
    arrow_kind = to_arrow_type(kind)
    by_window = defaultdict(list)
    items: dict = {}
    for window, item in pairs.select("window", "item").collect():  # at most about BROADCAST_PAIRS
        by_window[window].append(items.setdefault(item, len(items)))
    names = [*items]
    sent, mark = spark.sparkContext.broadcast((list(by_window.items()), names)), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window_list, named = sent.value
        if mark not in _BUILT:
            _BUILT.clear()
            _BUILT[mark] = Lexicon.of(window_list)
        lexicon = _BUILT[mark]
        for batch in batches:
            n_words, spans, found = [], [], []
            for text in batch[text_col].cast(pa.large_binary()):
                ids = word_numbers(text.as_buffer().to_pybytes() if text.is_valid else b"", lexicon.number)
                owners: set[int] = set()
                runs: list[list[int]] = []
                for start, n, own in sorted(lexicon.hits(ids), key=lambda x: x[:2]) if lexicon.entries and ids.any() else ():
                    owners.update(own)
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], start + n)
                    else:
                        runs.append([start, start + n])
                n_words.append(len(ids))
                spans.append([{"start": a, "end": b} for a, b in runs])
                found.append(sorted((named[o] for o in owners if named[o] is not None), key=str))
            columns = [batch[id_col], pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(found, pa.list_(arrow_kind))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "spans", "items"])

    return scan, kind.simpleString()


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: Column) -> Column:
    """Ranges that overlap or touch become one."""
    nothing = F.slice(spans, 1, 0)

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"])
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), nothing, add)


def contamination(docs: DataFrame, items: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", pairs_at_once: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: its id, ``n_words``, ``spans`` and ``items``.

    ``spans`` are maximal ranges of words that lie in an occurrence of an item's window,
    ``items`` the ids of the items with such windows, sorted as strings. The windows are a
    hash set that every executor gets, as far as they number ``pairs_at_once`` pairs of window and
    item; more are dealt to blocks by hash, each one a pass over the documents, and what
    texts are hit is merged by the text's digest. No row of a document leaves its task in
    the first case, only hit texts' ranges in the second.

    A null text has no words. Items with null or wordless texts have no windows; an item
    whose id is null hits words but isn't listed; items sharing an id are one. Repeated
    rows give equal rows each, and an empty table none. Other columns aren't read.
    """
    spark = docs.sparkSession
    pairs = windows(items, words, item_col)
    blocks = -(-pairs.count() // pairs_at_once)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if blocks <= 1:
        scan, kind = _scanner(pairs, "id", "text")
        with small_batches(spark):
            found = materialize(texts.mapInArrow(scan, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, spans array<struct<start:long,end:long>>, items array<{kind}>"), "hits")
        return found.withColumnRenamed("id", id_col)
    pairs = materialize(pairs.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks))), "windows")
    keyed = texts.withColumn("key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    parts = []
    for b in range(blocks):
        scan, kind = _scanner(pairs.where(F.col("block") == b).select("window", "item"), "key", "text")
        with small_batches(spark):
            hits = keyed.select("key", "text").mapInArrow(scan, f"key binary, n_words long, spans array<struct<start:long,end:long>>, items array<{kind}>").where(F.size("spans") > 0)
            parts.append(materialize(hits.drop("n_words").dropDuplicates(["key"]), f"hits-{b}"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    by_text = every.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    by_name = F.transform(F.array_sort(F.transform("items", lambda i: F.struct(i.cast("string").alias("name"), i.alias("item")))), lambda x: x["item"])
    by_text = by_text.select("key", _merged(F.col("spans")).alias("spans"), by_name.alias("items"))
    n_words = F.coalesce(F.regexp_count(F.translate("text", UPPER, UPPER.lower()), F.lit(PATTERN)), F.lit(0)).cast("long")
    joined = keyed.select("id", "key", n_words.alias("n_words")).join(by_text, "key", "left")
    none = {c: F.coalesce(c, F.array().cast(by_text.schema[c].dataType)) for c in ("spans", "items")}
    return joined.select(F.col("id").alias(id_col), "n_words", none["spans"].alias("spans"), none["items"].alias("items"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` of what ``contamination`` found."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    names = F.array_join(F.transform("items", lambda i: i.cast("string")), ",")
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the ranges of words, and what stands between the words of a range."""
    data = text.encode()
    kept, begin, at, number, runs = [], 0, 0, 0, iter(spans)
    run = next(runs, None)
    for part in stretches(data):
        for word in part:
            while FOLD[data[at]] == 32:
                at += 1
            if run and number == run[0]:
                kept.append(data[begin:at])
            at += len(word)
            number += 1
            if run and number == run[1]:
                begin, run = at, next(runs, None)
    return b"".join([*kept, data[begin:]]).decode()


def decontaminated(docs: DataFrame, items: DataFrame, drop: str = "spans", words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without hit words (``drop="spans"``) or without documents that hold any (``drop="documents"``).

    Ids must be unique and not null here, as hits are joined to rows by them. Null texts stay null; other columns pass.
    """
    if drop not in ("spans", "documents"):
        raise ValueError("drop must be 'spans' or 'documents'")
    hit = contamination(docs, items, words, id_col, text_col, item_col).where(F.size("spans") > 0).select(F.col(id_col), F.col("spans").alias("_dc_spans"))
    if drop == "documents":
        return docs.join(hit, id_col, "left_anti")

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_words(t, [(s["start"], s["end"]) for s in own]) for t, own in zip(text, spans)])

    both = docs.join(hit, id_col, "left")
    clean = both.where(F.col("_dc_spans").isNull()).select(docs.columns)
    mended = both.where(F.col("_dc_spans").isNotNull()).withColumn(text_col, cut(text_col, "_dc_spans")).select(docs.columns)
    return clean.unionByName(mended)
