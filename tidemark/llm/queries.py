"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, decontaminate, filter_audit, html_extract, image_copies, line_dedup, packing, pieces, ranked_search, sharding, shingle_join, suffix_dedup, toxicity
from tidemark.llm.scratch import table

SHARDS = 8
#: Vectors that one task draws as pictures: rows are small, but what is made of them takes time and room.
DRAWN_AT_ONCE = 500


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; rows whose crc32(doc_id) is a multiple of 5 are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon, model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.with_scores(docs, lexicon, model, score_col="score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 3-word shingle sets reach a similarity of 0.9."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shingle_join.classes(docs, words=3, threshold=(90, 100)).select("doc_id", "n_shingles", "component_id")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document when all 200-byte strings that recur are gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.drop_repeats(docs, keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _render(vectors: np.ndarray, side: int = 96) -> np.ndarray:
    """Grey pictures whose 8 x 8 waves have the vectors' components as amplitudes."""
    at = (np.arange(side) + 0.5) / side
    waves = np.array([np.cos(np.pi * (2 * k + 1) * at + k) for k in range(8)])
    grey = np.einsum("nij,ih,jw->nhw", vectors.reshape(-1, 8, 8), waves, waves, optimize=True)
    low, high = grey.min(axis=(1, 2), keepdims=True), grey.max(axis=(1, 2), keepdims=True)
    return np.rint((grey - low) / np.maximum(high - low, 1e-9) * 255).astype(np.uint8)


def media_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for every embedding. Ids ending in 3 and 7 show the picture of the id before: one cropped, one turned and darkened.

    Without such an id before, or where its vector hasn't 64 finite components, an id shows its own; without such a vector of its own, none.
    """
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors = vectors.withColumn("embedding", F.when(fine, F.col("embedding")))
    edited = F.when((F.col("image_id") % 10).isin(3, 7), F.col("image_id") - 1)
    source = vectors.where((F.col("image_id") % 10).isin(2, 6)).groupBy(F.col("image_id").alias("shown")).agg(F.max("embedding").alias("drawn"))
    rows = vectors.withColumn("shown", edited).join(source, "shown", "left").select("image_id", F.col("drawn").isNotNull().alias("edited"), F.coalesce("drawn", "embedding").alias("drawn"))
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-vectors.count() // DRAWN_AT_ONCE)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, image_copies.AT_ONCE):
                part = batch.slice(begin, image_copies.AT_ONCE)
                there = np.flatnonzero(part["drawn"].is_valid().to_numpy(zero_copy_only=False))
                greys = iter(_render(part["drawn"].flatten().to_numpy().reshape(-1, 64)) if len(there) else ())
                media: list[dict | None] = [None] * part.num_rows
                for i in there:
                    grey = next(greys)
                    if part["edited"][i].as_py():
                        grey = grey[9:, 14:] if part["image_id"][i].as_py() % 10 == 3 else (np.rot90(grey) * 0.85 + 12).astype(np.uint8)
                    media[i] = {"width": grey.shape[1], "height": grey.shape[0], "pixels": grey.tobytes()}
                yield pa.RecordBatch.from_arrays([part["image_id"], pa.array(media, kind)], names=["image_id", "media"])

    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])
    return rows.mapInArrow(draw, "image_id long, media struct<width:int,height:int,pixels:binary>")


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of copied pictures among those drawn from all embeddings."""
    return image_copies.copies(media_of_embeddings(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on shards 0 to 7 by rendezvous hashing of doc_id, and where they go with nine."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and of every conversation turn, and the text they decode to. A turn has no doc_id, a document no conv_id."""
    pieces_of = pieces.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    back = pieces.transcode(docs.unionByName(turns, allowMissingColumns=True), pieces_of)
    return back.select("doc_id", "conv_id", "turn", F.size("ids").alias("n_ids"), "ids", "decoded", F.col("decoded").eqNullSafe(F.col("text")).alias("same"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.learn_weights(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its source's boilerplate lines."""
    kept = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.md5(text).alias("kept_md5"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a 10-word window of a benchmark item."""
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents of each language, in all orders."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_shingle_join": op2_shingle_join,
    "op3_suffix_array": op3_suffix_array,
    "op4_image_copies": op4_image_copies,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_decontamination": op12_decontamination,
    "op13_filter_audit": op13_filter_audit,
}

#: Words of ``text`` in DuckDB: only A-Z are lower-cased.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op10_line_dedup": f"""
        WITH pages AS (
            SELECT doc_id, coalesce(source, '') AS host, text, coalesce(string_split(text, chr(10)), []) AS lines FROM documents
        ), totals AS (
            SELECT host, count(DISTINCT text) AS total FROM pages WHERE text IS NOT NULL GROUP BY host
        ), seen AS (
            SELECT DISTINCT host, text, trim(unnest(lines), ' ' || chr(9) || chr(13)) AS line FROM pages
        ), common AS (
            SELECT host, line FROM (SELECT host, line, count(*) AS n FROM seen WHERE line <> '' GROUP BY host, line)
            JOIN totals USING (host) WHERE n >= {line_dedup.MIN_PAGES} AND n > total * CAST({line_dedup.MAX_RATIO} AS DOUBLE)
        ), by_host AS (
            SELECT host, list(line) AS common FROM common GROUP BY host
        ), kept AS (
            SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), trim(x, ' ' || chr(9) || chr(13)))) AS rest
            FROM pages LEFT JOIN by_host USING (host)
        )
        SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(rest) AS BIGINT) AS n_dropped,
               CAST(length(array_to_string(rest, chr(10))) AS BIGINT) AS kept_chars, md5(array_to_string(rest, chr(10))) AS kept_md5
        FROM kept
    """,
    "op11_ranked_search": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0
        ), size AS (
            SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs
        ), query AS (
            SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark
        ), posted AS (
            SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM query) GROUP BY r, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM posted, size GROUP BY term, docs
        ), parts AS (
            SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * size.docs) // size.terms))) AS part
            FROM posted JOIN docs USING (r) JOIN weights USING (term) CROSS JOIN size
        ), scored AS (
            SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM query JOIN parts USING (term) GROUP BY item_id, r, doc_id
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
        ) WHERE rank <= {ranked_search.TOP}
    """,
    "op12_decontamination": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
        ), items AS (
            SELECT item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
        ), windows AS (
            SELECT DISTINCT item_id, len(w) AS long, array_to_string(w, ' ') AS win FROM items WHERE len(w) < {decontaminate.WORDS}
            UNION
            SELECT item_id, {decontaminate.WORDS}, array_to_string(w[i:i + {decontaminate.WORDS - 1}], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - {decontaminate.WORDS - 2})) AS i FROM items WHERE len(w) >= {decontaminate.WORDS})
        ), lengths AS (
            SELECT DISTINCT long FROM windows
        ), placed AS (
            SELECT r, long, i, array_to_string(w[i:i + long - 1], ' ') AS win FROM (SELECT r, w, long, unnest(range(1, CAST(len(w) - long + 2 AS BIGINT))) AS i FROM docs, lengths WHERE len(w) >= long)
        ), hits AS (
            SELECT r, i, long, item_id FROM placed JOIN windows USING (long, win)
        ), words AS (
            SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + long)) AS k FROM hits) GROUP BY r
        ), owners AS (
            SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words USING (r) LEFT JOIN owners USING (r)
    """,
    "op13_filter_audit": r"""
        WITH marks AS (
            SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), least AS (
            SELECT coalesce(text, '') AS text, min(doc_id) AS least FROM documents GROUP BY 1
        ), texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents
        ), failing AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
                    regexp_matches(text, '[#$%&*|]'), coalesce(least < doc_id, false)] AS fails
            FROM texts JOIN least USING (text) LEFT JOIN marks USING (doc_id)
        ), kinds AS (
            SELECT part, good, toxic, fails, count(*) AS n FROM failing GROUP BY ALL
        ), letters AS (
            SELECT unnest(range(1, 6)) AS f
        ), orders AS (
            SELECT [a.f, b.f, c.f, d.f, e.f] AS ord FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), steps AS (
            SELECT ord, step, ord[step] AS f, array_to_string(list_transform(ord, lambda x: chr(CAST(64 + x AS INTEGER))), '') AS filter_order FROM orders, (SELECT unnest(range(1, 6)) AS step)
        ), counted AS (
            SELECT part, filter_order, step, f,
                   sum(n) FILTER (NOT gone AND NOT own) AS kept, sum(n) FILTER (NOT gone AND own) AS removed, sum(n) FILTER (gone AND own) AS redundant,
                   sum(n) FILTER (own AND alone) AS unique_fails, sum(n) FILTER (NOT gone AND own AND good) AS good_lost, sum(n) FILTER (NOT gone AND own AND toxic) AS toxic_lost
            FROM (
                SELECT part, filter_order, step, f, good, toxic, n, fails[f] AS own, len(list_filter(fails, lambda x: x)) = 1 AS alone,
                       len(list_filter(ord[1:step - 1], lambda x: fails[x])) > 0 AS gone
                FROM kinds, steps
            ) GROUP BY part, filter_order, step, f
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM counted
    """,
}
