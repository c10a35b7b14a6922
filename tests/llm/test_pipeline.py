"""Every stage's decisions take effect, on a small corpus with planted cases."""

import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import prose
from tidemark.llm.scratch import materialize


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        text = f"{prose(rng, 50)}\nPrinted from the shared page\n{prose(rng, 50)}" + (" you moron you loser" if toxic else "")
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        labels.append((i, 1, int(toxic)))
    near = rows[1][1].split(" ")
    near[7] = "changed"
    rows.append((500, " ".join(near), "en", "s0", 0))
    passage = prose(rng, 60)
    rows += [(600 + k, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", "en", "s1", 0) for k in range(3)]
    rows += [(700, None, "en", "s1", 0), (701, "", "en", None, 0), (702, "x" * 3000, None, "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, after = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs
    ids = {n: {r["doc_id"] for r in d.select("doc_id").distinct().collect()} for n, d in after.items()}
    toxic = {i for i in range(240) if i % 6 == 0}
    assert len(toxic & ids["toxicity"]) <= 2 and len(ids["toxicity"] - toxic) >= 200
    assert ids["line_dedup"] == ids["toxicity"] and after["line_dedup"].where(F.col("text").contains("Printed from")).count() == 0
    assert ids["shingle_join"] == ids["line_dedup"] - {500} and {700, 701} <= ids["shingle_join"]
    assert ids["suffix_array"] == ids["shingle_join"] and after["suffix_array"].where(F.col("text").contains(passage)).count() == 0
    assert after["suffix_array"].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert ids["packing"] == ids["suffix_array"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == after["packing"].count()


def test_one_row_of_each_class_stays(spark, tmp_path):
    rng = np.random.default_rng(10)
    texts = [prose(rng, 90) for _ in range(5)]

    def near(text):
        words = text.split(" ")
        words[7] = "changed"
        return " ".join(words)

    rows = [(i, prose(rng, 60), "en", "s", 0) for i in range(20)]
    rows += [(800, texts[0], "en", "s", 0), (800, texts[0], "en", "s", 0), (800, texts[0], "de", "s", 0)]  # repeated rows
    rows += [(801, texts[1], "en", "s", 0), (801, near(texts[1]), "en", "s", 0)]  # near copies under one id
    rows += [(802, texts[2], "en", "s", 0), (None, near(texts[2]), "en", "s", 0)]
    rows += [(None, texts[3], "en", "s", 0), (None, near(texts[3]), "en", "s", 0), (None, texts[3], "en", "s", 0)]
    rows += [(801, texts[4], "en", "s", 0)]  # another class under the same id
    rows += [(900, "", "en", "s", 0), (900, "", "en", "s", 0), (901, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = corpus_pipeline.shingle_join_stage(spark, docs, str(tmp_path))
    assert stage.columns == docs.columns
    got = [(r["doc_id"], r["text"], r["lang"]) for r in stage.collect()]
    assert got.count((800, texts[0], "de")) == 1 and sum(d == 800 for d, _, _ in got) == 1
    assert sum(t in (texts[1], near(texts[1])) for _, t, _ in got) == 1
    assert [d for d, t, _ in got if t in (texts[2], near(texts[2]))] == [802]
    assert sum(t in (texts[3], near(texts[3])) for _, t, _ in got) == 1 and (801, texts[4], "en") in got
    assert got.count((900, "", "en")) == 2 and (901, None, "en") in got and len(got) == 20 + 5 + 3
    after = corpus_pipeline.suffix_dedup_stage(spark, stage, str(tmp_path)).collect()
    assert [r["text"] for r in after if r["doc_id"] == 800] == [texts[0]]


def test_toxicity_stage_stores_no_second_copy_of_the_documents(spark, tmp_path, monkeypatch):
    """All rows but the rejected ones come back, repeated, null and empty ones too, while no text but the labelled sample's is written."""
    from tidemark.llm.scratch import Workspace

    rng, kept, keep = np.random.default_rng(14), {}, Workspace.keep

    def noted(self, df, name):
        kept[name] = df.columns
        return keep(self, df, name)

    monkeypatch.setattr(Workspace, "keep", noted)
    rows = [(i, prose(rng, 60) + (" you moron you loser" if i % 6 == 0 else ""), "en", "s", 0) for i in range(240)]
    rows += [rows[1], rows[1], (None, rows[2][1], "en", "s", 0), (700, None, "en", None, 0), (701, "", None, "s", 0)]
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))
    got = sorted(map(tuple, stage.collect()), key=str)
    plain = [r for r in rows if not (r[1] or "").endswith("loser")]
    assert stage.columns == docs.columns and [r for r in got if not (r[1] or "").endswith("loser")] == sorted(plain, key=str)
    assert len(got) <= len(plain) + 2 and {n for n, c in kept.items() if "text" in c} == {"labelled"}


def test_a_written_table_leaves_no_shuffle_files(spark):
    def shuffled() -> set[str]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(name)
    summed = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("n"))
    kept = materialize(summed, "summed")
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(name) == setting
    # what was written is still there, and the query itself can run again
    assert sorted(kept.collect()) == sorted(summed.collect())
