"""Ranked search, decontamination and the filter audit against plain versions, and their edge cases."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ascii_words, decontaminate, filter_audit, queries, ranked_search

VOCABULARY = [f"{a}{b}" for a in "ba ko ÉL mü 7 lo Zi".split() for b in "r st nd q x".split()]


def terms(text):
    up = str.maketrans(ascii_words.UPPER, ascii_words.UPPER.lower())
    return re.findall(ascii_words.PATTERN, (text or "").translate(up))


def prose(rng, n):
    return "".join(VOCABULARY[min(int(rng.exponential(6)), len(VOCABULARY) - 1)] + " .\n-\t"[int(rng.integers(5))] * int(1 + rng.integers(2)) for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(5)
    items = [(k, prose(rng, int(n))) for k, n in enumerate(rng.integers(1, 40, size=25))]
    items += [(30, None), (31, ""), (32, " . "), (33, items[3][1]), (34, "bar"), (3, "another text of item three"), (None, prose(rng, 14)), (35, "never seen anywhere at all by any of those documents here")]
    docs = [(k, prose(rng, int(n)), "en", "s") for k, n in enumerate(rng.integers(0, 120, size=150))]
    for k, (item, text) in enumerate(items):
        docs.append((200 + k, f"{prose(rng, 12)} {text} {prose(rng, 12)}", "de" if k % 2 else None, "s"))
    docs += [(300, None, None, "s"), (301, "", "", "s"), (302, docs[4][1], "fr", "s"), (4, docs[4][1], "en", "s"), (None, docs[4][1], "en", "s"), (None, prose(rng, 50), None, "s")]
    docs += [(400, prose(rng, 900), "en", "s"), (401, "x" * 3_000_000 + " " + items[5][1], "en", "s"), (402, "A#B " * 300, "en", "s")]
    labels = [(int(d[0]), int(rng.integers(2)), int(rng.integers(2))) for d in docs if d[0] is not None and d[0] % 3] + [(1, None, None), (1, 1, 0), (None, 1, 1)]
    return docs, items, labels


@pytest.fixture(scope="module")
def frames(spark, tables):
    docs, items, labels = tables
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumns({"id": F.lit("?"), "n": F.lit(1), "key": F.lit(None), "items": F.lit(2), "rank": F.lit(3)}).repartition(5),
        spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash")),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def brute_ranks(docs, items, top=10):
    own = [(i, Counter(terms(t))) for i, t, *_ in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    count, total = len(own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, query in asked.items():
        scored = []
        for i, c, n in own:
            m = 100 - 90 + (90 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in query & c.keys())
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [ranked_search.BROADCAST_PAIRS, 60])
def test_ranks_equal_scoring_every_document(frames, tables, at_once):
    got = sorted((tuple(r) for r in ranked_search.search(frames[0], frames[1], pairs_at_once=at_once).collect()), key=str)
    assert got == brute_ranks(tables[0], tables[1])


def test_masks_spare_most_documents():
    rng = np.random.default_rng(0)
    n, terms_of = 20_000, list(range(1, 13))
    found = ranked_search.BestDocuments([terms_of], 10)
    everything = np.zeros(n, np.int64)
    for begin in range(0, n, 4000):
        held = [(np.flatnonzero(rng.random(4000) < 0.6 / t), t) for t in terms_of]
        rows = np.concatenate([r for r, _ in held])
        of = np.concatenate([np.full(len(r), t) for r, t in held])
        parts = of * 1000 + rng.integers(0, 900, len(rows))
        np.add.at(everything, rows + begin, parts)
        found.visit(np.arange(begin, begin + 4000), np.zeros(4000, bool), rows, of, parts)
    order = np.lexsort((np.arange(n), -everything))[:10]
    assert found.best[0][1].tolist() == order.tolist() and found.best[0][0].tolist() == everything[order].tolist()
    assert found.evaluated < found.matched / 20


def test_queries_of_more_terms_than_a_machine_word(spark):
    words = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(words[i : i + 3 * i + 1])) for i in range(60)]
    items = [(1, " ".join(words)), (2, " ".join(words[:70]))]
    got = sorted((tuple(r) for r in ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == brute_ranks(docs, items)


def brute_hits(text, items, words=10):
    own = terms(text)
    hit, owners = set(), set()
    for item, other in items:
        other = terms(other)
        size = min(words, len(other))
        windows = {tuple(other[k : k + size]) for k in range(len(other) - size + 1)} if size else set()
        for k in range(len(own) - size + 1):
            if tuple(own[k : k + size]) in windows:
                hit.update(range(k, k + size))
                owners.add(item)
    names = sorted(str(o) for o in owners if o is not None)
    return len(own), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("at_once", [decontaminate.BROADCAST_PAIRS, 90])
def test_hits_equal_comparing_every_window(frames, tables, at_once):
    got = decontaminate.report(decontaminate.contamination(frames[0], frames[1], pairs_at_once=at_once)).collect()
    want = [(d[0], *brute_hits(d[1], tables[1])) for d in tables[0]]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[5] for w in want) > 20


def test_spans_and_documents_are_removed(spark):
    item = "One two, three four; five six seven eight nine ten eleven"
    rows = [(1, f"Before this. {item.upper()}! After"), (2, "clean text"), (3, None), (4, ""), (5, item), (6, f"é {item} x {item}é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("own"))
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    left = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(docs, items).collect()}
    assert left == {1: "Before this. ! After", 2: "clean text", 3: None, 4: "", 5: "", 6: "é  x  elevené"[:-8] + " elevené"}
    kept = decontaminate.decontaminated(docs, items, "documents")
    assert {r["doc_id"] for r in kept.collect()} == {2, 3, 4} and kept.columns == docs.columns


def test_long_texts_are_split_in_stretches(monkeypatch):
    rng = np.random.default_rng(1)
    text = prose(rng, 400) + " " + "y" * 300
    whole = [w for part in ascii_words.stretches(text.encode()) for w in part]
    for size in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(ascii_words, "STRETCH", size)
        assert [w for part in ascii_words.stretches(text.encode()) for w in part] == whole == [t.encode() for t in terms(text)]


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, rows = {}, []
    for i, text, lang, _ in docs:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        copies = [j for j, t, *_ in docs if (t or "") == text and j is not None]
        rows.append((lang or "", i, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and any(j < i for j in copies)}))
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            before = []
            for step, f in enumerate(order, 1):
                out_now = [r for r in left if r[2][f]]
                shapley[f] += len(out_now)
                left = [r for r in left if not r[2][f]]
                alone = [r for r in rows if r[0] == part and r[2][f] and sum(r[2].values()) == 1]
                out[part, "".join(order), step] = (len(left), len(out_now), sum(r[2][f] for r in before), len(alone), sum(r[1] in good for r in out_now), sum(r[1] in toxic for r in out_now))
                before += out_now
        for (p, order, step), x in out.items():
            if p == part:
                out[p, order, step] = (*x[:6], shapley[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_audit_equals_applying_every_order(frames, tables):
    got = filter_audit.audit_documents(frames[0], frames[2])
    assert sorted(map(tuple, got.collect())) == brute_audit(tables[0], tables[2])
    assert got.columns == ["part", "filter_order", "step", *filter_audit.OUTCOMES, "shapley"]


def test_packed_sums_do_not_run_over():
    total = (2**62 - 1) * filter_audit.packed(0b00101, True, False, 5) + 2**62 * filter_audit.packed(0b00101, True, True, 5)
    fields = filter_audit.unpacked(total, 5)
    assert fields.shape == (120, 5, 6) and fields.max() == 2**63 - 1
    first = dict(zip(filter_audit.OUTCOMES, fields[0, 0].tolist()))  # order ABCDE, step A
    assert first == {"kept": 0, "removed": 2**63 - 1, "redundant": 0, "unique_fails": 0, "good_lost": 2**63 - 1, "toxic_lost": 2**62}


def test_equal_to_sql(spark, tables, tmp_path):
    docs, items, labels = tables
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    db = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op11_ranked_search", "op12_decontamination", "op13_filter_audit"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = db.sql(queries.ORACLE_SQL[name])
        assert got.columns == want.columns, name
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str), name


def test_empty_tables(spark, frames):
    docs, items, labels = (f.where("1 = 0") for f in frames)
    assert ranked_search.search(docs, frames[1]).count() == ranked_search.search(frames[0], items).count() == ranked_search.search(docs, items).count() == 0
    assert decontaminate.contamination(docs, frames[1]).count() == 0
    assert decontaminate.report(decontaminate.contamination(frames[0], items)).where("contaminated").count() == 0
    assert filter_audit.audit_documents(docs, labels).count() == 0
    assert filter_audit.audit_documents(frames[0], labels).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
