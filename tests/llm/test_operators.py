"""The operators against plain versions on small tables, and their edge cases."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, html_extract, image_copies, line_dedup, packing, pieces, sharding, shingle_join, suffix_dedup, toxicity
from tidemark.llm.scratch import Workspace

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(WORDS[i] + str(rng.integers(60)) + "." * int(k % 8 == 7) for k, i in enumerate(rng.integers(len(WORDS), size=n)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    base = [prose(rng, n) for n in (120, 200, 90, 300, 60, 150)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(14):  # near copies of the second text
        words = base[1].split()
        words[rng.integers(len(words))] = f"changed{k}"
        rows.append((100 + k, " ".join(words)))
    passage = prose(rng, 60)
    rows += [(200 + k, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for k in range(6)]
    rows += [(300, base[0]), (301, base[0]), (302, ""), (303, None), (304, "   \t"), (305, "One two"), (306, "one TWO"), (307, "é" * 150 + "é" * 150)]
    rows += [(308, "x" * 5000), (309, prose(rng, 4000))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_classes(rows, words, num):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(up))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_shingle_classes(spark, corpus, words, num):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.classes(frame(spark, corpus), words=words, threshold=(num, 100)).collect()}
    assert got == brute_classes(corpus, words, num)


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(1 << 50, size=200).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 180, replace=False), rng.integers(1 << 50, size=rng.integers(0, 40)).astype(np.uint64)])) for _ in range(150)]
    pairs = shingle_join.similar_pairs(np.array([len(x) for x in sets]), [shingle_join.bitmap(x) for x in sets], (80, 100), lambda i, j: i != j)
    found = {(int(min(x, y)), int(max(x, y))) for a, b in pairs for x, y in zip(a, b, strict=True)}
    for i in range(150):
        for j in range(i + 1, 150):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n * 100 >= 80 * (len(sets[i]) + len(sets[j]) - n):
                assert (i, j) in found


def test_shingle_classes_in_blocks(spark, corpus, monkeypatch):
    """Blocks of three sets, repeated rows, a null id, a very long text and columns of the names used inside."""
    monkeypatch.setattr(shingle_join, "BLOCK", 3)
    rng = np.random.default_rng(21)
    base, rows = prose(rng, 130).split(" "), [*corpus, (400, prose(rng, 40_000))]
    for k in range(40):  # a chain: neighbours are near copies, the ends are not
        base[(3 * k) % 120] = f"link{k}"
        rows.append((500 + k, " ".join(base)))
    twice = [*rows, rows[0], rows[0], (None, rows[1][1]), (None, "alone with no id")]
    docs = frame(spark, twice).withColumn("row", F.lit("x")).withColumn("node", F.lit(1)).withColumn("label", F.lit(2))
    got = shingle_join.classes(docs, words=5, threshold=(80, 100)).collect()
    assert len(got) == len(twice)
    want = brute_classes(rows, 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {want[1][1], None}
    assert len({want[500 + k][1] for k in range(40)}) == 1


def test_shingle_join_keeps_no_wide_table_beside_others(spark, corpus, monkeypatch):
    """Prefixes are never stored, bitmaps only while buckets use them; buckets in several passes give the same classes."""
    alive, beside, keep, drop = {}, {}, Workspace.keep, Workspace.drop

    def kept(work, df, name):
        beside[name] = {c for columns in alive.values() for c in columns}
        alive[work.name, name] = df.columns
        return keep(work, df, name)

    def dropped(work, *names):
        for name in names:
            alive.pop((work.name, name), None)
        return drop(work, *names)

    monkeypatch.setattr(Workspace, "keep", kept)
    monkeypatch.setattr(Workspace, "drop", dropped)
    monkeypatch.setattr(shingle_join, "PASS_LEAST", 1)
    monkeypatch.setattr(shingle_join, "PASS_COPIES", 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.classes(frame(spark, corpus), words=3, threshold=(90, 100)).collect()}
    assert got == brute_classes(corpus, 3, 90)
    assert {"nodes", "meeting", "placed"} <= beside.keys() and not any("prefix" in columns for columns in beside.values())
    passes = {name for name in beside if name.startswith("candidates-")}
    assert len(passes) > 1 and {name for name, columns in beside.items() if "bitmap" in columns} == passes


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(spark, corpus, hot):
    docs = frame(spark, corpus).withColumns({c: F.lit("clash") for c in ("n_spans", "row", "key", "at", "spans", "kinds")})
    got = {r["doc_id"]: r for r in suffix_dedup.drop_repeats(docs, hot=hot).collect()}
    assert {got[0][c] for c in ("row", "key", "at", "spans", "kinds")} == {"clash"}
    seen = Counter(b[s : s + 200] for _, t in corpus for b in [(t or "").encode()] for s in range(len(b) - 199))
    for i, t in corpus:
        b, keep = (t or "").encode(), np.ones(len((t or "").encode()), dtype=bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                keep[s : s + 200] = False
        rest = bytes(x for x, k in zip(b, keep, strict=True) if k)
        n_spans = int((np.diff(np.concatenate([[1], keep.astype(int)])) == -1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), len(b) - len(rest), n_spans, hashlib.sha256(rest).hexdigest()), i
    assert got[303]["text"] == ""


def test_repeats_in_very_long_texts(spark):
    """Texts beyond the windows handled at once, a repeat across that seam, and repeated rows under one id."""
    rng = np.random.default_rng(12)
    seam = (1 << suffix_dedup.CHUNK_BITS) - 150
    long = bytes(rng.integers(97, 123, size=seam + 5000, dtype=np.uint8)).decode()
    alone = bytes(rng.integers(97, 123, size=5000, dtype=np.uint8)).decode()
    got = suffix_dedup.drop_repeats(frame(spark, [(1, long), (2, alone[:1000] + long[seam - 300 : seam + 300] + alone[1000:2000]), (3, alone[3000:4000]), (3, alone[3000:4000])])).collect()
    by_id = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in got}
    assert len(got) == 4 and by_id == {1: (600, 1), 2: (600, 1), 3: (1000, 1)}
    with pytest.raises(ValueError, match="span"):
        suffix_dedup.repeated_spans(frame(spark, [(1, alone)]).withColumnRenamed("doc_id", "row"), span=300)


def test_multikey_quicksort_finds_equal_windows():
    rng = np.random.default_rng(3)
    left, key = rng.integers(4, 12, size=400), rng.integers(0, 3, size=400)
    windows = np.array([rng.integers(1, x + 2) for x in left])
    content = [bytes(rng.integers(97, 99, size=w + 11, dtype=np.uint8)) for w in windows]
    got = suffix_dedup.repeated_windows(key, left, windows, content, span=12)
    each = [(key[i], left[i] - k, content[i][k : k + 12]) for i in range(400) for k in range(windows[i])]
    times = Counter(each)
    assert got.tolist() == [times[x] > 1 for x in each] and 0 < got.sum() < len(got)


def test_line_boilerplate(spark):
    rows = [(i, f"own line {i}\n  Shared footer \n\nlast {i}", "a") for i in range(40)] + [(100 + i, "copy one\ncopy two", "a") for i in range(30)]
    rows += [(900, None, "a"), (901, "", "a"), (902, "Shared footer", None), (903, "Shared footer", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_dropped", F.lit("clash"))
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got[0]["text"] == "own line 0\n\nlast 0" and got[0]["n_dropped"] == 1 and got[0]["n_lines"] == 4
    assert got[100]["text"] == "copy one\ncopy two"  # copies of one page are one page
    assert got[900]["text"] is None and got[901]["text"] == "" and got[903]["n_dropped"] == 0 and got[902]["n_dropped"] == 0


def test_packing_is_whole_and_exact(spark, corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [*corpus, (400, "Don't STOP! ça va\x1cbien <|endoftext|> x2 naïve"), (401, "Σίσυφος ΟΔΟΣ 12.5%")]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(frame(spark, rows).coalesce(2), path, window=256).collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[i], key=lambda x: x["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = total = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda x: x["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
        total += at
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding < 0.1 * total


def test_cuts_are_optimal():
    rng = np.random.default_rng(0)
    pos = np.concatenate([[0], np.cumsum(rng.integers(1, 9, size=40))])
    fee = rng.integers(0, 5, size=41)
    cost, _ = packing.best_cuts(pos, fee, 12)
    best = [0.0]
    for j in range(1, 41):
        best.append(min(best[i] + 12 - (pos[j] - pos[i]) + fee[j] for i in range(j) if pos[j] - pos[i] <= 12))
    assert cost == pytest.approx(best)


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") != 7, F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    rows = sharding.shard_documents(docs, [1.0] * 8, [1.0] * 9).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(300 < len(s) < 450 for s in slots.values())
    seven = next(r for r in rows if r["doc_id"] == 7)
    assert (seven["size"], seven["text_crc32"]) == (1, 0)
    heavy = docs.select(sharding.rendezvous_shard(F.col("doc_id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert 0.7 < {r["s"]: r["count"] for r in heavy}[1] / 3000 < 0.8


def test_shards_recomputed_by_hand(spark):
    """Every score by the formula, in Python; null keys, repeated rows, changed weights, a clashing column."""
    import math

    import xxhash

    rows = [(i, "t" * (i % 7), "x") for i in range(400)] + [(5, "ttttt", "x"), (5, "other", "x"), (None, "a", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")

    def best(key, weights):
        units = [((xxhash.xxh64_intdigest(f"{'' if key is None else key}#{i}".encode(), 42) >> 12) + 0.5) / 2**52 for i in range(len(weights))]
        return max((-w / math.log(u), i) for i, (w, u) in enumerate(zip(weights, units, strict=True)))[1]

    for weights, grown in (([1.0] * 3, [1.0] * 4), ([1.0, 2.5, 0.5], [1.0, 2.5, 1.5])):
        got = sharding.shard_documents(docs, weights, grown).collect()
        assert len(got) == len(rows)
        assert all(r["shard"] == best(r["doc_id"], weights) and r["grown_shard"] == best(r["doc_id"], grown) for r in got)
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is None, i or 0, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
        for shard in range(3):
            assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_nearest_finds_the_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[0].tolist()) for i in range(20)]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, None] * 8), (9050, [1.0, 2.0]), (9051, [2.0, 1.0]), (9052, [2.0, 4.0]), (9100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    good = [r for r in rows if r[0] < 9000]
    ids, m = np.array([r[0] for r in good]), np.array([r[1] for r in good])
    unit, hits, total = m / np.linalg.norm(m, axis=1, keepdims=True), 0, 0
    for q in [i for i in ids if i % 50 == 0]:
        s = unit @ unit[list(ids).index(q)]
        best = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:5]
        hits += len(set(best) & {v for v, _ in got[q]})
        total += 5
        assert len(got[q]) == 5
    assert hits / total >= 0.9
    assert got[9050] == [(9052, pytest.approx(1.0)), (9051, pytest.approx(0.8))] and 9100 not in got
    assert [v for v, _ in got[0]] == [5000, 5001, 5002, 5003, 5004]


def test_probes_come_in_order():
    f = np.random.default_rng(0).random(5)
    order = ann.probe_order(f, 243)
    costs = [c for c, _ in order]
    assert costs == sorted(costs) and len({frozenset(x) for _, x in order}) == 243


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, table = sentencepiece.SentencePieceProcessor(model_file=path), pieces.piece_table(spark, path).cache()
    odd = ["", "  ", " a  b\n\nc ", "naïve ﬁ ① 日本語 \U0001f600 x", "word" * 30 + " " + "ab1" * 40, "\t tab", "Hello world, hello.", "é" * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, None, odd[6]])], "i int, text string")
    for r in pieces.decode(pieces.encode(df, table), table).collect():
        assert r["ids"] == (sp.encode(r["text"]) if r["text"] is not None else None) and r["decoded"] == r["text"]


def test_pieces_of_whole_documents(spark, tmp_path):
    import sentencepiece

    from tidemark.llm import queries

    path, rng = public_tokenizers.path("piece_bpe_32k.model"), np.random.default_rng(8)
    odd = ["", "  ", " a  b\n\nc ", "naïve ﬁ ① 日本語 \U0001f600 x", "word" * 30 + " " + "ab1" * 40, "\t tab\r\n", "Hello world, hello.", "é" * 60, prose(rng, 20_000), "x" * 5000, None]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate([*odd, odd[6], odd[6]])], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, 0, "Hi there"), (5, 1, None)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = queries.op8_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == list(range(len(odd) + 2)) and sum(r["conv_id"] == 5 for r in got) == 2
    for r in got:
        text = [*odd, odd[6], odd[6]][r["doc_id"]] if r["doc_id"] is not None else ["Hi there", None][r["turn"]]
        assert r["ids"] == (sp.encode(text) if text is not None else None) and r["decoded"] == text and r["same"]
    table = pieces.piece_table(spark, path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd[:8] + [None])], "i int, text string")
    fold = {r["i"]: (r["ids"], r["decoded"]) for r in pieces.decode(pieces.encode(df, table), table).collect()}
    assert {r["i"]: (r["ids"], r["decoded"]) for r in pieces.transcode(df, table).collect()} == fold


def test_viterbi_over_a_unigram_table(spark):
    table = spark.createDataFrame([("▁a", 1, -1.0, "2061"), ("b", 2, -1.0, "62"), ("▁ab", 3, -2.5, "206162"), ("a", 4, -3.0, "61"), ("▁", 5, -2.0, "20"), (None, 6, None, "00")], "piece string, id int, score double, bytes string")
    df = spark.createDataFrame([("ab",)], "text string")
    assert pieces.encode(df, table, kind="unigram").first()["ids"] == [1, 2]


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><!-- x --><article><h1>A &amp; B</h1><p>One <b>two</b>\n three.<div class='ad'>Buy now</div><p>Four&nbsp;five and then more words that follow it<script>var p='<p>';</script></article><div class=comments><p>First! nice post you wrote</p></div><footer>f</footer>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "plain < text"), (5, "<nav>menu"), (6, page[:40])], "page_id long, html string")
    weights = html_extract.learn_weights(df)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df, weights).collect()}
    assert got[1] == "A & B One two three. Four five and then more words that follow it" and got[2] == got[3] == "" and got[5] == ""
    assert html_extract.main_text("<body><p>some words here</p></body>", {}) == "some words here"


def test_html_against_a_plain_extractor(spark):
    """Pages made of known parts: what a reader would copy by hand is the article's blocks in order."""
    rng = np.random.default_rng(14)
    junk = ["<nav><ul><li><a href='/a'>{}</a></li></ul></nav>", "<div class='cookie-notice'>{}</div>", "<aside><p>{}</p></aside>", "<div id=comments><p>{}</p></div>", "<form>{}<input></form>", "<footer>{}</footer>", "<script>{}</script>", "<div class='ad'>{}</div>"]
    inner = ["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote class='share'>{}</blockquote>", "<pre>{}</pre>", "<p><b>{}</b></p>", "<p><math><mi>{}</mi></math></p>"]
    rows, want = [], {}
    for i in range(60):
        blocks = [prose(rng, rng.integers(5, 60)) for _ in range(rng.integers(4, 12))]
        parts = [inner[rng.integers(len(inner))].format(b) for b in blocks]
        if i % 3 == 0:
            parts.insert(2, junk[-1].format(prose(rng, 6)))
        article = "".join(parts)
        article = f"<article>{article}</article>" if i % 4 else f"<div class='content side'>{article}</div>"
        before, after = ("".join(junk[k].format(prose(rng, 8)) for k in rng.permutation(len(junk))[:3]) for _ in range(2))
        page = f"<html><head><title>t</title></head><body>{before}{article}{after}</body></html>"
        if i % 5 == 0:
            page = page.replace("<body>", "<body><form action='/'>").replace("</body>", "</form></body>")
            page = page.replace("<form><input></form>", "")
        rows.append((i, page, "kept"))
        want[i] = " ".join(b.strip() for b in blocks)
    rows += [(100, "<div>" * 50_000 + "deep words stay here", "kept"), (101, "<p>" + "word " * 200_000, "kept"), (102, rows[1][1], "kept"), (102, rows[1][1], "kept")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(df, html_extract.learn_weights(df)).collect()]
    texts = dict(got)
    assert len(got) == len(rows) and texts[100] == "deep words stay here" and len(texts[101].split()) == 200_000 and texts[102] == texts[1]
    assert np.mean([texts[i] == want[i] for i in want]) >= 0.95


def test_best_region_is_maximal():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x = rng.normal(size=12).tolist()
        s, e = html_extract.best_region(x)
        best = max([sum(x[i:j]) for i in range(12) for j in range(i, 13)])
        assert sum(x[s:e]) == pytest.approx(best)


def test_toxicity_sees_through_disguise(spark):
    rng = np.random.default_rng(5)
    clean = ["the river runs over old stones and under the bridge", "people walk along the road every morning", "a market opens on friday with bread and fruit"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = " ".join(rng.permutation(" ".join(clean).split())) + (" you are a moron and a loser" if toxic else " you are a friend")
        rows.append((i, text))
        labels.append((i, int(toxic)))
    rows += [(1000, "you are a m0r0n and a l.o.s.e.r"), (1001, "you are a m o r o n and a looooser"), (1002, None), (1003, ""), (1004, "bread and fruit on friday 2024")]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon, model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.with_scores(docs, lexicon, model, score_col="score").collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    assert got[1000] >= 0.5 and got[1001] >= 0.5 and got[1004] < 0.5 and got[1002] == got[1003] < 0.5
    again = frame(spark, [*rows[-5:-3], rows[-5], (1005, "bread and fruit on friday " * 20_000 + "you m0r0n")]).withColumn("toxicity", F.lit("clash")).withColumn("text2", F.col("text"))
    scored = toxicity.with_scores(again, lexicon, model).collect()
    assert [r["toxicity"] >= 0.5 for r in scored][:3] == [True] * 3 and len(scored) == 4 and scored[0]["toxicity"] == scored[2]["toxicity"] == got[1000] and scored[3]["text2"] == scored[3]["text"]


SPELLED = ["m  o  r  o  n", "m\to\tr\to\tn", "m\no\nr\no\nn", "m,o,r,o,n", "m/o/r/o/n", "m|o|r|o|n", "m\u200bo\u200br\u200bo\u200bn", "mo\u200bron", "m. o. r. o. n", "mo ro n", "m 0 r 0 n", "mooron", "morron", "m;o;r;o;n", "m:o:r:o:n"]


def test_toxicity_restores_every_joint():
    """Joints of any kind, pairs, a sign first and one doubled letter give the word back; plain text stays as it is."""
    table = toxicity.letter_table()
    said = "\n".join(["you are a moron and a loser", "the river runs over stones and the clown walks to the market", "bread and fruit and a letter"] * 60).lower()
    codes = table[np.minimum(np.frombuffer(("\n" + said + "\n").encode("utf-32-le"), dtype="<u4"), 0x180)].astype(int)
    n = np.bincount((codes[:-2] * toxicity.V + codes[1:-1]) * toxicity.V + codes[2:], minlength=toxicity.V**3).reshape(-1, toxicity.V) + 0.05
    reader = toxicity.Reader(model=np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))
    for x in SPELLED:
        assert "moron" in reader.words(f"and the river {x} runs over"), repr(x)
    assert "loser" in reader.words("such a l o $ e r today") and "river" in reader.words("$ r i v e r".replace("$", "the"))
    plain = "to be is he. It is in of, to the letter and a market"
    assert reader.words(plain) == set(re.findall("[a-z]+", plain.lower()))
    for long in ("a " * 200_000, "ab." * 200_000, "|" * 300_000, ". " * 200_000, "a" * 300_000):
        began = time.time()
        toxicity._SPELLED.findall(long)
        toxicity._DISGUISED.search(long)
        assert time.time() - began < 10


def test_decoding_is_the_best_of_all_readings(spark):
    """Every path of small lattices by hand: Viterbi's reading has the least cost."""
    import itertools

    text = "you moron you loser the river runs over old stones and people walk along the road "
    model = toxicity.log_model(toxicity.count_trigrams(spark.createDataFrame([(text * 20,)], "text string")))
    code = lambda x: toxicity.LETTERS.get(x, toxicity.OTHER if x.isalpha() else 0)

    def cost(path):
        a = b = 0
        total = 0.0
        for letters, fee in path:
            total += fee
            for x in letters:
                if code(x) or b:
                    total -= float(model[a * toxicity.V + b, code(x)])
                    a, b = b, code(x)
        return total - (float(model[a * toxicity.V + b, 0]) if b else 0.0)

    for chunk in ("m0r0n", "l.o.s.e.r", "l00000ser", "y0u", "m o r o n", "$tone$", "rooooad", "1!1", "r!ver.", "0ver+old"):
        paths = list(itertools.product(*toxicity.lattice(chunk)))
        best = min(map(cost, paths))
        readings = {"".join(x for x, _ in p).strip() for p in paths if cost(p) <= best + 1e-4}
        got = toxicity.decode(chunk, model)
        assert " ".join(got.split()) in {" ".join(x.split()) for x in readings}, chunk


def test_disguise_of_any_length_is_read(spark):
    text = "the river runs over old stones and you moron run along the road every morning "
    model = toxicity.log_model(toxicity.count_trigrams(spark.createDataFrame([(text * 50,)], "text string")))
    reader = toxicity.Reader(model=model)
    filler = "the river runs over old stones and " * 12
    late = (filler + "you moron").replace(" ", "")
    assert len(late) > 300
    assert "moron" in reader.words(" ".join(late))  # spelled apart
    assert "moron" in reader.words(".".join(late))
    assert "moron" in reader.words("mo" + "o" * 60 + "ron")
    assert "moron" in reader.words("mmoorroonn") and "moron" in reader.words("m" + "0" * 70 + "ron")
    began = time.process_time()
    reader.words("ab" * 50_000), reader.words("1" * 100_000), reader.words("a.b" * 30_000 + ".")
    assert time.process_time() - began < 30


def test_copied_pictures(spark):
    from tidemark.llm.queries import _render

    shown = _render(np.random.default_rng(6).normal(size=(6, 64)))
    pictures = [*shown, shown[0][9:, 14:], (np.rot90(shown[1]) * 0.85 + 12).astype(np.uint8), shown[2]]
    rows = [(i, {"width": p.shape[1], "height": p.shape[0], "pixels": bytearray(p.tobytes())}) for i, p in enumerate(pictures)]
    rows += [(50, None), (51, {"width": 3, "height": 3, "pixels": bytearray(b"x")}), (52, {"width": 40, "height": 40, "pixels": bytearray(1600)})]
    df = spark.createDataFrame(rows, "image_id long, media struct<width:int,height:int,pixels:binary>")
    got = {r["image_id"]: r["class_id"] for r in image_copies.copies(df).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0, 7: 1, 8: 2, 50: 50, 51: 51, 52: 52}


def test_edited_pictures_against_a_brute_force_matcher(spark):
    """Noisy, smaller, cropped and turned copies: what comparing all descriptors of two pictures finds, the hash tables find too; a crowd of copies, blank pictures and repeated ids."""
    import math

    from tidemark.llm.queries import _render

    rng = np.random.default_rng(7)
    base = _render(rng.normal(size=(14, 64)))
    edits = [
        lambda p: np.clip(p + rng.normal(0, 4, p.shape), 0, 255).astype(np.uint8),
        lambda p: np.rint(image_copies.resized(p.astype(float), 0.8)).astype(np.uint8),
        lambda p: p[9:, 14:],
        lambda p: (np.rot90(p) * 0.85 + 12).astype(np.uint8),
    ]
    pictures = {i: p for i, p in enumerate(base)} | {100 * (k + 1) + i: f(p) for k, f in enumerate(edits) for i, p in enumerate(base)}
    crowd = {1000 + k: np.clip(base[0] + rng.normal(0, 2, base[0].shape), 0, 255).astype(np.uint8) for k in range(3 * image_copies.ALL_PAIRS)}
    blank = {2000: np.zeros((90, 90), np.uint8), 2001: np.full((90, 90), 7, np.uint8), 2002: np.zeros((500, 700), np.uint8)}

    def media(p):
        return {"width": p.shape[1], "height": p.shape[0], "pixels": bytearray(p.tobytes())}

    rows = [(i, media(p), "x") for i, p in (pictures | crowd | blank).items()] + [(0, media(base[0]), "x"), (None, media(base[1]), "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "image_id long, media struct<width:int,height:int,pixels:binary>, label string")
    found = image_copies.copies(df).collect()
    got = {r["image_id"]: r["class_id"] for r in found if r["image_id"] is not None}
    assert len(found) == len(rows) and all(got[i] == i for i in (*range(14), *blank)) and {got[i] for i in crowd} == {0}
    assert sorted(str(r["class_id"]) for r in found if r["image_id"] is None) == ["1", "None"]

    def brute(p, q):
        (b, at), (b2, at2) = image_copies.describe(p), image_copies.describe(q)
        near = np.argwhere(np.bitwise_count(b.view("<u8")[:, None] ^ b2.view("<u8")[None]).sum(axis=2) <= image_copies.NEAR_BITS)
        votes = defaultdict(set)
        for i, j in near:
            turn, scale = (at2[j, 3] - at[i, 3]) % (2 * math.pi), at[i, 2] / at2[j, 2]
            dx = at2[j, 0] - scale * (math.cos(turn) * at[i, 0] - math.sin(turn) * at[i, 1])
            dy = at2[j, 1] - scale * (math.sin(turn) * at[i, 0] + math.cos(turn) * at[i, 1])
            for grid in (0, 0.5):
                votes[grid, math.floor(turn * 6 / math.pi + grid) % 12, math.floor(math.log(scale) / 0.5 + grid), math.floor(dx / 12 + grid), math.floor(dy / 12 + grid)].add(i)
        return max(map(len, votes.values()), default=0) >= image_copies.CONSENSUS

    want = [i for i in pictures if i >= 100 and brute(pictures[i % 100], pictures[i])]
    assert len(want) >= 50 and np.mean([got[i] == i % 100 for i in want]) >= 0.9
    assert all(got[i] in (i, i % 100) for i in pictures)


def test_large_buckets_lose_no_near_pair(spark):
    """Twelve pictures of classes of their own in one bucket, two of them near each other and far from the rest: stars miss the pair, comparing the bucket finds it."""
    rng = np.random.default_rng(9)
    codes = rng.integers(-(1 << 62), 1 << 62, (12, 4))
    codes[1] = codes[0] ^ 5
    crowds = spark.createDataFrame([(7, i, 0, 100 - (11 - i), i) for i in range(12)], "key long, image long, place int, weight int, label long")
    described = spark.createDataFrame([(i, [int(x) for x in codes[i]]) for i in range(12)], "image long, bits array<long>")
    stars = [(r["a"], r["b"]) for turn in range(image_copies.ROUNDS) for r in image_copies.star_pairs(crowds, turn).collect()]
    assert (0, 1) not in stars
    assert [tuple(r) for r in image_copies.crowd_pairs(crowds, described).collect()] == [(0, 1, 0, 0)]
    alike = crowds.withColumn("label", F.lit(3).cast("long"))
    assert image_copies.crowd_pairs(alike, described).count() == 0


def test_cells_of_pictures_against_all_pairs_that_share_a_key(monkeypatch):
    """Two matches are a link here, so that many links are scarce ones; tiles of a few pictures, which are halved, give the classes of a plain loop."""
    import math

    from tidemark.llm.queries import _render

    monkeypatch.setattr(image_copies, "CONSENSUS", 2)
    monkeypatch.setattr(image_copies, "TILE", 7)
    monkeypatch.setattr(image_copies, "PAIRS_AT_ONCE", 400)
    rng = np.random.default_rng(12)
    shown = _render(rng.normal(size=(40, 64)))
    pictures = [*shown, shown[3][9:, 14:], (np.rot90(shown[5]) * 0.85 + 12).astype(np.uint8)]
    described = [image_copies.describe(p) for p in pictures]
    ids, n, width = np.sort(rng.integers(-(1 << 62), 1 << 62, len(pictures))), len(pictures), 24
    places = [at.astype(np.float32) for _, at in described]
    cell = image_copies._Cell(ids, np.array([len(b) for b, _ in described]), np.concatenate([b.view("<i8") for b, _ in described]), np.concatenate(places), width)
    tiles = cell.tiles(0, n)
    for i, one in enumerate(tiles):
        for two in tiles[i:]:
            cell.meet(one, two)

    part = list(range(n))
    keys = [image_copies.table_keys(b, width) for b, _ in described]
    for i in range(n):
        for j in range(i + 1, n):
            apart = np.bitwise_count(described[i][0].view("<u8")[:, None] ^ described[j][0].view("<u8")[None]).sum(axis=2)
            votes = defaultdict(set)
            for u, v in np.argwhere((keys[i][:, None] == keys[j][None]).any(axis=2) & (apart <= image_copies.NEAR_BITS)):
                (x, y, a, t), (x2, y2, a2, t2) = places[i][u].tolist(), places[j][v].tolist()
                turn, scale = (t2 - t) % (2 * math.pi), a / a2
                dx, dy = x2 - scale * (math.cos(turn) * x - math.sin(turn) * y), y2 - scale * (math.sin(turn) * x + math.cos(turn) * y)
                for grid in (0, 1):
                    votes[grid, math.floor(turn / (2 * math.pi / 12) + grid / 2) % 12, math.floor(math.log(scale) / 0.5 + grid / 2), math.floor(dx / 12 + grid / 2), math.floor(dy / 12 + grid / 2)].add(u)
            if max(map(len, votes.values()), default=0) >= 2:
                low, high = sorted((part[i], part[j]))
                part = [low if x == high else x for x in part]
    assert cell.part.tolist() == part and len(cell.links) == n - len(set(part)) and 2 < len(set(part)) < n - 2


def test_smaller_copies_are_found_among_many_pictures(spark):
    """The share of copies that are found doesn't fall with the number of other pictures, and pictures that only have a few like corners stay apart."""
    from tidemark.llm.queries import _render

    shown = _render(np.random.default_rng(14).normal(size=(1500, 64)))
    edits = [lambda p: np.rint(image_copies.resized(p.astype(float), 0.8)).astype(np.uint8), lambda p: p[9:, 14:], lambda p: (np.rot90(p) * 0.85 + 12).astype(np.uint8)]
    pictures = [*shown, *(f(p) for f in edits for p in shown[:60])]
    df = spark.createDataFrame([(i, {"width": p.shape[1], "height": p.shape[0], "pixels": bytearray(p.tobytes())}) for i, p in enumerate(pictures)], "image_id long, media struct<width:int,height:int,pixels:binary>")
    got = {r["image_id"]: r["class_id"] for r in image_copies.copies(df.repartition(8)).collect()}
    assert all(got[i] == i for i in range(1500))
    for k in range(3):
        copies = range(1500 + 60 * k, 1560 + 60 * k)
        assert all(got[i] in (i, (i - 1500) % 60) for i in copies)
        assert np.mean([got[i] != i for i in copies]) >= 0.9


def test_blocks_of_pictures_meet_once_and_are_sent_in_rounds(spark, monkeypatch):
    """Many small blocks give the classes of few; a job takes so many copies of a block's descriptors at most."""
    from collections import Counter

    from tidemark.llm.queries import _render

    for blocks in (3, 4, 7, 10):
        rounds = image_copies.block_rounds(blocks)
        assert sorted(p for r in rounds for p in r) == [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]
        assert all(max(Counter(i for p in r for i in p).values()) == 1 for r in rounds)
    shown = _render(np.random.default_rng(15).normal(size=(30, 64)))
    pictures = [*shown, *(p[9:, 14:] for p in shown)]
    df = spark.createDataFrame([(i, {"width": p.shape[1], "height": p.shape[0], "pixels": bytearray(p.tobytes())}) for i, p in enumerate(pictures)], "image_id long, media struct<width:int,height:int,pixels:binary>")
    monkeypatch.setattr(image_copies, "BLOCK", 10)
    monkeypatch.setattr(image_copies, "ROUNDS_AT_ONCE", 2)
    got = {r["image_id"]: r["class_id"] for r in image_copies.copies(df).collect()}
    assert got == {i: i % 30 for i in range(60)}


def test_unlike_pictures_are_hardly_ever_candidates(monkeypatch):
    """What is looked at in a cell stays far below the number of picture pairs, which all have near descriptors."""
    from tidemark.llm.queries import _render

    rng = np.random.default_rng(16)
    shown = _render(rng.normal(size=(400, 64)))
    described = [image_copies.describe(p) for p in shown]
    many, bits = np.array([len(b) for b, _ in described]), np.concatenate([b for b, _ in described])
    places, small = np.concatenate([at for _, at in described]).astype(np.float32), np.concatenate([image_copies.small_version(p).ravel() for p in shown])
    cell = image_copies._PairCell(np.arange(400), many, np.ascontiguousarray(bits).view("<i8"), places, small, np.full((400, 2), 96, np.float32), np.arange(400) // 200, (True, True))
    looked, look = [], cell._try
    monkeypatch.setattr(cell, "_try", lambda first, second, x, y: (looked.append(len(x)), look(first, second, x, y)))
    cell.search()
    assert not cell.links and 0 < sum(looked) < 0.05 * 400 * 399 / 2


def test_matches_of_pictures_are_not_written(spark, monkeypatch):
    """Matches grow with the square of the pictures: no table of an intermediate step has more rows than there are pictures."""
    from tidemark.llm.queries import _render
    from tidemark.llm.scratch import Workspace

    sizes, keep = {}, Workspace.keep

    def counted(self, df, name):
        kept = keep(self, df, name)
        sizes[name] = max(sizes.get(name, 0), kept.count())
        return kept

    monkeypatch.setattr(Workspace, "keep", counted)
    shown = _render(np.random.default_rng(13).normal(size=(24, 64)))
    pictures = [*shown, *(p[9:, 14:] for p in shown)]
    df = spark.createDataFrame([(i, {"width": p.shape[1], "height": p.shape[0], "pixels": bytearray(p.tobytes())}) for i, p in enumerate(pictures)], "image_id long, media struct<width:int,height:int,pixels:binary>")
    got = {r["image_id"]: r["class_id"] for r in image_copies.copies(df).collect()}
    assert got == {i: i % 24 for i in range(48)}
    assert max(sizes.values()) <= len(pictures), sizes


def test_every_embedding_has_its_picture(spark, tmp_path):
    from tidemark.llm import queries

    rows = [(2, [1.0] * 64), (3, [2.0] * 64), (7, [float(i) for i in range(64)]), (8, None), (9, [1.0] * 5), (12, [float("nan")] * 64), (13, [float(i % 5) for i in range(64)]), (13, [3.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in queries.media_of_embeddings(spark, str(tmp_path)).collect():
        got.setdefault(r["image_id"], []).append(r["media"])
    assert sorted(got) == [2, 3, 7, 8, 9, 12, 13] and len(got[13]) == 2
    assert got[8] == got[9] == got[12] == [None] and got[3][0]["height"] == 87 and got[7][0]["height"] == got[13][0]["height"] == 96


def test_empty_tables(spark):
    docs = frame(spark, []).withColumn("source", F.lit("s"))
    path = public_tokenizers.path("word_bpe_49k.json")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert shingle_join.classes(docs).count() == 0
    assert suffix_dedup.drop_repeats(docs).count() == 0
    assert line_dedup.drop_boilerplate(docs).count() == 0
    assert packing.pack_documents(docs, path).count() == 0
    assert sharding.shard_documents(docs, [1.0], [1.0, 1.0]).count() == 0
    assert toxicity.with_scores(docs, *toxicity.train(docs, marks)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, vectors).count() == 0
    pictures = spark.createDataFrame([], "image_id long, media struct<width:int,height:int,pixels:binary>")
    assert image_copies.copies(pictures).count() == 0
    pages = spark.createDataFrame([], "page_id long, html string")
    assert html_extract.extract(pages, html_extract.learn_weights(pages)).count() == 0
