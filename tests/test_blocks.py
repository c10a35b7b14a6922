"""Block parsing on hand-built bytes, cut files, and byte functions."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as fc
from tidemark.sources import blocks


def transaction(witness=False, script=b"\xaa", inputs=1):
    one = b"\x11" * 32 + struct.pack("<I", 3) + b"\x01\x99" + b"\xff" * 4
    count = bytes([inputs]) if inputs < 253 else b"\xfd" + struct.pack("<H", inputs)
    size = bytes([len(script)]) if len(script) < 253 else b"\xfe" + struct.pack("<I", len(script))
    body = count + one * inputs + b"\x02" + struct.pack("<q", 5000) + size + script + struct.pack("<q", 7) + b"\x00"
    plain = struct.pack("<i", 1) + body + struct.pack("<I", 9)
    raw = struct.pack("<i", 1) + b"\x00\x01" + body + b"\x02\x02\xbb\xcc\x00" * inputs + struct.pack("<I", 9) if witness else plain
    return raw, plain


def header(time=1_600_000_000):
    return struct.pack("<i", 2) + bytes(range(32)) + bytes(255 - i for i in range(32)) + struct.pack("<I", time) + b"\x1d\x00\xff\xee" + b"\x11\x22\x33\x44"


def block(*txs, time=1_600_000_000, size=None):
    count = bytes([len(txs)]) if len(txs) < 253 else b"\xfd" + struct.pack("<H", len(txs))
    body = header(time) + count + b"".join(txs)
    return blocks.MAGIC + struct.pack("<I", len(body) if size is None else size) + body


def rows_of(data, table, **kw):
    return [r for part in blocks.parse_range(lambda at, n: data[at : at + n], len(data), "f", table, **kw) for r in part.to_pylist()]


def test_every_field_of_a_block():
    (raw, plain), (wraw, wplain) = transaction(), transaction(True)
    data = block(raw, wraw)
    (head,) = rows_of(data, "headers")
    assert head == {"file": "f", "block_hash": blocks.display_hash(header()), "block_size": len(data) - 8, "version": 2, "prev_hash": bytes(range(32)), "merkle_root": bytes(255 - i for i in range(32)), "time": 1_600_000_000, "bits": b"\x1d\x00\xff\xee", "nonce": b"\x11\x22\x33\x44", "n_txs": 2}
    txs = rows_of(data, "transactions")
    assert [t["tx_hash"] for t in txs] == [blocks.display_hash(plain), blocks.display_hash(wplain)] and txs[0]["tx_hash"] == txs[1]["tx_hash"]
    assert [(t["tx_index"], t["version"], t["segwit"], t["n_inputs"], t["n_outputs"], t["lock_time"]) for t in txs] == [(0, 1, False, 1, 2, 9), (1, 1, True, 1, 2, 9)]
    assert [(r["out_index"], r["amount"], r["pub_key"]) for r in rows_of(data, "outputs")] == [(0, 5000, b"\xaa"), (1, 7, b"")] * 2
    assert [(r["in_index"], r["prev_tx"], r["vout"], r["script_sig"], r["sequence"]) for r in rows_of(data, "inputs")] == [(0, b"\x11" * 32, 3, b"\x99", 2**32 - 1)] * 2
    assert [(r["tx_hash"], r["in_index"], r["item_index"], r["item"]) for r in rows_of(data, "witnesses")] == [(txs[1]["tx_hash"], 0, 0, b"\xbb\xcc"), (txs[1]["tx_hash"], 0, 1, b"")]


def test_known_double_hash():
    assert blocks.display_hash(b"abc").hex() == "58636c3ec08c12d55aedda056d602d5bcca72d8df6a69b519b72d32dc2428b4f"
    assert blocks.display_hash(b"a", b"bc") == blocks.display_hash(b"abc") == hashlib.sha256(hashlib.sha256(b"abc").digest()).digest()[::-1]


def test_a_wrong_size_field_is_not_believed():
    """Published case: the size field says 61, the block takes 143 bytes."""
    tx = b"\x01\x00\x00\x00\x01" + bytes(0x10 + i for i in range(32)) + bytes(4) + b"\x01\x42" + b"\xff" * 4 + b"\x01" + bytes(range(1, 9)) + b"\x01\x51" + bytes(4)
    data = block(tx, size=0x3D)
    assert [(r["tx_hash"], r["amount"], r["pub_key"]) for r in rows_of(data * 2, "outputs")] == [(blocks.display_hash(tx), 0x0807060504030201, b"\x51")] * 2


def test_amounts_beyond_the_signed_range_keep_their_bytes():
    raw = b"\x01\x00\x00\x00\x01" + bytes(range(32)) + b"\x02\x00\x00\x00\x01\xaa" + b"\xff" * 4 + b"\x01" + bytes.fromhex("1032547698BADCFE") + b"\x02\x51\xac" + bytes(4)
    (row,) = rows_of(block(raw), "outputs")
    assert row["amount"].to_bytes(8, "little", signed=True) == bytes.fromhex("1032547698BADCFE") and row["pub_key"] == b"\x51\xac"


def test_counts_and_sizes_of_several_bytes():
    (raw, plain), many = transaction(script=b"s" * 70_000, inputs=300), [transaction()[0]] * 400
    data = block(raw, *many)
    assert len(rows_of(data, "inputs")) == 700 and rows_of(data, "headers")[0]["n_txs"] == 401
    first = rows_of(data, "outputs")[0]
    assert first["pub_key"] == b"s" * 70_000 and first["tx_hash"] == blocks.display_hash(plain)


def test_bad_data_fails():
    data = block(transaction()[0])
    for bad, said in ((b"\x00" + data[1:], "magic"), (data + bytes(10), "magic"), (data[:-3], "truncated"), (data[:60], "truncated"), (data + data[:2], "magic")):
        with pytest.raises(ValueError, match=said):
            rows_of(bad, "outputs")
    tricked = block(transaction(script=blocks.MAGIC + bytes(40))[0])
    inside = tricked.index(blocks.MAGIC, 10) - 8
    with pytest.raises(ValueError, match="truncated"):
        rows_of(tricked[:4] + struct.pack("<I", inside) + tricked[8:], "outputs")
    with pytest.raises(ValueError, match="ends after"):  # a size that leads over the next block
        rows_of(block(transaction()[0], size=2 * len(data) - 8) + data * 2, "outputs")
    assert rows_of(b"", "outputs") == []


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files of blocks whose scripts hold whole blocks, one of them with wrong sizes."""
    path = tmp_path_factory.mktemp("blocks")
    hidden = block(transaction()[0], time=5)
    several = [block(*[transaction(k % 2, bytes([k, j]) + hidden * (j % 3))[0] for j in range(k % 7)], time=1000 + k) for k in range(40)]
    (path / "blk00001.dat").write_bytes(b"".join(several))
    (path / "more").mkdir()
    (path / "more" / "blk00002.dat").write_bytes(b"".join(several[k][:4] + struct.pack("<I", 17) + several[k][8:] for k in range(3, 9)))
    (path / "blk00003.dat").write_bytes(b"")
    (path / "other.dat").write_bytes(b"no blocks")
    return str(path)


@pytest.mark.parametrize("table", blocks.SCHEMAS)
def test_cut_files_give_the_rows_of_whole_ones(spark, folder, table):
    spark.dataSource.register(blocks.BlockSource)
    whole = sorted(map(str, blocks.read_blocks(spark, folder, table=table, whole_files=True).collect()))
    for cut in (97, 1 << 20):
        read = spark.read.format("blocks").options(path=folder, table=table, cut=cut).load()
        assert sorted(map(str, read.collect())) == whole and whole
        assert read.schema == blocks.SCHEMAS[table]
    assert sorted(map(str, blocks.read_blocks(spark, f"file://{folder}", table=table).collect())) == whole


def test_a_file_is_parsed_by_several_tasks(spark, folder):
    spark.dataSource.register(blocks.BlockSource)
    read = spark.read.format("blocks").options(path=f"{folder}/blk00001.dat", cut=1000).load()
    parts = read.select(F.spark_partition_id().alias("p"), "block_hash").distinct().groupBy("block_hash").count()
    assert read.rdd.getNumPartitions() > 8 and parts.agg(F.max("count")).first()[0] == 1


def test_block_files_become_tables(spark, tmp_path):
    data = block(transaction()[0])
    (tmp_path / "blk00001.dat").write_bytes(data)
    (tmp_path / "blk00002.dat").write_bytes(data)
    b, t, o = blocks.ledger_tables(blocks.read_blocks(spark, str(tmp_path)))
    assert (b.count(), t.count(), o.count()) == (1, 1, 2)


def test_null_and_empty_contents_have_no_blocks(spark):
    rows = [("a", None), ("b", b""), (None, bytes(block(transaction()[0])))]
    got = blocks.parse_content(spark.createDataFrame(rows, "file string, content binary")).collect()
    assert [(r["file"], r["amount"]) for r in got] == [(None, 5000), (None, 7)]


def test_compact_sizes(spark):
    cases = {"FC": 252, "FD3412": 0x1234, "FE78563412": 0x12345678}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "h string, v long").withColumn("got", fc.compact_size(F.unhex("h")))
    assert all(r["got"] == r["v"] for r in df.collect())


def test_listings_ranges_and_reads_at_offsets(folder):
    """Files are listed with their sizes, ranges join up, and reads at offsets of a store's file give what a mapped file gives."""
    from pyarrow import fs

    assert [(p.rsplit("/", 1)[1], n > 0) for p, n in blocks._listed(folder, "blk*.dat")] == [("blk00001.dat", True), ("blk00003.dat", False), ("blk00002.dat", True)]
    with pytest.raises(FileNotFoundError):
        blocks._listed(f"{folder}/none", "*")
    reader = blocks.BlockReader({"path": f"{folder}/blk00001.dat", "cut": "1000"})
    parts = reader.partitions()
    assert len(parts) > 8 and parts[0].begin == 0 and all(a.end == b.begin for a, b in zip(parts, parts[1:]))
    near = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    with fs.LocalFileSystem().open_input_file(f"{folder}/blk00001.dat") as f:
        far = [r for p in parts for batch in blocks.parse_range(lambda at, n: f.read_at(n, at), p.size, "blk00001.dat", "outputs", p.begin, p.end) for r in batch.to_pylist()]
    assert near == far and near
