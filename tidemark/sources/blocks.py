"""Block files: magic, size, header, transactions with inputs, outputs and witnesses."""

from __future__ import annotations

import fnmatch
import hashlib
import mmap
import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed value: the network's magic.
MAGIC = bytes.fromhex("F9BEB4D9")
#: Bytes of a file that one task parses: the blocks that start there.
CUT = 16 << 20


def _columns(described: str) -> StructType:
    kinds = StructType()
    for column in described.split(", "):
        kinds.add(*column.split(" "))
    return kinds


SCHEMAS = {
    "outputs": _columns("file string, block_hash binary, time long, tx_hash binary, out_index integer, amount long, pub_key binary"),
    "headers": _columns("file string, block_hash binary, block_size long, version integer, prev_hash binary, merkle_root binary, time long, bits binary, nonce binary, n_txs long"),
    "transactions": _columns("file string, block_hash binary, tx_hash binary, tx_index integer, version integer, segwit boolean, n_inputs integer, n_outputs integer, lock_time long"),
    "inputs": _columns("file string, tx_hash binary, in_index integer, prev_tx binary, vout long, script_sig binary, sequence long"),
    "witnesses": _columns("file string, tx_hash binary, in_index integer, item_index integer, item binary"),
}


def display_hash(*parts: bytes | memoryview) -> bytes:
    """Double SHA-256 of the parts in a row, byte-reversed."""
    once = hashlib.sha256(parts[0])
    for part in parts[1:]:
        once.update(part)
    return hashlib.sha256(once.digest()).digest()[::-1]


class Block:
    """Where the fields of a block stand: one walk over its counts and sizes, which leaves offsets for each kind of field.

    Values are then gathered a column at a time. ``end`` is the offset behind the block, as
    its contents have it; the block's own size field isn't needed. A wrong magic or
    data that end too early raise ``ValueError``.
    """

    def __init__(self, data: bytes | mmap.mmap, at: int = 0):
        if data[at : at + 4] != MAGIC:
            raise ValueError("bad magic")
        self.data, self.at = data, at
        #: For each transaction: begin, begin of its input count, end of outputs, lock time, segwit.
        self.txs: list[tuple[int, int, int, int, bool]] = []
        #: Offsets with the number of the transaction and of the field in it; scripts and items with their lengths.
        self.inputs: list[tuple[int, int, int, int, int]] = []
        self.outputs: list[tuple[int, int, int, int, int]] = []
        self.items: list[tuple[int, int, int, int, int]] = []
        try:
            self.end = self._walk(at + 88)
        except IndexError:
            raise ValueError("truncated block data") from None
        if self.end > len(data):
            raise ValueError("truncated block data")

    def _compact(self, at: int) -> tuple[int, int]:
        """A compact size and the offset behind it."""
        first = self.data[at]
        if first < 253:
            return first, at + 1
        wide = 1 << first - 252
        self.data[at + wide]  # must be there
        return int.from_bytes(self.data[at + 1 : at + 1 + wide], "little"), at + 1 + wide

    def _walk(self, at: int) -> int:
        data, compact = self.data, self._compact
        self.count, at = compact(at)
        for t in range(self.count):
            begin = at
            at += 4
            segwit = data[at] == 0 and data[at + 1] == 1
            at += 2 * segwit
            counted = at
            n_inputs = data[at]
            if n_inputs < 253:
                at += 1
            else:
                n_inputs, at = compact(at)
            for i in range(n_inputs):
                size = data[at + 36]
                if size < 253:
                    script = at + 37
                else:
                    size, script = compact(at + 36)
                self.inputs.append((t, i, at, script, size))
                at = script + size + 4
            n_outputs = data[at]
            if n_outputs < 253:
                at += 1
            else:
                n_outputs, at = compact(at)
            for i in range(n_outputs):
                size = data[at + 8]
                if size < 253:
                    script = at + 9
                else:
                    size, script = compact(at + 8)
                self.outputs.append((t, i, at, script, size))
                at = script + size
            behind = at
            for i in range(n_inputs if segwit else 0):
                n_items, at = compact(at)
                for k in range(n_items):
                    size, item = compact(at)
                    self.items.append((t, i, k, item, size))
                    at = item + size
            self.txs.append((begin, counted, behind, at, segwit))
            at += 4
        return at

    def hashes(self) -> tuple[bytes, list[bytes]]:
        """Of the header and of the transactions, without the segwit marker and the witnesses."""
        view = memoryview(self.data)
        try:
            txs = [display_hash(view[b : b + 4], view[c:e], view[k : k + 4]) if segwit else display_hash(view[b : k + 4]) for b, c, e, k, segwit in self.txs]
            return display_hash(view[self.at + 8 : self.at + 88]), txs
        finally:
            view.release()

    def table(self, name: str, file: str, schema: pa.Schema) -> pa.RecordBatch:
        """The rows of one of ``SCHEMAS``. 64-bit amounts beyond the signed range are negative."""
        block_hash, tx_hashes = self.hashes()
        raw = np.frombuffer(self.data, np.uint8)
        data = self.data

        def numbers(at: np.ndarray, kind: str) -> np.ndarray:
            return raw[at[:, None] + np.arange(np.dtype(kind).itemsize)].view(kind).ravel()

        def of_tx(t: np.ndarray) -> pa.Array:
            return pa.array(tx_hashes, pa.binary()).take(pa.array(t))

        head = self.at + 8
        if name == "headers":
            size, version = numbers(np.array([head - 4]), "<u4")[0], numbers(np.array([head]), "<i4")[0]
            rows = [[block_hash], [size], [version], [data[head + 4 : head + 36]], [data[head + 36 : head + 68]], numbers(np.array([head + 68]), "<u4"), [data[head + 72 : head + 76]], [data[head + 76 : head + 80]], [self.count]]
        elif name == "transactions":
            at = np.array([x[:4] for x in self.txs], np.int64).reshape(-1, 4)
            n = [np.bincount(np.array([x[0] for x in found], np.int64), minlength=len(self.txs)) for found in (self.inputs, self.outputs)]
            rows = [[block_hash] * len(at), tx_hashes, np.arange(len(at)), numbers(at[:, 0], "<i4"), [x[4] for x in self.txs], *n, numbers(at[:, 3], "<u4")]
        else:
            found = {"inputs": self.inputs, "outputs": self.outputs, "witnesses": self.items}[name]
            x = np.array(found, np.int64).reshape(-1, 5)
            values = [data[a : a + n] for a, n in zip(x[:, 3].tolist(), x[:, 4].tolist())]
            if name == "outputs":
                time = numbers(np.array([head + 68]), "<u4")[0]
                rows = [[block_hash] * len(x), np.full(len(x), time), of_tx(x[:, 0]), x[:, 1], numbers(x[:, 2], "<i8"), values]
            elif name == "inputs":
                rows = [of_tx(x[:, 0]), x[:, 1], [data[a : a + 32] for a in x[:, 2].tolist()], numbers(x[:, 2] + 32, "<u4"), values, numbers(x[:, 3] + x[:, 4], "<u4")]
            else:
                rows = [of_tx(x[:, 0]), x[:, 1], x[:, 2], values]
        columns = [col if isinstance(col, pa.Array) else pa.array(col, kind.type) for col, kind in zip(rows, list(schema)[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([file] * len(columns[0]), pa.string()), *columns], schema=schema)


def block_ranges(read: Callable[[int, int], bytes], size: int, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """(begin, end) of the blocks that start in a range of a file, found from the file's start.

    A block's size field is believed where it leads to a magic or to the end of the file; else the block's
    contents say where it ends. So every range of a file sees the same blocks, and a magic
    within a script starts none.
    """
    at, end = 0, size if end is None else end
    while at < min(end, size):
        if read(at, 4) != MAGIC:
            raise ValueError("bad magic")
        behind = at + 8 + int.from_bytes(read(at + 4, 4), "little")
        if behind != size and (behind > size or read(behind, 4) != MAGIC):
            behind = at + Block(read(at, size - at)).end
        if at >= begin:
            yield at, behind
        at = behind


def parse_range(read: Callable[[int, int], bytes], size: int, file: str, table: str, begin: int = 0, end: int | None = None) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(SCHEMAS[table])
    for at, behind in block_ranges(read, size, begin, end):
        block = Block(read(at, behind - at))
        if block.end != behind - at:
            raise ValueError(f"a block of {behind - at} bytes ends after {block.end}")
        yield block.table(table, file, schema)


class FileRange(InputPartition):
    def __init__(self, path: str, size: int, begin: int, end: int):
        super().__init__((path, begin))
        self.path, self.size, self.begin, self.end = path, size, begin, end


def _local(path: str) -> str | None:
    """The local path that ``path`` names, or None."""
    parts = urlparse(path)
    return path if parts.scheme == "" else unquote(parts.path) if parts.scheme == "file" else None


def _listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """Paths and sizes of the file ``path``, or of the files below it whose names match."""
    local = _local(path)
    if local is not None:
        if not os.path.isdir(local):
            return [(local, os.path.getsize(local))]
        found = (os.path.join(folder, name) for folder, _, names in os.walk(local) for name in names if fnmatch.fnmatch(name, pattern))
        return sorted((f, os.path.getsize(f)) for f in found)
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    top = store.get_file_info(root)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [top] if top.is_file else [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and fnmatch.fnmatch(f.base_name, pattern)]
    return sorted((f.path, f.size) for f in files)


class BlockSource(DataSource):
    """``spark.read.format("blocks")``: options ``path``, ``pattern``, ``table`` (of ``SCHEMAS``) and ``cut`` (bytes a task).

    A file is cut into ranges; a task finds the blocks that start in its range by their size
    fields and parses only those, so that one file uses as many tasks as it has ranges. Paths are those
    that Python can open on every executor; for others ``read_blocks`` lets Spark read whole files.
    """

    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> StructType:
        return SCHEMAS[self.options.get("table", "outputs")]

    def reader(self, schema: StructType) -> BlockReader:
        return BlockReader(self.options)


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "blk*.dat")
        self.table, self.cut = options.get("table", "outputs"), int(options.get("cut", CUT))

    def partitions(self) -> list[FileRange]:
        ranges = [FileRange(path, size, at, min(at + self.cut, size)) for path, size in _listed(self.path, self.pattern) for at in range(0, size, self.cut)]
        return ranges or [FileRange("", 0, 0, 0)]

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        name = os.path.basename(part.path)
        if _local(self.path) is not None:
            with open(part.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as content:
                yield from parse_range(lambda at, n: content[at : at + n], part.size, name, self.table, part.begin, part.end)
        else:
            from pyarrow import fs

            with fs.FileSystem.from_uri(self.path)[0].open_input_file(part.path) as f:
                yield from parse_range(lambda at, n: f.read_at(n, at), part.size, name, self.table, part.begin, part.end)


def parse_content(contents: DataFrame, table: str = "outputs", name_col: str = "file", content_col: str = "content") -> DataFrame:
    """The blocks of a binary column: each row's bytes are a file. Null and empty contents have no blocks."""
    schema = to_arrow_schema(SCHEMAS[table])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"]):
                data = content.as_py() or b""
                for part in parse_range(lambda at, n: data[at : at + n], len(data), name, table):
                    yield part.cast(schema)

    return contents.select(F.col(name_col).cast("string").alias("name"), F.col(content_col).alias("content")).mapInArrow(parse, SCHEMAS[table])


def read_blocks(spark: SparkSession, path: str, pattern: str = "blk*.dat", table: str = "outputs", whole_files: bool = False) -> DataFrame:
    """Rows of a table of the block files under ``path``; ``file`` is a file's name.

    ``whole_files``: Spark reads each file as one row, for stores that only Spark opens; a file is then one task's.
    """
    if whole_files:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
        return parse_content(files.withColumn("file", F.element_at(F.split("path", "/"), -1)), table)
    spark.dataSource.register(BlockSource)
    return spark.read.format("blocks").options(path=path, pattern=pattern, table=table).load()


def ledger_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, transactions and outputs, one row for each key."""
    blocks = rows.select(F.col("block_hash").alias("hash"), F.timestamp_seconds("time").alias("time"), "file").dropDuplicates(["hash"])
    txs = rows.select("block_hash", F.col("tx_hash").alias("hash")).dropDuplicates(["hash"])
    return blocks, txs, rows.select("tx_hash", F.col("out_index").alias("count"), (F.col("amount") / 1e8).alias("amount"), "pub_key").dropDuplicates(["tx_hash", "count"])
