"""Queries over block bytes that Spark encodes from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import columns as fc
from tidemark.plans.queries import query
from tidemark.sources import bars as src
from tidemark.sources import blocks

c = F.col

#: Order keys of one block, which bounds what is gathered into its bytes.
ORDERS_PER_BLOCK = 1000
FIRST_TIME = 1_500_000_000


def block_bytes(spark, sf_dir) -> DataFrame:
    """(file, content): a block for every thousand order keys, an order a transaction, a line an output.

    Amounts are prices in cents, scripts the part keys' digits, lock times the order keys'
    low 32 bits. Orders of odd key carry the segwit marker and a witness, which their hash leaves out.
    """
    amount = F.round(c("l_extendedprice") * 100).cast("long")
    script = F.hex(c("l_partkey").cast("string"))
    output = F.concat(fc.little_endian_hex(amount, 8), fc.compact_size_hex(F.length(script) / 2), script)
    lines = src.table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", amount.alias("amount"), output.alias("hex")).alias("line"))
    outs = F.array_sort(F.collect_list("line"))
    txs = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(outs, lambda x: x["hex"]), "").alias("outs"))
    odd = c("key") % 2 == 1
    body = F.concat(F.lit("01" + "00" * 32 + "FFFFFFFF" + "00" + "FFFFFFFF"), fc.compact_size_hex(c("n")), c("outs"))
    tx = F.concat(F.lit("01000000"), F.when(odd, "0001").otherwise(""), body, F.when(odd, "0102BEEF").otherwise(""), fc.little_endian_hex(c("key") % (1 << 32), 4))
    gathered = txs.groupBy(F.floor(c("key") / ORDERS_PER_BLOCK).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", tx.alias("hex")))), lambda x: x["hex"]), "").alias("txs"))
    content = F.concat(F.lit("02000000" + "00" * 64), fc.little_endian_hex(F.lit(FIRST_TIME) + c("block"), 4), F.lit("00" * 8), fc.compact_size_hex(c("n")), c("txs"))
    return gathered.select(c("block").cast("string").alias("file"), F.unhex(F.concat(F.lit(blocks.MAGIC.hex()), fc.little_endian_hex((F.length(content) / 2).cast("long"), 4), content)).alias("content"))


def _little_endian(value: str, width: int) -> str:
    return f"array_to_string(list_reverse(regexp_extract_all(printf('%0{2 * width}X', CAST({value} AS BIGINT)), '..')), '')"


_REVERSED = "array_to_string(list_reverse(regexp_extract_all({}, '..')), '')"


@query(
    f"""WITH lines AS (
        SELECT l_orderkey AS key, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, CAST(l_partkey AS VARCHAR) AS script,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT)) - 1 AS out_index
        FROM lineitem
    ), txs AS (
        SELECT key, sha256(unhex(sha256(unhex('01000000' || '01' || repeat('00', 32) || 'FFFFFFFF00FFFFFFFF' || {_little_endian('count(*)', 1)}
               || string_agg({_little_endian('amount', 8)} || {_little_endian('length(script)', 1)} || hex(encode(script)), '' ORDER BY out_index) || {_little_endian('key % 4294967296', 4)})))) AS h
        FROM lines GROUP BY key
    )
    SELECT CAST(key // {ORDERS_PER_BLOCK} AS VARCHAR) AS file, CAST({FIRST_TIME} + key // {ORDERS_PER_BLOCK} AS BIGINT) AS time, upper({_REVERSED.format('h')}) AS tx_hash,
           CAST(out_index AS INTEGER) AS out_index, amount, script AS pub_key
    FROM lines JOIN txs USING (key)"""
)
def block_outputs(spark, sf_dir):
    """Outputs parsed from the bytes of blocks."""
    found = blocks.parse_content(block_bytes(spark, sf_dir))
    return found.select("file", "time", F.hex("tx_hash").alias("tx_hash"), "out_index", "amount", F.decode("pub_key", "UTF-8").alias("pub_key"))


@query(
    f"""WITH orders_of AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT CAST(key // {ORDERS_PER_BLOCK} AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY key // {ORDERS_PER_BLOCK} ORDER BY key) - 1 AS INTEGER) AS tx_index,
           CAST(1 AS INTEGER) AS version, key % 2 = 1 AS segwit, CAST(1 AS INTEGER) AS n_inputs, CAST(n AS INTEGER) AS n_outputs, CAST(key % 4294967296 AS BIGINT) AS lock_time
    FROM orders_of"""
)
def block_transactions(spark, sf_dir):
    """Transactions parsed from the bytes of blocks."""
    return blocks.parse_content(block_bytes(spark, sf_dir), "transactions").drop("block_hash", "tx_hash")
