"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import rounded
from tidemark.operators import price_features as pf
from tidemark.plans import sql_features as sf
from tidemark.sources import bars as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {sf.BARS} SELECT * FROM bars")
def daily_bars(spark, sf_dir):
    return src.order_bars(spark, sf_dir)


def _family(name: str) -> None:
    names = pf.FAMILIES[name]

    def run(spark, sf_dir):
        return rounded_doubles(pf.price_features(src.order_bars(spark, sf_dir)).select("symbol", "date", *names))

    run.__name__ = f"price_{name}"
    query(sf.family(names))(run)


for _name in pf.FAMILIES:
    _family(_name)


@query(f"WITH RECURSIVE {sf.BARS},{sf.STEPS},{sf.EWMA} SELECT b.symbol, b.date, round(CASE WHEN e.k >= 20 THEN sqrt(e.e) END, 6) + 0.0 AS ewma_vol FROM bars b LEFT JOIN ew e USING (symbol, date)")
def price_ewma_volatility(spark, sf_dir):
    return rounded_doubles(pf.ewma_vol(src.order_bars(spark, sf_dir)))
