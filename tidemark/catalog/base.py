"""Query registry, output shaping and the SQL form of the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "ticks": "SELECT 'S' || user_id AS symbol, ts, event_id AS seq, value AS price, event_type AS channel, props FROM events",
    "channel_ticks": "SELECT event_type AS symbol, ts, event_id AS seq, value AS price, event_type AS channel FROM events",
    "bars": """SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts,
        arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, (ts, event_id)) AS close, sum(value) AS volume, count(*) AS n
        FROM events GROUP BY 1, 2""",
    "regimes": """SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY ts, seq) AS previous FROM (
        SELECT 'S' || user_id AS symbol, ts, event_id AS seq, value AS price, least(value / 100, 1.0) AS confidence,
        CASE event_type WHEN 'view' THEN 'low_vol_bull' WHEN 'click' THEN 'high_vol_bear' WHEN 'purchase' THEN 'stable_range'
        WHEN 'signup' THEN 'crisis' WHEN 'error' THEN 'high_vol_range' END AS regime FROM events)""",
    "metric_days": """SELECT 'S' || user_id AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, event_type AS metric,
        avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3""",
    "fills": """SELECT 'P' || l_suppkey AS symbol, l_shipdate AS ts, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000 AS seq,
        CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity,
        l_extendedprice / l_quantity AS price, l_extendedprice * l_tax AS fee, l_orderkey AS order_id,
        l_linestatus AS book_side FROM lineitem""",
    "levels": """SELECT l_orderkey AS book_id, 'P' || l_suppkey AS symbol, l_shipdate AS ts,
        (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000 AS seq, CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side,
        floor(l_extendedprice / l_quantity * 100 + 0.5003) / 100.0 AS price, l_quantity AS quantity FROM lineitem""",
    "quotes": """SELECT 'S' || user_id AS symbol, ts, event_id AS seq, event_type AS channel, value - 0.5 AS bid, value + 0.5 AS ask,
        (1 + event_id % 10)::DOUBLE AS bid_qty, (1 + event_id % 7)::DOUBLE AS ask_qty FROM events""",
    "quote_orders": """SELECT 'S' || user_id AS symbol, ts, event_id AS seq, event_id AS order_id,
        CASE WHEN event_type IN ('view', 'click') THEN 'buy' ELSE 'sell' END AS side, (1 + event_id % 5)::DOUBLE AS quantity,
        CASE WHEN event_type IN ('view', 'click') THEN value * 0.7 ELSE value * 1.3 END AS limit_price,
        CASE WHEN event_type IN ('view', 'click') THEN value * 1.4 ELSE value * 0.6 END AS stop_price FROM events""",
    "closed_trades": """SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey % 1000000 AS trade_id, 'P' || l_suppkey AS pair, o_custkey AS account,
        o_orderdate AS entry_time, l_shipdate AS exit_time, l_extendedprice * (l_discount - l_tax) AS pnl,
        l_extendedprice AS notional, l_quantity AS quantity,
        CASE WHEN l_returnflag = 'R' THEN 'short' ELSE 'long' END AS side,
        CASE WHEN l_linestatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS status, l_extendedprice * l_tax AS fee
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "equity": """SELECT 'N' || c_nationkey AS strategy, o_orderdate AS ts, sum(o_totalprice) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "nation_bars": """SELECT 'N' || c_nationkey AS symbol, date_trunc('month', o_orderdate)::TIMESTAMP AS ts,
        avg(o_totalprice) AS close, sum(o_totalprice) AS volume, max(o_totalprice) AS high, min(o_totalprice) AS low
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "log_lines": """SELECT doc_id, generate_subscripts(parts, 1)::INTEGER - 1 AS line_no, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)""",
}


def sql(views: str, body: str) -> str:
    """A query text with the named views in front; ``body`` may start with further CTEs after ``WITH``."""
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views.split())
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].strip()}"
    return f"WITH {ctes},\n{body[4:].strip()}" if body.upper().startswith("WITH") else f"WITH {ctes}\n{body}"


# Values are compared after rounding to ``digits``. The half is nudged off the exact midpoint, where many
# decimal inputs land and where the last bit of two engines would decide.
HALF = 0.5003


def r(expr: str, digits: int = 6) -> str:
    """Comparison rounding as SQL text."""
    return f"(floor(({expr})::DOUBLE * 1e{digits} + {HALF}) / 1e{digits})"


def rs(columns: str, digits: int = 6) -> str:
    return ", ".join(f"{r(c, digits)} AS {c}" for c in columns.split())


def rd(c: Column | str, digits: int = 6) -> Column:
    """Comparison rounding as a column."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10**digits)
    return F.floor(c.cast("double") * scale + HALF) / scale


def shaped(df: DataFrame, digits: int = 6, columns: str | None = None, per: dict[str, int] | None = None) -> DataFrame:
    """Round doubles, widen counts, and drop the zone from timestamps, for comparison with SQL."""
    names = columns.split() if columns else df.columns
    types = {f.name: f.dataType for f in df.schema}
    per = per or {}

    def one(name: str) -> Column:
        kind = types[name]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return rd(F.col(name).cast("double"), per.get(name, digits)).alias(name)
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(name).cast("long").alias(name)
        if isinstance(kind, T.TimestampType):
            return F.col(name).cast("timestamp_ntz").alias(name)
        return F.col(name)

    return df.select(*[one(n) for n in names])


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with its SQL counterpart, where one can be written."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap
