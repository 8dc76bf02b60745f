"""The relational store: orders, trades, links, pnl snapshots and events as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.plans.sizing import broadcast_if_small

MONEY = "decimal(38,18)"
TABLES = {
    "orders": "order_id string, client_order_id string, symbol string, exchange string, side string, order_type string, amount double, "
    "price double, status string, filled double, remaining double, cost double, fee double, fee_currency string, exchange_timestamp timestamp, "
    "created_at timestamp, updated_at timestamp, strategy_id string, pair_id string, extra_data string",
    "trades": "trade_id string, pair_id string, strategy_id string, side string, status string, entry_time timestamp, exit_time timestamp, "
    "entry_price_asset1 double, entry_price_asset2 double, exit_price_asset1 double, exit_price_asset2 double, quantity_asset1 double, "
    "quantity_asset2 double, notional_value double, hedge_ratio double, entry_z_score double, exit_z_score double, realized_pnl double, "
    "total_fees double, net_pnl double, max_favorable_excursion double, max_adverse_excursion double, exit_reason string",
    "trade_orders": "trade_id string, order_id string, role string",
    "portfolio_pnl": "ts timestamp, total_value double, cash_balance double, positions_value double, realized_pnl double, unrealized_pnl double, "
    "total_pnl double, drawdown double, positions string, metrics string",
    "system_events": "ts timestamp, event_type string, severity string, service string, message string, details string",
}
# The rules each table must meet: name and a condition on the row.
CONSTRAINTS = {
    "orders": {"positive_amount": "amount > 0", "non_negative_filled": "filled >= 0", "non_negative_remaining": "remaining >= 0", "non_negative_cost": "cost >= 0"},
    "trades": {"positive_quantity_asset1": "quantity_asset1 > 0", "positive_quantity_asset2": "quantity_asset2 > 0",
               "positive_notional_value": "notional_value > 0", "positive_hedge_ratio": "hedge_ratio > 0"},
    "portfolio_pnl": {"non_negative_total_value": "total_value >= 0"},
}


def upsert_orders(target: DataFrame, updates: DataFrame, key: str = "order_id", version: str = "version") -> DataFrame:
    """Insert new orders and overwrite known ones: per column the latest value given wins, columns an
    update leaves null keep their value, and ``remaining`` defaults to amount - filled. One partial
    aggregation; ``version`` orders the rows of a key (the target holds the lowest)."""
    rows = target.unionByName(updates, allowMissingColumns=True)
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in rows.columns if c not in (key, version, "remaining")]
    given = F.max_by(F.struct("remaining"), F.col(version))["remaining"].alias("_rem")
    d = rows.groupBy(key).agg(*latest, given, F.max(version).alias(version))
    return d.withColumn("remaining", F.coalesce("_rem", F.col("amount") - F.col("filled"))).drop("_rem")


def append_open_trades(trades: DataFrame, new: DataFrame) -> DataFrame:
    return trades.unionByName(new.withColumn("status", F.lit("open")), allowMissingColumns=True)


def close_trades(trades: DataFrame, exits: DataFrame, key: str = "trade_id", columns: Sequence[str] = ("exit_time", "pnl", "exit_reason")) -> DataFrame:
    """Set the exit columns of matched trades and mark them closed; others stay as they are."""
    e = exits.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    d = trades.join(broadcast_if_small(e), key, "left")
    d = d.withColumns({c: F.coalesce(f"_{c}", F.col(c)) if c in trades.columns else F.col(f"_{c}") for c in columns})
    return d.withColumn("status", F.when(F.col("_hit"), "closed").otherwise(F.col("status"))).drop("_hit", *[f"_{c}" for c in columns])


def snapshot_rows(df: DataFrame, details: Mapping[str, Column], ts: str = "ts") -> DataFrame:
    """Rows ready to append: detail columns as one JSON text, and the day they are partitioned by."""
    pairs = [x for name, c in details.items() for x in (F.lit(name), c.cast("string"))]
    return df.withColumns({"details": F.to_json(F.create_map(*pairs)), "day": F.to_date(ts)})


def write_snapshots(df: DataFrame, path: str) -> None:
    """Append day-partitioned snapshots or events."""
    df.write.mode("append").partitionBy("day").parquet(path)


def retain(df: DataFrame, now: Column, days: int = 90, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days``; on a day-partitioned table the filter prunes folders when ts is ``day``."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def recent_pnl(df: DataFrame, now: Column, hours: int, ts: str = "ts") -> DataFrame:
    """Rows of the last hours, newest first."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(0), F.lit(hours))).orderBy(F.col(ts).desc())


def open_trades(trades: DataFrame, pair: str | None = None, status: str = "OPEN") -> DataFrame:
    d = trades.filter(F.col("status") == status)
    return d if pair is None else d.filter(F.col("pair") == pair)


def check_constraints(df: DataFrame, rules: Mapping[str, str], unique: Sequence[str] = (), parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Violations per rule: row rules in one pass, then duplicate keys and missing parents.

    ``parents`` maps a foreign-key column to the frame that must hold it under the same name.
    """
    one_pass = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(n) for n, c in rules.items()])
    out = one_pass.unpivot([], list(rules), "rule", "violations")
    if unique:
        doubles = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        out = out.unionByName(doubles.agg(F.lit("unique_" + "_".join(unique)).alias("rule"), F.count(F.lit(1)).alias("violations")))
    for column, parent in (parents or {}).items():
        orphans = df.join(parent.select(column), column, "left_anti")
        out = out.unionByName(orphans.agg(F.lit(f"parent_{column}").alias("rule"), F.count(F.lit(1)).alias("violations")))
    return out


def finite_positive(df: DataFrame, price: str, key: str = "symbol") -> DataFrame:
    """Rows with a key and a finite positive price."""
    p = F.col(price).cast("double")
    return df.filter(F.col(key).isNotNull() & (p > 0) & ~F.isnan(p) & (p < float("inf")))
