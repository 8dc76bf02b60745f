"""Trade excursions against price marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.plans.ranges import interval_extremes
from tidemark.plans.series import TICKS, Series


def excursions(trades: DataFrame, marks: DataFrame, s: Series = TICKS, price: str = "price") -> DataFrame:
    """Largest favourable and adverse pnl of each trade between entry and exit.

    Trades: keys, trade_id, entry_ts, exit_ts, entry_price, quantity, direction (1 or -1).
    """
    span = interval_extremes(trades, marks, s, "trade_id", "entry_ts", "exit_ts", price)
    d = trades.join(span, [*s.keys, "trade_id"])
    size = F.col("quantity") * F.col("direction")
    a, b = ((F.col(c) - F.col("entry_price")) * size for c in ("low", "high"))
    return d.withColumns({
        "mfe": F.greatest(F.greatest(a, b), F.lit(0.0)), "mae": F.greatest(-F.least(a, b), F.lit(0.0)),
    }).drop("low", "high")
