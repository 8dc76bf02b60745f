"""Order books, microstructure measures and simulated fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.maths import ratio
from tidemark.operators.ranking import top_per_key
from tidemark.plans.ranges import first_touch
from tidemark.plans.series import TICKS, Series, asof, by_key_size, over_rows, over_time, running, with_position

# the keys of the payload differ only in case (U, u), so it is read as a map
DEPTH_SCHEMA = "stream string, data map<string, string>"
LEVELS_SCHEMA = "array<array<string>>"


def parse_depth(df: DataFrame, value: str = "value") -> DataFrame:
    """Depth envelopes (JSON text) to symbol, update ids and decimal levels.

    Both level spellings are read; zero quantities stay, since they mean removal. Envelopes whose stream
    has no ``@`` part are dropped, as are levels with fewer than two parts.
    """
    d = df.withColumn("_m", F.from_json(value, DEPTH_SCHEMA)).filter(F.size(F.split("_m.stream", "@")) >= 2)

    def field(name: str) -> Column:
        return F.try_element_at("_m.data", F.lit(name))

    def levels(short: str, long: str) -> Column:
        raw = F.from_json(F.coalesce(field(long), field(short), F.lit("[]")), LEVELS_SCHEMA)
        full = F.filter(raw, lambda p: F.size(p) >= 2)
        return F.transform(full, lambda p: F.struct(p[0].cast("decimal(38,18)").alias("price"), p[1].cast("decimal(38,18)").alias("quantity")))

    last = field("lastUpdateId")
    return d.withColumns({
        "symbol": F.upper(F.split("_m.stream", "@")[0]),
        "first_id": F.coalesce(field("U"), last, F.lit("0")).cast("long"),
        "final_id": F.coalesce(field("u"), last, F.lit("0")).cast("long"),
        "event_time": F.timestamp_millis(field("E").cast("long")),
        "bids": levels("b", "bids"), "asks": levels("a", "asks"),
    }).drop("_m")


def explode_levels(updates: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per level of both sides."""
    tagged = F.concat(F.transform("bids", _tag("bid")), F.transform("asks", _tag("ask")))
    return updates.select(*keep, F.explode(tagged).alias("_l")).select(*keep, "_l.*")


def _tag(side: str):
    return lambda e: F.struct(F.lit(side).alias("side"), e["price"].alias("price"), e["quantity"].alias("quantity"))


def _best_first() -> Column:
    """Sort key that puts the best level of either side first."""
    return F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))


def depth_top_n(levels: DataFrame, keys: Sequence[str], n: int = 5, tie: str = "seq") -> DataFrame:
    """The n best levels of each side of each book, ranked."""
    return top_per_key(levels, [*keys, "side"], [_best_first().asc(), F.col(tie).asc()], n, "rank")


def assemble_books(levels: DataFrame, keys: Sequence[str], depth: int | None = 20) -> DataFrame:
    """Books as rows: bids descending and asks ascending, each cut to ``depth`` levels (None: all)."""
    top = depth_top_n(levels, keys, depth or 2**31 - 1)

    def side(name: str) -> Column:
        ranked = F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct("rank", "price", "quantity"))))
        return F.transform(ranked, lambda e: F.struct(e["price"].alias("price"), e["quantity"].alias("quantity"))).alias(f"{name}s")

    return top.groupBy(*keys).agg(side("bid"), side("ask"))


def apply_increments(snapshots: DataFrame, updates: DataFrame, depth: int = 20, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Final book per key after all increments, in long form: the latest quantity of a price wins, zero
    removes the level, and each side is cut to its best ``depth`` levels."""
    rows = snapshots.unionByName(updates)
    at = F.struct(*[F.col(c) for c in order])
    last = rows.groupBy(*keys, "side", "price").agg(F.max_by("quantity", at).alias("quantity"), F.max(at).alias("_at"))
    live = last.filter(F.col("quantity") > 0).withColumn("seq", F.col(f"_at.{order[-1]}")).drop("_at")
    return depth_top_n(live, keys, depth)


def sequence_gaps(updates: DataFrame, s: Series = TICKS) -> DataFrame:
    """``valid`` iff an update starts right after the previous one's last id and does not run backwards."""
    d = over_rows(updates, s, lambda x, w: x.withColumn("prior_final", F.lag("final_id", 1).over(w)), before=1)
    good = (F.col("first_id") == F.col("prior_final") + 1) & (F.col("final_id") >= F.col("first_id"))
    return d.withColumn("valid", F.when(F.col("prior_final").isNull(), True).otherwise(good))


def _strictly(levels: str, falling: bool) -> Column:
    n = F.size(levels)
    pairs = F.zip_with(
        F.slice(levels, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(levels, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: (a["price"] > b["price"]) if falling else (a["price"] < b["price"]),
    )
    return F.forall(pairs, lambda ok: ok)


def best(levels: str) -> Column:
    return F.try_element_at(F.col(levels), F.lit(1))


def validate_books(books: DataFrame) -> DataFrame:
    """``valid`` iff both sides are strictly ordered, the book is not crossed and quantities are positive."""
    crossed = F.coalesce(best("bids")["price"] >= best("asks")["price"], F.lit(False))
    positive = F.forall("bids", lambda e: e["quantity"] > 0) & F.forall("asks", lambda e: e["quantity"] > 0)
    return books.withColumn("valid", _strictly("bids", True) & _strictly("asks", False) & ~crossed & positive)


def top_of_book(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best prices, mid and spread per book from level rows; null when a side is empty."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    d = levels.groupBy(*keys).agg(F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"))
    return d.withColumns({"mid": (F.col("best_bid") + F.col("best_ask")) / 2, "spread": F.col("best_ask") - F.col("best_bid")})


def book_checksum(books: DataFrame, depth: int = 10) -> DataFrame:
    """MD5 of ``price:quantity`` texts joined by a bar, best bids first, then best asks."""
    texts = [F.transform(F.slice(c, 1, depth), lambda e: F.concat_ws(":", e["price"].cast("string"), e["quantity"].cast("string"))) for c in ("bids", "asks")]
    return books.withColumn("checksum", F.md5(F.concat_ws("|", F.concat(*texts))))


def snapshot_due(df: DataFrame, keys: Sequence[str], width: str = "5 minutes", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """The last row of each bucket of ``width``: one snapshot per key and bucket."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    d = df.groupBy(*keys, F.window(ts, width).alias("_w")).agg(F.max_by(row, F.struct(ts, tie)).alias("_r"))
    return d.select(*keys, F.col("_w.start").alias("bucket"), "_r.*")


def mid_ticks(quotes: DataFrame) -> DataFrame:
    """One synthetic trade of quantity 1 at the mid of each quote."""
    both = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    return quotes.filter(both).select("symbol", "ts", "seq", ((F.col("bid") + F.col("ask")) / 2).alias("price"), F.lit(1.0).alias("quantity"))


def relative_spread(quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    rel = ratio(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2)
    return quotes.groupBy(*keys).agg(F.avg(F.when(F.col("ask") > F.col("bid"), rel)).alias("relative_spread"))


def book_imbalance(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    signed = F.when(F.col("side") == "bid", F.col("quantity")).otherwise(-F.col("quantity"))
    return levels.groupBy(*keys).agg(F.coalesce(ratio(F.sum(signed), F.sum("quantity")), F.lit(0.0)).alias("imbalance"))


def trade_intensity(df: DataFrame, s: Series = TICKS, minutes: int = 60) -> DataFrame:
    """Trades per minute over the trailing window that ends at each trade."""
    def build(d: DataFrame, w) -> DataFrame:
        return d.withColumn("intensity", F.count(F.lit(1)).over(w.rangeBetween(-minutes * 60, 0)) / F.lit(float(minutes)))

    return over_time(df, s, minutes * 60, build)


def slippage(bid: Column, ask: Column, quantity: Column, top_quantity: Column, base_bps: float = 1.0, factor: float = 0.1,
             max_bps: float = 50.0, impact: float = 1.0) -> Column:
    """Slippage as a fraction: base, half the spread and the size impact, capped; the cap without a book."""
    mid = (bid + ask) / 2
    spread = F.when(ask - bid != 0, ask - bid).otherwise(mid * 0.001)
    bps = base_bps + ratio(spread, mid) * 10_000 * 0.5 + factor * ratio(quantity, top_quantity) * impact
    return F.coalesce(F.least(bps, F.lit(max_bps)), F.lit(max_bps)) / 10_000


# Default tiers: (cumulative notional from which the tier holds, taker rate in basis points).
FEE_TIERS = ((0.0, 10.0), (1_000_000.0, 9.0), (10_000_000.0, 8.0))


def tiered_fee(fills: DataFrame, s: Series = TICKS, tiers: Sequence[tuple[float, float]] = FEE_TIERS) -> DataFrame:
    """Taker fee of each fill by the cumulative notional including it."""
    d = running(fills, s, {"volume_to_date": ("sum", F.col("quantity") * F.col("price"))})
    rate = F.lit(tiers[0][1])
    for bound, bps in sorted(tiers)[1:]:
        rate = F.when(F.col("volume_to_date") >= bound, F.lit(bps)).otherwise(rate)
    return d.withColumn("fee_paid", F.col("quantity") * F.col("price") * rate / 10_000)


def latency_shift(df: DataFrame, ms: int, ts: str = "ts") -> DataFrame:
    """Delay a time column by a constant."""
    return df.withColumn(ts, F.col(ts) + F.expr(f"interval {int(ms)} milliseconds"))


_QUOTE = {"bid": "bid", "ask": "ask", "bid_qty": "bid_qty", "ask_qty": "ask_qty"}


def _priced(d: DataFrame, fee_bps: float) -> DataFrame:
    """Fill at the touch moved by slippage, with the taker fee. Needs the quote columns and side, quantity."""
    buy = F.col("side") == "buy"
    top = F.when(buy, F.col("ask_qty")).otherwise(F.col("bid_qty"))
    slip = slippage(F.col("bid"), F.col("ask"), F.col("quantity"), top)
    d = d.withColumn("slippage", slip)
    price = F.when(buy, F.col("ask") * (1 + F.col("slippage"))).otherwise(F.col("bid") * (1 - F.col("slippage")))
    return d.withColumn("fill_price", price).withColumn("fee", F.col("fill_price") * F.col("quantity") * fee_bps / 10_000)


def market_fills(orders: DataFrame, quotes: DataFrame, latency_ms: int = 0, fee_bps: float = 10.0, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Fill each order against the latest quote at its time plus latency; orders before any quote stay out."""
    d = asof(latency_shift(orders, latency_ms), quotes, tuple(by), _QUOTE, right_ts="quote_ts")
    touch = F.when(F.col("side") == "buy", F.col("ask")).otherwise(F.col("bid"))
    return _priced(d.filter(F.col("quote_ts").isNotNull() & touch.isNotNull()), fee_bps)


def _touches(orders: DataFrame, quotes: DataFrame, s: Series, limit: str, buy_value: str, sell_value: str, buy_below: bool) -> DataFrame:
    """Positions of the first touching quote for buys and sells."""
    return by_key_size(orders, s, lambda o, q, own: _touching(o, q, own, limit, buy_value, sell_value, buy_below), quotes)


def _touching(orders: DataFrame, quotes: DataFrame, s: Series, limit: str, buy_value: str, sell_value: str, buy_below: bool) -> DataFrame:
    buys = first_touch(orders.filter("side = 'buy'"), quotes, s, "order_id", limit, buy_value, buy_below)
    sells = first_touch(orders.filter("side = 'sell'"), quotes, s, "order_id", limit, sell_value, not buy_below)
    hits = buys.unionByName(sells)
    placed = with_position(quotes.select(*s.keys, *s.order, *_QUOTE), s, "hit_pos").withColumnRenamed("ts", "fill_ts").drop("seq")
    return orders.join(hits, [*s.keys, "order_id"]).join(placed, [*s.keys, "hit_pos"])


def limit_fills(orders: DataFrame, quotes: DataFrame, fee_bps: float = 10.0, s: Series = TICKS) -> DataFrame:
    """Fill each limit order at the first quote from its time on that reaches the limit, at the better of
    limit and touch. Orders: symbol, order_id, ts, side, quantity, limit."""
    d = _touches(orders, quotes, s, "limit", "ask", "bid", True)
    price = F.when(F.col("side") == "buy", F.least("limit", "ask")).otherwise(F.greatest("limit", "bid"))
    return d.withColumn("fill_price", price).withColumn("fee", F.col("fill_price") * F.col("quantity") * fee_bps / 10_000)


def stop_fills(orders: DataFrame, quotes: DataFrame, fee_bps: float = 10.0, s: Series = TICKS) -> DataFrame:
    """Trigger each stop at the first mid past it, then fill as a market order at that quote."""
    mids = quotes.withColumn("_mid", (F.col("bid") + F.col("ask")) / 2)
    d = _touches(orders, mids, s, "stop", "_mid", "_mid", False)
    return _priced(d, fee_bps)


def empty_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "symbol string, ts timestamp, seq bigint, side string, price double, quantity double")
