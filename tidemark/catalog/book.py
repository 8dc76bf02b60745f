"""Order-book and fill queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import query, r, rs, shaped, sql
from tidemark.operators import book as B
from tidemark.plans.series import TICKS
from tidemark.sources import views as V


def _envelopes(spark, sf):
    """Depth messages as JSON text, one per order book."""
    level = F.array(F.format_string("%.2f", F.col("price")), F.format_string("%.1f", F.col("quantity")))
    d = B.depth_top_n(V.levels(spark, sf), ["book_id"], 20).groupBy("book_id").agg(
        F.collect_list(F.when(F.col("side") == "bid", level)).alias("b"), F.collect_list(F.when(F.col("side") == "ask", level)).alias("a"))
    data = F.struct(F.lit(0).cast("long").alias("E"), F.col("book_id").alias("U"), (F.col("book_id") + 1).alias("u"), "b", "a")
    stream = F.concat(F.lit("sym"), F.col("book_id").cast("string"), F.lit("@depth20"))
    return d.select("book_id", F.to_json(F.struct(stream.alias("stream"), data.alias("data"))).alias("value"))


@query("b01_parse_depth", sql("levels", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY book_id, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END, seq) AS rank FROM levels)
SELECT 'SYM' || book_id AS symbol, book_id AS first_id, book_id + 1 AS final_id, count(*) FILTER (side = 'bid') AS n_bids, count(*) FILTER (side = 'ask') AS n_asks,
{r('sum(price * quantity)', 2)} AS notional FROM k WHERE rank <= 20 GROUP BY book_id"""))
def parse_depth(spark, sf):
    d = B.parse_depth(_envelopes(spark, sf))
    rows = B.explode_levels(d, ["symbol", "first_id", "final_id"])
    bid = F.col("side") == "bid"
    return shaped(rows.groupBy("symbol", "first_id", "final_id").agg(
        F.count_if(bid).alias("n_bids"), F.count_if(~bid).alias("n_asks"),
        F.sum(F.col("price").cast("double") * F.col("quantity").cast("double")).alias("notional")), 2)


def _increments(spark, sf):
    """Levels of a supplier's book: prices on a coarse grid so that later quantities replace earlier ones."""
    qty = F.when(F.col("quantity") <= 5, 0.0).otherwise(F.col("quantity"))
    return V.levels(spark, sf).select("symbol", "ts", "seq", "side", F.floor(F.col("price") / 50).cast("double").alias("price"), qty.alias("quantity"))


FINAL = """inc AS (SELECT symbol, ts, seq, side, floor(price / 50) AS price, CASE WHEN quantity <= 5 THEN 0.0 ELSE quantity END AS quantity FROM levels),
last AS (SELECT symbol, side, price, arg_max(quantity, (ts, seq)) AS quantity FROM inc GROUP BY 1, 2, 3),
final AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS rank FROM last WHERE quantity > 0)"""


@query("b02_apply_increments", sql("levels", f"WITH {FINAL} SELECT symbol, side, price, quantity, rank FROM final WHERE rank <= 20"))
def apply_increments(spark, sf):
    d = B.apply_increments(B.empty_levels(spark), _increments(spark, sf))
    return shaped(d, columns="symbol side price quantity rank")


@query("b03_sequence_gaps", sql("ticks", """WITH u AS (SELECT symbol, ts, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS pos FROM ticks),
v AS (SELECT *, pos * 2 - 1 + CASE WHEN seq % 10 = 7 THEN 1 ELSE 0 END AS first_id, pos * 2 AS final_id FROM u),
l AS (SELECT *, lag(final_id) OVER (PARTITION BY symbol ORDER BY ts, seq) AS prior_final FROM v)
SELECT symbol, seq, first_id::BIGINT AS first_id, final_id, prior_final, CASE WHEN prior_final IS NULL THEN true ELSE first_id = prior_final + 1 AND final_id >= first_id END AS valid FROM l"""))
def sequence_gaps(spark, sf):
    return B.sequence_gaps(V.updates(spark, sf)).select("symbol", "seq", "first_id", "final_id", "prior_final", "valid")


@query("b04_validate_books", sql("levels", """WITH t AS (SELECT book_id, count(*) FILTER (side = 'bid') AS nb, count(DISTINCT price) FILTER (side = 'bid') AS db, count(*) FILTER (side = 'ask') AS na, count(DISTINCT price) FILTER (side = 'ask') AS da,
 max(price) FILTER (side = 'bid') AS bb, min(price) FILTER (side = 'ask') AS ba, min(quantity) AS q FROM levels GROUP BY 1)
SELECT book_id, nb = db AND na = da AND coalesce(bb < ba, true) AND q > 0 AS valid FROM t"""))
def validate_books(spark, sf):
    return B.validate_books(V.books(spark, sf)).select("book_id", "valid")


@query("b05_top_of_book", sql("levels", f"""WITH t AS (SELECT book_id, max(price) FILTER (side = 'bid') AS best_bid, min(price) FILTER (side = 'ask') AS best_ask FROM levels GROUP BY 1)
SELECT book_id, {rs('best_bid best_ask', 2)}, {r('(best_bid + best_ask) / 2', 4)} AS mid, {r('best_ask - best_bid', 2)} AS spread FROM t"""))
def top_of_book(spark, sf):
    return shaped(B.top_of_book(V.levels(spark, sf), ["book_id"]), 2, per={"mid": 4})


@query("b06_depth_top_n", sql("levels", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END, seq) AS rank FROM levels)
SELECT symbol, side, {r('price', 2)} AS price, quantity, rank FROM k WHERE rank <= 5"""))
def depth_top_n(spark, sf):
    return shaped(B.depth_top_n(V.levels(spark, sf), ["symbol"], 5), 2, "symbol side price quantity rank")


@query("b07_book_checksum", sql("levels", f"""WITH {FINAL}, t AS (SELECT symbol, string_agg(price || ':' || quantity, '|' ORDER BY side DESC, rank) AS txt FROM final WHERE rank <= 10 GROUP BY 1)
SELECT symbol, md5(txt) AS checksum FROM t"""))
def book_checksum(spark, sf):
    final = B.apply_increments(B.empty_levels(spark), _increments(spark, sf)).drop("rank")
    return B.book_checksum(B.assemble_books(final, ["symbol"])).select("symbol", "checksum")


@query("b08_snapshot_due", sql("quotes", """SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts)::TIMESTAMP AS bucket, max(seq) AS seq, arg_max(bid, (ts, seq)) AS bid FROM quotes GROUP BY 1, 2"""))
def snapshot_due(spark, sf):
    d = B.snapshot_due(V.quotes(spark, sf), ["symbol"])
    return d.select("symbol", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "seq", "bid")


@query("b09_mid_ticks", sql("quotes", f"SELECT symbol, seq, {r('(bid + ask) / 2')} AS price, 1.0::DOUBLE AS quantity FROM quotes"))
def mid_ticks(spark, sf):
    return shaped(B.mid_ticks(V.quotes(spark, sf)), columns="symbol seq price quantity")


@query("b10_relative_spread", sql("quotes", f"SELECT symbol, {r('avg((ask - bid) / nullif((ask + bid) / 2, 0)) FILTER (ask > bid)')} AS relative_spread FROM quotes GROUP BY 1"))
def relative_spread(spark, sf):
    return shaped(B.relative_spread(V.quotes(spark, sf), ["symbol"]))


@query("b11_book_imbalance", sql("levels", f"""SELECT book_id, {r("coalesce(sum(CASE side WHEN 'bid' THEN quantity ELSE -quantity END) / nullif(sum(quantity), 0), 0)")} AS imbalance FROM levels GROUP BY 1"""))
def book_imbalance(spark, sf):
    return shaped(B.book_imbalance(V.levels(spark, sf), ["book_id"]))


@query("b12_trade_intensity", sql("channel_ticks", f"""SELECT symbol, seq, {r('count(*) OVER (PARTITION BY symbol ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) / 60.0')} AS intensity FROM channel_ticks"""))
def trade_intensity(spark, sf):
    return shaped(B.trade_intensity(V.channel_ticks(spark, sf)), columns="symbol seq intensity")


SLIP = "least(1.0 + (CASE WHEN ask - bid <> 0 THEN ask - bid ELSE (bid + ask) / 2 * 0.001 END) / ((bid + ask) / 2) * 10000 * 0.5 + 0.1 * quantity / (CASE side WHEN 'buy' THEN ask_qty ELSE bid_qty END), 50.0) / 10000"
PRICED = f"""s AS (SELECT *, {SLIP} AS slippage FROM m), f AS (SELECT *, CASE side WHEN 'buy' THEN ask * (1 + slippage) ELSE bid * (1 - slippage) END AS fill_price FROM s)"""


@query("b13_slippage", sql("quotes quote_orders", f"""WITH m AS (SELECT o.symbol, o.seq, side, quantity, bid, ask, bid_qty, ask_qty FROM quote_orders o JOIN quotes q ON o.seq = q.seq), {PRICED}
SELECT symbol, seq, {r('slippage', 8)} AS slippage FROM f"""))
def slippage(spark, sf):
    d = V.quote_orders(spark, sf).drop("symbol", "ts").join(V.quotes(spark, sf), "seq")
    top = F.when(F.col("side") == "buy", F.col("ask_qty")).otherwise(F.col("bid_qty"))
    d = d.withColumn("slippage", B.slippage(F.col("bid"), F.col("ask"), F.col("quantity"), top))
    return shaped(d, 8, "symbol seq slippage")


@query("b14_tiered_fee", sql("fills", f"""WITH v AS (SELECT *, sum(quantity * price) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS vol FROM fills)
SELECT symbol, seq, {r('vol', 2)} AS volume_to_date, {r('quantity * price * CASE WHEN vol >= 10000000 THEN 8.0 WHEN vol >= 1000000 THEN 9.0 ELSE 10.0 END / 10000', 4)} AS fee_paid FROM v"""))
def tiered_fee(spark, sf):
    return shaped(B.tiered_fee(V.fills(spark, sf)), 4, "symbol seq volume_to_date fee_paid", per={"volume_to_date": 2})


@query("b15_market_fills", sql("quotes quote_orders", f"""WITH q AS (SELECT * FROM quotes WHERE channel <> 'view'),
m AS (SELECT o.symbol, o.order_id, o.side, o.quantity, q.bid, q.ask, q.bid_qty, q.ask_qty, q.ts AS qts FROM (SELECT *, ts + INTERVAL 250 MILLISECOND AS at FROM quote_orders) o ASOF JOIN q ON o.symbol = q.symbol AND o.at >= q.ts), {PRICED}
SELECT symbol, order_id, {rs('slippage fill_price')}, {r('fill_price * quantity * 10 / 10000')} AS fee FROM f"""))
def market_fills(spark, sf):
    q = V.quotes(spark, sf).filter("channel <> 'view'")
    return shaped(B.market_fills(V.quote_orders(spark, sf), q, 250), columns="symbol order_id slippage fill_price fee")


@query("b16_limit_fills", sql("quotes quote_orders", f"""WITH h AS (SELECT o.symbol, o.order_id, any_value(o.side) AS side, any_value(o.quantity) AS quantity, any_value(o.limit_price) AS lim, min(q.ts) AS fill_ts, arg_min(q.bid, q.ts) AS bid, arg_min(q.ask, q.ts) AS ask
 FROM quote_orders o JOIN quotes q ON o.symbol = q.symbol AND q.ts >= o.ts AND CASE o.side WHEN 'buy' THEN q.ask <= o.limit_price ELSE q.bid >= o.limit_price END GROUP BY 1, 2),
f AS (SELECT *, CASE side WHEN 'buy' THEN least(lim, ask) ELSE greatest(lim, bid) END AS fill_price FROM h)
SELECT symbol, order_id, fill_ts, {r('fill_price')} AS fill_price, {r('fill_price * quantity * 10 / 10000')} AS fee FROM f"""))
def limit_fills(spark, sf):
    return shaped(B.limit_fills(V.quote_orders(spark, sf), V.quotes(spark, sf)), columns="symbol order_id fill_ts fill_price fee")


@query("b17_stop_fills", sql("quotes quote_orders", f"""WITH h AS (SELECT o.symbol, o.order_id, any_value(o.side) AS side, any_value(o.quantity) AS quantity, min(q.ts) AS fill_ts, arg_min(q.bid, q.ts) AS bid, arg_min(q.ask, q.ts) AS ask,
 arg_min(q.bid_qty, q.ts) AS bid_qty, arg_min(q.ask_qty, q.ts) AS ask_qty
 FROM quote_orders o JOIN quotes q ON o.symbol = q.symbol AND q.ts >= o.ts AND CASE o.side WHEN 'buy' THEN (q.bid + q.ask) / 2 >= o.stop_price ELSE (q.bid + q.ask) / 2 <= o.stop_price END GROUP BY 1, 2),
m AS (SELECT * FROM h), {PRICED} SELECT symbol, order_id, fill_ts, {r('fill_price')} AS fill_price, {r('fill_price * quantity * 10 / 10000')} AS fee FROM f"""))
def stop_fills(spark, sf):
    return shaped(B.stop_fills(V.quote_orders(spark, sf), V.quotes(spark, sf)), columns="symbol order_id fill_ts fill_price fee")


@query("b18_latency_shift", sql("ticks", "SELECT symbol, seq, ts + INTERVAL 250 MILLISECOND AS ts FROM ticks"))
def latency_shift(spark, sf):
    return shaped(B.latency_shift(V.ticks(spark, sf), 250), columns="symbol seq ts")


@query("w25_excursions", sql("ticks", f"""WITH t AS (SELECT symbol, seq AS trade_id, ts AS entry_ts, ts + INTERVAL 3 DAY AS exit_ts, price AS entry_price, 1 + seq % 5 AS quantity, CASE WHEN channel IN ('view', 'click') THEN 1 ELSE -1 END AS dir FROM ticks),
m AS (SELECT trade_id, max((price - entry_price) * quantity * dir) AS up, min((price - entry_price) * quantity * dir) AS down FROM t JOIN ticks k ON t.symbol = k.symbol AND k.ts BETWEEN entry_ts AND exit_ts GROUP BY 1)
SELECT trade_id, {r('greatest(up, 0)', 4)} AS mfe, {r('greatest(-down, 0)', 4)} AS mae FROM m"""))
def excursions(spark, sf):
    from tidemark.operators.trades import excursions as run

    t = V.ticks(spark, sf)
    direction = F.when(F.col("channel").isin("view", "click"), 1.0).otherwise(-1.0)
    trades = t.select("symbol", F.col("seq").alias("trade_id"), F.col("ts").alias("entry_ts"), (F.col("ts") + F.expr("interval 3 days")).alias("exit_ts"),
                      F.col("price").alias("entry_price"), (1 + F.col("seq") % 5).cast("double").alias("quantity"), direction.alias("direction"))
    return shaped(run(trades, t, TICKS), 4, "trade_id mfe mae")
