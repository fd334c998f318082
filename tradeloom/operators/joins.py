"""Joins of trades, bars, fills and statements: windows of time by cells, one-to-one checks, allocation, universes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, timeframe_seconds
from ..sources.staging import staged


def trailing_windows(points: DataFrame, events: DataFrame, keys: list[str], width_us: int, running: dict[str, Callable[[Column], Column]], merged: dict[str, Column]) -> DataFrame:
    """(keys, _at, merged): what the events (keys, ts, _x) from _at - width_us to _at, both included, give for each of the points (keys, _at), which must be distinct.

    In cells of just that width a window is the end of one cell and the beginning of the next: two running values, one from each side, and no pair of a point with an event.
    running: by name, the aggregate of _x of which a running value is kept; merged puts its two halves, `name_old` and `name_new`, together.
    """
    cell = lambda c: F.floor(F.col(c) / width_us)
    span = lambda t, d: (t - d * width_us).alias("_t")
    known = lambda df, *c: df.where(" and ".join(f"{k} is not null" for k in (*keys, *c)))
    e = known(events, "ts").select(*keys, F.unix_micros("ts").alias("_t"), F.lit(0).alias("_side"), "_x")
    p = known(points, "_at").select(*keys, "_at", F.unix_micros("_at").alias("_end"))
    both = e
    for side, d in ((1, 0), (2, 1)):
        both = both.unionByName(p.select(*keys, "_at", span(F.col("_end"), d), F.lit(side).alias("_side")), allowMissingColumns=True)
    both = both.withColumn("_cell", cell("_t"))
    w = Window.partitionBy(*keys, "_cell")
    up, down = (w.orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0) for t in ("_t", F.desc("_t")))
    halves = both.withColumns({f"{n}_{h}": f("_x").over(o) for n, f in running.items() for h, o in (("new", up), ("old", down))}).where("_side > 0")
    one = lambda n, h, side: F.max(F.when(F.col("_side") == side, F.struct(F.col(f"{n}_{h}").alias("v"))))["v"].alias(f"{n}_{h}")
    each = halves.groupBy(*keys, "_at").agg(*[one(n, h, side) for n in running for h, side in (("new", 1), ("old", 2))])
    return each.select(*keys, "_at", *[v.alias(n) for n, v in merged.items()])


#: Time that the smallest cell of range aggregates spans.
CELL = "1h"


def range_cells(bars: DataFrame, levels: int, cell: str = CELL) -> DataFrame:
    """(symbol, level, m, lo, hi, n): least low, highest high and number of the bars of 2^level cells of time, from m * 2^level cells on; levels 0 to `levels`.

    A level has half the rows of the one below, so all have twice the cells that hold bars; bars are combined to cells first.
    """
    base = bars.groupBy("symbol", _cell("ts", cell).alias("m")).agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.count("*").alias("n"))
    up = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("m", F.call_function("shiftright", "m", "level"))
    return up.groupBy("symbol", "level", "m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def _cell(ts: str, cell: str) -> Column:
    return F.floor(F.unix_micros(ts) / (timeframe_seconds(cell) * 1_000_000))


def covering_cells(start: Column, end: Column, levels: int) -> Column:
    """Cells (level, m) that together are the cells start .. end - 1 of level 0: at most two of each level.

    From the lowest level up, an odd start or end is taken by itself, and what is left is halved.
    """
    cell = lambda level, m: F.struct(level.alias("level"), m.alias("m"))
    none = F.expr("cast(array() as array<struct<level: int, m: bigint>>)")
    odd = lambda x: x.bitwiseAND(1) == 1

    def step(acc: Column, level: Column) -> Column:
        first = (acc["s"] < acc["e"]) & odd(acc["s"])
        s = acc["s"] + first.cast("long")
        last = (s < acc["e"]) & odd(acc["e"])
        e = acc["e"] - last.cast("long")
        cells = F.concat(acc["cells"], F.when(first, F.array(cell(level, acc["s"]))).otherwise(none), F.when(last, F.array(cell(level, e))).otherwise(none))
        half = lambda x: F.call_function("shiftright", x, F.lit(1))
        return F.struct(half(s).alias("s"), half(e).alias("e"), cells.alias("cells"))

    begin = F.struct(start.cast("long").alias("s"), end.cast("long").alias("e"), none.alias("cells"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), begin, step, lambda acc: acc["cells"])


def trade_cells(trades: DataFrame, levels: int, cell: str = CELL) -> DataFrame:
    """(id, symbol, opened_at, closed_at, level, m): the cells inside each trade, and as level -1 the cells that it opens and closes in."""
    t = trades.select("id", "symbol", "opened_at", "closed_at").where("opened_at <= closed_at").withColumns({"_s": _cell("opened_at", cell), "_e": _cell("closed_at", cell)})
    edge = lambda m: F.struct(F.lit(-1).alias("level"), F.col(m).alias("m"))
    edges = F.when(F.col("_s") == F.col("_e"), F.array(edge("_s"))).otherwise(F.array(edge("_s"), edge("_e")))
    return t.select("id", "symbol", "opened_at", "closed_at", F.inline(F.concat(edges, covering_cells(F.col("_s") + 1, F.col("_e"), levels))))


def trade_extremes(trades: DataFrame, bars: DataFrame, cell: str = CELL) -> DataFrame:
    """(id, lo, hi, n_bars) of the bars from opened_at to closed_at; trades without bars are absent.  Ids must be unique.

    Least and highest prices of cells of time by powers of two are made once; a trade reads at most two cells of each level, however long it is,
    and bars only in the cells that it opens and closes in.
    """
    # trades of one symbol, open and close read the same bars: each such interval is looked up once
    spans = staged(trades.where("opened_at <= closed_at").select("symbol", "opened_at", "closed_at").distinct(), "trade-spans")
    longest = spans.agg(F.max(_cell("closed_at", cell) - _cell("opened_at", cell))).first()[0] or 0
    levels = max(0, int(longest).bit_length())
    inside = range_cells(bars, levels, cell).withColumn("at", F.lit(None).cast("timestamp"))
    single = bars.select("symbol", F.lit(-1).alias("level"), _cell("ts", cell).alias("m"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.lit(1).cast("long").alias("n"), F.col("ts").cast("timestamp").alias("at"))
    key = ["symbol", "opened_at", "closed_at"]
    met = trade_cells(spans.withColumn("id", F.lit(0)), levels, cell).join(inside.unionByName(single), ["symbol", "level", "m"])
    met = met.where((F.col("level") >= 0) | F.col("at").between(F.col("opened_at"), F.col("closed_at")))
    found = staged(met.groupBy(*key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n_bars")), "trade-extremes")
    return trades.select("id", *key).join(found, key).select("id", "lo", "hi", "n_bars")


def excursions(trades: DataFrame, extremes: DataFrame) -> DataFrame:
    """mae_usd, mfe_usd (at least 0) and their multiples of risk_usd."""
    short = F.lower("side") == "short"
    size = F.abs("size")
    adverse = F.when(short, F.col("hi") - F.col("entry")).otherwise(F.col("entry") - F.col("lo"))
    gain = F.when(short, F.col("entry") - F.col("lo")).otherwise(F.col("hi") - F.col("entry"))
    out = trades.join(extremes, "id").withColumns({"mae_usd": F.greatest(F.lit(0.0), adverse) * size, "mfe_usd": F.greatest(F.lit(0.0), gain) * size})
    return out.withColumns({"mae_r": ratio(F.col("mae_usd"), F.col("risk_usd")), "mfe_r": ratio(F.col("mfe_usd"), F.col("risk_usd"))})


def exits_from_bars(trades: DataFrame, bars: DataFrame, atr: DataFrame, times_atr: float, slop_bps: float) -> DataFrame:
    """trades with implied_stop (risk_usd / size from the entry), tp_proxy (ATR as of the open) and the reason that the bars' extremes tell.

    SL before TL (closed within a minute of exit_deadline) before TP; without bars, or when nothing fits: UNKNOWN.  atr: (symbol, ts, atr).
    """
    from .asof import asof_join

    long = F.lower("side") == "long"
    with_atr = asof_join(trades.withColumn("ts", F.col("opened_at")), atr.where("atr is not null"), ["symbol"], ["atr"]).drop("ts")
    step = ratio(F.col("risk_usd"), F.abs("size"))
    out = with_atr.withColumns({"implied_stop": F.col("entry") - F.when(long, step).otherwise(-step), "tp_proxy": F.col("entry") + F.when(long, times_atr).otherwise(-times_atr) * F.col("atr")}).drop("atr")
    out = out.join(trade_extremes(trades, bars), "id", "left")
    tol = F.col("entry") * slop_bps / 1e4
    stopped = F.when(long, F.col("lo") <= F.col("implied_stop") + tol).otherwise(F.col("hi") >= F.col("implied_stop") - tol)
    late = F.abs(F.unix_micros("closed_at") - F.unix_micros("exit_deadline")) <= 60_000_000
    taken = F.when(long, F.col("hi") >= F.col("tp_proxy") - tol).otherwise(F.col("lo") <= F.col("tp_proxy") + tol)
    reason = F.when(F.col("lo").isNull() | F.col("entry").isNull(), "UNKNOWN").when(stopped, "SL").when(late, "TL").when(taken, "TP").otherwise("UNKNOWN")
    return out.withColumn("exit_from_bars", reason).drop("lo", "hi", "n_bars")


def enrichment_extract(trades: DataFrame, oi: DataFrame, funding: DataFrame, path: str | None = None) -> DataFrame:
    """(id, symbol, opened_at, funding_last_at_entry, oi_last_at_entry, oi_delta_pct_win) of each trade; with a path, also written there as CSV with a header."""
    out = window_enrichment(trades, oi, funding).select("id", "symbol", "opened_at", F.col("funding_last").alias("funding_last_at_entry"), F.col("oi_last").alias("oi_last_at_entry"), F.col("oi_delta").alias("oi_delta_pct_win"))
    if path:
        out.write.mode("overwrite").option("header", True).csv(path)
    return out


def window_enrichment(trades: DataFrame, oi: DataFrame, funding: DataFrame, hours: int = 8) -> DataFrame:
    """trades (id, symbol, opened_at, ...) with the last funding, last open interest and its relative change in the hours up to the open.

    The change needs two points and a first one other than 0.
    """
    points = staged(trades.select("symbol", F.col("opened_at").alias("_at")).distinct(), "window-points")
    running = {"last": lambda x: F.max(x), "first": lambda x: F.min(x), "n": lambda x: F.count(x)}
    merged = {"_last": F.coalesce("last_new", "last_old"), "_first": F.coalesce("first_old", "first_new"), "_n": F.col("n_old") + F.col("n_new")}

    def windows(series: DataFrame) -> DataFrame:
        x = F.struct("ts", F.col("value").alias("v")).alias("_x")
        return trailing_windows(points, series.select("symbol", "ts", x), ["symbol"], hours * 3_600_000_000, running, merged)

    o = windows(oi).select("symbol", "_at", F.col("_last.v").alias("oi_last"), F.when(F.col("_n") >= 2, ratio(F.col("_last.v"), F.col("_first.v")) - 1).alias("oi_delta"))
    f = windows(funding).select("symbol", "_at", F.col("_last.v").alias("funding_last"))
    # as many rows as distinct opens of a symbol; staged, so that Spark knows whether they can be broadcast to the trades
    found = staged(o.join(f, ["symbol", "_at"]), "windows").withColumnRenamed("symbol", "_symbol")
    same = (F.col("symbol") == F.col("_symbol")) & (F.col("opened_at") == F.col("_at"))
    return trades.join(found, same, "left").select(*trades.columns, "oi_last", "funding_last", "oi_delta")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(inner join, keys that repeat on either side); the second must be empty for the first to be one-to-one."""
    repeats = left.select(*keys, F.lit("left").alias("side")).unionByName(right.select(*keys, F.lit("right").alias("side"))).groupBy(*keys, "side").agg(F.count("*").alias("n")).where("n > 1")
    return left.join(right, keys), repeats


def match_candidates(statements: DataFrame, positions: DataFrame, tol: float) -> DataFrame:
    """Statement rows and positions of one symbol whose sizes and prices differ relatively by at most tol, with the gap in seconds.

    statements: statement_id, symbol, qty, entry, closed_at; positions: position_id, symbol, size, entry_price, opened_at.
    Prices and sizes meet by logarithmic cells (a row looks into three of each), so a symbol's rows are not all paired; sizes of 0 have a cell of their own.
    """
    width = 2 * tol + 1e-9
    cell = lambda x: F.coalesce(F.floor(F.log(F.abs(x)) / width).cast("long"), F.lit(-(1 << 62)))
    around = lambda x: F.explode(F.array_distinct(F.array(*[F.when(F.abs(x) > 0, cell(x) + k).otherwise(cell(x)) for k in (-1, 0, 1)])))
    s = statements.where("entry > 0").withColumn("_price_cell", around(F.col("entry"))).withColumn("_size_cell", around(F.col("qty")))
    p = positions.where("entry_price > 0").withColumns({"_price_cell": cell(F.col("entry_price")), "_size_cell": cell(F.col("size"))})
    close = lambda a, b: F.abs(a - b) <= tol * F.greatest(F.abs(a), F.abs(b))
    both = s.join(p, ["symbol", "_price_cell", "_size_cell"]).where(close(F.col("qty"), F.col("size")) & close(F.col("entry"), F.col("entry_price")) & (F.col("opened_at") <= F.col("closed_at")))
    return both.withColumn("gap", F.abs(F.unix_micros("closed_at") - F.unix_micros("opened_at")) / 1e6).drop("_price_cell", "_size_cell")


def unmatched(statements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Statement rows that no position matches."""
    return statements.join(candidates.select("statement_id").distinct(), "statement_id", "left_anti")


def nearest_match(candidates: DataFrame) -> DataFrame:
    """Each statement's nearest position, which other statements may take as well."""
    w = Window.partitionBy("statement_id").orderBy("gap", "position_id")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def exchange_check(positions: DataFrame, exchange: DataFrame, pad: str, tol: float) -> DataFrame:
    """Positions whose size the exchange's trades near the open or the close do not show.

    exchange: symbol, ts, trade_side, amount, price.  Result: id, kind (ENTRY_ or EXIT_SIZE_MISMATCH), expected, found, vwap.
    Symbols that the exchange side lacks are skipped.
    """
    micros = timeframe_seconds(pad) * 1_000_000
    worth = F.struct(F.sum("amount").alias("a"), F.sum(F.col("amount") * F.col("price")).alias("v")).alias("_x")
    x = staged(exchange.groupBy("symbol", F.col("trade_side").alias("_want"), "ts").agg(worth), "exchange-times")
    known = positions.join(x.select("symbol").distinct(), "symbol", "left_semi")
    t = None
    for kind, at, buys in (("ENTRY_SIZE_MISMATCH", "opened_at", "long"), ("EXIT_SIZE_MISMATCH", "closed_at", "short")):
        part = known.select("id", F.lit(kind).alias("kind"), F.abs("size").alias("expected"), "symbol", F.when(F.lower("side") == buys, "buy").otherwise("sell").alias("_want"), (F.timestamp_micros(F.unix_micros(at) + micros)).alias("_at"))
        t = part if t is None else t.unionByName(part)
    points = t.select("symbol", "_want", "_at").distinct()
    running = {"a": lambda x: F.sum(F.col(f"{x}.a")), "v": lambda x: F.sum(F.col(f"{x}.v"))}
    both = lambda c: F.coalesce(F.col(f"{c}_old") + F.col(f"{c}_new"), f"{c}_old", f"{c}_new")
    got = staged(trailing_windows(points, x, ["symbol", "_want"], 2 * micros, running, {"_a": both("a"), "_v": both("v")}), "exchange-windows")
    out = t.join(got, ["symbol", "_want", "_at"], "left").select("id", "kind", "expected", F.coalesce("_a", F.lit(0.0)).alias("found"), ratio(F.col("_v"), F.col("_a")).alias("vwap"))
    return out.where(F.abs(F.col("expected") - F.col("found")) > tol)


def backfill_entry(positions: DataFrame, fills: DataFrame) -> DataFrame:
    """positions with null size or entry_price filled from their entry fills: sum of |q|, and |q|-weighted price."""
    q = F.abs("qty")
    f = fills.where("fill_type = 'ENTRY'").groupBy(F.col("position_id").alias("id")).agg(F.sum(q).alias("_q"), ratio(F.sum(q * F.col("price")), F.sum(q)).alias("_p"))
    return positions.join(f, "id", "left").withColumns({"size": F.coalesce("size", "_q"), "entry_price": F.coalesce("entry_price", "_p")}).drop("_q", "_p")


def allocate_exits(need: DataFrame, closing: DataFrame) -> DataFrame:
    """(id, exit_qty, exit_price, exit_fees, exit_at): closing trades in order of time until the size is filled, the last one in part.

    need: id, size; closing: id, ts, seq, qty, price, fee.
    """
    w = Window.partitionBy("id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = closing.join(need, "id").withColumn("_before", F.coalesce(F.sum("qty").over(w), F.lit(0.0)))
    rows = rows.withColumn("_use", F.greatest(F.lit(0.0), F.least(F.col("qty"), F.col("size") - F.col("_before")))).where("_use > 0")
    return rows.groupBy("id").agg(F.sum("_use").alias("exit_qty"), ratio(F.sum(F.col("_use") * F.col("price")), F.sum("_use")).alias("exit_price"), F.sum(F.col("fee") * F.col("_use") / F.col("qty")).alias("exit_fees"), F.max("ts").alias("exit_at"))


def universe(symbols: DataFrame, invalid: DataFrame, categories: DataFrame | None = None, banned: list[str] | None = None) -> DataFrame:
    """symbols less the invalid ones and those in a banned category (symbol, categories array<string>)."""
    out = symbols.join(invalid.select("symbol"), "symbol", "left_anti")
    if categories is not None and banned:
        lower = F.transform("categories", F.lower)
        out = out.join(categories.where(F.arrays_overlap(lower, F.array(*[F.lit(b.lower()) for b in banned]))).select("symbol"), "symbol", "left_anti")
    return out


def with_listing_age(rows: DataFrame, listed: DataFrame, first_bars: DataFrame, on: str = "ts") -> DataFrame:
    """rows with age_days: whole days since the listing, or the first bar where no listing is known; never below 0."""
    out = rows.join(listed.select("symbol", "listed_at"), "symbol", "left").join(first_bars.select("symbol", "first_ts"), "symbol", "left")
    age = F.floor((F.unix_micros(on) - F.unix_micros(F.coalesce("listed_at", "first_ts"))) / 86_400e6)
    return out.withColumn("age_days", F.when(age.isNotNull(), F.greatest(F.lit(0), age)).cast("long")).drop("first_ts")


def with_assets(rows: DataFrame, bars: DataFrame, assets: list[str], columns: list[str], on: str = "ts") -> DataFrame:
    """rows with `asset_column` as of their time, for each asset; null after the least of the assets' last times.

    Rows and bars meet by day: each day also gets the asset's last bar before it, so days are joined in tasks of their own.  What goes
    through one task for each asset is one row a day.
    """
    from .asof import asof_join

    some = bars.where(F.col("symbol").isin(assets)).select("symbol", "ts", F.struct(*columns).alias("_v"), F.to_date("ts").alias("_day"))
    end = some.groupBy("symbol").agg(F.max("ts").alias("e")).agg(F.min("e").alias("_end"))
    newest = some.groupBy("symbol", "_day").agg(F.max(F.struct("ts", "_v")).alias("_x"))
    days = newest.groupBy("symbol").agg(F.min("_day").alias("_a"), F.max("_day").alias("_b")).select("symbol", F.explode(F.sequence("_a", "_b")).alias("_day"))
    before = Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.join(newest, ["symbol", "_day"], "left").withColumn("_x", F.last("_x", ignorenulls=True).over(before)).where("_x is not null")
    all_bars = some.select("symbol", "_day", "ts", "_v").unionByName(carried.select("symbol", "_day", "_x.ts", "_x._v"))
    out = rows.withColumn("_day", F.to_date(on))
    for a in assets:
        own = all_bars.where(F.col("symbol") == a).select("_day", F.col("ts").alias(on), *[F.col(f"_v.{c}").alias(f"{a.lower()}_{c}") for c in columns])
        out = asof_join(out, own, ["_day"], [f"{a.lower()}_{c}" for c in columns], on=on)
    names = [f"{a.lower()}_{c}" for a in assets for c in columns]
    return out.drop("_day").crossJoin(F.broadcast(end)).withColumns({n: F.when(F.col(on) <= F.col("_end"), F.col(n)) for n in names}).drop("_end")  # one row
