"""Data quality and comparisons: audits, contracts, schema checks, parity, sets, regime comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite, ratio
from .windows import with_quantiles


def column_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, missing, mean, p10, p90) of numeric columns, all columns together."""
    known = {f"_q_{c}": finite(F.col(c)) for c in columns}
    one = df.agg(F.count("*").alias("n"), *[F.struct(F.lit(c).alias("name"), F.avg(finite(F.col(c)).isNull().cast("double")).alias("missing"), F.avg(finite(F.col(c))).alias("mean")).alias(c) for c in columns])
    both = with_quantiles(one, df, known, [0.1, 0.9])
    parts = [F.struct(F.col(c).alias("x"), F.col(f"_q_{c}").alias("q")) for c in columns]
    return both.select("n", F.inline(F.array(*parts))).select("x.name", "n", "x.missing", "x.mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"))


def class_balance(df: DataFrame, y: str) -> DataFrame:
    total = df.agg(F.count("*").alias("_n"))
    return df.groupBy(y).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(y, "n", (F.col("n") / F.col("_n")).alias("share"))  # one row


def column_difference(have: list[str], want: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) column names, in the order given."""
    return [c for c in want if c not in have], [c for c in have if c not in want]


def contract(df: DataFrame, required: list[str], ts: str) -> tuple[list[str], DataFrame]:
    """(missing columns, (name, nulls, first_ts, last_ts) of those that are there)."""
    there = [c for c in required if c in df.columns]
    one = df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *[F.struct(F.lit(c).alias("name"), F.count_if(finite(F.col(c)).isNull()).alias("nulls")).alias(c) for c in there])
    rows = one.select("first_ts", "last_ts", F.explode(F.array(*there)).alias("x")).select("x.name", "x.nulls", "first_ts", "last_ts")
    return [c for c in required if c not in df.columns], rows


def schema_check(df: DataFrame, numeric: list[str], allowed: dict[str, list[str]]) -> tuple[dict[str, list[str]], DataFrame]:
    """(missing, extra and boolean columns, (name, bad) counts of infinite numbers and categories that are not allowed)."""
    want = [*numeric, *allowed]
    missing, extra = column_difference(df.columns, want)
    booleans = [c for c in numeric if c in df.columns and isinstance(df.schema[c].dataType, T.BooleanType)]
    checks: dict[str, Column] = {c: F.abs(F.col(c).cast("double")) == float("inf") for c in numeric if c in df.columns and c not in booleans}
    checks |= {c: ~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in allowed.items() if c in df.columns}
    one = df.agg(*[F.struct(F.lit(c).alias("name"), F.count_if(x).alias("bad")).alias(c) for c, x in checks.items()])
    return {"missing": missing, "extra": extra, "boolean": booleans}, one.select(F.inline(F.array(*checks)))


def is_close(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def parity(got: DataFrame, expected: DataFrame, keys: list[str], columns: list[str], rtol: float = 1e-6, atol: float = 1e-8) -> DataFrame:
    """(name, n, differ, worst) of columns in both tables on common keys; a null against a value differs."""
    both = got.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns]).join(expected.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns]), keys)
    part = lambda c: F.struct(F.lit(c).alias("name"), F.count_if(~F.coalesce(is_close(F.col(f"a_{c}"), F.col(f"b_{c}"), rtol, atol), F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())).alias("differ"), F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias("worst"))
    one = both.agg(F.count("*").alias("n"), *[part(c).alias(c) for c in columns])
    return one.select("n", F.inline(F.array(*columns)))


def compare_series(a: DataFrame, b: DataFrame, keys: list[str], value: str, code: str) -> DataFrame:
    """(n, mae, worst, accuracy) of two series on common keys."""
    both = a.select(*keys, F.col(value).alias("x"), F.col(code).alias("p")).join(b.select(*keys, F.col(value).alias("y"), F.col(code).alias("q")), keys)
    return both.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"), F.max(F.abs(F.col("x") - F.col("y"))).alias("worst"), F.avg(F.col("p").eqNullSafe(F.col("q")).cast("double")).alias("accuracy"))


def ewm_alpha(df: DataFrame, x: str, y: str, by: list[str], order: str) -> DataFrame:
    """(by, alpha): median of (y - y1) / (x - y1) inside (0, 1)."""
    prev = F.lag(y).over(Window.partitionBy(*by).orderBy(order))
    a = ratio(F.col(y) - prev, F.col(x) - prev)
    each = df.withColumn("_a", a).where("_a > 0 and _a < 1")
    return with_quantiles(each.select(*by).distinct(), each, {"_q": F.col("_a")}, [0.5], by).select(*by, F.col("_q")[0].alias("alpha"))


def drivers(df: DataFrame, code: str, columns: list[str], quantiles: tuple[float, ...] = (0.01, 0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """(code, driver, n, quantiles): spread of each driver within each code."""
    one = df.groupBy(code).agg(*[F.count(c).alias(f"_n_{c}") for c in columns])
    both = with_quantiles(one, df, {f"_q_{c}": F.col(c) for c in columns}, list(quantiles), [code])
    return both.select(code, F.inline(F.array(*[F.struct(F.lit(c).alias("driver"), F.col(f"_n_{c}").alias("n"), F.col(f"_q_{c}").alias("q")) for c in columns])))


def functional_dependency(df: DataFrame, determinants: list[str], dependent: str) -> DataFrame:
    """(tuples, most): number of determinant tuples and the most values of dependent that one has; 1 where it is a function."""
    return df.groupBy(*determinants).agg(F.count_distinct(dependent).alias("k")).agg(F.count("*").alias("tuples"), F.max("k").alias("most"))


def slope_source(df: DataFrame, slope: str, bases: list[str]) -> DataFrame:
    """(base, mae): mean distance of each candidate's change from the slope column, all bases in one pass."""
    w = Window.partitionBy("symbol").orderBy("ts")
    parts = [(F.col(b) - F.lag(b).over(w)).alias(f"_{b}") for b in bases]
    one = df.select(slope, *parts).agg(*[F.struct(F.lit(b).alias("base"), F.avg(F.abs(F.col(f"_{b}") - F.col(slope))).alias("mae")).alias(b) for b in bases])
    return one.select(F.inline(F.array(*bases)))


def ablation(metrics: DataFrame, baseline: str, brier_gain: float, auc_loss: float) -> DataFrame:
    """metrics (feature, auc, brier) with differences from the baseline row, and whether to disable the feature."""
    base = metrics.where(F.col("feature") == baseline).select(F.col("auc").alias("_a"), F.col("brier").alias("_b"))
    out = metrics.where(F.col("feature") != baseline).crossJoin(F.broadcast(base))  # one row
    out = out.withColumns({"d_auc": F.col("auc") - F.col("_a"), "d_brier": F.col("brier") - F.col("_b")}).drop("_a", "_b")
    return out.withColumn("disable", (F.col("d_brier") < brier_gain) & (F.col("d_auc") >= -auc_loss))


def universe_sync(target: DataFrame, existing: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, state) with state added, removed or kept."""
    t, e = target.select(key).distinct().withColumn("_t", F.lit(True)), existing.select(key).distinct().withColumn("_e", F.lit(True))
    state = F.when(F.col("_e").isNull(), "added").when(F.col("_t").isNull(), "removed").otherwise("kept")
    return t.join(e, key, "full").select(key, state.alias("state"))


def usdt_perps(markets: DataFrame) -> DataFrame:
    """(symbol) of active linear swaps quoted and settled in USDT; an empty id is made of base and quote."""
    ok = (F.col("quote") == "USDT") & (F.coalesce("settle", "quote") == "USDT") & F.col("swap") & F.col("linear") & F.coalesce("active", F.lit(True))
    name = F.upper(F.regexp_replace(F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.concat("base", "quote")), "[^A-Za-z0-9]", ""))
    return markets.where(ok & name.rlike("USDT$")).select(name.alias("symbol")).distinct()


def head_tail(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first and last n rows of each class."""
    up, down = Window.partitionBy(by).orderBy(*order), Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return df.withColumns({"_a": F.row_number().over(up), "_b": F.row_number().over(down)}).where((F.col("_a") <= n) | (F.col("_b") <= n)).drop("_a", "_b")


def closest(df: DataFrame, p: str, threshold: float, order: str, n: int) -> DataFrame:
    """The n rows nearest to a threshold, with ABOVE or BELOW."""
    return df.withColumns({"gap": F.abs(F.col(p) - threshold), "side": F.when(F.col(p) >= threshold, "ABOVE").otherwise("BELOW")}).orderBy("gap", order).limit(n)


def cut_points(df: DataFrame) -> DataFrame:
    """Regime cut points: funding eps, open-interest terciles (z-score, else daily change), high volatility."""
    values = {"f": F.abs("funding_rate"), "z": F.col("oi_z_7d"), "c": F.col("oi_pct_1d"), "v": F.col("vol_level")}
    one = with_quantiles(df.agg(F.count("*").alias("n")), df, values, [0.2, 0.33, 0.66])
    at = lambda name, k: F.col(name)[k]
    return one.select(F.greatest(at("f", 0), F.lit(1e-8)).alias("funding_eps"), F.coalesce(at("z", 1), at("c", 1)).alias("oi_q33"), F.coalesce(at("z", 2), at("c", 2)).alias("oi_q66"), F.coalesce(at("v", 2), F.lit(1.0)).alias("vol_high"))


def macro_reduce(df: DataFrame, columns: list[str], tf: str) -> DataFrame:
    """One row for each time (first known value by symbol), then the first for each bucket of tf."""
    from .bars import bucket

    first = lambda c, order: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    each = df.groupBy("ts").agg(*[first(c, F.col("symbol")) for c in columns])
    return each.groupBy(bucket(F.col("ts"), tf).alias("bucket")).agg(*[first(c, F.col("ts")) for c in columns])
