"""Predictions: thresholds, bins, calibration errors, rank metrics, folds, bootstrap."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.staging import staged
from .windows import with_order_index, with_quantiles, with_running


def dedup_mean(preds: DataFrame) -> DataFrame:
    """One row for each (entry_ts, symbol): mean p, first y by id."""
    return preds.groupBy("entry_ts", "symbol").agg(F.avg("p").alias("p"), F.min_by("y", "id").alias("y"))


def sweep(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n, win_rate, avg_pnl, sum_pnl) of rows with p >= threshold; thresholds that none reaches stay with n = 0.

    Rows are counted once by the highest threshold they reach, then summed from above.
    """
    ts = sorted(thresholds)
    cell = F.when(F.lit(False), -1)
    for k in reversed(range(len(ts))):
        cell = cell.when(F.col("p") >= ts[k], k)
    sums = df.withColumn("k", cell).where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.sum((F.col("pnl") > 0).cast("long")).alias("w"), F.sum("pnl").alias("s"))
    grid = df.sparkSession.createDataFrame(list(enumerate(ts)), "k int, threshold double")
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)  # as many rows as thresholds
    out = grid.join(sums, "k", "left").withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(up) for c in ("n", "w", "s")})
    return out.select("threshold", "n", ratio(F.col("w").cast("double"), F.col("n").cast("double")).alias("win_rate"), ratio(F.col("s"), F.col("n").cast("double")).alias("avg_pnl"), F.when(F.col("n") > 0, F.col("s")).otherwise(0.0).alias("sum_pnl"))


def ev_curve(df: DataFrame, thresholds: list[float], least: int = 1) -> DataFrame:
    """(threshold, n, win_rate, ev_r): share won times mean gain less share lost times mean loss, in R; r <= 0 is a loss."""
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    win = F.col("r") > 0
    # a threshold's rows meet in partial sums on the map side: as many groups as thresholds
    each = df.withColumn("threshold", grid).where("p >= threshold").groupBy("threshold").agg(F.count("*").alias("n"), F.avg(F.coalesce(win, F.lit(False)).cast("double")).alias("win_rate"), F.avg(F.when(win, F.col("r"))).alias("_g"), F.avg(F.when(~win, -F.col("r"))).alias("_l"))
    ev = F.col("win_rate") * F.coalesce("_g", F.lit(0.0)) - (1 - F.col("win_rate")) * F.coalesce("_l", F.lit(0.0))
    return each.where(F.col("n") >= least).select("threshold", "n", "win_rate", ev.alias("ev_r"))


def cost_aware_sweep(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n, win_rate, ev_r): mean p times mean gain less (1 - mean p) times mean loss, in R, of rows with p >= threshold.

    Where no row of a threshold has an R, wins are told by pnl and ev_r is null; it is null without a gain or a loss, too.  Thresholds that none reaches stay with n = 0.
    """
    each = df.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where("p >= threshold")
    share = lambda won: F.avg(F.coalesce(won, F.lit(False)).cast("double"))
    won = F.col("r") > 0
    lost = ~F.coalesce(won, F.lit(False))
    sums = each.groupBy("threshold").agg(F.count("*").alias("n"), F.when(F.count("r") > 0, share(won)).otherwise(share(F.col("pnl") > 0)).alias("win_rate"), F.avg("p").alias("_p"), F.avg(F.when(won, F.col("r"))).alias("_g"), F.avg(F.when(lost, -F.col("r"))).alias("_l"))
    grid = df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return grid.join(sums, "threshold", "left").select("threshold", F.coalesce("n", F.lit(0)).alias("n"), "win_rate", (F.col("_p") * F.col("_g") - (1 - F.col("_p")) * F.col("_l")).alias("ev_r"))


def best_threshold(curve: DataFrame, value: str, least: int) -> DataFrame:
    """The row of the largest value among thresholds with at least `least` trades; of ties the lowest threshold."""
    return curve.where(F.col("n") >= least).orderBy(F.desc(value), "threshold").limit(1)


def rank_bins(df: DataFrame, x: str, y: str, tie: str, bins: int) -> DataFrame:
    """(bin, n, x_mean, y_rate, lift) of equal-count bins by the rank of x, ties by `tie`.

    The rank comes from `windows.with_order_index`, which needs no single task.
    """
    ranked = with_order_index(df.select(x, y, tie).where(F.col(x).isNotNull()), [x, tie], "_i")
    totals = ranked.agg(F.count("*").alias("_n"), F.avg(y).alias("_base"))
    last = F.greatest(F.lit(1), F.col("_n") - 1)
    cell = F.greatest(F.lit(0), F.floor((F.col("_i") * bins + last - 1) / last) - 1).cast("int")
    return ranked.crossJoin(F.broadcast(totals)).withColumn("bin", cell).groupBy("bin").agg(F.count("*").alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_rate"), (F.avg(y) / (F.first("_base") + 1e-9)).alias("lift"))  # one row


def value_bins(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """(bin, n, p_mean, y_rate) of bins between distinct quantiles of p, right-closed; the first takes the least value."""
    q = [k / bins for k in range(bins + 1)]
    edges = with_quantiles(df.agg(F.count("*").alias("_rows")), df, {"_e": F.col(p)}, q).select(F.array_distinct("_e").alias("_e"))
    cell = F.greatest(F.lit(1), F.size(F.filter("_e", lambda e: e < F.col(p)))) - 1
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", cell).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("p_mean"), F.avg(y).alias("y_rate"))  # one row


def feature_bins(df: DataFrame, x: str, y: str, result: str, bins: int) -> DataFrame:
    """(bin, n, x_low, x_high, win_rate, mean_result, lift) of bins between distinct quantiles of a feature; lift against the win rate of all rows."""
    some = df.where(F.col(x).isNotNull())
    base = some.agg(F.avg(F.col(y).cast("double")).alias("_base"))
    edges = with_quantiles(base, some, {"_e": F.col(x)}, [k / bins for k in range(bins + 1)]).withColumn("_e", F.array_distinct("_e"))
    cell = F.greatest(F.lit(1), F.size(F.filter("_e", lambda e: e < F.col(x)))) - 1
    each = some.crossJoin(F.broadcast(edges)).groupBy(cell.alias("bin"))  # one row
    return each.agg(F.count("*").alias("n"), F.min(x).alias("x_low"), F.max(x).alias("x_high"), F.avg(F.col(y).cast("double")).alias("win_rate"), F.avg(result).alias("mean_result"), ratio(F.avg(F.col(y).cast("double")), F.first("_base")).alias("lift"))


def width_bin(p: Column, bins: int, right_closed: bool) -> Column:
    """Equal-width bin of a probability, clipped to 0 .. bins-1."""
    raw = F.ceil(p * bins) - 1 if right_closed else F.floor(p * bins)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)).cast("int")


def ece(df: DataFrame, p: str, y: str, cell: Column) -> DataFrame:
    """(ece): mean distance of bins' accuracy and confidence, weighted by rows."""
    each = df.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("c"), F.avg(y).alias("a"))
    return ece_of_bins(each, "n", "c", "a")


def ece_of_bins(bins: DataFrame, n: str, conf: str, acc: str) -> DataFrame:
    return bins.agg((F.sum(F.col(n) * F.abs(F.col(acc) - F.col(conf))) / F.sum(n)).alias("ece"))


def auc_brier(df: DataFrame, p: str, y: str, by: list[str] = ()) -> DataFrame:
    """(by, auc, brier, brier_base, accuracy): ranks by average over ties, from counts of each distinct p; places run over all groups at once."""
    each = df.groupBy(*by, p).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("k"), F.sum(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("b"), F.sum(((F.col(p) >= 0.5) == (F.col(y) == 1)).cast("double")).alias("hit"))
    ranked = with_running(each, [*by, p], {"before": F.col("n")}).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    s = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), (F.sum(F.col("rank") * F.col("k")) - F.min("before") * F.sum("k")).alias("r"), F.sum("b").alias("b"), F.sum("hit").alias("hit"))
    return s.select(*by, ratio(F.col("r") - F.col("k") * (F.col("k") + 1) / 2, F.col("k") * (F.col("n") - F.col("k"))).alias("auc"), (F.col("b") / F.col("n")).alias("brier"), (F.col("k") / F.col("n") * (1 - F.col("k") / F.col("n"))).alias("brier_base"), (F.col("hit") / F.col("n")).alias("accuracy"))


def resolution(df: DataFrame, raw: str, cal: str) -> DataFrame:
    """Population deviation ratio and share of distinct values (rounded to 6) of cal against raw."""
    distinct = lambda c: F.count_distinct(F.round(c, 6)).cast("double")
    return df.agg(ratio(F.stddev_pop(cal), F.stddev_pop(raw)).alias("std_ratio"), ratio(distinct(cal), distinct(raw)).alias("unique_ratio"))


def erf(x: Column) -> Column:
    """Error function to 1.2e-7 (Abramowitz and Stegun 7.1.26 refined by its Chebyshev form)."""
    # Coefficients of the published rational Chebyshev approximation of erfc.
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = 1 / (1 + 0.5 * F.abs(x))
    poly = F.lit(c[-1])
    for v in reversed(c[:-1]):
        poly = poly * t + v
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, 1 - tail).otherwise(tail - 1)


def deflated_sharpe(df: DataFrame, r: str, by: list[str], trials: int, least: int = 10) -> DataFrame:
    """(by, n, sharpe, psr, dsr): probability that the Sharpe ratio exceeds 0, and the same after `trials` tries."""
    each = df.where(F.col(r).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s")).where((F.col("n") >= least) & (F.col("_s") > 0))
    out = each.withColumn("sharpe", F.col("_m") / F.col("_s"))
    out = out.withColumn("psr", 0.5 * (1 + erf(F.col("sharpe") * F.sqrt(F.col("n") - 1) / 2**0.5)))
    return out.withColumn("dsr", F.greatest(F.lit(0.0), 1 - (1 - F.col("psr")) * trials)).drop("_m", "_s")


def purged_folds(indexed: DataFrame, folds: int, embargo: int, index: str = "order_idx") -> DataFrame:
    """(fold, role, rows): contiguous test folds; training rows keep `embargo` rows away from the test fold.

    The first N % folds folds hold one row more.  Each row goes to each fold at most once.
    """
    n = indexed.agg(F.count("*").alias("_n"))
    size, more = F.floor(F.col("_n") / folds), F.col("_n") % folds
    k = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    bounds = n.select("_n", k).withColumns({"_lo": F.col("fold") * size + F.least("fold", more)}).withColumn("_hi", F.col("_lo") + size - 1 + (F.col("fold") < more).cast("int"))
    x = F.col(index)
    role = F.when(x.between(F.col("_lo"), F.col("_hi")), "test").when((x < F.col("_lo") - embargo) | (x > F.col("_hi") + embargo), "train")
    return indexed.crossJoin(F.broadcast(bounds)).withColumn("role", role).where("role is not null").drop("_n", "_lo", "_hi")  # `folds` rows


def row_hash(*parts: str) -> Column:
    """60 bits of MD5 over columns joined by colons, as a positive number; any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


#: A prime: draws have that many values.
DRAWS = 2_147_483_647
#: Chances of a Poisson(1) draw to be at most 0, 1, ... 7.
POISSON_STEPS = list(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(8)))


#: Rows and replicates whose weights are made at once; some 70,000 numbers stay in a core's cache.
_ROWS, _REPS = 2_048, 32


def _hashed(df: DataFrame, p: str, y: str, key: str) -> DataFrame:
    """(_s, p, y): each row's hash, once; its draw in a replicate is that number times the replicate's multiplier modulo a prime, so draws of one replicate are as independent as the hashes."""
    return df.select(F.pmod(row_hash(key), F.lit(DRAWS)).alias("_s"), F.col(p).cast("double").alias("_p"), F.col(y).cast("double").alias("_y"))


def poisson_weights(s: np.ndarray, first: int, last: int) -> np.ndarray:
    """Poisson(1) weights of rows with hashes s in the replicates first .. last: replicates x rows."""
    rep = np.arange(first, last + 1, dtype=np.uint64) * np.uint64(1_103_515_245) % np.uint64(DRAWS) + np.uint64(1)
    x = np.multiply.outer(rep, s.astype(np.uint64))
    # modulo 2^31 - 1: low and high 31 bits are added, and the prime is taken off where it fits (an unsigned difference wraps where it does not)
    low = (x & np.uint64(DRAWS)).astype(np.uint32)
    x >>= np.uint64(31)
    low += x.astype(np.uint32)
    draw = np.minimum(low, low - np.uint32(DRAWS))
    w = np.zeros(draw.shape, np.uint8)
    for least in _LEAST_DRAWS:
        w += (draw >= least).view(np.uint8)
    return w


def _least_draw(chance: float) -> np.uint32:
    """The first draw whose (draw + 0.5) / DRAWS lies above chance."""
    d = max(0, int(chance * DRAWS) - 3)
    while d < DRAWS and not (d + 0.5) / DRAWS > chance:
        d += 1
    return np.uint32(d)


_LEAST_DRAWS = [_least_draw(c) for c in POISSON_STEPS]


def _interval(each: DataFrame, metric: str) -> DataFrame:
    q = F.percentile(metric, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return each.agg(q.alias("q")).select(F.lit(metric).alias("metric"), F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))  # one value a replicate


def bootstrap(df: DataFrame, p: str, y: str, key: str, replicates: int) -> DataFrame:
    """(metric, low, mid, high): 2.5, 50 and 97.5 % of the Brier score over resampled rows.

    A task draws the weights of its rows for blocks of replicates and keeps two sums a replicate; rows are never copied for one.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, 2))
        for b in batches:
            s, e = b.column("_s").to_numpy(), np.column_stack([b.column("_e").to_numpy(), np.ones(b.num_rows)])
            for i in range(0, len(s), _ROWS):
                for k in range(0, replicates, _REPS):
                    to = min(replicates, k + _REPS)
                    total[k:to] += poisson_weights(s[i : i + _ROWS], k + 1, to).astype(np.float64) @ e[i : i + _ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1)), pa.array(total[:, 0]), pa.array(total[:, 1])], ["rep", "e", "w"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _hashed(df, p, y, key).select("_s", F.coalesce(F.pow(F.col("_p") - F.col("_y"), F.lit(2)), F.lit(0.0)).alias("_e")).repartition(parts)
    sums = rows.mapInArrow(part, "rep long, e double, w double")
    return _interval(sums.groupBy("rep").agg(ratio(F.sum("e"), F.sum("w")).alias("brier")), "brier")


def bootstrap_auc(df: DataFrame, p: str, y: str, key: str, replicates: int) -> DataFrame:
    """The same of the area under the ROC curve.

    Rows lie in ranges of the score.  A task goes through its range in order and keeps, for each replicate, weights of both labels and the pairs that they make inside the range;
    the first and the last score, which neighbouring ranges may share, stay apart.  So ranges x replicates numbers meet in the end, however many scores there are.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = lambda: np.zeros(replicates, np.int64)
        now, pos, neg, first = None, zero(), zero(), True
        inner, inner_pos, inner_neg, twice = None, zero(), zero(), zero()
        out = []
        for b in batches:
            score, label, s = (b.column(c).to_numpy() for c in ("_p", "_y", "_s"))
            for i in range(0, len(s), _ROWS):
                at, mark = score[i : i + _ROWS], label[i : i + _ROWS] == 1
                new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (mark[1:] != mark[:-1])])
                sums = np.empty((len(new), replicates), np.int64)
                for k in range(0, replicates, _REPS):
                    to = min(replicates, k + _REPS)
                    sums[:, k:to] = np.add.reduceat(poisson_weights(s[i : i + _ROWS], k + 1, to), new, axis=1, dtype=np.int64).T
                for j, each in zip(new, sums, strict=True):
                    if at[j] != now:
                        if now is not None and first:
                            out.append((now, True, pos, neg, zero()))
                            first = False
                        elif now is not None:
                            inner = now if inner is None else inner
                            twice += pos * (2 * inner_neg + neg)
                            inner_pos += pos
                            inner_neg += neg
                        now, pos, neg = at[j], zero(), zero()
                    if mark[j]:
                        pos += each
                    else:
                        neg += each
        if now is not None:
            out.append((now, True, pos, neg, zero()))
        if inner is not None:
            out.append((inner, False, inner_pos, inner_neg, twice))
        lists = [pa.array([r[c] for r in out], pa.list_(pa.int64())) for c in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.float64()), pa.array([r[1] for r in out], pa.bool_()), *lists], ["p", "one", "pos", "neg", "twice"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # unknown scores are the lowest, as in a window's order, NaN the highest; rows without a label make no pair
    score = F.coalesce(F.nanvl("_p", F.lit(float("inf"))), F.lit(float("-inf")))
    rows = staged(_hashed(df, p, y, key).where("_y is not null").select("_s", score.alias("_p"), "_y"), "bootstrap-rows")
    ranges = rows.repartitionByRange(parts, "_p", "_s").sortWithinPartitions("_p", "_y").mapInArrow(part, "p double, one boolean, pos array<long>, neg array<long>, twice array<long>")
    blocks = ranges.select("p", "one", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(replicates)).alias("rep"), "pos", "neg", "twice")).alias("x")).select("p", "one", "x.*")
    c = blocks.groupBy("rep", "p", "one").agg(*[F.sum(n).alias(n) for n in ("pos", "neg", "twice")])
    inside = F.when(F.col("one"), 0.5 * F.col("pos") * F.col("neg")).otherwise(0.5 * F.col("twice"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("rep").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _interval(c.withColumns({"below": below, "inside": inside}).groupBy("rep").agg(ratio(F.sum(F.col("pos") * F.col("below").cast("double") + F.col("inside")), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")), "auc")


def best_by_net(df: DataFrame, p: str, pnl: str, thresholds: list[float], least: int) -> DataFrame:
    """(threshold, n, net) of the threshold whose rows (p at or above it, `least` at least) have the highest net result; of ties the lowest."""
    steps = F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(p) >= t)).alias("threshold")
    sums = df.select(pnl, steps).groupBy("threshold").agg(F.count("*").alias("n"), F.round(F.sum(pnl), 2).alias("net")).where(F.col("n") >= least)
    return sums.orderBy(F.desc("net"), "threshold").limit(1)


def drawdown_breach(df: DataFrame, r: str, key: str, fractions: list[float], trials: int, steps: int, limit: float) -> DataFrame:
    """(f, breach): share of resampled paths of r whose drawdown at stake f passes limit; a stake lost whole is a breach.

    A path's steps draw rows by hash from the ranked results; paths spread over tasks by (f, trial).
    """
    ranked = with_order_index(df.where(F.col(r).isNotNull()).select(r, key), [r, key], "_i")
    n = ranked.agg(F.count("*").alias("_n"))
    spark = df.sparkSession
    paths = spark.range(trials).withColumnRenamed("id", "trial").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    draws = paths.crossJoin(F.broadcast(n)).withColumn("_i", F.pmod(row_hash("trial", "step"), F.col("_n"))).join(ranked, "_i")
    each = draws.select("trial", "step", F.col(r).alias("_r"), F.explode(F.array(*[F.lit(f) for f in fractions])).alias("f"))
    w = Window.partitionBy("f", "trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    growth = 1 + F.col("f") * F.col("_r")
    each = each.withColumns({"_dead": (growth <= 0).cast("int"), "_log": F.log(F.greatest(growth, F.lit(1e-12)))}).withColumn("_at", F.sum("_log").over(w))
    each = each.withColumn("_dd", 1 - F.exp(F.col("_at") - F.greatest(F.lit(0.0), F.max("_at").over(w))))
    return each.groupBy("f", "trial").agg(F.max(F.greatest(F.col("_dead"), (F.col("_dd") > limit).cast("int"))).alias("b")).groupBy("f").agg(F.avg(F.col("b").cast("double")).alias("breach"))
