"""Training sets and models on tables: logistic models over purged folds, calibrators, ablation, shuffle test."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import calendar, logit, ratio, weekday_flags
from ..sources.staging import staged
from .calibration import auc_brier, ece, resolution, width_bin
from .fits import Variant, figures, fit_all, packed_rows, score_all
from .joins import window_enrichment
from .performance import cost_audit
from .shuffles import kth_places
from .windows import with_order_index, with_quantiles, with_running


def training_set(positions: DataFrame, oi: DataFrame, funding: DataFrame, bps: float = 6.0, keep: list[str] | None = None) -> DataFrame:
    """Closed trades with calendar features, funding and open interest, costs, label and order index; of the columns only `keep` and the order's, where given."""
    c = calendar(F.col("opened_at"))
    df = positions.where("closed_at is not null").withColumns({"hour_sin": c["hour_sin"], "hour_cos": c["hour_cos"]}).select("*", *weekday_flags(F.col("opened_at")))
    df = cost_audit(window_enrichment(df, oi, funding), bps)
    df, order = df.withColumn("y", (F.col("pnl") > 0).cast("int")), ["opened_at", "symbol", "id"]
    return with_order_index(df if keep is None else df.select(*dict.fromkeys([*order, *keep])), order)


def entry_features(df: DataFrame) -> DataFrame:
    """EMA spread in percent and whether the fast one crossed down; needs ema_fast, ema_slow."""
    spread = 100 * ratio(F.col("ema_fast") - F.col("ema_slow"), F.col("ema_slow"))
    return df.withColumns({"ema_spread_pct": spread, "crossed_down": (F.col("ema_fast") < F.col("ema_slow")).cast("int")})


def known_features(df: DataFrame, features: list[str], mask: list[str] = ()) -> list[str]:
    """Features that have a value somewhere and are not masked out."""
    one = df.agg(*[F.count(c).alias(c) for c in features]).first()  # one row
    return [c for c in features if one[c] and c not in mask]


def model(features: list[str], y: str = "y", l1: bool = False, strength: float = 0.01) -> Pipeline:
    filled = [f"{c}_filled" for c in features]
    return Pipeline(stages=[
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol=y, regParam=strength, elasticNetParam=1.0 if l1 else 0.0, maxIter=30),
    ])


def scored(fitted: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    return fitted.transform(df).select(*keep, vector_to_array("probability")[1].alias("p"))


def out_of_fold(df: DataFrame, features: list[str], folds: int, embargo: int, keep: list[str]) -> DataFrame:
    """Scores of each fold's test rows by a model of its training rows; a single-class training part scores its share, one without rows null."""
    rows = packed_rows(df, features, F.array("y"), keep=keep)
    m = fit_all(rows, features, [Variant("all", tuple(features))], folds, embargo)
    return score_all(rows, m, keep).select(*keep, F.nanvl(F.col("_p")[0], F.lit(None)).alias("p"))


def drop_one(df: DataFrame, features: list[str], folds: int, embargo: int) -> DataFrame:
    """(feature, auc, brier) with each feature left out; `baseline` keeps all.  All models are fitted together."""
    rows = packed_rows(df, features, F.array("y"))
    left = [Variant("baseline", tuple(features)), *[Variant(f, tuple(x for x in features if x != f)) for f in features]]
    m = fit_all(rows, features, left, folds, embargo)
    return figures(rows, m).select(F.col("variant").alias("feature"), "auc", "brier")


def calibrators(preds: DataFrame, bins: int = 12) -> dict:
    """Named functions from predictions to predictions with `p_cal`: platt, isotonic, binned (monotone means of quantile bins)."""
    platt = LogisticRegression(featuresCol="_z", labelCol="y", maxIter=50)
    vec = VectorAssembler(inputCols=["_l"], outputCol="_z")
    fitted = platt.fit(vec.transform(preds.withColumn("_l", logit(F.col("p")))))
    a, b = float(fitted.coefficients[0]), float(fitted.intercept)
    blocks = isotonic_blocks(preds)
    edges = with_quantiles(preds.agg(F.count("*")), preds, {"_e": F.col("p")}, [k / bins for k in range(1, bins)]).select(F.array_distinct("_e")).first()[0] or []
    cell = F.lit(0)
    for e in edges:
        cell = cell + (F.col("p") > e).cast("int")
    rows = preds.groupBy(cell.alias("k")).agg(F.count("*").alias("n"), F.avg("y").alias("m")).orderBy("k").collect()  # at most `bins` rows
    means = monotone([r["m"] for r in rows], [r["n"] for r in rows])
    of = F.create_map(*[F.lit(v) for r, m in zip(rows, means, strict=True) for v in (r["k"], m)])
    return {
        "platt": lambda df: df.withColumn("p_cal", 1 / (1 + F.exp(-(a * logit(F.col("p")) + b)))),
        "binned": lambda df: df.withColumn("p_cal", of[cell]),
        "isotonic": lambda df: apply_isotonic(df, blocks),
    }


_LEVEL = "lo double, hi double, n double, s double"


def isotonic_blocks(preds: DataFrame, x: str = "p", y: str = "y") -> DataFrame:
    """(lo, hi, value, next_lo, next_value): the blocks of the nondecreasing least-squares fit of y by x, in order of x.

    Equal x are combined first.  Neighbours that fall are pooled inside ranges of x; what is left meets in fewer ranges, eight at a time, and is pooled again: a pool
    of one range is never split by another.  The last round holds the fit's own blocks and what the eight ranges before it left.
    """

    def pooled(batches: Iterator[pa.RecordBatch]) -> list[list[float]]:
        out: list[list[float]] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append(list(row))
                while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
                    _, hi, n, s = out.pop()
                    out[-1] = [out[-1][0], hi, out[-1][2] + n, out[-1][3] + s]
        return out

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist([dict(zip(("lo", "hi", "n", "s"), r, strict=True)) for r in pooled(batches)], pa.schema([(c, pa.float64()) for c in ("lo", "hi", "n", "s")]))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(lo, hi, s / n) for lo, hi, n, s in pooled(batches)]
        after = [*rows[1:], (None, None, None)]
        found = [{"lo": lo, "hi": hi, "value": v, "next_lo": a[0], "next_value": a[2]} for (lo, hi, v), a in zip(rows, after, strict=False)]
        yield pa.RecordBatch.from_pylist(found, pa.schema([(c, pa.float64()) for c in ("lo", "hi", "value", "next_lo", "next_value")]))

    known = preds.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    level = known.groupBy(F.col(x).cast("double").alias("lo")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s")).select("lo", F.col("lo").alias("hi"), "n", "s")
    parts = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        level = staged(level.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInArrow(part, _LEVEL), "isotonic-pools")
        parts = -(-parts // 8)
    return staged(level.repartition(1).sortWithinPartitions("lo").mapInArrow(last, "lo double, hi double, value double, next_lo double, next_value double"), "isotonic-blocks")


def apply_isotonic(df: DataFrame, blocks: DataFrame, x: str = "p", name: str = "p_cal", cells: int = 1_000) -> DataFrame:
    """df with the fit's value at x: a block's own inside it, on a line between blocks, the first or last one's beyond them.  x is in 0 .. 1, and meets blocks by its cell of that range."""
    cell = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * cells)
    first = blocks.agg(F.min("lo").alias("_first"))  # one row
    reach = blocks.crossJoin(F.broadcast(first)).withColumn("_from", F.when(F.col("lo") > F.col("_first"), F.col("lo")).otherwise(F.lit(float("-inf"))))
    reach = reach.select(*[F.col(c).alias(f"_{c}") for c in ("lo", "hi", "value", "next_lo", "next_value")], "_from", F.explode(F.sequence(cell(F.col("_from")), cell(F.coalesce("next_lo", F.lit(1.0))))).alias("_cell"))
    inside = (F.col(x) >= F.col("_from")) & (F.col("_next_lo").isNull() | (F.col(x) < F.col("_next_lo")))
    out = df.withColumn("_at", cell(F.col(x))).join(reach, (F.col("_at") == F.col("_cell")) & inside, "left")
    between = F.col("_value") + (F.col("_next_value") - F.col("_value")) * (F.col(x) - F.col("_hi")) / (F.col("_next_lo") - F.col("_hi"))
    value = F.when((F.col(x) <= F.col("_hi")) | F.col("_next_lo").isNull(), F.col("_value")).otherwise(between)
    return out.withColumn(name, value).select(*df.columns, name)


def monotone(values: list[float], weights: list[float]) -> list[float]:
    """Least-squares nondecreasing values: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [v for v, _, n in blocks for _ in range(int(n))]


def choose_calibrator(preds: DataFrame, least_std: float = 0.5, least_unique: float = 0.05, found: dict | None = None) -> tuple[str, list[dict]]:
    """(name, report): the first calibrator that lowers ECE without raising Brier and keeps spread and distinct values; else raw.  found: `calibrators` of preds, where they are fitted already."""
    raw = {"ece": ece(preds, "p", "y", width_bin(F.col("p"), 15, True)).first()[0], "brier": auc_brier(preds, "p", "y").first()["brier"]}
    report = [{"name": "raw", **raw}]
    chosen = "raw"
    for name, apply in (found or calibrators(preds)).items():
        out = apply(preds).select("p", "y", "p_cal")
        r = resolution(out, "p", "p_cal").first()
        one = {"name": name, "ece": ece(out, "p_cal", "y", width_bin(F.col("p_cal"), 15, True)).first()[0], "brier": auc_brier(out, "p_cal", "y").first()["brier"], "std_ratio": r["std_ratio"], "unique_ratio": r["unique_ratio"]}
        report.append(one)
        fits = one["ece"] < raw["ece"] and one["brier"] <= raw["brier"] + 1e-12 and (one["std_ratio"] or 0) >= least_std and (one["unique_ratio"] or 0) >= least_unique
        if chosen == "raw" and fits:
            chosen = name
    return chosen, report


def shuffle_p_value(preds: DataFrame, key: str, replicates: int) -> DataFrame:
    """(auc, p_value): share of label shuffles against fixed scores whose AUC reaches the real one.

    A replicate gives each row a pseudo-random place by hash and takes the k first places as label 1; ranks by score are taken once, and `kth_places` sums them
    up to the k-th place without a row for each replicate.
    """
    preds = staged(preds.select(key, "p", "y"), "shuffle-scores")
    each = with_running(preds.groupBy("p").agg(F.count("*").alias("n")), ["p"], {"before": F.col("n")})
    ranked = staged(preds.join(each, "p").select(key, "y", (F.col("before") + (F.col("n") + 1) / 2).alias("r")), "shuffle-ranks")
    n, k, s = ranked.agg(F.count("*"), F.sum("y"), F.sum(F.col("r") * F.col("y"))).first()  # one row
    sums = kth_places(ranked, key, "r", replicates, n, k or 0)
    auc = (s - k * (k + 1) / 2) / (k * (n - k)) if k and k < n else None
    return sums.agg(F.lit(auc).cast("double").alias("auc"), F.avg((F.col("s1") >= F.lit(s)).cast("double")).alias("p_value"))
