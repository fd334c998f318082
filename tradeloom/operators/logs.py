"""Decision logs: lines to typed rows, taxonomy, diagnostics, live state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: The fields of a decision line, in order.
FIELDS = ["bundle", "symbol", "decision_ts", "schema_ok", "p_cal", "pstar", "pstar_scope", "risk_on_1", "risk_on", "scope_val", "scope_src", "scope_ok", "meta_ok", "strat_ok", "reason", "err"]
MARK = "META_DECISION"
PATTERN = MARK + r"\s+" + r"\s+".join(f"{f}=(\\S+)" for f in FIELDS[:-1]) + r"\s+err=(.*)$"
TYPES = {"schema_ok": C.token_bool, "scope_ok": C.token_bool, "meta_ok": C.token_bool, "strat_ok": C.token_bool, "p_cal": C.token_number, "pstar": C.token_number, "risk_on": C.token_number, "risk_on_1": C.token_number, "scope_val": C.token_number, "decision_ts": C.token_time}


def parse_decisions(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The 16 typed fields of each decision line, with the columns in keep; other lines are dropped.  Works on streams."""
    some = lines.where(F.contains(F.col(line), F.lit(MARK)) & F.col(line).rlike(PATTERN))
    out = some.select(*keep, *[F.regexp_extract(line, PATTERN, k + 1).alias(f) for k, f in enumerate(FIELDS)])
    return out.withColumns({f: TYPES.get(f, C.token)(F.col(f)) for f in FIELDS if f not in ("symbol", "bundle")}).withColumn("err", F.coalesce("err", F.lit("")))


def latest_decisions(decisions: DataFrame, order: list[str]) -> DataFrame:
    """Of decisions of one symbol and time the latest line."""
    from .bars import keep_last

    return keep_last(decisions, ["symbol", "decision_ts"], order)


def with_reasons(decisions: DataFrame) -> DataFrame:
    """decision (taken or skipped), reason_raw and reason_canonical."""
    taken = F.coalesce("meta_ok", F.lit(False)) & F.coalesce("strat_ok", F.lit(False))
    out = decisions.withColumn("decision", F.when(taken, "taken").otherwise("skipped")).withColumnRenamed("reason", "reason_raw")
    return out.withColumn("reason_canonical", C.canonical_reason(F.col("reason_raw"), F.col("decision"), F.col("schema_ok"), F.col("meta_ok"), F.col("strat_ok"), F.col("err")))


def with_listing(decisions: DataFrame, meta: DataFrame, warm_up_days: int) -> DataFrame:
    """decisions with listed_at, age_days and schema_fail_class."""
    out = decisions.join(meta.select("symbol", "listed_at"), "symbol", "left")
    age = F.floor((F.unix_micros("decision_ts") - F.unix_micros("listed_at")) / 86_400e6)
    out = out.withColumn("age_days", F.when(age.isNotNull(), F.greatest(F.lit(0), age)).cast("long"))
    return out.withColumn("schema_fail_class", C.schema_fail_class(F.col("reason_raw"), F.col("schema_ok"), F.col("err"), F.col("age_days"), warm_up_days))


def reason_mapping(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("reason_raw", "reason_canonical").agg(F.count("*").alias("n"))


def agreement(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of rows whose two columns are equal (nulls equal each other), for each named pair."""
    return df.agg(F.count("*").alias("n"), *[F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias(name) for name, (a, b) in pairs.items()])


def fail_rates(decisions: DataFrame) -> DataFrame:
    """n, failures, rate, and failures for warm-up fields only."""
    failed = ~F.coalesce("schema_ok", F.lit(True))
    fields = C.missing_from_error(F.col("err"))
    only = failed & (F.size(fields) > 0) & F.forall(fields, lambda f: f.isin(*C.WARM_UP_FIELDS))
    return decisions.agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"), F.avg(failed.cast("double")).alias("fail_rate"), F.count_if(only).alias("warm_up_only"))


def missing_counts(decisions: DataFrame, by: list[str], k: int = 20) -> DataFrame:
    """The k most frequent missing fields of each group of `by`, ties by name, with rank."""
    each = decisions.where(~F.coalesce("schema_ok", F.lit(True))).select(*by, F.explode(C.missing_from_error(F.col("err"))).alias("field"))
    n = each.groupBy(*by, "field").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("n"), "field")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def incidents(decisions: DataFrame, least: int = 3) -> DataFrame:
    """Fields outside warm-up that are missing at least `least` times."""
    n = missing_counts(decisions, [], 1 << 30)
    return n.where(~F.col("field").isin(*C.WARM_UP_FIELDS) & (F.col("n") >= least)).select("field", "n")


#: Kinds of live lines and the pattern of each, the first that fits.
EVENTS = {
    "decision": r"META_DECISION\b.*\bsymbol=(\S+)", "open": r"\bOPENED\b.*\bsymbol=(\S+)", "close": r"\bCLOSED\b.*\bsymbol=(\S+)", "signal": r"\bSIGNAL\b.*\bsymbol=(\S+)",
    "veto": r"\bVETO\b.*\bsymbol=(\S+)", "stop": r"\bSTOP\b.*\bsymbol=(\S+)", "target": r"\bTARGET\b.*\bsymbol=(\S+)", "error": r"\bERROR\b.*\bsymbol=(\S+)",
}


def events(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with event (the first kind that fits) and symbol; others are dropped."""
    kind, symbol = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, pattern in EVENTS.items():
        kind, symbol = kind.when(F.col(line).rlike(pattern), name), symbol.when(F.col(line).rlike(pattern), F.regexp_extract(line, pattern, 1))
    return lines.withColumns({"event": kind, "symbol": symbol}).where("event is not null")


def latest_state(rows: DataFrame, keys: list[str], order: Column, fields: list[str]) -> DataFrame:
    """For each key the last known value of each field."""
    return rows.groupBy(*keys).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields], F.count("*").alias("n_events"))


# The lines of the live process, kind by kind in the order they are tried: pattern, group of the symbol, group of the detail (0: none).
LIVE_LINES = {
    "check": (r"Checking\s+([A-Z0-9]+)\.\.\.", 1, 0),
    "ohlcv_limit": (r"OHLCV_LIMIT\s+symbol=([A-Z0-9]+)\s+base_tf=([0-9a-zA-Z]+).*?base_limit=(\d+)", 1, 3),
    "backfill": (r"ENTRY_QUAL_BACKFILL\s+symbol=([A-Z0-9]+).*?from=(\d+)\s+to=(\d+)", 1, 3),
    "decision": (r"META_DECISION.*?symbol=([A-Z0-9]+).*?decision_ts=([0-9T:\-+]+)\s+.*?reason=([A-Za-z0-9_.:-]+)", 1, 3),
    "veto": (r"Signal for\s+([A-Z0-9]+)\s+vetoed:\s+(.+)$", 1, 2),
    "signal": (r"SIGNAL\s+([A-Z0-9]+)\s+@\s+([0-9.]+)\s+\|\s+regime=([A-Z_]+)\s+\|\s+wp=([0-9.]+)%", 1, 4),
    "open": (r"OPENED\s+(LONG|SHORT)\s+([A-Z0-9]+)", 2, 1),
    "watchdog": (r"WATCHDOG\s+symbol=([A-Z0-9]+)\s+stage=([a-z_]+)\s+age=([0-9.]+)s", 1, 3),
    "ohlcv_insufficient": (r"OHLCV_INSUFFICIENT\s+symbol=([A-Z0-9]+)\s+tf=([0-9a-zA-Z]+)\s+have=(\d+)\s+need=(\d+)", 1, 3),
    "scan_skip": (r"SCAN_SKIP\s+symbol=([A-Z0-9]+)\s+stage=([A-Za-z0-9_:-]+)", 1, 2),
    "feature_missing": (r"FEATURE_MISSING.*?symbol=([A-Z0-9]+).*?missing=\[(.*)\]", 1, 2),
}


def live_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with kind (the first pattern that fits), symbol and detail; other lines, and null ones, are dropped."""
    found = None
    for kind, (pattern, symbol, detail) in LIVE_LINES.items():
        part = lambda group, pattern=pattern: F.regexp_extract(line, pattern, group) if group else F.lit("")
        one = F.struct(F.lit(kind).alias("kind"), part(symbol).alias("symbol"), part(detail).alias("detail"))
        fits = F.col(line).rlike(pattern)
        found = F.when(fits, one) if found is None else found.when(fits, one)
    return lines.withColumn("_found", found).where("_found is not null").select(*lines.columns, "_found.*")
