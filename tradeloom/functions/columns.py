"""Column functions: timeframes, numbers, calendar, tokens, buckets, rules, decisions, sizing, trades, text."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"m": 60, "h": 3_600, "d": 86_400}


def timeframe_seconds(tf: str) -> int:
    """'5m', '15m', '1h', '4h', '1d' in seconds; m is minutes, never months."""
    n, unit = tf.strip()[:-1], tf.strip()[-1:].lower()
    if unit not in SECONDS or not n.isdigit() or int(n) == 0:
        raise ValueError(f"no timeframe: {tf!r}")
    return int(n) * SECONDS[unit]


# numbers and tokens


def finite(x: Column) -> Column:
    """Null for NaN and the infinities."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def to_number(x: Column) -> Column:
    """A text as a double; null where it is none."""
    return finite(F.trim(x.cast("string")).try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.when(b != 0, a / b)


_MISSING = ("", "none", "nan", "null", "nat")


def token(x: Column) -> Column:
    """Text of a token; null for the words that mean missing."""
    t = F.trim(x)
    return F.when(~F.lower(t).isin(*_MISSING), t)


def token_bool(x: Column) -> Column:
    t = F.lower(token(x))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def token_number(x: Column) -> Column:
    return to_number(token(x))


def token_time(x: Column) -> Column:
    """ISO time as a UTC timestamp; null where it is none."""
    return token(x).try_cast("timestamp")


# calendar


def calendar(ts: Column) -> dict[str, Column]:
    """hour, dow (Mon = 0), hour_sin, hour_cos and the session by hour."""
    hour = F.hour(ts)
    angle = hour * (2 * math.pi / 24)
    session = F.when(hour < 8, "ASIA").when(hour < 16, "EUROPE").when(hour.isNotNull(), "US")
    return {"hour": hour, "dow": F.weekday(ts), "hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "session": session}


def weekday_flags(ts: Column) -> list[Column]:
    return [(F.weekday(ts) == d).cast("int").alias(f"dow_{d}") for d in range(7)]


# codes


def three_way(x: Column, low: Column | float, high: Column | float) -> Column:
    """-1 up to low, 1 from high, else 0; null stays null."""
    return F.when(x <= low, -1).when(x >= high, 1).when(x.isNotNull(), 0)


def sign_code(x: Column, eps: Column | float) -> Column:
    """-1 up to -eps, 1 from eps, else 0."""
    eps = F.lit(eps) if not isinstance(eps, Column) else eps
    return F.when(x <= -eps, -1).when(x >= eps, 1).when(x.isNotNull(), 0)


def tercile_code(x: Column, low: Column | float, high: Column | float) -> Column:
    return three_way(x, low, high) + 1


def crowd_side(oi_z: Column, funding_z: Column, high: float, low: float) -> Column:
    oi_z, funding_z = F.coalesce(oi_z, F.lit(0.0)), F.coalesce(funding_z, F.lit(0.0))
    return F.when((oi_z >= high) & (funding_z >= high), 1).when((oi_z >= high) & (funding_z <= low), -1).otherwise(0)


def crossed_code(a: Column, b: Column) -> Column:
    """Nine cells of two codes from -1 to 1; null if either is."""
    return (a + 1) * 3 + (b + 1)


def risk_on(regime_up: Column, slope: Column, vol: Column, vol_high: float) -> Column:
    """1 if the regime is up, the slope positive and the volatility below its limit; missing fails closed."""
    up = F.coalesce(finite(regime_up), F.lit(0.0)).cast("int") == 1
    return F.when(up & (finite(slope) > 0) & (finite(vol) < vol_high), 1).otherwise(0)


def first_code(text: Column, names: dict[str, int], prob: Column, code: Column) -> Column:
    """A code from its name, else from a probability of at least one half, else as given."""
    named = reduce(lambda c, kv: c.when(F.upper(F.trim(text)) == kv[0], kv[1]), names.items(), F.when(F.lit(False), 0))
    return F.coalesce(named, F.when(finite(prob).isNotNull(), (finite(prob) >= 0.5).cast("int")), finite(code).cast("int"))


# rules

COMPARISONS: dict[str, Callable[..., Column]] = {
    "==": lambda x, v: x == v,
    "!=": lambda x, v: x != v,
    "<": lambda x, v: x < v,
    "<=": lambda x, v: x <= v,
    ">": lambda x, v: x > v,
    ">=": lambda x, v: x >= v,
    "outside": lambda x, v: (x < v[0]) | (x > v[1]),
    "is_true": lambda x, v=None: x.cast("boolean"),
    "is_false": lambda x, v=None: ~x.cast("boolean"),
}


def compare(x: Column, op: str, value=None) -> Column:
    """A comparison by name; missing values compare false."""
    return F.coalesce(COMPARISONS[op](x, value), F.lit(False))


def evaluate_rules(spec: dict, registry: dict[str, Callable[..., Column]], params: dict | None = None) -> tuple[Column, Column]:
    """(should_enter, tags) of a rule set {veto: {any}, entry: {all, any}} whose rules are {name: args}.

    registry maps a name to a function of its arguments that gives a boolean column; an argument "@x" is looked up in params.
    """

    def rules(part: str, how: str) -> list[tuple[str, Column]]:
        out = []
        for rule in spec.get(part, {}).get(how, []):
            (name, args), = rule.items() if isinstance(rule, dict) else {rule: {}}.items()
            args = {k: (params or {})[v[1:]] if isinstance(v, str) and v.startswith("@") else v for k, v in (args or {}).items()}
            out.append((name, F.coalesce(registry[name](**args), F.lit(False))))
        return out

    veto, every, some = rules("veto", "any"), rules("entry", "all"), rules("entry", "any")
    vetoed = reduce(lambda a, b: a | b[1], veto, F.lit(False))
    ok = reduce(lambda a, b: a & b[1], every, F.lit(True))
    if some:
        ok = ok & reduce(lambda a, b: a | b[1], some, F.lit(False))
    tags = [F.when(c, F.lit(f"veto:{n}")) for n, c in veto] + [F.when(c, F.lit(n)) for n, c in every + some]
    return ok & ~vetoed, F.array_compact(F.array(*tags)) if tags else F.array()


def vetoes(consolidated: Column, age_days: Column, rsi: Column, ret_30d: Column, adx: Column, n_open: Column, equity: Column, *, min_age: int, max_age: int, rsi_range: tuple[float, float], max_ret: float, adx_range: tuple[float, float], max_open: int, min_equity: float) -> Column:
    """Names of the entry vetoes that hold; none: enter."""
    checks = {
        "GAP": ~F.coalesce(consolidated, F.lit(False)),
        "AGE_TOO_NEW": age_days < min_age,
        "AGE_TOO_OLD": age_days > max_age,
        "RSI_RANGE": ~F.coalesce(rsi, F.lit(0.0)).between(*rsi_range),
        "STRUCTURAL_TREND": ret_30d > max_ret,
        "ADX": ~F.coalesce(adx.between(*adx_range), F.lit(False)),
        "MAX_OPEN": n_open >= max_open,
        "LOW_EQUITY": equity < min_equity,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


def missing_fields(columns: dict[str, Column]) -> Column:
    """Names of the required columns that are null, NaN or infinite."""
    return F.array_compact(F.array(*[F.when(finite(c).isNull(), F.lit(n)) for n, c in columns.items()]))


# decisions


def scope_ok(scope: str | None, columns: list[str]) -> tuple[Column, bool]:
    """(test, whether its columns are missing): scope RISK_ON_1 reads risk_on_1 where present, else risk_on; unknown scopes fail."""
    name = (scope or "").strip().upper()
    if not name:
        return F.lit(True), False
    if name != "RISK_ON_1":
        return F.lit(False), False
    source = next((c for c in ("risk_on_1", "risk_on") if c in columns), None)
    if source is None:
        return F.lit(False), True
    return F.coalesce(to_number(F.col(source)), F.lit(0.0)) == 1, False


def meta_decision(schema_ok: Column, in_scope: Column, p: Column, pstar: Column, *, scope: str = "", gate: bool = True, fail_closed: bool = True, required: bool = True, scope_missing: bool = False) -> tuple[Column, Column]:
    """(meta_ok, reason): schema, then scope, then threshold."""
    name = scope or "NONE"
    blocked = F.lit(gate) & ~F.coalesce(in_scope, F.lit(False))
    valid = finite(p).between(0, 1) & finite(pstar).isNotNull()
    ok_schema = F.coalesce(schema_ok, F.lit(False))
    by_p = F.when(~F.coalesce(valid, F.lit(False)), "prob_invalid_no_gate").when(p >= pstar, "ok").otherwise("below_pstar")
    reason = (
        F.when(~ok_schema, "schema_fail")
        .when(pstar.isNull(), "no_prob_gate" if required else "meta_disabled")
        .when(blocked & F.lit(fail_closed), f"scope_{'error' if scope_missing else 'fail'}:{name}")
        .otherwise(by_p)
    )
    return ~(reason.isin("schema_fail", "below_pstar") | F.startswith(reason, F.lit("scope_"))), reason


#: Words in a raw reason and the canonical reason that each stands for, the first that is found.
REASON_WORDS = [
    ("regime_slope", "regime_slope_down"), ("regime_down", "regime_down"), ("entry_skip_regime", "regime_down"), ("atr_too_small", "atr_too_small"), ("atr_invalid", "atr_invalid"),
    ("dedup", "dedup_entry"), ("in_position", "in_position"), ("cooldown", "cooldown"), ("daycap", "daycap"), ("daily_cap", "daycap"), ("max_open", "max_open_positions"),
    ("no_5m_data_after_signal", "no_5m_data_after_signal"), ("simulation_none", "simulation_none"), ("error", "internal_error"), ("exception", "internal_error"), ("internal", "internal_error"),
]


def canonical_reason(raw: Column, decision: Column, schema_ok: Column, meta_ok: Column, strat_ok: Column, err: Column) -> Column:
    """The canonical reason of a decision: schema, probability and scope come before words in the raw reason, then the gates' outcome."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    is_true, is_false = (lambda c: F.coalesce(c, F.lit(False))), (lambda c: ~F.coalesce(c, F.lit(True)))
    skipped = F.lower(F.trim(F.coalesce(decision, F.lit("")))) == "skipped"
    by_strategy = skipped & is_true(meta_ok) & is_false(strat_ok)
    out = F.when(is_false(schema_ok) | (text == "schema_fail") | F.contains(F.lower(F.coalesce(err, F.lit(""))), F.lit("missing_required")), "schema_fail")
    out = out.when(F.contains(text, F.lit("below_pstar")), "meta_prob")
    # a bypassed scope starts with the same letters and counts as scope
    out = out.when(F.startswith(text, F.lit("scope_")) | F.contains(text, F.lit("scope_fail")) | F.contains(text, F.lit("scope_error")), "meta_scope")
    for word, name in REASON_WORDS:
        out = out.when(text == word if word == "entry_skip_regime" else F.contains(text, F.lit(word)), name)
    out = out.when(by_strategy, "strategy_fail").when(text.isin("ok", "no_prob_gate", "prob_invalid_no_gate", "meta_disabled"), "ok")
    return out.when(skipped & is_false(meta_ok), "meta_prob").otherwise("other")


def missing_from_error(err: Column) -> Column:
    """Field names in an error text `missing_required: [...]`: the quoted ones of a list, else its tokens."""
    payload = F.trim(F.regexp_extract(F.coalesce(err, F.lit("")), r"missing_required\s*[:=]\s*(.+)$", 1))
    quoted = F.regexp_extract_all(payload, F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1))
    words = F.filter(F.regexp_extract_all(payload, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda t: ~F.lower(t).isin("missing", "required"))
    return F.when(F.startswith(payload, F.lit("[")) & (F.size(quoted) > 0), F.transform(quoted, F.trim)).otherwise(words)


WARM_UP_FIELDS = ("days_since_prev_break", "S6_fresh_x_compress")


def schema_fail_class(raw: Column, schema_ok: Column, err: Column, age_days: Column, warm_up_days: int) -> Column:
    """warmup_expected, integration_defect or unknown."""
    fields = missing_from_error(err)
    failed = ~F.coalesce(schema_ok, F.lit(True)) | (F.lower(F.trim(F.coalesce(raw, F.lit("")))) == "schema_fail")
    return (
        F.when(~failed | (F.size(fields) == 0), "unknown")
        .when(~F.forall(fields, lambda f: f.isin(*WARM_UP_FIELDS)), "integration_defect")
        .when(age_days.isNull(), "unknown")
        .when(age_days <= warm_up_days, "warmup_expected")
        .otherwise("integration_defect")
    )


# sizing


def clip_linear(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """The line through (x0, y0) and (x1, y1), held at its ends."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x0) / (x1 - x0)))
    return y0 + share * (y1 - y0)


def stack_multiplier(share: Column, expansion: Column, *, low: float = 1.0, high: float = 1.0, share_from: float = 0.5, share_to: float = 0.7, expansion_from: float = 0.006, expansion_to: float = 0.015, share_weight: float = 0.6, expansion_weight: float = 0.4) -> Column:
    """Between low and high by a weighted mean of two scores in 0 .. 1: the share of closes near the VWAP and the absolute expansion; missing values count as 0."""
    if share_weight + expansion_weight <= 0:
        share_weight, expansion_weight = 1.0, 0.0
    score = lambda x, a, b: clip_linear(F.coalesce(finite(x), F.lit(0.0)), a, b if b > a else a + 1e-6, 0.0, 1.0)
    both = share_weight * score(share, share_from, share_to) + expansion_weight * score(F.abs(expansion), expansion_from, expansion_to)
    return low + both / (share_weight + expansion_weight) * (high - low)


def scaler_product(scalers: list[dict], least: float = 0.0, most: float = 1e18) -> Column:
    """Product of lines held at their ends, one for each scaler (feature, in_min, in_max, mult_min, mult_max, default, cap_min, cap_max), itself held in least .. most."""
    out = F.lit(1.0)
    for s in scalers:
        x = F.coalesce(finite(F.col(s["feature"])), F.lit(float(s.get("default", 0.0))))
        low, high = float(s.get("in_min", 0.0)), float(s.get("in_max", 1.0))
        one = clip_linear(x, low, high if high > low else low + 1e-9, float(s.get("mult_min", 1.0)), float(s.get("mult_max", 1.0)))
        out = out * F.least(F.greatest(one, F.lit(float(s.get("cap_min", -1e18)))), F.lit(float(s.get("cap_max", 1e18))))
    return F.least(F.greatest(out, F.lit(max(least, 0.0))), F.lit(most))


def size_multiplier(p: Column, eth_hist: Column, *, p0: float = 0.4, p1: float = 0.9, m0: float = 1.0, m1: float = 2.0, down: float = 0.5, cap: float | None = None) -> Column:
    """Linear in p between p0 and p1; times `down` while the histogram is negative; capped."""
    m = clip_linear(finite(p), p0, p1, m0, m1) * F.when(finite(eth_hist) < 0, down).otherwise(1.0)
    return F.least(m, F.lit(cap)) if cap is not None else m


def sizing_chain(equity: Column, regime_up: Column, is_risk_on: Column, multiplier: Column, risk_scale: Column, entry: Column, stop: Column, *, mode: str = "cash", risk_cash: float = 10.0, risk_pct: float = 0.01, block_when_down: bool = True, size_when_down: float = 1.0, probe: float | None = 0.01, notional_pct: float = 1.0, leverage: float = 1.0) -> dict[str, Column]:
    """Regime block or downscale, multiplier, risk-off probe, risk in cash, quantity, notional cap."""
    down = F.coalesce(regime_up, F.lit(0)) == 0
    blocked = down & F.lit(block_when_down)
    base = equity * F.when(down, size_when_down).otherwise(1.0)
    before = F.greatest(F.lit(0.0), F.coalesce(finite(risk_scale), multiplier))
    after = F.when((is_risk_on != 1) & F.lit(probe is not None), F.least(before, F.lit(probe or 0.0))).otherwise(before)
    risk = F.greatest(F.lit(0.0), base * risk_pct * after if mode == "percent" else risk_cash * after)
    distance = F.abs(entry - stop)
    free = F.when(distance > 0, risk / distance).otherwise(0.0)
    most = base * notional_pct * leverage
    qty = F.when((entry > 0) & (free * entry > most), most / entry).otherwise(free)
    zero = lambda c: F.when(blocked, 0.0).otherwise(c)
    return {"skipped": blocked, "size_mult": zero(after), "risk_usd": zero(risk), "qty": zero(qty)}


def curve_lookup(x: Column, bins: list[tuple[float, float, float]]) -> Column:
    """Value of the bin [low, high) that x lies in, held at both ends."""
    bins = sorted(bins)
    out = F.when(F.lit(False), 0.0)
    for _, high, value in bins[:-1]:
        out = out.when(x < high, value)
    return out.when(x.isNotNull(), bins[-1][2])


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between points, held at both ends."""
    points = sorted(points)
    out = F.when(x <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(x.isNotNull(), points[-1][1])


# calibration


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(p: Column, a: float, b: float, on_logit: bool = True) -> Column:
    return sigmoid(a * (logit(p) if on_logit else p) + b)


# trades


def trade_pnl(side: Column, entry: Column, exit_: Column, size: Column, fees: Column) -> Column:
    """Profit of a closed trade after fees; short sides gain as the price falls."""
    move = F.when(F.lower(side).isin("short", "sell"), entry - exit_).otherwise(exit_ - entry)
    return move * F.abs(size) - F.coalesce(fees, F.lit(0.0))


def near(a: Column, b: Column, rel: float = 0.15, absolute: float = 5e-3) -> Column:
    gap = F.abs(a - b)
    return F.coalesce((gap <= absolute) | (gap / F.greatest(F.abs(a), F.abs(b), F.lit(absolute)) <= rel), F.lit(False))


def exit_reason(pnl: Column, mae: Column, mfe: Column, stop_usd: Column, tp_usd: Column, closed: Column, deadline: Column, minutes: float = 3.0) -> Column:
    """TL near the deadline, SL for losers at the stop, TP for winners at the target or with 70 % of their best excursion, MANUAL when flat."""
    late = F.abs(F.unix_micros(closed) - F.unix_micros(deadline)) <= minutes * 60e6
    return (
        F.when(late, "TL")
        .when((pnl <= 0) & (near(mae, stop_usd) | near(F.abs(pnl), stop_usd)), "SL")
        .when((pnl > 0) & (near(mfe, tp_usd) | near(pnl, tp_usd * 0.9) | F.coalesce((mfe > 0) & (pnl / mfe >= 0.7), F.lit(False))), "TP")
        .when(F.abs(pnl) <= 5e-3, "MANUAL")
        .otherwise("UNKNOWN")
    )


# Recorded exit reasons and what they stand for.
EXIT_WORDS = {"STOP": "STOP", "SL": "STOP", "STOP_LOSS": "STOP", "TP": "TP", "TAKE_PROFIT": "TP", "TIME": "TIME", "TL": "TIME", "TIME_LIMIT": "TIME"}


def recorded_exit(reason: Column) -> Column:
    """The recorded reason in upper case, its synonyms as one word."""
    word = F.upper(F.trim(F.coalesce(reason, F.lit(""))))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in EXIT_WORDS.items() for x in pair])[word], word)


def exit_by_result(r: Column, pnl: Column, mae: Column, stop_usd: Column, *, stop_r: float, tp_r: float, tolerance: float) -> Column:
    """Reason by bands of the result in units of risk; between the bands, of losers by how near the stop they came."""
    loser, tp = pnl < 0, r >= tp_r * (1 - tolerance)
    near_stop = F.abs(F.abs(mae) - stop_usd) <= max(tolerance, 0.15) * F.greatest(F.abs(mae), F.abs(stop_usd))
    return F.when(tp, "TP").when(r <= stop_r * (1 - tolerance), "STOP").when(loser & near_stop, "STOP").when(loser & (F.abs(mae) < 0.5 * stop_usd), "TIME").otherwise("OTHER")


def exit_flag(recorded: Column, r: Column, pnl: Column, mae: Column, stop_usd: Column, *, tp_r: float, tolerance: float) -> Column:
    """What speaks against the recorded reason; null: nothing."""
    loser = pnl < 0
    near_stop = F.abs(F.abs(mae) - stop_usd) <= max(tolerance, 0.15) * F.greatest(F.abs(mae), F.abs(stop_usd))
    return F.when((recorded != "TP") & (r >= tp_r * (1 - tolerance)), "tp_not_recorded").when((recorded == "TIME") & loser & near_stop, "time_near_stop").when((recorded == "STOP") & loser & (F.abs(mae) < 0.5 * stop_usd), "stop_far_from_stop")


def client_id(tag: Column, symbol: Column, side: Column, ts: Column) -> Column:
    """TAG, eight letters of the symbol, side, minute and eight digits of a SHA-1, at most 36 characters."""
    minute = F.date_format(ts, "yyyyMMddHHmm")
    seed = F.concat_ws("|", tag, symbol, side, minute)
    return F.substring(F.concat(tag, F.substring(symbol, 1, 8), side, minute, F.substring(F.sha1(F.encode(seed, "UTF-8")), 1, 8)), 1, 36)


def markdown_cell(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")
