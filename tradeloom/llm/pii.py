"""Personal data by candidate gradient boosting, in DataFrame functions and Spark's own boosted trees.

1. Generators with high recall propose spans of each kind, which may overlap between kinds.  A span's start follows from the lengths of
   what stands between the matches of one pattern, so Spark's regular expressions need no positions.
2. Each span gets format features (its kind, length, digits, separators, letters, check digits) and features of the characters beside it.
3. Labels come from what the features do not hold: words before the span that name personal data (label 1) or other
   numbers and files (label 0), for base kinds also whether the format proves itself.  Boosted trees, fitted on at most
   `sample_rows` labelled spans, score every span.
4. Thresholds for the wanted precision, calibrated on all labelled spans that the fit did not use, select further spans: one
   threshold for each kind that has both labels, one over these kinds together for the others.
5. Of selected spans that overlap, the one of the highest score stays, of equal scores the longer one; base spans come first.

Base spans (email, ip, card and phone by their formats) always stay.

Defined results: null or empty text: no spans.  Repeated rows and ids keep one result each.  Columns besides id and
text are ignored, whatever their names.  Empty tables, tables whose sample shows one label only, and tables where no score is precise
enough get base spans only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged, whole_text

BASE_KINDS = ["email", "ip", "card", "phone"]
# The contract's formats, written so that no text makes them backtrack far and no value is cut at a length; \G stands for the last match's end.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:token|secret|password|api[_ -]?key)\b *[=:] *\"?[A-Za-z0-9_./+-]{12,}+\"?",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "spelled_email": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,}+ (?:\[at\]|\(at\)) [a-z0-9-]{2,}+(?: (?:\[dot\]|\(dot\)) [a-z0-9-]{2,}+)++",
    "hex": r"(?i)(?<![0-9a-z])[0-9a-f]{32,}+(?![0-9a-z])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "tax_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9./-])",
    "address": r"\b[0-9]{1,5} \p{Lu}\p{L}++(?: \p{Lu}\p{L}++){0,2} (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr)\b|\b\p{Lu}\p{L}+(?:straße|strasse|weg|gasse) [0-9]{1,4}\b|\b[0-9]{1,4},? rue \p{L}{2,}+(?: \p{L}{2,}+)?|\b[Cc]alle \p{Lu}\p{L}++,? [0-9]{1,4}\b",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{L}++(?:[ -]\p{Lu}\p{L}++)*+",
}
#: A text without this character class cannot have the kind; a cheap test before the pattern.
NEEDS = {"email": "@", "phone": "+"}
# Words before a span that tell what it is; labels come from them, and no feature repeats them.
PERSONAL = r"(?i)(?:phone|tel|call|mobile|contact|e-?mail|write to|card|iban|account|ssn|social security|tax id|born|birth|dob|lives? at|address|home|name|signed|met|token|secret|password|api key|ip|client)[^\p{L}]{0,4}(?:(?:is|was|no|number|on|of|by|at|me)\b[^\p{L}]{0,3}){0,2}\"?$"
IMPERSONAL = r"(?i)(?:order|file|version|release|page|invoice|build|isbn|ticket|item|part|ref|serial|total|sum|table|chapter|commit|checksum|sha|digest|updated|published|copyright|rev|model|section)[^\p{L}]{0,8}(?:(?:is|was|no|number|on|of|by|at)\b[^\p{L}]{0,3}){0,2}\"?$"
CONTEXT_BEFORE, CONTEXT_AFTER = 32, 8
SAMPLE_ROWS = 8_000
WANTED_PRECISION = 0.95
#: Scores are rounded to so many decimals, which bounds the counts that thresholds are chosen from.
DECIMALS = 3


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds: from the right, every second digit counts double."""
    d = F.split(F.reverse(digits), "(?!^)")
    value = lambda c: c.try_cast("int")
    single = F.transform(d, lambda c, i: F.when(i % 2 == 0, value(c)).otherwise((value(c) * 2) % 10 + F.when(value(c) >= 5, 1).otherwise(0)))
    total = F.aggregate(single, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def _proposed(text: Column, kind: str) -> Column:
    """Spans of one pattern: gap before it, value, context; in order."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    spans = F.transform(
        found,
        lambda m, i: F.named_struct(
            F.lit("kind"), F.lit(kind),
            F.lit("n"), i,
            F.lit("gap"), F.length(F.element_at(between, i + 1)),
            F.lit("value"), m,
            F.lit("before"), F.right(F.element_at(between, i + 1), F.lit(CONTEXT_BEFORE)),
            F.lit("after"), F.left(F.element_at(between, i + 2), F.lit(CONTEXT_AFTER)),
        ),
    )
    return spans


def propose(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, id) of every row; (row, kind, start, end, value, before, after) of every proposed span."""
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    marked = texts.withColumn("digit", F.col("text").rlike("[0-9]")).withColumn("other", F.col("text").rlike(r"@|\[at\]|\(at\)|(?i:token|secret|password|key\b)|[0-9a-fA-F]{32}|\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\b"))
    none = F.expr("cast(null as array<struct<kind string, n int, gap int, value string, before string, after string>>)")
    for kind in PATTERNS:
        test = F.col("other") if kind in ("email", "secret", "spelled_email", "hex", "name") else F.col("digit")
        if kind in NEEDS:
            test = test & F.contains("text", F.lit(NEEDS[kind]))
        marked = marked.withColumn(f"is_{kind}", F.when(test, F.col("text").rlike(PATTERNS[kind])).otherwise(False))
    spans = F.array_compact(F.array(*[F.when(F.col(f"is_{k}"), _proposed(F.col("text"), k)).otherwise(none) for k in PATTERNS]))
    rows = staged(marked.select(F.monotonically_increasing_id().alias("row"), "id", F.flatten(spans).alias("spans")), "pii-spans")
    each = rows.select("row", F.inline("spans"))
    w = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(w))
    return rows.select("row", "id"), each.select("row", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "before", "after")


def _mod97(value: Column) -> Column:
    """Remainder of an account number with its first four characters moved to the end and letters read as 10 to 35; 1 if its check digits hold."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.upper(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)))
    number = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97
    return F.aggregate(F.array_remove(F.split(moved, "(?!^)"), ""), F.lit(0), step)


def with_features(spans: DataFrame) -> DataFrame:
    """spans with valid (a base format holds), cue (1 or 0 by the words before it, else null) and the features f_*."""
    digits = _digits(F.col("value"))
    part = F.transform(F.split("value", r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3)
    small = F.forall(part, lambda ok: ok) & F.forall(F.split("value", r"\."), lambda p: F.right(F.regexp_replace(p, "^0+(?=[0-9])", ""), F.lit(3)).try_cast("int") <= 255)
    n = F.length(digits)
    kind, value = F.col("kind"), F.col("value")
    luhn = F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(False)
    valid = (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", (n >= 16) & (n <= 19) & luhn)
        .when(kind == "phone", (n >= 8) & (n <= 15))
        .otherwise(False)
    )
    length = F.length("value")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    count = lambda pattern: number(F.least(F.size(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))), F.lit(12)))
    cue = F.when(kind.isin("secret", "name") | F.col("before").rlike(PERSONAL), 1).when(F.col("before").rlike(IMPERSONAL), 0)
    return spans.withColumns({
        "valid": F.coalesce(valid, F.lit(False)),
        "cue": cue,
        **{f"f_is_{k}": number(kind == k) for k in PATTERNS},
        "f_length": number(F.least(length, F.lit(200))),
        "f_digits": number(F.least(n, F.lit(40))),
        "f_digit_share": number(n / length),
        "f_groups": count("[0-9]+"),
        "f_dashes": count("-"),
        "f_points": count(r"\."),
        "f_spaces": count(" "),
        "f_capitals": count(r"\p{Lu}"),
        "f_luhn": number(luhn),
        "f_account": number(F.when(kind == "iban", _mod97(value) == 1).otherwise(False)),
        "f_year": number(F.regexp_extract(value, "(?:19|20)[0-9]{2}", 0).try_cast("int") - 1900),
        "f_kinds_of_characters": number(F.size(F.array_distinct(F.split(F.left(value, F.lit(64)), "(?!^)")))),
        "f_letters_and_digits": number(value.rlike("[A-Za-z]") & value.rlike("[0-9]")),
        "f_digit_near": number(F.col("before").rlike("[0-9][ .-]?$") | F.col("after").rlike("^[ .-]?[0-9]")),
        "f_letter_touches": number(F.col("before").rlike(r"[\p{L}_/]$") | F.col("after").rlike(r"^[\p{L}_/]")),
        "f_plus_before": number(F.col("before").rlike(r"\+[0-9 ]*$")),
    })


def _weak_label() -> Column:
    """1 where words before the span or its format prove it, 0 where they speak against it; null: unknown.

    Formats speak for base kinds only; card numbers too short for the format whose check digit holds, phone numbers one or two digits
    short, and account numbers are judged by the trees unless words tell.
    """
    kind, digits = F.col("kind"), F.col("f_digits")
    speaks = ((kind == "card") & (F.col("f_luhn") == 1)) | ((kind == "phone") & digits.between(6, 7))
    by_format = F.when(F.col("valid"), 1).when(kind.isin(BASE_KINDS) & ~speaks, 0)
    return F.coalesce(by_format, F.col("cue")).cast("double")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, precision: float = WANTED_PRECISION) -> DataFrame:
    """(id, base, spans): arrays of struct<kind, start, end> for each row; base by format, spans with what the trees add.

    base is ordered as the kinds are listed, then by start; further kinds follow in spans.  start and end count code points, end exclusive.
    """
    rows, proposed = propose(docs, id_col, text_col)
    spans = staged(with_features(proposed).withColumn("label", _weak_label()), "pii-features")
    names = [c for c in spans.columns if c.startswith("f_")]
    base = spans.where("valid").select("row", "kind", "start", "end", F.lit(True).alias("base"), F.lit(2.0).alias("p"))
    further = _further(spans, names, sample_rows, precision)
    chosen = base if further is None else _without_overlaps(base.unionByName(further.withColumn("base", F.lit(False))))
    order = F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), F.col("kind")).alias("rank")
    of_row = chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(order, "start", "end", "kind", "base"))).alias("all"))
    pick = lambda x: F.named_struct(*[y for c in ("kind", "start", "end") for y in (F.lit(c), x[c])])
    empty = F.expr("cast(array() as array<struct<kind string, start bigint, end bigint>>)")
    return rows.join(of_row, "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce(F.transform(F.filter("all", lambda x: x["base"]), pick), empty).alias("base"),
        F.coalesce(F.transform("all", pick), empty).alias("spans"),
    )


def _without_overlaps(spans: DataFrame) -> DataFrame:
    """(row, kind, start, end, base): all base spans, and of the others those that no better one overlaps, chosen from the best down.

    Spans are compared within islands of spans that touch each other, not with all spans of a text.
    """
    w = Window.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best_first = F.struct((-F.col("p")).alias("loss"), (F.col("start") - F.col("end")).alias("minus_length"), "start", "end", "kind", "base")
    held = island.groupBy("row", "island").agg(F.array_sort(F.collect_list(best_first)).alias("all"))
    none = F.slice("all", 1, 0)
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    picked = F.aggregate("all", none, lambda kept, x: F.when(x["base"] | free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return held.select("row", F.inline(F.when(F.size("all") == 1, F.col("all")).otherwise(picked))).select("row", "kind", "start", "end", "base")


def _further(spans: DataFrame, names: list[str], sample_rows: int, precision: float) -> DataFrame | None:
    """(row, kind, start, end, p) of spans that no format proves and the boosted trees select; None if the sample cannot teach them or no score is precise enough."""
    place = F.xxhash64("row", "kind", "start")
    held = F.pmod("place", F.lit(4)) == 0
    labelled = spans.where("label is not null").select("kind", "label", *names, place.alias("place"))
    sample = staged(labelled.where(~held).orderBy("place").limit(sample_rows), "pii-sample")
    seen = sample.agg(F.max("place").alias("last"), F.min("label").alias("least"), F.max("label").alias("most")).first()
    if seen["last"] is None or seen["least"] == seen["most"]:
        return None
    gather = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, maxDepth=4, stepSize=0.3, seed=7).fit(gather.transform(sample))
    score = lambda df: model.transform(gather.transform(df)).withColumn("p", F.round(vector_to_array("probability")[1], DECIMALS))
    unused = labelled.where(held | (F.col("place") > seen["last"]))
    steps = score(unused).groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()  # at most kinds times scores
    mixed = [k for k in PATTERNS if 0 < sum(r["good"] for r in steps if r["kind"] == k) < sum(r["n"] for r in steps if r["kind"] == k)]
    pooled = _threshold([r for r in steps if r["kind"] in mixed], precision)
    least = {k: _threshold([r for r in steps if r["kind"] == k], precision) if k in mixed else pooled for k in PATTERNS}
    chosen = [(F.col("kind") == k) & (F.col("p") >= max(0.5, t)) for k, t in least.items() if t is not None]
    if not chosen:
        return None
    return score(spans.where("not valid")).where(reduce(lambda a, b: a | b, chosen)).select("row", "kind", "start", "end", "p")


def _threshold(steps: list, precision: float) -> float | None:
    """The least score from which on the wanted share of spans is good."""
    good: dict[float, float] = {}
    n: dict[float, int] = {}
    for r in steps:
        good[r["p"]], n[r["p"]] = good.get(r["p"], 0) + r["good"], n.get(r["p"], 0) + r["n"]
    found, sum_good, sum_n = None, 0.0, 0
    for p in sorted(n, reverse=True):
        sum_good, sum_n = sum_good + good[p], sum_n + n[p]
        if sum_good >= precision * sum_n:
            found = p
    return found
