"""Column statistics, full profiles, insights and single-column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions.columns import (
    DATE_LIKE,
    clean_float,
    field_type,
    is_date,
    is_numeric,
    is_text,
    ladder_up_to,
    numeric_columns,
    parse_timestamp,
    percent,
    ref,
    require_columns,
    seconds,
    text_columns,
)
from framewise.functions.quantiles import group_percentiles, weighted_median
from framewise.functions.scale import freeze
from framewise.operators.aggregates import (
    column_frequencies,
    correlation_pairs,
    counted_histograms,
    counted_outliers,
    duplicate_count,
    histogram,
)

SAMPLES = 5
# Share of the values of a text column that must look like, or parse as, a date.
DATE_SHARE = 0.8
# Parts of names that hint at a date.
DATE_NAME_PARTS = ("date", "time", "at", "day", "month", "year")
DATE_COLUMN_HINTS = ("date", "time", "day", "week", "month", "year", "period", "dt", "ts")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: distinct non-missing values and rows, from one (column, value) shuffle."""
    freq = column_frequencies(df, columns)
    return freq.groupBy("column").agg(
        F.count("value").alias("distinct_count"), F.sum("n").alias("row_count")
    )


def text_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column, over all non-missing values: the share that looks like a date and the mean length.

    Blank values count as missing. One aggregate for all columns.
    """
    measures, structs = [], []
    for i, c in enumerate(columns):
        value = F.when(F.trim(ref(c)) != "", ref(c))
        measures += [F.avg(value.rlike(DATE_LIKE).cast("double")).alias(f"d{i}"), F.avg(F.length(value)).alias(f"l{i}")]
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.coalesce(F.col(f"d{i}"), F.lit(0.0)).alias("date_share"),
                F.coalesce(F.col(f"l{i}"), F.lit(0.0)).alias("mean_length"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*structs)))


def counted_text_facts(freq: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``text_facts`` from (column, value, n)."""
    known = freq.where(F.col("column").isin(list(columns)) & (F.trim("value") != ""))
    like = F.sum(F.when(F.col("value").rlike(DATE_LIKE), F.col("n")).otherwise(0))
    return known.groupBy("column").agg(
        (like / F.sum("n")).alias("date_share"), (F.sum(F.length("value") * F.col("n")) / F.sum("n")).alias("mean_length")
    )


def counted_numbers(freq: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of numeric columns, with the value as a number."""
    rows = freq.where(F.col("column").isin(list(columns)) & F.col("value").isNotNull())
    return rows.select("column", F.col("value").try_cast("double").alias("value"), "n")


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """The k most frequent non-missing values of each column, ranked.

    The rank limit is applied inside each task before the shuffle, so a column with many values sends k rows
    per task.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    ranked = freq.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def _sample_values(freq: DataFrame) -> DataFrame:
    order = Window.partitionBy("column").orderBy("value")
    first = freq.where(F.col("value").isNotNull()).withColumn("_i", F.row_number().over(order))
    kept = first.where(F.col("_i") <= SAMPLES)
    return kept.groupBy("column").agg(
        F.array_sort(F.collect_list("value")).alias("sample_values")
    )


def _moments(df: DataFrame) -> DataFrame:
    """Counts and moments of every column from one scan, reshaped to a row per column."""
    measures: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    structs = []
    for i, field in enumerate(df.schema.fields):
        c = clean_float(ref(field.name), field.dataType)
        measures.append(F.count(c).alias(f"c{i}"))
        parts = [
            F.lit(i).alias("ordinal"),
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("dtype"),
            F.col("_rows").alias("row_count"),
            F.col(f"c{i}").alias("non_null_count"),
        ]
        numeric = is_numeric(field.dataType)
        for tag, fn in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp)):
            if numeric:
                measures.append(fn(c).cast("double").alias(f"{tag}{i}"))
                parts.append(F.col(f"{tag}{i}").alias(tag))
            else:
                parts.append(F.lit(None).cast("double").alias(tag))
        structs.append(F.struct(*parts))
    return df.agg(*measures).select(F.inline(F.array(*structs)))


def column_stats(df: DataFrame, samples: bool = True, freq: DataFrame | None = None) -> DataFrame:
    """A row per column: type, counts, missing share, distinct values, samples and numeric moments.

    Samples are the five smallest distinct values (as text), so they do not depend on row order. ``freq`` is the
    table's ``column_frequencies`` where it is already at hand.
    """
    freq = column_frequencies(df, df.columns) if freq is None else freq
    distinct = freq.groupBy("column").agg(F.count("value").alias("unique_count"))
    stats = _moments(df).join(F.broadcast(distinct), "column", "left")
    if samples:
        stats = stats.join(F.broadcast(_sample_values(freq)), "column", "left")
    null_count = F.col("row_count") - F.col("non_null_count")
    columns = [
        "ordinal",
        "column",
        "dtype",
        "row_count",
        "non_null_count",
        null_count.alias("null_count"),
        percent(null_count, F.col("row_count"), 2).alias("null_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "min",
        "max",
        "mean",
        "std",
    ]
    return stats.select(*columns, *(["sample_values"] if samples else []))


PROFILE_SCHEMA = ("section", "column", "item", "number", "text")


def _section(
    df: DataFrame, section: str, column: Column, item: Column, number: Column, text: Column
) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        column.alias("column"),
        item.cast("string").alias("item"),
        number.cast("double").alias("number"),
        text.cast("string").alias("text"),
    )


class _Parts:
    """What the sections of a profile share, each computed once: the input is read for the value counts, the moments,
    the correlations and the duplicates, whatever its number of columns."""

    def __init__(self, df: DataFrame, samples: bool) -> None:
        self.df, self.numeric, self.texts = df, numeric_columns(df), text_columns(df)
        self.freq = freeze(column_frequencies(df, df.columns))
        # These have a row per column, or per pair of them.
        self.stats = freeze(column_stats(df, samples, self.freq))
        numbers = counted_numbers(self.freq, self.numeric)
        self.outliers = freeze(counted_outliers(numbers)) if self.numeric else None
        self.numbers = numbers
        self.pairs = freeze(correlation_pairs(df, self.numeric)) if len(self.numeric) >= 2 else None


def full_profile(df: DataFrame) -> DataFrame:
    """The whole profile in long form (section, column, item, number, text).

    Sections: stats, distribution, outliers, correlation, insight. Values are counted per column once; distinct
    counts, top values, histograms, quartiles and outliers come from those counts.
    """
    none = F.lit(None)
    parts = _Parts(df, samples=False)
    facts = ["non_null_count", "null_count", "null_pct", "unique_count", "min", "max", "mean", "std"]
    pairs: list[Column] = []
    for fact in facts:
        pairs += [F.lit(fact), F.col(fact).cast("double")]
    long = parts.stats.select("column", F.stack(F.lit(len(facts)), *pairs).alias("item", "number"))
    long = long.where(F.col("number").isNotNull())
    result = _section(long, "stats", F.col("column"), F.col("item"), F.round("number", 4), none)

    if parts.numeric:
        bins = counted_histograms(parts.numbers, 20)
        part = _section(bins, "distribution", F.col("column"), F.col("bin"), F.col("count"), F.col("bin_start"))
        result = result.unionByName(part)
    others = [c for c in df.columns if c not in parts.numeric]
    if others:
        top = top_values(parts.freq.where(F.col("column").isin(others)), 20)
        part = _section(top, "distribution", F.col("column"), F.col("rank"), F.col("n"), F.col("value"))
        result = result.unionByName(part)
    if parts.outliers is not None:
        fences = F.concat_ws("..", F.col("lower_fence"), F.col("upper_fence"))
        part = _section(parts.outliers, "outliers", F.col("column"), F.lit("count"), F.col("count"), fences)
        result = result.unionByName(part)
    if parts.pairs is not None:
        part = _section(
            parts.pairs, "correlation", F.col("col_a"), F.col("col_b"), F.col("correlation"), none
        )
        result = result.unionByName(part)
    part = _section(
        _insights(parts), "insight", F.col("column"), F.col("type"), F.col("number"), F.col("severity")
    )
    return result.unionByName(part)


def insights(df: DataFrame) -> DataFrame:
    """Findings (type, severity, column, number) by fixed rules over the profile."""
    return _insights(_Parts(df, samples=False))


def _insights(parts: _Parts) -> DataFrame:
    stats = parts.stats

    def rows(source: DataFrame, kind: str, severity: Column, column: Column, number: Column) -> DataFrame:
        return source.select(
            F.lit(kind).alias("type"),
            severity.alias("severity"),
            column.alias("column"),
            number.cast("double").alias("number"),
        )

    missing = stats.where(F.col("null_pct") >= 5)
    level = F.when(F.col("null_pct") >= 30, "warning").otherwise("info")
    found = rows(missing, "missing_values", level, F.col("column"), F.col("null_pct"))

    unique = stats.where(
        (F.col("unique_count") == F.col("row_count"))
        & ~F.col("column").isin(parts.numeric)
        & (F.col("row_count") > 0)
    )
    found = found.unionByName(
        rows(unique, "high_cardinality", F.lit("info"), F.col("column"), F.col("unique_count"))
    )
    if parts.pairs is not None:
        first = parts.pairs.orderBy(F.desc(F.abs("correlation")), "col_a", "col_b").limit(3)
        strong = first.where(F.abs("correlation") >= 0.8)
        pair = F.concat_ws(",", "col_a", "col_b")
        found = found.unionByName(
            rows(strong, "correlation", F.lit("info"), pair, F.col("correlation"))
        )
    if parts.outliers is not None:
        out = parts.outliers.where(F.col("pct") >= 5)
        found = found.unionByName(
            rows(out, "outliers", F.lit("warning"), F.col("column"), F.col("count"))
        )
    copies = duplicate_count(parts.df).where(F.col("duplicate_count") > 0)
    found = found.unionByName(
        rows(copies, "duplicates", F.lit("warning"), F.lit("*"), F.col("duplicate_count"))
    )
    if parts.texts:
        # One row per column of the table.
        facts = F.broadcast(counted_text_facts(parts.freq, parts.texts))
        dates = stats.join(facts, "column").where(F.col("date_share") >= DATE_SHARE)
        found = found.unionByName(
            rows(dates, "date_column", F.lit("info"), F.col("column"), F.lit(None))
        )
    return found


# --- single columns ---------------------------------------------------------------------------


def null_rate_issue(null_pct: Column) -> Column:
    """warning above 20 % missing, critical above 50 %, null otherwise."""
    return F.when(null_pct > 50, "critical").when(null_pct > 20, "warning")


def adjusted_skewness(skew: Column, n: Column) -> Column:
    """Sample-size adjusted Fisher-Pearson skewness from the population one."""
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))


def _issue(kind: str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity")))


def _issues(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def _base_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(ref(column)).alias("_non_null"),
        F.count_distinct(ref(column)).alias("unique_count"),
    )
    nulls = F.col("total_rows") - F.col("_non_null")
    return counts.select(
        "total_rows",
        nulls.alias("null_count"),
        percent(nulls, F.col("total_rows"), 1).alias("null_pct"),
        "unique_count",
        "_non_null",
    )


def _null_issue() -> Column:
    severity = null_rate_issue(F.col("null_pct"))
    return F.when(
        severity.isNotNull(),
        F.struct(F.lit("high_null_rate").alias("type"), severity.alias("severity")),
    )


def numeric_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: moments, quartiles, adjusted skewness and issues of a numeric column."""
    value = clean_float(ref(column), field_type(df, column))
    clean = df.select(value.alias(column))
    counts = _base_counts(df, column)
    moments = clean.agg(
        F.count(ref(column)).alias("_n"),
        F.min(ref(column)).cast("double").alias("min"),
        F.max(ref(column)).cast("double").alias("max"),
        F.round(F.avg(ref(column)), 4).alias("mean"),
        F.stddev_samp(ref(column)).alias("_std"),
        F.skewness(ref(column)).alias("_skew"),
    )
    cuts = group_percentiles(clean, [], column, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    skew = adjusted_skewness(F.col("_skew"), F.col("_n"))
    many = F.col("total_rows") > 10
    issues = _issues(
        _issue("skewed", "info", F.abs("skewness") > 2),
        _issue("constant_value", "warning", F.col("unique_count") == 1),
        _issue(
            "potential_id",
            "info",
            (F.col("unique_count") >= F.col("total_rows") * 0.95) & many,
        ),
        _null_issue(),
    )
    row = counts.crossJoin(moments).crossJoin(cuts)
    row = row.withColumn("skewness", F.round(skew, 3))
    return row.select(
        F.lit(column).alias("column"),
        F.lit("numeric").alias("col_type"),
        "total_rows",
        "null_count",
        "null_pct",
        "unique_count",
        "min",
        "max",
        "mean",
        F.round("median", 4).alias("median"),
        F.when(F.col("_n") > 1, F.round("_std", 4)).when(F.col("_n") == 1, 0.0).alias("std"),
        F.round("p25", 4).alias("p25"),
        F.round("p75", 4).alias("p75"),
        "skewness",
        issues.alias("issues"),
    )


def categorical_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: mode and its share, the ten most frequent values and issues of a text column."""
    counts = _base_counts(df, column)
    top = top_values(column_frequencies(df, [column]), 10)
    listed = top.agg(
        F.min_by("value", "rank").alias("most_common"),
        F.min_by("n", "rank").alias("_top_n"),
        F.array_sort(
            F.collect_list(F.struct("rank", F.col("value").alias("label"), F.col("n").alias("count")))
        ).alias("top_categories"),
    )
    row = counts.crossJoin(listed).withColumn(
        "most_common_pct", percent(F.col("_top_n"), F.col("_non_null"), 1)
    )
    unique, total = F.col("unique_count"), F.col("total_rows")
    issues = _issues(
        _issue("constant_value", "warning", unique == 1),
        _issue("high_cardinality", "warning", unique > 50),
        _issue("near_unique", "info", (unique <= 50) & (unique >= total * 0.8) & (total > 10)),
        _issue("dominant_value", "info", (F.col("most_common_pct") > 90) & (unique > 1)),
        _null_issue(),
    )
    return row.select(
        F.lit(column).alias("column"),
        F.lit("categorical").alias("col_type"),
        "total_rows",
        "null_count",
        "null_pct",
        "unique_count",
        "most_common",
        "most_common_pct",
        "top_categories",
        issues.alias("issues"),
    )


def day_gaps(df: DataFrame, column: str, key: Sequence[str] = ()) -> DataFrame:
    """Gaps between neighbouring timestamps as (key…, gap in whole days, weight), without a global sort.

    Timestamps are first reduced to one row per day, so the window runs over calendar days, not over rows.
    Neighbours within a day are less than a day apart; they are one row with gap 0 and their number as weight.
    """
    t = parse_timestamp(ref(column), field_type(df, column))
    keys = [ref(k).alias(k) for k in key]
    rows = df.select(*keys, t.alias("_t")).where(F.col("_t").isNotNull())
    days = rows.groupBy(*key, F.to_date("_t").alias("_day")).agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    order = Window.partitionBy(*key).orderBy("_day")
    gap = F.floor((seconds(F.col("_first")) - F.lag(seconds(F.col("_last"))).over(order)) / 86400)
    between = days.withColumn("gap", gap).where(F.col("gap").isNotNull())
    between = between.select(*key, "gap", F.lit(1).cast("long").alias("weight"))
    within = days.where(F.col("_n") > 1).select(
        *key, F.lit(0).cast("long").alias("gap"), (F.col("_n") - 1).alias("weight")
    )
    return between.unionByName(within).groupBy(*key, "gap").agg(F.sum("weight").alias("weight"))


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: first and last day, span and frequency by the median gap."""
    counts = _base_counts(df, column)
    t = parse_timestamp(ref(column), field_type(df, column))
    span = df.select(t.alias("_t")).agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count("_t").alias("_n")
    )
    median = day_gaps(df, column).agg(
        F.floor(weighted_median(F.col("gap"), F.col("weight"))).alias("_gap")
    )
    steps = [(1, "daily"), (8, "weekly"), (35, "monthly"), (100, "quarterly")]
    frequency = ladder_up_to(F.col("_gap"), steps, "annual")
    row = counts.crossJoin(span).crossJoin(median)
    days = F.floor((seconds(F.col("_hi")) - seconds(F.col("_lo"))) / 86400)
    return row.select(
        F.lit(column).alias("column"),
        F.lit("date").alias("col_type"),
        "total_rows",
        "null_count",
        "null_pct",
        "unique_count",
        F.date_format("_lo", "yyyy-MM-dd").alias("min_date"),
        F.date_format("_hi", "yyyy-MM-dd").alias("max_date"),
        days.alias("date_range_days"),
        F.when(F.col("_n") > 2, frequency).alias("estimated_frequency"),
        _issues(_null_issue()).alias("issues"),
    )


def column_kind(df: DataFrame, column: str) -> str:
    """numeric, date or categorical; text is a date when its name hints at it and four values in five parse."""
    dtype = field_type(df, column)
    if is_numeric(dtype):
        return "numeric"
    if is_date(dtype):
        return "date"
    if is_text(dtype) and any(part in column.lower() for part in DATE_NAME_PARTS):
        value = F.when(F.trim(ref(column)) != "", ref(column))
        parsed = df.agg(F.count(value).alias("n"), F.count(parse_timestamp(value, dtype)).alias("ok")).first()
        if parsed.ok >= DATE_SHARE * parsed.n:
            return "date"
    return "categorical"


def column_profile(df: DataFrame, column: str) -> DataFrame:
    """Profile of one column by its kind."""
    require_columns(df, column)
    profiles = {
        "numeric": numeric_profile,
        "date": date_profile,
        "categorical": categorical_profile,
    }
    return profiles[column_kind(df, column)](df, column)


def column_distribution(df: DataFrame, column: str) -> DataFrame:
    """Distribution shown with a column profile: up to ten bins, or the ten most frequent values."""
    require_columns(df, column)
    if is_numeric(field_type(df, column)):
        return histogram(df, column, 10)
    top = top_values(column_frequencies(df, [column]), 10)
    return top.select("rank", F.col("value").alias("label"), F.col("n").alias("count")).orderBy("rank")


def detect_time_columns(df: DataFrame) -> DataFrame:
    """Columns that hold times: timestamp types, or text where 80 % of the non-missing values parse."""
    none = df.sparkSession.range(1)
    found = [c for c in df.columns if is_date(field_type(df, c))]
    parts = [none.select(F.lit(c).alias("column"), F.lit(1.0).alias("parse_rate")) for c in found]
    texts = text_columns(df)
    if texts:
        shares = [
            F.avg(
                F.when(F.trim(ref(c)) != "", parse_timestamp(ref(c), field_type(df, c)).isNotNull().cast("double"))
            ).alias(f"r{i}")
            for i, c in enumerate(texts)
        ]
        named = [F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("parse_rate")) for i, c in enumerate(texts)]
        parts.append(df.agg(*shares).select(F.inline(F.array(*named))))
    if not parts:
        return none.select(F.lit("").alias("column"), F.lit(0.0).alias("parse_rate")).limit(0)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.where(F.col("parse_rate") >= 0.8)


def date_candidates(df: DataFrame) -> DataFrame:
    """Every non-numeric column with its parse rate and span, in the order they are considered."""
    names = [c for c in df.columns if not is_numeric(field_type(df, c))]
    hinted = [c for c in names if any(h in c.lower() for h in DATE_COLUMN_HINTS)]
    ordered = hinted + [c for c in names if c not in hinted]
    if not ordered:
        raise ValueError("No column can hold dates")
    measures, structs = [F.count(F.lit(1)).alias("_n")], []
    for i, c in enumerate(ordered):
        t = parse_timestamp(ref(c), field_type(df, c))
        measures += [
            F.count(t).alias(f"ok{i}"),
            F.min(t).alias(f"lo{i}"),
            F.max(t).alias(f"hi{i}"),
        ]
        span = F.floor((seconds(F.col(f"hi{i}")) - seconds(F.col(f"lo{i}"))) / 86400)
        structs.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.when(F.col("_n") > 0, F.col(f"ok{i}") / F.col("_n")).alias("parse_rate"),
                F.col(f"ok{i}").alias("parsed"),
                span.alias("span_days"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*structs)))


def pick_date_column(df: DataFrame) -> DataFrame:
    """The first candidate where 80 % of all values parse and the dates span more than a day."""
    fit = date_candidates(df).where(
        (F.col("parse_rate") >= 0.8) & (F.col("parsed") >= 2) & (F.col("span_days") > 1)
    )
    return fit.orderBy("position").limit(1).select("column", "parse_rate", "span_days")
