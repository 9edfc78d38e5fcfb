"""Feature transforms, feature suggestions, target detection and mutual information."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewise.functions.columns import (
    as_text,
    field_type,
    is_float,
    is_integer,
    is_numeric,
    is_text,
    ladder,
    numeric_columns,
    parse_timestamp,
    ref,
    require_columns,
    require_numeric,
)
from framewise.functions.quantiles import group_percentiles
from framewise.functions.scale import broadcast_if_few, broadcast_if_small, row_positions
from framewise.operators.aggregates import correlations, unpivot_numeric
from framewise.operators.profile import DATE_SHARE, adjusted_skewness, column_stats, text_facts

MAX_DUMMIES = 1_000
MAX_SUGGESTIONS = 12
MISSING = "MISSING"


def date_decompose(df: DataFrame, column: str) -> DataFrame:
    """Year, month, weekday (Monday is 0) and weekend flag; what does not parse has no parts and flag 0."""
    require_columns(df, column)
    t = parse_timestamp(ref(column), field_type(df, column))
    weekend = F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0))
    return df.withColumns(
        {
            f"{column}_year": F.year(t),
            f"{column}_month": F.month(t),
            f"{column}_dayofweek": F.weekday(t),
            f"{column}_is_weekend": weekend,
        }
    )


def log_transform(df: DataFrame, column: str) -> DataFrame:
    """log(1 + x) with negative values read as 0."""
    require_numeric(df, column)
    floor = F.when(ref(column) < 0, F.lit(0.0)).otherwise(ref(column).cast("double"))
    return df.withColumn(f"{column}_log", F.log1p(floor))


def bin_quartile(df: DataFrame, column: str, bins: int = 4) -> DataFrame:
    """Right-closed quantile bins Q1..Qn as text, ``nan`` for missing values.

    The bin edges (a few numbers) are read first. Equal neighbouring edges cannot be labelled: an error.
    """
    require_numeric(df, column)
    cuts = group_percentiles(df, [], column, {f"e{i}": i / bins for i in range(bins + 1)}).first()
    edges = [cuts[f"e{i}"] for i in range(bins + 1)]
    if None in edges or len(set(edges)) != len(edges):
        raise ValueError(f"Bin edges of '{column}' must be unique")
    label: Column = F.when(ref(column).isNull(), "nan")
    for i, edge in enumerate(edges[1:-1], start=1):
        label = label.when(ref(column) <= F.lit(edge), f"Q{i}")
    return df.withColumn(f"{column}_quartile", label.otherwise(f"Q{bins}"))


def _label_text(df: DataFrame, column: str) -> Column:
    return F.coalesce(as_text(ref(column), field_type(df, column)), F.lit(MISSING))


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """A 0/1 column per value, the distinct values becoming the schema.

    Above ``MAX_DUMMIES`` values, more than a schema holds well, one sparse vector column ``{column}_onehot`` over the
    values in text order.
    """
    require_columns(df, column)
    text = _label_text(df, column)
    found = df.select(text.alias("v")).distinct().orderBy("v").limit(MAX_DUMMIES + 1).collect()
    if len(found) > MAX_DUMMIES:
        labels = row_positions(df.select(text.alias("_label")).distinct(), [F.col("_label")], "_index")
        indexed = df.drop(f"{column}_onehot").join(broadcast_if_small(labels), text == F.col("_label"), "left")
        encoder = OneHotEncoder(inputCol="_index", outputCol=f"{column}_onehot", dropLast=False)
        return encoder.fit(indexed.select("_index")).transform(indexed).drop("_label", "_index")
    return df.withColumns({f"{column}_{r.v}": (text == r.v).cast("int") for r in found})


def label_table(df: DataFrame, column: str) -> DataFrame:
    """(label, index) of the distinct non-missing values in text order."""
    text = as_text(ref(column), field_type(df, column))
    labels = df.where(ref(column).isNotNull()).select(text.alias("label")).distinct()
    return row_positions(labels, [F.col("label")], "index")


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Index of each value in text order, -1 for missing; the labels stay a table, whatever their number."""
    require_columns(df, column)
    name = f"{column}_encoded"
    labels = label_table(df, column).select(
        F.col("label").alias("_label"), F.col("index").cast("int").alias(name)
    )
    text = as_text(ref(column), field_type(df, column))
    joined = df.drop(name).join(broadcast_if_few(labels), text == F.col("_label"), "left")
    return joined.drop("_label").withColumn(name, F.coalesce(ref(name), F.lit(-1)))


def interaction(df: DataFrame, first: str, second: str) -> DataFrame:
    """Product of two columns."""
    require_numeric(df, first)
    require_numeric(df, second)
    return df.withColumn(f"{first}_x_{second}", ref(first) * ref(second))


def suggest_features(df: DataFrame) -> DataFrame:
    """Ranked transform suggestions (rank, column, transform_type) by fixed rules over the profile.

    Date-like text, skewed or continuous numbers, then categories, then products of correlated columns as long
    as the list holds fewer than twelve entries.
    """
    numeric = numeric_columns(df)
    stats = column_stats(df)
    floats = [c for c in numeric if is_float(field_type(df, c))]
    integers = [c for c in numeric if is_integer(field_type(df, c))]
    texts = [f.name for f in df.schema.fields if is_text(f.dataType)]
    column, unique = F.col("column"), F.col("unique_count")

    def suggestion(rows: DataFrame, phase: int, kind: str, order: Column) -> DataFrame:
        return rows.select(
            F.lit(phase).alias("_phase"),
            order.cast("double").alias("_order"),
            "column",
            F.lit(kind).alias("transform_type"),
        )

    date_like = F.lit(False)
    if texts:
        # One row per text column.
        stats = stats.join(F.broadcast(text_facts(df, texts)), "column", "left")
        date_like = F.coalesce(F.col("date_share") >= DATE_SHARE, F.lit(False))
    parts = [suggestion(stats.where(date_like), 1, "date_decompose", F.col("ordinal"))]
    if numeric:
        measures, structs = [], []
        for i, c in enumerate(numeric):
            measures += [F.skewness(ref(c)).alias(f"s{i}"), F.count(ref(c)).alias(f"n{i}")]
            skew = adjusted_skewness(F.col(f"s{i}"), F.col(f"n{i}"))
            structs.append(F.struct(F.lit(c).alias("column"), skew.alias("skew")))
        skews = df.agg(*measures).select(F.inline(F.array(*structs)))
        shaped = stats.join(F.broadcast(skews), "column")
        tailed = shaped.where((F.col("skew") > 1.5) & (F.col("min") >= 0))
        parts.append(suggestion(tailed, 1, "log_transform", F.col("ordinal") + 0.1))
        spread = stats.where(column.isin(floats or [""]) & (unique > 20))
        parts.append(suggestion(spread, 1, "bin_quartile", F.col("ordinal") + 0.2))
    category = (column.isin(texts or [""]) & ~date_like) | (
        column.isin(integers or [""]) & (unique <= 20)
    )
    few = stats.where(category & unique.between(2, 15))
    some = stats.where(category & unique.between(16, 50))
    parts.append(suggestion(few, 2, "one_hot", F.col("ordinal")))
    parts.append(suggestion(some, 2, "label_encode", F.col("ordinal")))
    if len(numeric) >= 2:
        r = correlations(df, numeric, numeric, later=True).where(F.abs("r") >= 0.5)
        named = r.select(F.concat_ws("__", "col_a", "col_b").alias("column"), (F.col("i") * len(numeric) + F.col("j")).alias("_place"))
        parts.append(suggestion(named, 3, "interaction", F.col("_place")))
    # A few rows per column of the table.
    order = Window.orderBy("_phase", "_order")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
    kept = ranked.where((F.col("_phase") < 3) | (F.col("rank") <= MAX_SUGGESTIONS))
    return kept.select("rank", "column", "transform_type")


def detect_problem_type(df: DataFrame, target: str) -> DataFrame:
    """One row: classification or regression, with the distinct values behind the decision."""
    require_columns(df, target)
    dtype = field_type(df, target)
    counts = df.agg(F.count(ref(target)).alias("non_null"), F.count_distinct(ref(target)).alias("classes"))
    if isinstance(dtype, T.BooleanType) or not is_numeric(dtype):
        kind = F.lit("classification")
    elif is_float(dtype):
        kind = F.lit("regression")
    else:
        limit = F.greatest(F.lit(10), F.floor(F.col("non_null") * 0.05))
        kind = F.when(F.col("classes") <= limit, "classification").otherwise("regression")
    return counts.select(F.lit(target).alias("target"), kind.alias("problem_type"), "non_null", "classes")


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """Classes of a target with their sizes: the twenty largest of a text target, all of the others."""
    require_columns(df, target)
    counts = df.where(ref(target).isNotNull()).groupBy(ref(target).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("count")
    )
    if is_text(field_type(df, target)):
        return counts.orderBy(F.desc("count"), "class").limit(20)
    return counts.orderBy("class")


def _binned(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, Column]:
    """A small code per column: quantile bin of a number, the text itself otherwise."""
    numeric = [c for c in columns if is_numeric(field_type(df, c))]
    codes: dict[str, Column] = {}
    if numeric:
        long = unpivot_numeric(df, numeric).where(F.col("value").isNotNull())
        cuts = {f"e{i}": i / bins for i in range(1, bins)}
        # (bins - 1) numbers per column become literals of the next scan.
        rows = group_percentiles(long, ["column"], "value", cuts).collect()
        for row in rows:
            edges = sorted({row[name] for name in cuts})
            median = row[f"e{bins // 2}"]
            value = F.coalesce(ref(row["column"]).cast("double"), F.lit(median))
            code = None
            for i, edge in enumerate(edges):
                test = value <= F.lit(edge)
                code = F.when(test, str(i)) if code is None else code.when(test, str(i))
            codes[row["column"]] = code.otherwise(str(len(edges)))
    for c in columns:
        if c not in numeric:
            codes[c] = _label_text(df, c)
    return codes


def feature_importance_mi(
    df: DataFrame, target: str, features: Sequence[str] | None = None, bins: int = 10
) -> DataFrame:
    """Mutual information (nats) of each column with the target on quantile bins, ranked with its share.

    All features share one shuffle of (feature, x, y) counts. The estimate is the binned one, so ranks compare
    with nearest-neighbour estimates, values do not. Missing numbers count as the median, missing text as a
    value of its own.
    """
    require_columns(df, target)
    names = [
        f.name
        for f in df.schema.fields
        if f.name != target
        and (features is None or f.name in features)
        and (is_numeric(f.dataType) or is_text(f.dataType))
    ]
    codes = _binned(df, [*names, target], bins)
    pairs: list[Column] = []
    for c in names:
        if c in codes:
            pairs += [F.lit(c), codes[c]]
    coded = df.select(
        codes[target].alias("y"), F.stack(F.lit(len(pairs) // 2), *pairs).alias("column", "x")
    )
    joint = coded.groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    px = joint.groupBy("column", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("column", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("column").agg(F.sum("n").alias("t"))
    terms = joint.join(px, ["column", "x"]).join(py, ["column", "y"]).join(total, "column")
    part = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))
    scores = terms.groupBy("column").agg(F.greatest(F.sum(part), F.lit(0.0)).alias("mi"))
    # One row per column from here on.
    whole = F.sum("mi").over(Window.partitionBy())
    shared = scores.withColumn(
        "importance_pct", F.when(whole > 0, F.round(F.col("mi") / whole * 100, 1)).otherwise(0.0)
    )
    order = Window.orderBy(F.desc("importance"), "column")
    rated = shared.withColumn("importance", F.round("mi", 4))
    return rated.select(
        "column",
        "importance",
        "importance_pct",
        F.row_number().over(order).alias("rank"),
        ladder(
            F.col("importance_pct"),
            [(20, "very strong"), (10, "strong"), (5, "moderate"), (1, "weak")],
            "very low",
        ).alias("strength"),
    )
