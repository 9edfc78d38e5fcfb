"""Quality of predictions: metrics, residuals, confusion, segments, errors and explanations.

Every function takes a scored table: one row per prediction with the actual value next to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from framewise.functions.columns import field_type, is_numeric, ladder, ref, require_columns
from framewise.functions.quantiles import group_percentiles
from framewise.operators.relational import sample_rows

MAX_LABELS = 1_000


def _r2(y: Column, p: Column) -> Column:
    """1 - residual / total sum of squares, null when the actual values do not vary."""
    total = F.var_pop(y) * F.count(y)
    rest = F.sum(F.pow(y - p, F.lit(2)))
    return F.when(F.max(y) > F.min(y), 1 - rest / total)


def regression_metrics(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """One row: r2, mae, rmse and the number of rows."""
    y, p = ref(actual).cast("double"), ref(predicted).cast("double")
    rows = scored.where(y.isNotNull() & p.isNotNull())
    return rows.agg(
        F.round(_r2(y, p), 4).alias("r2"),
        F.round(F.avg(F.abs(y - p)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(F.pow(y - p, F.lit(2)))), 4).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def _number_text(number: Column) -> Column:
    """A number as text, whole ones without a point."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def _labels(df: DataFrame, first: str, second: str) -> tuple[Column, Column]:
    """Both label columns as text of one common type: 1, 1.0 and '1' are one label, as are true and 'True'."""
    kinds = [field_type(df, c) for c in (first, second)]

    def text(name: str) -> Column:
        plain = ref(name).cast("string")
        if kinds[0] == kinds[1]:
            return plain
        if any(isinstance(k, BooleanType) for k in kinds):
            return F.lower(plain)
        if any(is_numeric(k) for k in kinds):
            return F.coalesce(_number_text(ref(name).try_cast("double")), plain)
        return plain

    return text(first), text(second)


def confusion(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Counts per (actual, predicted) label pair that occurs."""
    rows = scored.where(ref(actual).isNotNull() & ref(predicted).isNotNull())
    return rows.groupBy(
        *[c.alias(n) for c, n in zip(_labels(rows, actual, predicted), ("actual", "predicted"), strict=True)]
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Square matrix, a row per actual and a column per predicted label, 0 where a pair never occurs.

    The labels become the schema, so they are read first; more than ``MAX_LABELS`` are refused.
    """
    cells = confusion(scored, actual, predicted)
    seen = cells.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    labels = [r.label for r in seen.orderBy("label").limit(MAX_LABELS + 1).collect()]
    if len(labels) > MAX_LABELS:
        raise ValueError(f"More than {MAX_LABELS} labels: read the pairs of confusion() instead")
    # A label that was only ever predicted still gets its row.
    rows = seen.select(F.col("label").alias("actual"), F.lit(None).cast("string").alias("predicted"))
    padded = cells.unionByName(rows.withColumn("n", F.lit(0).cast("long")))
    return padded.groupBy("actual").pivot("predicted", labels).agg(F.sum("n")).na.fill(0)


def class_scores(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Per label: support, precision, recall and F1."""
    cells = confusion(scored, actual, predicted)
    n, hit = F.col("n"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    # Each pair counts once for its actual and once for its predicted label.
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("label"), n.alias("s"), F.lit(0).cast("long").alias("c"), hit.alias("t")),
                F.struct(
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("long").alias("s"),
                    n.alias("c"),
                    F.lit(0).cast("long").alias("t"),
                ),
            )
        )
    )
    joined = sides.groupBy("label").agg(
        F.sum("s").alias("support"), F.sum("c").alias("claimed"), F.sum("t").alias("tp")
    )
    joined = joined.withColumns(
        {
            "precision": F.coalesce(F.try_divide("tp", "claimed"), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)),
        }
    )
    both = F.col("precision") + F.col("recall")
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), both)
    return joined.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def classification_metrics(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """One row: accuracy, F1, precision, recall. Two actual classes: of the larger label; else weighted."""
    per_class = class_scores(scored, actual, predicted)
    weight = F.col("support") / F.col("_all")
    # One row per class.
    rows = per_class.withColumn("_all", F.sum("support").over(Window.partitionBy()))
    present = F.col("support") > 0

    def either(name: str) -> Column:
        larger = F.struct(F.col("label").try_cast("double").alias("number"), F.col("label").alias("text"))
        binary = F.max_by(F.col(name), F.when(present, larger))
        weighted = F.sum(F.col(name) * weight)
        return F.round(F.when(F.count_if(present) == 2, binary).otherwise(weighted), 4).alias(name)

    return rows.agg(
        F.round(F.sum("tp") / F.max("_all"), 4).alias("accuracy"),
        either("f1"),
        either("precision"),
        either("recall"),
        F.sum("support").alias("n"),
    )


def confusion_summary(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """One row: totals, accuracy and the actual class with the lowest recall."""
    per_class = class_scores(scored, actual, predicted).where(F.col("support") > 0)
    order = F.struct("recall", "label")
    return per_class.agg(
        F.sum("support").alias("total"),
        F.sum("tp").alias("correct"),
        F.round(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
        F.min_by("label", order).alias("worst_class"),
        F.round(F.min("recall"), 4).alias("worst_recall"),
    )


def residual_summary(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """One row: mae, bias, population std, 75th and 90th percentile of |error| and the bias label."""
    y, p = ref(actual).cast("double"), ref(predicted).cast("double")
    rows = scored.select(y.alias("_y"), (y - p).alias("_e"), F.abs(y - p).alias("_a")).where(
        F.col("_e").isNotNull()
    )
    stats = rows.agg(
        F.avg("_a").alias("mae"),
        F.avg("_e").alias("bias"),
        F.stddev_pop("_e").alias("std"),
        F.stddev_pop("_y").alias("_sy"),
    )
    cuts = group_percentiles(rows, [], "_a", {"percentile_75": 0.75, "percentile_90": 0.9})
    scale = F.when(F.col("_sy") > 0, F.col("_sy")).otherwise(1.0)
    label = (
        F.when(F.abs("bias") / scale < 0.02, "none")
        .when(F.col("bias") > 0, "under-prediction")
        .otherwise("over-prediction")
    )
    names = ["mae", "bias", "std", "percentile_75", "percentile_90"]
    return stats.crossJoin(cuts).select(
        *[F.round(n, 4).alias(n) for n in names], label.alias("bias_label")
    )


def residual_sample(
    scored: DataFrame,
    key: Sequence[str],
    n: int = 200,
    actual: str = "actual",
    predicted: str = "predicted",
    seed: int = 42,
) -> DataFrame:
    """Up to n seeded (predicted, residual) points."""
    picked = sample_rows(scored.where(ref(actual).isNotNull()), key, n, seed)
    return picked.select(
        *[ref(k) for k in key],
        F.round(ref(predicted).cast("double"), 4).alias("predicted"),
        F.round((ref(actual) - ref(predicted)).cast("double"), 4).alias("residual"),
    )


def segment_performance(
    scored: DataFrame,
    group: str,
    problem_type: str = "regression",
    actual: str = "actual",
    predicted: str = "predicted",
    max_groups: int = 15,
) -> DataFrame:
    """R² (not below -1) or accuracy of the largest groups, with a status and the gap best to worst.

    Groups with more than 50 values, or nearly one per row, are refused by ``segment_column_check``.
    """
    require_columns(scored, group, actual, predicted)
    if problem_type == "regression":
        y, p = ref(actual).cast("double"), ref(predicted).cast("double")
        r2 = _r2(y, p)
        raw = F.when(r2.isNotNull(), F.greatest(r2, F.lit(-1.0)))
        steps = [(0.85, "strong"), (0.65, "moderate"), (0.4, "weak")]
    else:
        raw = F.avg((ref(actual) == ref(predicted)).cast("double"))
        steps = [(0.85, "strong"), (0.7, "moderate"), (0.5, "weak")]
    rows = scored.where(ref(actual).isNotNull() & ref(predicted).isNotNull())
    label = F.coalesce(ref(group).cast("string"), F.lit("nan")).alias("segment")
    groups = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), raw.alias("_m"))
    top = groups.orderBy(F.desc("n"), "segment").limit(max_groups)
    metric = F.when(F.col("n") >= 2, F.round("_m", 4))
    # At most max_groups rows from here on.
    everything = Window.partitionBy()
    shaped = top.select("segment", "n", metric.alias("metric"))
    shaped = shaped.withColumns(
        {
            "status": F.coalesce(ladder(F.col("metric"), steps, "poor"), F.lit("insufficient_data")),
            "low_sample": F.col("n") < 10,
            "is_best": F.col("segment")
            == F.max_by("segment", F.struct("metric", "n")).over(everything),
            "is_worst": F.col("segment")
            == F.min_by("segment", F.when(F.col("metric").isNotNull(), F.struct("metric", "n"))).over(
                everything
            ),
            "gap": F.round(F.max("metric").over(everything) - F.min("metric").over(everything), 4),
        }
    )
    return shaped.orderBy(F.desc_nulls_last("metric"), "segment")


def segment_column_check(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values, rows and whether the column is fit for a breakdown."""
    require_columns(df, column)
    counts = df.agg(F.count_distinct(ref(column)).alias("unique_count"), F.count(F.lit(1)).alias("n"))
    near = (F.col("n") > 5) & (F.col("unique_count") >= F.col("n") * 0.8)
    return counts.withColumn("usable", ~((F.col("unique_count") > 50) | near))


def checked_segment_performance(
    df: DataFrame, scored: DataFrame, group: str, problem_type: str = "regression"
) -> DataFrame:
    """``segment_performance`` that refuses a column with too many values."""
    facts = segment_column_check(df, group).first()
    if not facts["usable"]:
        raise ValueError(f"Column '{group}' has {facts['unique_count']} values: too many to break down")
    return segment_performance(scored, group, problem_type)


def prediction_errors(
    scored: DataFrame,
    key: Sequence[str],
    problem_type: str = "regression",
    n: int = 10,
    actual: str = "actual",
    predicted: str = "predicted",
    features: Sequence[str] = (),
) -> DataFrame:
    """The 1-50 largest absolute errors, or the first wrong rows by key with the error rate of all rows."""
    n = max(1, min(50, n))
    keys = [ref(k) for k in key]
    extra = [ref(f) for f in features]
    if problem_type == "regression":
        y, p = ref(actual).cast("double"), ref(predicted).cast("double")
        rows = scored.where(y.isNotNull() & p.isNotNull()).withColumn("_a", F.abs(y - p))
        top = rows.orderBy(F.desc("_a"), *keys).limit(n)
        rank = F.row_number().over(Window.orderBy(F.desc("_a"), *keys))
        return top.select(
            rank.alias("rank"),
            *keys,
            F.round(y, 4).alias("actual"),
            F.round(p, 4).alias("predicted"),
            F.round(y - p, 4).alias("error"),
            F.round("_a", 4).alias("abs_error"),
            *extra,
        )
    wrong = ref(actual) != ref(predicted)
    totals = scored.agg(
        F.count_if(wrong).alias("total_errors"),
        F.round(F.try_divide(F.count_if(wrong), F.count(F.lit(1))), 4).alias("error_rate"),
    )
    top = scored.where(wrong).orderBy(*keys).limit(n)
    rank = F.row_number().over(Window.orderBy(*keys))
    return top.select(
        rank.alias("rank"),
        *keys,
        ref(actual).cast("string").alias("actual"),
        ref(predicted).cast("string").alias("predicted"),
        *extra,
    ).crossJoin(F.broadcast(totals)).orderBy("rank")


def confidence(runs: DataFrame) -> DataFrame:
    """Adds ``overall_confidence`` and the list of ``limitations`` to rows of model facts.

    Needs id, problem_type, n_rows, n_features, cv_std and the metrics r2, accuracy, f1.
    """
    regression = F.col("problem_type") == "regression"
    score = F.coalesce(
        F.when(regression, F.col("r2")).otherwise(F.coalesce("f1", "accuracy")), F.lit(0.0)
    )
    stable = F.col("cv_std").isNull() | (F.col("cv_std") < 0.05)
    level = F.when((score >= 0.85) & stable, "high").when(score >= 0.65, "medium").otherwise("low")
    r2, accuracy = F.coalesce("r2", F.lit(0.0)), F.coalesce("accuracy", F.lit(0.0))
    found = F.array_compact(
        F.array(
            F.when(F.col("n_rows") < 100, "small_dataset"),
            F.when(F.col("cv_std") > 0.1, "unstable_cross_validation"),
            F.when(regression & (r2 < 0.5), "low_r2"),
            F.when(~regression & (accuracy < 0.7), "low_accuracy"),
            F.when(F.col("n_features") > F.col("n_rows") * 0.5, "too_many_features"),
        )
    )
    return runs.select(
        "id",
        level.alias("overall_confidence"),
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none"))).alias("limitations"),
    )


def explain_rows(
    rows: DataFrame,
    key: Sequence[str],
    importance: dict[str, float],
    means: dict[str, float],
    stds: dict[str, float],
) -> DataFrame:
    """Per row and feature: importance * (value - mean) / std, ranked by size inside each row."""
    parts: list[Column] = []
    for name, weight in importance.items():
        spread = stds.get(name) or 0.0
        spread = spread if spread >= 1e-10 else 1.0
        value = ref(name).cast("double")
        # Without a stored mean the value itself is the mean: no contribution.
        mean = F.lit(float(means[name])) if name in means else value
        parts.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.round(value, 4).alias("value"),
                F.round(mean, 4).alias("mean_value"),
                F.round(F.lit(float(weight)) * (value - mean) / F.lit(float(spread)), 6).alias(
                    "contribution"
                ),
            )
        )
    # The features of one row are sorted inside the row, without a shuffle.
    ranked = _by_size(parts)
    long = rows.select(*[ref(k) for k in key], F.posexplode(ranked).alias("_pos", "_s"))
    direction = F.when(F.col("_s.contribution") >= 0, "positive").otherwise("negative")
    return long.select(
        *[ref(k) for k in key],
        (F.col("_pos") + 1).alias("rank"),
        "_s.*",
        direction.alias("direction"),
    )


def _by_size(parts: Sequence[Column]) -> Column:
    keyed = F.transform(
        F.array(*parts),
        lambda s: F.struct(
            F.coalesce(-F.abs(s["contribution"]), F.lit(0.0)).alias("o"), s["feature"].alias("f"), s.alias("s")
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])
