"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

``text_statistics`` counts words, symbols, repeated lines and repeated five-word windows of each text.
``outlier_distances`` turns them into a statistic vector per document, estimates centre and covariance of each
(language, source) group from the half of its rows with the smallest covariance determinant, and measures every row
by its squared Mahalanobis distance. ``quality_verdicts`` puts a base rule and the distance together.

Everything is DataFrame functions. A group's rows never meet: each concentration step sends per-task sums. Values
lie on fixed grids, so medians and subset limits come from counted grid points, whose number no input makes larger,
and the sums behind a covariance are exact whatever the order of addition.

Defined cases: a null text is the empty one; texts without words have no statistic vector, take no part in any
estimate and fail the base rule; null language or source makes a group of its own; groups of fewer than
``min_rows`` rows join the pool of their language, pools of fewer rows the pool of all such rows, and a pool that
is smaller still rejects nothing. Repeated rows count once each. Input columns other than doc_id, text, lang and source
are not read by the verdicts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.storage import shared_folder, stored

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

FEATURES = ("f_length", "f_word", "f_symbol", "f_lines", "f_repeat")
#: Spread below which a feature's differences do not count, added to each covariance (in feature units).
FLOORS = (0.5, 0.12, 0.10, 0.10, 0.08)
GRID = 256.0
#: Steps from each start; the determinant falls with each and stands still after a few.
STEPS = 3
STARTS = ("median", "sign")
HALF = 0.5
MIN_ROWS = 50
#: Squared distance beyond which a document is rejected: the chi-square value with 5 degrees of freedom that a
#: normal vector passes once in 10^6. The README has the rejections measured on labelled documents.
CUTOFF = 35.888
BIN = 16.0


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text.

    n_lines counts lines with a word; n_dup_lines those equal to an earlier one; n_repeat_words the words inside
    five-word windows that occur twice or more, the first occurrence included.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # Words come from the trimmed text, lines from the text as it is: blanks at a line's ends belong to it.
    out = docs.withColumns({"_body": F.btrim(whole, F.lit(" \t\n\x0b\x0c\r")), "_whole": whole})
    lines = F.filter(F.split("_whole", "\n"), lambda x: x.rlike(WORD))
    out = out.withColumns(
        {
            "_words": F.when(F.col("_body") == "", F.array().cast("array<string>")).otherwise(F.split("_body", SPACES + "+")),
            "_lines": lines,
            "n_symbols": F.when(_has_symbol(), F.regexp_count("_body", F.lit(SYMBOLS))).otherwise(F.lit(0)).cast("long"),
        }
    ).drop("_body", "_whole")
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_two": _joined(F.col("_words"), F.col("_words"), 1),
        }
    ).drop("_lines")
    # Words 1, 2, 4 and 5 of each window; the middle word is added only where these repeat.
    out = out.withColumn("_four", _joined(F.col("_two"), F.col("_two"), 3)).drop("_two")
    repeated = F.size(F.array_distinct("_four")) < F.size("_four")
    out = out.withColumn("_five", F.when(repeated, _joined(F.col("_four"), F.slice("_words", 3, F.greatest(F.size("_words"), F.lit(0))), 0)))
    covered = F.when(F.col("_five").isNotNull(), _covered_words(F.col("_five"))).otherwise(F.lit(0))
    return out.drop("_words", "_four").withColumn("n_repeat_words", covered.cast("long")).drop("_five")


def _has_symbol() -> Column:
    return reduce(lambda a, b: a | b, [F.col("_body").contains(c) for c in SYMBOLS.strip("[]")])


def _joined(left: Column, right: Column, apart: int) -> Column:
    """Hash of left[i] with right[i + apart], as far as both go."""
    n = F.greatest(F.least(F.size(left), F.size(right) - apart), F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, apart + 1, n), lambda a, b: F.xxhash64(a, b))


def _covered_words(windows: Column) -> Column:
    """Words inside windows whose hash comes twice or more: sort (hash, place), keep equal neighbours, add up the
    places each kept window adds to those before it."""
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda a, k: F.get(a, k)["h"]
    return F.element_at(
        F.transform(
            F.array(placed),
            lambda a: F.aggregate(
                F.array_sort(
                    F.transform(
                        F.filter(a, lambda x, k: (x["h"].eqNullSafe(same(a, k - 1))) | (x["h"].eqNullSafe(same(a, k + 1)))),
                        lambda x: x["i"],
                    )
                ),
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
                lambda s: s["n"],
            ),
        ),
        1,
    )


def base_failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words") -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat) > 20 * F.col(n_words))


def feature_vector() -> dict[str, Column]:
    """The transformed statistics, rounded to the grid; null without words."""
    n = F.col("n_words")
    share = lambda part, whole: F.sqrt(F.col(part) / whole)
    raw = {
        "f_length": F.log(n),
        "f_word": F.log(F.col("word_chars") / n),
        "f_symbol": share("n_symbols", n),
        "f_lines": share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))),
        "f_repeat": share("n_repeat_words", n),
    }
    return {k: F.when(n > 0, F.round(v * GRID) / GRID) for k, v in raw.items()}


def _squared(centre: list[Column], factor: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor; one lambda variable per step
    keeps the expression linear in size."""
    steps: list[Column] = []

    def solve(i: int, done: list[Column]) -> Column:
        if i == len(FEATURES):
            return reduce(lambda a, b: a + b, [y * y for y in done])
        y = F.col(FEATURES[i]) - centre[i]
        for j, before in enumerate(done):
            y = y - factor[i, j] * before
        y = y / factor[i, i]
        return F.get(F.transform(F.array(y), lambda v: solve(i + 1, [*done, v])), F.lit(0))

    return solve(0, steps)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _with_factor(est: DataFrame) -> DataFrame:
    """Cholesky factor l_i_j of covariance s_i_j plus the squared floors, and log_det; one column at a time."""
    for i, j in _pairs():
        value = F.col(f"s_{i}_{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        est = est.withColumn(f"l_{i}_{j}", F.sqrt(value) if i == j else value / F.col(f"l_{j}_{j}"))
    logs = [F.log(F.col(f"l_{i}_{i}")) for i in range(len(FEATURES))]
    return est.withColumn("log_det", 2 * reduce(lambda a, b: a + b, logs))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean m_i and covariance s_i_j of each group; sums of grid values and their products are exact."""
    sums = [F.sum(f).alias(f"a_{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"b_{i}_{j}") for i, j in _pairs()]
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    mean = {f"m_{i}": F.col(f"a_{i}") / F.col("n") for i in range(len(FEATURES))}
    cov = {f"s_{i}_{j}": F.col(f"b_{i}_{j}") / F.col("n") - mean[f"m_{i}"] * mean[f"m_{j}"] for i, j in _pairs()}
    return got.select(*keys, "n", *[v.alias(k) for k, v in {**mean, **cov}.items()])


def _measured(rows: DataFrame, est: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined with their group's estimate, with the squared distance d2."""
    wanted = [*[f"m_{i}" for i in range(len(FEATURES))], *[f"l_{i}_{j}" for i, j in _pairs()]]
    joined = rows.join(est.select(*keys, *wanted), keys)
    centre = [F.col(f"m_{i}") for i in range(len(FEATURES))]
    factor = {(i, j): F.col(f"l_{i}_{j}") for i, j in _pairs()}
    return joined.withColumn("d2", _squared(centre, factor)).drop(*wanted)


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates of each group: medians with median absolute deviations, and medians with the covariance of
    the directions from them (spatial signs), scaled by those deviations."""
    k, g = len(FEATURES), ["_group"]
    half = lambda x: F.percentile(x, F.lit(0.5))
    medians = rows.groupBy(*g).agg(*[half(f).alias(f"m_{i}") for i, f in enumerate(FEATURES)])
    off = rows.join(medians, g)
    spread = off.groupBy(*g).agg(
        *[(1.4826 * half(F.abs(F.col(f) - F.col(f"m_{i}")))).alias(f"v_{i}") for i, f in enumerate(FEATURES)],
        *[F.first(f"m_{i}").alias(f"m_{i}") for i in range(k)],
    )
    plain = spread.select(
        *g,
        F.lit("median").alias("_start"),
        *[f"m_{i}" for i in range(k)],
        *[(F.col(f"v_{i}") * F.col(f"v_{i}") if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in _pairs()],
    )
    unit = [(F.col(FEATURES[i]) - F.col(f"m_{i}")) / F.sqrt(F.col(f"v_{i}") * F.col(f"v_{i}") + FLOORS[i] ** 2) for i in range(k)]
    norm = reduce(lambda a, b: a + b, [u * u for u in unit])
    grid = lambda x: F.round(x * 4096) / 4096
    signs = rows.join(spread, g).withColumn("_norm", norm)
    sign = signs.groupBy(*g).agg(
        *[
            F.avg(grid(F.when(F.col("_norm") > 0, unit[i] * unit[j] / F.col("_norm")).otherwise(0.0))).alias(f"c_{i}_{j}")
            for i, j in _pairs()
        ]
    ).join(spread, g)
    wide = [F.sqrt(F.col(f"v_{i}") * F.col(f"v_{i}") + FLOORS[i] ** 2) for i in range(k)]
    turned = sign.select(
        *g,
        F.lit("sign").alias("_start"),
        *[f"m_{i}" for i in range(k)],
        *[(F.col(f"c_{i}_{j}") * k * wide[i] * wide[j]).alias(f"s_{i}_{j}") for i, j in _pairs()],
    )
    return plain.unionByName(turned)


def _chi_square(p: int, x: float) -> float:
    """Distribution function of the chi-square law by its series."""
    a, term, total, n = p / 2, 1.0, 1.0, 0
    while term > 1e-16 * total:
        n += 1
        term *= (x / 2) / (a + n)
        total += term
    return total * math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1))


def _chi_square_point(p: int, share: float) -> float:
    low, high = 1e-9, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(p, mid) < share else (low, mid)
    return low


def outlier_distances(stats: DataFrame, folder: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """Statistics with ``d2``, the squared robust distance from their group; null where nothing can be said.

    ``stats`` has doc_id, lang, source and the columns of ``text_statistics``; give it stored, as each step reads it.
    """
    k = len(FEATURES)
    rows = stats.select("lang", "source", *[v.alias(f) for f, v in feature_vector().items()]).where("n_words > 0")
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    kind = sizes.select(
        "lang", "source", "n", F.sum(F.when(F.col("n") < min_rows, F.col("n"))).over(_window("lang")).alias("pool")
    ).select(
        "lang",
        "source",
        F.when(F.col("n") >= min_rows, F.struct(F.lit(0).alias("level"), "lang", "source"))
        .when(F.col("pool") >= min_rows, F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source")))
        .otherwise(F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
        .alias("_group"),
    )
    groups = stored(kind.select(F.to_json("_group").alias("_group"), F.col("lang").alias("_lang"), F.col("source").alias("_source")), folder)
    grouped = lambda df: df.join(
        groups, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    ).drop("_lang", "_source")
    rows = grouped(rows).select("_group", *FEATURES)
    keys = ["_group", "_start"]
    est = stored(_with_factor(_starts(rows)), folder)
    started = rows.crossJoin(F.broadcast(stats.sparkSession.createDataFrame([(s,) for s in STARTS], "_start string")))
    for _ in range(STEPS):
        est = stored(_with_factor(_moments(_nearest(started, est, keys), keys)), folder)
    best = est.groupBy("_group").agg(F.min_by(F.struct(*[c for c in est.columns if c not in keys]), F.struct("log_det", "_start")).alias("e"))
    best = best.select("_group", "e.*")
    # A normal law's covariance within the ellipsoid of its inner share is too small by this factor.
    inner = _chi_square(k + 2, _chi_square_point(k, HALF)) / HALF
    best = _scaled(best, 1 / inner)
    limit = _chi_square_point(k, 0.975)
    second = _moments(_measured(rows, best, ["_group"]).where(F.col("d2") <= limit), ["_group"])
    final = stored(_scaled(second, 0.975 / _chi_square(k + 2, limit)).where(F.col("n") >= min_rows * HALF), folder)
    vector = grouped(stats.withColumns(feature_vector()))
    wanted = [*[f"m_{i}" for i in range(k)], *[f"l_{i}_{j}" for i, j in _pairs()]]
    joined = vector.join(final.select("_group", *wanted), "_group", "left")
    centre, factor = [F.col(f"m_{i}") for i in range(k)], {(i, j): F.col(f"l_{i}_{j}") for i, j in _pairs()}
    return joined.withColumn("d2", _squared(centre, factor)).drop(*wanted, "_group", *FEATURES)


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _scaled(est: DataFrame, by: float) -> DataFrame:
    names = {f"s_{i}_{j}" for i, j in _pairs()}
    kept = [c for c in est.columns if not c.startswith("l_") and c != "log_det"]
    return _with_factor(est.select(*[(F.col(c) * by).alias(c) if c in names else F.col(c) for c in kept]))


def _nearest(rows: DataFrame, est: DataFrame, keys: list[str]) -> DataFrame:
    """The share HALF of each group with the smallest distances, up to the end of a bin of the distance's logarithm."""
    measured = _measured(rows, est, keys).withColumn(
        "_bin", F.floor(F.log2(F.greatest(F.col("d2"), F.lit(2.0**-20))) * BIN).cast("int")
    )
    limits = measured.groupBy(*keys).agg(F.expr(f"percentile_disc({HALF}) WITHIN GROUP (ORDER BY _bin)").alias("_limit"))
    return measured.join(limits, keys).where(F.col("_bin") <= F.col("_limit"))


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per document: doc_id, the text statistics, base_failed, the squared distance d2 and kept.

    A document is kept if it passes the base rule and its distance, where there is one, is at most ``cutoff``.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    given = docs.select("doc_id", "text", *[F.col(c).cast("string").alias(c) for c in ("lang", "source")])
    stats = stored(text_statistics(given).drop("text"), folder)
    out = outlier_distances(stats, folder, min_rows).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff))


def kept_documents(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of docs that the verdicts keep. Verdicts name rows by doc_id: of rows that share one (or have none) all stay
    if any is kept."""
    kept = verdicts.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
