import math
import random

import numpy as np
import pytest

from framewise.functions import quantiles, scale
from framewise.operators import profile

PLANS = [{"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}]


@pytest.mark.parametrize("kind", ["spread", "tiny", "equal", "signs", "skewed"])
def test_selection_equals_sorted_values(spark, large_plans, kind):
    rng = random.Random(3)
    make = {
        "spread": lambda i: rng.gauss(0, 1e6),
        "tiny": lambda i: rng.random() * 1e-12,
        "equal": lambda i: 7.25 if i % 3 else float(i),
        "signs": lambda i: (-1) ** i * 10.0 ** rng.randint(-300, 300),
        "skewed": lambda i: 1e300 if i % 100 == 0 else rng.random(),
    }[kind]
    rows = [(g, make(i), rng.randint(1, 4)) for i in range(900) for g in ("x", None)] + [("x", None, 1), ("y", 4.0, 3)]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(4)
    for weight in (None, "w"):
        got = {r["g"]: r for r in quantiles.group_percentiles(df, ["g"], "v", PLANS[0], weight).collect()}
        assert set(got) == {"x", "y", None}
        for g, r in got.items():
            values = [x for k, v, w in rows if k == g and v is not None for x in [v] * (w if weight else 1)]
            for name, p in PLANS[0].items():
                want = np.percentile(values, 100 * p)
                assert math.isclose(r[name], want, rel_tol=1e-9, abs_tol=1e-300), (kind, g, name, r[name], want)


def test_infinite_values_have_cells_of_their_own(spark, large_plans):
    rows = [(float("-inf"),)] * 3 + [(float(i),) for i in range(50)] + [(float("inf"),)] * 3
    (r,) = quantiles.group_percentiles(spark.createDataFrame(rows, "v double"), [], "v", {"m": 0.5, "q": 0.25}).collect()
    assert r["m"] == np.percentile([v for (v,) in rows], 50) and r["q"] == np.percentile([v for (v,) in rows], 25)


def test_a_profile_reads_its_input_four_times_at_any_width(spark, tmp_path, monkeypatch):
    names = [f"c{i}" for i in range(40)]
    rows = [tuple(float((i * 7 + k * i * i) % 50) for k in range(40)) for i in range(120)]
    spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).write.parquet(str(tmp_path / "wide"))
    frozen = []
    monkeypatch.setattr(profile, "freeze", lambda df: frozen.append(df) or scale.freeze(df))
    out = profile.full_profile(spark.read.parquet(str(tmp_path / "wide")))
    plans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in [*frozen, out]]
    assert sum(plans) <= 4
    assert out.where("section = 'distribution'").count() == sum(min(20, len({r[k] for r in rows})) for k in range(40))
