from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cellweave.functions import cells as fc, distributions as d


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 300), st.floats(0.05, 200), st.floats(0.05, 50))
def test_nb_tail_is_sum_of_masses(k, mu, phi):
    y = np.arange(0, k + 1.0)
    assert d.nb_sf(k, mu, phi) == pytest.approx(max(0.0, 1 - np.exp(d.nb_logpmf(y, mu, phi)).sum()), abs=1e-10)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200), st.floats(0.05, 150))
def test_poisson_tail_is_sum_of_masses(k, mu):
    total = sum(math.exp(-mu + i * math.log(mu) - math.lgamma(i + 1)) for i in range(k + 1))
    assert d.poisson_sf(k, mu) == pytest.approx(max(0.0, 1 - total), abs=1e-10)


def test_known_quantiles():
    assert d.normal_isf(np.array(0.025)) == pytest.approx(1.959963984540054, abs=1e-10)
    assert d.chi2_isf(0.05, 1.0) == pytest.approx(3.841458820694124, abs=1e-9)
    low, high = d.garwood(np.array([0.0, 5.0]))
    assert low == pytest.approx([0, 1.623486], abs=1e-5) and high == pytest.approx([3.688879, 11.668332], abs=1e-5)
    low, high = d.betabinom_tails(3, 10, 2.0, 3.0)
    assert low + high - float(np.exp(d.betabinom_logpmf(3.0, 10.0, 2.0, 3.0))) == pytest.approx(1)


def test_dirty_values(spark):
    rows = [("2018-02-03", dt.date(2018, 2, 3)), ("20180203", dt.date(2018, 2, 3)), ("03022018", dt.date(2018, 2, 3)), ("201802", dt.date(2018, 2, 1)), ("2018-02-31", None), ("1850-01-01", None), (" ", None), (None, None), ("x", None)]
    got = spark.createDataFrame(rows, "t string, want date").select(fc.any_date(F.col("t")).alias("d"), "want").collect()
    assert [r.d for r in got] == [r.want for r in got]
    codes = spark.createDataFrame([("5300108",), ("3550308",), ("ab",), (None,)], "x string").select(fc.place_code(F.col("x")).alias("p")).collect()
    assert [r.p for r in codes] == [530010, 355030, None, None]


def test_epi_weeks(spark):
    days = [dt.date(2017, 1, 1) + dt.timedelta(n) for n in range(0, 1500, 3)]
    y, w = fc.epi_week(F.col("d"))
    for r in spark.createDataFrame([(x,) for x in days], "d date").select("d", y.alias("y"), w.alias("w")).collect():
        sunday = r.d - dt.timedelta((r.d.weekday() + 1) % 7)
        year = (sunday + dt.timedelta(3)).year
        first = dt.date(year, 1, 4)
        first -= dt.timedelta((first.weekday() + 1) % 7)
        assert (r.y, r.w) == (year, (sunday - first).days // 7 + 1)


def test_great_circle(spark):
    r = spark.range(1).select(fc.great_circle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("km")).first()
    assert r.km == pytest.approx(6371 * math.pi / 2)
