"""The detector over long keys: stretches side by side and blocks with a warm start equal one row after the other."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import recursive as Q
from tidemark.operators.states import bocd_step
from tidemark.plans import folds
from tidemark.plans.series import Series

S = Series()


def values(kind, n):
    rng = np.random.default_rng(7)
    x = {"noise": rng.normal(0, 1, n), "walk": np.cumsum(rng.normal(0, 0.1, n)), "same": np.full(n, 1.3),
         "levels": np.repeat(rng.normal(0, 3, n // 100 + 1), 100)[:n] + rng.normal(0, 0.1, n), "holes": rng.exponential(2, n)}[kind]
    if kind == "holes":
        x[[3, 400, 930, 931]] = np.nan
        x[700] = np.inf
    return x


def agree(got, want):
    assert np.allclose(got["probability"], want["probability"], rtol=1e-10, atol=1e-13)
    assert np.allclose(got["recent_std"].astype(float), want["recent_std"], rtol=1e-12, atol=1e-13, equal_nan=True)
    assert got["run_length"].tolist() == want["run_length"].tolist() and got["level"].tolist() == want["level"].tolist()


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("kind", ["noise", "walk", "same", "levels", "holes"])
@pytest.mark.parametrize("adaptive", [False, True])
def test_stretches_equal_one_row_after_the_other(kind, adaptive):
    n = 4_500
    rows = pd.DataFrame({"x": values(kind, n), "i": range(n)})
    params = {"adaptive": adaptive, "longest": 120, "memory": 200}
    want, end = bocd_step("x", ["i"], lanes=1, **params)(rows, None)
    step = bocd_step("x", ["i"], **params)
    got, last = step(rows, None)
    agree(got, want)
    assert np.allclose(last[3], end[3], rtol=1e-9, atol=1e-13) and last[:2] == end[:2]
    state, parts = None, []
    for part in (rows[:7], rows[7:60], rows[60:2000], rows[2000:]):
        out, state = step(part.reset_index(drop=True), state)
        parts.append(out)
    agree(pd.concat(parts, ignore_index=True), want)


def split(spark, rows):
    for name, v in (("layout", "split"), ("block.rows", str(rows))):
        spark.conf.set(f"tidemark.{name}", v)


@pytest.fixture
def unset(spark):
    yield
    for name in ("layout", "block.rows"):
        spark.conf.unset(f"tidemark.{name}")


def test_rows_of_a_long_key_are_worked_on_once(spark, monkeypatch, unset):
    """Any step that forgets: the detector ran three times over each row before."""
    seen = spark.sparkContext.accumulator(0)

    def steps(value, keep, **_):
        def step(rows, state):
            seen.add(len(rows))
            x = np.r_[np.zeros(3 - len(state or ())), state or (), rows[value]]
            out = rows[keep].reset_index(drop=True).assign(probability=x[3:] + x[2:-1] + x[1:-2], run_length=0, recent_std=0.0, level="low")
            return out, tuple(x[-3:].tolist())

        return step

    monkeypatch.setattr(Q.S, "bocd_step", steps)
    monkeypatch.setattr(Q, "BOCD_WARM", 4, raising=False)
    n = 2_000
    x = np.random.default_rng(1).normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "HOT", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s"), "seq": range(n), "x": x}))
    split(spark, 64)
    got = Q.bocd(df, "x", S, ["seq"]).toPandas().sort_values("seq", ignore_index=True)
    padded = np.r_[0, 0, x]
    assert len(got) == n and np.allclose(got["probability"], padded[2:] + padded[1:-1] + padded[:-2])
    assert seen.value < 1.3 * n


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_blocks_that_do_not_forget_run_again(spark, monkeypatch, unset):
    """Keys of noise, of one value (whose blocks never meet) and a null key, with rows of equal time and holes."""
    monkeypatch.setattr(Q, "BOCD_WARM", 70)
    turns = []
    monkeypatch.setattr(folds, "written", lambda df, real=folds.written: turns.append(1) or real(df))
    parts = []
    for i, (symbol, x) in enumerate({"A": values("noise", 1500), "B": values("same", 1300), None: values("holes", 1000), "C": values("noise", 40)}.items()):
        parts.append(pd.DataFrame({"symbol": [symbol] * len(x), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(x)) // 5, unit="s"), "seq": np.arange(len(x)) + 10_000 * i, "x": x}))
    pdf = pd.concat(parts, ignore_index=True)
    params = {"adaptive": True, "longest": 30, "memory": 60}
    want = pd.concat([bocd_step("x", ["seq"], lanes=1, **params)(p, None)[0] for p in parts], ignore_index=True)
    split(spark, 300)
    got = Q.bocd(spark.createDataFrame(pdf.sample(frac=1, random_state=1)), "x", S, ["seq"], **params)
    got = got.toPandas().sort_values("seq", ignore_index=True)
    assert len(turns) > 1 and len(got) == len(want) and got["seq"].tolist() == want["seq"].tolist()
    agree(got, want)


def test_states_agree_number_by_number():
    assert folds._same((1, 0.5, (1e-200, float("nan"))), (1, 0.5 * (1 + 2e-14), (1e-200, float("nan"))))
    assert not folds._same((1, 0.5, (1e-200,)), (1, 0.5, (1.1e-200,)))
    assert not folds._same((1, 0.5), (2, 0.5)) and not folds._same((0.5,), (0.5, 0.5))
