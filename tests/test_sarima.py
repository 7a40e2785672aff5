"""Seasonal ARIMA for many series: differences, orders and forecasts on series whose law is known."""

import numpy as np
import pytest

from colonnade.operators import sarima


def simulated():
    rng = np.random.default_rng(5)
    n = 400
    e = rng.normal(size=n + 50)
    ar = np.zeros(n + 50)
    for t in range(2, n + 50):
        ar[t] = 0.5 * ar[t - 1] + 0.3 * ar[t - 2] + e[t]
    ma = e[1:] + 0.6 * e[:-1]
    seasonal = np.zeros(n + 50)
    for t in range(n + 50):
        seasonal[t] = e[t] + (0.4 * seasonal[t - 1] if t else 0) + (0.6 * seasonal[t - 12] if t >= 12 else 0) - (0.24 * seasonal[t - 13] if t >= 13 else 0)
    wave = 10 * np.sin(2 * np.pi * np.arange(n) / 12)
    return {
        "ar": 20 + ar[50:], "walk": np.cumsum(e[50:]) + 0.3 * np.arange(n), "ma": ma[-n:], "seasonal": seasonal[50:],
        "wave": wave + 0.05 * np.arange(n) + 0.1 * e[50:], "short": e[:14], "flat": np.full(30, 7.0),
    }


def frame(spark, series):
    rows = [(name, int(t), float(y)) for name, values in series.items() for t, y in enumerate(values)]
    return spark.createDataFrame(rows, "s string, at long, y double")


@pytest.fixture(scope="module")
def fitted(spark):
    df = frame(spark, simulated())
    models, base = sarima.fit_sarima(df, "s", "at", "y", 12)
    return {r["series"]: r for r in models.collect()}, models, base


def test_differences_follow_the_series(fitted):
    models, _, _ = fitted
    assert (models["ar"]["d"], models["ar"]["sd"]) == (0, 0)
    assert (models["walk"]["d"], models["walk"]["sd"]) == (1, 0)
    assert models["wave"]["sd"] == 1
    assert models.keys() == simulated().keys()
    assert all(m["converged"] for m in models.values())


def test_kpss_is_the_plain_statistic(spark):
    series = simulated()
    roots, levels = sarima.unit_roots(sarima.numbered(frame(spark, series), "s", "at", "y"), 12)
    got = {r["series"]: r for r in roots.collect()}
    for name in ("ar", "walk", "ma", "short"):
        assert got[name]["sd"] == 0
        for d in range(3):
            v = np.diff(series[name], d)
            e, n = v - v.mean(), len(v)
            lags = int(3 * np.sqrt(n) / 13)
            lrv = sum((1 - abs(k) / (lags + 1)) * (e[abs(k) :] * e[: n - abs(k)]).sum() for k in range(-lags, lags + 1)) / n
            assert got[name][f"kpss_{d}"] == pytest.approx((np.cumsum(e) ** 2).sum() / n**2 / lrv)


def test_one_series_does_not_change_another(spark, fitted):
    models, _, _ = fitted
    alone, _ = sarima.fit_sarima(frame(spark, {"ar": simulated()["ar"]}), "s", "at", "y", 12)
    one = alone.first()
    assert [one[k] for k in ("p", "q", "sp", "sq")] == [models["ar"][k] for k in ("p", "q", "sp", "sq")]
    assert one["aic"] == pytest.approx(models["ar"]["aic"])


def test_orders_recover_the_law(spark):
    df = frame(spark, {k: v for k, v in simulated().items() if k in ("ar", "ma", "seasonal")})
    every, _ = sarima.fit_sarima(df, "s", "at", "y", 12, max_p=2, max_q=1, max_sp=1, max_sq=1, every_order=True)
    rows = {(r["series"], r["p"], r["q"], r["sp"], r["sq"]): r for r in every.collect()}
    assert np.allclose(rows["ar", 2, 0, 0, 0]["ar"], [0.5, 0.3], atol=0.12)
    assert np.allclose(rows["ma", 0, 1, 0, 0]["ma"], [0.6], atol=0.12)
    both = rows["seasonal", 1, 0, 1, 0]
    assert both["ar"][0] == pytest.approx(0.4, abs=0.12) and both["sar"][0] == pytest.approx(0.6, abs=0.12)
    for name, order in (("ar", (2, 0, 0, 0)), ("ma", (0, 1, 0, 0)), ("seasonal", (1, 0, 1, 0))):
        worse = rows[(name, 0, 0, 0, 0)]
        assert rows[(name, *order)]["aic"] < worse["aic"] - 50


def test_multiplied_polynomials_by_direct_minimisation():
    rng = np.random.default_rng(2)
    m, y_lags, e_lags = 4, sarima.product_lags(4, 2, 1), sarima.product_lags(4, 1, 1)
    a = rng.normal(size=(300, 1 + len(y_lags) + len(e_lags)))
    a[:, 0] += 0.4 * a[:, 1] - 0.3 * a[:, 1 + y_lags.index(4)]
    fit = sarima.fit_order(a.T @ a, y_lags, e_lags, m, (2, 1, 1, 1))

    def rss(beta):
        ar, sar, ma, sma = beta[:2], beta[2:3], beta[3:4], beta[4:]
        out = a[:, 0].copy()
        for k, c in enumerate(np.convolve([1, *-ar], [1, 0, 0, 0, -sar[0]])):
            if k and c:
                out += c * a[:, 1 + y_lags.index(k)]
        for k, c in enumerate(np.convolve([1, ma[0]], [1, 0, 0, 0, sma[0]])):
            if k and c:
                out -= c * a[:, 1 + len(y_lags) + e_lags.index(k)]
        return float(out @ out)

    beta = np.r_[fit["ar"], fit["sar"], fit["ma"], fit["sma"]]
    assert rss(beta) == pytest.approx(fit["rss"])
    assert all(rss(beta + 1e-3 * s * np.eye(5)[i]) > fit["rss"] for i in range(5) for s in (-1, 1))


def test_forecasts(spark, fitted):
    _, models, base = fitted
    got = {}
    for r in sarima.forecast_sarima(models, base, 24).collect():
        got.setdefault(r["series"], []).append(r)
    for name, rows in got.items():
        assert sorted(r["t"] for r in rows) == [len(simulated()[name]) + h for h in range(1, 25)]
    wave = sorted(got["wave"], key=lambda r: r["t"])
    want = 10 * np.sin(2 * np.pi * np.arange(400, 424) / 12) + 0.05 * np.arange(400, 424)
    assert np.abs(np.array([r["forecast"] for r in wave]) - want).max() < 1
    assert all(r["forecast"] == pytest.approx(7.0) for r in got["flat"])
    for rows in got.values():
        width = [r["high"] - r["low"] for r in sorted(rows, key=lambda r: r["t"])]
        assert all(b >= a - 1e-9 for a, b in zip(width, width[1:]))


def test_white_noise_model_of_a_period_of_one(spark):
    models, base = sarima.fit_sarima(frame(spark, {"ar": simulated()["ar"]}), "s", "at", "y", 1, max_p=1, max_q=0)
    row = models.first()
    v = simulated()["ar"] - simulated()["ar"].mean()
    lag = np.r_[0, v[:-1]]
    phi = (v @ lag) / (lag @ lag)
    assert row["ar"][0] == pytest.approx(phi) and row["sigma2"] == pytest.approx(((v - phi * lag) ** 2).mean())
    first = min(sarima.forecast_sarima(models, base, 3).collect(), key=lambda r: r["t"])
    assert first["forecast"] == pytest.approx(row["mean"] + phi * v[-1])
