import numpy as np
import pytest

from wattloom.operators import insensitive as ins
from wattloom.operators.forecast import forecast_kernel
from wattloom.plans.experiment import run_model
from test_forecast import CONF, daily_meters


def objective(x, y, intercept, coef, penalty, epsilon):
    residual = y - x @ coef - intercept
    return 0.5 * coef @ coef + penalty * np.maximum(np.abs(residual) - epsilon, 0).sum()


def split_steps(x, y, penalty, epsilon, rounds=20_000, rho=1.0):
    """Another way to the same least value: alternate between the residuals and the ridge system (augmented Lagrangian)."""
    wide = np.hstack([np.ones((len(x), 1)), x])
    system = np.linalg.inv(wide.T @ wide * rho + np.diag(np.r_[1e-9, np.ones(x.shape[1])]))
    z, u = y.copy(), np.zeros(len(y))
    for _ in range(rounds):
        theta = system @ (wide.T @ (y - z - u)) * rho
        v = y - wide @ theta - u
        far = np.abs(v) - epsilon
        z = np.where(far <= 0, v, np.sign(v) * (epsilon + np.maximum(far - penalty / rho, 0)))
        u += z - (y - wide @ theta)
    return theta[0], theta[1:]


def samples_of(spark, groups):
    data = [(g, i, x[i].tolist(), y[i].tolist()) for g, (x, y) in groups.items() for i in range(len(x))]
    return spark.createDataFrame(data, "clust_id string, base_pos long, features array<double>, targets array<double>")


@pytest.mark.parametrize("penalty,epsilon", [(1.0, 0.1), (10.0, 0.0)])
def test_least_objective(spark, monkeypatch, penalty, epsilon):
    monkeypatch.setattr(ins, "BLOCK", 16)
    rng = np.random.default_rng(5)
    groups = {}
    for name, n in (("a", 90), ("b", 40)):
        x = rng.normal(size=(n, 3))
        y = np.stack([x @ rng.normal(size=3) + 4 + rng.standard_t(2, n) for _ in range(2)], axis=1)
        groups[name] = x, y
    rows = ins.fit_insensitive(samples_of(spark, groups), penalty=penalty, epsilon=epsilon, tolerance=1e-6).collect()
    assert sorted((r.clust_id, r.horizon) for r in rows) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    for r in rows:
        x, y = groups[r.clust_id][0], groups[r.clust_id][1][:, r.horizon - 1]
        mine = objective(x, y, r.intercept, np.array(r.coef), penalty, epsilon)
        other = split_steps(x, y, penalty, epsilon)
        assert mine <= objective(x, y, *other, penalty, epsilon) * 1.002
        np.testing.assert_allclose(r.coef, other[1], atol=0.05)


def test_far_values_do_not_pull(spark):
    """A tenth of wild targets moves the least-squares line, not this one."""
    x = np.linspace(-1, 1, 100)[:, None]
    y = 3 * x + 1
    y[::10] += 500
    model = ins.fit_insensitive(samples_of(spark, {"g": (x, y)}), penalty=100.0).first()
    assert abs(model.intercept - 1) < 0.3 and abs(model.coef[0] - 3) < 0.5


def test_no_samples_and_bad_arguments(spark):
    none = samples_of(spark, {"g": (np.zeros((1, 1)), np.zeros((1, 1)))}).where("base_pos < 0")
    assert ins.fit_insensitive(none).isEmpty()
    with pytest.raises(ValueError):
        ins.fit_insensitive(none, penalty=0)


def test_kernel_follows_a_curve(spark):
    x = np.linspace(-2, 2, 200)[:, None]
    samples = samples_of(spark, {"g": (x, np.sin(3 * x))})
    made = forecast_kernel(samples, samples, 64, penalty=100.0, epsilon=0.02).orderBy("base_pos").toPandas()
    np.testing.assert_allclose(made["pred_val"], np.sin(3 * x)[:, 0], atol=0.1)


def test_kernel_as_a_model_of_a_run(spark):
    series, index = daily_meters(spark)
    errors = run_model(series, index, CONF, "svr")[1].first()
    assert errors.mape is not None and errors.mape < 50
