import numpy as np

from gridlark.operators.net import predict, train


def test_training_prediction_and_back_projection(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = np.tanh(x[:, 0]) - 0.5 * x[:, 1]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    net = train(df, ["a", "b"], "y", hidden=(8,), restarts=2, epochs=60, rate=0.1)
    assert net.loss < 0.1 * y.var()
    got = predict(df, net).where("a is not null").toPandas()
    assert np.allclose(got["prediction"], net.forward(got[["a", "b"]].to_numpy())[-1][:, 0])
    assert predict(df, net).where("prediction is null").count() == 1
    start = np.zeros(2)
    up = net.back_project(start)
    assert net.forward(up)[-1][0] > net.forward(start)[-1][0] and up[0] > 0 > up[1]
    again = train(df, ["a", "b"], "y", hidden=(8,), restarts=2, epochs=60, rate=0.1)
    assert abs(again.loss - net.loss) < 1e-6  # sums of tasks come in any order
    import pytest

    with pytest.raises(ValueError):
        train(df.where("a > 99"), ["a", "b"], "y", epochs=1)


def test_kinds_of_layers_agree_with_their_expressions(spark):
    from gridlark.operators.net import KINDS, Network

    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    for kind in KINDS:
        net = Network(("a", "b"), (rng.normal(size=(3, 4)), rng.normal(size=(5, 1))), kind)
        got = predict(df, net).toPandas()
        assert np.allclose(got["prediction"], net.forward(got[["a", "b"]].to_numpy())[-1][:, 0])
        h, values = 1e-6, net.forward(x[:1])
        grad = net.back(values, np.ones((1, 1)))[1][0]
        moved = [(net.forward(x[:1] + h * np.eye(2)[k])[-1] - net.forward(x[:1] - h * np.eye(2)[k])[-1])[0, 0] / (2 * h) for k in range(2)]
        assert np.allclose(grad, moved, atol=1e-5)
