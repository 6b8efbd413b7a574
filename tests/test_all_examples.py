"""The detector is fitted to all vectors of all frames, however many there are."""

import numpy as np
import pytest

from veilframe.operators import detector

SPEC = detector.Spec(16, 16, 4, 2, 6, 4)


@pytest.fixture(scope="module")
def tables(spark):
    rng, x = np.random.default_rng(11), np.arange(16)
    cross = (abs(x[None] - x[:, None]) < 2) | (abs(x[None] + x[:, None] - 15) < 2)
    images, boxes = [], []
    for k in range(6):
        a = rng.integers(60, 140, (60, 80)).astype(np.uint8)
        a[7 * k : 7 * k + 16, 9 * k : 9 * k + 16][cross] = 230
        images.append(("m", k, a.reshape(-1).tolist(), 80, 60))
        boxes.append(("m", k, 9 * k, 7 * k, 16, 16))
    f = spark.createDataFrame(images, "movie_url string, frameset long, grey array<int>, width int, height int")
    return f, spark.createDataFrame(boxes, "movie_url string, frameset long, x int, y int, w int, h int")


def slope(model, rows):
    """Steepest slope of the loss over these rows: 0 where the model is the best one for all of them."""
    v, label = np.array([r.v for r in rows]), np.array([r.label for r in rows])
    weight = np.where(label, 0.5 / label.sum(), 0.5 / (~label).sum()) * (model.probability(v) - label)
    return max(abs((v * np.sqrt(SPEC.size)).T @ weight + 1e-3 * model.weights / np.sqrt(SPEC.size)).max(), abs(weight.sum()))


def fitted_to(rows, model):
    """Whether the model is the one fitted to these rows."""
    alone = detector.fitted(np.array([r.v for r in rows]), np.array([r.label for r in rows]), SPEC)
    return np.allclose(alone.weights, model.weights, atol=1e-6) and abs(alone.bias - model.bias) < 1e-6


def test_more_examples_than_the_former_sample(tables):
    """Before, 4,000 vectors of a label at most were taken."""
    rows = detector.examples(*tables, SPEC, 900).collect()
    assert sum(not r.label for r in rows) == 5400
    model = detector.train(*tables, SPEC, rounds=0, distractions=900)
    assert fitted_to(rows, model)
    assert slope(model, rows) < 1e-8


def test_more_false_alarms_than_the_former_sample(tables):
    spec = detector.Spec(16, 16, 4, 2, 6, 1)
    once = detector.train(*tables, spec, rounds=0, distractions=20)
    alarms = detector.false_alarms(*tables, once, (1.0,), 0.0).collect()  # every window
    assert len(alarms) > 4000
    model = detector.train(*tables, spec, rounds=1, distractions=20, least=0.0)
    rows = detector.examples(*tables, spec, 20).collect() + alarms
    assert fitted_to(rows, model) and not fitted_to(rows, once)
    assert slope(model, rows) < 1e-8


def test_the_same_model_each_time(tables):
    first, second = (detector.train(*tables, SPEC, rounds=1, distractions=30) for _ in range(2))
    assert (first.weights == second.weights).all() and first.bias == second.bias
