"""Registered queries read the whole table and do as much as their operators' defaults."""

import numpy as np
import pytest

from quern.operators import evaluate as V
from quern.plans import catalog
from quern.session import table


@pytest.mark.parametrize("name", ["hash_encode", "index_signatures"])
def test_encoders_take_every_document(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() == table(spark, sf, "documents").count()


def test_latency_bootstrap_draws_as_often_as_the_operator(spark, sf, monkeypatch):
    monkeypatch.setattr(V, "clustered_percentile", lambda df, *columns, draws=V.SAMPLES: draws)
    assert catalog.queries()["latency_bootstrap"](spark, sf) == V.SAMPLES == 10_000


def test_weighted_percentile_is_that_of_the_repeated_values():
    rng = np.random.default_rng(3)
    for point in (0.0, 0.5, 0.95, 1.0):
        values, times = np.sort(rng.normal(size=50)), rng.integers(0, 4, 50)
        assert np.isclose(V.weighted_percentile(values, times, point), np.percentile(np.repeat(values, times), point * 100), rtol=1e-12)
