"""The registered model queries run their whole searches."""

import inspect

import pytest

import __spark_entry__ as contract
from postlab.operators import models as M


class Seen(Exception):
    pass


@pytest.fixture
def calls(monkeypatch):
    """The arguments, defaults included, of the first search a query starts."""
    def spy(name):
        signature = inspect.signature(getattr(M, name))

        def seen(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            raise Seen(bound.arguments)

        monkeypatch.setattr(M, name, seen)

    def call(query, name, spark, sf):
        spy(name)
        with pytest.raises(Seen) as found:
            contract.queries()[query](spark, sf)
        return found.value.args[0]

    return call


def test_repeated_splits_run_ten_by_ten_over_the_whole_grid(spark, sf, calls):
    got = calls("m9_repeated_split_scores", "repeated_split_scores", spark, sf)
    assert (got["repetitions"], got["folds"]) == (10, 10)
    assert got["settings"] == M.GRIDS["logistic_regression"]


@pytest.mark.parametrize("query, name", [
    ("m7_grid_search", "logistic_regression"), ("m7_grid_search_baseline", "baseline"),
    ("m7_grid_search_svm", "svm"), ("m7_grid_search_forest", "random_forest")])
def test_every_grid_has_a_query(spark, sf, calls, query, name):
    got = calls(query, "grid_search", spark, sf)
    assert got["settings"] == M.GRIDS[name] and got["folds"] == 5
