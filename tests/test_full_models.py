"""The registered model queries use the estimators' full defaults over event folds and the full search."""

import pytest

import __spark_entry__
from ledgerfold import presets as P
from ledgerfold.plans import modeling


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["M02_forest_walk_forward", "M02_boosted_walk_forward", "M04_compare_models"])
def test_tree_folds_are_full(spark, monkeypatch, name):
    def capture(df, learners, target, event, numeric, categorical, *, min_train):
        raise Seen(event, min_train, {k: (x.trees, x.depth) for k, x in learners.items()})

    monkeypatch.setattr(modeling.T, "walk_forward", capture)
    with pytest.raises(Seen) as seen:
        __spark_entry__.queries()[name](spark, __spark_entry__.SMOKE_DIR)
    both = {"forest": (200, 10), "boosted": (300, 6)}
    want = both if name.startswith("M04") else {k: v for k, v in both.items() if k in name}
    assert seen.value.args == ("date_id", P.MIN_TRAIN_EVENTS, want)


def test_search_is_full(spark, monkeypatch):
    def capture(df, order, kind, target, params, numeric, *, k):
        raise Seen(len(params), k, sorted(params[0]))

    monkeypatch.setattr(modeling.M, "random_search", capture)
    with pytest.raises(Seen) as seen:
        __spark_entry__.queries()["M05_random_search"](spark, __spark_entry__.SMOKE_DIR)
    assert seen.value.args == (20, 5, ["depth", "leaf", "split", "trees"])
