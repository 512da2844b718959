"""Every query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import pandas as pd
import pytest

from stillpoint.plans import queries as plans


def cell(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "__float__") and not isinstance(v, str):
        return round(float(v), 6)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([cell(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_twin(spark, duck, sf, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows(got) == rows(want)
