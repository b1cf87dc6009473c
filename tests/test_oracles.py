"""Every registered query against its DuckDB oracle: same columns, type
families, row count and multiset of values (exact)."""

import pytest

from riskwave.ml import model as mlm
from riskwave.oracle_check import compare
from riskwave.oracles import ORACLES
from riskwave.queries import QUERIES
from tests.conftest import SF_SMALL

KEYS = sorted(k for k in QUERIES if k in ORACLES)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, duck_small, name, monkeypatch):
    # Whether stream and batch serve alike does not depend on the size of the ensemble.
    monkeypatch.setattr(mlm, "GBT_PARAMS", dict(mlm.GBT_PARAMS, maxIter=3, maxDepth=3))
    r = compare(spark, SF_SMALL, name, QUERIES[name], ORACLES[name], duck_small)
    assert "error" not in r, r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["match"], r
