"""Every registered query against its SQL on the smallest tables; the others must run."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tools.check import compare, duck  # noqa: E402

from saldo.catalog import load  # noqa: E402

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    msg = compare(spark, con, name, QUERIES[name], SQL.get(name), SMALL)
    assert msg.startswith(("ok", "ROWS")), msg
