import pytest

from tests.compare import same
from tidemark import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_matches_sql(spark, small, name):
    assert same(plans.QUERIES[name](spark, small), plans.ORACLES[name], small) >= 0


def test_queries_read_whole_tables():
    """No query is cut to the first keys or to a remainder of the keys."""
    for name in ("new_order_pricing", "market_watch", "hot_cold_except", "ssn_certifier", "ssi_dangerous", "mvocc_stale_reads", "scan_many"):
        assert not any(x in plans.ORACLES[name] for x in ("l_orderkey <", "% 100 =", "% 5 =")), name
