import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from orderlens.session import local_session

    session = local_session(cores="*", shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def standins(spark):
    from orderlens.sources.standins import StandIns

    return StandIns(spark, SF01)


@pytest.fixture(scope="session")
def enriched(spark, standins):
    from orderlens.operators.enrich import build_enriched

    df = build_enriched(standins.sor_detail, standins.sor_master, standins.ar_customer,
                        standins.inv_master)
    return df.cache()
