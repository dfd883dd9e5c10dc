import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerspark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), "ledgerspark-tests")
    yield session
    session.stop()


@pytest.fixture
def no_broadcast(spark):
    """Force every lookup down the path for tables too large to broadcast."""
    spark.conf.set("spark.ledger.broadcastRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.ledger.broadcastRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


TXN_SCHEMA = "transaction_id long, date timestamp_ntz, description string, amount double, day_of_week string"


@pytest.fixture
def make(spark):
    """A transaction table from (id, date, description, amount, day_of_week[, category]) tuples."""
    from datetime import datetime

    def build(rows):
        schema = TXN_SCHEMA + (", category string" if rows and len(rows[0]) == 6 else "")
        parsed = [
            (r[0], datetime.fromisoformat(r[1]) if r[1] else None, *r[2:]) for r in rows
        ]
        return spark.createDataFrame(parsed, schema)

    return build
