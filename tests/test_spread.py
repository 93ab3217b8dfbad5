"""Steps that sort and aggregate rows several times keep a number of partitions, however well their rows compress."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ledger
from ledgerloom.operators.catalogue import search_prefixes
from ledgerloom.plans.facts import Facts
from ledgerloom.plans.ledger_queries import tx_fees
from ledgerloom.plans.trace_queries import frames_of

STEPS = {
    "frames": frames_of,
    "fees": tx_fees,
    "prefixes": lambda t: search_prefixes(t.creations),
    "history": lambda t: ledger.balance_history(t.deltas),
    "activity": lambda t: ledger.address_activity(ledger.transfer_volume(t.outputs), ledger.total_received(t.outputs)),
}


@pytest.mark.parametrize("name", STEPS)
def test_rows_stay_spread(spark, sf, name):
    parts = STEPS[name](Facts(spark, sf)).select(F.spark_partition_id().alias("part")).distinct().count()
    assert parts >= 8  # merged to one before
