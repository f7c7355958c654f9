"""Small helpers for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a list of ids that may be sent to every executor: 8 MB of numbers.
IDS_TO_SEND = 1_000_000


def ids_for_join(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast only if counting shows that it is small; else it is shuffled."""
    return F.broadcast(ids) if ids.count() <= IDS_TO_SEND else ids
