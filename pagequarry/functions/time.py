"""Points in time as zone-free timestamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the last moment a timestamp can hold.
MAX_MOMENT = datetime(9999, 12, 31, 23, 59, 59, 999999)


def moment(as_of: Column | datetime | None) -> Column:
    """``as_of`` as TIMESTAMP_NTZ; now, if not given."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, datetime):
        return F.lit(as_of.isoformat(" ")).cast("timestamp_ntz")
    return as_of.cast("timestamp_ntz")


def instant(as_of: Column | datetime | None) -> Column:
    """``as_of`` as TIMESTAMP, read in the session time zone; now, if not given."""
    return F.current_timestamp() if as_of is None else moment(as_of).cast("timestamp")
