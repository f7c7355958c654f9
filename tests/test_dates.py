from datetime import datetime

from dateutil.parser import parse
from pyspark.sql import functions as F

from pagequarry.functions.dates import ZONE_MINUTES, iso_date

AS_OF = datetime(2024, 5, 15)
TEXTS = [
    "2024-02-13T16:17:10.123456+05:30",
    "2024-02-13 16:17",
    "2024-02-13",
    "2024/02/13",
    "20240213",
    "4:04 PM UTC-3, Feb 13, 2024",
    "13 February 2024",
    "13 Feb 2024 07:08:09 CEST",
    "Tue, 13 Feb 2024 16:17:10 GMT",
    "Tue, 13 Feb 2024 16:17:10 -0800",
    "Sept 3, 2023 12:00 AM",
    "Sep 3rd, 2023 at 12:30 PM",
    "02/13/2024",
    "13/02/2024 10:00",
    "1/2/2024",
    "13.02.2024",
    "03-04-2021 5:06 pm IST",
    "Published on May 4, 2021 by someone",
    "December 2020",
    "March 3",
    "10:30",
    "7 pm",
    "Friday",
    "2021-12-31T23:59:59-11:00",
    "1 January 99",
    "no date at all",
    "Thu Sep 25 10:36:28 2003",
    "Wed Aug 27 13:08:45 +0000 2008",
    "2003 Sep 25",
    "2003-Sep-25",
    "20240213T161710Z",
    "20030925104941",
    "2024-02",
    "2024",
    "10h36m28s",
    "25 Sep 2003 to 26 Sep 2003",
    "99:99 nonsense",
    "February 31, 2024",
]
#: Every form with other days and times, every zone behind a time.
FORMS = ["%d %b %Y %H:%M:%S", "%a, %d %B %Y %I:%M %p", "%Y/%m/%d %H:%M", "%I:%M%p on %B %d %Y", "%b %d %Y at %H:%M", "%A %d %B %Y"]
TIMES = [datetime(1998, 1, 31, 0, 5, 9), datetime(2016, 2, 29, 12, 0), datetime(2030, 12, 1, 23, 59, 58)]
TEXTS += [t.strftime(f) for f in FORMS for t in TIMES]
TEXTS += [f"{t:%d %B %Y %H:%M} {zone}" for zone in ZONE_MINUTES for t in TIMES[:2]]
TEXTS += [f"{t:%Y-%m-%d %H:%M} {zone}{sign}{hours}" for zone in ("GMT", "UTC") for sign in "+-" for hours in (1, 9) for t in TIMES[:1]]


def expected(text):
    try:
        d = parse(
            text, fuzzy=True, default=AS_OF, tzinfos={k: m * 60 for k, m in ZONE_MINUTES.items()}
        )
    except (ValueError, OverflowError):
        return None
    return d.isoformat()


def test_against_dateutil(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    as_of = F.lit(AS_OF.isoformat(" ")).cast("timestamp")
    got = {r.t: r.iso for r in df.select("t", iso_date(F.col("t"), as_of).alias("iso")).collect()}
    wrong = {t: (got[t], expected(t)) for t in TEXTS if got[t] != expected(t)}
    assert not wrong


def test_two_dates_are_none(spark):
    df = spark.createDataFrame([("published 2021-03-04, changed 2021-05-06",)], "t string")
    assert df.select(iso_date(F.col("t"), F.lit(AS_OF)).alias("iso")).first().iso is None


def test_epoch(spark):
    df = spark.createDataFrame([("1552153530",), ("1552153530999",), ("155215353",)], "t string")
    rows = df.select(iso_date(F.col("t"), F.lit("2024-01-01").cast("timestamp")).alias("iso")).collect()
    assert [r.iso for r in rows[:2]] == ["2019-03-09T17:45:30"] * 2
