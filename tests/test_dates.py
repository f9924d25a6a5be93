"""The grammar of free dates: readings, ambiguities, what is no date."""

import datetime

import pytest
from pyspark.sql import functions as F

from sentimart.functions.dates import free_date

D = datetime.date
CASES = {
    "2015-07-17": D(2015, 7, 17), "17 July 2015": D(2015, 7, 17), "July 17, 2015": D(2015, 7, 17),
    "Jul 17 '15": D(2015, 7, 17), "17-JUL-99": D(1999, 7, 17), "17jul2015": D(2015, 7, 17),
    "Wed Jul 15 20:01:02 +0000 2015": D(2015, 7, 15), "2015-07-17T23:59:59.000-08:00": D(2015, 7, 17),
    "20150717": D(2015, 7, 17), "7/17/15": D(2015, 7, 17), "17/7/2015": D(2015, 7, 17),
    "07/08/2015": D(2015, 7, 8), "07.08.2015": D(2015, 8, 7), "17.7.15": D(2015, 7, 17),
    "07-08-2015": None, "08-08-2015": D(2015, 8, 8), "17-08-2015": D(2015, 8, 17),
    "2015-17-07": None, "2015-02-30": None, "2016-02-29": D(2016, 2, 29), "2015-02-29": None,
    "the 1st of May 2020": D(2020, 5, 1), "Sept. 3rd, 2021 at 5 pm": D(2021, 9, 3),
    "Tuesday the 2nd, June 1998 10:30am EST": D(1998, 6, 2), "2015年7月17日": D(2015, 7, 17),
    "July 2015": None, "2015": None, "17": None, "": None, " ": None, None: None, "not a date 5": None,
    "may": None, "2015-07-17 and more": None, "17 18 2015 7": None, "123/4/2015": None,
    "13/13/2015": None, "0/1/2015": None, "31 Apr 2020": None, "99999999": None, "1436931662": None,
    "5 6 7": None, "May 5 6": D(2006, 5, 5), "12:30 2020/1/2": D(2020, 1, 2), "x" * 50_000: None,
    "1 " * 20_000: None, "March 3 2020 March": None, "2020 5 Jan": D(2020, 1, 5),
}


def test_readings(spark):
    texts = list(CASES)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {texts[r.i]: r.d for r in df.select("i", free_date(F.col("t")).alias("d")).collect()}
    assert {k: v for k, v in got.items() if v != CASES[k]} == {}


@pytest.mark.parametrize("day_first, want", [(True, D(2015, 8, 7)), (False, D(2015, 7, 8))])
def test_day_first_decides(spark, day_first, want):
    df = spark.createDataFrame([("07/08/2015",), ("07.08.2015",), ("07-08-2015",)], "t string")
    got = df.select(free_date(F.col("t"), day_first).alias("d")).collect()
    assert [r.d for r in got] == [want] * 3


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("2015-07-17",)], "t string").select(free_date(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
