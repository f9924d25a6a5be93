"""Date parsing for post timestamps.

``posted_date`` is the plain cast used by the job: the calendar date as
written, the time and any offset ignored, NULL when the string is not a date
(ANSI mode is on in Spark 4, so ``try_cast`` is used instead of ``cast``).

``lenient_date`` accepts a list of further layouts and is NULL when none
fits.

``free_date`` takes a date of free layout. It is a small grammar in built-in
expressions: what is no part of a date (times, offsets, zones, weekdays, ordinal
endings, particles) is cut out, what is left is classified field by field (a
number of four digits is a year, of eight a whole date, of one or two a day,
month or year, a name a month), and the order of the classes says which is
which. NULL when a field is left over or missing, when the day does not exist,
or when two readings are possible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts tried by lenient_date after the ISO cast, in order.
LENIENT_FORMATS = [
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "d MMM yyyy",
    "MMM d yyyy",
    "MMMM d, yyyy",
]

# "Wed Jul 15 20:01:02 +0000 2015": weekday and offset are dropped so the
# calendar date is kept as written.
_CREATED_AT = r"^[A-Za-z]{3} ([A-Za-z]{3}) (\d{1,2}) \d{2}:\d{2}:\d{2} [+-]\d{4} (\d{4})$"


def posted_date(col: Column) -> Column:
    return col.try_cast("date")


def lenient_date(col: Column) -> Column:
    s = F.trim(col)
    created_at = F.when(s.rlike(_CREATED_AT),
                        F.regexp_replace(s, _CREATED_AT, "$1 $2 $3"))
    candidates = [s.try_cast("date"),
                  F.try_to_timestamp(created_at, F.lit("MMM d yyyy")).cast("date")]
    candidates += [F.try_to_timestamp(s, F.lit(fmt)).cast("date") for fmt in LENIENT_FORMATS]
    return F.coalesce(*candidates)


# The grammar's names.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH_NAMES = _MONTHS + ["january", "february", "march", "april", "june", "july", "august",
                          "september", "sept", "october", "november", "december"]
_WEEKDAYS = (r"\b(mon(day)?|tue(s(day)?)?|wed(nesday)?|thu(r(s(day)?)?)?|fri(day)?|sat(urday)?|"
             r"sun(day)?)\b")
_CLOCK = (r"\b\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?(\s*[ap]\.?m\b\.?)?|"
          r"\b\d{1,2}\s*[ap]\.?m\b\.?")
_OFFSET = r"(?<=\s)[+-]\d{2}:?\d{2}\b"
_PARTICLES = r"\b(utc|gmt|z|[ecmp][sd]?t|of|the|at|on|st|nd|rd|th)\b"
_CENTURY = 69    # two-digit years from here on are of the last century


def _fields(col: Column) -> Column:
    """The text without what is no part of a date, in lower case."""
    s = F.lower(F.trim(col))
    for pattern, by in ((r"(?<=\d)t(?=\d)", " "), (_CLOCK, " "), (_OFFSET, " "), (_WEEKDAYS, " "),
                        (r"(?<=\d)(st|nd|rd|th)\b", ""), (_PARTICLES, " ")):
        s = F.regexp_replace(s, pattern, by)
    return F.trim(s)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def free_date(col: Column, day_first: bool | None = None) -> Column:
    """The date of a text of free layout, NULL when there is none or more than
    one. Of ``a/b/year`` a is the month and of ``a.b.year`` the day, unless a
    field above 12 says otherwise; other separators leave that open.
    ``day_first`` decides for every separator."""
    return _once(_fields(col), lambda s: _once(
        F.regexp_extract_all(s, F.lit("([0-9]+|[a-z]+)")), lambda t: _once(
            _kinds(t), lambda kinds: _read(s, t, kinds, day_first))))


def _kinds(tokens: Column) -> Column:
    """A letter for every token: year, month, day or short number, whole date."""
    return F.array_join(F.transform(tokens, lambda t: (
        F.when(t.isin(_MONTH_NAMES), "M").when(~t.rlike("^[0-9]+$"), "X")
         .when(F.length(t) == 4, "Y").when(F.length(t) == 8, "C")
         .when(F.length(t) <= 2, "N").otherwise("X"))), "")


def _read(s: Column, tokens: Column, kinds: Column, day_first: bool | None) -> Column:
    """The date by the order of the classes."""
    def number(i: int) -> Column:
        return F.get(tokens, F.lit(i)).try_cast("int")

    def month(i: int) -> Column:
        name = F.substring(F.get(tokens, F.lit(i)), 1, 3)
        return F.array_position(F.array(*map(F.lit, _MONTHS)), name).cast("int")

    def year(i: int) -> Column:
        y = number(i)
        short = F.length(F.get(tokens, F.lit(i))) <= 2
        return F.when(short & (y >= _CENTURY), y + 1900).when(short, y + 2000).otherwise(y)

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")

    a, b = number(0), number(1)
    between = F.regexp_extract(s, r"^\d+\s*([^0-9a-z\s]?)", 1)
    if day_first is None:
        turned = F.when(between == "/", False).when(between == ".", True)
    else:
        turned = F.lit(day_first)
    turned = F.when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False).otherwise(turned)
    pair = F.when(a == b, date(year(2), a, b)).when(turned, date(year(2), b, a)) \
            .when(~turned, date(year(2), a, b))
    # two-digit years only where the separator is one of dates
    short = F.when(between.isin("/", "."), pair)
    whole = F.get(tokens, F.lit(0))
    found = (F.when(kinds == "C", F.concat_ws("-", F.substring(whole, 1, 4), F.substring(whole, 5, 2),
                                              F.substring(whole, 7, 2)).try_cast("date"))
              .when(kinds == "YNN", date(a, b, number(2)))
              .when(kinds == "NNY", pair)
              .when(kinds == "NNN", short)
              .when(kinds.isin("MNY", "MNN"), date(year(2), month(0), b))
              .when(kinds.isin("NMY", "NMN"), date(year(2), month(1), a))
              .when(kinds == "YMN", date(a, month(1), number(2)))
              .when(kinds == "YNM", date(a, month(2), b)))
    return found
