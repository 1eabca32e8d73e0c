"""Calendar-digit time: ``yyyyMMddHHmmss`` packed in a BIGINT.

Encoded order is chronological, so comparisons hold; differences are not
durations.  Literals are decoded once on the driver and compared with the raw
timestamp column, because only a predicate on the raw column reaches Parquet.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The divisor that leaves each period of an encoded time.
PERIODS = {"year": 10**10, "month": 10**8, "day": 10**6, "hour": 10**4, "minute": 10**2}

Instant = int | str | datetime | date


def divisor(unit: str) -> int:
    try:
        return PERIODS[unit.lower()]
    except KeyError:
        raise ValueError(f"period must be one of {sorted(PERIODS)}, not {unit!r}") from None


def encode(ts: Column | str) -> Column:
    """TIMESTAMP to BIGINT calendar digits, cut to the second."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(ts, "yyyyMMddHHmmss").cast("bigint")


def decode(t: Column | str) -> Column:
    """BIGINT calendar digits to TIMESTAMP_NTZ; null if it is no calendar instant."""
    t = F.col(t) if isinstance(t, str) else t
    return F.try_to_timestamp(F.lpad(t.cast("string"), 14, "0"), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def period_bucket(t: Column | str, unit: str) -> Column:
    """The period of an encoded time, e.g. 202401 for a month."""
    t = F.col(t) if isinstance(t, str) else t
    return F.call_function("div", t, F.lit(divisor(unit)).cast("bigint"))


def _local(x: datetime) -> datetime:
    """Without a zone: one that has a zone is told in the session's, UTC without a session."""
    if x.tzinfo is None:
        return x
    spark = SparkSession.getActiveSession()
    zone = spark.conf.get("spark.sql.session.timeZone") if spark else "UTC"
    return x.astimezone(ZoneInfo(zone)).replace(tzinfo=None)


def to_datetime(x: Instant) -> datetime | None:
    """A query bound as a datetime; None for digits that are no calendar instant."""
    if isinstance(x, datetime):
        return _local(x)
    if isinstance(x, date):
        return datetime(x.year, x.month, x.day)
    if isinstance(x, str):
        return _local(datetime.fromisoformat(x))
    try:
        return datetime.strptime(f"{x:014d}", "%Y%m%d%H%M%S")
    except ValueError:
        return None


def to_encoded(x: Instant) -> int:
    return x if isinstance(x, int) else int(to_datetime(x).strftime("%Y%m%d%H%M%S"))


def _lit(at: datetime, kind: T.DataType) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").cast(kind)


def kind_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_calendar(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


class Axis:
    """Comparisons of one time column with query instants, of either kind.

    On a timestamp column an encoded bound stands for a whole second, as the
    encoding drops fractions: ``<= e`` is then ``< e + 1 s``.
    """

    def __init__(self, df: DataFrame, name: str):
        self.col, self.kind = df[name], kind_of(df, name)
        if isinstance(self.kind, T.DateType):
            self.col, self.kind = self.col.cast("timestamp_ntz"), T.TimestampNTZType()
        self.calendar = is_calendar(self.kind)

    def _split(self, x: Instant) -> tuple[Column, Column | int, bool]:
        """The column to compare, the bound, and whether the bound is a whole second."""
        if not self.calendar:
            return self.col, to_encoded(x), False
        at = to_datetime(x)
        if at is None:
            return encode(self.col), x, False
        return self.col, at, isinstance(x, int)

    def _value(self, v) -> Column:
        return _lit(v, self.kind) if isinstance(v, datetime) else F.lit(v)

    def at_least(self, x: Instant) -> Column:
        c, v, _ = self._split(x)
        return c >= self._value(v)

    def below(self, x: Instant) -> Column:
        c, v, _ = self._split(x)
        return c < self._value(v)

    def at_most(self, x: Instant) -> Column:
        c, v, second = self._split(x)
        return c < self._value(v + timedelta(seconds=1)) if second else c <= self._value(v)

    def equals(self, x: Instant) -> Column:
        c, v, second = self._split(x)
        return self.at_least(x) & self.at_most(x) if second else c == self._value(v)
