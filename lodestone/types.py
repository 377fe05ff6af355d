"""The sixteen column types, their Spark types and their text forms.

At rest and in DataFrames a TIME is a long of nanoseconds of the day, since Parquet files cannot hold
Spark's time type; rows given and fetched hold ``datetime.time``. A TIMESTAMP_WITH_TIME_ZONE is a struct
of the instant and the zone's name. A UUID is its canonical string and sorts as one.
"""

from __future__ import annotations

import base64
import datetime as dt
import uuid
from enum import Enum
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import types as T


class DataType(Enum):
    SHORT = "short"
    INT = "int"
    LONG = "long"
    FLOAT = "float"
    DOUBLE = "double"
    CHAR = "char"
    VARCHAR = "varchar"
    BOOLEAN = "boolean"
    DATE = "date"
    TIME = "time"
    TIMESTAMP = "timestamp"
    TIMESTAMP_WITH_TIME_ZONE = "timestamp_with_time_zone"
    INTERVAL = "interval"
    UUID = "uuid"
    BYTE = "byte"
    VARBYTE = "varbyte"

    # -- properties -----------------------------------------------------------------------------

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def fixed_size(self) -> int | None:
        """Bytes of a value; None where the column must say."""
        return _SIZE.get(self)

    @property
    def indexable(self) -> bool:
        return self not in (DataType.VARCHAR, DataType.BOOLEAN, DataType.TIMESTAMP_WITH_TIME_ZONE, DataType.INTERVAL, DataType.BYTE, DataType.VARBYTE)

    @property
    def sized(self) -> bool:
        return self in (DataType.CHAR, DataType.VARCHAR, DataType.BYTE, DataType.VARBYTE)

    @property
    def integral(self) -> bool:
        return self in _RANGE

    @property
    def floating(self) -> bool:
        return self in (DataType.FLOAT, DataType.DOUBLE)

    @classmethod
    def of(cls, name: str) -> DataType:
        """By name or alias, without case."""
        key = name.strip().upper()
        if key not in cls.__members__ and key not in _ALIAS:
            raise ValueError(f"unknown type {name!r}")
        return _ALIAS.get(key) or cls[key]

    @classmethod
    def detect(cls, value: Any) -> DataType:
        """The type of a Python value; integers get the narrowest of INT and LONG."""
        if isinstance(value, bool):
            return cls.BOOLEAN
        if isinstance(value, int):
            return cls.INT if -(1 << 31) <= value < 1 << 31 else cls.LONG
        if isinstance(value, dt.datetime):
            return cls.TIMESTAMP if value.tzinfo is None else cls.TIMESTAMP_WITH_TIME_ZONE
        for kind, t in ((float, cls.DOUBLE), (str, cls.VARCHAR), (dt.date, cls.DATE), (dt.time, cls.TIME), (dt.timedelta, cls.INTERVAL), (uuid.UUID, cls.UUID), (bytes, cls.VARBYTE), (bytearray, cls.VARBYTE)):
            if isinstance(value, kind):
                return t
        raise ValueError(f"no type for {type(value).__name__}")

    # -- values ---------------------------------------------------------------------------------

    def accepts(self, value: Any) -> bool:
        """Exact typing: no widening from integers to floating point, no booleans as integers."""
        if value is None:
            return True
        if self in _RANGE:
            return isinstance(value, int) and not isinstance(value, bool) and -_RANGE[self] <= value < _RANGE[self]
        if self is DataType.DATE:
            return isinstance(value, dt.date) and not isinstance(value, dt.datetime)
        if self is DataType.TIMESTAMP:
            return isinstance(value, dt.datetime) and value.tzinfo is None
        if self is DataType.TIMESTAMP_WITH_TIME_ZONE:
            return isinstance(value, dt.datetime) and value.tzinfo is not None
        return isinstance(value, _CLASS[self])

    def stored(self, value: Any) -> Any:
        """The value as the DataFrame holds it."""
        if value is None:
            return None
        if self is DataType.TIME:
            return ((value.hour * 60 + value.minute) * 60 + value.second) * 10**9 + value.microsecond * 1000
        if self is DataType.UUID:
            return str(value)
        if self is DataType.TIMESTAMP_WITH_TIME_ZONE:
            return (value.astimezone(dt.UTC), str(value.tzinfo))
        return bytes(value) if self in (DataType.BYTE, DataType.VARBYTE) else value

    def loaded(self, value: Any) -> Any:
        """The value as a row gives it."""
        if value is None:
            return None
        if self is DataType.TIME:
            s, ns = divmod(value, 10**9)
            return dt.time(s // 3600, s // 60 % 60, s % 60, ns // 1000)
        if self is DataType.UUID:
            return uuid.UUID(value)
        if self is DataType.TIMESTAMP_WITH_TIME_ZONE:
            at = value[0] if value[0].tzinfo else value[0].replace(tzinfo=dt.UTC)
            return at.astimezone(dt.UTC if value[1] == "UTC" else ZoneInfo(value[1]))
        return bytes(value) if self in (DataType.BYTE, DataType.VARBYTE) else value

    def parse(self, text: str | None) -> Any:
        """A value from its text; "NULL" and None are null, binary is Base64, booleans are strict."""
        if text is None or text.upper() == "NULL":
            return None
        if self in _RANGE:
            value: Any = int(text)
        elif self.floating:
            value = float(text)
        elif self is DataType.BOOLEAN:
            if text.lower() not in ("true", "false"):
                raise ValueError(f"not a boolean: {text!r}")
            value = text.lower() == "true"
        elif self in (DataType.BYTE, DataType.VARBYTE):
            value = base64.b64decode(text, validate=True)
        elif self is DataType.INTERVAL:
            value = dt.timedelta(seconds=float(text))
        elif self is DataType.UUID:
            value = uuid.UUID(text)
        elif self in (DataType.CHAR, DataType.VARCHAR):
            value = text
        else:
            kind = {DataType.DATE: dt.date, DataType.TIME: dt.time}.get(self, dt.datetime)
            value = kind.fromisoformat(text)
        if not self.accepts(value):
            raise ValueError(f"{text!r} is not a {self.name}")
        return value

    def format(self, value: Any) -> str:
        """The text of a value, which ``parse`` reads."""
        if value is None:
            return "NULL"
        if self in (DataType.BYTE, DataType.VARBYTE):
            return base64.b64encode(value).decode()
        if self is DataType.BOOLEAN:
            return str(value).lower()
        if self is DataType.INTERVAL:
            return str(value.total_seconds())
        return value.isoformat() if hasattr(value, "isoformat") else str(value)


#: Other names of types.
_ALIAS = {"BOOL": DataType.BOOLEAN, "DATETIME": DataType.TIMESTAMP, "TIMESTAMPTZ": DataType.TIMESTAMP_WITH_TIME_ZONE, "DURATION": DataType.INTERVAL}
_RANGE = {DataType.SHORT: 1 << 15, DataType.INT: 1 << 31, DataType.LONG: 1 << 63}
#: Bytes of the fixed-size types.
_SIZE = {
    DataType.SHORT: 2, DataType.INT: 4, DataType.LONG: 8, DataType.FLOAT: 4, DataType.DOUBLE: 8, DataType.BOOLEAN: 1, DataType.DATE: 8,
    DataType.TIME: 8, DataType.TIMESTAMP: 16, DataType.INTERVAL: 16, DataType.UUID: 16,
}
_CLASS = {
    DataType.FLOAT: float, DataType.DOUBLE: float, DataType.CHAR: str, DataType.VARCHAR: str, DataType.BOOLEAN: bool, DataType.TIME: dt.time,
    DataType.INTERVAL: dt.timedelta, DataType.UUID: uuid.UUID, DataType.BYTE: (bytes, bytearray), DataType.VARBYTE: (bytes, bytearray),
}
_SPARK = {
    DataType.SHORT: T.ShortType(), DataType.INT: T.IntegerType(), DataType.LONG: T.LongType(), DataType.FLOAT: T.FloatType(), DataType.DOUBLE: T.DoubleType(),
    DataType.CHAR: T.StringType(), DataType.VARCHAR: T.StringType(), DataType.BOOLEAN: T.BooleanType(), DataType.DATE: T.DateType(), DataType.TIME: T.LongType(),
    DataType.TIMESTAMP: T.TimestampNTZType(), DataType.INTERVAL: T.DayTimeIntervalType(), DataType.UUID: T.StringType(),
    DataType.TIMESTAMP_WITH_TIME_ZONE: T.StructType([T.StructField("instant", T.TimestampType()), T.StructField("zone", T.StringType())]),
    DataType.BYTE: T.BinaryType(), DataType.VARBYTE: T.BinaryType(),
}
