"""Canonical text: JSON, instants, numbers, CSV fields."""

import base64
import datetime
import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StoreError


def iso_ms(ts: Column) -> Column:
    """UTC text with milliseconds, rounded to the nearest."""
    return F.date_format(F.timestamp_millis(unix_ms(ts)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parsed_iso(text: Column) -> Column:
    """The instant of a UTC text with or without fractions of a second; null for any other text."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?Z$"), F.try_to_timestamp(text))


def unix_ms(ts: Column) -> Column:
    return F.round(F.unix_micros(ts) / 1000.0).cast("long")


def plain(value):
    """A value as canonical JSON may hold it."""
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise StoreError("number is not finite")
        return value + 0.0
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    if isinstance(value, datetime.datetime):
        value = value.astimezone(datetime.timezone.utc) if value.tzinfo else value.replace(tzinfo=datetime.timezone.utc)
        ms = round(value.timestamp() * 1000)
        return (datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)).isoformat(timespec="milliseconds") + "Z"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items() if v is not None}
    return [plain(v) for v in value]


def encode(value) -> bytes:
    """Keys sorted, no white space, absent members left out, numbers in their shortest form."""
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(value) -> str:
    return hashlib.sha256(encode(value)).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json(rows: pd.DataFrame) -> pd.Series:
    """Canonical JSON of a struct column, a batch at a time."""

    def clean(v):
        if hasattr(v, "tolist"):
            return [clean(x) for x in v.tolist()] if hasattr(v, "shape") and v.shape else v.item()
        return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v

    def absent(v):
        return v is None or v is pd.NaT or v is pd.NA

    names = list(rows.columns)
    return pd.Series([encode({n: clean(v) for n, v in zip(names, r, strict=True) if not absent(v)}).decode() for r in rows.itertuples(index=False, name=None)])


def number_text(value: float) -> str:
    """Shortest text that reads back as the value; zero of either sign is 0.0."""
    return "0.0" if value == 0 else repr(float(value))


def csv_field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
