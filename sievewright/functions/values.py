"""Column expressions for dates as ISO text, and canonical JSON of maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso(ts: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC, with microseconds if there are any, as manifests hold it."""
    plain = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return F.concat(plain, F.when(micro > 0, F.concat(F.lit("."), F.lpad(micro.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def from_iso(text: Column) -> Column:
    """The timestamp of ISO 8601 text, with or without a zone (then UTC); null for other text."""
    zoned = F.when(text.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return zoned.try_cast("timestamp")


def canonical_json(values: Column) -> Column:
    """A map of texts as JSON with sorted keys, no blanks, and nulls as null."""
    text = lambda x: F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))
    entry = lambda e: F.concat(text(e["key"]), F.lit(":"), F.coalesce(text(e["value"]), F.lit("null")))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(values)), entry), ","), F.lit("}"))


def canonical_hash(values: Column) -> Column:
    return F.sha2(canonical_json(values), 256)
