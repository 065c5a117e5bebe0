"""Scalars of reports, records and files: shortened and humanised texts, ids, digests, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(c: Column) -> Column:
    """SHA-256 in hexadecimal; NULL of NULL."""
    return F.sha2(c, 256)


def shortened(c: Column, most: int) -> Column:
    return F.substring(c, 1, most)


def numbered(prefix: str, n: Column, width: int = 3) -> Column:
    """``prefix`` and a number padded with zeros; longer numbers stay whole."""
    t = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t))


def humanised(c: Column) -> Column:
    """Underscores as blanks, words capitalised."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def anchor(c: Column) -> Column:
    """The id of a section: lower case, blanks as dashes."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def file_stem(c: Column) -> Column:
    """A name usable in a file: lower case, blanks as underscores, slashes and commas dropped."""
    return F.replace(F.regexp_replace(F.lower(c), "[/,]", ""), F.lit(" "), F.lit("_"))


def table_line(columns: list[tuple[Column, int]]) -> Column:
    """Columns cut and padded to fixed widths, a blank between."""
    return F.concat_ws(" ", *[F.rpad(F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, w), w, " ") for c, w in columns])


def header_preview(names: list[str], first: int = 5) -> str:
    """The first names of a table's columns and how many there are."""
    return ", ".join(names[:first]) + (f", … ({len(names)} columns)" if len(names) > first else "")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def plain_reason(reason: Column) -> Column:
    """The reasons of a low score in words."""
    # fixed values: what the reasons say
    words = {"short_name": "the name is short", "type_conflict": "the registry has it under another type", "not_in_registry": "the registry does not have it", "low_base_score": "nothing speaks for it"}
    return F.concat_ws(", ", F.transform(F.split(reason, ", "), lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), r), r)))


def context_of(text: Column, context: Column, name: Column, width: int = 60) -> Column:
    """Where the context stands in the text (from 0): whole, else its first ``width`` characters, else the name; -1 if nowhere."""
    at = lambda part: F.when((part != "") & (F.position(part, text) > 0), F.position(part, text) - 1)
    return F.coalesce(at(context), at(F.substring(context, 1, width)), at(name), F.lit(-1))


def window(text: Column, start: Column, end: Column, side: int = 20, most: int = 150) -> Column:
    """The span with ``side`` characters around it, at most ``most`` of them."""
    first = F.greatest(start - side, F.lit(0))
    return F.substring(text, first + 1, F.least(end + side - first, F.lit(most)))


def blank_date(c: Column) -> Column:
    """The date of a text; NULL of a blank one or one that is none."""
    return F.nullif(F.trim(c), F.lit("")).try_cast("date")


def utc_text(c: Column) -> Column:
    """A timestamp in UTC as ISO-8601, seconds."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def time_suffix(c: Column) -> Column:
    """A timestamp as the end of a file name."""
    return F.date_format(c, "yyyyMMdd_HHmmss")


def seconds_left(started: Column, now: Column, every: float) -> Column:
    """Seconds until the next call of a service that takes one every ``every`` seconds; never negative."""
    gone = F.unix_micros(now.cast("timestamp")) / 1e6 - F.unix_micros(started.cast("timestamp")) / 1e6
    return F.greatest(F.lit(0.0), F.lit(float(every)) - gone)


def batches(n: Column, size: int) -> Column:
    """How many batches of ``size`` hold ``n`` rows."""
    return F.ceil(n / size)


def megabytes(n: Column) -> Column:
    return F.floor(n / (1024 * 1024))


def clamped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def scaled(c: Column, largest: Column, low: float, high: float) -> Column:
    """``c`` over the largest value, as a size between ``low`` and ``high``; ``low`` where the largest is 0."""
    return F.when(largest > 0, clamped(low + (high - low) * c / largest, low, high)).otherwise(F.lit(low))


def truthy_entries(m: Column) -> Column:
    """A map without entries that are NULL or empty."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def entry_or(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def appended(values: Column, value: Column) -> Column:
    """An array with a value at its end unless it has it already."""
    return F.when(F.array_contains(values, value), values).otherwise(F.array_append(values, value))


def inside_any(name: Column, values: Column) -> Column:
    """Whether a name is part of another value of an array."""
    return F.exists(values, lambda v: v.contains(name) & (v != name))


def first_counted(json: Column, keys: list[str]) -> Column:
    """The length of the first list found under one of the keys of a JSON object; 0 if there is none."""
    return F.coalesce(*[F.json_array_length(F.get_json_object(json, f"$.{k}")) for k in keys], F.lit(0))
