"""Text, name and number scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def last_first(full_name: Column) -> tuple[Column, Column]:
    """Last and first name of ``Rep. Last, First [P-ST-n]``: before and after the first comma, without title and bracket."""
    shape = r"(?s)^(?:(?:Rep|Sen|Del)\.)?\s*([^,]*?)(?:,(.*?))?\s*(?:\[.*\]\s*)?$"
    part = lambda i: F.trim(F.regexp_extract(F.trim(F.coalesce(full_name, F.lit(""))), shape, i))
    return part(1), part(2)


def strip(c: Column) -> Column:
    """Without blanks and line ends on either side."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def chamber(full_name: Column) -> Column:
    """Rep, Sen, Del or ''."""
    n = F.coalesce(full_name, F.lit(""))
    return F.when(n.startswith("Rep."), "Rep").when(n.startswith("Sen."), "Sen").when(n.startswith("Del."), "Del").otherwise("")


def chamber_long(full_name: Column) -> Column:
    n = F.coalesce(full_name, F.lit(""))
    return F.when(n.startswith("Sen."), "Senate").when(n.startswith("Rep."), "House").otherwise("Unknown")


def clean_district(c: Column) -> Column:
    """``6.0`` is ``6``, ``nan`` and blank are ''."""
    t = F.trim(F.coalesce(c, F.lit("")))
    number = t.try_cast("double")
    return F.when((t == "") | (F.lower(t) == "nan"), "").when(number.isNotNull(), number.cast("bigint").cast("string")).otherwise(t)


def plain_name(c: Column) -> Column:
    """Lower case, punctuation dropped, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are 1."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def split_list(c: Column, delimiter: str = ";") -> Column:
    """Trimmed non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), delimiter), lambda x: F.trim(x)), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets are 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))
