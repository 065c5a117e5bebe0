"""Several values packed in one field: one row per value, position kept.

Quoted spans, and known names that hold punctuation, are replaced by indexed placeholders; the rest is split at the
delimiters; each item gets its spans back by array lookup; the array is exploded with positions. All of it is built-in
expressions over one row: no shuffle.

The placeholder is U+E000, digits, U+E001. A U+E000 of the input is first written as U+E000 'e', so no input can form
a placeholder.

Defined results: a NULL, empty or blank field gives no rows; empty values between delimiters are skipped and take no
position; repeats keep their own positions; an unclosed quotation mark is an ordinary character; a field of any length
is handled by possessive (iterative) patterns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = ";,|/\t\n\r"
_OPEN, _CLOSE = "", ""
_BLANK = r"[^\S\t\n\r]*+"


def _sets(delimiters: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-|" else c for c in delimiters) + "]"


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _trie(names: Iterable[str]) -> str:
    """A pattern of the names, the longest first, in which names share their beginnings: one path is tried, not every name."""
    root: dict = {}
    for n in names:
        node = root
        for c in n:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        parts = []
        for c in sorted(k for k in node if k):
            text, child = c, node[c]
            while len(child) == 1 and "" not in child:
                (c, child), = child.items()
                text += c
            parts.append(_quoted(text) + build(child))
        if not parts:
            return ""
        return "(?:" + "|".join(parts) + ")" + ("?" if "" in node else "")

    return build(root)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often and deep it is used."""
    return F.transform(F.array(value), use)[0]


def span_pattern(names: Iterable[str] = (), delimiters: str = DELIMITERS) -> str:
    """Whole items that must not be split: quoted with doubled or escaped marks inside, or one of ``names``."""
    d = _sets(delimiters)
    alternatives = [
        r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"',
        r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'",
    ]
    held = sorted({n.strip() for n in names if n and set(n) & set(delimiters)}, key=lambda n: (-len(n), n))
    alternatives += ["(?iu:" + _trie(held) + ")"] if held else []
    return rf"(?:^|(?<={d})){_BLANK}(?:{'|'.join(alternatives)})(?={_BLANK}(?:{d}|$))"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def _unquote(item: Column) -> Column:
    n = F.length(item)
    inner = F.substring(item, F.lit(2), n - 2)
    double = (n >= 2) & item.startswith('"') & item.endswith('"')
    single = (n >= 2) & item.startswith("'") & item.endswith("'")
    plain = F.regexp_replace(F.regexp_replace(inner, '""', '"'), r"(?s)\\(.)", "$1")
    as_json = F.from_json(F.concat(F.lit("["), item, F.lit("]")), "array<string>")
    return (
        F.when(double, F.when(item.contains("\\"), F.coalesce(F.when(F.size(as_json) == 1, as_json[0]), plain)).otherwise(plain))
        .when(single, F.regexp_replace(F.regexp_replace(inner, "''", "'"), r"(?s)\\(.)", "$1"))
        .otherwise(item)
    )


def packed_items(field: Column, names: Iterable[str] = (), delimiters: str = DELIMITERS) -> Column:
    """``field`` as an array of its non-empty values, in order."""
    pattern = span_pattern(names, delimiters)
    safe = F.replace(field, F.lit(_OPEN), F.lit(_OPEN + "e"))
    safe = F.when(safe.rlike(r"(?s)^\s*\[.*\]\s*$"), F.regexp_replace(safe, r"^\s*\[|\]\s*$", "")).otherwise(safe)

    def restore(item: Column, spans: Column) -> Column:
        back = F.array_join(
            F.transform(
                F.split(item, rf"(?={_OPEN}[0-9])|(?<={_CLOSE})", -1),
                lambda t: F.when(
                    t.rlike(rf"^{_OPEN}[0-9]+{_CLOSE}$"), F.get(spans, F.regexp_extract(t, "([0-9]+)", 1).cast("int"))
                ).otherwise(t),
            ),
            "",
        )
        return F.when(item.contains(_OPEN), back).otherwise(item)

    def masked(text: Column) -> Column:
        """The text with placeholders, and its spans."""
        parts = F.transform(
            F.split(text, pattern, -1),
            lambda p, i: F.when(i > 0, F.concat(F.lit(_OPEN), (i - 1).cast("string"), F.lit(_CLOSE), p)).otherwise(p),
        )
        return F.struct(F.array_join(parts, "").alias("text"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("spans"))

    def items(m: Column) -> Column:
        return F.transform(
            F.split(m["text"], _sets(delimiters), -1),
            lambda x: F.replace(_strip(_once(_strip(restore(x, m["spans"])), _unquote)), F.lit(_OPEN + "e"), F.lit(_OPEN)),
        )

    return F.filter(_once(_once(safe, masked), items), lambda x: x != "")


def split_packed(
    df: DataFrame, key: str, fields: list[str], names: Iterable[str] = (), delimiters: str = DELIMITERS
) -> DataFrame:
    """Rows ``(key, field_name, item_pos, item)`` of the packed ``fields`` of ``df``; positions count from 1.

    ``names`` are known values that may hold delimiters (a reference list of bounded size, sent inside the plan).
    """
    names = list(names)
    packed = F.array(
        *[F.struct(F.lit(f).alias("field_name"), packed_items(F.col(f), names, delimiters).alias("items")) for f in fields]
    )
    return (
        df.select(F.col(key), F.explode(packed).alias("p"))
        .select(key, F.col("p.field_name").alias("field_name"), F.posexplode("p.items").alias("at", "item"))
        .select(key, "field_name", (F.col("at") + 1).cast("bigint").alias("item_pos"), "item")
    )


def reference_names(*tables: DataFrame, column: str = "name", at_most: int = 20_000) -> list[str]:
    """Names of small reference lists that hold a delimiter. A longer list is refused: it would not fit in a plan."""
    out: list[str] = []
    for t in tables:
        held = t.select(column).where(F.col(column).rlike(_sets(DELIMITERS))).distinct().limit(at_most + 1).collect()
        if len(held) > at_most:
            raise ValueError(f"more than {at_most} reference names hold a delimiter")
        out += [r[0] for r in held]
    return sorted(out)
