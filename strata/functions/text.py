"""Splitting and regularizing text, as Column expressions (all inside code generation)."""

from __future__ import annotations

import re
import shlex

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = " \t[],"


def split_fields(s: Column, delimiter: str = ",") -> Column:
    """Fields between delimiters; one empty field at the end is dropped, so '' has none."""
    parts = F.split(s, re.escape(delimiter), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokenize(s: Column, separators: str = SEPARATORS) -> Column:
    """Non-empty tokens between any of the separators."""
    cls = "[" + "".join("\\" + c if c in "[]\\^-" else c for c in separators) + "]"
    return F.filter(F.split(s, cls, -1), lambda x: x != "")


def tokenize_distinct(s: Column, separators: str = SEPARATORS) -> Column:
    return F.array_distinct(tokenize(s, separators))


def tokenize_args(line: str) -> list[str] | None:
    """Words of a command line, quotes honoured; None if a quote is left open."""
    try:
        return shlex.split(line)
    except ValueError:
        return None


def to_numbers(s: Column, kind: str = "int") -> Column:
    return F.transform(tokenize(s, " [],"), lambda x: x.try_cast(kind))


def to_indices(s: Column) -> Column:
    """Non-negative whole numbers; others become null."""
    return F.transform(tokenize(s, " [],"), lambda x: F.when(x.try_cast("int") >= 0, x.try_cast("int")))


def extract_elements(parts: Column, positions: list[int]) -> Column:
    """The elements at 0-based positions, null where a position is out of range."""
    return F.array(*[F.try_element_at(parts, F.lit(p + 1)) for p in positions])


def regularize_csv(s: Column) -> Column:
    """Outer white space and that around commas removed."""
    return F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"\s*(,)\s*", "$1")


def replace_space(s: Column, by: str) -> Column:
    return F.regexp_replace(s, r"\s+", by.replace("\\", "\\\\").replace("$", "\\$"))


def regularize_integers(s: Column) -> Column:
    """Leading zeros of whole numbers removed."""
    return F.regexp_replace(s, r"\b0+([0-9])", "$1")


def regularize_floats(s: Column) -> Column:
    """Zeros at the end of a fraction removed, and the point with them if none is left."""
    return F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*[1-9])0+\b", "$1"), r"\.0+\b", "")


def entry_name(*parts: Column) -> Column:
    """Attributes joined by ^; an attribute that holds ^ is an error."""
    bad = F.lit(False)
    for p in parts:
        bad = bad | p.contains("^")
    return F.when(bad, F.raise_error(F.lit("illegal attribute in a data entry name"))).otherwise(F.concat_ws("^", *parts))


def global_key(*parts: Column) -> Column:
    return F.concat_ws("::", *parts)


def parse_row(s: Column) -> Column:
    """'{c1:v1,c2:v2}' as a map."""
    inner = F.regexp_replace(s, r"^\s*\{|\}\s*$", "")
    return F.map_from_entries(F.transform(tokenize(inner, ",|; "), lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)), F.split_part(p, F.lit(":"), F.lit(2)))))


def diff_text(key: Column, lhs: Column, rhs: Column) -> Column:
    """key:(lhs,rhs), with _ for what is missing."""
    return F.concat(key.cast("string"), F.lit(":("), F.coalesce(lhs, F.lit("_")), F.lit(","), F.coalesce(rhs, F.lit("_")), F.lit(")"))


def storage_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def time_text(ms: float) -> str:
    if ms < 1000:
        return f"{ms:.1f} ms"
    s = ms / 1000
    return f"{s:.2f} s" if s < 60 else f"{int(s // 60)} m {s % 60:.0f} s" if s < 3600 else f"{int(s // 3600)} h {int(s % 3600 // 60)} m"
