"""Lines in the order that a sort command names: keys by field, numbers, reversal, distinct lines."""

from __future__ import annotations

import re
import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = re.compile(r"([0-9]+)([nr]*)(?:,([0-9]+)([nr]*))?")


def _fields(line: Column, separator: str | None, first: int, last: int | None) -> Column:
    """The text from one field to another; without a separator a field begins with the blanks before it."""
    if separator is None:
        skipped = rf"^(?:[ \t]*[^ \t]+){{{first - 1}}}"
        return F.regexp_extract(line, skipped + ("(.*)$" if last is None else rf"((?:[ \t]*[^ \t]+){{0,{last - first + 1}}})"), 1)
    parts = F.split(line, re.escape(separator))
    length = F.size(parts) if last is None else F.lit(max(0, last - first + 1))
    return F.array_join(F.slice(parts, first, length), separator)


def _number(s: Column) -> Column:
    return F.coalesce(F.regexp_extract(s, r"^[ \t]*(-?[0-9]*\.?[0-9]*)", 1).try_cast("double"), F.lit(0.0))


def sort_keys(command: str, line: Column) -> tuple[list[Column], bool]:
    r"""The columns that `sort` with flags -n, -r, -u, -t and -k orders lines by, as bytes, and whether equal lines are one.

    -u is for whole lines only. Numbers are doubles. The line itself decides ties.
    """
    words = shlex.split(command)
    if not words or words[0] != "sort":
        raise ValueError(f"not a sort command: {command}")
    everywhere, separator, wanted, distinct = "", None, [], False
    rest = iter(words[1:])
    for w in rest:
        if not w.startswith("-") or w == "-":
            raise ValueError(f"sort reads what is printed, not {w}")
        flags = w[1:]
        while flags:
            flag, flags = flags[0], flags[1:]
            if flag in "nr":
                everywhere += flag
            elif flag == "u":
                distinct = True
            elif flag in "tk":
                value, flags = flags or next(rest, ""), ""
                if flag == "t" and len(value) == 1:
                    separator = value
                elif flag == "k" and (m := _KEY.fullmatch(value)) and int(m[1]) > 0:
                    wanted.append((int(m[1]), m[3] and int(m[3]), m[2] + (m[4] or "")))
                else:
                    raise ValueError(f"-{flag} {value} of sort")
            else:
                raise ValueError(f"-{flag} of sort")
    if distinct and (wanted or "n" in everywhere):
        raise ValueError("-u of sort with keys")
    order = lambda c, how: c.desc() if "r" in how else c.asc()
    keys = []
    for first, last, own in wanted or ([(0, None, "")] if "n" in everywhere else []):
        how = own or everywhere
        key = _fields(line, separator, first, last) if first else line
        keys.append(order(_number(key) if "n" in how else key, how))
    return [*keys, order(line, everywhere)], distinct


def sorted_lines(df: DataFrame, command: str, line: str = "line") -> DataFrame:
    """df in the order of a sort command; with -u each line once."""
    keys, distinct = sort_keys(command, F.col(line))
    return (df.dropDuplicates([line]) if distinct else df).orderBy(*keys)
