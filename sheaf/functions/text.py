"""Text functions: byte lengths, clamped substrings, first and n-th substitution, formats, escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.coerce import as_kind, num_to_text

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK, _UNMARK = "\ue000", "\ue001"


def length(s: Column, unit: str = "byte") -> Column:
    return (F.octet_length(s) if unit == "byte" else F.length(s)).cast("bigint")


def substr(s: Column, start: Column | int, n: Column | int | None = None, unit: str = "byte") -> Column:
    """From a 1-based start, clamped to 1 without shortening n; n below 0 gives an empty text."""
    begin = F.greatest(F.lit(1), start if isinstance(start, Column) else F.lit(start))
    size = F.lit(1 << 30) if n is None else F.greatest(F.lit(0), n if isinstance(n, Column) else F.lit(n))
    if unit == "char":
        return F.substring(s, begin, size)
    return F.substring(s.cast("binary"), begin, size).cast("string")


def index(s: Column, t: Column, unit: str = "byte") -> Column:
    """The 1-based place of t in s, 0 if it isn't there."""
    at = F.instr(s, t)
    if unit == "char":
        return at.cast("bigint")
    return F.when(at > 0, F.octet_length(F.substring(s, F.lit(1), at - 1)) + 1).otherwise(0).cast("bigint")


def match_place(s: Column, pattern: str) -> tuple[Column, Column]:
    """(start, length) of the first match: 0 and -1 if there is none."""
    at = F.regexp_instr(s, F.lit(pattern)).cast("bigint")
    return at, F.when(at > 0, F.length(F.regexp_extract(s, pattern, 0))).otherwise(-1).cast("bigint")


def split_fields(s: Column, separator: str = " ", at_most: int | None = None) -> Column:
    """Fields of a record: " " stands for runs of blanks, else a regular expression; an empty record has none.

    at_most: the highest field needed; what follows it is one more field, unsplit.
    """
    if separator == " ":
        limit = -1 if at_most is None else at_most + 2  # blanks before the first field make an empty one
        return F.filter(F.split(s, "[ \\t]+", limit), lambda x: x != "")
    limit = -1 if at_most is None else at_most + 1
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, separator if len(separator) > 1 else re.escape(separator), limit))


def replacement(text: str) -> str:
    r"""The Java replacement for one in which & is the match and \& an ampersand."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and text[i + 1 : i + 2] in ("&", "\\"):
            out.append("\\\\" if text[i + 1] == "\\" else "&")
            i += 2
            continue
        out.append("$0" if c == "&" else "\\" + c if c in "$\\" else c)
        i += 1
    return "".join(out)


def group_replacement(text: str) -> str:
    r"""As replacement, with \0 to \9 for groups."""
    parts = re.split(r"(\\[0-9])", text)
    return "".join(f"${p[1]}" if re.fullmatch(r"\\[0-9]", p) else replacement(p) for p in parts)


def gsub(s: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, F.lit(pattern), F.lit(replacement(new)))


def gsub_count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("bigint")


def sub(s: Column, pattern: str, new: str) -> Column:
    """The first match replaced."""
    at = F.regexp_instr(s, F.lit(pattern))
    found = F.regexp_extract(s, pattern, 0)
    put = F.regexp_replace(found, F.lit(pattern), F.lit(replacement(new)))
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), put, F.substring(s, at + F.length(found), F.length(s)))).otherwise(s)


def gensub(s: Column, pattern: str, new: str, which: str | int) -> Column:
    r"""All matches (which begins with g or G) or the n-th replaced; \0 to \9 and & stand for groups."""
    put = group_replacement(new)
    if isinstance(which, str) and which[:1] in ("g", "G"):
        return F.regexp_replace(s, F.lit(pattern), F.lit(put))
    n = max(1, int(which))
    marked = F.split(F.regexp_replace(F.replace(s, F.lit(_MARK), F.lit(_UNMARK)), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK)

    def rebuilt(p):
        head, tail = F.array_join(F.slice(p, 1, 2 * n - 1), ""), F.array_join(F.slice(p, 2 * n + 1, F.greatest(F.lit(1), F.size(p))), "")
        return F.when(F.size(p) > 2 * n - 1, F.concat(head, F.regexp_replace(F.get(p, 2 * n - 1), F.lit(pattern), F.lit(put)), tail)).otherwise(s)

    return F.transform(F.array(marked), rebuilt)[0]


def upper_ascii(s: Column) -> Column:
    return F.translate(s, _LOWER, _UPPER)


def lower_ascii(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def escape_csv(s: Column) -> Column:
    r"""Quoted if it holds a quote, comma, tab or newline; quotes doubled, tab and newline as \t and \n."""
    inner = F.replace(F.replace(F.replace(s, F.lit('"'), F.lit('""')), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    return F.when(s.rlike('[",\t\n]'), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(s)


def escape_tsv(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))


def unescape(s: Column) -> Column:
    r"""\t, \n and \\ read back; another backslash stays."""
    hidden = F.replace(s, F.lit("\\\\"), F.lit(_MARK))
    return F.replace(F.replace(F.replace(hidden, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit(_MARK), F.lit("\\"))


def hex_to_int(s: Column) -> Column:
    """The hexadecimal integer that a text begins with (sign and 0x allowed), else 0."""
    digits = F.regexp_extract(s, "^-?(?:0[xX])?([0-9a-fA-F]+)", 1)
    low = F.conv(F.when(F.length(F.ltrim(digits, F.lit("0"))) > 16, F.lit("0")).otherwise(digits), 16, 10).try_cast("bigint")
    value = F.coalesce(low, F.lit(0).cast("bigint"))
    return F.when(s.startswith("-"), -value).otherwise(value)


_SPEC = re.compile(r"%([-0]*)([0-9]*)(?:\.([0-9]+))?([a-zA-Z%])")


def sprintf(fmt: str, *args: tuple[Column, str]) -> Column:
    """fmt with (column, kind) arguments: conversions d i f c e g o s x and %%; missing ones are 0 or empty."""
    out, at, rest = [], 0, list(args)
    for m in _SPEC.finditer(fmt):
        out.append(F.lit(fmt[at : m.start()]))
        at = m.end()
        flags, width, precision, conv = m.groups()
        if conv == "%":
            out.append(F.lit("%"))
            continue
        if conv not in "difcegosx":
            out.append(F.lit(m.group()))
            continue
        x, kind = rest.pop(0) if rest else (F.lit(""), "str")
        piece = _converted(conv, x, kind, precision)
        if width:
            n = int(width)
            if "-" in flags:
                piece = F.when(F.length(piece) < n, F.rpad(piece, n, " ")).otherwise(piece)
            elif "0" in flags and conv not in "sc":
                negative = piece.startswith("-")
                body = F.when(negative, F.substring(piece, F.lit(2), F.length(piece))).otherwise(piece)
                padded = F.concat(F.when(negative, "-").otherwise(""), F.repeat(F.lit("0"), F.greatest(F.lit(0), n - F.length(piece))), body)
                piece = padded
            else:
                piece = F.when(F.length(piece) < n, F.lpad(piece, n, " ")).otherwise(piece)
        out.append(piece)
    return F.concat(*out, F.lit(fmt[at:]))


def _converted(conv: str, x: Column, kind: str, precision: str | None) -> Column:
    if conv == "s":
        text = as_kind(x, kind, "str")
        return text if precision is None else F.substring(text, 1, int(precision))
    if conv in "di":
        return as_kind(x, kind, "int").cast("string")
    if conv == "c":
        return F.substring(x, 1, 1) if kind == "str" else F.chr(as_kind(x, kind, "int"))
    if conv in "ox":
        n = as_kind(x, kind, "int")
        return F.lower(F.hex(n)) if conv == "x" else F.conv(n.cast("string"), 10, 8)
    number = as_kind(x, kind, "float")
    plain = num_to_text(number) if precision is None else F.format_string(f"%.{precision}f", number)
    if conv == "f":
        return plain
    power = F.format_string(f"%.{precision or 6}e", number)
    power = F.regexp_replace(F.regexp_replace(power, r"e\+?(-?)0*([0-9])", "e$1$2"), r"(\.[0-9]*?)0+e|\.e", "$1e") if precision is None else F.regexp_replace(power, r"e\+?(-?)0*([0-9])", "e$1$2")
    power = F.regexp_replace(power, r"\.e", "e")
    return power if conv == "e" else F.when(F.length(plain) <= F.length(power), plain).otherwise(power)
