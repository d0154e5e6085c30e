"""Planning of scripts: which run as DataFrame expressions, which as aggregates, and which record by record.

- stateless: rules that print what depends on the record and constants only.
  Each rule is a branch of one array that is exploded, in rule order. Variables
  set and read for one record, assignments to fields and to the record,
  substitutions, and calls of functions that return expressions are carried as
  expressions.
- ordered: the same, with what comes from earlier records added as columns by
  the operators of order: first occurrences (!seen[k]++), ranges of records,
  running sums, and a value of the record before. It needs order_by, whose
  columns must tell records apart.
- lookup: a first rule that loads arrays from the first input (NR == FNR, with
  next), and rules as above that read them or test for their keys. Each array is
  one grouped aggregation, each use by another key one left join. Files must
  follow each other in the order.
- counters: rules that only add to variables or array elements, keep a largest,
  smallest or last value (with what stands beside it), or print; and an END that
  prints what was kept. Each array is one grouped aggregation, the variables one
  more; what stands beside a largest value is found in a second scan.
- sequential: everything else. Records go in the given order through one
  evaluator; with parallel=True each partition has its own and the states are
  merged as sums, unions and any text that is not empty, before END.

BEGIN runs on the driver, where its variables become constants.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import coerce, mathx
from sheaf.functions import fields as fields_
from sheaf.functions import text as text_
from sheaf.operators.lines import sorted_lines
from sheaf.operators.ordered import previous_record, range_flag, record_number, running_total
from sheaf.runtime import ship, written
from sheaf.script.evaluate import Machine, split_form, text
from sheaf.script.syntax import Node, Program, Rule, ScriptError, parse
from sheaf.sources import readers
from sheaf.sources.sinks import write_targets


class _NoPlan(Exception):
    """The script's shape is not one that the planner knows."""


Typed = tuple[Column, str]


def _walk(x: Any) -> Iterator[Node]:
    if isinstance(x, Node):
        yield x
        for a in x.args:
            yield from _walk(a)
    elif isinstance(x, (list, tuple)):
        for a in x:
            yield from _walk(a)


def _rewritten(x: Any, change: Callable[[Node], Node]) -> Any:
    """A program, or a part of one, with nodes changed from the leaves up."""
    if isinstance(x, Node):
        return change(Node(x.kind, tuple(_rewritten(a, change) for a in x.args)))
    if isinstance(x, Rule):
        return Rule(*[_rewritten(a, change) for a in (x.pattern, x.last, x.body)])
    if isinstance(x, Program):
        functions = {name: (params, _rewritten(body, change)) for name, (params, body) in x.functions.items()}
        return Program(*[_rewritten(a, change) for a in (x.begin, x.rules, x.prepare, x.end)], functions)
    return type(x)(_rewritten(a, change) for a in x) if isinstance(x, (list, tuple)) else x


class _Columns:
    """Expressions over one record (or one row of an aggregate) as typed columns."""

    def __init__(self, constants: dict[str, Any], fs: str | None, variables: dict[str, Typed] | None = None, elements=None, record: bool = True, functions: dict | None = None, members=None) -> None:
        self.constants, self.fs = constants, fs
        self.variables, self.elements, self.members, self.record = variables or {}, elements, members, record
        self.functions = functions or {}
        #: Conditions under which the statement at hand runs, and what statements before it changed: the record, its fields, variables.
        self.guards: tuple[Column, ...] = ()
        self.line_now: Column = F.col("line")
        self.fields_now: Column = F.col("fields")
        self.set_here: dict[str, tuple[Column, str, tuple[Column, ...]]] = {}
        self.calls = 0
        self.changes = False

    def __call__(self, e: Node) -> Typed:
        f = getattr(self, f"on_{e.kind}", None)
        if f is None:
            raise _NoPlan(e.kind)
        return f(e)

    def want(self, e: Node, kind: str) -> Column:
        c, have = self(e)
        return coerce.as_kind(c, have, kind)

    def test(self, e: Node) -> Column:
        if e.kind in ("regex", "match", "compare", "and", "or") or (e.kind == "unary" and e[0] == "!"):
            return self.truth(e)
        c, kind = self(e)
        return coerce.truthy(c, kind)

    def truth(self, e: Node) -> Column:
        if e.kind == "regex":
            return _matches(self.line(), e[0])
        if e.kind == "match":
            negated, a, p = e.args
            hit = _matches(self.want(a, "str"), p[0]) if p.kind in ("regex", "str") else F.regexp_like(self.want(a, "str"), self.want(p, "str"))
            return ~hit if negated else hit
        if e.kind == "compare":
            (a, ka), (b, kb) = self(e[1]), self(e[2])
            return coerce.compare(e[0], a, ka, b, kb)
        if e.kind == "unary":
            return ~self.test(e[1])
        a, b = self.test(e[0]), self.test(e[1])
        return a & b if e.kind == "and" else a | b

    def line(self) -> Column:
        if not self.record:
            raise _NoPlan("the record outside rules")
        return self.line_now

    def _here(self, new: Column, old: Column) -> Column:
        """new where the statement at hand runs, else old."""
        return new if not self.guards else F.when(_all(self.guards), new).otherwise(old)

    def assign(self, target: Node, value: Typed) -> None:
        """What a statement sets holds for the rest of the record's rules."""
        if not self.changes:
            raise _NoPlan("an assignment")
        c, kind = value
        if target.kind == "field":
            if target[0].kind != "int" or target[0][0] < 0:
                raise _NoPlan("a computed field is changed")
            n, new = target[0][0], coerce.as_kind(c, kind, "str")
            if n == 0:
                if self.fs is None:
                    raise _NoPlan("the record is set, to CSV or TSV")
                fields = text_.split_fields(new, self.fs)
            else:
                fields = fields_.assign(self.fields_now, n, new)
                new = fields_.rebuild(fields, text(self.constants["OFS"]))
            self.line_now, self.fields_now = self._here(new, self.line_now), self._here(fields, self.fields_now)
        elif target.kind == "var" and target[0] not in self.variables and target[0] not in _LIVE:
            name = target[0]
            held = self.set_here.get(name)
            if held and _begins(self.guards, held[2]) and len(self.guards) > len(held[2]):
                old, before, where = held
                both = before if before == kind else "str" if "str" in (before, kind) else "float"
                inner = _all(self.guards[len(where) :])
                self.set_here[name] = F.when(inner, coerce.as_kind(c, kind, both)).otherwise(coerce.as_kind(old, before, both)), both, where
            else:
                self.set_here[name] = c, kind, self.guards
        else:
            raise _NoPlan("an element or a built-in variable is changed")

    def on_assign(self, e: Node) -> Typed:
        op, target, value = e.args
        got = self(value) if op == "=" else self.on_binary(Node("binary", (op[0], target, value)))
        self.assign(target, got)
        return got

    def on_step(self, e: Node) -> Typed:
        op, post, target = e.args
        old, kind = self(target)
        old, kind = (coerce.to_num(old), "float") if kind == "str" else (old, kind)
        new = (old + 1 if op == "++" else old - 1), kind
        self.assign(target, new)
        return (old, kind) if post else new

    def _substitute(self, name: str, args: list[Node]) -> Typed:
        """The number of replacements, which the target holds from then on."""
        target = args[2] if len(args) > 2 else Node("field", (Node("int", (0,)),))
        if args[0].kind not in ("regex", "str") or args[1].kind != "str":
            raise _NoPlan("a pattern or replacement that is no constant")
        old, pattern, new = self.want(target, "str"), args[0][0], args[1][0]
        if name == "gsub":
            n, put = text_.gsub_count(old, pattern), text_.gsub(old, pattern, new)
        else:
            n, put = (F.regexp_instr(old, F.lit(pattern)) > 0).cast("bigint"), text_.sub(old, pattern, new)
        guards, self.guards = self.guards, (*self.guards, n > 0)
        self.assign(target, (put, "str"))
        self.guards = guards
        return n, "int"

    def _inline(self, name: str, args: list[Node]) -> Typed:
        """A call of a function whose value is an expression of its arguments."""
        params, body = self.functions[name]
        self.calls += 1
        if self.calls > 12 or len(args) > len(params):
            raise _NoPlan("recursion")
        values = [self(a) for a in args] + [(F.lit(""), "str")] * (len(params) - len(args))
        kept = self.set_here, self.guards, self.variables, self.line_now, self.fields_now
        self.set_here, self.guards = {p: (c, k, ()) for p, (c, k) in zip(params, values, strict=True)}, ()
        try:
            got = self._value([body] if isinstance(body, Node) else list(body), frozenset(params))
        finally:
            self.set_here, self.guards, self.variables, line, fields = kept
            self.calls -= 1
        if self.line_now is not line or self.fields_now is not fields:
            raise _NoPlan("a function changes the record")
        return got

    def _value(self, statements: list[Node], own: frozenset[str]) -> Typed:
        if not statements:
            return F.lit(""), "str"
        s, rest = statements[0], statements[1:]
        if s.kind == "block":
            return self._value([*s.args, *rest], own)
        if s.kind == "return":
            return self(s[0]) if s[0] is not None else (F.lit(""), "str")
        if s.kind == "if":
            test, held = self.test(s[0]), dict(self.set_here)
            a, ka = self._value([s[1], *rest], own)
            self.set_here = held
            b, kb = self._value([*([s[2]] if s[2] is not None else []), *rest], own)
            kind = ka if ka == kb else "str" if "str" in (ka, kb) else "float"
            return F.when(test, coerce.as_kind(a, ka, kind)).otherwise(coerce.as_kind(b, kb, kind)), kind
        if s.kind == "expr" and s[0].kind == "assign" and s[0][1].kind == "var" and s[0][1][0] in own:
            before, self.changes = self.changes, True
            self(s[0])
            self.changes = before
            return self._value(rest, own)
        raise _NoPlan(f"{s.kind} in a function")

    def on_int(self, e: Node) -> Typed:
        return F.lit(e[0]).cast("bigint"), "int"

    def on_float(self, e: Node) -> Typed:
        return F.lit(e[0]), "float"

    def on_str(self, e: Node) -> Typed:
        return F.lit(e[0]), "str"

    def _bool(self, e: Node) -> Typed:
        return self.truth(e).cast("bigint"), "int"

    on_regex = on_match = on_compare = on_and = on_or = _bool

    def on_field(self, e: Node) -> Typed:
        if e[0].kind == "int" and e[0][0] == 0:
            return self.line(), "str"
        self.line()
        n = e[0][0] if e[0].kind == "int" else self.want(e[0], "int")
        if isinstance(n, int):
            return F.coalesce(F.get(self.fields_now, n - 1), F.lit("")), "str"
        return F.when(n == 0, self.line()).otherwise(fields_.nth(self.fields_now, F.when(n == 0, 1).otherwise(n))), "str"

    def on_column(self, e: Node) -> Typed:
        return F.col(e[0]), e[1]

    def on_var(self, e: Node) -> Typed:
        name = e[0]
        if name in self.set_here:
            c, kind, where = self.set_here[name]
            if not _begins(self.guards, where):
                raise _NoPlan(f"variable {name} may keep its value")
            return c, kind
        if name in self.variables:
            return self.variables[name]
        if name == "NF" and self.record:
            return fields_.count(self.fields_now), "int"
        if name == "FILENAME" and self.record:
            return F.col("file"), "str"
        if name in self.constants:
            v = self.constants[name]
            if isinstance(v, dict):
                raise _NoPlan("an array as a value")
            return F.lit(v), "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str"
        raise _NoPlan(f"variable {name}")

    def on_index(self, e: Node) -> Typed:
        if self.elements is None:
            raise _NoPlan("array element")
        return self.elements(e)

    def on_in(self, e: Node) -> Typed:
        if self.members is None:
            raise _NoPlan("a test for a key")
        return self.members(e).cast("bigint"), "int"

    def on_cond(self, e: Node) -> Typed:
        (a, ka), (b, kb) = self(e[1]), self(e[2])
        kind = ka if ka == kb else "str" if "str" in (ka, kb) else "float"
        return F.when(self.test(e[0]), coerce.as_kind(a, ka, kind)).otherwise(coerce.as_kind(b, kb, kind)), kind

    def on_concat(self, e: Node) -> Typed:
        return F.concat(self.want(e[0], "str"), self.want(e[1], "str")), "str"

    def on_unary(self, e: Node) -> Typed:
        if e[0] == "!":
            return self._bool(e)
        c, kind = self(e[1])
        if kind == "str":
            c, kind = coerce.to_num(c), "float"
        return (-c if e[0] == "-" else c), kind

    def on_binary(self, e: Node) -> Typed:
        op = e[0]
        (a, ka), (b, kb) = self(e[1]), self(e[2])
        if ka == kb == "int" and op in "+-*%":
            return {"+": mathx.add_int, "-": mathx.subtract_int, "*": mathx.multiply_int, "%": mathx.modulo_int}[op](a, b), "int"
        a, b = coerce.as_kind(a, ka, "float"), coerce.as_kind(b, kb, "float")
        if op == "/":
            return mathx.divide(a, b), "float"
        if op == "%":
            return mathx.modulo_float(a, b), "float"
        return {"+": a + b, "-": a - b, "*": a * b, "^": F.pow(a, b)}[op], "float"

    def on_call(self, e: Node) -> Typed:
        name, args = e.args
        if name in self.functions:
            return self._inline(name, args)
        if name in ("sub", "gsub"):
            return self._substitute(name, args)
        s = lambda i: self.want(args[i], "str")
        x = lambda i: self.want(args[i], "float")
        n = lambda i: self.want(args[i], "int")
        if name == "length":
            return text_.length(s(0) if args else self.line()), "int"
        if name == "substr":
            return text_.substr(s(0), n(1).cast("int"), *([n(2).cast("int")] if len(args) > 2 else [])), "str"
        if name == "index":
            return text_.index(s(0), s(1)), "int"
        if name in ("toupper", "tolower", "escape_csv", "escape_tsv"):
            f = {"toupper": text_.upper_ascii, "tolower": text_.lower_ascii, "escape_csv": text_.escape_csv, "escape_tsv": text_.escape_tsv}[name]
            return f(s(0)), "str"
        if name == "int":
            return n(0), "int"
        if name == "hex":
            return text_.hex_to_int(s(0)), "int"
        if name in ("sin", "cos", "atan", "exp", "sqrt"):
            return getattr(F, name)(x(0)), "float"
        if name in ("log", "log2", "log10"):
            return mathx.log(x(0), {"log": "e", "log2": "2", "log10": "10"}[name]), "float"
        if name == "atan2":
            return F.atan2(x(0), x(1)), "float"
        if name in ("and", "or", "xor"):
            return {"and": mathx.bit_and, "or": mathx.bit_or, "xor": mathx.bit_xor}[name](n(0), n(1)), "int"
        if name == "compl":
            return mathx.bit_not(n(0)), "int"
        if name in ("lshift", "rshift", "rshiftl") and args[1].kind == "int":
            f = {"lshift": mathx.shift_left, "rshift": mathx.shift_right, "rshiftl": mathx.shift_right_logical}[name]
            return f(n(0), args[1][0]), "int"
        if name == "sprintf" and args and args[0].kind == "str":
            return text_.sprintf(args[0][0], *[self(a) for a in args[1:]]), "str"
        if name == "gensub" and len(args) > 2 and args[0].kind in ("regex", "str") and args[1].kind == "str" and args[2].kind in ("int", "str"):
            return text_.gensub(s(3) if len(args) > 3 else self.line(), args[0][0], args[1][0], args[2][0]), "str"
        if name in ("join_fields", "join_csv", "join_tsv") and all(a.kind in ("int", "str") for a in args):
            values = [a[0] for a in args]
            if name == "join_fields" and len(values) < 3:
                values.append(text(self.constants["OFS"]))
            self.line()
            return getattr(fields_, name)(self.fields_now, *values), "str"
        raise _NoPlan(f"function {name}")


def _matches(s: Column, pattern: str) -> Column:
    """A search; plain beginnings, ends and substrings as such, which sources can use."""
    plain = lambda p: bool(p) and not any(c in p for c in "\\.^$|?*+()[]{}")
    if pattern.startswith("^") and plain(pattern[1:]):
        return s.startswith(pattern[1:])
    if pattern.endswith("$") and plain(pattern[:-1]):
        return s.endswith(pattern[:-1])
    return s.contains(pattern) if plain(pattern) else s.rlike(pattern)


_OUT = "line string, target string"
_LIVE = {"NR", "FNR", "NF", "FILENAME", "RSTART", "RLENGTH", "PID", "FS", "OFS", "ORS", "RS", "SUBSEP"}


def _begins(guards: tuple[Column, ...], first: tuple[Column, ...]) -> bool:
    """Whether guards begin with the same conditions."""
    return len(guards) >= len(first) and all(a is b for a, b in zip(guards, first, strict=False))


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


class Script:
    """A program ready to run over DataFrames with a column `line` (and `file`, if it has several inputs).

    form: "csv" or "tsv", the fields of a line are those of such a file.
    output: "csv" or "tsv", what print is given is escaped and joined so (FS, OFS and formats of printf aside).
    header: the first record names the fields: FI["name"] is the number of one; it is no record then.
    print | "sort ..." orders what the script prints, if all of it goes there.
    """

    def __init__(self, source: str, variables: dict[str, Any] | None = None, form: str | None = None, output: str | None = None, header: bool = False) -> None:
        if form not in (None, "csv", "tsv") or output not in (None, "csv", "tsv"):
            raise ScriptError("form and output are csv or tsv")
        self.source, self.variables, self.form, self.header = source, dict(variables or {}), form, header
        self.program: Program = parse(source)
        if output:
            self.variables["OFS"] = "," if output == "csv" else "\t"
            self.program = _rewritten(self.program, lambda n: Node("print", ([Node("call", (f"escape_{output}", [a])) for a in n[0]], *n.args[1:])) if n.kind == "print" else n)
        for n in _walk([self.program.begin, self.program.end, self.program.prepare, [(r.pattern, r.last, r.body) for r in self.program.rules], [b for _, b in self.program.functions.values()]]):
            if n.kind == "call" and n[0] == "system":
                raise ScriptError("commands are not run")

    def kind(self) -> str:
        """stateless, ordered, lookup, counters or sequential: how the script will run."""
        machine, on = self._begun()
        if not on:
            return "stateless"
        for name, plan in (("stateless", self._rows), ("ordered", self._in_order), ("lookup", self._looked_up), ("counters", self._totals)):
            try:
                plan(None, machine, None)
                return name
            except _NoPlan:
                pass
        return "sequential"

    def _begun(self) -> tuple[Machine, bool]:
        m = Machine(self.program, self.variables, self.form)
        return m, m.begin()

    def run(self, df: DataFrame, order_by: list[str] | None = None, parallel: bool = False) -> DataFrame:
        """What the script prints, one row (line) a print, without the newline at its end."""
        prints = [n for n in _walk([self.program.begin, self.program.end, [r.body for r in self.program.rules], [b for _, b in self.program.functions.values()]]) if n.kind in ("print", "printf")]
        commands = {n[2][0] if n[1] == "|" and n[2].kind == "str" else None for n in prints} | {None for r in self.program.rules if r.body is None}
        if len(commands) == 1 and None not in commands:
            plain = copy.copy(self)
            plain.program = _rewritten(self.program, lambda n: Node(n.kind, (n[0], None, None)) if n.kind in ("print", "printf") else n)
            return sorted_lines(plain._run(df, order_by, parallel).select("line"), commands.pop())
        return self._run(df, order_by, parallel).select("line")

    def _named(self, df: DataFrame, order_by: list[str] | None) -> tuple[Script, DataFrame]:
        """The script with the names of the first record in place, and the records after it."""
        if not order_by:
            raise ScriptError("a header needs order_by")
        named = copy.copy(self)
        named.header = False
        first = df.orderBy(*order_by).limit(1).collect()  # one row
        line = (first[0]["line"] or "") if first else ""
        names = split_form(line, self.form) if self.form else Machine(self.program).split_text(line, text(self._begun()[0].globals["FS"]))
        at = {x: i for i, x in enumerate(names, 1)}
        named.variables = self.variables | {"FI": at}
        known = lambda n: n.kind == "index" and n[0] == "FI" and len(n[1]) == 1 and n[1][0].kind == "str"
        named.program = _rewritten(self.program, lambda n: Node("int", (at.get(n[1][0][0], 0),)) if known(n) else n)
        for c in first[:1]:
            same = F.lit(True)
            for name in order_by:
                same = same & F.col(name).eqNullSafe(F.lit(c[name]))
            df = df.where(~same)
        return named, df

    def write(self, df: DataFrame, path: str, order_by: list[str] | None = None, parallel: bool = False) -> DataFrame:
        """Run the script; what it prints to files goes to folders target=<name> under path, the rest is returned as rows.

        What an earlier run left there is replaced, or added to if the script appends (>>).
        """
        rows = written(self._run(df, order_by, parallel))
        p = self.program
        append = any(n.kind in ("print", "printf") and n[1] == ">>" for n in _walk([p.begin, p.end, [r.body for r in p.rules], [b for _, b in p.functions.values()]]))
        write_targets(rows.where("target is not null"), F.col("line"), F.col("target"), path, append)
        return rows.where("target is null").select("line")

    def _run(self, df: DataFrame, order_by: list[str] | None, parallel: bool) -> DataFrame:
        """What is printed, as line and target."""
        if self.header:
            named, df = self._named(df, order_by)
            return named._run(df, order_by, parallel)
        spark = df.sparkSession
        machine, on = self._begun()
        first = [(t.removesuffix("\n"), target) for target, t in machine.out]
        machine.out = []
        before = spark.createDataFrame(first, _OUT) if first else None
        if not on or not (self.program.rules or self.program.end):
            return before if before is not None else spark.createDataFrame([], _OUT)
        if "file" not in df.columns:
            df = df.withColumn("file", F.lit(""))
        out = None
        for plan in (self._rows, self._in_order, self._looked_up, self._totals):
            try:
                out = plan(df, machine, order_by)
                break
            except _NoPlan:
                pass
        if out is None:
            ship(spark)
            out = self._merged(df, machine) if parallel else self._sequential(df, machine, order_by)
        return out if before is None else before.unionByName(out)

    def _constants(self, machine: Machine) -> dict[str, Any]:
        """Variables that nothing after BEGIN changes."""
        changed = set()
        for n in _walk([self.program.end, self.program.prepare, [(r.pattern, r.last, r.body) for r in self.program.rules]]):
            if n.kind == "assign" and n[1].kind != "field":
                changed.add(n[1][0])
            elif n.kind == "step" and n[2].kind != "field":
                changed.add(n[2][0])
            elif n.kind in ("getline", "forin") or n.kind == "call" and n[0] in ("split", "sub", "gsub", "match", "rand", "srand"):
                changed |= {"NF"} if n.kind != "forin" else {n[0]}
        live = {"NR", "FNR", "NF", "FILENAME", "RSTART", "RLENGTH", "PID"}
        return {k: v for k, v in machine.globals.items() if k not in changed | live}

    def _prepared(self, df: DataFrame | None, machine: Machine, order_by: list[str] | None, rules: list | None = None) -> tuple[DataFrame | None, dict[str, Typed]]:
        """df with fields, and with record numbers where the rules read them."""
        fs = text(machine.globals["FS"])
        rules = self.program.rules if rules is None else rules
        used = {n[0] for n in _walk([(r.pattern, r.last, r.body) for r in rules]) if n.kind == "var"} & {"NR", "FNR"}
        if used and df is not None and not order_by:
            raise ScriptError("NR and FNR need order_by")
        if df is not None:
            line = F.col("line")
            fields = readers.csv_fields(line) if self.form == "csv" else readers.tsv_fields(line) if self.form else text_.split_fields(line, fs, self._last_field())
            df = df.withColumn("fields", fields)
            if "NR" in used:
                df = record_number(df, list(order_by or []), name="_nr")
            if "FNR" in used:
                df = record_number(df, list(order_by or []), ["file"], "_fnr")
        return df, {k: (F.col(f"_{k.lower()}"), "int") for k in used}

    def _last_field(self) -> int | None:
        """The highest field that rules read; None if they may read or count any, or change one."""
        nodes = list(_walk([(r.pattern, r.last, r.body) for r in self.program.rules]))
        if self.program.functions or any(n.kind == "var" and n[0] == "NF" or n.kind == "call" and n[0] in ("sub", "gsub", "join_fields", "join_csv", "join_tsv") for n in nodes):
            return None
        targets = [n[1] if n.kind == "assign" else n[2] for n in nodes if n.kind in ("assign", "step")]
        fields = [n[0] for n in nodes if n.kind == "field"]
        if any(t.kind == "field" for t in targets) or any(n.kind != "int" for n in fields):
            return None
        return max([1, *[n[0] for n in fields]])

    # stateless

    def _rows(self, df: DataFrame | None, machine: Machine, order_by: list[str] | None) -> DataFrame | None:
        p = self.program
        if p.end or p.prepare or any(r.last for r in p.rules):
            raise _NoPlan("END, PREPARE or ranges")
        df, numbers = self._prepared(df, machine, order_by)
        return self._printed(df, machine, p.rules, numbers)

    def _columns(self, machine: Machine, variables: dict[str, Typed]) -> _Columns:
        cols = _Columns(self._constants(machine), None if self.form else text(machine.globals["FS"]), variables, functions=self.program.functions)
        cols.changes = True
        return cols

    def _printed(self, df: DataFrame | None, machine: Machine, rules: list, variables: dict[str, Typed], cols: _Columns | None = None) -> DataFrame | None:
        """What rules print about each record, in rule order."""
        cols = cols or self._columns(machine, variables)
        ofs, ors = (text(machine.globals[k]) for k in ("OFS", "ORS"))
        prints: list[Column] = []
        stopped: list[Column] = []

        def live(guards: list[Column]) -> Column:
            return _all([*guards, *[~s for s in stopped]])

        def do(s: Node | None, guards: list[Column]) -> None:
            if s is None:
                return
            cols.guards = tuple(guards)
            if s.kind == "expr":
                cols(s[0])
            elif s.kind == "block":
                for x in s.args:
                    do(x, guards)
            elif s.kind == "if":
                test = cols.test(s[0])
                do(s[1], [*guards, test])
                do(s[2], [*guards, ~test])
                cols.guards = tuple(guards)
            elif s.kind == "next":
                stopped.append(live(guards))
            elif s.kind in ("print", "printf") and s[1] != "|":
                if s.kind == "print":
                    parts = [cols.want(a, "str") for a in s[0]] or [cols.line()]
                    line = F.concat_ws(ofs, *parts)
                    line = line if ors == "\n" else F.concat(line, F.lit(ors.removesuffix("\n")))
                else:
                    if s[0][0].kind != "str":
                        raise _NoPlan("a format that is no constant")
                    line = F.regexp_replace(text_.sprintf(s[0][0][0], *[cols(a) for a in s[0][1:]]), "\n\\z", "")
                target = F.lit(None).cast("string") if s[1] is None else cols.want(s[2], "str")
                prints.append(F.when(live(guards), F.struct(line.alias("line"), target.alias("target"))))
            else:
                raise _NoPlan(s.kind)

        for r in rules:
            cols.guards = ()
            guards = [] if r.pattern is None else [cols.test(r.pattern)]
            do(r.body if r.body is not None else Node("print", ([], None, None)), guards)
        if df is None:
            return None
        if not prints:
            return df.sparkSession.createDataFrame([], _OUT)
        return df.select(F.explode(F.filter(F.array(*prints), lambda x: x.isNotNull())).alias("_p")).select("_p.line", "_p.target")

    # in order

    def _in_order(self, df: DataFrame | None, machine: Machine, order_by: list[str] | None) -> DataFrame | None:
        """As rows, with columns for first occurrences, ranges, running sums and values of the record before."""
        p = self.program
        if p.end or p.prepare:
            raise _NoPlan("END or PREPARE")
        if df is not None and not order_by:
            raise ScriptError("what depends on earlier records needs order_by")
        df, variables = self._prepared(df, machine, order_by)
        order = list(order_by or [])
        rules = [Rule(r.pattern, r.last, r.body) for r in p.rules]
        fresh = lambda: self._columns(machine, dict(variables))
        changed = any(n.kind in ("assign", "step") and n.args[1 if n.kind == "assign" else 2].kind == "field" or n.kind == "call" and n[0] in ("sub", "gsub") for r in rules for n in _walk(r.body))
        if changed:
            raise _NoPlan("the record is changed")

        for k, r in enumerate(rules):
            seen = r.pattern
            if seen is not None and r.last is None and seen.kind == "unary" and seen[0] == "!" and seen[1].kind == "step" and seen[1][0] == "++" and seen[1][1] and seen[1][2].kind == "index":
                array = seen[1][2][0]
                if sum(n.kind == "index" and n[0] == array or n.kind in ("forin", "in") and n[1] == array for x in rules for n in _walk((x.pattern, x.last, x.body))) != 1:
                    raise _NoPlan("the array is used elsewhere")
                if k and any(n.kind == "next" for x in rules[:k] for n in _walk(x.body)):
                    raise _NoPlan("not every record reaches the rule")
                cols = fresh()
                keys = [cols.want(x, "str") for x in seen[1][2][1]]
                if df is not None:
                    df = df.withColumn("_key", F.concat_ws("\x1c", *keys))
                    first = df.groupBy("_key").agg(F.min(F.struct(*order)).alias("_at")).select("_key", F.col("_at.*"), F.lit(True).alias(f"_first{k}"))
                    df = df.join(first, ["_key", *order], "left").withColumn(f"_first{k}", F.col(f"_first{k}").isNotNull().cast("bigint")).drop("_key")
                rules[k] = Rule(Node("column", (f"_first{k}", "int")), None, r.body)
            elif r.last is not None:
                cols = fresh()
                start, stop = cols.test(r.pattern), cols.test(r.last)
                if df is not None:
                    df = range_flag(df, order, start, stop, name=f"_range{k}").withColumn(f"_range{k}", F.col(f"_range{k}").cast("bigint"))
                rules[k] = Rule(Node("column", (f"_range{k}", "int")), None, r.body)

        df = self._carried(df, rules, fresh, variables, order)
        return self._printed(df, machine, rules, variables)

    def _carried(self, df: DataFrame | None, rules: list, fresh, variables: dict[str, Typed], order: list[str]) -> DataFrame | None:
        """Running sums and values of the record before, for variables that one statement of a rule without pattern changes.

        The statement is taken out; reads before it see the state before the
        record, reads after it the state with it.
        """
        changes: dict[str, list] = {}
        for k, r in enumerate(rules):
            for n in _walk((r.pattern, r.body)):
                if n.kind in ("assign", "step"):
                    target = n[1] if n.kind == "assign" else n[2]
                    if target.kind != "var":
                        raise _NoPlan("an element is changed")
                    changes.setdefault(target[0], []).append((k, n))
                elif n.kind == "getline" or n.kind in ("next", "nextfile", "exit"):
                    raise _NoPlan(n.kind)
        for name, where in changes.items():
            k, n = where[0]
            r = rules[k]
            own = r.body.args if r.body is not None and r.body.kind == "block" else (r.body,)
            at = next((i for i, x in enumerate(own) if x.kind == "expr" and x[0] is n), None)
            if len(where) > 1 or at is None:
                raise _NoPlan(f"variable {name} is changed in other ways")
            guarded = r.pattern is not None
            reads = lambda part: any(x.kind == "var" and x[0] == name for x in _walk(part))  # noqa: E731, B023
            early = [r.pattern, own[:at], [(x.pattern, x.body) for x in rules[:k]]]
            late = [own[at + 1 :], [(x.pattern, x.body) for x in rules[k + 1 :]]]
            if n.kind == "assign" and n[0] == "=":
                if not reads(early):
                    continue  # set and read for one record
                if reads(late) or reads(n[2]) or guarded:
                    raise _NoPlan(f"variable {name} is read on both sides")
                value, kind = fresh()(n[2])
                if kind != "str":
                    raise _NoPlan("a number of the record before")
                if df is not None:
                    df = previous_record(df, order, value, name=f"_before_{name}", default="")
                variables[name] = F.col(f"_before_{name}"), "str"
            elif n.kind == "step" or n[0] in ("+=", "-="):
                if reads(early) or n.kind != "step" and reads(n[2]):
                    raise _NoPlan(f"variable {name} is read before it grows")
                value, kind = (F.lit(1).cast("bigint"), "int") if n.kind == "step" else fresh()(n[2])
                value, kind = (coerce.to_num(value), "float") if kind == "str" else (value, kind)
                value = -value if (n[0] in ("--", "-=")) else value
                if guarded:
                    value = F.when(fresh().test(r.pattern), value)
                if df is not None:
                    df = running_total(df, order, value, name=f"_total_{name}")
                variables[name] = F.col(f"_total_{name}"), kind
            else:
                raise _NoPlan(n.kind)
            rules[k] = Rule(r.pattern, None, Node("block", tuple(x for i, x in enumerate(own) if i != at)))
        return df

    # lookups between inputs

    def _looked_up(self, df: DataFrame | None, machine: Machine, order_by: list[str] | None) -> DataFrame | None:
        """Arrays of the first input as tables by key, joined to the records of the others."""
        p = self.program
        if p.end or p.prepare or any(r.last for r in p.rules) or not p.rules or not _first_input(p.rules[0].pattern):
            raise _NoPlan("no first input")
        load, rules = p.rules[0].body, p.rules[1:]
        steps = load.args if load is not None and load.kind == "block" else (load,)
        if steps[-1] is None or steps[-1].kind != "next" or any(s.kind != "expr" for s in steps[:-1]):
            raise _NoPlan("the first input is not only loaded")
        if df is not None and not order_by:
            raise ScriptError("NR and FNR need order_by")
        df, numbers = self._prepared(df, machine, order_by, rules)
        fresh = lambda: self._columns(machine, dict(numbers))
        one = fresh()
        loaded: dict[str, tuple[Column, Column, str]] = {}
        for s in steps[:-1]:
            e = s[0]
            target = e if e.kind == "index" else e[1] if e.kind == "assign" else e[2] if e.kind == "step" else None
            if target is None or target.kind != "index" or target[0] in loaded:
                raise _NoPlan("what the first input sets")
            key = F.concat_ws("\x1c", *[one.want(k, "str") for k in target[1]])
            if e.kind == "index":
                value, kind = F.first(F.lit("")), "str"
            elif e.kind == "assign" and e[0] == "=":
                c, kind = one(e[2])
                value = F.max_by(c, F.struct(*(order_by or ["line"])))
            elif e.kind == "step" or e[0] in ("+=", "-="):
                c, kind = (F.lit(1).cast("bigint"), "int") if e.kind == "step" else one(e[2])
                c, kind = (coerce.to_num(c), "float") if kind == "str" else (c, kind)
                value = F.sum(-c if e[0] in ("--", "-=") else c)
            else:
                raise _NoPlan("an element is changed")
            loaded[target[0]] = key, value, kind
        if any(n.kind in ("assign", "step") and n.args[1 if n.kind == "assign" else 2].kind == "field" or n.kind == "call" and n[0] in ("sub", "gsub") for r in rules for n in _walk(r.body)):
            raise _NoPlan("the record is changed")
        parts = [(r.pattern, r.body) for r in rules]
        uses = {(n[0], repr(n[1])) if n.kind == "index" else (n[1], repr(n[0])): n[1] if n.kind == "index" else n[0] for n in _walk(parts) if n.kind in ("index", "in")}
        if not uses or any(name not in loaded for name, _ in uses):
            raise _NoPlan("an array that the first input does not set")
        tested = {n[1] for n in _walk(parts) if n.kind == "in"}
        for pattern, body in parts:
            sure = _tested(pattern)
            if not (_sure(pattern, frozenset(), tested, loaded) and _sure(body, sure, tested, loaded)):
                raise _NoPlan("an element that may not be there")
        rest = None
        if df is not None:
            first = F.broadcast(df.orderBy(*order_by).limit(1).select(F.col("file").alias("_first")))  # one row
            here = F.col("file").eqNullSafe(F.col("_first"))
            source, rest = df.join(first, here, "left_semi"), df.join(first, here, "left_anti")
        number: dict[tuple[str, str], int] = {}
        for i, (use, keys) in enumerate(uses.items()):
            number[use] = i
            at = F.concat_ws("\x1c", *[fresh().want(k, "str") for k in keys])
            if rest is not None:
                key, value, _ = loaded[use[0]]
                found = source.groupBy(key.alias(f"_at{i}")).agg(value.alias(f"_get{i}"), F.lit(True).alias(f"_has{i}"))
                rest = rest.withColumn(f"_key{i}", at).join(found, F.col(f"_key{i}") == F.col(f"_at{i}"), "left").drop(f"_key{i}", f"_at{i}")

        def element(e: Node) -> Typed:
            c, kind = F.col(f"_get{number[e[0], repr(e[1])]}"), loaded[e[0]][2]
            return (F.coalesce(c, F.lit("")), kind) if kind == "str" else (c, kind)

        cols = fresh()
        cols.elements = element
        cols.members = lambda e: F.col(f"_has{number[e[1], repr(e[0])]}").isNotNull()
        return self._printed(rest, machine, rules, numbers, cols)

    # counters

    def _totals(self, df: DataFrame | None, machine: Machine, order_by: list[str] | None) -> DataFrame | None:
        p = self.program
        if p.prepare or p.functions or any(r.last for r in p.rules):
            raise _NoPlan("PREPARE, functions or ranges")
        fixed = self._constants(machine)
        df, numbers = self._prepared(df, machine, order_by)
        cols = _Columns(fixed, text(machine.globals["FS"]), numbers)
        order = F.struct(*order_by) if order_by else None
        scalars: dict[str, list[Typed]] = {}
        #: Variables with one value of one record: the column that finds it, its kind and what holds without such a record.
        kept: dict[str, tuple[Column, str, Any]] = {}
        #: Records that hold a largest or smallest value: which, the test for them, whether the last of them counts, and what is kept of them.
        beside: list[tuple[str, Column, Column, bool, dict[str, Column]]] = []
        stopped: list[Column] = []
        arrays: dict[str, tuple[str, Column, list[tuple[Column, Typed]]]] = {}

        def add(target: Node, value: Typed, live: Column) -> None:
            c, kind = value
            if kind == "str":
                c, kind = coerce.to_num(c), "float"
            if target.kind == "var":
                if target[0] in numbers or target[0] in ("NF", "NR", "FNR"):
                    raise _NoPlan("a built-in variable is changed")
                scalars.setdefault(target[0], []).append((F.when(live, c), kind))
                return
            if target.kind != "index":
                raise _NoPlan("a field is changed")
            key = F.concat_ws("\x1c", *[cols.want(k, "str") for k in target[1]])
            name = repr(target[1])
            known = arrays.setdefault(target[0], (name, key, []))
            if known[0] != name:
                raise _NoPlan("an array with two kinds of keys")
            known[2].append((live, (c, kind)))

        def keep(name: str, kind: str, ordered: bool = True) -> tuple[str, Any]:
            """The kind of a variable and its value before any record."""
            start = machine.globals.get(name, "")
            if name in kept or name in _LIVE or isinstance(start, dict) or ordered and df is not None and order is None:
                raise _NoPlan(f"variable {name}")
            if start == "" and kind != "str":
                return kind, 0
            if isinstance(start, str) != (kind == "str"):
                raise _NoPlan(f"variable {name} is text and number")
            return ("float" if isinstance(start, float) else kind), start

        def extreme(test: Node, body: Node | None, live: Column) -> bool:
            """Whether this keeps the largest or smallest value so far, and other values of its record."""
            steps = () if body is None else body.args if body.kind == "block" else (body,)
            if test.kind != "compare" or test[0] not in _TURNED or not steps or any(x.kind != "expr" or x[0].kind != "assign" or x[0][0] != "=" or x[0][1].kind != "var" for x in steps):
                return False
            sets = {x[0][1][0]: x[0][2] for x in steps}
            for op, value, best in ((test[0], test[1], test[2]), (_TURNED[test[0]], test[2], test[1])):
                if best.kind == "var" and repr(sets.get(best[0])) == repr(value) and len(sets) == len(steps):
                    break
            else:
                return False
            name = best[0]
            c, own = cols(value)
            kind, start = keep(name, own, ordered=False)
            beats = live & coerce.compare(op, c, own, F.lit(start), "str" if isinstance(start, str) else "float" if isinstance(start, float) else "int")
            c = coerce.as_kind(c, own, kind)
            kept[name] = (F.max if op[0] == ">" else F.min)(F.when(beats, c)), kind, start
            others = {}
            for other, e in sets.items():
                if other != name:
                    x, own = cols(e)
                    kind, start = keep(other, own)
                    kept[other] = F.lit(None), kind, start
                    others[other] = coerce.as_kind(x, own, kind)
            if others:
                beside.append((name, beats, c, op.endswith("="), others))
            return True

        def do(s: Node | None, live: Column) -> None:
            if s is None:
                return
            if s.kind == "next":
                stopped.append(live)
                return
            if s.kind not in ("block", "if"):
                live = live & _all([~x for x in stopped])
            if s.kind == "block":
                for x in s.args:
                    do(x, live)
            elif s.kind == "if":
                if s[2] is None and extreme(s[0], s[1], live & _all([~x for x in stopped])):
                    return
                test = cols.test(s[0])
                do(s[1], live & test)
                do(s[2], live & ~test)
            elif s.kind == "expr" and s[0].kind == "assign" and s[0][0] == "=" and s[0][1].kind == "var":
                c, own = cols(s[0][2])
                kind, start = keep(s[0][1][0], own)
                found = F.max_by(F.when(live, F.struct(coerce.as_kind(c, own, kind).alias("x"))), F.when(live, order)) if order is not None else F.lit(None)
                kept[s[0][1][0]] = (found["x"] if order is not None else found), kind, start
            elif s.kind == "expr" and s[0].kind == "assign" and s[0][0] in ("+=", "-="):
                c, kind = cols(s[0][2])
                c, kind = (coerce.to_num(c), "float") if kind == "str" else (c, kind)
                add(s[0][1], (c if s[0][0] == "+=" else -c, kind), live)
            elif s.kind == "expr" and s[0].kind == "step":
                add(s[0][2], (F.lit(1 if s[0][0] == "++" else -1).cast("bigint"), "int"), live)
            else:
                raise _NoPlan(s.kind)

        printing: list[Rule] = []
        for r in p.rules:
            steps = (Node("print", ([], None, None)),) if r.body is None else r.body.args if r.body.kind == "block" else (r.body,)
            prints = [any(n.kind in ("print", "printf") for n in _walk(x)) for x in steps]
            if any(prints):
                printing.append(Rule(r.pattern, None, Node("block", tuple(x for x, shows in zip(steps, prints, strict=True) if shows))))
            rest = tuple(x for x, shows in zip(steps, prints, strict=True) if not shows)
            if rest and not (r.pattern is not None and extreme(r.pattern, Node("block", rest), _all([~x for x in stopped]))):
                do(Node("block", rest), F.lit(True) if r.pattern is None else cols.test(r.pattern))
        if not p.end:
            raise _NoPlan("nothing is printed")
        if kept.keys() & scalars.keys():
            raise _NoPlan("a variable is set and added to")
        rows = None
        if printing:
            if stopped or any(n.kind in ("assign", "step", "next") or n.kind == "call" and n[0] in ("sub", "gsub") for n in _walk([(r.pattern, r.body) for r in printing])):
                raise _NoPlan("rules that print change more")
            rows = self._printed(df, machine, printing, numbers)

        def total(parts: list[Typed]) -> Typed:
            kind = "float" if any(k == "float" for _, k in parts) else "int"
            zero = F.lit(0.0) if kind == "float" else F.lit(0).cast("bigint")
            out = zero
            for c, k in parts:
                out = out + F.coalesce(F.sum(coerce.as_kind(c, k, kind)), zero)
            return out, kind

        kinds = {n: total(v) for n, v in scalars.items()}
        alone = {n for *_, others in beside for n in others}
        row = None if df is None else df.agg(F.count("*").alias("NR"), *[c.alias(f"v_{n}") for n, (c, _) in kinds.items()], *[c.alias(f"v_{n}") for n, (c, _, _) in kept.items() if n not in alone])
        if row is not None:
            for n, beats, c, late, others in beside:
                best = df.agg(kept[n][0].alias("_best"))
                held = df.crossJoin(F.broadcast(best)).where(beats & (c == F.col("_best")))  # one row
                found = (F.max_by if late else F.min_by)(F.struct(*[x.alias(f"v_{o}") for o, x in others.items()]), order)
                row = row.crossJoin(F.broadcast(held.agg(found.alias("_beside"))))  # one row
                row = row.select("*", "_beside.*").drop("_beside")
        variables: dict[str, Typed] = {"NR": (F.col("NR"), "int")} | {n: (F.col(f"v_{n}"), k) for n, (_, k) in kinds.items()}
        variables |= {n: (F.coalesce(f"v_{n}", coerce.as_kind(F.lit(start), "str" if isinstance(start, str) else "float" if isinstance(start, float) else "int", k)), k) for n, (_, k, start) in kept.items()}
        ofs, ors = text(machine.globals["OFS"]), text(machine.globals["ORS"]).removesuffix("\n")
        out: list[DataFrame | None] = []

        def shown(s: Node, c: _Columns) -> Column:
            if s[1] is not None:
                raise _NoPlan("a target in END")
            if s.kind == "print":
                if not s[0]:
                    raise _NoPlan("the record in END")
                line = F.concat_ws(ofs, *[c.want(a, "str") for a in s[0]])
                return F.concat(line, F.lit(ors)) if ors else line
            if s[0][0].kind != "str":
                raise _NoPlan("a format that is no constant")
            return F.regexp_replace(text_.sprintf(s[0][0][0], *[c(a) for a in s[0][1:]]), "\n\\z", "")

        def finish(s: Node) -> None:
            if s.kind == "block":
                for x in s.args:
                    finish(x)
            elif s.kind in ("print", "printf"):
                line = shown(s, _Columns(fixed, "", variables, record=False))
                out.append(None if row is None else row.select(line.alias("line")))
            elif s.kind == "forin":
                key, array, body = s.args
                if array not in arrays:
                    raise _NoPlan("an array that is not counted")
                shape = arrays[array][0]
                mates = {n: v for n, v in arrays.items() if v[0] == shape}
                sums = {n: total([(F.when(w, c), k) for w, (c, k) in v[2]]) for n, v in mates.items()}
                touched = {n: F.max(F.coalesce(_any([w for w, _ in v[2]]), F.lit(False))) for n, v in mates.items()}

                def element(e: Node) -> Typed:
                    if e[0] not in sums or len(e[1]) != 1 or e[1][0].kind != "var" or e[1][0][0] != key:
                        raise _NoPlan("another element")
                    return F.col(f"m_{e[0]}"), sums[e[0]][1]

                c = _Columns(fixed, "", {key: (F.col("_key"), "str")} | variables, element, record=False)
                inner = body.args if body.kind == "block" else (body,)
                lines = []
                for x in inner:
                    live = F.lit(True)
                    while x.kind == "if" and x[2] is None:
                        live, x = live & c.test(x[0]), x[1] if x[1].kind != "block" or len(x[1].args) != 1 else x[1][0]
                    if x.kind not in ("print", "printf"):
                        raise _NoPlan(x.kind)
                    lines.append(F.when(live, F.struct(shown(x, c).alias("line"))))
                if df is None:
                    return
                grouped = df.groupBy(arrays[array][1].alias("_key")).agg(*[t[0].alias(f"m_{n}") for n, t in sums.items()], touched[array].alias("_there")).where("_there")
                if any(n.kind == "var" and n[0] in variables for n in _walk(body)):
                    grouped = grouped.crossJoin(F.broadcast(row))  # one row
                out.append(grouped.select(F.explode(F.filter(F.array(*lines), lambda z: z.isNotNull())).alias("_p")).select("_p.line"))
            else:
                raise _NoPlan(s.kind)

        for b in p.end:
            finish(b)
        if df is None:
            return None
        result = out[0]
        for x in out[1:]:
            result = result.unionByName(x)
        result = result.withColumn("target", F.lit(None).cast("string"))
        return result if rows is None else rows.unionByName(result)

    # record by record

    def _records(self, df: DataFrame, order_by: list[str] | None) -> DataFrame:
        rows = df.orderBy(*order_by) if order_by else df
        return rows.select("file", "line")

    def _sequential(self, df: DataFrame, machine: Machine, order_by: list[str] | None) -> DataFrame:
        """One evaluator over all records, in order: its own state makes a second impossible."""
        program, form, start = self.program, self.form, dict(machine.globals)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Machine(program, start, form)

            def records() -> Iterator[tuple[str, str]]:
                for f in frames:
                    yield from zip(f["file"].fillna(""), f["line"].fillna(""), strict=True)

            on = m.main(records())
            if on:
                m.end()
            yield pd.DataFrame({"line": [t.removesuffix("\n") for _, t in m.out], "target": [target for target, _ in m.out]}, dtype=object)

        return self._records(df, order_by).coalesce(1).mapInPandas(run, _OUT)

    def _merged(self, df: DataFrame, machine: Machine) -> DataFrame:
        """An evaluator for each partition; states are merged on the driver, then END runs there."""
        program, form, start = self.program, self.form, dict(machine.globals)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            m = Machine(program, start | {"PID": TaskContext.get().partitionId() + 1}, form)
            m.main((a, b) for f in frames for a, b in zip(f["file"].fillna(""), f["line"].fillna(""), strict=True))
            state = {k: v for k, v in m.globals.items() if v != start.get(k) and k not in ("PID", "FILENAME", "FNR")}
            yield pd.DataFrame({"line": [t.removesuffix("\n") for _, t in m.out] + [None], "target": [target for target, _ in m.out] + [None], "state": [None] * len(m.out) + [json.dumps(state)]}, dtype=object)

        got = written(self._records(df, None).mapInPandas(run, f"{_OUT}, state string"))
        merged: dict[str, Any] = dict(start)
        for r in got.where("state is not null").select("state").toLocalIterator():
            for k, v in json.loads(r["state"]).items():
                merged[k] = merge(merged.get(k, ""), v)
        end = Machine(self.program, merged, self.form)
        end.end()
        lines = got.where("line is not null").select("line", "target")
        last = [(t.removesuffix("\n"), target) for target, t in end.out]
        return lines.unionByName(df.sparkSession.createDataFrame(last, _OUT)) if last else lines


#: Comparisons that keep an extreme, and the same with the sides exchanged.
_TURNED = {">": "<", "<": ">", ">=": "<=", "<=": ">="}


def _first_input(pattern: Node | None) -> bool:
    """Whether a pattern is NR == FNR."""
    return pattern is not None and pattern.kind == "compare" and pattern[0] == "==" and {n[0] for n in pattern.args[1:] if n.kind == "var"} == {"NR", "FNR"}


def _tested(test: Node | None) -> frozenset:
    """The elements that are there where a test holds."""
    if test is None:
        return frozenset()
    if test.kind == "in":
        return frozenset({(test[1], repr(test[0]))})
    return _tested(test[0]) | _tested(test[1]) if test.kind == "and" else frozenset()


def _sure(x: Any, there: frozenset, tested: set[str], loaded: dict) -> bool:
    """Whether all elements read are there, or texts of arrays whose keys are never tested: reading one makes it."""
    if isinstance(x, (list, tuple)):
        return all(_sure(a, there, tested, loaded) for a in x)
    if not isinstance(x, Node):
        return True
    if x.kind == "index":
        return (x[0], repr(x[1])) in there or x[0] not in tested and loaded[x[0]][2] == "str"
    if x.kind in ("if", "cond", "and"):
        return _sure(x[0], there, tested, loaded) and _sure(x[1], there | _tested(x[0]), tested, loaded) and (len(x.args) < 3 or _sure(x[2], there, tested, loaded))
    return _sure(x.args, there, tested, loaded)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def merge(a: Any, b: Any) -> Any:
    """How two workers' values of a variable become one."""
    if isinstance(a, dict) or isinstance(b, dict):
        a, b = a if isinstance(a, dict) else {}, b if isinstance(b, dict) else {}
        return {k: merge(a.get(k, ""), b.get(k, "")) for k in {**a, **b}}
    if isinstance(a, str) and isinstance(b, str):
        return b if b else a
    if isinstance(a, str):
        return b if not a else a
    if isinstance(b, str):
        return a if not b else b
    return a + b
