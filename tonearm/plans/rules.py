"""Declarative rules: a small expression language compiled to columns, so that all rules run in one projection.

Expressions are Python syntax over one record, `metadata.<field>`: constants, lists, comparisons (chained as in
Python), in / not in, and / or / not, arithmetic, and registered functions. Anything else is refused when the
rule is compiled; such a rule fails for each record with the reason. A rule without a check is skipped.
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RELEASE_DEFAULTS, SEVERITIES

DEFAULT_PLATFORMS = ("spotify", "apple", "youtube", "amazon", "tiktok")


class RuleError(ValueError):
    """An expression that the language doesn't have."""


@dataclass(frozen=True)
class Rule:
    id: str
    check: str | None
    severity: str = "warning"
    title: str = ""
    platform: str | None = None
    layer: str = "metadata"
    category: str = ""
    fix_hint: str = ""
    active: bool = True


@dataclass(frozen=True)
class Typed:
    """A column and its kind: text, number, bool or list."""

    column: Column
    kind: str
    value: object = None


FUNCTIONS: dict[str, Callable[..., Typed]] = {}


def rule_function(name: str):
    """Register a function of the language: it gets and returns Typed columns."""

    def add(f):
        FUNCTIONS[name] = f
        return f

    return add


def _kind(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    return "list" if isinstance(value, (list, tuple)) else "text"


def truth(x: Typed) -> Column:
    """Python's truth value."""
    if x.kind == "bool":
        return x.column
    if x.kind == "number":
        return x.column != 0
    return F.size(x.column) > 0 if x.kind == "list" else x.column != ""


def anchored(pattern: str) -> str:
    """A pattern that matches from the start, as re.match does; \\d means ASCII digits."""
    return f"^(?:{pattern})"


@rule_function("has_value")
def _has_value(x: Typed) -> Typed:
    return Typed(F.trim(x.column) != "" if x.kind == "text" else truth(x), "bool")


@rule_function("regex_match")
def _regex_match(x: Typed, p: Typed) -> Typed:
    text = x.column.cast("string")
    return Typed(truth(x) & text.rlike(anchored(str(p.value))), "bool")


@rule_function("all_items_match")
def _all_items_match(x: Typed, p: Typed) -> Typed:
    return Typed((F.size(x.column) > 0) & F.forall(x.column, lambda v: v.rlike(anchored(str(p.value)))), "bool")


@rule_function("no_duplicates")
def _no_duplicates(x: Typed) -> Typed:
    return Typed(F.size(x.column) == F.size(F.array_distinct(x.column)) if x.kind == "list" else F.lit(True), "bool")


@rule_function("contains")
def _contains(x: Typed, y: Typed) -> Typed:
    return Typed(F.contains(F.lower(x.column.cast("string")), F.lower(y.column.cast("string"))), "bool")


@rule_function("len")
def _len(x: Typed) -> Typed:
    return Typed(F.size(x.column) if x.kind == "list" else F.length(x.column), "number")


@rule_function("abs")
def _abs(x: Typed) -> Typed:
    return Typed(F.abs(x.column), "number")


@rule_function("lower")
def _lower(x: Typed) -> Typed:
    return Typed(F.lower(x.column), "text")


@rule_function("upper")
def _upper(x: Typed) -> Typed:
    return Typed(F.upper(x.column), "text")


@rule_function("str")
def _str(x: Typed) -> Typed:
    return Typed(x.column.cast("string"), "text")


@rule_function("int")
def _int(x: Typed) -> Typed:
    return Typed(x.column.try_cast("long"), "number")


@rule_function("bool")
def _bool(x: Typed) -> Typed:
    return Typed(truth(x), "bool")


_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a.cast("double"), b), ast.Mod: lambda a, b: F.when(b != 0, F.pmod(a, F.nullif(b, F.lit(0))) + F.when((b < 0) & (F.pmod(a, F.nullif(b, F.lit(0))) > 0), b).otherwise(0))}


class Compiler:
    def __init__(self, fields: dict[str, str]):
        self.fields = fields
        self.first_field: str | None = None

    def compile(self, text: str) -> Column:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", SyntaxWarning)  # patterns hold escapes such as \\d
                tree = ast.parse(text, mode="eval")
        except SyntaxError as e:
            raise RuleError(f"syntax: {e.msg}") from e
        # the first field in breadth-first order is the value that a result shows
        self.first_field = next((n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "metadata"), None)
        return F.coalesce(truth(self.visit(tree.body)), F.lit(False))

    def visit(self, n: ast.AST) -> Typed:
        f = getattr(self, f"on_{type(n).__name__}", None)
        if f is None:
            raise RuleError(f"{type(n).__name__} is not allowed")
        return f(n)

    def on_Constant(self, n):
        if n.value is None or isinstance(n.value, (bytes, complex)) or n.value is Ellipsis:
            raise RuleError("constant of that type is not allowed")
        return Typed(F.lit(n.value), _kind(n.value), n.value)

    def on_List(self, n):
        items = [self.visit(e) for e in n.elts]
        return Typed(F.array(*[i.column for i in items]), "list", items)

    on_Tuple = on_List

    def on_Name(self, n):
        if n.id in ("True", "False"):
            return Typed(F.lit(n.id == "True"), "bool")
        raise RuleError(f"unknown name {n.id}")

    def on_Attribute(self, n):
        if not (isinstance(n.value, ast.Name) and n.value.id == "metadata"):
            raise RuleError("only fields of metadata are allowed")
        if n.attr not in self.fields:
            raise RuleError(f"unknown field {n.attr}")
        return Typed(F.col(n.attr), self.fields[n.attr])

    def on_Compare(self, n):
        left, out = self.visit(n.left), None
        for op, right_node in zip(n.ops, n.comparators):
            right = self.visit(right_node)
            one = self.one_comparison(left, op, right)
            out = one if out is None else out & one
            left = right
        return Typed(out, "bool")

    @staticmethod
    def one_comparison(left: Typed, op: ast.cmpop, right: Typed) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if right.kind == "list":
                same = [i.column for i in right.value if i.kind == left.kind] if isinstance(right.value, list) else None
                hit = F.array_contains(right.column, left.column) if same is None else (left.column.isin(*same) if same else F.lit(False))
            elif right.kind == "text" and left.kind == "text":
                hit = F.contains(right.column, left.column)
            else:
                raise RuleError("in needs a list or text")
            return ~hit if isinstance(op, ast.NotIn) else hit
        if type(op) not in _COMPARE:
            raise RuleError(f"{type(op).__name__} is not allowed")
        if left.kind != right.kind:
            if isinstance(op, ast.Eq):
                return F.lit(False)
            if isinstance(op, ast.NotEq):
                return F.lit(True)
            raise RuleError(f"{left.kind} and {right.kind} don't compare")
        return _COMPARE[type(op)](left.column, right.column)

    def on_BoolOp(self, n):
        parts = [F.coalesce(truth(self.visit(v)), F.lit(False)) for v in n.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(n.op, ast.And) else out | p
        return Typed(out, "bool")

    def on_UnaryOp(self, n):
        x = self.visit(n.operand)
        if isinstance(n.op, ast.Not):
            return Typed(~truth(x), "bool")
        if isinstance(n.op, ast.USub) and x.kind == "number":
            return Typed(-x.column, "number")
        raise RuleError(f"{type(n.op).__name__} is not allowed")

    def on_BinOp(self, n):
        a, b = self.visit(n.left), self.visit(n.right)
        if isinstance(n.op, ast.Add) and a.kind == b.kind == "text":
            return Typed(F.concat(a.column, b.column), "text")
        if type(n.op) not in _ARITHMETIC or a.kind != "number" or b.kind != "number":
            raise RuleError(f"{type(n.op).__name__} is not allowed here")
        return Typed(_ARITHMETIC[type(n.op)](a.column, b.column), "number")

    def on_Call(self, n):
        if not isinstance(n.func, ast.Name) or n.func.id not in FUNCTIONS or n.keywords:
            raise RuleError("only registered functions, without keywords, are allowed")
        args = [self.visit(a) for a in n.args]
        try:
            return FUNCTIONS[n.func.id](*args)
        except TypeError as e:
            raise RuleError(f"{n.func.id}: wrong number of arguments") from e


RELEASE_FIELDS = {name: _kind(default) for name, default in RELEASE_DEFAULTS.items()}


def select_rules(rules: list[Rule], platforms=DEFAULT_PLATFORMS, layer: str | None = None, active_only: bool = True) -> list[Rule]:
    """Universal rules and those of the platforms; later definitions of an id replace earlier ones in place."""
    by_id: dict[str, Rule] = {}
    for r in rules:
        by_id[r.id] = r
    return [r for r in by_id.values() if (r.active or not active_only) and (r.platform is None or r.platform in platforms) and layer in (None, r.layer)]


def rule_frame(spark, rules: list[Rule]) -> DataFrame:
    """Rules as a table, one row an id (the last definition), to filter by platform, layer or state; get one by its id, count them as any table."""
    fields = ", ".join(f"`{n}` {'boolean' if n == 'active' else 'string'}" for n in Rule.__dataclass_fields__)
    last = {r.id: r for r in rules}
    return spark.createDataFrame([tuple(r.__dict__.values()) for r in last.values()], fields)


def list_rules(frame: DataFrame, platform: str | None = None, layer: str | None = None, active_only: bool = True) -> DataFrame:
    """Rules of a table; with a platform, its own and the universal ones."""
    out = frame.where("active") if active_only else frame
    if platform is not None:
        out = out.where(F.col("platform").isNull() | (F.col("platform") == platform))
    return out if layer is None else out.where(F.col("layer") == layer)


#: What a result tells of its rule alone.
_OF_RULE = "array<struct<rule_id:string,severity:string,message:string,fix_hint:string,platform:string>>"


def evaluate(records: DataFrame, rules: list[Rule], keys: list[str], platforms=DEFAULT_PLATFORMS, fields: dict[str, str] | None = None) -> DataFrame:
    """A row for each record and rule: rule_id, severity, status (pass, fail, skip), message and the value checked.

    Rules often share a check, so each check is compiled once. What doesn't depend on the record is one constant, looked
    up by the rule's place.
    """
    fields = fields or RELEASE_FIELDS
    compiled: dict[str, tuple[Column, str | None]] = {}
    verdicts, of_rule = [], []

    def verdict(check: str) -> tuple[Column, str | None]:
        """Status and value of a check as one struct, and why it was refused, if it was."""
        c, refused = Compiler(fields), None
        value = F.lit(None).cast("string")
        try:
            status = F.when(c.compile(check), "pass").otherwise("fail")
            if c.first_field in fields:
                value = F.col(c.first_field).cast("string")
        except RuleError as e:
            status, refused = F.lit("fail"), f"expression error: {e}"
        return F.struct(status.alias("status"), value.alias("checked_value")), refused

    skipped = F.struct(F.lit("skip").alias("status"), F.lit(None).cast("string").alias("checked_value"))
    for r in select_rules(rules, platforms):
        severity = r.severity if r.severity in SEVERITIES and r.severity != "error" else "warning"
        message = r.title or r.id
        if not (r.check or "").strip():
            verdicts.append(skipped)
            message = "manual review required"
        else:
            if r.check not in compiled:
                compiled[r.check] = verdict(r.check)
            one, refused = compiled[r.check]
            verdicts.append(one)
            message = refused or message
        of_rule.append({"rule_id": r.id, "severity": severity, "message": message, "fix_hint": r.fix_hint, "platform": r.platform})
    if not verdicts:
        verdicts = [skipped]
        records = records.limit(0)
    known = F.from_json(F.lit(json.dumps(of_rule)), _OF_RULE)
    rows = records.select(*keys, F.posexplode(F.array(*verdicts)).alias("__at", "__v")).withColumn("__r", F.get(known, F.col("__at")))
    return rows.select(*keys, "__r.rule_id", "__r.severity", "__v.status", "__r.message", "__r.fix_hint", "__v.checked_value", "__r.platform")


def load_rules(folder: str) -> list[Rule]:
    """Rules of a folder of YAML files (.yml before .yaml, by name): platform under `dsp`, rules under `rules`."""
    from pathlib import Path

    import yaml

    out = []
    for path in [*sorted(Path(folder).rglob("*.yml")), *sorted(Path(folder).rglob("*.yaml"))]:
        doc = yaml.safe_load(path.read_text()) or {}
        for r in doc.get("rules", []) if isinstance(doc, dict) else []:
            out.append(Rule(r["id"], r.get("check"), r.get("severity", "warning"), r.get("title", ""), r.get("dsp", doc.get("dsp")), r.get("layer", doc.get("layer", "metadata")), r.get("category", ""), r.get("fix_hint", "") or "", bool(r.get("active", True))))
    return out


HANDLERS: dict[str, Callable[[DataFrame], Column]] = {}


def handler(prefix: str):
    """Register a column builder for a rule id or a prefix of ids; the longest prefix wins."""

    def add(f):
        HANDLERS[prefix] = f
        return f

    return add


def handler_for(rule_id: str):
    hits = [p for p in HANDLERS if rule_id == p or rule_id.startswith(p)]
    return HANDLERS[max(hits, key=len)] if hits else None


def run_handlers(df: DataFrame, rule_ids: list[str], keys: list[str]) -> DataFrame:
    results = []
    for rule_id in rule_ids:
        f = handler_for(rule_id)
        passed = F.coalesce(f(df), F.lit(False)) if f else F.lit(False)
        results.append(F.struct(F.lit(rule_id).alias("rule_id"), passed.alias("passed"), F.lit("" if f else "not yet implemented").alias("message")))
    return df.select(*keys, F.explode(F.array(*results)).alias("r")).select(*keys, "r.*")
