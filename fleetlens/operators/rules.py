"""Ordered pass/kill rules over process rows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: the rule words. ------------------------------------------------
VERDICTS = ("pass", "kill")
BINDING = "set"
COMPARISONS = (">=", "<=", "!=", "=~", "==", ">", "<")
NUMERIC_FIELDS = ("Id", "Time")
# -----------------------------------------------------------------------------------

_TOKEN = re.compile(r"""'[^']*'|"[^"]*"|/(?:\\.|[^/])*/i?|>=|<=|!=|=~|==|=|>|<|[^\s<>=!~]+""")


_NAME = re.compile("[A-Za-z_]+")


@dataclass(frozen=True)
class Rule:
    """``verdict`` when ``condition`` holds; ``now`` stops the search at this rule."""

    verdict: str
    condition: Column
    now: bool = False
    log: bool = False


def _operand(token: str, numeric: set[str], columns: set[str]) -> tuple[Column, str]:
    if token in columns:
        col = F.col(token)
        if token in numeric:
            return col.cast("double"), "number"
        return F.lower(F.coalesce(col.cast("string"), F.lit("null"))), "text"
    if re.fullmatch(r"-?\d+(?:\.\d+)?", token):
        return F.lit(float(token)), "number"
    if token[0] == "/":
        body, _, flags = token[1:].rpartition("/")
        return F.lit(("(?i)" if flags == "i" else "") + body), "regex"
    return F.lit(token.strip("'\"").lower()), "text"


def _comparison(left: str, op: str, right: str, numeric: set[str], columns: set[str]) -> Column:
    a, kind = _operand(left, numeric, columns)
    b, other = _operand(right, numeric, columns)
    if op == "=~":
        return F.regexp_like(a.cast("string"), b)
    if kind != other and "number" in (kind, other):
        a, b = a.try_cast("double"), b.try_cast("double")
    test = {">=": a >= b, "<=": a <= b, "!=": a != b, "==": a == b, ">": a > b, "<": a < b}[op]
    return F.coalesce(test, F.lit(op == "!="))


def read_rules(lines: list[str], columns: list[str], numeric=NUMERIC_FIELDS) -> list[Rule]:
    """``pass|kill [now] [log] field op value [and|or ...]`` lines as rules.

    ``set name = value`` binds a name for the rules after it: to a number, a text, a
    pattern, a field, or another name's value at that place. Fields cannot be bound.
    """
    rules, names, nums, bound = [], set(columns), set(numeric), {}
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        tokens = _TOKEN.findall(line)
        verdict = tokens.pop(0)
        if verdict == BINDING:
            if len(tokens) != 3 or tokens[1] != "=" or not _NAME.fullmatch(tokens[0]):
                raise ValueError(f"a binding is `set name = value`: {line}")
            if tokens[0] in names:
                raise ValueError(f"a field cannot be bound: {line}")
            bound[tokens[0]] = bound.get(tokens[2], tokens[2])
            continue
        if verdict not in VERDICTS:
            raise ValueError(f"unknown action in rule: {line}")
        flags = {"now": False, "log": False}
        while tokens and tokens[0] in flags:
            flags[tokens.pop(0)] = True
        condition, joiner = None, None
        while tokens:
            if len(tokens) < 3 or tokens[1] not in COMPARISONS:
                raise ValueError(f"incomplete comparison in rule: {line}")
            left, right = (bound.get(t, t) for t in (tokens[0], tokens[2]))
            term = _comparison(left, tokens[1], right, nums, names)
            condition = term if condition is None else (condition & term if joiner == "and" else condition | term)
            tokens = tokens[3:]
            if tokens:
                joiner = tokens.pop(0)
                if joiner not in ("and", "or"):
                    raise ValueError(f"expected and/or in rule: {line}")
        if condition is None:
            raise ValueError(f"rule without condition: {line}")
        rules.append(Rule(verdict, condition, flags["now"], flags["log"]))
    return rules


def verdicts(processes: DataFrame, rules: list[Rule], symbols: DataFrame | None = None,
             on: list[str] | None = None) -> DataFrame:
    """Adds ``verdict``, ``rule`` (index of the deciding rule, NULL if none) and ``log``.

    The last matching rule decides, unless a matching ``now`` rule comes first.
    ``symbols`` are status values per server, joined on ``on``.
    """
    df = processes if symbols is None else processes.join(symbols, on, "left")
    df = df.withColumn("_m", F.array(*[F.coalesce(r.condition, F.lit(False)) for r in rules]))
    hit = [F.element_at("_m", i + 1) for i in range(len(rules))]
    beyond = F.lit(len(rules))
    stops = [F.when(hit[i], F.lit(i)).otherwise(beyond) for i, r in enumerate(rules) if r.now]
    df = df.withColumn("_stop", reduce(F.least, stops, beyond))
    fired = [F.when(hit[i] & (F.lit(i) <= F.col("_stop")), F.lit(i)).otherwise(-1) for i in range(len(rules))]
    df = df.withColumn("_rule", reduce(F.greatest, fired, F.lit(-1)))
    kinds = F.array(*[F.lit(r.verdict) for r in rules])
    logged = reduce(
        lambda a, b: a | b,
        [hit[i] & (F.lit(i) <= F.col("_stop")) for i, r in enumerate(rules) if r.log],
        F.lit(False),
    )
    decided = F.col("_rule") >= 0
    return df.select(
        *processes.columns,
        F.when(decided, F.element_at(kinds, F.col("_rule") + 1)).otherwise("pass").alias("verdict"),
        F.when(decided, F.col("_rule")).alias("rule"),
        logged.alias("log"),
    )
