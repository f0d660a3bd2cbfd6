"""Declarative rule screens: a nested specification compiled to one boolean column and one per leaf.

A leaf is {"field", "op", "value"}; a group is {"any"|"all": [...]}.  A missing value fails every
operator but `isna`.  `parse` and `to_spec` turn a specification into a tree and back; `normal_form` gives screens that say
the same in another order, nesting or repetition one specification, and so one digest.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import six_digits
from . import preprocess

OPERATORS = ("lt", "le", "gt", "ge", "eq", "ne", "in", "isna", "notna")


@dataclass(frozen=True)
class Rule:
    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Group:
    word: str  # all or any
    parts: tuple


def _rule(spec: dict, path: str) -> Rule:
    if not isinstance(spec, dict):
        raise ValueError(f"{path}: a rule or a group is wanted")
    field, op, value = spec.get("field"), spec.get("op"), spec.get("value")
    if not isinstance(field, str) or op not in OPERATORS:
        raise ValueError(f"{path}: a rule needs a field and one of {', '.join(OPERATORS)}")
    if op in ("isna", "notna"):
        return Rule(field, op)
    if value is None:
        raise ValueError(f"{path}: {op} needs a value")
    if op == "in":
        if isinstance(value, (str, bytes)) or not hasattr(value, "__iter__"):
            raise ValueError(f"{path}: in needs a list")
        return Rule(field, op, tuple(value))
    return Rule(field, op, value)


def parse(spec: dict, path: str = "condition") -> Rule | Group:
    """The tree of a specification; errors name the place."""
    for word in ("all", "any"):
        if isinstance(spec, dict) and word in spec:
            if not spec[word]:
                raise ValueError(f"{path}.{word} is empty")
            return Group(word, tuple(parse(s, f"{path}.{word}[{k}]") for k, s in enumerate(spec[word])))
    return _rule(spec, path)


def to_spec(tree: Rule | Group) -> dict:
    """The specification that parse() makes this tree of."""
    if isinstance(tree, Group):
        return {tree.word: [to_spec(p) for p in tree.parts]}
    spec = {"field": tree.field, "op": tree.op}
    return spec if tree.op in ("isna", "notna") else spec | {"value": list(tree.value) if tree.op == "in" else tree.value}


def _text(tree: Rule | Group) -> str:
    return json.dumps(to_spec(tree), sort_keys=True, ensure_ascii=False, default=str)


def _normal(tree: Rule | Group) -> Rule | Group:
    if isinstance(tree, Rule):
        return Rule(tree.field, tree.op, tuple(sorted(set(tree.value), key=lambda v: (str(type(v)), v)))) if tree.op == "in" else tree
    parts: dict[str, Rule | Group] = {}
    for part in map(_normal, tree.parts):
        for p in part.parts if isinstance(part, Group) and part.word == tree.word else (part,):
            parts[_text(p)] = p
    return next(iter(parts.values())) if len(parts) == 1 else Group(tree.word, tuple(parts[k] for k in sorted(parts)))


def normal_form(spec: dict) -> dict:
    """The specification with groups of one kind merged, repeated parts once, groups of one part undone, and parts in order of their text."""
    return to_spec(_normal(parse(spec)))


def _leaf(spec: dict, path: str) -> Column:
    rule = _rule(spec, path)
    op, x, v = rule.op, F.col(rule.field), rule.value
    if op == "isna":
        return x.isNull()
    if op == "notna":
        return x.isNotNull()
    if op == "in":
        test = x.isin(list(v))
    else:
        test = {"lt": x < v, "le": x <= v, "gt": x > v, "ge": x >= v, "eq": x == v, "ne": x != v}[op]
    return F.coalesce(test, F.lit(False))


def leaves(spec: dict, path: str = "condition") -> list[tuple[str, dict]]:
    """(path, leaf) of every rule in order."""
    for word in ("all", "any"):
        if word in spec:
            if not spec[word]:
                raise ValueError(f"{path}.{word} is empty")
            return [x for k, s in enumerate(spec[word]) for x in leaves(s, f"{path}.{word}[{k}]")]
    return [(path, spec)]


def compile_rules(spec: dict, path: str = "condition") -> Column:
    if "all" in spec:
        return reduce(lambda a, b: a & b, (compile_rules(s, f"{path}.all[{k}]") for k, s in enumerate(spec["all"])))
    if "any" in spec:
        return reduce(lambda a, b: a | b, (compile_rules(s, f"{path}.any[{k}]") for k, s in enumerate(spec["any"])))
    return _leaf(spec, path)


def with_positive_guard(spec: dict, field: str = "pe_ttm") -> dict:
    """`field` > 0 in front, unless the screen says so already."""
    guard = {"field": field, "op": "gt", "value": 0}
    return spec if any(leaf == guard for _, leaf in leaves(spec)) else {"all": [guard, spec]}


def describe(spec: dict) -> str:
    for word, joint in (("all", " AND "), ("any", " OR ")):
        if word in spec:
            return "(" + joint.join(map(describe, spec[word])) + ")"
    return f"{spec['field']} {spec['op']}" + ("" if spec["op"] in ("isna", "notna") else f" {spec['value']}")


def summary(frame: DataFrame, spec: dict, key: str = "ts_code") -> DataFrame:
    """key, passed, failed_rules (texts of the rules that it fails)."""
    failed = F.array_compact(F.array(*(F.when(~_leaf(s, p), describe(s)) for p, s in leaves(spec))))
    return frame.select(key, compile_rules(spec).alias("passed"), failed.alias("failed_rules"))


def detail(frame: DataFrame, spec: dict, key: str = "ts_code") -> DataFrame:
    """One row per key and rule: its number, text, value, verdict and a short explanation."""
    rows = F.array(*(
        F.struct(F.lit(k).alias("rule"), F.lit(describe(s)).alias("text"), F.col(s["field"]).cast("double").alias("value"), _leaf(s, p).alias("passed"))
        for k, (p, s) in enumerate(leaves(spec))
    ))
    out = frame.select(key, F.explode(rows).alias("r")).select(key, "r.*")
    return out.withColumn("shown", six_digits("value")).withColumn("explanation", F.when(F.col("value").isNull(), "no data").when(F.col("passed"), "satisfied").otherwise("not satisfied"))


def funnel(frame: DataFrame, spec: dict) -> DataFrame:
    """Per rule how many rows pass and fail it, each rule on its own."""
    rules = leaves(spec)
    one = frame.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(_leaf(s, p)).alias(f"r{k}") for k, (p, s) in enumerate(rules)))
    rows = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(describe(s)).alias("text"), F.col(f"r{k}").alias("passed"), (F.col("n") - F.col(f"r{k}")).alias("failed")) for k, (_, s) in enumerate(rules)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def pass_rates(frame: DataFrame, spec: dict, group: str = "industry", least: int = 5, top: int = 20) -> DataFrame:
    rows = frame.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(compile_rules(spec)).alias("passed")).where(F.col("n") >= least)
    return rows.withColumn("rate", F.col("passed") * 100.0 / F.col("n")).orderBy(F.desc("rate"), group).limit(top)


def run(frame: DataFrame, spec: dict, key: str = "ts_code") -> dict[str, DataFrame]:
    """A screen from factors to verdicts: {"rules": a condition, "preprocess": steps of preprocess.apply, "factors": columns to show}.

    summary (key, passed, failed_rules and the columns that the rules or `factors` name, as they are after preprocessing), detail,
    counts (total, passed, failed) and codes (of those that pass).
    """
    rules = spec.get("rules")
    tree = parse(rules, "rules")
    rows = preprocess.apply(frame, [(name, dict(options)) for name, options in spec.get("preprocess", ())])
    shown = list(dict.fromkeys([leaf["field"] for _, leaf in leaves(to_spec(tree))] + list(spec.get("factors", ()))))
    missing = [c for c in shown if c not in rows.columns]
    if missing:
        raise ValueError(f"factors missing: {', '.join(missing)}")
    judged = rows.select(key, *(F.col(c) for c in shown), compile_rules(rules).alias("passed"), F.array_compact(F.array(*(F.when(~_leaf(s, p), describe(s)) for p, s in leaves(rules)))).alias("failed_rules"))
    counts = judged.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return {"summary": judged, "detail": detail(rows, rules, key), "counts": counts, "codes": judged.where("passed").select(key).orderBy(key)}
