"""Strength of relations between artifacts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, tiers, relation types and cue words of the scoring rules.
WEIGHTS = {"position": 0.35, "target": 0.25, "bidirection": 0.20, "evidence": 0.15, "density": 0.05}
TIERS = [(0.8, "strong"), (0.5, "moderate"), (0.2, "weak")]
POSITION = {"depends_on": 0.9, "supersedes": 0.9, "constrains": 0.7, "references": 0.7, "hierarchy": 0.6, "sibling": 0.6}
STRONG_CUES = "区别是|已废弃|替代|必须|配合使用|需要|依赖"
WEAK_CUES = "参见|参考|可选|详见"
UNDIRECTED = ["sibling", "references", "navigational"]
INVERSE = {"depends_on": "depended_on_by", "supersedes": "superseded_by", "constrains": "constrained_by"}
BROKEN = 0.2


def lookup(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), default if isinstance(default, Column) else F.lit(default))


def position(relation_type: Column) -> Column:
    return lookup(POSITION, relation_type, 0.4)


def target(name: Column) -> Column:
    segments = F.size(F.filter(F.split(F.replace(name, F.lit("::"), F.lit(".")), "[.]"), lambda s: F.trim(s) != ""))
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", 0.1).when(segments >= 2, 1.0).otherwise(0.7)


def bidirection(has_reverse: Column) -> Column:
    return F.when(has_reverse, 1.0).otherwise(0.5)


def evidence(quote: Column) -> Column:
    return F.when(F.coalesce(F.trim(quote), F.lit("")) == "", 0.1).when(quote.rlike(STRONG_CUES), 1.0).when(quote.rlike(WEAK_CUES), 0.7).otherwise(0.5)


def density(count: Column) -> Column:
    return F.when(count >= 3, 1.0).when(count == 2, 0.7).otherwise(0.4)


def breakdown(relation_type: Column, name: Column, has_reverse: Column, quote: Column, count: Column) -> Column:
    parts = {"position": position(relation_type), "target": target(name), "bidirection": bidirection(has_reverse), "evidence": evidence(quote), "density": density(count)}
    return F.struct(*[c.alias(f"w_{k}") for k, c in parts.items()])


def score(parts: Column) -> Column:
    return sum((F.lit(w) * parts[f"w_{k}"] for k, w in list(WEIGHTS.items())[1:]), F.lit(WEIGHTS["position"]) * parts["w_position"])


def tier(value: Column) -> Column:
    found = F.when(value >= TIERS[0][0], TIERS[0][1])
    for least, name in TIERS[1:]:
        found = found.when(value >= least, name)
    return found.otherwise("negligible")


def broken(value: Column) -> Column:
    return value < BROKEN


def ten_point(value: Column) -> Column:
    return F.round(value * 10, 1)


def direction(relation_type: Column) -> Column:
    return F.when(relation_type.isin(UNDIRECTED), "undirected").otherwise("directed")


def inverse(relation_type: Column) -> Column:
    both = INVERSE | {v: k for k, v in INVERSE.items()}
    return lookup(both, relation_type, relation_type)
