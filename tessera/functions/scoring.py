"""Scores, classes and confidence arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the hybrid score and its penalty.
WEIGHTS = {"semantic": 0.40, "lexical": 0.20, "graph": 0.15, "importance": 0.10, "recency": 0.06, "access": 0.04, "category": 0.05}
CONTRADICTED = 0.80
IMPORTANCE = {"profile": 0.95, "preference": 0.80, "habit": 0.70, "event": 0.50}
# Older names of what is done with a relation, and of the link that a decision makes.
RELATION_ACTIONS = {"duplicate": "merge", "reinforcement": "reinforce", "related": "link", "independent": "store", "contradiction": "contradict"}
DECISION_LINKS = {"reinforce": "supports", "related": "related", "ignore": "duplicate_of"}
SINGLE_VALUED = ("residence", "employer", "name", "age")
SINGLE_VALUED_TYPES = ("LOCATION", "EMPLOYMENT", "PROFILE")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null or has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, 1 - dot(a, b) / n)


def similarity(distance: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)), F.lit(0.5))


def recency(last_accessed: Column, created_at: Column, as_of: str) -> Column:
    """1 / (1 + 0.1 days) since the last access, else the creation; unknown counts half, the future as now."""
    ref = F.coalesce(last_accessed, created_at)
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ref)) / 86_400_000_000
    return F.when(ref.isNull(), 0.5).otherwise(1 / (1 + F.greatest(F.lit(0.0), days) * 0.1))


def access(count: Column) -> Column:
    n = F.coalesce(count, F.lit(0))
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(n) * 0.3))


def importance_signal(importance: Column) -> Column:
    """Missing and zero importance count half."""
    return F.when(F.coalesce(importance, F.lit(0.0)) == 0, 0.5).otherwise(importance)


def hybrid(signals: dict[str, Column], contradicted: Column) -> Column:
    """Weighted sum of the signals (null counts nothing), less the penalty, not under 0."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.coalesce(signals[name], F.lit(0.0)) * weight
    return F.greatest(F.lit(0.0), total - F.when(F.coalesce(contradicted, F.lit(False)), CONTRADICTED).otherwise(0.0))


def simple_score(distance: Column, importance: Column, access_count: Column) -> Column:
    """The older score of similarity, importance and accesses."""
    return similarity(distance) * 0.50 + importance_signal(importance) * 0.25 + F.least(F.coalesce(access_count, F.lit(0)) / 10, F.lit(1.0)) * 0.15


def category_importance(category: Column) -> Column:
    out = F.lit(0.40)
    for name, value in IMPORTANCE.items():
        out = F.when(F.lower(category) == name, value).otherwise(out)
    return out


def lifecycle(state: Column, access_count: Column) -> Column:
    """active from three accesses on, else weak; archived stays."""
    return F.when(state == "archived", state).when(F.coalesce(access_count, F.lit(0)) >= 3, "active").otherwise("weak")


def decayed(state: Column, importance: Column, access_count: Column) -> Column:
    """An active row of little importance and access turns weak."""
    weak = (state == "active") & (F.coalesce(importance, F.lit(0.0)) < 0.5) & (F.coalesce(access_count, F.lit(0)) < 3)
    return F.when(weak, "weak").otherwise(state)


def reinforced(confidence: Column) -> Column:
    return F.least(F.lit(1.0), confidence + 0.10)


def doubted(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), confidence - 0.20)


def distance_class(distance: Column) -> Column:
    return F.when(distance <= 0.10, "duplicate").when(distance <= 0.30, "reinforcement").when(distance <= 0.45, "related").otherwise("independent")


def candidate_decision(distance: Column) -> Column:
    return F.when(distance <= 0.05, "ignore").when(distance <= 0.20, "reinforce").when(distance <= 0.40, "related").otherwise("new")


def single_valued(attribute: Column, fact_type: Column) -> Column:
    a = F.lower(F.trim(attribute))
    return F.coalesce(a.isin(*SINGLE_VALUED) | a.startswith("favorite_") | fact_type.isin(*SINGLE_VALUED_TYPES), F.lit(False))


def domain_key(entity: Column, attribute: Column, value: Column, single: Column) -> Column:
    """Facts compete by (entity, attribute), of many-valued attributes by the value as well."""
    base = F.concat_ws("|", F.lower(F.trim(entity)), F.lower(F.trim(attribute)))
    return F.when(single, base).otherwise(F.concat_ws("|", base, F.lower(F.trim(value))))


def mapped(value: Column, names: dict[str, str]) -> Column:
    """The name that a value stands for, null for others."""
    return F.coalesce(*[F.when(value == k, v) for k, v in names.items()])
