"""Rules as data: the built-in catalogue and rules added by users."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from argusframe.operators.rule_index import index_rules
from argusframe.operators.rules import AI_RULES, RULES, Rule, check_rules, number_user_rules

_CATALOG_COLUMNS = "rule_ord int, rule_id string, severity string, scope string, extension string, pattern string, anti string, title string"


def load_rule_catalog(user_rules: list[Rule] | None = None, ai_rules: bool = False) -> list[Rule]:
    """The rules of a scan, built-in ones first."""
    rules = RULES + (AI_RULES if ai_rules else [])
    return check_rules(rules + (number_user_rules(user_rules) if user_rules else []))


def parse_user_rules(text: str) -> list[Rule]:
    """User rules from JSON: a list of objects with the fields of ``Rule``."""
    return number_user_rules([
        Rule(**{**item, "extensions": tuple(item["extensions"]), "needles": tuple(item.get("needles", ()))})
        for item in json.loads(text)
    ])


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The catalogue as a table, one row per rule and extension."""
    rows = [
        (r.ord, r.id, r.severity, r.scope, ext, r.java, r.java_anti, r.title)
        for r in rules for ext in (r.extensions or (None,))
    ]
    return spark.createDataFrame(rows, _CATALOG_COLUMNS)


def register_rules(source: list[Rule] | DataFrame) -> list[Rule] | DataFrame:
    """User rules for a scan: a list of ``Rule`` (ECMAScript patterns, unrolled
    into the scan) or a table of Java patterns (``match_rule_table``). The form
    decides the dialect, the number of rules decides nothing. Both are checked here, every pattern by its own dialect."""
    if not isinstance(source, DataFrame):
        return number_user_rules(source)
    index_rules(source)
    return source
