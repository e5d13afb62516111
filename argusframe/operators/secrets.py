"""Leaked secrets in source files: keys, tokens, database addresses and
private keys. Every occurrence on every line is reported, masked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from argusframe.functions.text import literal_lookup, mask_secret, message
from argusframe.operators.files import is_secret_path
from argusframe.schema import SCANNER_ORD, as_findings


@dataclass(frozen=True)
class SecretRule:
    id: str
    severity: str
    pattern: str
    group: int
    needles: tuple[str, ...]
    title: str
    ord: int
    java: str | None = None
    """The same matches as ``pattern`` without a group that Java would recurse into."""

    @property
    def search(self) -> str:
        return self.java or self.pattern


# What counts as a secret. ``group`` is the part to be masked.
SECRET_RULES = (
    SecretRule("secret-api-key", "critical",
               r"(?:sk_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36})",
               0, ("sk_live_", "sk-", "AKIA", "ghp_"), "API key", 1),
    SecretRule("secret-generic-token", "high",
               r"(?:[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy])['\"]?[ \t]*[:=][ \t]*['\"]([^'\" \t\n]{16,})['\"]",
               1, ("secret", "token", "key"), "Secret token", 2),
    SecretRule("secret-db-url", "critical",
               r"[A-Za-z][A-Za-z0-9+.-]{1,30}://[^ \t\n:/@'\"]+:[^ \t\n:/@'\"]+@[^ \t\n/'\"]+",
               0, ("://",), "Database address with password", 3),
    SecretRule("secret-private-key", "critical",
               r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----",
               0, ("-----BEGIN ",), "Private key", 4,
               r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z0-9]++ )*+PRIVATE KEY-----"),
)


def _may_hold(content: Column, rule: SecretRule) -> Column:
    test = F.lit(not rule.needles)
    for needle in rule.needles:
        test = test | F.contains(F.lower(content) if needle.islower() else content, F.lit(needle))
    return test & content.rlike(rule.search)


def secret_items(rules=SECRET_RULES) -> Column:
    """Array of ``struct(rule_ord, line, seq, secret)`` over all lines of
    ``content``; null where no rule matches the text as a whole, so that only
    suspect texts are split into lines."""
    suspect = None
    for rule in rules:
        test = _may_hold(F.col("content"), rule)
        suspect = test if suspect is None else suspect | test

    def of_rule(rule: SecretRule, text: Column, pos: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(rule.search), F.lit(rule.group))
        return F.transform(found, lambda s, i: F.struct(
            F.lit(rule.ord).alias("rule_ord"), (pos + 1).alias("line"), i.alias("seq"), s.alias("secret")))

    def on_line(text: Column, pos: Column) -> Column:
        return F.flatten(F.array(*[of_rule(r, text, pos) for r in rules]))

    return F.when(suspect, F.flatten(F.transform(F.split("content", "\n"), on_line)))


def secret_matches(files: DataFrame, rules=SECRET_RULES) -> DataFrame:
    """``(target_id, path, rule_ord, line, seq, secret)``, unmasked: for the
    report below only."""
    texts = files.filter(is_secret_path(F.col("path")))
    return texts.select("target_id", "path", F.explode(secret_items(rules)).alias("m")).select("target_id", "path", "m.*")


def scan_secrets(files: DataFrame, rules=SECRET_RULES) -> DataFrame:
    return report_secrets(secret_matches(files, rules), rules)


def report_secrets(matches: DataFrame, rules=SECRET_RULES) -> DataFrame:
    described = matches.withColumn("rule", literal_lookup(
        F.col("rule_ord"), {r.ord: r for r in rules}, ("id", "severity", "title")))
    return as_findings(described.select(
        "target_id",
        F.lit("secrets").alias("scanner"),
        "rule.severity",
        F.lit("secret").alias("category"),
        F.concat("rule.title", F.lit(" in the code")).alias("title"),
        message("`{secret}` looks like a secret, in `{path}` on line {line}.",
                secret=mask_secret(F.col("secret")), path=F.col("path"), line=F.col("line")).alias("description"),
        F.col("path").alias("file"),
        "line",
        F.lit("Revoke the secret and keep its successor in a secret store.").alias("recommendation"),
        F.col("rule.id").alias("rule_id"),
        F.lit(SCANNER_ORD["secrets"]).alias("scanner_ord"),
        "rule_ord",
        "seq",
    ))
