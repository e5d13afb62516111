"""Static analysis of source files.

The whole scan is one narrow stage. Each line rule is searched for in the
*whole text* with a pattern that cannot cross a newline, after the suppressed
lines have been blanked; the first hit is the first matching line, and its
number is the count of newlines before it. So no file is split into lines and
nothing is shuffled: ``scan_sources`` is scan, project, generate.

``match_line_rules`` and ``first_match_per_file`` are the same detection taken
apart on exploded lines, for callers who want every hit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from argusframe.functions.regex import SPACE_IN_LINE
from argusframe.functions.text import literal_lookup, message, path_extension
from argusframe.operators.files import explode_lines, prune_paths, size_cap
from argusframe.operators.rules import FILE, LINE, RULES, RULES_BY_ID, USER_RULE_ORD, Rule
from argusframe.schema import SCANNER_ORD, as_findings

# Lines that begin so are comments or rule definitions.
_SUPPRESSED_STARTS = ("//", r"\*", r"/\*")
_SUPPRESSED_KEYS = ("pattern", "regex", "antiPattern", "title", "description", "recommendation", "id")

_SUPPRESSED = (
    f"^[{SPACE_IN_LINE}]*(?:{'|'.join(_SUPPRESSED_STARTS)}"
    f"|(?:{'|'.join(_SUPPRESSED_KEYS)})[{SPACE_IN_LINE}]*:)"
)


def is_suppressed(line: Column) -> Column:
    return line.rlike(_SUPPRESSED)


def blank_suppressed(content: Column) -> Column:
    """Empty the suppressed lines and keep all others where they are."""
    return F.regexp_replace(content, f"(?md){_SUPPRESSED}[^\\n]*", "")


def suppress_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_suppressed(F.col("text")))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _extension_test(rule: Rule) -> Column:
    """On column ``ext``; as SQL text, since a scan asks this for every rule."""
    names = ", ".join(f"'{e}'" for e in rule.extensions)
    return F.expr(f"ext IN ({names})" if names else "false")


def _needle_test(rule: Rule) -> Column:
    """On column ``lowered``."""
    return F.expr(" OR ".join(f"contains(lowered, '{n}')" for n in rule.needles) or "true")


def report_rules(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    where = message(" Found in `{path}` on line {line}.", path=F.col("path"), line=F.col("line"))
    described = hits.withColumn("rule", literal_lookup(
        F.col("rule_ord"), {r.ord: r for r in rules}, ("id", "severity", "title", "description", "recommendation")))
    return as_findings(described.select(
        "target_id",
        F.lit("sast").alias("scanner"),
        "rule.severity",
        F.lit("code").alias("category"),
        "rule.title",
        F.concat("rule.description", F.when(F.col("line").isNotNull(), where).otherwise("")).alias("description"),
        F.col("path").alias("file"),
        "line",
        "rule.recommendation",
        F.col("rule.id").alias("rule_id"),
        F.lit(SCANNER_ORD["sast"]).alias("scanner_ord"),
        "rule_ord",
        F.lit(1).alias("seq"),
    ))


def with_scan_texts(files: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds what ``rule_cases`` reads: ``ext``, ``clean`` and ``lowered``; the
    texts only where ``wanted``."""
    def text(value: Column) -> Column:
        return value if wanted is None else F.when(wanted, value)

    return files.select(
        "*", path_extension(F.col("path")).alias("ext"),
        text(blank_suppressed(F.col("content"))).alias("clean"), text(F.lower("content")).alias("lowered"))


def rule_cases(rules: Sequence[Rule], use_needles: bool = True) -> list[Column]:
    """One ``struct(rule_ord, before)`` or null per line and file rule, decided
    on a row of ``with_scan_texts``. ``before`` is the text in front of the
    first hit of a line rule, null for a file rule."""
    clean, content = F.col("clean"), F.col("content")
    whole = F.lit(None).cast("string").alias("before")
    cases = []
    for rule in rules:
        if rule.scope not in (LINE, FILE):
            continue
        test = _extension_test(rule)
        if use_needles:
            test = test & _needle_test(rule)
        if rule.scope == LINE:
            test = test & clean.rlike(rule.java)
            before = F.split(clean, rule.java, 2)[0]
            if rule.ord >= USER_RULE_ORD:  # splitting passes over a hit of no width at the start
                before = F.when(F.regexp_instr(clean, F.lit(rule.java)) == 1, "").otherwise(before)
            before = before.alias("before")
        else:
            test = test & content.rlike(rule.java)
            if rule.anti:
                test = test & ~content.rlike(rule.java_anti)
            before = whole
        cases.append(F.when(test, F.struct(F.lit(rule.ord).alias("rule_ord"), before)))
    return cases


def hit_line(before: Column) -> Column:
    """Line of a hit from the text in front of it."""
    return F.when(before.isNotNull(), newline_count(before) + 1).cast("int")


def scanned_extensions(rules: Sequence[Rule]) -> list[str]:
    return sorted({e for r in rules if r.scope in (LINE, FILE) for e in r.extensions})


def rule_hits(files: DataFrame, rules: Sequence[Rule], use_needles: bool = True) -> DataFrame:
    """``(target_id, path, rule_ord, line)`` of every rule hit, one row per
    file and rule. Expects pruned files."""
    cases = rule_cases(rules, use_needles)
    if not cases:
        return files.sparkSession.createDataFrame([], "target_id string, path string, rule_ord int, line int")
    texts = files.select("target_id", "path", "content").filter(
        path_extension(F.col("path")).isin(*scanned_extensions(rules)))
    return (
        with_scan_texts(texts).select("target_id", "path", F.explode(F.array(*cases)).alias("hit"))
        .filter(F.col("hit").isNotNull())
        .select("target_id", "path", "hit.rule_ord", hit_line(F.col("hit.before")).alias("line"))
    )


def scan_sources(files: DataFrame, rules: Sequence[Rule] = RULES, use_needles: bool = True) -> DataFrame:
    """All line and file findings of the built-in scanner."""
    return report_rules(rule_hits(size_cap(prune_paths(files)), rules, use_needles), rules)


def match_line_rules(lines: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every ``(target_id, path, line, rule_id)`` where a line rule matches,
    on lines already pruned and cleared of suppressed ones."""
    text = F.col("text")
    cases = [
        F.when(_extension_test(r) & text.rlike(r.java), F.lit(r.id))
        for r in rules if r.scope == LINE
    ]
    return (
        lines.withColumn("ext", path_extension(F.col("path")))
        .select("target_id", "path", "line", F.explode(F.array(*cases)).alias("rule_id"))
        .filter(F.col("rule_id").isNotNull())
    )


def first_match_per_file(matches: DataFrame) -> DataFrame:
    return matches.groupBy("target_id", "path", "rule_id").agg(F.min("line").alias("line"))


def match_file_rules(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(target_id, path, rule_id)`` of the whole-file rules."""
    content = F.col("content")
    cases = []
    for rule in (r for r in rules if r.scope == FILE):
        test = _extension_test(rule) & content.rlike(rule.java)
        if rule.anti:
            test = test & ~content.rlike(rule.java_anti)
        cases.append(F.when(test, F.lit(rule.id)))
    return (
        files.withColumn("ext", path_extension(F.col("path")))
        .select("target_id", "path", F.explode(F.array(*cases)).alias("rule_id"))
        .filter(F.col("rule_id").isNotNull())
    )


def line_matches(files: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Pruned files -> lines -> unsuppressed lines -> all matches."""
    return match_line_rules(suppress_lines(explode_lines(size_cap(prune_paths(files)))), rules)


def env_not_ignored(files: DataFrame) -> DataFrame:
    """Targets with a root ``.env`` that the root ignore list leaves out.

    Reads the raw listing, since pruning drops ``.env``. One aggregation over
    the two root files of each target; file texts are reduced to a flag before
    the shuffle."""
    rule = RULES_BY_ID["env-not-gitignored"]
    path = F.col("path")
    roots = (
        files.filter(path.isin(".env", ".gitignore"))
        .select("target_id",
                (path == ".env").alias("is_env"),
                F.when(path == ".gitignore", F.contains("content", F.lit(".env"))).alias("covers"))
        .groupBy("target_id")
        .agg(F.max("is_env").alias("has_env"), F.max("covers").alias("covers"))
        .filter(F.col("has_env") & ~F.coalesce("covers", F.lit(False)))
    )
    no_list = F.col("covers").isNull()
    return as_findings(roots.select(
        "target_id",
        F.lit("sast").alias("scanner"),
        F.lit(rule.severity).alias("severity"),
        F.lit("config").alias("category"),
        F.when(no_list, "Environment file and no ignore list").otherwise("Environment file missing in the ignore list").alias("title"),
        F.lit(rule.description).alias("description"),
        F.when(no_list, ".env").otherwise(".gitignore").alias("file"),
        F.lit(rule.recommendation).alias("recommendation"),
        F.lit(rule.id).alias("rule_id"),
        F.lit(SCANNER_ORD["sast"]).alias("scanner_ord"),
        F.lit(0).alias("rule_ord"),
        F.lit(0).alias("seq"),
    ))


def match_rule_table(files: DataFrame, rule_table: DataFrame) -> DataFrame:
    """User rules as a table ``(id, severity, extension, scope, pattern, anti,
    title, description, recommendation)`` with one row per rule and extension
    and Java patterns, which are matched line by line; a line rule reports its
    first line. The table is read and checked when the scan is planned; see ``rule_index`` for how it is matched.
    """
    from argusframe.operators.rule_index import index_rules, match_rule_index  # which builds on this module
    return match_rule_index(files, index_rules(rule_table))
