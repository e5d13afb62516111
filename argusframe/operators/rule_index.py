"""User rules by the thousand: an index of literals names the few rules that may match a file.

Most patterns can't match without certain literal texts: of ``exec\\(|spawn\\(`` one of two. ``required_texts`` reads such a set off the
pattern. All sets together make one automaton for each extension, and a file goes through it once,
whatever the number of rules. What it meets are candidates: a file and a rule, with the lines in which the literals are. Only these are
matched, by Java and as they are, in SQL. So the cost grows with the texts and with the candidates, not with rules times lines.

A pattern without such a set (``^\\s+$``) is a candidate for every line; those rules are matched line by line in the row.
"""

from __future__ import annotations

import json
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from argusframe.functions.severity import SEVERITIES
from argusframe.functions.text import path_extension
from argusframe.operators.files import prune_paths, size_cap
from argusframe.operators.rules import FILE, LINE, USER_RULE_ORD, Rule
from argusframe.operators.sast import is_suppressed, report_rules

# Workers get the functions of this module with the job, not by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A set with more texts, or with a text shorter than this, does not tell candidates well enough.
MOST_TEXTS = 32
LEAST_LENGTH = 3
#: A catalogue is part of the program; one beyond this is refused.
MOST_RULES = 200_000
#: Bytes of patterns that are sent to every task.
BROADCAST_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
RULE_COLUMNS = ("id", "severity", "extension", "scope", "pattern", "anti", "title", "description", "recommendation")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
# Java reads these in its own way: unions and cuts of classes, quoted stretches, its own escapes, comments, and case beyond ASCII.
_JAVA_ONLY = re.compile(r"&&|\\[QEhHRXGpPk0cUN]|\[[^\]\\]*\[|\[\^?\]|\(\?[a-z]*[xU]")


def lowered(text: str) -> str:
    """``text`` with A-Z in small letters and all else in its place."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set that tells more: the longer shortest text, then the fewer texts."""
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _of(items) -> frozenset[str] | None:
    """Texts of which each match of a parsed pattern holds one; null if nothing is known. Any set that is returned is one."""
    best, run = None, ""

    def close() -> None:
        nonlocal best, run
        best, run = _better(best, frozenset([run]) if run else None), ""

    for kind, value in items:
        if kind is op.LITERAL and value < 128:
            run += lowered(chr(value))
            continue
        if kind is op.SUBPATTERN and len(value[3]) and all(k is op.LITERAL and v < 128 for k, v in value[3]):
            run += lowered("".join(chr(v) for _, v in value[3]))
            continue
        close()
        found = None
        if kind is op.SUBPATTERN:
            found = _of(value[3])
        elif kind is op.ATOMIC_GROUP:
            found = _of(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            found = _of(value[2])
        elif kind is op.BRANCH:
            sides = [_of(side) for side in value[1]]
            if all(sides):
                found = frozenset().union(*sides)
                found = found if len(found) <= MOST_TEXTS else None
        best = _better(best, found)
    close()
    return best


def required_texts(pattern: str) -> frozenset[str] | None:
    """Small-letter texts of which one is in every text that the Java pattern matches, in any case; null if there are none worth looking for."""
    if _JAVA_ONLY.search(pattern):
        return None
    try:
        found = _of(parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None  # Java may read it, this parser does not
    return found if found and min(map(len, found)) >= LEAST_LENGTH else None


@dataclass(frozen=True)
class RuleIndex:
    """Checked rules of a table: ``rules`` by number, and (number, extension, is line rule, texts or null) of each rule and extension."""

    rules: list[Rule]
    entries: list[tuple[int, str, bool, tuple[str, ...] | None]]


def _java_error(spark: SparkSession, patterns: list[tuple[str, str, bool]]) -> str | None:
    """What Java says of the first pattern it can't compile, or that matches an empty line where that is refused."""
    compiler = spark._jvm.java.util.regex.Pattern
    for owner, pattern, is_line in patterns:
        try:
            compiled = compiler.compile(pattern)
        except Exception as error:  # what the gateway makes of a Java exception
            reason = getattr(error, "java_exception", error)
            return f"rule {owner}: {reason.getDescription() if hasattr(reason, 'getDescription') else reason}"
        if is_line and compiled.matcher("").find():
            return f"rule {owner}: the pattern matches an empty line"
    return None


def index_rules(rule_table: DataFrame) -> RuleIndex:
    """A table of rules, one row per rule and extension and Java patterns, checked and indexed.

    A rule with an unknown severity or scope, a pattern that Java can't compile, a line pattern that matches an empty line, or different
    values in the rows of one id is refused here, before any scan. Repeated rows count once; rows without an extension match no file."""
    rows = rule_table.select(*RULE_COLUMNS).distinct().orderBy("id", "extension").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a table of rules may have {MOST_RULES} rows")
    numbers: dict[str, int] = {}
    rules: list[Rule] = []
    entries = []
    seen: dict[str, tuple] = {}
    for r in rows:
        values = (r.severity, r.scope, r.pattern, r.anti or "", r.title, r.description, r.recommendation)
        if not r.id or not r.pattern:
            raise ValueError("a rule needs an id and a pattern")
        if seen.setdefault(r.id, values) != values:
            raise ValueError(f"rule {r.id}: id used twice")
        if r.severity not in SEVERITIES:
            raise ValueError(f"rule {r.id}: unknown severity {r.severity!r}")
        if r.scope not in (LINE, FILE):
            raise ValueError(f"rule {r.id}: unknown scope {r.scope!r}")
        if r.id not in numbers:
            numbers[r.id] = USER_RULE_ORD + len(rules)
            rules.append(Rule(r.id, r.severity, (), r.scope, r.pattern, anti=r.anti or None, title=r.title or "", description=r.description or "",
                              recommendation=r.recommendation or "", ord=numbers[r.id]))
    patterns = [(r.id, p, r.scope == LINE and p is r.pattern) for r in rules for p in (r.pattern, r.anti) if p]
    error = _java_error(rule_table.sparkSession, patterns)
    if error:
        raise ValueError(error)
    texts = {r.id: required_texts(r.pattern) for r in rules}
    for r in rows:
        if r.extension is not None:
            found = texts[r.id]
            entries.append((numbers[r.id], r.extension, r.scope == LINE, tuple(sorted(found)) if found else None))
    return RuleIndex(rules, entries)


CANDIDATES = "target_id string, path string, rule_ord int, lines array<struct<line: int, text: string>>, content string"


def _find(entries_of, batch_bytes: int = BATCH_BYTES):
    """``mapInArrow`` function from (target_id, path, ext, content) to the candidates of each file."""
    schema = pa.schema([("target_id", pa.string()), ("path", pa.string()), ("rule_ord", pa.int32()),
                        ("lines", pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())]))), ("content", pa.string())])

    def automata() -> dict:
        import ahocorasick
        by_extension: dict[str, dict[str, set]] = {}
        for number, extension, is_line, texts in entries_of():
            for text in texts or ():
                by_extension.setdefault(extension, {}).setdefault(text, set()).add((number, is_line))
        built = {}
        for extension, words in by_extension.items():
            built[extension] = ahocorasick.Automaton()
            for word, rules in words.items():
                built[extension].add_word(word, (tuple(sorted(n for n, line in rules if line)), tuple(sorted(n for n, line in rules if not line))))
            built[extension].make_automaton()
        return built

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automata()
        rows, held = [], 0
        for batch in batches:
            for target, path, extension, content in zip(*(batch.column(c).to_pylist() for c in ("target_id", "path", "ext", "content"))):
                if content is None or extension not in built:
                    continue
                at: dict[int, set] = {}
                whole: set[int] = set()
                breaks = [k for k, c in enumerate(content) if c == "\n"] if "\n" in content else []
                for end, (line_rules, file_rules) in built[extension].iter(lowered(content)):
                    whole.update(file_rules)
                    if line_rules:
                        line = bisect_right(breaks, end)
                        for n in line_rules:
                            at.setdefault(n, set()).add(line)
                texts = content.split("\n") if at else []
                for n in sorted(at.keys() | whole):
                    lines = [{"line": k + 1, "text": texts[k]} for k in sorted(at.get(n, ()))]
                    rows.append({"target_id": target, "path": path, "rule_ord": n, "lines": lines, "content": content if n in whole else None})
                    held += 100 + sum(len(x["text"]) for x in lines) + (len(content) if n in whole else 0)
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def candidates(texts: DataFrame, index: RuleIndex) -> DataFrame:
    """``(target_id, path, rule_ord, lines, content)`` of each file and rule that may match; ``content`` for file rules only."""
    entries = [e for e in index.entries if e[3]]
    shared = texts.sparkSession.sparkContext.broadcast(entries)
    extensions = sorted({e[1] for e in entries})
    ext = path_extension(F.col("path"))
    return texts.filter(ext.isin(extensions)).select("target_id", "path", ext.alias("ext"), "content").mapInArrow(_find(lambda: shared.value), CANDIDATES)


def _matched(found: DataFrame, index: RuleIndex) -> DataFrame:
    """``(target_id, path, rule_ord, line)`` of the candidates that match."""
    rows = [(r.ord, r.scope == LINE, r.pattern, r.anti) for r in index.rules]
    rules = found.sparkSession.createDataFrame(rows, "rule_ord int, is_line boolean, pattern string, anti string")
    small = sum(len(r[2]) + len(r[3] or "") for r in rows) <= BROADCAST_BYTES
    both = found.join(F.broadcast(rules) if small else rules, "rule_ord")
    hits = F.filter("lines", lambda x: ~is_suppressed(x["text"]) & F.rlike(x["text"], F.col("pattern")))
    line = F.when(F.col("is_line"), F.array_min(F.transform(hits, lambda x: x["line"])))
    whole = F.rlike("content", F.col("pattern")) & ~F.coalesce(F.rlike("content", F.col("anti")), F.lit(False))
    return both.select("target_id", "path", "rule_ord", line.alias("line"), F.when(F.col("is_line"), line.isNotNull()).otherwise(whole).alias("hit")).filter("hit").drop("hit")


def match_all(texts: DataFrame, entries, rules: list[Rule]) -> DataFrame:
    """``(target_id, path, rule_ord, line)`` by trying every line of ``texts`` with every rule of its extension; no index."""
    by_ord = {r.ord: r for r in rules}
    by_extension: dict[str, list] = {}
    for number, extension, is_line, _ in entries:
        rule = by_ord[number]
        by_extension.setdefault(extension, []).append({"n": number, "is_line": is_line, "pattern": rule.pattern, "anti": rule.anti})
    ext = path_extension(F.col("path"))
    kind = "map<string,array<struct<n:int,is_line:boolean,pattern:string,anti:string>>>"
    mine = F.element_at(F.from_json(F.lit(json.dumps(by_extension)), kind), ext)
    lines = F.transform(F.split("content", "\n"), lambda text: F.when(~is_suppressed(text), text))

    def hits(held: Column) -> Column:
        def of_rule(r: Column) -> Column:
            first = F.array_min(F.transform(held, lambda text, i: F.when(F.rlike(text, r["pattern"]), i + 1)))
            whole = F.rlike(F.col("content"), r["pattern"]) & ~F.coalesce(F.rlike(F.col("content"), r["anti"]), F.lit(False))
            line = F.when(r["is_line"], first)
            return F.when(F.when(r["is_line"], line.isNotNull()).otherwise(whole), F.struct(r["n"].alias("rule_ord"), line.alias("line")))
        return F.filter(F.transform(mine, of_rule), lambda h: h.isNotNull())

    found = F.get(F.transform(F.array(lines), hits), F.lit(0))
    return texts.filter(ext.isin(sorted(by_extension))).select("target_id", "path", F.explode(found).alias("hit")).select("target_id", "path", "hit.rule_ord", "hit.line")


def match_rule_index(files: DataFrame, index: RuleIndex) -> DataFrame:
    """Findings of all rules of the index; a line rule reports its first line. Files are pruned as for built-in rules."""
    texts = size_cap(prune_paths(files))
    parts = []
    if any(e[3] for e in index.entries):
        parts.append(_matched(candidates(texts, index), index))
    rest = [e for e in index.entries if not e[3]]
    if rest or not parts:
        parts.append(match_all(texts, rest, index.rules))
    hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return report_rules(hits, index.rules)
