"""The shipped syntax rules over a stream of tokens instead of lines of text.

A text is cut into tokens by one pattern: comments, strings, names, numbers, signs and line breaks. Comments go, a string becomes one token with
marks around it and without blanks inside, and the tokens are written one blank apart, with the line breaks where they were. A rule is a sequence
of tokens with gaps that may hold line breaks. So it finds a call however it is laid over lines, and nothing inside strings or comments,
as what is in there has no gaps. ``...`` in brackets stands for tokens whose brackets close, and a name that a rule uses twice
is compared as a set of names. All of it is SQL on the row of the file; only files with a word of a rule are cut into tokens.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from argusframe.functions.text import path_extension
from argusframe.operators.files import prune_paths, size_cap
from argusframe.operators.rules import AI_RULES, Rule
from argusframe.operators.sast import hit_line, report_rules

OPEN, CLOSE, BLANK = "\x02", "\x03", "\x01"

_JS_COMMENTS = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
_PY_COMMENTS = r"#[^\n]*+"
_PY_LONG = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|\'\'\'(?:[^\'\\]++|\\[\s\S]|\'(?!\'\'))*+\'\'\''
_SHORT = r'"(?:[^"\\\n]++|\\[\s\S])*+"|\'(?:[^\'\\\n]++|\\[\s\S])*+\''
_TEMPLATE = r"`(?:[^`\\]++|\\[\s\S])*+`"
_REST = r"[\p{L}_$][\p{L}\p{N}_$]*+|[0-9][0-9A-Za-z_.]*+|\n|[^\s]"
TOKENS = {
    "js": "|".join((_JS_COMMENTS, _SHORT, _TEMPLATE, _REST)),
    "py": "|".join((_PY_COMMENTS, _PY_LONG, _SHORT, _REST)),
}
_IS_COMMENT = {"js": r"\A/[/*]", "py": r"\A#"}

# Parts of rules.
G = r"[ \n]++"
NAME = r"[\p{L}_$][\p{L}\p{N}_$]*+"
#: A name or a chain of up to nine members, given back piece by piece if the rule goes on with a member. The bound keeps Java's matcher from recursing along
#: a chain; where a rule begins with an expression its last member is enough.
EXPRESSION = rf"{NAME}(?:[ \n]+\.{G}{NAME}){{0,8}}"
_PLAIN = rf"[^ \n()\[\]{{}}]++"
_LEAF = rf"[^ \n()\[\]{{}},]++"


def _balanced(depth: int, leaf: str) -> str:
    """Tokens, each with its gap behind it, whose brackets close within ``depth``."""
    if depth == 0:
        return rf"(?:{leaf}{G})*+"
    return rf"(?:{leaf}{G}|[(\[{{]{G}{_balanced(depth - 1, _PLAIN)}[)\]}}]{G})*+"


ANY = _balanced(4, _PLAIN)
ARGUMENT = _balanced(4, _LEAF)


def string(start: str = "", whole: bool = False) -> str:
    """A string token, with this start or (``whole``) this text."""
    return f"{OPEN}s{re.escape(start)}" + (CLOSE if whole else f"[^{CLOSE}]*+{CLOSE}")


def sequence(*parts: str) -> str:
    """Tokens with gaps between them, from the start of a token on; a part that is empty or ends in its own gap needs none."""
    out = r"(?<![^ \n])"
    for k, part in enumerate(parts):
        out += part + ("" if part in (ANY, ARGUMENT) or k == len(parts) - 1 else G)
    return out + r"(?![^ \n])"


_HOLE = rf"{OPEN}t[^{CLOSE}]*?\$\{{[^{CLOSE}]*+{CLOSE}"

#: By rule: the token sequences of which one must be there.
SEQUENCES: dict[str, tuple[str, ...]] = {
    "ai/hardcoded-api-key-in-source": tuple(sequence(NAME, "=", string(start)) for start in ("sk-", "sk_live_", "AKIA", "ghp_")),
    "ai/cors-allow-all-origins": (
        sequence("cors", r"\(", r"\{", rf"(?:{_LEAF}{G}:{G}{ARGUMENT},{G})*+origin", ":", rf"(?:{string('*', True)}|true)"),
        sequence(string("Access-Control-Allow-Origin", True), ":", string("*", True))),
    "ai/raw-sql-concatenation": (sequence(NAME, r"\.", "(?:query|execute)", r"\(", _HOLE), sequence(NAME, r"\.", "query", r"\(", string(), r"\+")),
    "ai/password-without-hashing": (sequence("password", "[:=]", EXPRESSION, r"\.", "body", r"\.", "password"),),
    "ai/jwt-weak-secret": (sequence("jwt", r"\.", "sign", r"\(", ARGUMENT, ",", string(), r"\)"),),
    "ai/unvalidated-redirect": (sequence("res", r"\.", "redirect", r"\(", EXPRESSION, r"\.", "(?:query|body)", r"\.", NAME, r"\)"),),
    "ai/exposed-admin-route": tuple(sequence(NAME, r"\.", "get", r"\(", string(start), ",") for start in ("/admin/", "/debug/")),
}
#: A name that is bound by the first sequence and must not be in the second.
UNBOUND = {"ai/express-no-helmet": (sequence("const", f"({NAME})", "=", "express", r"\(", r"\)"), sequence(f"({NAME})", r"\.", "use", r"\(", "helmet", r"\("))}

#: A text in small letters that has none of a rule's words is not cut into tokens for it; each lies within one token.
WORDS = {
    "ai/hardcoded-api-key-in-source": ("sk-", "sk_live_", "akia", "ghp_"),
    "ai/cors-allow-all-origins": ("origin",),
    "ai/raw-sql-concatenation": ("query", "execute"),
    "ai/express-no-helmet": ("express",),
    "ai/password-without-hashing": ("password",),
    "ai/jwt-weak-secret": ("jwt",),
    "ai/unvalidated-redirect": ("redirect",),
    "ai/exposed-admin-route": ("/admin/", "/debug/"),
}


def _literal(pattern: str) -> Column:
    return F.lit(pattern)


def token_text(content: Column, language: str) -> Column:
    """The tokens of a text, one blank apart, as the rules read them."""
    def written(token: Column) -> Column:
        breaks = F.regexp_replace(token, r"[^\n]++", "")
        quote = F.left(token, F.lit(1))
        long = F.rlike(token, F.lit(r"\A(?:\"\"\"|''')[\s\S]*(?:\"\"\"|''')\z"))
        inner = F.when(long, F.substring(token, F.lit(4), F.length(token) - 6)).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))
        inside = F.regexp_replace(F.translate(inner, OPEN + CLOSE, ""), r"\s", BLANK)
        text = F.concat(F.lit(OPEN), F.when(quote == "`", "t").otherwise("s"), inside, F.lit(CLOSE))
        is_string = F.rlike(token, F.lit(r"\A(['\"`])[\s\S]*\1\z")) & (F.length(token) > 1)
        return F.when(F.rlike(token, F.lit(_IS_COMMENT[language])), breaks).when(is_string, F.concat(text, F.lit(" "), breaks)).otherwise(token)

    tokens = F.regexp_extract_all(content, _literal(TOKENS[language]), F.lit(0))
    return F.concat(F.array_join(F.transform(tokens, written), " "), F.lit(" "))


def _before(stream: Column, patterns: Sequence[str]) -> Column:
    """The stream in front of the first of several sequences; null if there is none."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return F.when(stream.rlike(joined), F.get(F.split(stream, joined, 2), F.lit(0)))


def _before_unbound(stream: Column, bound: str, used: str) -> Column:
    """The stream in front of the first sequence whose name is not in the other one; null if all are."""
    names = F.regexp_extract_all(stream, _literal(bound), F.lit(1))
    free = F.array_except(names, F.regexp_extract_all(stream, _literal(used), F.lit(1)))
    place = F.array_position(names, F.get(free, F.lit(0))).cast("int")  # from 1; the pieces before it are in front
    pieces = F.split(stream, bound, -1)
    # every piece but the first begins after a sequence, which has as many line breaks as it was written with
    breaks = F.transform(F.regexp_extract_all(stream, _literal(bound), F.lit(0)), lambda m: F.regexp_replace(m, r"[^\n]++", ""))
    front = F.concat(F.array_join(F.slice(pieces, F.lit(1), place), ""), F.array_join(F.slice(breaks, F.lit(1), place - 1), ""))
    return F.when(F.size(free) > 0, front)


def syntax_hits(files: DataFrame, rules: Sequence[Rule] = AI_RULES) -> DataFrame:
    """``(target_id, path, rule_ord, line)`` of every rule hit, one row per file and rule; ``line`` is that of the first token."""
    parts = []
    for language, extensions in (("js", (".js", ".ts")), ("py", (".py",))):
        mine = [r for r in rules if set(r.extensions) & set(extensions) and (r.id in SEQUENCES or r.id in UNBOUND)]
        if not mine:
            continue
        ext = path_extension(F.col("path"))
        lower = F.lower("content")
        word = F.lit(False)
        for needle in sorted({n for r in mine for n in WORDS[r.id]}):
            word = word | F.contains(lower, F.lit(needle))
        texts = size_cap(prune_paths(files)).filter(ext.isin(*extensions) & word)
        streams = texts.select("target_id", "path", F.explode(F.array(token_text(F.col("content"), language))).alias("stream"))
        cases = []
        for r in mine:
            before = _before(F.col("stream"), SEQUENCES[r.id]) if r.id in SEQUENCES else _before_unbound(F.col("stream"), *UNBOUND[r.id])
            cases.append(F.struct(F.lit(r.ord).alias("rule_ord"), before.alias("before")))
        hits = streams.select("target_id", "path", F.explode(F.array(*cases)).alias("hit")).filter("hit.before IS NOT NULL")
        parts.append(hits.select("target_id", "path", "hit.rule_ord", hit_line(F.col("hit.before")).alias("line")))
    if not parts:
        return files.sparkSession.createDataFrame([], "target_id string, path string, rule_ord int, line int")
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return hits


def scan_syntax(files: DataFrame, rules: Sequence[Rule] = AI_RULES) -> DataFrame:
    """Findings of the syntax rules. Null and empty texts have no tokens; a string or comment that does not close ends with its line or is read as signs."""
    return report_rules(syntax_hits(files, rules), rules)
