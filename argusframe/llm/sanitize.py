"""Personal data: patterns, and terms that give protected entities away, in SQL expressions only.

*Base.* Emails, IPv4 addresses, payment cards and phone numbers are found by pattern and checked (ranges, Luhn,
number of digits). The patterns are those of the rule with possessive repeats and starts only at the edge of a run,
which finds the same matches without backtracking.

*Disclosure.* Each found value is a protected entity e, and every run of letters, marks and digits that touches no base span is a
candidate term t of its text. Over all different texts of the corpus (copies are no evidence) it is counted in how many e occurs, t occurs, and both
meet, wherever they are in the texts. The information that t gives about e, log2(P(e|t) / P(e)), is held against all there is to know about e, log2(1 / P(e)).
A term that gives away at least ``disclosure`` of it, on the evidence of at least ``support`` texts, is a further span and is
generalised wherever it is in the texts that hold e. Texts without the entity have nothing to protect and stay as they are.

Entities of fewer than ``support`` texts can meet no term often enough, so only the others are paired with the terms of their texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argusframe.llm.common import store
from argusframe.operators.skew import salted_join

# The kinds of personal data in the order of their listing and the patterns that define them.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
#: Key of a text.
TEXT = ["h", "c"]
# Cheap tests that a text with a valid match always passes.
HINTS = {
    "email": "contains({t}, '@')",
    "ip": r"{t} RLIKE r'[0-9]\.[0-9]'",
    "card": r"{t} RLIKE r'[0-9](?:[\x20-]?[0-9]){{11}}'",
    "phone": "contains({t}, '+')",
}
TERM = r"[\p{L}\p{M}\p{N}]++"


@dataclass(frozen=True)
class SanitizeParams:
    """``support``: texts in which an entity and its term meet at the least; ``disclosure``: share of what there is to know."""

    support: int = 2
    disclosure: float = 0.8


def spans_of(text: str, pattern: str) -> str:
    """SQL for the leftmost non-overlapping matches of a pattern as structs (s, e, v) in code points.

    What lies between the matches gives their places."""
    return f"""transform(array(named_struct('m', regexp_extract_all({text}, r'{pattern}', 0), 'g', split({text}, r'{pattern}', -1))), q ->
      aggregate(transform(q.m, (v, i) -> i), named_struct('at', 0, 'out', CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, v: STRING>>)), (a, i) -> named_struct(
        'at', a.at + char_length(q.g[i]) + char_length(q.m[i]),
        'out', array_append(a.out, named_struct('s', a.at + char_length(q.g[i]), 'e', a.at + char_length(q.g[i]) + char_length(q.m[i]), 'v', q.m[i]))), a -> a.out))[0]"""


def _valid(kind: str) -> str:
    """SQL for the check of a match x of a kind."""
    if kind == "ip":
        return r"forall(split(x.v, r'\.'), p -> char_length(regexp_replace(p, r'^0+(?=[0-9])', '')) <= 3 AND CAST(right(p, 3) AS INT) <= 255)"
    if kind == "card":
        digits = "translate(x.v, ' -', '')"
        luhn = f"""aggregate(sequence(1, char_length({digits})), 0, (t, i) -> t + transform(array(CAST(substring(reverse({digits}), i, 1) AS INT)),
          d -> IF(i % 2 = 1, d, IF(d > 4, 2 * d - 9, 2 * d)))[0])"""
        return f"char_length({digits}) BETWEEN 12 AND 19 AND {luhn} % 10 = 0"
    if kind == "phone":
        return "char_length(regexp_replace(x.v, '[^0-9]', '')) BETWEEN 9 AND 15"
    return "true"


def base_spans(text: str) -> Column:
    """Spans (s, o, e, v) of all kinds, by start and then by kind; ``o`` is the number of the kind."""
    none = "CAST(array() AS ARRAY<STRUCT<s: INT, o: INT, e: INT, v: STRING>>)"
    each = []
    for o, (kind, pattern) in enumerate(PATTERNS.items()):
        found = f"filter({spans_of(text, pattern)}, x -> {_valid(kind)})"
        found = f"transform({found}, x -> named_struct('s', x.s, 'o', {o}, 'e', x.e, 'v', x.v))"
        exists = f"regexp_count({text}, r'{pattern}') > 0"
        each.append(f"IF(({HINTS[kind].format(t=text)}) AND {exists}, {found}, {none})")
    return F.expr(f"array_sort(concat({', '.join(each)}))")


def _blanked() -> Column:
    """The text with as many blanks in place of its base spans, so that what is left keeps its places."""
    return F.expr("""IF(size(base) = 0, text, aggregate(base, named_struct('at', 0, 'out', ''), (a, x) -> IF(x.e <= a.at, a, named_struct('at', x.e,
      'out', concat(a.out, substring(text, a.at + 1, greatest(0, x.s - a.at)), repeat(' ', x.e - greatest(a.at, x.s))))), a -> concat(a.out, substring(text, a.at + 1))))""")


def _entities() -> Column:
    """Distinct fingerprints of the protected values of a text."""
    return F.expr("array_distinct(transform(base, b -> xxhash64(b.o, IF(b.o = 0, lower(b.v), regexp_replace(b.v, '[^0-9.]', '')))))")


def _terms() -> Column:
    """Distinct terms of a text without its base spans."""
    return F.expr(f"array_distinct(transform(regexp_extract_all(plain, r'{TERM}', 0), v -> lower(v)))")


def _places(texts: DataFrame) -> DataFrame:
    """(h, c, t, s, f): each place of a term; sums over the row of terms and gaps, as arrays would be copied for each term."""
    runs = texts.select(*TEXT, F.expr(f"regexp_extract_all(plain, r'{TERM}', 0)").alias("v"), F.expr(f"split(plain, r'{TERM}', -1)").alias("g"))
    runs = runs.select(*TEXT, F.arrays_zip("v", "g").alias("runs"))
    runs = runs.select(*TEXT, F.posexplode("runs").alias("i", "x")).filter("x.v IS NOT NULL")
    runs = runs.select(*TEXT, "i", F.expr("lower(x.v)").alias("t"), F.expr("char_length(x.v)").alias("n"), F.expr("char_length(x.g)").alias("gap"))
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy(*TEXT).orderBy("i")).cast("int")
    return runs.withColumn("f", end).select(*TEXT, "t", (F.col("f") - F.col("n")).alias("s"), "f")


def _printed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({names})[x.o], ':', x.s, ':', x.e)), ',')"


def _with_text_key(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of its text, 96 bits of hashes; rows with equal texts have equal keys."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("h", F.xxhash64(text)).withColumn("c", F.crc32(text.cast("binary")))


def revealing_terms(found: DataFrame, holders: DataFrame, held: DataFrame, p: SanitizeParams) -> DataFrame:
    """(e, t) of the terms that give away enough about an entity, counted over different texts."""
    met = holders.select("es", F.explode(_terms()).alias("t")).select("t", F.explode("es").alias("e"))
    meet = met.groupBy("e", "t").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= p.support)
    seen = found.select(F.explode(_terms()).alias("t")).groupBy("t").agg(F.count("*").alias("n_t")).filter(F.col("n_t") >= p.support)
    total = F.lit(float(max(1, found.count())))
    gain = F.log2(total * F.col("n_et") / (F.col("n_t") * F.col("n_e")))
    enough = gain >= p.disclosure * F.log2(total / F.least(total / 2, F.col("n_e")))
    return meet.join(seen, "t").join(held, "e").filter(enough).select("e", "t")


def detect_texts(docs: DataFrame, params: SanitizeParams | None = None) -> DataFrame:
    """(h, c, base, spans) of each different text of ``docs`` that has a span: base spans, and all spans with those of revealing terms."""
    p = params or SanitizeParams()
    texts = _with_text_key(docs.select(F.coalesce("text", F.lit("")).alias("text"))).dropDuplicates(TEXT)
    found = store(texts.select(*TEXT, "text", base_spans("text").alias("base")).select(*TEXT, "base", _blanked().alias("plain")), "detected")

    own = found.filter("size(base) > 0").select(*TEXT, F.explode(_entities()).alias("e"))
    held = store(own.groupBy("e").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= p.support), "held")
    known = own.join(held, "e").groupBy(*TEXT).agg(F.collect_list("e").alias("es"))
    holders = store(found.filter("size(base) > 0").select(*TEXT, "plain").join(known, TEXT), "holders")
    reveals = revealing_terms(found, holders, held, p)
    marked = holders.select(*TEXT, "es", F.explode(_terms()).alias("t")).select(*TEXT, "t", F.explode("es").alias("e")).join(reveals, ["e", "t"])
    marked = store(marked.select(*TEXT, "t").distinct(), "marked")
    places = _places(holders.join(marked.select(*TEXT).distinct(), TEXT)).join(marked, [*TEXT, "t"])
    terms = places.groupBy(*TEXT).agg(F.collect_set(F.expr(f"named_struct('s', s, 'o', {len(PATTERNS)}, 'e', f, 'v', t)")).alias("terms"))
    both = found.select(*TEXT, "base").join(terms, TEXT, "left").filter("size(base) > 0 OR terms IS NOT NULL")
    return both.select(*TEXT, "base", F.expr("array_sort(concat(base, coalesce(terms, array())))").alias("spans"))


def detect(docs: DataFrame, params: SanitizeParams | None = None) -> DataFrame:
    """(doc_id, base, spans) for each row of ``docs``. Rows with one text may be a third of all, so the join is salted."""
    rows = _with_text_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<s: INT, o: INT, e: INT, v: STRING>>)")
    joined = salted_join(rows, detect_texts(docs, params), TEXT, "left", salts=8)
    return joined.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def sanitize_digests(docs: DataFrame, params: SanitizeParams | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``.

    A null text counts as an empty one and has no spans; rows with equal texts come out alike and count as one text in the statistics; an empty table gives
    an empty result; only doc_id and text are read.
    """
    counts = [F.expr(f"CAST(size(filter(base, x -> x.o = {o})) AS BIGINT)").alias(f"n_{kind}") for o, kind in enumerate(PATTERNS)]
    return detect(docs, params).select("doc_id", *counts, F.sha2(F.expr(_printed("base")), 256).alias("base_sha256"), F.expr(_printed("spans")).alias("spans"))


def sanitize(docs: DataFrame, params: SanitizeParams | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; other columns and null texts stay.

    Of overlapping spans the first counts, and one that begins inside it goes with the rest of its characters kept out of the text.
    """
    found = detect_texts(docs, params).select(F.col("h").alias("__h"), F.col("c").alias("__c"), F.col("spans").alias("__spans"))
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    masked = f"""aggregate(__spans, named_struct('at', 0, 'out', ''), (a, x) -> CASE
        WHEN x.s >= a.at THEN named_struct('at', x.e, 'out', concat(a.out, substring(text, a.at + 1, x.s - a.at), array({names})[x.o]))
        ELSE named_struct('at', greatest(a.at, x.e), 'out', a.out) END, a -> concat(a.out, substring(text, a.at + 1)))"""
    text = F.coalesce("text", F.lit(""))
    same = (F.xxhash64(text) == F.col("__h")) & (F.crc32(text.cast("binary")) == F.col("__c"))
    return docs.join(found, same, "left").withColumn("text", F.expr(f"IF(__spans IS NULL, text, {masked})")).select(*docs.columns)
