"""String expressions with the semantics the scanners need."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

from argusframe.functions.regex import SPACE

# The characters of the class, one by one.
_SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{SPACE.replace('x0B', 'v')}]", c))
_LEAD_SPACE = f"^[{SPACE}]+"


def trim_space(text: Column) -> Column:
    """Trim every kind of white space; left to itself, Spark's ``trim`` takes blanks only."""
    return F.trim(text, F.lit(_SPACES))


def trim_start(text: Column) -> Column:
    return F.regexp_replace(text, _LEAD_SPACE, "")


def first_present(value: Column, fallback: Column | str) -> Column:
    """``fallback`` for null *and* for empty text."""
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.coalesce(F.when(value != "", value), other)


def decode_utf8(raw: Column) -> Column:
    """Bytes to text; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: one per character, two outside the BMP."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_extension(path: Column) -> Column:
    """Lower-cased last extension of the base name, with its dot; a name that
    only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]*)$", 1))


def relative_path(path: Column, root: Column | str) -> Column:
    """``path`` below ``root``; unchanged when it lies elsewhere."""
    root = F.lit(root) if isinstance(root, str) else root
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substr(path, F.length(prefix) + 1)).otherwise(path)


def escape_html(text: Column) -> Column:
    # Entity of each reserved character, ampersand first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def mask_secret(text: Column) -> Column:
    """Keep four characters and star the rest."""
    return F.concat(F.left(text, F.lit(4)), F.repeat(F.lit("*"), F.greatest(F.length(text) - 4, F.lit(0))))


def message(template: str, **values: Column) -> Column:
    """Fill ``{name}`` holes of a template with columns; null values as empty."""
    parts, rest = [], template
    while rest:
        head, hole, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if hole:
            name, _, tail = tail.partition("}")
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = tail
    return F.concat(*parts)


def literal_lookup(key: Column, table: dict, fields: tuple[str, ...]) -> Column:
    """``struct(fields..)`` of the table entry with the given key. The table is
    one JSON literal, which Spark folds to a map when it plans the query."""
    rows = {str(k): {f: getattr(v, f) for f in fields} for k, v in table.items()}
    kind = "map<string,struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    return F.element_at(F.from_json(F.lit(json.dumps(rows)), kind), key.cast("string"))
