"""ECMAScript pattern text -> ``java.util.regex`` pattern text.

The rules are written in the ECMAScript dialect. Three things differ there:
the white space class is Unicode-wide, the word boundary is ASCII, and ``.``
stops at four terminators only. ``single_line=True`` additionally keeps every
part of the pattern from crossing a newline, so that searching a whole text
finds exactly what searching its lines one by one would find.
"""

from __future__ import annotations

import re

# White space and line terminators of ECMAScript.
SPACE_IN_LINE = r"\t\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = r"\n" + SPACE_IN_LINE
NOT_TERMINATOR = r"[^\n\r\u2028\u2029]"

_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_PIECE = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|.", re.S)


def java_pattern(pattern: str, ignore_case: bool = False, single_line: bool = False) -> str:
    space = SPACE_IN_LINE if single_line else SPACE

    def convert(match: re.Match) -> str:
        piece = match.group(0)
        if piece == r"\s":
            return f"[{space}]"
        if piece == r"\b":
            return _BOUNDARY
        if piece == ".":
            return NOT_TERMINATOR
        if piece == "^" and single_line:
            return r"(?<![^\n])"
        if piece == "$":
            return r"(?![^\n])" if single_line else r"\z"
        if piece in (r"\W", r"\D") and single_line:
            return rf"[^{piece.lower()}\n]"
        if piece.startswith("[") and len(piece) > 1:
            inner = piece[1:-1].replace(r"\s", space)
            if single_line and inner.startswith("^"):
                inner += r"\n"
            elif single_line and re.search(r"\\[WDS]", inner):
                inner += r"&&[^\n]"
            return f"[{inner}]"
        return piece

    return ("(?i)" if ignore_case else "") + _PIECE.sub(convert, pattern)
