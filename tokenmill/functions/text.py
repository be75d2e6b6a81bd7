"""Text functions: paragraph filter, line split, normalisation, pre-tokenisation, repair.

Everything is a built-in Spark expression except the two steps Spark SQL has
no function for (NFKD decomposition; HTML entity and mojibake repair), which
run as Arrow-batched pandas UDFs over a whole column.
"""

from __future__ import annotations

import html
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pre-tokenizer pattern. Alternatives, in order: one punctuation
# mark (Unicode P plus the ASCII symbols $ + < = > ^ ` | ~), one digit, a run of
# letters / marks, a run of anything else that is not whitespace.
PRETOKENIZE_PATTERN = (
    r"[\p{P}$+<=>^`|~]|\p{N}|[\p{L}\p{M}]+|[^\s\p{Z}\x85\p{L}\p{M}\p{N}\p{P}$+<=>^`|~]+"
)
# The same pattern for RE2 (DuckDB), whose \s lacks the vertical tab.
PRETOKENIZE_PATTERN_RE2 = (
    r"[\p{P}$+<=>^`|~]|\p{N}|[\p{L}\p{M}]+|[^\s\x0b\p{Z}\x85\p{L}\p{M}\p{N}\p{P}$+<=>^`|~]+"
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def char_length(x) -> Column:
    """Length in characters (code points), not bytes."""
    return F.char_length(_c(x))


def paragraph_filter(text, delimiter: str = "\n\n", min_chars: int = 20) -> Column:
    """Split on ``delimiter``, keep parts longer than ``min_chars`` characters, join with a newline.

    Newlines are normalised first (``\\r\\n`` and ``\\r`` become ``\\n``) as text-mode file reading does.
    """
    t = F.regexp_replace(F.regexp_replace(_c(text), "\r\n", "\n"), "\r", "\n")
    parts = F.split(t, _regex_literal(delimiter), -1)
    kept = F.filter(parts, lambda p: F.char_length(p) > min_chars)
    return F.array_join(kept, "\n")


def _regex_literal(s: str) -> str:
    special = set(".^$*+?()[]{}|\\")
    return "".join("\\" + ch if ch in special else ch for ch in s)


def split_lines(text) -> Column:
    """Array of lines (split on ``\\n``, empty lines kept)."""
    return F.split(_c(text), "\n", -1)


def pretokenize(text) -> Column:
    """Words and isolated punctuation marks / digits, in order (built-in regex, no UDF)."""
    return F.regexp_extract_all(_c(text), F.lit(PRETOKENIZE_PATTERN), 0)


@cache
def _splitter():
    import regex

    return regex.compile(PRETOKENIZE_PATTERN)


def split_words(s: str) -> list[str]:
    """The same split inside a Python worker."""
    return _splitter().findall(s)


def normalize_one(s):
    if s is None:
        return None
    if s.isascii():
        return s.lower()
    # each character by itself: the form of a letter does not depend on its place in the word
    return unicodedata.normalize("NFKD", s).translate(_FOLDED)


class _Folded(dict):
    """Code point -> its lower case, nothing for a non-spacing mark; filled as characters come."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        form = self[code] = "" if unicodedata.category(ch) == "Mn" else ch.lower()
        return form


_FOLDED = _Folded()


def pieces(s: str) -> list[str]:
    """A text cut at blanks and line breaks: no word crosses one, so a piece can be normalised and split by itself."""
    return s.replace("\n", " ").split(" ")


def words_of(piece: str) -> list[str]:
    """Normalised words of a piece of text."""
    if piece.isascii() and piece.isalpha():
        return [piece.lower()]
    return split_words(normalize_one(piece))


@F.pandas_udf(T.StringType())
def _normalize_udf(s: pd.Series) -> pd.Series:
    return s.map(normalize_one)


def normalize(text) -> Column:
    """NFKD, drop non-spacing marks (accents), lowercase."""
    return _normalize_udf(_c(text))


# Quote characters straightened by the repair step.
SINGLE_QUOTES = "\u02bc\u2018\u2019\u201a\u201b"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f"
# Terminal escape sequences and control characters removed.
TERMINAL_ESCAPE_PATTERN = r"\x1b\[[0-9;]*[A-Za-z]"
CONTROL_CHAR_PATTERN = r"[\x00-\x08\x0b\x0e-\x1f\x7f\u206a-\u206f\ufeff\ufff9-\ufffc]"
LINE_BREAK_PATTERN = r"\r\n|[\r\u2028\u2029\x85]"


#: Characters that a byte above 127 becomes when UTF-8 is misread as Latin-1 or the Western code page.
_WESTERN = {chr(b): b for b in range(0x80, 0x100)} | {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)}


@cache
def _damage():
    import re

    # one UTF-8 sequence of two to four bytes, as the characters its bytes were misread as
    lead = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in _WESTERN.items() if lo <= b <= hi) + "]"
    tail = lead(0x80, 0xBF)
    whole = f"{lead(0xC2, 0xDF)}{tail}|{lead(0xE0, 0xEF)}{tail}{{2}}|{lead(0xF0, 0xF4)}{tail}{{3}}"
    # the same with bytes lost on the way: U+FFFD or a substitute character, or a question mark beside a byte that is still there
    gone, left = "[\ufffd\x1a]", f"(?:{tail}|[\ufffd\x1a])"
    some = f"(?:{left}|[?])"
    ends = lambda n: f"(?=.{{0,{n - 1}}}[\ufffd\x1a?])(?=[?]{{0,{n - 1}}}{left}){some}{{{n}}}"
    lossy = f"{lead(0xC2, 0xDF)}{gone}|{lead(0xC2, 0xC3)}[?]|{lead(0xE0, 0xEF)}{ends(2)}|{lead(0xF0, 0xF4)}{ends(3)}"
    return re.compile(f"(?P<whole>{whole})|(?P<lossy>{lossy})", re.DOTALL)


def _reread(m) -> str:
    if m["lossy"]:
        return "\ufffd"
    try:
        return bytes(_WESTERN[c] for c in m.group()).decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def repair_encoding(s: str) -> str:
    """Misread UTF-8 sequences become the characters they stood for, each on its own; the rest stays.

    Text misread twice is repaired twice. A sequence that has lost bytes (U+FFFD, a substitute
    character or a question mark stands for them) becomes one U+FFFD, as what it stood for is unknown.
    """
    for _ in range(3):
        t = _damage().sub(_reread, s)
        if t == s:
            break
        s = t
    return s


def _decoded_one(s):
    if s is None:
        return None
    if "&" in s:
        s = html.unescape(s)
    return s if s.isascii() else repair_encoding(s)


@F.pandas_udf(T.StringType())
def _decode_udf(s: pd.Series) -> pd.Series:
    return s.map(_decoded_one)


@F.pandas_udf(T.StringType())
def _compose_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def decode_entities(text) -> Column:
    """HTML entities decoded, then misread encodings repaired."""
    return _decode_udf(_c(text))


def straighten(text) -> Column:
    """The built-in part of the repair: escapes, line breaks, quotes, control characters."""
    t = F.regexp_replace(_c(text), TERMINAL_ESCAPE_PATTERN, "")
    t = F.translate(t, SINGLE_QUOTES, "'" * len(SINGLE_QUOTES))
    t = F.translate(t, DOUBLE_QUOTES, '"' * len(DOUBLE_QUOTES))
    t = F.regexp_replace(t, LINE_BREAK_PATTERN, "\n")
    return F.regexp_replace(t, CONTROL_CHAR_PATTERN, "")


def fix_text(text) -> Column:
    """Full repair: what decoding brings to light is straightened after it, and NFKD comes last.

    NFKD also folds Latin ligatures and full-width characters.
    """
    return _compose_udf(straighten(decode_entities(text)))
