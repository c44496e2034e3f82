"""Stripping text and pulling the SQL statement out of a model completion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class body, under the (?U) flag.
WHITESPACE_CLASS = r"\s\x1C-\x1F"

# The fence of a code block, its language tag and a leading label.
FENCE = "```"
TAG_PATTERN = r"(?iU)\Asql"
LABEL_PATTERN = (
    rf"(?iU)\A[{WHITESPACE_CLASS}]*(?:sql|sqlite|query)"
    rf"[{WHITESPACE_CLASS}]*:[{WHITESPACE_CLASS}]*"
)
# Runs of white space other than a single space, which may stay as it is.
_RUN_PATTERN = rf"(?U) [{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}&&[^ ]][{WHITESPACE_CLASS}]*"

# The bytes of one character of UTF-8, or a run of ASCII, with each byte as
# the character of the same number.
_UTF8_PATTERN = (
    r"[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]"
    r"|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)


def decode_utf8(data: Column) -> Column:
    """Bytes as text, without the bytes that belong to no character.

    Nothing is put in their place, and a replacement character that the bytes do spell
    stays. Valid bytes, the usual case, are only looked through.
    """
    text = data.cast("string")
    bytewise = F.decode(data, "ISO-8859-1")
    kept = F.regexp_replace(bytewise, rf"({_UTF8_PATTERN})|[\x80-\xFF]", "$1")
    mended = F.encode(kept, "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(mended)


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def unfence(text: Column) -> Column:
    """The body of the first fenced block, without its tag; the text itself when no
    block is closed. An empty body counts as a body."""
    parts = F.split(text, FENCE, 3)
    body = F.regexp_replace(F.get(parts, F.lit(1)), TAG_PATTERN, "")
    fenced = F.contains(text, F.lit(FENCE)) & (F.size(parts) == 3)
    return F.when(fenced, body).otherwise(text)


def drop_label(text: Column) -> Column:
    """Remove one leading ``sql:``, ``sqlite:`` or ``query:`` in any case.

    The pattern can match at the start only, so whether it does is asked of the
    text up to its first colon, which spares long texts a search at every position.
    """
    head = F.substring_index(text, ":", 1)
    labelled = F.contains(text, F.lit(":")) & F.regexp_like(
        F.concat(head, F.lit(":")), F.lit(LABEL_PATTERN)
    )
    return F.when(labelled, F.regexp_replace(text, LABEL_PATTERN, "")).otherwise(text)


def first_statement(text: Column) -> Column:
    """Everything before the first semicolon, even one inside a literal."""
    return F.substring_index(text, ";", 1)


def collapse_whitespace(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.btrim(F.regexp_replace(text, _RUN_PATTERN, " "))


def extract_sql(completion: Column) -> Column:
    """The single-line SQL statement of a completion; NULL becomes an empty string."""
    text = strip(F.coalesce(completion, F.lit("")))
    return collapse_whitespace(first_statement(drop_label(strip(unfence(text)))))


def clean_ddl(ddl: Column) -> Column:
    """Strip a CREATE statement, then drop every semicolon at its end."""
    return F.rtrim(strip(ddl), F.lit(";"))
