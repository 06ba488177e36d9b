"""Field extraction from one access-log line with built-in expressions."""

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.schema import LINE_FIELDS

# The accepted line layout. It is searched for, not anchored, so text
# before and after it is ignored; the first place it matches counts, with the time
# and then the request as short as possible. NON_SPACE and DIGIT spell out, for
# Java's regex engine, the Unicode-aware meaning the layout gives to \S and \d.
#   (\S+) (\S+) (\S+) \[(.*?)\] "(.*?)" (\d+) (\d+) "([^"]*)" "([^"]*)" (\d+)
NON_SPACE = (
    r"[^\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
DIGIT = r"\p{Nd}"

# What every match contains: two literals, found by a byte search, and the part from
# the end of the request on. Text without them never meets the general pattern.
MARKERS = (" [", '] "')
LINE_END = rf'" {DIGIT}++ {DIGIT}++ "[^"]*+" "[^"]*+" {DIGIT}'

# The common case: a match at the first character, with plain ASCII tokens, no quote
# or newline inside quoted parts and numbers that fit their column types. No
# quantifier backtracks. Where this matches, the layout's first match is the same
# one: each token here can end in one place only.
PLAIN_LINE = (
    r"(?s)^([!-~]++) ([!-~]++) ([!-~]++) "
    r'\[([^\]"\n]*+)\] "([^"\n]*+)" '
    r"([0-9]{1,9}+) ([0-9]{1,18}+) "
    r'"([^"\n]*+)" "([^"\n]*+)" ([0-9]{1,9}+)(?!\p{Nd}).*$'
)

# The general case, in time linear in the text. Tried as written, the layout costs
# a line that fails late (a "-" for its size, say) a hundred times more, as every
# start, time and request end is tried with every other. Three facts rule them out:
# the first match starts where a token starts; if a time can end at one '] "' and the
# rest matches after a later one, it matches after the first; and likewise, within
# one newline-free stretch, if a later bracket leads to a match the first one does.
# So each stretch has one candidate, which the atomic groups (?>..) commit to.
SEARCHED_LINE = (
    r"^(?s:.*?)(?<![^\n])"
    rf"(?>[^\n]*?(?<!{NON_SPACE})({NON_SPACE}++) ({NON_SPACE}++) ({NON_SPACE}++) "
    r'\[)(?>([^\n]*?)\] ")([^\n]*?)" '
    rf"({DIGIT}++) ({DIGIT}++) "
    rf'"([^"]*+)" "([^"]*+)" ({DIGIT}++)(?s:.*)$'
)

# Separators of the extracted fields. No field of PLAIN_LINE holds a newline. No
# field of SEARCHED_LINE holds a quote followed by a newline: tokens, time and
# request hold no newline, referrer and agent hold no quote.
PLAIN_SEPARATOR = "\n"
SEARCHED_SEPARATOR = '"\n'

# Decimal digits of other scripts, which the layout accepts in numbers, and the ASCII
# digits they stand for, in the same order.
OTHER_DIGITS = "".join(
    c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"
)
SAME_DIGITS = "".join(str(unicodedata.digit(c)) for c in OTHER_DIGITS)

_GROUP = {name: number for number, name in enumerate(LINE_FIELDS, start=1)}


def _template(fields: list[str], separator: str) -> str:
    return separator.join(f"${_GROUP[name]}" for name in fields)


def _typed(parts: Column, position: int, name: str) -> Column:
    """One extracted field in its column type; NULL for a number that does not fit."""
    text = F.get(parts, F.lit(position))
    kind = LINE_FIELDS[name]
    if kind == "string":
        return text.alias(name)
    translated = F.translate(text, OTHER_DIGITS, SAME_DIGITS)
    return F.coalesce(text.try_cast(kind), translated.try_cast(kind)).alias(name)


def extract_fields(df: DataFrame, line: str, fields: list[str], matched: str) -> DataFrame:
    """Add ``fields``, NULL where they are missing, and ``matched``: the line matches.

    One regex pass per plain line. The pass rewrites the line to the wanted groups
    only, so unwanted fields cost no string building. A rewritten line always
    differs from the line (the layout's own punctuation is gone), which is how a
    match is told from a non-match without running the pattern twice.

    The fields leave through ``inline(array(struct(..)))``, a one-row generator:
    filters on them stay above it. Without it the optimizer pushes filters below the
    projection, and every regex and cast runs twice per line.
    """
    text = F.col(line)
    kept = [F.col(f"`{name}`") for name in df.columns]
    may_match = F.contains(text, F.lit(MARKERS[0])) & F.contains(text, F.lit(MARKERS[1]))
    may_match = may_match & F.rlike(text, F.lit(LINE_END))
    plain, searched, parts = F.col("_plain"), F.col("_searched"), F.col("_parts")
    rewritten = df.select(
        *kept,
        F.regexp_replace(text, PLAIN_LINE, _template(fields, PLAIN_SEPARATOR)).alias("_plain"),
    ).select(
        *kept,
        plain,
        F.when(
            (plain == text) & may_match,
            F.regexp_replace(text, SEARCHED_LINE, _template(fields, SEARCHED_SEPARATOR)),
        ).alias("_searched"),
    )
    split = rewritten.select(
        *kept,
        F.when(plain != text, F.split(plain, PLAIN_SEPARATOR))
        .when(searched != text, F.split(searched, SEARCHED_SEPARATOR))
        .alias("_parts"),
    )
    typed = [_typed(parts, i, name) for i, name in enumerate(fields)]
    row = F.struct(*typed, parts.isNotNull().alias(matched))
    return split.select(*kept, F.inline(F.array(row)))


def strip_line_end(line: Column) -> Column:
    """Drop the line terminator: up to two newlines at the very end of the text."""
    return F.regexp_replace(line, r"\n{1,2}\z", "")
