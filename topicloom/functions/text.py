"""Text helpers: previews, keys, hashes, tokens, number formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns. WORD is one word character: a letter, a digit or an underscore.
WORD = r"[\p{L}\p{N}_]"
# A term starts where no word character precedes and ends on a word boundary.
TERM_PATTERN = rf"(?<!{WORD})[a-z][a-z0-9\-]{{2,}}(?:(?<!-)(?!{WORD})|(?<=-)(?={WORD}))"
COUNTED_WORD_PATTERN = r"[a-z0-9\-]+"
SENTIMENT_TOKEN_PATTERN = r"[a-z][a-z0-9\-']*"
PREVIEW_CHARS = 200
CONTENT_CAP = 2000
BLOCK_CAP = 1990


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda a plain expression is evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), 0)


# Characters counted as white space at the ends of a text.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def preview(text: Column, limit: int = PREVIEW_CHARS, ellipsis: bool = True) -> Column:
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(head, F.lit("..."))).otherwise(text) if ellipsis else head


def block_text(text: Column) -> Column:
    """At most 1990 characters, the last three an ellipsis when cut."""
    return F.when(
        F.length(text) > BLOCK_CAP, F.concat(F.substring(text, 1, BLOCK_CAP - 3), F.lit("..."))
    ).otherwise(text)


def cap_content(text: Column) -> Column:
    return F.substring(text, 1, CONTENT_CAP)


def squeeze(text: Column) -> Column:
    """Collapse white space and trim, keeping case."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def topic_key(topic: Column) -> Column:
    return F.lower(squeeze(topic))


def fingerprint(text: Column, prefix: str = "tl:v1:") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(topic_key(text), 256), 1, 24))


def analysis_key(topic: Column, sources: Column, count: Column, timeline: Column, region: Column) -> Column:
    return fingerprint(F.concat_ws("|", topic, sources, count.cast("string"), timeline, region))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def term_tokens(text: Column) -> Column:
    """Tokens a topic's vocabulary is drawn from."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def counted_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(COUNTED_WORD_PATTERN), F.lit(0))


def sentiment_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(SENTIMENT_TOKEN_PATTERN), F.lit(0))


def short_keyword(topic: Column) -> Column:
    """First three words longer than two characters, else the first 50 characters."""
    words = F.filter(F.split(F.trim(topic), r"\s+"), lambda w: F.length(w) > 2)
    return F.when(F.size(words) > 0, F.concat_ws(" ", F.slice(words, 1, 3))).otherwise(F.substring(topic, 1, 50))


def signed_percent(value: Column) -> Column:
    """``+12%``, rounded half to even; a small fall reads ``-0%``."""
    sign = F.when(value < 0, "-").otherwise("+")
    return F.concat(sign, F.abs(F.bround(value, 0)).cast("bigint").cast("string"), F.lit("%"))


def decimal_text(value: Column, places: int = 2) -> Column:
    return F.format_string(f"%.{places}f", F.round(value, places))
