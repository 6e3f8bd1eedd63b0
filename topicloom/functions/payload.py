"""Fields of heterogeneous social-post payloads.

A payload is read as MAP<STRING, STRING> in key order: scalars as text, objects as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.text import blank_to_null, let, strip

# Keys in order of preference.
TEXT_KEYS = ["content", "text", "postText", "commentary", "description", "body"]
URL_KEYS = ["linkedinUrl", "url", "postUrl", "link"]
DEFAULT_URL = "https://linkedin.com"
TIME_KEYS = [
    "postedAt", "postedAtTimestamp", "postDate", "postedDate", "publishedAt", "createdAt", "date", "timestamp",
]
TIME_PARENTS = ["post", "metadata", "actor"]
COUNT_PARENTS = ["socialActivity", "socialCounts", "engagement", "stats", "counts"]
LIKE_WORDS = "like|reaction"
COMMENT_WORDS = "comment"
SHARE_WORDS = "repost|share|reshare"
MIN_POST_CHARS = 20
EPOCH_MILLIS_ABOVE = 1_000_000_000_000

PAYLOAD_TYPE = "map<string,string>"


def as_map(json: Column) -> Column:
    return F.from_json(json, PAYLOAD_TYPE)


def field(payload: Column, key: str) -> Column:
    return F.try_element_at(payload, F.lit(key))


def first_filled(payload: Column, keys: list[str], default: Column) -> Column:
    return F.coalesce(*[blank_to_null(field(payload, k)) for k in keys], default)


def post_text(payload: Column) -> Column:
    return strip(first_filled(payload, TEXT_KEYS, F.lit("")))


def post_url(payload: Column) -> Column:
    return first_filled(payload, URL_KEYS, F.lit(DEFAULT_URL))


def post_author(payload: Column) -> Column:
    def name_of(parent: str) -> Column:
        return blank_to_null(F.get_json_object(field(payload, parent), "$.name"))

    return F.coalesce(blank_to_null(field(payload, "authorName")), name_of("author"), name_of("actor"), F.lit(""))


def parse_time(value: Column) -> Column:
    """Epoch seconds or milliseconds (also as digits in text), or ISO-8601; else null."""
    raw = strip(value)
    number = F.expr("cast(null as double)")
    number = F.when(raw.rlike(r"^\d+(\.\d+)?([eE]\+?\d+)?$"), raw.cast("double")).otherwise(number)
    seconds = F.when(number > EPOCH_MILLIS_ABOVE, number / 1000.0).otherwise(number)
    # Later than year 9999 is no date.
    epoch = F.when(seconds < 253402300800, F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint")))
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), raw.try_cast("timestamp"))
    return F.when(number.isNotNull(), epoch).otherwise(iso)


def post_time(payload: Column, collected_at: Column) -> Column:
    """First parseable of the known keys, at top level, then inside three parents."""
    candidates = [parse_time(field(payload, k)) for k in TIME_KEYS]
    for parent in TIME_PARENTS:
        candidates += [parse_time(F.get_json_object(field(payload, parent), f"$.{k}")) for k in TIME_KEYS]
    return F.coalesce(*candidates, collected_at)


def _entries(json: Column) -> Column:
    return F.map_entries(F.when(json.startswith("{"), as_map(json)))


def _whole(value: Column) -> Column:
    return value.try_cast("double").cast("bigint")


def _digits(value: Column) -> Column:
    return F.when(strip(value).rlike(r"^\d+$"), strip(value).try_cast("bigint"))


def _nested_counts(payload: Column) -> Column:
    none = F.array().cast("array<struct<key:string,value:bigint>>")
    return F.concat(
        *[
            F.coalesce(
                F.transform(
                    _entries(field(payload, parent)),
                    lambda e: F.struct(F.lower(e["key"]).alias("key"), _whole(e["value"]).alias("value")),
                ),
                none,
            )
            for parent in COUNT_PARENTS
        ]
    )


def _top_counts(payload: Column) -> Column:
    def value_of(text: Column) -> Column:
        inner = F.aggregate(
            _entries(text),
            F.lit(0).cast("bigint"),
            lambda acc, e: acc + F.coalesce(_whole(e["value"]), F.lit(0)),
        )
        return F.when(text.startswith("{"), inner).otherwise(
            F.when(text.rlike(r"^\d+\.\d+$"), _whole(text)).otherwise(_digits(text))
        )

    return F.transform(
        F.map_entries(payload),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), value_of(e["value"]).alias("value")),
    )


def as_typed_map(json: Column) -> Column:
    """The fields of a JSON object in key order, each a VARIANT that knows its type."""
    return F.from_json(json, "map<string,variant>")


def _number(v: Column) -> Column:
    """A JSON number without its fraction, true as 1, false as 0; null for anything else."""
    kind = F.schema_of_variant(v)
    whole = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint")).otherwise(F.try_variant_get(v, "$", "double").cast("bigint"))
    numeric = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), whole)
    return F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint")).otherwise(numeric)


def _string_number(v: Column, pattern: str) -> Column:
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.when(text.rlike(pattern), strip(text).try_cast("bigint"))


def _typed_nested(payload: Column) -> Column:
    none = F.array().cast("array<struct<key:string,value:bigint>>")

    def entries(parent: str) -> Column:
        text = field(payload, parent)
        value = lambda v: F.coalesce(_number(v), _string_number(v, r"^\s*[+-]?\d+\s*$"))
        inner = F.map_entries(F.when(text.startswith("{"), as_typed_map(text)))
        return F.coalesce(F.transform(inner, lambda e: F.struct(F.lower(e["key"]).alias("key"), value(e["value"]).alias("value"))), none)

    return F.concat(*[entries(parent) for parent in COUNT_PARENTS])


def _typed_top(typed: Column) -> Column:
    def value_of(v: Column) -> Column:
        inner = F.map_values(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")))
        total = F.aggregate(
            inner, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(_number(x), _string_number(x, r"^\d+$"), F.lit(0).cast("bigint"))
        )
        return F.coalesce(_number(v), _string_number(v, r"^\s*\d+\s*$"), total)

    return F.transform(F.map_entries(typed), lambda e: F.struct(F.lower(e["key"]).alias("key"), value_of(e["value"]).alias("value")))


def typed_engagement_counts(payload: Column, json: Column) -> Column:
    """``engagement_counts`` by the types of the JSON text: in nested maps true counts as 1, 3.7 as 3 and quoted whole numbers
    as such, while "3.7" doesn't count; so too at top level, where a map counts as the sum of its values."""
    return _taken(F.concat(_typed_nested(payload), _typed_top(as_typed_map(json))))


def engagement_counts(payload: Column) -> Column:
    """STRUCT<likes, comments, shares> of a payload whose types are lost: first positive hit in key
    order, nested maps first; a key serves one metric only. Digits with a fraction count though they may have been quoted."""
    return _taken(F.concat(_nested_counts(payload), _top_counts(payload)))


def _taken(entries: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("likes"), zero.alias("comments"), zero.alias("shares"))

    def take(s: Column, e: Column) -> Column:
        likes = (s["likes"] == 0) & e["key"].rlike(LIKE_WORDS)
        comments = ~likes & (s["comments"] == 0) & e["key"].rlike(COMMENT_WORDS)
        shares = ~likes & ~comments & (s["shares"] == 0) & e["key"].rlike(SHARE_WORDS)
        return F.struct(
            F.when(likes, e["value"]).otherwise(s["likes"]).alias("likes"),
            F.when(comments, e["value"]).otherwise(s["comments"]).alias("comments"),
            F.when(shares, e["value"]).otherwise(s["shares"]).alias("shares"),
        )

    counted = let(entries, lambda found: F.filter(found, lambda e: e["value"] > 0))
    return F.aggregate(counted, start, take)
