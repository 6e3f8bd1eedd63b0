"""Reading lists and insight objects out of free-form responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.text import let, strip
from topicloom.functions.wordlists import QUERY_SUFFIXES

MAX_ITEMS = 8
# Fixed text: the row that stands in for an unreadable insight.
FALLBACK_TAKEAWAYS = ["Keyword trends extracted successfully.", "Multiple sources analysed."]
FALLBACK_OPPORTUNITIES = ["Further domain-specific research recommended."]
FALLBACK_CONFIDENCE = 0.4
INSIGHT_TYPE = (
    "struct<summary:string,key_takeaways:array<string>,opportunities:array<string>,confidence:double>"
)


def expand_topic(topic: Column) -> Column:
    """Four search queries per topic."""
    return F.array(*[F.concat(topic, F.lit(f" {suffix}")) for suffix in QUERY_SUFFIXES])


def strip_fences(raw: Column) -> Column:
    inner = strip(F.regexp_replace(raw, r"```(?:json)?", ""))
    return strip(F.rtrim(inner, F.lit("`")))


def string_list(raw: Column, topic: Column) -> Column:
    """A JSON array of strings, else all quoted strings of five or more characters, else
    the templated queries; at most eight."""

    def read(body: Column) -> Column:
        # Elements that are not strings make the array unusable, so types are checked first.
        kinds = F.schema_of_variant(F.try_parse_json(body))
        parsed = F.when(kinds.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.from_json(body, "array<string>"))
        quoted = F.regexp_extract_all(body, F.lit(r'"([^"]{5,})"'), F.lit(1))
        return F.coalesce(parsed, F.when(F.size(quoted) > 0, quoted), expand_topic(topic))

    return F.slice(let(strip_fences(raw), read), 1, MAX_ITEMS)


def insight(raw: Column, topic: Column) -> Column:
    """An insight object with its three required keys, else the fallback row."""
    fallback = F.struct(
        F.concat(F.lit("Intelligence analysis complete for topic: "), topic, F.lit(".")).alias("summary"),
        F.array(*[F.lit(x) for x in FALLBACK_TAKEAWAYS]).alias("key_takeaways"),
        F.array(*[F.lit(x) for x in FALLBACK_OPPORTUNITIES]).alias("opportunities"),
        F.lit(FALLBACK_CONFIDENCE).alias("confidence"),
    )

    def read(parsed: Column) -> Column:
        complete = (
            parsed["summary"].isNotNull() & parsed["key_takeaways"].isNotNull() & parsed["opportunities"].isNotNull()
        )
        return F.when(
            complete,
            F.struct(
                parsed["summary"].alias("summary"),
                parsed["key_takeaways"].alias("key_takeaways"),
                parsed["opportunities"].alias("opportunities"),
                F.coalesce(parsed["confidence"], F.lit(0.0)).alias("confidence"),
            ),
        ).otherwise(fallback)

    return let(F.from_json(strip_fences(raw), INSIGHT_TYPE), read)
