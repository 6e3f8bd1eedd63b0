"""Low-signal test, label clean-up and cluster labels, over named columns.

The word lists go into the expression as one SQL text, so that ``IN`` becomes a hash
lookup and building the plan stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.text import let
from topicloom.functions.wordlists import (
    GENERIC_LABEL_TERMS,
    LABEL_ACRONYMS,
    LOW_SIGNAL_TERMS,
    sql_list,
    stop_words,
)

DEFAULT_LABEL = "Emerging Topic"


def is_low_signal(term: str = "term") -> Column:
    """Short, numeric, holding a low-signal or short word, or made of stop words only."""
    words = f"filter(split(lower(trim({term})), r'\\s+'), t -> t <> '')"
    return F.expr(
        f"size({words}) = 0 OR trim({term}) RLIKE r'^\\d+$'"
        f" OR exists({words}, t -> t IN ({sql_list(LOW_SIGNAL_TERMS)}) OR length(t) < 3)"
        f" OR forall({words}, t -> t IN ({sql_list(stop_words())}))"
    )


def _label_words(keyword: str) -> str:
    dropped = sql_list(sorted(set(stop_words()) | set(LOW_SIGNAL_TERMS) | set(GENERIC_LABEL_TERMS)))
    return (
        f"slice(filter(split(lower({keyword}), r'\\s+'), t -> t NOT IN ({dropped}) AND length(t) >= 3"
        " AND NOT t RLIKE r'^\\d+$'), 1, 3)"
    )


def clean_label(keyword: str) -> Column:
    return F.concat_ws(" ", F.expr(_label_words(keyword)))


def cluster_label(keywords: str = "keywords") -> Column:
    """Up to four new words in keyword order, title-cased, acronyms in capitals."""
    words = F.expr(f"slice(array_distinct(flatten(transform({keywords}, k -> {_label_words('k')}))), 1, 4)")
    titled = F.transform(
        words,
        lambda t: F.when(t.isin(LABEL_ACRONYMS), F.upper(t)).otherwise(
            F.concat(F.upper(t.substr(F.lit(1), F.lit(1))), t.substr(F.lit(2), F.length(t)))
        ),
    )
    return let(titled, lambda ts: F.when(F.size(ts) > 0, F.concat_ws(" ", ts)).otherwise(F.lit(DEFAULT_LABEL)))
