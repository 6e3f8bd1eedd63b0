"""Lexicon sentiment of one text as a single Column without a shuffle: ``sentiment`` in the JVM, ``scanned_sentiment`` in
Python, which costs less for long texts.

A text is cut into tokens; each token that holds a lexicon entry gets the *first*
entry (in lexicon order) it contains, per polarity. Position ``i`` can score when token
``i`` or ``i+1`` holds an entry or the two together hold a two-word entry; scoring at
``i`` uses up ``i+1`` as well. Only those few positions are folded over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.text import SENTIMENT_TOKEN_PATTERN, let, sentiment_tokens
from topicloom.functions.wordlists import INTENSIFIERS, NEGATIVE_LEXICON, NEGATORS, POSITIVE_LEXICON, sql_list

LABEL_MARGIN = 0.08


def _ranked(lexicon: dict[str, int]) -> list[tuple[int, str]]:
    """(rank*10 + weight, entry): the smallest number names the first entry."""
    return [(rank * 10 + weight, entry) for rank, (entry, weight) in enumerate(lexicon.items(), start=1)]


def _single_words(lexicon: dict[str, int]) -> list[tuple[int, str]]:
    return [(code, entry) for code, entry in _ranked(lexicon) if " " not in entry]


def two_word_entries() -> list[tuple[int, str, str]]:
    return [(code, *entry.split(" ")) for code, entry in _ranked(NEGATIVE_LEXICON) if " " in entry]


def _words(values: list[str]) -> Column:
    return F.expr(f"array({sql_list(values)})")


def _first_entry(token: Column, lexicon: dict[str, int]) -> Column:
    entries = ", ".join(f"named_struct('code', {code}, 'entry', '{entry}')" for code, entry in _single_words(lexicon))
    return F.get(F.filter(F.expr(f"array({entries})"), lambda e: F.contains(token, e["entry"])), 0)["code"]


def _two_word_code(token: Column, following: Column) -> Column:
    code = F.lit(None).cast("int")
    for value, left, right in reversed(two_word_entries()):
        code = F.when(F.endswith(token, F.lit(left)) & F.startswith(following, F.lit(right)), F.lit(value)).otherwise(code)
    return code


def entry_pattern(entries: list[str]) -> str:
    """One alternation, grouped by first letter so that most positions fail at once."""
    by_letter: dict[str, list[str]] = {}
    for entry in entries:
        by_letter.setdefault(entry[0], []).append(entry[1:])
    return "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())


def _code_array(tokens: Column) -> Column:
    """Per token: null, or its codes in both lexicons."""
    any_entry = entry_pattern([e for _, e in _single_words(POSITIVE_LEXICON) + _single_words(NEGATIVE_LEXICON)])
    return F.transform(
        tokens,
        lambda t: F.when(
            t.rlike(any_entry),
            F.struct(
                _first_entry(t, POSITIVE_LEXICON).alias("p"),
                _first_entry(t, NEGATIVE_LEXICON).alias("n"),
            ),
        ),
    )


def _positions(tokens: Column, codes: Column) -> Column:
    """Zero-based positions that can score, ascending."""
    indexed = F.transform(codes, lambda c, i: F.when(c.isNotNull(), i))
    hit = F.filter(indexed, lambda i: i.isNotNull())
    around = F.filter(F.flatten(F.transform(hit, lambda i: F.array(i - 1, i))), lambda i: i >= 0)
    joined = F.concat_ws(" ", tokens)
    any_pair = F.lit(False)
    for _, left, right in two_word_entries():
        any_pair = any_pair | F.contains(joined, F.lit(f"{left} {right}"))
    paired = F.filter(
        F.transform(
            tokens,
            lambda t, i: F.when(_two_word_code(t, F.get(tokens, i + 1)).isNotNull(), i),
        ),
        lambda i: i.isNotNull(),
    )
    none = F.array().cast("array<int>")
    return F.array_sort(F.array_distinct(F.concat(around, F.when(any_pair, paired).otherwise(none))))


def _totals(tokens: Column, codes: Column) -> Column:
    negators, intensifiers = _words(NEGATORS), _words(INTENSIFIERS)

    def step(state: Column, i: Column) -> Column:
        before = F.slice(tokens, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))
        here, following = F.get(codes, i), F.get(codes, i + 1)
        pos = F.coalesce(F.least(here["p"], following["p"]) % 10, F.lit(0))
        neg = F.coalesce(
            F.least(here["n"], following["n"], _two_word_code(F.get(tokens, i), F.get(tokens, i + 1))) % 10, F.lit(0)
        )
        factor = F.when(F.arrays_overlap(before, intensifiers), 2).otherwise(1)
        flipped = F.arrays_overlap(before, negators)
        scored = F.struct(
            (i + 1).alias("used"),
            (state["pos"] + F.when(flipped, neg).otherwise(pos) * factor).alias("pos"),
            (state["neg"] + F.when(flipped, pos).otherwise(neg) * factor).alias("neg"),
        )
        return F.when(i <= state["used"], state).otherwise(scored)

    start = F.struct(F.lit(-1).alias("used"), F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    return F.aggregate(_positions(tokens, codes), start, step)


def label_of(score: Column) -> Column:
    return (
        F.when(score > LABEL_MARGIN, "positive").when(score < -LABEL_MARGIN, "negative").otherwise("neutral")
    )


def sentiment(text: Column) -> Column:
    """STRUCT<label, score, positive, negative> of a text; blank or null is neutral."""
    content = F.coalesce(text, F.lit(""))
    any_entry = entry_pattern([*POSITIVE_LEXICON, *NEGATIVE_LEXICON, *[e.split(" ")[0] for e in NEGATIVE_LEXICON if " " in e]])
    nothing = F.struct(F.lit(-1).alias("used"), F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    # Most texts hold no entry at all and are not even tokenised.
    totals = F.when(~F.lower(content).rlike(any_entry), nothing).otherwise(
        let(
            sentiment_tokens(content),
            lambda tokens: let(_code_array(tokens), lambda codes: _totals(tokens, codes)),
        )
    )

    return _finished(totals)


def _finished(totals: Column) -> Column:
    def finish(t: Column) -> Column:
        signal = t["pos"] + t["neg"]
        score = F.when(signal == 0, F.lit(0.0)).otherwise(F.round((t["pos"] - t["neg"]) / signal, 3))
        return let(
            score,
            lambda s: F.struct(
                label_of(s).alias("label"),
                s.alias("score"),
                t["pos"].cast("bigint").alias("positive"),
                t["neg"].cast("bigint").alias("negative"),
            ),
        )

    return let(totals, finish)


_TOKEN = re.compile(SENTIMENT_TOKEN_PATTERN)
#: What a token's characters leave behind, and where the token begins among them.
_RUN_END = re.compile(r"[a-z0-9\-']*")
_TOKEN_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789-'")


@cache
def _scanner():
    """Finds the words of all entries, of those of two words the first."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for entry in [*POSITIVE_LEXICON, *NEGATIVE_LEXICON]:
        made.add_word(entry.split(" ")[0], None)
    made.make_automaton()
    return made


@lru_cache(1 << 14)
def _codes(token: str) -> tuple[int | None, int | None]:
    """The codes of a token's first entries in both lexicons."""
    positive, negative = (next((code for code, entry in _single_words(x) if entry in token), None) for x in (POSITIVE_LEXICON, NEGATIVE_LEXICON))
    return positive, negative


def _weight(codes: list[int | None]) -> int:
    return min((c for c in codes if c is not None), default=0) % 10


def scanned_totals(low: str) -> tuple[int, int]:
    """(positive, negative) of a lower-cased text. A search for all entries finds the few tokens that hold one; a text
    without any isn't cut into tokens."""
    held = set()
    for end, _ in _scanner().iter(low):
        # the characters around an entry hold one token, which begins at their first letter
        begin = end
        while begin and low[begin - 1] in _TOKEN_CHARACTERS:
            begin -= 1
        held.add(_TOKEN.search(low, begin, _RUN_END.match(low, end).end()).group())
    if not held:
        return 0, 0
    tokens = _TOKEN.findall(low)
    codes = {i: _codes(t) for i, t in enumerate(tokens) if t in held}
    pairs: dict[int, int] = {}
    for i in codes:
        for code, left, right in reversed(two_word_entries()):
            if i + 1 < len(tokens) and tokens[i].endswith(left) and tokens[i + 1].startswith(right):
                pairs[i] = code
    found = {i for i, both in codes.items() if both != (None, None)}
    positive = negative = 0
    used = -1
    for i in sorted(found | {i - 1 for i in found if i} | pairs.keys()):
        if i <= used:
            continue
        used = i + 1
        (p, n), (p_next, n_next) = codes.get(i, (None, None)), codes.get(i + 1, (None, None))
        pos, neg = _weight([p, p_next]), _weight([n, n_next, pairs.get(i)])
        before = tokens[max(0, i - 2) : i]
        if any(t in NEGATORS for t in before):
            pos, neg = neg, pos
        factor = 2 if any(t in INTENSIFIERS for t in before) else 1
        positive, negative = positive + pos * factor, negative + neg * factor
    return positive, negative


def scanned_sentiment(text: Column) -> Column:
    """The same as ``sentiment``."""

    @F.arrow_udf("struct<pos:bigint,neg:bigint>")
    def totals(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [scanned_totals(t.as_py()) for t in texts]
            fields = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
            yield pa.StructArray.from_arrays(fields, ["pos", "neg"])

    return _finished(totals(F.lower(F.coalesce(text, F.lit("")))))


def lexicon_weights(token: Column) -> Column:
    """STRUCT<positive, negative> of one token's first entries, or null without any."""
    found = F.get(_code_array(F.array(token)), 0)
    return F.when(found.isNotNull(), F.struct((found["p"] % 10).alias("positive"), (found["n"] % 10).alias("negative")))


def token_contexts(text: Column) -> Column:
    """Tokens that follow a negator or an intensifier within two places."""

    def contexts(tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before = F.slice(tokens, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))
            return F.struct(
                (i + 1).alias("pos"),
                t.alias("token"),
                F.arrays_overlap(before, _words(NEGATORS)).alias("negated"),
                F.when(F.arrays_overlap(before, _words(INTENSIFIERS)), 2).otherwise(1).alias("factor"),
            )

        return F.filter(F.transform(tokens, one), lambda c: c["negated"] | (c["factor"] == 2))

    return let(sentiment_tokens(text), contexts)


def scored_positions(text: Column) -> Column:
    """The (1-based) positions that score, after each has used up the next token."""

    def visit(positions: Column, tokens: Column) -> Column:
        start = F.struct(F.lit(-1).alias("used"), F.array().cast("array<int>").alias("taken"))
        folded = F.aggregate(
            positions,
            start,
            lambda s, i: F.when(i <= s["used"], s).otherwise(
                F.struct((i + 1).alias("used"), F.concat(s["taken"], F.array(i)).alias("taken"))
            ),
        )
        return F.transform(
            folded["taken"], lambda i: F.struct((i + 1).alias("pos"), F.get(tokens, i).alias("token"))
        )

    return let(
        sentiment_tokens(text),
        lambda tokens: let(_code_array(tokens), lambda codes: visit(_positions(tokens, codes), tokens)),
    )
