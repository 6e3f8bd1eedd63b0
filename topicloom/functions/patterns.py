"""Terms of a text, and counts of many terms in a text in one pass, by an Aho-Corasick automaton per list of terms.

Lists of terms travel with the rows as one string, a list per topic, so that a worker builds few automata and keeps
them. Texts come lower-cased from the JVM, and leave an Arrow batch one by one: what a worker holds besides the
batch is one text and its tokens.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache, partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between the terms of a list; terms are words, so none holds it.
SEPARATOR = "\x1f"
#: Automata that a worker keeps. Bounds memory, not results.
KEPT = 256
#: Counts that a task adds up before it passes them on. Bounds memory, not results.
HELD_COUNTS = 1 << 17
#: Bytes of texts that are looked at as an array at a time; a longer text by itself. Bounds memory, not results.
PART_BYTES = 1 << 22
#: ``text.TERM_PATTERN``: here the ends of a word are known by letters, digits and underscores of any script.
TERM = re.compile(r"\b[a-z][a-z0-9\-]{2,}\b")
#: A term without hyphens and spaces.
PLAIN = re.compile(r"[a-z][a-z0-9]{2,}")


class Automaton:
    """All terms of one list. Terms that are listed twice are counted twice, empty ones never occur."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        distinct = dict.fromkeys(t for t in terms if t)
        self.number = {t: i for i, t in enumerate(distinct)}
        self.places = [self.number.get(t, -1) for t in terms]
        self.pairs = {t.split(" ")[0] for t in distinct if " " in t}
        self.idx: dict[str, int] = {t: i for i, t in reversed(list(enumerate(terms))) if t}

    @cached_property
    def machine(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for t, i in self.number.items():
            made.add_word(t, (i, len(t), t.endswith("-")))
        if self.number:
            made.make_automaton()
        return made

    def occurrences(self, text: str) -> list[int]:
        """Non-overlapping occurrences of each term."""
        counts, ends = [0] * (len(self.number) + 1), [0] * len(self.number)
        for end, (i, size, _) in self.machine.iter(text) if self.number else ():
            if end + 1 - size >= ends[i]:
                counts[i] += 1
                ends[i] = end + 1
        return [counts[i] for i in self.places]

    def whole_words(self, text: str) -> list[int]:
        """Non-overlapping occurrences between word boundaries; after a closing hyphen the boundary is the start of the
        next word."""
        counts, ends = [0] * (len(self.number) + 1), [0] * len(self.number)
        n = len(text)
        for end, (i, size, hyphen) in self.machine.iter(text) if self.number else ():
            start = end + 1 - size
            if start < ends[i] or (start and _is_word(text[start - 1])):
                continue
            if (end + 1 < n and _is_word(text[end + 1])) == hyphen:
                counts[i] += 1
                ends[i] = end + 1
        return [counts[i] for i in self.places]

    def token_counts(self, tokens: list[str], held: Counter | None = None) -> dict[int, int]:
        """How often tokens (``held``: their counts), and pairs of tokens that follow each other, are terms, by the term's
        place in the list."""
        idx, firsts = self.idx, self.pairs
        held = Counter(tokens) if held is None else held
        found = {idx[t]: held[t] for t in held.keys() & idx.keys()}
        for a, b in pairwise(tokens) if firsts else ():
            if a in firsts and (i := idx.get(f"{a} {b}")) is not None:
                found[i] = found.get(i, 0) + 1
        return found


class Vocabulary:
    """Counts of one list of terms in texts whose tokens are known.

    A plain term stands between word boundaries just where a token, or a part of one between hyphens, is that term. So an
    automaton looks for the other terms only: pairs, terms with hyphens, and stop words, which the tokens lack.
    """

    def __init__(self, terms: list[str], stop_words: frozenset[str]):
        self.all = Automaton(terms)
        self.plain: dict[str, list[int]] = {}
        self.others: list[int] = []
        for i, t in enumerate(terms):
            if PLAIN.fullmatch(t) and t not in stop_words:
                self.plain.setdefault(t, []).append(i)
            elif t:
                self.others.append(i)
        self.rest = Automaton([terms[i] for i in self.others])
        self.listed = frozenset(self.all.idx) | self.plain.keys()

    def counts(self, text: str, tokens: list[str]) -> tuple[dict[int, int], dict[int, int]]:
        """``Automaton.token_counts``, and ``Automaton.whole_words`` of the terms that are there by place in the list."""
        listed = self.listed
        held = Counter([t for t in tokens if t in listed])
        among = self.all.token_counts(tokens, held)
        if "-" in text:
            cut = (t for piece in text.split() if "-" in piece for t in TERM.findall(piece) if "-" in t)
            held.update(p for t in cut for p in t.split("-") if p in listed)
        words = {i: held[t] for t in held.keys() & self.plain.keys() for i in self.plain[t]}
        if self.others:
            words.update((i, n) for i, n in zip(self.others, self.rest.whole_words(text), strict=True) if n)
        return among, words


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


@lru_cache(KEPT)
def _automaton(joined: str) -> Automaton:
    return Automaton(joined.split(SEPARATOR) if joined else [])


@lru_cache(KEPT)
def _vocabulary(joined: str, stop_words: frozenset[str]) -> Vocabulary:
    return Vocabulary(joined.split(SEPARATOR) if joined else [], stop_words)


def joined(terms: Column) -> Column:
    """A list of terms as one string."""
    return F.array_join(terms, SEPARATOR)


def tokens_of(low: str, stop_words: frozenset[str]) -> list[str]:
    """The tokens of a lower-cased text without stop words."""
    return [t for t in TERM.findall(low) if t not in stop_words]


def _added_up(batches: Iterator[pa.RecordBatch], terms_in, *columns: str, dropped: frozenset[str] = frozenset()) -> Iterator[pa.RecordBatch]:
    """(topic, term, total): what ``terms_in`` finds in each row's text and ``columns``, added up in parts, less ``dropped``."""
    held: dict[object, Counter] = {}
    size, kind = 0, pa.string()

    def drain() -> Iterator[pa.RecordBatch]:
        for topic, counts in held.items():
            for term in dropped & counts.keys():
                del counts[term]
            columns = [pa.array([topic], kind).take(pa.array(np.zeros(len(counts), np.int32))), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["topic", "term", "total"])
        held.clear()

    for batch in batches:
        kind = batch.schema.field("topic").type
        for topic, low, *rest in zip(*(batch[c] for c in ("topic", "low", *columns)), strict=True):
            if (text := low.as_py()) is None:
                continue
            counts = held.setdefault(topic.as_py(), Counter())
            size -= len(counts)
            counts.update(terms_in(text, *(r.as_py() for r in rest)))
            size += len(counts)
            if size >= HELD_COUNTS:
                yield from drain()
                size = 0
    yield from drain()


def token_totals(stop_words: Iterable[str]):
    """Function for ``mapInArrow`` over (topic, low): how often each token occurs. Stop words are counted like any word and
    left out of the sums, which costs less than asking for each token."""
    return partial(_added_up, terms_in=TERM.findall, dropped=frozenset(stop_words))


@lru_cache(KEPT)
def _words(joined: str, n: int) -> tuple[frozenset[str], frozenset[str]]:
    words = joined.split(SEPARATOR)
    return frozenset(words[:n]), frozenset(words)


def pair_totals(stop_words: Iterable[str]):
    """Function for ``mapInArrow`` over (topic, low, words, firsts, any_second): how often pairs of tokens occur whose first
    is one of the ``firsts`` first words and whose second is one of the words, or anything if ``any_second``."""
    stops = frozenset(stop_words)

    def pairs(low: str, words: str, firsts: int, any_second: bool) -> list[str]:
        first, second = _words(words, firsts)
        tokens = pairwise(tokens_of(low, stops))
        return [f"{a} {b}" for a, b in tokens if a in first and (any_second or b in second)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _added_up(batches, pairs, "words", "firsts", "any_second")

    return count


def _rows(*columns: pa.Array) -> Iterator[tuple]:
    """The rows of a batch, of which one at a time is made into Python objects."""
    return (tuple(v.as_py() for v in row) for row in zip(*columns, strict=True))


def parts_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows (from, to) that hold at most ``PART_BYTES``, but a row at least."""
    before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(before, before[at] + PART_BYTES, "right")) - 1)
        yield at, end
        at = end


#: Bytes of words that ``text.COUNTED_WORD_PATTERN`` counts.
_COUNTED = np.zeros(256, bool)
_COUNTED[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), ord("-")]] = True


def counted_words_of(texts: pa.StringArray) -> np.ndarray:
    """How many runs of a-z, 0-9 and hyphens each of the texts holds."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    if held is None or ends[-1] == ends[0]:
        return np.zeros(len(texts), np.int64)
    inner = _COUNTED[np.frombuffer(held, np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    firsts = ends[:-1][ends[:-1] < len(inner)]
    begins[firsts] = inner[firsts]
    return np.diff(np.searchsorted(np.flatnonzero(begins), ends))


def text_counts(low: Column, terms: Column) -> Column:
    """Of a lower-cased text: how many words it has (``text.COUNTED_WORD_PATTERN``), and the occurrences of each of ``terms``
    (an array of strings), as an array; substrings count. Null if either is null."""

    @F.arrow_udf("struct<words:int,counts:array<bigint>>")
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            texts = texts.cast(pa.string())
            ends, counts, missing = [0], array("q"), []
            for text, terms in _rows(texts, lists):
                missing.append(text is None or terms is None)
                if not missing[-1]:
                    counts.extend(_automaton(terms).occurrences(text))
                ends.append(len(counts))
            words = [counted_words_of(texts.slice(lo, hi - lo)) for lo, hi in parts_of(texts)]
            gone = pa.array(missing, pa.bool_())
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(counts, np.int64)), mask=gone)
            n = pa.array(np.concatenate([*words, np.zeros(0)]).astype(np.int32), mask=np.array(missing, bool))
            yield pa.StructArray.from_arrays([n, values], ["words", "counts"], mask=gone)

    return count(low, joined(terms))


def occurrence_counts(low: Column, terms: Column) -> Column:
    """Occurrences of each of ``terms`` (an array of strings) in a lower-cased text, as an array; substrings count."""
    return text_counts(low, terms)["counts"]


def term_counts(stop_words: Iterable[str]):
    """Function for ``mapInArrow`` over (topic, key, low, terms): (topic, key, items) of the rows whose text holds a term.
    ``items`` has (idx, tf, literal) of each term that is there: its place in the list, its count among the tokens that
    aren't stop words and pairs of them, and its whole-word count in the text.

    Not a column: a filter on a column from Python is planned with a second run of the Python code.
    """
    stops = frozenset(stop_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic, key, texts, lists = batch.columns
            rows, ends, idx, tf, literal = array("i"), array("i", [0]), array("i"), array("i"), array("i")
            for row, (text, terms) in enumerate(_rows(texts, lists)):
                if text is None or terms is None:
                    continue
                one, tokens = _vocabulary(terms, stops), tokens_of(text, stops)
                held, words = one.counts(text, tokens)
                for i in sorted(words.keys() | held.keys()):
                    idx.append(i)
                    tf.append(held.get(i, 0))
                    literal.append(words.get(i, 0))
                if len(idx) > ends[-1]:
                    rows.append(row)
                    ends.append(len(idx))
            taken, offsets, *fields = (pa.array(np.frombuffer(c, np.int32)) for c in (rows, ends, idx, tf, literal))
            items = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["idx", "tf", "literal"]))
            yield pa.RecordBatch.from_arrays([topic.take(taken), key.take(taken), items], [*batch.schema.names[:2], "items"])

    return count
