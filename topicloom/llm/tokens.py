"""Token ids of whole texts by the tokenizers library.

White space separates tokens in the vocabulary used here and is dropped. So a batch of texts is cut at spaces and line
feeds, each distinct piece gets its ids once, and the texts' ids are gathered from those of their pieces, all as
arrays. A piece of letters and then punctuation is two words to the tokenizer: each goes to the library's model as
it is, without normalization and splitting around it. All other pieces go through the whole tokenizer. Ids of words
are remembered by the worker. Files set up otherwise than ``CUTS_AT_SPACE`` says are used for whole texts. The result
is always that of ``encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids are kept as little-endian unsigned 32-bit integers.
ID = np.dtype("<u4")
#: Bytes of words and their ids that a worker remembers; beyond that it forgets them. Bounds memory, not results.
MEMO_BYTES = 16 << 20
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BATCH_BYTES = 3 << 20
#: Letters whose lower case and byte form are plain, and ASCII punctuation.
LETTERS = string.ascii_letters + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
SIMPLE = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*[!-/:-@\[-`{-~]*$"
#: The set-up under which pieces are independent of each other (fixed values of the public vocabulary file).
CUTS_AT_SPACE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}

_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cuts_at_space(setup: dict) -> bool:
    steps = {k: (setup.get(k) or {}) for k in ("normalizer", "pre_tokenizer")}
    split = (steps["pre_tokenizer"].get("pretokenizers") or [{}])[0]
    return (
        [x["type"] for x in steps["normalizer"].get("normalizers", [])] == CUTS_AT_SPACE["normalizer"]
        and [x["type"] for x in steps["pre_tokenizer"].get("pretokenizers", [])] == CUTS_AT_SPACE["pre_tokenizer"]
        and split.get("pattern") == {"Regex": CUTS_AT_SPACE["pattern"]}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and not setup.get("post_processor")
    )


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` numbered ``which``, one after the other."""
    n = lengths[which]
    ends = np.cumsum(n)
    at = np.repeat(starts[which] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at]


class _Memo:
    """Words met before and their ids, as arrays."""

    def __init__(self, learn: Callable[[list[str]], tuple[list[int], list[int]]]):
        self.learn = learn
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.flat = np.empty(0, ID)
        self.ends = np.zeros(1, np.int64)

    def runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(starts, lengths) in ``flat`` of the ids of distinct ``words``; new ones are learned together."""
        if self.words.nbytes + self.flat.nbytes > MEMO_BYTES:
            self.clear()
        which = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = which < 0
        if new.any():
            which[new] = len(self.words) + np.arange(np.count_nonzero(new))
            added = words.filter(pa.array(new))
            ids, ends = self.learn(added.to_pylist())
            self.ends = np.concatenate([self.ends, len(self.flat) + np.array(ends, np.int64)])
            self.flat = np.concatenate([self.flat, np.array(ids, ID)])
            self.words = pa.concat_arrays([self.words, added])
        return self.ends[which], self.ends[which + 1] - self.ends[which]


class Encoder:
    """Ids of texts with one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = _cuts_at_space(json.loads(self.tokenizer.to_str()))
        self.words, self.marks, self.others = _Memo(self._ids_of_words), _Memo(self._ids_of_words), _Memo(self._ids_of_pieces)
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.model = self.tokenizer.model

    def _ids_of_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids, numbers of ids) of words of lower-case letters, or of punctuation."""
        ids: list[int] = []
        ends = []
        for word in words:
            if word:
                plain = word if word.isascii() else self.as_bytes(word)[0][0]
                ids += [t.id for t in self.model.tokenize(plain)]
            ends.append(len(ids))
        return ids, ends

    def _ids_of_pieces(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        ids: list[int] = []
        ends = []
        for piece in pieces:
            ids += self.tokenizer.encode(piece, add_special_tokens=False).ids
            ends.append(len(ids))
        return ids, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). A null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.cuts:
            ids, ends = self._ids_of_pieces(texts.to_pylist())
            return np.array(ids, ID), np.diff(np.array([0, *ends], np.int64))
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        counts = pc.list_value_length(pieces).to_numpy().astype(np.int64)
        coded = pc.list_flatten(pieces).dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary
        # per distinct piece: its stem's and its punctuation's ids, or those of the whole piece
        simple = pc.match_substring_regex(distinct, SIMPLE)
        plain = distinct.filter(simple)
        stems = pc.utf8_lower(pc.utf8_rtrim(plain, string.punctuation)).dictionary_encode()
        marks = pc.utf8_ltrim(plain, LETTERS).dictionary_encode()
        stem_starts, stem_sizes = self.words.runs(stems.dictionary)
        words = self.words.flat
        mark_starts, mark_sizes = self.marks.runs(marks.dictionary)
        other_starts, other_sizes = self.others.runs(distinct.filter(pc.invert(simple)))
        flat = np.concatenate([words, self.marks.flat, self.others.flat])
        is_plain = simple.to_numpy(zero_copy_only=False)
        parts = np.zeros((len(distinct), 2, 2), np.int64)  # (first, second part) x (start, length)
        stem, mark = stems.indices.to_numpy(), marks.indices.to_numpy()
        parts[is_plain, 0] = np.stack([stem_starts[stem], stem_sizes[stem]], 1)
        parts[is_plain, 1] = np.stack([mark_starts[mark] + len(words), mark_sizes[mark]], 1)
        parts[~is_plain, 0] = np.stack([other_starts + len(words) + len(self.marks.flat), other_sizes], 1)
        by_piece = _gather(flat, parts[:, :, 0].ravel(), parts[:, :, 1].ravel(), np.arange(2 * len(distinct)))
        sizes = parts[:, :, 1].sum(1)
        ids = _gather(by_piece, np.cumsum(sizes) - sizes, sizes, which)
        ends = np.concatenate([[0], np.cumsum(sizes[which])])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)

    def documents(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, working on ``BATCH_BYTES`` of text at once."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            done = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, "right")))
            ids, lengths = self.encode(texts.slice(first, last - first))
            yield from np.split(ids, np.cumsum(lengths)[:-1])
            first = last


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_ids(text: Column, path: str) -> Column:
    """Column of the ids of a text, as bytes. ``path`` must name the same file on every machine."""

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = encoder(path)
        for texts in batches:
            yield pa.array([ids.tobytes() for ids in one.documents(texts)], pa.binary())

    return encode(text)
