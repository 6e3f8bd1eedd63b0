"""Alignment of the tokens of two tokenizers over the bytes of the same texts.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model with byte fallback. Both encode a space
and the text (B adds the space itself). Tokens get their places in two steps: the character offsets of A and the byte
spans in B's proto are coarse cuts; where such cuts don't agree with the lengths of the tokens' decoded bytes, i.e.
inside characters of several bytes and in runs of byte-fallback tokens, the places are counted on from the last cut
that does. A text is aligned only if the decoded bytes of both tokenizers are those of the space and the text.

Texts are cut at places over which neither tokenizer can join anything (``_cuts`` looks in the vocabularies whether
that holds), each distinct segment is encoded and aligned once, and a worker remembers bounded numbers of segments.
Groups, links and counts of a text are sums over its segments. A pair of ids that is linked in a document is counted
once for it. Tasks write *blocks*: the rows of their documents, and the distinct segments and id pairs in them with the
number of the block's documents that hold each pair. Pairs of all blocks are summed by Spark, the sums go back to the
blocks that hold the pairs, and every block is finished on its own. So nothing but a block's pairs (bounded) is in one
task, and texts are neither shuffled nor encoded twice.

Defined results: null and empty texts, and those whose bytes differ (they hold U+2581, say), have no tokens: zeros and
an empty digest. They count for no pair. Rows that repeat a doc_id are documents of their own; a null doc_id stays
null. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import spans_of, stage
from topicloom.llm.tokens import _gather

#: Segments that a worker remembers; beyond that it closes its block and forgets all but the most frequent. Bounds
#: memory, not results.
SEGMENTS = 300_000
#: Numbers of segments listed for the documents of one block, at most one document more.
ENTRIES = 4_000_000
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BATCH_BYTES = 3 << 20
#: Put between segments; a text that holds it is one segment.
MARK = "\x1e"
#: White space by any of the definitions in use.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Cuts before a space or a line feed that follows something else, before a letter after such a line feed, and after letters.
CUT_BEFORE_SPACE = rf"([^{SPACES}])([ \n])"
CUT_AFTER_LINE = rf"({MARK}\n)(\pL)"
CUT_AFTER_LETTERS = rf"(\pL)([^\pL'{SPACES}])"

DOCS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, segs binary, times binary"
STAGED = f"{DOCS}, seg_ids binary, seg_links binary, seg_pairs binary, pairs array<long>, docs array<long>"

_aligners: dict[tuple[str, str], Aligner] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Bytes:
    """Decoded bytes of every id of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = spans_of(self.sizes)[:-1]
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.names = np.array([str(i) for i in range(len(entries))], object)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.flat, self.starts, self.sizes, ids)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level entries: itself where it is printable in Latin-1,
    else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _runs(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over runs that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


class Aligner:
    """One pair of tokenizers, and the segments that this worker has met."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        entries = (names.get(i, "") for i in range(max(names) + 1))
        self.bytes_a = _Bytes([bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        of_byte = [self.b.is_byte(i) for i in range(len(pieces))]
        decoded = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, of_byte, strict=True)]
        self.bytes_b = _Bytes(decoded)
        self.cuts = self._cuts([p for p, byte in zip(pieces, of_byte, strict=True) if not byte])
        self.clear()

    def _cuts(self, pieces: list[str]) -> list[str]:
        """The cuts over which no entry of B reaches and that A's splitting makes anyway."""
        import json

        import regex

        setup = json.loads(self.a.to_str())
        split = setup.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or setup.get("normalizer") or setup.get("post_processor"):
            return []
        found = []
        if not any(regex.search("[^▁]▁|\n", p) for p in pieces):
            found += [CUT_BEFORE_SPACE, CUT_AFTER_LINE]
        if not any(regex.search(r"\p{L}[^\p{L}]", p) for p in pieces):
            found.append(CUT_AFTER_LETTERS)
        return found

    def clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.sums = np.zeros((5, 0), np.int64)  # n_a, n_b, n_groups, n_links, whether the bytes are equal
        self.groups = pa.array([], pa.binary())
        self.links = np.empty(0, np.int64)  # numbers of pairs, link by link
        self.pair_no: dict[int, int] = {}

    def forget(self, keep: np.ndarray) -> None:
        """Forget all segments but these."""
        n_links = self.sums[3]
        links = _gather(self.links, np.cumsum(n_links) - n_links, n_links, keep)
        held, self.links = np.unique(links, return_inverse=True)
        values = np.fromiter(self.pair_no, np.int64, len(self.pair_no))[held]
        self.pair_no = {p: i for i, p in enumerate(values.tolist())}
        self.words, self.groups, self.sums = self.words.take(pa.array(keep)), self.groups.take(pa.array(keep)), self.sums[:, keep]

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(segments of a space and each text, number of segments of each)."""
        texts = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
        odd = pc.match_substring(texts, MARK)
        marked = texts
        for cut in self.cuts:
            marked = pc.replace_substring_regex(marked, cut, rf"\1{MARK}\2")
        pieces = pc.split_pattern(marked, MARK)
        if pc.any(odd).as_py():
            pieces = pc.if_else(odd, pa.array([[t] for t in texts.to_pylist()], pieces.type), pieces)
        return pc.list_flatten(pieces), pc.list_value_length(pieces).to_numpy().astype(np.int64)

    def known(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct segments; new ones are learned together."""
        which = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = which < 0
        if new.any():
            which[new] = len(self.words) + np.arange(np.count_nonzero(new))
            added = words.filter(pa.array(new))
            for first in range(0, len(added), 20_000):
                self._learn(added.slice(first, 20_000))
            self.words = pa.concat_arrays([self.words, added])
        return which

    def _learn(self, words: pa.Array) -> None:
        sums, groups, pairs = self.align(words.to_pylist())
        no = self.pair_no
        distinct, which = np.unique(pairs, return_inverse=True)
        numbers = np.array([no.setdefault(p, len(no)) for p in distinct.tolist()], np.int64)
        self.links = np.concatenate([self.links, numbers[which]])
        self.sums = np.concatenate([self.sums, sums], 1)
        self.groups = pa.concat_arrays([self.groups, pa.array(groups, pa.binary())])

    def _tokens_a(self, segments: list[str], chars: np.ndarray):
        """(ids, numbers of ids, begins, ends): places in bytes, from character offsets."""
        found = self.a.encode_batch(segments, add_special_tokens=False)
        ids = [e.ids for e in found]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        base = np.repeat(spans_of(np.fromiter(map(len, segments), np.int64, len(segments)))[:-1], counts)
        flat = chain.from_iterable(chain.from_iterable(e.offsets for e in found))
        span = np.fromiter(flat, np.int64, 2 * len(base)).reshape(-1, 2) + base[:, None]
        return np.fromiter(chain.from_iterable(ids), np.int64, len(base)), counts, chars[span[:, 0]], chars[span[:, 1]]

    def _tokens_b(self, segments: list[str], at: np.ndarray):
        """The same from the spans in B's proto. B adds a space; a segment that has none in front gets a line feed, which
        joins with nothing, and the tokens of both are left out."""
        owned = [len(s) > 1 and s[0] == " " for s in segments]  # B gives nothing for an empty text
        asked = [s[1:] if own else "\n" + s for s, own in zip(segments, owned, strict=True)]
        found = [p.pieces for p in self.b.encode(asked, return_type="proto", num_threads=1)]
        pieces = list(chain.from_iterable(found))
        n = len(pieces)
        ids = np.fromiter([p.id for p in pieces], np.int64, n)
        span = np.stack([np.fromiter([p.begin for p in pieces], np.int64, n), np.fromiter([p.end for p in pieces], np.int64, n)], 1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        own = np.array(owned, bool)
        span += np.repeat(at[:-1] + np.where(own, 1, -1), counts)[:, None]
        first = np.cumsum(counts) - counts
        span[first[own], 0] = at[:-1][own]
        kept = np.ones(n, bool)
        kept[first[~own]] = kept[first[~own] + 1] = False
        return ids[kept], counts - 2 * ~own, span[kept, 0], span[kept, 1]

    @staticmethod
    def _ends(table: _Bytes, ids, counts, begins, ends, at, data) -> tuple[np.ndarray, np.ndarray]:
        """(end of each token in bytes, whether each segment's tokens decode to its bytes)."""
        sizes, n = table.sizes[ids], np.cumsum(counts)
        segment = np.repeat(np.arange(len(counts)), counts)
        decoded = np.cumsum(sizes) - np.concatenate([[0], np.cumsum(sizes)])[n - counts][segment] + at[:-1][segment]
        last = np.zeros(len(ids), bool)
        last[n[counts > 0] - 1] = True
        # a coarse cut holds if the next token begins where this one ends, and the bytes so far say the same
        following = np.append(begins[1:], 0)
        holds = (ends == decoded) & (last | (following == ends))
        place = np.maximum.accumulate(np.where(holds, np.arange(len(ids)), -1))
        run = np.cumsum(sizes)
        counted = np.where(place >= 0, ends[place] + run - run[place], run)
        fine = np.where(holds, ends, np.where((place >= 0) & (segment[place] == segment), counted, decoded))
        whole = _runs(sizes, n) == np.diff(at)
        if len(ids):
            mine = np.repeat(whole, counts)
            of_segment = np.repeat(whole, np.diff(at))
            same = table.of(ids[mine]) == data[of_segment]
            bytes_of = np.repeat(np.arange(len(counts)), np.diff(at))[of_segment]
            whole[bytes_of[~same]] = False
        return fine, whole

    def align(self, segments: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Of each segment: its sums and its groups as text, and the linked id pairs (A's id in the upper half) of all."""
        data = np.frombuffer("".join(segments).encode(), np.uint8)
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        at = chars[spans_of(np.array([len(s) for s in segments]))]
        ids_a, n_a, begin_a, end_a = self._tokens_a(segments, chars)
        ids_b, n_b, begin_b, end_b = self._tokens_b(segments, at)
        end_a, whole_a = self._ends(self.bytes_a, ids_a, n_a, begin_a, end_a, at, data)
        end_b, whole_b = self._ends(self.bytes_b, ids_b, n_b, begin_b, end_b, at, data)
        whole = whole_a & whole_b
        in_a, in_b = np.repeat(whole, n_a), np.repeat(whole, n_b)
        ids_a, end_a, ids_b, end_b = ids_a[in_a], end_a[in_a], ids_b[in_b], end_b[in_b]
        cuts, links = np.intersect1d(end_a, end_b, assume_unique=True), np.union1d(end_a, end_b)
        # between two ends that follow each other lies the overlap of one token of A with one of B
        pairs = (ids_a[np.searchsorted(end_a, links)] << 32) | ids_b[np.searchsorted(end_b, links)] if len(links) else links.astype(np.int64)
        per = lambda ends: np.diff(np.searchsorted(ends, at, "right"))
        n_groups = per(cuts)
        sums = np.stack([n_a * whole, n_b * whole, n_groups, per(links), whole])
        names_a, names_b = self.bytes_a.names[ids_a].tolist(), self.bytes_b.names[ids_b].tolist()
        group_a, group_b = (np.searchsorted(e, cuts, "right").tolist() for e in (end_a, end_b))
        texts, x, y = [], 0, 0
        for p, q in zip(group_a, group_b, strict=True):
            texts.append(f"{','.join(names_a[x:p])}|{','.join(names_b[y:q])}")
            x, y = p, q
        ends = spans_of(n_groups).tolist()
        return sums, [";".join(texts[i:j]).encode() for i, j in zip(ends, ends[1:], strict=False)], pairs


def aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


class _Block:
    """Documents of one block: what they hold of the worker's segments and pairs."""

    def __init__(self, one: Aligner, no: int):
        self.one, self.no, self.entries = one, no, 0
        self.used = np.zeros(0, np.int64)  # documents that hold a segment
        self.docs = np.zeros(0, np.int64)

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        one = self.one
        texts = pc.fill_null(texts.cast(pa.string()), "")
        flat, counts = one.segments(texts)
        coded = flat.dictionary_encode()
        words = one.known(coded.dictionary)[coded.indices.to_numpy()]
        ends = np.cumsum(counts)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        good = (_runs(one.sums[4][words], ends) == counts) & ~empty
        sums = np.stack([_runs(s[words], ends) for s in one.sums[:4]]) * good
        lists = pa.ListArray.from_arrays(pa.array(spans_of(counts), pa.int32()), one.groups.take(pa.array(words)))
        digests = [hashlib.sha256(t.as_buffer()).hexdigest() if g else "" for t, g in zip(pc.binary_join(lists, b";"), good, strict=True)]
        # distinct segments of each document, and how often it has them
        of = np.repeat(np.arange(len(counts)), counts)
        keep = good[of]
        key, times = np.unique(of[keep] * len(one.words) + words[keep], return_counts=True)
        doc, seg = np.divmod(key, max(1, len(one.words)))
        self._count(doc, seg)
        parts = np.searchsorted(doc, np.arange(1, len(counts)))
        self.entries += len(seg)
        columns = [
            pa.array(np.full(len(counts), self.no)), doc_ids.cast(pa.int64()), *map(pa.array, sums), pa.array(digests, pa.string()),
            pa.array([x.tobytes() for x in np.split(seg.astype("<u4"), parts)], pa.binary()),
            pa.array([x.tobytes() for x in np.split(times.astype("<u4"), parts)], pa.binary()),
        ]
        nothing = [pa.nulls(len(counts), k) for k in [pa.binary()] * 3 + [pa.list_(pa.int64())] * 2]
        return _batch(columns + nothing)

    def _count(self, doc: np.ndarray, seg: np.ndarray) -> None:
        """Count each pair once for every document that holds it."""
        one = self.one
        n_links = one.sums[3]
        self.used = np.pad(self.used, (0, len(one.words) - len(self.used)))
        self.docs = np.pad(self.docs, (0, len(one.pair_no) - len(self.docs)))
        self.used += np.bincount(seg, minlength=len(self.used))
        starts = np.cumsum(n_links) - n_links
        step = 1 << 20
        first = 0
        while first < len(doc):  # whole documents, about a million links at once
            last = int(np.searchsorted(doc, doc[min(first + step, len(doc)) - 1], "right"))
            links = _gather(one.links, starts, n_links, seg[first:last])
            holder = np.repeat(doc[first:last], n_links[seg[first:last]])
            held = np.unique(holder * len(one.pair_no) + links) % max(1, len(one.pair_no))
            self.docs += np.bincount(held, minlength=len(self.docs))
            first = last

    def frequent(self, most: int) -> np.ndarray:
        """Segments that more than one document of the block holds, the most frequent ones."""
        first = np.argsort(-self.used, kind="stable")[:most]
        return np.sort(first[self.used[first] > 1])

    def close(self) -> pa.RecordBatch:
        """The block's own row: its segments, their links, and its pairs in ascending order with their documents."""
        one = self.one
        segs = np.flatnonzero(self.used)
        n_links = one.sums[3]
        links = _gather(one.links, np.cumsum(n_links) - n_links, n_links, segs)
        values = np.fromiter(one.pair_no, np.int64, len(one.pair_no))[: len(self.docs)]
        held = np.flatnonzero(self.docs)
        held = held[np.argsort(values[held])]
        rank = np.zeros(len(self.docs), np.int64)
        rank[held] = np.arange(len(held))
        row = [[x.astype("<u4").tobytes()] for x in (segs, n_links[segs], rank[links])]
        nothing = [pa.nulls(1, k) for k in [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 2]
        own = [pa.array(x, pa.binary()) for x in row] + [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (values[held], self.docs[held])]
        return _batch([pa.array([self.no], pa.int64()), *nothing, *own])


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [c.strip().split(" ")[0] for c in STAGED.split(",")])


def blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows of documents and of blocks, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, no = aligner(paths), TaskContext.get().partitionId() << 24
        block = _Block(one, no)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                if len(one.words) > SEGMENTS or block.entries > ENTRIES:
                    yield block.close()
                    if len(one.words) > SEGMENTS:
                        one.forget(block.frequent(SEGMENTS // 2))
                    block = _Block(one, no := no + 1)
                done = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, "right")))
                yield block.add(*(c.slice(first, last - first) for c in batch.columns))
                first = last
        yield block.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(run, STAGED), "alignment")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(rows: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of one block, with the counts of its pairs."""
    own = rows.filter(pc.is_valid(rows["seg_ids"])).to_pylist()[0]
    docs = rows.filter(pc.is_null(rows["seg_ids"])).combine_chunks()
    order = np.argsort(counted["pair"].to_numpy())
    counts = counted["total"].to_numpy()[order].astype(np.int64)
    best = counted["best"].to_numpy()[order].astype(np.int64)
    seg_ids, seg_links, seg_pairs = (np.frombuffer(own[k], "<u4").astype(np.int64) for k in ("seg_ids", "seg_links", "seg_pairs"))
    ends = np.cumsum(seg_links)
    sums, bests = _runs(counts[seg_pairs], ends), _runs(best[seg_pairs], ends)
    segs = [np.frombuffer(b or b"", "<u4") for b in docs["segs"].to_pylist()]
    times = np.frombuffer(b"".join(docs["times"].to_pylist()), "<u4").astype(np.int64)
    at = np.searchsorted(seg_ids, np.concatenate([*segs, np.empty(0, "<u4")]))
    ends = np.cumsum([len(s) for s in segs], dtype=np.int64)
    columns = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    columns |= {"n_best": pa.array(_runs(bests[at] * times, ends)), "count_sum": pa.array(_runs(sums[at] * times, ends))}
    return pa.table(columns | {"groups_sha256": docs["groups_sha256"]})


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts links whose id pair is held by as many documents as any pair with the same id of A, ``count_sum``
    adds up the numbers of documents over the links.
    """
    staged = blocks(docs, paths or default_paths())
    held = staged.filter("seg_ids is not null").select(F.col("block").alias("home"), F.explode(F.arrays_zip("pairs", "docs")).alias("held"))
    held = held.select("home", F.col("held.pairs").alias("pair"), F.col("held.docs").alias("docs"))
    totals = stage(held.groupBy("pair").agg(F.sum("docs").alias("total")), "pair-counts")
    # an id of A has at most as many partners as B has entries
    most = F.max("total").over(Window.partitionBy(F.shiftright("pair", 32)))
    judged = totals.select("pair", "total", (F.col("total") == most).alias("best"))
    counted = held.select("home", "pair").join(judged, "pair")
    return staged.groupBy("block").cogroup(counted.groupBy("home")).applyInArrow(_finish, RESULT)
