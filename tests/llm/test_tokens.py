import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import LONG, awkward, docs
from topicloom.llm.packing import best_fit_decreasing, best_fit_packing, lower_bound, pack
from topicloom.llm.token_files import File, read, write
from topicloom.llm.common import filesystem, new_folder
from topicloom.llm.tokens import ID, Encoder, default_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain():
    return tokenizers.Tokenizer.from_file(default_path())


def _direct(plain, text, end):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, end], ID)


def test_encoder_gives_what_the_library_gives(plain):
    pick = random.Random(7)
    parts = list("abcAZ 019.,!?'\"-_<>|$%&*#\n\t\r\x0b\x1c\x85\xa0　éÉßÑ÷ªµİΣς中한🙂́ﬁ½") + ["'s", "<|endoftext|>", "don't", " the "]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 40))) for _ in range(3000)] + [None, "", LONG, "x" * 5000]
    found = Encoder(default_path()).documents(pa.array(texts))
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_encoder_forgets_without_changing(plain, monkeypatch):
    import topicloom.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MEMO_BYTES", 100)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 50)
    texts = [f"some words {i} and more {i % 7}" for i in range(60)]
    for text, ids in zip(texts, Encoder(default_path()).documents(pa.array(texts)), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, plain):
    table = docs(spark, awkward())
    held = write(table, new_folder(spark, "test"), end_id=2)
    got = sorted(read(spark, held).collect(), key=lambda r: r.start)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    expected = sorted((str(i), _direct(plain, t, 2).tobytes()) for i, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == expected
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
        at += r.n_tokens
    # short-document access by id
    store, root = filesystem(held.folder)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for row in held.manifest(spark).collect():
        one = File(store, f"{root}/{row.file}", held.dictionary)
        for i in (4, 5, 11):
            for at in one.find(i):
                assert one.ids(at).tolist() in [_direct(plain, t, 2).tolist() for t in texts[i]]
        with pytest.raises(ValueError, match="another dictionary"):
            File(store, f"{root}/{row.file}", b"other")


def test_token_files_of_nothing(spark):
    held = write(docs(spark, []), new_folder(spark, "test"), end_id=2)
    assert read(spark, held).collect() == []


def _check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_awkward_rows(spark, plain):
    table = docs(spark, awkward())
    got = best_fit_packing(table, capacity=64, end_id=1).collect()
    _check(got, 64)
    want = []
    for r in table.collect():
        ids = _direct(plain, r.text, 1)
        for k, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want.append((str(r.doc_id), k, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert best_fit_packing(docs(spark, [])).collect() == []


def test_partitions_exchange_until_few_bins_are_left(spark, monkeypatch):
    import topicloom.llm.packing as packing

    monkeypatch.setattr(packing, "PART", 60)
    pick = random.Random(1)
    lengths = [pick.randint(1, 99) for _ in range(400)] + [100] * 5
    rows = [(i, 0, 0, n, n) for i, n in enumerate(lengths)]
    got = pack(spark.createDataFrame(rows, packing.PIECES), 100).collect()
    assert len(got) == len(rows)
    bins = _check(got, 100)
    at_once = best_fit_decreasing(np.array(lengths), 100)[0].max() + 1
    assert lower_bound(np.array(lengths), 100) <= bins <= at_once * 1.04 + 1


def test_bounds_and_best_fit():
    pick = np.random.default_rng(5)
    for _ in range(200):
        lengths = pick.integers(1, 31, pick.integers(1, 9))
        bins, offsets = best_fit_decreasing(lengths, 30)
        used = np.bincount(bins, lengths)
        assert used.max() <= 30 and (offsets + lengths <= 30).all()
        assert lower_bound(lengths, 30) <= _fewest(sorted(lengths.tolist(), reverse=True), 30)
    assert lower_bound(np.array([60, 60, 60]), 100) == 3
    assert lower_bound(np.array([], int), 100) == 0


def _fewest(lengths, capacity):
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0] and i < len(lengths):
            return
        if i == len(lengths):
            best[0] = min(best[0], len(rooms))
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]
