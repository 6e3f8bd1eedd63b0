import hashlib
import io
import struct

import numpy as np
import pytest

from tests.llm.data import PAGES, VECTORS
from topicloom.llm import neighbours, warc
from topicloom.llm.common import filesystem, new_folder


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", "p", 1) for i, u, h in rows], PAGES)


BODY = "<html><body>" + "payload text é 🙂 " * 20 + "</body></html>"
ROWS = [
    (3, "http://a/1", BODY), (1, "http://a/2", BODY), (1, "http://a/2", BODY), (None, None, BODY), (7, "x\r\ny: z", BODY + "!"),
    (8, None, None), (9, "", ""), (10, "u", "short"), (11, "u", "short"), (None, None, None), (12, "http://long", "0123456789" * 300_000),
    (None, "http://only", BODY + "only null ids"), (None, "http://only", BODY + "only null ids"), (13, "u", "a" * 99), (14, "u", "a" * 99),
    (15, "u", "b" * 100), (16, "u", "b" * 100), (17, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 10), (18, "u", "é" * 50), (19, "u", "é" * 50),
]


def _expected(rows, least=100):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        refers = min(same) if len(data) >= least and same and min(same) != i else None
        out.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", str(refers)))
    return sorted(out)


def test_archives_round_trip(spark):
    got = warc.archived(_pages(spark, ROWS)).collect()
    rows = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got)
    assert rows == _expected(ROWS)
    assert warc.archived(_pages(spark, [])).collect() == []


def test_archives_hold_a_dictionary_and_whole_payloads(spark, monkeypatch):
    many = [(i, f"http://site/{i}", f"<html><head><title>{i}</title></head><body>{'common part ' * 20}{i * i}</body></html>") for i in range(400)]
    folder = new_folder(spark, "test")
    manifest = warc.write(warc.resolve(_pages(spark, many).coalesce(1)), folder)
    back = warc.read(spark, folder, manifest, with_payload=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in back} == {i: h for i, _, h in many}
    assert {r.page_id: r.url for r in back} == {i: u for i, u, _ in many}
    store, root = filesystem(folder)
    listed = manifest.collect()
    assert sum(r.records for r in listed) == len(many)
    for row in (r for r in listed if r.records >= 16):
        with store.open_input_file(f"{root}/{row.file}") as source:
            data = source.read()
        assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE
        assert sum(1 for _ in warc.records(io.BytesIO(data))) == row.records
        with pytest.raises(ValueError, match="ends within"):
            list(warc.records(io.BytesIO(data[:-3])))


def test_records_are_cut_anywhere(monkeypatch):
    out = io.BytesIO()
    out.close, closing = (lambda: None), out.close
    archive = warc.Archive(out)
    rows = [warc.record(i, "u", bytes([i % 256]) * (i * 37 % 5000), "0" * 64, None) for i in range(60)]
    for r in rows:
        archive.add(r)
    archive.close()
    for window, read in ((7, 11), (1 << 14, 100), (100, 1 << 20)):
        monkeypatch.setattr(warc, "WINDOW", window)
        monkeypatch.setattr(warc, "READ", read)
        assert list(warc.records(io.BytesIO(out.getvalue()))) == rows
    closing()


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s", 2, "q") for i, v in rows], VECTORS)


def _brute(rows, k, modulus):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = []
    queries = {}
    for i, v in good:
        if i % modulus == 0:
            queries[i] = min(queries.get(i, tuple(v)), tuple(v))
    for q, v in queries.items():
        found = sorted((float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(v, w, strict=True)))), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r, i, d) for r, (d, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_neighbours_are_exact(spark, monkeypatch):
    pick = np.random.default_rng(9)
    rows = [(i, pick.normal(size=8).round(2).tolist()) for i in range(1, 400)]
    rows += [(400 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(100, [9.0] * 8), (None, [1.0] * 8), (500, None), (501, []), (600, [0.0] * 8), (700, [float("nan")] * 8), (701, [1.0, None] * 4)]
    rows += [(800, [float("inf")] + [1.0] * 7), (900, [1.0, 2.0]), (901, [2.0, 2.0]), (902, [1.0]), (1000, [1e-30] * 8), (1001, [1e30] * 8)]
    for tile in (4096, 50):
        monkeypatch.setattr(neighbours, "TILE_ROWS", tile)
        got = [tuple(r) for r in neighbours.nearest(_vectors(spark, rows), 10, 20).collect()]
        assert sorted(got) == _brute(rows, 10, 20)
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 300)  # several groups of queries
    assert sorted(tuple(r) for r in neighbours.nearest(_vectors(spark, rows[:120]), 10, 20).collect()) == _brute(rows[:120], 10, 20)
    assert neighbours.nearest(_vectors(spark, [])).collect() == []


def test_neighbours_meet_in_a_grid(spark, monkeypatch):
    """Several blocks and slices; no row of vectors passes the driver."""
    pick = np.random.default_rng(3)
    rows = [(i, pick.normal(size=4).round(1).tolist()) for i in range(600)]
    table = _vectors(spark, rows).repartition(5)
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 200)
    kind = type(table)
    collect = kind.collect

    def small(df):
        assert "embedding" not in df.columns
        return collect(df)

    with monkeypatch.context() as driver:
        driver.setattr(kind, "collect", small)
        for name in ("toArrow", "toPandas", "toLocalIterator"):
            driver.setattr(kind, name, None)
        found = neighbours.nearest(table, 3, 20)
        got = sorted(tuple(r) for r in found.collect())
    assert got == _brute(rows, 3, 20)
    assert "embedding" not in found._jdf.queryExecution().toString()  # what is shuffled are heaps
    # one block, all slices in turn, give the same heaps as one slice
    monkeypatch.setattr(neighbours, "WAVES", 0)
    assert sorted(tuple(r) for r in neighbours.nearest(table, 3, 20).collect()) == got


def test_bounds_hold():
    pick = np.random.default_rng(1)
    for scale in (1e-30, 1.0, 1e20):
        a, b = (neighbours.Block(np.arange(50), pick.normal(size=(50, 33)) * scale) for _ in range(2))
        low, high = neighbours.bounds(a, b)
        exact = np.sqrt(((a.vectors[:, None] - b.vectors[None]) ** 2).sum(2))
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low).max() < 0.2 * exact.mean()
