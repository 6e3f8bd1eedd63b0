"""The queries beside their SQL, and the pipeline beside its stages' rules."""

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.data import PLAIN, awkward, docs
from tests.oracle import _rows, connect
from topicloom.llm import decontamination, quality, secrets, simhash
from topicloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(spark, name):
    df = QUERIES[name](spark, SF)
    cur = connect(SF).execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, cur.fetchall())


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing",
    ]


def test_pipeline_stages_do_what_their_operators_say(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    names = rows.columns
    kept = corpus_pipeline.quality(spark, rows, SF).cache()
    assert kept.columns == names
    model = quality.fit(rows, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows.collect() if model.score(r.text) >= 0.3}
    once = corpus_pipeline.near_duplicates(spark, kept, SF).cache()
    assert once.columns == names
    assert {r.doc_id for r in once.collect()} == {r.component_id for r in simhash.near_duplicates(kept).collect()}
    clean = corpus_pipeline.decontamination(spark, once, SF).cache()
    judged = decontamination.decontaminate(once, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in judged if not r.contaminated}
    masked = corpus_pipeline.secrets(spark, clean, SF).cache()
    assert masked.columns == names and masked.count() == clean.count()
    found = {r.doc_id: r for r in secrets.secret_spans(masked).collect()}
    assert all(r.n_access == r.n_hex == 0 for r in found.values())
    packed = corpus_pipeline.packing(spark, masked, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in masked.collect()}
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    for t in (kept, once, clean, masked):
        t.unpersist()


def test_pipeline_stages_keep_awkward_rows(spark):
    table = docs(spark, awkward() + PLAIN)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        assert stage(spark, docs(spark, []), SF).collect() == []
        if stage is not corpus_pipeline.packing:
            assert out.columns == table.columns and dict(out.dtypes) == dict(table.dtypes)
        assert out.count() > 0
    once = corpus_pipeline.near_duplicates(spark, table, SF).collect()
    assert len({simhash.fingerprint(r.text) for r in once}) == len(once)
    points = np.array([simhash.fingerprint(r.text) for r in once], np.uint64)
    assert (np.bitwise_count(points[:, None] ^ points[None, :]) + 64 * np.eye(len(points), dtype=int) > 4).all()
