import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import cluster, evolution, similarity
from topicloom.session import stage


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("seed", [1, 2])
def test_consistency_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    sets = {t: [frozenset(rng.sample("abcdefghij", rng.randrange(0, 9))) for _ in range(40)] for t in "xy"}
    sets["x"] += [frozenset("abc")] * 60  # one hot group of copies
    sets["z"] = [frozenset("ab")]
    rows = [(t, sorted(s)) for t, ss in sets.items() for s in ss]
    df = spark.createDataFrame(rows, "topic string, keywords array<string>")
    got = {r.topic: r.consistency for r in similarity.consistency(df).collect()}
    for t, ss in sets.items():
        pairs = [jaccard(a, b) for a, b in itertools.combinations([s for s in ss if s], 2)]
        assert abs(got[t] - (sum(pairs) / len(pairs) if pairs else 0.0)) < 1e-12


@pytest.mark.parametrize("block", [512, 7])
def test_consistency_of_sets_of_any_size(spark, block, monkeypatch):
    """Small and large sets, copies of both, one keyword in nearly all sets."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(block)
    names = [f"k{i:02d}" for i in range(60)]
    sets = {t: [frozenset(rng.sample(names, rng.choice([1, 3, 8, 9, 13, 30])) + ["k00"] * (rng.random() < 0.8)) for _ in range(50)] for t in "xy"}
    sets["x"] += [sets["x"][0]] * 9 + [frozenset(names[:30])] * 5
    sets["w"] = [frozenset(names[:30])] * 2
    sets["v"] = [frozenset(names[:3])] * 2
    df = spark.createDataFrame([(t, sorted(s)) for t, ss in sets.items() for s in ss], "topic string, keywords array<string>")
    got = {r.topic: r.consistency for r in similarity.consistency(df).collect()}
    for t, ss in sets.items():
        pairs = [jaccard(a, b) for a, b in itertools.combinations(ss, 2)]
        assert abs(got[t] - sum(pairs) / len(pairs)) < 1e-12


def run_frame(spark, rows):
    t = "array<struct<label:string,keywords:array<string>,score:double>>"
    return spark.createDataFrame(rows, f"topic string, trends {t}, previous {t}")


def evolve(spark, trends, previous):
    rows = evolution.score_opportunities(evolution.trend_evolution(run_frame(spark, [("t", trends, previous)])))
    return rows.first()


def test_evolution_edges(spark):
    previous = [("p", ["a", "b", "c", "d", "e"], 10.0), ("q", ["x"], 0.0), ("r", ["x"], 5.0)]
    now = [
        ("fifth", ["a"], 11.0),       # overlap exactly 0.2, +10%: stable
        ("tied", ["x"], 3.0),         # first of equals: previous score 0
        ("none", ["zz"], 4.0),
        ("empty", [], 0.0),
    ]
    e = {x.trend: x for x in evolve(spark, now, previous).evolution}
    assert (e["fifth"].status, e["fifth"].change) == ("stable", "+10%")
    assert (e["tied"].previous_score, e["tied"].change, e["tied"].status) == (0.0, "+100%", "rising")
    assert (e["none"].status, e["none"].change) == ("new", "+100%")
    assert (e["empty"].status, e["empty"].change) == ("new", "+0%")


def test_rounded_change_is_half_even_and_feeds_growth(spark):
    r = evolve(spark, [("a", ["k"], 112.5), ("b", ["m"], 99.7)], [("a", ["k"], 100.0), ("b", ["m"], 100.0)])
    assert [x.change for x in r.evolution] == ["+12%", "-0%"]
    assert [(o.trend, o.opportunity_score) for o in r.opportunities] == [("a", 10.0), ("b", 7.91)]


def test_opportunities(spark):
    one = evolve(spark, [("only", ["k"], 2.0)], None).opportunities
    assert [(o.opportunity_score, o.reason) for o in one] == [(10.0, "high growth + low competition")]
    zero = evolve(spark, [("a", ["k"], 0.0)], None).opportunities
    assert zero[0].opportunity_score == 0.0
    same = evolve(spark, [("a", ["k"], 5.0), ("a", ["k"], 1.0)], [("a", ["k"], 4.0)])
    # A repeated label takes its last evolution row: falling by 75%, floored at one half.
    assert [o.opportunity_score for o in same.opportunities] == [10.0, 2.0]


def test_previous_snapshot_equals_plain_lag(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"t{i % 7}", f"20{rng.randrange(10, 14)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, topic string, d string").select("id", "topic", F.to_timestamp_ntz("d").alias("captured_at"), F.col("id").alias("trends"))
    got = {r.id: r.previous for r in evolution.previous_snapshot(df).collect()}
    by_topic = {}
    for i, topic, d in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == by_topic.get(topic)
        by_topic[topic] = i


def test_candidate_ks():
    assert [cluster.candidate_ks(n) for n in (2, 3, 4, 5, 6, 7, 50)] == [[2], [3], [3], [3, 4], [3, 4, 5], [3, 4, 5, 6], [3, 4, 5, 6]]


def unit(v):
    v = np.asarray(v, dtype=float)
    return v / np.linalg.norm(v)


def test_clusters_and_silhouette(spark):
    """Four separated groups over many blocks; silhouettes against all pairs."""
    rng = np.random.default_rng(0)
    vectors = {i: unit(np.eye(8)[2 * (i % 4)] + 0.15 * rng.random(8)) for i in range(80)}
    vectors[80] = np.zeros(8)
    rows = []
    for i, v in vectors.items():
        at = np.flatnonzero(v)
        rows.append(("t", i % 5, len(vectors), [i] * max(len(at), 1), [int(x) for x in at] or [-1], [float(v[x]) for x in at] or [0.0]))
    flat = spark.createDataFrame(rows, "topic string, block long, n_docs long, ids array<long>, idx array<int>, w array<double>")
    blocks = stage(
        flat.groupBy("topic", "block", "n_docs").agg(
            F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("idx")).alias("idx"), F.flatten(F.collect_list("w")).alias("w")
        ),
        "blocks",
    )
    labels = stage(cluster.labelled(blocks, restarts=4), "labels")
    best = cluster.choose_k(cluster.silhouettes(labels)).first()
    assert best.k in (4, 5)  # the empty document may stand alone
    rows = labels.where("run % 100 = 4").collect()
    assert len(rows) == len(vectors)
    groups = {r.post_id: r.cluster for r in rows}
    assert len({groups[i] for i in range(4)}) == 4
    assert all(groups[i] == groups[i % 4] for i in range(80))
    for r in rows:
        distances = {}
        for j, v in vectors.items():
            if j != r.post_id:
                distances.setdefault(groups[j], []).append(1 - float(v @ vectors[r.post_id]))
        own = np.mean(distances.pop(r.cluster))
        other = min(np.mean(d) for d in distances.values())
        assert abs(r.silhouette - (other - own) / max(own, other)) < 1e-9


def test_seeds_come_from_all_documents(spark):
    """A few documents far from 3,000 others are found as a cluster; vectors are as wide as the vocabulary."""
    rng = np.random.default_rng(3)
    rows, width = [], 400
    for block in range(10):
        ids, idx, w = [], [], []
        for i in range(block * 300, block * 300 + 300):
            rare = i % 1000 == 7
            v = unit(np.array([1.0, 0.1 * rng.random()])) if not rare else np.array([1.0, 0.0])
            at = [i % 3, 3 + i % 5] if not rare else [width - 1]
            ids += [i] * len(at)
            idx += at
            w += [float(x) for x in v[: len(at)]]
        rows.append(("t", block, 3000, ids, idx, w))
    blocks = stage(spark.createDataFrame(rows, "topic string, block long, n_docs long, ids array<long>, idx array<int>, w array<double>"), "blocks")
    assert cluster.width_of(blocks) == width
    labels = cluster.labelled(blocks, restarts=4).where("run % 100 = 4").collect()
    assert len(labels) == 3000
    rare = {r.cluster for r in labels if r.post_id % 1000 == 7}
    assert len(rare) == 1 and all(r.cluster not in rare for r in labels if r.post_id % 1000 != 7)


def test_nearest_rows_lie_together():
    """Centroids of all runs are compared row by row; equal at ten decimals, the first of a run wins."""
    rng = np.random.default_rng(5)
    x, centroids = rng.random((40, 6)), rng.random((9, 6))
    centroids[4] = centroids[3] + 1e-13
    centroids[8] = np.nan
    runs = np.array([203, 3, 203, 3, 3, 104, 104, 104, 7])
    names, winner, distance = cluster._nearest(x, centroids, runs)
    assert names.tolist() == [3, 7, 104, 203] and winner.shape == distance.shape == (4, 40)
    for j, run in enumerate(names):
        at = np.flatnonzero(runs == run)
        gaps = ((x[:, None, :] - centroids[at][None]) ** 2).sum(axis=2)
        assert winner[j].tolist() == at[np.round(gaps, 10).argmin(axis=1)].tolist()
        assert np.allclose(distance[j], gaps.min(axis=1), equal_nan=True)
    assert cluster._nearest(np.zeros((0, 6)), centroids[:4], runs[:4])[1].shape == (2, 0)
