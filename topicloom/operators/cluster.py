"""K-means over unit TF-IDF vectors for many topics at once.

Documents are packed into blocks of about two thousand, each belonging to one topic, so
a hot topic is many blocks spread over the cluster and a small topic is one. Every pass
joins the blocks with their topic's centroids, assigns a block with one matrix product,
and adds up per-cluster sums before the shuffle. All restarts and all candidate numbers
of clusters advance together. Each iteration's centroids are staged, which keeps the
lineage short and lets Catalyst see how small they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.ranking import first_per_group, top_per_group
from topicloom.session import stage

MIN_K, MAX_K = 3, 6
RESTARTS = 10
SEED = 42
# A run ends after so many passes, or when its centroids move by no more, squared and added up, than this
# share of the topic's mean variance per term.
MAX_ITERATIONS = 300
TOLERANCE = 1e-4
BLOCK_DOCS = 2048
HELD_TOPICS = 32

BLOCK_COLUMNS = ["topic", "block", "ids", "idx", "w"]
PARTIAL = "topic string, run int, c int, n bigint, sse double, sums array<double>"
DRAWS = "topic string, restart int, key double, centroid array<double>"
MOMENTS = "topic string, n bigint, square double, sums array<double>"
LABELS = "topic string, post_id bigint, run int, cluster int, silhouette double"


def candidate_ks(n_docs: int) -> list[int]:
    """Numbers of clusters to try for a topic of ``n_docs`` documents (two or more)."""
    if n_docs <= MIN_K:
        return [n_docs]
    return [k for k in range(MIN_K, min(MAX_K, n_docs) + 1) if k < n_docs]


def blocks_of(posts: DataFrame, documents: DataFrame, sizes: DataFrame, key: str = "post_id") -> DataFrame:
    """(topic, block, n_docs, ids, idx, w): sparse documents as parallel arrays.

    ``posts``: topic, key; ``documents``: weighted documents of their term model. A
    document without vocabulary terms has one entry with ``idx`` -1. Topics of one
    document are left out.
    """
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n_docs") / BLOCK_DOCS))
    nothing = F.array(F.struct(F.lit(-1).alias("idx"), F.lit(0.0).alias("w")))
    heavy = F.transform(
        F.filter("items", lambda i: i["weight"] > 0), lambda i: F.struct(i["idx"].alias("idx"), i["weight"].alias("w"))
    )
    vectors = documents.select("topic", F.col(key).alias("id"), heavy.alias("v"))
    entries = F.transform(
        F.when(F.size("v") > 0, F.col("v")).otherwise(nothing),
        lambda x: F.struct(F.col("id").alias("id"), x["idx"].alias("idx"), x["w"].alias("w")),
    )
    return (
        posts.select("topic", F.col(key).cast("bigint").alias("id"))
        .join(sizes.where("n_docs > 1"), "topic")
        .join(vectors, ["topic", "id"], "left")
        .groupBy("topic", block.alias("block"), "n_docs")
        .agg(F.flatten(F.array_sort(F.collect_list(entries))).alias("e"))
        .select("topic", "block", "n_docs", F.col("e.id").alias("ids"), F.col("e.idx").alias("idx"), F.col("e.w").alias("w"))
    )


def width_of(blocks: DataFrame) -> int:
    """Length of the vectors: the terms of the largest vocabulary."""
    return 1 + max(0, blocks.agg(F.max(F.array_max("idx"))).first()[0] or 0)


def _matrix(ids, idx, w, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, idx, w = (np.asarray(a) for a in (ids, idx, w))
    unique, row = np.unique(ids, return_inverse=True)
    x = np.zeros((len(unique), width))
    seen = idx >= 0
    x[row[seen], idx[seen]] = w[seen]
    return unique, x


def _uniform(ids: np.ndarray, restart: int, step: int) -> np.ndarray:
    """A pseudo-random number between 0 and 1 per document, the same in every attempt of a task."""
    x = ids.astype(np.uint64) + np.uint64(((SEED * 1009 + restart) * 64 + step) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def _draw(step: int, restarts: int, width: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block and restart, the document with the smallest exponential key of rate equal to its weight. The least
    over all blocks is a draw over all documents of the topic in proportion to their weights: one, and
    from the second step on the squared distance to the nearest seed."""
    for frame in frames:
        rows = []
        for b in frame.itertuples(index=False):
            ids, x = _matrix(b.ids, b.idx, b.w, width)
            for restart in range(restarts):
                weight = np.ones(len(x))
                if step:
                    chosen = np.vstack([np.asarray(c) for r, c in zip(b.restarts, b.centroids) if r == restart])
                    gap = (x**2).sum(axis=1)[:, None] - 2.0 * (x @ chosen.T) + (chosen**2).sum(axis=1)[None, :]
                    weight = gap.min(axis=1)
                    weight[weight < 1e-12] = 0.0
                with np.errstate(divide="ignore"):
                    key = -np.log(_uniform(ids, restart, step)) / weight
                i = int(key.argmin())
                if np.isfinite(key[i]):
                    rows.append((b.topic, restart, float(key[i]), x[i]))
        yield pd.DataFrame(rows, columns=["topic", "restart", "key", "centroid"])


def _moments(width: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block: documents, sum of squares, vector sum."""
    for frame in frames:
        rows = []
        for b in frame.itertuples(index=False):
            _, x = _matrix(b.ids, b.idx, b.w, width)
            rows.append((b.topic, len(x), float((x**2).sum()), x.sum(axis=0)))
        yield pd.DataFrame(rows, columns=["topic", "n", "square", "sums"])


def variances(blocks: DataFrame, width: int) -> DataFrame:
    """(topic, variance): mean variance of a term's weight over the topic's documents."""
    sums = (
        blocks.select(*BLOCK_COLUMNS)
        .mapInPandas(partial(_moments, width), MOMENTS)
        .groupBy("topic")
        .agg(F.sum("n").alias("n"), F.sum("square").alias("square"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    )
    of_mean = F.aggregate("sums", F.lit(0.0), lambda acc, v: acc + v * v) / (F.col("n") * F.col("n"))
    return sums.select("topic", F.greatest((F.col("square") / F.col("n") - of_mean) / width, F.lit(0.0)).alias("variance"))


def _nearest(x: np.ndarray, centroids: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run numbers, winning row of ``centroids`` per run and document, squared distances)."""
    gap = np.ascontiguousarray((x @ centroids.T).T)  # a row per centroid, so that rows are compared as a whole
    gap *= -2.0
    gap += (centroids**2).sum(axis=1)[:, None]
    # equal at ten decimals: the first cluster, so that the order of a sum decides nothing
    compared = np.round(gap, 10)
    names = np.unique(runs)
    winner = np.empty((len(names), len(x)), dtype=np.int64)
    for j, run in enumerate(names):
        first, *others = np.flatnonzero(runs == run)
        winner[j], least = first, compared[first]
        for at in others:
            nearer = compared[at] < least
            winner[j][nearer] = at
            least = np.minimum(least, compared[at])
    distance = np.take_along_axis(gap, winner, axis=0) + (x**2).sum(axis=1)
    return names, winner, np.maximum(distance, 0.0)


def _model_of(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centroids = np.vstack([np.asarray(v) for v in b.centroids])
    return np.asarray(b.runs), np.asarray(b.cs), centroids


def _partials(width: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and topic: members, squared error and vector sum of every cluster."""
    held: dict[str, list] = {}

    def drain() -> pd.DataFrame:
        rows = [
            (topic, int(r), int(c), int(n), float(e), s)
            for topic, (runs, cs, ns, sse, sums) in held.items()
            for r, c, n, e, s in zip(runs, cs, ns, sse, sums)
            if n > 0
        ]
        held.clear()
        return pd.DataFrame(rows, columns=["topic", "run", "c", "n", "sse", "sums"])

    for frame in frames:
        for b in frame.itertuples(index=False):
            runs, cs, centroids = _model_of(b)
            _, x = _matrix(b.ids, b.idx, b.w, width)
            _, winner, distance = _nearest(x, centroids, runs)
            member = np.zeros((len(runs), len(x)))
            np.put_along_axis(member, winner, 1.0, axis=0)
            error = np.bincount(winner.ravel(), distance.ravel(), len(runs))
            if b.topic not in held:
                held[b.topic] = [runs, cs, np.zeros(len(runs)), np.zeros(len(runs)), np.zeros(centroids.shape)]
            total = held[b.topic]
            total[2] += np.bincount(winner.ravel(), minlength=len(runs))
            total[3] += error
            total[4] += member @ x
            if len(held) >= HELD_TOPICS:
                yield drain()
    if held:
        yield drain()


def _labels(width: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cluster and cosine silhouette of every document under every run of its topic.

    With unit vectors the mean distance to a cluster follows from the cluster's vector
    sum, so no pair of documents is compared.
    """
    for frame in frames:
        parts = []
        for b in frame.itertuples(index=False):
            runs, cs, centroids = _model_of(b)
            sums, ns = np.vstack([np.asarray(v) for v in b.sums]), np.asarray(b.ns, dtype=float)
            ids, x = _matrix(b.ids, b.idx, b.w, width)
            names, winner, _ = _nearest(x, centroids, runs)
            similarity = x @ sums.T
            square = (x**2).sum(axis=1)
            for j, run in enumerate(names):
                at = np.flatnonzero((runs == run) & (ns > 0))
                mine = winner[j]
                rows = np.arange(len(x))
                size = ns[mine]
                mean = 1.0 - similarity[:, at] / ns[at]
                mean[at[None, :] == mine[:, None]] = np.inf
                other = mean.min(axis=1)
                # A document is no distance from itself.
                own = (size - similarity[rows, mine] - (1.0 - square)) / np.maximum(size - 1.0, 1.0)
                widest = np.maximum(own, other)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where((size > 1) & (widest > 0), (other - own) / widest, 0.0)
                if len(at) < 2:
                    s = np.full(len(x), -1.0)
                parts.append(
                    pd.DataFrame({"topic": b.topic, "post_id": ids, "run": int(run), "cluster": cs[mine], "silhouette": s})
                )
        yield pd.concat(parts) if parts else pd.DataFrame(columns=["topic", "post_id", "run", "cluster", "silhouette"])


def _with_models(blocks: DataFrame, model: DataFrame, extra: list[str]) -> DataFrame:
    """Blocks joined with the (at most a few hundred) centroids of their topic."""
    fields = ["run", "c", "centroid", *extra]
    arrays = model.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("m"))
    columns = {"run": "runs", "c": "cs", "centroid": "centroids", "sums": "sums", "n": "ns"}
    split = arrays.select("topic", *[F.col(f"m.{f}").alias(columns[f]) for f in fields])
    return blocks.select(*BLOCK_COLUMNS).join(split, "topic")


def _totals(blocks: DataFrame, model: DataFrame, width: int) -> DataFrame:
    partials = _with_models(blocks, model, []).mapInPandas(partial(_partials, width), PARTIAL)
    return (
        partials.groupBy("topic", "run", "c")
        .agg(
            F.sum("n").alias("n"),
            F.sum("sse").alias("sse"),
            vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"),
        )
    )


def _moved(model: DataFrame, totals: DataFrame) -> DataFrame:
    """The next centroids; an empty cluster stays where it is. ``shift`` is the squared move."""
    mean: Column = F.when(F.col("n") > 0, F.transform("sums", lambda v: v / F.col("n"))).otherwise(F.col("centroid"))
    moved = model.select("topic", "run", "c", "centroid").join(totals, ["topic", "run", "c"], "left").withColumn("next", mean)
    shift = F.aggregate(
        F.zip_with("centroid", "next", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d
    )
    return moved.select("topic", "run", "c", F.col("next").alias("centroid"), shift.alias("shift"))


def start_centroids(blocks: DataFrame, width: int, restarts: int = RESTARTS) -> DataFrame:
    """k-means++ seeds of every run, drawn from all documents; a run is restart * 100 + k.

    One pass over the blocks draws the next seed of all restarts. The seeds of a smaller k are the first
    of the largest; where all documents are seeds already, the first ones are taken again.
    """
    sizes = blocks.groupBy("topic").agg(F.first("n_docs").alias("n_docs"))
    seeds = None
    for step in range(MAX_K):
        rows = blocks.select(*BLOCK_COLUMNS)
        if seeds is not None:
            held = seeds.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("restart", "c", "centroid"))).alias("s"))
            rows = rows.join(held, "topic").select(
                *BLOCK_COLUMNS, F.col("s.restart").alias("restarts"), F.col("s.centroid").alias("centroids")
            )
        drawn = rows.mapInPandas(partial(_draw, step, restarts, width), DRAWS).groupBy("topic", "restart")
        new = drawn.agg(F.min_by("centroid", "key").alias("centroid")).withColumn("c", F.lit(step))
        seeds = stage(new if seeds is None else seeds.unionByName(new), "seeds")
    n = F.col("n_docs").cast("int")
    ks = F.when(n <= MIN_K, F.array(n)).otherwise(F.sequence(F.lit(MIN_K), F.least(F.lit(MAX_K), n - 1)))
    wanted = sizes.withColumn("k", F.explode(ks)).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    found = seeds.groupBy("topic", "restart").agg(F.array_sort(F.collect_list(F.struct("c", "centroid"))).alias("s"))
    seed = F.element_at("s", (F.col("c") % F.size("s") + 1).cast("int"))["centroid"]
    return wanted.join(found, "topic").select(
        "topic", (F.col("restart") * 100 + F.col("k")).cast("int").alias("run"), "c", seed.alias("centroid")
    )


def given_centroids(documents: DataFrame, width: int, k: int, key: str = "post_id") -> DataFrame:
    """The first ``k`` documents of each topic that have a vector, as centroids of one run (numbered ``k``)."""
    first = top_per_group(documents.where(F.exists("items", lambda i: i["weight"] > 0)), ["topic"], [F.asc(key)], k, "c")
    weights = F.map_from_arrays("items.idx", "items.weight")
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(weights, i), F.lit(0.0)))
    return first.select("topic", F.lit(k).alias("run"), (F.col("c") - 1).cast("int").alias("c"), dense.alias("centroid"))


def fit(blocks: DataFrame, width: int, restarts: int = RESTARTS, max_iterations: int = MAX_ITERATIONS,
        tolerance: float = TOLERANCE, start: DataFrame | None = None) -> DataFrame:
    """(topic, run, c, centroid) of every run at its end. Runs that have ended take no further part, and blocks of a
    topic whose runs all have are not read again. ``start`` takes the place of drawn seeds; a negative ``tolerance``
    lets every run take all its passes."""
    bound = stage(variances(blocks, width), "variances")
    live = stage(start_centroids(blocks, width, restarts) if start is None else start, "centroids")
    ended = []
    for iteration in range(max_iterations):
        moved = _moved(live, _totals(blocks, live, width))
        moves = moved.groupBy("topic", "run").agg(F.sum("shift").alias("move")).join(bound, "topic")
        still = moves.select("topic", "run", (F.col("move") > tolerance * F.col("variance")).alias("live"))
        model = stage(moved.join(still, ["topic", "run"]).select("topic", "run", "c", "centroid", "live"), "centroids")
        last = iteration == max_iterations - 1
        ended.append((model if last else model.where("not live")).drop("live"))
        live = model.where("live").drop("live")
        if last or live.isEmpty():
            break
    result = ended[0]
    for more in ended[1:]:
        result = result.unionByName(more)
    return stage(result, "centroids")


def best_restarts(model: DataFrame, totals: DataFrame, width: int) -> DataFrame:
    """Per topic and k, the centroids of the restart with the least squared error."""
    errors = totals.groupBy("topic", "run").agg(F.sum("sse").alias("sse")).withColumn("k", F.col("run") % 100)
    winners = first_per_group(errors, ["topic", "k"], [F.asc(F.round("sse", 9)), F.asc("run")])
    return (
        model.select("topic", "run", "c", "centroid")
        .join(winners.select("topic", "run"), ["topic", "run"])
        .join(totals.select("topic", "run", "c", "n", "sums"), ["topic", "run", "c"], "left")
        .withColumn("sums", F.coalesce("sums", F.array_repeat(F.lit(0.0), width)))
        .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    )


def labelled(blocks: DataFrame, restarts: int = RESTARTS, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """(topic, post_id, run, cluster, silhouette) for the best restart of every k."""
    width = width_of(blocks)
    model = fit(blocks, width, restarts, max_iterations)
    totals = stage(_totals(blocks, model, width), "cluster-totals")
    best = stage(best_restarts(model, totals, width), "best-centroids")
    return _with_models(blocks, best, ["sums", "n"]).mapInPandas(partial(_labels, width), LABELS)


def silhouettes(labels: DataFrame) -> DataFrame:
    """(topic, k, silhouette)."""
    return labels.groupBy("topic", (F.col("run") % 100).alias("k")).agg(F.avg("silhouette").alias("silhouette"))


def choose_k(scores: DataFrame) -> DataFrame:
    """(topic, k): the first k of the best silhouette."""
    return first_per_group(scores, ["topic"], [F.desc(F.round("silhouette", 9)), F.asc("k")]).select("topic", "k")


def cluster_documents(posts: DataFrame, documents: DataFrame, sizes: DataFrame,
                      restarts: int = RESTARTS, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """(topic, post_id, cluster): the best clustering of each topic of two or more documents."""
    blocks = stage(blocks_of(posts, documents, sizes), "blocks")
    labels = stage(labelled(blocks, restarts, max_iterations), "labels")
    best = choose_k(silhouettes(labels))
    return (
        labels.withColumn("k", F.col("run") % 100).join(best, ["topic", "k"]).select("topic", "post_id", "cluster")
    )
