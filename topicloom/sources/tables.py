"""The driver tables read as the engine's canonical inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.operators.ranking import ordered_list


class Tables:
    """Canonical inputs over one folder of parquet tables.

    Options leave out joins a query does not need, so they never reach the plan. Texts are read in
    the splits of their files; ``partitions``, or the setting ``spark.topicloom.text.partitions``, deals
    them to so many tasks instead, which pays where a few files hold them all.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, partitions: int | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.partitions = partitions or int(spark.conf.get("spark.topicloom.text.partitions", "0"))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def posts(self, urls: bool = True, engagement: bool = True) -> DataFrame:
        d = self.read("documents").select("doc_id", "text", "lang")
        if self.partitions:
            d = d.repartition(self.partitions, "doc_id")
        columns = [
            F.col("doc_id").alias("post_id"),
            F.col("lang").alias("topic"),
            F.concat(F.lit("q"), (F.col("doc_id") % 5).cast("string")).alias("query"),
            F.element_at(
                F.array(*[F.lit(s) for s in ("serpapi", "newsapi", "linkedin", "mock")]), (F.col("doc_id") % 4 + 1).cast("int")
            ).alias("source"),
            F.col("text").alias("content"),
        ]
        if urls:
            pages = self.read("pages").select("page_id", "url")
            d = d.join(pages, d.doc_id == pages.page_id, "left")
            columns.append(F.coalesce("url", F.lit("https://example.com")).alias("url"))
        if engagement:
            d = d.join(self.interactions(), d.doc_id == F.col("user_id"), "left")
            columns += [F.col("last_ts").alias("collected_at")]
            columns += [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("likes", "comments", "shares")]
        return d.select(*columns)

    def interactions(self) -> DataFrame:
        kinds = {"likes": "click", "comments": "view", "shares": "signup"}
        return (
            self.read("events")
            .groupBy("user_id")
            .agg(
                F.max("ts").alias("last_ts"),
                *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()],
            )
        )

    def api_usage(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        return self.read("events").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("logged_at"),
            F.col("event_type").alias("source"),
            F.when(k >= 80, 500).otherwise(200).alias("status_code"),
            F.col("value").alias("response_ms"),
            k.alias("record_count"),
        )

    def runs(self, counts: bool = True) -> DataFrame:
        o = self.read("orders")
        columns = [
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("topic-"), F.col("o_custkey").cast("string")).alias("topic"),
            F.col("o_orderdate").alias("captured_at"),
            F.col("o_totalprice").alias("elapsed_secs"),
        ]
        if counts:
            lines = self.read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
            o = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
            columns.append(F.coalesce("n", F.lit(0).cast("bigint")).alias("sources_count"))
        return o.select(*columns)

    def trend_rows(self) -> DataFrame:
        """One row per topic, snapshot and label, ranked by score; keywords from the words
        of part names."""
        words = F.array(F.get(F.split("p_name", " "), 0), F.get(F.split("p_name", " "), 1))
        trends = (
            self.read("part")
            .groupBy(
                F.col("p_brand").alias("topic"), (F.col("p_size") % 2).alias("snapshot"), F.col("p_type").alias("label")
            )
            .agg(
                (F.sum("p_size").cast("double") / 10).alias("score"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_set(words)))).alias("keywords"),
            )
        )
        order = Window.partitionBy("topic", "snapshot").orderBy(F.desc("score"), F.asc("label"))
        return trends.withColumn("trend_rank", F.row_number().over(order))

    def trend_runs(self) -> DataFrame:
        """One row per topic and snapshot with the ranked trends as an array."""
        item = F.struct("label", "keywords", "score")
        return self.trend_rows().groupBy("topic", "snapshot").agg(
            ordered_list(F.col("trend_rank"), item).alias("trends")
        )

    def trend_pairs(self) -> DataFrame:
        """Current (snapshot 1) and previous (snapshot 0) trends of each topic."""
        runs = self.trend_runs()
        current = runs.where("snapshot = 1").select("topic", "trends")
        previous = runs.where("snapshot = 0").select("topic", F.col("trends").alias("previous"))
        return current.join(previous, "topic", "left")

    def run_history(self) -> DataFrame:
        """Runs whose trends are one per line item: label, keywords and score."""
        lines = self.read("lineitem").select(
            "l_orderkey",
            F.col("l_linenumber").alias("n"),
            F.struct(
                F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("label"),
                F.array(
                    F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")),
                    F.concat(F.lit("d"), F.round(F.col("l_discount") * 100).cast("int").cast("string")),
                    F.concat(F.lit("f-"), F.col("l_returnflag")),
                ).alias("keywords"),
                (F.round(F.col("l_extendedprice")) / 1000).alias("score"),
            ).alias("trend"),
            "l_partkey",
        )
        order = F.struct("n", "l_partkey", "trend.label")
        trends = lines.groupBy("l_orderkey").agg(ordered_list(order, F.col("trend")).alias("trends"))
        runs = self.runs(counts=False)
        return runs.join(trends, runs.id == trends.l_orderkey).select("id", "topic", "captured_at", "trends")

    def timeline(self) -> DataFrame:
        """Weekly order counts per priority, as a share of the priority's best week."""
        weekly = (
            self.read("orders")
            .groupBy(F.col("o_orderpriority").alias("topic"), F.date_trunc("week", "o_orderdate").cast("date").alias("dt"))
            .agg(F.count("*").alias("n"))
        )
        best = F.max("n").over(Window.partitionBy("topic"))
        return weekly.select("topic", "dt", F.floor(F.lit(100.0) * F.col("n") / best).cast("int").alias("value"))

    def jobs(self) -> DataFrame:
        c, n = self.read("customer"), self.read("nation")
        key = F.col("c_custkey")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            key.alias("pos"),
            F.col("c_mktsegment").alias("topic"),
            F.col("c_name").alias("title"),
            F.concat(F.lit("company-"), (key % 37).cast("string")).alias("company"),
            F.when(key % 11 == 0, "").otherwise(F.col("n_name")).alias("location"),
            F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("band-"), (key % 10).cast("string"))).alias("salary"),
        )

    def topics(self) -> DataFrame:
        part, region = self.read("part"), self.read("region")
        parts = [
            part.select(F.col("p_name").alias("topic")),
            region.select(F.col("r_name")),
            region.select(F.concat("r_name", F.lit(" market"))),
            part.select(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" tools"))),
            region.select(F.lit("robotics")),
            region.select(F.lit(" AI   startups ")),
            part.select(F.concat(F.lit("future "), F.split_part("p_name", F.lit(" "), F.lit(1)))),
        ]
        union = parts[0]
        for p in parts[1:]:
            union = union.union(p)
        return union.distinct()
