"""What one pass over a text gives, and what the analysis shuffles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from topicloom.functions import patterns
from topicloom.functions import wordlists as w
from topicloom.functions.sentiment import scanned_sentiment, sentiment
from topicloom.functions.text import counted_words
from topicloom.plans import analysis


def texts():
    rng = random.Random(13)
    words = [*w.POSITIVE_LEXICON, *w.NEGATIVE_LEXICON, *w.NEGATORS, *w.INTENSIFIERS]
    words += ["plain", "mislaid offer", "job", "losses", "laid", "shut downstream", "Regrowth", "9top", "'win-'", "éwin", "-top9x", "é", "7", "WIN"] * 6
    gaps = [" ", " ", " ", "  ", "\n", ", ", "é", "-", "'", " ", "\U0001f600"]
    found = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(20))) for _ in range(1500)]
    return [*found, None, "", " ", "-", "é"]


def test_scanned_sentiment_equals_the_column(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "text string")
    rows = df.select("text", sentiment(F.col("text")).alias("a"), scanned_sentiment(F.col("text")).alias("b"))
    assert rows.schema["a"].dataType == rows.schema["b"].dataType
    for r in rows.collect():
        assert r.a == r.b, r.text


def test_words_and_occurrences_of_one_pass(spark, monkeypatch):
    terms = ["top", "win ", "é", "top"]
    df = spark.createDataFrame([(t, terms) for t in texts()] + [("a b", None)], "text string, terms array<string>")
    rows = df.select("text", "terms", F.size(counted_words(F.col("text"))).alias("n"), patterns.text_counts(F.lower("text"), F.col("terms")).alias("c")).collect()
    for r in rows:
        if r.text is None or r.terms is None:
            assert r.c is None
        else:
            assert (r.c.words, r.c["counts"]) == (r.n, [r.text.lower().count(t) for t in terms]), r.text


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_words_are_counted_in_parts(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(patterns, "PART_BYTES", size)
    low = pa.array([t.lower() if t else t for t in texts()]).slice(3)
    ranges = list(patterns.parts_of(low))
    assert [r[0] for r in ranges] + [len(low)] == [0] + [r[1] for r in ranges]
    got = [n for lo, hi in ranges for n in patterns.counted_words_of(low.slice(lo, hi - lo)).tolist()]
    assert got == [len(re.findall(r"[a-z0-9\-]+", t or "")) for t in low.to_pylist()]


def test_texts_are_not_shuffled_for_the_documents(spark, monkeypatch):
    """Documents were joined with their keywords before their texts had been read for sentiment and preview."""
    plans, keep = {}, analysis.stage

    def stage(df, name):
        plans[name] = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return keep(df, name)

    monkeypatch.setattr(analysis, "stage", stage)
    rows = [(i, "a", "mock", f"solar wind power{i} success", f"https://x/{i}", 0, 0, 0) for i in range(6)]
    posts = spark.createDataFrame(rows, "post_id long, topic string, source string, content string, url string, likes int, comments int, shares int")
    posts = posts.withColumn("collected_at", F.lit(None).cast("timestamp"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        documents = analysis.process(posts, analysis.column_clusters("source")).documents
        exchanges = [x for x in plans["documents"].split("\n\n") if re.match(r"\s*\(\d+\) Exchange", x)]
        assert exchanges and not any("content#" in x for x in exchanges)
        assert {r.sentiment.label for r in documents.collect()} == {"positive"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
