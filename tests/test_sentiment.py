import random
import re

from pyspark.sql import functions as F

from topicloom.functions import wordlists as w
from topicloom.functions.sentiment import sentiment
from topicloom.operators.sentiments import sentiment_by_source, sentiment_summary, summary_or_neutral, with_sentiment

KNOWN = [
    ("", 0, 0, 0.0, "neutral"),
    (None, 0, 0, 0.0, "neutral"),
    ("the weather is mild", 0, 0, 0.0, "neutral"),
    ("record growth and strong profit", 5, 0, 1.0, "positive"),
    ("the company announced layoffs", 0, 3, -1.0, "negative"),
    ("not success", 2, 0, 1.0, "positive"),
    ("not a success", 0, 2, -1.0, "negative"),
    ("was very highly rated success", 4, 0, 1.0, "positive"),
    ("cutting-edge", 2, 1, 0.333, "positive"),
    ("staff were laid off in a crisis", 0, 6, -1.0, "negative"),
    ("growth loss", 2, 2, 0.0, "neutral"),
    ("failed launch", 1, 2, -0.333, "negative"),
]


def test_known_rows(spark):
    df = spark.createDataFrame(KNOWN, "text string, positive long, negative long, score double, label string")
    got = df.select("*", sentiment(F.col("text")).alias("s")).collect()
    for r in got:
        assert (r.s.positive, r.s.negative, r.s.score, r.s.label) == (r.positive, r.negative, r.score, r.label), r.text


def sequential(text):
    """Walks the tokens one by one."""
    tokens = re.findall(r"[a-z][a-z0-9\-']*", text.lower())

    def first(entries, s):
        return next((v for k, v in entries.items() if k in s), 0)

    pos = neg = at = 0
    while at < len(tokens):
        both = " ".join(tokens[at : at + 2]) if at + 1 < len(tokens) else ""
        before = set(tokens[max(0, at - 2) : at])
        step, p, n = 1, first(w.POSITIVE_LEXICON, tokens[at]), first(w.NEGATIVE_LEXICON, tokens[at])
        if both:
            bp, bn = first(w.POSITIVE_LEXICON, both), first(w.NEGATIVE_LEXICON, both)
            if bp or bn:
                step, p, n = 2, bp, bn
        factor = 2 if before & set(w.INTENSIFIERS) else 1
        if before & set(w.NEGATORS):
            p, n = n, p
        pos, neg, at = pos + p * factor, neg + n * factor, at + step
    return pos, neg


def test_equals_a_sequential_walk(spark):
    rng = random.Random(7)
    words = list(w.POSITIVE_LEXICON) + list(w.NEGATIVE_LEXICON) + w.NEGATORS + w.INTENSIFIERS
    words += ["plain", "mislaid offer", "job losses", "shut downstream", "Regrowth", "topped", "a", "x-y", "it's"] * 6
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", sentiment(F.col("text")).alias("s")).collect():
        assert (r.s.positive, r.s.negative) == sequential(r.text), r.text


def test_summaries(spark):
    rows = [("a", "x", "success"), ("a", "x", "crisis"), ("a", "y", "plain"), ("a", "y", "win win")]
    df = with_sentiment(spark.createDataFrame(rows, "topic string, source string, content string"))
    one = sentiment_summary(df, ["topic"]).first()
    assert (one["count"], one.positive_pct, one.negative_pct, one.neutral_pct) == (4, 50.0, 25.0, 25.0)
    assert (one.overall_score, one.overall_label) == (0.25, "positive")
    by = {r.source: r["count"] for r in sentiment_by_source(df).collect()}
    assert by == {"(all)": 4, "x": 2, "y": 2}
    topics = spark.createDataFrame([("a",), ("b",)], "topic string")
    empty = {r.topic: r for r in summary_or_neutral(topics, sentiment_summary(df, ["topic"])).collect()}["b"]
    assert (empty.overall_label, empty.neutral_pct, empty["count"]) == ("neutral", 100.0, 0)
