import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from topicloom.functions.labels import clean_label, cluster_label, is_low_signal
from topicloom.functions.text import term_tokens
from topicloom.functions.wordlists import stop_words
from topicloom.operators import engagement, terms
from topicloom.session import stage

TOKEN = re.compile(r"(?u)\b[a-zA-Z][a-zA-Z0-9\-]{2,}\b")
ODD = ["9-abc foo-é foo- -bar foo--bar a_bc under_score x1y2 café naïve", "foo foo foo", "state-of-the-art now", "ünder bar.baz"]


def corpus():
    rng = random.Random(3)
    words = "alpha beta gamma delta the and state-of-art data robots robots arm-x 2024 é été new café".split()
    gaps = [" ", " ", " ", "  ", ", ", ". ", "-", "\n"]
    docs = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    return [(i, f"t{i % 3}", d) for i, d in enumerate(docs + ODD * 3)]


def frame(spark):
    return spark.createDataFrame(corpus(), "post_id long, topic string, content string")


def test_tokens_equal_python(spark):
    for r in frame(spark).select("content", term_tokens(F.col("content")).alias("t")).collect():
        assert r.t == TOKEN.findall(r.content.lower()), r.content


def brute():
    """Counts, literal counts and unit weights straight from the definition."""
    stops = set(stop_words())
    by_topic = defaultdict(dict)
    for i, topic, text in corpus():
        kept = [t for t in TOKEN.findall(text.lower()) if t not in stops]
        by_topic[topic][i] = (text.lower(), Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]))
    rows = {}
    for topic, docs in by_topic.items():
        total = sum((c for _, c in docs.values()), Counter())
        vocab = [t for t, _ in sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[:250]]
        df = {t: sum(1 for _, c in docs.values() if c[t]) for t in vocab}
        for i, (text, c) in docs.items():
            raw = {t: c[t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in vocab}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            for t in vocab:
                literal = len(re.findall(rf"\b{re.escape(t)}\b", text))
                if c[t] or literal:
                    rows[topic, i, t] = (c[t], literal, raw[t] / norm if norm else 0.0)
    return rows


def test_counts_and_weights_equal_brute_force(spark):
    model = terms.TermModel(frame(spark))
    got = {(r.topic, r.post_id, r.term): (r.tf, r.literal, r.weight) for r in model.weights().collect()}
    want = brute()
    assert got.keys() == want.keys()
    for k, (tf, literal, weight) in want.items():
        assert got[k][:2] == (tf, literal), k
        assert abs(got[k][2] - weight) < 1e-9


def test_document_keywords_rank_before_filter(spark):
    model = terms.TermModel(frame(spark))
    heavy = defaultdict(list)
    for (topic, i, t), (_, _, weight) in brute().items():
        if weight > 0:
            heavy[topic, i].append((-round(weight, 10), t))
    got = {(r.topic, r.post_id): r.keywords for r in model.document_keywords().collect()}
    low = {"data", "new"}
    for key, items in heavy.items():
        top = [t for _, t in sorted(items)[:8]]
        want = [t for t in top if not low & set(t.split())]
        assert got.get(key, []) == want


def test_empty_vocabulary_gives_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "!! ?? 12"), (2, "a", "it is")], "post_id long, topic string, content string")
    model = terms.TermModel(df)
    assert model.weights().count() == 0 and model.keywords().count() == 0
    assert engagement.score_posts(
        df.select("*", *[F.lit(v).alias(n) for n, v in (("source", "x"), ("url", "u"), ("likes", 0), ("comments", 0), ("shares", 0))]),
        model.keywords(),
    ).count() == 2


def test_labels(spark):
    df = spark.createDataFrame([("new era",), ("ai",), ("the and",), ("solid state",), ("123",), ("ab cde",)], "term string")
    low = {r.term: r.low for r in df.select("term", is_low_signal("term").alias("low")).collect()}
    assert low == {"new era": True, "ai": True, "the and": True, "solid state": False, "123": True, "ab cde": True}
    lists = spark.createDataFrame(
        [(["nlp market growth", "growth rate", "solar power grid", "wind"],), (["market"],), ([],)], "keywords array<string>"
    )
    got = [r.l for r in lists.select(cluster_label("keywords").alias("l")).collect()]
    assert got == ["NLP Growth Rate Solar", "Emerging Topic", "Emerging Topic"]
    assert df.select(clean_label("term").alias("l")).collect()[3].l == "solid state"


def scores(spark, rows):
    df = spark.createDataFrame(rows, "topic string, post_id long, raw_score double")
    return {r.post_id: r.engagement_score for r in engagement.scale_scores(stage(df, "scores")).collect()}


def test_scaling(spark):
    assert scores(spark, [("a", 1, 3.0)]) == {1: 100.0}
    assert scores(spark, [("a", 1, 0.0), ("a", 2, 0.0)]) == {1: 0.0, 2: 0.0}
    assert scores(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 4.0)]) == {1: 0.0, 2: 33.33, 3: 100.0}


def test_gate_spares_linkedin_with_interactions(spark):
    df = spark.createDataFrame(
        [("linkedin", 0.0, 1), ("linkedin", 0.0, 0), ("mock", 4.99, 5), ("mock", 5.0, 0)], "source string, engagement_score double, likes int"
    ).select("*", F.lit(0).alias("comments"), F.lit(0).alias("shares"))
    kept = [(r.source, r.engagement_score) for r in df.where(engagement.passes_gate()).collect()]
    assert kept == [("linkedin", 0.0), ("mock", 5.0)]


def test_automaton_counts_like_one_term_at_a_time():
    from topicloom.functions.patterns import Automaton

    rng = random.Random(9)
    listed = ["aa", "a", "aab", "a-", "a a", "ab-a", "b", "a-a", "aa", "", "é", "-a", "ba b", "a_"]
    one = Automaton(listed)
    for _ in range(3000):
        text = "".join(rng.choice("aab- é_") for _ in range(rng.randrange(30)))
        assert one.occurrences(text) == [text.count(t) if t else 0 for t in listed]
        boundary = {t: r"(?=\w)" if t.endswith("-") else r"(?!\w)" for t in listed}
        assert one.whole_words(text) == [len(re.findall(rf"(?<!\w){re.escape(t)}{boundary[t]}", text)) if t else 0 for t in listed]
        tokens = text.replace("-", " ").split()
        pairs = Counter(tokens + [f"{x} {y}" for x, y in zip(tokens, tokens[1:])])
        assert one.token_counts(tokens) == {i: pairs[t] for i, t in enumerate(listed) if t and pairs[t] and listed.index(t) == i}


def test_keyword_counts_in_one_pass(spark):
    rows = [("Solar solar-panel aaaa", ["solar", "panel", "aa", "solar"]), (None, ["x"]), ("text", []), ("", ["x"])]
    df = spark.createDataFrame(rows, "text string, terms array<string>")
    from topicloom.functions.patterns import occurrence_counts

    got = [r.c for r in df.select(occurrence_counts(F.lower("text"), F.col("terms")).alias("c")).collect()]
    assert got == [[2, 1, 2, 2], None, [], [0]]


def tied_corpus():
    """Topics whose 250th term is tied: with few words behind it, with more than the list holds, and with words that occur once."""
    rng = random.Random(5)
    few = [f"w{i:03d}x" for i in range(300)]
    many = [f"v{i:04d}x" for i in range(1200)]
    rows = [("few", " ".join(rng.choice(few[:260]) for _ in range(90))) for _ in range(12)] + [("few", " ".join(few[::-1]))]
    rows += [("many", " ".join(many[i : i + 2] * 3)) for i in range(0, 1200, 2)]
    rows += [("many", "zz-top aaa-bar " * 5)] + [("once", " ".join(many[::-1])), (None, "solar wind solar wind"), ("none", None)]
    return [(i, t, c) for i, (t, c) in enumerate(rows)]


def test_vocabulary_with_ties_equals_brute_force(spark):
    want = defaultdict(Counter)
    for _, topic, text in tied_corpus():
        kept = [t for t in TOKEN.findall(text or "") if t not in set(stop_words())]
        want[topic] += Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])])
    df = spark.createDataFrame(tied_corpus(), "post_id long, topic string, content string")
    for most in (250, 40):
        got = defaultdict(dict)
        for r in terms.vocabulary(df, most).collect():
            got[r.topic][r.idx] = (r.term, r.total)
        best = {k: sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:most] for k, c in want.items() if c}
        assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == best
    assert any(" " in t for t, _ in best["many"])


def test_counts_run_python_once(spark):
    """A filter on what Python counts was planned with a second run of the Python code."""
    posts = frame(spark)
    counts = terms.document_counts(posts, stage(terms.vocabulary(posts), "vocabulary"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") + plan.count("MapInArrow") == 1


def test_parts_of_counts_are_passed_on_before_they_grow(monkeypatch):
    import pyarrow as pa

    from topicloom.functions import patterns

    monkeypatch.setattr(patterns, "HELD_COUNTS", 10)
    texts = [" ".join(f"word{i}x{j}" for j in range(6)) for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"topic": ["a"] * 50, "low": texts})
    parts = list(patterns.token_totals(["word0x0"])(iter([batch, batch])))
    assert max(p.num_rows for p in parts) <= 15
    total = Counter()
    for p in parts:
        for r in p.to_pylist():
            total[r["term"]] += r["total"]
    assert total == Counter({w: 2 for t in texts for w in t.split() if w != "word0x0"})


def test_plain_terms_are_counted_from_tokens():
    from topicloom.functions.patterns import Automaton, Vocabulary, tokens_of

    rng = random.Random(11)
    stops = frozenset(["the", "top-up"])
    listed = ["aab", "aba", "the", "aab aba", "aab-aba", "aab-", "aab", "", "ab", "\u00e9ab", "aab\u00e9", "top", "top-up", "up aab", "aab the"]
    one, whole = Vocabulary(listed, stops), Automaton(listed)
    assert set(one.rest.number) == {"the", "aab aba", "aab-aba", "aab-", "ab", "\u00e9ab", "aab\u00e9", "top-up", "up aab", "aab the"}
    parts = ["aab", "aba", "the", "ab", "top", "up", "\u00e9", "_", "7", "-", "-", " ", " ", "\u00a0", "\u2028", "\x1f", ".", "\u0301"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        tokens = [t for t in re.findall(r"\b[a-z][a-z0-9\-]{2,}\b", text) if t not in stops]
        assert tokens_of(text, stops) == tokens
        assert one.counts(text, tokens) == (whole.token_counts(tokens), {i: n for i, n in enumerate(whole.whole_words(text)) if n})
