"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing column names."""

EXTRA = "score string, fp string, found int, label string, root int, part int, size string, `order` int, `__place` int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
LABELS = "doc_id long, quality int, toxic int, text string, label string, score double"
ITEMS = "item_id long, text string, found string, block int"
PAGES = "page_id long, url string, html string, digest string, payload string, first int"
VECTORS = "vec_id long, embedding array<float>, label int, score string, rank int, query_id string"

PLAIN = [f"The {a} river runs past {b} and {c} hills toward the quiet harbour of {a} every {b} morning" for a in
         ("old", "wide", "cold", "blue", "slow") for b in ("green", "stone", "tall", "low") for c in ("seven", "dark", "far")]
LONG = " ".join(f"word{i % 977} of {i % 13}" for i in range(60_000))


def docs(spark, texts, first=1):
    """Documents numbered from ``first``; a tuple in ``texts`` gives (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "s", "f", 1, "l", 2, 3, "z", 4, 5) for i, t in rows], DOCS)


def awkward():
    """Texts with nulls, repeats, a null id, and one long text."""
    return [None, "", "  \n\t ", "a", PLAIN[0], PLAIN[0], (5, PLAIN[0]), (5, PLAIN[0]), (None, PLAIN[1]), (None, None), LONG, "É\x00 ß 中文 🙂 x"]


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, "text", "label", 0.5) for i, q, t in rows], LABELS)


def items(spark, texts):
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "f", 1) for i, t in rows], ITEMS)
