"""Secret scans and multipart credentials, as DataFrame expressions only.

Three kinds of strong spans are found in whole texts: ``assign`` (a keyword, a sign and a value), ``access`` (access
identifiers) and ``hex`` (long hexadecimal runs). Each has a role: identifier or secret. Weak candidates are
``account`` (identifier), ``opaque`` (secret) and ``endpoint`` (a URL): by themselves they are common and harmless. An
identifier and a secret that lie in one scope, that is at most ``SCOPE`` code points apart, are a credential: a weak
part of either role is reported beside the other role. An endpoint is only further evidence and is reported beside both.
With ``weak_pairs`` (as in the query and the pipeline) the parts may all be weak; without it, one of the parts beside
a weak one must be strong. The parts of a text are joined with the scopes by interval inside the row, so no
row is shuffled and hot documents need no care. Weak candidates that overlap a strong span are dropped.

Positions are code points, ends exclusive. They follow from the lengths of what a pattern matches and of what lies
between, summed in runs of ``RUN`` so that a text with very many matches costs little more than one with few.

Defined results: a null text is empty: no spans. Rows that repeat a doc_id are scanned each. A null doc_id stays null.
An empty table gives no rows. Further columns are ignored, or kept by ``redacted``. Very long texts are
scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE, RUN = 400, 256

#: Patterns by kind, in the order of ties, with the group whose length is checked and the least length (fixed values).
STRONG = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # a run that is too short holds no run that is long enough
}
WEAK = {
    "endpoint": r"(?i:https?|ftp|jdbc:[a-z]{1,20}|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}",
    "account": r"""(?i:username|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "opaque": r"[A-Za-z0-9+/]{32,}={0,2}",
}
ROLES = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
KINDS = [*STRONG, *WEAK]
SPAN = "struct<start:int,end:int,kind:int>"
MASK = "[REDACTED]"


def _total(values: Column, start: Column, count: Column) -> Column:
    return F.aggregate(F.slice(values, start, count), F.lit(0), lambda a, x: a + x)


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the matches whose group has the least length; matches that fail still use up their text."""
    regex = F.lit(pattern)
    whole, between = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, pattern, -1)
    checked = F.regexp_extract_all(text, regex, F.lit(group))
    rows = F.transform(
        F.arrays_zip(whole.alias("whole"), checked.alias("checked"), F.slice(between, 1, F.size(whole)).alias("gap")),
        lambda m: F.struct(
            F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("size"), (F.length(m["checked"]) >= least).alias("ok")
        ),
    )

    def placed(m: Column) -> Column:
        steps = F.transform(m, lambda x: x["gap"] + x["size"])
        bases = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(m) - 1) / RUN).cast("int")),
            lambda run: _total(steps, F.lit(1), run * RUN),
        )
        spans = F.transform(
            m,
            lambda x, i: F.struct(
                (bases[F.floor(i / RUN).cast("int")] + _total(steps, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN) + x["gap"]).alias("start"),
                x["size"].alias("size"),
                x["ok"].alias("ok"),
            ),
        )
        return F.transform(
            F.filter(spans, lambda x: x["ok"]),
            lambda x: F.struct(
                x["start"].cast("int").alias("start"), (x["start"] + x["size"]).cast("int").alias("end"), F.lit(KINDS.index(kind)).alias("kind")
            ),
        )

    # ``let`` by a one-element array: the matches are found once
    found = F.transform(F.array(rows), placed)[0]
    return F.when(F.regexp(text, regex), found).otherwise(_none())


def _of_role(spans: Column, role: str) -> Column:
    numbers = [KINDS.index(k) for k in KINDS if ROLES[k] == role]
    return F.filter(spans, lambda s: s["kind"].isin(numbers))


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def _near(parts: Column, s: Column, below: int) -> Column:
    """Whether one of ``parts``, of a kind below ``below``, lies in the scope of ``s``."""
    return F.exists(parts, lambda p: (p["start"] <= s["end"] + SCOPE) & (p["end"] >= s["start"] - SCOPE) & (p["kind"] < below))


def scanned(docs: DataFrame, into: str, weak_pairs: bool = False) -> DataFrame:
    """``docs`` with two array columns of spans: ``into``_strong and ``into``_weak, each by start, then kind."""
    text, strong, weak = f"{into}_text", f"{into}_strong", f"{into}_weak"
    roles = {r: f"{into}_{r}" for r in ("identifier", "secret")}
    rows = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = [_spans(F.col(text), kind, *rule) for kind, rule in STRONG.items()]
    rows = rows.withColumn(strong, F.array_sort(F.concat(*found)))
    candidates = F.filter(
        F.concat(*[_spans(F.col(text), kind, pattern) for kind, pattern in WEAK.items()]),
        lambda w: ~F.exists(F.col(strong), lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])),
    )
    rows = rows.withColumn(weak, candidates if weak_pairs else F.when(F.size(strong) > 0, candidates).otherwise(_none()))
    rows = rows.withColumns({name: _of_role(F.concat(strong, weak), role) for role, name in roles.items()})
    every, sure = len(KINDS), len(KINDS) if weak_pairs else len(STRONG)

    def linked(w: Column) -> Column:
        identifier, secret = (lambda below, name=name: _near(F.col(name), w, below) for name in roles.values())
        both = (identifier(every) & secret(sure)) | (identifier(sure) & secret(every))
        own = {"identifier": secret(sure), "secret": identifier(sure), "endpoint": both}
        result = F.lit(False)
        for role, beside in own.items():
            result = result | (w["kind"].isin([KINDS.index(k) for k in WEAK if ROLES[k] == role]) & beside)
        return result

    pairs = (F.size(roles["identifier"]) > 0) & (F.size(roles["secret"]) > 0)
    kept = F.when(pairs, F.array_sort(F.filter(F.col(weak), linked))).otherwise(_none())
    return rows.withColumn(weak, kept).drop(text, *roles.values())


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, weak_pairs: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    rows = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "found", weak_pairs)
    strong = F.col("found_strong")
    counts = [_count(strong, k).alias(f"n_{k}") for k in STRONG]
    everything = F.array_sort(F.concat("found_strong", "found_weak"))
    return rows.select(
        "doc_id", *counts, F.sha2(written(strong).cast("binary"), 256).alias("base_sha256"), written(everything).alias("spans")
    )


def redacted(docs: DataFrame, weak_pairs: bool = False) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``MASK``; n_chars, if there is one, follows the text."""
    rows = scanned(docs, "__found", weak_pairs)
    spans = F.array_sort(F.concat("__found_strong", "__found_weak"))
    text = F.col("text")

    def step(done: Column, s: Column) -> Column:
        ahead = s["start"] >= done["at"]
        gap = text.substr(done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(ahead, F.concat(done["out"], gap, F.lit(MASK))).otherwise(done["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(spans, start, step, lambda done: F.concat(done["out"], text.substr(done["at"] + 1, F.length(text))))
    any_found = F.size(spans) > 0
    rows = rows.withColumn("text", F.when(any_found, masked).otherwise(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(any_found, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*[f"`{c}`" for c in docs.columns])
