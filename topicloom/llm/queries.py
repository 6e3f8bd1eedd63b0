"""One query per operator, over its whole table, and the comparison SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm.alignment import aligned
from topicloom.llm.common import table
from topicloom.llm.conversations import damage, repaired
from topicloom.llm.decontamination import decontaminate
from topicloom.llm.licences import licences
from topicloom.llm.neighbours import nearest
from topicloom.llm.packing import best_fit_packing
from topicloom.llm.quality import classify
from topicloom.llm.retrieval_packing import retrieval_packing
from topicloom.llm.secrets import secret_spans
from topicloom.llm.simhash import near_duplicates
from topicloom.llm.token_files import token_files
from topicloom.llm.toxicity import scores
from topicloom.llm.warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


WARC_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
    CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN f.first IS NULL OR f.first = p.page_id THEN NULL ELSE f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""


@query("op1_warc_dictionary", WARC_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = archived(table(spark, sf_dir, "pages"), least=100)
    return read_back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_subword_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query("op3_simhash_bk_trees")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), radius=4)


@query("op4_toxicity_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)
    return found.select("doc_id", "held_out", "score", "predicted")


DECONTAMINATION_SQL = """
WITH w AS (
    SELECT doc_id, regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM documents) t
), b AS (
    SELECT item_id, regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
    FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
        FROM benchmark) t
), s AS (
    SELECT item_id, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0
), i AS (
    SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, pos, pos + n - 1), ' ') AS grams
    FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS pos FROM s) t
), d AS (
    SELECT doc_id, pos, n, array_to_string(list_slice(ws, pos, pos + n - 1), ' ') AS grams
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS pos
        FROM w CROSS JOIN (SELECT DISTINCT n FROM s) k WHERE len(ws) >= n) t
), m AS (
    SELECT d.doc_id, d.pos, d.n, i.item_id FROM d JOIN i ON i.n = d.n AND i.grams = d.grams
), h AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit
    FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS pos FROM m) t GROUP BY doc_id
), c AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) t GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""


@query("op5_winnowing", DECONTAMINATION_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_multipart_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"), weak_pairs=True)


NEIGHBOURS_SQL = """
WITH v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
    SELECT q.vec_id AS query_id, c.vec_id, 
        sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op7_block_matrix_neighbours", NEIGHBOURS_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=10, modulus=100)


@query("op8_licence_paragraphs")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), capacity=4096, end_id=1)


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), end_id=2)


@query("op11_retrieval_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing(table(spark, sf_dir, "documents"), capacity=2048, end_id=1)


@query("op12_cross_tokenizer_spans")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))


#: The alignment as a recursion over rows: of each state of the grammar the cheapest repair so far, the least audit first.
CONVERSATION_SQL = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), summed AS (
    SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))), 4294967295) % 20 AS kind
    FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
    FROM summed WHERE kind <> 0
), placed AS (
    SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS place,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending FROM damaged
), judged AS (
    SELECT *, ending = '' AS blank, ending NOT IN ('.', '!', '?') AS cut,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM placed
), codes AS (
    SELECT *, blank OR seen AS forced, CASE WHEN NOT blank AND NOT seen AND cut THEN 1 ELSE 0 END AS trunc FROM judged
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (seen AND NOT blank) AS duplicate, sum(trunc) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
    FROM codes GROUP BY conv_id
), inserted AS (
    SELECT * FROM (VALUES ('', 0, ''), ('', 1, 'u'), ('', 2, 'a'), ('s', 0, 's'), ('s', 1, 'u'), ('s', 2, 'a'), ('u', 0, 'u'), ('u', 1, 'a'),
        ('a', 0, 'a'), ('a', 1, 'u')) t(state, k, upto)
), steps AS (
    SELECT conv_id, 0 AS place, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, [] :: VARCHAR[] AS turns FROM facts
    UNION ALL
    SELECT conv_id, place, state, best.cost, best.audit, best.turns FROM (
        SELECT conv_id, place, state, min({'cost': cost, 'audit': audit, 'turns': turns}) AS best FROM (
            SELECT p.conv_id, c.place, e.edit, c.role, c.text,
                CASE e.edit WHEN 'D' THEN i.upto WHEN 'K' THEN c.initial ELSE CASE WHEN i.upto = 'u' THEN 'a' ELSE 'u' END END AS state,
                p.cost + 2 * i.k + CASE e.edit WHEN 'D' THEN 3 WHEN 'K' THEN c.trunc ELSE 2 + c.trunc END AS cost,
                p.audit || repeat('I', i.k) || e.edit AS audit,
                list_concat(list_concat(p.turns, list_slice(CASE WHEN p.state = 'u' THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END, 1, i.k)),
                    CASE e.edit WHEN 'D' THEN [] :: VARCHAR[] WHEN 'K' THEN [c.role || ':' || c.text]
                    ELSE [CASE WHEN i.upto = 'u' THEN 'assistant:' ELSE 'user:' END || c.text] END) AS turns
            FROM steps p JOIN inserted i ON i.state = p.state JOIN codes c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.place = p.place + 1
                JOIN (VALUES ('D'), ('K'), ('R')) e(edit) ON e.edit = 'D' OR NOT c.forced AND (e.edit = 'R'
                    OR i.upto || c.initial IN ('s', 'u', 'su', 'ua', 'au'))
        ) t GROUP BY conv_id, place, state
    ) t
), ended AS (
    SELECT f.conv_id, min({'cost': cost + CASE state WHEN 'u' THEN 2 WHEN 's' THEN 4 ELSE 0 END,
        'audit': audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END,
        'turns': list_concat(turns, CASE state WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE [] :: VARCHAR[] END)}) AS best
    FROM facts f JOIN steps p ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.place = f.n GROUP BY f.conv_id
), ids AS (
    SELECT DISTINCT conv_id FROM conversations
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
    coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
FROM ids i LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""


@query("op13_turn_alignment", CONVERSATION_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damage(table(spark, sf_dir, "conversations")))
