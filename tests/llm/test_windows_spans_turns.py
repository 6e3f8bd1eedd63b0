"""Retrieval packing, tokenizer alignment and conversation repair, beside brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.data import PLAIN, awkward, docs
from topicloom.llm import alignment, conversations, retrieval_packing
from topicloom.llm.tokens import default_path

# ---- retrieval packing ----


def _ids(rows):
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(default_path())
    return [np.array([*one.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in rows]


def _check_packed(rows, table, capacity):
    """Every id in one piece, sequences without gaps, nothing padded."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    want = Counter()
    for r, ids in zip(table, _ids(table), strict=True):
        want[r.doc_id] += len(ids)
    assert {k: sum(r.length for r in v) for k, v in by_doc.items()} == want
    for ids, doc_id in ((i, r.doc_id) for r, i in zip(table, _ids(table), strict=True)):
        own = [r for r in by_doc[doc_id] if r.doc_tokens == len(ids)]
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32
        copies = sum(r.length for r in own) // len(ids)
        covered = Counter(i for r in own for i in range(r.start, r.start + r.length))
        assert len(covered) == len(ids) and set(covered.values()) == {copies}
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
        lengths.append(at)
    return lengths


def test_retrieval_packing_keeps_every_id_without_padding(spark):
    table = docs(spark, [t for t in awkward() if not isinstance(t, tuple) or t[0] is not None] + PLAIN)
    for capacity in (64, 2048):
        _check_packed(retrieval_packing.retrieval_packing(table, capacity).collect(), table.collect(), capacity)
    nulls = docs(spark, [(None, None), (None, PLAIN[0])])
    assert sum(r.length for r in retrieval_packing.retrieval_packing(nulls).collect()) == sum(map(len, _ids(nulls.collect())))
    assert retrieval_packing.retrieval_packing(docs(spark, [])).collect() == []


def test_shards_are_bounded_also_for_copies(spark, monkeypatch):
    monkeypatch.setattr(retrieval_packing, "SHARD", 1 << 13)
    table = docs(spark, [(7, PLAIN[0])] * 300 + PLAIN)
    rows = retrieval_packing.retrieval_packing(table, 64).collect()
    shards = Counter(r.sequence_id >> 32 for r in rows if r.offset >= 0)
    assert len(shards) > 15 and max(shards.values()) < 120
    _check_packed(rows, table.collect(), 64)


def test_index_scores_are_bm25():
    r = np.random.default_rng(1)
    bags = [np.unique(r.integers(0, 40, r.integers(0, 30)), return_counts=True) for _ in range(50)]
    lengths = np.array([int(c.sum()) + 1 for _, c in bags])
    held = Counter(int(t) for b, _ in bags for t in b)
    weight = retrieval_packing.Weights(50, int(lengths.sum()) - 50, held, 40)
    index = retrieval_packing.Index(bags, lengths, weight)
    mean = (lengths.sum() - 50) / 50
    for seed in range(50):
        want = np.zeros(50)
        for t in bags[seed][0]:
            idf = np.log(1 + (50 - held[t] + 0.5) / (held[t] + 0.5))
            for d, (terms, times) in enumerate(bags):
                for tf in times[terms == t]:
                    want[d] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (lengths[d] - 1) / mean))
        assert np.allclose(index.scores(seed), want, rtol=1e-4, atol=1e-4)
        unused = r.random(50) < 0.7
        ranked = list(index.ranked(seed, unused))
        assert sorted(ranked) == np.flatnonzero(unused).tolist()
        assert (np.diff(index.scores(seed)[ranked]) <= 0).all()


def test_windows_take_the_likest_documents():
    kinds = [[0, 1, 2], [10, 11, 12]]
    bags = [(np.array(kinds[i % 2]), np.array([5, 5, 5])) for i in range(20)]
    lengths = np.full(20, 16)
    weight = retrieval_packing.Weights(20, 20 * 15, {t: 10 for k in kinds for t in k}, 20)
    index = retrieval_packing.Index(bags, lengths, weight)
    found = list(retrieval_packing.windows(lengths, index, 32))
    assert len(found) == 10 and all(len({d % 2 for d, *_ in w}) == 1 for w in found)


# ---- tokenizer alignment ----

ODD = ["a▁b", "a\x1eb c. d", "  x\xa0  y　 z", "don't won't I'LL", "é́ 中文🙂<s></s><unk><0x0A>", "a\r\nb\n\n c\t\td", "x.\n.y", "１２３ ﬁ １ x", "\n", " ",
       ".a", "word.com,foo;bar's", "\x00a", "𝔘𝔫 ͏ ", "''s 's", "\n\nFoo\nBar", " \n a", "<|endoftext|> x", "a2b c-d_e", "x \n", "क्षि का", "²x½ y"]


def _aligned_one_by_one(rows):
    """Over whole texts, token by token."""
    one, alphabet = alignment.Aligner(*alignment.default_paths()), alignment.byte_alphabet()
    found, holders = [], Counter()
    for text in rows:
        full = b" " + (text or "").encode()
        a = one.a.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        piece = one.b.id_to_piece
        b = [(i, bytes([int(piece(i)[3:5], 16)]) if one.b.is_byte(i) else piece(i).replace("▁", " ").encode()) for i in one.b.encode(text or "")]
        if not text or any(b"".join(t for _, t in x) != full for x in (a, b)):
            found.append(None)
            continue
        owner = [[k for k, (_, t) in enumerate(x) for _ in t] for x in (a, b)]
        links = [(a[p][0], b[q][0]) for p, q in dict.fromkeys(zip(*owner, strict=True))]
        ends = [np.cumsum([len(t) for _, t in x]) for x in (a, b)]
        cuts = np.intersect1d(*ends)
        names = []
        for first, last in zip([0, *cuts], cuts, strict=False):
            names.append("|".join(",".join(str(t[0]) for t, e in zip(x, end, strict=True) if first < e <= last) for x, end in zip((a, b), ends, strict=True)))
        found.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(names).encode()).hexdigest()))
        holders.update(set(links))
    most = defaultdict(int)
    for (i, _), n in holders.items():
        most[i] = max(most[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else
            (*f[:3], len(f[3]), sum(holders[p] == most[p[0]] for p in f[3]), sum(holders[p] for p in f[3]), f[4]) for f in found]


@pytest.mark.parametrize("remembered", [300_000, 20])
def test_alignment_equals_that_of_whole_texts(spark, remembered, monkeypatch):
    texts = [t for t in awkward() if not isinstance(t, tuple) and len(t or "") < 10_000] + PLAIN[:20] + ODD
    texts.append(" ".join(f"wörd{i % 97}, of-{i % 13}\n" for i in range(600)))
    monkeypatch.setattr(alignment, "SEGMENTS", remembered)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 100 if remembered == 20 else alignment.BATCH_BYTES)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(docs(spark, texts)).collect()}
    assert [got[i + 1] for i in range(len(texts))] == _aligned_one_by_one(texts)


def test_alignment_of_repeated_ids_nulls_and_nothing(spark):
    rows = alignment.aligned(docs(spark, [(3, "a b"), (3, "a b"), (None, "a b"), (None, None)])).collect()
    assert Counter((r.doc_id, r.n_a, r.count_sum) for r in rows) == Counter({(3, 2, 6): 2, (None, 2, 6): 1, (None, 0, 0): 1})
    assert alignment.aligned(docs(spark, [])).collect() == []


# ---- conversation repair ----

TURNS = "conv_id long, turn long, role string, text string, kind string, place int, content string, dropped string, cut int"


def _cheapest(initials, forced, truncated):
    """By states of the grammar, each with its least audit."""
    def put(states, state, value):
        if state not in states or value < states[state]:
            states[state] = value

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit) in list(states.items()):
                put(states, "a" if state == "u" else "u", (cost + 2, audit + "I"))
        return states

    states = {"": (0, "")}
    for initial, gone, cut in zip(initials, forced, truncated, strict=True):
        after = {}
        for state, (cost, audit) in inserted(states).items():
            put(after, state, (cost + 3, audit + "D"))
            if not gone:
                asked = "a" if state == "u" else "u"
                if initial == asked or (initial == "s" and not state):
                    put(after, initial, (cost + cut, audit + "K"))
                put(after, asked, (cost + 2 + cut, audit + "R"))
        states = after
    ended = inserted(states)
    return min(ended[s] for s in ("", "a") if s in ended)


def test_repairs_are_cheapest_and_audits_least():
    r = random.Random(3)
    for _ in range(4000):
        n = r.randrange(12)
        initials = "".join(r.choice("suax" if r.random() < 0.3 else "ua") for _ in range(n))
        forced = bytes(r.random() < 0.15 for _ in range(n))
        truncated = bytes(not f and r.random() < 0.4 for f in forced)
        assert conversations.repair(initials, forced, truncated) == _cheapest(initials, forced, truncated)


def test_long_conversations_take_linear_time_and_cells():
    r = random.Random(5)
    initials = "".join("ua"[i % 2] if r.random() < 0.9 else "s" for i in range(20_000))
    forced = bytes(r.random() < 0.1 for _ in initials)
    truncated = bytes(not f and r.random() < 0.1 for f in forced)
    table = conversations.alignment_table(initials, forced, truncated, conversations.first_repair(initials, forced, truncated))
    assert max(map(len, table)) <= 3
    head = initials[:900], forced[:900], truncated[:900]
    assert conversations.repair(*head) == _cheapest(*head)


def _repaired(spark, rows):
    table = spark.createDataFrame([(*r, "k", 1, "c", "d", 2) for r in rows], TURNS)
    plain = table.selectExpr("conv_id", "turn", "coalesce(role, ' ') role", "coalesce(text, ' ') text", "false dropped")
    return {r.conv_id: r for r in conversations.repaired(plain).collect()}


def test_faults_and_edits(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (2, 0, "user", "A?"), (2, 1, "user", "A?"),
            (2, 4, "assistant", "cut off"), (3, 0, "assistant", " \n"), (4, None, None, None), (4, 2, "", "x."), (None, 1, "user", "Q?")]
    got = _repaired(spark, rows)
    text = lambda *turns: hashlib.sha256("\n".join(turns).encode()).hexdigest()
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "KKK", text("system:Be brief.", "user:Hello?", "assistant:Hi."))
    assert tuple(got[2])[1:] == (2, 0, 1, 1, 1, 4, "KDK", text("user:A?", "assistant:cut off"))
    assert tuple(got[3])[1:] == (0, 1, 0, 0, 0, 3, "D", text(""))
    assert tuple(got[4])[1:] == (0, 1, 0, 0, 1, 6, "DD", text(""))
    assert tuple(got[None])[1:] == (0, 0, 0, 0, 0, 2, "KI", text("user:Q?", "assistant:"))


def test_damage_goes_by_conversation_and_turn(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in (None, 0, 1)] + [(None, 5, "user", None)]
    table = spark.createDataFrame([(*r, "k", 1, "c", "d", 2) for r in rows], TURNS)
    got = defaultdict(list)
    for r in conversations.damage(table).collect():
        got[r.conv_id, r.turn].append((r.role, r.text, r.dropped))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: (text or " ").replace(".", "").replace("!", "")}.get(kind, text or " ")
        assert got[c, t] == [("user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    repaired = conversations.repaired(conversations.damage(table))
    assert {r.conv_id for r in repaired.collect()} == {*range(30), None}
    assert conversations.repaired(conversations.damage(table.limit(0))).collect() == []
