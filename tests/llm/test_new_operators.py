"""Exact dedup, conversation repair and cross-tokenizer alignment against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evalspark.llm import alignment, conversations, cuckoo, queries

SF, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


# --- exact dedup ----------------------------------------------------------------

def _signature(n: int, mark: int = 0) -> bytes:
    h = hashlib.sha512(str(n).encode()).digest()[:cuckoo.WIDTH]
    return mark.to_bytes(2, "little") + h[2:] if mark else h


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60), st.integers(0, 9)), max_size=300), st.integers(0, 1))
def test_cuckoo_index_is_a_dictionary(steps, mark):
    """Insertions and deletions, all fingerprints alike or not, with a reload half way."""
    index, want = cuckoo.CuckooIndex(buckets=1), {}
    for i, (add, n, keep) in enumerate(steps):
        key = _signature(n, mark)
        if add:
            index.add(key, keep, 1)
            k, c = want.get(key, (keep, 0))
            want[key] = (min(k, keep), c + 1)
        else:
            index.set(key, None, 0)
            want.pop(key, None)
        if i == len(steps) // 2:
            again = cuckoo.CuckooIndex()
            for batch in index.rows(0):
                for _, kind, entry, signature, keep_id, copies, buckets, slots in zip(*(c.to_pylist() for c in batch.columns)):
                    again.load_slots(buckets, slots) if kind == cuckoo.FILTER else again.load_entry(entry, signature, keep_id, copies)
            index = again
    for n in range(61):
        entry = index.find(_signature(n, mark))
        got = None if entry is None else (index.keep_ids[entry], index.copies[entry])
        assert got == want.get(_signature(n, mark))
    assert len(index.live()) == len(want)


def test_cuckoo_index_grows_and_false_hits_are_no_copies():
    index = cuckoo.CuckooIndex(buckets=1)
    for n in range(3000):
        index.add(_signature(n), n, 1)
    assert index.buckets >= 1024 and len(index.live()) == 3000
    assert all(index.keep_ids[index.find(_signature(n))] == n for n in range(3000))
    twin = bytearray(_signature(7))
    twin[-1] ^= 1  # same fingerprint and buckets, another signature
    assert index.find(bytes(twin)) is None


def _expected_groups(rows):
    """(doc_id, text) rows -> sorted rows of the query."""
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    out, seen = [], set()
    for i, t in norm:
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), i == keep and t not in seen, hashlib.sha256(t.encode()).hexdigest()))
        if i == keep:
            seen.add(t)
    return sorted(out, key=str)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_exact_dedup_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert _rows(queries.QUERIES["op12_cuckoo_exact_dedup"](spark, SF)) == _expected_groups(rows)


def test_exact_dedup_odd_rows_insert_and_delete(spark):
    rows = [(5, "a b"), (3, "a\t\n b"), (3, "a b"), (None, "a b"), (7, None), (8, ""), (None, "x\x1cy"), (None, "x\x1cy"), (9, " a b"), (2, "A" * 100_000), (1, "A" * 100_000), (4, "a\x85b"), (6, "a b ")]
    schema = "doc_id long, text string, signature string, copies int, kind int"
    frame = lambda rs: spark.createDataFrame([(i, t, "clash", 1, 0) for i, t in rs], schema)
    index = cuckoo.build(frame(rows), shards=3)
    assert _rows(cuckoo.decisions(index, spark)) == _expected_groups(rows)
    more = [(0, "a  b"), (11, "new"), (12, "new"), (7, "")]
    index = cuckoo.insert(index, frame(more))
    assert _rows(cuckoo.decisions(index, spark)) == _expected_groups(rows + more)
    gone = [0, 3, 9, 11, None, 99]
    index = cuckoo.delete(index, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [(i, t) for i, t in rows + more if i is None or i not in gone]
    assert _rows(cuckoo.decisions(index, spark)) == _expected_groups(left)
    back = cuckoo.insert(index, frame([(9, " a b")]))  # its entry and slot had been freed
    assert _rows(cuckoo.decisions(back, spark)) == _expected_groups(left + [(9, " a b")])
    assert cuckoo.exact_duplicates(frame(rows).limit(0)).count() == 0


def test_exact_dedup_moves_a_row_a_batch_of_a_hot_group(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', cast(id as string)) as text")
    index = cuckoo.build(docs, shards=4)
    members = index.members(spark)
    merged = members.mapInArrow(cuckoo._merged, "signature binary, keep_id long, copies long")
    assert merged.groupBy("signature").count().agg({"count": "max"}).first()[0] <= members.rdd.getNumPartitions() * 4
    assert cuckoo.decisions(index, spark).where("kept").count() == 1 + 20_000 - 6667


# --- conversation repair ----------------------------------------------------------

PATTERN = re.compile(r"(s?(ua)+)?").fullmatch
BLANKS = " \t\n\x0b\x0c\r"


def _may_start(initials):
    """A beginning of the pattern?"""
    body = initials[1:] if initials[:1] == "s" else initials
    return all(c == "ua"[i % 2] for i, c in enumerate(body))


def _cheapest(rows):
    """(cost, audit, repaired rows) of (role, text, fault) rows: uniform-cost search over
    (rows read, initials written) with (cost, audit) as the key."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and PATTERN(initials):
            return cost, audit, out
        if (i, initials) in seen:
            continue
        seen.add((i, initials))
        offers = [(cost + 2, audit + "I", i, r[0], (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            offers.append((cost + 3, audit + "D", i + 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                offers.append((cost + more, audit + "K", i + 1, role[:1], (role, text)))
                offers += [(cost + 2 + more, audit + "R", i + 1, r[0], (r, text)) for r in ("user", "assistant")]
        for c, a, j, new, row in offers:
            if _may_start(initials + new):
                heapq.heappush(heap, (c, a, j, initials + new, out if row is None else (*out, row)))


def _faults(rows):
    """(role, text) rows with the first fault of each."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def _reported(rows):
    """The report's columns for (turn, role, text) rows in order."""
    faults = _faults([(r, t) for _, r, t in rows])
    cost, audit, out = _cheapest(faults)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    counts = [sum(f == k for _, _, f in faults) for k in ("blank", "duplicate", "truncated")]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest


def _expected_repairs(rows, damage):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        own = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {conv: _reported(sorted(own, key=order)) for conv, own in convs.items()}


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_query(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    got = queries.QUERIES["op11_conversation_repair"](spark, SF).collect()
    assert {r["conv_id"]: tuple(r[c] for c in REPORT) for r in got} == _expected_repairs(rows, True)
    assert len(got) == len({r[0] for r in rows})


def _random_conversations(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Sys", "student"]
    texts = ["Yes.", "No", "", " \t", None, "a\n", "Really?  ", "x" * 3000 + "!", "\x0b.", "é"]
    return [(rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 2, 256])
def test_repair_of_odd_rows(spark, block, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = _random_conversations(random.Random(block), 60)
    rows += rows[:7] + [(9, None, "user", "Only."), (10, 3, None, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, code int")
    got = conversations.repair_report(df).collect()
    assert {r["conv_id"]: tuple(r[c] for c in REPORT) for r in got} == _expected_repairs(rows, True)
    assert conversations.repair_report(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 19), max_size=7), st.integers(1, 3))
def test_repair_weights_equal_search(codes, block):
    """Blocks of any length, put together, give the cheapest audit."""
    names = {0: "x", 1: "s", 2: "u", 3: "a", 4: ""}
    faults = {0: "", 1: "truncated", 2: "blank", 3: "duplicate"}
    joined = conversations.Joined()
    for k in range(0, len(codes), block):
        joined.append(conversations.block_paths(bytes(codes[k:k + block])))
    want = _cheapest([(names[c % 5], "", faults[c // 5]) for c in codes])
    assert joined.end() == want[:2]


def test_repair_of_one_long_conversation(spark):
    """All rows of one conversation, in many ranges and blocks, texts that repeat."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["Yes.", f"Well {t}.", f"cut {t}"])) for t in range(3000) for _ in range(1 + (t % 50 == 0))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    done = conversations.repair(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = done.report.first()
    ordered = sorted(rows, key=lambda r: (r[1], r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    faults = _faults([(r, t) for _, _, r, t in ordered])
    field = conversations.Field(3 * len(rows))  # one integer for the whole conversation
    best = {0: 0}
    for role, _, fault in faults:
        best = field.row(field.inserted(best), {"u": 2, "a": 3}[role[0]] + 5 * ["", "truncated", "blank", "duplicate"].index(fault))
    wide = conversations.Joined()
    wide.field, wide.best = field, best
    assert (got["cost"], got["audit"]) == wide.end()
    out = done.rows.orderBy("seq", "place").collect()
    assert PATTERN("".join(r["role"][0] for r in out))
    assert got["gaps"] == 0 and got["duplicate"] == sum(f == "duplicate" for _, _, f in faults)
    assert done.edits.selectExpr("count(distinct shiftright(seq, 33))").first()[0] > 1


# --- cross-tokenizer alignment ------------------------------------------------------

ODD = ["", None, " ", "a", "  two  spaces ", "a\n b\n\n  c", "It's  don't\tx\x1cy\x85z\xa0q É é ΣΑΣ İstanbul <|endoftext|> a<s>b</s> <unk> <0x41>", "日本語 🙂 ½ 12,3 auß teöß", "A" * 3000, "a\nb\r\nc",
       "hello  world\n\n x", " " * 50, "é" * 700, "a \u2581 b", "\u2581", "x\u2581", "don't I'll 123 Ⅷ ٣ á", "\t\r\n \x0b\x0c", "x\u2009 y\u3000z \u2028 w.\x1c  v", "\x00\x01 \x00", "the cat " * 5000, "a\t b\xa0 c .\n d", "\n"]


def _sides():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    byte_of = {s: x for x, s in alignment.byte_symbols().items()}
    a_bytes = lambda i: bytes(byte_of[c] for c in tok.id_to_token(i))
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode()
    return tok, b, a_bytes, piece


def _plain_alignment(texts):
    """Whole texts through both libraries, byte ranges compared one by one."""
    tok, b, a_bytes, b_bytes = _sides()
    docs, counts = [], defaultdict(int)
    for t in texts:
        a_ids, b_ids = (tok.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if b"".join(map(a_bytes, a_ids)) != whole or b"".join(map(b_bytes, b_ids)) != whole:
            a_ids = b_ids = []
        spans = []
        for ids, of in ((a_ids, a_bytes), (b_ids, b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of(i)), i))
                at = own[-1][1]
            spans.append(own)
        links, k = [], 0
        for s, e, i in spans[0]:
            while k and spans[1][k - 1][1] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, x, y = [], 0, 0
        for cut in cuts:
            x2, y2 = x, y
            while x2 < len(a_ids) and spans[0][x2][1] <= cut:
                x2 += 1
            while y2 < len(b_ids) and spans[1][y2][1] <= cut:
                y2 += 1
            groups.append(",".join(map(str, a_ids[x:x2])) + "|" + ",".join(map(str, b_ids[y:y2])))
            x, y = x2, y2
        docs.append((len(a_ids), len(b_ids), len(groups), links, ";".join(groups)))
        for pair in set(links):
            counts[pair] += 1
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(n_a, n_b, n_g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for n_a, n_b, n_g, links, g in docs]


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{TINY}/documents.parquet' order by doc_id").fetchall()
    got = queries.QUERIES["op13_tokenizer_alignment"](spark, TINY).select(*ALIGNED).collect()
    want = _plain_alignment([t for _, t in rows])
    assert sorted(map(tuple, got)) == [(i, *w) for (i, _), w in zip(rows, want)]


def test_alignment_of_odd_texts_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN", 2)
    texts = ODD + ["of the " + t for t in ODD if t] + [f"word{i % 7} {i}" for i in range(40)]
    rows = [(None if i == 3 else 4 if i == 5 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, part int, pairs string").repartition(9)
    got = alignment.align(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN).select(*ALIGNED).collect()
    want = [(i, *w) for (i, _), w in zip(rows, _plain_alignment([t for _, t in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert alignment.align(df.limit(0), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN).count() == 0


def test_second_pass_of_alignment_encodes_nothing(monkeypatch):
    """From what the first pass writes and the pairs' counts alone come the documents' rows."""
    import pyspark
    from types import SimpleNamespace as Box

    texts = ["of the word", None, "", "of the " * 50, "Häuser 日本", "x\u2581y"]
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(P.path("piece_bpe_32k.model"), "rb") as g:
        made_of = Box(value=(f.read(), g.read(), P.PATTERN))
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: Box(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    documents, last = (b.to_pylist() for b in alignment._first_pass(made_of)([batch]))
    monkeypatch.setattr(alignment, "_aligner", lambda made_of: pytest.fail("a text is encoded again"))
    n_b, top = alignment.Aligner(*made_of.value).n_b, {}
    for p in last[0]["packed"]:
        for pair, n in zip(np.frombuffer(p["pairs"], "<u8").tolist(), np.frombuffer(p["n"], "<u4").tolist()):
            top[pair // n_b] = max(top.get(pair // n_b, 0), n)
    best = np.array([top.get(i, 0) for i in range(max(top) + 1)])
    nothing = dict.fromkeys(("id", *alignment.SUMS, "digest", "x", "y"))
    rows = [{"part": 0, "kind": 0} | nothing | {"x": p["pairs"], "y": np.frombuffer(p["n"], "<u4").astype("<i8").tobytes()} for p in last[0]["packed"]]
    rows += [{"part": 0, "kind": 1} | nothing | {"x": last[0]["sizes"], "y": last[0]["links"]}]
    rows += [{"part": 0, "kind": 2} | nothing | {c: d[c] for c in ("id", *alignment.SUMS, "digest")} | {"x": d["refs"]} for d in documents]
    schema = pa.schema([("part", pa.int64()), ("kind", pa.int32()), *((c, pa.int64()) for c in ("id", *alignment.SUMS)), *((c, pa.binary()) for c in ("digest", "x", "y"))])
    got = [tuple(r.values()) for b in alignment._second_pass(n_b, Box(value=best))(pa.RecordBatch.from_pylist([r], schema) for r in rows) for r in b.to_pylist()]
    assert got == [(i, *w) for i, w in enumerate(_plain_alignment(texts))]


@given(st.lists(st.integers(0, (1 << 32) - 1)))
def test_planes(numbers):
    assert alignment.unplaned(alignment.planes(np.array(numbers, np.int64))).tolist() == numbers


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=2000))
def test_minimal_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    levels, table = alignment.CountIndex.build(keys)
    index = alignment.CountIndex(levels, table)
    assert sorted(index.numbers(keys).tolist()) == list(range(len(keys)))
    absent = np.array([1 << 63 | 12345], np.uint64)
    if absent[0] not in keys:
        with pytest.raises(KeyError):
            index.numbers(absent)


def test_alignment_chunks_equal_whole_texts():
    """Texts of odd white space: chunk by chunk as whole."""
    tok, b, _, _ = _sides()
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(P.path("piece_bpe_32k.model"), "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read(), P.PATTERN)
    assert aligner.cuts
    rng = random.Random(1)
    parts = ["a", "Word", " ", "  ", "\n", "\t", "\xa0", "\u2009", "\x1c", "\x85", ".", "'s", "é", "日", "12", "\u2028", "!?", "don't"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        chunks = aligner.chunks(text)
        assert [i for c in chunks for i in aligner._a_ids([c])[0]] == tok.encode(" " + text, add_special_tokens=False).ids
        assert [i for ids in aligner._b_ids(chunks) for i in ids] == b.encode(text)
