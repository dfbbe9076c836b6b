"""Token files, BPE, repeats, top-k, SimHash and the pipeline against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from evalspark.llm import bpe, components, decontaminate, queries, repeats, simhash, simple8b, token_files, topk

SF, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "a", "It's  don't\tx\x1cy\x85z\xa0q É é ΣΑΣ İstanbul <|endoftext|> a<|startoftext|>b", "日本語 🙂 ½ 12,3 auß teöß", "ÀÉ×÷ß ŸÿÝ", "A" * 3000, "a\nb\r\nc", "hello  world\n\n x", " " * 50, "é" * 700, "ab" * 2000, "don't I'll 123 Ⅷ ٣ á", "\t\r\n \x0b\x0c", "x" * 1500 + " y", "\x00\x01", "the cat " * 20_000]


def texts_of(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall())


def odd_documents(spark):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(ODD)] + [(None, "null id", "x", "y", 1), (4, ODD[4], "x", "y", 1)], DOCS)


# --- token files ----------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 49_407), st.integers(0, (1 << 64) - 1)), max_size=3000))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, offsets, escapes = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, escapes, len(ids)) == ids).all()
    if len(ids):  # a block decodes on its own
        b = len(offsets) - 2
        last = simple8b.decode(words[offsets[b]:], np.array([0, len(words) - offsets[b]]), escapes, len(ids) - b * simple8b.BLOCK)
        assert (last == ids[b * simple8b.BLOCK:]).all()


def _expected_files(rows):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start, out = 0, []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, tmp_path):
    got = queries.QUERIES["op2_simple8b_token_files"](spark, SF)
    assert sorted(map(tuple, got.collect())) == _expected_files(texts_of(SF).items())
    odd = token_files.token_file_digests(odd_documents(spark), P.path("word_bpe_49k.json"), str(tmp_path / "odd"))
    want = _expected_files([(None, "null id"), *((i, t) for i, t in enumerate(ODD) for _ in range(1 + (i == 4)))])
    assert sorted(map(tuple, odd.collect()), key=lambda r: r[1]) == want
    assert token_files.token_file_digests(odd_documents(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_token_files_order_rows_that_repeat_an_id(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(40)] + [(None, f"none {i}") for i in range(40)]
    digests = []
    for k, n in enumerate((2, 5)):
        df = spark.createDataFrame(rows[::-1] if k else rows, "doc_id long, text string").repartition(n)
        got = token_files.token_file_digests(df, P.path("word_bpe_49k.json"), str(tmp_path / str(k))).collect()
        digests.append(sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got))
    assert digests[0] == digests[1] and [r[1] for r in digests[0]] == [None] * 40 + [7] * 40


# --- BPE ------------------------------------------------------------------------

def _tiktoken():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark):
    enc = _tiktoken()
    docs = odd_documents(spark).withColumn("ids", F.lit("clash"))
    got = bpe.encode_and_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    digests = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op3_recursive_bpe"](spark, TINY).collect()}
    for i, t in texts_of(TINY).items():
        ids = enc.encode_ordinary(t or "")
        assert digests[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encode_and_decode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_long_pieces_contract_alike():
    codec, enc = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN), _tiktoken()
    rng = random.Random(1)
    for _ in range(20):
        piece = "".join(rng.choice("abehtnors") for _ in range(rng.randint(2, 400)))
        want = enc._encode_single_piece(piece)
        assert codec._contract_long(piece.encode()) == want
        assert codec._contract([piece.encode()])[0].tolist() == want


def test_codec_holds_a_row_a_piece_and_a_row_a_document():
    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    rng = random.Random(4)
    words = ["".join(rng.choice("abehtnors") for _ in range(10)) for _ in range(20_000)]
    codec.db.execute("set memory_limit = '48MB'")  # rows of all positions and steps do not fit
    tokens, sizes = codec._contract([w.encode() for w in words])
    enc, ends = _tiktoken(), np.cumsum(sizes)
    assert all(tokens[e - n:e].tolist() == enc._encode_single_piece(w) for w, n, e in zip(words[::20], sizes[::20], ends[::20]))
    assert codec.decode(np.tile(tokens, 10), np.tile(sizes, 10)) == [w.encode() for w in words] * 10
    codec.close()


def test_codec_of_ranks_with_gaps():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"cd": 301, b"bc": 299, b"abcd": 1000, b"aa": 302, b"aaa": 303}
    codec, enc = bpe.Codec(ranks, r"\S+|\s+"), tiktoken.Encoding("gaps", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["", None]
    ids, sizes = codec.encode(texts)
    assert ids.tolist() == [i for t in texts for i in enc.encode_ordinary(t or "")]
    assert codec.decode(ids, sizes) == [(t or "").encode() for t in texts]
    assert codec.decode(np.array([97, 5000, -1, 280, 98]), np.array([3, 0, 2])) == [b"a", b"", b"b"]  # ids of no token
    codec.close()


# --- repeats --------------------------------------------------------------------

def cover(raw, length):
    """Bytes in strings of ``length`` that start twice, per text."""
    counts = Counter(b[k:k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        own, end = bytearray(len(b)), 0
        for k in range(len(b) - length + 1):
            if counts[b[k:k + length]] > 1:
                own[max(k, end):k + length] = b"\1" * (k + length - max(k, end))
                end = k + length
        out.append(own)
    return out


def _reports(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    for (i, _), b, own in zip(rows, raw, cover(raw, length)):
        runs = sum(1 for k, c in enumerate(own) if c and (k == 0 or not own[k - 1]))
        kept = bytes(x for x, c in zip(b, own) if not c)
        yield i, len(b), sum(own), runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")


def test_repeats_on_documents(spark):
    got = queries.QUERIES["op5_suffix_array_repeats"](spark, TINY)
    assert sorted(map(tuple, got.collect())) == sorted(_reports(list(texts_of(TINY).items()), 400))


def hard_texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdéü") for _ in range(rng.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, base = line(130), line(300)
    rows = [(i, line(rng.randint(0, 60)) + passage[rng.randint(0, 40):len(passage) - rng.randint(0, 40)] + line(rng.randint(0, 60))) for i in range(40)]
    for i in range(40, 80):
        words = base.split()
        for _ in range(3):
            words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(90, "a" * 3000), (91, "ab" * 700), (92, None), (93, ""), (94, passage), (94, passage), (None, passage + base), (95, "xy" + "a" * 450)]
    return rows


@pytest.mark.parametrize("group", [repeats.GROUP, 5])
def test_repeats_by_trees_and_by_windows(spark, group):
    rows = hard_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans, _ = repeats.repeated_spans(docs, group=group)
    found = {}
    for r in spans.collect():
        found[(r.doc_id, r.t)] = repeats.merged(r.spans)
    keys = {(r.doc_id, r.text): r.t for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    raw = [(t or "").encode() for _, t in rows]
    for (i, t), own in zip(rows, cover(raw, 400)):
        runs = found.get((i, keys[(i, t)]), [])
        mine = bytearray(len(own))
        for a, b in runs:
            mine[a:b] = b"\1" * (b - a)
        assert mine == own, (i, group)


def test_repeat_report_edges(spark):
    docs = spark.createDataFrame(hard_texts(), "doc_id long, text string")
    got = sorted((tuple(r) for r in repeats.removal_report(docs).collect()), key=repr)
    assert got == sorted(_reports(hard_texts(), 400), key=repr)
    assert repeats.removal_report(docs.limit(0)).count() == 0
    cut = repeats.without_repeats(docs.withColumn("n_removed", F.lit("clash"))).collect()
    assert len(cut) == docs.count() and all((r.text is None) or len(r.text.encode()) + r.n_removed >= 0 for r in cut)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=12), st.text("ab", max_size=12)), min_size=2, max_size=9, unique=True), st.integers(2, 10))
def test_interval_tree_groups_are_the_maximal_repeats(sides, length):
    sides = [(a.encode(), b.encode()) for a, b in sides]
    reach = [set() for _ in sides]
    for left, right, members in repeats.maximal_repeats(sides, length):
        assert left + right >= length and len(members) > 1
        same = {(sides[m][0][len(sides[m][0]) - left:], sides[m][1][:right]) for m in members}
        assert len(same) == 1
        shared = [m for m, (a, b) in enumerate(sides) if a.endswith(next(iter(same))[0]) and b.startswith(next(iter(same))[1])]
        assert sorted(shared) == sorted(members)  # all occurrences
        for m in members:
            reach[m].add((left, right))
    suffix = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[-1 - k] != b[-1 - k]), min(len(a), len(b)))
    prefix = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    for i, (a, b) in enumerate(sides):
        for j, (c, d) in enumerate(sides):
            pair = suffix(a, c), prefix(b, d)
            if i != j and sum(pair) >= length:
                assert pair in reach[i]


# --- top-k ----------------------------------------------------------------------

def test_topk_ties_gaps_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 340)] + [(400, None), (420, [1.0, None]), (440, [float("nan")] * 6), (460, [float("inf")]), (None, [1.0] * 6), (500, [2.0, 3.0]), (520, []), (0, rows[0][1]), (540, [1e9] * 6)]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0).collect()))
    # every row is a candidate and, by its id, a query: rows that repeat an id too
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, q) in enumerate(good):
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(good) if m != n)[:20]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_topk_of_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [2.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0).collect()))
    assert got == sorted([(20, 1, 20, 8192), (20, 2, 1, 4096), (20, 1, 1, 8192), (20, 2, 20, 8192)])


def test_topk_in_many_tiles(spark, monkeypatch):
    """Lengths that differ, blocks that need only the first tiles: the same as brute force."""
    for name, n in (("BUCKET", 20), ("QUERIES", 7), ("TILE", 2)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 5)) * np.exp(rng.normal(size=(700, 1)) * 1.5)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.floor(64 * v).astype(np.int64)
    want = []
    for i in range(0, 700, 20):
        scores = q @ q[i]
        order = sorted((j for j in range(700) if j != i), key=lambda j: (-scores[j], j))[:20]
        want += [(i, r, j, int(scores[j])) for r, j in enumerate(order, 1)]
    assert sorted(map(tuple, topk.top_k(df, F.col("id") % 20 == 0).collect())) == want


def test_pruning_drops_only_lower_scores():
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(size=(400, 8)) * 40)
    norms = np.sqrt((v * v).sum(axis=1))
    by = np.argsort(-norms)
    block = topk.Block({"ids": by.astype("<i8").tobytes(), "rows": by.astype("<i8").tobytes(), "norms": norms[by].tobytes(), "vectors": v[by].tobytes(), "dims": 8})
    pruned = 0
    for q in v[:60]:
        scores = block.vectors @ q
        for theta in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]):
            kept = topk.candidates(q, float(np.sqrt(q @ q)), float(theta), block)
            assert set(np.nonzero(scores >= theta)[0]) <= set(kept.tolist())
            pruned += len(scores) - len(kept)
    assert pruned > 0


# --- SimHash --------------------------------------------------------------------

def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in lower).split(" ") if w]
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(prints))]


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    assert (simhash._corrections() != 0).sum() == 2047  # perfect: every syndrome has its error
    prints = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    for bits in (0, 1, 2):
        other = prints.copy()
        for _ in range(bits):
            other ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
        keys = [set() for _ in range(1000)]
        for r, k in zip(*simhash.golay_keys(np.concatenate([prints, other]))):
            keys[r].add(int(k))
        assert all(keys[i] & keys[500 + i] for i in range(500))


def test_simhash_on_documents(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op7_golay_simhash"](spark, TINY).collect()}
    docs = texts_of(TINY)
    ids, prints = list(docs), [brute_print(t) for t in docs.values()]
    roots = brute_components(prints)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, roots)}


def test_simhash_chains_nulls_and_ties(spark):
    rng = random.Random(3)
    chain = [rng.getrandbits(64)]
    for _ in range(60):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = chain + [rng.getrandbits(64) for _ in range(50)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = list(enumerate(signed)) + [(None, signed[5]), (3, signed[3])]
    got = simhash.group_ids(spark.createDataFrame(rows, "doc_id long, fingerprint long"))
    roots = brute_components(prints)
    assert {r.fingerprint: r.component_id for r in got.collect()} == {s: c for s, c in zip(signed, roots)}
    docs = odd_documents(spark)
    made = simhash.near_duplicates(docs).collect()
    assert len(made) == docs.count() and {r.fingerprint for r in made if r.doc_id in (0, 1, 2)} == {"0" * 16}
    kept = simhash.one_of_each_group(docs.withColumn("component_id", F.lit(1)))
    own = [r.doc_id for r in kept.collect()]
    assert len(own) == len(set(own)) and 0 in own and 1 not in own and 4 in own
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.one_of_each_group(docs.limit(0)).count()


def test_components_of_stars_and_paths(spark):
    links = [(1, i) for i in range(2, 200)] + [(i, i + 1) for i in range(300, 400)] + [(500, 500), (7, 1), (601, 600)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 200)}, **{i: 300 for i in range(300, 401)}, 600: 600, 601: 600}


# --- the pipeline ---------------------------------------------------------------

def brute_pipeline(sf):
    rows = [(i, t, n) for i, t, n in duckdb.sql(f"select doc_id, text, n_chars from '{sf}/documents.parquet' order by doc_id").fetchall() if t and any(c.isalpha() for c in t)]
    roots = brute_components([brute_print(t) for _, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    kept = []
    for (i, t, n), own in zip(rows, cover([t.encode() for _, t, _ in rows], 400)):
        new, at = [], 0
        for c in t:  # a character goes if all its bytes do
            size = len(c.encode())
            if not all(own[at:at + size]):
                new.append(c)
            at += size
        new = "".join(new)
        if not any(own) or new.strip():
            kept.append((i, new, len(new) if any(own) else n))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, t, _ in kept])
    con.execute(f"create view benchmark as select * from '{sf}/benchmark.parquet'")
    bad = {r[0] for r in con.execute(decontaminate.oracle()).fetchall()}
    enc = _tiktoken()
    return {i: (n, enc.encode_ordinary(t)) for i, t, n in kept if i not in bad}


def test_pipeline_against_brute_force(spark):
    got = corpus_pipeline.run(spark, TINY).collect()
    assert {r.doc_id: (r.n_chars, r.ids) for r in got} == brute_pipeline(TINY)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_pipeline_stages_take_odd_documents(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for own in (docs, docs.limit(0), docs.withColumn("lang_pred", F.lit("x")).withColumn("extra", F.lit(1))):
            made = stage(spark, own, TINY)
            made.collect()
            if name != "byte_level_bpe":
                assert made.columns == own.columns or set(made.columns) == set(own.columns) - {"lang_pred"}


def _own_mb() -> float:
    import re

    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_lean_tasks_give_freed_memory_back():
    from evalspark.llm.common import give_back, lean

    def run(batches):
        held = []
        for batch in batches:
            for _ in range(2000):
                held.append((bytes(65_000), bytes(600)))  # 130 MB below the size that malloc maps on its own
            pins.append(held[-1][1])
            yield batch

    pins: list = []  # what stays lies behind all that is freed
    give_back()
    before = _own_mb()
    assert list(lean(run)(iter([1]))) == [1]
    assert _own_mb() - before < 40


def test_codec_closes_its_database_and_opens_it_again():
    import public_tokenizers as P
    from evalspark.llm import bpe

    codec = bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    texts = ["unsplittablewordsofthetest and their antidisestablishmentarianism", "", None, "naïve café"]
    first = codec.encode(texts)
    plain = codec.decode(*first)
    codec.close()
    assert codec._db is None
    again = bpe.Codec(codec.ranks, P.PATTERN).encode(texts)
    assert [x.tolist() for x in codec.encode(texts + ["anotherunsplittableword"])][0][:len(first[0])] == first[0].tolist() == again[0].tolist()
    assert codec.decode(*first) == plain == [(t or "").encode() for t in texts]
    codec.close()


def word_cover(texts, words, holders):
    """Bytes in runs of ``words`` words that so many texts hold, per text."""
    import re

    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in texts]
    keys = [[tuple(b[x:y] for x, y in w[k:k + words]) for k in range(len(w) - words + 1)] for b, w in zip(texts, found)]
    counts = Counter(k for own in keys for k in set(own))
    out = []
    for b, w, own in zip(texts, found, keys):
        mask = bytearray(len(b))
        for k, key in enumerate(own):
            if counts[key] >= holders:
                x, y = w[k][0], w[k + words - 1][1]
                mask[x:y] = b"\1" * (y - x)
        out.append(mask)
    return out


def passage_texts():
    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choice("abcdeü") for _ in range(rng.randint(1, 6))) for _ in range(n))
    short, long, two = line(53), line(90), line(60)
    rows = [(i, f"{line(rng.randint(0, 80))} {short} {line(rng.randint(0, 80))}") for i in range(12)]
    rows += [(20 + i, f"{line(30)}\n{' '.join(long.split()[i:i + 60 + i])}\t{line(300)}") for i in range(12)]
    rows += [(40 + i, f"{line(40)} {two} {line(40)}") for i in range(2)]  # two rows only
    rows += [(50, "  ".join(short.split())), (51, "\n" + short.replace(" ", "\n")), (52, None), (53, ""), (54, "the " * 400), (55, "the " * 60 + line(9)), (56, "the " * 51), (57, line(100) + f" {short} " * 3)]
    return rows + [(None, f"x {short} y"), (58, short), (58, short), (59, " ".join(short.split()[:50]))]


def test_passages_by_words_against_all_windows(spark):
    rows = passage_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = {(r.doc_id, r.text): r.t for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    raw = [(t or "").encode() for _, t in rows]
    for holders in (2, 3):
        found = {(r.doc_id, r.t): repeats.merged(r.spans) for r in repeats.passage_spans(docs, holders=holders).collect()}
        for (i, t), own in zip(rows, word_cover(raw, 51, holders)):
            mine = bytearray(len(own))
            for a, b in found.get((i, keys[(i, t)]), []):
                mine[a:b] = b"\1" * (b - a)
            assert mine == own, (i, holders)
    assert repeats.passage_spans(docs.limit(0)).count() == 0


def test_pipeline_cuts_passages_of_over_50_words(spark):
    rng = random.Random(5)
    line = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(n))
    passage, short = line(51), line(50)
    assert len(passage.encode()) < 400
    own = [(line(40), line(60)) for _ in range(8)]
    texts = [f"{a} {passage} {b}" for a, b in own[:3]] + [f"{a} {short} {b}" for a, b in own[3:6]] + [f"{a} {b}" for a, b in own[6:]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.suffix_array_dedup(spark, docs, TINY).collect()}
    want = [f"{a}  {b}" for a, b in own[:3]] + texts[3:]
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}
