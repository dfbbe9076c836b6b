"""Language ID, toxicity, HTML, URL filters and decontamination against brute force and fixtures."""

import itertools
import math
import os
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from evalspark.llm import decontaminate, html_text, langid, queries, toxicity, url_filters

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, lang_pred long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- language ID ----------------------------------------------------------------

def test_forward_sums_all_segmentations():
    pieces = sorted({langid.START, "a", "b", "ab", "ba", "aba", langid.START + "a", langid.START + "ab", "c"})
    rng = np.random.default_rng(3)
    table = np.vstack([rng.random((len(pieces), 2)), [[langid.UNKNOWN] * 2], [[0.0] * 2]])
    index = {p: i for i, p in enumerate(pieces)}

    def brute(word, k):
        text = langid.START + word
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[start:i])
                    start = i
            parts.append(text[start:])
            p = 1.0
            for x in parts:
                p *= table[index[x], k] if x in index else langid.UNKNOWN if len(x) == 1 else 0.0
            total += p
        return math.log(total)

    words = ["a", "abab", "bba", "xab", "ababababa", "c" * 9, "é"]
    got = langid.word_scores(words, langid.Lattice(pieces), table)
    for i, w in enumerate(words):
        for k in (0, 1):
            assert got[i, k] == pytest.approx(brute(w, k), rel=1e-9)
    long = langid.word_scores(["ab" * 3000], langid.Lattice(pieces), table)
    assert np.isfinite(long).all()


def test_expected_counts_of_long_words():
    """Every letter of a word is used once, however long the word or rare its letters:
    400 letters, a script without spaces, characters that are no piece."""
    pieces = sorted({langid.START, *"abcde", "ab", "cde", "abcdeabcdeab", "日本", "日"})
    lattice = langid.Lattice(pieces)
    p = np.append(np.full(len(pieces), 1 / len(pieces)), [langid.UNKNOWN, 0.0])
    sizes = np.array([len(x) for x in pieces] + [1, 0])
    for word in ("abcde" * 80, "日本語" * 150, "x" * 36, "x" * 700, "a"):
        got = langid.expected_counts([word, "ab"], np.array([2.0, 0.0]), lattice, p)
        assert got @ sizes == pytest.approx(2 * (len(word) + 1))
    apart = langid.expected_counts(["a" * 400], np.array([1.0]), langid.Lattice(["a", langid.START]), np.array([0.5, 0.5, langid.UNKNOWN, 0.0]))
    assert apart.tolist() == pytest.approx([400.0, 1.0, 0.0, 0.0])


def test_whole_vocabulary_and_texts_are_used(spark):
    """The longest pieces are in; what stands behind the 20,000th character teaches too."""
    pieces = langid.sentencepiece_vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    assert max(map(len, pieces)) > 12
    rows = [(i, "so " * 9000 + "quuxly " * 50, "aa") for i in range(3)] + [(i + 3, "so " * 9000 + "zimbor " * 50, "bb") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, pieces)
    assert model.predict(["quuxly", "zimbor"])[0] == ["aa", "bb"]


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(f"text {i}", lang) for lang, n in (("x", 5), ("y", 4), ("dirty", 1)) for i in range(n)]
    assert langid.fit(spark.createDataFrame(rows, "text string, lang string"), ["a", "t", langid.START]).languages == ["x", "y"]


def test_expected_counts_match_enumeration():
    pieces = sorted({langid.START, "a", "b", "ab"})
    table = np.array([0.4, 0.3, 0.2, 0.1, langid.UNKNOWN, 0.0])
    got = langid.expected_counts(["ab"], np.array([2.0]), langid.Lattice(pieces), table)
    i = {p: k for k, p in enumerate(pieces)}
    joint, apart = table[i["ab"]] * table[i[langid.START]], table[i["a"]] * table[i["b"]] * table[i[langid.START]]
    assert got[i["ab"]] == pytest.approx(2 * joint / (joint + apart))
    assert got[i[langid.START]] == pytest.approx(2.0)


def test_language_id_held_out_accuracy(spark):
    found = queries.QUERIES["op1_language_id"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    got = found.join(truth, "doc_id").collect()
    assert len(got) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark):
    docs = spark.createDataFrame([(1, "der die das und nicht", "de", "x", 7), (2, "the of and that", "en", "x", 7), (3, None, "en", None, None), (4, "", None, "x", 7), (5, "123 !!", "de", "x", 7), (None, "und die der", None, "x", 7), (2, "the of and that", "en", "x", 7), (8, "the " * 200_000, None, "x", 7)], DOCS)
    model = langid.fit(docs, langid.sentencepiece_vocabulary(queries.tokenizer_path("piece_bpe_32k.model")))
    got = langid.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by = {(r.doc_id, (r.text or "")[:4]): r for r in got.collect()}
    assert got.count() == 8
    assert [by[k].lang_pred for k in ((3, ""), (4, ""), (5, "123 "))] == ["und"] * 3 and by[(3, "")].score == 0
    assert by[(None, "und ")].lang_pred == "de" and by[(8, "the ")].lang_pred == "en"
    empty = langid.fit(docs.limit(0), ["a"])
    assert empty.languages == [] and {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


# --- toxicity -------------------------------------------------------------------

def test_copies_do_not_crowd_out_a_language(spark):
    """A language of 20,000 copies of a text and 100 others: all 101 texts are learned from."""
    copies = spark.range(20_000).selectExpr("'the same old line' as text", "'en' as lang")
    others = spark.range(100).selectExpr("concat('word', translate(cast(id as string), '0123456789', 'abcdefghij')) as text", "'en' as lang")
    pieces = sorted({langid.START} | set("abcdefghijlmnorstw") | {"word", "same"})
    model = langid.fit(copies.unionByName(others), pieces)
    assert model.languages == ["en"]
    table = dict(zip(model.pieces, model.probabilities[:, 0]))
    assert 50 < table["word"] / table["same"] < 200  # 100 texts with the one, 1 with the other


def test_label_model_recovers_rates_and_finds_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(40_000) < 0.2
    a, b = np.array([0.6, 0.5, 0.4, 0.55]), np.array([0.02, 0.01, 0.03, 0.02])
    votes = (rng.random((len(y), 4)) < np.where(y[:, None], a, b)).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # a copy of the first voter
    pairs = votes.T @ votes / len(y)
    model = toxicity.fit_label_model(pairs, 0.25, np.append(a, a[0]) * 0.9, np.append(b, b[0]))
    assert model.share == pytest.approx(0.2, abs=0.04)
    assert np.abs(model.toxic[:4] - a).max() < 0.12
    assert model.weights[0] < model.weights[1] and model.weights[4] < model.weights[1]
    posterior = model.posterior(votes)
    assert ((posterior > 0.5) == y).mean() > 0.9


def test_toxicity_held_out(spark):
    got = queries.QUERIES["op8_weak_supervision_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in clean) / len(clean) <= 0.03
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.7
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot, worthless moron"), (2, "a fine day"), (3, None), (4, ""), (None, "plain"), (2, "a fine day"), (9, "idiot " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (77, 1)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        got = {(r.doc_id, r.text and r.text[:3]): r.score for r in toxicity.score(docs, toxicity.fit(docs, own, F.lit(True))).collect()}
        assert len(got) == 6 and got[(3, None)] == got[(4, "")] and all(0 <= s <= 1 for s in got.values())
    assert got[(1, "you")] >= 0.7 > got[(2, "a f")] and got[(9, "idi")] >= 0.7
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, F.lit(True))).count() == 0


# --- HTML -----------------------------------------------------------------------

HTML = [
    ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
    ("<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>z", "- x\n- y\n\n  3. 1\n  4. 2\n\nz"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>wide cell</table>", "Name       Qty\napple pie  3\nwide cell"),
    ("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a  b\n   c"),
    ("<pre>  x\n   y</pre>", "  x\n   y"),
    ("x<div style='display: none'>no</div><span hidden>no</span><script>var a='</p>';</script><!-- c -->y", "x\ny".replace("\n", "")),
    ("<title>t</title>a &amp; b&nbsp;c<br>d", "a & b\xa0c\nd"),
    ("<details><summary>S</summary>hid</details><details open><summary>T</summary>seen</details>", "S\nT\nseen"),
    ("<dl><dt>k<dd>v</dl>", "k\n  v"),
    ("<div>a</div><div>b</div>  <div> c  d </div>", "a\nb\nc d"),
    ("a < b <3 <i>c</i", "a < b <3 c"),
    ("<blockquote>q</blockquote>", "> q"),
    ("</p></div>x</table>", "x"), ("<h1>a<h2>b", "a\n\nb"), ("", ""), (None, ""),
]


@pytest.mark.parametrize("page,text", HTML)
def test_html_text(page, text):
    assert html_text.extract(page) == text


def test_html_deep_and_broken_pages():
    assert html_text.extract("<div>" * 20_000 + "x") == "x"
    assert html_text.extract("<a b='" * 20_000) == ""
    assert html_text.extract("<td colspan=999 rowspan=999>" * 50) == ""


@pytest.mark.parametrize("page,text", [
    ('<p>a <a href="x"">b</a> c</p><p title=don\'t>d</p><p>e "f" it\'s</p>', 'a b c\n\nd\n\ne "f" it\'s'),
    ("<p title = 'x > y' hidden>no</p><p title=\"a>b\">yes</p><p class= >z</p>", "yes\n\nz"),
    ("<img alt=it's><b>x</b> 'y'<i =\">z</i>", "x 'y'z"),
    ("<p>a</p><a href=\"x>b</a>", "a"),
    ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
    ("<table><tbody><form><tr><td>a</td></tr></form></tbody></table>c", "a\n\nc"),
    ("<table><tr>stray<b>bold</b><td>a</td></tr><tbody>more<tr><td>b</td></tr></tbody></table>", "stray\nbold\nmore\na\nb"),
    ("<table><tr><div>x<td>a</td></div></tr><tr hidden>no<td>no</td></tr></table>", "x\na"),
    ("<table><tr><td><form>in a cell</form></td></tr></table>", "in a cell"),
])
def test_html_loses_no_text(page, text):
    assert html_text.extract(page) == text


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, None)], "page_id long, html string, text string")
    got = html_text.with_text(pages)
    assert got.columns == ["page_id", "html", "text"] and rows(got) == rows(spark.createDataFrame([(1, "<p>a", "a"), (1, "<p>a", "a"), (None, None, "")], "page_id long, html string, text string"))
    assert html_text.with_text(pages.limit(0)).count() == 0
    assert queries.QUERIES["op9_layout_aware_html"](spark, SF).where("text <> ''").count() == spark.read.parquet(f"{SF}/pages.parquet").count()


# --- URL filters ----------------------------------------------------------------

def test_digest_array_survives_collisions(tmp_path):
    path = os.path.join(tmp_path, "d.bin")
    words = [f"host{i}.net/" for i in range(500)]
    with open(path, "wb") as f:
        f.write(url_filters.digest_file(words))
    array = url_filters.DigestArray(path)
    probes = [w.encode() for w in words[:50]] + [b"other/", b""]
    assert array.contains(probes).tolist() == [True] * 50 + [False] * 2
    # every probe looks up the same key: only the stored string tells
    key = int(array.keys[7])
    owner = array.string(7)
    assert array.contains([b"x", owner], digest=lambda s: key).tolist() == [False, True]
    assert not url_filters.DigestArray(_write(tmp_path, [])).contains([b"a"]).any()


def _write(folder, strings):
    path = os.path.join(folder, "empty.bin")
    with open(path, "wb") as f:
        f.write(url_filters.digest_file(strings))
    return path


def _judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]

    def fits(entry):
        h, p = entry.split("/", 1)
        return (host == h or host.endswith("." + h)) and path.startswith("/" + p)

    rule = max((r for r in url_filters.RULES if fits(r)), key=len, default=None)
    verdict = url_filters.RULES[rule] if rule else "block" if any(map(fits, url_filters.BLOCK_LIST)) else "allow"
    return host, path, rule, verdict


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/1?q#f", "https://example.net/EN/", "x://b.net", "x://b.net/", "http://m.example.com/de/x", "http://xexample.com/de/", "http://a.org/fr/1", "http://a.org/fr", "nothing", "", None, "a://b://c/d", "http://www.cheap-pills.example.com/en/4", "http://spam-farm.example.org/fr/1", "http://h?x/en/", "://", "http://\nq.net/a", "http://u@É.net:80/ x", "http://" + "a." * 3000 + "net/" + "y" * 50_000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(1, urls[0], "clash")], "page_id long, url string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filters.judge(pages).collect() if r.page_id != 1}
    assert url_filters.judge(pages).count() == len(urls) + 1
    assert got == {i: _judge(u) for i, u in enumerate(urls) if i != 1}
    assert url_filters.judge(pages.limit(0)).count() == 0
    real = {r.page_id: tuple(r)[1:] for r in queries.QUERIES["op10_url_filter"](spark, SF).collect()}
    assert real == {i: _judge(u) for i, u in duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall()}


# --- decontamination ------------------------------------------------------------

ITEM = "If Alice has 3 apples and gives 2 apples to Bob then how many apples does Alice have left after she walked 5 km home"


def test_reparameterised_questions(spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (7, ITEM, "x"), (2, None, "x"), (3, "too short", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([
        (10, "intro words here. " + ITEM + ". more", 1), (11, ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("3", "17").replace("2", "four").replace("5 km", "9 miles"), 1),
        (12, ITEM.replace("Alice have", "Zoe have").replace("Alice has", "Carol has"), 1),  # one name, two values
        (13, "nothing of the sort is in this quite ordinary text about apples and pears", 1), (14, None, 1), (15, "", 1), (None, ITEM, 1), (10, "intro words here. " + ITEM + ". more", 1), (16, "word " * 100_000 + ITEM, 1)], "doc_id long, text string, item_id int")
    got = decontaminate.contaminated(docs, items)
    found = {(r.doc_id, r.item_id): r.changed for r in got.collect()}
    assert set(found) == {(10, 1), (11, 1), (None, 1), (16, 1)} and got.count() == 4
    assert found[(10, 1)] == 0 and found[(11, 1)] >= 4
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [12, 13, 14, 15]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 == decontaminate.contaminated(docs, items.limit(0)).count()
    assert decontaminate.clean(docs, items.limit(0)).count() == docs.count()


def against_oracle(docs, items):
    con = duckdb.connect()
    for name, columns, table in (("documents", "doc_id bigint, text varchar", docs), ("benchmark", "item_id bigint, text varchar", items)):
        con.execute(f"create table {name} ({columns})")
        con.executemany(f"insert into {name} values (?, ?)", table)
    return sorted(con.execute(decontaminate.oracle()).fetchall())


def test_items_of_equal_words(spark):
    """Items that differ in punctuation only, of 8 to 12 words."""
    texts = ["what is the sum of all digits in base ten", "which of these words is the odd one here", "name the largest prime that divides both of the given sums exactly"]
    items = [(10 * i + k, t + end) for i, t in enumerate(texts) for k, end in enumerate(("", "?", " ..."))]
    docs = [(i, f"so then: {t}. and more") for i, t in enumerate(texts)] + [(9, "nothing of the sort is in this quite ordinary text about pears")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = against_oracle(docs, items)
    assert len(want) == 9 and rows(got.drop("text_hash")) == want


def test_copies_in_another_case(spark):
    names = "Ann Lee met Bob Ray then Cy Fox saw Di Kim and Ed Poe near Rome in May"  # no window with three literals throughout
    numbers = "Add 11 22 33 44 55 66 77 88 99 and 12 13 14"
    items = spark.createDataFrame([(1, ITEM), (2, names), (3, numbers)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so here it is: {t}. and more of it") for i, t in enumerate((names, names.lower(), names.upper(), numbers, numbers.replace("44", "45").replace("77", "78"), ITEM.upper(), ITEM.lower()))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.changed for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(0, 2): 0, (1, 2): 0, (2, 2): 0, (3, 3): 0, (5, 1): 0, (6, 1): 0}


def test_an_edit_does_not_hide_a_copy(spark):
    item = ("The farmer of the valley planted rows of beans along the river. The rain came late that spring and the beans stayed small. "
            "The farmer of the hill waited for the sun before planting and lost nothing at all. The question is which of them sold more beans at the market")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, item.replace("The rain", "Rain that")), (3, item.replace("The rain", "Much rain")), (4, item.replace("The ", "A ", 1).replace("The rain", "My rain").replace("The farmer of the hill", "His farmer of the hill"))], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(docs, items).collect()) == [1, 2, 3, 4]


def test_short_items(spark):
    items = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Add 7 to 9."), (3, "Who was Ed"), (4, "?!"), (5, "What is the capital of France"), (6, "1 2 3 4 5 6 7 8 9")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So: what is the capital of france, then"), (2, "What is the capital of Spain?"), (3, "add 7 to 9"), (4, "add 7 to 8, who was"), (5, "who was ed"), (6, "0 1 2 3 4 5 6 7 8 9 10"), (7, "1 2 3 4 5 6 7 8"), (8, ""), (9, None)], "doc_id long, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 1), (1, 5), (3, 2), (5, 3), (6, 6)] and not any(r.changed for r in found)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 4, 7, 8, 9]


def test_one_word_items_delete_no_ordinary_text(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "Not at all."), (3, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "I said yes to all of it."), (2, "Yes, and not at all late."), (3, "He nodded. Yes! They left."), (4, "It is not at all"), (5, "not at all"), (6, ITEM), (7, "3.5 Yes.no")], "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [1, 2, 4, 7]


def test_sql_has_every_kind_of_row(spark):
    """Templates, other-case copies, edited copies, short items: as many rows in SQL."""
    items = [(1, ITEM), (7, ITEM), (2, None), (3, "Yes"), (4, "What is the capital of France?"), (5, "one Two 3 km Four five Six 7 m eight")]
    words_ = ITEM.split()
    edited = " ".join([*words_[:9], "Other", *words_[9:]])
    docs = [(1, ITEM), (2, ITEM.upper()), (3, ITEM.lower()), (4, edited), (5, "Yes. No."), (6, "so what is the capital of France then"), (7, None), (8, ""), (None, ITEM), (1, ITEM), (9, "One two 4 km four Five six 8 m eight")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in docs], "text": [r[1] for r in docs]}))
    con.register("benchmark", pa.table({"item_id": [r[0] for r in items], "text": [r[1] for r in items]}))
    got = rows(decontaminate.contaminated(d, i).drop("text_hash"))
    assert got == sorted(con.execute(decontaminate.oracle()).fetchall(), key=repr) and len(got) == 7


def test_rows_of_the_sql_stay(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES["op4_template_decontamination"](spark, SF)) == sorted(con.execute(decontaminate.oracle()).fetchall(), key=repr)


def test_decontamination_has_no_python(spark):
    docs, items = (queries.table(spark, SF, t) for t in ("documents", "benchmark"))
    plan = decontaminate.contaminated(docs, items)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_toxicity_learns_from_whole_texts(spark):
    """What stands behind the 40,000th character counts, and the driver gets indices only."""
    sample = spark.createDataFrame([(1, "so " * 20_000 + "zzquxo", ), (0, "so fine"), (1, "zzquxo"), (0, "")], "toxic int, text string")
    counts = {r["feature"]: (r["clean"], r["toxic"]) for r in toxicity.feature_counts(sample).collect()}
    assert counts["zzquxo"] == (0, 2) and counts["zzqu*"] == (0, 2) and counts["so"] == (1, 1)
    found = toxicity.indexed(sample, ["zzqu*"], ["fine", "zzquxo"])
    voter = len(toxicity.FIXED)
    assert [(y, voter in fired, have) for y, fired, have in found] == sorted([(1, True, [1]), (0, False, [0]), (1, True, [1]), (0, False, [])])
