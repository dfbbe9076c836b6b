"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text becomes its words: numbers (with their inner points and commas) and letter
runs. In the template, a number or number word, a word with a capital and a unit are
the placeholders of their type; every other word stands for itself. Windows of
``WINDOW`` template words of the benchmark items, at least ``LITERALS`` of them no
placeholder, are joined by hash with the windows of all documents.

A document holds an item if, along one alignment, ``RUN`` windows of the item (all, if
it has fewer) are in it, and the slots are consistent there: the item's values map one
to one to the document's, so a question with other numbers, names or units is caught
and a text that only has the item's shape by chance, with values that do not map, is
not.

Where templates do not reach that, the item's words themselves are compared as well,
whatever their case and however few literals a window has: a lower-cased copy, or one
of mostly names and numbers, is held if the windows of either kind make ``RUN`` (all,
if it has fewer). And along an alignment that has over half of an item's windows word
for word, a slot that does not map hides nothing: it is a copy with an edit. An item of
fewer than ``WINDOW`` words is held where all its words stand in a row, in any case;
one of a few common words is in ordinary texts as well. The SQL has no such rows.

Null texts have no words. Items that repeat a text count as the one with the
smallest id (an item without an id counts only where the text has no id at all, and
is given as null). Rows that repeat doc_id and text give one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 8
LITERALS = 3
RUN = 6
SHORT = 5
# Unit words and number words.
UNITS = ("mm cm m km inch inches ft feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons "
         "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
         "cent cents dollar dollars euro euros usd eur mph kmh percent degree degrees celsius fahrenheit w kw watt watts volt volts").split()
NUMBERS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty "
           "forty fifty sixty seventy eighty ninety hundred thousand million billion half twice double triple dozen").split()
NUMBER, NAME, UNIT = "0", "A", "B"  # placeholders; no literal has a digit or a capital
WORDS = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+"
SENTENCE_END = r"[.!?]+(?:[ \t\r\f]+|$)|\n+"


def words(text: str) -> Column:
    """The words of a text column."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS), F.lit(0))


def template(column: str) -> Column:
    """The template of a column of words."""
    def kind(w: Column) -> Column:
        return (F.when(w.isin(NUMBERS) | (w < ":") | w.rlike(r"^\p{N}"), NUMBER).when(w != F.lower(w), NAME).when(w.isin(UNITS), UNIT).otherwise(w))
    return F.transform(F.col(column), kind)


def folded(column: str) -> Column:
    """A column of words in lower case."""
    return F.transform(F.col(column), F.lower)


def folded_words(text: str) -> Column:
    return F.transform(words(text), F.lower)


def windows(column: str, n: int = WINDOW, seed: str = "") -> str:
    """Hashes of all windows of ``n`` of a column of words, in order."""
    made = f"transform(sequence(1, size({column}) - {n - 1}), i -> xxhash64({seed}slice({column}, i, {n})))"
    return f"case when size({column}) >= {n} then {made} else cast(array() as array<bigint>) end"


def literal_windows(column: str) -> str:
    """The same of lower-cased words; no hash is that of a template's window."""
    return windows(column, WINDOW, f"{WINDOW}, ")


def short_sentences(text: str) -> Column:
    """The lower-cased words of each sentence of 1 to SHORT - 1 words."""
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), SENTENCE_END), lambda t: F.transform(F.regexp_extract_all(t, F.lit(WORDS), F.lit(0)), F.lower))
    return F.filter(parts, lambda w: (F.size(w) > 0) & (F.size(w) < SHORT))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(distinct items with words and template; of those of ``WINDOW`` words or more the template
    windows with enough literals and all literal windows)."""
    one = items.groupBy(F.col(text_col).alias("text")).agg(F.min(F.col(id_col).cast("long")).alias("item_id"))
    told = one.select("item_id", words("text").alias("item_words")).select("item_id", "item_words", template("item_words").alias("item_template")).withColumn("key", F.xxhash64("item_words"))
    told = stored(told, "items")
    placeholders = f"'{NUMBER}', '{NAME}', '{UNIT}'"
    # items of equal words (other punctuation or white space) share a key: their windows count once
    each = told.dropDuplicates(["key"]).withColumn("item_folded", folded("item_words"))
    typed = each.select("key", "item_template", F.posexplode(F.expr(windows("item_template"))).alias("item_at", "window"))
    typed = typed.where(F.expr(f"size(filter(slice(item_template, item_at + 1, {WINDOW}), w -> w not in ({placeholders}))) >= {LITERALS}")).drop("item_template")
    literal = each.select("key", F.posexplode(F.expr(literal_windows("item_folded"))).alias("item_at", "window"))
    # windows of too few literals are not counted among an item's template windows
    probes = typed.withColumn("typed", F.lit(True)).unionByName(literal.withColumn("typed", F.lit(False)))
    counts = probes.groupBy("key").agg(F.count_if("typed").alias("windows"), F.count_if(~F.col("typed")).alias("literals"))
    return told, stored(probes.join(counts, "key"), "item-windows")


def _short_items(base: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id) of items of fewer than ``WINDOW`` words."""
    short = told.where(f"size(item_words) between 1 and {WINDOW - 1}").select("item_id", folded("item_words").alias("item_folded")).withColumn("h", F.xxhash64("item_folded"))
    lengths = [r["n"] for r in short.select(F.size("item_folded").alias("n")).where(f"n >= {SHORT}").distinct().collect()]  # at most WINDOW - SHORT
    said = base.select("doc_id", F.xxhash64("text").alias("text_hash"), short_sentences("text").alias("sentences"), folded_words("text").alias("folded"))
    rows = ", ".join(["sentences", *(f"case when size(folded) >= {n} then transform(sequence(1, size(folded) - {n - 1}), i -> slice(folded, i, {n})) else slice(sentences, 1, 0) end" for n in sorted(lengths))])
    said = said.select("doc_id", "text_hash", F.explode(F.expr(f"array_distinct(concat({rows}))")).alias("run")).withColumn("h", F.xxhash64("run"))
    return said.join(short, "h").where("run = item_folded").select("doc_id", "text_hash", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, windows (matched; a short item is one), slots (distinct values
    compared), changed (of them, how many differ), text_hash: one row per document and
    item it holds."""
    told, probes = item_windows(items)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = base.select("doc_id", F.xxhash64("text").alias("text_hash"), words("text").alias("words"))
    forms = keyed.select("doc_id", "text_hash", F.size("words").alias("n_words"), template("words").alias("template"), folded("words").alias("folded"))
    # one array of hashes a document: of its template, then of its words; a hit tells which, so its place in the text follows
    rows = forms.select("doc_id", "text_hash", "n_words", F.posexplode(F.expr(f"concat({windows('template')}, {literal_windows('folded')})")).alias("place", "window"))
    # left to the planner: the benchmark's windows are broadcast if the written table is under the threshold
    hits = rows.join(probes, "window").withColumn("shift", F.expr(f"place - if(typed, 0, n_words - {WINDOW - 1}) - item_at"))
    runs = hits.groupBy("doc_id", "text_hash", "key", "windows", "literals", "shift").agg(F.collect_set(F.expr("if(typed, item_at, -1 - item_at)")).alias("both"))
    runs = runs.selectExpr("*", "filter(both, p -> p >= 0) as by_template", "transform(filter(both, p -> p < 0), p -> -1 - p) as by_word").withColumn("by_any", F.array_union("by_template", "by_word"))
    runs = runs.withColumn("typed", F.expr(f"windows > 0 and size(by_template) >= least({RUN}, windows)")).where(f"typed or size(by_any) >= least({RUN}, literals)")
    runs = runs.withColumn("copy", F.expr(f"size(by_word) >= least({RUN}, literals) and 2 * size(by_word) > literals"))
    runs = stored(runs.select("doc_id", "text_hash", "key", "shift", "typed", "copy", F.when(F.col("typed"), F.col("by_template")).otherwise(F.col("by_any")).alias("places")), "runs")
    texts = stored(keyed.join(runs.select("doc_id", "text_hash").distinct().withColumnsRenamed({"doc_id": "d", "text_hash": "t"}), F.expr("doc_id <=> d and text_hash <=> t"), "left_semi").dropDuplicates(["doc_id", "text_hash"]), "run-texts")
    aligned = runs.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}).join(texts, F.expr("doc_id <=> d and text_hash <=> t")).join(told, "key")
    covered = aligned.withColumn("positions", F.expr(f"array_distinct(flatten(transform(places, p -> sequence(p, p + {WINDOW - 1}))))"))
    placeholders = f"'{NUMBER}', '{NAME}', '{UNIT}'"
    slots = covered.withColumn("slots", F.expr(f"array_distinct(transform(filter(positions, p -> item_template[p] in ({placeholders})), p -> struct(item_template[p] as kind, lower(item_words[p]) as a, lower(words[p + shift]) as b)))"))
    consistent = slots.withColumn("maps", F.expr("size(array_distinct(transform(slots, s -> struct(s.kind, s.a)))) = size(slots) and size(array_distinct(transform(slots, s -> struct(s.kind, s.b)))) = size(slots)")).where("maps or copy")
    found = consistent.select("doc_id", "text_hash", "item_id", F.expr("typed and maps").alias("first"), F.size("places").alias("windows"), F.size("slots").alias("slots"), F.expr("size(filter(slots, s -> s.a <> s.b))").alias("changed"))
    best = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("first", "windows", (-F.col("changed")).alias("same"), "slots")).alias("m"))
    long = best.select("doc_id", "item_id", F.col("m.windows").cast("long").alias("windows"), F.col("m.slots").cast("long").alias("slots"), (-F.col("m.same")).cast("long").alias("changed"), "text_hash")
    short = _short_items(base, told).select("doc_id", "item_id", F.lit(1).cast("long").alias("windows"), *(F.lit(0).cast("long").alias(c) for c in ("slots", "changed")), "text_hash")
    return long.unionByName(short)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    found = contaminated(docs, items, id_col, text_col).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct()
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(F.col("__d")) & F.xxhash64(docs[text_col]).eqNullSafe(F.col("__h")), "left_anti")


def oracle(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The same in DuckDB's SQL, windows and sentences compared as lists of words."""
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    kind = rf"case when w in ({quoted(NUMBERS)}) or regexp_matches(w, '^\p{{N}}') then '{NUMBER}' when w <> lower(w) then '{NAME}' when w in ({quoted(UNITS)}) then '{UNIT}' else w end"
    slots = f"'{NUMBER}', '{NAME}', '{UNIT}'"
    forms = f"list_transform(ws, lambda w: {kind}) as tp, list_transform(ws, lambda w: lower(w)) as lw"
    return rf"""
with items as (select min(item_id) as item_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as ws from {benchmark} group by text),
docs as (select distinct doc_id, text as whole, regexp_extract_all(coalesce(text, ''), '{WORDS}') as ws from {documents}),
it as (select item_id, ws, {forms} from items),
dt as (select doc_id, whole, ws, {forms} from docs),
iw0 as (select item_id, unnest(range(1, len(tp) - {WINDOW - 2})) as i, tp, lw from it where len(tp) >= {WINDOW}),
iw as (select item_id, i, true as typed, tp[i:i + {WINDOW - 1}] as win from iw0 where len(list_filter(tp[i:i + {WINDOW - 1}], lambda w: w not in ({slots}))) >= {LITERALS}
       union all select item_id, i, false, lw[i:i + {WINDOW - 1}] from iw0),
nw as (select item_id, count(*) filter (typed) as n, count(*) filter (not typed) as l from iw group by item_id),
dw0 as (select doc_id, whole, unnest(range(1, len(tp) - {WINDOW - 2})) as i, tp, lw from dt where len(tp) >= {WINDOW}),
dw as (select doc_id, whole, i, true as typed, tp[i:i + {WINDOW - 1}] as win from dw0 union all select doc_id, whole, i, false, lw[i:i + {WINDOW - 1}] from dw0),
hits as (select dw.doc_id, dw.whole, iw.item_id, iw.typed, iw.i, dw.i - iw.i as shift from dw join iw using (typed, win)),
runs as (select doc_id, whole, item_id, shift, coalesce(list(distinct i) filter (typed), []) as bt, coalesce(list(distinct i) filter (not typed), []) as bw, list(distinct i) as ba from hits group by all),
kept as (select r.*, n > 0 and len(bt) >= least({RUN}, n) as typed, len(bw) >= least({RUN}, l) and 2 * len(bw) > l as copy, l from runs r join nw using (item_id)),
told as (select *, case when typed then bt else ba end as places from kept where typed or len(ba) >= least({RUN}, l)),
pos as (select distinct doc_id, whole, item_id, shift, p + unnest(range(0, {WINDOW})) as p from (select *, unnest(places) as p from told)),
val as (select distinct pos.doc_id, pos.whole, pos.item_id, shift, it.tp[p] as kind, lower(it.ws[p]) as a, lower(dt.ws[p + shift]) as b
        from pos join it on it.item_id = pos.item_id join dt on dt.doc_id is not distinct from pos.doc_id and dt.whole = pos.whole),
sl as (select * from val where kind in ({slots})),
agg as (select t.doc_id, t.whole, t.item_id, t.shift, t.typed, t.copy, len(t.places) as windows, count(sl.a) as slots, count(distinct (sl.kind, sl.a)) filter (sl.a is not null) as da, count(distinct (sl.kind, sl.b)) filter (sl.a is not null) as db, count(*) filter (sl.a <> sl.b) as changed
        from told t left join sl on sl.doc_id is not distinct from t.doc_id and sl.whole = t.whole and sl.item_id = t.item_id and sl.shift = t.shift group by all),
best as (select *, row_number() over (partition by doc_id, whole, item_id order by (typed and da = slots and db = slots) desc, windows desc, changed, slots desc) as r from agg where (da = slots and db = slots) or copy),
said as (select doc_id, whole, list_transform(regexp_extract_all(unnest(regexp_split_to_array(coalesce(whole, ''), '{SENTENCE_END}')), '{WORDS}'), lambda w: lower(w)) as run from docs),
lens as (select distinct len(lw) as n from it where len(lw) between {SHORT} and {WINDOW - 1}),
rows0 as (select doc_id, whole, n, lw, unnest(range(1, len(lw) - n + 2)) as i from dt, lens where len(lw) >= n),
short as (select doc_id, whole, item_id from said join it on it.lw = said.run where len(it.lw) between 1 and {SHORT - 1}
          union select doc_id, whole, item_id from rows0 join it on it.lw = rows0.lw[i:i + n - 1] and len(it.lw) = n)
select doc_id, item_id, windows::bigint as windows, slots::bigint as slots, changed::bigint as changed from best where r = 1
union all select doc_id, item_id, 1::bigint, 0::bigint, 0::bigint from short"""
