"""Repair of conversation structure: the cheapest edits that give every conversation
roles whose initials read ``(s?(ua)+)?``.

Edits of a row: Keep (0), Rerole to user or assistant (2), Delete (3); Insert (2) puts an
empty turn of user or assistant before, between or after rows. Blank and duplicate rows
must be deleted; a truncated row that stays costs 1 more. Of the cheapest repairs the one
whose audit, the initials of its edits in order, is least in ASCII is taken.

One integer is the whole weight of a path: its high digits are the cost, below are the
letters of its audit as digits of ``BITS`` bits, the first letter on top, in a field of
fixed width that zeros fill up to the end. A path is lengthened by adding to it, the
smaller integer is the better path, and the minimum of integers over the edges of a
DAG (rows x the four states of the pattern, an edge a letter) decides cost and audit at
once. Two paths of equal cost that have read the same rows are never prefixes of each
other (the longer one would have more inserts), so what follows cannot turn their order.

On Spark: rows are dealt by ranges of (conversation, turn, role, digest of the text, a
running number), so a conversation with any share of all rows lies in as many tasks as its rows need.
A task cuts its conversations into blocks of ``BLOCK`` rows and gives each block's
weights from every state to every state; these are put together conversation by
conversation, and letters that all paths share leave the integers. Only a byte a row
and the audit of a conversation, one cell of the result, meet in a task; texts are joined
with their edits by row number afterwards. Duplicates are found by the least row number
of a (conversation, digest), counted in partial aggregates, and never by a set in memory.

Defined results: a null role or text is one space; a null conversation is a conversation;
null turns come first; rows of equal turn go by role, then by the text's digest;
rows that repeat in everything follow each other; a row whose role is empty has no
initial and may stay anywhere; an empty table gives no conversation. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepared, stored

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
BLOCK = 256  # rows whose paths are put into one integer
# classes of a role's initial, and faults; a row's code is class + CLASSES * fault
OTHER, SYSTEM, USER, ASSISTANT, NOTHING = range(CLASSES := 5)
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
# states of the pattern: nothing yet, after s, after u, after a
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP = ({}, {START: AFTER_S}, {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, {AFTER_U: AFTER_A}, {q: q for q in range(4)})
TURN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U, AFTER_U: AFTER_A}  # a turn put or turned into place
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
BITS, LETTERS = 3, "\0DIKR"  # a letter's digit is its place; 0 ends the audit
D, I, K, R = range(1, 5)


class Field:
    """Weights with room for ``width`` letters."""

    def __init__(self, width: int):
        self.width, self.mask = width, (1 << BITS * width) - 1

    def letters(self, weight: int) -> int:
        """The number of letters in a weight: what its zeros at the end leave."""
        low = weight & self.mask
        return self.width - ((low & -low).bit_length() - 1) // BITS if low else 0

    def then(self, weight: int, cost: int, letter: int) -> int:
        return weight + (cost << BITS * self.width) + (letter << BITS * (self.width - 1 - self.letters(weight)))

    def inserted(self, best: dict[int, int]) -> dict[int, int]:
        """With up to two inserted turns; three would bring a state back for more."""
        for _ in range(2):
            best = least([*best.items(), *((TURN[q], self.then(w, 2, I)) for q, w in best.items())])
        return best

    def row(self, best: dict[int, int], code: int) -> dict[int, int]:
        kind, fault = code % CLASSES, code // CLASSES
        offers = [(q, self.then(w, 3, D)) for q, w in best.items()]
        if fault in (SOUND, TRUNCATED):
            more = int(fault == TRUNCATED)
            offers += [(KEEP[kind][q], self.then(w, more, K)) for q, w in best.items() if q in KEEP[kind]]
            offers += [(TURN[q], self.then(w, 2 + more, R)) for q, w in best.items()]
        return least(offers)

    def read(self, weight: int) -> tuple[int, str]:
        """(cost, audit)."""
        n = self.letters(weight)
        digits = (weight & self.mask) >> BITS * (self.width - n)
        return weight >> BITS * self.width, "".join(LETTERS[digits >> BITS * k & 7] for k in range(n - 1, -1, -1))


def least(offers) -> dict[int, int]:
    best: dict[int, int] = {}
    for q, w in offers:
        if q not in best or w < best[q]:
            best[q] = w
    return best


def block_paths(codes: bytes, starts=(START, AFTER_S, AFTER_U, AFTER_A)) -> list[str | None]:
    """The best path over the rows from each state to each, as ``cost:audit``; inserts
    after the last row are the next block's."""
    field = Field(3 * len(codes))
    out: list[str | None] = [None] * 16
    for p in starts:
        best = {p: 0}
        for code in codes:
            best = field.row(field.inserted(best), code)
        for q, w in best.items():
            out[4 * p + q] = "%d:%s" % field.read(w)
    return out


class Joined:
    """The paths over a conversation's blocks so far, from START to each state. Letters
    and cost that all of them share have been taken out of the integers."""

    def __init__(self):
        self.field, self.best = Field(0), {START: 0}
        self.cost, self.audit = 0, []

    def append(self, paths: list[str | None]) -> None:
        had, parts = self.field, {}
        for p, w in self.best.items():
            for q in range(4):
                if (path := paths[4 * p + q]) is not None:
                    cost, _, audit = path.partition(":")
                    parts[p, q] = w, had.letters(w), int(cost), audit
        field = Field(max(n + len(audit) for _, n, _, audit in parts.values()))
        offers = []
        for (_, q), (w, n, cost, audit) in parts.items():
            digits = 0
            for letter in audit:
                digits = digits << BITS | LETTERS.index(letter)
            low = (w & had.mask) >> BITS * (had.width - n)
            offers.append((q, ((w >> BITS * had.width) + cost << BITS * field.width) + ((low << BITS * len(audit) | digits) << BITS * (field.width - n - len(audit)))))
        self._settle(field, least(offers))

    def _settle(self, field: Field, best: dict[int, int]) -> None:
        lows = [w & field.mask for w in best.values()]
        differ = 0
        for low in lows:
            differ |= low ^ lows[0]
        lengths = [field.letters(w) for w in best.values()]
        common = min(field.width - -(-differ.bit_length() // BITS), min(lengths))
        left = Field(max(lengths) - common)
        cost = min(w >> BITS * field.width for w in best.values())
        shared = lows[0] >> BITS * (field.width - common)
        self.audit.append("".join(LETTERS[shared >> BITS * k & 7] for k in range(common - 1, -1, -1)))
        self.cost += cost
        self.field = left
        self.best = {q: ((w >> BITS * field.width) - cost << BITS * left.width) + ((w & field.mask) >> BITS * (field.width - common - left.width) & left.mask) for q, w in best.items()}

    def end(self) -> tuple[int, str]:
        """(cost, audit) of the best whole path, turns inserted at the end included."""
        wide = Field(self.field.width + 2)
        shift = BITS * 2
        best = wide.inserted({q: w << shift for q, w in self.best.items()})
        cost, audit = wide.read(min(w for q, w in best.items() if q in (START, AFTER_A)))
        return self.cost + cost, "".join(self.audit) + audit


def walk(audit: str, codes: bytes) -> Iterator[tuple[int, str, str]]:
    """(row that an edit is at or before, letter, the initial that it gives or '-')."""
    state, row = START, 0
    for letter in audit:
        if letter in "IR":
            state = TURN[state]
        elif letter == "K":
            state = KEEP[codes[row] % CLASSES][state]
        yield row, letter, ("a" if state == AFTER_A else "u") if letter in "IR" else "-"
        row += letter != "I"


# --- Spark ----------------------------------------------------------------------

def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, digest, code, seq: ``seq`` numbers the rows in order, with
    the number of the range in its high 31 bits."""
    base = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).when(F.col("role") == "", NOTHING).otherwise(OTHER)
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = ["conv", "turn", "role", "digest", "number"]
    dealt = base.select("*", digest.alias("digest"), (kind + CLASSES * fault).cast("int").alias("code"), F.monotonically_increasing_id().alias("number"))
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("number").withColumn("seq", F.monotonically_increasing_id())


def _coded(rows: DataFrame) -> DataFrame:
    """seq, conv, turn, code of the rows and marks (code -1) of those that are the first
    of their role and text, by ranges and in order, a mark before its row."""
    small = rows.select("seq", "conv", "turn", "code")
    firsts = rows.groupBy("conv", "digest").agg(F.min("seq").alias("seq"))
    marks = firsts.select("seq", *(F.lit(None).cast(small.schema[c].dataType).alias(c) for c in ("conv", "turn")), F.lit(-1).alias("code"))
    return small.unionByName(marks).withColumn("range", F.shiftright("seq", 33)).repartition("range").sortWithinPartitions("seq", "code").drop("range")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, first seq, codes, first turn, last turn, turns, paths) of each block."""
    mark = last = conv = None
    held: list[int] = []  # codes of the open block
    first_seq, turns, inner = 0, [], False
    for batch in batches:
        for seq, at, turn, code in zip(*(c.to_pylist() for c in batch.columns)):
            if code < 0:
                mark = seq
                continue
            new = last is None or seq != last + 1 or at != conv
            if held and (new or len(held) == BLOCK):
                yield conv, first_seq, bytes(held), *_turns(turns), block_paths(bytes(held), (START,) if inner else range(4))
                held, turns = [], []
            if not held:
                # a conversation that begins behind another of the same range has nothing before
                inner = new and last is not None and seq == last + 1
                first_seq = seq
            if mark != seq and code // CLASSES != BLANK:
                code = code % CLASSES + CLASSES * DUPLICATE
            held.append(code)
            turns.append(turn)
            last, conv = seq, at
    if held:
        yield conv, first_seq, bytes(held), *_turns(turns), block_paths(bytes(held), (START,) if inner else range(4))


def _turns(turns: list) -> tuple:
    """(first, last, number) of the turns that are not null."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _conversation(conv, blocks: list[tuple], joined: Joined) -> Iterator[tuple]:
    """A row for each block: its letters and roles; the last has the report as well."""
    cost, audit = joined.end()
    codes = b"".join(b[1] for b in blocks)
    kinds = [c % CLASSES for c in codes]
    faults = [sum(c // CLASSES == f for c in codes) for f in (BLANK, DUPLICATE, TRUNCATED)]
    illegal = sum(pair not in LEGAL for pair in zip(kinds, kinds[1:]))
    known = [b for b in blocks if b[4]]
    gaps = 0
    if known:
        distinct = sum(b[4] for b in known) - sum(a[3] == b[2] for a, b in zip(known, known[1:]))
        gaps = known[-1][3] - known[0][2] + 1 - distinct
    edits = walk(audit, codes)
    row, letter, role = next(edits, (None, "", ""))
    end = 0
    for k, b in enumerate(blocks):
        end += len(b[1])
        letters, roles = [], []
        while letter and (row < end or k == len(blocks) - 1):
            letters.append(letter)
            roles.append(role)
            row, letter, role = next(edits, (None, "", ""))
        report = (gaps, *faults, illegal, cost, audit) if k == len(blocks) - 1 else (None,) * 7
        yield conv, b[0], "".join(letters), "".join(roles), *report


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    conv, blocks, joined = None, [], Joined()
    for batch in batches:
        for at, first_seq, codes, first_turn, last_turn, turns, paths in zip(*(c.to_pylist() for c in batch.columns)):
            if blocks and at != conv:
                yield from _conversation(conv, blocks, joined)
                blocks, joined = [], Joined()
            conv = at
            blocks.append((first_seq, codes, first_turn, last_turn, turns))
            joined.append(paths)
    if blocks:
        yield from _conversation(conv, blocks, joined)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, seq, place, edit, role): inserts before a row have place 0 and 1, the row 2,
    inserts behind the last row 3 and 4."""
    for batch in batches:
        for conv, seq, letters, roles in zip(*(c.to_pylist() for c in batch.columns[:4])):
            place, rows = 0, len(letters) - letters.count("I")
            for letter, role in zip(letters, roles):
                name = {"u": "user", "a": "assistant"}.get(role)
                if letter == "I":
                    yield (conv, seq, place, letter, name) if rows else (conv, seq - 1, 3 + place, letter, name)
                    place += 1
                else:
                    yield conv, seq, 2, letter, name
                    seq, place, rows = seq + 1, 0, rows - 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, SHA-256 of its ``role:text`` lines) of rows in order."""
    conv = digest = None
    for batch in batches:
        for at, role, text in zip(*(c.to_pylist() for c in batch.columns[:3])):
            if digest is None or at != conv:
                if digest is not None:
                    yield conv, digest.hexdigest()
                conv, digest = at, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if digest is not None:
        yield conv, digest.hexdigest()


def _mapped(df: DataFrame, rows_of, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function from batches to tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _batches(rows_of(batches), arrow), schema)


def _fields(conv: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(rest).fields])


@dataclass(frozen=True)
class Repaired:
    """``report``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit of every
    conversation. ``edits``: conv, seq, place, edit, turn, role, text, one row an edit in
    order of (seq, place), deleted rows with the role and text that they had."""

    report: DataFrame
    edits: DataFrame

    @property
    def rows(self) -> DataFrame:
        """The repaired conversations."""
        return self.edits.where(F.col("edit") != "D")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    prepared(rows.sparkSession)
    conv_type = rows.schema[conv_col].dataType
    ordered = stored(_ordered(rows, conv_col, turn_col, role_col, text_col), "conversations")
    blocks = _mapped(_coded(ordered), _blocks, _fields(conv_type, "first_seq long, codes binary, first_turn long, last_turn long, turns long, paths array<string>"))
    whole = blocks.repartition("conv").sortWithinPartitions("conv", "first_seq")
    found = stored(_mapped(whole, _conversations, _fields(conv_type, "first_seq long, letters string, roles string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")), "repairs")
    edits = _mapped(found.select("conv", "first_seq", "letters", "roles"), _edits, _fields(conv_type, "seq long, place int, edit string, new_role string"))
    texts = ordered.select("seq", "turn", "role", "text")
    at = F.when(F.col("edit") != "I", F.col("seq"))
    joined = edits.withColumn("at", at).join(texts.withColumnRenamed("seq", "at"), "at", "left")
    whole_edits = joined.select("conv", "seq", "place", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return Repaired(found.where("audit is not null").drop("first_seq", "letters", "roles"), whole_edits)


def digests(rows: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of repaired rows: of their ``role:text``, joined by line ends.
    A digest is made in order by its nature: a conversation's texts stream through one
    task, sorted by Spark and a batch at a time."""
    ordered = rows.select("conv", "role", "text", "seq", "place").repartition("conv").sortWithinPartitions("conv", "seq", "place")
    return _mapped(ordered, _digests, _fields(rows.schema["conv"].dataType, "repaired_sha256 string"))


# --- the query's damage ------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with faults by crc32(``conv_id:turn``) modulo 20."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(text_of("role"))
    some = rows.withColumn("kind", kind).where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), "kind")
    return some.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage, repair and report: a row for every conv_id of the table."""
    own = conversations.select("conv_id", "turn", "role", "text")
    done = repair(damaged(own))
    ids = own.select("conv_id").distinct()
    report = ids.join(done.report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    whole = report.join(digests(done.rows), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit(""), 256)
    return whole.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
