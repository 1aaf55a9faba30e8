"""Repair of conversations whose rows are missing, repeated, blank or under a wrong role.

A sound conversation is empty or reads ``(system)? (user assistant)+``, by the initials of
its roles. Each row is kept (cost 0), given the role ``user`` or ``assistant`` (1) or deleted
(2), and empty user or assistant turns may be put in anywhere (5 each); blank rows and repeats
have to go, truncated rows that stay cost 5. The cheapest edits are found, of equally cheap
ones the least in ASCII order of ``D, I, K, R``.

What a row does to the four states (nothing yet, after system, after user, after assistant) is
a min-plus matrix of its symbol: its initial and its fault. Equal consecutive symbols are one
run, and a run is a power of the symbol's matrix, put together from cached binary powers.

Products of matrices may be bracketed at will, so no conversation is held by one task: rows are
range-partitioned in order, and each partition turns its piece of a conversation into runs and
one matrix. The few matrices of a conversation are folded from the back, which gives each
piece the costs behind it; then pieces choose their edits side by side, for every state in
which they can be entered, and a fold from the front says which was the case. Only edit letters
and a stream of rows (for rendering) meet by conversation.

NULL roles and texts are one space. Rows are ordered by turn, NULL first; rows of one turn by
role, the first 64 characters of the text, then its digest. An empty role has no initial: it is
never kept. Rows without ``conv_id`` form one conversation. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.session import shuffle_width, stage

#: Costs of the edits, and what an undeleted truncated row costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Characters that a complete text ends in, and white space.
ENDS, SPACE = ".!?", " \t\n\x0b\x0c\r"
#: Rows of a run whose choices are unrolled at a time.
UNROLLED = 4096
#: Characters of a text that order rows of one turn and role.
HEAD = 64

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60
#: Symbol 0 has to go; 1 to 8 are the initials s, u, a and others, each whole or truncated.
INITIALS = "sua"

Matrix = tuple[int, ...]


# -- the faults ------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the hash of ``conv_id:turn`` gives them.

    Of 20 hashes one each: the row is dropped, emptied, loses its ``. ! ?``, occurs twice, is
    given to the user. NULL counts as one space.
    """
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), blank),
    )
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return (
        _rows(conversations)
        .withColumn("fate", F.crc32(key) % 20)
        .where("fate <> 0")
        .select(
            "conv_id", "turn",
            F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
            text.alias("text"),
            F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def _rows(conversations: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
    )


def _said() -> Column:
    """Digest of role and text together."""
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _order(*more: str) -> list[Column]:
    names = ["conv_id", *more]
    return [*names, F.asc_nulls_first("turn"), "role", "head", "said"]


def faults(rows: DataFrame) -> DataFrame:
    """Narrow rows: their order, initial, and what is wrong with each.

    ``again`` is true for rows said in an earlier turn, ``tie`` for rows of the first of several
    turns: of those, all but the first are repeats as well, and they stand side by side. The
    turns of a repeated text are combined before they are shuffled.
    """
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = rows.select(
        "conv_id", "turn", "role", F.substring("text", 1, HEAD).alias("head"), _said().alias("said"),
        (stripped == "").alias("blank"),
        (~F.right(stripped, F.lit(1)).isin(*ENDS)).alias("truncated"),
    )
    repeated = (
        narrow.groupBy("conv_id", "said")
        .agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
        .select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first", "times")
    )
    met = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s"))
    same = F.col("turn").eqNullSafe(F.col("first.turn"))
    known = F.col("times").isNotNull()
    return narrow.join(repeated, met, "left").select(
        "conv_id", "turn", "role", "head", "said", "blank", "truncated",
        F.substring("role", 1, 1).alias("initial"),
        (known & ~same).alias("again"), (known & same).alias("tie"),
    )


# -- min-plus matrices -----------------------------------------------------------------


def _product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(
        min(min(a[4 * i + k] + b[4 * k + j] for k in range(4)), NEVER)
        for i in range(4)
        for j in range(4)
    )


def _matrix(entries: dict[tuple[int, int], int]) -> Matrix:
    return tuple(entries.get((i, j), NEVER) for i in range(4) for j in range(4))


#: Nothing, one or two turns put in; a third brings no state that fewer do not.
_ONE = _matrix({(s, NEXT[s]): INSERT for s in range(4)})
UNIT = _matrix({(s, s): 0 for s in range(4)})
INSERTED = tuple(min(t) for t in zip(UNIT, _ONE, _product(_ONE, _ONE)))
#: Least cost from each state to a sound end.
FINISH = tuple(min(INSERTED[4 * s + START], INSERTED[4 * s + ASSISTANT]) for s in range(4))


def edits(symbol: int, state: int) -> dict[str, tuple[int, int]]:
    """Cost and next state of each edit that a row allows in a state."""
    found = {"D": (DELETE, state)}
    if symbol:
        extra = TRUNCATED * ((symbol - 1) % 2)
        initial = (*INITIALS, "")[(symbol - 1) // 2]
        if state in KEPT.get(initial, {}):
            found["K"] = (extra, KEPT[initial][state])
        found["R"] = (REROLE + extra, NEXT[state])
    return found


@lru_cache(maxsize=None)
def _power(symbol: int, exponent: int) -> Matrix:
    """The matrix of ``2 ** exponent`` rows of a symbol."""
    if exponent:
        return _product(_power(symbol, exponent - 1), _power(symbol, exponent - 1))
    row: dict[tuple[int, int], int] = {}
    for state in range(4):
        for cost, after in edits(symbol, state).values():
            row[state, after] = min(cost, row.get((state, after), NEVER))
    return _product(INSERTED, _matrix(row))


@lru_cache(maxsize=1 << 14)
def run_matrix(symbol: int, count: int) -> Matrix:
    result, exponent = UNIT, 0
    while count:
        if count & 1:
            result = _product(result, _power(symbol, exponent))
        count >>= 1
        exponent += 1
    return result


@lru_cache(maxsize=1 << 16)
def _advanced(matrix: Matrix, symbol: int, count: int) -> Matrix:
    return _product(matrix, run_matrix(symbol, count))


def advance(matrix: Matrix, symbol: int, count: int) -> Matrix:
    """``matrix`` and then a run. Matrices that differ by a constant are computed once."""
    least = min(matrix)
    base = tuple(min(x - least, NEVER) if x < NEVER else NEVER for x in matrix)
    return tuple(min(x + least, NEVER) for x in _advanced(base, symbol, count))


@lru_cache(maxsize=1 << 16)
def _before(costs: Matrix, symbol: int, count: int) -> Matrix:
    power = run_matrix(symbol, count)
    return tuple(min(power[4 * i + k] + costs[k] for k in range(4)) for i in range(4))


def costs_before(costs: Matrix, symbol: int, count: int) -> Matrix:
    """Least costs in front of a run, given those behind it; every state can be left."""
    least = min(costs)
    found = _before(tuple(x - least for x in costs), symbol, count)
    return tuple(x + least for x in found)


@lru_cache(maxsize=1 << 16)
def _choose(symbol: int, after: Matrix, state: int) -> tuple[str, int]:
    here = _before(after, symbol, 1)
    chosen = ""
    while True:
        options = edits(symbol, state)
        options["I"] = (INSERT, NEXT[state])
        for edit in sorted(options):
            cost, then = options[edit]
            if cost + (here if edit == "I" else after)[then] == here[state]:
                break
        chosen, state = chosen + edit, then
        if edit != "I":
            return chosen, state


def choose(runs: list[tuple[int, int]], behind: Matrix, state: int) -> tuple[str, int]:
    """The cheapest, then least, edits of a piece entered in ``state``, and the state left.

    ``behind`` has the least costs after the piece. Choices of a run are unrolled block by
    block, from costs that binary powers give at the end of each block.
    """
    after = [behind]
    for symbol, count in reversed(runs):
        after.append(costs_before(after[-1], symbol, count))
    chosen: list[str] = []
    for (symbol, count), costs in zip(runs, after[-2::-1]):
        while count:
            block = min(count, UNROLLED)
            count -= block
            steps = [costs_before(costs, symbol, count) if count else costs]
            for _ in range(block - 1):
                steps.append(costs_before(steps[-1], symbol, 1))
            for step in reversed(steps):
                least = min(step)
                edit, state = _choose(symbol, tuple(x - least for x in step), state)
                chosen.append(edit)
    return "".join(chosen), state


def finish(state: int) -> str:
    """Turns put in behind the last row."""
    return "I" * (FINISH[state] // INSERT)


# -- pieces of conversations -----------------------------------------------------------

_PIECE = (
    "runs array<int>, matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, first_initial string, last_initial string, first_turn bigint, "
    "last_turn bigint, turns bigint"
)


class _Piece:
    """Rows of one conversation in one partition, in order."""

    def __init__(self) -> None:
        self.runs: list[list[int]] = []
        self.faults = [0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = None
        self.first_turn = self.last_turn = None
        self.said = None

    def add(self, turn, said, blank, truncated, initial, again, tie) -> None:
        repeat = again or (tie and self.said == (turn, said))
        self.said = (turn, said)
        if blank or repeat:
            symbol = 0
            self.faults[0 if blank else 1] += 1
        else:
            self.faults[2] += truncated
            place = INITIALS.find(initial) if initial else -1
            symbol = 1 + 2 * (place if place >= 0 else 3) + truncated
        if self.runs and self.runs[-1][0] == symbol and self.runs[-1][1] < 1 << 30:
            self.runs[-1][1] += 1
        else:
            self.runs.append([symbol, 1])
        if self.first is None:
            self.first = initial
        else:
            self.illegal += not sound(self.last, initial)
        self.last = initial
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn

    def row(self) -> tuple:
        matrix = UNIT
        for symbol, count in self.runs:
            matrix = advance(matrix, symbol, count)
        flat = [x for run in self.runs for x in run]
        return (
            flat, list(matrix), *self.faults, self.illegal, self.first, self.last,
            self.first_turn, self.last_turn, self.turns,
        )


def sound(left: str, right: str) -> bool:
    """Whether two adjacent initials may stand in a sound conversation."""
    return left + right in ("su", "ua", "au")


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, name, piece, made = None, None, None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if made:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*made), schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
            made.clear()

    for batch in batches:
        if schema is None:
            schema = _piece_schema(batch.schema)
        for conv, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if piece is None or (conv, part) != name:
                if piece is not None:
                    made.append((*name, *piece.row()))
                name, piece = (conv, part), _Piece()
            piece.add(*row)
        if len(made) > 1000:
            yield from flush()
    if piece is not None:
        made.append((*name, *piece.row()))
        yield from flush()


def _piece_schema(rows: pa.Schema) -> pa.Schema:
    big = pa.int64()
    return pa.schema(
        [("conv_id", rows.field(0).type), ("part", pa.int32()), ("runs", pa.list_(pa.int32())),
         ("matrix", pa.list_(big))]
        + [(n, big) for n in ("blank", "duplicate", "truncated", "illegal")]
        + [("first_initial", pa.string()), ("last_initial", pa.string())]
        + [(n, big) for n in ("first_turn", "last_turn", "turns")]
    )


def pieces(rows: DataFrame) -> DataFrame:
    """Every conversation's runs and matrix, partition by partition of the whole order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    placed = (
        faults(rows)
        .repartitionByRange(shuffle_width(rows.sparkSession), *_order())
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions(*_order())
        .select("conv_id", "part", "turn", "said", "blank", "truncated", "initial", "again", "tie")
    )
    return placed.mapInArrow(_summarise, f"conv_id {kind}, part int, {_PIECE}")


def _behind(matrices: list) -> list[list[int]]:
    """Least costs behind each piece, and before the first."""
    costs = [list(FINISH)]
    for matrix in reversed(matrices):
        last = costs[-1]
        costs.append([min(matrix[4 * i + k] + last[k] for k in range(4)) for i in range(4)])
    return costs[::-1]


def _with_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_behind([p["matrix"] for p in row]) for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(found, pa.list_(pa.list_(pa.int64())))],
            ["conv_id", "all", "costs"],
        )


def _with_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each state in which a piece may be entered: its edits and the state it is left in."""
    for batch in batches:
        audits, exits = [], []
        for flat, behind, entered in zip(*(c.to_pylist() for c in batch.columns[2:5])):
            runs = list(zip(flat[::2], flat[1::2]))
            made = [choose(runs, tuple(behind), s) for s in ([START] if entered else range(4))]
            audits.append([a for a, _ in made])
            exits.append([s for _, s in made])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(audits, pa.list_(pa.string())),
             pa.array(exits, pa.list_(pa.int32()))],
            ["conv_id", "part", "audits", "exits"],
        )


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the pieces of each conversation from the front."""
    for batch in batches:
        made = []
        for conv in range(batch.num_rows):
            row = batch.column(1)[conv].as_py()
            state, audit = START, []
            blank = duplicate = truncated = illegal = turns = 0
            least = last_turn = last = None
            for p in row:
                audit.append(p["audits"][state])
                state = p["exits"][state]
                blank += p["blank"]
                duplicate += p["duplicate"]
                truncated += p["truncated"]
                illegal += p["illegal"] + (last is not None and not sound(last, p["first_initial"]))
                last = p["last_initial"]
                turns += p["turns"]
                if p["first_turn"] is not None:
                    if least is None:
                        least = p["first_turn"]
                    turns -= p["first_turn"] == last_turn
                    last_turn = p["last_turn"]
            gaps = 0 if least is None else min(last_turn - least + 1 - turns, 2**63 - 1)
            made.append((gaps, blank, duplicate, truncated, illegal, row[0]["cost"], "".join(audit) + finish(state)))
        columns = [pa.array([m[k] for m in made], pa.int64()) for k in range(6)]
        columns.append(pa.array([m[6] for m in made], pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["conv_id", *_COUNTS, "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation with rows: ``gaps``, counts of faults, ``cost`` and ``audit``.

    ``gaps`` counts the turns missing between the first and last. A row's first fault counts:
    ``blank`` (white space only), ``duplicate`` (role and text seen earlier), ``truncated`` (does
    not end in ``. ! ?``). ``illegal`` counts adjacent roles that may not follow one another.
    What is gathered by conversation are its pieces, at most one a partition; the letters of
    the audit are one value of the result and so stand in one row.
    """
    spark_kind = rows.schema["conv_id"].dataType.simpleString()
    made = stage(pieces(rows), "pieces")
    folded = (
        made.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("part", "matrix"))).alias("all"))
        .mapInArrow(
            _with_costs,
            f"conv_id {spark_kind}, all array<struct<part:int,matrix:array<bigint>>>, "
            "costs array<array<bigint>>",
        )
    )
    costs = folded.select(
        F.col("conv_id").alias("c"),
        F.get(F.get("costs", F.lit(0)), F.lit(START)).alias("cost"),
        F.posexplode("all.part").alias("place", "p"),
        "costs",
    ).select("c", "p", "cost", "place", F.get("costs", F.col("place") + 1).alias("behind"))
    met = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    located = stage(made.join(costs, met).drop("c", "p", "matrix"), "located")
    chosen = located.select(
        "conv_id", "part", "runs", "behind", (F.col("place") == 0).alias("entered")
    ).mapInArrow(
        _with_edits, f"conv_id {spark_kind}, part int, audits array<string>, exits array<int>"
    )
    chosen = chosen.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "audits", "exits")
    fields = [
        "part", "cost", "audits", "exits", "blank", "duplicate", "truncated", "illegal",
        "first_initial", "last_initial", "first_turn", "last_turn", "turns",
    ]
    whole = (
        located.join(chosen, met)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))
    )
    counts = ", ".join(f"{n} bigint" for n in _COUNTS)
    return whole.mapInArrow(_compose, f"conv_id {spark_kind}, {counts}, audit string")


# -- repaired rows ---------------------------------------------------------------------


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation, behind a first one with its audit, become repaired rows."""
    conv = schema = None
    audit, at, state, place = "", 0, START, 0
    out: list[tuple] = []
    held = 0

    def emit(edit: str, role: str, text: str) -> None:
        nonlocal place, held
        out.append((conv, place, edit, role, text))
        place += 1
        held += len(text)

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            emit("I", ROLES[state], "")
            at += 1

    def flush() -> pa.RecordBatch:
        nonlocal held
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)]
        out.clear()
        held = 0
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        if schema is None:
            kind = batch.schema.field(0).type
            schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()),
                                ("role", pa.string()), ("text", pa.string())])
        for row in range(batch.num_rows):
            edits_of = batch.column(1)[row].as_py()
            if edits_of is not None:
                insert()
                conv, audit = batch.column(0)[row].as_py(), edits_of
                at, state, place = 0, START, 0
                continue
            insert()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            role = batch.column(2)[row].as_py()
            state = NEXT[state] if edit == "R" else KEPT[role[0]][state]
            emit(edit, ROLES[state] if edit == "R" else role, batch.column(3)[row].as_py())
            if held > 1 << 22 or len(out) > 10_000:
                yield flush()
    insert()
    if out:
        yield flush()


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the rows that are left, in order.

    One shuffle by conversation. A task streams its conversations in order and holds the edit
    letters of one, not its texts. Rows come out side by side and in order.
    """
    ordered = rows.select(
        "conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text",
        F.substring("text", 1, HEAD).alias("head"), _said().alias("said"),
    )
    empty = F.lit(None)
    heads = audited.select(
        "conv_id", "audit", empty.cast("long").alias("turn"), empty.cast("string").alias("role"),
        empty.cast("string").alias("text"), empty.cast("string").alias("head"),
        empty.cast("binary").alias("said"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    return (
        heads.unionByName(ordered)
        .withColumn("later", F.col("audit").isNull())
        .repartition("conv_id")
        .sortWithinPartitions(*_order("later"))
        .select("conv_id", "audit", "role", "text")
        .mapInArrow(_apply, f"conv_id {kind}, place bigint, edit string, role string, text string")
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, running, kind = None, None, None

    def done() -> pa.RecordBatch:
        columns = [pa.array([conv], kind), pa.array([running.hexdigest()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for row in range(batch.num_rows):
            if batch.column(1)[row].as_py() == 0:
                if running is not None:
                    yield done()
                conv, running = batch.column(0)[row].as_py(), hashlib.sha256()
            else:
                running.update(b"\n")
            for column, end in ((3, b":"), (4, b"")):
                running.update(batch.column(column)[row].as_py().encode() + end)
    if running is not None:
        yield done()


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` lines of repaired rows as ``repaired`` gives them.

    A digest has no parallel form: a conversation streams through one task, of which it needs
    a few bytes of memory.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")


def audit_report(conversations: DataFrame) -> DataFrame:
    """The audit of every conversation once its rows are damaged, and the repaired digest."""
    rows = damage(conversations)
    audited = stage(audits(rows), "audits")
    named = audited.withColumnRenamed("conv_id", "a")
    sums = digests(repaired(rows, audited)).withColumnRenamed("conv_id", "d")
    nothing = hashlib.sha256().hexdigest()
    return (
        conversations.select("conv_id")
        .distinct()
        .join(named, F.col("conv_id").eqNullSafe(F.col("a")), "left")
        .join(sums, F.col("conv_id").eqNullSafe(F.col("d")), "left")
        .select(
            "conv_id",
            *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in _COUNTS],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )


SQL = r"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations
), hashed AS (
    SELECT *, xor(list_reduce(
        list_prepend(4294967295::UBIGINT,
            list_transform(string_split(key, ''), lambda x: ascii(x)::UBIGINT)),
        lambda c, b: list_reduce(
            list_prepend(xor(c, b), list_transform(range(8), lambda k: k::UBIGINT)),
            lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))
        ), 4294967295::UBIGINT) % 20 AS fate
    FROM given
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hashed, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
    FROM damaged
), judged AS (
    SELECT *, left(role, 1) AS initial,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM numbered
), insertions(st, nst, cost, letters, lines) AS (
    VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
        (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
        (3, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']),
        (1, 3, 10, 'II', ['user:', 'assistant:']), (3, 3, 10, 'II', ['user:', 'assistant:']),
        (2, 2, 10, 'II', ['assistant:', 'user:'])
), changes(letter, initial, st, nst, cost) AS (
    VALUES ('D', NULL, 0, 0, 2), ('D', NULL, 1, 1, 2), ('D', NULL, 2, 2, 2), ('D', NULL, 3, 3, 2),
        ('R', NULL, 0, 2, 1), ('R', NULL, 1, 2, 1), ('R', NULL, 2, 3, 1), ('R', NULL, 3, 2, 1),
        ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0),
        ('K', 'a', 2, 3, 0)
), steps AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS st, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT s.conv_id, r.i, c.nst,
        s.cost + n.cost + c.cost + CASE WHEN r.fault = 'truncated' AND c.letter <> 'D' THEN 5 ELSE 0 END,
        s.audit || n.letters || c.letter,
        s.lines || n.lines || CASE c.letter WHEN 'D' THEN []
            WHEN 'K' THEN [r.role || ':' || r.text]
            ELSE [CASE c.nst WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END
    FROM steps s
    JOIN judged r ON r.conv_id = s.conv_id AND r.i = s.i + 1
    JOIN insertions n ON n.st = s.st
    JOIN changes c ON c.st = n.nst AND (c.initial IS NULL OR c.initial = r.initial)
        AND (c.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    QUALIFY row_number() OVER (PARTITION BY s.conv_id, c.nst
        ORDER BY s.cost + n.cost + c.cost + CASE WHEN r.fault = 'truncated' AND c.letter <> 'D' THEN 5 ELSE 0 END,
            s.audit || n.letters || c.letter) = 1
), ended AS (
    SELECT s.conv_id, s.cost + n.cost AS cost, s.audit || n.letters AS audit, s.lines || n.lines AS lines
    FROM steps s JOIN insertions n ON n.st = s.st AND n.nst IN (0, 3)
    WHERE s.i = coalesce((SELECT max(j.i) FROM judged j WHERE j.conv_id = s.conv_id), 0)
    QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + n.cost, s.audit || n.letters) = 1
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, e.cost::BIGINT AS cost, e.audit,
    sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c USING (conv_id)
"""
