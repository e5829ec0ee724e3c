"""Structure repair of conversations by a dynamic program over a grammar.

A conversation becomes a string of symbols, one per row: the initial of its role
with its fault. Re-Pair builds one grammar over all such strings: the commonest
pairs of neighbouring symbols become symbols themselves, round after round. The
repaired roles must follow ``(s?(ua)+)?``, an automaton of four states, so what a
symbol's rows cost between any two states is a 4 x 4 matrix, and a rule's matrix
is the min-plus product of its two sides. It is worked out once, bottom-up, and
serves every conversation that holds the symbol. Beside each cost stands an audit
rope: not the letters of the edits but the state in the middle, from which the
two sides' ropes follow, and the letters' rank among the matrix's entries, which
is all that ties need. No entry's letters begin another's, since all cover the
same rows and end with a row's own edit, so ranks of concatenations are ranks of
pairs. Long conversations are cut into blocks whose matrices are multiplied.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from ..session import stored
from . import textscan as ts

#: Rows of a block at most; the grid of blocks runs over the whole table, so a short conversation can lie in two.
BLOCK = 1024
#: Rounds of pairing and new symbols a round at most; what is left unpaired is multiplied symbol by symbol.
ROUNDS, PER_ROUND = 6, 128
#: Distinct strings a worker remembers the matrices of.
KEPT = 20_000

STATES = 4  # nothing yet, after s, after u, after a
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
NEVER = 1 << 40
#: State after one more role, by state and initial.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The only role that may be put in after a state, and its initial.
ADDED = {0: ("user", "u"), 1: ("user", "u"), 2: ("assistant", "a"), 3: ("user", "u")}
#: Inserts that end a conversation from a state.
CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}
#: Rows that must go, sound rows by initial, and unfinished rows by initial.
GONE, SOUND, CUT = "x", "suao", "SUAO"


class Matrix:
    """Least cost from state to state, its letters' rank, and for a product the state in the middle."""

    def __init__(self, cost: np.ndarray, rank: np.ndarray, mid: np.ndarray | None = None, letters: dict | None = None, sides: tuple | None = None):
        self.cost, self.rank, self.mid, self.letters, self.sides = cost, rank, mid, letters, sides

    def __matmul__(self, other: "Matrix") -> "Matrix":
        cost = self.cost[:, :, None] + other.cost[None, :, :]
        key = cost * 256 + self.rank[:, :, None] * 16 + other.rank[None, :, :]
        mid = key.argmin(axis=1)
        best = np.take_along_axis(key, mid[:, None, :], 1)[:, 0, :]
        _, rank = np.unique(best & 255, return_inverse=True)
        return Matrix(np.minimum(best >> 8, NEVER), rank.reshape(STATES, STATES), mid, sides=(self, other))

    def audit(self, p: int, q: int) -> str:
        """The letters of the entry, read off its rope."""
        out, todo = [], [(self, p, q)]
        while todo:
            m, p, q = todo.pop()
            if m.letters is not None:
                out.append(m.letters[p, q])
            else:
                r = int(m.mid[p, q])
                todo += [(m.sides[1], r, q), (m.sides[0], p, r)]
        return "".join(out)


def terminal(symbol: str) -> Matrix:
    """Inserts, as few as may be, and then the row's own edit."""
    reach = {(p, p): 0 for p in range(STATES)}
    for p in range(STATES):
        at = p
        for k in (1, 2, 3):
            at = NEXT[at, ADDED[at][1]]
            reach.setdefault((p, at), k)
    extra = UNFINISHED if symbol in CUT else 0
    found: dict = {}
    for (p, r), k in reach.items():
        edits = [(DELETE, "D", r)]
        if symbol != GONE:
            edits += [(KEEP + extra, "K", NEXT[r, symbol.lower()])] if (r, symbol.lower()) in NEXT else []
            edits += [(REROLE + extra, "R", NEXT[r, i]) for i in "ua" if (r, i) in NEXT]
        for cost, letter, q in edits:
            new = (cost + INSERT * k, "I" * k + letter)
            found[p, q] = min(found.get((p, q), new), new)
    order = sorted({letters for _, letters in found.values()})
    cost, rank = np.full((STATES, STATES), NEVER, np.int64), np.zeros((STATES, STATES), np.int64)
    for (p, q), (c, letters) in found.items():
        cost[p, q], rank[p, q] = c, order.index(letters)
    return Matrix(cost, rank, letters={at: letters for at, (_, letters) in found.items()})


class Grammar:
    """Rules in the order they were made, and one matrix per symbol."""

    def __init__(self, rounds: list[list[tuple[str, str]]]):
        self.rounds = rounds
        self.matrix = {c: terminal(c) for c in GONE + SOUND + CUT}
        for rules in rounds:
            for pair, symbol in rules:
                self.matrix[symbol] = self.matrix[pair[0]] @ self.matrix[pair[1]]
        self.known = lru_cache(KEPT)(self._of)

    def __reduce__(self):
        return Grammar, (self.rounds,)

    def shortened(self, text: str) -> str:
        for rules in self.rounds:
            for pair, symbol in rules:
                text = text.replace(pair, symbol)
        return text

    def _of(self, text: str) -> Matrix:
        """The matrix of a whole string, by halves of its shortened form."""
        parts = [self.matrix[c] for c in self.shortened(text)]
        while len(parts) > 1:
            parts = [parts[i] @ parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


def _chosen(pairs: list[str], most: int) -> list[str]:
    """The commonest pairs that cannot overlap each other: no symbol ends one and begins another."""
    begins, ends, out = set(), set(), []
    for p in pairs:
        if len(out) == most:
            break
        if p[0] == p[1]:
            if p[0] in begins or p[0] in ends:
                continue
        elif p[0] in ends or p[1] in begins:
            continue
        begins.add(p[0])
        ends.add(p[1])
        out.append(p)
    return out


def grammar(strings: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Grammar:
    """Re-Pair over distinct strings (``seq``, ``n`` times each); a round replaces the commonest pairs that do not overlap.

    The driver sees at most 4 * ``per_round`` pairs a round, never strings.
    """
    made, symbol = [], 0xE000  # the private use area
    for _ in range(rounds):
        pairs = (
            strings.filter(F.length("seq") > 1).select("n", F.explode(F.expr("transform(sequence(1, length(seq) - 1), i -> substring(seq, i, 2))")).alias("pair"))
            .groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(4 * per_round))
        chosen = _chosen([r["pair"] for r in pairs.collect()], per_round)
        if not chosen:
            break
        rules = [(p, chr(symbol + i)) for i, p in enumerate(chosen)]
        symbol += len(rules)
        made.append(rules)
        text = F.col("seq")
        for pair, new in rules:
            text = F.replace(text, F.lit(pair), F.lit(new))
        strings = stored(strings.select(text.alias("seq"), "n"), "paired")
    return Grammar(made)


def _facts(turns: DataFrame) -> DataFrame:
    """Rows with what can be told from each alone; a null role or text is one space."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return (
        turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
        .withColumn("last", last).withColumn("digest", F.md5(F.col("text").cast("binary")))
        .select("conv_id", "turn", "role", "text", "digest", (F.col("last") == "").alias("blank"), (~F.col("last").isin(".", "!", "?")).alias("cut")))


def _in_order(turns: DataFrame) -> DataFrame:
    """All rows by conversation, turn (nulls first), role and text, numbered through (``pos``) and cut into blocks."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    return global_rank(_facts(turns), order, "pos").withColumn("block", F.floor(F.col("pos") / BLOCK))


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per conversation and block: its first place, its symbols and its faults."""
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    known = rows.select("conv_id", "block", "pos", "role", "blank", "cut").join(first, "pos", "left")
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("cut"), "t").otherwise(".")
    symbol = (
        F.when(F.col("fault").isin("b", "d"), GONE)
        .otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o")))
    symbol = F.when(F.col("fault") == "t", F.upper(symbol)).otherwise(symbol)
    return (
        known.withColumn("fault", fault).withColumn("symbol", symbol).groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "symbol", "fault"))).alias("rows"))
        .select("conv_id", "block", F.expr("rows[0].pos").alias("pos"), F.expr("array_join(rows.symbol, '')").alias("seq"), F.expr("array_join(rows.fault, '')").alias("faults")))


def _runs(columns: list[list]):
    """Rows of sorted columns, grouped by the first: (value, [rows])."""
    begin = 0
    for i in range(1, len(columns[0]) + 1):
        if i == len(columns[0]) or columns[0][i] != columns[0][begin]:
            yield columns[0][begin], list(zip(*(c[begin:i] for c in columns[1:])))
            begin = i


def _solve(rules: Grammar, blocks: list[tuple[int, int, str, str]]) -> list[tuple]:
    """(pos, block, faults, letters, state before, cost of the whole) for each block of one conversation, the cost with the first only."""
    matrices = [rules.known(b[2]) for b in blocks]
    # the best way to each state, and for every block the four states to come back by
    cost, rank, back = np.array([0, NEVER, NEVER, NEVER]), np.zeros(STATES, np.int64), []
    for m in matrices:
        key = (cost[:, None] + m.cost) * 256 + rank[:, None] * 16 + m.rank
        via = key.argmin(axis=0)
        best = key[via, np.arange(STATES)]
        cost, rank = np.minimum(best >> 8, NEVER), np.unique(best & 255, return_inverse=True)[1]
        back.append(via)
    total, _, q = min((int(cost[q]) + INSERT * k, int(rank[q]), q) for q, k in CLOSING.items())
    closing, out = "I" * CLOSING[q], []
    for (pos, block, _, faults), m, via in zip(reversed(blocks), reversed(matrices), reversed(back)):
        p = int(via[q])
        out.append((pos, block, faults, m.audit(p, q) + closing, p, None))
        closing, q = "", p
    out.reverse()
    return [out[0][:5] + (total,)] + out[1:]


PIECE = ["conv_id", "pos", "block", "faults", "audit", "state", "cost"]


def _solved(rules: Grammar):
    """The letters of every block, from blocks sorted by conversation and place; a conversation's strings are held, one letter a row."""
    def run(batches):
        current, held, kind = None, [], None

        def piece(conv, blocks):
            rows = _solve(rules, blocks)
            columns = [[conv] * len(rows), *map(list, zip(*rows))]
            types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], PIECE)

        for b in batches:
            kind = b.column("conv_id").type
            done = []
            for conv, rows in _runs([b.column(c).to_pylist() for c in ("conv_id", "pos", "block", "seq", "faults")]):
                if held and conv != current:
                    done.append(piece(current, held))
                    held = []
                current = conv
                held += rows
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if held:
            yield piece(current, held)
    return run


def _with_pieces(turns: DataFrame, by: list[str]) -> DataFrame:
    """Rows and the pieces of their audits in one frame, dealt by ``by`` and sorted, each piece before its block's rows."""
    rows = _in_order(turns)
    blocks = stored(_blocks(rows), "blocks")
    rules = grammar(stored(blocks.groupBy("seq").agg(F.count("*").alias("n")), "strings"))
    kind = dict(turns.dtypes)["conv_id"]
    pieces = (
        blocks.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
        .mapInArrow(_solved(rules), f"conv_id {kind}, pos long, block long, faults string, audit string, state int, cost long"))
    if by != ["conv_id"]:
        pieces = stored(pieces, "pieces")
    both = (
        rows.select("conv_id", "pos", "block", "turn", "role", "text").withColumn("place", F.lit(1))
        .unionByName(pieces.withColumn("place", F.lit(0)), allowMissingColumns=True))
    return both.repartition(*by).sortWithinPartitions("conv_id", "pos", "place")


def _edits(columns: dict[str, list], state: dict):
    """('piece' | 'row', ...) and every edit of a batch in order: ('edit', conversation, letter, role, text)."""
    for conv, pos, turn, role, text, place, faults, audit, before, cost in zip(*(columns[c] for c in ("conv_id", "pos", "turn", "role", "text", "place", "faults", "audit", "state", "cost"))):
        if not place:
            yield "piece", conv, pos, faults, audit, cost
            state["audit"], state["at"], state["state"] = audit, 0, before
            yield from _inserts(conv, state)
            continue
        yield "row", conv, pos, turn, role
        letter = state["audit"][state["at"]]
        state["at"] += 1
        if letter == "R":
            role = ADDED[state["state"]][0]
        if letter != "D":
            state["state"] = NEXT[state["state"], role[:1]]
        yield "edit", conv, letter, role, text
        yield from _inserts(conv, state)


def _inserts(conv, state: dict):
    while state["at"] < len(state["audit"]) and state["audit"][state["at"]] == "I":
        role, initial = ADDED[state["state"]]
        state["state"] = NEXT[state["state"], initial]
        state["at"] += 1
        yield "edit", conv, "I", role, ""


def _columns(b: pa.RecordBatch) -> dict[str, list]:
    return {c: b.column(c).to_pylist() for c in b.schema.names}


def _repaired(batches):
    state: dict = {}
    at = step = None
    for b in batches:
        columns, out = _columns(b), []
        for kind, *x in _edits(columns, state):
            if kind == "edit":
                step += 1
                out.append((x[0], at, step, *x[1:]))
            elif x[1] != at:  # a block's piece has the place of its first row, whose edit follows the inserts before it
                at, step = x[1], -1
        columns = list(zip(*out)) if out else [[]] * 6
        types = [b.column("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "pos", "step", "edit", "role", "text"])


class _Digest:
    """One conversation's figures while its rows go by."""

    def __init__(self, conv):
        self.conv, self.sha, self.parts, self.audit, self.cost = conv, hashlib.sha256(), 0, [], 0
        self.faults = {"b": 0, "d": 0, "t": 0}
        self.least = self.most = self.turn = self.role = None
        self.distinct = self.illegal = 0

    def piece(self, pos, faults, audit, cost):
        for f in self.faults:
            self.faults[f] += faults.count(f)
        self.audit.append(audit)
        self.cost += cost or 0

    def row(self, pos, turn, role):
        if turn is not None and turn != self.turn:
            self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn
            self.distinct += 1
        if self.role is not None:
            self.illegal += self.role + role[:1] not in ("su", "ua", "au")
        self.role = role[:1]

    def edit(self, letter, role, text):
        if letter != "D":
            self.sha.update(f"{chr(10) if self.parts else ''}{role}:{text}".encode())
            self.parts += 1

    def values(self):
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.distinct, (1 << 63) - 1)
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _digested(batches):
    state, now, kind = {}, None, None

    def result(done):
        columns = list(zip(*done)) if done else [[]] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *[pa.int64()] * 6, pa.string(), pa.string()])], ["conv_id", *FIGURES, "audit", "repaired_sha256"])

    for b in batches:
        kind, done = b.column("conv_id").type, []
        for what, conv, *x in _edits(_columns(b), state):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.values())
                now = _Digest(conv)
            getattr(now, what)(*x)
        yield result(done)
    if now is not None:
        yield result([now.values()])


def repaired(turns: DataFrame) -> DataFrame:
    """Every edit of the cheapest repair: conv_id, pos, step, edit (K, R, D or I), role and text; sort a conversation by pos and step.

    ``turns`` holds conv_id, turn, role and text; other columns are not read. A
    conversation's rows go by turn (nulls first), then role, then the MD5 of the
    text; a null role or text is one space, a null conv_id a conversation. A row
    is blank without a character other than ASCII white space, else duplicate if its
    role and text were there before, else truncated if its last such character
    is none of ``.!?``. Blank and duplicate rows are deleted; an insert's text is
    empty. Equal cost is settled by the edits' letters. An empty table gives none.
    """
    both = _with_pieces(turns, ["conv_id", "block"])
    kind = dict(turns.dtypes)["conv_id"]
    ts.small_batches(turns.sparkSession, 4096)
    return both.mapInArrow(_repaired, f"conv_id {kind}, pos long, step long, edit string, role string, text string")


def repair_digest(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """What was wrong with each conversation, and its repair: one row per conv_id of ``every`` (of ``turns`` by default).

    Returns conv_id, gaps (numbers missing between the least and the largest
    turn), blank, duplicate, truncated, illegal (neighbours whose roles do not
    follow each other), cost, audit and repaired_sha256 (of ``role:text`` rows of
    the repair, joined by line feeds). A conversation without rows has zeros, an
    empty audit and the digest of an empty text. Rows, ties and nulls are as in
    ``repaired``. A digest of one text is taken in order, so a conversation's
    rows stream through one task; only its audit is held there.
    """
    ts.small_batches(turns.sparkSession, 4096)
    kind = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in FIGURES) + ", audit string, repaired_sha256 string"
    found = _with_pieces(turns, ["conv_id"]).mapInArrow(_digested, schema)
    if every is None:
        return found
    named = every.select(F.col("conv_id").alias("_id")).distinct()
    return named.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in FIGURES], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties the text, 2 takes its full stops and marks, 3 repeats the row, 4 makes it the user's.

    Nulls in conv_id and turn count as one space there, a null role or text becomes one.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce(F.col("text").cast("string"), space), F.coalesce(F.col("role").cast("string"), space)
    return (
        turns.select("conv_id", "turn", "role", "text").withColumn("_d", F.crc32(name.cast("binary")) % 20).filter("_d <> 0")
        .select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(role).alias("role"),
                F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
        .drop("_copy"))
