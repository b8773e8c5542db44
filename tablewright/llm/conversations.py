"""Repair of the structure of conversations by cheapest edits, ties by prefix-doubling path ranking.

A conversation should read ``(system? (user assistant)+)?``. Its rows are numbered by one
range sort of the whole table and cut into blocks of ``BLOCK`` rows, so a conversation of
any length is spread over tasks. A row counts as a step over the four states of that
pattern. Every block multiplies its steps to a matrix of costs from state to state; the
matrices of a conversation, one per block, give the cost that remains behind each block.
With it a block knows which edits lie on cheapest paths. These arcs rank the nodes (row,
state) by the first 1, 2, 4, ... letters of their audits; the ranks choose one arc per node,
and doubled pointers read the path off from every state the block may be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.tables import settled
from tablewright.operators.ordering import with_position

# Rows of a block; its cost matrix is all that another task sees of it.
BLOCK = 2048
# Rows taken through the kernels at once.
ROWS = 1 << 16
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
_FAR = 1 << 60

# States: nothing yet, after the system row, after a user row, after an assistant row.
# Initials: system, user, assistant, any other.
_AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
# Where a row written by us leads: user, except after a user row.
_NEXT = np.array([2, 2, 3, 2])
_ENDS = np.array([True, False, False, True])
# Bits of a row's symbol above its initial.
_BLANK, _OPEN, _REPEATED = 4, 8, 16
# Letters of an audit in ASCII order; 0 is its end.
_LETTERS = "\0DIKR"
_D, _I, _K, _R = range(1, 5)


def _inserted() -> np.ndarray:
    """Cheapest inserts from state to state."""
    out = np.full((4, 4), _FAR)
    for q in range(4):
        at, cost = q, 0
        for _ in range(3):
            out[q, at] = min(out[q, at], cost)
            at, cost = _NEXT[at], cost + INSERT
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacks of cost matrices: smallest sums."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), _FAR)


def _costs() -> np.ndarray:
    """(symbol, letter, state): cost of an edit of one row, ``_FAR`` where it is not allowed."""
    out = np.full((32, 5, 4), _FAR)
    out[:, _D] = DELETE
    for symbol in range(_BLANK):
        for open_ in (0, _OPEN):
            extra = UNFINISHED if open_ else 0
            out[symbol | open_, _K] = np.where(_AFTER[:, symbol] >= 0, KEEP + extra, _FAR)
            out[symbol | open_, _R] = REROLE + extra
    return out


def _steps() -> np.ndarray:
    """(symbol, state, state): cheapest inserts and one edit of a row."""
    edits = np.full((32, 4, 4), _FAR)
    for symbol in range(32):
        for q in range(4):
            for letter, to in ((_D, q), (_K, _AFTER[q, symbol & 3]), (_R, _NEXT[q])):
                if _COSTS[symbol, letter, q] < _FAR:
                    edits[symbol, q, to] = min(edits[symbol, q, to], _COSTS[symbol, letter, q])
    return _product(_INSERTED[None], edits)


_INSERTED, _COSTS = _inserted(), _costs()
_STEPS = _steps()
_LAST = _INSERTED[:, _ENDS].min(axis=1)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32 of conv_id and turn; nulls in role and text become a space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fault.alias("f")).where("f <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, position, block): rows by conversation and turn, nulls first.

    Rows of one turn follow by role and text. Rows equal in all are kept apart by where they
    were read, so that even a very frequent row spreads over the sort.
    """
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.monotonically_increasing_id().alias("_row"))
    placed = with_position(rows, ["conv_id", "turn", "role", "text", "_row"], small=0)
    return placed.drop("_row").withColumn("block", F.floor(F.col("position") / BLOCK))


def _symbol() -> Column:
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, F.lit(i)) for i, c in enumerate("sua")], F.lit(3))
    return (initial + F.when(trimmed == "", F.lit(_BLANK)).otherwise(F.lit(0))
            + F.when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), F.lit(0)).otherwise(F.lit(_OPEN)))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, block, start, symbols): the rows of every block, one byte each.

    A row repeats an earlier one of its conversation if that has its role and text; the
    earliest of each is found by a grouped minimum, which combines before the shuffle.
    """
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = rows.groupBy("conv_id", same.alias("same")).agg(F.min("position").alias("first"))
    firsts = firsts.select("conv_id", F.floor(F.col("first") / BLOCK).alias("block"), F.lit(None).cast("long").alias("code"), "first")
    codes = rows.select("conv_id", "block", (F.col("position") * 32 + _symbol()).cast("long").alias("code"), F.lit(None).cast("long").alias("first"))
    blocks = codes.union(firsts).groupBy("conv_id", "block").agg(F.collect_list("code").alias("codes"), F.collect_list("first").alias("firsts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            starts, found = [], []
            for codes, firsts in zip(frame["codes"], frame["firsts"]):
                codes = np.sort(np.asarray(codes, np.int64))
                again = ~np.isin(codes >> 5, np.asarray(firsts, np.int64))
                starts.append(int(codes[0] >> 5))
                found.append(((codes & 31) | np.where(again, _REPEATED, 0)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"conv_id": frame["conv_id"].astype("Int64"), "block": frame["block"], "start": starts, "symbols": found})

    return blocks.mapInPandas(run, "conv_id long, block long, start long, symbols binary")


def _lots(frame: pd.DataFrame, rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """Parts of a frame of blocks with about ``rows`` rows, longest blocks first."""
    lengths = frame["symbols"].str.len()
    lot = (lengths.cumsum() // rows).to_numpy()
    for _, part in frame.groupby(lot, sort=False):
        yield part.iloc[np.argsort(-part["symbols"].str.len().to_numpy(), kind="stable")]


def _by_place(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(t, blocks that have a row t), for lengths in descending order."""
    for t in range(int(lengths[0]) if len(lengths) else 0):
        yield t, int(np.searchsorted(-lengths, -t, "left"))


def block_matrices(found: list[bytes]) -> np.ndarray:
    """(block, state, state): cheapest edits of each block; blocks come longest first."""
    lengths = np.array([len(s) for s in found])
    flat, first = np.frombuffer(b"".join(found), np.uint8), np.cumsum(lengths) - lengths
    out = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, _FAR), (len(found), 4, 4)).copy()
    for t, n in _by_place(lengths):
        out[:n] = _product(out[:n], _STEPS[flat[first[:n] + t]])
    return out


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in _lots(frame):
            matrices = block_matrices(part["symbols"].tolist())
            rows = []
            for found, matrix in zip(part["symbols"], matrices):
                s = np.frombuffer(found, np.uint8)
                blank = (s & _BLANK) > 0
                repeated = ~blank & ((s & _REPEATED) > 0)
                open_ = ~blank & ~repeated & ((s & _OPEN) > 0)
                initial = (s & 3).astype(int)
                pair = initial[:-1] * 4 + initial[1:]
                rows.append([*matrix.ravel().tolist(), blank.sum(), repeated.sum(), open_.sum(), (~np.isin(pair, _LEGAL)).sum(), initial[0], initial[-1]])
            yield pd.DataFrame({"conv_id": part["conv_id"].astype("Int64"), "block": part["block"], "summary": rows})


# Pairs of initials that may follow each other: system user, user assistant, assistant user.
_LEGAL = (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Totals of every conversation and the costs that remain behind each of its blocks."""
    for frame in frames:
        rows = []
        for conv_id, parts in zip(frame["conv_id"].astype("Int64"), frame["parts"]):
            table = np.array([p["summary"] for p in parts], np.int64)
            illegal = table[:, 19].sum() + (~np.isin(table[:-1, 21] * 4 + table[1:, 20], _LEGAL)).sum()
            behind, at = [], _LAST
            for row in table[::-1]:
                behind.append(at.tolist())
                at = np.minimum((row[:16].reshape(4, 4) + at).min(axis=1), _FAR)
            rows.append((conv_id, *table[:, 16:19].sum(axis=0).tolist(), int(illegal), int(at[0]), [p["block"] for p in parts], behind[::-1]))
        out = pd.DataFrame(rows, columns=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "blocks", "behind"])
        out["conv_id"] = out["conv_id"].astype("Int64")
        yield out


class _Paths:
    """The least cheapest path from every node of some blocks, which come longest first.

    Nodes are (block, row, state), and one more row per block for what lies behind it.
    """

    def __init__(self, found: list[bytes], behind: np.ndarray, last: np.ndarray):
        lengths = np.array([len(s) for s in found])
        self.first = np.cumsum(lengths + 1) - lengths - 1
        rows = int((lengths + 1).sum())
        symbols = np.zeros(rows, np.int64)
        inner = np.ones(rows, bool)
        inner[self.first + lengths] = False
        symbols[inner] = np.frombuffer(b"".join(found), np.uint8)
        remains = np.zeros((rows, 4), np.int64)
        remains[self.first + lengths] = behind
        for t, n in reversed(list(_by_place(lengths))):
            at = self.first[:n] + t
            remains[at] = np.minimum((_STEPS[symbols[at]] + remains[at + 1][:, None, :]).min(axis=2), _FAR)
        self._arcs(symbols, inner, remains, self.first[last] + lengths[last])
        self._double()

    def _arcs(self, symbols, inner, remains, finals) -> None:
        """Arcs on cheapest paths: (node, letter, target)."""
        row, q = np.divmod(np.arange(remains.size), 4)
        target = np.full((5, remains.size), -1)
        cost = np.full((5, remains.size), _FAR)
        here = inner[row]
        state = {_D: q, _K: _AFTER[q, symbols[row] & 3], _R: _NEXT[q]}
        for letter, to in state.items():
            ok = here & (_COSTS[symbols[row], letter, q] < _FAR)
            target[letter, ok] = (row[ok] + 1) * 4 + to[ok]
            cost[letter, ok] = _COSTS[symbols[row[ok]], letter, q[ok]] + remains.ravel()[target[letter, ok]]
        # Behind the last row of a conversation only inserts are left; behind other blocks the next one begins.
        can = here.copy()
        can.reshape(-1, 4)[finals] = ~_ENDS
        target[_I, can] = row[can] * 4 + _NEXT[q[can]]
        cost[_I, can] = INSERT + remains.ravel()[target[_I, can]]
        letter, node = np.nonzero((cost == remains.ravel()) & (remains.ravel() < _FAR))
        self.node, self.letter, self.target, self.nodes = node, letter, target[letter, node], remains.size

    def _double(self) -> None:
        """Rank nodes by the first 1, 2, 4, ... letters of their audits, then let the ranks choose among arcs."""
        order = np.lexsort((self.letter, self.node))
        least, arc = np.unique(self.node[order], return_index=True)
        pointer, rank = np.arange(self.nodes), np.zeros(self.nodes, np.int64)
        pointer[least], rank[least] = self.target[order][arc], self.letter[order][arc]
        while True:
            ahead = pointer[pointer]
            if (ahead == pointer).all():
                break
            _, rank = np.unique(rank * (self.nodes + 5) + rank[pointer], return_inverse=True)
            pointer = ahead
        # One arc per node: the least letter, then the least audit behind it.
        order = np.lexsort((rank[self.target], self.letter, self.node))
        chosen = order[np.unique(self.node[order], return_index=True)[1]]
        step, self.letters, far = np.arange(self.nodes), np.zeros(self.nodes, np.int64), np.zeros(self.nodes, np.int64)
        step[self.node[chosen]], self.letters[self.node[chosen]] = self.target[chosen], self.letter[chosen]
        far[self.node[chosen]] = 1
        self.pointers = [step]
        while True:
            last = self.pointers[-1]
            far = far + far[last]
            ahead = last[last]
            if (ahead == last).all():
                break
            self.pointers.append(ahead)
        self.end, self.far = last, far

    def audits(self, block: int, states: list[int]) -> tuple[list[str], list[int]]:
        """Audit and exit state of a block entered in each of ``states``.

        Letters of the audit: D, K, and U or A for a row that becomes user or assistant;
        u and a for inserted rows.
        """
        start = self.first[block] * 4 + np.array(states)
        far = self.far[start]
        at = np.repeat(start, far)
        step = np.arange(far.sum()) - np.repeat(np.cumsum(far) - far, far)
        for k, pointer in enumerate(self.pointers):
            at = np.where(step >> k & 1, pointer[at], at)
        text = "".join(_WRITTEN[self.letters[at], at % 4])
        ends = np.cumsum(far).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends)], (self.end[start] % 4).tolist()


# What an audit's letter means in each state.
_WRITTEN = np.array([list("    "), list("DDDD"), list("uuau"), list("KKKK"), list("UUAU")])


def _traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in _lots(frame):
            paths = _Paths(part["symbols"].tolist(), np.array(part["behind"].tolist(), np.int64), part["is_last"].to_numpy(bool))
            # Only the first block of a conversation is surely entered with nothing before it.
            both = [paths.audits(i, [0] if first else [0, 1, 2, 3]) for i, first in enumerate(part["is_first"])]
            yield pd.DataFrame({"conv_id": part["conv_id"].astype("Int64"), "block": part["block"], "start": part["start"],
                                "audits": [a for a, _ in both], "exits": [e for _, e in both]})


def _walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The audit of every block in the state it is entered in."""
    for frame in frames:
        rows = []
        for conv_id, parts in zip(frame["conv_id"].astype("Int64"), frame["parts"]):
            state = 0
            for part in parts:
                rows.append((conv_id, part["block"], part["start"], part["audits"][state]))
                state = int(part["exits"][state])
        out = pd.DataFrame(rows, columns=["conv_id", "block", "start", "edits"])
        out["conv_id"] = out["conv_id"].astype("Int64")
        yield out


def _parts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("parts"))


def plan_repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals per conversation and the edits of every block of ``ordered`` rows.

    Totals: conv_id, blank, duplicate, truncated, illegal, cost. Edits: conv_id, block,
    start (position of its first row), edits (see ``_Paths.audits``).
    """
    blocks = settled(symbols(rows), "blocks")
    summaries = blocks.mapInPandas(_summaries, "conv_id long, block long, summary array<long>")
    totals = settled(_parts(summaries, "summary").mapInPandas(
        _settle, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, blocks array<long>, behind array<array<long>>"), "totals")
    each = totals.select("conv_id", F.size("blocks").alias("n"), F.posexplode(F.arrays_zip("blocks", "behind")).alias("i", "b"))
    each = each.select(F.col("conv_id").alias("_c"), F.col("b.blocks").alias("_b"), F.col("b.behind").alias("behind"),
                       (F.col("i") == 0).alias("is_first"), (F.col("i") == F.col("n") - 1).alias("is_last"))
    joined = blocks.join(each, blocks["conv_id"].eqNullSafe(each["_c"]) & (blocks["block"] == each["_b"])).drop("_c", "_b")
    traced = joined.mapInPandas(_traced, "conv_id long, block long, start long, audits array<string>, exits array<int>")
    edits = settled(_parts(traced, "start", "audits", "exits").mapInPandas(_walked, "conv_id long, block long, start long, edits string"), "edits")
    return totals.drop("blocks", "behind"), edits


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, position, part, role, text, edit): rows of the repaired conversations, in order of position and part.

    An inserted row has the position of the row before which (at the end: behind which) it
    stands. Row and edit meet by position, which no conversation makes frequent.
    """
    each = edits.select("start", F.posexplode(F.regexp_extract_all("edits", F.lit("[ua]*[DKUA](?:[ua]+$)?"), F.lit(0))).alias("i", "own"))
    each = each.select((F.col("start") + F.col("i")).alias("position"), "own")
    letters = rows.join(each, "position").select("conv_id", "position", "role", "text", F.posexplode(F.split("own", "")).alias("part", "letter"))
    letters = letters.where("letter <> '' and letter <> 'D'")
    role = F.when(F.lower("letter") == "u", "user").when(F.lower("letter") == "a", "assistant").otherwise(F.col("role"))
    text = F.when(F.col("letter").isin("u", "a"), "").otherwise(F.col("text"))
    edit = F.when(F.col("letter").isin("u", "a"), "insert").when(F.col("letter") == "K", "keep").otherwise("rerole")
    return letters.select("conv_id", "position", "part", role.alias("role"), text.alias("text"), edit.alias("edit"))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the lines ``role:text``, hashed row by row as they stream past."""
    lines = rows.select("conv_id", "position", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "position", "part").select("conv_id", "line")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, done, running = [], [], None
        for frame in frames:
            for conv_id, line in zip(frame["conv_id"].astype("Int64"), frame["line"]):
                conv_id = None if conv_id is pd.NA else int(conv_id)
                if running is None or names[-1] != conv_id:
                    if running is not None:
                        done.append(running.hexdigest())
                    names.append(conv_id)
                    running = hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(line.encode("utf-8", "replace"))
            if len(done) > 10_000:
                yield pd.DataFrame({"conv_id": pd.array(names[:-1], "Int64"), "repaired_sha256": done})
                names, done = names[-1:], []
        if running is not None:
            done.append(running.hexdigest())
        yield pd.DataFrame({"conv_id": pd.array(names, "Int64"), "repaired_sha256": done})

    return lines.mapInPandas(run, "conv_id long, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): its faults and its cheapest repair.

    conv_id, gaps (turns missing between the first and the last), blank, duplicate and
    truncated (rows by their first fault), illegal (neighbouring rows whose roles may not
    follow each other), cost, audit (initials of the cheapest edits, ties ASCII-least) and
    repaired_sha256. Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an
    empty row 5; blank and duplicate rows have to go, and a truncated row that stays costs 5
    more.

    * A null role or text is one space, so such a text is blank and such a role has to change.
    * Null turns come first and count for no gap; with no other turns, gaps is 0.
    * Rows without conv_id are one conversation. Rows of one turn follow by role and text.
    * Repeated rows are duplicates. Any length of text or conversation is taken whole; only
      the digest of a conversation's text is made in one task, row by row.
    * Further columns are not read, whatever their names. No rows: no result.
    """
    rows = ordered(rows)
    totals, edits = plan_repairs(rows)
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    letters = F.translate("edits", "uaUA", "IIRR")
    audits = _parts(edits.withColumn("edits", letters), "edits").select("conv_id", F.array_join(F.transform("parts", lambda p: p["edits"]), "").alias("audit"))
    out = totals
    for more in (turns, audits, digests(repaired(rows, edits))):
        more = more.withColumnRenamed("conv_id", "_c")
        out = out.join(more, out["conv_id"].eqNullSafe(more["_c"]), "left").drop("_c")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """``repair_report`` of ``damage``, with a row for every conversation; zeros for one of which no row is left."""
    names = rows.select(F.col("conv_id").alias("_c")).distinct()
    report = repair_report(damage(rows))
    out = names.join(report, F.col("_c").eqNullSafe(F.col("conv_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col("_c").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
