"""Operator 11: repair of the structure of conversations at least cost, by a dynamic program with checkpoints.

A repaired conversation has the role initials `(s?(ua)+)?`. Four states follow the initials given so far: nothing, after the
system turn, after a user, after an assistant. Deleting a turn costs 4, giving it another role 3, inserting an empty turn
3, and a truncated turn that stays 3 more; blank turns and repeats must go. The least cost from a turn to the end is a vector
over the states, which follows from the vector of the next turn. Of the cheapest scripts the one whose initials (Delete,
Insert, Keep, Rerole) come first in ASCII order is taken: at each turn the first edit that is tight, that is whose cost
and following vector add up to the vector here.

The vectors of all turns are never held at once. Turns are numbered over the whole table and cut into blocks; what a block
does to a cost vector is a matrix of 4 x 4 least costs, and running over a conversation's matrices from its end gives the
vector at the end of each block. In a block the program keeps the vectors of every sqrt(n)-th turn and recomputes those
between while it walks forward. Where a conversation spans blocks, each block first says where each state leads, then the
blocks' entry states follow, then all blocks write their edits. So a conversation of any length is shared out; only its
digest, in which every byte depends on all before, and its audit string pass through one task, turn by turn.

Defined cases: a null text or role is one space, a null turn comes first and is one space in the damage key, a null conv_id is
a conversation of its own. Turns of one number go by role, then by the SHA-256 of their text. A conversation without turns
has zeros and empty strings. A role counts by its initial; a turn with another initial than s, u and a can't be kept. Repeated
rows are turns of their own (and duplicates). An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import turns as T

#: Turns of a block at most: 16 bytes each in the task that works on it.
BLOCK = 1 << 16
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Faults, by the first that applies.
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
#: States, the state that a new turn leads to, and what it costs to end in a state.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT, END = (USER, USER, ASSISTANT, USER), (0, 6, 3, 0)
#: By class of initial (s, u, a, other): the state that keeping it leads to from each state, -1 where it doesn't fit.
KEEP = ((SYSTEM, -1, -1, -1), (USER, USER, -1, USER), (-1, -1, ASSISTANT, -1), (-1, -1, -1, -1))
NEVER = 1 << 60
#: Fixed value: white space of the format.
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame, mod: int = 20) -> DataFrame:
    """key, turn, role, text of conversations with known damage, by a checksum of conversation and turn: 0 drops the turn,
    1 empties it, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    named = rows.select(T.key_of(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], turn.alias("at"))
    named = named.withColumn("kind", F.crc32(F.concat_ws(":", "key", "at").cast("binary")) % mod).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return named.select("key", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("again")).drop("again")


def _class(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def faulty(rows: DataFrame) -> DataFrame:
    """rows (key, turn, role, text) in order with seq and fault. Of equal turns of a conversation all but the first are
    duplicates; the first ones are found by a partial minimum, so no group of copies meets in one task."""
    rows = T.ordered(rows, "turns")
    first = rows.groupBy("key", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)
    return C.materialize(rows.join(first, "seq", "left").select("key", "seq", "turn", "role", "text", fault.alias("fault")), "faults")


def back(v: list[int], code: int) -> list[int]:
    """The cost vector before a turn, from the one after it. code: 4 * fault + class of the initial."""
    fault, kind = divmod(code, 4)
    out = [DELETE + x for x in v]
    if fault in (SOUND, CUT_OFF):
        more, keep = TRUNCATED * (fault == CUT_OFF), KEEP[kind]
        for s in range(4):
            out[s] = min(out[s], REROLE + more + v[NEXT[s]], more + v[keep[s]] if keep[s] >= 0 else NEVER)
    out[USER], out[ASSISTANT] = min(out[USER], INSERT + out[ASSISTANT]), min(out[ASSISTANT], INSERT + out[USER])
    out[EMPTY], out[SYSTEM] = min(out[EMPTY], INSERT + out[USER]), min(out[SYSTEM], INSERT + out[USER])
    return out


def matrix(codes: list[int]) -> list[list[int]]:
    """Least costs of the turns from each state (row) to each state (column)."""
    columns = []
    for end in range(4):
        v = [NEVER] * 4
        v[end] = 0
        for code in reversed(codes):
            v = back(v, code)
        columns.append(v)
    return [list(row) for row in zip(*columns, strict=True)]


def walk(codes: list[int], end: list[int], state: int, last: bool) -> tuple[list[str], list[str], int]:
    """For each turn its edits (insertions before it, its own and, after the last turn, insertions behind it) and where they
    lead: u or a for a new role, = for the role kept, - for a deleted turn; and the state at the end."""
    n = len(codes)
    step = isqrt(n - 1) + 1
    marks, v = [end] * (n // step + 2), end
    for i in range(n - 1, -1, -1):
        v = back(v, codes[i])
        if i % step == 0:
            marks[i // step] = v
    edits, roles = [], []
    for a in range(0, n, step):
        b = min(a + step, n)
        held = [marks[a // step + 1] if b < n else end]
        for i in range(b - 1, a - 1, -1):
            held.append(back(held[-1], codes[i]))
        for i in range(a, b):
            here, after = held[b - i], held[b - i - 1]
            fault, kind = divmod(codes[i], 4)
            stays, more = fault in (SOUND, CUT_OFF), TRUNCATED * (fault == CUT_OFF)
            own, to = "", ""
            while True:
                if here[state] == DELETE + after[state]:
                    own, to = own + "D", to + "-"
                    break
                if here[state] == INSERT + here[NEXT[state]]:
                    state = NEXT[state]
                    own, to = own + "I", to + " sua"[state]
                    continue
                kept = KEEP[kind][state]
                if stays and kept >= 0 and here[state] == more + after[kept]:
                    own, to, state = own + "K", to + "=", kept
                else:
                    state = NEXT[state]
                    own, to = own + "R", to + " sua"[state]
                break
            edits.append(own)
            roles.append(to)
    while last and END[state]:
        state = NEXT[state]
        edits[-1] += "I"
        roles[-1] += " sua"[state]
    return edits, roles, state


def _segments(f: pd.DataFrame) -> list[tuple[str, list[int], list[int]]]:
    """(key, seq and code of its turns in order) of a block."""
    f = f.sort_values("seq")
    keys, seq, codes = f["key"].to_numpy(), f["seq"].tolist(), f["code"].tolist()
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(f)] if len(f) else [0]
    return [(keys[a], seq[a:b], codes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _matrices(f: pd.DataFrame) -> pd.DataFrame:
    block = int(f["block"].iloc[0])
    rows = [(key, block, sum(matrix(codes), [])) for key, _, codes in _segments(f)]
    return pd.DataFrame(rows, columns=["key", "block", "costs"])


def _ends(frames):
    """The cost vector at the end of each block of a conversation, blocks from the last to the first."""
    key, v = None, None
    for f in frames:
        rows = []
        for own, block, costs in zip(f["key"], f["block"], f["costs"], strict=True):
            last = own != key
            key, v = own, list(END) if last else v
            rows.append((own, block, v, last))
            v = [min(costs[4 * s + t] + v[t] for t in range(4)) for s in range(4)]
        yield pd.DataFrame(rows, columns=["key", "block", "ends", "last"])


def _by_key(f: pd.DataFrame, *columns: str) -> dict[str, tuple]:
    return {key: own for key, *own in zip(f["key"], *(f[c].tolist() for c in columns), strict=True)}


def _exits(codes: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """Where each state leads through a block."""
    asked, rows = _by_key(ends, "block", "ends", "last"), []
    for key, _, own in _segments(codes) if asked else []:
        if key in asked:
            block, end, last = asked[key]
            rows.append((key, block, [walk(own, list(map(int, end)), s, last)[2] for s in range(4)]))
    return pd.DataFrame(rows, columns=["key", "block", "exits"])


def _entries(frames):
    """The state in which each block of a conversation begins."""
    key, state = None, EMPTY
    for f in frames:
        rows = []
        for own, block, exits in zip(f["key"], f["block"], f["exits"], strict=True):
            state = EMPTY if own != key else state
            key = own
            rows.append((own, block, state))
            state = int(exits[state])
        yield pd.DataFrame(rows, columns=["key", "block", "state"])


def _edits(codes: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    asked, seqs, edits, roles = _by_key(ends, "ends", "last", "state"), [], [], []
    for key, seq, own in _segments(codes):
        end, last, state = asked[key]
        script, to, _ = walk(own, list(map(int, end)), state, last)
        seqs += seq
        edits += script
        roles += to
    return pd.DataFrame({"seq": pd.Series(seqs, dtype="int64"), "edits": edits, "roles": roles})


def repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (key, turn, role, text) in order with seq, fault, edits and roles: what is done before, to and after each turn, and
    the roles that this gives (see walk)."""
    turns = faulty(rows)
    codes = C.materialize(turns.select("key", "seq", F.floor(F.col("seq") / block).alias("block"), (4 * F.col("fault") + _class(F.col("role"))).alias("code")), "codes")
    costs = codes.groupBy("block").applyInPandas(_matrices, "key string, block long, costs array<long>")
    ends = costs.repartition("key").sortWithinPartitions("key", F.desc("block")).mapInPandas(_ends, "key string, block long, ends array<long>, last boolean")
    ends = C.materialize(ends, "ends")
    shared = ends.join(ends.filter("not last").select("key").distinct(), "key", "left_semi")
    exits = codes.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(_exits, "key string, block long, exits array<long>")
    states = exits.repartition("key").sortWithinPartitions("key", "block").mapInPandas(_entries, "key string, block long, state int")
    known = ends.join(states, ["key", "block"], "left").na.fill(EMPTY, ["state"])
    edits = codes.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_edits, "seq long, edits string, roles string")
    return turns.join(edits, "seq")


def texts(edited: DataFrame) -> DataFrame:
    """conv_id, seq, step, role, text of the repaired conversations, from repaired(): in order of seq and step."""
    each = edited.select(T.id_of(F.col("key")), "seq", "role", "text", "edits", F.posexplode(F.split("roles", "")).alias("step", "to")).filter("to in ('u', 'a', '=')")
    role = F.when(F.col("to") == "u", "user").when(F.col("to") == "a", "assistant").otherwise(F.col("role"))
    inserted = F.substring("edits", F.col("step") + 1, F.lit(1)) == "I"
    return each.select("conv_id", "seq", "step", role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"))


class _Report:
    def __init__(self, key: str):
        self.key, self.counts, self.illegal, self.cost, self.audit = key, [0] * 4, 0, 0, []
        self.low = self.high = self.before = None
        self.different, self.sha, self.begun = 0, hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.begun else "") + role + ":" + text).encode())
        self.begun = True

    def add(self, seq, turn, role, text, fault, edits, roles) -> None:
        if seq < 0:  # the mark of a conversation, turns or none
            return
        self.counts[fault] += 1
        if turn is not None:
            turn = int(turn)
            self.different += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.audit.append(edits)
        for edit, to in zip(edits, roles, strict=True):
            self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit] + TRUNCATED * (fault == CUT_OFF and edit in "KR")
            if edit != "D":
                self.line({"u": "user", "a": "assistant"}.get(to, role), "" if edit == "I" else text)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.different
        return self.key, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def report(edited: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each of conversations (conv_id),
    from repaired()."""
    columns = ["seq", "turn", "role", "text", "fault", "edits", "roles"]
    marks = conversations.select(T.key_of(F.col("conv_id")).alias("key")).distinct().select("key", F.lit(-1).cast("long").alias("seq"), F.lit(None).cast("string").alias("turn"), *[F.lit("").alias(c) for c in ("role", "text")], F.lit(0).alias("fault"), *[F.lit("").alias(c) for c in ("edits", "roles")])
    schema = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    edited = edited.withColumn("turn", F.col("turn").cast("string"))  # pandas has nullable numbers as floats
    folded = C.materialize(T.fold(edited.select("key", *columns).unionByName(marks), columns, _Report, schema), "repairs")
    return folded.select(T.id_of(F.col("key")), *folded.columns[1:])


def repair_report(rows: DataFrame) -> DataFrame:
    """The report of damaged conversations; rows: conv_id, turn, role, text."""
    return report(repaired(damaged(rows)), rows.select("conv_id"))
