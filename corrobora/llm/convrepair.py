"""Repair of conversations: the cheapest edits that make the roles alternate, by dynamic programming over time-major arrays.

A legal conversation is a system turn, if any, then pairs of a user's and an assistant's turn. Its grammar has four
states: nothing yet (0), after the system (1), after a user (2), after an assistant (3). Each row is kept, given the
other role, or deleted, and empty turns may be inserted anywhere; every edit has a cost.

Conversations of like length make a bucket. For a bucket, the cost of finishing from each state is computed backward,
turn by turn, for all its conversations at once, and stored; then the edits are traced forward, again for all at once. A
state allows one role to insert and one to give, so edits spell their path, and the ASCII-least of the cheapest is found
letter by letter. A long conversation is cut into pieces, which are conversations of their own in the bucket: matrices of
the least cost from state to state join their ends, and each is traced from every state it may be entered in.

Plan: what decides is two bytes and a digest a row; those rows are dealt by conversation and sorted, and a task takes in
whole conversations as they come. The edits go back to the texts in a second stream, sorted alike, which holds one text at
a time. A conversation is in one task, as its order and its hash demand; some 80 bytes of each of its rows are held there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm._shared import SPACE
from corrobora.ship import ship

#: What edits cost, and what a truncated row adds that is not deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows that are repaired together (and the rest of the last conversation), rows of a piece, cells of a tensor.
ROWS, PIECE, CELLS = 65_536, 1_024, 1 << 18
#: More than any repair costs.
NEVER = 1 << 40
#: Kinds of rows by the first letter of the role; the state after each kind, by state.
KINDS = "sua"
AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The state after the one role that may be inserted or given, by state, and that role.
NEXT = np.array([2, 2, 3, 2])
GIVEN = ("user", "user", "assistant", "user")
#: Letters of edits by number.
LETTERS = np.frombuffer(b"DKR", np.uint8)


def closed(cost: np.ndarray) -> np.ndarray:
    """Costs (n, 4) when turns may be inserted first."""
    after_user = np.minimum(cost[:, 2], INSERT + cost[:, 3])
    out = np.minimum(cost, INSERT + after_user[:, None])
    out[:, 2] = after_user
    out[:, 3] = np.minimum(cost[:, 3], INSERT + cost[:, 2])
    return out


#: What it costs to end in each state.
END = closed(np.array([[0, NEVER, NEVER, 0]], np.int64))[0]


class Tensor:
    """Pieces of rows as columns, turns as rows, aligned at their ends; ``at`` is -1 where a piece has not begun."""

    def __init__(self, kind: np.ndarray, must: np.ndarray, cut: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.turns = int(size.max())
        step = np.arange(self.turns)[:, None] - (self.turns - size)[None, :]
        self.at = np.where(step >= 0, start[None, :] + step, -1)
        self.kind, self.must, self.extra = kind[self.at], must[self.at], np.where(cut[self.at], TRUNCATED, 0)

    def kept(self, t: int, ahead: np.ndarray) -> np.ndarray:
        """What it costs to keep row t, by state, when ``ahead`` is what the rest costs."""
        to = AFTER[:, self.kind[t]].T
        cost = np.where(to < 0, NEVER, np.take_along_axis(ahead, np.maximum(to, 0), axis=1) + KEEP)
        return np.where(self.must[t][:, None], NEVER, cost + self.extra[t][:, None])

    def given(self, t: int, ahead: np.ndarray) -> np.ndarray:
        """What it costs to give row t the role that its state wants."""
        return np.where(self.must[t][:, None], NEVER, ahead[:, NEXT] + REROLE + self.extra[t][:, None])

    def backward(self, end: np.ndarray) -> np.ndarray:
        """(turns + 1, n, 4): the least cost from each state at each turn on, when ``end`` (n, 4) is that of what follows."""
        out = np.empty((self.turns + 1, *end.shape), np.int64)
        out[-1] = end
        for t in range(self.turns - 1, -1, -1):
            ahead = out[t + 1]
            cost = np.minimum(ahead + DELETE, np.minimum(self.kept(t, ahead), self.given(t, ahead)))
            out[t] = np.where((self.at[t] >= 0)[:, None], np.minimum(closed(cost), NEVER), ahead)
        return out

    def forward(self, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(edit, inserted before it, state on arrival) by turn and piece, and the state after the last turn."""
        n = len(state)
        edit, inserted, arrival = (np.zeros((self.turns, n), np.uint8) for _ in range(3))
        rows = np.arange(n)
        for t in range(self.turns):
            on, ahead = self.at[t] >= 0, cost[t + 1]
            arrival[t] = state
            open_ = on.copy()
            while open_.any():
                now = cost[t][rows, state]
                gone = open_ & (ahead[rows, state] + DELETE == now)
                more = open_ & ~gone & (cost[t][rows, NEXT[state]] + INSERT == now)
                inserted[t] += more
                rest = open_ & ~gone & ~more
                keeps = rest & (self.kept(t, ahead)[rows, state] == now)
                gives = rest & ~keeps
                edit[t] = np.where(keeps, 1, np.where(gives, 2, edit[t]))
                state = np.where(more | gives, NEXT[state], np.where(keeps, AFTER[state, self.kind[t]], state))
                open_ = more
        return edit, inserted, arrival, state


def blocks(size: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of pieces of like length, longest first: few enough together for a tensor of CELLS."""
    order = np.argsort(-size, kind="stable")
    lo = 0
    while lo < len(order):
        longest = int(size[order[lo]])
        hi = lo + max(1, CELLS // longest)
        like = order[lo:hi]
        like = like[size[like] * 2 > longest]  # padding is less than the rows
        yield like
        lo += len(like)


def cheapest(kind: np.ndarray, must: np.ndarray, cut: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ASCII-least of the cheapest repairs of conversations that stand one after the other.

    ``kind`` (index in KINDS, 3 for others), ``must`` (has to be deleted) and ``cut`` (truncated) tell of each row, ``first``
    is where each conversation starts. Returns (edit, inserted before it, state on arrival) by row, and cost and last state
    by conversation.
    """
    size = np.diff(np.append(first, len(kind)))
    conv = np.repeat(np.arange(len(first)), -(-size // PIECE))
    part = np.arange(len(conv)) - np.searchsorted(conv, conv)
    start = first[conv] + part * PIECE
    length = np.minimum(PIECE, first[conv] + size[conv] - start)
    end = np.tile(END, (len(conv), 1))
    tensor = lambda own: Tensor(kind, must, cut, start[own], length[own])

    # What follows a piece costs what the next one does from each state; for that, matrices of costs from state to state.
    later = np.flatnonzero(part > 0)
    matrix = np.zeros((len(conv), 4, 4), np.int64)
    for own in blocks(length[later]):
        own = later[own]
        t = tensor(own)
        for to in range(4):
            matrix[own, :, to] = t.backward(np.tile(np.where(np.arange(4) == to, 0, NEVER), (len(own), 1)))[0]
    for p in later[::-1]:
        end[p - 1] = np.minimum((matrix[p] + end[p][None, :]).min(axis=1), NEVER)

    edit, inserted, arrival = (np.zeros(len(kind), np.uint8) for _ in range(3))
    cost, last = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    alone = np.flatnonzero(np.bincount(conv, minlength=len(first))[conv] == 1)
    for own in blocks(length[alone]):
        own = alone[own]
        t = tensor(own)
        back = t.backward(end[own])
        *told, state = t.forward(back, np.zeros(len(own), np.int64))
        on = t.at >= 0
        for into, what in zip((edit, inserted, arrival), told, strict=True):
            into[t.at[on]] = what[on]
        cost[conv[own]], last[conv[own]] = back[0][:, 0], state

    # Pieces of long conversations are traced from every state; then the states are followed.
    long_ = np.flatnonzero(np.bincount(conv, minlength=len(first))[conv] > 1)
    exits, traced = np.zeros((len(conv), 4), np.int64), {}
    for own in blocks(length[long_]):
        own = long_[own]
        t = tensor(own)
        back = t.backward(end[own])
        cost[conv[own[part[own] == 0]]] = back[0][part[own] == 0, 0]
        for s in range(4):
            *told, exits[own, s] = t.forward(back, np.full(len(own), s))
            for column, p in enumerate(own):
                traced[p, s] = [x[t.turns - length[p] :, column].copy() for x in told]
    state = 0
    for p in long_:
        state = 0 if part[p] == 0 else state
        for into, what in zip((edit, inserted, arrival), traced[p, state], strict=True):
            into[start[p] : start[p] + length[p]] = what
        state = exits[p, state]
        last[conv[p]] = state
    return edit, inserted, arrival, cost, last


#: Turns inserted at the end, by the last state.
TRAILING = np.array([0, 2, 1, 0])


def spelled(edit: np.ndarray, inserted: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[str]:
    """The initials of the edits of each conversation."""
    place = np.cumsum(inserted.astype(np.int64) + 1) - 1
    out = np.full(int(place[-1]) + 1 if len(place) else 0, ord("I"), np.uint8)
    out[place] = LETTERS[edit]
    ends = np.append(first, len(edit))
    bound = np.where(ends > 0, np.append(place, 0)[ends - 1] + 1, 0) if len(place) else np.zeros(len(ends), np.int64)
    return [out[lo:hi].tobytes().decode() + "I" * int(TRAILING[s]) for lo, hi, s in zip(bound[:-1], bound[1:], last, strict=True)]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with seeded faults: (conv_id, turn, role, text, gone).

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row (gone is true), 1 empties its text, 2 takes out its
    ``[.!?]``, 3 repeats it, 4 makes its role user. Nulls count as one space, in the key and as role or text.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


#: How both streams are dealt and sorted.
DEALT, SORTED = ("nameless", "conv"), ("nameless", "conv", "kind", "timed", "turn", "role", "digest")


def keyed(rows: DataFrame) -> DataFrame:
    """Rows of conversations with the columns of SORTED; ties of a turn stand by role, then by the digest of role and text."""
    both = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return rows.select(F.col("conv_id").isNull().alias("nameless"), F.coalesce("conv_id", F.lit(0)).alias("conv"), F.lit(1).alias("kind"), F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", F.substr(F.unhex(both), F.lit(1), F.lit(16)).alias("digest"), "text", "gone")


AUDITED = "nameless boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits binary, last int"


def audited(rows: DataFrame) -> DataFrame:
    """One row a conversation: faults counted, cost and initials of its repair, and the edits row by row, as bytes.

    ``rows``: (conv_id, turn, role, text, gone); rows that are gone only make their conversation known. A row's first
    fault counts: blank (nothing but ASCII white space), duplicate (role and text seen earlier), truncated (its last other
    character is none of ``.!?``). Null turns come first.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        key, n = None, 0
        for batch in batches:
            digest = batch.column(batch.num_columns - 1)
            marks = np.frombuffer(digest.buffers()[2] or b"", np.uint64)[2 * digest.offset : 2 * (digest.offset + len(digest))].reshape(-1, 2)
            new = [*[c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], marks[:, 0], marks[:, 1]]
            if not len(marks):
                continue
            # Where the last conversation of the batch starts, if it does in this batch.
            starts = heads(new)
            starts = starts if (new[0][0], new[1][0]) != key else starts[1:]
            key, n = (new[0][-1], new[1][-1]), n + len(marks)
            if n >= ROWS and len(starts):
                whole = [*held, [x[: starts[-1]] for x in new]]
                if sum(len(x[0]) for x in whole):
                    yield told([np.concatenate(x) for x in zip(*whole, strict=True)])
                held = [[x[starts[-1] :] for x in new]]
                n = len(held[0][0])
            else:
                held.append(new)
        if held:
            yield told([np.concatenate(x) for x in zip(*held, strict=True)])

    def heads(x: list[np.ndarray]) -> np.ndarray:
        new = np.ones(len(x[0]), bool)
        new[1:] = (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])
        return np.flatnonzero(new)

    def told(x: list[np.ndarray]) -> pa.RecordBatch:
        starts = heads(x)
        conv = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x[0]))))
        names, many = [x[0][starts], x[1][starts]], len(starts)
        alive = ~x[5].astype(bool)
        conv, (timed, turn, code, one, two) = conv[alive], [x[i][alive] for i in (2, 3, 4, 6, 7)]
        timed = timed.astype(bool)
        count = lambda which: np.bincount(conv[which], minlength=many)
        first = np.searchsorted(conv, np.arange(many))
        size = np.bincount(conv, minlength=many)
        # Faults
        kind, blank, cut = code & 3, (code & 4) > 0, (code & 8) > 0
        order = np.lexsort((np.arange(len(conv)), two, one, conv))
        again = np.zeros(len(conv), bool)
        a, z = order[:-1], order[1:]
        again[z] = (conv[a] == conv[z]) & (one[a] == one[z]) & (two[a] == two[z])
        again &= ~blank
        cut &= ~blank & ~again
        near = conv[1:] == conv[:-1]
        illegal = near & ~(((kind[:-1] == 0) & (kind[1:] == 1)) | ((kind[:-1] == 1) & (kind[1:] == 2)) | ((kind[:-1] == 2) & (kind[1:] == 1)))
        # Gaps, between turns that are known
        at, own = turn[timed], conv[timed]
        lead = np.ones(len(at), bool)
        lead[1:] = own[1:] != own[:-1]
        new = lead.copy()
        new[1:] |= at[1:] != at[:-1]
        heads_, gaps = np.flatnonzero(lead), np.zeros(many, np.int64)
        if len(at):
            tails = np.append(heads_[1:], len(at)) - 1
            gaps[own[heads_]] = at[tails] - at[heads_] + 1 - np.bincount(own[new], minlength=many)[own[heads_]]
        # Repair
        some = size > 0
        edit, inserted, arrival, cost, last = cheapest(kind, blank | again, cut, first[some])
        audit, total, ending = np.full(many, "", object), np.zeros(many, np.int64), np.zeros(many, np.int64)
        audit[some], total[some], ending[some] = spelled(edit, inserted, first[some], last), cost, last
        packed = edit | (inserted << 2) | (arrival << 4)
        ends = first + size
        columns = [names[0], names[1], gaps, count(blank), count(again), count(cut), np.bincount(conv[1:][illegal], minlength=many), total]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(audit.tolist(), pa.string()), pa.array([packed[lo:hi].tobytes() for lo, hi in zip(first, ends, strict=True)], pa.binary()), pa.array(ending, pa.int32())], names=[c.split()[0] for c in AUDITED.split(", ")])

    last = F.right(F.expr("trim(TRAILING seen FROM text)"), F.lit(1))
    kinds = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    code = kinds + F.when(last == "", 4).otherwise(0) + F.when(last.isin("", ".", "!", "?"), 0).otherwise(8)
    small = keyed(rows).withColumn("seen", F.lit(SPACE)).withColumn("code", code).drop("text", "seen")
    dealt = small.repartition(*DEALT).sortWithinPartitions(*SORTED)
    return dealt.select("nameless", "conv", "timed", "turn", "code", "gone", "digest").mapInArrow(run, AUDITED)


class Walk:
    """Reads conversations as they come, first the audit, then the rows in order, and gives the repaired turns."""

    def __init__(self):
        self.edits, self.at = b"", 0

    def begin(self, edits: bytes, last: int) -> list[tuple[str, str]]:
        """A conversation starts; the turns that end it."""
        self.edits, self.at, state, out = edits, 0, last, []
        for _ in range(TRAILING[last]):
            out.append((GIVEN[state], ""))
            state = NEXT[state]
        return out

    def step(self, role: str, text: str) -> list[tuple[str, str, str]]:
        """(role, text, initial of the edit) of the turns that a row becomes."""
        code, out = self.edits[self.at], []
        self.at += 1
        edit, inserted, state = code & 3, code >> 2 & 3, code >> 4
        for _ in range(inserted):
            out.append((GIVEN[state], "", "I"))
            state = NEXT[state]
        if edit:
            out.append((role, text, "K") if edit == 1 else (GIVEN[state], text, "R"))
        return out


def restreamed(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Audits and rows of conversations in one stream: kind 0 is the audit of what follows as kind 1."""
    texts = keyed(rows.where("NOT gone"))
    heads = audit.select("*", F.lit(0).alias("kind"))
    dealt = heads.unionByName(texts, allowMissingColumns=True).repartition(*DEALT).sortWithinPartitions(*SORTED)
    return dealt


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of the repaired conversations, with the initial of what made each.

    ``rows`` as for audited(). Places count from 1. A conversation of which nothing stays has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, tail, name, place = Walk(), [], None, 0
        for batch in batches:
            out = []
            emit = lambda turns: [out.append((name, i, *t)) for i, t in enumerate(turns, place + 1)]
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    emit([(*t, "I") for t in tail])
                    tail, name, place = walk.begin(r["edits"], r["last"]), None if r["nameless"] else r["conv"], 0
                else:
                    turns = walk.step(r["role"], r["text"])
                    emit(turns)
                    place += len(turns)
            yield turns_of(out)
        out = [(name, i, *t, "I") for i, t in enumerate(tail, place + 1)]
        yield turns_of(out)

    def turns_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "place", "role", "text", "edit"])

    stream = restreamed(rows, audited(rows)).select("nameless", "conv", "kind", "edits", "last", "role", "text")
    return stream.mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_digest(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row a conversation.

    ``rows`` as for audited(). gaps: turns missing between the least and the greatest (null turns aside); illegal: neighbours
    whose roles' first letters are none of su, ua, au; cost and audit: the cheapest edits (D, I, K, R) that leave
    ``(s?(ua)+)?``, the ASCII-least of them; repaired_sha256: hash of the repaired ``role:text`` lines. A role that starts
    with none of s, u, a can't be kept. Without rows all is 0, audit empty. A null conv_id is a conversation like any
    other; repeated rows are rows of their own; rows of one turn stand by role, then by a hash of their text. Texts are
    read whole. Extra columns are not carried along. Empty input: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, tail, head, lines, sha = Walk(), [], None, 0, hashlib.sha256()

        def add(turns: list[tuple]) -> None:
            nonlocal lines
            for t in turns:
                sha.update(f"{chr(10) if lines else ''}{t[0]}:{t[1]}".encode())
                lines += 1

        def finished() -> tuple:
            add(tail)
            return (None if head["nameless"] else head["conv"], *[head[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], sha.hexdigest())

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    if head is not None:
                        out.append(finished())
                    head, lines, sha = r, 0, hashlib.sha256()
                    tail = walk.begin(r["edits"], r["last"])
                else:
                    add(walk.step(r["role"], r["text"]))
            yield digests(out)
        yield digests([] if head is None else [finished()])

    def digests(out: list[tuple]) -> pa.RecordBatch:
        names = [c.split() for c in DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if k == "string" else pa.int64()) for i, (_, k) in enumerate(names)], names=[n for n, _ in names])

    return restreamed(rows, audited(rows)).drop("timed", "turn", "digest", "gone").mapInArrow(run, DIGEST)
