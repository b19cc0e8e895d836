"""Chat formatting with a grammar round trip.

Every turn is rendered between an opener that names its role and a closer. A deterministic parser reads the rendered
turn back; where the turn it recovers is not the source, its text is escaped one step further, until the two are
identical. Escaping is reversible and marked in the opener, so plain texts stay as they are.

Grammar (TEXT holds no control string; a starred opener says that TEXT is escaped)::

    conversation := turn*
    turn         := "<s>[INST] " TEXT " [/INST]" | "<s>[OUT] " TEXT " </s>" | "<s>[SYS] " TEXT " [/SYS]"
                  | "<s>[ROLE] " ROLE "[/ROLE] " TEXT " [/TURN]"          (each opener also starred: "<s>[INST*] ")
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.ship import ship

# The template's marks.
OPENERS = {"user": "<s>[INST", "assistant": "<s>[OUT", "system": "<s>[SYS"}
CLOSERS = {"user": " [/INST]", "assistant": " </s>", "system": " [/SYS]"}
OTHER_OPENER, ROLE_END, OTHER_CLOSER = "<s>[ROLE", "[/ROLE] ", " [/TURN]"
CONTROL = ("<s>", "</s>", "[INST", "[/INST]", "[OUT", "[SYS", "[/SYS]", "[ROLE", "[/ROLE]", "[/TURN]")
ESCAPES = {"&": "&a;", "<": "&l;", "[": "&b;"}

CONTROL_PATTERN = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_UNESCAPE = {v: k for k, v in ESCAPES.items()}
_OPENING = re.compile(r"<s>\[(INST|OUT|SYS|ROLE)(\*?)\] ")
_ROLE_OF = {"INST": "user", "OUT": "assistant", "SYS": "system"}


class NotInGrammar(ValueError):
    """The rendered text is no sentence of the grammar."""


def escape(text: str) -> str:
    return re.sub(r"[&<\[]", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"&[alb];", lambda m: _UNESCAPE[m[0]], text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end bound its text in ``rendered``, still escaped."""
    turns, at = [], 0
    while at < len(rendered):
        if not (m := _OPENING.match(rendered, at)):
            raise NotInGrammar(f"no opener at {at}")
        at, read = m.end(), unescape if m[2] else str
        if m[1] == "ROLE":
            end = rendered.find(ROLE_END, at)
            if end < 0:
                raise NotInGrammar(f"no role at {at}")
            role, at, closer = read(rendered[at:end]), end + len(ROLE_END), OTHER_CLOSER
        else:
            role = _ROLE_OF[m[1]]
            closer = CLOSERS[role]
        first = CONTROL_PATTERN.search(rendered, at)
        end = first.start() - 1 if first else -1
        if end < at or not rendered.startswith(closer, end):
            raise NotInGrammar(f"no closer after {at}")
        turns.append((role, read(rendered[at:end]), at, end))
        at = end + len(closer)
    return turns


def render_turn(role: str, text: str) -> str:
    """One turn, escaped as little as the round trip allows."""
    for star, write in (("", str), ("*", escape)):
        opener = f"{OPENERS[role]}{star}] " if role in OPENERS else f"{OTHER_OPENER}{star}] {write(role)}{ROLE_END}"
        rendered = f"{opener}{write(text)}{CLOSERS.get(role, OTHER_CLOSER)}"
        try:
            if [t[:2] for t in parse(rendered)] == [(role, text)]:
                return rendered
        except NotInGrammar:
            continue
    raise AssertionError("escaped text holds no control string")


class Conversation:
    """What is read back from the rendered turns of one conversation, turn by turn."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str) -> None:
        for role, text, start, end in parse(rendered):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                masked = rendered[start:end]
                masked = unescape(masked) if rendered.startswith("<s>[OUT*] ") else masked
                self.loss.update(masked.encode())
                self.loss_chars += len(masked)
        self.chars += len(rendered)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def render_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, rendered, loss_start, loss_end): one row a turn, rendered on its own, without a shuffle.

    The loss mask of a turn spans the assistant's text inside ``rendered`` (null for other roles). Null roles and texts
    count as empty. Extra columns are not carried along.
    """
    ship(conversations.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [render_turn(r, t) for r, t in zip(pdf["role"], pdf["text"], strict=True)]
            spans = [parse(x)[0][2:] if r == "assistant" else (None, None) for r, x in zip(pdf["role"], out, strict=True)]
            yield pdf[["conv_id", "turn", "role"]].assign(rendered=out, loss_start=pd.array([a for a, _ in spans], "Int64"), loss_end=pd.array([b for _, b in spans], "Int64"))

    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "conv_id long, turn long, role string, rendered string, loss_start long, loss_end long")


def digest(rendered: DataFrame) -> DataFrame:
    """One row a conversation, read back from its rendered turns in order.

    Rows are dealt by conversation and sorted by turn (null first; ties by role, then text as rendered); each task
    streams them, holding a single turn at a time, so the length of a conversation is not bound by memory. Repeated
    rows are turns of their own. A null conv_id is a conversation like any other. Empty input: no rows.
    """
    ship(rendered.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, done = None, []
        for pdf in batches:
            for missing, conv, text in zip(pdf["conv_id"].isna(), pdf["conv_id"], pdf["rendered"], strict=True):
                conv = None if missing else int(conv)
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(conv)
                now.add(text)
            yield frame(done)
            done = []
        if now is not None:
            yield frame([now.row()])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        return pdf.assign(conv_id=pd.array(pdf["conv_id"].tolist(), "Int64"))

    dealt = rendered.select("conv_id", "turn", "role", "rendered").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    return dealt.select("conv_id", "rendered").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
