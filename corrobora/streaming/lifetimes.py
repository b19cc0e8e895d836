"""What lives for a while, as state of a stream: one-time codes, sessions, uploads, unfinished documents, open applications.

Rows that come in are held until the watermark has passed them and are then taken in the order of their time, so results
do not depend on how a stream is cut into batches, nor on the order of rows inside the delay of the watermark; Spark drops
rows that are older than the watermark of the batch before. Time is that of the events; timers fire by the watermark, and what they end comes out.

State is kept by Spark for each slice of the keys, as one value: the rows held, and what is alive. Both are bounded by the
delay and by the lifetimes. State goes to Python and back beside the rows, and a slice has one timer, for what comes first: a
batch calls Python once for each slice, not several times for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corrobora.constants import CODE_ATTEMPTS, CODE_SECONDS, FINAL_STATUSES, SESSION_SECONDS, STALE_SECONDS
from corrobora.shared import shared_path, written
from corrobora.ship import ship

#: The state store, which keeps state on disk beside the executors.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: The end of what does not end by itself.
EVER = 1 << 62
#: Slices of the keys, by hash. A stream that goes on from its checkpoint needs the number it began with.
SLICES = 256


class InOrder:
    """Takes the rows of a key in the order of (at, event_id) once the watermark has passed them.

    A subclass says what rows hold (``ROW``, beginning with at and event_id, microseconds and a number) and what is alive
    (``ALIVE``, under a name), and decides in ``take`` and ``until``.
    """

    ROW = "at long, event_id long"
    ALIVE = "until long"

    @property
    def state(self) -> str:
        typed = lambda columns: ", ".join(c.replace(" ", ": ", 1) for c in columns.split(", "))
        return f"held array<struct<key: string, {typed(self.ROW)}>>, alive array<struct<key: string, name: string, {typed(self.ALIVE)}>>"

    def __call__(self, slice_, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """All that has happened by the watermark, whether rows came in or the timer is due; the next one is for what comes first."""
        now, names = state.getCurrentWatermarkMs() * 1000, ["__key", *(c.split()[0] for c in self.ROW.split(", "))]
        was, lived = state.get if state.exists else ([], [])
        held: dict[str | None, list] = {}
        for key, *r in was:
            held.setdefault(key, []).append(tuple(r))
        living: dict[str | None, dict] = {}
        for key, name, *v in lived:
            living.setdefault(key, {})[name] = tuple(v)
        if not state.hasTimedOut:
            for pdf in rows:
                for key, at, event, *r in zip(*(pdf[c].tolist() for c in names), strict=True):
                    held.setdefault(key, []).append((int(at), int(event), *(None if pd.isna(v) else v for v in r)))
        out, later = [], []
        for key in held | living:
            alive, own = living.setdefault(key, {}), sorted(held.get(key, []), key=lambda r: r[:2])
            for r in (r for r in own if r[0] < now):
                out += self.until((key,), alive, r[0])
                out += self.take((key,), alive, r)
            out += self.until((key,), alive, now)
            later += [(key, *r) for r in own if r[0] >= now]
        left = [(key, name, *v) for key, alive in living.items() for name, v in alive.items()]
        if later or left:
            state.update((later, left))
            if due := [v[2] for v in left if v[2] < EVER] + [r[1] for r in later]:
                # It fires once the watermark is beyond that millisecond, and so beyond all moments of it.
                state.setTimeoutTimestamp(min(due) // 1000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=self.OUT, dtype=object)

    def until(self, key, alive: dict, now: int) -> list[tuple]:
        """Rows for what has ended before ``now``, in order; ``alive`` maps names to tuples of ALIVE, the end first."""
        ended = sorted((v[0], k) for k, v in alive.items() if v[0] < now)
        return [x for end, name in ended for x in self.over(key, name, end, alive.pop(name))]


class SignIns(InOrder):
    """Codes that live for five minutes and five attempts, and the sessions of an hour that they open."""

    ROW = "at long, event_id long, kind string, challenge string, code string"
    ALIVE = "until long, what string, code string, attempts int"
    OUT = ["person", "event_id", "at", "outcome", "subject"]

    def take(self, key, alive: dict, r: tuple) -> list[tuple]:
        at, event, kind, challenge, code = r
        told = lambda what, subject: [(key[0], event, at, what, subject)]
        if kind == "request":
            alive[f"c{event}"] = (at + 1_000_000 * CODE_SECONDS, "code", code, 0)
            return told("code_sent", f"c{event}")
        if kind == "verify":
            held = alive.get(challenge)
            if held is None:
                return told("expired", challenge)
            tried = held[3] + 1
            if tried > CODE_ATTEMPTS:
                del alive[challenge]
                return told("too_many_attempts", challenge)
            if code != held[2]:
                alive[challenge] = (*held[:3], tried)
                return told("wrong_code", challenge)
            del alive[challenge]
            alive[f"s{event}"] = (at + 1_000_000 * SESSION_SECONDS, "session", "", 0)
            return told("signed_in", f"s{event}")
        live = [k for k, v in alive.items() if v[1] == "session"]
        return told("served" if live else "unauthorised", max(live, key=lambda k: (alive[k][0], k)) if live else "")

    def over(self, key, name: str, end: int, was: tuple) -> list[tuple]:
        return [(key[0], None, end, f"{was[1]}_over", name)]


class Sweep(InOrder):
    """What is not touched for a while goes; a touch by a final status ends the wait without that."""

    ROW = "at long, event_id long, status string"
    ALIVE = "until long, since long"
    OUT = ["key", "since", "at"]

    def __init__(self, seconds: int, final: tuple[str, ...]):
        self.seconds, self.final = seconds, final

    def take(self, key, alive: dict, r: tuple) -> list[tuple]:
        alive.clear()
        if r[2] not in self.final:
            alive["it"] = (r[0] + 1_000_000 * self.seconds, r[0])
        return []

    def over(self, key, name: str, end: int, was: tuple) -> list[tuple]:
        return [(key[0], was[1], end)]


#: The status of a document that comes in.
UPLOADED = "uploaded"


class Barrier(InOrder):
    """An application comes out when none of its documents is at work: each is final, or was not heard of for so long that it is given up."""

    ROW = "at long, event_id long, document string, status string"
    ALIVE = "until long, status string"
    OUT = ["application", "at", "ready", "given_up", "documents"]

    def __init__(self, seconds: int, final: tuple[str, ...], removed: str):
        self.seconds, self.final, self.removed = seconds, final, removed

    def take(self, key, alive: dict, r: tuple) -> list[tuple]:
        at, _, document, status = r
        if status == self.removed:
            alive.pop(document, None)
        elif status == UPLOADED or document in alive:
            alive[document] = (EVER if status in self.final else at + 1_000_000 * self.seconds, status)
        return self.out(key, alive, at)

    def over(self, key, name: str, end: int, was: tuple) -> list[tuple]:
        raise AssertionError("documents that are given up stay")

    def until(self, key, alive: dict, now: int) -> list[tuple]:
        rows = []
        for end, name in sorted((v[0], k) for k, v in alive.items() if v[0] < now):
            alive[name] = (EVER, "given_up")
            rows += self.out(key, alive, end)
        return rows

    def out(self, key, alive: dict, at: int) -> list[tuple]:
        if not alive or any(v[0] != EVER for v in alive.values()):
            return []
        many = lambda s: sum(v[1] == s for v in alive.values())
        row = (key[0], at, many("ready"), many("given_up"), len(alive))
        alive.clear()
        return [row]


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("time", F.col("at")).withWatermark("time", late).withColumn("at", F.unix_micros("at"))


def _run(timed: DataFrame, key: str, processor: InOrder, out: str) -> DataFrame:
    ship(timed.sparkSession)
    timed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    # Keys are text in Python, where numbers beside nulls would become floats.
    sliced = timed.withColumn("__key", F.col(key).cast("string")).withColumn("__slice", F.pmod(F.xxhash64("__key"), F.lit(SLICES)))
    done = sliced.groupBy("__slice").applyInPandasWithState(processor.__call__, f"{processor.OUT[0]} string, {out}", processor.state, "append", GroupStateTimeout.EventTimeTimeout)
    return done.withColumn(processor.OUT[0], F.col(processor.OUT[0]).cast(timed.schema[key].dataType)).withColumn("at", F.timestamp_micros("at"))


def sign_ins(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(person, event_id, at, outcome, subject) of a stream of (person, event_id, at timestamp, kind, challenge, code).

    ``request`` sends a code (``code``) and opens the challenge ``c<event_id>``; ``verify`` answers ``challenge``; any other kind
    is a call that needs a session. Outcomes: code_sent, signed_in (subject: ``s<event_id>``), wrong_code, too_many_attempts
    (the sixth answer to a challenge, which ends it), expired (nothing is there to answer), served (by the latest session)
    or unauthorised; and code_over, session_over without an event when a lifetime has passed. What ends at a moment is
    still good at that moment.
    """
    return _run(_timed(stream, late), "person", SignIns(), "event_id long, at long, outcome string, subject string")


def swept(stream: DataFrame, seconds: int, final: tuple[str, ...] = (), late: str = "10 minutes") -> DataFrame:
    """(key, since, at): what was last touched at ``since`` and is over at ``at``, ``seconds`` later, of a stream of (key, event_id, at timestamp, status).

    Every row touches its key, and the wait begins anew; a status in ``final`` ends it without a row.
    """
    return _run(_timed(stream, late), "key", Sweep(seconds, final), "since long, at long").withColumn("since", F.timestamp_micros("since"))


def barrier_stream(uploads: DataFrame, statuses: DataFrame, seconds: int = STALE_SECONDS, final: tuple[str, ...] = tuple(FINAL_STATUSES), removed: str = "removed_by_user", late: str = "10 minutes") -> DataFrame:
    """(application, at, ready, given_up, documents): each application, once, when the last of its documents is final.

    ``uploads``: (application, document, event_id, at timestamp), a stream of documents that come in; ``statuses``: the same
    with status, a stream of what becomes of them; the watermark is that of the stream that is behind. Removed documents do not count. A document of which nothing is heard
    for ``seconds`` is given up and counts as final. What comes in afterwards opens the application anew; a status of a
    document that came out already, or never came in, changes nothing.
    """
    opened = _timed(uploads.select("application", "document", "event_id", "at", F.lit(UPLOADED).alias("status")), late)
    both = opened.unionByName(_timed(statuses.select("application", "document", "event_id", "at", "status"), late))
    return _run(both, "application", Barrier(seconds, final, removed), "at long, ready int, given_up int, documents int")


#: Rows of a file of a stream that is replayed; a micro-batch has as many files as its rows need.
FILE_ROWS = 50_000


def replayed(rows: DataFrame, at: str, parts: int) -> DataFrame:
    """A stream of the rows of a table in ``parts`` micro-batches, by ranges of ``at``.

    ``rows`` are computed once. Every part has equally many files, written and read by as many tasks; where one has fewer
    rows than files, empty files make up for them, so that a trigger takes a part.
    """
    spark = rows.sparkSession
    path, rows = shared_path(spark, "replay"), written(rows, "replayed")
    low, high, many = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at)), F.count("*")).first()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
    files = max(1, -(-many // (parts * FILE_ROWS)))
    for n in range(parts):  # one after the other, so that files are taken in this order
        own = f"{path}-{n}"
        rows.where(F.floor((F.unix_micros(at) - F.lit(low or 0)) / step) == n).repartition(files).write.parquet(own)
        there = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(own).select("path").count()
        for _ in range(files - there):
            rows.limit(0).coalesce(1).write.mode("append").parquet(own)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}-*")


def run_to_end(stream: DataFrame, label: str, seconds: int = 1_800) -> DataFrame:
    """The table that a stream leaves when it has taken in all that there is now."""
    spark = stream.sparkSession
    out, state = shared_path(spark, label), shared_path(spark, f"{label}-state")
    query = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    try:
        if not query.awaitTermination(seconds):
            raise TimeoutError(f"the stream {label} has not ended after {seconds} seconds")
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(out)
