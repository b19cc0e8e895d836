"""Streams with state against plain simulations: rows out of order, rows that are too late, ends by the watermark."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from corrobora.streaming import lifetimes

T0 = 1_700_000_000_000_000
MINUTE = 60_000_000


def at(us):
    return datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(tzinfo=None, microsecond=us % 1_000_000)


def micros(x):
    return round(x.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


def stream_of(spark, path, batches, schema):
    for n, rows in enumerate(batches):
        spark.createDataFrame([(*r[:1], *r[1:2], at(r[2]), *r[3:]) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def in_time(batches, delay):
    """(rows that are not too late, in order of time and event; the last watermark). Spark drops rows by the watermark of the batch before."""
    old = mark = -(1 << 62)
    taken = []
    for rows in batches:
        taken += [r for r in rows if r[2] > old]
        old, mark = mark, max(mark, (max(r[2] for r in rows) // 1000 - delay // 1000) * 1000)
    return sorted((r for r in taken if r[2] < mark), key=lambda r: (r[2], r[1])), mark


def mixed(rng, n, make):
    """Batches of rows that arrive up to four minutes late, and some by half an hour."""
    rows = []
    for i in range(n):
        t = T0 + rng.randrange(240 * MINUTE)
        rows.append((t + rng.randrange(4 * MINUTE) + (30 * MINUTE if rng.random() < 0.02 else 0), make(i, t)))
    rows.sort()
    step = -(-n // 5)
    return [[r for _, r in rows[i : i + step]] for i in range(0, n, step)]


def test_sign_ins_are_a_simulation(spark, tmp_path):
    rng = random.Random(2)

    def make(i, t):
        kind = rng.choice(["request", "verify", "verify", "verify", "call"])
        return (rng.randrange(4), i, t, kind, f"c{rng.randrange(max(1, i))}", str(rng.randrange(2)))

    batches = mixed(rng, 600, make)
    # A run of answers: five are wrong, the sixth ends the challenge although it is right.
    quick = [(9, 1000 + i, T0 + 10 * MINUTE + i * 1000, "verify", "c999", "x" if i < 5 else "1") for i in range(7)]
    batches[0] += [(9, 999, T0 + 10 * MINUTE - 1, "request", "", "1"), *quick, (9, 1100, T0 + 11 * MINUTE, "call", "", "")]
    batches[0] += [(8, 1200, T0, "request", "", "1"), (8, 1201, T0 + 5 * MINUTE, "verify", "c1200", "1"), (8, 1202, T0 + 65 * MINUTE, "call", "", ""), (8, 1203, T0 + 65 * MINUTE + 1, "call", "", "")]
    schema = "person long, event_id long, at timestamp, kind string, challenge string, code string"
    out = lifetimes.run_to_end(lifetimes.sign_ins(stream_of(spark, tmp_path / "in", batches, schema), "5 minutes"), "t-sign")
    got = sorted((r["person"], r["event_id"] if r["event_id"] is not None else -1, micros(r["at"]), r["outcome"], r["subject"]) for r in out.collect())

    rows, mark = in_time(batches, 5 * MINUTE)
    want, codes, sessions = [], {}, {}
    for p, e, t, kind, challenge, code in rows:
        if kind == "request":
            codes[p, f"c{e}"] = [t + 5 * MINUTE, code, 0, "open"]
            want.append((p, e, t, "code_sent", f"c{e}"))
        elif kind == "verify":
            c = codes.get((p, challenge))
            if c is None or c[3] != "open" or c[0] < t:
                want.append((p, e, t, "expired", challenge))
                continue
            c[2] += 1
            if c[2] > 5:
                c[3] = "used"
                want.append((p, e, t, "too_many_attempts", challenge))
            elif c[1] != code:
                want.append((p, e, t, "wrong_code", challenge))
            else:
                c[3], sessions[p, f"s{e}"] = "used", t + 60 * MINUTE
                want.append((p, e, t, "signed_in", f"s{e}"))
        else:
            live = [(end, s) for (q, s), end in sessions.items() if q == p and end >= t]
            want.append((p, e, t, *(("served", max(live)[1]) if live else ("unauthorised", ""))))
    want += [(p, -1, c[0], "code_over", name) for (p, name), c in codes.items() if c[3] == "open" and c[0] < mark]
    want += [(p, -1, end, "session_over", name) for (p, name), end in sessions.items() if end < mark]
    assert len(rows) < sum(map(len, batches))  # some were too late, or too new
    assert got == sorted(want)
    assert {"signed_in", "too_many_attempts", "wrong_code", "expired", "served", "unauthorised", "code_over", "session_over"} <= {r[3] for r in got}
    assert (8, 1201, T0 + 5 * MINUTE, "signed_in", "s1201") in got and (8, 1202, T0 + 65 * MINUTE, "served", "s1201") in got and (8, 1203, T0 + 65 * MINUTE + 1, "unauthorised", "") in got


def test_sweeps_are_a_simulation(spark, tmp_path):
    rng = random.Random(4)
    batches = mixed(rng, 400, lambda i, t: (rng.randrange(12), i, t, rng.choice(["put", "put", "taken", None])))
    out = lifetimes.run_to_end(lifetimes.swept(stream_of(spark, tmp_path / "in", batches, "key long, event_id long, at timestamp, status string"), 600, ("taken",), "5 minutes"), "t-sweep")
    rows, mark = in_time(batches, 5 * MINUTE)
    want = []
    for key in range(12):
        own = [r for r in rows if r[0] == key]
        for r, after in zip(own, [*[x[2] for x in own[1:]], mark]):
            if r[3] != "taken" and r[2] + 10 * MINUTE < after:
                want.append((key, r[2], r[2] + 10 * MINUTE))
    assert sorted((r["key"], micros(r["since"]), micros(r["at"])) for r in out.collect()) == sorted(want) and want


def test_an_application_comes_out_once(spark, tmp_path):
    rng = random.Random(6)
    statuses = ["ready", "ready", "unreadable", "pending", "removed_by_user"]
    ups = mixed(rng, 150, lambda i, t: (rng.randrange(5), 2 * i, t, f"d{i % 9}"))
    done = mixed(rng, 400, lambda i, t: (rng.randrange(5), 2 * i + 1, t, f"d{rng.randrange(9)}", rng.choice(statuses)))
    schema = "application long, event_id long, at timestamp, document string"
    out = lifetimes.run_to_end(lifetimes.barrier_stream(stream_of(spark, tmp_path / "a", ups, schema), stream_of(spark, tmp_path / "b", done, f"{schema}, status string"), 600, late="8 minutes"), "t-barrier")
    # The watermark is the lesser of both, so a row is too late by what both streams have shown.
    old, mark, rows = -(1 << 62), -(1 << 62), []
    tops = [-(1 << 62)] * 2
    for a, b in zip(ups, done):
        rows += [(*r, "uploaded") for r in a if r[2] > old] + [r for r in b if r[2] > old]
        tops = [max(x, max(r[2] for r in y)) for x, y in zip(tops, (a, b))]
        old, mark = mark, (min(tops) // 1000 - 8 * 60_000) * 1000
    want = []
    for app in range(5):
        state = {}

        def check(t, state=state, app=app):
            if state and all(s[0] != "pending" for s in state.values()):
                want.append((app, t, sum(s[0] == "ready" for s in state.values()), sum(s[0] == "given_up" for s in state.values()), len(state)))
                state.clear()

        def give_up(until, state=state):
            for end, d in sorted((s[1] + 10 * MINUTE, d) for d, s in state.items() if s[0] == "pending" and s[1] + 10 * MINUTE < until):
                state[d] = ("given_up", end)
                check(end)

        for _, _, t, d, s in sorted((r for r in rows if r[0] == app and r[2] < mark), key=lambda r: (r[2], r[1])):
            give_up(t)
            if s == "removed_by_user":
                state.pop(d, None)
            elif s == "uploaded" or d in state:
                state[d] = (s if s in ("ready", "unreadable") else "pending", t)
            check(t)
        give_up(mark)
    assert sorted((r["application"], micros(r["at"]), r["ready"], r["given_up"], r["documents"]) for r in out.collect()) == sorted(want)
    assert any(w[3] for w in want) and any(w[2] > 1 for w in want)


def test_state_is_kept_by_slices(spark, tmp_path, monkeypatch):
    """Many keys share a call and a state; keys that are null or beyond what a double holds stay apart."""
    monkeypatch.setattr(lifetimes, "SLICES", 4)
    keys = [*range(200), (1 << 53) + 1, 1 << 53, None]
    batches = [[(k, i, T0 + i * 1000, "put") for i, k in enumerate(keys)], [(1, 9999, T0 + 60 * MINUTE, "taken")]]
    stream = stream_of(spark, tmp_path / "in", batches, "key long, event_id long, at timestamp, status string")
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    q = lifetimes.swept(stream, 600, ("taken",), "5 minutes").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(path)
    try:
        q.awaitTermination(300)
        most = max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])
    finally:
        q.stop()
    assert most <= 4
    got = [(r["key"], micros(r["since"]), micros(r["at"])) for r in spark.read.parquet(path).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(k, T0 + i * 1000, T0 + i * 1000 + 10 * MINUTE) for i, k in enumerate(keys)]


def test_a_replay_of_nothing(spark):
    rows = spark.createDataFrame([], "key long, event_id long, at timestamp, status string")
    assert lifetimes.run_to_end(lifetimes.swept(lifetimes.replayed(rows, "at", 2), 600), "t-none").collect() == []
    with pytest.raises(AssertionError):
        lifetimes.Barrier(1, (), "").over((1,), "d", 0, ())


def test_a_part_of_a_replay_is_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(lifetimes, "FILE_ROWS", 10)
    # The second part has one row for four files, the third has none but the last moment's.
    rows = spark.createDataFrame([(i, at(T0 + i * 1_000_000)) for i in (*range(100), 150, 299)], "event_id long, at timestamp")
    stream, batches = lifetimes.replayed(rows, "at", 3).withColumn("file", F.input_file_name()), []
    query = stream.writeStream.foreachBatch(lambda b, n: batches.append(b.collect()) and None).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    assert [sorted(r["event_id"] for r in b) for b in batches] == [list(range(100)), [150], [299]]
    assert len({r["file"] for r in batches[0]}) == 4
