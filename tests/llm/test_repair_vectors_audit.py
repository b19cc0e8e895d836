"""Conversation repair, the vector join and the filter audit against brute force, on small fixtures and awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from corrobora.llm import convrepair, epsgrid, filteraudit

# --- conversation repair


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every edit; rows: (role, text, must, truncated)."""
    legal = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    given = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    best = {}

    def after(at, state, inserts):
        key = at, state, inserts
        if key in best:
            return best[key]
        out = [(0, "", ())] if at == len(rows) and state in (0, 3) else []
        if inserts < 3:
            for c, a, r in after(at, legal[state][given[state][0]], inserts + 1):
                out.append((c + 5, "I" + a, ((given[state], ""), *r)))
        if at < len(rows):
            role, text, must, truncated = rows[at]
            out += [(c + 2, "D" + a, r) for c, a, r in after(at + 1, state, 0)]
            if not must:
                more = 5 if truncated else 0
                if role[:1] in legal[state]:
                    out += [(c + more, "K" + a, ((role, text), *r)) for c, a, r in after(at + 1, legal[state][role[:1]], 0)]
                for new in ("user", "assistant"):
                    if new[0] in legal[state]:
                        out += [(c + more + 1, "R" + a, ((new, text), *r)) for c, a, r in after(at + 1, legal[state][new[0]], 0)]
        best[key] = [min(out)] if out else []
        return best[key]

    return after(0, 0, 0)[0]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def brute_repair(rows):
    """By conversation, what repair_digest() has to return; rows: (conv_id, turn, role, text), nulls and all."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            space = lambda v: " " if v is None else str(v)
            h, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            own += [(turn is not None, turn or 0, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        own.sort(key=lambda r: (*r[:3], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()[:16]))
        what = faults([r[2:] for r in own])
        cost, audit, kept = cheapest([(r[2], r[3], w in ("blank", "duplicate"), w == "truncated") for r, w in zip(own, what)])
        turns = {r[1] for r in own if r[0]}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, what.count("blank"), what.count("duplicate"), what.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, audit string, kind int"


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in random.Random(3).sample(rows, len(rows))], CONVERSATIONS)
    got = convrepair.repair_digest(convrepair.damage(df)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}, df


TEXTS = ["Fine.", "Why?", "cut off", "", " \n\t", "Yes!  \n", "a. b", "Fine.", "ü…", None, ".", "x" * 70_000 + "."]


def test_repair_is_the_cheapest(spark):
    rng = random.Random(11)
    rows = [(c, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage"]), rng.choice(TEXTS)) for c in range(250) for t in range(rng.randrange(1, 12))]
    rows += [(None, t, ("user", "assistant")[t % 2], "Null names count.") for t in range(5)] + [(900, 2**62, "user", "Far."), (900, 4, "user", "Near."), (901, None, "user", "No turn."), (902, 1, "user", "Twice."), (902, 1, "user", "Twice.")]
    rows += [(c, 1, "user", "May go.") for c in range(1000, 1030)]  # some lose their only row
    got, df = repaired(spark, rows)
    want = brute_repair(rows)
    assert got == want
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in want.values())
    turns = sorted((r["conv_id"] is not None, r["conv_id"] or 0, r["place"], r["role"], r["text"]) for r in convrepair.repaired_turns(convrepair.damage(df)).collect())
    for conv, lines in itertools.groupby(turns, key=lambda r: r[:2]):
        lines = list(lines)
        assert [r[2] for r in lines] == list(range(1, len(lines) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[3][:1] for r in lines))
        assert hashlib.sha256("\n".join(f"{r[3]}:{r[4]}" for r in lines).encode()).hexdigest() == got[conv[1] if conv[0] else None][-1]


def test_repair_of_nothing(spark):
    got, df = repaired(spark, [(1, 1, "user", "One.")])
    assert convrepair.repair_digest(convrepair.damage(df.limit(0))).collect() == [] and convrepair.repaired_turns(convrepair.damage(df.limit(0))).collect() == []


@pytest.mark.parametrize("piece", [3, 1024])
def test_pieces_and_buckets_change_nothing(monkeypatch, piece):
    monkeypatch.setattr(convrepair, "PIECE", piece)
    monkeypatch.setattr(convrepair, "CELLS", 64)
    rng = np.random.default_rng(piece)
    size = rng.integers(1, 14, 300)
    n = int(size.sum())
    kind, must, cut, first = rng.integers(0, 4, n), rng.random(n) < 0.15, rng.random(n) < 0.2, np.cumsum(size) - size
    edit, inserted, _, cost, last = convrepair.cheapest(kind, must, cut & ~must, first)
    audit = convrepair.spelled(edit, inserted, first, last)
    for i, lo in enumerate(first):
        rows = [("suax"[kind[j]], "", must[j], cut[j] and not must[j]) for j in range(lo, lo + size[i])]
        assert (cost[i], audit[i]) == cheapest(rows)[:2]


def test_a_task_takes_in_whole_conversations(spark, monkeypatch):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Turn {t}.") for c in (1, 2, 3) for t in range(1, 1500)]
    got, _ = repaired(spark, rows)
    for c, v in got.items():
        own = [r for r in rows if r[0] == c]
        assert v[0] <= 1498 and len(v[6]) >= v[1] and v[5] == brute_cost(own)


def brute_cost(rows):
    """The cost alone, state by state."""
    inf = float("inf")
    own = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [("user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    cost = [0, inf, inf, 0]
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    close = lambda c: [min(c[s], 5 + c[step[s]], 10 + c[step[step[s]]]) for s in range(4)]
    cost = close(cost)
    for (role, text), fault in reversed(list(zip(own, faults(own)))):
        new = []
        for s in range(4):
            options = [2 + cost[s]]
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                options += [1 + more + cost[step[s]], more + (cost[step[s]] if role[0] == ("a" if s == 2 else "u") else inf)]
            new.append(min(options))
        cost = close(new)
    return cost[0]


# --- vectors


def brute_vectors(rows, cosine=0.9):
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    xs = [np.asarray(v, np.float64) if o else None for (_, v), o in zip(rows, ok)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations([i for i, o in enumerate(ok) if o], 2):
        if len(xs[a]) == len(xs[b]) and xs[a] @ xs[b] >= cosine * np.sqrt(xs[a] @ xs[a]) * np.sqrt(xs[b] @ xs[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    low = {}
    for i, o in enumerate(ok):
        if o:
            low[find(i)] = min(low.get(find(i), 10**9), rows[i][0])
    return sorted(((i, links[n], low[find(n)] if ok[n] else i, i is None or not ok[n] or i == low[find(n)]) for n, (i, _) in enumerate(rows)), key=str)


def vectors_of(spark, rows, kind="float", **more):
    df = spark.createDataFrame([(*r, 5) for r in rows], f"vec_id long, embedding array<{kind}>, n_links int")
    return sorted((tuple(r) for r in epsgrid.near_vectors(df, **more).collect()), key=str)


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(3)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f(rng.normal(size=16))) for i in range(200)]
    centre = rng.normal(size=16)
    rows += [(1000 + i, f(centre + rng.normal(size=16) * 0.25)) for i in range(120)]  # a cloud that chains hold together
    rows += [(3000 + i, rows[7][1]) for i in range(40)] + [(3100 + i, f(1.5 * np.array(rows[7][1]))) for i in range(3)]  # copies, and multiples
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] * 16), (4003, [None] + [1.0] * 15), (4004, []), (4005, [float("inf")] * 16), (None, rows[7][1]), (None, None)]
    rows += [(4010, [1.0, 2.0]), (4011, [2.0, 4.0]), (4012, [-1.0, -2.0]), (4013, [1e30, 2e30]), (4014, f([1e-40, 2e-40])), (4015, [-0.0, 1.0]), (4016, [0.0, 1.0]), (5, rows[9][1])]
    want = brute_vectors([(i, v and [x and np.float64(np.float32(x)) for x in v]) for i, v in rows])
    assert vectors_of(spark, rows) == want
    assert vectors_of(spark, rows, interval_bytes=64 * 23, lead=3) == want  # many intervals, several levels


def test_vectors_at_the_threshold(spark):
    rows = [(1, [3.0, 4.0, 0.0]), (2, [4.0, 3.0, 0.0]), (3, [3.0, 4.0, 1e-9])]
    assert vectors_of(spark, rows, kind="double", cosine=0.96) == [(1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False)]  # 24/25 is it, and just under it is not
    assert vectors_of(spark, []) == []
    assert epsgrid.links_exactly(np.array([3.0, 4.0]), np.array([4.0, 3.0]), Fraction("0.96")) and not epsgrid.links_exactly(np.array([3.0, 4.0]), np.array([-4.0, -3.0]), Fraction("0.9"))


def test_distant_blocks_are_skipped():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32)) * 3
    x = np.concatenate([c + rng.normal(size=(300, 32)) * 0.2 for c in centres])
    u = epsgrid.unit(x)
    basis = epsgrid.Basis({32: epsgrid.principal(u, 8)}, 8)
    cells = np.floor(basis.place(u)[:, :-1] / np.sqrt(0.2))
    x = x[np.lexsort(cells.T[::-1])]
    side = epsgrid.Interval(x, np.ones(len(x), np.int64), basis)
    root, done = epsgrid.join_intervals(side, side, 0.9, Fraction("0.9"))
    n = 1 << (-(-len(x) // epsgrid.BLOCK) - 1).bit_length()  # halves of halves
    assert done < 0.5 * n * (n + 1) / 2
    u = epsgrid.unit(x)
    assert (side.links == (u @ u.T >= 0.9).sum(axis=1) - 1).all() and len(set(root.tolist())) == 20


# --- filter audit


def brute_audit(docs, labels):
    bad = {}
    for d, text, lang in docs:
        t, w = text or "", re.findall("[^\x20\x09-\x0d]+", text or "")
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails += "E" * any(d is not None and e is not None and e < d and (u or "") == t for e, u, _ in docs)
        good, toxic = (any(l[0] == d and d is not None and l[i] == 1 for l in labels) for i in (1, 2))
        bad.setdefault(lang or "", []).append((fails, good, toxic))
    out = {}
    for part, own in bad.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                here = [x for x in own if f in x[0] and not set(order[:i]) & set(x[0])]
                shapley[f] += len(here)
                out[part, "".join(order), i + 1] = [sum(not set(order[: i + 1]) & set(x[0]) for x in own), len(here), sum(f in x[0] for x in own) - len(here), sum(x[0] == f for x in own), sum(x[1] for x in here), sum(x[2] for x in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_is_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "d", "e|f", "naïve", "…", "w%d" % rng.randrange(600)])
    docs = [(i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(word() for _ in range(rng.choice([0, 1, 150, 199, 200, 201, 400]))), rng.choice(["en", "de", "", None])) for i in range(80)]
    docs += [(100 + i, docs[i % 7][1], "en") for i in range(30)]  # copies
    docs += [(200, None, "en"), (201, "", "fr"), (202, " \n ", "fr"), (None, docs[3][1], "en"), (None, "alone", None), (50, docs[50][1], "en"), (300, "x" * 50, "xx"), (301, "a b " * 40_000, "xx"), (302, docs[2][1] + "\x85 ", "xx")]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 110, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (4, 0, 0), (4, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int")
    lab = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = filteraudit.audit(df, lab).collect()
    assert {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})
    assert filteraudit.audit(df.limit(0), lab).collect() == []
    assert {r["part"] for r in filteraudit.audit(df, lab.limit(0)).where("good_lost = 0").collect()} == {d[2] or "" for d in docs}


@pytest.mark.parametrize("run", [64, 1 << 20])
def test_counts_of_texts_of_any_length(monkeypatch, run):
    monkeypatch.setattr(filteraudit, "RUN", run)
    filteraudit.powers.cache_clear()
    rng = random.Random(run)
    texts = ["".join(rng.choice("ab AB\n#é|") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130, 700]))) for _ in range(300)]
    texts += ["long" * 100, "long" * 100 + " " + "long" * 100 + " x " + "long" * 99, " " * 200, "a" * 64 + " " + "a" * 64, "é" * 90 + "\té"]
    b = [t.encode() for t in texts]
    got = filteraudit.counts(np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)]))
    for i, t in enumerate(texts):
        w = re.findall("[^\x20\x09-\x0d]+", t)
        assert [int(got[k][i]) for k in ("words", "distinct", "capitals", "symbols", "chars")] == [len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)), len(t)], (i, t)
    filteraudit.powers.cache_clear()


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(filteraudit, "word_hashes", lambda b, s, e: np.zeros(len(s), np.uint64))
    b = [t.encode() for t in ("a b a c", "", "b b", "abc abd abc")]
    got = filteraudit.counts(np.frombuffer(b"".join(b), np.uint8), np.cumsum([0, *map(len, b)]))
    assert got["distinct"].tolist() == [3, 0, 1, 2]
