"""Large groups searched by all pairs of blocks: nothing is lost, whatever the order of the sketches does."""

import random

import pytest

import corpus_pipeline
from corrobora.llm import neardup, queries
from tests.llm.test_llm import brute_components, frame, words


@pytest.mark.parametrize("seed", [1])
def test_no_link_is_lost(spark, monkeypatch, seed):
    rng = random.Random(seed)
    base = words(rng, 60, 10**6)
    rows = []
    for _ in range(150):
        own = list(base)
        for i in rng.sample(range(60), rng.randrange(2, 9)):
            own[i] = f"x{rng.randrange(40)}"
        rows.append(" ".join(own))
    rows += [" ".join(words(rng, 30, 10**6)) for _ in range(5)] + ["", rows[0], rows[0]]
    data = list(enumerate(rows))
    want = brute_components(data, 2, 80)
    monkeypatch.setattr(neardup, "WINDOW", 8)
    # One search only, in the order of a constant: blocks of rows that have little to do with each other.
    monkeypatch.setattr(neardup, "SEARCHES", 1)
    monkeypatch.setattr(neardup, "sketch", lambda sig: b"\0" * neardup.BINS)
    bounded = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, data), 2, 80).collect()}
    exact = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, data), 2, 80, exact=True).collect()}
    assert exact == {i: v[1] for i, v in want.items()}
    assert all(bounded[i] >= v for i, v in exact.items())


def near_copies(rng, n, length, most):
    base, rows = words(rng, length, 10**6), []
    for _ in range(n):
        own = list(base)
        for i in rng.sample(range(length), rng.randrange(2, most)):
            own[i] = f"x{rng.randrange(40)}"
        rows.append(" ".join(own))
    return list(enumerate(rows))


def test_queries_search_large_groups_exactly(spark, monkeypatch, tmp_path):
    """op3 and the pipeline's stage, where the bounded search cuts groups into blocks that have little to do with each other."""
    monkeypatch.setattr(neardup, "WINDOW", 8)
    monkeypatch.setattr(neardup, "SEARCHES", 1)
    monkeypatch.setattr(neardup, "sketch", lambda sig: b"\0" * neardup.BINS)
    data = near_copies(random.Random(2), 120, 60, 9)
    want = {i: v[1] for i, v in brute_components(data, 2, 80).items()}
    bounded = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, data), 2, 80, exact=False).collect()}
    assert bounded != want
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op3_minhash"](spark, str(tmp_path)).collect()} == want
    data = near_copies(random.Random(3), 120, 200, 5)
    want = {i for i, v in brute_components(data, 5, 80).items() if v[1] == i}
    bounded = {r["doc_id"] for r in neardup.near_duplicates(frame(spark, data), 5, 80, exact=False).where("kept").collect()}
    assert bounded != want
    assert {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, frame(spark, data), "").collect()} == want


def test_blocks_do_not_depend_on_partitions(spark, monkeypatch):
    """The exact search repeats its rows once for each block that they meet: blocks cut where partitions end would be many more."""
    tables, write = [], neardup.materialize

    def spied(df, label, **seen):
        tables.append((label, out := write(df, label, **seen)))
        return out

    monkeypatch.setattr(neardup, "materialize", spied)
    monkeypatch.setattr(neardup, "WINDOW", 32)
    monkeypatch.setattr(neardup, "SEARCHES", 1)
    monkeypatch.setattr(neardup, "sketch", lambda sig: b"\0" * neardup.BINS)
    data = near_copies(random.Random(2), 120, 60, 9)
    want = {i: v[1] for i, v in brute_components(data, 2, 80).items()}
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, data), 2, 80).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert 2 <= [neardup.facts(t)["rows"] for label, t in tables if label == "blocks"][-1] <= 10
