"""Archives, folders and committed sinks: guards, partitions, commits that fail, are repeated or pruned; signatures against the JVM's."""

import io
import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from corrobora.functions import canonical, ed25519
from corrobora.plans import records, signing
from corrobora.sources import archives, committed, uploads
from corrobora.streaming import lifetimes

PNG = b"\x89PNG\r\n\x1a\n" + b"x" * 20


def archive(*entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            info = zipfile.ZipInfo(name.removeprefix("link:"))
            info.compress_type = method
            info.external_attr = (0o120777 if name.startswith("link:") else 0o100644) << 16
            z.writestr(info, data)
    return out.getvalue()


def told(data, limits=uploads.LIMITS, **more):
    return [(n, e, d, w) for n, e, d, w in archives.members(io.BytesIO(data), limits, **more)]


def test_members_and_their_guards():
    got = {e: (d, w) for _, e, d, w in told(archive(("a.png", PNG), ("../b", b"x"), ("/c", b"x"), ("C:/d", b"x"), ("e\\..\\..\\f", b"x"), ("link:g", b"a.png"), ("h.zip", archive(("x", b"y"))), ("i.jpg", b"MZ\x90"), ("j", b""), ("k.txt", "ü".encode()), ("__MACOSX/l", b"x"), ("m/", b""), ("n/.DS_Store", b"x"), ("o.bin", b"\xff\x00")))}
    assert got == {"a.png": (PNG, ""), "../b": (None, "path_traversal"), "/c": (None, "absolute_path"), "C:/d": (None, "absolute_path"), "e\\..\\..\\f": (None, "path_traversal"), "g": (None, "symlink"), "h.zip": (None, "nested_archive"), "i.jpg": (None, "executable"), "j": (None, "empty_file"), "k.txt": ("ü".encode(), ""), "o.bin": (None, "unsupported_type")}
    assert told(b"no") == [(-1, "", None, "bad_archive")] and told(b"") == [(-1, "", None, "bad_archive")]
    assert told(archive(("a", b"x"), ("bomb", b"0" * 1_100_000))) == [(-1, "", None, "compression_bomb")]
    few = uploads.LIMITS | {"files": 1, "file": 10, "total": 25}
    assert told(archive(*[(str(i), b"x") for i in range(5)]), few) == [(-1, "", None, "too_many_entries")]
    assert told(archive(*[(str(i), b"123456789") for i in range(3)]), few) == [(-1, "", None, "archive_too_large")]
    assert told(archive(("a", b"x"), ("b", b"x" * 11)), few) == [(0, "a", b"x", ""), (1, "b", None, "file_too_large")]
    assert [r[0] for r in told(archive(*[(str(i), b"x") for i in range(6)]), first=2, last=4)] == [2, 3]


def test_sizes_that_lie_and_broken_members():
    data = bytearray(archive(("a", b"y" * 5_000), ("b", b"fine"), method=zipfile.ZIP_STORED))
    at = data.rfind(b"PK\x01\x02", 0, data.rfind(b"PK\x01\x02"))
    small = uploads.LIMITS | {"file": 1_000}
    data[at + 24 : at + 28] = (10).to_bytes(4, "little")  # the directory claims ten bytes
    assert [w for *_, w in told(bytes(data), small)][0] in ("file_too_large", "unreadable_entry")
    torn = bytearray(archive(("a", os.urandom(2_000)), ("b", b"fine")))
    torn[60:70] = b"\0" * 10
    assert [(e, w) for _, e, _, w in told(bytes(torn))] == [("a", "unreadable_entry"), ("b", "")]


def test_table_functions_beside_a_table(spark):
    files = spark.createDataFrame([(1, archive(("a", b"one"), ("b", b"two"))), (2, None), (3, b"no"), (4, archive())], "id int, content binary")
    got = files.lateralJoin(archives.archive_members()(F.col("content").outer())).toDF("id", "packed", "number", "entry", "content", "reason")
    assert sorted((r["id"], r["number"], r["entry"], r["content"] and bytes(r["content"]), r["reason"]) for r in got.collect()) == [(1, 0, "a", b"one", ""), (1, 1, "b", b"two", ""), (3, -1, "", None, "bad_archive")]

    def render(pdf):
        for i in range(pdf[0]):
            if pdf[1:2] == b"!" and i == 2:
                raise ValueError("torn")
            yield b"%d" % i

    pdfs = spark.createDataFrame([(1, bytes([2])), (2, bytes([20])), (3, bytes([21])), (4, b"\x05!"), (5, None)], "id int, content binary")
    rows = pdfs.lateralJoin(archives.pdf_pages(render)(F.col("content").outer())).groupBy("id").agg(F.count_if(F.col("reason") == "").alias("n"), F.max("reason").alias("why")).collect()
    assert sorted(map(tuple, rows)) == [(1, 2, ""), (2, 20, ""), (3, 0, "pdf_too_many_pages"), (4, 0, "pdf_failed")]


def test_a_folder_is_read_in_partitions(spark, tmp_path):
    big = archive(*[(f"{i:02}.bin", b"%PDF" + os.urandom(2_000)) for i in range(12)])
    files = {"one/big.zip": big, "one/a.png": PNG, "one/deep/er/b.txt": b"hello", "two/none": b"", "two/c.exe": b"MZ", "top.txt": b"top", "two/bad.zip": b"PK\x03\x04 no", "two/large.txt": b"x" * 30_000}
    archives.saved(spark.createDataFrame(list(files.items()), "path string, content binary"), str(tmp_path))
    archives.register(spark)
    read = spark.read.format("upload_folder").option("partitionBytes", 9_000).option("file", 25_000).load(str(tmp_path))
    assert read.rdd.getNumPartitions() >= 4
    got = {(r["upload"], r["path"], r["number"]): (r["entry"], r["mime"], r["bytes"], r["reason"]) for r in read.collect()}
    assert len(got) == 12 + 7
    assert got["one", "one/big.zip", 7] == ("07.bin", "application/pdf", 2_004, "") and got["one", "one/deep/er/b.txt", 0] == ("", "text/plain", 5, "") and got["", "top.txt", 0][1:] == ("text/plain", 3, "")
    assert [got["two", f"two/{f}", n][3] for f, n in (("none", 0), ("c.exe", 0), ("bad.zip", -1), ("large.txt", 0))] == ["empty_file", "executable", "bad_archive", "file_too_large"]
    whole = spark.read.format("upload_folder").load(f"file://{tmp_path}")
    assert whole.count() == len(got)
    kept = archives.room(read, uploads.LIMITS | {"files": 3, "total": 4_100}).where("upload = 'one'").orderBy("path", "number").collect()
    assert [r["reason"] for r in kept[:4]] == ["", "", "", "max_files"] and kept[3]["content"] is None and kept[0]["entry"] == ""
    empty = tmp_path / "empty"
    empty.mkdir()
    assert spark.read.format("upload_folder").load(str(empty)).collect() == []


# --- commits


def put(spark, path, *contents):
    committed.put(spark.createDataFrame([(c,) for c in contents], "content binary"), path)


def held(spark, path):
    return sorted(bytes(r["content"]) for r in committed.blobs(spark, path).collect())


def segments(path):
    return sorted(os.listdir(path / "segments")) if (path / "segments").exists() else []


def test_putting_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    assert held(spark, path) == []
    put(spark, path, b"a", b"b", b"a", None)
    first = segments(tmp_path / "s")
    put(spark, path, b"a", b"b")
    assert held(spark, path) == [b"a", b"b"] and segments(tmp_path / "s") == first and len(committed.manifests(path)) == 2
    one = spark.createDataFrame([(b"a",), (b"z",)], "content binary").select(F.sha2("content", 256).alias("hash"))
    committed.remove(one, path)
    assert held(spark, path) == [b"b"]
    committed.remove(one, path)
    put(spark, path, b"a", b"c")
    assert held(spark, path) == [b"a", b"b", b"c"]
    assert [bytes(r["content"]) for r in committed.find(spark, path, [r["hash"] for r in one.collect()]).collect()] == [b"a"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    committed.register(spark)
    path = str(tmp_path / "f")
    spark.range(4).write.format("committed_log").mode("append").save(path)
    before = segments(tmp_path / "f")
    bad = spark.range(0, 40, 1, 4).select(F.when(F.col("id") == 37, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("committed_log").mode("append").save(path)
    assert spark.read.format("committed_log").load(path).count() == 4 and len(committed.manifests(path)) == 1
    time.sleep(3)  # tasks of the job that still ran are killed
    committed.vacuum(path, 0)  # what one of them may have left half-way
    assert segments(tmp_path / "f") == before
    late = committed.BatchWriter({"path": path}, spark.range(1).schema)
    late.give_up()
    with pytest.raises(RuntimeError, match="aborted"):
        late.write(iter([]))
    (tmp_path / "f" / "segments" / "lost.parquet").write_bytes(b"x")  # of a machine that went away
    assert spark.read.format("committed_log").load(path).count() == 4
    assert committed.vacuum(path) == 0 and committed.vacuum(path, 0) == 1 and segments(tmp_path / "f") == before
    with pytest.raises(Exception, match="only appended to"):
        spark.range(1).write.format("committed_log").mode("overwrite").save(path)
    with pytest.raises(Exception, match="nothing was committed"):
        spark.read.format("committed_log").load(str(tmp_path / "none"))


def test_a_named_commit_happens_once_and_ranges_prune(spark, tmp_path):
    committed.register(spark)
    path = str(tmp_path / "n")
    rows = lambda lo, hi: spark.range(lo, hi, 1, 1).select(F.format_string("k%03d", "id").alias("k"), "id")
    for lo in (0, 100, 200):
        for _ in range(2):
            rows(lo, lo + 100).write.format("committed_log").option("commit", f"batch-{lo}").option("key", "k").mode("append").save(path)
    read = spark.read.format("committed_log").load(path)
    assert read.count() == 300 and read.rdd.getNumPartitions() == 3 and read.columns == ["k", "id", "commit_at", "commit_name"]
    one = read.where("k = 'k150'")
    assert one.rdd.getNumPartitions() == 1 and [r["id"] for r in one.collect()] == [150]
    assert read.where("k = 'none'").collect() == [] and read.where("k IN ('k001', 'k299')").rdd.getNumPartitions() == 2


# --- signatures


def test_signatures_are_the_jvms(spark):
    seed, public, mark = (bytes.fromhex(x) for x in ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"))  # RFC 8032, 7.1, test 3
    assert ed25519.public_key(seed) == public and ed25519.sign(seed, b"\xaf\x82") == mark and ed25519.verify(public, b"\xaf\x82", mark)
    assert not ed25519.verify(public, b"\xaf\x83", mark) and not ed25519.verify(public, b"\xaf\x82", mark[:-1] + b"\x7f") and not ed25519.verify(public, b"", b"") and not ed25519.verify(b"\xff" * 32, b"", mark)
    own, j = bytes(range(32)), spark.sparkContext._jvm.java.security
    factory = j.KeyFactory.getInstance("Ed25519")
    private = factory.generatePrivate(j.spec.PKCS8EncodedKeySpec(bytearray(bytes.fromhex("302e020100300506032b657004220420") + own)))
    jvm = records.Signer(spark, j.KeyPair(factory.generatePublic(j.spec.X509EncodedKeySpec(bytearray(bytes.fromhex("302a300506032b6570032100") + ed25519.public_key(own)))), private))
    for record in ({"b": 1, "a": [2, {"z": None, "y": 0.5}]}, {"name": "Zoë \u0001", "n": 1e21}, {}):
        assert ed25519.sign(own, canonical.canonical(record).encode()).hex() == jvm.sign(record) and jvm.verify(record, jvm.sign(record))


def test_there_is_one_form_of_json():
    assert canonical.canonical({"b": [1.0, True, None], "a": {"d": "é\"\n", "c": -0.0}, "\ue000": 1, "\U0001f600": 2}) == '{"a":{"c":0,"d":"é\\"\\n"},"b":[1,true,null],"\U0001f600":2,"\ue000":1}'
    assert [canonical.number(x) for x in (1e21, 1e20, 1.5e-7, 0.000001, 123.456, -5.0, 2**60, float("nan"), 1e-7, 12345678901234567890.0)] == ["1e+21", "100000000000000000000", "1.5e-7", "0.000001", "123.456", "-5", "1152921504606847000", "null", "1e-7", "12345678901234567000"]


def test_a_replayed_batch_adds_no_record(spark, tmp_path):
    path, seed = str(tmp_path / "signed"), b"k" * 32
    rows = spark.createDataFrame([(i, None if i == 3 else "no json" if i == 4 else json.dumps({"z": i, "a": i / 2})) for i in range(20)], "id int, record string").withColumn("at", F.timestamp_seconds("id"))
    stream = lifetimes.replayed(rows, "at", 2)
    for n in range(2):
        q = signing.signed_sink(stream, seed, path, "r").option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    log = spark.read.format("committed_log").load(path)
    got = {r["id"]: r for r in signing.verified(log, ed25519.public_key(seed)).collect()}
    assert len(got) == log.count() == 20 and {i for i, r in got.items() if not r["valid"]} == {3, 4}
    assert got[5]["payload"] == '{"a":2.5,"z":5}' and got[6]["payload"] == '{"a":3,"z":6}'
    changed = log.withColumn("payload", F.replace("payload", F.lit('"z":7'), F.lit('"z":8')))
    assert {r["id"] for r in signing.verified(changed, ed25519.public_key(seed)).where("NOT valid").collect()} == {3, 4, 7}
    assert signing.signed(rows.limit(0), seed).collect() == []


def test_found_files_come_in_few_frames():
    rows = [(i, b"x" * 10) for i in range(uploads.FRAME_ROWS + 5)]
    frames = list(uploads.framed(iter(rows), ["n", "content"], lambda r: len(r[1])))
    assert [len(f) for f in frames] == [uploads.FRAME_ROWS, 5] and [n for f in frames for n in f["n"]] == list(range(len(rows)))
    large = [(i, b"x" * (uploads.FRAME_BYTES // 2)) for i in range(3)]
    assert [len(f) for f in uploads.framed(iter(large), ["n", "content"], lambda r: len(r[1]))] == [2, 1]
    assert list(uploads.framed(iter(()), ["n"], len)) == []


def test_contents_leave_in_small_batches(spark):
    """Archives are packed and saved without Arrow frames, which hold 10,000 rows however large they are."""
    names, bodies = F.array(F.lit("a.txt")), F.array(F.encode(F.lit("x"), "UTF-8"))
    plan = spark.range(3).select(archives.zipped(names, bodies).alias("content"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
