"""Small fixtures with known answers, and models in plain Python."""

from __future__ import annotations

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from blockloom.functions import binary as B
from blockloom.functions.fingerprint import KIND_CODE
from blockloom.operators import control, inventory, journal, overlay, planning, ranges, verify
from blockloom.plans import fixtures as X
from blockloom.plans import headers
from blockloom.plans import records as plans
from blockloom.sources import descriptors, images, records, sinks

MAP = "disk_id string, start long, length long, kind string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_violations_of_maps(spark):
    e = spark.createDataFrame([("gap", 0, 5, "data"), ("gap", 7, 3, "zero"), ("over", 0, 5, "data"), ("over", 4, 6, "data"), ("ok", 0, 10, "hole"), ("long", 0, 11, "data"), ("short", 0, 9, "data")], MAP)
    s = spark.createDataFrame([(d, 10) for d in ("gap", "over", "ok", "long", "short", "none")], "disk_id string, size long")
    assert rows(ranges.map_violations(e, s)) == [("gap", "gap", 7), ("long", "beyond", 0), ("none", "short", 0), ("over", "overlap", 4), ("short", "short", 9)]


def test_gap_fill_of_an_empty_map_is_one_zero_extent(spark):
    s = spark.createDataFrame([("d", 10)], "disk_id string, size long")
    assert rows(ranges.fill_gaps(spark.createDataFrame([], MAP), s)) == [("d", 0, 10, "zero")]


def test_split_skips_empty_and_keeps_the_tail(spark):
    e = spark.createDataFrame([("d", 0, 0, "data"), ("d", 100, 10, "data")], MAP)
    assert rows(ranges.split(e, 4)) == [("d", 100, 4, "data"), ("d", 104, 4, "data"), ("d", 108, 2, "data")]


def test_bounds_tell_overflow_from_out_of_bounds(spark):
    df = spark.createDataFrame([(1, 2**63 - 1, 5, 10), (2, 5, 6, 10), (3, 5, 5, 10)], "id int, start long, length long, size long")
    assert [r["issue"] for r in ranges.check_bounds(df).orderBy("id").collect()] == ["overflow", "out_of_bounds", None]


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_interval_join_at_any_width(spark, width):
    rng = random.Random(width)
    left = [("d", rng.randint(0, 200), rng.randint(0, 30), "data") for _ in range(40)]
    right = [("d", a := rng.randint(0, 200), a + rng.randint(0, 30), i) for i in range(40)]
    got = ranges.interval_join(spark.createDataFrame(left, MAP), spark.createDataFrame(right, "disk_id string, lo long, hi long, n int"), width)
    assert rows(got.select("start", "length", "n")) == sorted((s, n, i) for _, s, n, _ in left for _, lo, hi, i in right if n and lo < hi and s < hi and lo < s + n)


def test_overlay_against_a_byte_model(spark):
    rng = random.Random(4)
    runs = []
    for layer in range(4):
        size = 2 ** (layer + 1)
        runs += [("d", layer, g * size, size, 1000 * layer + g) for g in rng.sample(range(64 // size), 64 // size // 3 + 1)]
    got = overlay.resolve_mixed(spark.createDataFrame(runs, "disk_id string, layer int, start long, length long, backing_start long"), spark.createDataFrame([("d", 64)], "disk_id string, size long"))
    model = [min(((y, b + p - s) for _, y, s, n, b in runs if s <= p < s + n), default=(None, None)) for p in range(64)]
    seen = [(r["layer"], None if r["layer"] is None else r["backing_start"] + i) for r in got.orderBy("start").collect() for i in range(r["length"])]
    assert seen == model


def test_chain_issues(spark):
    got = {(r["disk_id"], r["depth"]): r["issue"] for r in overlay.walk_chain(spark.createDataFrame([(f"d{n}", i, i + 1 if i < n else None, 8, i == 1) for n in (16, 17) for i in range(1, n + 1)], "disk_id string, cid long, parent_cid long, size long, is_leaf boolean")).collect()}
    assert not any(v for (d, _), v in got.items() if d == "d16") and got["d17", 15] == "depth"


def test_fingerprint_against_plain_arithmetic(spark):
    e = [("d", 0, 512, "data"), ("d", 512, 1 << 40, "hole"), ("d", 512 + (1 << 40), 4096, "zero")]
    h = 0xCBF29CE484222325
    for _, s, n, k in e:
        for b in struct.pack("<QQQ", s, n, KIND_CODE[k]):
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
    assert planning.fingerprints(spark.createDataFrame(e, MAP)).first()["fingerprint"] == f"{h:016x}"
    assert planning.fingerprints(spark.createDataFrame(e[::-1], MAP)).first()["fingerprint"] == f"{h:016x}"


def test_discard_needs_its_guarantee(spark):
    c = planning.CAPABILITIES
    df = spark.createDataFrame([("hole", c["discard"]), ("hole", c["discard"] | c["discard_zeroes"]), ("hole", c["write_zero"]), ("zero", 0), ("data", 0)], "kind string, caps long")
    assert [r[0] for r in df.select(planning.operation(F.col("kind"), F.col("caps"))).collect()] == ["write_zeros", "discard", "zero", "write_zeros", "copy"]


def test_unknown_identity_is_not_an_alias(spark):
    base = {"src_caps": 7, "dst_caps": 7, "src_size": 8, "dst_size": 8, "start": 0, "length": 8, "flush": True}
    df = spark.createDataFrame([{**base, "pair_id": i, "src_identity": a, "dst_identity": b} for i, (a, b) in enumerate([(None, None), (1, None), (1, 1), (1, 2)])], "pair_id int, src_caps long, dst_caps long, src_size long, dst_size long, start long, length long, flush boolean, src_identity long, dst_identity long")
    assert rows(planning.preflight(df)) == [(2, "alias")]


@pytest.mark.parametrize("budget,over", [(100, 0), (99, 1)])
def test_budget_boundary(spark, budget, over):
    assert planning.over_memory(spark.createDataFrame([(100, budget)], "required long, budget long")).count() == over


def test_first_difference(spark):
    pairs = [(b"abc", b"abd"), (b"abc", b"abc"), (b"abc", b"ab"), (b"", b"x"), (bytes(5000) + b"1", bytes(5000) + b"2"), (b"x", b"y")]
    df = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(pairs)], "i int, a binary, b binary")
    assert [r[1] for r in df.select("i", verify.first_difference(F.col("a"), F.col("b"))).orderBy("i").collect()] == [2, None, None, None, 5000, 0]


def test_compare_blocks_finds_missing_and_short_blocks(spark):
    schema = "disk_id string, block_no long, start long, bytes binary"
    a = spark.createDataFrame([("x", 0, 0, bytearray(b"aa")), ("x", 1, 2, bytearray(b"bb")), ("y", 0, 0, bytearray(b"cc")), ("z", 0, 0, bytearray(b"d"))], schema)
    b = spark.createDataFrame([("x", 0, 0, bytearray(b"aa")), ("y", 0, 0, bytearray(b"c")), ("z", 0, 0, bytearray(b"dtail"))], schema)
    assert rows(verify.compare_blocks(a, b)) == [("x", 2), ("y", 1)]


def test_manifest_without_checksum_uses_sha1(spark):
    f = spark.createDataFrame([("k", 3, 10, "aa", "bb")], "key string, n_bytes long, capacity long, sha256 string, sha1 string")
    m = "key string, size long, capacity long, checksum_type string, checksum string, sha1 string"
    good = [("k", 3, None, None, None, "BB"), ("k", 3, 10, "sha256", "AA", None)]
    bad = [("k", 3, 11, "sha256", "aa", None), ("k", 3, None, "sha1", "aa", None), ("q", 3, None, None, None, "bb")]
    assert verify.check_manifest(spark.createDataFrame(good, m), f).count() == 0
    assert sorted(r["issue"] for r in verify.check_manifest(spark.createDataFrame(bad, m), f).collect()) == ["capacity", "checksum", "no file"]


def test_journal_edges(spark):
    good = ["prepared", "stage_intent", "staged", "acquire_intent", "lease_held", "transfer_complete", "abort_intent", "aborted_lease", "cleanup_intent", "cleaned"]
    j = spark.createDataFrame([("a", i, s) for i, s in enumerate(good)] + [("b", 0, "prepared"), ("b", 1, "published")], "artifact string, sequence int, state string")
    assert rows(journal.illegal_steps(j).select("artifact", "sequence")) == [("b", 1)]


def test_access_matrix(spark):
    schema = "req_id int, file_id string, start long, length long, writes boolean, direct boolean, flush boolean"
    df = spark.createDataFrame([(1, "f", 0, 100, False, False, False), (2, "f", 50, 100, False, False, False), (3, "f", 120, 10, True, False, False), (4, "f", 4000, 50, False, True, False), (5, "f", 9000, 0, True, True, False), (6, "g", 0, 0, False, False, True), (7, "g", 5, 5, False, False, False)], schema)
    assert rows(journal.access_conflicts(df).select("req_a", "req_b")) == [(1, 4), (2, 3), (2, 4), (3, 4), (6, 7)]


def test_walk_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "parent string, child string")
    assert rows(inventory.walk(e, spark.createDataFrame([("a",)], "node string"))) == [("a", 0), ("b", 1), ("c", 1)]


@pytest.mark.parametrize("url,issue", [("https://h.example/nfc/a", None), ("https://*/ha-nfc/a", None), ("http://h.example/nfc/a", "scheme"), ("https://h.example:444/nfc/a", "port"), ("https://u@h.example/nfc/a", "user"), ("https://h.example/x", "path"), ("https://h.example/nfc/a#f", "fragment")])
def test_urls(spark, url, issue):
    assert spark.createDataFrame([(url,)], "u string").select(inventory.url_issue(F.col("u"), "h.example", 443)).first()[0] == issue


@pytest.mark.parametrize("text,ok", [("2024-02-29T00:00:00Z", True), ("2023-02-29T00:00:00Z", False), ("2024-12-31T23:59:60Z", True), ("2024-12-31T24:00:00Z", False), ("2024-12-31T23:59:59.123Z", True), ("2024-12-31T23:59:59.Z", False)])
def test_times(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(B.strict_utc(F.col("t"))).first()[0] is ok


def test_each_header_rule_fires_for_its_own_damage(spark, small):
    got = {}
    for r in headers.sparse_headers(spark, small).collect():
        got.setdefault(int(r["id"]) % headers.VARIANTS, set()).add(r["check"])
    wanted = {1: "magic", 2: "version", 3: "flags", 6: "capacity", 8: "grain size", 9: "grain size", 10: "descriptor pair", 11: "table entries", 13: "overlap", 14: "directory bounds", 15: "footer directory", 16: "overhead", 18: "overhead bounds", 19: "unclean shutdown", 20: "newline check",
              21: "compression", 22: "capacity limit", 23: "grain limit", 24: "reserved bytes"}
    assert all(check in got[v] for v, check in wanted.items()) and got[0] <= {"overhead bounds", "header length"}


def test_stream_header_rules(spark, small):
    got = {}
    for r in headers.stream_headers(spark, small).collect():
        got.setdefault(int(r["id"]) % headers.VARIANTS, set()).add(r["check"])
    assert all(check in got[v] for v, check in {1: "magic", 2: "version", 3: "flags", 4: "footer profile", 8: "geometry", 6: "capacity", 12: "overhead", 21: "compression"}.items()) and got[0] <= {"overhead", "header length", "footer profile"}


def test_grain_tables_of_one_image(spark):
    raw = bytearray(21 * 512) + struct.pack("<128I", 22, 0, *[0] * 126) + struct.pack("<512I", *[128 + 128 * i if i % 5 == 0 else 0 for i in range(512)])
    struct.pack_into("<Q", raw, 12, 128 * 600)
    struct.pack_into("<Q", raw, 20, 128)
    struct.pack_into("<Q", raw, 56, 21)
    got = rows(images.grain_tables(spark.createDataFrame([("image", bytearray(raw))], "id string, raw binary")))
    assert got == [("image", i, 128 + 128 * i) for i in range(0, 512, 5)]


@pytest.mark.parametrize("width", [700, 1 << 16])
def test_stretches_of_a_disk_change_nothing(spark, small, monkeypatch, width):
    """What windows over whole disks say, windows over stretches of them say as well."""
    runs = X.mixed_runs(spark, small).where("layer = 0").select("disk_id", "start", "length", F.when(F.col("start") % 3 > 0, F.lit("b")).alias("backing"), F.col("start").alias("physical"))
    regions = X.extents(spark, small).select("disk_id", "start", (F.col("length") + F.col("seq") % 3 * 20_000).alias("length"))
    points = X.extents(spark, small).select("disk_id", (F.col("start") * 2 + 77).alias("point"))

    def answers():
        e, s, broken = X.extents(spark, small), X.sizes(spark, small), X.broken(spark, small)
        asked = [ranges.coalesce_kind(e), ranges.coalesce_physical(runs), ranges.fill_gaps(broken, s), ranges.map_violations(broken, s), ranges.point_lookup(points, broken.where("seq % 103 <> 0 and length > 0")), ranges.overlapping_regions(regions), ranges.running_start(e.drop("start"), "disk_id", "seq"), journal.completion(e)]
        return [sorted(str(tuple(r)) for r in x.collect()) for x in asked]

    want = answers()
    monkeypatch.setattr(ranges, "WIDTH", width)
    assert answers() == want and all(want)


def test_progress_is_told_at_steps_and_ends(spark):
    work = spark.createDataFrame([(1, i, 10) for i in range(10)] + [(2, 0, 0), (3, 0, 5), (3, 5, 40)], "disk_id long, start long, length long")
    assert sorted(map(tuple, journal.progress(work, 35).collect())) == [(1, 40), (1, 80), (1, 100), (2, 0), (3, 45)]


def test_raw_parts_are_split_and_overlaps_raise(spark, tmp_path):
    blocks = spark.createDataFrame([("d", 5, bytearray(b"abcdefgh")), ("d", 20, bytearray(b"xyz")), ("e", 0, bytearray(b"q")), ("e", 1, None), ("e", 9, bytearray(b""))], "disk_id string, start long, bytes binary")
    files = {(r["disk_id"], r["part"]): open(r["path"], "rb").read() for r in sinks.write_raw(blocks, str(tmp_path / "a"), part=8).collect()}
    assert files == {("d", 0): b"\0\0\0\0\0abc", ("d", 1): b"defgh", ("d", 2): b"\0\0\0\0xyz", ("e", 0): b"q"}
    with pytest.raises(Exception, match="overlap"):
        sinks.write_raw(blocks.unionByName(spark.createDataFrame([("d", 6, bytearray(b"z"))], blocks.schema)), str(tmp_path / "b"))


def test_progress_events_by_hand(spark):
    rows_ = [(1, 1, 0, 0), (1, 2, 5, 1), (1, 3, 9, 50), (1, 4, 9, 200), (1, 5, 11, 210), (1, 6, 11 + (64 << 20), 211), (2, 1, 7, 9)]
    got = control.transferring_events(spark.createDataFrame(rows_, "copy_id long, seq long, bytes long, elapsed_ms long")).collect()
    assert sorted((r["copy_id"], r["seq"]) for r in got) == [(1, 2), (1, 5), (1, 6), (2, 1)]



def test_inflate_names_each_damage(spark, small):
    got = plans.inflate_check(spark, small).collect()
    want = {0: None, 1: "too short", 2: "truncated", 3: "trailing input", 4: "not zlib"}
    assert all(r["issue"] == want[r["index"] % 5] for r in got)
    too_long = spark.createDataFrame([("d", 0, bytearray(zlib.compress(bytes(70_000))))], "disk_id string, index long, payload binary")
    assert images.inflate(too_long).first()["issue"] == "too long"


def test_raw_blocks_source(spark, tmp_path):
    data = bytes(8192) + random.Random(1).randbytes(5000)
    (tmp_path / "raw.img").write_bytes(data)
    spark.dataSource.register(images.RawBlocks)
    df = spark.read.format("raw_blocks").option("path", str(tmp_path / "raw.img")).option("partition", 8192).load()
    got = df.orderBy("block_no").collect()
    assert b"".join(bytes(r["bytes"]) for r in got) == data and [r["start"] for r in got] == [0, 4096, 8192, 12288]
    assert rows(ranges.coalesce_kind(images.block_kinds(df)).select("start", "length", "kind")) == [(0, 8192, "hole"), (8192, 5000, "data")]


def test_descriptor_variants(spark):
    chain = 'version=1\nCID=2\nparentCID=1\ncreateType="monolithicSparse"\nparentFileNameHint="base"\nRW 8 SPARSE "c"'
    stream = 'version=1\nCID=2\nparentCID=ffffffff\ncreateType="streamOptimized"\nRW 8 SPARSE "c"\nddb.toolsInstallType="4"'
    df = lambda body: spark.createDataFrame([("d", body)], "descriptor_id string, body string")
    assert descriptors.violations(df(chain), "chain").count() == 0
    assert descriptors.violations(df(chain), "sparse").first()["issue"] == "unwanted parent"
    assert descriptors.violations(df(stream), "stream").count() == 0
    assert descriptors.violations(df(stream), "sparse").first()["issue"] == "layout name"
    assert descriptors.violations(df(chain.replace('parentFileNameHint="base"\n', "")), "chain").first()["issue"] == "missing parent hint"


def test_artifact_is_closed(spark):
    df = spark.createDataFrame([('{"schema_version":1,"artifact":"a","complete":true,"capacity":1,"encoded_bytes":1,"digest":"x"}',), ("[1]",), ("nonsense",)], "body string")
    assert [r["issue"] for r in records.artifacts(df).collect()] == [None, "not an object", "not an object"]


def test_streaming_journal_twin(spark, tmp_path):
    from blockloom.streaming.journals import illegal_steps

    schema = "artifact string, sequence long, state string"
    parts = [[("a", 0, "prepared"), ("b", 0, "prepared")], [("a", 1, "stage_intent"), ("b", 1, "published")], [("a", 2, "cleaned")]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = illegal_steps(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["artifact"], r["sequence"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}


def test_stream_records_source(spark, tmp_path):
    from blockloom.plans.more import stream_file
    from blockloom.sources import streams

    data = {0: bytes(65536), 256: random.Random(1).randbytes(65536), 1024: bytes(range(256)) * 256}
    (tmp_path / "s.img").write_bytes(stream_file(data))
    (tmp_path / "t.img").write_bytes(stream_file({512: bytes(65536), 256: bytes(65536)})[:-512])
    spark.dataSource.register(streams.StreamRecords)
    df = spark.read.format("stream_records").option("path", f"{tmp_path}/s.img,{tmp_path}/t.img").load()
    good = df.where(F.col("disk_id").endswith("s.img"))
    assert [(r["kind"], r["sector"]) for r in good.orderBy("record").collect()] == [("grain", 0), ("grain", 256), ("grain", 1024), ("end", None)]
    assert streams.violations(good).count() == 0
    assert sorted((r["record"], r["check"]) for r in streams.violations(df).collect()) == [(1, "no end"), (1, "order")]


def test_output_steps_and_long_journals(spark):
    legal = journal.output_steps()
    assert ("prepared", "stage_intent") in legal and ("verified", "cleanup_intent") in legal and ("publish_intent", "cleanup_intent") not in legal and ("cleaned", "prepared") not in legal
    # The one illegal step is between two stretches.
    n = journal.STRETCH
    rows = spark.createDataFrame([("a", n - 2, "staged"), ("a", n - 1, "convert_intent"), ("a", n, "verified"), ("b", n, "cleaned"), ("c", 0, None), ("c", 1, "staged")], "artifact string, sequence long, state string")
    assert [(r["artifact"], r["sequence"], r["before"]) for r in journal.illegal_steps(rows, legal=legal).collect()] == [("a", n, "convert_intent")]
    assert journal.illegal_steps(rows.limit(0), legal=legal).count() == 0


def test_refused_requests_at_the_bound(spark):
    rows = spark.createDataFrame([("x", i, "Logout" if i % 3 == 0 else "Login") for i in range(10)] + [("y", 0, "Login")], "connection string, request long, method string")
    assert sorted(r["request"] for r in journal.refused_requests(rows, "connection", "request", most=4).collect()) == [4, 5, 7, 8]
    assert journal.refused_requests(rows, "connection", "request", most=10).count() == 0


def test_bindings_and_payloads_with_nulls(spark):
    told = spark.createDataFrame([("a", "s", True, "01"), ("b", None, True, "01"), ("c", None, True, None), ("d", "s", None, "01"), ("e", "s", True, "01")], "key string, store string, intact boolean, operation string")
    expected = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", None), ("d", "s")], "key string, store string")
    got = {r["key"]: r["issue"] for r in journal.binding_issues(told, expected, "key", ["store"]).collect()}
    assert got == {"a": None, "b": "store", "c": "operation", "d": "checksum", "e": "unasked"}
    rows = spark.createDataFrame([(0, b"KDMV" + bytes(508)), (1, b"KDMV" + bytes(507)), (2, bytes(512)), (3, None)], "i int, p binary")
    assert {r["i"]: r["x"] for r in rows.select("i", verify.payload_issue(rows["p"]).alias("x")).collect()} == {0: None, 1: "short", 2: "magic", 3: "short"}
