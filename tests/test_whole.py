"""Registered queries over whole tables, against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

from blockloom.operators import journal
from blockloom.plans import fixtures as X
from blockloom.plans import maps, more, records
from blockloom.sources import images


def test_exit_codes_weigh_every_event(spark, small):
    weightiest = {}
    for user, event, kind in X.table(spark, small, "events").select("user_id", "event_id", "event_type").collect():
        status = {"click": "completed", "view": "completed", "signup": "cancelled", "purchase": "completed" if event % 200 else "uncertain"}.get(kind, "failed" if event % 90 else "invalid_request")
        weightiest[user] = max(weightiest.get(user, "assessed"), status, key=journal.PRECEDENCE.index)
    got = more.exit_codes(spark, small).collect()
    assert {r["user_id"]: (r["status"], r["code"]) for r in got} == {u: (s, journal.EXIT_CODES[s]) for u, s in weightiest.items()}
    assert len(got) == len(weightiest)


def test_properties_are_those_of_every_event(spark, small):
    told = Counter((r["user_id"], r["event_type"]) for r in X.table(spark, small, "events").select("user_id", "event_type").collect())
    assert sorted(map(tuple, records.duplicate_properties(spark, small).collect())) == sorted((*k, n) for k, n in told.items() if n > 1)
    missing = {(u, name) for u, _ in told for name in ("click", "view", "resize")} - set(told)
    assert sorted((r["object_id"], r["name"]) for r in records.missing_properties(spark, small).collect()) == sorted(missing)


def test_missing_properties_look_at_every_event(spark, tmp_path):
    rows = [(1, 1, "click"), (2, 1, "view"), (40, 2, "click"), (41, 2, "view"), (3, 3, "error"), (80, 4, "view")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = records.missing_properties(spark, str(tmp_path)).collect()
    assert sorted((r["object_id"], r["name"]) for r in got) == sorted([(3, "click"), (3, "view"), (4, "click"), *((i, "resize") for i in (1, 2, 3, 4))])


def test_shared_identities_are_those_of_every_disk(spark, small):
    lines = {tuple(r) for r in X.table(spark, small, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey").collect()}
    told = Counter((s, p % 64, o % 8) for s, p, o in lines)
    assert sorted(map(tuple, maps.shared_identities(spark, small).collect())) == sorted((*k, n) for k, n in told.items() if n > 1)


def test_recent_tasks_keep_every_task(spark, small, tmp_path):
    owners = Counter(r["user_id"] for r in X.table(spark, small, "events").select("user_id").collect())
    got = more.recent_tasks(spark, small).collect()
    assert Counter(r["owner"] for r in got) == owners
    assert all((r["issue"] == "too many") == (owners[r["owner"]] > journal.MOST_TASKS) for r in got)
    rows = [(i, 1, "click") for i in range(380, 420)] + [(500, 3, "view"), (501, 3, "view"), (513, 3, "view"), (515, 3, "purchase"), (518, 3, "error")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = more.recent_tasks(spark, str(tmp_path)).collect()
    assert Counter(r["issue"] for r in got if r["owner"] == 1) == {"too many": 40}
    assert sorted((r["reference"], r["state"], r["operation"], r["issue"]) for r in got if r["owner"] == 3) == [
        (250, "success", "export_vm", "duplicate"), (250, "success", "other", "duplicate"), (256, "success", "export_vm", "entity"), (257, "lost", "other", "state"), (259, "error", "other", None),
    ]


def test_inflate_check_reads_texts_to_their_end(spark, tmp_path):
    size = images.STREAM_GRAIN
    texts = {0: "é" * size + "tail", 5: "é" * size + "other", 10: "x" * size, 15: "", 20: None, 25: "short", 1: "y" * size, 2: "z" * (size + 1)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["index"], r["disk_id"]): (r["sha256"], r["issue"]) for r in records.inflate_check(spark, str(tmp_path)).collect()}
    want = {}
    for doc, text in texts.items():
        data = (text or "").encode()
        for part in range(max(1, -(-len(data) // size))):
            sha = hashlib.sha256(data[part * size : (part + 1) * size].ljust(size, b"\0")).hexdigest()
            want[doc, f"d{part or ''}"] = (None, "too short") if doc == 1 else (None, "truncated") if doc == 2 else (sha, None)
    assert got == want and len({sha for (doc, _), (sha, _) in got.items() if doc in (0, 5)}) == 3


def test_data_urls_with_at_signs_and_without_url_are_judged(spark, tmp_path):
    host = "m.ththth.example.net"
    want = {
        f"https://u@{host}/nfc/a": "user", f"https://u:p@{host}/nfc/a": "user", f"https://{host}/nfc/a@b": None, f"https://{host}/nfc/a?q=x@y": None, f"https://{host}/x@y": "path",
        f"https://{host}@other.example/nfc/a": "host", f"http://u@{host}/nfc/a": "scheme", f"https://{host}/nfc/a#x@y": "fragment", f"https://{host}/nfc/a": None, None: "shape",
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["issue"] for r in records.data_url_admission(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))
