import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from kerbline.operators import access, reconcile, registry
from kerbline.sources import contracts, scans, sinks


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_roster_files(spark, folder):
    path = write(folder, "r.json", json.dumps({"cameras": [{"id": 3, "location": "05 Gate", "live": True, "fps": 12.5}], "x": 1}, indent=1))
    (r,) = scans.read_roster(spark, path).collect()
    assert (r.label, r.portal_id, r.portal_live, r.fps, r.codec) == ("05 Gate", "3", True, 12.5, None)
    bad = write(folder, "bad.json", json.dumps({"items": []}))
    with pytest.raises(Exception, match="no 'cameras' list"):
        scans.read_roster(spark, bad).collect()


def test_csv_file(spark, folder):
    path = write(folder, "s.csv", '# a comment\n\nlabel , suggested_department,basis\n"05 ""Gate"", west", POLICE , near it\n  # more\nshort\n')
    rows = [tuple(r) for r in scans.read_csv_rows(spark, path).collect()]
    assert rows == [('05 "Gate", west', "POLICE", "near it"), ("short", "", "")]


def test_probe_manifest_district_and_log_files(spark, folder):
    probe = {"url": "u", "size_bytes": 5_000_000_000, "bytes_fetched": 1_500_000, "box_order": ["ftyp", "moov"], "format": {"duration": "7200.5"},
             "streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "hevc", "r_frame_rate": "25/1", "avg_frame_rate": "0/0", "bit_rate": "1999600"}]}
    r = scans.read_probes(spark, write(folder, "p.json", json.dumps(probe))).first()
    assert (r.size_gb, r.duration_h, r.codec, r.nominal_fps, r.actual_fps, r.has_audio, r.moov_at_front, r.video_bitrate_kbps) == (
        5.0, 2.0, "hevc", 25.0, None, True, True, 2000)
    manifest = {"camera": "7", "tag": "am", "chunks": [{"index": 0, "ok": True, "actual_first_pts_s": 1.5}, {"index": 1, "ok": False}]}
    rows = scans.read_manifests(spark, write(folder, "m.json", json.dumps(manifest))).orderBy("idx").collect()
    assert [(x.camera_id, x.idx, x.ok, x.first_pts_s) for x in rows] == [("7", 0, True, 1.5), ("7", 1, False, None)]
    geo = {"features": [{"properties": {"DISTRICT": "Surat ", "ST_NM": " GUJARAT"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[1, 2], [3, 4]]], [[[5, 6]]]]}},
                        {"properties": {"DISTRICT": "Goa", "ST_NM": "Goa"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0]]]}}]}
    pts = scans.read_districts(spark, write(folder, "d.json", json.dumps(geo)), "Gujarat").orderBy("polygon_no", "ring_no", "pos").collect()
    assert [(p.feature, p.pos, p.x, p.y) for p in pts] == [("Surat", 0, 1.0, 2.0), ("Surat", 1, 3.0, 4.0), ("Surat", 0, 5.0, 6.0)]
    log = write(folder, "cam9.log", "RPS: Server returned 500\nServer returned 404\nhello\n")
    assert sorted((x.camera_id, x.message_class) for x in scans.read_stream_log(spark, log).collect()) == [
        ("cam9", "benign"), ("cam9", "fatal"), ("cam9", "warning")]


def test_evidence_files(spark, folder):
    for name, body, recorded in (("a", b"footage", None), ("b", b"edited", b"original"), ("c", b"alone", False)):
        with open(f"{folder}/{name}.mp4", "wb") as f:
            f.write(body)
        if recorded is not False:
            write(folder, f"{name}.json", json.dumps({"clip": f"{name}.mp4", "sha256": hashlib.sha256(recorded or body).hexdigest()}))
    assert {r.clip: r.intact for r in scans.read_evidence(spark, folder).collect()} == {"a.mp4": True, "b.mp4": False, "c.mp4": False}


def test_event_quarantine_keeps_reasons(spark):
    good = {"type": "camera.health", "event_id": "1", "camera_id": "c", "emitted_at_ms": 1, "status": "online", "fps": None, "latency_ms": 3, "detail": None}
    rows = [good, {**good, "status": "asleep"}, {k: v for k, v in good.items() if k != "fps"}, {**good, "latency_ms": "slow"}, {"type": "x"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("{oops",)], "value string")
    checked = contracts.check_events(df)
    assert contracts.valid_events(checked, "camera.health").count() == 1
    assert contracts.quarantine(checked).count() == 5
    reasons = {e for r in contracts.quarantine(checked).collect() for e in r.errors}
    assert {"status is not an allowed value", "fps must be present", "not of the stated types", "unknown type x", "no type"} <= reasons


def test_roster_sync_is_careful(spark):
    cols = ("label string, portal_id string, last_portal_id string, codec string, portal_live boolean, status string, status_source string, last_error string, "
            "notes string, last_seen string, source_type string, source_url string, label_number int, location_status string, location_uncertainty_m int, "
            "location_basis string, department string")
    row = lambda label, pid, live=True, notes=None: (label, pid, None, "h264", live, "online", "portal_claim", None, notes, "then", "RTSP", "/x", 5, "verified", 10, "b", "police")
    local = spark.createDataFrame([row("05 a", "1"), row("06 b", "2", notes="seen"), row("07 gone", None, False, "left the portal roster on x")], cols)
    remote = spark.createDataFrame([("05 a", "2", None, True), ("08 new", "3", "hevc", True)], "label string, portal_id string, codec string, portal_live boolean")
    out = {r.label: r for r in reconcile.apply_roster(local, remote, "now").collect()}
    assert (out["05 a"].portal_id, out["05 a"].codec, out["05 a"].department) == ("2", "h264", "police")
    b = out["06 b"]
    assert (b.portal_id, b.last_portal_id, b.status, b.portal_live) == (None, "2", "offline", False) and b.notes.startswith("seen; left the portal roster on now")
    assert out["07 gone"].notes == "left the portal roster on x" and out["07 gone"].status == "online"
    assert (out["08 new"].location_uncertainty_m, out["08 new"].label_number, out["08 new"].department) == (15000, 8, "unassigned")
    again = {r.label: r for r in reconcile.apply_roster(reconcile.apply_roster(local, remote, "now"), remote, "later").collect()}
    assert again["06 b"].notes == b.notes and again["06 b"].last_portal_id == "2"
    with pytest.raises(ValueError):
        reconcile.refuse_repeated_labels(remote.unionByName(remote))


def test_digest_ignores_order_and_sees_changes(spark):
    rows = [("e", f"cam{i}", i) for i in range(50)]
    digest = lambda r: reconcile.roster_digest(spark.createDataFrame(r, "endpoint string, label string, n int"), ["endpoint"]).first()
    a = digest(rows)
    assert a == digest(rows[::-1]) and a.camera_count == 50
    assert a.digest != digest([("e", "cam0", 99), *rows[1:]]).digest


def test_placement_and_scope(spark):
    df = spark.createDataFrame([(23.0, 72.5, 25.0), (18.0, 72.5, 25.0), (float("nan"), 72.0, 1.0), (23.0, 72.5, 501.0), (float("inf"), 72.0, 1.0)],
                               "lat double, lng double, uncertainty_m double")
    assert [r.accepted for r in registry.placement_decision(df).collect()] == [True, False, False, False, False]
    assert df.select(registry.in_range(F.col("lat"), F.col("lng"))).first()[0]
    rows = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", None)], "id string, department_id string")
    assert access.visible_to(rows, "auditor", None).count() == 3
    assert [r.id for r in access.visible_to(rows, "investigator", "d2").collect()] == ["b"]


def test_batches_replace_themselves(spark, folder):
    df = spark.createDataFrame([("a", "t", 1)], "alert_id string, track_id string, n int")
    for _ in range(2):
        sinks.write_batch(df, f"{folder}/log", 0)
    sinks.write_batch(df.withColumn("n", F.lit(9)), f"{folder}/log", 1)
    log = sinks.read_log(spark, f"{folder}/log")
    assert log.count() == 2 and sinks.current_alerts(log).first().n == 9
