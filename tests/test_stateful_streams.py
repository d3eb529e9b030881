"""Streams with state in micro-batches, against plain loops over all rows; restarts, late rows, broken runs."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import tables
from tallyspark.streaming import ingest
from tallyspark.streaming.state import LIMITS, counted_requests, durable_state, repeat_pairs

START = datetime.datetime(2024, 1, 1)


def collect(spark, stream, rows, checkpoint, mode="update"):
    def each(batch, number):
        rows.extend(batch.collect())

    with durable_state(spark):
        stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_requests_in_windows_from_the_first_hit(spark, tmp_path):
    rng, fields = random.Random(4), "kind string, who string, request_id int, ts timestamp"
    requests = [("login", f"u{rng.randint(0, 2)}", i, START + datetime.timedelta(seconds=20 * i)) for i in range(300)]
    requests += [("login", "edge", 1000 + i, START + datetime.timedelta(seconds=s)) for i, s in enumerate((0, 600, 600, 601, 1200, 1201, 1202))]
    requests += [("upload", None, 2000, START), ("other", "x", 3000, START)]
    requests.sort(key=lambda r: (r[3], r[2]))
    got, source = [], str(tmp_path / "in")
    for k in range(0, len(requests), 60):  # a batch each, and a restart between
        spark.createDataFrame(requests[k : k + 60], fields).coalesce(1).write.mode("append").parquet(source)
        collect(spark, counted_requests(spark.readStream.schema(fields).parquet(source)), got, str(tmp_path / "state"))
    windows, want = {}, {}
    for kind, who, i, ts in requests:
        if kind in LIMITS:
            most, minutes = LIMITS[kind]
            end, n = windows.get((kind, who), (None, 0))
            if end is None or end < ts:
                end, n = ts + datetime.timedelta(minutes=minutes), 0
            allowed = n < most
            n += allowed
            windows[kind, who] = end, n
            want[i] = (allowed, most - n, end)
    assert {r.request_id: (r.allowed, r.remaining, r.reset_at) for r in got} == want
    assert len(got) == len(want) and any(not a for a, _, _ in want.values())


def test_pairs_within_two_days(spark, tmp_path):
    rng, fields = random.Random(2), "user_id int, cents int, tx_id int, ts timestamp"
    hour = datetime.timedelta(hours=1)
    rows = [(rng.randint(0, 3), rng.choice([5, 7]), i, START + i * hour * 2) for i in range(150)]
    rows += [(9, 5, 900, START), (9, 5, 901, START + 48 * hour), (9, 5, 902, START + 96 * hour + datetime.timedelta(seconds=1)), (9, 5, 903, START + 48 * hour), (None, 5, 904, START)]
    rows.sort(key=lambda r: r[3])
    source, got = str(tmp_path / "in"), []
    late = (9, 5, 999, START + 49 * hour)  # comes after rows of day ten: dropped
    for k in range(0, len(rows), 40):
        some = rows[k : k + 40]
        rng.shuffle(some)
        spark.createDataFrame([*some, *([late] if k == 120 else [])], fields).coalesce(1).write.mode("append").parquet(source)
        stream = repeat_pairs(spark.readStream.schema(fields).parquet(source), ["user_id", "cents"])
        collect(spark, stream, got, str(tmp_path / "state"), "append")
    want = {(a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and a[0] is not None and (a[3], a[2]) < (b[3], b[2]) and b[3] - a[3] <= 48 * hour}
    assert {(r.first_id, r.second_id) for r in got} == want and len(got) == len(want)
    assert {(900, 901), (900, 903), (901, 903)} <= want and not any(902 in p for p in want)


def test_months_are_read_only_where_touched(spark, tmp_path):
    fields = "user_id long, tx_date date, cents long"
    source, ledger, summaries, state = (str(tmp_path / n) for n in ("in", "ledger", "summaries", "state"))
    day = datetime.date
    batches = [[(u, day(2024, m, 3), u + m) for u in range(40) for m in (1, 2, 3)] + [(7, None, 1)], [(3, day(2024, 2, 9), 100), (5, day(2024, 4, 1), 6)], [(3, day(2024, 2, 10), 1000)]]
    asked = []

    def summarize(rows):
        asked.append(rows)
        return rows.groupBy("user_id", "year", "month").agg(F.sum("cents").alias("cents"))

    every = []
    for k, rows in enumerate(batches):
        every += rows
        spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(source)
        if k == 1:  # a month that is not touched any more can't be read: nothing may ask for it
            for part in (tmp_path / "ledger" / "year=2024" / "month=1").rglob("*.parquet"):
                part.write_bytes(b"broken")
        ingest.refresh_months(spark, source, fields, ledger, summaries, state, summarize)
        want = {}
        for u, d, c in every:
            want[u, d.year if d else 0, d.month if d else 0] = want.get((u, d.year if d else 0, d.month if d else 0), 0) + c
        got = spark.read.parquet(summaries).collect()
        assert {(r.user_id, r.year, r.month): r.cents for r in got} == want and len(got) == len(want)
    assert len(asked) == 3


def test_upserts(spark, tmp_path):
    """Against a dictionary; only touched buckets change; what breaks off before the commit leaves the table as it was."""
    path, fields, rng, want = str(tmp_path / "t"), "k long, name string, n long", random.Random(1), {}
    for _ in range(4):
        rows = [(rng.choice([None, *range(30)]), rng.choice("ab"), rng.randint(0, 10**6)) for _ in range(25)]
        tables.upsert(spark.createDataFrame(rows, fields), path, ["k", "name"], "n", buckets=8)
        new = {}
        for k, name, n in rows:
            new[k, name] = max(n, new.get((k, name), -1))
        want |= new
        assert {(r.k, r.name): r.n for r in tables.read(spark, path).collect()} == want
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    put = tables._Files.put
    tables._Files.put = lambda *_: (_ for _ in ()).throw(OSError("the driver is lost"))
    try:
        with pytest.raises(OSError):
            tables.upsert(spark.createDataFrame([(1, "a", 5)], fields), path, ["k", "name"], "n")
    finally:
        tables._Files.put = put
    assert {(r.k, r.name): r.n for r in tables.read(spark, path).collect()} == want
    number = tables.upsert(spark.createDataFrame([(1, "a", 5)], fields), path, ["k", "name"], "n", batch=3)
    assert {(r.k, r.name): r.n for r in tables.read(spark, path).collect()} == want | {(1, "a"): 5}
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert len({p.parent.name for p in (tmp_path / "t" / f"v={number:012d}").rglob("*.parquet")}) == 1
    assert tables.upsert(spark.createDataFrame([(1, "a", 6)], fields), path, ["k", "name"], "n", batch=3) == number
    tables.vacuum(spark, path)
    assert {(r.k, r.name): r.n for r in tables.read(spark, path).collect()} == want | {(1, "a"): 5}


def test_statement_files(spark, tmp_path, monkeypatch):
    """A second delivery of a file is a version without rows of its own; a run that breaks off is made good by the next."""
    folder, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def put(name, content):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)

    csv = b"Date,Description,Amount\n2024-01-05,Shop,5.00\n2024-01-06,Pay,-7.00\n"
    ofx = b"OFXHEADER:100\n<OFX><CURDEF>EUR\n<STMTTRN>\n<TRNTYPE>DEBIT\n<DTPOSTED>20240105\n<TRNAMT>-5\n<FITID>1\n<NAME>x\n</STMTTRN></OFX>"
    put("ann/a.csv", csv)
    put("ann/b.ofx", ofx)
    put("bob/a.csv", csv)
    os.utime(folder / "bob/a.csv", ns=((t := (folder / "ann/a.csv").stat().st_mtime_ns), t))  # one name and one time
    put("bob/bad.xlsx", b"PK\x03\x04")
    ingest.ingest_statements(spark, str(folder), target, state)
    put("ann/again.csv", csv)
    put("cem/c.csv", "Datum,Betrag,Name\n".encode("utf-16"))
    upsert = tables.upsert
    monkeypatch.setattr(tables, "upsert", lambda *a, **k: 1 / 0)
    with pytest.raises(Exception):  # noqa: B017
        ingest.ingest_statements(spark, str(folder), target, state)
    monkeypatch.setattr(tables, "upsert", upsert)
    for _ in range(2):
        ingest.ingest_statements(spark, str(folder), target, state)
    uploads = {r.upload_id.split("@")[0]: r for r in spark.read.parquet(f"{target}/uploads").collect()}
    assert {k: (r.version, r.reason) for k, r in uploads.items()} == {
        "ann/a.csv": (1, None), "ann/b.ofx": (1, None), "bob/a.csv": (1, None), "bob/bad.xlsx": (1, "unsupported"), "ann/again.csv": (2, None), "cem/c.csv": (1, None)}
    assert uploads["ann/again.csv"].previous_upload_id == uploads["ann/a.csv"].upload_id
    assert spark.read.parquet(f"{target}/csv").count() == 4 and spark.read.parquet(f"{target}/ofx").count() == 1
