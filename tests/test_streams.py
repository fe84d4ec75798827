"""Streams with state and timers give what the batch plans give."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from terrafold.sources.tables import attempts
from terrafold.streaming import logins, windows

START = datetime(2024, 5, 1)


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, rows, time_column, tmp_path, name, make, parts=4):
    """The rows of a stream over rows that come in so many files, in order of time, one in each micro-batch."""
    places = [r[0] for r in rows.select(time_column).orderBy(time_column).collect()]
    cuts = [places[len(places) * k // parts] for k in range(1, parts)]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(parts):
        part = rows
        if k:
            part = part.where(F.col(time_column) >= F.lit(cuts[k - 1]).cast("timestamp_ntz"))
        if k < parts - 1:
            part = part.where(F.col(time_column) < F.lit(cuts[k]).cast("timestamp_ntz"))
        part.coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        (file,) = (tmp_path / f"w{k}").glob("part-*")
        time.sleep(0.02)
        (source / f"{k}.parquet").write_bytes(file.read_bytes())
        time.sleep(1.05)  # files are taken by their times
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    return spark.table(name)


def test_logins_and_expired_codes(rocks, data, tmp_path):
    """Table rows, and users of a second factor whose codes come in time, late or never."""
    some = random.Random(5)
    rows, at = [], START
    for k in range(600):
        at += timedelta(seconds=some.choice([1, 20, 61, 150]))
        kind = some.choice(["password", "password", "code", "code", "unlock"] if k % 5 else ["password"])
        rows.append((1000 + some.randrange(6), at, kind, some.random() < 0.7, True, some.random() < 0.8))
    rows = rocks.createDataFrame(rows, attempts(rocks, data).schema)
    found = streamed(rocks, rows, "ts", tmp_path, "logins_told", logins.stream)
    batch = logins.batch(rows)
    key = lambda df: sorted(map(tuple, df.select("user_id", "ts", "outcome", "failed_count", "is_locked").collect()))
    assert key(found.where("outcome <> 'CodeExpired'")) == key(batch)
    last = rows.agg(F.max("ts")).first()[0]
    over = lambda df: sorted((r["user_id"], r["ts"]) for r in df.where("outcome = 'CodeExpired'").collect() if r["ts"] < last)
    assert over(found) == over(logins.expired_codes(batch)) and len(over(found)) > 20


def test_kept_clicks(rocks, tmp_path):
    some = random.Random(6)
    rows, at = [], START
    for _ in range(900):
        at += timedelta(milliseconds=some.choice([0, 50, 299, 300, 400, 700, 900]))
        rows.append((some.choice("ab"), at, some.choice([None, None, None, timedelta(milliseconds=windows.LABEL_MS), timedelta(milliseconds=windows.MAP_MS)])))
    frame = rocks.createDataFrame(rows, windows.CLICK_ROWS)
    until, expected = {}, []
    for key, t, wait in sorted(rows, key=lambda r: (r[1], r[2] is None)):
        if wait is not None:
            until[key] = t + wait
        elif key not in until or t >= until[key]:
            expected.append((key, t))
    kept = lambda df: sorted(map(tuple, df.collect()))
    assert kept(windows.kept_clicks(frame.repartition(5, "ts"))) == sorted(expected) and 100 < len(expected) < 600
    assert kept(streamed(rocks, frame, "ts", tmp_path, "clicks_kept", windows.kept_clicks_stream)) == sorted(expected)


def test_a_row_of_quick_clicks_is_not_ignored_for_ever(spark):
    rows = [("a", START, timedelta(milliseconds=300))] + [("a", START + timedelta(milliseconds=100 * k), None) for k in range(1, 8)]
    found = windows.kept_clicks(spark.createDataFrame(rows, windows.CLICK_ROWS)).collect()
    assert [r["ts"] for r in sorted(found)] == [START + timedelta(milliseconds=100 * k) for k in range(3, 8)]


def test_shares_run_out(rocks, tmp_path):
    some = random.Random(7)
    rows, at = [], START
    for k in range(400):
        at += timedelta(seconds=some.randrange(1, 90))
        rows.append((some.randrange(8), k, at, at + timedelta(minutes=some.choice([1, 10, 60]))))
    frame = rocks.createDataFrame(rows, "user_id long, id long, create_at timestamp_ntz, expiration timestamp_ntz")
    found = streamed(rocks, frame, "create_at", tmp_path, "shares_told", windows.run_out_stream)
    batch = windows.run_out(frame, F.lit(at).cast("timestamp_ntz"))
    told = lambda df: sorted(tuple(r) for r in df.select("user_id", "id", "ts").collect() if r["ts"] < at)
    assert told(found) == told(batch) and len(told(batch)) > 50
