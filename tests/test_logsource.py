"""Daily logs as a source: against the plain reader, with pruned files, ranges, and a stream that is restarted."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import logs, logsource

DAY = 86_400_000


def line(k, key, at, **more):
    return json.dumps({"sessionKey": key, "sessionId": key, "recordedAt": "t", "id": str(k), "role": "user", "content": f"text {k} é", "timestamp": at} | more)


@pytest.fixture
def folder(spark, tmp_path):
    logsource.register(spark)
    base = tmp_path / "m" / "conversations"
    for d in range(1, 6):
        shard = base / f"shard=2024-01-{d:02d}"
        shard.mkdir(parents=True)
        at = 1_704_067_200_000 + (d - 1) * DAY
        rows = [line(10 * d + k, "ab"[k % 2], at + k * 1000) for k in range(6)]
        rows += ["", "no json", "[1]", line(99, "a", "late"), line(98, "a\"q", at), line(10 * d + 7, "c", None)]
        (shard / "part-0.json").write_text("\n".join(rows) + ("\n" if d % 2 else ""))
    (base / "_SUCCESS").write_text("")
    return tmp_path / "m"


def test_rows_are_those_of_the_plain_reader_in_any_ranges(spark, folder):
    uri = folder.as_uri()
    columns = ["record_id", "session_key", "session_id", "role", "message_text", "recorded_at", "timestamp"]
    want = sorted(map(str, logs.read_messages(spark, uri).select(*columns).collect()))
    assert len(want) == 40
    for size in (37, 200, 10_000_000):
        got = spark.read.format("daily_logs").option("rangeBytes", size).load(uri)
        assert sorted(map(str, got.select(*columns).collect())) == want, size
    assert {str(r.d) for r in got.select(F.col("shard_date").alias("d")).distinct().collect()} == {f"2024-01-0{d}" for d in range(1, 6)}
    empty = folder.parent / "none"
    assert spark.read.format("daily_logs").load(empty.as_uri()).count() == 0


def test_options_decide_which_files_are_opened(spark, folder):
    start, uri = 1_704_067_200_000, folder.as_uri()

    def opened(**options):
        return [p.path.split("=")[1][:10] for p in logsource._Batch({"path": uri, **options}).partitions()]

    assert opened(session="a", since=str(start + 3 * DAY)) == ["2024-01-03", "2024-01-04", "2024-01-05"]  # a day's room for zones
    assert opened(until=str(start)) == ["2024-01-01", "2024-01-02"] and opened(firstday="2024-01-02", lastday="2024-01-02") == ["2024-01-02"]
    assert len(opened(since=str(-(10**18)), until=str(10**18))) == 5
    plain = logs.read_messages(spark, uri).withColumn("shard_date", F.to_date(F.timestamp_millis("timestamp")))
    of = lambda df: sorted(r[0] for r in df.select("record_id").collect())
    cases = [
        ({"session": "a", "since": start + 2 * DAY + 2000}, f"session_key = 'a' and timestamp >= {start + 2 * DAY + 2000}"),
        ({"first_day": date(2024, 1, 2), "last_day": date(2024, 1, 3), "since": 0}, "shard_date between '2024-01-02' and '2024-01-03'"),
        ({"session": 'a"q'}, "session_key = 'a\"q'"),
        ({"session": "c"}, "session_key = 'c'"),
        ({"until": start}, f"timestamp <= {start}"),
        ({"session": "none"}, "false"),
    ]
    for options, where in cases:
        assert of(logsource.read(spark, uri, **options)) == of(plain.where(where)), where
    both = logsource.read(spark, uri, session="a").unionByName(logsource.read(spark, uri, session="b"))
    assert of(both) == of(plain.where("session_key in ('a', 'b')"))


def test_a_stream_goes_on_where_it_stopped(spark, folder):
    out, state = folder.parent / "out", folder.parent / "state"

    def run():
        q = spark.readStream.format("daily_logs").load(folder.as_uri()).writeStream.format("parquet").option("path", out.as_uri()).option("checkpointLocation", state.as_uri()).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(out.as_uri()).select("record_id").collect())

    first = run()
    shard = folder / "conversations" / "shard=2024-01-05" / "part-0.json"
    with shard.open("a") as f:
        f.write(line(500, "a", 1) + "\n" + line(501, "a", 2)[:20])
    second = run()
    assert sorted([*first, "500"]) == second
    with shard.open("a") as f:
        f.write(line(501, "a", 2)[20:] + "\n")
    new = folder / "conversations" / "shard=2024-01-06"
    new.mkdir()
    (new / "part-1.json").write_text(line(600, "b", 5) + "\n")
    assert sorted([*second, "501", "600"]) == run() == run()
