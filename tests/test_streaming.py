"""Batch = stream: several time-ordered micro-batches, and a second run from the checkpoint."""
import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from roomgrid.operators import ratelimit as RL
from roomgrid.schemas import DRIVER
from roomgrid.sources.tables import read_table
from roomgrid.streaming.files import file_stream, write_in_order
from roomgrid.streaming.ratelimit import run_limiter


def test_limiter_resumes_and_equals_batch(spark, sf, tmp_path):
    t = pq.read_table(f"{sf}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    cuts = [0, t.num_rows // 3, 2 * t.num_rows // 3, t.num_rows]
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()

    def run():
        ev = file_stream(spark, str(src), DRIVER["events"], "events*.parquet").withColumn("user_id", F.col("user_id").cast("string"))
        return run_limiter(spark, ev, 6 * 3600, 2, out, ck)

    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        pq.write_table(t.slice(lo, hi - lo), src / f"events_{i}.parquet")
        if i != 1:       # the second and third file are two micro-batches of the second run
            got = run()
    want = RL.sessions(read_table(spark, sf, "events").withColumn("user_id", F.col("user_id").cast("string")), 6 * 3600, 2)
    cols = ["event_id", "user_id", "ordinal", "allowed"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert run().count() == t.num_rows      # nothing new: nothing added


def test_limiter_state_expires(spark, tmp_path):
    import datetime as dt
    src = tmp_path / "in"
    day = dt.datetime(2024, 1, 1)
    for i, (user, hour) in enumerate([("a", 0), ("b", 30), ("b", 60), ("b", 90)]):
        rows = [(i, user, day + dt.timedelta(hours=hour))]
        spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp").coalesce(1).write.mode("append").parquet(str(src))
    ev = file_stream(spark, str(src), "event_id long, user_id string, ts timestamp")
    run_limiter(spark, ev, 3600, 2, str(tmp_path / "out"), str(tmp_path / "ck"))
    state = spark.read.format("statestore").load(str(tmp_path / "ck"))
    assert {r.key.user_id for r in state.collect()} <= {"b"}


def test_trace_log_stream_and_append_sink(spark, sf, tmp_path):
    from roomgrid.sources.files import append_table
    from roomgrid.sources.views import chats, chats_from
    from roomgrid.streaming.route import run_trace_log
    folder = write_in_order(read_table(spark, sf, "conversations"), "conv_id", 2, str(tmp_path / "in"))
    got = run_trace_log(spark, file_stream(spark, folder, DRIVER["conversations"]), chats_from,
                        str(tmp_path / "log"), str(tmp_path / "ck"))
    rows = got.collect()
    assert len(rows) == chats(spark, sf).count()
    steps = json.loads(rows[0].payload)["steps"]
    assert [s["step_type"] for s in steps] == ["plan", "act", "critique", "decision"]
    assert json.loads(steps[0]["content"])["substeps"] and json.loads(steps[1]["content"])["tool"]
    out = str(tmp_path / "agent_traces")
    append_table(got, out)
    append_table(got, out)
    assert spark.read.parquet(out).count() == 2 * len(rows)


def test_form_messages_by_configuration(spark, tmp_path):
    from roomgrid.streaming.files import addressed, message_stream, run_to_end
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"message_id": 1, "from_raw": "+254", "text": "habari", "ts": "2024-01-01T00:00:00Z"}\n'
                                   '{"message_id": 2}\nnot json\n')
    (folder / "b.json").write_text('{"message_id": 3, "from_raw": null, "text": "", "other": 1}\n')
    (folder / "c.skip").write_text('{"message_id": 9, "text": "no"}\n')
    source = {"path": str(folder), "options": {"pathGlobFilter": "*.json", "maxFilesPerTrigger": "1"}}

    def start():
        for name, df in zip(("good", "bad"), addressed(message_stream(spark, source))):
            run_to_end(df.writeStream.format("parquet").option("path", str(tmp_path / name)), str(tmp_path / f"c-{name}"))
        return (sorted((r.message_id, r.user_key, r.text) for r in spark.read.parquet(str(tmp_path / "good")).collect()),
                sorted(r.reject_reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()))

    first = start()
    assert first == ([(1, "whatsapp:254", "habari"), (3, "anon", "")], ["missing message_id", "missing text"])
    assert start() == first
    (folder / "d.json").write_text('{"message_id": 4, "from_raw": "whatsapp:+7", "text": "x"}\n')
    assert [r[0] for r in start()[0]] == [1, 3, 4]
