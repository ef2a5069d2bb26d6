"""State machines over streams that come in pieces, out of order and more than once."""

import datetime as dt

from sleuthgrid.streaming import state as st

T0 = dt.datetime(2024, 1, 1)


def write(spark, path, batches, schema):
    """One file for each batch, in order."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/x{i}")
        name = next(f for f in os.listdir(f"{path}/x{i}") if f.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{path}/x{i}/{name}", f"{path}/in/{i:03d}.parquet")
        now = time.time() - 1000 + i
        os.utime(f"{path}/in/{i:03d}.parquet", (now, now))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_run_states(spark, tmp_path):
    schema = "plan string, event string, ts timestamp, id long"
    batches = [
        [("a", "started", at(0), 1), ("b", "started", at(0), 2), ("c", "started", at(0), 3), ("d", "completed", at(5), 4)],
        [("a", "step", at(300), 5), ("a", "step", at(300), 5), ("c", "completed", at(200), 7), ("c", "step", at(100), 6), (None, "step", at(1), 8)],
        [("z", "started", at(600), 9)],  # b has been silent for 600 s: not over it
        [("z", "step", at(601), 10), ("b2", "started", at(601), 11)],
        [("z", "step", at(602), 14)],  # the first batch after the stream's time has passed 600 s
        [("b", "started", at(900), 12), ("z", "failed", at(901), 13)],
    ]
    stream = write(spark, str(tmp_path), batches, schema)
    rows = st.replay(st.run_states(stream, "plan", "event", "ts", "id"), "update").collect()
    said = {}
    for r in sorted(rows, key=lambda r: r["_batch"]):
        said.setdefault(r["plan"], []).append(r["state"])
    assert said["a"][:2] == ["running", "running"] and said["a"][-1] == "stalled"
    assert said["b"] == ["running", "stalled", "running"]
    assert said["c"] == ["running", "completed"] and said["d"] == ["completed"]
    assert said["z"] == ["running", "running", "running", "failed"] and said["b2"] == ["running"]


def test_requirement_states(spark, tmp_path):
    schema = "req string, good boolean, ts timestamp"
    batches = [[("a", False, at(0)), ("b", False, at(0)), ("c", True, at(0)), ("d", None, at(0))], [("a", False, at(10)), ("b", True, at(10)), ("c", False, at(10))], [("a", True, at(20))]]
    rows = st.replay(st.requirement_states(write(spark, str(tmp_path), batches, schema), "req", "good", "ts"), "update").collect()
    said = {}
    for r in sorted(rows, key=lambda r: r["_batch"]):
        said.setdefault(r["req"], []).append((r["state"], r["attempts"]))
    assert said == {"a": [("pending", 1), ("unmet", 2), ("satisfied", 3)], "b": [("pending", 1), ("satisfied", 2)], "c": [("satisfied", 1), ("satisfied", 1)], "d": [("pending", 1)]}


def test_sessions_late_and_repeated(spark, tmp_path):
    schema = "u string, ts timestamp, id long"
    batches = [[("a", at(0), 1), ("a", at(100), 2), ("a", at(100), 2)], [("a", at(1500), 3), ("b", at(10_000), 4)], [("a", at(20), 5), ("b", at(30_000), 6)]]  # id 5 is late
    rows = st.replay(st.sessions(write(spark, str(tmp_path), batches, schema), "u", "ts", unique="id"), "append").collect()
    assert sorted((r["u"], r["start"], r["n"]) for r in rows) == [("a", at(0), 3), ("b", at(10_000), 1)]
