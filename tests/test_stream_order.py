"""The event-time rate limit: decisions don't depend on how rows fall into batches."""

import os
import random
import time

from pyspark.sql import functions as F

from loomframe.operators import privacy
from loomframe.streaming import monitor


def run(spark, tmp_path, files, delay, limit, seconds):
    source = tmp_path / "in"
    source.mkdir()
    now = time.time() - 1000
    for i, rows in enumerate(files):
        at = str(source / f"{i:03d}.json")
        with open(at, "w") as f:
            f.writelines(f'{{"who": "{w}", "t": {t}}}\n' for w, t in rows)
        os.utime(at, (now + i, now + i))
    stream = spark.readStream.schema("who string, t double").option("maxFilesPerTrigger", 1).json(str(source)).select("who", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"))
    out = monitor.admitted_by_event_time(stream, "who", "ts", delay, limit, seconds)
    query = out.writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return sorted((r.who, round(r.ts.timestamp()), r.admitted) for r in spark.table("decided").collect())


def test_out_of_order(spark, tmp_path):
    draw = random.Random(5)
    events = [(draw.choice("ab"), 1000 + 7 * i) for i in range(60)]
    shuffled = sorted(events, key=lambda e: e[1] + draw.random() * 60)
    files = [shuffled[i : i + 15] for i in range(0, 60, 15)] + [[("z", 5000)], [("a", 900), ("z", 6000)], [("z", 7000)]]
    got = run(spark, tmp_path, files, "80 seconds", 2, 40)
    want = []
    for who in "ab":
        out, _, _ = monitor._in_order([t for w, t in events if w == who], [], 10**9, 2, 40)
        want += [(who, t, g) for t, g in out]
    assert [r for r in got if r[0] != "z"] == sorted(want), "in order whatever the batches; the late request of 900 is dropped"
    assert any(not g for *_, g in want)


def test_state_goes():
    done, pending, recent = monitor._in_order([5, 50], [1, 2], 20, 3, 10)
    assert done == [(5, True)] and pending == [50] and recent == []
    assert monitor._in_order([12], [5], 20, 1, 10) == ([(12, False)], [], [])


def test_transforms():
    assert privacy.allowed_transforms("float") == ("preserve", "noise", "hash", "synthetic") and "mask" in privacy.allowed_transforms("date")
