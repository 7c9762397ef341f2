import random

from pyspark.sql import functions as F

from tonearm.streaming import ratelimit as L


def test_limiter_equals_a_plain_log(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "b", None]), 1_700_000_000 + r.randrange(600)) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want, logs = {}, {}
    for i, k, t in sorted(rows, key=lambda x: (str(x[1]), x[2], x[0])):
        log = [x for x in logs.get(k, []) if x >= t - 60]
        want[i] = len(log) < 5
        logs[k] = log + [t] if want[i] else log
    got = {x["event_id"]: x["allowed"] for x in L.limit_batch(events, "user", "ts", "event_id", 5).collect()}
    assert got == want and 0 < sum(got.values()) < len(got)
    one_batch = L.decide([t for _, k, t in sorted(rows, key=lambda x: (x[2], x[0])) if k == "b"], 5, 60)[0]
    assert sum(one_batch) == sum(want[i] for i, k, _ in rows if k == "b")
