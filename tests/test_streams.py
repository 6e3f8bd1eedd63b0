"""Keyed state: copies, late copies, expiry and batches that run again; panes of usage."""

import datetime as dt
import hashlib
import os
import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from topicloom.operators import history
from topicloom.streaming import jobs

POST = "post_id long, topic string, source string, content string, url string, collected_at timestamp, likes long, comments long, shares long"


def post(i, text, hour, url="https://e.com"):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=hour)
    return (i, "t", "web", text, url, at, 1, 0, 0)


def deliver(spark, folder, no, rows):
    """One more file of the stream, in the order of its name."""
    spark.createDataFrame(rows, POST).coalesce(1).write.parquet(f"{folder}/{no:03d}")


def arriving(spark, folder):
    return spark.readStream.schema(POST).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(spark, tmp, delay="2 days"):
    jobs.run_posts(arriving(spark, f"{tmp}/in"), f"{tmp}/out", f"{tmp}/state", delay).awaitTermination()
    return sorted(r.post_id for r in spark.read.parquet(f"{tmp}/out").collect())


def test_copies_late_copies_and_expiry(spark, tmp_path):
    tmp = str(tmp_path)
    deliver(spark, f"{tmp}/in", 1, [post(2, "a", 5), post(1, " a ", 3), post(3, "b", 4), post(9, "", 1), post(8, "c", 1, " ")])
    assert run(spark, tmp) == [1, 3]
    deliver(spark, f"{tmp}/in", 2, [post(4, "a", 1), post(5, "b", 30), post(6, "b", 30, "https://f.com")])
    assert run(spark, tmp) == [1, 3, 6]  # a copy that is older and one that is younger
    deliver(spark, f"{tmp}/in", 3, [post(7, "d", 24 * 9)])
    deliver(spark, f"{tmp}/in", 4, [post(10, "a", 24 * 9), post(11, "d", 24 * 9), post(12, "e", 2)])
    # the hash of "a" is forgotten, 12 is behind the watermark
    assert run(spark, tmp) == [1, 3, 6, 7, 10]


def test_a_batch_that_runs_again_leaves_its_rows_once(spark, tmp_path):
    tmp = str(tmp_path)
    deliver(spark, f"{tmp}/in", 1, [post(1, "a", 1), post(2, "b", 2)])
    assert run(spark, tmp) == [1, 2]
    deliver(spark, f"{tmp}/in", 2, [post(3, "a", 3), post(4, "c", 4)])
    assert run(spark, tmp) == [1, 2, 4]
    last = max(int(n) for n in os.listdir(f"{tmp}/state/commits") if n.isdigit())
    os.remove(f"{tmp}/state/commits/{last}")  # as if the driver had ended before the commit
    if os.path.exists(f"{tmp}/state/commits/.{last}.crc"):
        os.remove(f"{tmp}/state/commits/.{last}.crc")
    assert run(spark, tmp) == [1, 2, 4]


def test_hashes_share_state_by_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "HASH_GROUPS", 2, raising=False)
    tmp, text = str(tmp_path), lambda i: f"text {i % 300}"
    deliver(spark, f"{tmp}/in", 1, [post(i, text(i), i % 40) for i in range(400)])
    first = jobs.run_posts(arriving(spark, f"{tmp}/in"), f"{tmp}/out", f"{tmp}/state", "2 days")
    first.awaitTermination()
    # of 0 and 300 the earlier stays: hours i % 40 and (i + 300) % 40
    kept = [min((h % 40, h) for h in (i, i + 300) if h < 400)[1] for i in range(300)]
    assert sorted(r.post_id for r in spark.read.parquet(f"{tmp}/out").collect()) == sorted(kept)
    assert first.lastProgress["stateOperators"][0]["numRowsTotal"] < 50
    deliver(spark, f"{tmp}/in", 2, [post(500 + i, text(i), 30) for i in range(295, 300)] + [post(600, "new", 30)])
    assert run(spark, tmp) == sorted([*kept, 600])


class Group:
    """The state of one group of hashes, in memory."""

    def __init__(self):
        self.state, self.timers, self.written = {}, set(), 0

    def getMapState(self, *_):
        return self

    def iterator(self):
        return iter(list(self.state.items()))

    def updateValue(self, key, value):
        self.state[key] = value
        self.written += len(value[0])

    def removeKey(self, key):
        del self.state[key]

    def registerTimer(self, at):
        assert at not in self.timers
        self.timers.add(at)

    def listTimers(self):
        return iter(sorted(self.timers))


def batch_of(processor, group, mark, rows):
    """The posts that one batch emits; timers follow its rows."""
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    out = [r["post_id"] for r in processor.handleInputRows((0,), iter(rows), now)]
    for at in sorted(t for t in group.timers if t <= mark):
        list(processor.handleExpiredTimer((0,), now, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))
        group.timers.remove(at)
    return out


def arrived(i, text, second):
    at = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)
    return {"post_id": i, "collected_at": at, "content_hash": hashlib.sha256(text.encode()).hexdigest()}


def test_each_hash_of_a_group_is_forgotten_at_its_own_time():
    for seed in range(40):
        rng, group, processor = random.Random(seed), Group(), jobs.FirstOfContent("40 seconds", ["collected_at", "post_id"])
        processor.init(group)
        until, newest, no, again = {}, 1000, 0, 0
        for _ in range(120):
            mark, rows = max(0, newest - 40), []
            for _ in range(rng.randrange(8)):
                no += 1
                rows.append((no, f"t{rng.randrange(25)}", newest + rng.choice([9, 3, 0, -5, -20, -39, -40, -45])))
            expected = {}
            for i, text, at in sorted(rows, key=lambda r: (r[2], r[0])):
                if at >= mark and until.get(text, -1) < mark and text not in expected:
                    expected[text] = (i, at + 40)
            again += sum(text in until for text in expected)
            until |= {text: t for text, (_, t) in expected.items()}
            until = {text: t if t > mark else -1 for text, t in until.items()}
            assert sorted(batch_of(processor, group, mark * 1000, [arrived(*r) for r in rows])) == sorted(i for i, _ in expected.values())
            newest = max([newest, *(r[2] for r in rows)])
        assert again
        assert batch_of(processor, group, (newest + 100) * 1000, []) == [] and not group.state and not group.timers


def test_what_a_group_has_seen_is_not_written_again_in_every_batch():
    group, processor = Group(), jobs.FirstOfContent("60 days", ["collected_at", "post_id"])
    processor.init(group)
    for no in range(256):
        assert batch_of(processor, group, 0, [arrived(no, f"t{no}", 1000), arrived(-no - 1, f"t{no // 2}", 2000)]) == [no]
    assert sum(len(v[0]) for v in group.state.values()) == 256 * jobs.SEEN.size
    assert group.written <= 256 * jobs.SEEN.size * 9 and len(group.state) <= 9


def test_history_keeps_totals_in_state(spark, tmp_path):
    tmp, schema = str(tmp_path), "id long, topic string, captured_at timestamp, elapsed_secs double"
    at = lambda d: dt.datetime(2024, 1, d, tzinfo=dt.timezone.utc)
    for no, rows in enumerate([[(1, "a", at(1), 1.0), (2, "b", at(2), 2.0)], [(3, "a", at(5), 3.0)], [(4, "a", at(3), 5.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp}/in/{no}")
        runs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*")
        jobs.run_history(runs, f"{tmp}/out", f"{tmp}/state").awaitTermination()
    got = {r.topic: (r.total_runs, r.avg_elapsed, r.last_run_at.day) for r in jobs.read_history(spark, f"{tmp}/out").collect()}
    assert got == {"a": (3, 3.0, 5), "b": (1, 2.0, 2)}


def usage_log(spark):
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(3)}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(30 * 1440)), rng.choice([200, 404, None]),
             rng.choice([None, 1.5, 2.25]), rng.randrange(9)) for _ in range(800)]
    return spark.createDataFrame(rows, "source string, logged_at timestamp_ntz, status_code int, response_ms double, record_count long")


def test_panes_give_what_the_log_gives(spark):
    log = usage_log(spark)
    panes = history.usage_panes(log)
    for as_of in ("2024-01-20 00:00:00", "2024-01-20 13:07:00"):
        at = F.to_timestamp_ntz(F.lit(as_of))
        assert history.usage_from_panes(panes, log, at).collect() == history.usage_summary(log, at).collect()
    rolling = {(r.window_start, r.source): r for r in history.rolling_usage(panes).collect()}
    for (start, source), r in rolling.items():
        rows = log.where((F.col("logged_at") >= F.lit(start)) & (F.col("logged_at") < F.lit(r.window_end)) & (F.col("source") == source))
        if start.day % 9 == 0:
            assert rows.count() == r.total_calls


def test_stream_counts_each_call_in_one_pane(spark, tmp_path):
    log = usage_log(spark).withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    log.write.parquet(f"{tmp_path}/in")
    assert "Expand" not in jobs.usage_panes(log)._jdf.queryExecution().optimizedPlan().toString()
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    jobs.run_usage(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("total_calls")).first()[0] == 800
