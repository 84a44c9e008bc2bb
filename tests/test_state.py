import datetime as dt
import random
import threading

from lattica.sources.buckets import BucketedTable
from lattica.streaming import services
from lattica.streaming.files import hash_table, merge_changes, watch


def rows_of(table):
    return {r.file_path: r.content_hash for r in table.read().collect()}


def test_an_update_rewrites_its_buckets(spark, tmp_path):
    t = hash_table(spark, str(tmp_path / "t"), buckets=8)
    frame = lambda d: spark.createDataFrame(list(d.items()), "file_path string, content_hash string").coalesce(1)
    first = {f"f{i}": "1" for i in range(50)}
    m = t.merge(frame(first))
    assert len(m["places"]) == 8 and rows_of(t) == first
    n = t.merge(frame({"f3": "2"}))
    assert len(n["touched"]) == 1 and sum(m["places"][b] != p for b, p in n["places"].items()) == 1
    assert rows_of(t) == first | {"f3": "2"} and t.merge(frame({})) == n
    t.merge(frame({"new": "1"}), frame({"f4": "", "none": ""}))
    want = first | {"f3": "2", "new": "1"}
    del want["f4"]
    assert rows_of(t) == want
    for i in range(3):
        t.merge(frame({"f5": str(i)}))
    assert t.versions() == [4, 5, 6] and BucketedTable(spark, str(tmp_path / "t"), ["file_path"], "file_path string, content_hash string").buckets == 8
    used = {p.split("/")[1] for v in t.versions() for p in t.manifest(v)["places"].values()}
    assert {p.parent.name for p in (tmp_path / "t/data").glob("*/_bucket=*")} == used


def test_two_writers_lose_nothing(spark, tmp_path):
    tables = [hash_table(spark, str(tmp_path / "t"), buckets=2) for _ in range(2)]
    frames = [spark.createDataFrame([(f"{w}-{i}", "x")], "file_path string, content_hash string").coalesce(1) for w in range(2) for i in range(2)]
    threads = [threading.Thread(target=lambda w=w: [tables[w].merge(f) for f in frames[2 * w : 2 * w + 2]]) for w in range(2)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert set(rows_of(tables[0])) == {"0-0", "0-1", "1-0", "1-1"} and tables[1].manifest()["version"] == 4


def test_files_merge_as_a_stream(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "A.java").write_text("a")
    (src / "B.java").write_text("b")
    table, seen = hash_table(spark, str(tmp_path / "t"), buckets=4), []
    step = lambda: merge_changes(watch(spark, str(src)), table, str(tmp_path / "c"), lambda d: seen.append(sorted(r.file_path[-6:] for r in d.collect()))).awaitTermination()
    step()
    (src / "C.java").write_text("c")
    step()
    assert seen == [["A.java", "B.java"], ["C.java"]] and len(rows_of(table)) == 3 and len(table.manifest()["touched"]) == 1


def test_states_of_shuffled_repeated_batches(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    events = []
    for s in range(12):
        for seq in range(rng.randrange(1, 12)):
            events.append((f"s{s}", seq, start + dt.timedelta(hours=rng.randrange(0, 100)), rng.choice([*services.STATES, services.REQUEST, services.REQUEST, "approve", "resume", "other"])))
    events.append(("clock", 0, start + dt.timedelta(hours=120), "other"))
    frame = lambda rows: spark.createDataFrame(rows, services.EVENTS).coalesce(1)
    batches = [events[:], rng.sample(events, len(events) // 2)]
    rng.shuffle(batches[0])
    third = len(events) // 3
    parts = [batches[0][:third], batches[0][third:] + batches[1], batches[1][:5], [("clock", 1, start + dt.timedelta(hours=120), "other")]]
    folder, out = tmp_path / "in", str(tmp_path / "out")

    def collect(df, number):
        if not df.isEmpty():
            df.selectExpr("*", f"{number}L AS batch").write.mode("append").parquet(out)

    for part in parts:  # a run for each, from the checkpoint of the one before
        frame(part).write.mode("append").parquet(str(folder))
        stream = services.states(spark.readStream.schema(services.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder)))
        stream.writeStream.outputMode("update").foreachBatch(collect).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in services.latest(spark.read.parquet(out)).select("service", "state", "iterations", "approval").collect()}
    want = {tuple(r) for r in services.fold(frame(events)).collect()}
    assert got == want and {"expired", "approved"} <= {r[3] for r in want}


def test_ranges():
    rng, ranges, seen = random.Random(1), [], set()
    for _ in range(400):
        n = rng.randrange(120)
        assert services._add(ranges, n) == (n not in seen)
        seen.add(n)
    assert [x for a, b in ranges for x in range(a, b + 1)] == sorted(seen)
