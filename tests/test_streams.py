"""Keyed tables, logs and the writer of batches under restarts and repeated batches."""

import json
import random
import time

import pytest

from devquarry.operators import segments
from devquarry.streaming import tables, writer

SCHEMA = "id string, at long, n int, removed boolean"


def changes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "LEAST", 16)
    monkeypatch.setattr(tables, "ROWS_A_BUCKET", 4)
    rng = random.Random(3)
    table, wanted, folder = tables.create(spark, str(tmp_path / "t"), "id string, at long, n int", "id", "at"), {}, str(tmp_path / "t")
    for number in range(7):
        rows = [(f"k{rng.randrange(30)}", rng.randrange(100), rng.randrange(9), rng.random() < 0.2) for _ in range(25)]
        rows = list({(r[0], r[1]): r for r in rows}.values())
        table = tables.apply(table, changes(spark, [*rows, (None, 1, 1, False)]), number)
        for k, at, n, gone in sorted(rows, key=lambda r: r[1]):
            if k not in wanted or wanted[k][0] <= at:
                wanted[k] = (at, n, gone)
    live = {(k, at, n) for k, (at, n, gone) in wanted.items() if not gone}
    assert {tuple(r) for r in table.rows().collect()} == live and len(table.version.segments) < 7
    size = segments.bytes_of(spark, folder)
    again = tables.apply(tables.opened(spark, folder), changes(spark, [("k1", 999, 1, False)]), 6)
    assert again.version == table.version and segments.bytes_of(spark, folder) == size  # a repeated batch adds nothing
    one = next(iter(live))
    looked = tables.merge(table).get([one[0]])
    assert [tuple(r) for r in looked.collect()] == [one]
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert any("own_bucket#" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:])  # one folder of the merged segment is listed
    assert len(tables.opened(spark, folder).version.segments) == 1 and table.get(["nobody"]).count() == 0
    with pytest.raises(segments.Outdated):
        tables.apply(table, changes(spark, [("k1", 999, 1, False)]), 9)


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_logs(spark, tmp_path):
    source, log = tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    read = lambda: spark.readStream.schema("at long, model string").json(str(source))
    lines(source / "a.json", [{"at": i, "model": "m"} for i in range(5)])
    for as_json, where in ((False, log), (True, log + "-json")):
        tables.append(read(), where, str(tmp_path / f"ck{as_json}"), as_json).awaitTermination()
    lines(source / "b.json", [{"at": 10 + i, "model": "n"} for i in range(3)])
    tables.append(read(), log, str(tmp_path / "ckFalse")).awaitTermination()
    found = tables.scan(spark, log, "at long, model string")
    assert sorted(r.at for r in found.collect()) == [0, 1, 2, 3, 4, 10, 11, 12]
    # a batch that ran before its checkpoint was written runs again
    tables.append(read().filter("at < 10"), str(tmp_path / "x"), str(tmp_path / "ckx")).awaitTermination()
    (tmp_path / "ckx" / "commits" / "0").unlink()
    for crc in (tmp_path / "ckx" / "commits").glob(".*"):
        crc.unlink()
    tables.append(read().filter("at < 10"), str(tmp_path / "x"), str(tmp_path / "ckx")).awaitTermination()
    assert tables.scan(spark, str(tmp_path / "x"), "at long, model string").count() == 5
    assert [r.at for r in tables.scan(spark, log, "at long, model string", "at", 4, 10).orderBy("at").collect()] == [4, 10]
    assert tables.scan(spark, log + "-json", "at long, model string", as_json=True).count() == 5


def test_writer(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "t")
    source.mkdir()
    (tmp_path / "seen").mkdir()
    tables.create(spark, folder, "lane int, batch long, ops int, key string, at long, payload string", "key", "at")

    def run(seconds):
        read = spark.readStream.schema("key string, at long, payload string").option("maxFilesPerTrigger", 2).json(str(source))

        def step(batch, number):
            batch.write.mode("overwrite").parquet(str(tmp_path / "seen" / f"run={number}"))
            from pyspark.sql import functions as F

            tables.apply(tables.opened(spark, folder), batch.withColumn("removed", F.lit(False)))

        running = writer.coalesced(read, lanes=2, window=50).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="50 milliseconds").start()
        deadline = time.time() + seconds
        while time.time() < deadline and running.isActive and not done():
            time.sleep(0.5)
        running.stop()
        if running.exception():
            raise running.exception()

    wanted = {}

    def done():
        return {r.key: r.payload for r in tables.opened(spark, folder).rows().collect()} == wanted

    rng, at = random.Random(9), 0
    for part in range(3):  # three runs on one checkpoint
        for name in range(2):
            rows = []
            for _ in range(150):
                at += 1
                rows.append({"key": f"k{rng.randrange(40)}", "at": at, "payload": f"v{at}"})
                wanted[rows[-1]["key"]] = f"v{at}"
            lines(source / f"{part}-{name}.json", rows)
        run(90)
        assert done(), part
    seen = spark.read.parquet(str(tmp_path / "seen"))
    batches = seen.groupBy("lane", "batch").agg({"ops": "max", "key": "count"}).collect()
    assert max(r["max(ops)"] for r in batches) == 64 and sum(r["max(ops)"] for r in batches) == 900  # every operation is in one batch
    assert seen.groupBy("lane", "batch", "key").count().filter("count > 1").count() == 0  # the last write of a key alone
