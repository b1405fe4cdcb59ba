"""The artifact source as a batch with pushed filters and as a stream, leases as keyed state, and smaller additions."""

import os
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import geometry, quality, query
from ledgerloom.plans import migrations
from ledgerloom.plans.commits import Store
from ledgerloom.sources.artifacts import ArtifactSource
from ledgerloom.streaming import leases


def test_filters_and_limit_reach_the_lister(spark, tmp_path):
    for name in ("a1", "a2", "b1", "b2"):
        (tmp_path / name).write_bytes(name.encode())
        os.utime(tmp_path / name, (1_000_000_000 + ord(name[1]), 1_000_000_000 + ord(name[1])))
    (tmp_path / "b3").mkdir()  # opening it fails: it must not be
    spark.dataSource.register(ArtifactSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        load = lambda **o: spark.read.format("artifacts").option("path", str(tmp_path)).options(**o).load()
        found = load().where("source_reference like 'a%' and length(raw_content) = 2 and observed_at <= timestamp_seconds(1000000049)")
        assert [r["source_reference"] for r in found.collect()] == ["a1"]
        plan = found._jdf.queryExecution().executedPlan().toString()
        left = plan.split("Filter", 1)[1].split("\n")[0]
        assert "length" in left and "StartsWith" not in left  # Spark tests only what the lister cannot
        assert [r[0] for r in load().where(F.col("source_reference").isin("b1", "a2", "none")).select("source_reference").orderBy("source_reference").collect()] == ["a2", "b1"]
        assert sorted(r[0] for r in load(limit=3).select("source_reference").collect()) == ["a1", "a2", "b1"]
        with pytest.raises(PySparkException):
            load().collect()
        assert load(bodies="false").count() == 5
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stream_admits_a_page_a_trigger_and_never_opens_twice(spark, tmp_path):
    raw, out, log, check = (str(tmp_path / n) for n in ("raw", "out", "log", "check"))
    os.mkdir(raw)
    put = lambda *names: [open(f"{raw}/{n}", "wb").write(n.encode()) for n in names]
    spark.dataSource.register(ArtifactSource)

    def run():
        arrived = spark.readStream.format("artifacts").option("path", raw).option("log", log).option("page", 2).load()
        arrived.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(out).select("source_reference").collect())

    put("c", "d", "e")
    assert run() == ["c", "d"]  # the admission limit
    for name in "cd":  # what was admitted is gone: opening it again would fail
        os.remove(f"{raw}/{name}")
    put("a", "f")  # one sorts before what is there already
    assert run() == ["a", "c", "d", "e"] and run() == ["a", "c", "d", "e", "f"] and run() == ["a", "c", "d", "e", "f"]
    put("c")  # the same reference again is no new artifact
    assert run() == ["a", "c", "d", "e", "f"]


def test_leases_expire_and_no_row_is_held_twice(spark, tmp_path):
    """A worker that dies gives its rows back when the lease ends; of two that ask, one gets the row."""
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    at = lambda s: datetime(2026, 1, 1, 0, 0, s) if s < 60 else datetime(2026, 1, 1, 0, s // 60, s % 60)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", leases.STORE)

    def send(*rows):
        spark.createDataFrame([(i, a, w, at(s)) for i, a, w, s in rows], leases.REQUEST).coalesce(1).write.mode("append").parquet(inbox)
        changes = leases.leased(spark.readStream.schema(leases.REQUEST).parquet(inbox), lease_ms=60_000)
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(((r["id"], r["worker"], r["change"], r["attempts"]) for r in spark.read.parquet(out).collect()))

    try:
        first = send(("x", "QUEUED", "", 0), ("x", "CLAIM", "w1", 1), ("x", "CLAIM", "w2", 2), ("y", "QUEUED", "", 0), ("y", "CLAIM", "w1", 1), ("y", "DONE", "w1", 5), ("z", "CLAIM", "w1", 1), ("q", "QUEUED", "", 0), ("q", "CLAIM", "w1", 1), ("q", "RELEASE", "w1", 2))
        held = [("q", "w1", "HELD", 1), ("q", "w1", "RELEASED", 0), ("x", "w1", "HELD", 1), ("y", "w1", "DONE", 1), ("y", "w1", "HELD", 1)]
        assert first == held
        second = send(("other", "QUEUED", "", 300))  # w1 died; time goes on, and the timer gives x back
        assert second == sorted([*held, ("x", "w1", "EXPIRED", 1)])
        third = send(("x", "CLAIM", "w2", 310), ("x", "DONE", "w1", 311), ("y", "CLAIM", "w2", 310))  # too late for w1; y is done
        assert third == sorted([*second, ("x", "w2", "HELD", 2)])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def test_nearest_on_decimals(spark):
    points = spark.createDataFrame([(1, 0.5), (1, 0.75), (1, 9.0), (2, 0.5)], "page int, y double")
    rows = spark.createDataFrame([(1, 0.25, "a"), (1, 1.0, "b"), (1, 0.5001, "c")], "page int, row_y double, name string")
    got = {(r["page"], r["y"]): r["name"] for r in geometry.nearest_within(points, rows, 0.25).collect()}
    assert got == {(1, 0.5): "c", (1, 0.75): "c"}  # c is 0.2499 away, b 0.25
    tie = geometry.nearest_within(points.where("y = 0.75"), rows.where("name <> 'c'").withColumn("row_y", F.when(F.col("name") == "a", 0.5).otherwise(F.col("row_y"))), 0.25)
    assert [r["name"] for r in tie.collect()] == ["b"]  # equally near: the later
    assert {(r["page"], r["y"]) for r in geometry.near_any(points, rows.select("page", F.col("row_y").alias("y")), 0.25).collect()} == {(1, 0.5), (1, 0.75)}
    assert geometry.nearest_within(points, rows, 0).count() == 0


def test_sums_and_reads_that_refuse(spark):
    money = spark.createDataFrame([("a", 1, "MXN"), ("a", 2, "MXN"), ("b", 1, "MXN"), ("b", 2, "USD"), ("c", None, "USD"), ("c", 5, "MXN")], "k string, amount bigint, currency string")
    total = lambda df: df.groupBy("k").agg(query.checked_sum(F.col("amount"), F.col("currency")).alias("s"))
    assert {r["k"]: r["s"] for r in total(money.where("k <> 'b'")).collect()} == {"a": 3, "c": 5}
    with pytest.raises(PySparkException, match="different currencies"):
        total(money).collect()
    ev = spark.createDataFrame([("1", "s", "MANUAL", "r1", None, None, datetime(2026, 1, 1)), ("2", "s", "FAX", "r2", None, None, datetime(2026, 1, 1))], schemas.EVIDENCE)
    key = lambda *refs: spark.createDataFrame([("s", r) for r in refs], "source_id string, source_reference string")
    assert [r["id"] for r in quality.point_read(ev, key("r1", "none"), ["source_id", "source_reference"]).collect()] == ["1"]
    with pytest.raises(PySparkException, match="TYPE"):
        quality.point_read(ev, key("r2"), ["source_id", "source_reference"]).collect()


def test_migrations_resume_between_steps(spark, tmp_path):
    root = str(tmp_path)
    Store(spark, root, migrations.VERSIONS[0]).snapshot().commit({"claim_evidence": spark.createDataFrame([(1, "c1"), (1, "c2"), (2, "c3")], "evidence_id bigint, claim_id string")})
    one = migrations.upgrade(spark, root, steps=1)  # and then the run dies
    assert one.marks["schema"] == 1 and one.read("interpretations").columns == ["id", "evidence_id"] and one.read("interpretation_claims").count() == 3
    full = migrations.upgrade(spark, root)
    assert full.marks["schema"] == 3 and {(r["evidence_id"], r["extraction_profile"], r["unread_rows"]) for r in full.read("interpretations").collect()} == {(1, "EMAIL_V1", 0), (2, "EMAIL_V1", 0)}
    assert migrations.upgrade(spark, root).version == full.version
    full.commit({}, marks={"schema": 9})
    with pytest.raises(ValueError, match="not known"):
        migrations.upgrade(spark, root)
