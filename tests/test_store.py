"""Commits, the staged pipeline on them, incremental reconciliation and re-extraction."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import document, statement
from ledgerloom import schemas
from ledgerloom.operators import incremental, lookups, match, quality
from ledgerloom.operators import store as store_rules
from ledgerloom.plans.checkpoint import cut
from ledgerloom.plans.commits import Conflict, Store
from ledgerloom.plans.projection import transactions
from ledgerloom.streaming import pipeline

NOW, SEEN = datetime(2026, 2, 1), datetime(2026, 1, 31)
BLOCKS, COLUMNS, XHTML = "STATEMENT_BLOCKS_V1", "STATEMENT_COLUMNS_V1", "application/xhtml+xml"


@pytest.fixture(autouse=True)
def few_parts(monkeypatch):
    monkeypatch.setattr(incremental, "PARTS", 4)


def evidence(spark, *rows):
    """(id, source, reference, bytes)"""
    return spark.createDataFrame([(i, s, "MANUAL", r, XHTML, raw, SEEN) for i, s, r, raw in rows], schemas.EVIDENCE)


def put(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_a_commit_is_whole_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"a": "x int", "b": "y int, p int"}, {"b": ("p",)})
    empty = store.snapshot()
    assert empty.version == 0 and empty.read("a").count() == 0
    one = empty.commit({"a": spark.range(3).selectExpr("cast(id as int) x"), "b": spark.range(4).selectExpr("cast(id as int) y", "cast(id % 2 as int) p")}, marks={"n": 7})
    # A writer dies after its first table: nothing of it is seen, and the next one is not hindered.
    broken = spark.range(1).select(F.raise_error(F.lit("killed")).cast("int").alias("y"), F.lit(0).alias("p"))
    with pytest.raises(Exception, match="killed"):
        one.commit({"a": spark.range(9).selectExpr("cast(id as int) x"), "b": broken})
    seen = store.snapshot()
    assert (seen.version, seen.marks, seen.read("a").count(), seen.read("b").count()) == (1, {"n": 7}, 3, 4)
    two = seen.commit({"a": spark.range(2).selectExpr("cast(id as int) x")}, {"b": spark.range(1).selectExpr("cast(id as int) y", "5 p")})
    assert two.read("a").count() == 5 and [tuple(r) for r in two.read("b").collect()] == [(0, 5)]
    assert seen.read("a").count() == 3 and store.snapshot(1).read("b").count() == 4 and store.versions() == [1, 2]
    with pytest.raises(Conflict):  # two writers from one version
        seen.commit({"a": spark.range(1).selectExpr("cast(id as int) x")})
    with pytest.raises(ValueError):
        store.snapshot(9)


def test_vacuum_leaves_what_is_read_or_being_written(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"a": "x int", "b": "y int"})
    rows = lambda n: spark.range(n).selectExpr("cast(id as int) x")
    assert store.vacuum() == {}
    one = store.snapshot().commit({"a": rows(3), "b": rows(1).withColumnRenamed("x", "y")})
    two = one.commit({"a": rows(2)})
    three = two.commit({}, {"a": rows(4)})
    with pytest.raises(Conflict):  # leaves a folder that no marker names
        two.commit({"a": rows(7)})
    assert store.vacuum(keep=3) == {} and store.snapshot(1).read("a").count() == 3
    gone = store.vacuum(keep=1)  # the loser's folder is young: it might be at work
    assert {k: len(v) for k, v in gone.items()} == {"a": 2} and len(list((tmp_path / "data" / "a").iterdir())) == 2
    assert (three.read("a").count(), store.snapshot().read("b").count(), store.versions()) == (4, 1, [1, 2, 3])
    with pytest.raises(ValueError, match="vacuumed"):
        store.snapshot(2)
    with pytest.raises(Conflict):  # a writer from a version of long ago is still told
        one.commit({"b": rows(1).withColumnRenamed("x", "y")})
    assert {k: len(v) for k, v in store.vacuum(keep=1, grace_seconds=-1).items()} == {"a": 1, "b": 1}
    assert store.vacuum(keep=5) == {} and store.oldest() == 3 and store.snapshot().read("a").count() == 4
    with pytest.raises(ValueError):
        store.vacuum(keep=0)


def test_stages_store_once_retry_for_ever_and_go_on(spark, tmp_path):
    """Two sources tell of one movement, one artifact arrives twice, one fails and is read again when due; a failing stage stops no other."""
    inbox, root = str(tmp_path / "in"), str(tmp_path / "out")
    text = statement(("6 ENE 2026", "Tienda Compra", "-$10.00"))
    put(evidence(spark, ("a", "s1", "1", text), ("b", "s2", "1", text), ("c", "s1", "2", statement(("6 ENE 2026", "Tienda Compra", "-$0.00"))), ("d", "s1", "3", b"<doc/>")), inbox)
    run = lambda: pipeline.run_stages(spark, pipeline.inbox(spark, inbox), root, BLOCKS, NOW)
    assert run() == {}
    put(evidence(spark, ("a2", "s1", "1", text)), inbox)
    assert run() == {}
    snap = pipeline.ledger(spark, root).snapshot()
    assert {r["id"] for r in snap.read("evidence").collect()} == {"a", "b", "c", "d"} and bytes(snap.read("evidence").where("id = 'a'").first()["raw_content"]) == text
    stages = {r["id"]: r for r in pipeline.latest(snap.read("stages"), "id").collect()}
    assert {k: (r["processing_stage"], r["status"], r["attempts"]) for k, r in stages.items()} == {"a": ("RECONCILED", "READ", 1), "b": ("RECONCILED", "READ", 1), "c": ("RECEIVED", "FAILED", 1), "d": ("RECONCILED", "UNRECOGNISED", 1)}
    assert stages["c"]["problem"] == "the amount did not parse" and stages["c"]["next_try"] == NOW + timedelta(minutes=1)
    state = sorted((r["transaction_state"], r["reconciliation_state"]) for r in pipeline.transactions(spark, root).collect())
    assert state == [("ACTIVE", "RECONCILED"), ("SUPERSEDED", "RECONCILED")]
    # All four kinds of events, numbered without a gap over the commits; a page of the feed.
    events = snap.read("events").orderBy("seq").collect()
    assert [e["seq"] for e in events] == list(range(1, len(events) + 1)) and snap.marks["seq"] == len(events)
    assert {k: sum(e["type"] == k for e in events) for k in {e["type"] for e in events}} == {"EvidenceIngested": 4, "ClaimActivated": 2, "TransactionCreated": 2, "TransactionReconciled": 1}
    basis = [json.loads(e["payload"])["basis"] for e in events if e["type"] == "TransactionReconciled"]
    assert basis == ["composite"] and [r["seq"] for r in pipeline.feed(snap, after=3, limit=2).collect()] == [4, 5]
    # A batch that is run again, as after a lost offset commit, does nothing.
    import shutil

    assert snap.marks["batch:inbox"] == 1
    shutil.rmtree(f"{root}/checkpoints")
    assert run() == {} and pipeline.ledger(spark, root).snapshot().version == snap.version
    # No try is the last one: eleven of them, each when due and not before.
    at = NOW
    for n in range(2, 12):
        assert n > 3 or pipeline.retry_due(spark, root, at) == 0
        at += timedelta(days=1)
        assert pipeline.retry_due(spark, root, at) == 1
    assert pipeline.latest(pipeline.ledger(spark, root).snapshot().read("stages"), "id").where("id = 'c'").first()["attempts"] == 11
    assert pipeline.build(spark, root) == 0 and pipeline.reconcile(spark, root) == 0
    # Tidied, it reads as before from fewer rows and folders.
    held = lambda s: {t: sorted(map(str, s.read(t).collect())) for t in ("evidence", "claims", "fields", "slots", "events")}
    snap = pipeline.ledger(spark, root).snapshot()
    was, stood, folders = held(snap), sorted(map(str, pipeline.transactions(spark, root).collect())), sum(map(len, snap.tables.values()))
    gone = pipeline.tidy(spark, root, keep=1)
    now = pipeline.ledger(spark, root).snapshot()
    assert held(now) == was and sorted(map(str, pipeline.transactions(spark, root).collect())) == stood and now.marks == snap.marks
    assert now.read("stages").count() == 4 and sum(map(len, now.tables.values())) < folders and len(gone["stages"]) > 10
    assert pipeline.retry_due(spark, root, at + timedelta(days=1)) == 1
    done = []
    problems = pipeline.run_stages(spark, None, root, BLOCKS, NOW, {"one": lambda: 1 / 0, "two": lambda: done.append(2)})
    assert list(problems) == ["one"] and done == [2]


def test_counters_of_a_pass(spark, tmp_path):
    rows = [("a", "s", "1", statement(("6 ENE 2026", "Tienda Compra", "-$10.00"), ("7 ENE 2026", "otro", "-$1.00"))), ("b", "s", "2", b"<doc/>"), ("c", "s", "3", b"<doc>")]
    snap, seen = pipeline.receive(pipeline.ledger(spark, str(tmp_path)).snapshot(), evidence(spark, *rows), BLOCKS, NOW)
    assert seen.get == {"processed": 3, "claimed": 1, "unrecognised": 1, "failed": 1, "skipped": 1}
    _, seen = pipeline.receive(snap, evidence(spark, *rows), BLOCKS, NOW)
    assert seen.get["processed"] == 0


@pytest.fixture(scope="module")
def some(spark):
    rows = transactions(spark, "/root/testdata/sf0.001").where("pmod(xxhash64(id), 3) = 0").withColumns({"claim_id": F.col("id"), "evidence_id": F.col("id")})
    return cut(rows.select(*[c for c in spark.createDataFrame([], incremental.SCHEMAS["transactions"]).columns if c not in ("part", "step")]))


def drained(tx, known=None):
    """Full sweeps until nothing is added."""
    before = -1
    while True:
        tx, known = match.run(tx, known, cut)
        known = cut(known)
        if (n := known.count()) == before:
            return tx, known
        before = n


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def pass_over(snap, new):
    work = incremental.reconciled(snap, new)
    part = incremental.part_of("id").alias("part")
    return snap.commit(incremental.additions(work) | {"transactions": new.select("*", F.lit(snap.version + 1).cast("long").alias("step"), part)})


def test_incremental_equals_full_sweeps(spark, some, tmp_path):
    """In two parts, ids mixed so that heads change, against full sweeps after each part."""
    first, second = some.where("pmod(xxhash64(id, 1), 10) < 6"), some.where("pmod(xxhash64(id, 1), 10) >= 6")
    snap = pass_over(Store(spark, str(tmp_path), incremental.SCHEMAS, incremental.SPLIT).snapshot(), first)
    base = [c for c in some.columns if c not in ("claim_id", "evidence_id")]
    tx, known = drained(first.select(*base))
    assert same(snap.read("candidates").drop("step", "part"), known)
    # Compaction between the parts changes nothing but what is stored.
    before = {t: snap.read(t).count() for t in ("heads", "states")}
    snap = snap.commit({}, incremental.compacted(snap))
    assert all(snap.read(t).count() == snap.read(t).select(*k).distinct().count() <= before[t] for t, k in (("heads", ["sweep", "key"]), ("states", ["id"]))) and snap.read("heads").count() < before["heads"]
    snap = pass_over(snap, second)
    tx, known = drained(tx.unionByName(second.select(*base)), known)
    assert same(snap.read("candidates").drop("step", "part"), known)
    assert same(incremental.current(snap).select(*base), tx.select(*base))


def test_a_small_part_reads_a_small_part_of_the_index(spark, some, tmp_path, monkeypatch):
    """Two new rows of a table of hundreds: only the parts of their own keys are read, and no members where the head stays."""
    monkeypatch.setattr(incremental, "PARTS", 64)
    snap = pass_over(Store(spark, str(tmp_path), incremental.SCHEMAS, incremental.SPLIT).snapshot(), some)
    total = snap.read("blocks").count()
    read = {}
    stored = incremental.Blocks.stored

    def counted(self, table, wanted, on):
        parts = [r[0] for r in wanted.select(incremental.part_of(*on)).distinct().collect()]
        read[table] = read.get(table, 0) + self.snap.read(table).where(F.col("part").isin(parts)).count()
        return stored(self, table, wanted, on)

    monkeypatch.setattr(incremental.Blocks, "stored", counted)
    new = some.limit(2).withColumns({"id": F.concat(F.lit("Z"), "id"), "tracking_key": F.lit(None).cast("string"), "amount_minor": F.lit(-1).cast("long")})
    incremental.reconciled(snap, new)
    assert total > 1000 and sum(read.values()) < total / 4 and read.get("blocks", 0) == 0


def test_a_match_of_two_empties_its_block_at_once(spark, tmp_path, monkeypatch):
    """The two rows of a composite match are all that their block had: its head goes with them, and the sweep is not run over them
    again. Blocks hold of a row what their sweep compares. A third row that comes later finds an empty block."""
    calls, evaluate = [], incremental.Blocks.evaluate
    monkeypatch.setattr(incremental.Blocks, "evaluate", lambda self, sweep, adds, leaves: calls.append(sweep) or evaluate(self, sweep, adds, leaves))
    base = [c for c in spark.createDataFrame([], incremental.SCHEMAS["transactions"]).columns if c not in ("part", "step", "claim_id", "evidence_id")]
    made = spark.range(6).selectExpr(
        "concat(substr('ABC', 1 + cast(id % 3 as int), 1), id div 3) AS id", "concat('s', id % 3) AS source_id", "100 + id div 3 AS amount_minor", "'MXN' AS currency", "concat('M', id div 3) AS merchant",
        "'someone' AS counterparty", "'OUTFLOW' AS direction", "'SETTLED' AS financial_status", "'UNRECONCILED' AS reconciliation_state", "'ACTIVE' AS transaction_state", "cast(null AS string) AS superseded_by",
        "timestamp'2026-01-05 12:00:00' AS occurred_at", "cast(null AS string) AS tracking_key").select(*base)
    both = cut(made.withColumns({"claim_id": F.col("id"), "evidence_id": F.col("id")}))
    first, second = both.where("id not like 'C%'"), both.where("id like 'C%'")
    snap = pass_over(Store(spark, str(tmp_path), incremental.SCHEMAS, incremental.SPLIT).snapshot(), first)
    assert calls.count("composite") == 1
    heads = incremental.compacted(snap)["heads"].where("sweep = 'composite'")
    assert heads.count() == 0 and snap.read("heads").where("sweep = 'composite' and head is null and n = 0").count() == 2
    rows = {r["sweep"]: r for r in snap.read("blocks").selectExpr("sweep", "row.source_id is null AS s", "row.counterparty is null AS c", "row.direction is null AS d").distinct().collect()}
    assert tuple(rows["composite"])[1:] == (False, True, True) and tuple(rows["weak"])[1:] == (True, True, True)
    tx, known = drained(first.select(*base))
    assert known.where("basis = 'composite' and status = 'MATCH'").count() == 2 and same(snap.read("candidates").drop("step", "part"), known)
    snap = pass_over(snap, second)
    tx, known = drained(tx.unionByName(second.select(*base)), known)
    assert same(snap.read("candidates").drop("step", "part"), known) and same(incremental.current(snap).select(*base), tx.select(*base))


def both_layouts(n, columns_too=True):
    """A statement that the block reader and the column reader both can read, to different claims."""
    blocks = [(60, 100, 110, "6 ENE 2026"), (500, 100, 110, f"-${n}.00"), (140, 100, 110, f"Tienda{n} Compra")]
    columns = [(60, 5, 6, "01/01/2026"), (120, 5, 6, "al"), (180, 5, 6, "31/01/2026"), (45, 20, 21, "9"), (60, 20, 21, "CGO"), (100, 20, 21, f"ACME{n % 2}"), (430, 20, 21, "$4.00")]
    return document(blocks + columns * columns_too)


def test_reextraction_ends_as_a_fresh_build(spark, tmp_path):
    """Interpretations, transactions and merges of artifacts that are read again are taken back; the rest is decided as if they had never been."""
    raw = [(f"e{i}", f"s{i % 2}", str(i), both_layouts(1 + i // 2, i < 4)) for i in range(8)]  # pairs of two sources
    root, fresh = str(tmp_path / "old"), str(tmp_path / "new")
    ev = evidence(spark, *raw)
    now = lambda: pipeline.ledger(spark, root).snapshot()
    pipeline.receive(now(), ev, BLOCKS, NOW)
    assert pipeline.build(spark, root) == 8 and pipeline.reconcile(spark, root) == 4
    some = spark.createDataFrame([("e0",), ("e1",), ("e2",), ("e6",)], "id string")  # e6 has no columns: its reading fails, the old one stays
    assert pipeline.reextract(spark, root, some, COLUMNS, NOW) == 3
    open_again = {r["evidence_id"]: (r["transaction_state"], r["reconciliation_state"], r["superseded_by"]) for r in pipeline.transactions(spark, root).collect()}
    assert all(open_again[e] == ("SUPERSEDED", "UNRECONCILED", None) for e in ("e0", "e1", "e2")) and open_again["e3"] == ("ACTIVE", "UNRECONCILED", None) and open_again["e4"][1] == "RECONCILED"
    assert pipeline.build(spark, root) == 3 and pipeline.reconcile(spark, root) > 0
    assert pipeline.reextract(spark, root, some, COLUMNS, NOW) == 0  # the same reading again changes nothing

    store = pipeline.ledger(spark, fresh)
    pipeline.receive(store.snapshot(), ev.where("id in ('e0', 'e1', 'e2')"), COLUMNS, NOW)
    pipeline.receive(store.snapshot(), ev.where("id not in ('e0', 'e1', 'e2')"), BLOCKS, NOW)
    pipeline.build(spark, fresh)
    pipeline.reconcile(spark, fresh)
    gone = "not (transaction_state = 'SUPERSEDED' and superseded_by is null)"
    assert same(pipeline.transactions(spark, root).where(gone), pipeline.transactions(spark, fresh))
    assert same(pipeline.candidates(spark, root), pipeline.candidates(spark, fresh))
    assert same(pipeline.current_claims(now()), pipeline.current_claims(store.snapshot()))
    told = [json.loads(e["payload"]) for e in now().read("events").where("type = 'ClaimActivated'").collect()]
    assert sum("supersedesInterpretationId" in t for t in told) == 3


FLAT = "evidence_id string, claim_id string, field_name string, value_int long, value_text string, confidence string"


def test_claims_with_their_fields_are_pivoted_where_they_are(spark):
    """As a row per field gives it, with claims in several rows, fields that are there twice or unknown, and claims of none."""
    flat = spark.createDataFrame([
        ("e", "1", "amount_minor", 5, None, "HIGH"), ("e", "1", "amount_minor", 7, None, "HIGH"), ("e", "1", "merchant", None, "a", "LOW"), ("e", "1", "merchant", None, "b", "LOW"),
        ("e", "2", "colour", None, "red", "LOW"), ("f", "1", "financial_status", None, "SETTLED", "HIGH"), ("f", "1", "merchant", None, None, "LOW"),
    ], FLAT)
    field = F.struct("field_name", "value_int", "value_text", "confidence")
    half = F.coalesce(F.col("value_text"), F.lit("")) == "b"
    nested = flat.groupBy("evidence_id", "claim_id", half.alias("half")).agg(F.collect_list(field).alias("fields")).drop("half")
    nested = nested.unionByName(nested.limit(1).select(F.lit("none").alias("evidence_id"), "claim_id", F.slice("fields", 1, 0).alias("fields")))
    assert sorted(map(str, store_rules.pivot_claims(nested).collect())) == sorted(map(str, store_rules.pivot_claims(flat).collect()))


def test_only_the_fields_that_are_asked_for_are_aggregated(spark):
    rows = [("e", "2", "merchant", None, "a", "LOW"), ("e", "1", "merchant", None, "b", "HIGH"), ("f", "1", "colour", None, "red", "LOW"), (None, "1", "merchant", None, "c", "MEDIUM"), ("e", "3", "amount_minor", 1, None, "HIGH")]
    flat = spark.createDataFrame(rows, FLAT)
    out = lookups.confidences(flat, ["merchant"])
    assert {r[0]: r[1] for r in out.collect()} == {"e": "HIGH", "f": None, None: "MEDIUM"}
    problems = quality.claim_problems(flat)
    assert ("3", "AMOUNT_WITHOUT_CURRENCY") in {tuple(r) for r in problems.collect()}
    for df in (out, problems):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" in plan and ("IN (amount_minor,currency)" in plan or "= merchant" in plan)


def test_evidence_is_made_by_all_tasks(spark):
    from ledgerloom import queries

    assert queries.customer_statements(spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count() >= 4


def test_migrations_shuffle_ids_and_stores_are_compressed_well(spark, tmp_path):
    from ledgerloom.plans import migrations

    li = spark.range(4).select((F.col("id") % 2).alias("evidence_id"), F.col("id").cast("string").alias("claim_id"))
    heads = migrations.migrate({"claim_evidence": li}, 0)[0]["active_interpretation"]
    plan = heads._jdf.queryExecution().optimizedPlan().toString()
    assert "interpretation_id" not in plan.split("], [")[0] and heads.count() == 2  # grouped by ids alone
    snap = Store(spark, str(tmp_path), {"a": "evidence_id long, interpretation_id string"}).snapshot().commit({"a": heads})
    assert all(".zstd." in f for f in snap.read("a").inputFiles())
