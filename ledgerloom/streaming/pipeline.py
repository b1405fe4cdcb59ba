"""The staged pipeline: artifacts arrive, each is stored and interpreted once, claims become transactions, and
transactions of several sources are reconciled.

Every stage makes one commit (plans.commits), so what it writes, raw evidence, interpretation, claims, slots, stages and
numbered events, is there as a whole or not at all; a stage that dies leaves nothing, and the next run takes it up again.
Extraction is Structured Streaming: a batch that runs again finds its number among the commit's marks and does nothing.
An artifact that arrives again, in whatever batch, is not stored again. A failed artifact is a stage row with the number
of tries and the time of its next one, for as often as it takes, never a failed batch.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import backoff_minutes
from ..operators import incremental, store
from ..plans.checkpoint import cut
from ..plans.commits import Snapshot, Store
from ..schemas import CLAIM_FIELD, EVIDENCE
from ..sources.extractor import Extractor
from ..text.interpreters import interpret

EVIDENCE_KEY = ["source_id", "source_reference"]
SCHEMAS = incremental.SCHEMAS | {
    "evidence": f"{EVIDENCE}, extraction_profile string",
    "stages": "id string, processing_stage string, status string, problem string, attempts int, next_try timestamp, step long",
    "interpretations": "id string, evidence_id string, extraction_profile string, unread_rows int, step long",
    "claims": "claim_id string, interpretation_id string, evidence_id string",
    "fields": CLAIM_FIELD,
    "slots": "evidence_id string, interpretation_id string, step long",
    "events": "seq long, type string, payload string, occurred_at timestamp",
}
#: The version of the readers: with another one, an artifact's interpretation is another one.
READERS = "1"


def ledger(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, SCHEMAS, incremental.SPLIT)


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key that was written last."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "step").alias("r")).select(key, "r.*")


def with_events(snap: Snapshot, appended: dict[str, DataFrame], bodies: list[DataFrame], marks: dict[str, int] | None = None) -> Snapshot:
    """A commit with events behind those that are stored: numbers go on without a gap."""
    after = snap.marks.get("seq", 0)
    events = None
    for b in bodies:
        events = b if events is None else events.unionByName(b)
    if events is None:
        return snap.commit(appended, marks=marks)
    events = cut(store.numbered(events, after))
    return snap.commit(appended | {"events": events}, marks={**(marks or {}), "seq": after + events.count()})


def tidy(spark: SparkSession, root: str, keep: int = 10, grace_seconds: float = 7 * 86400) -> dict[str, list[str]]:
    """One commit in which stages and the block index hold their last rows only, then the folders go that none of the newest `keep`
    versions reads. Raises Conflict where a stage commits meanwhile; nothing has changed then."""
    snap = ledger(spark, root).snapshot()
    if snap.version:
        rows = incremental.compacted(snap)
        if "stages" in snap.tables:
            rows["stages"] = latest(snap.read("stages"), "id")
        snap.commit({}, rows)
    return snap.store.vacuum(keep, grace_seconds)


def feed(snap: Snapshot, after: int = 0, limit: int = 100) -> DataFrame:
    """A page of events behind a cursor, in order."""
    return snap.read("events").where(F.col("seq") > after).orderBy("seq").limit(limit)


# ---- extraction -----------------------------------------------------------------------------------------------------
def readings(evidence: DataFrame, step: int, now: datetime, extract: Extractor | None = None) -> dict[str, DataFrame]:
    """evidence (EVIDENCE, extraction_profile, attempts) as rows of the tables that an interpretation fills, and what it counted."""
    seen = Observation()
    told = interpret(evidence, extract, ("extraction_profile", "observed_at", "attempts")).observe(
        seen, F.count("*").alias("processed"), F.count_if(F.col("status") == "READ").alias("claimed"), F.count_if(F.col("status") == "UNRECOGNISED").alias("unrecognised"),
        F.count_if(F.col("status") == "FAILED").alias("failed"), F.coalesce(F.sum("unread_rows"), F.lit(0)).alias("skipped"),
    )
    read = cut(told)
    at = F.lit(step).cast("long").alias("step")
    failed = F.col("status") == "FAILED"
    due = F.lit(now).cast("timestamp") + F.make_interval(mins=backoff_minutes(F.col("attempts")).cast("int"))
    stages = read.select("id", F.when(failed, "RECEIVED").otherwise("EXTRACTED").alias("processing_stage"), "status", "problem", F.col("attempts").cast("int").alias("attempts"), F.when(failed, due).alias("next_try"), at)
    made = F.sha2(F.concat_ws(":", F.lit("interpretation"), "evidence_id", "extraction_profile", F.lit(READERS)), 256)
    good = read.where("status = 'READ'").withColumnRenamed("id", "evidence_id").withColumn("interpretation_id", made)
    one = good.select("evidence_id", "interpretation_id", "observed_at", F.posexplode("claims").alias("n", "c")).withColumn("claim_id", F.sha2(F.concat_ws(":", "interpretation_id", F.col("n").cast("string")), 256))
    money = F.col("field_name") == "amount_minor"
    fields = one.select("claim_id", F.explode("c").alias("field_name", "v")).select(
        "claim_id", "field_name", F.when(money, F.col("v.value").cast("long")).alias("value_int"), F.when(~money, F.col("v.value")).alias("value_text"), F.col("v.confidence").alias("confidence"))
    return {
        "stages": stages, "interpretations": good.select(F.col("interpretation_id").alias("id"), "evidence_id", "extraction_profile", "unread_rows", at),
        "claims": one.select("claim_id", "interpretation_id", "evidence_id"), "fields": fields, "slots": good.select("evidence_id", "interpretation_id", at), "counters": seen,
        "extracted": one.select("claim_id", "interpretation_id", "evidence_id", "observed_at"),
    }


def claim_events(extracted: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """superseded: (evidence_id, old) interpretations that these claims' own take the place of."""
    old = extracted.withColumn("old", F.lit(None).cast("string")) if superseded is None else extracted.join(superseded.select("evidence_id", "old"), "evidence_id", "left")
    names = {"claim_id": "claimId", "ids": "evidenceIds", "interpretation_id": "interpretationId", "old": "supersedesInterpretationId"}
    return store.event_body(old.withColumn("ids", F.array("evidence_id")), "ClaimActivated", [F.col(c).alias(n) for c, n in names.items()], "observed_at")


def receive(snap: Snapshot, arrived: DataFrame, profile: str, now: datetime, extract: Extractor | None = None, marks: dict[str, int] | None = None) -> tuple[Snapshot, Observation]:
    """Stores and reads the artifacts of `arrived` (EVIDENCE) that are not stored, in one commit; what the pass counted, as it went."""
    new = cut(store.insert_if_absent(arrived, snap.read("evidence"), EVIDENCE_KEY, "id").withColumn("extraction_profile", F.lit(profile)))
    made = readings(new.withColumn("attempts", F.lit(1)), snap.version + 1, now, extract)
    seen, extracted = made.pop("counters"), made.pop("extracted")
    ingested = store.event_body(new, "EvidenceIngested", [F.col("id").alias("evidenceId"), F.col("source_reference").alias("sourceReference"), F.col("observed_at").alias("observedAt")], "observed_at")
    return with_events(snap, made | {"evidence": new}, [ingested, claim_events(extracted)], marks), seen


def extract_available(spark: SparkSession, arrived: DataFrame, root: str, profile: str, now: datetime | None = None, extract: Extractor | None = None, name: str = "inbox") -> StreamingQuery:
    """Reads what a stream of evidence has and stops when there is no more. name: of the source, which has a checkpoint of its own."""

    def batch(df: DataFrame, number: int) -> None:
        snap = ledger(df.sparkSession, root).snapshot()
        if snap.marks.get(f"batch:{name}", -1) < number:
            receive(snap, df, profile, now or datetime.now(), extract, {f"batch:{name}": number})

    return arrived.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/checkpoints/{name}").trigger(availableNow=True).start()


def inbox(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of evidence that arrives as Parquet files."""
    return spark.readStream.schema(EVIDENCE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def retry_due(spark: SparkSession, root: str, now: datetime, extract: Extractor | None = None) -> int:
    """Reads again the failed artifacts whose time has come, from the stored evidence; the number read. There is no last try: the
    time between tries grows to a day."""
    snap = ledger(spark, root).snapshot()
    due = cut(latest(snap.read("stages"), "id").where((F.col("status") == "FAILED") & (F.col("next_try") <= F.lit(now))).select("id", (F.col("attempts") + 1).alias("attempts")))
    n = due.count()
    if n:
        made = readings(cut(snap.read("evidence").join(due, "id")), snap.version + 1, now, extract)
        made.pop("counters")
        with_events(snap, {k: v for k, v in made.items() if k != "extracted"}, [claim_events(made["extracted"])])
    return n


def reextract(spark: SparkSession, root: str, evidence: DataFrame, profile: str, now: datetime, extract: Extractor | None = None) -> int:
    """Reads stored artifacts (id) again under a profile; the number of interpretations that changed. Where the new reading has
    claims and is another interpretation, it takes the artifact's slot, the transactions of the old one are taken back, and
    what was decided in connection with them is open again; where it fails or finds nothing, the old one stays."""
    snap = ledger(spark, root).snapshot()
    again = cut(snap.read("evidence").join(evidence.select("id").distinct(), "id", "left_semi").withColumn("extraction_profile", F.lit(profile)).withColumn("attempts", F.lit(1)))
    made = readings(again, snap.version + 1, now, extract)
    made.pop("counters")
    held = latest(snap.read("slots"), "evidence_id").select("evidence_id", F.col("interpretation_id").alias("old"))
    changed = cut(made["slots"].join(held, "evidence_id", "left").where("not old <=> interpretation_id"))
    n = changed.count()
    if not n:
        return 0
    ids = changed.select("interpretation_id")
    old = snap.read("claims").join(changed.where("old is not null").select(F.col("old").alias("interpretation_id")), "interpretation_id", "left_semi")
    gone = snap.read("transactions").join(old.select("claim_id"), "claim_id", "left_semi").select("id")
    extracted = made["extracted"].join(ids, "interpretation_id", "left_semi")
    known = snap.read("interpretations").select(F.col("id"))  # a reading that comes back has its claims already
    fresh = cut(ids.join(known, F.col("interpretation_id") == F.col("id"), "left_anti"))
    claims = made["claims"].join(fresh, "interpretation_id", "left_semi")
    appended = {
        "slots": changed.select("evidence_id", "interpretation_id", "step"), "stages": made["stages"].join(changed.select(F.col("evidence_id").alias("id")), "id", "left_semi"),
        "interpretations": made["interpretations"].join(fresh.withColumnRenamed("interpretation_id", "id"), "id", "left_semi"), "claims": claims, "fields": made["fields"].join(claims.select("claim_id"), "claim_id", "left_semi"),
    }
    with_events(snap, appended | incremental.retracted(snap, gone), [claim_events(extracted, changed)])
    return n


# ---- transactions ---------------------------------------------------------------------------------------------------
def current_claims(snap: Snapshot) -> DataFrame:
    """(claim_id, evidence_id) of the interpretations that hold their artifact's slot."""
    return snap.read("claims").join(latest(snap.read("slots"), "evidence_id").select("interpretation_id"), "interpretation_id", "left_semi").select("claim_id", "evidence_id")


def build(spark: SparkSession, root: str) -> int:
    """Transactions of current claims that have none yet, an artifact's claims all or none; the number added. Without a stated
    time, the artifact's own counts. Artifacts that were read have then passed the last stage, those without a claim too."""
    snap = ledger(spark, root).snapshot()
    known = snap.read("transactions").select("claim_id")
    fresh = cut(store.whole_artifacts(current_claims(snap), known))
    waiting = latest(snap.read("stages"), "id").where("processing_stage = 'EXTRACTED'")
    step = F.lit(snap.version + 1).cast("long").alias("step")
    fields = fresh.join(snap.read("fields"), "claim_id")
    rows = store.pivot_claims(fields).join(snap.read("evidence").select(F.col("id").alias("evidence_id"), "source_id", "observed_at"), "evidence_id").select(
        F.col("claim_id").alias("id"), "source_id", "amount_minor", "currency", "merchant", "counterparty", "direction", "financial_status",
        F.lit("UNRECONCILED").alias("reconciliation_state"), F.lit("ACTIVE").alias("transaction_state"), F.lit(None).cast("string").alias("superseded_by"),
        F.coalesce(F.try_to_timestamp("occurred_at"), "observed_at").alias("occurred_at"), "tracking_key", "claim_id", "evidence_id", step, incremental.part_of("claim_id").alias("part"),
    )
    rows = cut(rows)
    passed = cut(waiting.select("id", F.lit("RECONCILED").alias("processing_stage"), "status", "problem", "attempts", "next_try", step))
    n = rows.count()
    if n or passed.limit(1).count():
        created = store.event_body(rows, "TransactionCreated", [F.col("id").alias("transactionId"), F.array("evidence_id").alias("evidenceIds")], "occurred_at")
        with_events(snap, {"transactions": rows, "stages": passed}, [created])
    return n


def transactions(spark: SparkSession, root: str) -> DataFrame:
    """The transactions as decisions and retractions leave them."""
    return incremental.current(ledger(spark, root).snapshot())


def candidates(spark: SparkSession, root: str) -> DataFrame:
    return incremental.standing(ledger(spark, root).snapshot().read("candidates"))


def reconcile(spark: SparkSession, root: str, now: datetime | None = None) -> int:
    """Decides the transactions that came, or were opened again, since the last pass; the number of new candidates."""
    snap = ledger(spark, root).snapshot()
    done = snap.marks.get("matched", 0)
    again = cut(snap.read("again").where(F.col("step") >= (done + 1) * incremental.STEPS).select("id").distinct())
    new = snap.read("transactions").where(F.col("step") > done).drop("step", "part")
    old = snap.read("transactions").where(F.col("step") <= done).join(again, "id", "left_semi").drop("step", "part")
    new = cut(new.join(_dead(snap), "id", "left_anti").unionByName(old))
    if not new.limit(1).count():
        return 0
    work = incremental.reconciled(snap, new)
    found = work.candidates
    bodies = []
    if found is not None:
        matched = found.where("status = 'MATCH'").withColumn("at", F.lit(now or datetime.now()).cast("timestamp"))
        bodies = [store.event_body(matched, "TransactionReconciled", [F.col("left_ref").alias("survivingTransactionId"), F.col("right_ref").alias("supersededTransactionId"), F.coalesce(F.nullif(F.col("basis"), F.lit("")), F.lit("tracking_key")).alias("basis")], "at")]
    with_events(snap, incremental.additions(work, again), bodies, {"matched": snap.version})
    return found.count() if found is not None else 0


def _dead(snap: Snapshot) -> DataFrame:
    """Transactions that were taken back before a pass had seen them."""
    return latest(snap.read("states"), "id").where("transaction_state <> 'ACTIVE'").select("id")


def run_stages(spark: SparkSession, arrived: DataFrame, root: str, profile: str, now: datetime | None = None, stages: dict[str, Callable] | None = None, extract: Extractor | None = None) -> dict[str, str]:
    """Extraction, retries, building and matching in order; the problems by stage. One stage's failure does not stop the others."""
    now = now or datetime.now()
    stages = stages or {
        "extract": lambda: extract_available(spark, arrived, root, profile, now, extract).awaitTermination(),
        "retry": lambda: retry_due(spark, root, now, extract),
        "build": lambda: build(spark, root),
        "match": lambda: reconcile(spark, root, now),
    }
    problems = {}
    for name, stage in stages.items():
        try:
            stage()
        except Exception as e:  # noqa: BLE001  told in the result; the next run takes the stage up again
            problems[name] = f"{type(e).__name__}: {e}"[:500]
    return problems
