"""Forward-only migrations of a set of tables, in order, each a transform of DataFrames; ids that they make are keyed hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Snapshot, Store

Tables = dict[str, DataFrame]
DEFAULT_PROFILE = "EMAIL_V1"


def interpretations_from_claims(t: Tables) -> Tables:
    """Every evidence with claims gets one interpretation that holds them and is the active one."""
    made = F.sha2(F.concat(F.lit("interpretation:"), F.col("evidence_id").cast("string")), 256).alias("interpretation_id")
    own = t["claim_evidence"].select("evidence_id", "claim_id", made)
    heads = t["claim_evidence"].select("evidence_id").distinct().select("evidence_id", made)  # numbers are shuffled, not their hashes
    return t | {"interpretations": heads.withColumnRenamed("interpretation_id", "id"), "interpretation_claims": own.select("interpretation_id", "claim_id"), "active_interpretation": heads}


def profiles(t: Tables) -> Tables:
    """A profile for what was read before there were several."""
    return t | {"interpretations": t["interpretations"].withColumn("extraction_profile", F.lit(DEFAULT_PROFILE))}


def unread_rows(t: Tables) -> Tables:
    return t | {"interpretations": t["interpretations"].withColumn("unread_rows", F.lit(0))}


STEPS: tuple[Callable[[Tables], Tables], ...] = (interpretations_from_claims, profiles, unread_rows)


def migrate(tables: Tables, version: int) -> tuple[Tables, int]:
    """The tables at the newest version; tables newer than this code are refused."""
    if not 0 <= version <= len(STEPS):
        raise ValueError(f"version {version} is not known; the newest is {len(STEPS)}")
    for step in STEPS[version:]:
        tables = step(tables)
    return tables, len(STEPS)


#: The tables of each version of the schema, version 0 first.
_OWN = {"claim_evidence": "evidence_id bigint, claim_id string"}
_MADE = {"interpretation_claims": "interpretation_id string, claim_id string", "active_interpretation": "evidence_id bigint, interpretation_id string"}
VERSIONS = (
    _OWN,
    _OWN | _MADE | {"interpretations": "id string, evidence_id bigint"},
    _OWN | _MADE | {"interpretations": "id string, evidence_id bigint, extraction_profile string"},
    _OWN | _MADE | {"interpretations": "id string, evidence_id bigint, extraction_profile string, unread_rows int"},
)


def upgrade(spark: SparkSession, root: str, steps: int | None = None) -> Snapshot:
    """Brings stored tables to the newest version, or `steps` further. A step is one commit, which carries the version in its marks:
    one that dies leaves the version before, and the next run goes on from there."""
    snap = Store(spark, root, VERSIONS[0]).snapshot()
    version = snap.marks.get("schema", 0)
    if version > len(STEPS):
        raise ValueError(f"version {version} is not known; the newest is {len(STEPS)}")
    for at in range(version, len(STEPS) if steps is None else min(len(STEPS), version + steps)):
        old, new = VERSIONS[at], VERSIONS[at + 1]
        snap = Store(spark, root, old).snapshot()
        tables = {name: snap.read(name) for name in old}
        made = STEPS[at](tables)
        changed = {name: df for name, df in made.items() if df is not tables.get(name)}
        snap = Snapshot(Store(spark, root, new), snap.version, snap.tables, snap.marks).commit({}, changed, {"schema": at + 1})
    return Snapshot(Store(spark, root, VERSIONS[snap.marks.get("schema", 0)]), snap.version, snap.tables, snap.marks)
