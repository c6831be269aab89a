"""Ledgers: the latest row per key wins; worklists and pending queues."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["neuron", "chain_idx"]
#: Dispositions after which a chain is not reviewed again.
TERMINAL = ("approved", "corrected", "rejected")


def latest(events: DataFrame, value: str) -> DataFrame:
    """The value of the last event per key: one aggregate that combines map-side, no sort."""
    return events.groupBy(*KEY).agg(F.max_by(value, F.struct("ts", "seq")).alias(value))


def pending(manifest: DataFrame, reviews: DataFrame, claimed: bool = True) -> DataFrame:
    """Flagged chains without a terminal disposition; those in review only if ``claimed``."""
    done = TERMINAL if claimed else (*TERMINAL, "in_review")
    closed = latest(reviews, "review").filter(F.col("review").isin(*done)).select(*KEY)
    return manifest.filter("status = 'flagged'").join(closed, KEY, "left_anti")


def chain_status(manifest: DataFrame, reviews: DataFrame) -> DataFrame:
    """The review if there is one, else the status of the manifest."""
    return manifest.join(latest(reviews, "review"), KEY, "left").select(*KEY, F.coalesce("review", "status").alias("badge"))


def should_run(status: Column, retry_failed: bool = False, force: bool = False) -> Column:
    """Whether a chain still has to run: it did not complete and, unless retried, did not fail."""
    if force:
        return F.lit(True)
    return ~status.isin("done", "flagged") if retry_failed else ~status.isin("done", "flagged", "failed")


def second_pass(status: Column, cropped: bool = False, on_flagged: bool = True, everywhere: bool = False) -> Column:
    """Whether a chain that completed its first pass, not cropped, gets a second one."""
    if cropped:
        return F.lit(False)
    if everywhere:
        return status.isin("done", "flagged")
    return (status == "flagged") if on_flagged else F.lit(False)


def seeded(existing: DataFrame, chains: DataFrame) -> DataFrame:
    """Existing rows stay; chains without a row are added as pending."""
    new = chains.select(*KEY).distinct().join(existing.select(*KEY), KEY, "left_anti")
    return existing.unionByName(new.withColumn("status", F.lit("pending")))


def without(ledger: DataFrame, scope: DataFrame) -> DataFrame:
    """The ledger less every chain in scope."""
    return ledger.join(scope.select(*KEY), KEY, "left_anti")


def phase_seconds(timings: DataFrame, phases: list[str]) -> DataFrame:
    """One row per chain with the seconds of each phase; null where a phase did not run."""
    return timings.groupBy(*KEY).pivot("phase", phases).agg(F.sum("seconds"))


def of_shards(shards: list[DataFrame]) -> DataFrame:
    """The rows of all shards that exist; columns that older ones lack are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def states(documents: DataFrame, schema) -> DataFrame:
    """Columns of saved states (``json``); frame numbers, which JSON keeps as text, are whole again."""
    s = documents.withColumn("_s", F.from_json("json", schema)).select(*(c for c in documents.columns if c != "json"), "_s.*")
    return s.withColumn("frame_to_z", F.transform_keys("frame_to_z", lambda k, _: k.cast("int")))


def of_neurons(chains: DataFrame, actions: DataFrame) -> DataFrame:
    """A disposition of a neuron (neuron, review, ts, seq) as one of each of its chains."""
    return chains.select(*KEY).distinct().join(actions.select("neuron", "review", "ts", "seq"), "neuron").select(*KEY, "review", "ts", "seq")


def saved(states: DataFrame, branches: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What saving corrected branches (neuron, chain_idx, ts, seq) changes: the states, of which a saved one takes
    its neuron's window (neuron, crop_window), and the dispositions ``corrected``, to be added to the reviews.
    A branch without a state has only the disposition."""
    own = branches.select(*KEY).distinct().join(windows.select("neuron", F.col("crop_window").alias("_w")), "neuron")
    at = states.join(own, KEY, "left").withColumn("crop_window", F.coalesce("_w", "crop_window")).select(*states.columns)
    return at, branches.select(*KEY, F.lit("corrected").alias("review"), "ts", "seq")


def of_path(path: Column) -> Column:
    """neuron, chain_idx and z of a mask's path, as a struct."""
    part = lambda k: F.regexp_extract(path, r"([^/]+)/chain_(\d+)/masks/mask_0*(\d+)\.png$", k)
    return F.struct(part(1).alias("neuron"), part(2).cast("long").alias("chain_idx"), part(3).cast("long").alias("z"))
