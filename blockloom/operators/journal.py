"""Job and output journals: legal steps, sequences, assessments, access conflicts and progress."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.ranges import preceded, running

# The legal steps of a job, the sequence numbers of its states, and what each state means on recovery.
STEPS = [
    ("prepared", "stage_intent"),
    ("stage_intent", "staged"),
    ("staged", "acquire_intent"),
    ("acquire_intent", "lease_held"),
    ("lease_held", "transfer_complete"),
    ("transfer_complete", "complete_intent"),
    ("complete_intent", "completed_lease"),
    ("lease_held", "abort_intent"),
    ("transfer_complete", "abort_intent"),
    ("abort_intent", "aborted_lease"),
    ("completed_lease", "publish_intent"),
    ("publish_intent", "published"),
    ("staged", "cleanup_intent"),
    ("completed_lease", "cleanup_intent"),
    ("aborted_lease", "cleanup_intent"),
    ("cleanup_intent", "cleaned"),
]
SEQUENCES = {
    "prepared": [0],
    "stage_intent": [1],
    "staged": [2],
    "acquire_intent": [3],
    "lease_held": [4],
    "transfer_complete": [5],
    "complete_intent": [6],
    "completed_lease": [7],
    "abort_intent": [5, 6],
    "aborted_lease": [6, 7],
    "publish_intent": [8],
    "published": [9],
    "cleanup_intent": [3, 7, 8],
    "cleaned": [4, 8, 9],
}
ACTIONS = {
    "prepared": "no_resources_recorded",
    "stage_intent": "local_preparation_unknown",
    "staged": "check_owned_local_resources",
    "completed_lease": "check_owned_local_resources",
    "aborted_lease": "check_owned_local_resources",
    "acquire_intent": "remote_outcome_unknown",
    "lease_held": "remote_outcome_unknown",
    "transfer_complete": "remote_outcome_unknown",
    "complete_intent": "remote_outcome_unknown",
    "abort_intent": "remote_outcome_unknown",
    "publish_intent": "publication_unknown",
    "published": "validate_published_artifact",
    "cleanup_intent": "cleanup_may_be_partial",
    "cleaned": "terminal",
}
LEASED = ["lease_held", "transfer_complete", "complete_intent", "completed_lease", "abort_intent", "aborted_lease", "publish_intent", "published"]
UNLEASED = ["prepared", "stage_intent", "staged", "acquire_intent"]
OUTPUT_SEQUENCES = {
    "prepared": 0,
    "stage_intent": 1,
    "staged": 2,
    "convert_intent": 3,
    "converted": 4,
    "verify_intent": 5,
    "verified": 6,
    "publish_intent": 7,
    "published": 8,
}
# The output states from which a cleanup may start, and the methods that are never refused.
OUTPUT_CLEANABLE = ["staged", "convert_intent", "converted", "verify_intent", "verified", "published"]
ALWAYS_SENT = ["Logout", "HttpNfcLeaseAbort"]
MOST_REQUESTS = 4096
#: Sequence or request numbers of a stretch.
STRETCH = 1 << 16


def output_steps() -> list[tuple[str, str]]:
    """The legal steps of an output: each state to the next, a cleanable one to its cleanup, a cleanup to its end."""
    states = list(OUTPUT_SEQUENCES)
    return [*zip(states, states[1:], strict=False), *((s, "cleanup_intent") for s in OUTPUT_CLEANABLE), ("cleanup_intent", "cleaned")]


def _map(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def illegal_steps(journal: DataFrame, key: str = "artifact", order: str = "sequence", legal: list[tuple[str, str]] = STEPS) -> DataFrame:
    """Entries whose state may not follow the one before it.  Long journals go in stretches of ``STRETCH`` numbers, so one is not
    one task."""
    moved = preceded(journal, key, [order], ["state"], STRETCH).withColumn("before", F.col("_before.state")).drop("_before").where("before is not null")
    steps = journal.sparkSession.createDataFrame(legal, "before string, state string")
    return moved.join(F.broadcast(steps), ["before", "state"], "left_anti")


def binding_issues(records: DataFrame, expected: DataFrame, key: str, bound: list[str]) -> DataFrame:
    """(key, issue) of output records read back: the first of checksum (not intact), unasked (nothing expected under
    this key), the bound field that differs, and operation (null or all zero); null for a record that may be used."""
    told = expected.select(key, F.lit(True).alias("_asked"), *[F.col(c).alias(f"_{c}") for c in bound])
    both = records.join(told, key, "left")
    issue = F.when(~F.coalesce("intact", F.lit(False)), "checksum").when(F.col("_asked").isNull(), "unasked")
    for c in bound:
        issue = issue.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c)
    return both.select(key, issue.when(F.coalesce("operation", F.lit("")).rlike("^0*$"), "operation").alias("issue"))


def refused_requests(requests: DataFrame, key: str, order: str, method: str = "method", most: int = MOST_REQUESTS) -> DataFrame:
    """Requests of a connection that are not sent since ``most`` were recorded before; those that end a session are.

    Nothing is refused up to ``most``, so a request's number among all is its number among the recorded ones.
    """
    counted = running(requests, key, order, F.lit(1), "_sent", -1, STRETCH)
    return counted.where((F.col("_sent") >= most) & ~F.col(method).isin(*ALWAYS_SENT)).drop("_sent")


def record_violations(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check) for job records that contradict themselves: unknown state, sequence, stage, lease."""
    state, sequence = F.col("state"), F.col("sequence")
    allowed = _map(SEQUENCES)[state]
    cleanup = state.isin("cleanup_intent", "cleaned")
    checks = [
        ("state", allowed.isNull()),
        ("sequence", ~F.array_contains(allowed, sequence.cast("int"))),
        ("stage", (~state.isin("prepared", "stage_intent")) != F.col("has_stage")),
        ("lease", (state.isin(*LEASED) & ~F.col("has_lease")) | (state.isin(*UNLEASED) & F.col("has_lease")) | (cleanup & (F.col("has_lease") != (sequence >= 7)))),
    ]
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks]))
    return records.select(*keys, F.explode(named).alias("check"))


def assess(journal: DataFrame, key: str = "artifact", order: str = "sequence") -> DataFrame:
    """Each job's last state and what it means for recovery."""
    last = journal.groupBy(key).agg(F.max_by("state", order).alias("state"), F.max(order).alias(order))
    return last.withColumn("action", F.coalesce(_map(ACTIONS)[F.col("state")], F.lit("unknown")))


def broken_sequences(journal: DataFrame, key: str = "artifact", order: str = "ts", most: int = 32) -> DataFrame:
    """Entries whose sequence is not one more than the entry before, or beyond ``most``."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.row_number().over(w) - 1
    return journal.withColumn("expected", n.cast("long")).where((F.col("sequence") != F.col("expected")) | (F.col("sequence") > most))


def output_violations(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check) for output records: a plain state has its sequence; a cleanup has its origin's plus 1, cleaned
    plus 2; a stage is there from 2 on, a digest from 6 on."""
    at = _map(OUTPUT_SEQUENCES)[F.col("state")]
    from_ = _map(OUTPUT_SEQUENCES)[F.col("origin")]
    expected = F.when(F.col("state") == "cleanup_intent", from_ + 1).when(F.col("state") == "cleaned", from_ + 2).otherwise(at)
    reached = F.when(F.col("state").isin("cleanup_intent", "cleaned"), from_).otherwise(at)
    checks = [
        ("sequence", F.col("sequence") != expected),
        ("state", expected.isNull()),
        ("stage", F.col("has_stage") != (reached >= 2)),
        ("digest", F.col("has_digest") != (reached >= 6)),
    ]
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks]))
    return records.select(*keys, F.explode(named).alias("check"))


def reconcile(locations: DataFrame) -> DataFrame:
    """(artifact, outcome) of a publication that was intended: from where the bundle is (staged, final: absent, owned
    or foreign), the state and whether a transaction is pending."""
    outcome = (
        F.when((F.col("state") != "publish_intent") | F.col("pending"), "not eligible")
        .when((F.col("staged") == "owned") & (F.col("final") == "absent"), "staged")
        .when((F.col("staged") == "absent") & (F.col("final") == "owned"), "already renamed")
        .otherwise("identity")
    )
    return locations.select("artifact", outcome.alias("outcome"))


def attest(locations: DataFrame) -> DataFrame:
    """Whether a published bundle may be attested: published, nothing pending, gone from the stage, owned in place."""
    ok = (F.col("state") == "published") & ~F.col("pending") & (F.col("staged") == "absent") & (F.col("final") == "owned")
    return locations.select("artifact", ok.alias("eligible"))


def successes(reports: DataFrame, key: str, phase: str, parts: str) -> DataFrame:
    """A pipeline succeeds if it completed and each of its parts did."""
    return reports.groupBy(key).agg((F.bool_and(F.col(parts)) & F.bool_or(F.col(phase) == "completed")).alias("success"))


def late_heartbeats(events: DataFrame, key: str, ts: str, limit_seconds: float) -> DataFrame:
    """Gaps between a key's events that are longer than the limit."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    return events.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > limit_seconds)


def access_conflicts(requests: DataFrame, page: int = 4096, width: int = 1 << 16, key: str = "file_id") -> DataFrame:
    """Pairs (req_a < req_b) of one file's requests that may not run together.

    A request: req_id, start, length, writes, direct, flush.  Overlap with a writer conflicts; a direct and a buffered
    request conflict on a shared page; a flush conflicts with all of its file.  Zero-length requests other than
    flushes touch nothing.  Byte and page conflicts are found by one bucketed join over whole pages.
    """
    some = requests.where("length > 0 and not flush")
    whole = some.withColumn("lo", F.floor(F.col("start") / page) * page).withColumn("hi", (F.floor((F.col("start") + F.col("length") - 1) / page) + 1) * page)
    dealt = whole.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    a, b = dealt.alias("a"), dealt.alias("b")
    both = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._b") == F.col("b._b")) & (F.col("a.req_id") < F.col("b.req_id")))
    both = both.where("a.lo < b.hi and b.lo < a.hi").where(F.col("a._b") == F.floor(F.greatest("a.lo", "b.lo") / width))
    overlap = F.expr("a.start < b.start + b.length and b.start < a.start + a.length")
    conflict = (overlap & (F.col("a.writes") | F.col("b.writes"))) | (F.col("a.direct") != F.col("b.direct"))
    pairs = both.where(conflict).select(F.col(f"a.{key}").alias(key), F.col("a.req_id").alias("req_a"), F.col("b.req_id").alias("req_b"))
    live = requests.where("length > 0 or flush")
    f = live.where("flush").select(key, F.col("req_id").alias("_f"))
    flushed = live.join(f, key).where("req_id <> _f").select(key, F.least("req_id", "_f").alias("req_a"), F.greatest("req_id", "_f").alias("req_b")).distinct()
    return pairs.unionByName(flushed)


def peak_in_flight(requests: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """The most requests of a key that run at one time; one that ends as another begins has ended."""
    events = requests.select(key, F.col(begin).alias("_at"), F.lit(1).alias("_d")).unionByName(requests.select(key, F.col(end).alias("_at"), F.lit(-1).alias("_d")))
    w = Window.partitionBy(key).orderBy("_at", "_d").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_n", F.sum("_d").over(w)).groupBy(key).agg(F.max("_n").alias("peak"))


def progress(work: DataFrame, step: int, key: str = "disk_id") -> DataFrame:
    """Snapshots (disk_id, done) of a copy: when at least ``step`` bytes were done since the last one, and at the end.

    The emission depends on the one before it, so a disk's rows are folded in order as they stream by; nothing of a disk
    is held but two numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, done, last, told_once = None, None, 0, 0, True
        for batch in batches:
            kind = batch.schema.field(0).type
            disks, told = [], []
            for n, (disk, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if disk != now or (n == 0 and now is None):
                    if not told_once or done != last:
                        disks.append(now)
                        told.append(done)
                    now, done, last, told_once = disk, 0, 0, False
                done += size or 0
                if done - last >= step:
                    disks.append(disk)
                    told.append(done)
                    last, told_once = done, True
            yield pa.RecordBatch.from_arrays([pa.array(disks, kind), pa.array(told, pa.int64())], names=[key, "done"])
        if not told_once or done != last:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([done], pa.int64())], names=[key, "done"])

    rows = work.select(key, F.col("length").cast("long").alias("length"), "start").repartition(key).sortWithinPartitions(key, "start").select(key, "length")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, done long")


def completion(work: DataFrame, key: str = "disk_id") -> DataFrame:
    """Each item's completed fraction of its disk; 1 for an empty disk."""
    totals = work.groupBy(F.col(key).alias("_k")).agg(F.sum("length").alias("_total"))
    work = running(work, key, "start", F.col("length"), "_done").join(totals, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    done, total = F.col("_done"), F.col("_total")
    fraction = F.when(total == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total)))
    return work.withColumn("fraction", fraction).drop("_done", "_total")


# Exit codes by status, and which of several errors counts: the last one that is there.
EXIT_CODES = {"assessed": 0, "completed": 0, "failed": 1, "output": 1, "invalid_request": 2, "uncertain": 3, "cancelled": 130}
PRECEDENCE = ["assessed", "completed", "invalid_request", "output", "cancelled", "failed", "uncertain"]


def exit_codes(outcomes: DataFrame, key: str, status: str) -> DataFrame:
    """A run's status is its weightiest one; with it the exit code."""
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col(status))
    worst = outcomes.groupBy(key).agg(F.max_by(status, rank).alias("status"))
    return worst.withColumn("code", _map(EXIT_CODES)[F.col("status")])


def first_failures(events: DataFrame, key: str, order: str, error: str) -> DataFrame:
    """Each key's earliest error."""
    return events.where(F.col(error).isNotNull()).groupBy(key).agg(F.min_by(error, order).alias("error"), F.min(order).alias("at"))


def unconserved(transfers: DataFrame) -> DataFrame:
    """Transfers whose received, written and durable bytes are not all the same."""
    return transfers.where("received <> written or written <> durable or received is null or written is null or durable is null")


# Task states and the operations that are told apart.
TASK_STATES = ["queued", "running", "success", "error"]
TASK_NAMES = {
    "VirtualMachine.exportVm": "export_vm",
    "vim.VirtualMachine.exportVm": "export_vm",
    "VirtualMachine.powerOn": "power_on",
    "vim.VirtualMachine.powerOn": "power_on",
    "VirtualMachine.powerOff": "power_off",
    "vim.VirtualMachine.powerOff": "power_off",
    "VirtualMachine.reconfigure": "reconfigure",
    "vim.VirtualMachine.reconfigure": "reconfigure",
}
MOST_TASKS = 32


def recent_tasks(tasks: DataFrame) -> DataFrame:
    """(owner, reference, state, operation, issue) of task lists (owner, entity, reference, state, name): a list that is
    too long, repeats a reference, names another entity (null names none) or an unknown state is told row by row; other
    names are ``other``."""
    from pyspark.sql import Window

    own = Window.partitionBy("owner")
    many, again = F.count(F.lit(1)).over(own) > MOST_TASKS, F.count(F.lit(1)).over(Window.partitionBy("owner", "reference")) > 1
    issue = F.when(many, "too many").when(again, "duplicate").when(F.col("entity") != F.col("owner"), "entity").when(~F.col("state").isin(*TASK_STATES), "state")
    return tasks.select("owner", "reference", "state", F.coalesce(_map(TASK_NAMES)[F.col("name")], F.lit("other")).alias("operation"), issue.alias("issue"))


def acknowledgments(intents: DataFrame, candidates: DataFrame, key: str = "output") -> DataFrame:
    """(output, issue) of publications whose acknowledgment was interrupted: the pending record must be the intent's in
    everything but state (published) and sequence (8), and be another file.

    Both tables have the key, state, sequence, pending, inode and fields that must agree (record, any type).
    """
    c = candidates.select(key, F.col("state").alias("_state"), F.col("sequence").alias("_sequence"), F.col("inode").alias("_inode"), F.col("record").alias("_record"))
    both = intents.join(c, key, "left")
    issue = (
        F.when((F.col("state") != "publish_intent") | ~F.col("pending") | F.col("_state").isNull(), "transition")
        .when((F.col("_state") != "published") | (F.col("_sequence") != 8) | ~F.col("_record").eqNullSafe(F.col("record")), "record")
        .when(F.col("_inode") == F.col("inode"), "same file")
    )
    return both.select(key, issue.alias("issue"))


# The states from which local resources may be cleaned up.
CLEANABLE_JOBS = ["staged", "completed_lease", "aborted_lease", "cleanup_intent"]


def cleanup_issues(jobs: DataFrame, key: str = "artifact") -> DataFrame:
    """(artifact, issue): why a job's local resources may not be removed, or null.  A job names the operation that asks
    (asked) and its own (operation), its state and whether a transaction is pending; a cleaned job may be asked again."""
    issue = (
        F.when(F.col("asked") != F.col("operation"), "identity")
        .when(F.col("pending"), "uncertain")
        .when((F.col("state") != "cleaned") & ~F.col("state").isin(*CLEANABLE_JOBS), "transition")
    )
    return jobs.select(key, issue.alias("issue"))


# Bounds of a transfer's options.
MOST_ENCODED, LEAST_ENCODED, MOST_SECONDS = 1 << 40, 512, 21_600


def option_violations(options: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check) for transfer options outside their bounds."""
    checks = [
        ("capacity", F.col("capacity") <= 0),
        ("encoded bytes", (F.col("max_encoded") < LEAST_ENCODED) | (F.col("max_encoded") > MOST_ENCODED)),
        ("timeout", (F.col("timeout") <= 0) | (F.col("timeout") > MOST_SECONDS)),
        ("output", ~F.col("probe") & (F.coalesce("output", F.lit("")) == "")),
        ("inspect", F.col("inspect") & (~F.col("probe") | F.col("shutdown"))),
    ]
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for n, c in checks]))
    return options.select(*keys, F.explode(named).alias("check"))
