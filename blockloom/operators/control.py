"""Running copies and recorded sessions: which progress is told, the order of phases, whether a session succeeded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The phases of a copy in order, the last three being ends.
PHASES = ["preparing", "started", "transferring", "flushing", "completed", "cancelled", "failed"]
ENDS = ["completed", "cancelled", "failed"]
#: Progress is told at the first bytes, after so many more, or after so long if there are more.
STEP_BYTES, STEP_MS = 64 << 20, 100


def transferring_events(progress: DataFrame, step: int = STEP_BYTES, every: int = STEP_MS) -> DataFrame:
    """(copy_id, seq, bytes, elapsed_ms): the rows of (copy_id, seq, bytes, elapsed_ms) that are told.

    A row counts if its bytes are not those of the row before.  It is told if they are above those told last, and these
    were none, or ``step`` less, or told ``every`` milliseconds before.  What is told depends on what was told, so each
    copy's rows are folded in order of seq as they stream by; nothing of a copy is held but the last two rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, checked, told, at = None, 0, 0, 0
        for batch in batches:
            keep = []
            for copy, n, ms in zip(*(batch.column(c).to_pylist() for c in ("copy_id", "bytes", "elapsed_ms")), strict=True):
                if copy != now:
                    now, checked, told, at = copy, 0, 0, 0
                emit = n != checked and n > told and (told == 0 or n - told >= step or ms - at >= every)
                checked = n
                if emit:
                    told, at = n, ms
                keep.append(emit)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = progress.select(F.col("copy_id").cast("long"), F.col("seq").cast("long"), F.col("bytes").cast("long"), F.col("elapsed_ms").cast("long"))
    return rows.repartition("copy_id").sortWithinPartitions("copy_id", "seq").mapInArrow(run, rows.schema)


def phase_violations(events: DataFrame) -> DataFrame:
    """(copy_id, seq, check) of copies' events (copy_id, seq, phase, bytes): a phase behind the one before, an event
    after the end, counted bytes that fall, and a copy that does not begin with its preparation."""
    w = Window.partitionBy("copy_id").orderBy("seq")
    place = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    rows = events.withColumn("_place", place).withColumn("_before", F.lag("_place").over(w)).withColumn("_phase", F.lag("phase").over(w)).withColumn("_bytes", F.lag("bytes").over(w))
    named = F.array_compact(
        F.array(
            F.when(F.col("_place") == 0, "unknown"),
            F.when(F.col("_before").isNull() & (F.col("phase") != PHASES[0]), "begin"),
            F.when(F.col("_phase").isin(*ENDS), "after the end"),
            F.when(~F.coalesce(F.col("_phase").isin(*ENDS), F.lit(False)) & (F.col("_place") > 0) & (F.col("_place") < F.col("_before")), "order"),
            F.when(F.col("bytes") < F.col("_bytes"), "bytes"),
        )
    )
    return rows.select("copy_id", "seq", F.explode(named).alias("check"))


def export_success(reports: DataFrame) -> DataFrame:
    """(session, success) of exports: no error of its own or of a cleanup, the lease completed, logged out, the manifest
    verified, the artifact published."""
    clean = F.coalesce(*[F.col(c) for c in ("primary_error", "artifact_cleanup_error", "lease_cleanup_error", "pagination_cleanup_error")]).isNull()
    ok = clean & (F.col("lease_cleanup") == "completed") & (F.col("session_cleanup") == "logged_out") & F.col("manifest_verified") & F.col("artifact_published")
    return reports.select("session", F.coalesce(ok, F.lit(False)).alias("success"))


def owned_success(reports: DataFrame) -> DataFrame:
    """(session, success) of owned transfers and probes (kind): no error, logged out, nothing pending, and the journal and
    the lease ended as the kind ends them.  A transfer also verified the manifest and read the container back, and
    received, written and durable bytes are the same."""
    transfer = F.col("kind") == "transfer"
    clean = F.coalesce(*[F.col(c) for c in ("primary_error", "journal_error", "payload_error", "pagination_cleanup_error")]).isNull()
    ends = (F.col("lease_cleanup") == F.when(transfer, "completed").otherwise("aborted")) & (F.col("state") == F.when(transfer, "completed_lease").otherwise("aborted_lease"))
    bytes_ = (F.col("received") == F.col("written")) & (F.col("written") == F.col("durable"))
    whole = ~transfer | (F.col("manifest_verified") & F.col("container_readback_verified") & bytes_)
    ok = clean & ends & (F.col("session_cleanup") == "logged_out") & ~F.col("pending") & whole
    return reports.select("session", F.coalesce(ok, F.lit(False)).alias("success"))


def locations(records: DataFrame, observed: DataFrame, parents: DataFrame) -> DataFrame:
    """(artifact, state, pending, staged, final, issue): where an output's bundle is, from what was observed.

    ``records``: artifact, state, pending, identity, operation, parent (null: none yet).  ``observed``: artifact, place
    (staged or final), identity, operation.  ``parents``: artifact, parent that the destination has now.  A place is
    absent if nothing was observed there, owned if identity and operation are the record's, else foreign; a destination
    that is not the recorded one is an issue.
    """
    seen = observed.select("artifact", "place", F.col("identity").alias("_i"), F.col("operation").alias("_o"))
    both = records.join(seen, "artifact", "left")
    owned = (F.col("_i") == F.col("identity")) & (F.col("_o") == F.col("operation"))
    label = F.when(F.coalesce(owned, F.lit(False)), "owned").otherwise("foreign")
    of = {p: F.coalesce(F.max(F.when(F.col("place") == p, label)), F.lit("absent")).alias(p) for p in ("staged", "final")}
    got = both.groupBy("artifact", "state", "pending", "parent").agg(*of.values())
    now = parents.select("artifact", F.col("parent").alias("_p"))
    issue = F.when(F.col("parent").isNotNull() & ~F.col("parent").eqNullSafe(F.col("_p")), "parent")
    return got.join(now, "artifact", "left").select("artifact", "state", "pending", "staged", "final", issue.alias("issue"))


def retained(records: DataFrame, again: DataFrame, decoded: DataFrame, containers: DataFrame) -> DataFrame:
    """(artifact, issue): whether a retained artifact may be read, or the first reason why not.

    ``records`` and ``again`` are two reads of the journal (artifact, state, pending, digest, container_bytes) before and
    after the container was hashed, ``decoded`` its grains as ``images.inflate`` tells them (artifact, issue), and
    ``containers`` the hash (artifact, sha256, n_bytes).
    """
    fields = ("state", "pending", "digest", "container_bytes")
    later = again.select("artifact", F.struct(*fields).alias("_later"))
    broken = decoded.groupBy("artifact").agg(F.count("issue").alias("_broken"))
    found = containers.select("artifact", F.col("sha256").alias("_sha256"), F.col("n_bytes").alias("_bytes"))
    rows = records.join(later, "artifact", "left").join(broken, "artifact", "left").join(found, "artifact", "left")
    issue = (
        F.when(~F.coalesce(F.col("state") == "completed_lease", F.lit(False)), "state")
        .when(F.coalesce("pending", F.lit(True)), "pending")
        .when(F.coalesce(F.col("_broken") > 0, F.lit(True)), "grain")
        .when(~F.coalesce((F.col("_sha256") == F.col("digest")) & (F.col("_bytes") == F.col("container_bytes")), F.lit(False)), "content")
        .when(~F.struct(*fields).eqNullSafe(F.col("_later")), "changed")
    )
    return rows.select("artifact", issue.alias("issue"))


def over_limits(sizes: DataFrame, limits: dict[str, int], key: str) -> DataFrame:
    """(key, limit, value) for every count of a row that passes its ceiling: an error row, never a cut."""
    over = F.array_compact(F.array(*[F.when(F.col(c) > most, F.struct(F.lit(c).alias("limit"), F.col(c).cast("long").alias("value"))) for c, most in limits.items()]))
    return sizes.select(key, F.explode(over).alias("_o")).select(key, "_o.limit", "_o.value")
