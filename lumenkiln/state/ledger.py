"""Idempotent requests, quota admission, circuits, job folding, leases: sets instead of row locks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXPIRY_HOURS = 24
LEASE_SECONDS = {"Geocode": 300, "Description": 900}
MAX_ATTEMPTS = 5
TRANSITIONS = {
    "Preparing": ["Queued", "Cancelled"], "Queued": ["Running", "DeferredQuota", "Cancelled"], "Running": ["Succeeded", "Failed", "DeferredQuota", "Queued", "Cancelled"],
    "DeferredQuota": ["Queued", "Preparing", "Cancelled"], "Failed": ["Queued"], "Cancelled": ["Queued"], "Succeeded": ["Queued"],
}


def folded(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple]], schema: str) -> DataFrame:
    """One output row for each row, from a state that goes along each key's rows in order.

    Rows stream through in sorted partitions, so only one state is in memory, however many rows a key has.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        key, state = None, None
        for frame in frames:
            out = []
            at = list(zip(*[[None if pd.isna(v) else v for v in frame[k]] for k in keys]))
            for here, row in zip(at, frame.itertuples(index=False)):
                if here != key:
                    key, state = here, start()
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


IDENTITY = ("method", "route", "request_sha256")


def idempotency(requests: DataFrame) -> DataFrame:
    """Each request as New, Replay, KeyReused or RequestInProgress: against the first request of its key within the expiry.

    Rows: user_id, idempotency_key, method, route, request_sha256, arrived_at, answered_at (when the response was stored, null if it never was),
    seq.  A key whose holder is older than the expiry is free again, so a key's requests fall into spans, each held by its first request.
    A request that is the holder's in method, route and hash gets the stored response if there is one by then.

    A pause of the expiry or longer always ends a span.  Between pauses, requests that all stand within the expiry of their first are one span; only
    the rest, in which spans follow each other without a pause, are gone through one by one.
    """
    own = requests.select("user_id", "idempotency_key", *IDENTITY, "arrived_at", "answered_at", "seq")
    # to the microsecond: whole seconds of both ends would make 24 hours of a little less
    key, expired = ["user_id", "idempotency_key"], lambda a, b: F.col(b) - F.col(a) >= F.expr(f"interval {EXPIRY_HOURS} hours")
    line = Window.partitionBy(*key).orderBy("arrived_at", "seq")
    pause = F.coalesce(expired("_before", "arrived_at"), F.lit(True))
    rows = own.withColumn("_before", F.lag("arrived_at").over(line)).withColumn("_run", F.sum(pause.cast("int")).over(line)).drop("_before")
    runs = rows.groupBy(*key, "_run").agg(F.min("arrived_at").alias("_from"), F.max("arrived_at").alias("_to"), F.min_by(F.struct("seq", "answered_at", *IDENTITY), F.struct("arrived_at", "seq")).alias("_holder"))
    rows = rows.join(runs, [*key, "_run"])
    short = ~expired("_from", "_to")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_holder.{c}")) for c in IDENTITY])
    said = F.when(F.col("seq") == F.col("_holder.seq"), "New").when(~same, "KeyReused").when(F.coalesce(F.col("_holder.answered_at") <= F.col("arrived_at"), F.lit(False)), "Replay").otherwise("RequestInProgress")
    one_by_one = folded(rows.filter(~short).select(*own.columns, "_run"), [*key, "_run"], ["arrived_at", "seq"], lambda: None, idempotent_step, "user_id long, idempotency_key string, seq long, outcome string")
    return rows.filter(short).select(*key, "seq", said.alias("outcome")).unionByName(one_by_one)


def idempotent_step(holder, row):
    """The holder after a request, and what is said to it: (arrived, answered, method, route, hash) and the outcome."""
    own = (row.method, row.route, row.request_sha256)
    if holder is None or (row.arrived_at - holder[0]).total_seconds() >= EXPIRY_HOURS * 3600:
        holder, said = (row.arrived_at, row.answered_at, *own), "New"
    elif holder[2:] != own:
        said = "KeyReused"
    else:
        said = "Replay" if holder[1] is not None and holder[1] == holder[1] and holder[1] <= row.arrived_at else "RequestInProgress"
    return holder, (row.user_id, row.idempotency_key, row.seq, said)


def admit(requests: DataFrame, *, limit: int, usd_limit: Decimal | None = None, reservation: Decimal | None = None, circuits: DataFrame | None = None) -> DataFrame:
    """Requests of one unit each as Admitted or DeferredQuota, in the order of seq, a month and provider of a user at a time.

    Two limits hold at once; as both costs are the same for every request, a request is admitted exactly while its rank is within the
    smaller of what either allows.  An open circuit (user_id, provider, usage_month) defers all.
    """
    allowed = limit if usd_limit is None else min(limit, int(usd_limit / reservation))
    if circuits is not None:
        requests = requests.join(circuits.select("user_id", "provider", "usage_month", F.lit(True).alias("_open")), ["user_id", "provider", "usage_month"], "left")
    else:
        requests = requests.withColumn("_open", F.lit(None).cast("boolean"))
    rank = F.row_number().over(Window.partitionBy("user_id", "provider", "usage_month").orderBy("seq"))
    ok = (F.col("_rank") <= allowed) & F.col("_open").isNull()
    deferred = F.add_months("usage_month", 1)
    return requests.withColumn("_rank", rank).select(
        "seq", "user_id", "provider", "usage_month", F.when(ok, "Admitted").otherwise("DeferredQuota").alias("decision"), F.when(~ok, deferred).alias("next_attempt"),
    )


def admit_amounts(requests: DataFrame, limit: Decimal | int) -> DataFrame:
    """Admission of unequal amounts (column amount): a later smaller one may still fit, so each key is gone through in order."""
    most = Decimal(limit)

    def step(used, row):
        fits = used + row.amount <= most
        return used + row.amount if fits else used, (row.user_id, row.provider, row.usage_month, row.seq, "Admitted" if fits else "DeferredQuota")

    columns = requests.select("user_id", "provider", "usage_month", "seq", F.col("amount").cast("decimal(20,6)").alias("amount"))
    return folded(columns, ["user_id", "provider", "usage_month"], ["seq"], Decimal, step, "user_id long, provider string, usage_month date, seq long, decision string")


def settle(events: DataFrame) -> DataFrame:
    """The ledger after Reserve, Consume and Release events (kind, amount): reserved and processed of each month."""
    amount = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("amount")).otherwise(0))
    return events.groupBy("user_id", "provider", "usage_month").agg((amount("Reserve") - amount("Consume", "Release")).alias("reserved"), amount("Consume").alias("processed"))


def circuits(events: DataFrame) -> DataFrame:
    """Open circuits: the last Failure or Retry of a key decides; only Authentication and Quota failures open it."""
    counted = events.filter("kind = 'Retry' or (kind = 'Failure' and failure_class in ('Authentication', 'Quota'))")
    last = counted.groupBy("user_id", "provider", "usage_month").agg(F.max_by("kind", "seq").alias("last"))
    return last.filter("last = 'Failure'").drop("last")


def delivered(messages: DataFrame, schema: str, succeeds: Callable[[Column], Column], *, max_receives: int = MAX_ATTEMPTS) -> DataFrame:
    """Messages (message_id, body, receive_count) after a round: Done, Retry or Dead, one by one.

    A body that is no JSON of the schema is Dead at once and fails nothing else; a message whose work fails comes again until it was received max_receives times.
    """
    bad = F.col("m._corrupt").isNotNull() | F.col("body").isNull()
    rows = messages.withColumn("m", F.from_json("body", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    state = F.when(bad, "Dead").when(F.coalesce(succeeds(F.col("m")), F.lit(False)), "Done").when(F.col("receive_count") >= max_receives, "Dead").otherwise("Retry")
    return rows.withColumn("state", state).drop("m")


#: Deferred jobs of a provider that an explicit retry takes with it.
PROMOTED = 100


def promote_deferred(jobs: DataFrame, retried: DataFrame, as_of: Column) -> DataFrame:
    """Jobs after explicit retries (user_id, provider, job_id) closed circuits.

    The first hundred other jobs of the user and provider that an open circuit deferred run again, descriptions from their preparation on; the rest of them
    are due at once.
    """
    mine = jobs.join(retried.select("user_id", "provider", F.col("job_id").alias("_retried")), ["user_id", "provider"])
    waiting = mine.filter((F.col("status") == "DeferredQuota") & (F.col("failure_code") == "ProviderCircuitOpen") & (F.col("job_id") != F.col("_retried"))).select("user_id", "provider", "job_id").distinct()
    rank = F.row_number().over(Window.partitionBy("user_id", "provider").orderBy("job_id"))
    marked = jobs.join(waiting.withColumn("_n", rank).select("job_id", "_n"), "job_id", "left")
    up, due = F.coalesce(F.col("_n") <= PROMOTED, F.lit(False)), F.col("_n").isNotNull()
    prepared = F.col("job_type") == "Description"
    return marked.withColumns({
        "status": F.when(up, F.when(prepared, "Preparing").otherwise("Queued")).otherwise(F.col("status")), "next_attempt": F.when(up & prepared, F.lit(None)).when(due, as_of).otherwise(F.col("next_attempt")),
        "attempt_count": F.when(up, F.lit(0)).otherwise(F.col("attempt_count")), "failure_code": F.when(~up, F.col("failure_code")),
    }).select(*jobs.columns)


def fold_jobs(events: DataFrame) -> DataFrame:
    """Current state of each job from its events (job_id, seq, status): transitions that are not allowed are passed over."""
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in TRANSITIONS.items() for x in pair])
    ordered = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "status"))).alias("all"))
    fold = F.aggregate("all", F.lit(None).cast("string"), lambda now, e: F.when(now.isNull() | F.coalesce(F.array_contains(F.try_element_at(allowed, now), e["status"]), F.lit(False)), e["status"]).otherwise(now))
    return ordered.select("job_id", fold.alias("status"), F.size("all").cast("long").alias("events"))


def claim(jobs: DataFrame, message_id: str, as_of: Column) -> DataFrame:
    """Jobs as a worker's claim leaves them: queued or expired ones are leased, those under the same lease stay the worker's."""
    lease = F.sha2(F.lit(message_id), 256)
    mine = (F.col("status") == "Running") & (F.col("lease_hash") == lease) & (F.col("lease_expires") > as_of)
    free = ((F.col("status") == "Queued") | ((F.col("status") == "Running") & (F.col("lease_expires") <= as_of))) & (F.col("attempt_count") < MAX_ATTEMPTS)
    seconds = F.when(F.col("job_type") == "Geocode", LEASE_SECONDS["Geocode"]).otherwise(LEASE_SECONDS["Description"])
    return jobs.withColumns({
        "claimed": F.coalesce(mine | free, F.lit(False)), "attempt_count": F.when(F.coalesce(free & ~mine, F.lit(False)), F.col("attempt_count") + 1).otherwise(F.col("attempt_count")),
        "lease_hash": F.when(F.coalesce(free, F.lit(False)), lease).otherwise(F.col("lease_hash")), "lease_expires": F.when(F.coalesce(free, F.lit(False)), as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).otherwise(F.col("lease_expires")),
        "status": F.when(F.coalesce(free, F.lit(False)), "Running").otherwise(F.col("status")),
    })


def complete(jobs: DataFrame, completions: DataFrame) -> DataFrame:
    """Completions (job_id, lease_hash, coordinate_revision, outcome) applied where lease and revision still hold; stale ones cancel."""
    done = completions.select("job_id", F.col("lease_hash").alias("_lease"), F.col("coordinate_revision").alias("_revision"), "outcome")
    rows = jobs.join(done, "job_id", "left")
    held = (F.col("status") == "Running") & F.col("lease_hash").eqNullSafe(F.col("_lease"))
    fresh = F.col("coordinate_revision").eqNullSafe(F.col("_revision"))
    return rows.withColumn("status", F.when(F.col("outcome").isNotNull() & held, F.when(fresh, F.col("outcome")).otherwise("Cancelled")).otherwise(F.col("status"))).select(*jobs.columns)


IMPORT_LEASE_SECONDS = 900
#: What a claimed import goes on with, by the phase it was left in; any other phase starts from the download.
RESUME = {"Staged": "Merge", "Merging": "Merge", "Merged": "WriteResult", "WritingResult": "WriteResult"}


def claim_imports(imports: DataFrame, owner: str, as_of: Column) -> DataFrame:
    """Imports as a worker's claim leaves them: what is queued and due, or running under a lease that ran out, is leased and goes on in its phase.

    Adds claimed and next_step (Download, Merge or WriteResult); imports that aren't claimed stay as they are.
    """
    due = (F.col("status") == "Queued") & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= as_of))
    lost = (F.col("status") == "Running") & (F.col("lease_expires").isNull() | (F.col("lease_expires") <= as_of))
    claimed = F.coalesce(due | lost, F.lit(False))
    phase = F.when(F.col("phase").isin(*RESUME), F.col("phase")).otherwise("Downloading")
    step = reduce(lambda c, x: c.when(F.col("phase") == x[0], x[1]), RESUME.items(), F.when(F.lit(False), "")).otherwise("Download")
    expires = as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(IMPORT_LEASE_SECONDS))
    keep = lambda name, value: F.when(F.col("claimed"), value).otherwise(F.col(name))
    return imports.withColumns({"claimed": claimed, "next_step": F.when(claimed, step)}).withColumns({
        "phase": keep("phase", phase), "attempt_count": keep("attempt_count", F.col("attempt_count") + 1), "lease_hash": keep("lease_hash", F.sha2(F.lit(owner), 256)),
        "lease_expires": keep("lease_expires", expires), "status": keep("status", F.lit("Running")),
    })


def failed_imports(imports: DataFrame, failures: DataFrame, as_of: Column, *, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Imports after failures (import_id, lease_hash, retryable): only the lease's holder may report; retryable ones wait longer each time, others end."""
    rows = imports.join(failures.select("import_id", F.col("lease_hash").alias("_lease"), "retryable"), "import_id", "left")
    hit = F.coalesce((F.col("status") == "Running") & (F.col("lease_hash") == F.col("_lease")), F.lit(False))
    again = hit & F.col("retryable") & (F.col("attempt_count") < max_attempts)
    wait = F.least(F.lit(3600.0), 300 * F.pow(F.lit(2.0), F.greatest(F.col("attempt_count") - 1, F.lit(0))))
    return rows.withColumns({
        "next_attempt": F.when(again, as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait)).otherwise(F.col("next_attempt")),
        "status": F.when(again, "Queued").when(hit, "Failed").otherwise(F.col("status")), "lease_hash": F.when(~hit, F.col("lease_hash")), "lease_expires": F.when(~hit, F.col("lease_expires")),
    }).select(*imports.columns)


def active_uploads(sessions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(active, expired) upload leases; of several active ones of an asset and purpose the first holds."""
    w = Window.partitionBy("asset_id", "purpose").orderBy("created_at", "session_id")
    live = sessions.filter((F.col("state") == "Active") & (F.col("expires_at") > as_of))
    return live.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"), sessions.filter((F.col("state") == "Active") & (F.col("expires_at") <= as_of))


def active_imports(imports: DataFrame, as_of: Column) -> DataFrame:
    """One active import a source: the earliest that is not terminal and whose upload has not expired."""
    expired = (F.col("status") == "AwaitingUpload") & (F.col("expires_at") <= as_of)
    w = Window.partitionBy("source_id").orderBy("created_at", "import_id")
    return imports.filter(F.col("status").isin("AwaitingUpload", "Queued", "Running") & ~F.coalesce(expired, F.lit(False))).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_revision(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """Newer coordinates supersede: the row of the greatest revision of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), revision).alias("r")).select(key, "r.*")


def purgeable(assets: DataFrame, as_of: Column) -> DataFrame:
    return assets.filter((F.col("lifecycle_state") == "Trashed") & (F.col("purge_after") <= as_of))


def outbox_after(outbox: DataFrame, deferrals: DataFrame) -> DataFrame:
    """Pending items of a deferred kind wait until the deferral's time; Sent and Skipped stay."""
    rows = outbox.join(deferrals.select("kind", F.col("until").alias("_until")), "kind", "left")
    wait = (F.col("state") == "Pending") & F.col("_until").isNotNull()
    return rows.withColumns({"next_attempt": F.when(wait, F.col("_until")).otherwise(F.col("next_attempt")), "state": F.when(wait, "Deferred").otherwise(F.col("state"))}).drop("_until")
