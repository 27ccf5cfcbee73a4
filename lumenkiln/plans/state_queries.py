"""Idempotency, quotas, circuits, leases and sweeps on the role views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds
from ..state import ledger
from .catalog_queries import as_of
from .registry import ORACLE_SQL, QUERIES, Roles, query

QUERIES["Z1_change_feed"], ORACLE_SQL["Z1_change_feed"] = QUERIES["Q6_change_feed"], ORACLE_SQL["Q6_change_feed"]
for _n in ("Z5_recovery_sweep",):
    QUERIES[_n], ORACLE_SQL[_n] = QUERIES["F10_sweep_outcome"], ORACLE_SQL["F10_sweep_outcome"]

_ORDERED = "select *, row_number() over (partition by user_id, idempotency_key order by arrived_at, seq) as n from request"
_FREE = "date_sub('second', f.holder_at, r.arrived_at) >= 86400"
_HELD = {"holder_at": "arrived_at", "holder_done": "answered_at", "holder_method": "method", "holder_route": "route", "holder_sha": "request_sha256"}
query("Z2_idempotency", f"""with recursive r as ({_ORDERED}), f as (
  select user_id, idempotency_key, seq, n, {', '.join(f'{c} as {h}' for h, c in _HELD.items())}, 'New' as outcome from r where n = 1
  union all select r.user_id, r.idempotency_key, r.seq, r.n, {', '.join(f'case when {_FREE} then r.{c} else f.{h} end' for h, c in _HELD.items())},
    case when {_FREE} then 'New' when f.holder_sha <> r.request_sha256 or f.holder_method <> r.method or f.holder_route <> r.route then 'KeyReused'
      when f.holder_done is not null and f.holder_done <= r.arrived_at then 'Replay' else 'RequestInProgress' end
  from f join r on r.user_id = f.user_id and r.idempotency_key = f.idempotency_key and r.n = f.n + 1)
select user_id, idempotency_key, seq, outcome from f""")(lambda r: ledger.idempotency(r.request))

_ADMIT = "select seq, user_id, provider, usage_month, case when n <= {k} {open} then 'Admitted' else 'DeferredQuota' end as decision, case when not (n <= {k} {open}) then cast(usage_month + interval 1 month as date) end as next_attempt from (select *, row_number() over (partition by user_id, provider, usage_month order by seq) as n from usage) u"
for _name in ("W0g_quota_admission", "Z8_quota_ledger"):
    query(_name, _ADMIT.format(k=12, open=""))(lambda r: ledger.admit(r.usage, limit=12))


@query("Z8_two_limits", _ADMIT.format(k=7, open=""))
def _(r: Roles):
    from decimal import Decimal

    return ledger.admit(r.usage, limit=12, usd_limit=Decimal("0.05"), reservation=Decimal("0.00632"))


query("Z8_settled", """select user_id, provider, usage_month, cast(sum(case event_type when 'view' then units else 0 end) - sum(case when event_type in ('click', 'error') then units else 0 end) as bigint) as reserved,
  cast(sum(case event_type when 'click' then units else 0 end) as bigint) as processed from usage group by 1, 2, 3""")(
    lambda r: ledger.settle(r.usage.withColumns({"kind": F.when(F.col("event_type") == "view", "Reserve").when(F.col("event_type") == "click", "Consume").when(F.col("event_type") == "error", "Release").otherwise("Other"), "amount": F.col("units")})))
query("Z8_unequal_amounts", """with recursive r as (select *, row_number() over (partition by user_id, provider, usage_month order by seq) as n from usage), f as (
  select user_id, provider, usage_month, seq, n, case when usd <= 250 then usd else cast(0 as decimal(20,6)) end as used, usd <= 250 as ok from r where n = 1
  union all select r.user_id, r.provider, r.usage_month, r.seq, r.n, cast(case when f.used + r.usd <= 250 then f.used + r.usd else f.used end as decimal(20,6)), f.used + r.usd <= 250 from f join r on r.user_id = f.user_id and r.provider = f.provider and r.usage_month = f.usage_month and r.n = f.n + 1)
select user_id, provider, usage_month, seq, case when ok then 'Admitted' else 'DeferredQuota' end as decision from f""")(lambda r: ledger.admit_amounts(r.usage.withColumn("amount", F.col("usd")), 250))


def _circuit_events(r: Roles):
    return r.usage.select("seq", "user_id", "provider", "usage_month", F.when(F.col("event_type") == "error", "Failure").when(F.col("event_type") == "signup", "Retry").otherwise("Other").alias("kind"), F.when(F.col("seq") % 2 == 0, "Quota").otherwise("Transient").alias("failure_class"))


_OPEN = "select user_id, provider, usage_month from usage where event_type = 'signup' or (event_type = 'error' and seq % 2 = 0) group by 1, 2, 3 having max_by(event_type, seq) = 'error'"
query("Z9_open_circuits", _OPEN)(lambda r: ledger.circuits(_circuit_events(r)))
query("Z9_blocked_by_circuit", f"select u.seq, case when c.user_id is null and n <= 12 then 'Admitted' else 'DeferredQuota' end as decision from (select *, row_number() over (partition by user_id, provider, usage_month order by seq) as n from usage) u left join ({_OPEN}) c using (user_id, provider, usage_month)")(
    lambda r: ledger.admit(r.usage, limit=12, circuits=ledger.circuits(_circuit_events(r))).select("seq", "decision"))



def _deferred(r: Roles):
    """Jobs with their provider, some deferred by an open circuit; the first job of each user and provider is retried."""
    jobs = r.job.withColumns({"provider": F.when(F.col("job_type") == "Geocode", "maps").otherwise("vision"), "failure_code": F.when(F.col("job_id") % 5 < 4, "ProviderCircuitOpen")}).select(
        "job_id", "user_id", "provider", "job_type", "status", "attempt_count", "next_attempt", "failure_code")
    return jobs, jobs.groupBy("user_id", "provider").agg(F.min("job_id").alias("job_id"))


query("Z9_promoted", """with j as (select job_id, user_id, job_type, status, attempt_count, next_attempt, status = 'DeferredQuota' and job_id % 5 < 4 and job_id <> min(job_id) over (partition by user_id, job_type) as waits from job),
  n as (select *, count(*) filter (where waits) over (partition by user_id, job_type order by job_id) as k from j)
  select job_id, case when waits and k <= 100 then case when job_type = 'Description' then 'Preparing' else 'Queued' end else status end as status, case when waits and k <= 100 then 0 else attempt_count end as attempt_count,
    case when waits and k <= 100 and job_type = 'Description' then null when waits then timestamp '2024-02-01' else next_attempt end as next_attempt from n""")(
    lambda r: ledger.promote_deferred(*_deferred(r), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).select("job_id", "status", F.col("attempt_count").cast("long").alias("attempt_count"), "next_attempt"))

_ALLOWED = " or ".join(f"(f.status = '{a}' and r.status in ({', '.join(repr(b) for b in bs)}))" for a, bs in ledger.TRANSITIONS.items())
query("Z3_job_states", f"""with recursive r as (select asset_id as job_id, job_id as seq, status, row_number() over (partition by asset_id order by job_id) as n, count(*) over (partition by asset_id) as events from job), f as (
  select job_id, status, n, events from r where n = 1 union all select r.job_id, case when {_ALLOWED} then r.status else f.status end, r.n, r.events from f join r on r.job_id = f.job_id and r.n = f.n + 1)
select job_id, status, events from f where n = events""")(lambda r: ledger.fold_jobs(r.job.select(F.col("asset_id").alias("job_id"), F.col("job_id").alias("seq"), "status")))
query("Z3_claimed", "select job_id, attempt_count + 1 as attempt_count from job where attempt_count < 5 and (status = 'Queued' or (status = 'Running' and lease_expires <= timestamp '2024-02-01'))")(
    lambda r: ledger.claim(r.job.withColumn("lease_hash", F.lit(None).cast("string")), "m-1", as_of()).filter("claimed").select("job_id", "attempt_count"))
query("Z4_fenced_completions", "select job_id, case when status = 'Running' and job_id % 2 = 0 then case when job_id % 3 = 0 then 'Cancelled' else 'Succeeded' end else status end as status from job")(
    lambda r: ledger.complete(
        r.job.withColumns({"lease_hash": F.lit("x"), "coordinate_revision": (F.col("job_id") % 3).cast("string")}),
        r.job.select("job_id", F.when(F.col("job_id") % 2 == 0, "x").otherwise("y").alias("lease_hash"), F.when(F.col("job_id") % 3 == 0, "old").otherwise((F.col("job_id") % 3).cast("string")).alias("coordinate_revision"), F.lit("Succeeded").alias("outcome"))).select("job_id", "status"))


def _imports(r: Roles):
    return r.orders.select(F.col("o_orderkey").alias("import_id"), (F.col("o_custkey") % 40).alias("source_id"), F.when(F.col("o_orderstatus") == "O", "AwaitingUpload").when(F.col("o_orderstatus") == "F", "Completed").otherwise("Queued").alias("status"), F.col("o_orderdate").alias("created_at"), F.date_add("o_orderdate", 1).cast("timestamp_ntz").alias("expires_at"))


_AT = "timestamp '1997-01-01'"
query("Z7_active_imports", f"select source_id, import_id from (select o_custkey % 40 as source_id, o_orderkey as import_id, row_number() over (partition by o_custkey % 40 order by o_orderdate, o_orderkey) as n from orders where (o_orderstatus = 'O' and cast(cast(o_orderdate as date) + 1 as timestamp) > {_AT}) or o_orderstatus not in ('O', 'F')) x where n = 1")(
    lambda r: ledger.active_imports(_imports(r), F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).select("source_id", "import_id"))
query("Z6_claimable_imports", f"select o_orderkey as import_id from orders where o_orderstatus not in ('O', 'F') and o_orderdate <= {_AT} order by o_orderdate, o_orderkey limit 20")(
    lambda r: _imports(r).filter("status = 'Queued' and created_at <= timestamp_ntz '1997-01-01'").orderBy("created_at", "import_id").limit(20).select("import_id"))


def _phased(r: Roles):
    """Imports in all states and phases, with leases and times of a next attempt."""
    k = F.col("o_orderkey")
    phase = F.element_at(F.array(*map(F.lit, ("Downloading", "Staged", "Merging", "Merged", "WritingResult", "None"))), (k % 6 + 1).cast("int"))
    return r.orders.select(
        k.alias("import_id"), F.when(k % 3 == 0, "Running").when(k % 3 == 1, "Queued").otherwise("Completed").alias("status"), F.when(k % 6 != 5, phase).alias("phase"), (k % 5).cast("int").alias("attempt_count"),
        F.when(k % 3 == 0, F.sha2(F.lit("m-0"), 256)).alias("lease_hash"), F.when(k % 3 == 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("lease_expires"), F.when(k % 4 == 1, F.col("o_orderdate").cast("timestamp_ntz")).alias("next_attempt"))


_PHASED = f"""select o_orderkey as import_id, case o_orderkey % 6 when 0 then 'Downloading' when 1 then 'Staged' when 2 then 'Merging' when 3 then 'Merged' when 4 then 'WritingResult' end as phase, o_orderkey % 5 as attempt_count,
  case when o_orderkey % 3 = 0 then 'Running' when o_orderkey % 3 = 1 then 'Queued' else 'Completed' end as status, (o_orderkey % 3 = 0 and o_orderdate <= {_AT}) or (o_orderkey % 3 = 1 and (o_orderkey % 4 <> 1 or o_orderdate <= {_AT})) as claimed from orders"""
query("Z6_claims", f"""select import_id, case when claimed then 'Running' else status end as status, attempt_count + case when claimed then 1 else 0 end as attempt_count, case when claimed then coalesce(case when phase <> 'Downloading' then phase end, 'Downloading') else phase end as phase,
  case when claimed then case when phase in ('Staged', 'Merging') then 'Merge' when phase in ('Merged', 'WritingResult') then 'WriteResult' else 'Download' end end as next_step from ({_PHASED}) p""")(
    lambda r: ledger.claim_imports(_phased(r), "m-1", F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).select("import_id", "status", F.col("attempt_count").cast("long").alias("attempt_count"), "phase", "next_step"))


def _failed(r: Roles):
    """Every running import's worker reports a failure, a third of them under a lease that is not its own."""
    failures = r.orders.select(F.col("o_orderkey").alias("import_id"), F.sha2(F.when(F.col("o_orderkey") % 9 == 0, "other").otherwise("m-0"), 256).alias("lease_hash"), (F.col("o_orderkey") % 2 == 0).alias("retryable"))
    return ledger.failed_imports(_phased(r), failures, F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), max_attempts=4)


query("Z6_failed", f"""select import_id, case when not told then status when import_id % 2 = 0 and attempt_count < 4 then 'Queued' else 'Failed' end as status,
  case when told and import_id % 2 = 0 and attempt_count < 4 then {_AT} + to_seconds(cast(least(3600, 300 * 2 ** greatest(attempt_count - 1, 0)) as bigint)) when import_id % 4 = 1 then o_orderdate end as next_attempt
  from (select p.*, o.o_orderdate, status = 'Running' and import_id % 9 <> 0 as told from ({_PHASED}) p join orders o on o.o_orderkey = p.import_id) x""")(lambda r: _failed(r).select("import_id", "status", "next_attempt"))
query("Z10_can_retry", "select job_id, status = 'DeferredQuota' or (status = 'Failed' and attempt_count < max_attempts) as can_retry from job")(lambda r: r.job.select("job_id", feeds.can_retry().alias("can_retry")))
query("Z11_upload_leases", f"select o_orderkey as session_id from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as n from orders where o_orderstatus = 'O' and o_orderdate + interval 1 day > {_AT}) x where n = 1")(
    lambda r: ledger.active_uploads(r.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("asset_id"), F.col("o_orderpriority").alias("purpose"), F.when(F.col("o_orderstatus") == "O", "Active").otherwise("Closed").alias("state"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("expires_at")), F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))[0].select("session_id"))
query("Z12_dead_letters", "select count(*) filter (where event_id % 10 = 0) as malformed, count(*) filter (where event_id % 10 <> 0) as accepted from events")(
    lambda r: r.events.select(F.from_json(F.when(F.col("event_id") % 10 == 0, F.lit("{bad")).otherwise(F.col("props")), "k long, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("m")).agg(F.count_if(F.col("m._corrupt_record").isNotNull()).alias("malformed"), F.count_if(F.col("m._corrupt_record").isNull()).alias("accepted")))
query("Z14_outbox", "select job_id, case when status = 'Queued' and job_type = 'Geocode' then 'Deferred' else case status when 'Queued' then 'Pending' else status end end as state from job")(
    lambda r: ledger.outbox_after(r.job.select("job_id", F.col("job_type").alias("kind"), F.when(F.col("status") == "Queued", "Pending").otherwise(F.col("status")).alias("state"), "next_attempt"), r.spark.createDataFrame([("Geocode",)], "kind string").withColumn("until", as_of())).select("job_id", "state"))
query("Z15_latest_revision", "select asset_id, max(job_id) as job_id, max_by(status, job_id) as status from job group by 1")(lambda r: ledger.latest_revision(r.job.select("asset_id", "job_id", "status"), "asset_id", "job_id"))
query("Z16_purgeable", "select asset_id from asset where lifecycle_state = 'Trashed' and updated_at + interval 30 day <= timestamp '2020-03-01'")(
    lambda r: ledger.purgeable(r.asset.withColumn("purge_after", F.col("updated_at") + F.make_dt_interval(F.lit(30))), F.lit("2020-03-01 00:00:00").cast("timestamp_ntz")).select("asset_id"))
