"""Queries over insurance policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.checks.base import Data, common, query
from docketry.functions import values
from docketry.operators import policies as op

TODAY = "1999-06-15"

common("norm_policies", """
select *, regexp_replace(vehicle_number, '\\D', '', 'g') as vehicle, lower(coalesce(insurer, '')) as ins
from policies""")
common("all_pairs", """
select a.id as a_id, b.id as b_id, a.vehicle,
  a.insurance_type as a_type, b.insurance_type as b_type,
  a.start_date as a_start, a.end_date as a_end, b.start_date as b_start, b.end_date as b_end,
  coalesce(a.file_hash = b.file_hash, false) as same_file,
  coalesce(a.policy_number = b.policy_number and a.ins = b.ins, false) as same_number,
  a.start_date is not null and a.end_date is not null and b.start_date is not null
    and b.end_date is not null as known
from norm_policies a join norm_policies b on a.vehicle = b.vehicle and a.id < b.id
where a.vehicle <> ''""")
common("rated_pairs", """
select *,
  case when known then greatest(a_start, b_start) end as s,
  case when known then least(a_end, b_end) end as e,
  case when known and greatest(a_start, b_start) <= least(a_end, b_end)
    then date_diff('day', greatest(a_start, b_start), least(a_end, b_end)) + 1 else 0 end as days,
  case when a_end is null or b_start is null then null
    when a_end <= b_start then date_diff('day', a_end, b_start)
    else date_diff('day', b_end, a_start) end as gap,
  coalesce(a_end <= b_start, false) as a_older
from all_pairs""")
common("found_conflicts", """
select case when basis = 'renewal' and not a_older then b_id else a_id end as a_id,
  case when basis = 'renewal' and not a_older then a_id else b_id end as b_id,
  vehicle, basis, a_type, days, gap,
  case when basis in ('overlap', 'redundant') then s end as s,
  case when basis in ('overlap', 'redundant') then e end as e
from (
  select *, case when same_file then 'same_file' when same_number then 'same_number'
    when a_type = b_type and days > 0 then 'overlap'
    when days > 0 and a_type in ('COMPREHENSIVE', 'THIRD_PARTY')
      and b_type in ('COMPREHENSIVE', 'THIRD_PARTY') then 'redundant'
    when a_type = b_type and gap between 0 and 31 then 'renewal' end as basis
  from rated_pairs) r
where basis is not null""")
common("conflicts", """
select a_id, b_id, vehicle,
  case basis when 'same_file' then 'EXACT_DUPLICATE' when 'same_number' then 'EXACT_DUPLICATE'
    when 'overlap' then 'OVERLAPPING_SAME_TYPE' when 'redundant' then 'POTENTIAL_REDUNDANT_COVERAGE'
    else 'LIKELY_RENEWAL' end as conflict_type,
  case when basis in ('same_file', 'same_number') then 'HIGH'
    when basis = 'overlap' and a_type in ('COMPREHENSIVE', 'COMPULSORY') then 'HIGH'
    when basis = 'renewal' then 'INFO' else 'WARNING' end as severity,
  cast(s as varchar) as overlap_start, cast(e as varchar) as overlap_end,
  case when basis in ('overlap', 'redundant') then days else 0 end as overlap_days,
  case basis when 'same_file' then 'Identical document uploaded more than once.'
    when 'same_number' then 'Same policy number and insurer.'
    when 'overlap' then 'Two ' || a_type || ' policies overlap for ' || days || ' day(s).'
    when 'redundant' then 'Comprehensive and third-party coverage overlap — review for redundancy.'
    else 'Likely renewal (gap of ' || gap || ' day(s)).' end as message
from found_conflicts""")
# reviewed and open rows of an earlier scan, derived from the policies
common("old_conflicts", """
select id as a_id, id + 1 as b_id, regexp_replace(vehicle_number, '\\D', '', 'g') as vehicle,
  'LIKELY_RENEWAL' as conflict_type, 'INFO' as severity,
  case when id % 3 = 0 then 'resolved' else 'needs_review' end as status
from policies""")


def text_dates(df, *names):
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def old_conflicts(d: Data):
    return d.policies.select(
        F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"),
        values.normalize_registration(F.col("vehicle_number")).alias("vehicle"),
        F.lit("LIKELY_RENEWAL").alias("conflict_type"), F.lit("INFO").alias("severity"),
        F.when(F.col("id") % 3 == 0, "resolved").otherwise("needs_review").alias("status"))


@query("policy_pairs", "select a_id, b_id, basis from found_conflicts")
def _(d: Data):
    return op.policy_pairs(d.policies).select("a_id", "b_id", "basis")


@query("detect_conflicts", """
select a_id, b_id, conflict_type, severity, overlap_start, overlap_end, overlap_days, message
from conflicts""")
def _(d: Data):
    found = op.detect_conflicts(d.policies).drop("vehicle")
    return text_dates(found, "overlap_start", "overlap_end")


@query("conflict_scan", """
select vehicle, a_id, b_id, conflict_type, severity, overlap_days, message, 'needs_review' as status
from conflicts""")
def _(d: Data):
    found, _ = op.conflict_scan(d.policies)
    return found.select("vehicle", "a_id", "b_id", "conflict_type", "severity", "overlap_days",
                        "message", "status")


@query("interval_overlap", """
select id, cast(case when ok then s end as varchar) as overlap_start,
  cast(case when ok then e end as varchar) as overlap_end,
  case when ok then date_diff('day', s, e) + 1 else 0 end as overlap_days
from (select id, greatest(start_date, date '1998-01-01') as s, least(end_date, date '1998-12-31') as e,
  coalesce(start_date is not null and end_date is not null and
    greatest(start_date, date '1998-01-01') <= least(end_date, date '1998-12-31'), false) as ok
  from policies) p""")
def _(d: Data):
    year = [F.lit(x).cast("date") for x in ("1998-01-01", "1998-12-31")]
    both = op.interval_overlap(F.col("start_date"), F.col("end_date"), *year)
    return text_dates(d.policies.select("id", both.alias("o")).select(
        "id", F.col("o.start").alias("overlap_start"), F.col("o.end").alias("overlap_end"),
        F.col("o.days").alias("overlap_days")), "overlap_start", "overlap_end")


@query("renewal_links", """
select a_id as older_id, b_id as newer_id, gap from found_conflicts where basis = 'renewal'""")
def _(d: Data):
    return op.renewal_links(d.policies)


@query("quality_issues", f"""
select id, severity, code from (
  select id, 'HIGH' as severity, 'invalid_dates' as code from norm_policies where end_date < start_date
  union all select id, 'WARNING', 'missing_insurer' from norm_policies where coalesce(insurer, '') = ''
  union all select id, 'HIGH', 'no_vehicle' from norm_policies where vehicle = ''
  union all select id, 'CRITICAL', 'vehicle_mismatch' from norm_policies where vehicle <> '0000042'
  union all select id, 'INFO', 'already_expired' from norm_policies where end_date < date '{TODAY}') q""")
def _(d: Data):
    return op.quality_issues(d.policies, F.lit("00-000-42"), F.lit(TODAY).cast("date")).select(
        "id", "severity", "code")


@query("coerce_policy_types", """
select id, case when kind in ('COMPULSORY', 'THIRD_PARTY', 'COMPREHENSIVE', 'OTHER') then kind end
    as insurance_type,
  cast(start_date as varchar) as start_date, case when id % 3 = 0 then null
    else cast(end_date as varchar) end as end_date
from (select *, case when id % 5 = 0 then 'MARINE' else insurance_type end as kind from policies) p""")
def _(d: Data):
    raw = d.policies.select(
        "id", F.when(F.col("id") % 5 == 0, "MARINE").otherwise(F.col("insurance_type")).alias("insurance_type"),
        F.col("start_date").cast("string"),
        F.when(F.col("id") % 3 == 0, F.date_format("end_date", "dd/MM/yyyy"))
        .otherwise(F.col("end_date").cast("string")).alias("end_date"))
    return text_dates(op.coerce_policy_types(raw), "start_date", "end_date")


@query("match_or_create_vehicle", """
select p.id, nullif(p.vehicle, '') as vehicle_key, p.vehicle <> '' and v.normalized_number is null as is_new
from norm_policies p left join vehicles v on v.normalized_number = p.vehicle""")
def _(d: Data):
    plates = d.policies.select("id", F.col("vehicle_number").alias("plate"))
    return op.match_or_create_vehicle(plates, d.vehicles).select("id", "vehicle_key", "is_new")


@query("replace_unreviewed_conflicts", """
select a_id, b_id, vehicle, conflict_type, severity, status from old_conflicts
where status <> 'needs_review' or vehicle not in (select vehicle from norm_policies where id % 2 = 0)
union all
select a_id, b_id, vehicle, conflict_type, severity, 'needs_review' from conflicts
where vehicle in (select vehicle from norm_policies where id % 2 = 0)""")
def _(d: Data):
    touched = op.prepared(d.policies).filter("id % 2 = 0").select("vehicle").union(
        d.policies.filter("id % 2 = 0 and vehicle_number = ''").select("vehicle_number")).distinct()
    fresh, _ = op.conflict_scan(d.policies)
    columns = ["a_id", "b_id", "vehicle", "conflict_type", "severity"]
    fresh = fresh.join(touched, "vehicle", "left_semi").select(*columns)
    return op.replace_unreviewed_conflicts(old_conflicts(d), fresh, touched).select(*columns, "status")


@query("conflict_alerts", """
select vehicle, 'conflict' as kind, severity, message from conflicts where severity in ('HIGH', 'CRITICAL')""")
def _(d: Data):
    return op.conflict_scan(d.policies)[1]


@query("recent_conflicts", """
select a_id, b_id, conflict_type from conflicts order by a_id % 1000 desc, a_id, b_id limit 500""")
def _(d: Data):
    found = op.detect_conflicts(d.policies).withColumn("created_at", F.col("a_id") % 1000)
    return op.recent_conflicts(found).select("a_id", "b_id", "conflict_type")


@query("vehicles_by_number", """
select normalized_number, registration_number from vehicles order by normalized_number limit 500""")
def _(d: Data):
    return op.vehicles_by_number(d.vehicles).select("normalized_number", "registration_number")


@query("vehicle_policies", "select id, insurance_type from norm_policies where vehicle = '0000042'")
def _(d: Data):
    return op.vehicle_policies(d.policies, "00-000-42").select("id", "insurance_type")


@query("days_until_expiry", f"""
select id, cast(date_diff('day', date '{TODAY}', end_date) as varchar) as days from policies""")
def _(d: Data):
    days = values.days_until_expiry(F.col("end_date"), F.lit(TODAY).cast("date"))
    return d.policies.select("id", days.cast("string").alias("days"))


@query("expiring_within", f"""
select id, coalesce(date_diff('day', date '{TODAY}', end_date) between 0 and 30, false) as soon from policies""")
def _(d: Data):
    return d.policies.select(
        "id", values.expiring_within(F.col("end_date"), F.lit(TODAY).cast("date"), 30).alias("soon"))


@query("is_expired", f"""
select id, coalesce(end_date < date '{TODAY}', false) as expired from policies""")
def _(d: Data):
    return d.policies.select(
        "id", values.is_expired(F.col("end_date"), F.lit(TODAY).cast("date")).alias("expired"))


@query("normalize_registration", "select id, vehicle as number from norm_policies")
def _(d: Data):
    return d.policies.select("id", values.normalize_registration(F.col("vehicle_number")).alias("number"))


@query("registration_matches", """
select p.id, p.vehicle <> '' and p.vehicle = regexp_replace(c.c_name, '\\D', '', 'g') as same
from norm_policies p join customer c on c.c_custkey = p.id""")
def _(d: Data):
    names = d.table("customer").select(F.col("c_custkey").alias("id"), "c_name")
    return d.policies.select("id", "vehicle_number").join(names, "id").select(
        "id", values.registration_matches(F.col("vehicle_number"), F.col("c_name")).alias("same"))
