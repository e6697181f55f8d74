"""Rules over insurance policies: duplicates, overlaps, renewals, data quality.

Policy columns: id, vehicle_number, insurance_type, policy_number, insurer,
start_date, end_date, file_hash. Policies whose number has no digits belong to
no vehicle and are never compared.

A vehicle of few policies is gathered in one row and its pairs are held against the
rules there, so its policies are shuffled once. For the other vehicles pairs are found by
joins on keys that make two policies comparable - the same file, the same policy number,
a shared slice of time - and never by listing all pairs of a vehicle, so the work follows
the number of findings and a vehicle that holds a large part of all rows is spread over
many keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions.values import is_expired, normalize_registration
from docketry.session import settle

# Members of one block when the pairs of a group of copies are listed block against block.
COPY_BLOCK = 1000
# Policies of a vehicle whose pairs are listed in one place; a work setting, results do not depend on it.
FEW_POLICIES = 64
# So many vehicles with more policies at most are broadcast; more are joined by shuffle.
CARRIED_VEHICLES = 1_000_000
# Slices of time, in days. An interval uses the first width that cuts it into at
# most SLICES parts; the widest covers every date.
SLICE_WIDTHS = [64, 1024, 16384, 4194304]
SLICES = 16


def prepared(policies: DataFrame) -> DataFrame:
    """The columns the rules read, with normalized vehicle and insurer."""
    return policies.select(
        "id",
        normalize_registration(F.col("vehicle_number")).alias("vehicle"),
        "insurance_type",
        F.when(F.col("policy_number") != "", F.col("policy_number")).alias("number"),
        F.lower(F.coalesce("insurer", F.lit(""))).alias("insurer"),
        F.col("start_date").alias("start"),
        F.col("end_date").alias("end"),
        F.when(F.col("file_hash") != "", F.col("file_hash")).alias("hash"),
    ).filter(F.col("vehicle") != "")


def _sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on `keys` with the other columns as a_<name> and b_<name>."""
    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in keys])

    return side(left, "a").join(side(right, "b"), keys)


def _copies(p: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(vehicle, a_id, b_id, a_hash, b_hash): all pairs of policies that agree on all `keys`.

    The members of a group are hashed into blocks of about `block`, and blocks meet pair by
    pair, so a large group is many tasks' work. The pairs are the result, whatever its size.
    """
    p = p.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    p = p.withColumn("mark", F.col("hash")).select("id", "mark", *keys)
    groups = (
        p.groupBy(*keys)
        .agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1).drop("n")
    )
    members = p.join(groups, keys).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = members.withColumn("i", F.col("own")).withColumn("j", each)
    right = members.withColumn("j", F.col("own")).withColumn("i", each)
    columns = ["id", "mark", *keys, "i", "j"]
    pairs = _sides(left.select(columns), right.select(columns), [*keys, "i", "j"]).filter("a_id < b_id")
    return pairs.select(
        "vehicle", "a_id", "b_id", F.col("a_mark").alias("a_hash"), F.col("b_mark").alias("b_hash"))


def _slice_of(day: Column, width: int) -> Column:
    return F.floor(F.unix_date(day) / F.lit(width)).cast("int")


def _covered(p: DataFrame) -> DataFrame:
    """One row per slice of time an interval covers."""
    days = F.datediff("end", "start")
    level = F.lit(len(SLICE_WIDTHS) - 1)
    for i in range(len(SLICE_WIDTHS) - 2, -1, -1):
        level = F.when(days <= SLICE_WIDTHS[i] * (SLICES - 1), F.lit(i)).otherwise(level)
    cuts = [
        F.sequence(_slice_of(F.col("start"), w), _slice_of(F.col("end"), w)) for w in SLICE_WIDTHS
    ]
    leveled = p.withColumn("level", level)
    chosen = cuts[-1]
    for i in range(len(SLICE_WIDTHS) - 2, -1, -1):
        chosen = F.when(F.col("level") == i, cuts[i]).otherwise(chosen)
    return leveled.withColumn("slice", F.explode(chosen))


def _starting(p: DataFrame) -> DataFrame:
    """One row per slice width with the slice in which an interval starts."""
    at = F.array(*[
        F.struct(F.lit(i).alias("level"), _slice_of(F.col("start"), w).alias("slice"))
        for i, w in enumerate(SLICE_WIDTHS)
    ])
    return p.withColumn("at", F.explode(at)).select("*", "at.level", "at.slice").drop("at")


def _same_papers() -> Column:
    """The pair was already found as a copy of one document or one policy."""
    return F.coalesce(F.col("a_hash") == F.col("b_hash"), F.lit(False)) | F.coalesce(
        (F.col("a_number") == F.col("b_number")) & (F.col("a_insurer") == F.col("b_insurer")),
        F.lit(False),
    )


def _overlapping(p: DataFrame) -> DataFrame:
    """Pairs of same-type or comprehensive/third-party policies that overlap in time.

    a starts first and b starts inside it, so each pair meets in exactly one slice:
    the one that holds the start of b.
    """
    valid = p.filter(F.col("start") <= F.col("end"))
    met = _sides(_covered(valid), _starting(valid), ["vehicle", "level", "slice"])
    return met.filter(_overlaps()).select("vehicle", *_overlap_columns())


def _same_type() -> Column:
    return F.col("a_insurance_type").eqNullSafe(F.col("b_insurance_type"))


def _overlaps() -> Column:
    mixed = {"COMPREHENSIVE", "THIRD_PARTY"}
    both = (
        F.col("a_insurance_type").isin(*mixed) & F.col("b_insurance_type").isin(*mixed)
    )
    return (
        (F.col("a_start") <= F.col("b_start")) & (F.col("b_start") <= F.col("a_end"))
        & ((F.col("a_start") < F.col("b_start")) | (F.col("a_id") < F.col("b_id")))
        & (_same_type() | F.coalesce(both, F.lit(False))) & ~_same_papers()
    )


def _overlap_columns() -> list[Column]:
    return [
        F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"),
        F.when(_same_type(), "overlap").otherwise("redundant").alias("basis"),
        F.col("a_insurance_type").alias("insurance_type"),
        F.col("b_start").alias("overlap_start"),
        F.least("a_end", "b_end").alias("overlap_end"),
        F.lit(None).cast("int").alias("gap"),
    ]


def _renewing(p: DataFrame, renewal_gap: int) -> DataFrame:
    """Pairs (older, newer) of one type where newer starts 0..gap days after older ends.

    Which of two policies counts as the older one is decided in id order: a is older
    unless its end lies after the start of b. Missing dates keep that order dependence.
    """
    width = renewal_gap + 1
    older = p.filter(F.col("end").isNotNull()).withColumn("slice", _slice_of(F.col("end"), width))
    at = _slice_of(F.col("start"), width)
    newer = p.filter(F.col("start").isNotNull()).withColumn("slice", F.explode(F.array(at - 1, at)))
    typed = F.coalesce("insurance_type", F.lit(""))
    keys = ["vehicle", "kind", "slice"]
    met = _sides(older.withColumn("kind", typed), newer.withColumn("kind", typed), keys)
    return met.filter(_renews(renewal_gap)).select("vehicle", *_renewal_columns())


def _gap() -> Column:
    return F.datediff("b_start", "a_end")


def _renews(renewal_gap: int) -> Column:
    in_order = (F.col("a_id") < F.col("b_id")) | (
        (F.col("a_id") > F.col("b_id"))
        & F.coalesce(F.col("b_end") > F.col("a_start"), F.lit(False))
    )
    apart = ~F.coalesce(
        interval_overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))["days"] > 0,
        F.lit(False),
    )
    return _gap().between(0, renewal_gap) & in_order & apart & ~_same_papers()


def _renewal_columns() -> list[Column]:
    return [
        F.col("a_id"), F.col("b_id"), F.lit("renewal").alias("basis"),
        F.col("a_insurance_type").alias("insurance_type"),
        F.lit(None).cast("date").alias("overlap_start"),
        F.lit(None).cast("date").alias("overlap_end"),
        _gap().alias("gap"),
    ]


def _copy_columns(basis: str) -> list[Column]:
    return [
        F.col("a_id"), F.col("b_id"), F.lit(basis).alias("basis"),
        F.lit(None).cast("string").alias("insurance_type"),
        F.lit(None).cast("date").alias("overlap_start"),
        F.lit(None).cast("date").alias("overlap_end"), F.lit(None).cast("int").alias("gap"),
    ]


def _gathered(p: DataFrame, renewal_gap: int) -> DataFrame:
    """The pairs of vehicles of few policies: each vehicle is one row, its pairs are listed from it."""
    names = [c for c in p.columns if c != "vehicle"]
    rows = p.groupBy("vehicle").agg(F.collect_list(F.struct(*names)).alias("rows")).filter(F.size("rows") > 1)
    met = rows.select("vehicle", "rows", F.explode("rows").alias("a")).select(
        "vehicle", "a", F.explode("rows").alias("b")).select(
        "vehicle", *[F.col(side)[c].alias(f"{side}_{c}") for side in "ab" for c in names])
    ordered = F.col("a_id") < F.col("b_id")
    same_file = F.col("a_hash") == F.col("b_hash")
    same_number = (F.col("a_number") == F.col("b_number")) & (F.col("a_insurer") == F.col("b_insurer"))
    valid = (F.col("a_start") <= F.col("a_end")) & (F.col("b_start") <= F.col("b_end"))
    typed = [F.coalesce(f"{side}_insurance_type", F.lit("")) for side in "ab"]
    rules = [
        (ordered & same_file, _copy_columns("same_file")),
        (ordered & same_number & ~F.coalesce(same_file, F.lit(False)), _copy_columns("same_number")),
        (valid & _overlaps(), _overlap_columns()),
        ((typed[0] == typed[1]) & _renews(renewal_gap), _renewal_columns()),
    ]
    found = F.array_compact(F.array(*[F.when(holds, F.struct(*columns)) for holds, columns in rules]))
    return met.select("vehicle", F.explode(found).alias("found")).select("vehicle", "found.*")


def policy_pairs(
    policies: DataFrame, renewal_gap: int = vocab.RENEWAL_GAP_DAYS, copy_block: int = COPY_BLOCK,
    few: int = FEW_POLICIES
) -> DataFrame:
    """Comparable pairs of one vehicle -> (vehicle, a_id, b_id, basis, ...).

    basis: same_file, same_number, overlap, redundant or renewal; the first that
    holds, in this order. The vehicles of more than `few` policies are looked up at once.
    """
    p = prepared(policies)
    many = settle(p.groupBy("vehicle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("vehicle"))
    known = many.limit(CARRIED_VEHICLES + 1).count()
    if not known:
        return _gathered(p, renewal_gap)
    if known <= CARRIED_VEHICLES:
        many = F.broadcast(many)
    return _gathered(p.join(many, "vehicle", "left_anti"), renewal_gap).unionByName(
        _joined(p.join(many, "vehicle", "left_semi"), renewal_gap, copy_block))


def _joined(p: DataFrame, renewal_gap: int, copy_block: int) -> DataFrame:
    """The pairs of vehicles of any number of policies, by joins."""
    files = _copies(p, ["vehicle", "hash"], copy_block).select("vehicle", *_copy_columns("same_file"))
    numbers = (
        _copies(p, ["vehicle", "number", "insurer"], copy_block)
        .filter(~F.coalesce(F.col("a_hash") == F.col("b_hash"), F.lit(False)))
        .select("vehicle", *_copy_columns("same_number"))
    )
    return (
        files.unionByName(numbers).unionByName(_overlapping(p))
        .unionByName(_renewing(p, renewal_gap))
    )


def interval_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """struct(start, end, days) of the inclusive overlap; NULLs and 0 without one."""
    start, end = F.greatest(a_start, b_start), F.least(a_end, b_end)
    known = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    meets = F.coalesce(known & (start <= end), F.lit(False))
    return F.struct(
        F.when(meets, start).alias("start"), F.when(meets, end).alias("end"),
        F.when(meets, F.datediff(end, start) + 1).otherwise(0).alias("days"),
    )


def detect_conflicts(
    policies: DataFrame, renewal_gap: int = vocab.RENEWAL_GAP_DAYS, copy_block: int = COPY_BLOCK
) -> DataFrame:
    """Classified conflicts (vehicle, a_id, b_id, conflict_type, severity, overlap_*, message)."""
    basis = F.col("basis")
    strict = F.col("insurance_type").isin("COMPREHENSIVE", "COMPULSORY")
    days = F.coalesce(F.datediff("overlap_end", "overlap_start") + 1, F.lit(0))
    kind = (
        F.when(basis.isin("same_file", "same_number"), "EXACT_DUPLICATE")
        .when(basis == "overlap", "OVERLAPPING_SAME_TYPE")
        .when(basis == "redundant", "POTENTIAL_REDUNDANT_COVERAGE")
        .otherwise("LIKELY_RENEWAL")
    )
    severity = (
        F.when(basis.isin("same_file", "same_number"), "HIGH")
        .when((basis == "overlap") & strict, "HIGH")
        .when(basis == "renewal", "INFO")
        .otherwise("WARNING")
    )
    message = (
        F.when(basis == "same_file", "Identical document uploaded more than once.")
        .when(basis == "same_number", "Same policy number and insurer.")
        .when(basis == "overlap", F.format_string(
            "Two %s policies overlap for %d day(s).", "insurance_type", days))
        .when(basis == "redundant",
              "Comprehensive and third-party coverage overlap — review for redundancy.")
        .otherwise(F.format_string("Likely renewal (gap of %d day(s)).", "gap"))
    )
    return policy_pairs(policies, renewal_gap, copy_block).select(
        "vehicle", "a_id", "b_id", kind.alias("conflict_type"), severity.alias("severity"),
        "overlap_start", "overlap_end", days.alias("overlap_days"), message.alias("message"),
    )


def renewal_links(policies: DataFrame, renewal_gap: int = vocab.RENEWAL_GAP_DAYS) -> DataFrame:
    """(older_id, newer_id, gap): each policy and its successors."""
    return _renewing(prepared(policies), renewal_gap).select(
        F.col("a_id").alias("older_id"), F.col("b_id").alias("newer_id"), "gap")


def quality_issues(
    policies: DataFrame, selected: Column | None = None, today: Column | None = None
) -> DataFrame:
    """Findings per policy (id, severity, code, message)."""
    def issue(test: Column, severity: str, code: str, message: str) -> Column:
        return F.when(test, F.struct(
            F.lit(severity).alias("severity"), F.lit(code).alias("code"),
            F.lit(message).alias("message")))

    vehicle = normalize_registration(F.col("vehicle_number"))
    findings = [
        issue(F.col("end_date") < F.col("start_date"), "HIGH", "invalid_dates",
              "Policy end date is before its start date."),
        issue(F.coalesce("insurer", F.lit("")) == "", "WARNING", "missing_insurer",
              "Insurer name is missing."),
        issue(vehicle == "", "HIGH", "no_vehicle",
              "Document has no identifiable vehicle number."),
    ]
    if selected is not None:
        chosen = normalize_registration(selected)
        findings.append(issue((chosen != "") & (vehicle != chosen), "CRITICAL", "vehicle_mismatch",
                              "Document vehicle number differs from the selected vehicle."))
    if today is not None:
        findings.append(issue(is_expired(F.col("end_date"), today), "INFO", "already_expired",
                              "Extracted expiry date has already passed."))
    return policies.select("id", F.explode(F.array_compact(F.array(*findings))).alias("issue")).select(
        "id", "issue.severity", "issue.code", "issue.message")


def coerce_policy_types(fields: DataFrame) -> DataFrame:
    """insurance_type: a known value or NULL; the two dates: ISO dates or NULL."""
    kind = F.col("insurance_type")
    iso = r"^\d{4}-\d{2}-\d{2}$"

    def day(name: str) -> Column:
        return F.when(F.rlike(F.col(name), F.lit(iso)), F.try_to_date(F.col(name), "yyyy-MM-dd"))

    return fields.withColumns({
        "insurance_type": F.when(kind.isin(*vocab.INSURANCE_TYPES), kind),
        "start_date": day("start_date"), "end_date": day("end_date"),
    })


def match_or_create_vehicle(plates: DataFrame, vehicles: DataFrame) -> DataFrame:
    """plates(plate, ...) with vehicle_key and is_new; no digits -> NULL key.

    `vehicles` is unique by normalized_number, so the join adds no rows.
    """
    number = F.nullif(normalize_registration(F.col("plate")), F.lit(""))
    known = vehicles.select(
        F.col("normalized_number").alias("vehicle_key"), F.lit(False).alias("known"))
    joined = plates.withColumn("vehicle_key", number).join(known, "vehicle_key", "left")
    is_new = F.col("vehicle_key").isNotNull() & F.col("known").isNull()
    return joined.select(*plates.columns, "vehicle_key", is_new.alias("is_new"))


def replace_unreviewed_conflicts(
    existing: DataFrame, fresh: DataFrame, vehicles: DataFrame
) -> DataFrame:
    """Unreviewed rows of the rescanned `vehicles` give way to `fresh`."""
    open_ = F.col("status") == "needs_review"
    kept = existing.filter(~open_).unionByName(
        existing.filter(open_).join(vehicles.select("vehicle").distinct(), "vehicle", "left_anti"))
    return kept.unionByName(fresh.withColumn("status", F.lit("needs_review")), allowMissingColumns=True)


def conflict_alerts(conflicts: DataFrame) -> DataFrame:
    """An alert for each HIGH or CRITICAL conflict."""
    return conflicts.filter(F.col("severity").isin("HIGH", "CRITICAL")).select(
        "vehicle", F.lit("conflict").alias("kind"), "severity", "message")


def conflict_scan(
    policies: DataFrame, existing: DataFrame | None = None, renewal_gap: int = vocab.RENEWAL_GAP_DAYS
) -> tuple[DataFrame, DataFrame]:
    """Conflicts of all given policies with their vehicle, and the alerts they raise."""
    fresh = detect_conflicts(policies, renewal_gap).withColumn("status", F.lit("needs_review"))
    if existing is not None:
        fresh = replace_unreviewed_conflicts(existing, fresh, prepared(policies))
    return fresh, conflict_alerts(fresh)


def recent_conflicts(conflicts: DataFrame, n: int = 500) -> DataFrame:
    """Newest conflicts first; ties by pair."""
    return conflicts.orderBy(F.desc("created_at"), "a_id", "b_id").limit(n)


def vehicles_by_number(vehicles: DataFrame, n: int = 500) -> DataFrame:
    return vehicles.orderBy("normalized_number").limit(n)


def vehicle_policies(policies: DataFrame, vehicle: str) -> DataFrame:
    """Policies of one vehicle, however its number is written."""
    wanted = normalize_registration(F.lit(vehicle))
    return policies.filter(
        (normalize_registration(F.col("vehicle_number")) == wanted) & (wanted != ""))
