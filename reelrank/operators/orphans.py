"""References to records that do not exist (problem 2).

Parent keys are integers with a fixed shape around them ("q00000012" is 12 with the
prefix "q" and eight digits). Sorted, they compress into contiguous runs; a reference is
matched as of the preceding run start and is an orphan beyond that run's end. Whether a
known key existed at the time of the reference is an as-of match too, against its log of
additions and removals, first by day and then, on days with a change, by second.

Every window below runs over groups that are bounded by construction, however skewed the
references are: a key bucket holds at most 2**BUCKET_BITS keys, a key's days are at most
the days of the period, a day has 86,400 seconds. References are made distinct per key and
day (per second on days with a change) by partial aggregation before any of these."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelrank.runtime import clean_key, cut, quoted, ship, sized_broadcast

#: The day of a column `seconds`, also before 1970.
DAY = "(seconds - pmod(seconds, 86400)) div 86400"
#: A bucket of neighbouring integers is the unit in which runs are made and matched.
BUCKET_BITS = 9


@dataclass(frozen=True)
class Reference:
    """One referring column: the table's and field's names in the report, the table,
    its key column, the entity referred to and the time (epoch seconds)."""

    tbl: str
    fld: str
    rows: DataFrame
    key: str
    entity: str
    seconds: Column


def key_parts(key: Column) -> list[Column]:
    """(shape, n): the shape and the integer give the key back, so different keys never
    share both. The shape is the prefix and, where the digits start with a zero, their
    number; of more than 18 digits the last 18 are the integer; a key without digits at
    its end is its own shape."""
    digits = F.regexp_extract(key, r"([0-9]{1,18})\z", 1)
    prefix = F.substring(key, F.lit(1), F.length(key) - F.length(digits))
    width = F.when(digits.startswith("0") & (F.length(digits) > 1), F.length(digits)).otherwise(F.when(digits == "", F.lit(-1)).otherwise(F.lit(0)))
    shape = F.concat(width.cast("string"), F.lit(":"), prefix)
    return [shape.alias("shape"), F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(0)).alias("n")]


def key_of() -> Column:
    """The key that (shape, n) came from."""
    width = F.substring_index("shape", ":", 1).cast("int")
    prefix = F.substring(F.col("shape"), F.instr("shape", ":") + 1, F.length("shape"))
    digits = F.col("n").cast("string")
    return F.when(width == -1, prefix).when(width == 0, F.concat(prefix, digits)).otherwise(F.concat(prefix, F.lpad(digits, width, F.lit("0"))))


def _bucket(n: str = "n") -> Column:
    return F.shiftright(F.col(n), BUCKET_BITS)


def runs(keys: DataFrame) -> DataFrame:
    """(entity, shape, bucket, lo, hi, kind) from distinct (entity, shape, n, kind): the
    longest stretches of neighbouring integers of one kind, cut at bucket ends."""
    w = W.partitionBy("entity", "shape", "bucket").orderBy("n")
    keyed = keys.withColumn("bucket", _bucket())
    fresh = (F.lag("n").over(w) == F.col("n") - 1) & (F.lag("kind").over(w) == F.col("kind"))
    marked = keyed.withColumn("_start", F.when(F.coalesce(fresh, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_start").over(w))
    return marked.groupBy("entity", "shape", "bucket", "_run").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("kind").alias("kind")).drop("_run")


def as_of_runs(refs: DataFrame, run_table: DataFrame) -> DataFrame:
    """refs (entity, shape, n, ...) with `kind` of the run that holds n, else null: the
    last run start at or before n is carried forward and n compared with its end."""
    cols = [c for c in refs.columns if c not in ("entity", "shape", "n")]
    point = refs.select("entity", "shape", _bucket().alias("bucket"), "n", F.lit(1).alias("_is_ref"), F.lit(None).cast("bigint").alias("_hi"), F.lit(None).cast("string").alias("_kind"), F.struct(*cols).alias("_rest") if cols else F.lit(None).alias("_rest"))
    rest = point.schema["_rest"].dataType
    start = run_table.select("entity", "shape", "bucket", F.col("lo").alias("n"), F.lit(0).alias("_is_ref"), F.col("hi").alias("_hi"), F.col("kind").alias("_kind"), F.lit(None).cast(rest).alias("_rest"))
    w = W.partitionBy("entity", "shape", "bucket").orderBy("n", "_is_ref").rowsBetween(W.unboundedPreceding, 0)
    both = point.unionByName(start)
    last = both.withColumn("_run", F.last(F.when(F.col("_is_ref") == 0, F.struct("_hi", "_kind")), ignorenulls=True).over(w)).where("_is_ref = 1")
    inside = F.col("n") <= F.col("_run._hi")
    return last.select("entity", "shape", "n", *[F.col("_rest")[c].alias(c) for c in cols], F.when(inside, F.col("_run._kind")).alias("kind"))


def _states(points: DataFrame, changes: DataFrame, group: list[str], at: str) -> DataFrame:
    """points with `state`, the op of the last change at or before `at`; null before any."""
    cols = [c for c in points.columns if c not in (*group, at)]
    p = points.select(*group, F.col(at), F.lit(1).alias("_is_ref"), F.struct(*cols).alias("_rest"), F.lit(None).cast("string").alias("_op"))
    c = changes.select(*group, F.col(at), F.lit(0).alias("_is_ref"), F.lit(None).cast(p.schema["_rest"].dataType).alias("_rest"), F.col("op").alias("_op"))
    w = W.partitionBy(*group).orderBy(at, "_is_ref").rowsBetween(W.unboundedPreceding, 0)
    done = p.unionByName(c).withColumn("state", F.last("_op", ignorenulls=True).over(w)).where("_is_ref = 1")
    return done.select(*group, at, *[F.col("_rest")[x].alias(x) for x in cols], "state")


def _reason(state: str) -> Column:
    return F.when(F.col(state).isNull(), "early").when(F.col(state) == "remove", "removed")


def find_orphans(references: list[Reference], parents: DataFrame, log: DataFrame) -> DataFrame:
    """(tbl, fld, ref_key, period, reason), each row once.

    parents: (entity string, key string), the keys that stand. log: (entity string, key
    string, op string, seconds bigint), op `add` or `remove`; each change holds from its
    very second, of several in one second a removal holds. A key with log rows exists from
    an addition to the next removal; one without exists always if it is a parent. reason:
    `never` (neither parent nor in the log), `removed`, `early` (before its first change).

    Keys count without white space at their ends; null and blank keys are no references,
    parents or changes. Log rows with another op or without a time don't count. period is
    the UTC month; a reference without a time has a null period and can only be `never`.
    Repeated rows and empty tables are allowed; other columns don't matter."""
    spark = parents.sparkSession
    ship(spark)
    tidy = log.select("entity", clean_key("key").alias("key"), "op", "seconds").where(F.col("key").isNotNull() & F.col("op").isin("add", "remove") & F.col("seconds").isNotNull() & F.col("entity").isNotNull())
    changes = tidy.select("entity", *key_parts(F.col("key")), "seconds", "op").groupBy("entity", "shape", "n", "seconds").agg(F.max("op").alias("op")).withColumn("day", F.expr(DAY))
    standing = parents.select("entity", clean_key("key").alias("key")).where("key is not null").select("entity", *key_parts(F.col("key")), F.lit("static").alias("kind"))
    logged = changes.select("entity", "shape", "n", F.lit("logged").alias("kind"))
    known = standing.unionByName(logged).groupBy("entity", "shape", "n").agg(F.min("kind").alias("kind"))  # "logged" < "static"

    def timed(r: Reference) -> DataFrame:
        return r.rows.select(F.lit(r.tbl).alias("tbl"), F.lit(r.fld).alias("fld"), F.lit(r.entity).alias("entity"), clean_key(quoted(r.key)).alias("key"), r.seconds.cast("bigint").alias("seconds")).where("key is not null")

    def unite(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    refs = unite([timed(r) for r in references])
    by_day = refs.groupBy("tbl", "fld", "entity", "key", F.expr(DAY).alias("day")).agg(F.lit(1).alias("_")).select("tbl", "fld", "entity", "day", *key_parts(F.col("key")))
    # which keys are known at all: one row per field, key and day against the runs
    placed = cut(as_of_runs(by_day, runs(known)).where("kind is null or kind = 'logged'"))
    never = placed.where("kind is null").select("tbl", "fld", "entity", "shape", "n", "day", F.lit("never").alias("reason"))
    # the state in which a logged key enters the day
    to_check = placed.where("kind = 'logged' and day is not null").select("tbl", "fld", "entity", "shape", "n", "day")
    last_of_day = changes.groupBy("entity", "shape", "n", "day").agg(F.max_by("op", "seconds").alias("op"), F.lit(True).alias("changed"))
    entering = _states(to_check, last_of_day.withColumn("day", F.col("day") + 1).select("entity", "shape", "n", "day", "op"), ["entity", "shape", "n"], "day")
    entering = entering.join(last_of_day.select("entity", "shape", "n", "day", "changed"), ["entity", "shape", "n", "day"], "left")
    quiet = entering.where("changed is null").select("tbl", "fld", "entity", "shape", "n", "day", _reason("state").alias("reason")).where("reason is not null")
    # days with a change: by second
    busy = cut(entering.where("changed").withColumn("key", key_of()))
    days = busy.groupBy("entity", "key", "day").agg(F.first("shape").alias("shape"), F.first("n").alias("n"), F.first("state").alias("op"))
    start_of_day = days.select("entity", "key", "day", (F.col("day") * 86400 - 1).alias("seconds"), F.coalesce("op", F.lit("none")).alias("op"))
    pairs = sized_broadcast(days.select("entity", "key", "day"), busy.count())
    exact = refs.where("seconds is not null").withColumn("day", F.expr(DAY)).join(pairs, ["entity", "key", "day"], "left_semi").distinct()
    events = changes.withColumn("key", key_of()).select("entity", "key", "day", "seconds", "op").join(pairs, ["entity", "key", "day"], "left_semi").unionByName(start_of_day)
    busy_state = _states(exact, events, ["entity", "key", "day"], "seconds")
    loud = busy_state.select("tbl", "fld", "key", "day", F.when(F.col("state") == "none", "early").when(F.col("state") == "remove", "removed").alias("reason")).where("reason is not null")
    found = unite([never.unionByName(quiet).select("tbl", "fld", key_of().alias("key"), "day", "reason"), loud])
    period = F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM")
    return found.select("tbl", "fld", F.col("key").alias("ref_key"), period.alias("period"), "reason").distinct()
