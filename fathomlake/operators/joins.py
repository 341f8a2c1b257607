"""As-of, range, proximity and exclusion joins; each has an equality to shuffle on, and none is a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_id: str, seconds: int) -> DataFrame:
    """Each left row with the newest right row of its keys at or before it and at most so many seconds older; (time, id) break ties.

    Right rows are filed under the time slot of `seconds` that they are in and the next one, so a hot key is spread
    over its slots and a left row meets one slot only.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / F.lit(seconds * 1_000_000))
    spread = right.withColumn("slot_", F.explode(F.array(slot(F.col(right_time)), slot(F.col(right_time)) + 1)))
    found = left.withColumn("slot_", slot(F.col(left_time))).join(spread, [*keys, "slot_"], "left")
    gap = F.unix_micros(left_time) - F.unix_micros(right_time)
    ok = gap.between(0, seconds * 1_000_000)
    best = F.max_by(F.when(ok, F.col(right_id)), F.when(ok, F.struct(right_time, right_id)))
    return found.groupBy(*left.columns).agg(best.alias(right_id))


def new_rows(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known yet."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def supplement(rows: DataFrame, extra: DataFrame, query: str, key: str, position: str, most: int) -> DataFrame:
    """`rows`, then for each query at most `most` extra rows that it doesn't have, behind them and in their order."""
    fresh = new_rows(extra, rows, [query, key])
    w = Window.partitionBy(query).orderBy(position, key)
    fresh = fresh.withColumn("nth_", F.row_number().over(w)).where(F.col("nth_") <= most)
    last = rows.groupBy(query).agg(F.max(position).alias("last_"))
    fresh = fresh.join(last, query, "left").withColumn(position, F.coalesce("last_", F.lit(0)) + F.col("nth_"))
    return rows.unionByName(fresh.select(*rows.columns))


def years_apart(dates: DataFrame, subject: str, date: str, name: str, years: int) -> DataFrame:
    """Pairs of a subject's dates exactly so many years apart; the name only where the pairs agree on one."""
    later = dates.select(subject, F.add_months(F.col(date), -12 * years).alias("then_"), F.col(date).alias("later"), F.col(name).alias("later_name"))
    same_day = F.dayofmonth(date) == F.dayofmonth("later")
    earlier = dates.withColumn("then_", F.col(date))
    pairs = earlier.join(later, [subject, "then_"]).where(same_day)
    one = F.count_distinct("later_name") == 1
    return pairs.groupBy(subject).agg(F.count("*").alias("n_pairs"), F.when(one, F.min("later_name")).alias("name"))


def nearest_after(anchors: DataFrame, values: DataFrame, document: str, at: str, value: str, reach: int) -> DataFrame:
    """Of each anchor in a document, the nearest value (the smaller on ties) that begins within `reach` characters behind it; by bins of `reach`."""
    binned = values.select(document, F.col(at).alias("value_at"), value).withColumn("bin_", F.floor(F.col("value_at") / reach))
    spread = anchors.withColumn("bin_", F.explode(F.array(F.floor(F.col(at) / reach), F.floor(F.col(at) / reach) + 1)))
    pairs = spread.join(binned, [document, "bin_"]).where((F.col("value_at") > F.col(at)) & (F.col("value_at") - F.col(at) <= reach))
    return pairs.groupBy(*anchors.columns).agg(F.min_by(value, F.struct("value_at", value)).alias(value), F.min("value_at").alias("value_at"))


def live_sessions(sessions: DataFrame, users: DataFrame, session_user: str, user: str, expires: str, now: Column) -> DataFrame:
    """Sessions that have not expired with their users; expired ones go before the join."""
    return sessions.where(F.col(expires) > now).join(users, F.col(session_user) == F.col(user))
