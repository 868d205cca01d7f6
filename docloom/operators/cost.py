"""Usage, spend, budgets and alerts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import budget_state, price
from ..session import stored

BUDGET, SILENCE = 10.0, timedelta(hours=24)


def stored_cost(provider: Column, model: Column, operation: Column, tokens: Column) -> Column:
    """The price as it is stored: rounded half up to four places, request by request."""
    return F.round(price(provider, model, operation, tokens).cast("decimal(30,12)"), 4).cast("decimal(10,4)")


def tracked(usage: DataFrame) -> DataFrame:
    """Usage with cost_usd; the local embedder isn't tracked."""
    return usage.filter(F.col("provider") != "ollama").withColumn("cost_usd", stored_cost(F.col("provider"), F.col("model"), F.col("operation"), F.col("tokens_used")))


def spend_since_month(usage: DataFrame, as_of: Column) -> DataFrame:
    return usage.filter(F.col("created_at") >= F.date_trunc("month", as_of)).agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("spend"))


def spend_of_day(usage: DataFrame, day: Column) -> DataFrame:
    start = F.date_trunc("day", day)
    return usage.filter((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 1 DAY"))).agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("spend"))


def breakdown(usage: DataFrame, start: Column, end: Column) -> DataFrame:
    """Requests, tokens and costs by provider and operation of the closed range, the costliest first."""
    inside = usage.filter(F.col("created_at").between(start, end))
    sums = inside.groupBy("provider", "operation").agg(
        F.count("*").alias("request_count"), F.sum("tokens_used").alias("total_tokens"), F.sum("cost_usd").alias("total_cost"), F.avg("cost_usd").alias("avg_cost_per_request")
    )
    return sums.orderBy(F.desc("total_cost"), "provider", "operation")


def share(parts: DataFrame) -> DataFrame:
    """parts with percentage, each one's rounded share of all cost; 0 if there is none. The total is one row, joined."""
    total = parts.agg(F.sum("total_cost").alias("__total"))
    return parts.crossJoin(F.broadcast(total)).withColumn("percentage", F.when(F.coalesce(F.col("__total"), F.lit(0)) == 0, 0).otherwise(F.floor(F.col("total_cost") / F.col("__total") * 100 + 0.5)).cast("int")).drop("__total")


def summary(spend: DataFrame, budget: float = BUDGET) -> DataFrame:
    """current_spend, budget, percentage, remaining, state."""
    s = F.col("spend").cast("double")
    return spend.select(s.alias("current_spend"), F.lit(float(budget)).alias("budget"), (s / budget * 100).alias("percentage"), F.greatest(F.lit(0.0), budget - s).alias("remaining"), budget_state(s, budget).alias("state"))


def valid_budget(text: str | None) -> float | None:
    """The budget that a setting gives: the default if unset; None if it is no number, and then no alert fires."""
    if text is None or not text.strip():
        return BUDGET
    try:
        value = float(text)
    except ValueError:
        return None
    return value if value == value else None


def new_alerts(candidates: DataFrame, alerts: DataFrame) -> DataFrame:
    """candidates (alert_type, period, triggered_at) without those that a stored alert of their type and period precedes by
    less than a day."""
    c, a = candidates.alias("c"), alerts.alias("a")
    near = (F.col("a.alert_type") == F.col("c.alert_type")) & (F.col("a.period") == F.col("c.period")) & (F.col("a.triggered_at") > F.col("c.triggered_at") - F.expr("INTERVAL 24 HOURS"))
    return c.join(a, near, "left_anti")


def over_budget(usage: DataFrame, budget: float) -> DataFrame:
    """alert_type, created_at, usage_id, current_spend_usd of every request after which the month's spend so far passes a
    threshold. Spend is summed by hour and then within hours, so no task has more than an hour's requests."""
    hour = F.date_trunc("hour", "created_at")
    month = Window.partitionBy(F.date_trunc("month", "hour")).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    before = usage.groupBy(hour.alias("hour")).agg(F.sum("cost_usd").alias("s")).select("hour", F.coalesce(F.sum("s").over(month), F.lit(0)).alias("before"))
    within = Window.partitionBy("hour").orderBy("created_at", "usage_id").rowsBetween(Window.unboundedPreceding, 0)
    spent = usage.withColumn("hour", hour).withColumn("so_far", F.sum("cost_usd").over(within)).join(before, "hour")
    total = (F.col("before") + F.col("so_far")).cast("double")
    return spent.select(budget_state(total, budget).alias("alert_type"), "created_at", "usage_id", total.alias("current_spend_usd")).filter("alert_type is not null")


def replay_alerts(usage: DataFrame, budget: float = BUDGET, silence: timedelta = SILENCE) -> DataFrame:
    """The alerts that a log of usage would have raised: after each request the month's spend so far is held against the
    budget, and an alert is silent if one of its type was raised less than `silence` before. The requests that pass a
    threshold are written, sorted by time; then each step finds, for every type at once, the first of them that is at
    least `silence` after the last alert. There are as many steps as a type has alerts, at most one for each `silence`
    that the log spans; a step reads only what lies after the earliest last alert."""
    spark, kind = usage.sparkSession, dict(usage.dtypes)["created_at"]
    over = stored(over_budget(usage, budget).orderBy("created_at"), "over-budget")
    first = F.min(F.struct("created_at", "usage_id", "current_spend_usd")).alias("x")
    raised, last = [], {}
    while True:
        ready = F.lit(not raised)
        for k, t in last.items():
            then = F.lit(str(t + silence)).cast(kind) if kind == "timestamp_ntz" else F.lit(t + silence)
            ready = ready | (F.col("alert_type") == k) & (F.col("created_at") >= then)
        found = [(r["alert_type"], *r["x"]) for r in over.filter(ready).groupBy("alert_type").agg(first).collect()]
        if not found:
            break
        raised += found
        last = {k: t for k, t, *_ in found}  # a type without another alert is done
    return spark.createDataFrame(raised, f"alert_type string, triggered_at {kind}, usage_id long, current_spend_usd double")


def recent_alerts(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return alerts.orderBy(F.desc("triggered_at"), "alert_type").limit(min(max(int(limit), 1), 50))


def default_range(as_of: datetime) -> tuple[datetime, datetime]:
    return as_of - timedelta(days=30), as_of
