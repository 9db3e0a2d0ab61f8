"""Batch decisions over a table of planned fetches, from stored robots snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Floor of the delay, ceiling of the daily budget, snapshot ages.
MIN_DELAY_SECONDS = 5.0
DAILY_BUDGET = 200
SNAPSHOT_TTL_HOURS = 24
SNAPSHOT_STALE_DAYS = 7
API_TIERS = [1, 5]


def classify_snapshot(status: Column, body: Column) -> Column:
    """What a stored robots response means; a web page in its place counts as absent."""
    head = F.lower(F.substring(F.ltrim(F.coalesce(body, F.lit(""))), 1, 400))
    html = head.rlike(r"^(<!doctype|<html|<\?xml)") | head.contains("<head>")
    return (
        F.when(status.isNull(), "UNAVAILABLE")
        .when(status.isin(404, 410), "ABSENT")
        .when(status.isin(401, 403), "FORBIDDEN")
        .when(status.between(200, 299) & html, "ABSENT")
        .when(status.between(200, 299), "OK")
        .otherwise("UNAVAILABLE")
    )


def robots_rules(snapshots: DataFrame, agent: str) -> DataFrame:
    """Rules of the group that applies to ``agent``, one row per rule.

    Groups follow RFC 9309: consecutive user-agent lines share the rules below
    them, and the catch-all group applies only where no group names the agent. A
    Disallow written as a full URL is taken as its path and marked ``by_intent``;
    such a rule counts whatever group it is in. Needs source and body.
    """
    product = agent.split("/")[0].lower()
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    # A snapshot is one small text file; its lines are ordered within the source.
    order = Window.partitionBy("source").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = (
        snapshots.select("source", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
        .select("source", "pos",
                F.lower(F.trim(F.regexp_extract(line, r"^([A-Za-z-]+)\s*:", 1))).alias("field"),
                F.trim(F.regexp_extract(line, r"^[A-Za-z-]+\s*:(.*)$", 1)).alias("value"))
        .filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    )
    opens = (F.col("field") == "user-agent") & (
        F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent"
    )
    grouped = lines.withColumn("grp", F.sum(opens.cast("int")).over(upto))
    agents = grouped.filter(F.col("field") == "user-agent").groupBy("source", "grp").agg(
        F.bool_or(F.lower("value").isin(product)).alias("named"),
        F.bool_or(F.col("value") == "*").alias("wild"),
    )
    any_named = agents.groupBy("source").agg(F.bool_or("named").alias("any_named"))
    applies = (
        agents.join(any_named, "source")
        .filter(F.col("named") | (~F.col("any_named") & F.col("wild")))
        .select("source", "grp", F.lit(True).alias("applies"))
    )
    url = F.lower("value").rlike("^https?://")
    after_host = F.regexp_replace("value", r"(?i)^https?://[^/]*", "")
    return (
        grouped.filter(F.col("field") != "user-agent")
        .withColumn("by_intent", url & (F.col("field") == "disallow"))
        .join(applies, ["source", "grp"], "left")
        .filter(F.col("applies") | F.col("by_intent"))
        .select(
            "source", F.col("field").alias("rule"),
            F.when(F.col("by_intent"), F.when(after_host == "", "/").otherwise(after_host))
            .otherwise(F.col("value")).alias("value"),
            "by_intent",
        )
    )


def _rule_pattern(value: Column) -> Column:
    """A rule path as a regular expression: * is any run, a final $ anchors."""
    quoted = F.regexp_replace(value, r"([.+?^(){}\[\]|\\])", r"\\$1")
    starred = F.replace(quoted, F.lit("*"), F.lit(".*"))
    body = F.regexp_replace(starred, r"\$(?!$)", r"\\\$")
    return F.concat(F.lit("^"), body)


def path_verdicts(paths: DataFrame, snapshots: DataFrame, rules: DataFrame) -> DataFrame:
    """The deciding rule of each (source, path), and whether it allows the path.

    The longest matching rule wins and Allow wins a tie. Rules join by source; the
    rules of one source are the lines of one small file.
    """
    target = paths.join(snapshots.select("source", "outcome"), "source", "left")
    usable = rules.filter(F.col("rule").isin("allow", "disallow") & (F.col("value") != ""))
    stem = F.regexp_replace("value", "/+$", "")
    intent = F.col("by_intent") & (
        (F.col("path") == F.col("value")) | F.col("path").startswith(F.concat(stem, F.lit("/")))
    )
    plain = ~F.col("by_intent") & F.regexp_like("path", _rule_pattern(F.col("value")))
    rank = F.struct(F.length("value").alias("len"), (F.col("rule") == "allow").alias("allow"), "value")
    hits = (
        paths.join(usable, "source")
        .groupBy("source", "path")
        .agg(
            F.bool_or(intent).alias("intended"),
            F.max(F.when(plain, rank)).alias("best"),
        )
    )
    outcome = F.coalesce("outcome", F.lit("UNAVAILABLE"))
    ruled = outcome.isin("OK", "STALE")
    allowed = (
        F.when(outcome == "ABSENT", True)
        .when(~ruled, False)
        .when(F.coalesce("intended", F.lit(False)), False)
        .otherwise(F.coalesce("best.allow", F.lit(True)))
    )
    matched = (
        F.when(outcome == "ABSENT", "no rules published")
        .when(~ruled, F.concat(F.lit("rules "), F.lower(outcome)))
        .when(F.coalesce("intended", F.lit(False)), "disallowed by intent")
        .when(F.col("best").isNull(), "no rule matches")
        .otherwise(F.col("best.value"))
    )
    return target.join(hits, ["source", "path"], "left").select(
        "source", "path", outcome.alias("outcome"), allowed.alias("allowed"), matched.alias("matched_rule")
    )


def crawl_delays(rules: DataFrame) -> DataFrame:
    """Seconds to leave between requests of a source: the declared delay, at least the floor."""
    return rules.filter((F.col("rule") == "crawl-delay") & ~F.col("by_intent")).groupBy("source").agg(
        F.greatest(F.max(F.col("value").try_cast("double")), F.lit(MIN_DELAY_SECONDS)).alias("delay")
    )


def _admitted(eligible: DataFrame, delays: DataFrame, budget: int) -> DataFrame:
    """``fetch_id`` of the fetches that go out: each at least the delay after the one before, a budget a day.

    A fetch that is refused leaves no trace, so which ones go out follows from one
    another, also past midnight. What has to be walked through in order is cut down
    first, by combining aggregations:

    * of fetches planned at one moment only the first can go out;
    * a source's day is parted into cells as long as its delay. After the first
      cell that has fetches, of any two neighbouring ones at least one lets a fetch
      out, so later cells than 2 * budget + 1 cannot;
    * a day depends on the day before only if its first fetch comes within the
      delay after the last one kept there. Runs of such days are walked together.
    """
    # Whole microseconds keep the comparisons exact.
    gap = (F.coalesce("delay", F.lit(MIN_DELAY_SECONDS)) * 1_000_000).cast("long")
    timed = eligible.join(delays.select("source", "delay"), "source", "left").select(
        "source", "day", "fetch_id", gap.alias("gap"), F.unix_micros(F.col("planned_at").cast("timestamp")).alias("t"))
    moments = timed.groupBy("source", "day", "gap", "t").agg(F.min("fetch_id").alias("fetch_id")).withColumn(
        "cell", F.floor((F.col("t") - F.unix_micros(F.col("day").cast("timestamp"))) / F.col("gap")))
    # Cells are no shorter than the least delay: at most 17,280 a day.
    in_order = Window.partitionBy("source", "day").orderBy("cell")
    cells = moments.select("source", "day", "cell").distinct().withColumn("_no", F.row_number().over(in_order))
    kept = moments.join(cells.filter(F.col("_no") <= 2 * budget + 1).drop("_no"), ["source", "day", "cell"])
    days = kept.groupBy("source", "day", "gap").agg(
        F.array_sort(F.collect_list(F.struct("t", "fetch_id"))).alias("planned"))
    # One row a day from here on.
    by_day = Window.partitionBy("source").orderBy("day")
    before = F.lag(F.element_at("planned", -1)["t"]).over(by_day)
    apart = F.coalesce((F.element_at("planned", 1)["t"] >= before + F.col("gap")).cast("int"), F.lit(1))
    linked = days.withColumn("_apart", apart).withColumn("run", F.sum("_apart").over(by_day))
    runs = linked.groupBy("source", "run").agg(
        F.first("gap").alias("gap"), F.array_sort(F.collect_list(F.struct("day", "planned"))).alias("days"))

    def walk(state: Column, fetch: Column) -> Column:
        due = F.coalesce(fetch["t"] >= state["last"] + F.col("gap"), F.lit(True))
        out = F.struct(fetch["t"].alias("last"), F.concat(state["sent"], F.array(fetch["fetch_id"])).alias("sent"))
        return F.when(due & (F.size(state["sent"]) < budget), out).otherwise(state)

    kind = eligible.schema["fetch_id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")

    def walk_day(state: Column, day: Column) -> Column:
        sent = F.aggregate(day["planned"], F.struct(state["last"].alias("last"), none.alias("sent")), walk)
        return F.struct(sent["last"].alias("last"), F.concat(state["days"], F.array(sent["sent"])).alias("days"))

    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<array<{kind}>>").alias("days"))
    sent = F.aggregate("days", start, walk_day, lambda s: F.flatten(s["days"]))
    return runs.select(F.explode(sent).alias("fetch_id"))


def admission_verdicts(
    fetches: DataFrame, sources: DataFrame, verdicts: DataFrame, contact: str, budget: int = DAILY_BUDGET,
    delays: DataFrame | None = None,
) -> DataFrame:
    """The ordered decision for each planned fetch.

    Every check that does not depend on other fetches is a column. Of those
    otherwise allowed, a fetch is deferred if the source's delay (``delays``: source,
    delay in seconds; the floor where none is declared) has not passed since the last
    one that was allowed, or if the day's budget is used up.
    """
    if budget > DAILY_BUDGET or budget < 0:
        raise ValueError(f"the daily budget must be between 0 and {DAILY_BUDGET}")
    known = fetches.join(sources, "source", "left").join(
        verdicts.select("source", "path", "allowed", "matched_rule"), ["source", "path"], "left"
    )
    api = F.col("tier").isin(*API_TIERS)
    first = (
        F.when(~F.coalesce("enabled", F.lit(False)), "SKIPPED_DISABLED")
        .when(~F.coalesce("approved", F.lit(False)), "BLOCKED_UNREVIEWED")
        .when(F.lit(not contact), "BLOCKED_UNREVIEWED")
        .when(F.coalesce("base_url", F.lit("")) == "", "BLOCKED_UNREVIEWED")
        .when(~api & ~F.coalesce("allowed", F.lit(False)), "BLOCKED_ROBOTS")
    )
    judged = known.withColumn("decision", first).withColumn("day", F.to_date("planned_at"))
    if delays is None:
        delays = fetches.sparkSession.createDataFrame([], fetches.select("source").schema).withColumn("delay", F.lit(MIN_DELAY_SECONDS))
    sent = _admitted(judged.filter(F.col("decision").isNull()), delays, budget).withColumn("_sent", F.lit(True))
    return (
        judged.join(sent, "fetch_id", "left")
        .withColumn(
            "decision",
            F.coalesce("decision", F.when(F.col("_sent"), "ALLOWED").otherwise("DEFERRED_RATE_LIMIT")),
        )
        .withColumn(
            "matched_rule",
            F.when(api, F.concat(F.lit("api terms: "), F.coalesce("matched_rule", F.lit("-"))))
            .otherwise(F.col("matched_rule")),
        )
        .drop("_sent")
    )


def send_times(allowed: DataFrame, delays: DataFrame) -> DataFrame:
    """Earliest time of each allowed fetch when a source is left alone for its delay.

    With a constant delay d, the i-th fetch goes out at d*i plus the running
    maximum of (planned - d*j). The rows of a source-day are at most its budget.
    """
    order = Window.partitionBy("source", "day").orderBy("planned_at", "fetch_id")
    # Whole microseconds keep the running sums exact.
    gap = (F.coalesce("delay", F.lit(MIN_DELAY_SECONDS)) * 1_000_000).cast("long")
    rows = (
        allowed.join(delays, "source", "left")
        .withColumn("_gap", gap)
        .withColumn("_i", F.row_number().over(order) - 1)
        .withColumn("_t", F.unix_micros(F.col("planned_at").cast("timestamp")))
    )
    running = F.max(F.col("_t") - F.col("_gap") * F.col("_i")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("send_at", F.timestamp_micros(running + F.col("_gap") * F.col("_i")))
        .withColumn("delay", F.col("_gap") / 1_000_000)
        .drop("_i", "_t", "_gap")
    )


def snapshot_state(snapshots: DataFrame, now: Column) -> DataFrame:
    """Age of each source's newest snapshot: FRESH, STALE (still usable) or EXPIRED."""
    latest = snapshots.groupBy("source").agg(F.max("fetched_at").alias("fetched_at"))
    hours = (F.unix_timestamp(now) - F.unix_timestamp("fetched_at")) / 3600
    return latest.withColumn("age_hours", F.bround(hours, 1)).withColumn(
        "state",
        F.when(hours < SNAPSHOT_TTL_HOURS, "FRESH")
        .when(hours < SNAPSHOT_STALE_DAYS * 24, "STALE")
        .otherwise("EXPIRED"),
    )
