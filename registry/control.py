"""Publication control, request admission and incremental revision."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from indexwright.operators import constraints
from indexwright.operators.durable import settle
from indexwright.operators.elementary import stratum_index
from indexwright.operators.matching import collection_calendar
from indexwright.plans import admission, publication
from indexwright.plans.quality import mix
from indexwright.streaming import incremental
from registry.base import query
from registry.sql_parts import PARTS, compose, day

# -- publication -----------------------------------------------------------------------
# Every order is a figure; its status says how far it went. Keys ending in 3 are
# corrections of the key before them.

_FIGURES = {"fig": """
    SELECT CAST(o_orderkey AS VARCHAR) AS obs_id, o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderdate AS d,
           CASE WHEN left(o_orderpriority, 1) = '1' THEN 'HEADLINE' ELSE 'ROUTE' END AS level,
           CASE WHEN left(o_orderpriority, 1) = '1' THEN '' ELSE o_orderpriority END AS route,
           CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 AS v, o_orderkey % 10 = 3 AS fixes,
           o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 11 = 0) AS published,
           o_orderstatus = 'F' AND o_custkey % 7 = 0 AS withdrawn FROM orders""",
    # What the rules make of the events: first of figures, then of corrections by their target.
    "plain": """
    SELECT *, st IN ('P', 'F') AND k % 13 <> 0 AS signed, published AND st IN ('P', 'F') AND k % 13 <> 0 AND k % 17 <> 0 AS came_out FROM fig WHERE NOT fixes""",
    "fixed": """
    SELECT f.*, coalesce(p.came_out AND p.d + INTERVAL 2 DAY < f.d
                         AND (NOT (p.withdrawn AND p.k % 19 <> 0) OR p.d + INTERVAL 3 DAY >= f.d), FALSE) AS signed
    FROM fig f LEFT JOIN plain p ON p.k = f.k - 1 WHERE f.fixes""",
    "law": """
    SELECT *, came_out AND withdrawn AND k % 19 <> 0 AS gone FROM (
      SELECT * FROM plain UNION ALL SELECT *, published AND signed AS came_out FROM fixed)"""}


def _figures(t):
    o = t.table("orders")
    head = F.col("o_orderpriority").startswith("1")
    return o.select(
        F.col("o_orderkey").cast("string").alias("obs_id"), F.to_date("o_orderdate").alias("obs_date"),
        F.when(head, "HEADLINE").otherwise("ROUTE").alias("level"), F.when(~head, F.col("o_orderpriority")).alias("route"),
        F.lit(None).cast("string").alias("bucket"),
        (F.round(F.col("o_totalprice") * 100).cast("bigint").cast("decimal(16,0)") / 100).cast("decimal(12,2)").alias("index_value"),
        F.lit("m1").alias("methodology_version"), F.lit("w1").alias("weight_set_version"),
        F.when(F.col("o_orderkey") % 10 == 3, 2).otherwise(1).alias("revision"))


def _events(t):
    o = t.table("orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("st"),
        F.col("o_orderdate").cast("timestamp").alias("d"))
    fixes, k = F.col("k") % 10 == 3, F.col("k")
    published = (F.col("st") == "F") | ((F.col("st") == "O") & (k % 11 == 0))

    def at(days):
        return F.timestamp_add("DAY", F.lit(days), F.col("d"))

    def event(when, action, days, actor="sys", reason=None, scheduled=None, supersedes=None):
        def text(v):
            return v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string")
        return F.when(when, F.struct(
            at(days).alias("event_ts"), F.lit(action).alias("action"), text(actor).alias("actor"), text(reason).alias("reason"),
            (scheduled if scheduled is not None else F.lit(None).cast("timestamp")).alias("scheduled_at"),
            text(supersedes).alias("supersedes_id")))

    steps = F.array_compact(F.array(
        event(~fixes, "SUBMIT", 0),
        event(fixes, "REVISE", 0, "bob", "recomputed", supersedes=(k - 1).cast("string")),
        event(~fixes & F.col("st").isin("P", "F"), "APPROVE", 1, F.when(k % 13 == 0, " ").otherwise("ann"),
              scheduled=F.when(k % 17 == 0, at(5))),
        event(published, "PUBLISH", 2),
        event((F.col("st") == "F") & (F.col("c") % 7 == 0), "WITHDRAW", 3, "ann", F.when(k % 19 != 0, "broken input"))))
    return o.select(k.cast("string").alias("obs_id"), F.explode(steps).alias("e")).select("obs_id", "e.*")


@query("k1_transition_violations", compose("""
    SELECT obs_id, 'APPROVE' AS action, 'UNNAMED_APPROVER' AS violation FROM law WHERE NOT fixes AND st IN ('P', 'F') AND k % 13 = 0
    UNION ALL SELECT obs_id, 'REVISE', 'TARGET_NOT_PUBLISHED' FROM law WHERE fixes AND NOT signed
    UNION ALL SELECT obs_id, 'PUBLISH', CASE WHEN signed THEN 'EARLY_RELEASE' ELSE 'NOT_APPROVED' END FROM law WHERE published AND NOT came_out
    UNION ALL SELECT obs_id, 'WITHDRAW', CASE WHEN k % 19 = 0 THEN 'NO_REASON' ELSE 'NOT_PUBLISHED' END FROM law WHERE withdrawn AND NOT gone
    """, extra=_FIGURES))
def _(t):
    return publication.transition_violations(_events(t)).select("obs_id", "action", "violation")


_CURRENT = """f.came_out AND NOT f.gone AND NOT EXISTS (SELECT 1 FROM law n WHERE n.fixes AND n.signed AND n.k = f.k + 1)"""


@query("k2_current_published", compose(f"""
    SELECT obs_id, {day('d')} AS obs_date, v AS index_value,
           CASE WHEN fixes THEN 'bob' ELSE 'ann' END AS approved_by,
           strftime(d + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS published_at,
           CAST(fixes AS BIGINT) AS is_revised, CASE WHEN fixes THEN 'recomputed' END AS revision_reason
    FROM law f WHERE level = 'HEADLINE' AND {_CURRENT}""", extra=_FIGURES))
def _(t):
    return publication.current_published(_figures(t), _events(t), "HEADLINE").select(
        "obs_id", "obs_date", "index_value", "approved_by", "published_at", "is_revised", "revision_reason")


@query("k3_published_as_of", compose("""
    SELECT obs_id, v AS index_value FROM law f
    WHERE came_out AND d + INTERVAL 2 DAY <= TIMESTAMP '1998-01-01' AND NOT (gone AND d + INTERVAL 3 DAY <= TIMESTAMP '1998-01-01')
      AND NOT EXISTS (SELECT 1 FROM law n WHERE n.fixes AND n.signed AND n.k = f.k + 1 AND n.d <= TIMESTAMP '1998-01-01')""", extra=_FIGURES))
def _(t):
    moment = F.lit("1998-01-01 00:00:00").cast("timestamp")
    return publication.current_published(_figures(t), _events(t), as_of=moment).select("obs_id", "index_value")


# A correction claims its figure from the moment it is signed, which is never before the figure came out.
_STANDING = {**_FIGURES, "standing": """
    SELECT f.*, f.d + INTERVAL 2 DAY AS since, coalesce(n.d, CASE WHEN f.gone THEN f.d + INTERVAL 3 DAY END) AS until
    FROM law f LEFT JOIN law n ON n.fixes AND n.signed AND n.k = f.k + 1 WHERE f.came_out"""}


@query("k3_standing_periods", compose("""
    SELECT obs_id, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, strftime(until, '%Y-%m-%d %H:%M:%S') AS until,
           CASE WHEN fixes THEN 'bob' ELSE 'ann' END AS approved_by, CASE WHEN fixes THEN CAST(k - 1 AS VARCHAR) END AS supersedes_id
    FROM standing WHERE until IS NULL OR since < until""", extra=_STANDING))
def _(t):
    return publication.standing_periods(_events(t)).select("obs_id", "since", "until", "approved_by", "supersedes_id")


@query("k3_published_month_ends", compose("""
    SELECT strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, level, count(*) AS figures, CAST(sum(CAST(fixes AS BIGINT)) AS BIGINT) AS corrections,
           CAST(sum(CAST(round(v * 100) AS BIGINT)) AS BIGINT) AS hundredths
    FROM (SELECT DISTINCT CAST(last_day(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS moment FROM orders) m
    JOIN standing s ON s.since <= m.moment AND (s.until IS NULL OR s.until > m.moment)
    GROUP BY moment, level""", extra=_STANDING))
def _(t):
    ends = t.table("orders").select(F.last_day(F.to_date("o_orderdate")).cast("timestamp").alias("moment"))
    return publication.published_at(_figures(t), _events(t), ends).groupBy("moment", "level").agg(
        F.count("*").alias("figures"), F.sum(F.col("is_revised").cast("bigint")).alias("corrections"),
        F.sum((F.col("index_value") * 100).cast("bigint")).alias("hundredths"))


@query("j4_superseded_excluded", compose(f"""
    SELECT level, count(*) AS published, CAST(sum(CASE WHEN {_CURRENT} THEN 1 ELSE 0 END) AS BIGINT) AS standing
    FROM law f WHERE came_out AND NOT gone GROUP BY level""".replace("NOT EXISTS (SELECT 1 FROM law n WHERE n.fixes AND n.signed AND n.k = f.k + 1)",
                                                                     "f.k + 1 NOT IN (SELECT k FROM law WHERE fixes AND signed)"), extra=_FIGURES))
def _(t):
    figures, events = _figures(t), _events(t)
    states = publication.publication_state(events).filter("state = 'PUBLISHED'")
    everything = figures.join(states, "obs_id").groupBy("level").agg(F.count("*").alias("published"))
    standing = publication.current_published(figures, events).groupBy("level").agg(F.count("*").alias("standing"))
    return everything.join(standing, "level")


@query("k4_published_export", compose(f"""
    SELECT 'D' AS "FREQ", {day('d')} AS "TIME_PERIOD", level AS "LEVEL", route AS "ROUTE", '' AS "LEAD_TIME", v AS "OBS_VALUE",
           'm1' AS "METHODOLOGY_VERSION", 'w1' AS "WEIGHT_SET_VERSION", CAST(CASE WHEN fixes THEN 2 ELSE 1 END AS BIGINT) AS "REVISION",
           'PUBLISHED' AS "OBS_STATUS" FROM law WHERE level = 'ROUTE' AND came_out AND NOT gone""", extra=_FIGURES))
def _(t):
    return publication.published_export(_figures(t), _events(t), "ROUTE").drop("STD_ERROR", "PROVENANCE")


# -- admission ---------------------------------------------------------------------------
# Users stand for sources, their events for planned fetches.

_AGENT = "indexbot/1.0"


# What the records of the events break when every event is taken as it came.
_RECORDS = {**_FIGURES, "record": """
    SELECT obs_id, NOT fixes AND ((st IN ('P', 'F') AND k % 13 = 0) OR (st = 'O' AND published)) AS unsigned_, withdrawn AND k % 19 = 0 AS unreasoned FROM fig"""}


@query("p7_publication_constraints", compose("""
    SELECT r.rule, CASE r.rule WHEN 'approval_is_attributed' THEN (SELECT count(*) FROM record WHERE unsigned_)
                               WHEN 'withdrawal_has_reason' THEN (SELECT count(*) FROM record WHERE unreasoned) ELSE 0 END AS violations
    FROM (VALUES ('state_known'), ('approval_is_attributed'), ('revision_has_reason'), ('withdrawal_has_reason')) r(rule)""", extra=_RECORDS))
def _(t):
    return constraints.check(publication.recorded_publications(_events(t)), constraints.publication_rules())


@query("p7_quarantined_publications", compose("""
    SELECT obs_id, concat_ws(',', CASE WHEN unsigned_ THEN 'approval_is_attributed' END, CASE WHEN unreasoned THEN 'withdrawal_has_reason' END) AS broken_rules
    FROM record WHERE unsigned_ OR unreasoned""", extra=_RECORDS))
def _(t):
    return constraints.quarantine(publication.recorded_publications(_events(t)), constraints.publication_rules()).select("obs_id", "broken_rules")


def _snapshots(t):
    users = t.table("events").groupBy(F.col("user_id").alias("source")).agg(F.max(F.col("ts").cast("timestamp")).alias("fetched_at"))
    kind = F.col("source") % 6
    status = F.when(kind == 1, 404).when(kind == 2, 403).otherwise(200)
    body = (
        F.when(kind == 3, "<!DOCTYPE html>\n<html><head></head></html>")
        .when(kind == 4, "User-agent: *  # everyone\nDisallow: https://x.example/private\n")
        .when(kind == 5, "User-agent: other\nUser-agent: IndexBot\nDisallow: /\n\nUser-agent: *\nDisallow:\n")
        .otherwise("User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 14400\n"))
    out = users.withColumn("status", status).withColumn("body", body)
    return out.withColumn("outcome", admission.classify_snapshot(F.col("status"), F.col("body")))


def _fetches(t):
    path = (F.when(F.col("event_type") == "view", "/search").when(F.col("event_type") == "click", "/private/x")
            .when(F.col("event_type") == "purchase", "/private/open/y").when(F.col("event_type") == "signup", "/a/b.pdf").otherwise("/private"))
    return t.table("events").select(F.col("event_id").alias("fetch_id"), F.col("user_id").alias("source"), path.alias("path"),
                                    F.col("ts").cast("timestamp").alias("planned_at"))


def _rules(t):
    return admission.robots_rules(_snapshots(t).filter("outcome = 'OK'"), _AGENT)


def _verdict(t):
    return admission.path_verdicts(_fetches(t).select("source", "path").distinct(), _snapshots(t), _rules(t))


_ADMIT = {
    "wanted": """SELECT event_id AS fetch_id, user_id AS source, user_id % 6 AS kind, ts,
        CASE event_type WHEN 'view' THEN '/search' WHEN 'click' THEN '/private/x' WHEN 'purchase' THEN '/private/open/y'
             WHEN 'signup' THEN '/a/b.pdf' ELSE '/private' END AS path FROM events""",
    "verdict": """SELECT *, CASE WHEN kind IN (1, 3) THEN TRUE WHEN kind = 2 THEN FALSE
             WHEN kind = 4 THEN NOT starts_with(path, '/private') WHEN kind = 5 THEN FALSE
             ELSE path IN ('/search', '/private/open/y') END AS allowed,
        CASE WHEN kind IN (1, 3) THEN 'no rules published' WHEN kind = 2 THEN 'rules forbidden'
             WHEN kind = 4 THEN CASE WHEN starts_with(path, '/private') THEN 'disallowed by intent' ELSE 'no rule matches' END
             WHEN kind = 5 THEN '/' WHEN path = '/search' THEN 'no rule matches' WHEN path = '/private/open/y' THEN '/private/open'
             WHEN path = '/a/b.pdf' THEN '/*.pdf$' ELSE '/private' END AS matched_rule FROM wanted""",
    "first": """SELECT *, CASE WHEN source % 10 = 0 THEN 'SKIPPED_DISABLED' WHEN source % 9 = 0 OR source % 13 = 0 THEN 'BLOCKED_UNREVIEWED'
             WHEN source % 8 <> 0 AND NOT allowed THEN 'BLOCKED_ROBOTS' END AS early FROM verdict""",
    # Fetch after fetch of a source: the last one that went out, and how many did on its day.
    "queue": """SELECT fetch_id, source, ts, CAST(ts AS DATE) AS day, CASE WHEN kind = 0 THEN 14400000000 ELSE 5000000 END AS gap,
             row_number() OVER (PARTITION BY source ORDER BY ts, fetch_id) AS no FROM first WHERE early IS NULL""",
    "walk": """SELECT fetch_id, source, no, day, epoch_us(ts) AS last, 1 AS used, TRUE AS sent FROM queue WHERE no = 1
             UNION ALL
             SELECT fetch_id, source, no, day, CASE WHEN sent THEN t ELSE last END, used + CASE WHEN sent THEN 1 ELSE 0 END, sent FROM (
               SELECT q.fetch_id, q.source, q.no, q.day, w.last, epoch_us(q.ts) AS t, CASE WHEN q.day = w.day THEN w.used ELSE 0 END AS used,
                      epoch_us(q.ts) >= w.last + q.gap AND (q.day <> w.day OR w.used < 2) AS sent
               FROM walk w JOIN queue q ON q.source = w.source AND q.no = w.no + 1)""",
    "decided": """SELECT f.*, coalesce(f.early, CASE WHEN w.sent THEN 'ALLOWED' ELSE 'DEFERRED_RATE_LIMIT' END) AS decision
             FROM first f LEFT JOIN walk w ON w.fetch_id = f.fetch_id""",
}


def _decisions(t):
    sources = t.table("events").select(F.col("user_id").alias("source")).distinct().select(
        "source", (F.col("source") % 10 != 0).alias("enabled"), (F.col("source") % 9 != 0).alias("approved"),
        F.when(F.col("source") % 13 == 0, "").otherwise("https://x.example").alias("base_url"),
        F.when(F.col("source") % 8 == 0, 1).otherwise(3).alias("tier"))
    return admission.admission_verdicts(_fetches(t), sources, _verdict(t), "https://contact.example", budget=2,
                                        delays=admission.crawl_delays(_rules(t)))


@query("r1_robots_rules", """
    SELECT source, rule, value, by_intent FROM (SELECT DISTINCT user_id AS source, user_id % 6 AS kind FROM events) s
    JOIN (VALUES (0, 'disallow', '/private', 0), (0, 'allow', '/private/open', 0), (0, 'disallow', '/*.pdf$', 0), (0, 'crawl-delay', '14400', 0),
                 (4, 'disallow', '/private', 1), (5, 'disallow', '/', 0)) r(kind, rule, value, bi) USING (kind),
         LATERAL (SELECT CAST(bi AS BIGINT) AS by_intent)""")
def _(t):
    return _rules(t)


@query("r1_snapshot_outcomes", """
    SELECT DISTINCT user_id AS source, CASE user_id % 6 WHEN 1 THEN 'ABSENT' WHEN 2 THEN 'FORBIDDEN' WHEN 3 THEN 'ABSENT' ELSE 'OK' END AS outcome FROM events""")
def _(t):
    return _snapshots(t).select("source", "outcome")


@query("r2_path_verdicts", compose(
    "SELECT DISTINCT source, path, CAST(allowed AS BIGINT) AS allowed, matched_rule FROM verdict", extra=_ADMIT))
def _(t):
    return _verdict(t).select("source", "path", "allowed", "matched_rule")


@query("r3_admission_verdicts", compose("SELECT fetch_id, source, path, decision FROM decided", extra=_ADMIT))
def _(t):
    return _decisions(t).select("fetch_id", "source", "path", "decision")


@query("r4_send_times", compose("""
    SELECT fetch_id, strftime(make_timestamp(CAST(max(epoch_us(ts) - gap * i) OVER (PARTITION BY source, CAST(ts AS DATE) ORDER BY ts, fetch_id) + gap * i AS BIGINT)),
           '%Y-%m-%d %H:%M:%S') AS send_at
    FROM (SELECT *, CASE WHEN kind = 0 THEN 14400000000 ELSE 5000000 END AS gap,
                 row_number() OVER (PARTITION BY source, CAST(ts AS DATE) ORDER BY ts, fetch_id) - 1 AS i FROM decided WHERE decision = 'ALLOWED')""",
    extra=_ADMIT))
def _(t):
    allowed = _decisions(t).filter("decision = 'ALLOWED'")
    return admission.send_times(allowed, admission.crawl_delays(_rules(t))).select("fetch_id", "send_at")


@query("r5_decision_mix", compose("SELECT decision, count(*) AS rows FROM decided GROUP BY ALL", extra=_ADMIT))
def _(t):
    return mix(_decisions(t), "decision")


@query("r5_snapshot_state", """
    SELECT source, age_hours, CASE WHEN raw < 24 THEN 'FRESH' WHEN raw < 168 THEN 'STALE' ELSE 'EXPIRED' END AS state
    FROM (SELECT user_id AS source, (epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts)))) / 3600 AS raw,
                 round_even((epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts)))) / 3600, 1) AS age_hours FROM events GROUP BY ALL)""")
def _(t):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return admission.snapshot_state(_snapshots(t), now).select("source", "age_hours", "state")


# -- incremental revision ------------------------------------------------------------------
# Stored: the index without the parts whose key ends in 00 or 50. These arrive late.

_NAMES = ["days", "lowest", "matched", "pairs", "raw", "stats", "strata_visits", "strata_links", "strata"]


def _earlier_parts() -> dict[str, str]:
    """The same chain over the quotes that were there before."""
    renamed = re.compile(r"\b(q|" + "|".join(_NAMES) + r")\b")
    bodies = {"q_0": "SELECT * FROM q WHERE part_key % 50 <> 0"}
    for name in _NAMES:
        bodies[f"{name}_0"] = renamed.sub(lambda m: m.group(1) + "_0", PARTS[name][1])
    return bodies


@query("st1_revised_strata", compose(f"""
    SELECT coalesce(n.route, o.route) AS route, coalesce(n.bucket, o.bucket) AS bucket, {day('coalesce(n.obs_date, o.obs_date)')} AS obs_date,
           n.index_value, CAST(CASE WHEN o.index_value IS NULL THEN 1 ELSE 2 END AS BIGINT) AS revision
    FROM strata n FULL JOIN strata_0 o ON o.route = n.route AND o.bucket = n.bucket AND o.obs_date = n.obs_date
    WHERE n.index_value IS DISTINCT FROM o.index_value
      AND EXISTS (SELECT 1 FROM q WHERE part_key % 50 = 0 AND q.route = coalesce(n.route, o.route) AND q.bucket = coalesce(n.bucket, o.bucket))""", "q", "strata", extra=_earlier_parts()))
def _(t):
    late = F.col("part_key") % 50 == 0
    stored = stratum_index(t.quotes.filter(~late)).filter("index_value is not null").select(
        "route", "bucket", "obs_date", "index_value", F.lit(1).alias("revision"))
    return incremental.revised_strata(t.quotes.filter(late), t.quotes, stored)


def _resumed(t):
    """What a batch with the late parts appends, and the chain states after it."""
    late = t.quotes.filter(F.col("part_key") % 50 == 0)
    earlier = t.quotes.filter(F.col("part_key") % 50 != 0)
    known = earlier.select("collected_date").distinct()
    stored = settle(stratum_index(earlier).filter("index_value is not null").select(
        "route", "bucket", "obs_date", "index_value", F.lit(1).alias("revision")), "stored")
    chains = settle(incremental.chain_states(stored).withColumn("batch", F.lit(0)), "chains")
    starts = settle(incremental.refold_starts(late, known, chains), "starts")
    first = starts.agg(F.min("start")).first()[0]
    if first is None:
        return stored.filter("false"), chains.drop("batch")
    fresh = settle(incremental.resumed_strata(starts, first, t.quotes, collection_calendar(t.quotes), chains), "fresh")
    rows = incremental.revisions(fresh, stored.join(starts, ["route", "bucket"]).filter("obs_date >= start"))
    after = incremental.chain_states(fresh, starts, chains).withColumn("batch", F.lit(1))
    return rows, incremental.newest_states(chains.unionByName(after)).filter("state is not null")


@query("st1_resumed_chains", compose(f"""
    SELECT coalesce(n.route, o.route) AS route, coalesce(n.bucket, o.bucket) AS bucket, {day('coalesce(n.obs_date, o.obs_date)')} AS obs_date,
           n.index_value, CAST(CASE WHEN o.index_value IS NULL THEN 1 ELSE 2 END AS BIGINT) AS revision
    FROM strata n FULL JOIN strata_0 o ON o.route = n.route AND o.bucket = n.bucket AND o.obs_date = n.obs_date
    WHERE n.index_value IS DISTINCT FROM o.index_value""", "q", "strata", extra=_earlier_parts()))
def _(t):
    return _resumed(t)[0]


@query("st1_chain_states", compose(f"""
    SELECT route, bucket, {day("date_trunc('month', obs_date)")} AS month, arg_max(index_value, obs_date) AS state
    FROM strata WHERE index_value IS NOT NULL GROUP BY ALL""", "q", "strata"))
def _(t):
    return _resumed(t)[1]
