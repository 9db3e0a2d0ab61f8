"""Common table expressions shared by the SQL statements.

Money is in whole cents and index values in millionths, so that half-even
rounding of quotients is exact integer arithmetic.
"""

from __future__ import annotations


def he(top: str, bottom: str) -> str:
    """Half-even quotient of a non-negative and a positive whole number."""
    t, b = f"({top})", f"({bottom})"
    return (
        f"({t} // {b} + CASE WHEN 2 * ({t} % {b}) > {b} OR "
        f"(2 * ({t} % {b}) = {b} AND ({t} // {b}) % 2 = 1) THEN 1 ELSE 0 END)"
    )


def hes(top: str, bottom: str) -> str:
    """Half-even quotient where the top may be negative."""
    return f"(CASE WHEN ({top}) < 0 THEN -1 ELSE 1 END * {he(f'abs({top})', bottom)})"


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


_FARE = he("CAST(round(l_extendedprice * 100) AS BIGINT)", "CAST(l_quantity AS BIGINT)")
_D = "CAST(round(l_discount * 100) AS BIGINT)"
_T = "CAST(round(l_tax * 100) AS BIGINT)"

PARTS: dict[str, tuple[list[str], str]] = {
    "line": ([], f"""
      SELECT sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
               strftime(l_shipdate, '%Y-%m-%d'))) AS quote_id,
             rs.r_name AS source, rs.r_name AS origin, rc.r_name AS destination,
             l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key,
             o_orderstatus AS order_status,
             rs.r_name || '-' || rc.r_name AS route,
             CASE left(o_orderpriority, 1) WHEN '1' THEN 'T1' WHEN '2' THEN 'T7' WHEN '3' THEN 'T21'
                  WHEN '4' THEN 'T30' ELSE 'T45' END AS bucket,
             lpad(replace(p_brand, 'Brand#', ''), 2, '0') AS carrier,
             p_type AS fare_brand, p_brand AS pair_key,
             {_FARE} AS fare_c, {_D} AS d, {_T} AS t,
             CAST(date_trunc('quarter', l_shipdate) AS DATE) AS collected_date,
             l_shipdate AS collected_at, o_orderdate AS departure_at,
             CAST(o_orderdate AS DATE) AS travel_date,
             CASE WHEN year(l_shipdate) = 1997 THEN 'SIMULATED_DEMO' ELSE 'LIVE_COLLECTED' END AS provenance
      FROM lineitem
      JOIN orders ON o_orderkey = l_orderkey
      JOIN customer ON c_custkey = o_custkey
      JOIN supplier ON s_suppkey = l_suppkey
      JOIN part ON p_partkey = l_partkey
      JOIN nation ns ON ns.n_nationkey = s_nationkey
      JOIN region rs ON rs.r_regionkey = ns.n_regionkey
      JOIN nation nc ON nc.n_nationkey = c_nationkey
      JOIN region rc ON rc.r_regionkey = nc.n_regionkey
      WHERE rs.r_name <> rc.r_name"""),
    "parts": (["line"], f"""
      SELECT *, CASE WHEN part_key % 10 <> 0 THEN carrier || part_key END AS flight_no,
             CASE WHEN d <> 0 OR t <> 0 THEN {he('fare_c * (100 - d)', '100')} END AS base_c,
             CASE WHEN d <> 0 OR t <> 0 THEN {he('fare_c * t', '100')} END AS tax_c
      FROM line"""),
    "q": (["parts"], """
      SELECT *, fare_c / 100.0 AS total_fare, base_c / 100.0 AS base_fare, tax_c / 100.0 AS taxes,
             CASE WHEN base_c IS NULL OR base_c + tax_c > fare_c THEN 'PARTIAL' ELSE 'COMPLETE' END AS quality_status,
             CASE WHEN base_c IS NULL OR base_c + tax_c > fare_c THEN 'LOW'
                  WHEN base_c + tax_c < fare_c THEN 'MEDIUM' ELSE 'HIGH' END AS component_confidence,
             CASE WHEN base_c IS NULL OR base_c + tax_c > fare_c THEN 'PARTIAL_COMPONENTS' ELSE 'NONE' END AS missing_reason
      FROM parts"""),
    "days": (["q"], """
      SELECT d, row_number() OVER (ORDER BY d) AS day_no, lag(d) OVER (ORDER BY d) AS prev_date,
             lead(d) OVER (ORDER BY d) AS next_date
      FROM (SELECT DISTINCT collected_date AS d FROM q)"""),
    "lowest": (["q"], """
      SELECT route, bucket, pair_key, collected_date AS d, min(fare_c) AS f, count(*) AS n
      FROM q GROUP BY ALL"""),
    "matched": (["lowest", "days"], """
      SELECT coalesce(c.route, p.route) AS route, coalesce(c.bucket, p.bucket) AS bucket,
             coalesce(c.pair_key, p.pair_key) AS pair_key, coalesce(c.d, p.obs_date) AS obs_date,
             p.f AS prev_c, c.f AS cur_c, coalesce(c.n, 0) AS n
      FROM lowest c
      FULL JOIN (SELECT l.*, days.next_date AS obs_date FROM lowest l JOIN days USING (d)
                 WHERE days.next_date IS NOT NULL) p
        ON c.route = p.route AND c.bucket = p.bucket AND c.pair_key = p.pair_key AND c.d = p.obs_date"""),
    "pairs": (["matched"], """
      SELECT *, (cur_c / 100.0) / (prev_c / 100.0) AS relative,
             ln((cur_c / 100.0) / (prev_c / 100.0)) AS lr,
             cur_c * 100 >= prev_c AND cur_c <= prev_c * 100 AS plausible
      FROM matched WHERE prev_c IS NOT NULL AND cur_c IS NOT NULL"""),
    "centre": (["pairs"], """
      SELECT route, bucket, obs_date, count(*) AS n, quantile_cont(lr, 0.05) AS p5,
             quantile_cont(lr, 0.95) AS p95, median(lr) AS med
      FROM pairs WHERE plausible GROUP BY ALL"""),
    "spread": (["centre"], """
      SELECT c.*, s.mad, s.mean_ad FROM centre c JOIN (
        SELECT route, bucket, obs_date, median(abs(lr - med)) AS mad, avg(abs(lr - med)) AS mean_ad
        FROM pairs JOIN centre USING (route, bucket, obs_date) WHERE plausible GROUP BY ALL)
        s USING (route, bucket, obs_date)"""),
    "scored": (["spread"], """
      SELECT p.*, n_all AS n_pairs, p5, p95, med, mad, mean_ad,
             coalesce(abs(lr - med) / CASE WHEN mad > 1e-12 THEN mad * 1.4826
                                           WHEN mean_ad > 1e-12 THEN mean_ad * 1.253314 END, 0.0) AS score,
             least(greatest(lr, p5), p95) AS clamped
      FROM pairs p JOIN (SELECT * RENAME (n AS n_all) FROM spread) USING (route, bucket, obs_date)
      WHERE plausible"""),
    "judged": (["scored"], """
      SELECT *, n_pairs < 5 AND abs(lr - clamped) > 1e-12 AS out_small,
             n_pairs >= 5 AND score > 3.5 AS out_large
      FROM scored"""),
    "raw": (["matched"], """
      SELECT route, bucket, obs_date, CAST(sum(n) AS BIGINT) AS raw_quotes,
             count(*) FILTER (prev_c IS NOT NULL AND cur_c IS NOT NULL) AS pairs
      FROM matched GROUP BY ALL"""),
    "stats": (["raw", "pairs"], """
      SELECT r.*, coalesce(k.accepted, 0) AS accepted, k.mean_log, k.var_log,
             r.pairs - coalesce(k.accepted, 0) AS rejected
      FROM raw r LEFT JOIN (
        SELECT route, bucket, obs_date, count(*) AS accepted, avg(lr) AS mean_log, var_samp(lr) AS var_log
        FROM pairs WHERE plausible GROUP BY ALL) k USING (route, bucket, obs_date)"""),
    "stats_reject": (["raw", "judged"], """
      SELECT r.*, coalesce(k.accepted, 0) AS accepted, k.mean_log,
             r.pairs - coalesce(k.accepted, 0) AS rejected
      FROM raw r LEFT JOIN (
        SELECT route, bucket, obs_date, count(*) AS accepted,
               avg(CASE WHEN n_pairs < 5 THEN clamped ELSE lr END) AS mean_log
        FROM judged WHERE NOT out_large GROUP BY ALL) k USING (route, bucket, obs_date)"""),
}


def chain_parts(stats: str, name: str, where: str = "") -> dict[str, tuple[list[str], str]]:
    """The recursive chain over a stats expression."""
    return {
        f"{name}_visits": ([stats], f"""
          SELECT route, bucket, obs_date, raw_quotes, accepted, rejected,
                 CASE WHEN accepted >= 3 THEN exp(mean_log) END AS gm,
                 row_number() OVER (PARTITION BY route, bucket ORDER BY obs_date) AS rn
          FROM {stats} WHERE raw_quotes > 0 {where}"""),
        f"{name}_links": ([f"{name}_visits"], f"""
          SELECT *, CAST(100.0 AS DOUBLE) AS idx, CAST(100.0 AS DOUBLE) AS held, CAST(NULL AS DOUBLE) AS prev
          FROM {name}_visits WHERE rn = 1
          UNION ALL
          SELECT v.*, round_even(l.held * v.gm, 6), coalesce(round_even(l.held * v.gm, 6), l.held), l.held
          FROM {name}_links l JOIN {name}_visits v
            ON v.route = l.route AND v.bucket = l.bucket AND v.rn = l.rn + 1"""),
        name: ([f"{name}_links"], f"""
          SELECT route, bucket, obs_date, idx AS index_value, prev AS prev_index_value, raw_quotes,
                 CASE WHEN prev IS NULL OR idx IS NULL THEN raw_quotes ELSE accepted END AS input_quote_count,
                 CASE WHEN prev IS NULL THEN 0 ELSE rejected END AS excluded_count,
                 CASE WHEN idx IS NULL THEN 1 ELSE 0 END AS insufficient,
                 CAST(round(idx * 1000000) AS HUGEINT) AS i6
          FROM {name}_links"""),
    }


PARTS.update(chain_parts("stats", "strata"))
PARTS.update(chain_parts("stats_reject", "strata_reject"))

PARTS["route_days"] = (["strata"], f"""
  SELECT route, obs_date, CAST({he('sum(166667 * i6)', '166667 * count(i6)')} AS HUGEINT) AS i6,
         count(i6) AS strata_computed, CAST(sum(insufficient) AS BIGINT) AS imputed_count,
         CAST(sum(input_quote_count) AS BIGINT) AS input_quote_count,
         CAST(sum(excluded_count) AS BIGINT) AS excluded_count,
         CAST(sum(raw_quotes) AS BIGINT) AS raw_quotes
  FROM strata GROUP BY route, obs_date""")
PARTS["routes"] = (["route_days"], """
  SELECT *, last_value(i6 IGNORE NULLS) OVER (PARTITION BY route ORDER BY obs_date
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p6
  FROM route_days""")
PARTS["traffic"] = (["q"], "SELECT route, count(*) AS volume FROM q GROUP BY route")
PARTS["shares"] = (["traffic"], f"""
  SELECT route, volume, CAST({he('volume * 100000000', '(SELECT sum(volume) FROM traffic)')} AS HUGEINT) AS s8
  FROM traffic""")
PARTS["weights"] = (["shares"], """
  SELECT route, s8 + CASE WHEN row_number() OVER (ORDER BY s8 DESC, route DESC) = 1
                          THEN 100000000 - sum(s8) OVER () ELSE 0 END AS w8
  FROM shares""")
PARTS["basket"] = (["routes", "weights"], """
  SELECT obs_date, route, w8, i6, p6 FROM routes JOIN weights USING (route) WHERE i6 IS NOT NULL""")
PARTS["sim_days"] = (["q"], """
  SELECT DISTINCT collected_date AS obs_date FROM q WHERE provenance = 'SIMULATED_DEMO'""")
PARTS["head_all"] = (["basket"], f"""
  SELECT obs_date, CAST({he('sum(w8 * i6)', 'sum(w8)')} AS HUGEINT) AS i6, count(*) AS routes_in_basket,
         sum(w8) AS w8, count(p6) = count(*) AS have_all
  FROM basket GROUP BY obs_date""")
PARTS["head_days"] = (["routes"], """
  SELECT obs_date, CAST(sum(raw_quotes) AS BIGINT) AS input_quote_count,
         CAST(sum(excluded_count) AS BIGINT) AS excluded_count,
         CAST(sum(imputed_count) AS BIGINT) AS imputed_count
  FROM routes GROUP BY obs_date""")
PARTS["headline"] = (["head_all", "head_days", "sim_days"], """
  SELECT d.*, h.i6, h.routes_in_basket, lag(h.i6) OVER (ORDER BY obs_date) AS p6
  FROM head_days d JOIN head_all h USING (obs_date)
  WHERE obs_date NOT IN (SELECT obs_date FROM sim_days)""")
PARTS["contrib"] = (["basket", "head_all"], f"""
  SELECT obs_date, route, b.w8, {hes('b.w8 * (b.i6 - b.p6)', 'h.w8')} AS c6
  FROM basket b JOIN head_all h USING (obs_date) WHERE h.have_all""")


def compose(select: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """A full statement: the named parts with what they need, then the select."""
    done: list[str] = []

    def need(name: str) -> None:
        if name in done:
            return
        for other in PARTS[name][0]:
            need(other)
        done.append(name)

    for name in names:
        need(name)
    tables = [f"{n} AS ({PARTS[n][1]})" for n in done]
    tables += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return ("WITH RECURSIVE " + ",\n".join(tables) + "\n" if tables else "") + select
