"""Payload parsers, supplied files, reference series, planning and extracts.

Payloads are rendered from the quotes by Spark, one response per quote, and read
back by the parsers; the SQL states the rows that must come out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from indexwright.session import checkpoint_dir
from indexwright.functions.text import search_hash
from indexwright.operators import normalise as nq
from indexwright.operators.durable import settle
from indexwright.sources import payloads, planning, reference_series, sinks, supplied
from registry.base import query
from registry.sql_parts import compose, day

def _stored(frame):
    """Payloads as the parsers find them: a stored table."""
    return settle(frame, "payloads")


# -- availability and charges ------------------------------------------------------


def _charge(kind, code, amount):
    return F.struct(F.lit(kind).alias("type"), F.lit(code).alias("code"), amount.alias("amount"))


def _availability(t):
    """A wanted journey, a one-stop decoy and a child fare in every response."""
    q = t.quotes
    fee = F.lit("12.50").cast("decimal(12,2)")
    other = F.lit("3.25").cast("decimal(12,2)")
    charges = F.filter(
        F.array(
            _charge("FarePrice", "", F.col("base_fare")), _charge("Tax", "GST", F.col("taxes")),
            _charge("Charge", "udf", fee), _charge("Charge", "DUDF", fee),
            _charge("Charge", "NEWCODE", other), _charge("Charge", "CUTE", F.lit(None).cast("decimal(12,2)")),
        ),
        lambda c: c["amount"].isNotNull())
    # A column each, so that what a response holds several times is made once.
    q = q.withColumn("charges", charges)
    def pax(kind):
        return F.struct(F.lit(kind).alias("passengerType"), F.col("total_fare").alias("fareAmount"),
                        F.col("charges").alias("serviceCharges"))
    fares = F.struct(F.array(F.struct(
        F.col("fare_brand").alias("classOfService"), F.lit("P").alias("productClass"),
        F.array(pax("CHD"), pax("ADT")).alias("passengerFares"))).alias("fares"))
    q = q.withColumn("available", fares)
    available = F.array(F.struct(F.lit("k1").alias("key"), F.col("available").alias("value")),
                        F.struct(F.lit("k2").alias("key"), F.col("available").alias("value")))
    def journey(stops, destination, ref):
        segment = F.struct(F.struct(F.col("carrier").alias("carrierCode"),
                                    F.substring("flight_no", 3, 20).alias("identifier")).alias("identifier"))
        return F.struct(
            F.when(F.col("bucket") == "T45", "Connect").otherwise("NonStop").alias("flightType"),
            F.lit(stops).alias("stops"),
            F.struct(F.col("source").alias("origin"), destination.alias("destination"),
                     F.date_format("departure_at", "yyyy-MM-dd'T'HH:mm:ss").alias("departure")).alias("designator"),
            F.array(segment).alias("segments"),
            F.array(F.struct(F.lit(ref).alias("fareAvailabilityKey"))).alias("fares"))
    end = F.substring_index("route", "-", -1)
    market = F.struct(F.array(
        journey(1, end, "k1"), journey(0, end, "k2"), journey(0, F.lit("ELSEWHERE"), "k1"),
        journey(0, end, "missing")).alias("value"))
    results = F.array(F.struct(F.array(F.struct(F.array(market).alias("journeysAvailableByMarket"))).alias("trips")))
    body = F.to_json(F.struct(F.struct(available.alias("faresAvailable"), results.alias("results")).alias("data")))
    return q.select(F.col("quote_id").alias("response_id"), F.col("source").alias("origin"),
                    end.alias("destination"), body.alias("body"))


@query("s1_availability_json", compose("""
    SELECT quote_id AS response_id, CAST(0 AS BIGINT) AS ordinal, origin, destination, carrier, flight_no, fare_brand,
           total_fare FROM q WHERE flight_no IS NOT NULL AND bucket <> 'T45'""", "q"))
def _(t):
    parsed = payloads.availability_offers(_stored(_availability(t)))
    return parsed.select("response_id", "ordinal", "origin", "destination", "carrier", "flight_no", "fare_brand", "total_fare")


@query("s3_charge_split", compose("""
    SELECT quote_id AS response_id, base_fare, taxes, CAST(25.0 AS DOUBLE) AS udf, CAST(3.25 AS DOUBLE) AS convenience_fee
    FROM q WHERE flight_no IS NOT NULL AND bucket <> 'T45'""", "q"))
def _(t):
    parsed = payloads.availability_offers(_stored(_availability(t)))
    return parsed.select("response_id", "base_fare", "taxes", "udf", "convenience_fee")


# -- GDS -------------------------------------------------------------------------


def _gds(t):
    """Offers with one or two segments by bucket, some with an unreadable base."""
    q = t.quotes
    segment = F.struct(
        F.col("carrier").alias("carrierCode"), F.substring("flight_no", 3, 20).alias("number"),
        F.struct(F.date_format("departure_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at")).alias("departure"))
    segments = F.when(F.col("bucket") == "T30", F.array(segment, segment)).otherwise(F.array(segment))
    base = F.when(F.col("line_no") == 1, "n/a").otherwise(F.col("base_fare").cast("string"))
    total = F.col("total_fare").cast("string")
    price = F.struct(
        F.lit("INR").alias("currency"), F.lit("1.00").alias("total"),
        F.when(F.col("line_no") == 2, "").otherwise(total).alias("grandTotal"), base.alias("base"),
        F.array(F.struct(F.lit("7.50").alias("amount")), F.struct(F.lit("0").alias("amount"))).alias("fees"))
    detail = F.struct(
        F.when(F.col("part_key") % 2 == 0, F.col("fare_brand")).alias("brandedFare"),
        F.lit("BASIS").alias("fareBasis"))
    offer = F.struct(
        F.array(F.struct(segments.alias("segments"))).alias("itineraries"), price.alias("price"),
        F.array(F.struct(F.array(detail).alias("fareDetailsBySegment"))).alias("travelerPricings"))
    return q.select(F.col("quote_id").alias("response_id"), F.to_json(F.struct(F.array(offer).alias("data"))).alias("body"))


@query("s2_gds_json", compose("""
    SELECT quote_id AS response_id, CAST(0 AS BIGINT) AS ordinal, carrier, flight_no,
           CASE WHEN part_key % 2 = 0 THEN fare_brand ELSE 'BASIS' END AS fare_brand,
           CASE WHEN line_no = 2 THEN CAST(1.0 AS DOUBLE) ELSE total_fare END AS total_fare
    FROM q WHERE bucket <> 'T30'""", "q"))
def _(t):
    return payloads.gds_offers(_stored(_gds(t))).select(
        "response_id", "ordinal", "carrier", "flight_no", "fare_brand",
        F.col("total_fare").cast("decimal(12,2)").alias("total_fare"))


@query("s3b_derived_tax", compose("""
    SELECT quote_id AS response_id,
           CASE WHEN ok THEN base_c / 100.0 END AS base_fare,
           CASE WHEN ok AND tot_c - base_c - 750 >= 0 THEN (tot_c - base_c - 750) / 100.0 END AS taxes,
           CASE WHEN ok THEN CAST(7.5 AS DOUBLE) END AS convenience_fee
    FROM (SELECT *, line_no <> 1 AND base_c IS NOT NULL AS ok,
                 CASE WHEN line_no = 2 THEN 100 ELSE fare_c END AS tot_c FROM q WHERE bucket <> 'T30')""", "q"))
def _(t):
    return payloads.gds_offers(_stored(_gds(t))).select("response_id", "base_fare", "taxes", "convenience_fee")


# -- tariff tables and flat offers ---------------------------------------------------


@query("s4_tariff_html", compose("""
    SELECT quote_id AS response_id, sector, fare_category, amount / 100.0 AS declared_fare FROM (
      SELECT quote_id, route || ' & Co' AS sector, 'Saver' AS fare_category, fare_c AS amount FROM q
      UNION ALL SELECT quote_id, route || ' & Co', 'Flexi', fare_c // 100 * 100 FROM q WHERE part_key % 3 <> 0
      UNION ALL SELECT quote_id, route || ' & Co', 'col3', 120000 FROM q)
    WHERE amount BETWEEN 50000 AND 200000000""", "q"))
def _(t):
    fare = F.format_number(F.col("total_fare"), 2)
    whole = F.format_number(F.floor("total_fare"), 0)
    body = F.concat(
        F.lit("<html><table>\n<TR><th>Sector</th><th class='x'>Saver</th><th>Flexi</th></tr>\n<tr><td><b>"),
        F.col("route"), F.lit("</b> &amp; Co</td><td>&#8377; "), fare, F.lit("</td><td>"),
        F.when(F.col("part_key") % 3 != 0, F.concat(F.lit("&#x20B9;&nbsp;"), whole)).otherwise("N/A"),
        F.lit("</td><td>Rs 1,200 <i>(12)</i></td></tr>\n<tr><td></td><td>900</td></tr><tr><td>lonely</td></tr></table>"))
    pages = t.quotes.select(F.col("quote_id").alias("response_id"), body.alias("body"))
    return payloads.tariff_bands(_stored(pages)).select("response_id", "sector", "fare_category", "declared_fare")


@query("s4_page_rows", """
    SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>')) AS BIGINT) AS table_rows,
           CAST(len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>')) AS BIGINT) AS list_items FROM pages""")
def _(t):
    def found(tag):
        return F.size(F.regexp_extract_all("html", F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)))
    return t.table("pages").select("page_id", found("tr").alias("table_rows"), found("li").alias("list_items"))


@query("s5_flat_json", compose("""
    SELECT quote_id AS response_id, CAST(0 AS BIGINT) AS ordinal, carrier, flight_no, fare_brand, total_fare, 'INR' AS currency,
           CAST(0 AS BIGINT) AS stops, base_fare, taxes, 'SIMULATED_DEMO' AS provenance FROM q""", "q"))
def _(t):
    offer = F.struct(
        "carrier", F.col("flight_no").alias("flightNumber"), F.col("total_fare").alias("totalAmount"),
        F.col("currency").alias("currencyCode"), F.col("fare_brand").alias("fareBrand"), F.lit(0).alias("stops"),
        F.col("base_fare").alias("baseFare"), "taxes")
    stored = t.quotes.select(F.col("quote_id").alias("response_id"),
                             F.to_json(F.struct(F.array(offer).alias("offers"))).alias("body"))
    parsed = payloads.flat_offers(stored).drop("udf")
    return parsed.select(*[F.col(c).cast("decimal(12,2)").alias(c) if c in ("total_fare", "base_fare", "taxes") else F.col(c)
                           for c in parsed.columns])


@query("u1_registered_parser", compose(
    "SELECT carrier, count(*) AS offers, CAST(sum(fare_c) AS BIGINT) AS cents FROM q GROUP BY carrier", "q"))
def _(t):
    offer = F.struct("carrier", F.col("total_fare").alias("totalAmount"))
    stored = t.quotes.select(F.col("quote_id").alias("response_id"),
                             F.to_json(F.struct(F.array(offer).alias("offers"))).alias("body"))
    return payloads.parse_with("flat", stored).groupBy("carrier").agg(
        F.count("*").alias("offers"), (F.sum(F.col("total_fare").cast("decimal(12,2)")) * 100).cast("bigint").alias("cents"))


@query("s15_payload_hash", """
    SELECT conv_id, turn, sha256(text) AS payload_sha256 FROM conversations""")
def _(t):
    rows = t.table("conversations").select("conv_id", "turn", F.col("text").alias("body"))
    return payloads.content_hash(rows).select("conv_id", "turn", "payload_sha256")


# -- supplied CSV ------------------------------------------------------------------

_CODES = "CASE {c} WHEN 'AFRICA' THEN 'AFR' WHEN 'AMERICA' THEN 'AME' WHEN 'ASIA' THEN 'ASI' WHEN 'EUROPE' THEN 'EUR' ELSE 'MI3' END"
_HEADER = "travel_date,collected_date,origin,destination,carrier,total_fare,currency,fare_brand,flight_number"


def _supplied(t):
    """Lines of one supplied file per bucket; one file lacks a required column."""
    q = t.quotes
    def code(c):
        place = {"AFRICA": "afr", "AMERICA": "AME", "ASIA": "ASI", "EUROPE": "EUR"}
        out = F.lit("MI3")
        for name, short in place.items():
            out = F.when(c == name, short).otherwise(out)
        return out
    pick = F.col("part_key") % 4
    def written(d):
        return (F.when(pick == 0, F.date_format(d, "yyyy-MM-dd")).when(pick == 1, F.date_format(d, "dd/MM/yyyy"))
                .when(pick == 2, F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "dd-MMM-yyyy")))
    money = (F.when(F.col("part_key") % 23 == 0, "0").when(F.col("part_key") % 29 == 0, "abc")
             .when(F.col("part_key") % 31 == 0, " ")
             .otherwise(F.concat(F.lit('"₹ '), F.format_number(F.col("total_fare"), 2), F.lit('"'))))
    line = F.concat_ws(
        ",", written(F.col("travel_date")), written(F.col("collected_date")), code(F.col("source")),
        code(F.substring_index("route", "-", -1)), F.col("carrier"), money,
        F.when(F.col("part_key") % 17 == 0, "usd").otherwise("inr"),
        F.concat(F.lit('"'), F.col("fare_brand"), F.lit(', "')), F.coalesce("flight_no", F.lit("")))
    file = F.concat(F.lit("supply-"), F.col("bucket"))
    rows = q.select(file.alias("file"), (F.col("order_key") * 16 + F.col("line_no") + 2).alias("row_number"), line.alias("line"))
    head = q.select(file.alias("file")).distinct().select(
        "file", F.lit(1).cast("bigint").alias("row_number"),
        F.when(F.col("file") == "supply-T45", _HEADER.replace(",carrier", ",operator")).otherwise(_HEADER).alias("line"))
    return _stored(rows.unionByName(head))


_SUPPLIED = {"rows": f"""
    SELECT 'supply-' || bucket AS file, CAST(order_key * 16 + line_no + 2 AS BIGINT) AS row_number,
           {_CODES.format(c='origin')} AS o, {_CODES.format(c='destination')} AS dd, carrier, fare_c, part_key, fare_brand,
           flight_no, collected_date, travel_date,
           CASE WHEN part_key % 23 = 0 OR part_key % 29 = 0 THEN FALSE ELSE part_key % 31 = 0 END AS blank
    FROM q WHERE bucket <> 'T45'""",
    "judged_rows": """
    SELECT *, CASE WHEN blank THEN 'missing required field(s): total_fare'
      WHEN part_key % 17 = 0 THEN 'currency out of scope: USD'
      WHEN o = 'MI3' THEN 'origin is not a 3-letter airport code: MI3'
      WHEN dd = 'MI3' THEN 'destination is not a 3-letter airport code: MI3'
      WHEN travel_date < collected_date THEN 'travel_date precedes collected_date'
      WHEN part_key % 23 = 0 THEN 'total_fare must be positive'
      WHEN part_key % 29 = 0 THEN 'total_fare is not a parseable amount' END AS reason FROM rows"""}


def _validated(t):
    return supplied.validate_rows(supplied.parse_rows(_supplied(t)), "REGIONAL_OFFICE")


@query("s6_supplied_accepted", compose(f"""
    SELECT file, row_number, {day('collected_date')} AS collected_date, {day('travel_date')} AS travel_date, o AS origin,
           dd AS destination, carrier, fare_c / 100.0 AS total_fare, fare_brand || ',' AS fare_brand, flight_no AS flight_number
    FROM judged_rows WHERE reason IS NULL""", "q", extra=_SUPPLIED))
def _(t):
    return supplied.accepted(_validated(t)).select(
        "file", "row_number", "collected_date", "travel_date", "origin", "destination", "carrier", "total_fare",
        "fare_brand", "flight_number")


@query("s6_supplied_rejected", compose(
    "SELECT file, row_number, reason FROM judged_rows WHERE reason IS NOT NULL", "q", extra=_SUPPLIED))
def _(t):
    return supplied.rejected(_validated(t))


@query("s6b_file_usability", compose("""
    SELECT file, count(*) AS rows_read, count(reason) AS rows_rejected,
           round_even(count(reason) / count(*), 3) AS rejection_rate,
           CAST(count(*) > count(reason) AND round_even(count(reason) / count(*), 3) <= 0.2 AS BIGINT) AS usable
    FROM judged_rows GROUP BY file""", "q", extra=_SUPPLIED))
def _(t):
    return supplied.file_usability(_validated(t))


@query("o4_required_columns_absent", compose("""
    SELECT 'supply-T45' AS file, 'missing required column(s): carrier' AS reason FROM q LIMIT 1""", "q"))
def _(t):
    return supplied.unreadable_files(_supplied(t))


@query("p6_route_and_lead_time", compose("""
    SELECT file, row_number, o || '-' || dd AS route, CAST(travel_date - collected_date AS BIGINT) AS lead_time_days
    FROM judged_rows WHERE reason IS NULL""", "q", extra=_SUPPLIED))
def _(t):
    return supplied.accepted(_validated(t)).select("file", "row_number", "route", "lead_time_days")


@query("p5_transacted_prices", compose("""
    SELECT file, count(*) AS transacted FROM judged_rows WHERE reason IS NULL GROUP BY file""", "q", extra=_SUPPLIED))
def _(t):
    paid = supplied.accepted(_validated(t))
    declared = supplied.accepted(supplied.validate_rows(supplied.parse_rows(_supplied(t)), supplied.TARIFF_SOURCE))
    return payloads.transacted_only(paid.unionByName(declared)).groupBy("file").agg(F.count("*").alias("transacted"))


@query("s6_files_read_back", compose("""
    SELECT quote_id, replace(fare_brand, ' ', chr(10)) || chr(10) || '"' || carrier || '"' AS fare_brand, total_fare AS fare,
           CASE WHEN part_key % 13 = 0 THEN 'total_fare is not a parseable amount' END AS reason FROM q""", "q"))
def _(t):
    # Written as CSV with line breaks and quotes inside fields, and read by line.
    folder = f"{checkpoint_dir(t.spark)}/indexwright/supplied-{uuid.uuid4().hex}"
    broken = F.concat(F.translate("fare_brand", " ", "\n"), F.lit('\n"'), "carrier", F.lit('"'))
    rows = t.quotes.select(
        F.date_format("collected_date", "yyyy-MM-dd").alias("collected_date"), F.date_format(F.date_add("collected_date", 9), "dd/MM/yyyy").alias("travel_date"),
        F.lit("DEL").alias("origin"), F.lit("BOM").alias("destination"), F.lit("ZZ").alias("carrier"), broken.alias("fare_brand"),
        F.when(F.col("part_key") % 13 == 0, "about").otherwise(F.format_number("total_fare", 2)).alias("total_fare"), F.lit("inr").alias("currency"),
        F.col("quote_id").alias("source_platform"))
    rows.write.option("header", True).option("escape", '"').csv(folder)
    validated = supplied.validate_rows(supplied.parse_rows(supplied.read_lines(t.spark, folder)), "REGIONAL_OFFICE")
    fares = t.quotes.select("quote_id", F.col("total_fare").alias("fare"))
    # A row that was read wrongly has another fare than its quote, or no quote.
    read = validated.select(F.col("source_platform").alias("quote_id"), "fare_brand", "total_fare", "reason").join(fares, "quote_id", "left")
    return read.filter(F.col("reason").isNotNull() | (F.col("total_fare") == F.col("fare"))).select("quote_id", "fare_brand", "fare", "reason")


# -- reference series -----------------------------------------------------------------

_MONTH_NAMES = "strftime(m, '%B')"
_BENCH = {"months": """
    SELECT date_trunc('month', o_orderdate) AS m, left(o_orderpriority, 1) AS pr,
           CAST(round(avg(CAST(round(o_totalprice * 100) AS BIGINT)) / 100) AS BIGINT) AS v
    FROM orders GROUP BY ALL"""}


def _benchmark_documents(t):
    """One stored document per year holding the monthly rows of all sectors."""
    month = F.trunc("o_orderdate", "month")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    sector = (F.when(F.col("pr") == "1", "Rural").when(F.col("pr") == "2", "Urban").when(F.col("pr") == "3", "Combined")
              .when(F.col("pr") == "4", "Hills").otherwise("Islands"))
    monthly = t.table("orders").withColumn("pr", F.substring("o_orderpriority", 1, 1)).groupBy(
        month.alias("m"), "pr").agg(F.round(F.avg(cents) / 100).cast("bigint").alias("v"))
    row = F.struct(
        F.date_format("m", "yyyy").alias("year"), F.upper(F.date_format("m", "MMMM")).alias("month"),
        sector.alias("sector"), F.lit("Airfare").alias("item"), F.col("v").cast("string").alias("index"),
        F.when(F.month("m") == 4, "Y").otherwise("N").alias("imputation"))
    # Twelve months by five sectors per document.
    return monthly.groupBy(F.year("m").alias("y")).agg(
        F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("body"))


@query("s7_benchmark_series", compose("""
    SELECT CAST(year(m) AS BIGINT) AS year, CAST(month(m) AS BIGINT) AS month, CAST(v AS DOUBLE) AS value, 'Airfare' AS item,
           CASE WHEN month(m) = 4 THEN 'Y' ELSE 'N' END AS imputation FROM months WHERE pr = '3'""", extra=_BENCH))
def _(t):
    return reference_series.benchmark_series(reference_series.benchmark_rows(_benchmark_documents(t)))


@query("s7_benchmark_integrity", compose("""
    SELECT count(*) AS months, CAST(max(p) - min(p) + 1 AS BIGINT) AS span, CAST(max(p) - min(p) + 1 <> count(*) AS BIGINT) AS has_gaps,
           CAST(0 AS BIGINT) AS foreign_rows, count(*) FILTER (month(m) = 4) AS imputed_months, CAST(1 AS BIGINT) AS usable
    FROM (SELECT m, year(m) * 12 + month(m) AS p FROM months WHERE pr = '3')""", extra=_BENCH))
def _(t):
    rows = reference_series.benchmark_rows(_benchmark_documents(t))
    return reference_series.benchmark_integrity(reference_series.benchmark_series(rows), "Airfare")


@query("s8_airport_throughput", compose(
    "SELECT origin AS airport, count(*) AS passengers FROM q GROUP BY origin", "q"))
def _(t):
    counts = t.quotes.groupBy("source").agg(F.count("*").alias("n"))
    # One entry per region.
    document = counts.agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("airports"))
    return reference_series.airport_throughput(document.select(F.to_json(F.struct("airports")).alias("body")))


# -- planning and identity ----------------------------------------------------------

_PLAN = {"plan": """
    SELECT s.source, r.route, b.bucket, b.days AS lead_time_days, c.d AS collected_date, c.d + CAST(b.days AS INTEGER) AS travel_date
    FROM (SELECT DISTINCT source FROM q WHERE source <> 'ASIA') s, (SELECT DISTINCT route FROM q WHERE origin <> 'AFRICA') r,
         (VALUES ('T1', 1), ('T7', 7), ('T15', 15), ('T21', 21), ('T30', 30), ('T45', 45)) b(bucket, days),
         (SELECT max(collected_date) AS d FROM q) c""",
    "hashed": f"""
    SELECT *, sha256(source || '|' || route || '|' || bucket || '|' || {day('travel_date')} || '|' || {day('collected_date')}) AS query_hash
    FROM plan"""}


def _plan(t):
    sources = t.quotes.select("source", (F.col("source") != "ASIA").alias("enabled")).distinct()
    routes = t.quotes.select("route", (F.col("source") != "AFRICA").alias("active")).distinct()
    newest = t.quotes.agg(F.max("collected_date").alias("d")).scalar()
    return planning.collection_plan(sources, routes, newest)


@query("s13_collection_plan", compose(f"""
    SELECT source, route, bucket, CAST(lead_time_days AS BIGINT) AS lead_time_days, {day('collected_date')} AS collected_date,
           {day('travel_date')} AS travel_date, query_hash FROM hashed""", "q", extra=_PLAN))
def _(t):
    return _plan(t)


_SEARCHES = {"searches": f"""
    SELECT DISTINCT source, route, bucket, {day('collected_date')} AS collected_date,
           sha256(source || '|' || route || '|' || bucket || '|' || {day('collected_date + 7')} || '|' || {day('collected_date')}) AS query_hash,
           year(collected_date) AS y FROM q"""}


def _searches(t):
    rows = t.quotes.select("source", "route", "bucket", "collected_date")
    return rows.withColumn("query_hash", search_hash(
        F.col("source"), F.col("route"), F.col("bucket"), F.date_add("collected_date", 7), F.col("collected_date")))


@query("s14_new_searches", compose(
    "SELECT source, route, bucket, collected_date, query_hash FROM searches WHERE y >= 1996", "q", extra=_SEARCHES))
def _(t):
    done = _searches(t).filter(F.year("collected_date") < 1996)
    return planning.new_searches(_searches(t), done)[0]


@query("s14_duplicate_searches", compose(
    "SELECT query_hash, 'DUPLICATE' AS status FROM searches WHERE y < 1996", "q", extra=_SEARCHES))
def _(t):
    plan = _searches(t).dropDuplicates(["query_hash"])
    done = plan.filter(F.year("collected_date") < 1996)
    return planning.new_searches(plan, done)[1].select("query_hash", "status")


# -- extracts and the guarded append ----------------------------------------------------


def _extract(t):
    rows = t.run.observations()
    return rows.select(
        F.when(F.col("level") == "ROUTE", "X").otherwise("D").alias("FREQ"),
        F.date_format("obs_date", "yyyy-MM-dd").alias("TIME_PERIOD"), F.col("level").alias("LEVEL"),
        F.coalesce("route", F.lit("")).alias("ROUTE"), F.coalesce("bucket", F.lit("")).alias("LEAD_TIME"),
        F.col("index_value").alias("OBS_VALUE"), F.col("methodology_version").alias("METHODOLOGY_VERSION"),
        F.col("weight_set_version").alias("WEIGHT_SET_VERSION"), F.col("revision").alias("REVISION"),
        F.lit("PUBLISHED").alias("OBS_STATUS"))


_DEC = "printf('%d.%06d', i6 // 1000000, i6 % 1000000)"


@query("s9_csv_rows", compose(f"""
    SELECT 'D' AS "FREQ", {day('obs_date')} AS "TIME_PERIOD", 'STRATUM' AS "LEVEL", route AS "ROUTE", bucket AS "LEAD_TIME",
           {_DEC} AS "OBS_VALUE", '1' AS "METHODOLOGY_VERSION", '1' AS "WEIGHT_SET_VERSION", '1' AS "REVISION",
           'PUBLISHED' AS "OBS_STATUS", '' AS "STD_ERROR", '' AS "PROVENANCE" FROM strata WHERE i6 IS NOT NULL
    UNION ALL SELECT 'X', {day('obs_date')}, 'ROUTE', route, '', {_DEC}, '1', '1', '1', 'PUBLISHED', '', '' FROM routes WHERE i6 IS NOT NULL
    UNION ALL SELECT 'D', {day('obs_date')}, 'HEADLINE', '', '', {_DEC}, '1', '1', '1', 'PUBLISHED', '', '' FROM headline""",
    "strata", "routes", "headline"))
def _(t):
    return sinks.as_text(_extract(t))


@query("s10_json_envelope", compose("""
    SELECT 'PRICE_INDEX' AS dataset, (SELECT count(i6) FROM strata) + (SELECT count(i6) FROM routes)
           + (SELECT count(*) FROM headline) AS observations""", "strata", "routes", "headline"))
def _(t):
    return sinks.envelope(_extract(t), sinks.Dataset()).select(F.col("dataset.id").alias("dataset"), "observations")


@query("s10_json_read_back", compose(f"""
    SELECT 'D' AS "FREQ", {day('obs_date')} AS "TIME_PERIOD", 'STRATUM' AS "LEVEL", route AS "ROUTE", bucket AS "LEAD_TIME",
           {_DEC} AS "OBS_VALUE", CAST(1 AS BIGINT) AS "REVISION", CAST(NULL AS VARCHAR) AS "STD_ERROR" FROM strata WHERE i6 IS NOT NULL
    UNION ALL SELECT 'X', {day('obs_date')}, 'ROUTE', route, '', {_DEC}, 1, NULL FROM routes WHERE i6 IS NOT NULL
    UNION ALL SELECT 'D', {day('obs_date')}, 'HEADLINE', '', '', {_DEC}, 1, NULL FROM headline""", "strata", "routes", "headline"))
def _(t):
    path = f"{checkpoint_dir(t.spark)}/indexwright/extract-{uuid.uuid4().hex}"
    sinks.write_json(_extract(t), path)
    return sinks.read_json(t.spark, path).select("FREQ", "TIME_PERIOD", "LEVEL", "ROUTE", "LEAD_TIME", "OBS_VALUE", "REVISION", "STD_ERROR")


@query("s11_nonconforming_codes", compose("""
    SELECT 'FREQ' AS dimension, 'X' AS code, count(i6) AS rows FROM routes""", "routes"))
def _(t):
    return sinks.nonconforming(_extract(t))


@query("s12_identity_conflicts", compose(f"""
    SELECT {day('obs_date')} AS obs_date, level, route, conflict FROM (
      SELECT obs_date, 'ROUTE' AS level, route, 'EXISTS' AS conflict FROM routes
        WHERE i6 IS NOT NULL AND obs_date = (SELECT max(obs_date) FROM routes)
      UNION ALL SELECT obs_date, 'HEADLINE', NULL, 'REPEATED' FROM headline)""", "routes", "headline"))
def _(t):
    rows = t.run.observations()
    heads = rows.filter("level = 'HEADLINE'")
    newest = t.run.routes.agg(F.max("obs_date").alias("d")).scalar()
    again = rows.filter((F.col("level") == "ROUTE") & (F.col("obs_date") == newest))
    incoming = again.unionByName(heads).unionByName(heads)
    stored = rows.filter("level = 'ROUTE'")
    return sinks.identity_conflicts(incoming, stored).select("obs_date", "level", "route", "conflict")


@query("s12_appended_rows", compose(f"""
    SELECT {day('obs_date')} AS obs_date, 'STRATUM' AS level, route, bucket, i6 / 1000000.0 AS index_value FROM strata WHERE i6 IS NOT NULL
    UNION ALL SELECT {day('obs_date')}, 'ROUTE', route, NULL, i6 / 1000000.0 FROM routes WHERE i6 IS NOT NULL
    UNION ALL SELECT {day('obs_date')}, 'HEADLINE', NULL, NULL, i6 / 1000000.0 FROM headline""", "strata", "routes", "headline"))
def _(t):
    # One append a level; a second writer of the headline prepared meanwhile and is refused.
    stored = sinks.ObservationTable(t.spark, f"{checkpoint_dir(t.spark)}/indexwright/observations-{uuid.uuid4().hex}")
    rows = settle(t.run.observations(), "observations")
    late = stored.prepare(rows.filter("level = 'HEADLINE'"))
    for level in ("STRATUM", "ROUTE", "HEADLINE"):
        stored.append(rows.filter(F.col("level") == level))
    try:
        late.commit()
    except ValueError:
        return stored.rows().select("obs_date", "level", "route", "bucket", "index_value")
    raise AssertionError("both writers of one identity succeeded")


# -- normalisation of offers -----------------------------------------------------------


def _offers(t):
    q = t.quotes
    return q.select(
        "quote_id",
        F.when(F.col("part_key") % 19 == 0, "ABC").otherwise(F.concat(F.lit(" "), F.lower("carrier"))).alias("carrier"),
        F.concat(F.col("flight_no"), F.lit("  ")).alias("flight_no"),
        F.when(F.col("part_key") % 7 == 0, "  ").otherwise(F.col("fare_brand")).alias("fare_brand"),
        F.when(F.col("part_key") % 23 == 0, "-5").when(F.col("part_key") % 29 == 0, "x1")
        .otherwise(F.concat(F.lit("₹"), F.format_number(F.col("total_fare"), 2))).alias("total_fare"),
        F.when(F.col("part_key") % 17 == 0, "USD").when(F.col("part_key") % 2 == 0, " inr").alias("currency"),
        F.col("base_fare").cast("string").alias("base_fare"),
        F.when(F.col("part_key") % 37 == 0, "?").otherwise(F.col("taxes").cast("string")).alias("taxes"))


_NORM = {"offers": """
    SELECT *, CASE WHEN part_key % 19 = 0 THEN 'carrier code is not two characters'
        WHEN part_key % 23 <> 0 AND part_key % 29 = 0 THEN 'total_fare is not a parseable amount'
        WHEN part_key % 23 = 0 THEN 'total_fare must be positive'
        WHEN part_key % 17 = 0 THEN 'currency is out of scope'
        WHEN part_key % 37 = 0 THEN 'taxes is not a parseable amount' END AS reject_reason FROM q"""}


@query("p1_normalised_quotes", compose("""
    SELECT quote_id, carrier, flight_no, CASE WHEN part_key % 7 <> 0 THEN fare_brand END AS fare_brand, total_fare,
           base_fare, taxes, component_confidence, quality_status, missing_reason
    FROM offers WHERE reject_reason IS NULL""", "q", extra=_NORM))
def _(t):
    return nq.normalise(_offers(t))[0].select(
        "quote_id", "carrier", "flight_no", "fare_brand", "total_fare", "base_fare", "taxes", "component_confidence",
        "quality_status", "missing_reason")


@query("p1_rejected_offers", compose(
    "SELECT quote_id, reject_reason FROM offers WHERE reject_reason IS NOT NULL", "q", extra=_NORM))
def _(t):
    return nq.normalise(_offers(t))[1].select("quote_id", "reject_reason")


@query("p1b_money_text", """
    SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 AS amount,
           CAST(o_orderkey % 5 = 0 AS BIGINT) AS unreadable FROM orders WHERE o_orderkey % 5 <> 0
    UNION ALL SELECT o_orderkey, NULL, 1 FROM orders WHERE o_orderkey % 5 = 0""")
def _(t):
    from indexwright.functions.text import parse_money
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("about "), F.col("o_totalprice").cast("string"))).otherwise(
        F.concat(F.lit("₹ "), F.format_number(F.round(F.col("o_totalprice") * 100).cast("bigint").cast("decimal(20,0)") / 100, 2)))
    rows = t.table("orders").select("o_orderkey", F.bround(parse_money(text), 2).alias("amount"))
    return rows.withColumn("unreadable", F.col("amount").isNull())
