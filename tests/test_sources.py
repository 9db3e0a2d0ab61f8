"""Payload parsers, supplied files, reference series, extracts."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from indexwright.functions.text import cell_text, first_date, parse_money
from indexwright.sources import payloads, planning, reference_series, sinks, supplied

D = Decimal


def _one(spark, body, **columns):
    frame = spark.createDataFrame([("r1", body)], "response_id string, body string")
    for name, value in columns.items():
        frame = frame.withColumn(name, F.lit(value))
    return frame


def test_availability_keeps_only_exact_non_stop_adult_fares(spark):
    def fares(amount):
        return {"fares": [{"classOfService": "V", "productClass": "EC", "passengerFares": [
            {"passengerType": "ADT", "fareAmount": amount, "serviceCharges": [
                {"type": "FarePrice", "code": "", "amount": 4000}, {"type": "Tax", "code": "GST", "amount": 200.5},
                {"type": "Fee", "code": "UDF", "amount": 61}, {"type": "Fee", "code": "dudf", "amount": 1},
                {"type": "Fee", "code": "CUTE", "amount": 50}, {"type": "Fee", "code": "NEW", "amount": 7.255},
                {"type": "Fee", "code": "X", "amount": None}]},
            {"passengerType": "CHD", "fareAmount": 1, "serviceCharges": []}]}]}

    def journey(**change):
        base = {"flightType": "NonStop", "stops": 0,
                "designator": {"origin": "DEL", "destination": "BOM", "departure": "2026-07-01T06:00:00"},
                "segments": [{"identifier": {"carrierCode": "QP", "identifier": " 1101 "}}],
                "fares": [{"fareAvailabilityKey": "k"}, {"fareAvailabilityKey": "none"}]}
        return {**base, **change}

    journeys = [
        journey(), journey(stops=1), journey(flightType="Connect"), journey(segments=[]),
        journey(designator={"origin": "DXN", "destination": "BOM"}),
        journey(segments=[{"identifier": {"carrierCode": "", "identifier": "1"}}]), journey(),
    ]
    doc = {"data": {"faresAvailable": [{"key": "k", "value": fares(1)}, {"key": "k", "value": fares(4319.755)}],
                    "results": [{"trips": [{"journeysAvailableByMarket": [{"value": journeys}]}]}]}}
    rows = payloads.availability_offers(
        _one(spark, json.dumps(doc), origin="DEL", destination="BOM")).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == [0, 1]
    r = rows[0]
    assert (r["flight_no"], r["fare_brand"], r["total_fare"]) == ("QP1101", "V", D("4319.76"))
    assert (r["base_fare"], r["taxes"], r["udf"], r["convenience_fee"]) == (D("4000.00"), D("200.50"), D("62.00"), D("57.26"))


def test_charges_absent_are_null(spark):
    doc = {"data": {"faresAvailable": [{"key": "k", "value": {"fares": [{"passengerFares": [
        {"passengerType": "ADT", "fareAmount": 5, "serviceCharges": []}]}]}}],
        "results": [{"trips": [{"journeysAvailableByMarket": [{"value": [{
            "flightType": "NonStop", "stops": 0, "designator": {}, "fares": [{"fareAvailabilityKey": "k"}],
            "segments": [{"identifier": {"carrierCode": "QP", "identifier": "1"}}]}]}]}]}]}}
    body = _one(spark, json.dumps(doc)).withColumn("origin", F.lit(None).cast("string")).withColumn("destination", F.lit(None).cast("string"))
    r = payloads.availability_offers(body).first()
    assert r["base_fare"] is None and r["udf"] is None and r["total_fare"] == D("5.00")


def test_gds_offers(spark):
    def offer(n=1, base="4000", total="4500.00", fees=("100",)):
        seg = {"carrierCode": "6E", "number": "201", "departure": {"at": "2026-07-01T06:00:00"}}
        return {"itineraries": [{"segments": [seg] * n}],
                "price": {"currency": "INR", "total": "1", "grandTotal": total, "base": base, "fees": [{"amount": f} for f in fees]},
                "travelerPricings": [{"fareDetailsBySegment": [{"fareBasis": "BASIS"}]}]}
    doc = {"data": [offer(), offer(2), offer(base="x"), offer(base="4480")]}
    rows = payloads.gds_offers(_one(spark, json.dumps(doc))).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == [0, 1, 2]
    assert (rows[0]["taxes"], rows[0]["convenience_fee"], rows[0]["fare_brand"]) == (D("400.00"), D("100.00"), "BASIS")
    assert rows[1]["base_fare"] is None and rows[1]["taxes"] is None
    assert rows[2]["base_fare"] == D("4480.00") and rows[2]["taxes"] is None


def test_tariff_sheet(spark):
    html = """<table>
      <tr><th>Sector</th><th>Basic</th><th>Plus</th></tr>
      <tr><td>CCU-GAU</td><td>&#8377 2,310</td><td>&#x0020B9; 2,995.50</td></tr>
      <tr><td>MAA-COK</td><td>&#00008377;1,875</td><td>on request</td></tr>
      <tr><td>HYD-PNQ</td><td>&nbsp;&#x20b9;&thinsp;3,060</td><td></td></tr></table>"""
    rows = payloads.tariff_bands(_one(spark, html)).collect()
    got = {(r["sector"], r["fare_category"]): r["declared_fare"] for r in rows}
    assert got == {("CCU-GAU", "Basic"): D("2310.00"), ("CCU-GAU", "Plus"): D("2995.50"),
                   ("MAA-COK", "Basic"): D("1875.00"), ("HYD-PNQ", "Basic"): D("3060.00")}
    assert payloads.transacted_only(payloads.tariff_bands(_one(spark, html))).isEmpty()


def test_cell_text(spark):
    cells = ["<b>a</b>&nbsp;&amp; b", "&#x20B9;5 &#8377;6", "&#128512;", "x&#;y &bogus;", "a\n  b"]
    frame = spark.createDataFrame([(c,) for c in cells], "c string").select(cell_text(F.col("c")).alias("t"))
    assert [r["t"] for r in frame.collect()] == ["a & b", "₹5 ₹6", "\U0001F600", "x&#;y &bogus;", "a b"]


def test_entities_like_the_html_rules(spark):
    import html
    cells = ["&#8377 4", "&#00008377;4", "&#x0020B9; 4", "&frac12;4", "&copy5", "&notit; &notin; x", "&#150;", "&#0;", "&#x110000;", "&#99999999999;",
             "&#1;x", "&ampamp;", "&&amp;", "&Eacute;t&eacute", "&#xD800;", "&;", "&#x;", "&NotEqualTilde;", "&rarr;&hearts;"]
    frame = spark.createDataFrame([(c,) for c in cells], "c string").select("c", cell_text(F.col("c")).alias("t"))
    for r in frame.collect():
        assert r["t"] == " ".join(html.unescape(r["c"]).split()), r["c"]


def test_dates_and_money(spark):
    texts = ["2026-07-01", "01/07/2026", "01-07-2026", "01-Jul-2026", "1-JUL-2026", "07/13/2026", "2026/07/01", "31-02-2026", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(first_date(F.col("t")).alias("d"))
    assert [str(r["d"]) for r in frame.collect()] == ["2026-07-01"] * 5 + ["None"] * 4
    money = ["1,234.50", "₹ 99", "INR 5", "abc", "1e3"]
    frame = spark.createDataFrame([(t,) for t in money], "t string").select(
        parse_money(F.col("t"), strip_code=True).alias("m"), parse_money(F.col("t")).alias("s"))
    rows = frame.collect()
    assert [r["m"] for r in rows] == [D("1234.500000"), D("99.000000"), D("5.000000"), None, D("1000.000000")]
    assert rows[2]["s"] is None


HEADER = "collected_date,travel_date,origin,destination,carrier,total_fare,currency,fare_brand"
GOOD = "2026-07-01,2026-07-08,DEL,BOM,6E,4500,INR,SAVER"
BAD = [
    ("2026-07-01,2026-07-08,DEL,BOM,6E,4500,USD,", "currency out of scope: USD"),
    ("2026-07-01,2026-07-08,DELH,BOM,6E,4500,INR,", "origin is not a 3-letter airport code: DELH"),
    ("2026-07-01,2026-07-08,DEL,del,6E,4500,INR,", "origin and destination are the same"),
    ("2026-07-01,2026-07-08,DEL,BOM,6EX,4500,INR,", "carrier is not a 2-character code: 6EX"),
    ("07/13/2026,2026-07-08,DEL,BOM,6E,4500,INR,", "collected_date is not a recognised date"),
    ("2026-07-09,2026-07-08,DEL,BOM,6E,4500,INR,", "travel_date precedes collected_date"),
    ("2026-07-01,2026-07-08,DEL,BOM,6E,0,INR,", "total_fare must be positive"),
    ("2026-07-01,2026-07-08,DEL,BOM,6E,-1,INR,", "total_fare must be positive"),
    ("2026-07-01,2026-07-08,DEL,BOM,6E,many,INR,", "total_fare is not a parseable amount"),
    ("2026-07-01,2026-07-08,DEL,BOM,6E,₹,INR,", "total_fare is empty"),
    ("2026-07-01,2026-07-08,DEL,BOM,,4500,INR,", "missing required field(s): carrier"),
    ("2026-07-01,2026-07-08", "missing required field(s): origin, destination, carrier, total_fare, currency"),
]


@pytest.fixture
def supply_folder(tmp_path):
    lines = [HEADER, GOOD, "", '2026-07-01,01/08/2026,del,bom,6e,"₹ 4,500.50",inr,"A ""B"", C"', *[b for b, _ in BAD]]
    (tmp_path / "mixed.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "clean.csv").write_text("\r\n".join([HEADER] + [GOOD] * 500) + "\r\n", encoding="utf-8")
    (tmp_path / "wrong.csv").write_text("collected_date,origin\n2026-07-01,DEL\n", encoding="utf-8")
    return str(tmp_path)


def test_supplied_files(spark, supply_folder):
    lines = supplied.read_lines(spark, supply_folder)
    name = F.element_at(F.split("file", "/"), -1)
    unreadable = supplied.unreadable_files(lines).withColumn("file", name).collect()
    assert [(r["file"], r["reason"]) for r in unreadable] == [
        ("wrong.csv", "missing required column(s): travel_date, destination, carrier, total_fare, currency")]
    validated = supplied.validate_rows(supplied.parse_rows(lines), "REGIONAL_OFFICE").withColumn("file", name)
    rejects = supplied.rejected(validated).orderBy("row_number").collect()
    # Blank lines are not rows; the header is row 1.
    assert [(r["row_number"], r["reason"]) for r in rejects] == [(i + 4, reason) for i, (_, reason) in enumerate(BAD)]
    good = supplied.accepted(validated).filter("file = 'mixed.csv'").orderBy("row_number").collect()
    assert [(r["row_number"], r["total_fare"], r["route"], r["lead_time_days"], r["fare_brand"]) for r in good] == [
        (2, D("4500.00"), "DEL-BOM", 7, "SAVER"), (3, D("4500.50"), "DEL-BOM", 31, 'A "B", C')]
    usable = {r["file"]: (r["rows_read"], r["usable"]) for r in supplied.file_usability(validated).collect()}
    assert usable == {"mixed.csv": (14, False), "clean.csv": (500, True)}


def test_row_numbers_hold_across_splits(spark, tmp_path):
    body = [HEADER] + [GOOD.replace("4500", str(i)) for i in range(1, 4001)]
    (tmp_path / "big.csv").write_text("\n".join(body) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = supplied.read_lines(spark, str(tmp_path))
        assert lines.select("file").count() == 4001
        rows = supplied.accepted(supplied.validate_rows(supplied.parse_rows(lines), "X"))
        assert rows.filter("row_number <> cast(total_fare as int) + 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_benchmark_and_throughput(spark):
    rows = [{"year": "2025", "month": m, "sector": s, "item": "Airfare", "index": v, "imputation": "N"}
            for m, v in (("january", "120.78"), (" FEBRUARY ", "111.31"), ("April", "100")) for s in ("Rural", "Combined")]
    docs = spark.createDataFrame([(json.dumps({"rows": rows}),)], "body string")
    series = reference_series.benchmark_series(reference_series.benchmark_rows(docs))
    assert [(r["year"], r["month"], r["value"]) for r in series.orderBy("month").collect()] == [
        (2025, 1, D("120.7800")), (2025, 2, D("111.3100")), (2025, 4, D("100.0000"))]
    check = reference_series.benchmark_integrity(series, "Airfare").first()
    assert (check["months"], check["span"], check["has_gaps"], check["usable"]) == (3, 4, True, True)
    empty = reference_series.benchmark_integrity(series.filter("false"), "Airfare").first()
    assert not empty["usable"]
    traffic = reference_series.airport_throughput(spark.createDataFrame([('{"airports": {"DEL": 5, "BOM": 4}}',)], "body string"))
    assert {r["airport"]: r["passengers"] for r in traffic.collect()} == {"DEL": 5, "BOM": 4}


def test_plan_and_duplicates(spark):
    sources = spark.createDataFrame([("a", True), ("b", False)], "source string, enabled boolean")
    routes = spark.createDataFrame([("DEL-BOM", True), ("DEL-BLR", True), ("X-Y", False)], "route string, active boolean")
    plan = planning.collection_plan(sources, routes, F.lit("2026-07-01").cast("date"))
    assert plan.count() == 12
    row = plan.filter("bucket = 'T7' and route = 'DEL-BOM'").first()
    assert str(row["travel_date"]) == "2026-07-08"
    import hashlib
    assert row["query_hash"] == hashlib.sha256(b"a|DEL-BOM|T7|2026-07-08|2026-07-01").hexdigest()
    fresh, repeated = planning.new_searches(plan, plan.filter("bucket = 'T7'"))
    assert (fresh.count(), repeated.count()) == (10, 2)


OBS_SCHEMA = ("obs_date string, level string, route string, bucket string, v string, "
              "methodology_version string, revision int")


def _observations(spark, rows):
    return spark.createDataFrame(rows, OBS_SCHEMA).selectExpr(
        "cast(obs_date as date) obs_date", "level", "route", "bucket", "cast(v as decimal(12,6)) index_value",
        "methodology_version", "revision")


def test_guarded_append(spark, tmp_path):
    path = str(tmp_path / "obs")
    first = _observations(spark, [("2026-07-01", "HEADLINE", None, None, "100", "1", 1), ("2026-07-01", "ROUTE", "A-B", None, "101", "1", 1)])
    sinks.append_observations(first, path)
    with pytest.raises(ValueError):
        sinks.append_observations(first.filter("level = 'HEADLINE'"), path)
    with pytest.raises(ValueError):
        again = _observations(spark, [("2026-07-02", "HEADLINE", None, None, "100", "1", 1)])
        sinks.append_observations(again.unionByName(again), path)
    sinks.append_observations(first.withColumn("revision", F.lit(2)), path)
    assert sinks.ObservationTable(spark, path).rows().count() == 4


def test_interleaved_appends(spark, tmp_path):
    table = sinks.ObservationTable(spark, str(tmp_path / "obs"))
    head = _observations(spark, [("2026-07-01", "HEADLINE", None, None, "100.25", "1", 1)])
    other = _observations(spark, [("2026-07-01", "ROUTE", "A-B", None, "101", "1", 1), ("2026-07-02", "HEADLINE", None, None, "102", "1", 1)])
    one, two, three = table.prepare(head), table.prepare(head), table.prepare(other)
    assert table.rows().count() == 0
    assert three.commit() == 1 and two.commit() == 2
    with pytest.raises(ValueError):
        one.commit()
    assert [str(r["index_value"]) for r in table.rows().orderBy("level", "obs_date").collect()] == ["100.250000", "102.000000", "101.000000"]
    with pytest.raises(ValueError):
        table.prepare(other)
    table.append(head.withColumn("revision", F.lit(2)))
    table.append(head.limit(0))
    assert table.rows().count() == 4 and sorted(table.runs()) == [1, 2, 3, 4]


def test_a_taken_number_is_not_taken_again(spark, tmp_path):
    table = sinks.ObservationTable(spark, str(tmp_path / "obs"))
    assert table._take(1, "a" * 32) and not table._take(1, "b" * 32) and table._take(2, "b" * 32)
    assert table.runs() == {1: "a" * 32, 2: "b" * 32}


def test_extracts_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("D", "2026-07-01", "ROUTE", "DEL-BOM", "", D("110.234567"), "1", "w", 1, "PUBLISHED")],
        "FREQ string, TIME_PERIOD string, LEVEL string, ROUTE string, LEAD_TIME string, OBS_VALUE decimal(12,6), "
        "METHODOLOGY_VERSION string, WEIGHT_SET_VERSION string, REVISION int, OBS_STATUS string")
    rows = rows.coalesce(1)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert back["OBS_VALUE"] == "110.234567" and back["METHODOLOGY_VERSION"] == "1"
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.splitlines()[1] == "D,2026-07-01,ROUTE,DEL-BOM,,110.234567,1,w,1,PUBLISHED,,"
    at = F.lit("2026-07-03 04:05:06").cast("timestamp")
    sinks.write_json(rows, str(tmp_path / "json"), sinks.Dataset(agency="Office"), at)
    line = json.loads("".join(p.read_text() for p in (tmp_path / "json" / "data").glob("*.json")))
    assert line["OBS_VALUE"] == "110.234567" and line["REVISION"] == 1 and line["STD_ERROR"] is None
    said = json.loads("".join(p.read_text() for p in (tmp_path / "json" / "envelope").glob("*.json")))
    assert said["dataset"]["agency"] == "Office" and set(said["dataset"]) == {"id", "name", "agency", "version", "description"}
    assert said["observations"] == 1 and said["extracted_at"].startswith("2026-07-03T04:05:06")
    assert sinks.read_json(spark, str(tmp_path / "json")).first()["REVISION"] == 1
    rows.select("FREQ").write.json(str(tmp_path / "broken" / "data"))
    with pytest.raises(Exception):
        sinks.read_json(spark, str(tmp_path / "broken"))
    assert sinks.dataset_schema()["LEVEL"].metadata["codes"] == ["HEADLINE", "ROUTE", "STRATUM"]


TRICKY = [
    'plain,5" pipe,x', '"two\nlines","say ""hi""\n\nagain",end', '"a"b,c"d,"', '"",""\n', "", "   ", ',,"\n"', '"ends in quote""",y', '"x"",\n""y",z', 'a "b\nc" d', "last",
]


@pytest.mark.parametrize("block", ["64", "1000000"])
def test_records_with_line_breaks_like_a_csv_reader(spark, tmp_path, block):
    import csv
    import io
    import random
    pick, wants = random.Random(3), {}
    for name in ("a", "b", "c"):
        rows = ["collected_date,travel_date"] + [pick.choice(TRICKY[:3] + TRICKY[4:]) for _ in range(300 if name != "c" else 3)]
        rows = [r if r.count('"') % 2 == 0 or r.startswith("plain") else r + '"' for r in rows]
        text = "\n".join(rows) + "\n"
        (tmp_path / f"{name}.csv").write_text(text)
        read = [r for r in csv.reader(io.StringIO(text, newline="")) if r and (len(r) > 1 or r[0].strip())]
        wants[f"{name}.csv"] = read
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = supplied.read_lines(spark, str(tmp_path)).select(
            F.element_at(F.split("file", "/"), -1).alias("file"), "row_number", supplied._cells(F.col("line")).alias("cells")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    for name, read in wants.items():
        rows = sorted((r["row_number"], r["cells"]) for r in got if r["file"] == name)
        assert [n for n, _ in rows] == list(range(1, len(read) + 1))
        assert [c for _, c in rows] == read


def test_files_without_rows_are_reported(spark, tmp_path):
    header = ",".join(supplied.REQUIRED)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text(header + "\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    lines, files = supplied.read_lines(spark, str(tmp_path)), supplied.list_files(spark, str(tmp_path))
    name = F.element_at(F.split("file", "/"), -1).alias("file")
    bad = {r["file"]: r["reason"] for r in supplied.unreadable_files(lines, files).select(name, "reason").collect()}
    assert bad["empty.csv"] == "no header" and bad["other.csv"].startswith("missing required") and len(bad) == 2
    validated = supplied.validate_rows(supplied.parse_rows(lines), "REGIONAL_OFFICE")
    fit = [tuple(r) for r in supplied.file_usability(validated, lines).select(name, "rows_read", "rows_rejected", "rejection_rate", "usable").collect()]
    assert fit == [("header.csv", 0, 0, D("0.000"), False)]
