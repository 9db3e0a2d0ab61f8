"""Personal data against Python's own regular expressions, and the kinds that context decides."""

import re

import pytest
from pyspark.sql import functions as F

from indexwright.llm import personal, queries

HARD = [
    "mail a@b.c_d@e.f x@y.zz a@b_c@d.e.f .@-.- %@a.b.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.255 1.1.1.1.1 9999.1.2.3 0000000001.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1111, 41111111111111111 4111  1111 1111 1111 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "5500005555555559 4111111111111111 30569309025904",
    "+1 (743) 555-3824 +44 20 7946 0958 +1 2 +12345678901234567 ++49 30 123456-7 +4930123456().-8", "é😀 a@b.co 日本 +1 743 555 3824 😀 10.0.0.1",
    "9" * 4000, "a" * 30000, "x." * 8000 + "@", "a@" * 3000, "1." * 6000, ("4111 1111 1111 1111, " * 700) + "x@y.zz " * 600, "0 " * 9000,
]


def _luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def _brute(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        spans += [(m.start(), 2, m.end())] * (14 <= len(digits) <= 19 and _luhn(digits))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


def test_base_spans(spark, docs, rows):
    hard = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    frame = docs.select("doc_id", "text").unionByName(hard)
    got = personal.find_personal(frame).collect()
    assert len(got) == len(rows) + len(HARD)
    for r in got:
        base = [(s["start"], personal.KINDS.index(s["kind"]), s["end"]) for s in r["spans"] if s["kind"] in personal.BASE]
        assert base == _brute(r["text"] or ""), r["doc_id"]
        assert all(s["match"] == r["text"][s["start"]:s["end"]] for s in r["spans"])


CASES = {
    "IBAN: GB82 WEST 1234 5698 7654 32 please": [("iban", "GB82 WEST 1234 5698 7654 32")],
    "DE89370400440532013000": [("iban", "DE89370400440532013000")],
    "DE89370400440532013001": [], "GB82WEST1234569876543": [],
    "my ssn is 219-09-9999": [("ssn", "219-09-9999")], "code 219-09-9999": [], "ssn 000-09-9999": [], "invoice ssn 219-09-9999": [],
    "call (212) 555-0173 now": [("local_phone", "(212) 555-0173")], "212-555-0173": [], "telefon 212.555.0173": [("local_phone", "212.555.0173")],
    "born 1984-07-12": [("birth_date", "1984-07-12")], "on 1984-07-12": [], "geboren 12.7.1984.": [("birth_date", "12.7.1984")],
    "mail x@y.zz order 12": [("email", "x@y.zz")], "phone +1 212 555 0173": [("phone", "+1 212 555 0173")],
}


def test_context_and_checksums(spark):
    frame = spark.createDataFrame([(t,) for t in CASES], "text string")
    got = {r["text"]: [(s["kind"], s["match"]) for s in r["spans"]] for r in personal.find_personal(frame).collect()}
    assert got == CASES


def test_words_nearby_move_the_score(spark):
    texts = ["4111111111111111", "card 4111111111111111", "invoice 4111111111111111", "4111111111111111 is an order of my card"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    scores = [r["spans"][0]["score"] for r in personal.find_personal(frame).collect()]
    assert scores == [0.8, 1.0, 0.5, 0.8]


def test_spans_can_be_exploded_and_names_may_clash(spark, docs, no_docs):
    found = personal.find_personal(docs)
    assert sorted(found.columns) == sorted(docs.columns)
    kinds = found.select(F.explode("spans").alias("s")).filter("s.kind = 'card'").count()
    assert kinds == sum(s["kind"] == "card" for r in found.collect() for s in r["spans"])
    assert personal.find_personal(no_docs).count() == 0 and personal.redact(no_docs).columns == no_docs.columns


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "to a@b.cc or +1 212 555 0173."), (2, "clean"), (3, ""), (4, None), (5, "x@1.2.3.4 end")], "id int, text string")
    assert [r["text"] for r in personal.redact(frame).orderBy("id").collect()] == ["to [email] or [phone].", "clean", "", None, "[email] end"]


@pytest.mark.parametrize("name", ["op13_personal_data"])
def test_query_uses_no_python_workers(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
