"""Registered queries against SQL on the smallest tables, and the pipeline stage by stage."""

import collections
import random
import re

import pytest

import corpus_pipeline
from check import compare, connect
from indexwright.llm import lines, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    note = compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name])
    assert "differ" not in note and "rows" not in note and "columns" not in note, note


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op1_language_profiles"](spark, FOLDER).filter("held_out")
    langs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    right, n = got.join(langs, "doc_id").selectExpr("avg(int(lang = lang_pred))", "count(*)").first()
    assert n > 20 and right >= 0.97


def test_pipeline_stages(spark, docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame, kept = docs.select(*columns), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, FOLDER)
        rows = out.collect()
        if name != "bpe":
            assert out.columns == columns
            frame = spark.createDataFrame(rows, out.schema)
            if name != "mix_sources":
                assert len(rows) <= (kept[-1] if kept else 10**6)
            kept.append(len(rows))
        else:
            assert all(r["round_trip"] for r in rows) and len(rows) == kept[-1]


def test_pipeline_on_an_empty_table(spark, no_docs):
    frame = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, FOLDER)
        assert frame.count() == 0
        if "text" in frame.columns:
            frame = spark.createDataFrame([], frame.schema)


def _failing(line):
    separators = len(re.findall(lines.SEPARATOR, line))
    if separators >= 3 and separators * 30 >= len(line):
        return True
    small = line.lower()
    said = re.findall(lines.PHRASES, small)
    chars = sum(map(len, said))
    if said and (2 * chars >= len(small) or 4 * chars >= len(small) and len({re.sub(" |s$", "", x) for x in said}) > 1):
        return True
    if len(line) < 40 and line.rstrip()[-1] not in lines.CLOSING:
        return True
    return len(re.findall(r"[#*$%&|<>~^_=\\{}]", line)) * 10 > len(line)


def _brute_stages(rows):
    """(id, text) after the quality rules, exact copies and near copies of 80 percent."""
    clean = []
    for doc, text in rows:
        words, at = text.split(), collections.defaultdict(list)
        for i in range(len(words) - 4):
            at[tuple(words[i:i + 5])].append(i)
        repeat = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(5)}
        solid = [x for x in text.split("\n") if x.strip()]
        lost = [x for x in solid if _failing(x)]
        if len(words) >= 10 and 100 * len(repeat) <= 20 * len(words) and 2 * sum(map(len, lost)) <= sum(map(len, solid)):
            clean.append((doc, "\n".join(x for x in text.split("\n") if not x.strip() or not _failing(x))))
    best = {}
    for doc, text in sorted(clean, key=lambda r: (-len(r[1]), r[0])):
        best.setdefault("".join(text.split()), (doc, text))
    single = sorted(best.values())
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for _, t in single)]
    root = list(range(len(single)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    seen = set()
    return clean, single, [r for k, r in zip(root, single) if not (k in seen or seen.add(k))]


def test_first_stages_like_brute_force(spark):
    pick = random.Random(12)
    word = lambda: "".join(pick.choice("abcdeghiklmnrstu") for _ in range(7))
    prose = lambda n: [word() + ("." if i % 12 == 11 else "") for i in range(n)]
    data = []
    for k in range(40):
        base = prose(300) + ["end."]
        data.append((4 * k, " ".join(base)))
        # One changed word in 30 to 90: they share 71 to 90 percent.
        changed = list(base)
        for at in range(10, 300, 30 + 3 * (k % 20)):
            changed[at] = word()
        data.append((4 * k + 1, " ".join(changed)))
        data.append((4 * k + 2, "short head\n" + " ".join(base)))
    data += [(2000, "\n".join([" ".join(prose(40)) + " end.", "This work is licensed under the GNU General Public License, version 3.", " ".join(prose(40)) + " end."]))]
    data += [(1000, "Home | News | Sport | Help\n" + " ".join(prose(90)) + " end."), (1001, "too short."), (1002, "ab cd ef gh ij. " * 30)]
    wants = _brute_stages(data)
    assert len(wants[1]) < len(wants[0]) and any(d % 4 == 1 for d, _ in wants[2]) and len(wants[2]) < len(wants[1])
    frame = spark.createDataFrame([(d, t, "en", "s1", len(t)) for d, t in data], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        out = stage(spark, frame, FOLDER)
        rows = out.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(want), name
        frame = spark.createDataFrame(rows, out.schema)


def test_verdicts_on_boilerplate_like_brute_force(spark):
    licences = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
                "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "The software is distributed under the terms of the BSD licence!"]
    junk = ["Tous droits réservés.", "Alle Rechte vorbehalten, 2024.", "Click here. Read more. " * 20, "Cookies, cookies and a privacy policy", "Copyright © 2019 Example Press. All rights reserved."]
    prose = ["The council approved the bridge after a long debate on its design, which was licensed under an older law of the county.",
             "The baker put a cookie into every box, and the children found the cookies before their parents.",
             "It was released under the MIT licence long ago, and since then " + "many hands have changed it without asking anyone " * 9 + "in the end.",
             "They would sign inside the margin and read moreover what the others had written there before them."]
    data = [(i, x) for i, x in enumerate(licences + junk + prose)]
    data += [(100 + i, "\n".join([prose[0], x, prose[1]])) for i, x in enumerate(licences + junk)]
    data += [(200 + i, "\n".join([x, prose[3], x, x])) for i, x in enumerate(licences + junk)]

    def kept(text):
        words, at = text.split(), collections.Counter(tuple(text.split()[i:i + 5]) for i in range(len(text.split()) - 4))
        repeat = {i + k for i in range(len(words) - 4) if at[tuple(words[i:i + 5])] > 1 for k in range(5)}
        solid = text.split("\n")
        return len(words) >= 10 and 100 * len(repeat) <= 20 * len(words) and 2 * sum(len(x) for x in solid if _failing(x)) <= sum(map(len, solid))

    got = {r["doc_id"]: r for r in lines.clean_lines(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    assert {k: r["kept"] for k, r in got.items()} == {k: kept(t) for k, t in data}
    n = len(licences + junk)
    assert all(got[i]["n_lines_removed"] == 1 for i in range(n)) and all(got[i]["n_lines_removed"] == 0 for i in range(n, len(licences + junk + prose)))
