import random
import re

from pyspark.sql import functions as F

from millrace.llm import licenses

SCHEMA = "doc_id long, text string, words string, pos int, label string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    words, places, labels = words_of(text), [], set()
    for label, phrase in licenses.PHRASES:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def corpus():
    rng = random.Random(6)
    fill = ["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "É", "x_y", "word", "a\x00b", "Kelvin", "İ"]
    out = [(i, rng.choice([" ", "-", "\n", ", "]).join(rng.choice(fill) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    out += [(1000, None), (1001, ""), (1002, "cc-by-nc"), (1003, "CC BY NC cc by nc by nc cc by nc"), (1004, "cc by")]
    out += [(None, "Under the MIT License."), (1005, "x under the mit license"), (1005, "x under the mit license"), (1006, "pad " * 60_000 + "cc by nc")]
    return out


def test_base_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    got = licenses.scan_licenses(df).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((d, *base(t)) for d, t in rows), key=key)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.score == 1 or not r.n_base
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_changed_templates_are_found(spark):
    bsd = dict(licenses.TEMPLATES)["bsd"].split()
    fewer = " ".join(bsd[:8] + bsd[9:])
    more = " ".join(bsd[:8] + ["really"] + bsd[8:])
    part = " ".join(bsd[:6])
    rows = [(1, "intro " * 7 + " ".join(bsd)), (2, fewer), (3, more), (4, part), (5, " ".join(reversed(bsd)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[i].labels for i in range(1, 6)] == ["bsd", "bsd", "bsd", "", ""]
    assert got[1].score == 1 and got[2].score < 1 and 0 < got[4].score < 0.7 and got[5].score == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_order_and_extent_count(spark):
    """Runs one after the other, out of order, or far apart are no license."""
    bsd = dict(licenses.TEMPLATES)["bsd"].split()
    runs = [bsd[i : i + 3] for i in range(len(bsd) - 2)]
    stutter = " ".join(w for r in runs for w in r)
    shuffled = " ".join(w for r in reversed(runs) for w in r)
    apart = " pad pad pad pad pad pad pad pad ".join(" ".join(r) for r in runs)
    halves = " ".join(bsd[10:] + bsd[:10])
    df = spark.createDataFrame(list(enumerate([stutter, shuffled, apart, halves, " ".join(bsd)])), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert [got[i].labels for i in range(5)] == ["", "", "", "", "bsd"]
    assert max(got[i].score for i in range(4)) < licenses.COVERAGE and got[4].score == 1


def test_versions_are_told_apart(spark):
    text = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    bsd3 = dict(licenses.TEMPLATES)["bsd"] + " a b c " + dict(licenses.TEMPLATES)["bsd-3"]
    by = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    lesser = text.format(3).replace("GNU General", "GNU Lesser General")
    rows = [(5, by.format("")), (6, by.format("-ShareAlike")), (7, lesser)]
    rows += [(1, text.format(2)), (2, text.format(3)), (3, "GNU General Public License, version 3."), (4, bsd3)]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "gpl-2", 2: "gpl-3", 3: "gpl-3", 4: "bsd-3", 5: "cc-by", 6: "cc-by-sa", 7: "lgpl-3"}


def test_names_that_differ_by_a_word(spark):
    """A license whose name holds another's, or that another's notice quotes, gets its own label only."""
    rows = [
        ("GNU Affero General Public License version 3", "agpl-3"),
        ("GNU Lesser General Public License version 2", "lgpl-2"),
        ("the GNU Lesser General Public License, version 2.1 or later", "lgpl-2.1"),
        ("either version 2 of the License Agreement for Acme Widgets", ""),
        ("either version 3 of the License", ""),
        ("see the GNU General Public License for details", "gpl"),
        ("a GNU Lesser General Public License ... either version 3 of the License", "lgpl"),
        ("GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "agpl-3"),
        ("GNU General Public License version 2, GNU Lesser General Public License", "gpl-2,lgpl"),
        ("BSD 2-Clause License", "bsd-2"),
        ("under the MIT License, not the general public license version 3", "mit"),
        ("Creative Commons Attribution NonCommercial 4.0, CC BY NC", "cc-by-nc"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def brute_score(text, templates, drift):
    """Best share of a template's runs in a chain of hits, over all spans of ``drift`` + 1 diagonals."""
    words, best = words_of(text), 0.0
    for _, template in templates:
        parts = template.split()
        n = len(parts) - 2
        hits = sorted((t, p) for t in range(n) for p in range(len(words) - 2) if words[p : p + 3] == parts[t : t + 3])
        for low in {p - t for t, p in hits}:
            span = [(t, p) for t, p in hits if low <= p - t <= low + drift]
            length = [1] * len(span)
            for j, (t, p) in enumerate(span):
                length[j] = 1 + max((length[i] for i in range(j) if span[i][0] < t and span[i][1] < p), default=0)
            best = max(best, max(length) / n)
    return best


def test_spans_against_brute_force(spark):
    rng = random.Random(8)
    templates = [t for t in licenses.TEMPLATES if t[0] in ("bsd", "isc", "cc0")]
    rows = []
    for i in range(150):
        words = rng.choice(templates)[1].split()
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 3)] = rng.choice([[], ["x"], words[:4], words[at : at + 5]])
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in licenses.scan_licenses(df, phrases=[], templates=templates, exact=[]).collect()}
    assert {d: round(s, 9) for d, s in got.items()} == {d: round(brute_score(t, templates, licenses.DRIFT), 9) for d, t in rows}
    assert len(set(got.values())) > 10
