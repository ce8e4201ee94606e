from __future__ import annotations

import re
import textwrap

import pytest

from verbarium.llm import licenses, oracle

from .conftest import multiset


def words_of(text: str) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text: str | None) -> tuple:
    text = text or ""
    words = words_of(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    own, best = set(), 0.0
    lines = [found for line in text.split("\n") if (found := words_of(line))]
    for name, template in licenses.TEMPLATES.items():
        wanted, most = set(words_of(template)), len(words_of(template))
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(map(len, lines[a + 1 : b])) > most:
                    break
                overlap = len(wanted & {w for line in lines[a : b + 1] for w in line})
                if overlap >= licenses.needed(len(wanted), licenses.CONTAINMENT):
                    own.add(name)
                    best = max(best, overlap / len(wanted))
    first, last = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(labels)), ",".join(sorted(labels | own)), 1.0 if places else best


def check(docs):
    found = [tuple(r) for r in licenses.scan(docs).collect()]
    assert multiset(found) == multiset((r["doc_id"], *brute(r["text"])) for r in docs.collect())


def test_odd_rows(odd_docs):
    check(odd_docs)


def test_all_documents(small_docs):
    check(small_docs)


def test_empty_table(no_docs):
    assert licenses.scan(no_docs).count() == 0


def test_edges_of_phrases_and_thresholds(spark):
    grant = licenses.TEMPLATES["mit-grant"].split()
    texts = [
        "MIT License, MIT-license: mit license",
        "submit license amit licensee",
        "CC  BY\nCC\nBY cc.by",
        "éMIT License MIT Licenseé",
        "The GNU General\nPublic License and the Apache License",
        " ".join(grant),
        " ".join(grant[: len(grant) * 3 // 4]),
        " ".join(grant[::-1]),
        " ".join(grant[:12]) + "\n" + " ".join(grant[12:]),
        *(" ".join(grant[k:]) for k in range(1, 12)),
        "\n".join(licenses.TEMPLATES.values()),
        "you may use this under the mozilla public license version 2.0 of the source code form terms subject is",
    ]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


@pytest.mark.parametrize("n", range(1, 40))
def test_needed_words(n):
    c = licenses.needed(n, 0.8)
    assert c * 10 >= n * 8 > (c - 1) * 10


def test_no_python_on_the_main_path(odd_docs):
    plan = licenses.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"):
        assert word not in plan


def wrapped(template: str, width: int) -> list[str]:
    lines = textwrap.wrap(template, width, break_long_words=False)
    return [
        "Some text.\n\n" + "\n".join(lines) + "\n\nMore of it.",
        "/*\r\n" + "\r\n".join(f" * {x}" for x in lines) + "\r\n */",
        "\n\n".join(lines),
        "\n#\n".join(f"# {x}" for x in lines),
    ]


@pytest.mark.parametrize("width", [1, 12, 20, 30, 40, 72, 80, 1000])
def test_wrapped_templates(spark, width):
    rows = [(name, text) for name, template in licenses.TEMPLATES.items() for text in wrapped(template, width)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = licenses.scan(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["doc_id"] in r["labels"].split(",")
    assert multiset(map(tuple, found)) == multiset((i, *brute(text)) for i, text in rows)


def test_words_far_apart_are_no_notice(spark):
    rows = [(name, ("word " * 30 + "\n").join(template.split())) for name, template in licenses.TEMPLATES.items() if len(template.split()) > 20]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = licenses.scan(docs).collect()
    assert not any(set(r["labels"].split(",")) & set(licenses.TEMPLATES) for r in found)
    assert multiset(map(tuple, found)) == multiset((i, *brute(text)) for i, text in rows)


def test_letters_beyond_ascii_are_no_template_words(spark):
    text = licenses.TEMPLATES["gpl-3-short"].replace("work", "wor\u212a")
    docs = spark.createDataFrame([(1, text), (2, "mit licen\u017fe"), (3, "M\u0130T L\u0130CENSE")], "doc_id long, text string")
    assert multiset(map(tuple, licenses.scan(docs).collect())) == multiset((i, *brute(t)) for i, t in docs.collect())


def test_clashing_columns_and_long_texts(spark):
    notice = "\n".join(licenses.TEMPLATES["isc"].split())
    text = "a line of plain words\n" * 50_000 + notice + "\nand more" * 50_000
    docs = spark.createDataFrame([(1, text, 1, "x", 2), (2, None, 1, "x", 2)], "doc_id long, text string, k1 int, lines string, near int")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (found[1]["labels"], found[1]["n_words"]) == ("isc", 350_000 + len(words_of(notice)))
    assert tuple(found[2])[1:] == (0, 0, None, None, "", "", 0.0)


def test_sql_on_wrapped_notices(spark, tmp_path):
    import duckdb

    rows = [(n, text) for n, text in enumerate(t for width in (1, 40, 72) for x in licenses.TEMPLATES.values() for t in wrapped(x, width))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
        expected = db.execute(oracle.op5_licenses()).fetchall()
    assert multiset(map(tuple, licenses.scan(docs).collect())) == multiset(expected)
