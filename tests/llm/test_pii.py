"""Personal data: base entities against the plain expressions, and planted contexts."""

import hashlib
import random
import re

import pytest

from prefloom.llm import pii_bootstrap as pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def brute(t):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m.group().split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 12 <= len(d) <= 19 and odd % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], ["email", "ip", "card", "phone"].index(x[2])))


def test_base_entities_equal_the_expressions():
    r = random.Random(3)
    parts = ["a", "b.c", "@", "@", ".", "-", "+", " ", "1", "22", "255", "256", "4111111111111111", "+1 (988) 555-2485", "é", "x@y.zz", "10.0.0.1", "\n"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(0, 12)))
        assert pii.base_spans(t) == brute(t), repr(t)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.personal_data_digest(pii.find_personal_data(docs)).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for x in rows:
        want = brute(texts[x.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert x.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(x.spans.split(","))
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(k == n for _, _, k in want) for n in ("email", "ip", "card", "phone"))


def test_patterns_find_unseen_identifiers(spark):
    seeds = [(i, f"word{i} please call me at +1 (988) 555-{2400 + i} now") for i in range(30)]
    more = [(100, "please call me at 5552-17A9 today"), (101, "room 1234-5678 is free"), (102, None), (103, ""), (103, "")]
    found = pii.find_personal_data(spark.createDataFrame(seeds + more, "doc_id long, text string"))
    got = {r.doc_id: [(s.start, s.stop) for s in r.added] for r in found.collect()}
    assert got[100] == [(18, 27)]
    assert not got[101] and not got[102] and not got[103] and not got[0]
    assert found.count() == 35


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", "x", 3)], "doc_id long, text string, base string, row int")
    out = pii.personal_data_digest(pii.find_personal_data(df)).collect()[0]
    assert out.spans == "email:5:11" and out.n_email == 1
    assert pii.personal_data_digest(pii.find_personal_data(df.limit(0))).count() == 0
    assert pii.mask_personal_data(df).first().text == "mail [email]"


@pytest.mark.parametrize("text", ["a" * 200000 + " a@b.cd", "1" * 100000, "@" * 50000])
def test_long_words_are_linear(text):
    pii.base_spans(text)
    list(pii._candidates(text, []))
