"""Toxicity: held-out accuracy on planted texts, the label model, and the edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.llm import toxicity as tx
from prefloom.llm.queries import QUERIES
from prefloom.llm.words import Words

SF01 = "/root/testdata/sf0.01"


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def planted(seed, n):
    """Texts of three vocabularies; toxic ones hold words of that vocabulary's own bad stems, none of them in the lexicon."""
    r = random.Random(seed)
    stems = ["grulm", "vexta", "ploog"]
    vocabularies = [[f"{c}{a}{b}" for a in "aeiou" for b in ("n", "rt", "st", "lm", "x", "nd", "ff")] for c in ("b", "kr", "d")]
    docs, labels = [], []
    for i in range(n):
        k, toxic = i % 3, r.random() < 0.2
        words = r.choices(vocabularies[k], k=r.randrange(20, 150))
        if toxic:
            for _ in range(r.randrange(2, 6)):
                words.insert(r.randrange(len(words)), stems[k] + r.choice("abcdefgh") + r.choice("xyz"))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = planted(3, 1200)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    t = spark.createDataFrame([x for x in labels if not out(x[0])], "doc_id long, quality int, toxic int")
    return d, labels, tx.fit_toxicity(d, t)


def test_held_out_accuracy(spark, fitted):
    d, labels, model = fitted
    got = {r.doc_id: r for r in tx.score_documents(d, model).collect()}
    held = [x for x in labels if out(x[0])]
    assert {i for i, r in got.items() if r.held_out} == {x[0] for x in held}
    toxic = [got[i].predicted for i, _, t in held if t]
    clean = [got[i].predicted for i, _, t in held if not t]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_voters_and_label_model(spark, fitted):
    _, _, model = fitted
    report = {r.voter: r for r in model.voter_report(spark).collect()}
    mined = [v for v in report if v.startswith("beginning")]
    assert {s for s in ("gru", "vex", "plo") if any(s in v for v in mined)} == {"gru", "vex", "plo"}
    for v in mined:
        assert report[v].toxic_rate > 0.5 and report[v].clean_rate < 0.05
    assert abs(model.labels.prior - 0.2) < 0.05
    assert model.labels.correlated  # nested beginnings fire together


def test_correlated_voters_count_once(spark):
    """Ten copies of one weak voter say no more than the voter itself."""
    r = random.Random(0)
    rows = []
    for _ in range(3000):
        toxic = r.random() < 0.2
        strong = r.random() < (0.9 if toxic else 0.01)
        weak = r.random() < (0.5 if toxic else 0.2)
        rows.append(([0] * strong + list(range(1, 11)) * weak, float(toxic) if r.random() < 0.3 else None))
    p = spark.createDataFrame(rows, "votes array<int>, share double").groupBy("votes", "share").agg(F.count("*").cast("double").alias("n"))
    voters = tx.Voters(np.arange(11, dtype=np.uint64), [str(i) for i in range(11)], np.array([0.9] + [0.5] * 10), np.array([0.01] + [0.2] * 10))
    model = tx.fit_label_model(p.cache(), voters, 0.2)
    assert len({model.groups[i] for i in range(1, 11)}) == 1 and model.groups[0] != model.groups[1]
    ask = spark.createDataFrame([([0],), (list(range(1, 11)),), ([],)], "votes array<int>").select(model.posterior(F.col("votes")).alias("p"))
    one, copies, none = (x.p for x in ask.collect())
    assert one > 0.8 and copies < 0.7 and none < 0.15


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = planted(5, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    lied = [(i, q, 1 - t if out(i) else t) for i, q, t in labels]
    a, b = (tx.score_documents(d, tx.fit_toxicity(d, spark.createDataFrame(x, schema))) for x in (labels, lied))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_edge_rows(spark):
    docs, labels = planted(7, 300)
    rows = [(i, t, "en", 0.5) for i, t in docs] + [(900, None, None, None), (901, "", "en", 1.0), (None, "idiot idiot", "en", 1.0), (5, docs[5][1], "en", 0.0), (902, "grulmax " * 20000, "x", 0.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    t = spark.createDataFrame([*labels, (0, 1, 7), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = tx.score_documents(d, tx.fit_toxicity(d, t))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, by.values())) == len(rows) and len(by[5]) == 2 and by[5][0] == by[5][1]
    assert by[900][0].score == by[901][0].score and by[None][0].held_out is False
    empty = tx.fit_toxicity(d.limit(0), t)
    assert tx.score_documents(d.limit(0), empty).collect() == []
    unlabelled = tx.fit_toxicity(d, t.limit(0))
    assert tx.score_documents(d, unlabelled).count() == len(rows)


def test_keys_against_plain_python():
    data = "Abcdefghi ab ÉTÉ abc Abc abcdef".encode()
    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64))
    _, keys = tx.keys_of(w)
    got = sorted(tx.beginning(int(k)) for k in keys if int(k) >> 56)
    want = []
    for word in (b"abcdefghi", b"ab", "ÉTÉ".encode().replace(b"T", b"t"), b"abc", b"abc", b"abcdef"):
        want += [word[:n] for n in tx.BEGINNINGS if len(word) >= n]
    assert got == sorted(want)
    finder = tx.Finder(np.array([int(k) for k in keys if tx.beginning(int(k)) == b"abc"][:1], np.uint64) | np.array([0, 1 << 60, 2 << 60], np.uint64))
    doc, number = finder.find(w)
    assert doc.tolist() == [0, 0, 0] and number.tolist() == [0, 1, 2]  # "abc" begins four words


def test_query(spark):
    got = QUERIES["op11_toxicity"](spark, SF01).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert sum(r.predicted for r in held if labels[r.doc_id] == 0) <= 2
    assert sum(r.predicted for r in held if labels[r.doc_id]) >= 0.6 * sum(labels[r.doc_id] for r in held)
