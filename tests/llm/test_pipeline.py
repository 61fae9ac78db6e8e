"""The pipeline's stages against brute force, one by one, on the smallest table."""

import re

import numpy as np
import tiktoken

import corpus_pipeline as cp
import public_tokenizers as P
from prefloom.llm import bpe, line_dedup
from prefloom.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, seen = docs.columns, [docs]
    for name, stage in cp.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name.replace(" ", "-")))
    assert all(d.columns == cols for d in seen[:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 50

    # quality: clean documents stay, short ones go
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert not [i for i in good if i not in ids[1] and len(texts[i].split()) >= 20]
    assert all(len(texts[i].split()) >= 20 for i in ids[1])

    # lines: no line twice, and every line of a document comes from it
    after = {r.doc_id: r.text for r in seen[2].collect()}
    lines = [x for t in after.values() for x in t.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    assert all(set(t.split("\n")) <= set(texts[i].split("\n")) for i, t in after.items())
    assert all(r.n_chars == len(r.text) for r in seen[2].collect())
    before = {x for r in seen[1].collect() for x in r.text.split("\n") if x.strip()}
    shingle = lambda x: {x[i : i + line_dedup.SHINGLE] for i in range(max(1, len(x) - line_dedup.SHINGLE + 1))}
    kept = [shingle(x) for x in lines]
    for x in sorted(before - set(lines))[:50]:  # a line that went resembles one of its class
        s = shingle(x)
        assert max(len(s & k) / len(s | k) for k in kept) > 0.5

    # decontamination: no benchmark window is left
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(r.text.lower())
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    for r in seen[4].collect():
        w = word.findall(r.text.lower())
        assert not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))

    # encoding
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    final = {r.doc_id: r.text for r in seen[4].collect()}
    for r in seen[5].collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == lib.encode_ordinary(final[r.doc_id]) and r.n_tokens * 4 == len(r.ids)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF), name.replace(" ", "-"))
    assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark):
    """Nulls, repeated rows and columns named like the stages' own: no stage fails or changes the columns."""
    extra = ["row", "n", "kept", "gone", "doc", "t", "w", "id", "spans", "host", "ids", "n_tokens", "class_id", "strict_host"]
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "en", "s"), (1, good, "en", "s"), (2, None, None, None), (3, "", "en", None), (4, good + "\n" + good, None, "s"), (None, good + " more", "en", "s")]
    rows += [(10 + i, f"{good} and {i} " + " ".join(f"z{i}x{k}" for k in range(30)), "de", "s") for i in range(4)]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "cast(length(text) as int) n_chars", *[f"'x' as {c}" for c in extra])
    cols = docs.columns
    for name, stage in cp.STAGES:
        assert docs.columns == cols
        docs = written(stage(spark, docs, SF), name.replace(" ", "-"))
    ids = {r.doc_id for r in docs.collect()}
    assert ids == {None, 1, 10, 11, 12, 13} and {"ids", "n_tokens", "row"} <= set(docs.columns)
