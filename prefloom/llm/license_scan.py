"""Licence scan: a trained paragraph classifier, calibrated, confirmed by templates.

A softmax regression over hashed word one- and two-grams names the licence
family of each paragraph (line), or "none".  It is fitted on a bounded sample
of labelled rows: template sentences and their damaged copies, corpus
paragraphs that a template labels, and corpus paragraphs without a licence
cue.  A held-out part sets the temperature and the least probability of a
family; below it a paragraph is "unknown".  A prediction is confirmed when
the paragraph shares enough two-grams with a template of that family.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.words import Words, blocks

# fixed values: public licence notices by family
TEMPLATES = {
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "it under the terms of the gnu affero general public license as published by the free software foundation",
    ],
    "apache": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www apache org licenses license 2.0",
    ],
    "bsd": [
        "licensed under the bsd 3 clause license",
        "released under the bsd 2 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "cc-by": [
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4.0",
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4.0",
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    ],
    "cc0": [
        "released under cc0 1.0 universal public domain dedication",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or any later version",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2.1",
        "it under the terms of the gnu lesser general public license as published by the free software foundation",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied",
    ],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "proprietary": ["all rights reserved", "copyright all rights reserved no part may be reproduced without permission"],
}
CUE = r"(?i)licen[sc]e|all rights reserved|copyright|\bcc[ -]?(by|0)|creative commons|permission is hereby|redistribution and use"
NONE = "none"
LABELS = [NONE, *TEMPLATES]

DIMENSIONS = 1 << 14
SAMPLE_ROWS = 4000  # corpus rows with a cue, and as many without, that the fit reads at most
COPIES = 40  # damaged copies of each template sentence
STEPS, RATE, DECAY = 250, 0.05, 1e-4
PRECISION = 0.995  # of held-out predictions above the chosen probability
SHARED = 0.6  # of a template's two-grams in the paragraph
SEED = 7


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed one- and two-gram numbers and the text number of each, in text order."""
    two, ok = w.grams(2)
    idx = np.concatenate([w.hash, two[ok]]) % np.uint64(DIMENSIONS)
    doc = np.concatenate([w.doc, w.doc[: len(ok)][ok]])
    order = np.argsort(doc, kind="stable")
    return idx[order].astype(np.int64), doc[order]


def _words_of(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


@dataclass
class Model:
    weight: np.ndarray  # features x labels
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5

    def logits(self, w: Words) -> np.ndarray:
        """Rows are texts; contributions are averaged with the root of the length, as in the fit."""
        out = np.tile(self.bias, (w.n_texts, 1)).astype(np.float32)
        idx, doc = features(w)
        if len(idx):
            has, first, count = np.unique(doc, return_index=True, return_counts=True)
            sums = np.add.reduceat(self.weight[idx], first, axis=0)
            out[has] += sums / np.sqrt(count)[:, None].astype(np.float32)
        return out

    def probabilities(self, w: Words) -> np.ndarray:
        z = self.logits(w) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _damaged(r: np.random.Generator, words: list[str], filler: list[str]) -> str:
    out = []
    for x in words:
        u = r.random()
        if u < 0.06:
            continue
        out.append(x if u < 0.97 else filler[r.integers(len(filler))])
    before = [filler[i] for i in r.integers(0, len(filler), r.integers(0, 4))]
    after = [filler[i] for i in r.integers(0, len(filler), r.integers(0, 6))]
    return " ".join([*before, *out, *after])


def fit(labelled: list[tuple[str, str]], filler: list[str]) -> Model:
    """Softmax regression on (text, label) rows and damaged templates; every fifth row is held out."""
    r = np.random.default_rng(SEED)
    rows = list(labelled)
    for family, texts in TEMPLATES.items():
        for t in texts:
            rows += [(t, family), *((_damaged(r, t.split(), filler), family) for _ in range(COPIES))]
    every = [x for t in TEMPLATES.values() for y in t for x in y.split()]
    for _ in range(COPIES * 20):  # licence words out of place are no licence
        n = int(r.integers(3, 14))
        mixed = [every[i] if r.random() < 0.35 else filler[r.integers(len(filler))] for i in r.integers(0, len(every), n)]
        rows.append((" ".join(mixed), NONE))
    r.shuffle(rows)
    held = np.arange(len(rows)) % 5 == 0
    train = [x for x, h in zip(rows, held, strict=True) if not h]
    test = [x for x, h in zip(rows, held, strict=True) if h]
    model = Model(np.zeros((DIMENSIONS, len(LABELS)), np.float32), np.zeros(len(LABELS), np.float32))
    w = _words_of([t for t, _ in train])
    y = np.array([LABELS.index(k) for _, k in train])
    idx, doc = features(w)
    scale = (1 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(train)), 1))).astype(np.float32)[doc][:, None]
    m = [np.zeros_like(model.weight), np.zeros_like(model.weight)]
    mb = [np.zeros_like(model.bias), np.zeros_like(model.bias)]
    share = np.bincount(y, minlength=len(LABELS))
    cost = (1 / np.maximum(share, 1) ** 0.5)[y]
    cost = (cost / cost.sum()).astype(np.float32)
    order = np.argsort(idx, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(idx[order]) > 0]))
    used = idx[order][cut]
    for step in range(1, STEPS + 1):
        p = model.probabilities(w).astype(np.float32)
        p[np.arange(len(y)), y] -= 1
        p *= cost[:, None]
        g = model.weight * DECAY
        g[used] += np.add.reduceat((p[doc] * scale)[order], cut, axis=0)
        for x, grad, (a, b) in ((model.weight, g, m), (model.bias, p.sum(axis=0), mb)):
            a += 0.1 * (grad - a)
            b += 0.001 * (grad * grad - b)
            x -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    _calibrate(model, test)
    return model


def _calibrate(model: Model, held: list[tuple[str, str]]) -> None:
    """Temperature by held-out likelihood; least probability by held-out precision."""
    w = _words_of([t for t, _ in held])
    y = np.array([LABELS.index(k) for _, k in held])
    best = None
    for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0):
        model.temperature = t
        loss = -np.log(model.probabilities(w)[np.arange(len(y)), y] + 1e-9).mean()
        if best is None or loss < best[0]:
            best = (loss, t)
    model.temperature = best[1]
    p = model.probabilities(w)
    top, conf = p.argmax(axis=1), p.max(axis=1)
    for least in np.arange(0.3, 0.96, 0.05):
        said = (top > 0) & (conf >= least)
        model.least = float(round(least, 2))
        if said.any() and (top == y)[said].mean() >= PRECISION:
            return


def _grams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def template_words() -> dict[str, list[set[tuple[str, str]]]]:
    w = {k: [_words_of([t]) for t in v] for k, v in TEMPLATES.items()}
    return {k: [_grams([x.decode() for x in y.text(0, len(y)).split(b" ")]) for y in v] for k, v in w.items()}


def confirm(text: str, family: str, templates: dict[str, list[set[tuple[str, str]]]]) -> float:
    """The largest share of a family template's two-grams that the paragraph has."""
    g = _grams(text.split(" "))
    return max(len(t & g) / len(t) for t in templates[family])


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` corpus lines with a licence cue and as many without.

    The lines are those with the least hashes, so the sample does not depend
    on partitions.  A cue line is labelled by the template it shares most
    with, if any; other cue lines are left out.
    """
    lines = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("t")).filter(F.length("t").between(8, 400))
    order = F.xxhash64("t")
    # only lines whose hash can be among the least, so that what tasks send does not grow with their number
    total = max(lines.count(), 1)
    low = order <= F.lit(min(8 * sample_rows * 2**64 // total - 2**63, 2**63 - 1))
    cue = [r.t for r in lines.filter(F.col("t").rlike(CUE)).groupBy("t").agg(F.lit(1)).orderBy(order, "t").limit(sample_rows).collect()]
    plain = [r.t for r in lines.filter(low & ~F.col("t").rlike(CUE)).orderBy(order, "t").limit(sample_rows).collect()]
    templates = template_words()
    rows = [(t, NONE) for t in plain]
    for t in cue:
        w = _words_of([t])
        s = w.text(0, len(w)).decode()
        score, family = max((confirm(s, k, templates), k) for k in TEMPLATES)
        if score >= SHARED:
            rows.append((t, family))
    filler = sorted({x for t in plain[:500] for x in t.split()}) or ["x"]
    return fit(rows, filler)


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = pickle.loads(shared.value)
        templates = template_words()
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column("t")):
                ends = np.flatnonzero(data == 10) + 1
                cuts = np.unique(np.concatenate([offs, ends]))
                w = Words(data, cuts.astype(np.int64))
                p = model.probabilities(w)
                top, conf = p.argmax(axis=1), p.max(axis=1)
                owner = np.searchsorted(offs, cuts[:-1], side="right") - 1
                count = np.bincount(owner[w.count() > 0], minlength=hi - lo)
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                line = np.arange(len(owner)) - np.searchsorted(owner, owner)
                for i in np.flatnonzero((top > 0) & (w.count() > 0)).tolist():
                    family = LABELS[top[i]] if conf[i] >= model.least else "unknown"
                    share = confirm(w.text(int(w.first[i]), int(w.first[i + 1])).decode(), LABELS[top[i]], templates)
                    found[owner[i]].append(
                        {"line": int(line[i]), "family": family, "probability": round(float(conf[i]), 4), "shared": round(share, 4), "confirmed": family != "unknown" and share >= SHARED}
                    )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(count.astype(np.int64)), pa.array(found, ARROW_FOUND)], names=["id", "n_paragraphs", "found"]
                )

    return scan


FOUND = "array<struct<line:int,family:string,probability:double,shared:double,confirmed:boolean>>"
ARROW_FOUND = pa.list_(
    pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("shared", pa.float64()), ("confirmed", pa.bool_())])
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id, n_paragraphs, found: per document the paragraphs that read as licences.

    A null or empty text has no paragraphs.  Rows keep their multiplicity;
    further columns are ignored.
    """
    model = model or train(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = d.mapInArrow(_scanner(shared), f"id {d.schema['id'].dataType.simpleString()}, n_paragraphs long, found {FOUND}")
    return out.withColumnRenamed("id", id_col)


def license_summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_paragraphs, n_predicted, n_unknown, n_confirmed, families (confirmed, sorted, comma-joined)."""
    count = lambda condition: F.expr(f"cast(size(filter(found, x -> {condition})) as bigint)")
    families = F.expr("array_join(array_sort(array_distinct(transform(filter(found, x -> x.confirmed), x -> x.family))), ',')")
    return found.select(
        id_col, "n_paragraphs", count("x.family <> 'unknown'").alias("n_predicted"), count("x.family = 'unknown'").alias("n_unknown"),
        count("x.confirmed").alias("n_confirmed"), families.alias("families"),
    )
