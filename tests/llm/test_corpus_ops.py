"""Corpus operators against brute force on small tables, and their edge rows."""

import collections
import pickle
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefloom.llm import decontaminate, host_rules, line_dedup, ngram_join, passage_dedup
from prefloom.llm.common import connected_components, written
from prefloom.llm.oracle import ORACLE_SQL
from prefloom.llm.queries import QUERIES
from prefloom.llm.words import Words, shingles

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, h1 string, bands int, rep int, t string, id int, doc string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def table(spark, texts):
    """A table with nulls and with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None if i % 3 else "s", "x", 1, 2, "y", 3, None) for i, t in texts], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(cur.fetchall())


# --- words ----------------------------------------------------------------------------


def test_words_equal_the_expression():
    r = np.random.default_rng(1)
    alphabet = list("aZ09 .,-\n\té日😀{}@[`") + ["ab", "THE "]
    texts = ["".join(r.choice(alphabet, r.integers(0, 30))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    w = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for i, t in enumerate(texts):
        assert w.text(int(w.first[i]), int(w.first[i + 1])).decode() == " ".join(words(t))
    by_hash = collections.defaultdict(set)
    for i in range(len(w)):
        by_hash[int(w.hash[i])].add(w.text(i, i + 1))
    assert all(len(x) == 1 for x in by_hash.values())


# --- decontamination --------------------------------------------------------------------


def test_decontamination_edges_and_blocks(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame(
        [(1, item, "c"), (2, "short ITEM", "c"), (3, None, "c"), (4, "", "c"), (None, "lost words", "c"), (10, item, "c")], "item_id long, text string, spans string"
    )
    texts = [(1, "x " + item + " y"), (2, None), (3, ""), (4, "a Short, item b"), (4, "a Short, item b"), (5, "clean lost words"), (6, "z " * 50000 + item)]
    docs = table(spark, texts)
    once = decontaminate.contamination_digest(decontaminate.find_contamination(docs, bench))
    blocks = decontaminate.contamination_digest(decontaminate.find_contamination(docs, bench, max_broadcast_bytes=30))
    rows = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in once.collect())
    assert rows == [(1, 13, 11, 2, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 4, 2, 1, True), (4, 4, 2, 1, True), (5, 3, 0, 0, False), (6, 50011, 11, 2, True)]
    assert sorted(blocks.collect()) == sorted(once.collect())  # repeated rows come out repeated
    kept = {r.doc_id: r.text for r in decontaminate.remove_contamination(docs, bench).collect()}
    assert kept[4] == "a  b" and 1 not in kept and kept[2] is None and kept[5] == "clean lost words" and kept[6] == "z " * 50000
    cleaned = decontaminate.remove_contamination(docs, bench, max_broadcast_bytes=30)
    key = lambda r: (r.doc_id, r.text or "")
    assert sorted(map(key, cleaned.collect())) == sorted(map(key, decontaminate.remove_contamination(docs, bench).collect()))
    assert cleaned.count() == len(texts) - 1 and cleaned.columns == docs.columns
    assert decontaminate.find_contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_index_size_is_bounded():
    items = [(str(i), " ".join(f"w{i}x{j}" for j in range(400))) for i in range(40)] + [("long", " ".join(f"v{j}" for j in range(9000)))]
    limit = 3 << 20
    parts = list(decontaminate._indexed(items, 10, limit))
    assert len(parts) > 1 and all(len(pickle.dumps(p)) <= limit for p in parts)
    windows = lambda p: {(w, i) for table in p.lengths.values() for texts in table.values() for w, owners in texts.items() for i in owners}
    assert set().union(*map(windows, parts)) == windows(decontaminate.WindowIndex(items, 10))


# --- quality rules ----------------------------------------------------------------------


def test_rules_edges(spark):
    clean = " ".join(f"word{i}" for i in range(40))
    texts = [(1, None), (2, ""), (3, clean), (3, clean), (4, "a b c d e f g h " * 2 + clean), (5, "spam " * 60), (6, "w#### " * 40), (7, clean + "\n" + clean)]
    out = {r.doc_id: r for r in host_rules.judge_documents(table(spark, texts)).collect()}
    assert not out[1].kept and not out[2].kept and out[1].n_words == 0
    assert out[3].kept and out[4].n_repeat_words == 16 and out[4].failed_weight == 1  # its host is strict here
    assert not out[5].kept and out[5].n_repeat_words == 60 and not out[6].kept
    assert out[7].base_failed and out[7].n_dup_lines == 1 and out[7].n_repeat_words == 80
    kept = host_rules.keep_good(table(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 3] and kept.columns == table(spark, texts).columns
    assert host_rules.judge_documents(table(spark, texts).limit(0)).count() == 0


def test_strict_hosts(spark):
    """A light failure rejects on a host that fails often, not elsewhere."""
    bad, good = "w " * 19, " ".join(f"word{i}" for i in range(40))
    light = "\n".join(["one more line"] * 2 + [" ".join(f"v{i}x" for i in range(30))])
    rows = [(i, bad, "bad") for i in range(80)] + [(100 + i, good, f"ok{i % 4}") for i in range(200)] + [(900, light, "bad"), (901, light, "ok1"), (902, good, "bad")]
    out = {r.doc_id: r for r in host_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[900].failed_weight == out[901].failed_weight == 1
    assert not out[900].kept and out[901].kept and out[902].kept and out[900].strict_host


# --- n-gram join ------------------------------------------------------------------------


def brute_classes(texts, n=5, threshold=0.8):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up, deg = list(range(len(texts))), [0] * len(texts)

    def find(i):
        return i if up[i] == i else find(up[i])

    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and c >= threshold * len(sets[i] | sets[j]):
                deg[i] += 1
                deg[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], deg


def test_ngram_join_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    ids = [r.doc_id for r in docs.collect()]
    classes, deg = brute_classes(texts)
    rows = {r.doc_id: r for r in ngram_join.ngram_join(docs).collect()}
    assert [rows[i].class_id for i in ids] == [ids[c] for c in classes]
    assert [rows[i].n_links for i in ids] == deg


def test_ngram_join_repeated_rows_and_ids(spark):
    x = " ".join(f"word{i}" for i in range(60))
    y = " ".join(f"other{i}" for i in range(60))
    df = table(spark, [(1, x), (1, x), (2, x + " more")])
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(df).collect()) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    df = table(spark, [(1, x), (1, y), (2, x + " more"), (3, y + " more"), (4, "apart")])
    rows = sorted((r.doc_id, r.n_links) for r in ngram_join.ngram_join(df).collect())
    assert rows == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_ngram_join_planted(spark, block):
    r = np.random.default_rng(5)
    base = [f"w{r.integers(500)}" for _ in range(60)]
    texts = []
    for _ in range(60):
        w = list(base)
        for k in r.integers(0, 60, r.integers(0, 3)):
            w[k] = f"q{r.integers(10**6)}"
        texts.append(" ".join(w))
    texts += ["few words", "Few WORDS!", None, "", "", "other few", " ".join(f"z{i}" for i in range(20000))]
    classes, deg = brute_classes(texts)
    df = table(spark, list(enumerate(texts)))
    rows = {x.doc_id: x for x in ngram_join.ngram_join(df, block_shingles=block).collect()}
    assert [rows[i].class_id for i in range(len(texts))] == classes
    assert [rows[i].n_links for i in range(len(texts))] == deg
    kept = ngram_join.one_of_each_group(df)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(classes)) and kept.columns == df.columns
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_blocks_of_many_short_texts_stay_small(spark):
    """Many members of few words make more blocks, and a block's comparison takes stripes, not whole matrices."""
    sizes = spark.range(50_000).selectExpr("22L as n_words").agg(ngram_join.block_count().alias("n")).first()
    assert sizes.n == 25
    m = 3000
    sets = [np.arange(i // 3 * 100, i // 3 * 100 + 20 + i % 3, dtype=np.uint64) for i in range(m)]
    tracemalloc.start()
    i, j = ngram_join.links_within(sets, None, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(3 * k + a, 3 * k + b) for k in range(m // 3) for a, b in ((0, 1), (0, 2), (1, 2))]
    assert peak < 3.5 * 4 * m * m
    side = np.arange(m) % 2 == 0
    i, j = ngram_join.links_within(sets, side, 0.8)
    assert len(i) == m // 3 * 2 and (side[i] != side[j]).all()


def test_shingles_of_short_texts():
    raw = b"a b c d e f" + b"a b" + b"" + b"x"
    g, doc = shingles(Words(np.frombuffer(raw, np.uint8), np.array([0, 11, 14, 14, 15])), 5)
    assert doc.tolist() == [0, 0, 1, 3] and len(set(g.tolist())) == 4


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("prefloom.llm.common.FEW_LINKS", few)
    links = [(i, i + 1) for i in range(1, 60)] + [(200, x) for x in range(300, 330)] + [(7, 7), (None, 3), (500, 400), (400, 500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 61)} | {x: 200 for x in [200, *range(300, 330)]} | {400: 400, 500: 400}
    assert got == want


# --- lines ------------------------------------------------------------------------------


def test_line_dedup_planted(spark):
    line = "the quick brown fox jumps over the lazy dog near the old river bank while seven grey geese look on from afar today"
    near = line.replace("lazy", "hazy")
    far = "a wholly different line of text that has nothing at all in common with the other one but some very small words in it"
    texts = [(5, f"{line}\n{far}"), (6, f"{near}\nonly six here"), (7, f"x y z\n\n{far}\nx y z"), (8, None), (9, ""), (10, line), (11, "a\n\nb"), (11, "a\n\nb"), (12, "日" * 30 + "\n" + "日" * 30)]
    df = table(spark, texts)
    counts = {r.doc_id: r for r in line_dedup.dedup_lines(df, counts=True).collect()}
    assert counts[5].n_removed == 0 and counts[5].text == f"{line}\n{far}"
    assert counts[6].text == "only six here" and counts[6].n_removed == 1
    assert counts[7].text == "x y z" and (counts[7].n_lines, counts[7].n_removed) == (3, 2)
    assert counts[8].text is None and counts[9].text == "" and counts[10].text == "" and counts[12].text == "日" * 30
    assert counts[11].text == "a\n\nb"
    kept = line_dedup.dedup_lines(df)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 8, 9, 11, 11, 12] and kept.columns == df.columns
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_recall(spark):
    """Pairs of lines at a similarity of 0.8 or more end in one class (at least 0.97 of them)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    s = line_dedup.SHINGLE
    lines = sorted({x for r in docs.collect() for x in r.text.split("\n") if x.strip()})
    sets = [{x[i : i + s] for i in range(max(1, len(x) - s + 1))} for x in lines]
    where = collections.defaultdict(list)
    for i, g in enumerate(sets):
        for x in g:
            where[x].append(i)
    links = set()
    for i, g in enumerate(sets):
        c = collections.Counter(j for x in g if len(where[x]) < 200 for j in where[x] if j < i)
        links |= {(i, j) for j, n in c.items() if n * 2 > len(g) and len(g & sets[j]) >= 0.8 * len(g | sets[j])}
    gone = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    left = {r.doc_id for r in line_dedup.dedup_lines(gone, counts=True).filter("n_removed = 0").collect()}
    assert len(links) > 20
    assert sum(i in left and j in left for i, j in links) <= 0.03 * len(links)
    linked = {i for x in links for i in x}
    assert all(i in left for i in range(len(lines)) if i not in linked)


def test_every_similar_pair_of_a_hot_bucket_is_linked(spark):
    """Lines that meet in a band end in one class exactly where a chain of pairs at the threshold joins them."""
    r = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    common, lines = "".join(r.choice(letters, 160)), []
    for _ in range(120):
        base = common + "".join(r.choice(letters, 40))
        lines += [base + "".join(r.choice(letters, 8)) for _ in range(3)]
    lines = [lines[i] for i in r.permutation(len(lines))]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    sig = line_dedup.signatures(line_dedup.line_table(docs, "doc_id", "text"), line_dedup.SHINGLE, line_dedup.ROWS, line_dedup.BANDS)
    buckets = collections.defaultdict(list)
    for row in sig.collect():
        for b in row.bands:
            buckets[b].append(row.first_doc)
    assert max(map(len, buckets.values())) > 3 * line_dedup.SMALL_BUCKET
    sets = [{x[i : i + line_dedup.SHINGLE] for i in range(len(x) - line_dedup.SHINGLE + 1)} for x in lines]
    up = list(range(len(lines)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in {(min(i, j), max(i, j)) for b in buckets.values() for i in b for j in b if i != j}:
        if len(sets[i] & sets[j]) >= line_dedup.THRESHOLD * len(sets[i] | sets[j]):
            i, j = find(i), find(j)
            up[max(i, j)] = min(i, j)
    left = {x.doc_id for x in line_dedup.dedup_lines(docs, counts=True).filter("n_removed = 0").collect()}
    assert left == {i for i in range(len(lines)) if find(i) == i}


# --- passages ---------------------------------------------------------------------------


def test_passages(spark):
    r = np.random.default_rng(9)
    random_words = lambda n: " ".join(f"{chr(97 + r.integers(26))}{r.integers(10**6)}" for _ in range(n))
    passage, para = random_words(51), random_words(40)
    texts = [(1, random_words(30) + " " + passage + " " + random_words(30)), (2, random_words(70) + ", " + passage.upper() + "!"), (3, random_words(90)), (4, None), (5, "")]
    texts += [(6, para + "\n" + random_words(30)), (7, random_words(25) + "\n" + para + " more"), (8, random_words(300)), (9, "so " * 400)]
    df = table(spark, texts)
    rows = passage_dedup.repeated_text(df).collect()
    found = collections.defaultdict(set)
    for x in rows:
        found[x.kind].add((x.doc_id, x.keeper, x.removed))
    assert found["passage"] >= {(1, 1, False), (2, 1, True)}
    assert found["paragraph"] == {(6, 6, False), (7, 6, True)}
    assert {x.doc_id for x in rows} <= {1, 2, 6, 7}
    assert {r.doc_id: r.text for r in passage_dedup.drop_repeated_paragraphs(df).collect()}[7] == texts[6][1].split("\n")[0]
    assert passage_dedup.repeated_text(df.limit(0)).count() == 0


def test_every_shared_passage_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    owners = collections.defaultdict(set)
    for r in docs.collect():
        w = words(r.text)
        for i in range(len(w) - 50):
            owners[tuple(w[i : i + 51])].add(r.doc_id)
    need = {d for x in owners.values() if len(x) > 1 for d in x}
    have = {r.doc_id for r in passage_dedup.repeated_passages(docs).select("doc").withColumnRenamed("doc", "doc_id").collect()}
    assert need and need <= have


def test_passages_reach_their_true_ends(spark):
    """Every shared passage of 39 words is found, from its first word to its last."""
    r = np.random.default_rng(8)
    n, rows, true = 0, [], {}
    for k in range(60):
        length = 39 + k % 12
        shared = [f"s{k}x{i}" for i in range(length)]
        for doc in (2 * k, 2 * k + 1):
            a, b = (int(x) for x in r.integers(0, 60, 2))
            own = [f"o{n + i}" for i in range(a + b)]
            n += a + b
            rows.append((doc, " ".join(own[:a] + shared + own[a:])))
            true[doc] = (a, a + length)
    got = passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {x.doc: (x.start, x.stop) for x in got} == true
    assert all(x.keeper == x.doc // 2 * 2 for x in got)


def test_close_passages_keep_one_copy_each(spark):
    """Shared passages with few words between them: each keeps one occurrence, the words between stay."""
    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    texts = {1: f"one {p} end1", 5: f"{p} only five has this {q}", 9: f"nine {q} end9", 12: f"{p} {q}"}
    got = passage_dedup.repeated_text(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).filter("kind = 'passage'").collect()
    left = {d: t.split() for d, t in texts.items()}
    for x in got:
        if x.removed:
            left[x.doc_id][x.start : x.stop] = [None] * (x.stop - x.start)
    left = {d: " ".join(w for w in t if w) for d, t in left.items()}
    assert left == {1: texts[1], 5: f"only five has this {q}", 9: "nine end9", 12: ""}


def _plans(monkeypatch, module):
    """Name -> executed plan of each table that the module writes."""
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(module, "written", noted)
    return plans


def test_ranges_of_words_are_cut_from_one_text():
    raw = "One, twö  three".encode()
    data = raw + b"four" + b"" + b"  five-SIX "
    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(raw), len(raw) + 4, len(raw) + 4, len(data)]))
    i, j = (np.array(x) for x in zip(*[(i, j) for i in range(len(w) + 1) for j in range(i, len(w) + 1)], strict=True))
    assert w.texts(i, j) == [w.text(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)] and len(w) == 6


def test_contexts_of_hits():
    """Many hits of many rows at once; a hit that its row does not have is of another row of that id."""
    words_of = lambda c, n: [f"{c}{i}" for i in range(n)]
    texts = [words_of("a", 70), [], words_of("b", 20), words_of("a", 30)]
    grams = Words(np.frombuffer(" ".join(texts[0]).encode(), np.uint8), np.array([0, len(" ".join(texts[0]))])).grams(16)[0].view(np.int64)
    hit = lambda p: {"pos": p, "g1": int(grams[p]), "g2": p, "first": 1}
    hits = [[hit(0), hit(30), hit(54)], [], [hit(3)], [hit(30), hit(2)]]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("g1", pa.int64()), ("g2", pa.int64()), ("first", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 1]), pa.array([" ".join(t).upper() or None for t in texts]), pa.array(hits, kind)], names=["id", "t", "hits"])
    got = [tuple(r.values()) for part in passage_dedup._contexts(iter([batch])) for r in part.to_pylist()]
    cut = lambda row, p: (texts[row][max(0, p - 23) : p], texts[row][p + 16 : p + 39])
    want = [(doc, p, int(grams[p]), p, 1, *[" ".join(x).encode() for x in cut(row, p)]) for doc, row, p in ((1, 0, 0), (1, 0, 30), (1, 0, 54), (1, 3, 2))]
    assert got == want
    assert passage_dedup._same(b"x y z", b"q y z", True) == 2 and passage_dedup._same(b"x y z", b"x y q") == 2
    assert passage_dedup._same(b"x y z", b"x y z", True) == 3 and passage_dedup._same(b"", b"") == 0


def test_words_of_paragraphs_are_counted_once(spark, monkeypatch):
    plans = _plans(monkeypatch, passage_dedup)
    line = " ".join("abcdefghijklmnopqrst")
    df = table(spark, [(1, line), (2, f"x\n{line}"), (3, line[:-2]), (4, None)])
    got = sorted((r.doc, r.line, r.n_words) for r in passage_dedup.similar_paragraphs(df).collect())
    assert got == [(1, 0, 20), (2, 1, 20)] and plans["paragraphs"].count("regexp_extract_all") == 1


def test_lines_and_prefixes_take_each_array_once(spark, monkeypatch):
    """No filter that Spark infers computes the lines or the shingles a second time, and places are those of the whole order."""
    plans = _plans(monkeypatch, line_dedup)
    df = table(spark, [(1, "one line\n\none line\ntwo"), (2, None), (3, "")])
    lines = line_dedup.line_table(df, "doc_id", "text")
    assert lines._jdf.queryExecution().executedPlan().toString().count("array_distinct") == 1
    assert sorted((r.doc, r.line) for r in lines.collect()) == [(1, "one line"), (1, "two")]
    r, s = np.random.default_rng(2), line_dedup.SHINGLE
    base = ["".join(r.choice(list("abc"), 60)) for _ in range(4)]
    texts = {i: base[i % 4][: 30 + i] + "".join(r.choice(list("xyz"), 3 * (i % 5))) for i in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "id long, line string")
    members = spark.createDataFrame([(i, i % 3 == 0) for i in range(0, 40, 2)], "id long, failed boolean")
    got = line_dedup._prefixes(members, rows, s, 0.8).collect()
    assert plans["line-shingles"].count("array_distinct") == 1
    key = {}
    for i, x in texts.items():
        for g in {x[k : k + s] for k in range(len(x) - s + 1)}:
            key.setdefault(g, set()).update([i] if i % 2 == 0 else [])
    hashed = {r.g: r.h for r in spark.createDataFrame([(g,) for g in key], "g string").selectExpr("g", "xxhash64(g) h").collect()}
    want = set()
    for i in range(0, 40, 2):
        own = sorted({texts[i][k : k + s] for k in range(len(texts[i]) - s + 1)}, key=lambda g: (len(key[g]), hashed[g]))
        want |= {(i, hashed[g], len(own), p) for p, g in enumerate(own, 1) if len(key[g]) > 1 and p <= int(len(own) * 0.2 + 1e-6) + 1}
    assert {(x.id, x.s, x.n, x.place) for x in got} == want and len(got) == len(want) > 20


def test_line_shingles_take_one_pass(spark, monkeypatch):
    """A text's shingles are found in one pass, by code points, and a pair's two texts are matched once each."""
    plans = _plans(monkeypatch, line_dedup)
    s = line_dedup.SHINGLE
    texts = ["", "short", "12345678", "\U0001f600a\U0001f600b\U0001f600cdefgh\U0001f600", "a\r\u2028b\u0085 \tcdefg", "aaaaaaaaaaaa", "日本語" * 6]
    df = spark.createDataFrame([(x,) for x in texts], "line string")
    got = {r.line: r.g for r in df.select("line", line_dedup.grams("line", s).alias("g")).collect()}
    assert all(sorted(got[x]) == sorted([x[i : i + s] for i in range(max(1, len(x) - s + 1))]) for x in texts)
    base = "the quick brown fox jumps over the lazy dog near the old river bank while seven grey geese look on from afar"
    docs = table(spark, [(1, base), (2, base.replace("lazy", "hazy")), (3, base + "!")])
    assert {r.doc_id for r in line_dedup.dedup_lines(docs, counts=True).filter("n_removed > 0").collect()} == {2, 3}
    assert plans["line-checked"].count("regexp_extract_all") == 2


def test_line_members_are_shuffled_once_by_compiled_code(spark):
    """A member's bands are those of its signature, in a method that the JVM compiles (up to 8,000 bytes)."""
    r = np.random.default_rng(3)
    lines = ["".join(r.choice(list("abcdefgh "), int(n))) + "x" for n in r.integers(1, 300, 60)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    table_, args = line_dedup.line_table(docs, "doc_id", "text"), (line_dedup.ROWS, line_dedup.BANDS)
    want = {(x.id, b) for x in line_dedup.signatures(table_, line_dedup.SHINGLE, *args).collect() for b in x.bands}
    sig = written(line_dedup.minima(table_, line_dedup.SHINGLE, line_dedup.ROWS), "signatures")
    members = line_dedup.members_of(sig, *args)
    assert {(x.id, x.band) for x in members.collect()} == want and members.count() == line_dedup.BANDS * len(set(lines))
    hubs = members.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("other"), F.count("*").alias("m")).filter("hub <> other")
    both = members.join(hubs.hint("shuffle_hash"), "band").filter("id <> hub")
    both.collect()
    stages = both._jdf.queryExecution().debug().codegenToSeq()
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()
