"""Fuzzy line dedup by MinHash over character shingles, with DataFrame functions only.

1. Each distinct line's shingles are exploded and hashed (generated code, no
   lambda).  A hash's low part names a bin, and a partial aggregation keeps
   the least value per bin and line: one-permutation MinHash.  The same
   aggregation collapses equal lines and finds the first document of each.
2. A band takes five of the 21 bins, by a perfect difference set: any two
   bands share one bin, so 21 bins serve 16 bands.  Five rows keep lines apart
   that share some common shingles only, whatever their number.
3. Bands meet in a shuffle on the band hash.  Each bucket's hub is its most
   frequent line; every member is verified against it by the exact Jaccard
   similarity of the shingle sets.
4. The members of buckets where some fail against their hub are grouped by
   their prefixes, the shingles that are rarest among all of them: similar
   lines share a shingle of their prefixes.  A pair is formed only where its
   ends are not linked yet, and the sizes and the places of the shared shingle
   leave room for the threshold.
5. Connected components of the verified links; the line of the least document
   id stays, all others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.functions.rows import computed_once
from prefloom.llm.common import connected_components, remove, settle, written

SHINGLE = 8
THRESHOLD = 0.8
ROWS, BANDS = 5, 16  # a pair at 0.8 meets with probability 0.975, at 0.85 with 0.994, at 0.4 with 0.14, at 0.1 with 0.0002
# perfect difference sets: fixed values, a set of r numbers for r * (r - 1) + 1 bins
DIFFERENCES = {3: (0, 1, 3), 4: (0, 1, 3, 9), 5: (0, 1, 4, 14, 16), 6: (1, 5, 11, 24, 25, 27)}
PER_BIN = 5  # hashes kept per bin and line; an empty bin (1 in 150) borrows from the next
ALWAYS = 16  # first shingles of a line kept whatever their hash, for long lines of few different ones
SMALL_BUCKET = 32  # members of a larger group are first compared with its least one
HAS_WORD = r"[^\x20\x09-\x0D]"
EMPTY = 2147483647  # the least value of a bin without a hash


def has_word(line: Column) -> Column:
    # most lines show it by their first character and need no regular expression
    return (F.ascii(line) > 32) | line.rlike(HAS_WORD)


def word_lines(text: Column) -> Column:
    """The distinct lines that have a word, in order."""
    return F.filter(F.array_distinct(F.split(F.coalesce(text, F.lit("")), "\n", -1)), has_word)


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, line, h1, h2: a row for each distinct line of each document."""
    # outer: from a plain explode Spark infers a filter on the size of the array, and computes the array for it a second time
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.explode_outer(word_lines(F.col(text_col))).alias("line"))
    return lines.filter("line is not null").withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))})


def bins_of(rows: int, bands: int) -> list[list[int]]:
    """The bins of each band: the difference set moved on by the band's number."""
    bins = rows * (rows - 1) + 1
    if rows not in DIFFERENCES or not 0 < bands <= bins:
        raise ValueError(f"{rows} rows allow 1 to {bins} bands, for rows of {sorted(DIFFERENCES)}")
    return [[(d + j) % bins for d in DIFFERENCES[rows]] for j in range(bands)]


def minima(lines: DataFrame, shingle: int, rows: int) -> DataFrame:
    """h1, h2, first_doc, last_doc, id, m array<int>: a row for each different line, with the least value of each bin (EMPTY, if none)."""
    bins = rows * (rows - 1) + 1
    wide = lines.select("doc", "h1", "h2", F.encode("line", "UTF-16BE").alias("b"))
    wide = wide.withColumn("n", F.expr(f"greatest(length(b) div 2 - {shingle - 1}, 1)"))
    # only a line's least hashes can be the least of a bin
    wide = wide.withColumn("below", F.expr(f"if(n <= {PER_BIN * bins}, 2147483648D, 2147483647D * {PER_BIN * bins} / n)"))
    one = wide.select("doc", "h1", "h2", "below", "b", F.expr("explode(sequence(0, n - 1))").alias("i"))
    one = one.select("doc", "h1", "h2", "below", "i", F.expr(f"xxhash64(substring(b, i * 2 + 1, {2 * shingle}))").alias("h"))
    value = "cast(shiftrightunsigned(h, 33) as int)"
    one = one.select("doc", "h1", "h2", "below", "i", F.expr(value).alias("v"), F.expr(f"cast(pmod(h & 2147483647, {bins}) as int)").alias("bin"))
    one = one.filter(f"i < {ALWAYS} or v < below")
    least = [F.min(F.when(F.col("bin") == k, F.col("v")).otherwise(EMPTY)).alias(f"m{k}") for k in range(bins)]
    sig = one.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("times"), *least)
    a = F.array(*[F.col(f"m{k}") for k in range(bins)])
    # a line's id sorts before those of rarer lines (by powers of two), then by hash
    rare = F.lit(15) - F.least(F.floor(F.log2("times")), F.lit(15))
    line_id = F.shiftleft(rare.cast("long"), 59).bitwiseOR(F.shiftrightunsigned("h1", 5))
    return sig.select("h1", "h2", "first_doc", "last_doc", line_id.alias("id"), a.alias("m"))


def filled(sig: DataFrame, rows: int) -> DataFrame:
    """The same with each empty bin filled from the next that is not, in a circle (short lines only).

    Apart from `minima`: lambdas among its results would take the whole aggregation out of generated code.
    """
    bins = rows * (rows - 1) + 1
    borrowed = f"transform(array(concat(a, a)), c -> transform(sequence(1, {bins}), k -> array_remove(slice(c, k, {bins}), {EMPTY})[0]))[0]"
    # the outer lambda computes the array once
    return sig.withColumn("m", F.expr(f"transform(array(m), a -> if(array_contains(a, {EMPTY}), {borrowed}, a))[0]"))


def bands_of(m: str, rows: int, bands: int) -> Column:
    """The band hashes of a column of minima."""
    each = [f"xxhash64({j}, {', '.join(f'{m}[{k}]' for k in places)})" for j, places in enumerate(bins_of(rows, bands))]
    return F.expr(f"array({', '.join(each)})")


def members_of(sig: DataFrame, rows: int, bands: int) -> DataFrame:
    """id, band: a row for each line and band, dealt out by the band.

    The band is computed from its number, after the explode: an array of all
    bands makes a method too long for the JVM to compile.
    """
    last = len(bins_of(rows, bands)) - 1
    one = filled(sig, rows).select("id", "m", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("j"))
    band = f"xxhash64(j, {', '.join(f'm[(j + {d}) % {rows * (rows - 1) + 1}]' for d in DIFFERENCES[rows])})"
    # not null: Spark would infer it on one side of the join only, and shuffle both
    return one.select("id", F.expr(band).alias("band")).filter("id is not null").repartition("band")


def signatures(lines: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """h1, h2, first_doc, last_doc, id, bands array<long>: a row for each different line."""
    return filled(minima(lines, shingle, rows), rows).withColumn("m", bands_of("m", rows, bands)).withColumnRenamed("m", "bands")


def grams(c: str, shingle: int) -> Column:
    """The shingles of a text column, repeats included."""
    # one pass: each match takes a character and looks ahead
    each = F.regexp_extract_all(F.col(c), F.lit(f"(?s)(?=({'.' * shingle}))."), F.lit(1))
    return F.when(F.length(c) <= shingle, F.array(F.col(c))).otherwise(each)


def shingle_pair(a: str, b: str, shingle: int) -> Column:
    """x, y: the shingles of two text columns, each computed once."""
    return F.inline(F.array(F.struct(grams(a, shingle).alias("x"), grams(b, shingle).alias("y"))))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(a, b) pairs -> a, b, similar."""
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    sets = both.select("a", "b", shingle_pair("ta", "tb", shingle))
    common, every = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    return sets.select("a", "b", (common >= threshold * every).alias("similar"))


def _prefixes(members: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(id, failed) -> the same with n, s, place: each line's prefix, the rarest of its n shingles among all members.

    Sets of n shingles that reach the threshold share at least threshold * n,
    so in any one order of the shingles they share one of the first
    n - ceil(threshold * n) + 1.  Shingles of one member only join nothing.
    """
    sets = texts.join(members, "id").select("id", "failed", F.array_distinct(grams("line", shingle)).alias("x"))
    # outer, as in line_table: a filter on the size would take the shingles of all texts, not of the members only
    one = sets.select("id", "failed", F.size("x").alias("n"), F.explode_outer("x").alias("x")).select("id", "failed", "n", F.xxhash64("x").alias("s"))
    table = written(one, "line-shingles")
    one = table.repartition("s")  # one shuffle serves the counts and the join; a member has a row of each s, so none is large
    often = one.groupBy("s").agg(F.count("*").alias("df"))
    # those of one member only come first in its order: they are counted (n less the others), not sorted
    each = Window.partitionBy("id")
    rank = F.row_number().over(each.orderBy("df", "s"))
    ranked = one.join(often.filter("df > 1").hint("shuffle_hash"), "s").withColumn("rank", rank).withColumn("shared", F.count("*").over(each))
    ranked = ranked.withColumn("place", (F.col("n") - F.col("shared") + F.col("rank")).cast("int"))
    first = ranked.filter(F.col("place") <= F.floor(F.col("n") * (1 - threshold) + 1e-6) + 1)
    out = written(first.select("s", "id", "n", "place", "failed"), "line-prefixes")
    remove(texts.sparkSession, table)
    settle(texts.sparkSession)
    return out


def _room(a: str, b: str, threshold: float) -> Column:
    """Whether two sets with a shingle in common at these places can reach the threshold.

    In one order of all shingles, what follows the first common one is all
    they can share; later common ones leave less room, so a similar pair
    passes at its first.
    """
    rest = F.least(F.col(f"n{a}") - F.col(f"place{a}"), F.col(f"n{b}") - F.col(f"place{b}")) + 1
    return rest >= (F.col(f"n{a}") + F.col(f"n{b}")) * (threshold / (1 + threshold)) - 1e-6


def _regrouped_links(members: DataFrame, texts: DataFrame, links: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """a, b: links that join, with `links`, every failed member with all members similar to it.

    A group of more than SMALL_BUCKET members is first compared with its least
    one, so that its near copies are linked; then the pairs of a group with a
    failed member, two unlinked ends and room for the threshold are verified.
    """
    spark = texts.sparkSession
    prefix = _prefixes(members, texts, shingle, threshold)
    groups = prefix.groupBy("s").agg(F.count("*").alias("m"), F.min(F.struct("id", "n", "place")).alias("least")).filter(F.col("m") > SMALL_BUCKET)
    groups = groups.select("s", F.col("least.id").alias("b"), F.col("least.n").alias("nb"), F.col("least.place").alias("placeb"))
    star = prefix.select("s", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("placea")).join(groups, "s")
    star = star.filter((F.col("a") != F.col("b")) & _room("a", "b", threshold)).select("a", "b").distinct()
    near = written(_verified(star, texts, shingle, threshold).filter("similar").select("a", "b"), "line-group-links")
    comps = connected_components(links.unionByName(near), "line-known").withColumnRenamed("node", "id")
    side = prefix.join(comps, "id", "left").withColumn("root", F.coalesce("root", "id"))
    side = written(side, "line-group-members")
    settle(spark)
    open_groups = side.groupBy("s").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.max("failed").alias("any")).filter("r1 <> r2 and any")
    side = side.join(open_groups.select("s"), "s", "left_semi")
    left = side.filter("failed").select("s", *[F.col(c).alias(c + "a") for c in ("id", "n", "place", "root")])
    right = side.select("s", *[F.col(c).alias(c + "b") for c in ("id", "n", "place", "root", "failed")])
    pairs = left.join(right, "s").filter(F.expr("roota <> rootb and (not failedb or ida > idb)") & _room("a", "b", threshold))
    pairs = pairs.select(F.greatest("ida", "idb").alias("a"), F.least("ida", "idb").alias("b")).distinct()
    found = _verified(pairs, texts, shingle, threshold).filter("similar").select("a", "b")
    out = written(near.unionByName(found), "line-regrouped")
    for t in (prefix, near, side):
        remove(spark, t)
    settle(spark)
    return out


def line_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    rows: int = ROWS,
    bands: int = BANDS,
) -> DataFrame:
    """h1, h2, keep_doc: lines that are not kept wherever they stand.

    `keep_doc` is the one document that keeps the line, null where a similar
    line stays instead.  Lines that no other line equals or resembles are not
    listed.
    """
    spark = docs.sparkSession
    lines = line_table(docs, id_col, text_col)
    sig = written(minima(lines, shingle, rows), "line-signatures")
    settle(spark)
    # one shuffle of all members serves the hubs and the join with them
    member = members_of(sig, rows, bands)
    hubs = member.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("other"), F.count("*").alias("m")).filter("hub <> other")
    both = member.join(hubs.select("band", "hub", "m").hint("shuffle_hash"), "band").filter("id <> hub")
    buckets = written(both.select("band", "id", "hub", "m"), "line-buckets")
    del member, hubs, both
    settle(spark)
    star = written(buckets.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "line-star")
    buckets = buckets.filter("m > 2")
    wanted = star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).distinct()
    # equal lines stand in many documents: the first one's copy is enough
    first = sig.join(wanted, "id", "left_semi").select("h1", "h2", F.col("first_doc").alias("doc"), "id")
    texts = written(lines.join(first.hint("shuffle_hash"), ["doc", "h1", "h2"]).select("id", "line"), "line-texts")
    settle(spark)
    checked = written(_verified(star, texts, shingle, threshold), "line-checked")
    links = checked.filter("similar").select("a", "b")
    # the two of a bucket have met; in a larger one the members that fail may resemble each other
    failed = checked.filter("not similar").select(F.col("a").alias("id"), F.col("b").alias("hub"))
    seen = buckets.join(failed.withColumn("failed", F.lit(True)), ["id", "hub"], "left").select("band", "id", F.coalesce("failed", F.lit(False)).alias("failed"))
    seen = written(seen, "line-seen")
    hot = seen.filter("failed").groupBy("band").agg(F.count("*").alias("m"))
    members = seen.join(hot.select("band"), "band", "left_semi").groupBy("id").agg(F.max("failed").alias("failed"))
    members = written(members, "line-hot-members")
    settle(spark)
    regrouped = _regrouped_links(members, texts, links, shingle, threshold)
    comps = connected_components(links.unionByName(regrouped), "line-components").withColumnRenamed("node", "id")
    comps = sig.select("h1", "h2", "first_doc", "id").join(comps, "id")
    keepers = comps.groupBy("root").agg(F.min(F.struct("first_doc", "h1", "h2")).alias("k"))
    joined = comps.join(keepers, "root")
    similar = joined.filter("k.h1 <> h1 or k.h2 <> h2").select("h1", "h2", F.lit(None).cast("long").alias("keep_doc"))
    repeated = sig.filter("first_doc <> last_doc").select("h1", "h2", F.col("first_doc").alias("keep_doc"))
    similar = written(similar, "line-similar")
    out = written(similar.unionByName(repeated.join(similar.select("h1", "h2"), ["h1", "h2"], "left_anti")), "line-verdicts")
    for t in (buckets, star, seen, texts, checked, members, regrouped, similar):
        remove(spark, t)
    settle(spark)
    return out


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc, gone array<long>: hashes of the lines that a document loses (a row per document that loses one)."""
    verdicts = line_verdicts(docs, id_col, text_col, **options)
    place = line_table(docs, id_col, text_col).select("doc", "h1", "h2")
    gone = place.join(verdicts, ["h1", "h2"]).filter("keep_doc is null or keep_doc <> doc")
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("h1")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, **options) -> DataFrame:
    """The documents with one line kept per class of similar lines, columns as they were.

    Of equal lines the first of the least document id stays.  A text that
    loses a line loses its lines without a word too; a text that loses none is
    unchanged.  Documents without a line left are dropped, unless `counts` is
    set: then every row stays, with n_lines (lines with a word) and n_removed
    (in place of columns of these names).
    A null or empty text has no lines and stays as it is.  A row with a null
    id is left alone.  Rows that share an id count as one document.
    """
    gone = written(removed_lines(docs, id_col, text_col, **options), "line-removed")
    settle(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed") if counts else docs
    row, none = F.col("row"), F.lit(None).cast("array<bigint>")
    text, doc = row.getField(text_col), row.getField(id_col)
    d = docs.select(F.struct(*docs.columns).alias("row"))
    d = d.join(gone, doc.cast("long") == F.col("doc"), "left")
    with_word = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), has_word)
    d = d.select("row", computed_once(F.size(with_word).alias("n"), word_lines(text).alias("different"), F.coalesce("gone", none).alias("gone")))
    kept = F.filter("different", lambda x: ~F.array_contains("gone", F.xxhash64(x)))
    d = d.select("row", "n", computed_once(F.when(F.col("gone").isNull(), F.col("different")).otherwise(kept).alias("kept")))
    changed = (F.size("kept") < F.col("n")) & doc.isNotNull()
    new = F.when(changed, F.array_join("kept", "\n")).otherwise(text)
    out = [new.alias(c) if c == text_col else row.getField(c).alias(c) for c in docs.columns]
    if counts:
        removed = F.when(changed, F.col("n") - F.size("kept")).otherwise(0)
        return d.select(*out, F.col("n").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
    return d.filter((F.size("kept") > 0) | (F.col("n") == 0) | doc.isNull()).select(*out)
