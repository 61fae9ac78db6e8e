import math

import pytest
from pyspark.sql import functions as F

from prefloom.functions.ratings import mean_rating, parse_rating, rating_class
from prefloom.functions.text import image_prompt, py_strip

# SURVEY §2.7 table: text -> Python float() result (None = ValueError)
CASES = {
    "5": 5.0, "4.5": 4.5, " 3 ": 3.0, ".5": 0.5, "5.": 5.0, "1e1": 10.0, "+2": 2.0, "\t4\n": 4.0,
    "N/A": None, "": None, "4/5": None, "None": None, "0x10": None, "1__0": None,
    "4d": None, "4D": None, "4.0f": None,
    "nan": math.nan, "inf": math.inf, "-Infinity": -math.inf, "+nan": math.nan, "-NaN": math.nan,
    "1_0": 10.0, "1_000.5": 1000.5, " 3 ": 3.0, " 4　": 4.0, "_1": None, "1_": None,
}


def _python_float(t):
    try:
        return float(t)
    except ValueError:
        return None


def test_table_matches_python():
    for t, want in CASES.items():
        got = _python_float(t)
        if want is None:
            assert got is None, t
        elif math.isnan(want):
            assert math.isnan(got), t
        else:
            assert got == want, t


def test_parse_rating(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "r string")
    rows = dict(df.select("r", parse_rating(F.col("r")).alias("v")).collect())
    for t, want in CASES.items():
        got = rows[t]
        if want is None:
            assert got is None, repr(t)
        elif math.isnan(want):
            assert math.isnan(got), repr(t)
        else:
            assert got == want, repr(t)


def test_rating_class(spark):
    df = spark.createDataFrame([("5",), ("4d",), ("N/A",), ("nan",), ("inf",), (None,)], "r string")
    got = dict(df.select("r", rating_class(F.col("r")).alias("c")).collect())
    assert got == {"5": "number", "4d": "spark_only", "N/A": "rejected", "nan": "nan", "inf": "inf", None: "null"}


def test_mean_rating_edge_cases(spark):
    schema = "a map<string, struct<Rating: string, Rationale: string>>"
    rows = [
        ({"x": ("4", ""), "y": ("5", "")},),
        ({},),
        ({"x": None},),
        ({"x": (None, "")},),
        ({"x": ("inf", ""), "y": ("-inf", "")},),
        ({"x": ("3", ""), "y": ("nan", "")},),
        (None,),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(mean_rating(F.col("a"))).collect()]
    assert got[0] == 4.5
    assert math.isnan(got[1])  # mean of nothing
    assert got[2] is None and got[3] is None  # null aspect / null rating -> unparseable
    assert math.isnan(got[4])  # inf + -inf
    assert math.isnan(got[5])
    assert got[6] is None


def test_py_strip_all_whitespace(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert len(spaces) == 29
    samples = [spaces + "a b" + spaces, "\x1c\x1dx\x1e\x1f", "​ x ​", "", "  "]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(py_strip(F.col("t"))).collect()]
    assert got == [s.strip() for s in samples]


def test_image_prompt(spark):
    df = spark.createDataFrame([("  hi\n", ["a.jpg", None, "c.png"])], "p string, imgs array<string>")
    got = df.select(image_prompt(F.col("p"), F.col("imgs"))).first()[0]
    want = "Picture 1: <img>a.jpg</img>\nPicture 2: <img>None</img>\nPicture 3: <img>c.png</img>\nhi"
    assert got == want


def test_random_texts_against_python_float(spark):
    """Every class of white space and control character around and inside numbers."""
    import random

    r = random.Random(17)
    odd = [chr(c) for c in range(0x21)] + ["\x7f", "\x85", "\xa0", "\u1680", "\u2000", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff"]
    core = ["3", "4.5", "-1", "+nan", "inf", "1_0", "1__0", "1e3", ".5", "5.", "e5", "4d", "", "\u0663", "0x1p3"]
    texts = sorted({"".join(r.choices(odd, k=r.randrange(3))) + r.choice(core) + "".join(r.choices(odd, k=r.randrange(3))) for _ in range(24000)})

    def python(t):
        try:
            return repr(float(t))
        except ValueError:
            return None

    from pyspark.sql import functions as F

    from prefloom.functions.ratings import parse_rating

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {x.i: None if x.v is None else repr(x.v) for x in df.select("i", parse_rating(F.col("t")).alias("v")).collect()}
    bad = [(texts[i], v) for i, v in got.items() if v != python(texts[i])]
    assert not bad and len(texts) > 10000
