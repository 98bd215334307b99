"""Native column helpers against Python string and regex semantics."""

from hypothesis import given, settings, strategies as st

from codeloom.functions.text import py_strip, splitlines
from codeloom.operators import scoring as S

ALPHABET = st.sampled_from(list("ab #=:\t\n\r\x0b\x0c\x1c\x85\u2028é_\"'") + ["except", "Exception", "try:",
                                                                              "continue", '"""', "'''", "x ="])
TEXT = st.lists(ALPHABET, max_size=30).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_strip_and_splitlines(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", py_strip("t").alias("s"), splitlines("t").alias("l")).collect()
    for r in got:
        assert r.s == r.t.strip()
        assert r.l == r.t.splitlines()


# code, exception score, docstring score, variable score, pattern score
CASES = [
    ("", 1.0, 1.0, 1.0, 0.5),
    ("try:\n    f()\nexcept:\n    pass\n", 0.3, 1.0, 1.0, 0.5),
    ("try:\n    f()\nexcept  \t:\n    continue\n", 0.3, 1.0, 1.0, 1.0),
    ("except\x1c: x", 0.3, 1.0, 1.0, 0.5),
    ("except Exception as e:", 0.6, 1.0, 1.0, 0.5),
    ("except\n\u2028Exception", 0.6, 1.0, 1.0, 0.5),
    ("except ValueError:", 1.0, 1.0, 1.0, 0.5),
    ("exceptException", 1.0, 1.0, 1.0, 0.5),
    ("except Exception:\nexcept:", 0.3, 1.0, 1.0, 0.5),
    ('def f():\n    """doc\n    more"""', 1.0, 0.0, 1.0, 0.5),
    ("x = '''a'''", 1.0, 0.0, 1.0, 0.5),
    ('x = """open only', 1.0, 1.0, 1.0, 0.5),
    ("a=1\nb=1\nc=1\nd=1\ne=1", 1.0, 1.0, 1.0, 0.5),
    ("a=1\nb=1\nc=1\nd=1\ne=1\nf=1", 1.0, 1.0, 0.6, 0.5),
    ("a=1\na=2\na=3\na=4\na=5\na=6", 1.0, 1.0, 1.0, 0.5),
    ("a = b = c = d = e = f = 1", 1.0, 1.0, 1.0, 0.5),                  # one match a line
    ("f(a=1)\nf(b=1)\nf(c=1)\nf(d=1)\ng == 1\nh != 1", 1.0, 1.0, 1.0, 0.5),
    ("a=1\u2028b=1\u2028c=1\u2028d=1\u2028e=1\u2028f=1", 1.0, 1.0, 1.0, 0.5),      # no line end of the pattern
    ("é1=1\né2=1\né3=1\né4=1\né5=1\né6=1", 1.0, 1.0, 0.6, 0.5),
    ("try: except continue", 1.0, 1.0, 1.0, 1.0),
    ("try : except continue", 1.0, 1.0, 1.0, 0.5),
]


def test_scores_of_written_out_cases(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, c string")
    c = F.col("c")
    rows = df.select("i", S.exception_score(c).alias("e"), S.docstring_score(c).alias("d"),
                     S.variable_score(c).alias("v"), S.pattern_score(c).alias("p")).collect()
    for r in rows:
        assert (r.e, r.d, r.v, r.p) == CASES[r.i][1:], CASES[r.i]


def test_size_and_llm_scores(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("+++ a\n--- b\n+x\n-y\n+z", "score 0.7"), ("", "n/a"), ("+a", "-3"), ("", "\u0660.\u0665 or 0.9")],
                               "d string, r string")
    rows = df.select(S.size_score(F.col("d")).alias("s"), S.llm_score(F.col("r")).alias("l")).collect()
    assert [round(r.s, 6) for r in rows] == [round(1 - 3 / 30, 6), 1.0, round(1 - 1 / 30, 6), 1.0]
    assert [r.l for r in rows] == [0.7, 0.5, 1.0, 0.5]
