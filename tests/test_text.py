"""Text, path and vector expressions against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fathomline.functions import paths, text, vectors


def plain_tokens(s):
    s = s.lower()
    out = [t for t in re.findall("[a-z0-9]+", s) if len(t) > 1]
    for run in re.findall("[一-鿿]+", s):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def test_tokens_match_plain_python(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("aB3 é学习随机，\t-") for _ in range(r.randrange(30)))) for i in range(200)]
    got = spark.createDataFrame(rows, "i int, s string").select("i", text.tokens(F.col("s")).alias("t")).collect()
    assert {g.i: g.t for g in got} == {i: plain_tokens(s) for i, s in rows}


def test_strip_and_lines_follow_unicode(spark):
    rows = [("　 a b ",), ("x\x0by z\r\nw\n",), ("",), ("\n\n",), ("\x1c q \x1f",)]
    got = spark.createDataFrame(rows, "s string").select("s", text.strip(F.col("s")).alias("t"), text.lines(F.col("s")).alias("l")).collect()
    for g in got:
        assert g.t == g.s.strip()
        assert g.l == g.s.splitlines()


def test_clip_marks_what_is_cut(spark):
    got = spark.createDataFrame([(" a  b \n c ",), ("abcdef",)], "s string").select(text.clip(F.col("s"), 5).alias("c")).collect()
    assert [g.c for g in got] == ["a b c", "abcde…"]


def test_classify_and_ids(spark):
    rows = [("book/T/f.txt",), ("course/S1/S2/My_C/f.md",), ("course/f.txt",), ("Video_A_B/f.vtt",), ("f.txt",)]
    got = spark.createDataFrame(rows, "rel string").select(paths.classify(F.col("rel")).alias("c"), paths.chunk_id(F.col("rel"), F.lit(1)).alias("i")).collect()
    assert [None if g.c is None else tuple(g.c) for g in got] == [("book", "T", None), ("course", "My C", "S1/S2"), None, ("video", "A B", None), None]
    assert got[0].i == hashlib.md5(b"book/T/f.txt|1").hexdigest()[:12]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r.n) for r in rows.select(vectors.normalize(F.col("v")).alias("n")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    with pytest.raises(Exception, match="differ in length"):
        rows.select(vectors.dot(F.col("v"), F.array(F.lit(1.0)))).collect()
    with pytest.raises(Exception, match="cannot truncate"):
        rows.select(vectors.truncate(F.col("v"), 3)).collect()
