"""Company keys (P1) and document content keys."""

import hashlib
import random
import unicodedata

from pyspark.sql import functions as F

from regiflow.functions import keys


def py_key(*parts):
    s = unicodedata.normalize("NFKD", "".join(parts)).strip().lower().replace("\xa0", " ")
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def test_zfill_never_truncates(spark):
    cases = ["57814", "0000057814", "123456789012", "", "-42", "+7", "abc"]
    df = spark.createDataFrame([(c,) for c in cases], "k string")
    got = [r.z for r in df.select(keys.zfill(F.col("k")).alias("z")).collect()]
    assert got == [c.zfill(10) for c in cases]


POLISH = [
    ("0000057814", "Sprawozdanie finansowe", "Bilans za rok 2023", "01.01.2023", "31.12.2023"),
    ("0000057814", "Opinia biegłego rewidenta / sprawozdanie z badania", "ŻÓŁĆ", "2023", "2024"),
    ("0000000001", "  Roczne\xa0sprawozdanie ", "ﬁrma", "", "x\t"),
    ("0000000002", "PLAIN ASCII", " Name ", "2020-01-01", "2020-12-31\n"),
    ("0000000003", "Ärger", "Ünïcödé ", "a", "b"),
]


def test_document_key_matches_python(spark):
    df = spark.createDataFrame(POLISH, "k string, t string, n string, f string, d string")
    got = df.select(keys.document_key(*[F.col(c) for c in "ktnfd"]).alias("h")).collect()
    assert [r.h for r in got] == [py_key(*row) for row in POLISH]


def test_normalize_keeps_l_with_stroke_and_splits_accents(spark):
    df = spark.createDataFrame([("Łódź\xa0ﬁ",), ("ABC ",), (None,)], "s string")
    got = [r.n for r in df.select(keys.normalize(F.col("s")).alias("n")).collect()]
    assert got[0] == unicodedata.normalize("NFKD", "Łódź\xa0ﬁ").strip().lower().replace("\xa0", " ")
    assert "ł" in got[0] and "fi" in got[0]
    assert got[1] == "abc" and got[2] is None


def test_nfkd_of_every_code_point(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"{chr(c)}|" for c in points[at:at + 512]) for at in range(0, len(points), 512)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    got = {r.i: r.n for r in df.select("i", keys.nfkd(F.col("t")).alias("n")).collect()}
    assert got == {i: unicodedata.normalize("NFKD", t) for i, t in enumerate(texts)}


def test_nfkd_puts_marks_into_canonical_order(spark):
    rng = random.Random(7)
    marks = [chr(c) for c in range(0x300, 0x1100) if unicodedata.combining(chr(c))] + list("\U0001d165\U0001d16d\U0001e944")
    others = list("aAzŻé ńﬁﬃ각힣ㄱÅ½ẛ̣\u0344\u1e69\U0001f600") + ["\u1100\u1161", "x"]
    texts = ["".join(rng.choice(marks if rng.random() < 0.6 else others) for _ in range(rng.randrange(1, 14))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate([*texts, "", "plain"])), "i int, t string").repartition(8)
    got = {r.i: r.n for r in df.select("i", keys.nfkd(F.col("t")).alias("n")).collect()}
    assert got == {i: unicodedata.normalize("NFKD", t) for i, t in enumerate([*texts, "", "plain"])}


def test_no_python_in_the_plan_of_a_key(spark):
    df = spark.createDataFrame(POLISH, "k string, t string, n string, f string, d string")
    out = df.select(keys.document_key(*[F.col(c) for c in "ktnfd"]).alias("h"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")


def test_null_part_gives_reason(spark):
    df = spark.createDataFrame([("1", None)], "a string, b string")
    row = df.select(keys.document_key(F.col("a"), F.col("b"), F.col("a"), F.col("a"), F.col("a")).alias("h"),
                    keys.document_key_reason(F.col("a"), F.col("b")).alias("r")).first()
    assert row.h is None and row.r == "null_part"
