"""Masks against a plain Python model, on invented and on given text."""

import re

from conftest import SF, values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrubline.functions import masks
from scrubline.functions import patterns as P
from scrubline.plans.pii import mask_table, pii_rows, pii_scan, pii_summary


def model(text):
    def email(m):
        name, domain = m[0].split("@", 1)
        return f"{name[0]}***@{domain[0]}***.{domain.split('.')[-1]}"

    def phone(m):
        digits = [d for d in m[0] if d.isdigit()]
        return "".join(digits[:2]) + "**-***-" + "".join(digits[-4:])

    text = re.sub(P.EMAIL, email, text)
    text = re.sub(P.PH_PHONE, phone, text)
    text = re.sub(r"\d{7,}", lambda m: m[0][:2].ljust(len(m[0]), "*"), text)
    return re.sub(P.PERSON_NAME, lambda m: " ".join(
        w[0].ljust(len(w), "*") for w in m[0].split()), text)


SAMPLES = [
    "Juan Dela Cruz", "Maria Santos <maria.s@mail.example.com>", "call 0917 123 4567 now",
    "+639171234567 and 63-917-123-4567", "id 1234567 x 123456 y 12345678901", "éJuan Dela Cruz",
    "a@b.co, c@d.e-f.org", "Ana B. Cruz met Ben C. Lim", "0 963 912 34567", "", "nothing here",
]


def test_samples(column):
    got = values(column(SAMPLES).withColumn("c", masks.mask_all(F.col("c"))))
    assert got == [model(s) for s in SAMPLES]
    assert got[0] == "J*** D*** C***"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    ["Ana", "Cruz", "B.", "0917", "123", "4567", " ", "-", "@", "mail.", "org", "639", "é",
     "7654321", ".", "x"]), max_size=12).map("".join), min_size=40, max_size=60))
def test_pieces(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = values(df.withColumn("c", masks.mask_all(F.col("c"))))
    assert got == [model(t) for t in texts]


def test_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    for r in df.withColumn("m", masks.mask_all(F.col("text"))).collect():
        assert r.m == model(r.text)


def test_whole_cells(column):
    df = column(["ab", "abc", "a" * 30, None])
    assert values(df.withColumn("c", masks.mask_whole(F.col("c")))) == [
        "**", "a*c", "a" + "*" * 8 + "a", None]


def test_scan(spark):
    df = spark.createDataFrame(
        [(1, "Juan Dela Cruz", "juan@gmail.com", "+639171234821", 10.0),
         (2, "Maria Santos", "maria@yahoo.com", "09285554821", 20.0),
         (3, "Jose Rizal", "jose@up.edu.ph", "0917 555 1234", 30.0)],
        "customer_id int, full_name string, email string, phone string, amount double")
    found = {r.col: r for r in pii_scan(df).collect()}
    assert found["email"].email == 3 and found["phone"].risk == "high"
    assert "amount" not in found and "customer_id" not in found
    assert pii_summary(pii_scan(df), 5).first().highest_risk == "high"
    assert pii_rows(df).count() == 3
    shown = "".join(str(tuple(r)) for r in mask_table(df).collect())
    assert "gmail" not in shown and "Dela" not in shown
