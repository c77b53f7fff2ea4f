"""Worked cases of the validators, as literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsift.functions import clean as C
from tarnsift.functions import text as X
from tarnsift.functions import vectors as V


def one(spark, make, *values, kind="string"):
    schema = ", ".join(f"c{k} {kind}" for k in range(len(values)))
    df = spark.createDataFrame([tuple(values)], schema)
    return df.select(make(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(("v", "want"), [("TiN", True), ("Al2O3", True), ("Fe3C", True), ("NaCl", True), ("AISI", False), ("SUS304", False)])
def test_formula_guard(spark, v, want):
    assert one(spark, C.is_formula, v) is want


@pytest.mark.parametrize(
    ("v", "want"),
    [
        ("gray cast iron, Grade 40A", "gray cast iron, Grade 40A"), ("a, b, c, d", ""), (None, ""), ("  x \n y ", "x y"),
        ("one end. New start", ""), ('say "x"', ""), ("Output JSON only", ""), ("x" * 81, ""),
    ],
)
def test_entity_name(spark, v, want):
    assert one(spark, C.entity_name, v) == want


@pytest.mark.parametrize(
    ("v", "want"),
    [
        ("58-80 ksi", "58-80 ksi"), ("450 MPa", "450 MPa"), ("100 to 325 HB", "100 to 325 HB"), ("QT: 90-115 HB", "QT: 90-115 HB"),
        ("55 HRC (tempered at 315 °C), 96 HRB (annealed)", "55 HRC (tempered at 315 °C), 96 HRB (annealed)"),
        ("various", None), (", yield: 70", None), ("", None), (None, None), ("7 " + "x" * 31, None),
    ],
)
def test_quantity(spark, v, want):
    assert one(spark, C.quantity, v) == want


@pytest.mark.parametrize(
    ("v", "want"),
    [
        ("45", "clean"), ("45 ksi", "clean"), ("100 to 325 HB", "clean"), ("280 HV (max), 22 HRC", "loose"), ("{1}", "garbage"),
        (" ", "null"), (None, "null"),
    ],
)
def test_classify(spark, v, want):
    assert one(spark, C.classify_numeric, v) == want


def test_canonical(spark):
    assert one(spark, lambda c: C.canonical(c, "Material"), " Stainless-STEELS ") == "stainless steel"
    assert one(spark, lambda c: C.canonical(c, "Material"), "TiN") == "TiN"
    assert one(spark, lambda c: C.canonical(c, "Standard"), None) == ""


def test_snippets(spark):
    assert one(spark, X.snippet, "a\nb " + "c" * 300) == "a b " + "c" * 236 + "…"
    text = "x" * 100 + "NEEDLE" + "y" * 200
    assert one(spark, lambda c: X.context_snippet(c, "needle"), text) == "..." + "x" * 80 + "NEEDLE" + "y" * 120 + "..."
    assert one(spark, lambda c: X.context_snippet(c, "absent"), "short") == "short"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r.n for r in df.select(V.l2_normalize(F.col("v")).alias("n")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('say {"a": {"b": "}"}} done', '{"a": {"b": "}"}}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ("none", None), ("{open", None),
        (None, None), ('{"a": "\\"}"} x', '{"a": "\\"}"}'),
    ],
)
def test_first_json_object(spark, text, want):
    assert X.balanced_object(text) == want
    assert one(spark, X.first_json_object, text) == want


def test_multi_vectors_round_trip(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, None)], "k int, m array<array<float>>")
    back = df.select("k", V.from_binary(V.to_binary("m"), F.lit(2)).alias("m"))
    assert [r.m for r in back.orderBy("k").collect()] == [[[1.0, 2.0], [3.0, 4.0]], None]


def test_random_projection_keeps_angles(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(2, 2000)).astype("float32")
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "k int, v array<float>")
    got = np.array([x.p for x in df.select("k", V.random_projection("v").alias("p")).orderBy("k").collect()])
    assert got.shape == (2, 128) and np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-5)
    cos = v[0] @ v[1] / np.linalg.norm(v[0]) / np.linalg.norm(v[1])
    assert abs(got[0] @ got[1] - cos) < 0.3


def test_token_pooling(spark):
    df = spark.createDataFrame([([[1.0], [3.0], [5.0], [7.0]],)], "m array<array<double>>")
    assert df.select(V.token_pooled("m", 3).alias("p")).first().p == [[3.0], [7.0]]


def test_settings(tmp_path):
    from tarnsift.sources.settings import Settings

    assert Settings.load(tmp_path / "none.toml") == Settings()
    (tmp_path / "c.toml").write_text("[engine]\nrerank_pool = 9\n")
    assert Settings.load(tmp_path / "c.toml").rerank_pool == 9
    (tmp_path / "d.toml").write_text("[engine]\nwhat = 9\n")
    with pytest.raises(ValueError):
        Settings.load(tmp_path / "d.toml")


def test_tables_and_files(spark, tmp_path):
    from tarnsift.sources import tables

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"abc")
    (tmp_path / "in" / "b.txt").write_bytes(b"x")
    f = tables.files(spark, str(tmp_path / "in"), "*.pdf").first()
    assert f.file_hash == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    tables.write_version(df, f"{tmp_path}/v")
    tables.write_version(df, f"{tmp_path}/v")
    assert tables.by_key(spark.read.parquet(f"{tmp_path}/v"), "k", 1).count() == 1
    tables.write_plan(df, f"{tmp_path}/p")
    tables.write_log(df, f"{tmp_path}/l")
    assert spark.read.json(f"{tmp_path}/p").first().v == "a"
    assert spark.read.option("sep", "\t").csv(f"{tmp_path}/l", header=True).first().v == "a"
