import uuid

import pytest
from pyspark.sql import functions as F

from groundmesh.config import Config
from groundmesh.functions import text as t


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize(
    ("value", "cleaned", "slugged"),
    [("  a b c​d ", "a b cd", "a-b-cd"), ("", "", "unknown"), (None, "", "unknown"), ("खतरा", "खतरा", "unknown"), ("--Belt & Drift!--", "--Belt & Drift!--", "belt-drift")],
)
def test_clean_and_slug(spark, value, cleaned, slugged):
    row = one(spark, value, t.clean_text(F.col("x")), t.slug(F.col("x")))
    assert (row.c0, row.c1) == (cleaned, slugged)


def test_uuid_and_ids(spark):
    import hashlib

    row = one(spark, "abc", t.store_key("textchunk", F.col("x")), t.stable_id(F.col("x"), F.lit(None), F.lit(3)))
    assert row.c0 == str(uuid.uuid5(uuid.NAMESPACE_URL, "chp-textchunk:abc"))
    assert row.c1 == hashlib.sha1(b"abc||3").hexdigest()[:32]


def test_excerpt(spark):
    cut = lambda s: one(spark, s, t.excerpt(F.col("x"))).c0
    assert cut("a" * 1000) == "a" * 1000
    assert cut("a" * 1001) == "a" * 1000 + "..."
    assert cut("a" * 700 + "." + "b" * 400) == "a" * 700 + "."
    assert cut("a" * 699 + "." + "b" * 400) == "a" * 699 + "." + "b" * 300 + "..."
    assert cut("a" * 800 + "।" + "b" * 400).endswith("।")


def test_terms_penalty_language_json(spark):
    cfg = Config()
    row = one(spark, "An of belt COURSE limits, course complete", t.query_terms(F.col("x"), cfg), t.generic_penalty(F.col("x"), cfg), t.language_signal(F.col("x")), t.infer_type(F.col("x"), F.lit("fire drill"), cfg))
    assert set(row.c0) == {"belt", "course", "limits", "complete"}
    assert (row.c1, row.c2, row.c3) == (0.6, "en", "risk")
    parse = lambda s: one(spark, s, t.parse_model_json(F.col("x"), "struct<a:int>")).c0
    assert parse('```json\n{"a": 1}\n```').a == 1
    assert parse('{"a": 2}').a == 2
    assert parse("no") is None
    assert one(spark, "a, , b", t.split_list(F.col("x"))).c0 == ["a", "b"]
    assert one(spark, "ख", t.language_signal(F.col("x")), t.citation(F.lit(""), F.lit(None)))[1] == "[Untitled, concept: unknown-concept]"
