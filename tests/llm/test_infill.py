"""Fill-in-middle against a plain version over code points, and its round trip."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundmesh.llm import infill

DOCS = "doc_id long, text string, n string, form string, output string"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(i, t, unit="token"):
    t = t or ""
    units = TOKEN.findall(t) if unit == "token" else list(t)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, len(units), "plain", None, None, t)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (i, len(units), form, len(prefix), len(middle), out)


def texts():
    rng = random.Random(7)
    alphabet = ["a", "b", " ", "\n", "\t", "\x0b", "\x1f", " ", "é", "日", "\U0001f600", "<", "P", "S", "M", ">", "é", "\0"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(300 + i, t) for i, t in enumerate([None, "", " ", "  \n", "x", " x", "x ", "日", "<S", "<<P", "a <P> b", "   "])]
    return rows + [(None, "null id é"), (5, rows[5][1]), (-3, "negative id 日本 x y"), (1 << 40, "word " * 5000 + "é " * 70_000)]


@pytest.mark.parametrize("unit", ["token", "char"])
def test_outputs_are_those_of_a_plain_version(spark, unit):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)
    made = infill.transform(docs, unit=unit)
    got = [tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string")).collect()]
    assert sorted(got, key=repr) == sorted((plainly(i, t, unit) for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", infill.restored("output", "form").cast("string").alias("text")).collect()
    assert sorted((tuple(r) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    sizes = made.where("form <> 'plain'").select("output", "form", "prefix_bytes", "middle_bytes").collect()
    assert all(bytes(r.output).split(b"<P>")[1].startswith(bytes(r.output).split(b"<P>")[1][: r.prefix_bytes]) and len(bytes(r.output).split(b"<M>")[1]) == r.middle_bytes for r in sizes)


def test_round_trip_digests(spark):
    rows = texts()
    got = infill.round_trip(spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(*p[:5], sha(p[5]), sha(t or "")) for p, (i, t) in ((plainly(i, t), (i, t)) for i, t in rows)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert infill.round_trip(spark.createDataFrame([], DOCS)).collect() == []


def test_exception_index_converts_both_ways():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(["a", "é", "日", "\U0001f600"], weights=[rng.random() * 5, 1, 1, 1], k=rng.randint(0, 30)))
        raw = text.encode()
        index = infill.ExceptionIndex(np.frombuffer(raw, np.uint8))
        for k in range(len(text) + 1):
            at = len(text[:k].encode())
            assert index.code_points(at) == k and index.bytes_before(k) == at
    assert len(infill.ExceptionIndex(np.frombuffer(b"plain ascii", np.uint8)).places) == 0


def test_unknown_unit(spark):
    with pytest.raises(ValueError, match="unit"):
        infill.transform(spark.createDataFrame([], DOCS), unit="line")
