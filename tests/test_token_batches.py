"""Tokens of whole batches against the tokenizer's SQL and columns, on lines made up of what tokens begin and end with."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from netquarry.functions import token_batches, tokenizer
from netquarry.plans import growth

BITS = """0 1 25 255 256 300 a f ff fe80 12345 02 0a A0 0x 0X1f x g zz _ é 日 😀 : :: ::: - . .. % $1 \\ / @ ^ ` { ~ ; " 1.2.3.4 ::1
    1:2:3:4:5:6:7:8 1:2:3::5:6:7:8:9 aa:bb:cc:dd:ee:ff aa-bb-cc-dd-ee-ff 1::2 "q%" """.split() + [" ", " ", "\t", "\r", "\x01", "\x7f", "\x85", "\u2028"]


def line(pick):
    if pick.random() < 0.6:
        return "".join(pick.choice(BITS) for _ in range(pick.randrange(14)))
    sign = pick.choice(":.-")
    groups = (pick.choice(["0", "1", "255", "256", "02", "aa", "c0de", "fffff", "", "1.2.3.4"]) for _ in range(pick.randrange(2, 12)))
    return pick.choice(["", "x", " ", '"', ":"]) + sign.join(groups) + pick.choice(["", "z", "é", ":", "::2", ".1", '"'])


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    """Tables with hard lines, of which many are empty and some end with what only Java takes for a line's end."""
    place, pick = tmp_path_factory.mktemp("hard"), random.Random(7)
    texts = ["\n".join(line(pick) for _ in range(40)) for _ in range(200)] + ["", "\n\n", "f\x85", "10.0.0.1\u2028", "7\u2029", None, "long " * 5000 + "::1"]
    columns = {"doc_id": range(len(texts)), "text": texts, "source": [None if k % 7 == 0 else f"s{k % 3}" for k in range(len(texts))]}
    pq.write_table(pa.table({k: pa.array(list(v)) for k, v in columns.items()}), place / "documents.parquet")
    pq.write_table(pa.table({"event_id": pa.array(range(300)), "user_id": pa.array([k * 7 % 90 for k in range(300)])}), place / "events.parquet")
    return str(place)


def both(spark, place, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{place}/{t}.parquet'")
    out = con.execute(growth.ORACLES[name])
    names = [x[0] for x in out.description]
    rows = growth.QUERIES[name](spark, place).select(*names).collect()
    return sorted(map(tuple, rows), key=str), sorted(out.fetchall(), key=str)


def test_templates_of_hard_lines(spark, hard):
    mine, other = both(spark, hard, "general_templates")
    assert mine == other


def test_templates_handle_no_token_by_itself(spark, hard):
    plan = growth.general_templates(spark, hard)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_kinds_of_hard_lines(spark, hard):
    mine, other = both(spark, hard, "token_kinds")
    assert mine == other and {r[0] for r in mine} == {None, "odd.log", "s0", "s1", "s2"}


def test_tokens_are_counted_before_they_are_rows(spark, hard):
    plan = growth.token_kinds(spark, hard)._jdf.queryExecution().executedPlan().toString()
    # The lines of documents are the only rows that come of an array.
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan and plan.count("Generate ") == 1


def test_tokens_of_a_text_that_is_no_utf8():
    """Its bytes are kept as they are."""
    bad = pa.Array.from_buffers(pa.string(), 1, [None, pa.array([0, 6], pa.int32()).buffers()[1], pa.py_buffer(b"\xff a\xc3 1")])
    (got,) = token_batches._count_tokens(iter([pa.RecordBatch.from_arrays([pa.array(["f"]), bad], names=["file", "text"])]))
    assert sorted(zip(got["token"].cast(pa.binary()).to_pylist(), got["kind"].to_pylist(), strict=True)) == [(b"1", "int"), (b"a\xc3", "string"), (b"\xff", "char")]


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_pieces_give_what_the_columns_give(spark, monkeypatch, size):
    """Whatever the size of pieces, on parts of arrays, with nulls and lines without text."""
    monkeypatch.setattr(token_batches, "PIECE_BYTES", size)
    pick = random.Random(size)
    texts = [line(pick) for _ in range(500)] + ["", None, ""]
    known = {}
    for kind in (pa.string(), pa.large_string()):
        part = pa.array(["x", *texts, "y"], kind).slice(1, len(texts))
        mine = [t for _, text, bounds in token_batches._pieces(part) for t in token_batches.templates(text, bounds, known).to_pylist()]
        df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", tokenizer.line_template("text").alias("t"))
        assert mine == [r["t"] for r in df.orderBy("k").collect()]
    assert list(token_batches._pieces(pa.array([], pa.string()))) == []
