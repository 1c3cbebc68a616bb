"""Appended bytes, followed logs, compressed places, tokens and ageing against plain code."""

import random

import numpy as np
import pyarrow as pa
import pytest

from netquarry.functions import tokenizer
from netquarry.operators import compressed, search, upkeep
from netquarry.operators import index as ix
from netquarry.sources import follow, store, terms
from netquarry.streaming import live
from test_growing import listed, places


@pytest.mark.parametrize("step", [1, 3, 1 << 20])
def test_each_line_belongs_to_one_range(monkeypatch, step):
    monkeypatch.setattr(follow, "STEP_BYTES", step)
    pick = random.Random(4)
    for _ in range(40):
        data = b"".join(pick.choice([b"", b"a", b"bcd" * 5, "é".encode()]) + b"\n" for _ in range(pick.randrange(9))) + pick.choice([b"", b"end"])
        size = pick.randrange(1, 8)
        found = []
        for k in range(0, len(data), size):
            found += [x for part in follow.whole_lines(pa.BufferReader(data), k, min(k + size, len(data)), len(data)) for x in part]
        lines = data.split(b"\n")
        assert found == (lines if lines[-1] else lines[:-1])


def test_only_appended_bytes_are_read(spark, tmp_path, monkeypatch):
    """A log that grows by its end; one changed before its end, and one left unended, are read whole."""
    log, place = tmp_path / "log", str(tmp_path / "index")
    log.mkdir()
    asked = []
    ranges = upkeep.read_ranges
    monkeypatch.setattr(upkeep, "read_ranges", lambda parts: asked.append(sorted((r["file"][-5:], r["start"], r["stop"]) for r in parts.collect())) or ranges(parts, 40))
    now = {"a.log": "x 10.0.0.1\n" * 30, "b.log": "y 10.0.0.2\n" * 5, "c.log": "10.0.0.3"}

    def refresh():
        for name, text in now.items():
            (log / name).write_text(text)
        n = upkeep.refresh(spark, place, str(log))
        assert listed(upkeep.read_grown(spark, place)) == places(now)
        return n

    assert refresh() == 3 and asked.pop() == []
    now = {"a.log": now["a.log"] + "\nmore ::1\n10.0.0.1\n", "b.log": "z 10.0.0.9\n" * 6, "c.log": "10.0.0.3\n10.0.0.4\n"}
    assert refresh() == 3 and asked.pop() == [("a.log", 330, 349), ("c.log", 0, 18)]
    now |= {"a.log": now["a.log"] + "10.0.0.5", "b.log": now["b.log"] + "10.0.0.7\n", "c.log": now["c.log"] + "\n\n10.0.0.8\n"}
    assert refresh() == 3 and asked.pop() == [("a.log", 349, 357), ("b.log", 66, 75), ("c.log", 18, 29)]
    # Its last line had no end, so it is read anew, by ranges from its start.
    now |= {"a.log": now["a.log"] + "1 10.0.0.6\n"}
    assert refresh() == 1 and asked.pop() == [("a.log", 0, 368)]
    now |= {"a.log": now["a.log"] + "10.0.0.6\n"}
    assert refresh() == 1 and asked.pop() == [("a.log", 368, 377)]


def test_a_followed_log_loses_no_line(spark, tmp_path):
    """Steps with a restart between, a line that is ended later, a new file and one that was cut."""
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()

    def step():
        stream = follow.follow(spark, f"file://{log}", range_bytes=25)
        write = live.write_followed(stream, str(out), str(tmp_path / "state"))
        write.trigger(availableNow=True).start().awaitTermination()
        return listed(live.read_followed(spark, str(out)))

    now = {"a.log": "\nx 10.0.0.1 10.0.0.2\n" * 9, "b c.log": "10.0.0.3\n10.0.0"}
    for name, text in now.items():
        (log / name).write_text(text)
    assert step() == places({**now, "b c.log": "10.0.0.3\n"})
    now |= {"b c.log": now["b c.log"] + ".4\n", "d.log": "\n\n::1\n", "a.log": now["a.log"] + "fe80::1 z\n"}
    for name, text in now.items():
        (log / name).write_text(text)
    assert step() == places(now)
    assert step() == places(now)  # nothing new


def test_varints_are_read_back():
    numbers = np.array([0, 1, 127, 128, 300, 1 << 14, (1 << 35) - 1, 1 << 62, 5])
    data, size = compressed.varints(numbers)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 5, 9, 1] and compressed.numbers_of(data).tolist() == numbers.tolist()
    assert compressed.numbers_of(np.zeros(0, np.uint8)).tolist() == [] and compressed.varints(np.zeros(0, np.int64))[0].size == 0


@pytest.mark.parametrize("block", [1, 2, 7, 128])
def test_compressed_places(spark, tmp_path, block):
    pick = random.Random(block)
    rows = [(f"f{k % 2}", f"10.0.0.{k % 5}", sorted((pick.randrange(1, 1 << pick.choice([5, 40])), pick.randrange(1, 257)) for _ in range(pick.choice([0, 1, 2, 50])))) for k in range(40)]
    postings = spark.createDataFrame([(f, a, len(x), x) for f, a, x in rows], f"file string, address string, n long, locations {store.LOCATIONS}")
    store.write_blocks(compressed.compress(postings, block), str(tmp_path / "blocks"))
    blocks = store.read_parquet(spark, str(tmp_path / "blocks"))
    want = sorted((f, a, *x) for f, a, found in rows for x in found)
    out = compressed.decompress(blocks).collect()
    assert sorted((r["file"], r["address"], *x) for r in out for x in r["locations"]) == want
    assert all(len(r["locations"]) == r["n"] <= block for r in out)
    near = compressed.between(blocks, terms.argument_terms(spark, "10.0.0.1,10.0.0.3"), 4, 20)
    assert sorted(tuple(r) for r in near.collect()) == sorted(x for x in want if x[1] in ("10.0.0.1", "10.0.0.3") and 4 <= x[2] <= 20)
    assert compressed.decompress(blocks.limit(0)).collect() == []


def test_tokens_and_templates(spark):
    cases = {
        'GET "a b" from 10.0.0.1:80, 0x1F': '%s "%s" %s %i:%d, %x',
        "12:34:56 02:00:00:00:00:0a fe80::1 1:2:3:4:5:6:7:8": "%d:%d:%d %m %I %I",
        "10.0.0.1a 10.0.0.300 std::string x_1 é 100% -5": "%s %s %s::%s %s %c %d%% -%d",
        '"open 1': '"%s %d',
        '"" a': '"%s" %c',
        "\tあい\r": "\t%s\r",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "text string")
    rows = df.select("text", tokenizer.line_template("text").alias("t"), tokenizer.tokens("text").alias("x")).collect()
    assert {r["text"]: r["t"] for r in rows} == {**cases, None: ""}
    found = {r["text"]: [tuple(x) for x in r["x"]] for r in rows}
    assert found[None] == [] and found['"" a'] == [("string", ""), ("char", "a")]
    assert found['GET "a b" from 10.0.0.1:80, 0x1F'] == [("string", "GET"), ("string", "a b"), ("string", "from"), ("ipv4", "10.0.0.1"), ("int", "80"), ("hex", "0x1F")]


def test_addresses_age_out(spark, tmp_path):
    """One that comes again after it aged out has two records; one still seen has none yet; a row far too late is dropped."""
    steps = [["00:00 10.0.0.1", "00:05 10.0.0.1", "00:06 10.0.0.2"], ["01:00 10.0.0.3"], ["00:01 10.0.0.9", "01:10 10.0.0.1 10.0.0.1"], ["03:00 10.0.0.4"]]
    for k, rows in enumerate(steps):
        lines = [(f"2024-01-01 {x[:5]}:00", x) for x in rows]
        spark.createDataFrame(lines, "ts string, text string").selectExpr("cast(ts as timestamp) as ts", "text").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
        write = live.write_aged(live.aged(stream, "ts", "10 minutes", "20 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
        write.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["address"], f"{r['first_seen']:%H:%M}", f"{r['last_seen']:%H:%M}", r["n"]) for r in rows) == [
        ("10.0.0.1", "00:00", "00:05", 2),
        ("10.0.0.1", "01:10", "01:10", 2),
        ("10.0.0.2", "00:06", "00:06", 1),
        ("10.0.0.3", "01:00", "01:00", 1),
    ]


def test_search_ends_when_all_terms_are_found(spark, tmp_path):
    """The first place of each term; files after the one that settles the last term are not opened."""
    log = tmp_path / "log"
    log.mkdir()
    for k in range(12):
        (log / f"{k:02d}.log").write_text(f"\n10.0.0.{k} here\n10.9.9.9 10.0.0.{k}\n")
    steps = []
    first = search.first_places(spark, str(log), terms.argument_terms(spark, "10.0.0.1,10.9.9.9,10.0.0.2"), files=2, seen=steps.append)
    assert sorted((r["term"], r["file"][-6:], r["line_no"], r["field"], r["text"]) for r in first.collect()) == [
        ("10.0.0.1", "01.log", 2, 1, "10.0.0.1 here"),
        ("10.0.0.2", "02.log", 2, 1, "10.0.0.2 here"),
        ("10.9.9.9", "00.log", 3, 1, "10.9.9.9 10.0.0.0"),
    ]
    assert [len(x) for x in steps] == [2, 4]
    none = search.first_places(spark, str(log), terms.argument_terms(spark, "1.1.1.1"), files=2, seen=steps.append)
    assert none.collect() == [] and sum(len(x) for x in steps) == 6 + 12
