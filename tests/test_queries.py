import math
import subprocess
import sys
import time
from pathlib import Path

import duckdb
import pytest

from netquarry.operators import templates
from netquarry.plans import growth, queries
from netquarry.plans.queries import synthetic
from netquarry.streaming import live

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent
QUERIES, ORACLES = queries.QUERIES | growth.QUERIES, queries.ORACLES | growth.ORACLES


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_places_of_a_stream(spark, tmp_path):
    """Files that come later get their own numbers; a step writes its own folder."""
    (tmp_path / "in").mkdir()
    for k, text in enumerate(("x\ny 10.0.0.1\n", "10.0.0.1 10.0.0.2\n")):
        (tmp_path / "in" / f"{k}.log").write_text(text)
        stream = live.read_stream(spark, str(tmp_path / "in"))
        live.write_postings(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["file"][-5:], r["address"], [tuple(x) for x in r["locations"]]) for r in rows) == [
        ("0.log", "10.0.0.1", [(2, 1)]),
        ("1.log", "10.0.0.1", [(1, 1)]),
        ("1.log", "10.0.0.2", [(1, 2)]),
    ]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    out = duck.execute(ORACLES[name])
    names = [x[0] for x in out.description]
    other = sorted((tuple(r[names.index(c)] for c in columns) for r in out.fetchall()), key=str)
    assert sorted(names) == columns
    close = lambda a, b: a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9))
    assert len(mine) == len(other) and all(close(a, b) for x, y in zip(mine, other, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", ["synth_index_all", "synth_index_ipv4", "synth_index_mac", "synth_index_ipv6", "index_records_text", "index_record_parse"])
def test_an_address_has_one_record_over_all_lines(spark, tmp_path, name):
    """Events so far apart that an address stands in several buckets of lines, 2^20 and 10^7 among their bounds."""
    ids = [k * step + add for k in range(12) for step, add in ((1 << 20, -1), (1 << 20, 0), (1_000_000, 7)) if k * step + add >= 0]
    rows = [(x, x % 5) for x in sorted({*ids, 9_999_998, 9_999_999})]
    spark.createDataFrame(rows, "event_id long, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    mine = QUERIES[name](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    out = con.execute(ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(tuple(r[c] for c in names) for r in mine) == sorted(out.fetchall())


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "t").write_text("# a comment\n%i\n\n%i\n%i%m\n")
    assert sorted(r["template"] for r in templates.read_templates(spark, str(tmp_path / "t")).collect()) == ["%i", "%i%m"]
    lines = spark.createDataFrame([("f", 1, "a 10.0.0.1"), ("f", 2, "# 10.0.0.1 10.0.0.2"), ("f", 3, "b")], "file string, line_no long, text string")
    assert sorted(r["template"] for r in templates.sample_templates(lines).collect()) == ["", "%i"]


def test_windowed_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ts":"2024-01-01T00:00:01Z","text":"10.0.0.1 10.0.0.1"}\n{"ts":"2024-01-01T00:20:00Z","text":"10.0.0.2"}\n')
    stream = spark.readStream.schema("ts timestamp, text string").json(str(tmp_path / "in"))
    run = live.windowed_counts(stream, "ts", "1 minute", "5 minutes").writeStream.outputMode("append").format("memory").queryName("windowed").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["address"], r["n"]) for r in spark.table("windowed").collect()] == [("10.0.0.1", 2)]


def test_live_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("x 10.0.0.1\ny 10.0.0.1 fe80::1\n")
    counter = live.Throughput()
    spark.streams.addListener(counter)
    run = live.live_counts(live.read_stream(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["address"], r["n"]) for r in spark.table("live").collect()) == [("10.0.0.1", 2), ("fe80::1", 1)]
    for _ in range(50):
        if counter.lines:
            break
        time.sleep(0.1)
    spark.streams.removeListener(counter)
    assert counter.lines == 2


def test_plan_reads_only_what_it_needs(spark, sf):
    from netquarry.operators import index as ix

    plan = ix.counts(ix.occurrences(synthetic(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan and "Python" not in plan
    # One exchange for the count, and one that spreads a file of one part over the cores.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange RoundRobinPartitioning") == 1 == plan.count("Exchange") - 1


def test_entry_works_without_the_extra_operators(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("netquarry.llm", "corpus_pipeline")):
            raise ModuleNotFoundError("gone", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "ipv4_index_documents" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not any(k.startswith("op") for k in e.queries()) and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
