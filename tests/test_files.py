import bz2
import gzip
import os
import random

import pytest

from netquarry import cli, shared
from netquarry.operators import index as ix
from netquarry.operators import search
from netquarry.paths import is_safe
from netquarry.sources import lines as src
from netquarry.sources import store, terms


def write(path, data):
    opener = {".gz": gzip.open, ".bz2": bz2.open}.get(path.suffix, open)
    with opener(path, "wb") as f:
        f.write(data)
    return str(path)


def read(spark, *paths):
    rows = src.read_lines(spark, [str(p) for p in paths]).collect()
    return sorted((os.path.basename(r["file"]), r["line_no"], r["text"]) for r in rows)


@pytest.mark.parametrize(
    "data, expected",
    [(b"", []), (b"a 10.0.0.1", [(1, "a 10.0.0.1")]), (b"x\n\ny\n", [(1, "x"), (2, ""), (3, "y")]), (b"x\r\ny\rz\n", [(1, "x\r"), (2, "y\rz")])],
)
def test_lines_of_small_files(spark, tmp_path, data, expected):
    assert read(spark, write(tmp_path / "a.log", data)) == [("a.log", n, t) for n, t in expected]


@pytest.mark.parametrize("split", ["700", "3k", "64k", "16m"])
def test_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    pick = random.Random(7)
    texts = ["x" * pick.randrange(0, 120) + f" 10.0.{k % 256}.{k % 7}" for k in range(3000)]
    data = "\n".join(texts).encode()
    paths = [write(tmp_path / n, data) for n in ("a.log", "b.log.gz", "c.log.bz2")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert read(spark, *paths) == [(os.path.basename(p), k, t) for p in paths for k, t in enumerate(texts, 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_index_of_blank_long_and_tied_lines(spark, tmp_path):
    path = write(tmp_path / "a.log", b"10.0.0.1\n\n10.0.0.1\n9.9.9.9 " + b"x" * 9000 + b"\n9.9.9.9 9.9.9.9\n")
    index = ix.build_index(ix.occurrences(src.read_lines(spark, path)))
    assert [r["record"] for r in ix.by_count(store.format_records(index)).collect()] == ["10.0.0.1,2,1:1,3:1", "9.9.9.9,2,5:1,5:2"]


def test_two_files_apart_and_combined(spark, tmp_path):
    paths = [write(tmp_path / n, b"10.0.0.1\n") for n in ("a.log", "b.log")]
    found = ix.occurrences(src.read_lines(spark, paths))
    assert sorted(r["n"] for r in ix.build_index(found).collect()) == [1, 1]
    assert [(r["address"], r["n"]) for r in ix.build_index(found, per_file=False).collect()] == [("10.0.0.1", 2)]


def test_one_address_in_every_line(spark):
    rows = [("f", k, "10.0.0.1") for k in range(1, 5001)]
    found = ix.occurrences(spark.createDataFrame(rows, "file string, line_no long, text string"))
    parts = ix.postings(found, bucket_lines=1000)
    assert parts.count() == 6
    row = ix.build_index(found).first()
    assert row["n"] == 5000 and [x["line"] for x in row["locations"]] == list(range(1, 5001))


@pytest.fixture
def log(spark, tmp_path):
    path = write(tmp_path / "x.log", b"a 10.0.0.1\nb fe80::1 10.0.0.1 10.0.0.1\nc 10.0.0.2\nd\n")
    found = ix.occurrences(src.read_lines(spark, path))
    return path, found


def test_text_and_parquet_round_trip(spark, tmp_path, log):
    index = ix.build_index(log[1], per_file=False)
    store.write_text(index, str(tmp_path / "i.txt"))
    store.write_parquet(index, str(tmp_path / "i.parquet"))
    plain = lambda df: sorted((r["address"], r["n"], [tuple(x) for x in r["locations"]]) for r in df.collect())
    assert plain(store.read_text(spark, str(tmp_path / "i.txt"))) == plain(index) == plain(store.read_parquet(spark, str(tmp_path / "i.parquet")))


def test_old_records(spark):
    df = spark.createDataFrame([("A,2,7,9",), ("198.51.100.9,4,12:1,12:3,70:2,901:1",)], "value string")
    rows = [(r["address"], r["n"], [tuple(x) for x in r["locations"]]) for r in store.parse_records(df).collect()]
    assert rows == [("A", 2, [(7, 0), (9, 0)]), ("198.51.100.9", 4, [(12, 1), (12, 3), (70, 2), (901, 1)])]


def test_search(spark, log):
    path, found = log
    lines, index = src.read_lines(spark, path), ix.build_index(found)
    wanted = terms.argument_terms(spark, "10.0.0.1,fe80::1,,10.0.0.1,10.0.0,FE80::1")
    assert sorted((r["term"], r["occurrences"]) for r in search.quick(index, wanted).collect()) == [("10.0.0.1", 3), ("fe80::1", 1)]
    assert sorted(r["term"] for r in search.missing(index, wanted).collect()) == ["10.0.0", "FE80::1"]
    hits = search.hits(index, wanted)
    assert sorted((r["line_no"], r["field"]) for r in search.retrieve(lines, hits).collect()) == [(1, 1), (2, 1), (2, 2), (2, 3)]
    assert sorted(r["line_no"] for r in search.retrieve(lines, hits, distinct=True).collect()) == [1, 2]
    buckets = search.hits(ix.postings(found, bucket_lines=2), wanted)
    assert sorted(map(tuple, buckets.collect())) == sorted(map(tuple, hits.collect()))


def test_term_file(spark, tmp_path):
    path = write(tmp_path / "terms", b"10.0.0.1\n\n10.0.0.1\nfe80::1")
    assert sorted(r["term"] for r in terms.file_terms(spark, path).collect()) == ["10.0.0.1", "fe80::1"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "is_safe", lambda path, refused: os.path.exists(path))
    a = write(tmp_path / "a.log", b"x 10.0.0.1\ny 10.0.0.2\nz 10.0.0.1\n")
    b = write(tmp_path / "b.log.gz", b"q 10.0.0.1\n")
    assert cli.main(["index", a]) == 0
    assert capsys.readouterr().out.split() == ["10.0.0.1,2,1:1,3:1", "10.0.0.2,1,2:1"]
    assert cli.main(["index", "-w", a]) == 0
    assert (tmp_path / "a.log.lpi").read_text() == "10.0.0.1,2,1:1,3:1\n10.0.0.2,1,2:1\n"
    store.write_text(ix.build_index(ix.occurrences(src.read_lines(spark, b))), str(tmp_path / "b.log.lpi"))
    capsys.readouterr()
    assert cli.main(["search", "10.0.0.1", a, b]) == 0
    out = capsys.readouterr()
    assert out.out == "x 10.0.0.1\nz 10.0.0.1\nq 10.0.0.1\n" and "MATCH [10.0.0.1] with 2 lines" in out.err
    assert cli.main(["index", "-p", a]) == 0 and (tmp_path / "a.log.lpi.parquet").is_dir()
    (tmp_path / "a.log.lpi").unlink()
    capsys.readouterr()
    write(tmp_path / "terms", b"10.0.0.2\n10.0.0.1\n")
    assert cli.main(["search", "-f", str(tmp_path / "terms"), "-w", str(tmp_path / "out"), a]) == 1  # nothing is there yet
    monkeypatch.setattr(cli, "is_safe", lambda path, refused: True)
    assert cli.main(["search", "-f", str(tmp_path / "terms"), "-w", str(tmp_path / "out"), a]) == 0
    assert (tmp_path / "out").read_text() == "x 10.0.0.1\ny 10.0.0.2\nz 10.0.0.1\n"
    assert "MATCH [10.0.0.1] with 2 lines" in capsys.readouterr().err
    assert cli.main(["search", "-q", "10.0.0.2", a]) == 0
    assert capsys.readouterr().out == ""
    assert cli.main(["search", "10.0.0.2", str(tmp_path / "none.log")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["index", "-d", "12", a])


def test_standard_input(spark):
    rows = src.stream_lines(spark, iter(["a 10.0.0.1\n", "b", "c\n"]), chunk=2).collect()
    assert sorted(tuple(r) for r in rows) == [("-", 1, "a 10.0.0.1"), ("-", 2, "b"), ("-", 3, "c")]
    assert src.stream_lines(spark, iter([])).count() == 0


def test_saved_splits_and_sizes(spark, tmp_path):
    a = write(tmp_path / "a.log", b"x\ny\n")
    b = write(tmp_path / "b.log", b"x\ny 10.0.0.1\nz\n")
    splits = shared.save(src.split_table(spark, [a, b]), "splits")
    lines = src.read_lines(spark, [a, b], splits)
    assert sorted(r["line_no"] for r in lines.collect()) == [1, 1, 2, 2, 3]
    with pytest.raises(Exception, match="other splits"):
        src.read_lines(spark, [write(tmp_path / "c.log", b"x\n")], splits).collect()
    assert sorted(r["bytes"] for r in src.file_sizes(spark, [a, b]).collect()) == [4, 15]


def test_an_unsplittable_file_is_dealt_out(spark, tmp_path):
    lines = src.read_lines(spark, write(tmp_path / "a.log.gz", b"".join(b"x %d\n" % k for k in range(5000))))
    sizes = [len(p) for p in lines.rdd.glom().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and min(sizes) > 500
    assert sorted(r["line_no"] for r in lines.collect()) == list(range(1, 5001))


def test_an_address_of_many_lines_has_several_records(spark):
    rows = [("f", k, "10.0.0.1" + " 10.0.0.2" * (k == 5)) for k in range(1, 3001)]
    found = ix.occurrences(spark.createDataFrame(rows, "file string, line_no long, text string"))
    index = ix.by_count(store.format_records(ix.build_index(found, record_lines=1000))).collect()
    assert [(r["address"], r["n"], r["total"]) for r in index] == [("10.0.0.1", n, 3000) for n in (999, 1000, 1000, 1)] + [("10.0.0.2", 1, 1)]
    again = store.parse_records(spark.createDataFrame([(r["record"],) for r in index], "value string"))
    assert [r["occurrences"] for r in search.quick(again, terms.argument_terms(spark, "10.0.0.1")).collect()] == [3000]


def test_building_a_search_reads_no_line(spark, tmp_path, log):
    """Nothing but the stored index is read before the result is asked for, and a scan without an index extracts once."""
    store.write_parquet(ix.postings(log[1]), str(tmp_path / "i.parquet"))
    lines = src.read_lines(spark, log[0])
    wanted = terms.argument_terms(spark, "10.0.0.1")
    plan = search.scan(lines, wanted)
    assert plan._jdf.queryExecution().executedPlan().toString().count("posexplode") == 1
    assert sorted((r["line_no"], r["field"]) for r in plan.collect()) == [(1, 1), (2, 1), (2, 2)]
    found = search.retrieve(lines, search.hits(store.read_parquet(spark, str(tmp_path / "i.parquet")), wanted))
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 3


def test_paths(tmp_path):
    good = tmp_path / "a.log"
    good.write_text("x")
    (tmp_path / "link.log").symlink_to(good)
    assert is_safe(str(good), ()) and is_safe(str(tmp_path / "new.log"), ())
    for bad in ("", "..", "../a.log", "a\nb", str(tmp_path / "link.log"), "/etc/passwd", str(tmp_path / "no" / "a.log")):
        assert not is_safe(bad)
