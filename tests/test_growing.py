import re

import pytest

from netquarry.functions import plain
from netquarry.operators import index as ix
from netquarry.operators import networks, search, stats, templates, upkeep
from netquarry.sources import lines as src
from netquarry.sources import store, terms

FILES = {"a.log": "x 10.0.0.1\n\nnothing\n10.0.0.1 10.0.0.2", "b c.log": "\n\n02:00:00:00:00:0a ::1 10.0.0.1\n", "empty.log": "", "d.log": "plain\n" * 50}


def write(folder, files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text)


def places(files):
    """name, address, line and field by plain code."""
    out = []
    for name, text in files.items():
        for number, line in enumerate(text.split("\n"), 1):
            out += [(name, address, number, k) for k, (_, address) in enumerate(plain.extract(line), 1)]
    return sorted(out)


def listed(index):
    rows = index.select("file", "address", "locations").collect()
    name = lambda f: re.sub("^.*/", "", f).replace("%20", " ")
    return sorted((name(r["file"]), r["address"], x["line"], x["field"]) for r in rows for x in r["locations"])


@pytest.mark.parametrize("split", [100, 700, 1 << 20])
def test_numbers_after_one_scan(spark, tmp_path, split):
    """Files of one split and of many, packed into tasks together; numbers of lines without addresses count too."""
    many = {"big.log": "".join(f"line {k} {'10.0.0.%d' % (k % 9) if k % 3 else ''}\n" for k in range(1, 700)), **FILES}
    write(tmp_path / "log", many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        store.write_split_index(ix.split_postings(src.read_splits(spark, str(tmp_path / "log"))), str(tmp_path / "index"))
        splits = store.read_splits_of(spark, str(tmp_path / "index")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert listed(store.read_split_index(spark, str(tmp_path / "index"))) == places(many)
    assert sum(r["lines"] for r in splits) == sum(len(t.split("\n")) - t.endswith("\n") - (not t) for t in many.values())
    assert len(splits) > 5 or split > 1000


def test_an_index_takes_one_scan_of_the_log(spark, tmp_path):
    write(tmp_path / "log", FILES)
    plan = ix.split_postings(src.read_splits(spark, str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_retrieval_opens_the_files_with_hits(spark, tmp_path):
    write(tmp_path / "log", {f"{k} x.log": f"\nhost 10.9.0.{k} here\n10.0.0.9\n" for k in range(20)})
    log = str(tmp_path / "log")
    store.write_split_index(ix.split_postings(src.read_splits(spark, log)), str(tmp_path / "index"))
    index = store.read_split_index(spark, str(tmp_path / "index"))
    found = search.retrieve_files(spark, log, search.hits(index, terms.argument_terms(spark, "10.9.0.3,10.9.0.17")))
    assert sorted((r["line_no"], r["text"], r["term"], r["field"]) for r in found.collect()) == [(2, "host 10.9.0.17 here", "10.9.0.17", 1), (2, "host 10.9.0.3 here", "10.9.0.3", 1)]
    assert sorted(f.rsplit("/", 1)[1] for f in found.inputFiles() if f.endswith(".log")) == ["17%20x.log", "3%20x.log"]
    once = search.retrieve_files(spark, log, search.hits(index, terms.argument_terms(spark, "10.0.0.9")), distinct=True)
    assert once.count() == 20 and once.columns == ["file", "line_no", "text"]
    none = search.retrieve_files(spark, log, search.hits(index, terms.argument_terms(spark, "1.1.1.1")))
    assert none.collect() == [] and none.columns == found.columns


def test_a_growing_log(spark, tmp_path):
    """Only what is new, longer or gone is read; a run that failed before its list was written is repeated."""
    log, place = tmp_path / "log", str(tmp_path / "index")
    write(log, FILES)
    assert upkeep.refresh(spark, place, str(log)) == 3  # an empty file has nothing to read
    assert listed(upkeep.read_grown(spark, place)) == places(FILES)
    assert upkeep.refresh(spark, place, str(log)) == 0
    now = {**FILES, "a.log": FILES["a.log"] + "0\nmore 10.0.0.1\n", "e.log": "10.0.0.5\n"}
    write(log, now)
    assert upkeep.refresh(spark, place, str(log)) == 2
    assert listed(upkeep.read_grown(spark, place)) == places(now)
    (log / "b c.log").unlink()
    now = {**{k: v for k, v in now.items() if k != "b c.log"}, "empty.log": "10.0.0.7"}
    write(log, now)
    (tmp_path / "index" / "run=2" / "places").mkdir(parents=True)  # left by a run that failed
    assert upkeep.refresh(spark, place, str(log)) == 1
    assert listed(upkeep.read_grown(spark, place)) == places(now)
    # A file that comes back with its old size is read again.
    write(log, {"b c.log": FILES["b c.log"]})
    assert upkeep.refresh(spark, place, str(log)) == 1
    assert listed(upkeep.read_grown(spark, place)) == places({**now, "b c.log": FILES["b c.log"]})


def test_most_specific_network(spark):
    import ipaddress
    import random

    pick = random.Random(1)
    four = [f"10.{pick.randrange(3)}.{pick.randrange(4)}.{pick.randrange(256)}" for _ in range(60)]
    six = [f"2001:db8::{pick.randrange(4):x}:{pick.randrange(300):x}" for _ in range(60)]
    known = [f"{a}/{pick.randrange(0, 33)}" for a in four] + [f"{a}/{pick.randrange(0, 129)}" for a in six]
    index = spark.createDataFrame([(a, k) for k, a in enumerate([*four, *six, "11.0.0.1", "02:00:00:00:00:0a", None])], "address string, n int")
    odd = ["10.0.0.0/33", "x/8", "10.0.0.0", "10.0.0.0/8/8", "::/129", None, ""]
    nets = spark.createDataFrame([(x,) for x in [*known, *odd]], "network string")
    out = networks.most_specific(index, nets)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    mine = {r["n"]: (r["address"], r["network"]) for r in out.collect()}
    for k, a in enumerate([*four, *six, "11.0.0.1"]):
        inside = [(ipaddress.ip_network(x, strict=False), x) for x in known]
        inside = [(n.prefixlen, x) for n, x in inside if ipaddress.ip_address(a) in n]
        want = min((-b, x) for b, x in inside)[1] if inside else None
        assert mine.get(k, (a, None)) == (a, want)
    assert networks.most_specific(index, nets.limit(0)).collect() == []


def test_sketches_of_parts_give_that_of_the_whole(spark):
    rows = [(f"f{k % 3}", f"10.{k % 7}.{k % 50}.{k % 200}") for k in range(6000)]
    occ = spark.createDataFrame(rows, "file string, address string")
    exact = len({a for _, a in rows})
    assert abs(stats.united(stats.sketches(occ, "file")).first()["addresses"] - exact) <= 0.05 * exact


def test_template_match_extracts_once(spark):
    log = spark.createDataFrame([("f", 1, "a 10.0.0.1"), ("f", 2, None)], "file string, line_no long, text string")
    wanted = spark.createDataFrame([("%i",), ("",)], "template string")
    out = templates.match(log, wanted)
    patterns = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("[0-9]*[.][0-9.]*")
    assert patterns(out) == patterns(templates.with_template(log)) > 0
    assert sorted((r["line_no"], r["template"]) for r in out.collect()) == [(1, "%i"), (2, "")]
