"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1). BENCH_CPUS: threads (default 8).
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from netquarry.operators import index as ix
from netquarry.operators import search
from netquarry.plans.queries import QUERIES
from netquarry.sources import lines as src
from netquarry.sources import store, terms

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = """ipv4_index_documents synth_index_all index_records_text combined_index_multi_source search_terms_exact
    search_quick_counts search_retrieve_lines template_match top_talkers cidr_search""".split()
#: Copies of the events in the log that is indexed and searched as a file.
COPIES = int(os.environ.get("BENCH_LOG_COPIES", "20"))


def timed(work) -> float:
    began = time.perf_counter()
    work()
    return round(time.perf_counter() - began, 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    place = tempfile.mkdtemp(prefix="netquarry-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", f"{place}/warehouse")
        .config("spark.checkpoint.dir", f"file://{place}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain(QUERIES["top_talkers"](spark, SF_DIR))  # start-up
    queries = {name: timed(lambda n=name: drain(QUERIES[n](spark, SF_DIR))) for name in HEADLINE}

    # A log as a file: index it, look terms up in the stored index, read their lines again.
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").select(F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("k"), "*")
    from netquarry.plans.queries import SYNTHETIC_TEXT

    events.select(F.concat(F.lit("Jan 01 00:00:00 host daemon: "), F.expr(SYNTHETIC_TEXT)).alias("value")).write.text(f"{place}/log")
    size = sum(p.stat().st_size for p in Path(place, "log").glob("part-*")) / 1e6
    # Numbers come after the one scan that the index takes, from the table of splits that it leaves.
    rows = src.read_splits(spark, f"{place}/log")
    counted = rows.select("file", F.col("mid").alias("line_no"), "text")
    queries["log_count_index"] = timed(lambda: drain(ix.counts(ix.occurrences(counted))))
    queries["log_index_write"] = timed(lambda: store.write_split_index(ix.split_postings(rows), f"{place}/index"))
    index = store.read_split_index(spark, f"{place}/index")
    wanted = terms.argument_terms(spark, "10.1.2.3,2001:db8::1f")
    queries["log_quick_search"] = timed(lambda: search.quick(store.read_parquet(spark, f"{place}/index/places"), wanted).collect())
    queries["log_retrieve"] = timed(lambda: drain(search.retrieve_files(spark, f"{place}/log", search.hits(index, wanted))))
    n = spark.read.text(f"{place}/log").count()
    spark.stop()
    shutil.rmtree(place, ignore_errors=True)
    out = {"metric": "total_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries}
    out |= {"sf": Path(SF_DIR).name.removeprefix("sf"), "log_mb": round(size, 1), "log_lines": n}
    out |= {"index_lines_per_min": round(60 * n / queries["log_index_write"]), "index_mb_per_sec": round(size / queries["log_index_write"], 1)}
    print(json.dumps(out))


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    main()
