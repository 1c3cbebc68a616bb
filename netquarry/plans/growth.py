"""Queries over logs that grow, age and are stored in little space, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import plain, token_batches, tokenizer
from ..operators import compressed, search, upkeep
from ..operators import index as ix
from ..sources import follow, store, terms
from ..streaming import live
from . import oracle, queries
from .queries import LOG_FILES, PRUNED_TERMS, SYNTHETIC_TEXT, odd, synthetic, table, text_lines
from .queries import _FILES, _FILES_OCC, _LOG, _ODD, _DOCS, _OCC  # noqa: PLC2701

#: Parts of the log that arrive after each other.
STEPS = 4


def grow(spark: SparkSession, sf_dir: str, place: str, step: int) -> None:
    """Let the files of the log at place have the lines that it has after a step. Each file is written anew by one task under
    its own name, so that a task that runs again changes nothing; what stood in it before is what it begins with."""
    rows = synthetic(spark, sf_dir).withColumn("part", ((F.col("line_no") - 1) % LOG_FILES).cast("int"))
    until = rows.count() * (step + 1) // STEPS
    system, folder = fs.FileSystem.from_uri(place)
    system.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, here = fs.FileSystem.from_uri(place)
        with ExitStack() as stack:
            handles: dict[int, pa.NativeFile] = {}
            for batch in batches:
                for part, text in zip(batch["part"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    if part not in handles:
                        handles[part] = stack.enter_context(store_.open_output_stream(f"{here}/synthetic-{part}.log"))
                    handles[part].write(text.encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([len(handles)], pa.int64())], names=["files"])

    ordered = rows.filter(F.col("line_no") <= until).repartition(LOG_FILES, "part").sortWithinPartitions("part", "line_no")
    ordered.select("part", "text").mapInArrow(write, "files long").agg(F.sum("files")).collect()


def _uri(path: str) -> str:
    return path if "://" in path else path.replace("file:", "file://", 1)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.regexp_extract("file", "[^/]*$", 0))


def _places(index: DataFrame) -> DataFrame:
    rows = _named(index).select("file", "address", "kind", F.explode("locations").alias("x"))
    return rows.select("file", "address", "kind", "x.line", "x.field")


def appended_log_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a log whose files were appended to three times, of which only the appended bytes were read."""
    log, place = _uri(shared.new_path(spark, "appended")), shared.new_path(spark, "appended-index")
    for step in range(STEPS):
        grow(spark, sf_dir, log, step)
        upkeep.refresh(spark, place, log)
    return _places(upkeep.read_grown(spark, place))


def followed_log_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of a log that is followed as a stream, which is started again from its checkpoint after each growth."""
    log, place = _uri(shared.new_path(spark, "followed")), shared.new_path(spark, "followed-index")
    for step in range(STEPS):
        grow(spark, sf_dir, log, step)
        stream = follow.follow(spark, log)
        live.write_followed(stream, f"{place}/out", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return _places(live.read_followed(spark, f"{place}/out"))


#: Of a row's place in time: rows for which the first holds come in the last step, so that those of the first step are far too
#: late; those of the second come nine minutes late, which is allowed.
FAR_LATE = "event_id % 97 = 0"
LITTLE_LATE = "event_id % 10 = 3"
SPAN = "(SELECT min(ts) AS low, max(ts) AS high FROM events)"


def _in_steps(spark: SparkSession, sf_dir: str, start: Callable[[DataFrame, str], object], name: str) -> str:
    """Run a stream over the events with their times in steps, each from the checkpoint of the last; return its folder."""
    place = shared.new_path(spark, name)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first() or (0, 0)
    came = F.col("ts").cast("double") + F.when(F.expr(LITTLE_LATE), 540).otherwise(0)
    step = F.least(F.floor((came - F.lit(low)) / F.lit(((high or 0) - (low or 0)) / STEPS + 1e-6)), F.lit(STEPS - 1)).cast("int")
    step = F.when(F.expr(FAR_LATE) & (step == 0), STEPS - 1).otherwise(step)
    timed = shared.save(events.select("ts", F.expr(SYNTHETIC_TEXT).alias("text"), step.alias("step")), name)
    for k in range(STEPS):
        timed.filter(F.col("step") == k).select("ts", "text").write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema("ts timestamp, text string").parquet(f"{place}/in")
        start(stream, place).awaitTermination()
    return place


def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in each hour that is over, of a stream in which some rows come too late and are dropped."""

    def start(stream: DataFrame, place: str):
        out = live.windowed_counts(stream, "ts", "10 minutes", "1 hour")
        write = out.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out")
        return write.option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()

    place = _in_steps(spark, sf_dir, start, "stream-windows")
    rows = spark.read.schema("start timestamp, address string, kind string, n long").parquet(f"{place}/out")
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


#: For how long an address may be unseen.
IDLE_MINUTES = 360


def aged_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time and count of the addresses that aged out of a stream, with rows that come late."""

    def start(stream: DataFrame, place: str):
        records = live.aged(stream, "ts", "10 minutes", f"{IDLE_MINUTES} minutes")
        return live.write_aged(records, f"{place}/out", f"{place}/state").trigger(availableNow=True).start()

    place = _in_steps(spark, sf_dir, start, "aged")
    rows = spark.read.schema("address string, kind string, first_seen timestamp, last_seen timestamp, n long").parquet(f"{place}/out")
    seen = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_seen", "last_seen")}
    return rows.withColumns(seen)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = shared.new_path(spark, "blocks")
    every = synthetic(spark, sf_dir).unionByName(odd(spark, sf_dir))
    store.write_blocks(compressed.compress(ix.postings(ix.occurrences(every))), place)
    return store.read_parquet(spark, place)


def compressed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of two logs out of compressed blocks in storage."""
    return _places(compressed.decompress(_blocks(spark, sf_dir)))


def compressed_range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of addresses in a range of lines, from the blocks that reach into it."""
    wanted = terms.argument_terms(spark, RANGE_TERMS)
    return compressed.between(_blocks(spark, sf_dir), wanted, RANGE_LINES[0], RANGE_LINES[1])


RANGE_TERMS = f"192.168.1.7,192.168.1.2,10.1.1.1,{PRUNED_TERMS}"
RANGE_LINES = (200, 900)


def _token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd(spark, sf_dir).unionByName(synthetic(spark, sf_dir)).unionByName(text_lines(spark, sf_dir, "documents", "text", "doc_id"))


def general_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by their templates of all tokens."""
    return token_batches.template_counts(_token_lines(spark, sf_dir))


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each kind in each log, and how many different ones there are."""
    lines = odd(spark, sf_dir).unionByName(text_lines(spark, sf_dir, "documents", "text", "source"))
    return token_batches.kind_counts(lines)


def first_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each term in a log without an index, whose files are read until no term is open."""
    log = queries._written_log(spark, sf_dir)
    return queries._named(search.first_places(spark, log, terms.argument_terms(spark, FIRST_TERMS), files=2))


FIRST_TERMS = f"{RANGE_TERMS},2001:db8::1"

def table_function_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses of documents and of the log by SQL text alone, with the batched table function."""
    plain.register(spark)
    every = text_lines(spark, sf_dir, "documents", "text", "doc_id").unionByName(synthetic(spark, sf_dir)).unionByName(odd(spark, sf_dir))
    return spark.sql("SELECT file, address, kind, line_no AS line, field FROM extract_from_lines(TABLE(SELECT file, line_no, text FROM {every}))", every=every)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "appended_log_index": appended_log_index,
    "followed_log_places": followed_log_places,
    "stream_windowed_counts": stream_windowed_counts,
    "aged_addresses": aged_addresses,
    "first_places": first_places,
    "compressed_postings": compressed_postings,
    "compressed_range_search": compressed_range_search,
    "general_templates": general_templates,
    "token_kinds": token_kinds,
    "table_function_places": table_function_places,
}

_PLACES = "SELECT file, address, kind, line_no AS line, CAST(field AS INTEGER) AS field FROM {} AS o"
# What a stream in steps has kept: far-late rows of the first step are gone.
_QUARTER = f"(epoch_us(high) - epoch_us(low)) / 1e6 / {STEPS}"
_CAME = f"(epoch_us(ts) - epoch_us(low)) / 1e6 + CASE WHEN {LITTLE_LATE} THEN 540 ELSE 0 END"
_KEPT = f"(SELECT e.*, high FROM events AS e, {SPAN} AS s WHERE NOT ({FAR_LATE} AND {_CAME} < {_QUARTER}))"
_SEEN = f"(SELECT o.address, o.kind, k.ts, k.high FROM {_OCC} AS o JOIN {_KEPT} AS k ON o.line_no = k.event_id + 1)"
_BOTH = oracle.occurrences(f"(SELECT * FROM {_LOG} AS l UNION ALL SELECT * FROM {_ODD} AS m)")
_IN = ", ".join(f"'{t}'" for t in RANGE_TERMS.split(","))


def _kind_sql(t: str) -> str:
    few = f"length({t}) - length(replace({t}, ':', '')) <= {tokenizer.COLONS}"
    cases = "".join(
        f" WHEN regexp_matches({t}, '^(?:{shape})$'){f' AND {few}' if kind == 'ipv6' else ''} THEN '{kind}'" for kind, shape in tokenizer.SHAPES.items()
    )
    return f"(CASE{cases} WHEN length({t}) > 1 AND {t}[1] <> '\"' THEN 'string' END)"


def _tokens_sql(lines: str) -> str:
    """file, line_no, pos, token, kind and quoted of the tokens of lines."""
    every = f"SELECT file, line_no, unnest(a) AS token, unnest(range(len(a))) AS pos FROM (SELECT file, line_no, regexp_extract_all(text, '{tokenizer.TOKEN}') AS a FROM {lines} AS l)"
    return f"""(SELECT file, line_no, pos, CASE WHEN quoted THEN token[2:-2] ELSE token END AS token, quoted, CASE WHEN quoted THEN 'string' ELSE {_kind_sql("token")} END AS kind
        FROM (SELECT *, token[1] = '"' AND length(token) > 1 AS quoted FROM ({every})))"""


_CODE = "CASE kind " + " ".join(f"WHEN '{k}' THEN '%{c}'" for k, c in tokenizer.CODES.items()) + " END"
_TOKEN_LINES = f"(SELECT * FROM {_ODD} AS a UNION ALL SELECT * FROM {_LOG} AS b UNION ALL SELECT * FROM {_DOCS} AS c)"
_KIND_LINES = f"(SELECT * FROM {_ODD} AS a UNION ALL SELECT * FROM {oracle.lines('documents', 'text', 'source')} AS c)"

ORACLES: dict[str, str] = {
    "table_function_places": _PLACES.format(oracle.occurrences(_TOKEN_LINES)),
    "appended_log_index": _PLACES.format(_FILES_OCC),
    "followed_log_places": _PLACES.format(_FILES_OCC),
    "stream_windowed_counts": f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, address, kind, count(*) AS n FROM {_SEEN} AS s
        WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= high - INTERVAL 10 MINUTE GROUP BY ALL""",
    "aged_addresses": f"""SELECT address, kind, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, count(*) AS n FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY address ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS record FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY address ORDER BY ts) <= INTERVAL {IDLE_MINUTES} MINUTE THEN 0 ELSE 1 END AS fresh FROM {_SEEN} AS s))
        GROUP BY address, kind, record HAVING max(ts) + INTERVAL {IDLE_MINUTES} MINUTE <= any_value(high) - INTERVAL 10 MINUTE""",
    "first_places": f"""SELECT o.address AS term, o.file, o.line_no, CAST(o.field AS INTEGER) AS field, l.text FROM {_FILES_OCC} AS o
        JOIN {_FILES} AS l ON o.file = l.file AND o.line_no = l.line_no WHERE o.address IN ({", ".join(f"'{t}'" for t in FIRST_TERMS.split(","))})
        QUALIFY row_number() OVER (PARTITION BY o.address ORDER BY regexp_extract(o.file, '[0-9]+') || '/', o.line_no, o.field) = 1""",
    "compressed_postings": _PLACES.format(_BOTH),
    "compressed_range_search": f"""SELECT file, address AS term, line_no AS line, CAST(field AS INTEGER) AS field FROM {_BOTH} AS o
        WHERE address IN ({_IN}) AND line_no BETWEEN {RANGE_LINES[0]} AND {RANGE_LINES[1]}""",
    "general_templates": f"""SELECT coalesce(template, '') AS template, count(*) AS lines FROM {_TOKEN_LINES} AS l LEFT JOIN (
        SELECT file, line_no, string_agg(CASE WHEN quoted THEN '"%s"' WHEN token = '%' THEN '%%' ELSE coalesce({_CODE}, token) END, '' ORDER BY pos) AS template
        FROM {_tokens_sql(_TOKEN_LINES)} AS t GROUP BY ALL) AS u USING (file, line_no) GROUP BY ALL""",
    "token_kinds": f"""SELECT file, kind, CAST(count(*) AS BIGINT) AS tokens, count(DISTINCT token) AS different FROM {_tokens_sql(_KIND_LINES)} AS t
        WHERE kind IS NOT NULL GROUP BY file, kind""",
}
