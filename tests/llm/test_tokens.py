import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netquarry.llm import packing, queries, token_store, tokens
from netquarry.llm import scratch
from netquarry.llm.token_store import EliasFano, TokenFile, pack_file

BYTES, WORDS = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("word_bpe_49k.json")
ALPHABET = "abc XYZ  .,'\"-7 07\n\t\r\x0b\x1c$é«»ñ漢́ｚ ７ "


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library(path, texts):
    return [e.ids for e in tokens.encoder(path).tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_give_the_ids_of_whole_texts(path, rows):
    pick = random.Random(1)
    texts = ["".join(pick.choice(ALPHABET) for _ in range(pick.randrange(0, 60))) for _ in range(3000)] + [None, "", "'s 's don't we'll", "<|endoftext|> x<|endoftext|>"]
    texts += list(rows.values())
    ids, offsets = tokens.encoder(path).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == library(path, texts)


def test_forgetting_keeps_results(monkeypatch, rows):
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    own = tokens.ChunkEncoder(BYTES)
    for _ in range(3):
        ids, offsets = own.encode(pa.array(list(rows.values())[:40]))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == library(BYTES, list(rows.values())[:40])


@pytest.mark.parametrize("values", [[], [0], [7, 7, 7], list(range(200)), [1000 * k * k for k in range(300)]])
def test_elias_fano(values):
    ef = EliasFano.encode(np.array(values, np.int64), values[-1] if values else 0)
    n = len(values)
    assert ef.span(0, n).tolist() == values and [ef.select(k) for k in range(n)] == values
    for a, b in [(0, 1), (1, 5), (60, 70), (63, 64), (64, 128), (100, n), (n, n)]:
        assert ef.span(min(a, n), min(b, n)).tolist() == values[a:b]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_file_and_size():
    pick = np.random.default_rng(3)
    sizes = pick.integers(1, 900, 5000)
    ids = pick.integers(0, 50000, sizes.sum()).astype(np.uint16)
    ends = np.cumsum(sizes)
    content = pack_file(np.arange(5000), np.zeros(5000, bool), ends, ids, 2)
    one = TokenFile(content)
    assert all((one.document(k) == ids[ends[k] - sizes[k] : ends[k]]).all() for k in (0, 1, 63, 64, 65, 4999))
    assert (len(one.bounds.low) + len(one.bounds.high)) * 8 / 5000 < 12  # 64 in a plain table


def test_store_round_trip(spark, documents, rows):
    out = {r["doc_id"]: r for r in token_store.digests(documents, BYTES, 0).collect()}
    start = 0
    for i, ids in zip(sorted(rows), library(BYTES, [rows[i] for i in sorted(rows)]), strict=True):
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (start, len(ids) + 1, crc([*ids, 0]))
        start += len(ids) + 1
    assert len(out) == len(rows)


def test_store_of_hard_and_no_rows(spark, hard):
    out = token_store.digests(hard, BYTES, 0).orderBy("start").collect()
    assert len(out) == hard.count() and [r["start"] for r in out] == np.cumsum([0, *(r["n_tokens"] for r in out)]).tolist()[:-1]
    assert [r["doc_id"] for r in out] == sorted((r["doc_id"] for r in out), key=lambda x: -1 if x is None else x)
    assert token_store.digests(hard.limit(0), BYTES, 0).count() == 0


def test_files_are_rolled(spark, documents, rows, monkeypatch):
    monkeypatch.setattr(token_store, "slices", lambda texts: tokens.slices(texts, 20_000))
    path = scratch.new_path(spark, "rolled")
    files = scratch.save(token_store.write(documents.coalesce(1), path, BYTES, 0, file_ids=20_000), "files")
    assert files.count() > 3
    monkeypatch.setattr(token_store, "PARTS_BLOCK", 1)
    back = token_store.with_start(token_store.read(spark, path), files).orderBy("doc_id").collect()
    want = library(BYTES, [rows[r["doc_id"]] for r in back])
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in back] == [[*x, 0] for x in want]


def test_offsets_come_through_select(spark, documents, monkeypatch):
    path = scratch.new_path(spark, "selected")
    scratch.save(token_store.write(documents.limit(30), path, BYTES, 0), "files")
    content = spark.read.format("binaryFile").load(path).first()["content"]
    ef = TokenFile(bytes(content)).bounds
    ef.samples = ef.samples + 1
    with pytest.raises(ValueError):
        ef.span(0, ef.n)  # a set bit is missing from where the samples now point


def test_width_of_ids(spark, documents, tmp_path):
    """A vocabulary of over 65,536 ids gets four bytes an id; two are refused."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    big = Tokenizer(models.WordLevel({**{f"w{k}": k for k in range(70_000)}, "\n": 70_000, "?": 70_001}, "?"))
    big.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    big.save(str(tmp_path / "big.json"))
    name = str(tmp_path / "big.json")
    assert token_store.id_width(name, 0) == 4 and token_store.id_width(BYTES, 0) == 2 and token_store.id_width(BYTES, 70_000) == 4
    with pytest.raises(ValueError):
        token_store.write(documents, scratch.new_path(spark, "narrow"), name, 0, width=2)
    with pytest.raises(ValueError):
        packing.pack(documents, name, 2, keep_ids=2)
    docs = spark.createDataFrame([(1, "w69999 w1"), (2, "w65536")], "doc_id long, text string")
    path = scratch.new_path(spark, "wide")
    scratch.save(token_store.write(docs, path, name, 0), "files")
    back = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_store.read(spark, path).collect()}
    assert back == {1: [69_999, 1, 0], 2: [65_536, 0]}
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(docs, name, 2, keep_ids=4).collect()}
    assert ids == {1: [69_999, 1, 2], 2: [65_536, 2]}


def shortest_first(histogram, capacity):
    """One piece at a time, longest first, into the shortest pack that it fits."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [k for k, p in enumerate(packs) if sum(p) + length <= capacity]
            if fits:
                packs[min(fits, key=lambda k: sum(packs[k]))].append(length)
            else:
                packs.append([length])
    return sorted(map(tuple, packs))


def test_patterns_are_shortest_pack_first():
    pick = random.Random(5)
    for _ in range(40):
        histogram = {pick.randrange(1, 61): pick.randrange(1, 12) for _ in range(pick.randrange(1, 12))}
        found = sorted(tuple(p) for p, n in packing.patterns(histogram, 60) for _ in range(n))
        assert sorted(map(sum, found)) == sorted(map(sum, shortest_first(histogram, 60)))


def fill(out, capacity=4096):
    used = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values(), default=0) <= capacity and sorted(used) == list(range(len(used)))
    return sum(used.values()) / (capacity * max(1, len(used)))


def test_packing(documents, rows):
    out = packing.pack(documents, WORDS, 2, keep_ids=2).collect()
    want = dict(zip(rows, ([*x, 2] for x in library(WORDS, rows.values())), strict=True))
    for r in out:
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == crc(piece) and np.frombuffer(r["ids"], "<u2").tolist() == piece
    assert sum(r["length"] for r in out) == sum(map(len, want.values())) and fill(out) > 0.97


def test_packing_of_hard_and_no_rows(hard):
    out = packing.pack(hard, WORDS, 2).collect()
    fill(out)
    assert len({(r["doc_id"], r["start"], r["ids_crc32"]) for r in out}) <= len(out) and sum(r["start"] == 0 for r in out) == hard.count()
    assert packing.pack(hard.limit(0), WORDS, 2).count() == 0


def test_patterns_use_every_piece_once():
    pick = random.Random(2)
    for _ in range(50):
        histogram = {pick.randrange(1, 101): pick.randrange(1, 500) for _ in range(pick.randrange(1, 60))}
        found = packing.patterns(histogram, 100)
        used = {}
        for pattern, count in found:
            assert sum(pattern) <= 100 and count > 0
            for length in pattern:
                used[length] = used.get(length, 0) + count
        assert used == histogram


def test_ranks_of_one_length_are_dealt_out(spark):
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    assert sorted(r["rank"] for r in packing.ranked(pieces, 60_000).collect()) == list(range(5000))
