import itertools
import random
import struct
import zlib
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

import corpus_pipeline
from netquarry.llm import queries, scratch
from netquarry.llm import sentencepiece_codec as sc

MODEL = queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    pick = random.Random(3)
    out = ["", " ", "  a", "a", "Hello world", "\n\n x\n", "▁x ▁", "😀é ñ’s", "a" * 300, "aaab" * 50, "  \t x", "http://www.foo.com/bar?x=1&y=2", "1234567890 12,345.678", "ﬁ ½ ①", " x　y", "end "]
    alphabet = "abcdehilnorstu .,'\"-_/()0123456789ABCTé\nü▁漢😀\t"
    out += ["".join(pick.choice(alphabet) for _ in range(pick.randrange(1, 80))) for _ in range(1500)]
    return out + [" ".join("".join(pick.choice("eatoinshrdl") for _ in range(pick.randrange(1, 15))) for _ in range(30)) for _ in range(300)]


def test_same_ids_and_texts_as_the_library(library, rows):
    every = texts() + list(rows.values())
    own = sc.WordEncoder(MODEL)
    ids, offsets = own.encode(pa.array(every))
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]
    want = library.encode(every)
    assert got == want
    back = library.decode(want)
    assert [x.decode(errors="replace") for x in own.decode_all(ids, offsets)] == back
    assert [own.pieces.decode(np.array(x)) for x in want[:600]] == back[:600]


def field(number, kind, content):
    """A protobuf field: kind 0 number, 2 bytes, 5 float."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    head = varint(number << 3 | kind)
    return head + (varint(content) if kind == 0 else struct.pack("<f", content) if kind == 5 else varint(len(content)) + content)


def unigram_model(path):
    """A small model of the unigram kind with byte pieces, written by hand."""
    pick = random.Random(4)
    words = {"▁", *"abcdeént", "▁a", "▁the", "the", "ab", "abc", "bcd", "cde", "de", "en", "ent", "tent", "▁ten", "nn", "eé", "▁▁"}
    words |= {"".join(pick.choice("abcdent") for _ in range(pick.randrange(2, 6))) for _ in range(60)}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]
    pieces += [(w, -2 - 7 * pick.random(), 1) for w in sorted(words)]
    content = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, s) + field(3, 0, t)) for p, s, t in pieces)
    content += field(2, 2, field(3, 0, 1) + field(35, 0, 1))  # unigram, byte fallback
    content += field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    path.write_bytes(content)
    return str(path)


def test_viterbi_of_a_unigram_model_equals_the_library(tmp_path):
    path = unigram_model(tmp_path / "unigram.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), sc.WordEncoder(path)
    assert own.pieces.unigram and not sc.Pieces(MODEL).unigram
    for seed in range(1, 21):
        pick = random.Random(seed)
        every = ["".join(pick.choice("abcdeént the x  ") for _ in range(pick.randrange(0, 50))) for _ in range(1000)] + ["", " ", "漢 abc", "\n\n ab", "▁ab c"]
        every += [" ".join(every[:400])]  # rounding grows with the text
        ids, offsets = own.encode(pa.array(every))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == model.encode(every), seed
        assert [x.decode() for x in own.decode_all(ids, offsets)] == [t.replace("▁", " ") for t in every]
    # The pass over sorted words gives each word's own best path.
    words = sorted({"▁" + w for t in every for w in t.split(" ")})
    assert own.pieces.encode(words) == [own.pieces.encode([w])[0] for w in words]


def test_encode_and_decode_rows(spark, library, hard):
    docs = hard.select("doc_id", "text")
    out = sc.decode(sc.encode(hard, MODEL), MODEL).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["ids"] == (None if r["text"] is None else library.encode(r["text"])) and r["decoded"] == r["text"]
    assert sc.encode(hard.limit(0), MODEL).count() == 0


def test_round_trip(library, documents, rows):
    for r in sc.round_trip(documents, MODEL).collect():
        ids = library.encode(rows[r["doc_id"]])
        assert r["same"] and r["n_ids"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_stages_one_by_one(spark, sf, documents):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = scratch.save(stage(spark, docs, sf), "test-stage")
        assert docs.columns == documents.columns
        kept[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r["text"] for r in docs.collect()})
    before, after = kept["quality rules"]
    assert all(before[i] == t for i, t in after.items()) and 0 < len(after) < len(before)
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    assert all(i in after for i in good if i in before and len(cases.words(before[i])) >= 20 and cases.quality(before[i])[4] * 100 <= 30 * len(cases.words(before[i])))
    before, after = kept["line dedup"]
    assert all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in after.items())
    before, after = kept["n-gram Jaccard join"]
    assert set(after) == {c for _, c in cases.classes(before.items(), 5, 80, 100).values()}
    before, after = kept["personal data"]
    assert set(before) == set(after)
    for i, t in after.items():
        assert (t == before[i]) == (cases.personal(before[i]) == "") and cases.personal(t) == ""
    packed = sorted(corpus_pipeline.sequences(spark, docs, sf).collect(), key=lambda r: (r["doc_id"], r["start"]))
    tokenizer, got, room = tokenizers.Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")), {}, {}
    for r in packed:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert r["start"] == len(got.setdefault(r["doc_id"], [])) and r["length"] == len(ids)
        got[r["doc_id"]] += ids
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in after.items()}
    for pieces in room.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces)][:-1] and sum(pieces[-1]) <= 4096


def test_whole_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 50


def test_stages_bear_hard_and_no_rows(spark, sf, hard):
    for docs in (hard, hard.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, sf), "test-stage")
            assert docs.columns == hard.columns
        corpus_pipeline.sequences(spark, docs, sf).count()


def test_each_stage_on_hard_rows(spark, sf, hard):
    """Which of the null, empty, repeated and long rows each stage keeps, given all of them."""
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name: Counter((r["doc_id"], r["text"]) for r in stages[name](spark, hard, sf).collect())
    given = Counter((r["doc_id"], r["text"]) for r in hard.collect())
    wordless = {k: n for k, n in given.items() if not cases.words(k[1] or "")}
    accepted, joined, cleaned = run("quality rules"), run("n-gram Jaccard join"), run("personal data")
    assert all(given[k] == n and len(cases.words(k[1] or "")) >= 20 for k, n in accepted.items())
    assert all(given[k] == n for k, n in joined.items()) and all(joined[k] == n for k, n in wordless.items())
    lines = run("line dedup")
    assert all(lines[k] == n for k, n in given.items() if k[1] is None)
    assert Counter(k[0] for k in cleaned.elements()) == Counter(k[0] for k in given.elements())
    assert all(cleaned[k] >= n for k, n in wordless.items())


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14))
