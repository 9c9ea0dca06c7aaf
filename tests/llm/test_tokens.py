"""Byte-level BPE and token files against the public libraries."""

import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odd_rows import ROWS
from tablewarden.llm import bpe, common, queries, token_files, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.Ranks(PATH)
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS.ids, special_tokens={})


@pytest.mark.parametrize("sizes", [{}, {"chunk": 3, "known": 8}])
def test_encode_decode(spark, odd, sizes):
    got = bpe.encode(odd.coalesce(1), RANKS, ["doc_id", "kept"], **sizes).withColumn("bytes", bpe.decode(F.col("ids"), RANKS)).collect()
    texts = {i: t or "" for i, t, _, _ in ROWS}
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    for r in got:
        assert r["ids"] == LIBRARY.encode_ordinary(texts[r["doc_id"]]), r["doc_id"]
        assert bytes(r["bytes"]).decode() == texts[r["doc_id"]]


def test_small_chunks_and_digests(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for frame in (odd.select("doc_id", "text"), docs):
        for r in bpe.round_trip(frame, RANKS).join(frame.dropDuplicates().withColumnRenamed("doc_id", "_i"), F.col("doc_id").eqNullSafe(F.col("_i"))).collect():
            ids = LIBRARY.encode_ordinary(r["text"] or "")
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))


def test_every_token_is_its_own_encoding():
    """The fold may start from bytes: no token of the file is out of reach of the merges."""
    pairs = RANKS.pair_ranks()
    for token, rank in list(RANKS.ids.items())[::7]:
        parts = [RANKS.ids[bytes([b])] for b in token]
        while len(parts) > 1:
            low, i = min((pairs.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            assert low < 1 << 30, token
            parts[i:i + 2] = [low]
        assert parts == [rank]


def test_every_token_arises_from_one_pair():
    """The fold goes by ascending ranks: every token of the file must, alone, arise that way; a file where one does not is refused."""
    halves = [RANKS.halves(t) for t in RANKS.tokens if len(t) > 1]
    assert all(a + b in RANKS.ids and max(RANKS.ids[a], RANKS.ids[b]) < RANKS.ids[a + b] for a, b in halves)
    odd = bpe.Ranks(PATH)
    odd.ids, odd.tokens = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"bc": 4}, [b"a", b"b", b"c", b"abc", b"bc"]
    with pytest.raises(ValueError):
        odd.halves(b"abc")


def test_long_pieces_and_small_tables(spark):
    """One piece of 100,000 letters takes as many steps as different tokens occur in it; the tables of the fold stay small in the driver."""
    letters = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(100_000))
    texts = [letters, "é" * 20_001 + "a", "a" * 4_097, "-" * 5_000 + "=" * 5_001]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    started = time.time()
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, RANKS, ["doc_id"]).collect()}
    assert time.time() - started < 60
    assert got == {i: LIBRARY.encode_ordinary(t) for i, t in enumerate(texts)}


def test_empty_table(spark, none, tmp_path):
    assert bpe.encode(none, RANKS, ["doc_id"]).count() == 0 and bpe.round_trip(none, RANKS).count() == 0
    token_files.write(none, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "t"))
    assert token_files.digests(spark, str(tmp_path / "t")).count() == 0


def test_token_files(spark, odd, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write(odd, public_tokenizers.path("byte_bpe_50k.json"), path)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = sorted(((i, t or "") for i, t, _, _ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    key = lambda r: (r[1], str(r[0]))
    assert sorted(map(tuple, token_files.digests(spark, path).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, token_files.metadata(spark, path).collect()), key=key) == sorted((w[:3] for w in want), key=key)
    some = token_files.tokens_of(spark, path, [8]).collect()
    assert [r["ids"] for r in some] == [library.encode(dict(rows)[8], add_special_tokens=False).ids + [2]]
    plan = token_files.metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_special_tokens_as_the_library_finds_them(spark, odd, tmp_path):
    """The query's call: ids as of encode(text, add_special_tokens=False), with the library's other settings at their defaults."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"one {end} two", f"{end}", f"{end}{end}  {end}a", f"a  {end}  b", f" {end}\n\n{end}\n", "<|endoftext|", f"<{end}>", f"it's{end}'s it", end.upper(), "", "plain  text "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, (_, t, _, _) in enumerate(ROWS)]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    want, start = {}, 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert 50256 in library.encode(texts[0], add_special_tokens=False).ids
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op9_token_files"](spark, str(tmp_path / "sf")).collect()}
    assert got == want


def test_pieces_are_encoded_once_and_joined():
    """No piece goes to the library twice, and pieces that are joined have the ids that they have alone."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        model = file.read()
    library = Tokenizer.from_buffer(model)
    texts = [" the", "zqj", "<|endoftext|", "endoftext|>", "|>", "<", "é", "  ", "\n", *(f" w{k}" for k in range(5_000))]
    for specials, odd in ((True, []), (True, ["<|endoftext|>"]), (False, ["<|endoftext|>"])):
        ids_of = token_files.PieceIds.of_worker(model, specials)
        assert (ids_of.cut is not None) == specials
        library.encode_special_tokens = not specials
        want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype=np.int32).tobytes() for t in texts + odd]
        assert ids_of(texts + odd) == want
        again, ids_of.tokenizer = token_files.PieceIds.of_worker(model, specials), None
        assert again is ids_of and again.known == dict(zip(texts + odd, want))
        ids_of._encoded = lambda left: [] if not left else 1 / 0
        assert again(texts + odd) == want
        token_files.PieceIds.of_worker(model, None)          # the next round begins anew


def test_workers_give_memory_back_after_every_chunk(monkeypatch):
    """Workers outlive tasks, and what Arrow's allocator kept counted in every later stage of the pipeline."""
    import pyarrow as pa

    calls = []
    pool = type("Pool", (), {"release_unused": lambda self: calls.append(1)})()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    batches = [pa.RecordBatch.from_arrays([pa.array([2 * k, 2 * k + 1]), pa.array([["a", f" b{k}"], ["a", " c"]])], names=["doc_id", "_pieces"]) for k in range(3)]
    out = list(words._coded(1, 4, 100, None)(iter(batches)))
    assert len(calls) == 3 + 1                     # three chunks of four pieces, and the end
    assert [d for b in out for d in b["doc_id"].to_pylist() if d is not None] == list(range(6))
    assert [p for b in out for p in b["piece"].to_pylist() if p is not None] == [b"a", b" b0", b" c", b" b1", b" b2"]
    calls.clear()
    texts = [pa.RecordBatch.from_arrays([pa.array(["one two", "three"])], names=["text"]) for _ in range(2)]
    assert [t.num_rows for t in common.slices(iter(texts))] == [2, 2] and len(calls) == 2


def test_words_come_first_in_the_pattern(spark):
    """Most pieces are words, so their alternative is tried first; the pieces are those of the library's pattern all the same."""
    import regex

    assert words.PIECES.startswith(r" ?\p{L}+|")
    ends = ["s", "t", "re", "ve", "m", "ll", "d", "S", "r", "x", "'s", " s", "1", ""]
    texts = [f"{a}'{e}{z}" for a in ("it", " ", "", "  ", "9", "'", "\n", "é") for e in ends for z in ("", "y", " z", "'d", "!", "  ")]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", words.pieces(F.col("text")).alias("p")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["p"] == regex.findall(public_tokenizers.PATTERN, r["text"]), r["text"]


def test_stretches_have_the_ids_of_their_texts(monkeypatch):
    """Bytes alone tell where a text is cut: whatever stands side by side, the ids are the library's, and texts in one chunk do not touch."""
    import random

    import pyarrow as pa
    import pyspark

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    with open(path, "rb") as file:
        model = file.read()
    atoms = [*"ab'sS9 \n\t.,<>|é×ß´ªº ’“—…日я٣́😀½²\x1c\x00", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "  ", "\n\n", "<|endoftext|>", "<|endof", "text|>",
             "'s", "'ll", " the", "ing", " 's", " '", "\r\n", "don't", "​", "﻿"]
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(atoms) for _ in range(rnd.randrange(0, 25))) for _ in range(20_000)] + [None, "", "  ", "x  ", "  <|endoftext|>", " <|endoftext|> x"]
    for specials, limit in ((True, 300), (True, 1 << 20), (False, 30_000)):
        library.encode_special_tokens = not specials
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
        rows = [r for b in token_files._tokenized(model, 7, specials, limit)(iter([batch.slice(0, 9_001), batch.slice(9_001)])) for r in b.to_pylist()]
        start = 0
        for k, (r, t, want) in enumerate(zip(rows, texts, library.encode_batch([t or "" for t in texts], add_special_tokens=False), strict=True)):
            assert r == {"doc_id": k, "part": 0, "start_in_part": start, "n_tokens": len(want.ids) + 1, "ids": want.ids + [7]}, t
            start += len(want.ids) + 1


def test_words_are_cut_at_bytes():
    """Latin words, numbers and marks are stretches of their own, so that few different ones go to the library."""
    texts = ["It's  the «größte» thing, (aged 42).\n\nNon–stop", " x"]
    raw = [t.encode() for t in texts]
    begins = token_files.stretches(np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([0, len(raw[0])]), [])
    data = b"".join(raw)
    cuts = [data[a:b].decode() for a, b in zip(begins, [*begins[1:], len(data)])]
    assert cuts == ["It", "'s", " ", " the", " «größte»", " thing", ",", " (", "aged", " 42", ").", "\n", "\n", "Non–stop", " x"]
