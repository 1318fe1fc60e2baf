"""Byte-level BPE and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from wikitables.llm import bpe, chunks, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def odd_texts(n, seed):
    rng = random.Random(seed)
    alphabet = "aàeéiioouß  \n\t\xa0\x1f\x85thrns'.,!?09中文字😀́Ġ"
    return ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(n)]


def test_transcode(hard_docs, hard, no_docs, reference):
    found = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in bpe.transcode(hard_docs, RANKS, P.PATTERN).collect()), key=repr)
    wanted = [(i, bytearray(np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()), t or "") for i, t in hard]
    assert found == sorted(wanted, key=repr)
    assert bpe.transcode(no_docs, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_encoder(reference, monkeypatch, small):
    """Also with memories so small that they are emptied all the time."""
    if small:
        for module, name, value in ((bpe, "STATES", 50), (bpe, "PAIRS", 10), (bpe, "REMEMBERED", 5), (chunks, "REMEMBERED", 8)):
            monkeypatch.setattr(module, name, value)
    encoder = bpe.BpeEncoder(RANKS, P.PATTERN)
    for text in [*odd_texts(3000, 1), "a" * 3000, "ab" * 999, "=" * 500, "thethe" * 200]:
        ids = encoder.encode([text])[0]
        assert ids == np.array(reference.encode_ordinary(text), "<u4").tobytes(), text
        assert "".join(encoder.decode(ids)) == text


def test_decoder_holds_back_broken_characters(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 1)
    encoder = bpe.BpeEncoder(RANKS, P.PATTERN)
    ids = np.array([encoder.ranks[bytes([b])] for b in "ß中😀".encode()], "<u4").tobytes()
    parts = list(encoder.decode(ids))
    assert "".join(parts) == "ß中😀" and parts[0] == "" and parts[1] == "ß"
    assert "".join(encoder.decode(ids[:-4])) == "ß中�"


def test_packing_ids_are_the_librarys(library):
    encoder = packing.Encoder(JSON, P.PATTERN)
    for text in odd_texts(2000, 2):
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("length", [1024, 7, 1])
def test_pack(hard_docs, hard, library, length):
    if length == 1:
        hard, hard_docs = [x for x in hard if x[0] not in (10, 11)], hard_docs.where("doc_id is null or doc_id not in (10, 11)")
    pieces = packing.pack(hard_docs, JSON, P.PATTERN, length).collect()
    wanted = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,) for _, t in hard)
    by_sequence, tokens = defaultdict(list), []
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        held = by_sequence[r["sequence_id"]]
        assert r["offset"] == sum(held)
        held.append(r["length"])
        if r["start"] == 0:
            tokens.append((r["doc_tokens"], []))
        assert r["start"] == len(tokens[-1][1])  # a document's pieces follow each other
        tokens[-1][1].extend(ids)
    assert all(n == len(x) for n, x in tokens) and sorted(tuple(x) for _, x in tokens) == wanted
    total = sum(map(len, wanted))
    assert sorted(by_sequence) == list(range(-(-total // length)))
    assert all(sum(held) == length for s, held in by_sequence.items() if s < total // length)


def test_pack_nothing(no_docs):
    assert packing.pack(no_docs, JSON, P.PATTERN, with_ids=False).count() == 0


def test_queries_hash(spark, tmp_path, stored_docs, hard, reference):
    stored_docs(hard).write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op5_byte_bpe(spark, str(tmp_path)).collect()}
    for i, t in hard:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        assert (i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) in found


def test_long_matches_keep_the_states_bounded(reference, monkeypatch):
    """A match of many different letters: states are dropped inside of it, and the guesses under way are kept."""
    monkeypatch.setattr(bpe, "STATES", 400)
    transducer = bpe.Transducer(bpe.load_ranks(RANKS))
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=20_000))
    assert transducer.encode(text.encode()) == reference.encode_ordinary(text)
    assert len(transducer.states) <= 402


def test_added_tokens_are_their_ids(library):
    encoder = packing.Encoder(JSON, P.PATTERN)
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "x<|endoftext|>\n y"):
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
