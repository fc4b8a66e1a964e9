"""Counts against the SentencePiece library's unigram search over the same pieces and scores, and brute force."""

import random
import struct

import pytest

from propgraph.llm import token_counts

from . import helpers

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if not byte & 128:
            return value, at


def coded(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram_model():
    """The model file with our scores, declared a unigram model."""
    pieces = token_counts.load_pieces(MODEL)
    data, at, out = open(MODEL, "rb").read(), 0, b""
    while at < len(data):
        tag, at = varint(data, at)
        size, at = varint(data, at)
        body = data[at : at + size]
        at += size
        if tag >> 3 == 1:
            n, start = varint(body, 1)
            name = body[start : start + n].decode()
            if name in pieces and b"\x18" not in body[start + n :][5:6]:
                body = body[: start + n] + b"\x15" + struct.pack("<f", pieces[name]) + body[start + n + 5 :]
        elif tag >> 3 == 2:
            body = body.replace(b"\x18\x02 ", b"\x18\x01 ", 1)
        out += coded(tag) + coded(len(body)) + body
    return out


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=unigram_model())


def test_counts_match_the_library(spark, library):
    own = token_counts.Counter(token_counts.load_pieces(MODEL), nodes=3000)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "é", "漢", "😀", "1", "!", "ing", "\t", "▁", "x" * 40]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    differ = [t for t in texts if own(t)[0] != len(library.encode(t))]
    assert len(differ) <= len(texts) // 200  # the library adds in single precision, so near ties can fall otherwise
    assert all(abs(own(t)[0] - len(library.encode(t))) <= 2 for t in differ)


def test_counts_match_brute_force():
    pieces = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.1, "aba": -4.2, "▁": -1.0, "▁a": -2.2, "abab": -5.9}
    own = token_counts.Counter(pieces)

    def best(s):
        table = [(0.0, 0)]
        for end in range(1, len(s) + 1):
            ways = [(table[i][0] + pieces[s[i:end]], -table[i][1] - 1) for i in range(end) if s[i:end] in pieces]
            ways.append((table[end - 1][0] + min(pieces.values()) - 10, -table[end - 1][1] - len(s[end - 1].encode())))
            score, n = max(ways)
            table.append((score, -n))
        return table[-1][1]

    rng = random.Random(1)
    for _ in range(800):
        t = "".join(rng.choice("ababc é\n") for _ in range(rng.randint(1, 20)))
        assert own(t)[0] == best("▁" + t.replace(" ", "▁"))
    long = "ab" * 500
    assert own(long)[0] == best("▁" + long)
    nodes = len(own.best)
    own("abab abab abab")
    assert len(own.best) <= nodes + 6


def test_awkward_rows(spark):
    rows = token_counts.count_tokens(helpers.awkward(spark), MODEL).collect()
    own = token_counts.counter(MODEL)
    assert sorted(map(str, rows)) == sorted(str(type(rows[0])(doc_id=r["doc_id"], n_tokens=own(r["text"])[0], n_pretokens=own(r["text"])[1])) for r in helpers.awkward(spark).collect())
    assert token_counts.count_tokens(helpers.empty(spark), MODEL).count() == 0
