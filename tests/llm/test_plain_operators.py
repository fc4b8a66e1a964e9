"""Encoding, sharding, mixing and quality rules against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest

from propgraph.llm import bpe, mixing, quality_rules, sharding

from . import helpers

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def plain(spark):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_random_texts_match_the_library(spark):
    own, theirs = bpe.codec(RANKS), plain(spark)
    rng = random.Random(5)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "é", "漢", "1", "٣", "!", "*", "　", "E", "''", "😀", "\r\n", "\x85", "\x1c"]
    for _ in range(1500):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4)]
        for text, (joined, ids) in zip(texts, own.encode_batch(texts)):
            assert ids.tolist() == theirs.encode_ordinary(text)
            assert own.decode(ids) == text.encode()
            assert joined == ",".join(map(str, ids.tolist()))


def test_bpe_long_pieces_and_chunks(monkeypatch):
    own = bpe.codec(RANKS)
    piece = b"ab" * 4000 + b"xyz" * 2000
    monkeypatch.setattr(bpe.Codec, "_merge_long", lambda self, p: None)
    assert own.merge(piece) is None
    monkeypatch.undo()
    short = piece[:250]
    assert own._merge_long(short) == own.merge(short)
    text = "it's  we're \n\n a " * 50
    points = bpe.np.frombuffer((text + "é漢😀").encode("utf-32-le"), bpe.np.uint32)
    whole = [x.tolist() for x in bpe.starts(points)]
    monkeypatch.setattr(bpe, "CHUNK", 7)
    assert [x.tolist() for x in bpe.starts(points)] == whole


def test_bpe_class_of_every_code_point():
    import tiktoken

    single, points = {bytes([i]): i for i in range(256)}, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, kinds = "".join(map(chr, points)), bpe._base_kinds()
    for pattern, kind in ((r"\p{L}", bpe.LETTER), (r"\p{N}", bpe.NUMBER), (r"\s", bpe.WHITE)):
        library = tiktoken.Encoding("one", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        assert bytes(library.encode_ordinary(every)).decode() == "".join(chr(c) for c in points if kinds[c] == kind)


def test_bpe_code_points_in_several_contexts(spark):
    own, theirs = bpe.codec(RANKS), plain(spark)
    chars = [chr(c) for c in [*range(0x20), *range(0x20, 0x3500), *range(0xA000, 0xB000), *range(0xF900, 0x13500, 3), *range(0x14000, 0x32400, 41), *range(0x32400, 0x110000, 997)] if not 0xD800 <= c < 0xE000]
    for texts in (["".join(chars)], ["".join(f"a{c}1{c} {c}'{c}s" for c in chars)], ["".join(f"!{c}{c}\n{c}b" for c in chars)]):
        for text, (_, ids) in zip(texts, own.encode_batch(texts)):
            assert ids.tolist() == theirs.encode_ordinary(text)


def test_bpe_table(spark):
    theirs = plain(spark)
    rows = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.encode(helpers.awkward(spark), RANKS).collect()}
    for r in helpers.awkward(spark).collect():
        ids = theirs.encode_ordinary(r["text"] or "")
        got = rows[r["doc_id"], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert got["n_tokens"] == len(ids) and got["token_ids"] == ids
        assert got["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        lengths = [len(theirs.decode_single_token_bytes(i)) for i in ids]
        assert got["token_starts"] == [0, *accumulate(lengths)][:-1]
    assert bpe.encode(helpers.empty(spark), RANKS).count() == 0
    back = bpe.decode(bpe.encode(helpers.awkward(spark), RANKS), RANKS).collect()
    assert Counter(r["text"] for r in back) == Counter(r["text"] or "" for r in helpers.awkward(spark).collect())


def test_sharding(spark):
    for table in (helpers.awkward(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
        rows = sharding.shard(table, 24).collect()
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
        held, load = defaultdict(list), Counter()
        for r in rows:
            held[r["shard"]].append(r["slot"])
            load[r["shard"]] += r["size"]
        assert all(sorted(v) == list(range(len(v))) for v in held.values())
        assert set(held) <= set(range(24))
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    assert sharding.shard(helpers.empty(spark)).count() == 0


def test_slot_map_versions(spark, tmp_path):
    rng = random.Random(2)
    sizes = [int(rng.paretovariate(1.5) * 100) for _ in range(4096)]
    first = sharding.SlotMap.fill(sizes, 24)
    grown = first.rebalance(sizes, 25)
    assert grown.version == 2 and all(grown.shard_of[i] == first.shard_of[i] for i in range(4096) if i not in grown.moved)
    assert all(grown.shard_of[i] == 24 for i in grown.moved)
    load = Counter()
    for i, s in enumerate(grown.shard_of):
        load[s] += sizes[i]
    assert max(load.values()) <= 1.06 * sum(sizes) / 25
    shrunk = grown.rebalance(sizes, 20)
    assert max(shrunk.shard_of) == 19
    first.save(spark, str(tmp_path / "map"))
    grown.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).shard_of == grown.shard_of
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1).shard_of == first.shard_of


def test_stored_map_is_edited_and_never_written_over(spark, tmp_path):
    path, table = str(tmp_path / "map"), spark.read.parquet(f"{SF}/documents.parquet")
    first = sharding.shard(table, 24, map_path=path)
    assert {r["map_version"] for r in first.select("map_version").distinct().collect()} == {1}
    one = sharding.SlotMap.load(spark, path)
    grown = sharding.shard(table, 25, map_path=path).collect()
    two = sharding.SlotMap.load(spark, path)
    assert two.version == 2 and two.shards == 25 and {r["map_version"] for r in grown} == {2}
    assert sharding.SlotMap.load(spark, path, 1) == one and all(r["shard"] == two.shard_of[r["virtual_slot"]] for r in grown)
    with pytest.raises(Exception):
        one.save(spark, path)
    assert sharding.SlotMap.load(spark, path, 1) == one


def test_a_record_repeated_many_times_is_dealt_over_the_shards(spark):
    rows = [(None, "the same row", None)] * 3000 + [(i, f"text {i}", "x") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.shard(table, 24).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    load, held = Counter(), defaultdict(list)
    for r in out:
        load[r["shard"]] += r["size"]
        held[r["shard"]].append(r["slot"])
    assert max(load.values()) < 1.02 * min(load.values()) and all(sorted(v) == list(range(len(v))) for v in held.values())


def test_mixed_rows_of_one_id_and_size_are_chosen_alike(spark):
    rows = [(1, f"text number {chr(97 + i)}", "s") for i in range(20)] + [(None, f"text number {chr(97 + i)}", None) for i in range(9)]
    out = []
    for parts in (1, 5):
        table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        out.append(Counter((r["doc_id"], r["text"]) for r in mixing.mixed(table).collect()))
    assert out[0] == out[1] and sum(out[0].values()) > 0


def water(sizes, weights, total):
    """Targets by the words of the rule: share, stop, reshare."""
    target, open_, left = {}, set(sizes), total
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark):
    for table in (helpers.awkward(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        docs = table.collect()
        sizes = Counter()
        for r in docs:
            sizes[r["source"]] += len(helpers.WORD.findall(r["text"] or ""))
        order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        want = water(dict(sizes), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
        rows = mixing.mix(table).collect()
        again = mixing.mix(table.repartition(7)).collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
        assert len(rows) == len(docs)
        source = {r["doc_id"]: r["source"] for r in docs}
        taken, most = Counter(), Counter()
        for r in rows:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
            assert r["taken"] <= 2 * r["size"]
            taken[s] += r["taken"]
            most[s] = max(most[s], r["size"])
        assert all(abs(taken[s] - want[s]) <= most[s] + 1 for s in sizes)
        copies = Counter()
        for r in rows:
            copies[r["doc_id"]] += r["copies"]
        assert Counter(r["doc_id"] for r in mixing.mixed(table).collect()) == +copies
    assert mixing.mix(helpers.empty(spark)).count() == 0


def test_mixing_a_source_of_one_size(spark):
    table = spark.range(3000).selectExpr("id AS doc_id", "'same words in all' AS text", "IF(id < 1000, 'x', 'y') AS source")
    rows = mixing.mix(table).collect()
    total = Counter()
    for r in rows:
        total["x" if r["doc_id"] < 1000 else "y"] += r["taken"]
    assert abs(total["x"] - 8000) <= 4 and abs(total["y"] - 10000) <= 4


def test_quality_rules(spark):
    for table in (helpers.awkward(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        want = Counter((r["doc_id"], *helpers.base_statistics(r["text"])) for r in table.collect())
        rows = quality_rules.apply_rules(table).collect()
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert r["kept"] == (not r["base_failed"] and not r["broken"])
    assert quality_rules.apply_rules(helpers.empty(spark)).count() == 0
