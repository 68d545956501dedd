"""Token counts, BPE and packing against the tokenizers library and by their invariants."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from matrel.llm import _chunks, bpe, packing, token_counts

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  a  b", "x <|endoftext|> y", "a\n b \n", "a  　b  c", "日本語 text\t\tq", "don't  it's", "a" * 3000, "a b\x1cc \x85d", "é ́e ǅ İ ΣΑΣ ﬁ 🙂", "</w> <|startoftext|>B", "\x00 \x01a"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns with clashing names, a null key, repeated rows
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "no key", "x"), (3, ODD[3], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def library(path):
    return _chunks.library(path)


def test_counts_match_the_library(spark, docs):
    own = library(_chunks.default_path())
    got = token_counts.op10_token_counts(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(own.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((docs[r["doc_id"]] or "").encode()), n > 512)


def test_counts_of_odd_texts(odd):
    own = library(_chunks.default_path())
    got = token_counts.count_tokens(odd).collect()
    assert len(got) == len(ODD) + 2
    by_id = {r["doc_id"]: r["n_tokens"] for r in got}
    for k, t in enumerate(ODD):
        assert by_id[k] == len(own.encode(t or "", add_special_tokens=False).ids), t


def test_no_rows(odd):
    none = odd.limit(0)
    assert token_counts.count_tokens(none).count() == 0
    assert bpe.encode_decode(none).count() == 0
    assert packing.pack(none).count() == 0


def test_bpe_matches_the_library(spark, docs):
    own = bpe.word_bpe(bpe.default_path())._library
    for r in bpe.op6_bpe(spark, SMALL).collect():
        ids = own.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        text = own.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_odd_texts(odd):
    own = bpe.word_bpe(bpe.default_path())._library
    got = {r["doc_id"]: r for r in bpe.encode_decode(odd).collect()}
    for k, t in enumerate(ODD):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert got[k]["ids"] == ids, t
        assert got[k]["decoded"] == own.decode(ids, skip_special_tokens=False)


def test_backtracking_equals_the_merges():
    coder = bpe.word_bpe(bpe.default_path())
    rnd = random.Random(7)
    for _ in range(3000):
        word = "".join(rnd.choice(["th", "e", "in", "an", "a", "s", "t", "er", "re", "ing", "tion", "o", "l", "b", "x9", "ö"]) for _ in range(rnd.randint(1, 12)))
        symbols = "".join(coder._alphabet[b] for b in word.encode())
        assert coder.core.encode_word(symbols) == [coder.core.ids[t] for t in coder.core.merge(symbols + coder.core.MARK)]


def test_proven_tokens_are_their_own_ids():
    path = _chunks.default_path()
    own, table = library(path), _chunks.proven(path)
    assert len(table) > 40_000
    for text, i in list(table.items())[::97]:
        assert own.encode(text, add_special_tokens=False).ids == [i]


def test_a_vocabulary_that_merges_dont_reach(tmp_path):
    with open(_chunks.default_path()) as f:
        made = json.load(f)
    size = len(made["model"]["vocab"])
    made["model"]["vocab"] |= {"qzxqzx": size + 100, "\u0120qzxqzx": size + 101}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    (tmp_path / "other.tiktoken").write_text("")
    assert "qzxqzx" not in _chunks.proven(str(path)) and _chunks.ranks(str(path)) is None
    text = "qzxqzx and qzxqzx, it's qzxqzx"
    assert _chunks.Encoder(str(path)).count(text) == len(library(str(path)).encode(text, add_special_tokens=False).ids)


def test_pieces():
    assert packing.piece_lengths(1024) == [1024]
    assert packing.piece_lengths(1025) == [1, 1024]
    assert packing.piece_lengths(2048) == [1024, 1024]


def test_packing(spark, docs):
    own = library(_chunks.default_path())
    rows = packing.op9_best_fit_packing(spark, SMALL).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    total = 0
    for d, pieces in by_doc.items():
        ids = np.array([*own.encode(docs[d] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        pieces.sort(key=lambda r: r["piece"])
        assert [r["length"] for r in pieces] == packing.piece_lengths(len(ids) // 4)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
        total += len(ids) // 4
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    least = -(-total // 1024)
    assert least <= len(by_sequence) <= 1.01 * least + 1


def test_packing_of_odd_texts(odd):
    rows = packing.pack(odd).collect()
    assert {r["doc_id"] for r in rows} == {*range(len(ODD)), None}
    assert sum(r["doc_id"] == 3 for r in rows) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def brute_bins(items, room):
    """The least number of bins, by trying everything."""
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= room:
                go(k + 1, [*bins[:b], bins[b] + items[k], *bins[b + 1 :]])
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best


def test_plan_is_the_least():
    rnd = random.Random(3)
    for k in range(300):
        low, high = [(1, 100), (20, 60), (25, 45)][k % 3]
        items = sorted((rnd.randint(low, high) for _ in range(10)), reverse=True)
        h = {s: items.count(s) for s in items}
        fillings = packing.plan(h, 100)
        assert {s: sum(f.count(s) * n for f, n in fillings) for s in h} == h
        assert all(sum(f) <= 100 for f, _ in fillings)
        least = brute_bins(items, 100)
        assert sum(n for _, n in fillings) == least >= packing.least_bins(h, 100)


def test_plan_of_many():
    rnd = random.Random(4)
    items = [min(1024, int(rnd.lognormvariate(4, 1.2)) + 1) for _ in range(20_000)]
    h = {s: items.count(s) for s in set(items)}
    fillings = packing.plan(h)
    assert {s: sum(f.count(s) * n for f, n in fillings) for s in h} == h
    assert sum(n for _, n in fillings) <= packing.least_bins(h) + 1
    assert packing.plan({}) == [] and packing.plan({7: 0}) == []
