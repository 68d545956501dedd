"""Texts longer than any of the corpus, and the folder of intermediate tables."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from matrel.llm import _io, fingerprints, lines, minhash, quality, toxicity


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_near_duplicates_of_long_texts(spark):
    rnd = random.Random(21)
    long = words(rnd, 40_000)
    near = list(long)
    for k in range(0, len(near), 60):  # five of sixty shingles: similarity about 0.85
        near[k] = "x"
    texts = [" ".join(long), " ".join(near), " ".join(words(rnd, 40_000)), " ".join(long[:3000])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got[0] == (39_996, 0) and got[1][1] == 0 and got[2][1] == 2 and got[3] == (2996, 3)


def test_scores_of_a_long_text(spark):
    rnd = random.Random(22)
    texts = [" ".join(words(rnd, 100_000)), None, "", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.statistics(df).collect()
    assert len(got) == 4 and {round(float(np.expm1(r["log_words"]))) for r in got} == {100_000, 0, 1}
    model = toxicity.Toxicity(np.zeros(0, np.uint64), np.zeros(0))
    assert toxicity.keep_clean(df, model).count() == 4
    hot = pa.array([" ".join(["fine"] * 50_000 + ["bad"] * 20 + ["fine"] * 50_000)])
    from matrel.llm import _words

    h = np.unique(_words.Words(*_words.string_buffer(pa.array(["bad"])), separator=_words.PUNCTUATED).hash)
    best, n, found, _ = toxicity._scored(toxicity.Toxicity(h, np.full(len(h), 2.0)), hot)
    assert n.tolist() == [100_020] and best[0] == pytest.approx(40) and [(a, b) for a, b, _ in found[0]] == [(50_000, 50_020)]


def test_fingerprint_of_a_long_text(spark):
    rnd = random.Random(23)
    long = words(rnd, 40_000)
    texts = [" ".join(long), " ".join(long[:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = (int(r["fingerprint"], 16) for r in fingerprints.edited_fingerprints(df).orderBy("doc_id").collect())
    assert (a ^ b).bit_count() <= 3


def test_lines_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(lines, "BITMAP", (1 << 15, 1 << 15))
    rnd = random.Random(24)
    notice = "this notice stands in all of these texts"
    texts = ["\n".join(x for k in range(8_000 if d == 0 else 3) for x in (" ".join(words(rnd, 4 + k % 3)), notice)) for d in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.drop_recurring_lines(df).collect()}
    assert got[0]["n_lines"] == 16_000 and got[0]["n_dropped"] == 8_000
    assert all(r["text"] == "\n".join(x for x in texts[d].split("\n") if x != notice) for d, r in got.items())


def session(master, folder=None, name="app"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=SimpleNamespace(master=master, applicationId=name))


def test_the_shared_folder():
    assert _io.shared_dir(session("yarn", "/shared/x/")) == "/shared/x"
    own = _io.shared_dir(session("local[4]", name="one"))
    assert own == _io.shared_dir(session("local[2]", name="one")) != _io.shared_dir(session("local", name="two"))
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            _io.shared_dir(session(master))


def test_tables_are_discarded(spark, tmp_path):
    held = dict(_io._tables)
    _io._tables.clear()
    out = _io.written(spark.range(5), "some")
    assert out.count() == 5
    assert _io.discard_tables(spark) == 1 and _io.discard_tables(spark) == 0
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(out.inputFiles()[0]).count()
    _io._tables.update(held)
