"""Line dedup, toxicity and quality against brute force and on held-out rows; the pipeline by its stages."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from matrel.llm import lines, minhash, quality, toxicity
from matrel.llm._labels import held_out, training_rows

SMALL = "/root/testdata/sf0.01"


def words_of(line):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)) if w]


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts, alike=lines.ALIKE):
    """Connected components of the texts that resemble each other: from each text to the first of its own."""
    texts = sorted({t for t in texts if t})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for k, own in enumerate(sets):
        for other, common in Counter(j for x in own for j in at[x]).items():
            if common >= alike * (len(own) + len(sets[other]) - common):
                root[find(k)] = find(other)
        for x in own:
            at[x].append(k)
    return {t: texts[find(k)] for k, t in enumerate(texts)}


def brute_lines(docs, least, group):
    """The definition, with strings: what each document loses."""
    seen, kinds = [], defaultdict(set)
    for d, text in docs:
        for k, line in enumerate(text.split("\n") if text else []):
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in words_of(line))
            if len(tokens) >= lines.TOKENS:
                seen.append((d, k, tokens))
                kinds[tokens].add(group[text])
    leaf = lambda tokens: (len(tokens), *tokens[: lines.DEPTH])
    need = lambda tokens: lines.needed(len(tokens), least)
    size, count = Counter(), Counter()
    for tokens, groups in kinds.items():
        size[leaf(tokens)] += len(groups)
        for p, t in enumerate(tokens):
            count[leaf(tokens), p, t] += len(groups) if t != "<*>" else 0
    templates, stands = defaultdict(set), defaultdict(set)
    for tokens, groups in kinds.items():
        for share in lines.SHARES:
            fixed = tuple((p, t) for p, t in enumerate(tokens) if (n := count[leaf(tokens), p, t]) >= need(tokens) and n >= share * size[leaf(tokens)])
            if len(fixed) >= lines.CONSTANT * len(tokens):
                templates[tokens].add((leaf(tokens), fixed))
                stands[leaf(tokens), fixed] |= groups
    out = defaultdict(set)
    for d, k, tokens in seen:
        if any(len(stands[t]) >= need(tokens) for t in templates[tokens]):
            out[d].add(k)
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for k in range(60):
        body = [" ".join(word() for _ in range(rnd.randint(3, 30))) for _ in range(rnd.randint(1, 6))]
        if k % 3 == 0:
            body.insert(rnd.randint(0, len(body)), f"Ticket {k} was opened by user{k} on 2024-01-{k:02d} today")
        if k % 4 == 0:
            body.insert(rnd.randint(0, len(body)), passage)
        if k % 5 == 0:
            body.append("All rights are reserved here")
        texts.append("\n".join(body))
    texts += [texts[1]] * 12  # copies of one document stay as they are
    texts += ["", None, "\n\n", "All rights are reserved here", "one\r\ntwo"]
    return list(enumerate(texts))


@pytest.mark.parametrize("most", [lines.KINDS, 0])
def test_lines_as_defined(spark, corpus, monkeypatch, most):
    monkeypatch.setattr(lines, "KINDS", most)  # 0: by the join
    want = brute_lines(corpus, lines.LEAST, brute_groups(t for _, t in corpus))
    assert len(want) > 20
    df = spark.createDataFrame([(d, t, "x") for d, t in corpus], "doc_id long, text string, n_lines string")
    rows = lines.drop_recurring_lines(df).collect()
    assert len(rows) == len(corpus)
    texts = dict(corpus)
    for r in rows:
        t = texts[r["doc_id"]]
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[r["doc_id"]])
        assert r["text"] == kept
        assert r["n_dropped"] == len(want[r["doc_id"]])
    assert all(not want[d] for d, t in corpus if t == texts[1])


def own_groups(spark, docs):
    """The operator's copy groups, by text."""
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lines._rows(df, "text", "doc_id")
    group = {r["mark"]: r["group"] for r in lines.copy_groups(rows).collect()}
    return {r["text"]: group.get(r["mark"], r["mark"]) for r in rows.collect()}


def test_all_lines(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute_lines(docs, lines.LEAST, own_groups(spark, docs))
    got = {r["doc_id"]: r for r in lines.op2_line_dedup(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        assert got[d]["n_dropped"] == len(want[d]), d
        assert got[d]["n_chars"] == len("\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]))


def test_copy_groups_of_all_texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    own = own_groups(spark, docs)
    near, far = (brute_groups((t for _, t in docs), x) for x in (0.65, 0.35))
    assert all(own[t] == own[first] for t, first in near.items())  # surely alike: one group
    held = defaultdict(set)
    for t, first in far.items():
        held[own[t]].add(first)
    assert all(len(x) == 1 for x in held.values())  # one group: alike at least so much


def test_lines_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "x"), (1, "x"), (1, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in lines.drop_recurring_lines(df).collect()) == [("1", "None"), ("1", "x"), ("1", "x"), ("None", "a b c d e")]
    assert lines.drop_recurring_lines(df.limit(0)).count() == 0


def brute_segments(scores):
    """Maximal scoring segments by definition: the best segment, then the same left and right of it."""
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best[0] + 1e-12:
                best = (s, i, j)
    s, i, j = best
    if s <= 0:
        return []
    left = brute_segments(scores[:i])
    right = [(a + j, b + j, x) for a, b, x in brute_segments(scores[j:])]
    return [*left, (i, j, s), *right]


def test_segments_as_defined():
    rnd = random.Random(8)
    for _ in range(300):
        scores = [rnd.choice([-3.0, -1.0, -0.5, 1.25, 2.0]) + rnd.random() * 0.01 for _ in range(rnd.randint(0, 14))]
        got = toxicity.segments(np.array(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)], scores
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in got)


def test_segments_in_one_pass():
    for scores in (np.where(np.arange(64_000) % 2 == 0, 1.0, -2.0), np.random.default_rng(1).normal(-0.05, 1, 64_000)):
        took = []
        for n in (16_000, 64_000):
            began = time.process_time()
            toxicity.segments(scores[:n])
            took.append(time.process_time() - began)
        assert took[1] < 10 * max(took[0], 0.005)  # four times the words; a scan that looks back takes sixteen times as long


def accuracy(spark, query, label):
    rows = query(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").select("predicted", label, "score").collect()
    return np.array([(r[0], r[1], r[2]) for r in rows])


def test_toxicity_on_held_out_rows(spark):
    x = accuracy(spark, toxicity.op5_toxicity, "toxic")
    assert len(x) > 40 and (x[:, 0] == x[:, 1]).mean() > 0.9
    bad, clean = x[x[:, 1] == 1, 2], x[x[:, 1] == 0, 2]
    assert (bad[:, None] > clean[None, :]).mean() > 0.75


def test_quality_on_held_out_rows(spark):
    x = accuracy(spark, quality.op8_quality, "quality")
    assert len(x) > 40 and (x[:, 0] == x[:, 1]).mean() > 0.95


def test_held_out_rows_are_never_learned(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "string(id) AS text")
    labels = spark.range(200).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    used = {int(r["text"]) for r in training_rows(docs, labels, "toxic").collect()}
    assert used == {k for k in range(200) if zlib.crc32(str(k).encode()) % 5}
    marked = {r["doc_id"] for r in docs.where(held_out(docs["doc_id"])).collect()}
    assert marked == set(range(200)) - used
    assert training_rows(docs, labels, "toxic", most=7).count() == 7


def test_passages_are_found(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(600):
        body = [word() for _ in range(40)]
        if k % 4 == 0:
            body[10:10] = ["vilely", "zounds"]
        rows.append((k, " ".join(body), int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    text = "some peaceful words here, then vilely, zounds! and peace again"
    odd = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "peace"), (None, text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(odd, model).collect()}
    span = got[1]["spans"][0]
    assert text.encode()[span["start"] : span["stop"]] == b"vilely, zounds"
    assert got[1]["score"] > 0.5 > max(got[k]["score"] for k in (2, 3, 4))
    assert got[None]["score"] == got[1]["score"] and got[3]["spans"] == []
    kept = toxicity.keep_clean(odd.withColumn("score", odd["doc_id"]), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == 3
    none = toxicity.fit(df.drop("toxic").limit(0), df.drop("text").limit(0))
    assert toxicity.score(odd, none).where("score < 0.5").count() == 5


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.random((800, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.6) & (x[:, 5] < 0.5) | (x[:, 8] > 0.9)).astype(float)
    model = quality.fit_rules(x, y)
    assert model.rules and ((model.chance(x) > 0.5) == y).mean() > 0.93
    df = spark.createDataFrame([[float(v) for v in row] for row in x[:50]], ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = [r[0] for r in df.select(model.column()).collect()]
    assert np.allclose(sorted(got), sorted(model.chance(x[:50])))
    one = quality.fit_rules(x, np.ones(len(x)))
    assert one.chance(x[:2]).min() > 0.9


def test_statistics_of_odd_texts(spark):
    got = quality.text_statistics(pa.array(["", None, "a a a b", "!!!", "É é\nx"]))
    names = quality.STATISTICS
    assert not got[:2].any()
    assert got[2][names.index("repeat")] == 0.5 and got[2][names.index("distinct")] == 0.5 and got[2][names.index("top_word")] == 0.75
    assert got[3][names.index("exclaim")] == 1.0
    df = spark.createDataFrame([(1, None), (None, "x"), (1, None)], "doc_id long, text string")
    model = quality.fit_rules(np.zeros((0, len(names))), np.zeros(0))
    assert quality.score(df, model).count() == 3 and quality.score(df.limit(0), model).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == columns
            kept[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        else:
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(kept["minhash_near_dedup"])
        docs = out
    toxic = {r["doc_id"] for r in toxicity.op5_toxicity(spark, SMALL).where("predicted = 1").collect()}
    everything = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert set(kept["toxicity"]) == everything - toxic
    assert set(kept["quality"]) < set(kept["toxicity"])
    assert set(kept["line_dedup"]) == set(kept["quality"])
    before = sorted(kept["quality"].items())
    want = brute_lines(before, lines.LEAST, own_groups(spark, before))
    for d, t in kept["quality"].items():
        assert kept["line_dedup"][d] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d])
    before = spark.createDataFrame(sorted(kept["line_dedup"].items()), "doc_id long, text string")
    first = {r["component_id"] for r in minhash.near_duplicates(before).collect()}
    assert set(kept["minhash_near_dedup"]) == first


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
        docs = out if k < 3 else docs
