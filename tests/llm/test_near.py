"""Fingerprints, near-duplicates and vectors against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from matrel.llm import embeddings, fingerprints, minhash
from matrel.llm.components import components

SMALL = "/root/testdata/sf0.001"


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text, k=5):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= k:
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return frozenset([tuple(words)] if words else [])


def brute(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return {d: (len(s), root[d], root[d] == d) for d, s in sets.items()}


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(1000, k) for k in range(500, 700)]
    root = roots({x for e in links for x in e}, links)
    df = spark.createDataFrame(links + [(None, 3), (7, None)], "a long, b long")
    got = {r["id"]: r["component_id"] for r in components(df).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in links)}
    assert components(df.limit(0)).count() == 0


def test_few_links_need_no_shuffle(spark, monkeypatch):
    """Before, each round over however few links was several shuffles."""
    from matrel.llm import components as module

    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (80, 85), (85, 90)], "a long, b long")
    few = components(df)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, 0) for i in range(41)) + [(80, 80), (85, 80), (90, 80)]
    assert sorted(map(tuple, few.collect())) == want
    monkeypatch.setattr(module, "HELD", 2)
    many = components(df)
    assert "Exchange" in many._jdf.queryExecution().executedPlan().toString() and sorted(map(tuple, many.collect())) == want


def test_blocks_of_a_band(spark, monkeypatch):
    """A component that fills several blocks: only its links to others are looked for, and all of these are found."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    base = [f"w{k}" for k in range(60)]
    texts = {k: " ".join([*base, f"x{k}"]) for k in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    sketched = minhash.sketches(docs, key="id")
    regs = {r["id"]: np.frombuffer(r["regs"], np.uint16) for r in sketched.collect()}
    keys = minhash.band_keys(np.stack([regs[k] for k in range(12)]))
    band = next(t for t in range(minhash.BANDS) if len(set(keys[:, t].tolist())) == 1)
    own = {k: 0 if k < 7 else 7 if k < 10 else k for k in range(12)}
    members = sketched.join(docs, "id").join(spark.createDataFrame(list(own.items()), "id long, component_id long"), "id")
    members = members.selectExpr(f"{int(keys[0, band])} AS key", "id", "component_id", "n_shingles", "regs", "text")
    found = minhash._block_links(members, 5, 75).collect()
    earlier = {(a, b) for a, b in combinations(range(12), 2) if (keys[a, :band] == keys[b, :band]).any()}
    open_ = {(a, b) for a, b in combinations(range(12), 2) if own[a] != own[b]} - earlier
    assert all(own[r["a"]] != own[r["b"]] and tuple(sorted((r["a"], r["b"]))) in open_ for r in found)
    assert roots(range(12), [*own.items(), *[(r["a"], r["b"]) for r in found]]) == roots(range(12), [*own.items(), *open_])


def test_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.op3_minhash_near_dedup(spark, SMALL).collect()}
    assert got == brute(texts)


@pytest.fixture(scope="module")
def planted():
    """Chains and groups about the threshold, short texts, copies, and lures that share half."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts, n = {}, 0
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([1, 3, 5, 8, 20, 60, 200]))]
        for _ in range(rnd.randint(1, 12)):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 30))):
                own[rnd.randrange(len(own))] = word()
            texts[n] = " ".join(own) if rnd.random() < 0.8 else "  ".join(own).upper()
            n += 1
    common = [word() for _ in range(80)]
    for _ in range(40):
        texts[n] = " ".join(common + [word() for _ in range(60)])
        n += 1
    for t in ("", None, " \n", "One", "one", "one two", "é One", "É one", "x\x00y z", "one"):
        texts[n] = t
        n += 1
    return texts


def test_planted_groups(spark, planted):
    df = spark.createDataFrame([(d, t, "s") for d, t in planted.items()], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(planted)


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F")], "doc_id long, text string")
    rows = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(2)
    both = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    for share in (0.2, 0.5, 0.9):
        k = int(len(both) * share)
        a = np.concatenate([both[:k], both[k : k + (len(both) - k) // 2]])
        b = np.concatenate([both[:k], both[k + (len(both) - k) // 2 :]])
        regs = [minhash.registers(np.array([0, len(x)]), np.sort(x)) for x in (a, b)]
        found, used = minhash.estimate(regs[0], regs[1], np.array([len(a)]), np.array([len(b)]))
        assert used[0] == 128 and abs(found[0] - share) < 0.2


def vector_links(rows, t=0.93):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            return None
        v = np.array(v, float)
        v = v / (np.abs(v).max() or 1.0) if len(v) else v
        return v / np.linalg.norm(v) if v.any() else None

    units = [(i, label, unit(v)) for i, v, label in rows]
    links = [(a[0], b[0]) for a, b in combinations(units, 2) if a[1] is not None and a[1] == b[1] and a[2] is not None and b[2] is not None and len(a[2]) == len(b[2]) and a[2] @ b[2] >= t]
    root = roots([r[0] for r in rows], links)
    return {r[0]: (sum(r[0] in e for e in links), root[r[0]], root[r[0]] == r[0]) for r in rows}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for _ in range(30):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 40))):
            rows.append((n, [float(x) for x in (base + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25, 0.4])) * rng.uniform(0.1, 9)], int(rng.integers(0, 2))))
            n += 1
    for v in (None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-200] * 16, [1e200] * 16):
        rows.append((n, v, 0))
        n += 1
    rows.append((n, rows[0][1], None))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    assert got == vector_links(rows)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_all_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.op4_embedding_near_dedup(spark, SMALL).collect()}
    assert got == vector_links(rows)


def likeness(a, b):
    return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128


def simhash(text):
    """The definition: weighted hashes of adjacent words vote on 128 bits."""
    words = re.split("[\x20\x09-\x0d]+", text)
    terms = list(zip(words[:-1], words[1:], strict=True)) if len(words) > 1 else [(words[0], "")]
    votes, total = np.zeros(128, np.int64), 0
    for a, b in terms:
        a, b = a.encode(), b.encode()
        weight = min(4, 1 + (len(a) + len(b)) // 6)
        h0 = xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42))
        h1 = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), h0)
        votes += weight * np.array([h >> k & 1 for h in (h0, h1) for k in range(64)])
        total += weight
    f0, f1 = (sum(1 << k for k in range(64) if 2 * votes[64 * h + k] > total) for h in (0, 1))
    return f"{f0:016x}{f1:016x}"


def check_edits(rows, got):
    rows = sorted(rows)
    prints = {}
    for d, t in rows:
        prints.setdefault(t or "", got[d]["fingerprint"])
        assert prints[t or ""] == got[d]["fingerprint"]
    for k, (d, t) in enumerate(rows):
        t, (nd, nt) = t or "", rows[(k + 1) % len(rows)]
        q = len(t) // 4
        edited = t[: len(t) - q] + (nt or "")[:q]
        r = got[d]
        if k % 7 == 0 and len(t) < 20_000:
            assert (r["fingerprint"], r["edited_fingerprint"]) == (simhash(t), simhash(edited))
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if edited in prints:
            assert r["edited_fingerprint"] == prints[edited]
        assert r["near_edited"] == pytest.approx(likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(likeness(r["fingerprint"], got[nd]["fingerprint"]))


def test_fingerprints_of_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in fingerprints.op1_document_fingerprints(spark, SMALL).collect()}
    check_edits(rows, got)
    whole = {d: int(r["fingerprint"], 16) for d, r in got.items()}
    asked = {f for d, f in whole.items() if d % 50 == 0}
    assert all(got[d]["n_found"] == sum(1 <= (f ^ q).bit_count() <= 3 for q in asked) for d, f in whole.items())
    near = np.mean([r["near_edited"] for r in got.values()])
    other = np.mean([r["near_next"] for r in got.values()])
    assert near > 0.7 > 0.58 > other


@pytest.mark.parametrize("n", [1, 2, 40])
def test_fingerprints_of_odd_texts(spark, n):
    texts = ["", None, "a", "abcd", "é" * 9, "🙂x" * 10, " lead", "a b c d", "a b c d", "\n\n", "x " * 500]
    rows = [(7 * k - 20, texts[k % len(texts)]) for k in range(n)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string")
    check_edits(rows, {r["doc_id"]: r for r in fingerprints.edited_fingerprints(df).collect()})


def test_fingerprint_rows(spark):
    df = spark.createDataFrame([(None, "x y"), (1, "same"), (1, "same"), (1, "more")], "doc_id long, text string")
    rows = fingerprints.edited_fingerprints(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in rows) == [(0, 3), (1, 4), (1, 4), (1, 4)]
    assert [r["near_next"] for r in rows if r["doc_id"] is None] == [None]
    assert fingerprints.edited_fingerprints(df.limit(0)).count() == 0


def test_radius_search(spark):
    rnd = random.Random(9)
    prints = []
    for _ in range(20):
        x = rnd.getrandbits(128)
        prints += [x] * 2 + [x ^ sum(1 << b for b in rnd.sample(range(128), k)) for k in (1, 2, 3, 4, 5)]
    df = spark.createDataFrame([(f"{x:032x}",) for x in prints] + [(None,)], "fingerprint string")
    want = {(a, b, bin(a ^ b).count("1")) for a in prints for b in prints if a != b and bin(a ^ b).count("1") <= 3}
    got = [(int(r[0], 16), int(r[1], 16), r[2]) for r in fingerprints.within_radius(df, df, 3).collect()]
    assert set(got) == want and len(got) == len(want)
    assert fingerprints.within_radius(df.limit(0), df, 3).count() == fingerprints.within_radius(df, df.limit(0), 3).count() == 0


def test_counts_in_the_radius(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "QUERIES", 3)  # so that a block's queries stand in several lists
    rnd = random.Random(10)
    base = rnd.getrandbits(128)
    prints = [base ^ sum(1 << b for b in rnd.sample(range(128), rnd.randint(0, 4))) for _ in range(150)] + [0, (1 << 128) - 1, 1 << 127, 1 << 63]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1), "x") for x in prints] + [(None, 1, "x")], "f0 long, f1 long, n string")
    for radius in (1, 3):
        got = {(r["f0"] % (1 << 64)) << 64 | r["f1"] % (1 << 64): r["n"] for r in fingerprints.count_within(df.limit(60), df, radius).collect()}
        asked = set(prints[:60])
        want = {x: sum(1 <= (x ^ q).bit_count() <= radius for q in asked) for x in prints}
        assert got == {x: n for x, n in want.items() if n}
    assert fingerprints.count_within(df.limit(0), df, 3).count() == 0
