"""Line dedup: what recurs across unrelated documents goes, whatever copies there are."""

import random

from matrel.llm import lines


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def left(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["text"].split("\n") for r in lines.drop_recurring_lines(df).collect()}


def test_copies_of_one_document_dont_keep_a_template(spark):
    rnd = random.Random(5)
    line = "this site was made by volunteers for everyone"
    around = lambda: [words(rnd, 20), words(rnd, 20)]
    texts = ["\n".join([a, line, b]) for a, b in (around() for _ in range(20))]
    texts += [texts[0]] * 60  # copies
    refrain = words(rnd, 12)
    texts.append("\n".join([line, refrain] * 40))  # one text that repeats it
    own = [words(rnd, 25) for _ in range(8)]
    for k in range(30):  # edited copies: their own lines stay, whatever stands beside them
        edited = list(own)
        edited[k % 8] = words(rnd, 2) + edited[k % 8]
        texts.append("\n".join(edited))
    got = left(spark, texts)
    assert all(line not in x for x in got.values())
    assert all(len(got[k]) == 2 for k in range(80)) and got[80] == [refrain] * 40
    assert all("\n".join(got[k]) == texts[k] for k in range(81, len(texts)))


def test_inner_lines_of_a_passage_go(spark):
    rnd = random.Random(6)
    passage = [words(rnd, 8) for _ in range(4)]
    texts = ["\n".join([words(rnd, 40), *passage, words(rnd, 40)]) for _ in range(10)]
    texts += ["\n".join([*passage, words(rnd, 80)]) for _ in range(10)]
    got = left(spark, texts)
    assert all("\n".join(got[k]) == "\n".join(x for x in t.split("\n") if x not in passage) for k, t in enumerate(texts))


def test_fields_stay_variable_at_every_size(spark):
    rnd = random.Random(7)
    names, sites = ([words(rnd, 1) for _ in range(20)] for _ in range(2))
    line = "Shared with the {} on {} today by all of us here"
    texts = ["\n".join([words(rnd, 15), line.format(a, b)]) for a in names for b in sites]
    rare = "Shared with the people we know who like to read along"  # in the same leaf, and rare there
    texts += ["\n".join([words(rnd, 15), rare]) for _ in range(8)]
    got = left(spark, texts)
    assert all(len(x) == 1 for x in got.values())


def test_longer_lines_need_fewer_groups(spark):
    rnd = random.Random(8)
    short, ordinary, long, passage = (words(rnd, n) for n in (3, 12, 30, 60))
    two = words(rnd, 2)
    plan = [(two, 30), (short, 12), (words(rnd, 4), 9), (ordinary, 5), (words(rnd, 12), 4), (long, 3), (words(rnd, 30), 2), (passage, 2)]
    gone = {short, ordinary, long, passage}
    texts = [[words(rnd, 40)] for _ in range(40)]
    for line, n in plan:
        for k in rnd.sample(range(40), n):
            texts[k].append(line)
    texts = ["\n".join([*x, words(rnd, 40)]) for x in texts]
    own = words(rnd, 55)
    texts.append("\n".join([own, words(rnd, 70)]))
    texts += [texts[-1] + " x"] * 3 + [texts[-1] + " y z"]  # near copies share a passage and keep it
    got = left(spark, texts)
    assert all(got[k] == [x for x in t.split("\n") if x not in gone] for k, t in enumerate(texts))
