"""What line dedup writes on its way, and that lines which share half of a name are kept apart."""

import random

import pytest
from pyspark.sql import functions as F

from axonframe.llm import lines


@pytest.mark.parametrize("names", [None, 3])
def test_only_shared_keys_are_written(spark, monkeypatch, names):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(60)) + str(k) for k in range(200)]
    texts += [t[:-1] + "#" for t in texts[:6]] + texts[:3]
    df = spark.createDataFrame([(t,) for t in texts], "line string").cache()
    if names:  # first hashes of three values: nearly all lines share theirs
        monkeypatch.setattr(lines, "_named", lambda x: x.withColumn("h1", F.pmod(F.xxhash64("line"), F.lit(names))).withColumn("h2", F.xxhash64(F.lit(1), "line")))
    written, saved = [], lines.saved
    monkeypatch.setattr(lines, "saved", lambda x, keep=False: [t := saved(x, keep), written.append(t.count())][0])
    got = lines._named(df).join(lines.fuzzy_components(df), ["h1", "h2"]).select("line", "component").distinct().collect()
    if not names:
        assert max(written) < 200  # all keys would be 2,000 and more
    s = {t: {t[i : i + 8] for i in range(len(t) - 7)} for t in texts}
    near = {t: {u for u in s if 100 * len(s[t] & s[u]) >= 80 * len(s[t] | s[u])} for t in s}
    of = {r.line: r.component for r in got}
    assert of.keys() == {t for t in s if len(near[t]) > 1} and len(of) == 12
    assert all((of[t] == of[u]) == (u in near[t]) for t in of for u in of)


def sets_of(texts):
    return {t: {t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in texts}


def test_lines_apart_are_not_compared_letter_by_letter(spark, monkeypatch):
    """Lines that share keys but are far apart: only near ones have their texts compared, and no sets are written for the others."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    common = word(90)
    texts = [common + word(110) for _ in range(60)]  # similarities of 0.3
    texts += [t[:-1] + "#" for t in texts[:5]]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    compared, hashes, saved = [], [], lines.saved

    def watched(x, keep=False):
        t = saved(x, keep)
        if {"a", "b", "i"} <= set(t.columns):
            compared.append(t.count())
        if "s" in t.columns:
            hashes.append(t.where("size(s) > 0").count())
        return t

    monkeypatch.setattr(lines, "saved", watched)
    got = lines._named(df).join(lines.fuzzy_components(df), ["h1", "h2"]).select("line", "component").collect()
    of = {r.line: r.component for r in got}
    assert of.keys() == set(texts[:5] + texts[60:]) and all(of[a] == of[b] for a, b in zip(texts, texts[60:])) and len(set(of.values())) == 5
    assert 5 <= sum(compared) <= 10 and not any(hashes), (compared, hashes)


@pytest.mark.parametrize("length", [30, 300, 1500, 3000])
def test_no_link_fails_the_parities(spark, length):
    """All pairs of lines, with repeated parts and characters of four bytes: what is near is alike, and the numbers are those of distinct shingles."""
    rng = random.Random(length)
    texts = set()
    for k in range(12):
        base = "".join(rng.choice(["ab", "abcdefgh ij", "aé\U0001f600z"][k % 3]) for _ in range(length))
        for e in range(4):
            cut = list(base)
            for _ in range(rng.randint(0, e * (1 + length // 80))):
                cut[rng.randrange(len(cut))] = rng.choice("xyz")
            texts.add("".join(cut) + base[: rng.randint(0, length // 6)])
    s = sets_of(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sorted(texts))], "id long, line string")
    marks = lines._marked(df).cache()
    names = sorted(texts)
    assert {r.id: r.n for r in marks.collect()} == {i: len(s[t]) for i, t in enumerate(names)}
    alike = {(r.a, r.b) for r in lines._sided(marks, "a").crossJoin(lines._sided(marks, "b")).where("a < b").where(lines._alike(80)).collect()}
    near = {(i, j) for j in range(len(names)) for i in range(j) if 100 * len(s[names[i]] & s[names[j]]) >= 80 * len(s[names[i]] | s[names[j]])}
    assert near and near <= alike


def test_long_lines_in_buckets_that_stay_apart(spark, monkeypatch):
    """Lines of far more shingles than parities have bits, in several components of a bucket, against brute force."""
    monkeypatch.setattr(lines, "WORDS", 2)
    monkeypatch.setattr(lines, "BLOCK", 4)
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghijkl mnop") for _ in range(600))
    texts = set()
    for _ in range(40):
        cut = list(base)
        for _ in range(rng.randint(2, 18)):
            cut[rng.randrange(600)] = rng.choice("XYZ")
        texts.add("".join(cut))
    s = sets_of(texts)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in texts:
        for b in texts:
            if 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                root[find(a)] = find(b)
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    got = lines._named(df).join(lines.fuzzy_components(df), ["h1", "h2"], "left").select("line", "component").collect()
    of = {r.line: r.line if r.component is None else r.component for r in got}
    assert all((of[a] == of[b]) == (find(a) == find(b)) for a in texts for b in texts)
