"""What candidate searches find of planted pairs, and predictions against sums written out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.llm import language, lines, neardup, vectors


def shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


@pytest.mark.parametrize("length", [12, 20, 40, 100, 400])
def test_line_bands_meet(spark, length):
    """Of pairs of lines at a similarity of 0.8 to 0.88 nearly all share a band."""
    rng = random.Random(length)
    letters = "abcdefghijklmnopqrstuvwxyz     éü"
    pairs = []
    while len(pairs) < 150:
        a = "".join(rng.choice(letters) for _ in range(length))
        b = list(a) + [rng.choice(letters) for _ in range(rng.randint(0, 1 + length // 12))]
        for _ in range(rng.randint(0, 1 + length // 80)):
            b[rng.randrange(len(b))] = rng.choice(letters)
        b = "".join(b)
        x, y = shingles(a), shingles(b)
        if a != b and 0.8 <= len(x & y) / len(x | y) <= 0.88:
            pairs.append((a, b))
    df = spark.createDataFrame([(i, s, line) for i, p in enumerate(pairs) for s, line in enumerate(p)], "i int, s int, line string")
    keys = lines._banded(df.select("line").distinct())
    named = lines._named(df).select("i", "s", "h1", "h2").join(keys, ["h1", "h2"])
    met = named.groupBy("i", "key").agg(F.count_distinct("s").alias("n")).where("n = 2").select("i").distinct().count()
    assert met >= 149, met


def test_line_components_of_near_lines(spark):
    """The operator links what exact comparison of all pairs links."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ij") for _ in range(rng.randint(5, 90))) for _ in range(60)]
    rows = []
    for i in range(240):
        line = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            line.insert(rng.randrange(len(line) + 1), rng.choice("abcxyz"))
        rows.append((i, "".join(line)))
    df = spark.createDataFrame(rows, "id int, line string").where(F.btrim("line") != "")
    got = {(r.h1, r.h2): r.component for r in lines.fuzzy_components(df.select("line").distinct()).collect()}
    name = {r.line: (r.h1, r.h2) for r in lines._named(df.select("line").distinct()).collect()}
    group = {}
    texts = sorted(name)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = shingles(a), shingles(b)
            if 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    for t in texts:
        group.setdefault(find(t), set()).add(got.get(name[t], name[t]))
    assert all(len(g) == 1 for g in group.values()) and len({next(iter(g)) for g in group.values()}) == len(group)


@pytest.mark.parametrize("words", [9, 14, 24, 70, 300, 3000])
def test_document_bands_meet(words):
    """Of pairs of documents at a similarity of 0.85 to 0.9 nearly all share a band, and no estimate drops one."""
    rng = random.Random(words)
    known = neardup._WordHash()
    met = kept = total = 0
    while total < 200:
        a = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        b = a + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, max(1, words // 6)))]
        if rng.random() < 0.5 and words > 60:
            b[rng.randrange(len(b))] = "changed"
        x, y = (neardup.shingle_set(" ".join(w).encode(), known) for w in (a, b))
        union = len(np.union1d(x, y))
        if len(x) == len(y) == union or not 0.85 <= (len(x) + len(y) - union) / union <= 0.9 + 1 / words:
            if words < 24 and rng.random() < 0.001:
                break
            continue
        total += 1
        sketches = np.stack([neardup.registers(x), neardup.registers(y)])
        keys = neardup.band_keys(sketches)
        met += bool((keys[0] == keys[1]).any())
        same, used = ((sketches[0] == sketches[1]) & (sketches[0] > 0)).sum(), ((sketches[0] > 0) | (sketches[1] > 0)).sum()
        kept += bool(neardup.may_link(np.array([same]), np.array([used]), np.array([len(x)]), np.array([len(y)]), 85)[0])
    assert met == total and kept == total, (met, kept, total)


def test_vectors_at_the_border(spark):
    """Cosines just above and below the least one, by exact construction."""
    rows = []
    for k, c in enumerate([0.9301, 0.93 + 1e-9, 0.93 - 1e-9, 0.9299]):
        rows += [(2 * k, [1.0, 0.0, 0.0], k), (2 * k + 1, [c, (1 - c * c) ** 0.5, 0.0], k)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: r.n_links for r in vectors.near_vectors(df).collect()}
    assert [got[2 * k] for k in range(4)] == [1, 1, 0, 0] and [got[2 * k + 1] for k in range(4)] == [1, 1, 0, 0]


def test_language_against_sums_written_out(spark):
    """TF-IDF cosines to all centroids in plain loops give the operator's language and score."""
    rng = random.Random(1)
    kinds = {"aa": "lorem ipsum dolor sit amet consectetur", "bb": "the quick brown fox jumps over", "cc": "über straße groß müde läuft schön"}
    docs = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(rng.randint(1, 60))), k) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(150))]
    docs += [(500, "Q7! the THE", "bb"), (501, "é", "cc"), (502, "a", "aa")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.fit_language_model(df)
    got = {r.id: r for r in language.identify(df, model).collect()}
    for key, text, _ in docs:
        data = [b + 32 if 65 <= b <= 90 else 32 if b and b < 128 and not chr(b).isalpha() else b for b in text.encode()]
        counts = np.zeros(language.BUCKETS)
        for i in range(len(data)):
            p = data[i : i + 3]
            if len(p) < 2 or p[:2] == [32, 32]:
                continue
            counts[(((p[0] << 8 | p[1]) * 2654435761) % 2**32) >> 20] += 1
            if len(p) == 3 and p[1:] != [32, 32]:
                counts[((((p[0] << 16 | p[1] << 8 | p[2]) + 0x9E3779B9) * 2246822519) % 2**32) >> 20] += 1
        weighed = np.log1p(counts) * model["idf"]
        weighed = weighed / max(np.sqrt((weighed**2).sum()), 1e-12)
        cosines = [float(weighed @ c) for c in model["centroids"]]
        assert got[key].score == pytest.approx(max(cosines), abs=1e-5), (key, text)
        assert got[key].lang_pred in {model["langs"][i] for i, c in enumerate(cosines) if c > max(cosines) - 1e-5}
