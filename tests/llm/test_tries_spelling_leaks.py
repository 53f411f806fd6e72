"""The conversation trie, spelling variants and decontamination against brute force, and on rough input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from axonframe.llm import leaks, spelling, tries

TURNS = "conv_id long, turn long, role string, text string"



# Tries ---------------------------------------------------------------------------------------------------------------


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], len((text or "").encode())


def brute_trie(turns):
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), *digest(role, text)))
    own = {c: [x[1:] for x in sorted(t)] for c, t in own.items()}
    members, ends = {}, {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + t[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    out = []
    for p, convs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        children = [q for q in under if len(q) == len(p) + 1]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under)]
        tokens = sum((len(members[q]) - 1) * q[-1][1] for q in under if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else -1, len(convs), len(children), len(leaves), tokens, sha))
    return sorted(out)


def trie_rows(spark, turns, shard_turns):
    found = tries.conversation_trie(spark.createDataFrame(turns, TURNS), shard_turns)
    columns = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in found.collect())


def conversations(seed, n, words, most=7):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"][: t % 2 + 1]), rng.choice(words)) for c in range(n) for t in range(rng.randint(0, most))]


@pytest.mark.parametrize("shard_turns", [5, 40, 100_000])
def test_trie_equals_brute_force_however_it_is_cut(spark, shard_turns):
    turns = conversations(1, 90, ["a", "b", "ü" * 30])
    turns += [(1000 + k, t, "user", "the same") for k in range(60) for t in range(3)]  # a path that very many share
    turns += [(5, 2, None, None), (6, None, "user", "first"), (6, None, "bot", "tied"), (6, None, "bot", "tied"), (None, 1, "user", "nobody's"), (-7, 1, "user", "a"), (-5, 1, "user", "b")]
    assert trie_rows(spark, turns, shard_turns) == brute_trie(turns)


def test_trie_of_long_conversations_and_of_nothing(spark):
    turns = [(c, t, "user", f"turn {t if t < 80 else t * c}") for c in (10, 11, 12, 15) for t in range(120)]
    assert trie_rows(spark, turns, 60) == brute_trie(turns)
    assert trie_rows(spark, [], 10) == []
    assert trie_rows(spark, [(None, 1, "user", "x")], 10) == []


def test_trie_spools_and_reads_back_blocks(spark, monkeypatch):
    monkeypatch.setattr(tries, "SPOOLED", 1000)
    monkeypatch.setattr(tries, "PIECE", 2)
    turns = conversations(3, 60, ["a", "b"], 5)
    walk, out = tries.Walk(0, None, None), []
    paths = {r["conv_id"]: bytes(r["path"]) for r in tries.rebuilt_paths(tries.conversation_paths(spark.createDataFrame(turns, TURNS))).collect()}
    for path, conv in sorted((p, c) for c, p in paths.items()):
        out += walk.add(path, conv)
    out += walk.end()
    found = sorted((r[5], r[6], -1 if r[11] is None else r[11], *r[7:11], r[12]) for r in out)
    assert found == brute_trie(turns)


# Spelling ------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    counts = {}
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n, len(near[w]), words[form[w]] if form[w] else 0))
    return sorted(out)


def variants(spark, docs):
    found = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in found.collect())


def misspelt(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdéñöst") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    docs = []
    for key in range(n):
        words = []
        for _ in range(150):
            w = rng.choice(stems[: rng.randint(1, 40)])
            if rng.random() < 0.1:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "z" + w[i + 1 :]])
            words.append(w.capitalize() if rng.random() < 0.1 else w)
        docs.append((key, " ".join(words)))
    return docs


def test_variants_equal_brute_force(spark, monkeypatch):
    docs = misspelt(7, 120)
    docs += [(None, "kindred " * 400 + "kindrad " * 60 + "kindrax " * 7), (3, None), (4, ""), (docs[0][0], docs[0][1]), (9, "q" * 3000 + "! " + ("q" * 2999 + " ") * 30 + ("q" * 3000 + " ") * 5)]
    expected = brute_variants(docs)
    assert len(expected) > 150 and any(x[1] for x in expected) and any(x[2] != x[0] and x[2] != x[1] for x in expected)
    assert variants(spark, docs) == expected
    monkeypatch.setattr(spelling, "BLOCK", 7)  # halves that more words share than a block holds
    monkeypatch.setattr(spelling, "BUCKET", 50)
    monkeypatch.setattr(spelling, "_REMEMBERED", 30)
    assert variants(spark, docs) == expected
    assert variants(spark, []) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=150, unique=True))
def test_position_index_finds_words_at_one_edit(words):
    index = spelling.PositionIndex(words)
    found = set()
    for m in {len(w) for w in words}:
        asks = [w for w in words if len(w) == m]
        found |= {(asks[a], words[b]) for a, b in zip(*index.one_edit(asks), strict=True)}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


# Leaks ---------------------------------------------------------------------------------------------------------------


def leak_split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_leaks(docs, items):
    windows = {}
    for item, text in items:
        w = leak_split(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, found = leak_split(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((-1 if key is None else key, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def leak_rows(spark, docs, items):
    found = leaks.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((-1 if r["id"] is None else r["id"], *[r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]) for r in found.collect())


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"wörd{k}" for k in range(12)] + ["the", "of", "x1"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    template = say(13)
    items = [(k, say(n)) for k, n in enumerate([1, 3, 7, 9, 10, 11, 25, 60, 200])] + [(20 + k, f"{template} {say(8)}") for k in range(30)]
    items += [(3, "another text of the item with number three goes on here for long"), (None, "words that belong to an item of no name stand here together"), (90, ""), (91, None), (92, "...!")]
    items += [(93, "again " * 40)]
    texts = dict(items)
    docs = []
    for k in range(120):
        parts = [say(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            w = (texts[rng.choice([4, 5, 6, 7, 8, 20, 33])] or "").split()
            i = rng.randrange(len(w))
            parts += [" ".join(w[i : i + rng.randint(5, 40)]).upper().replace("Ö", "ö"), say(rng.randint(0, 9))]
        docs.append((k, ", ".join(parts)))
    docs += [(200 + k, f"Start: {template}; end") for k in range(50)]  # what very many documents share
    docs += [(None, "words that belong to an item of no name stand here together"), (7, None), (8, ""), (9, "again " * 500), docs[3], docs[3], (11, texts[8] * 60)]
    expected = brute_leaks(docs, items)
    assert leak_rows(spark, docs, items) == expected
    long_items = [x for x in items if len(leak_split(x[1])) >= 10]
    assert leak_rows(spark, docs, long_items) == brute_leaks(docs, long_items)
    assert leak_rows(spark, docs, []) == brute_leaks(docs, [])
    assert leak_rows(spark, [], items) == []


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_BITS", 1 << 15)
    rng = random.Random(2)
    items = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(400))) for k in range(200)]
    docs = [(k, " ".join([f"w{rng.randrange(900)}" for _ in range(50)] + items[k % 200][1].split()[k : k + 8 + k % 9])) for k in range(200)]
    assert leak_rows(spark, docs, items) == brute_leaks(docs, items)


def test_a_shared_span_always_shares_its_fingerprint():
    rng = np.random.default_rng(1)
    span = rng.integers(0, 2**63, 10).astype(np.uint64)
    for _ in range(200):
        around = [rng.integers(0, 2**63, n).astype(np.uint64) for n in rng.integers(0, 30, 2)]
        prints = leaks.winnowed(np.concatenate([around[0], span, around[1]]), 10)
        assert prints[len(around[0])] == leaks.winnowed(span, 10)[0]


def test_rough_tables(spark, rough, empty):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs", "extra")], "item_id long, text string, doc_id string")
    found = leaks.contamination(rough, items)
    assert found.count() == rough.count() and {r["id"] for r in found.where("contaminated").collect()} == {1, 2}
    assert leaks.without_contaminated(rough, items).count() == rough.count() - 3
    assert leaks.contamination(empty, items).count() == 0
    assert spelling.spelling_variants(rough).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(empty).count() == 0
    turns = rough.selectExpr("doc_id as conv_id", "n as turn", "lang as role", "text", "id", "kept", "n", "row")
    expected = brute_trie([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    assert sorted(tuple(-1 if r[c] is None else r[c] for c in tries.conversation_trie(turns).columns) for r in tries.conversation_trie(turns).collect()) == expected
    assert tries.conversation_trie(turns.limit(0)).count() == 0
