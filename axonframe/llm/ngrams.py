"""LM scoring with an Elias-Fano bigram trie in shards.

Each task packs the words of many documents: tokens as places in the pack's own vocabulary. The vocabularies' hashes meet
by hash, which gives every word its count, a rank as its id, and a quantised probability. The packs then send each
(word before, word, document) to the shard of the word before; a word that comes very often is split over shards by the
word after. A shard's task makes its trie of the training bigrams in memory-mapped files: contexts, pointers and successors
as Elias-Fano sequences, probabilities in 8 bits. Successors are kept as sums along their level, so that the level never
falls; a lookup takes the context's pointers and then finds the successor from the value that its context starts at.
Probabilities are absolute discounts interpolated with the word's own:

    p(w | v) = max(c(v, w) - D, 0) / c(v) + D * kinds(v) / c(v) * p(w)        p(w) = (c(w) - D + D * V / (V + 1)) / N

Words not in training are one unknown word. A split context is scored by the same formula: the words that follow it are
counted over all its parts first, and each part gets the number.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

DISCOUNT = 0.75
#: Tokens of a pack, of a shard, and of one context before it is split.
PACK = 1_500_000
SHARD = 700_000
HOT = 250_000
#: Parts that the words are dealt into by their hash's first bits when a context is split.
PARTS = 4096
_START, _UNKNOWN = np.uint64(1), np.uint64(0)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: log10 of the least probability that 16 bits hold.
_LEAST = -12.0


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 in as few bytes as the largest needs, byte by byte plane, compressed."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 256 ** int(k[2]))
        planes = np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(len(a), int(kind[2])).T
        out.append(int(kind[2]).to_bytes(1, "little") + len(a).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes())
    return zstandard.compress(b"".join(out), 1)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(blob), 0, []
    while at < len(data):
        size, n = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        planes = np.frombuffer(data, np.uint8, size * n, at + 9).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{size}").astype(np.uint64))
        at += 9 + size * n
    return out


def _mapped(a: np.ndarray) -> np.ndarray:
    """The array in a file of the task's own folder, mapped into memory; the file goes with the mapping."""
    if not len(a):
        return a
    with tempfile.TemporaryFile() as f:
        f.write(np.ascontiguousarray(a).tobytes())
        f.flush()
        return np.memmap(f, a.dtype, "r", shape=a.shape)


_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
_NTH = np.full((256, 8), 8, np.int64)
for _i in range(256):
    for _k, _b in enumerate([b for b in range(8) if _i >> b & 1]):
        _NTH[_i, _k] = _b


class EliasFano:
    """A sequence of numbers that never falls: low bits packed, high bits in unary; 2 + log2(universe / n) bits a number."""

    def __init__(self, values: np.ndarray):
        v = values.astype(np.uint64)
        self.n = n = len(v)
        self.top = top = int(v[-1]) if n else 0
        self.l = max(0, (top // max(n, 1)).bit_length() - 1)
        low = (v & np.uint64((1 << self.l) - 1)).astype(np.uint64)
        high = (v >> np.uint64(self.l)).astype(np.int64)
        bits = np.zeros(n + (high[-1] if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        unary = np.packbits(bits, bitorder="little")
        if self.l:
            flat = (low[:, None] >> np.arange(self.l, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            self.low = _mapped(np.concatenate([np.packbits(flat.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)]))
        self.unary = _mapped(unary)
        ones = _ONES[unary]
        self.rank1 = _mapped(np.cumsum(np.concatenate([[0], ones])))
        self.rank0 = _mapped(np.cumsum(np.concatenate([[0], 8 - ones])))

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros of the unary bits."""
        rank = self.rank1 if one else self.rank0
        byte = np.searchsorted(rank, k, side="right") - 1
        cell = self.unary[byte] if one else ~self.unary[byte]
        return byte * 8 + _NTH[cell, k - rank[byte]]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        word = np.zeros(len(i), np.uint64)
        for b in range((self.l + 14) // 8):
            word |= self.low[byte + b].astype(np.uint64) << np.uint64(8 * b)
        return word >> shift & np.uint64((1 << self.l) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return high << np.uint64(self.l) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the place of the first number that is at least x (n if there is none)."""
        x = x.astype(np.uint64)
        out = np.full(len(x), self.n, np.int64)
        here = np.flatnonzero(x <= np.uint64(self.top)) if self.n else np.zeros(0, np.int64)
        high = (x[here] >> np.uint64(self.l)).astype(np.int64)
        start = np.zeros(len(here), np.int64)
        later = high > 0
        start[later] = self._select(high[later] - 1, False) - (high[later] - 1)
        stop = self._select(high, False) - high  # numbers whose high part is not above
        low = x[here] & np.uint64((1 << self.l) - 1)
        while True:
            todo = np.flatnonzero(start < stop)
            if not len(todo):
                break
            mid = (start[todo] + stop[todo]) >> 1
            less = self._low(mid) < low[todo]
            start[todo[less]] = mid[less] + 1
            stop[todo[~less]] = mid[~less]
        out[here] = start
        return out


class BigramTrie:
    """Contexts, their pointers and successors, with quantised discounted probabilities; all levels memory-mapped."""

    def __init__(self, v: np.ndarray, w: np.ndarray, count: np.ndarray, total: np.ndarray, whole: dict[int, int] | None = None):
        """Bigrams sorted by v and w, with counts; total is the count of each bigram's context, whole the number of words after
        the contexts that are split."""
        new = np.diff(v, prepend=v[:1] + np.uint64(1)) != 0
        first = np.flatnonzero(new)
        edges = np.append(first, len(v))
        self.contexts = EliasFano(v[first])
        self.pointers = EliasFano(edges)
        last = w[edges[1:] - 1] if len(first) else w
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last, dtype=np.uint64)])[: len(first)]
        self.successors = EliasFano(np.repeat(base, np.diff(edges)) + w if len(first) else w)
        logs = np.log10(np.maximum(count - DISCOUNT, 1e-9) / total)
        self.steps = np.quantile(logs, np.linspace(0, 1, 256)) if len(logs) else np.zeros(256)
        self.codes = _mapped(np.searchsorted((self.steps[1:] + self.steps[:-1]) / 2, logs).astype(np.uint8))
        kinds = np.diff(edges)
        if whole:
            kinds = np.array([whole.get(int(c), k) for c, k in zip(v[first], kinds, strict=True)])
        self.back = _mapped((DISCOUNT * kinds / total[first]).astype(np.float32))

    def probability(self, v: np.ndarray, w: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """p(w | v); contexts and words that training has not seen leave the unigram."""
        out = unigram.copy()
        if not self.contexts.n or not len(v):
            return out
        c = self.contexts.successor(v)
        known = np.flatnonzero(c < self.contexts.n)
        known = known[self.contexts.access(c[known]) == v[known]]
        c = c[known]
        begin, end = self.pointers.access(c).astype(np.int64), self.pointers.access(c + 1).astype(np.int64)
        base = np.zeros(len(c), np.uint64)
        inner = begin > 0
        base[inner] = self.successors.access(begin[inner] - 1)
        target = base + w[known]
        at = self.successors.successor(target)
        hit = np.flatnonzero((at < end) & (at >= begin) & (w[known] > 0))
        hit = hit[self.successors.access(at[hit]) == target[hit]]
        p = unigram[known] * self.back[c]
        p[hit] += 10.0 ** self.steps[self.codes[at[hit]]]
        out[known] = p
        return out


class _Local(dict):
    """Places of words in a pack's vocabulary, in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


_END = b"\n"  # no word holds a line feed: the end of a text


def _packs(docs: DataFrame, shards: int, id_column: str, text_column: str) -> DataFrame:
    """Rows of packs: (pack, shard, ids, blob). Shard -1 holds the tokens and ids, other shards the word hashes and counts."""
    held = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), held.alias("held"))
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("pack", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        local, tokens, ids, held_out, sizes, size = _Local(), [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{task}-{made}"
            names = list(local)
            hashes = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))
            flat = np.concatenate(tokens)
            train = np.repeat(~np.array(held_out), sizes)
            counts = np.bincount(flat[train], minlength=len(names))
            where = (hashes % np.uint64(shards)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            cut = np.searchsorted(where[order], np.arange(shards + 1))
            blobs = [_packed(flat, np.array(sizes), np.array(held_out, np.uint8), where)]
            blobs += [_packed(hashes[order[cut[s] : cut[s + 1]]], counts[order[cut[s] : cut[s + 1]]]) for s in range(shards)]
            id_type = ids[0].type if ids else pa.null()
            every = pa.concat_arrays([*ids]) if ids else pa.array([], id_type)
            lists = pa.ListArray.from_arrays(pa.array([0] + [len(every)] * (shards + 1), pa.int32()), every)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (shards + 1)), pa.array(range(-1, shards), pa.int32()), lists, pa.array(blobs, pa.binary())], names=["pack", "shard", "ids", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for text in part["text"].cast(pa.binary()):
                    found = text.as_py().translate(_LOWER).split()
                    found.append(_END)
                    tokens.append(np.fromiter(map(local.__getitem__, found), np.int64, len(found)))
                    sizes.append(len(found))
                    size += len(found)
                held_out += part["held"].to_pylist()
                ids.append(part["id"])
                if size >= PACK:
                    yield from flush()
                    made += 1
                    local, tokens, ids, held_out, sizes, size = _Local(), [], [], [], [], 0
        if sizes:
            yield from flush()

    return rows.mapInArrow(run, schema)


def _ranked_words(vocabularies: DataFrame, shards: int) -> DataFrame:
    """(pack, shard, blob): ids, counts and parts of a pack's words of a shard, in the order in which they were sent; pack null:
    the shard's words, tokens and the largest count."""
    schema = "pack string, shard int, blob binary"

    def count(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        sent = [_unpacked(x) for x in group["blob"].to_pylist()]
        every, back = np.unique(np.concatenate([h for h, _ in sent]), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([c for _, c in sent]).astype(float), minlength=len(every)).astype(np.uint64)
        rank = np.empty(len(every), np.uint64)
        rank[np.lexsort((every, -total.astype(np.int64)))] = np.arange(len(every), dtype=np.uint64)
        ids = np.where(total > 0, rank * np.uint64(shards) + np.uint64(shard) + np.uint64(2), _UNKNOWN)
        sums = np.array([np.count_nonzero(total), total.sum(), total.max(initial=0)], np.uint64)
        ends = np.cumsum([0, *[len(h) for h, _ in sent]])
        blobs = [_packed(ids[back[a:b]], total[back[a:b]], every[back[a:b]] >> np.uint64(52)) for a, b in zip(ends, ends[1:], strict=False)]
        names = group["pack"].to_pylist()
        return pa.table({"pack": pa.array([*names, None]), "shard": pa.array([shard] * (len(names) + 1), pa.int32()), "blob": pa.array([*blobs, _packed(sums)], pa.binary())})

    return vocabularies.select("pack", "shard", "blob").groupBy("shard").applyInArrow(count, schema)


def _unigram(count: np.ndarray, n: float, v: float) -> np.ndarray:
    return (np.maximum(count - DISCOUNT, 0) + DISCOUNT * v / (v + 1)) / max(n, 1)


def _shard(before: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    return ((before * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)) % np.uint64(shards)


def _splits(total: np.ndarray) -> np.ndarray:
    """Into how many parts a context is split by its count."""
    return np.where(total > HOT, 2 ** np.ceil(np.log2(np.maximum(total, 1) / HOT)), 1).clip(1, PARTS)


def _sent(packs: DataFrame, words: DataFrame, word_shards: int, shards: int, n: int, v: int, texts: int, split_only: bool = False) -> DataFrame:
    """(shard, pack, kind, blob): what packs send to shards. Kind 0: word before and its part (in one number), word, document,
    count and whether it is for training, quantised probability of the word, total of the word before, its parts; kind 1:
    the documents' own figures, to any shard. With split_only instead, as kind 2, each training word after a split context
    once: word before and part, word, total."""
    by_pack = words.groupBy("pack").agg(F.collect_list(F.struct("shard", "blob")).alias("found"))
    both = packs.join(by_pack, "pack").select("pack", "blob", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch["pack"][k].as_py()
                flat, sizes, held, where = (x.astype(np.int64) for x in _unpacked(batch["blob"][k].as_py()))
                ids, counts, part = np.zeros(len(where), np.uint64), np.zeros(len(where)), np.zeros(len(where), np.int64)
                order = np.argsort(where, kind="stable")
                cut = np.searchsorted(where[order], np.arange(word_shards + 1))
                for found in batch["found"][k].as_py():
                    s = found["shard"]
                    got = _unpacked(found["blob"])
                    ids[order[cut[s] : cut[s + 1]]], counts[order[cut[s] : cut[s + 1]]], part[order[cut[s] : cut[s + 1]]] = got[0], got[1], got[2]
                part[counts == 0] = 0  # the unknown word belongs to the first part
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                base = np.log10((counts + 1) / (n + v + 1))
                figures = _packed(sizes, np.add.reduceat((counts > 0)[flat].astype(np.int64), starts), held, np.add.reduceat(base[flat], starts).view(np.uint64))
                log = np.log10(np.maximum(_unigram(counts, n, v), 10**_LEAST))
                code = np.round(log / _LEAST * 65535).astype(np.uint64)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                w, before = ids[flat], np.empty(len(flat), np.uint64)
                before[1:], before[starts] = w[:-1], _START
                total = np.empty(len(flat))
                total[1:], total[starts] = counts[flat][:-1], texts
                if split_only:
                    hot = np.flatnonzero((total > HOT) & (w > 0) & (held[doc] == 0))
                    hot = hot[np.lexsort((w[hot], before[hot]))]
                    hot = hot[np.flatnonzero((np.diff(before[hot], prepend=np.uint64(0)) != 0) | (np.diff(w[hot], prepend=np.uint64(0)) != 0))]
                    own_part = np.floor(part[flat[hot]] * _splits(total[hot]) / PARTS)
                    to = _shard(before[hot], own_part, shards)
                    out = [(int(s), 2, _packed(before[i] * np.uint64(PARTS) + own_part[to == s].astype(np.uint64), w[i], total[i].astype(np.uint64))) for s in np.unique(to) for i in [hot[to == s]]]
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([name] * len(out), pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["shard", "pack", "kind", "blob"])
                    continue
                keep = np.lexsort((doc, w, before))
                same = np.ones(len(keep), bool)
                same[1:] = (np.diff(before[keep]) != 0) | (np.diff(w[keep]) != 0) | (np.diff(doc[keep]) != 0)
                first = np.flatnonzero(same)
                times = np.diff(np.append(first, len(keep)))
                at = keep[first]
                splits = _splits(total[at])
                own_part = np.floor(part[flat[at]] * splits / PARTS)
                to = _shard(before[at], own_part, shards)
                lot = np.argsort(to, kind="stable")
                ends = np.searchsorted(to[lot], np.arange(shards + 1))
                out = []
                for s in range(shards):
                    here = lot[ends[s] : ends[s + 1]]
                    if len(here):
                        i = at[here]
                        context = before[i] * np.uint64(PARTS) + own_part[here].astype(np.uint64)
                        again = np.argsort(context, kind="stable")
                        here, i, context = here[again], i[again], context[again]
                        out.append((s, 0, _packed(np.diff(context, prepend=np.uint64(0)), w[i], doc[i], times[here] * 2 + (held[doc[i]] == 0), code[flat[i]], total[i])))
                out.append((int(np.uint64(xxhash.xxh64_intdigest(name)) % np.uint64(shards)), 1, figures))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([name] * len(out)), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["shard", "pack", "kind", "blob"])

    return both.mapInArrow(run, "shard int, pack string, kind int, blob binary")


def _split_kinds(sent: DataFrame, shards: int) -> DataFrame:
    """(shard, pack, kind, blob), kind 3: for each part of a split context, the number of words that follow the context, all its parts
    together. Parts are counted in their own shards, so that no task holds a context."""

    def count(group: pa.Table) -> pa.Table:
        got = [_unpacked(x) for x in group["blob"].to_pylist()]
        context, word, total = (np.concatenate([g[i] for g in got]) for i in range(3))
        order = np.lexsort((word, context))
        context, word, total = context[order], word[order], total[order]
        new = np.flatnonzero((np.diff(context, prepend=np.uint64(0)) != 0) | (np.diff(word, prepend=np.uint64(0)) != 0) | (np.arange(len(context)) == 0))
        first = new[np.flatnonzero(np.diff(context[new], prepend=np.uint64(0)) != 0)] if len(new) else new
        kinds = np.diff(np.append(np.searchsorted(context[new], context[first]), len(new)))
        return pa.table({"before": pa.array((context[first] // np.uint64(PARTS)).astype(np.int64)), "total": pa.array(total[first].astype(np.int64)), "kinds": pa.array(kinds, pa.int64())})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, total, kinds = (batch[c].to_numpy() for c in ("before", "total", "kinds"))
            splits = _splits(total.astype(float)).astype(np.int64)
            row = np.repeat(np.arange(len(splits)), splits)
            part = np.arange(len(row)) - np.repeat(np.cumsum(splits) - splits, splits)
            context = before[row].astype(np.uint64) * np.uint64(PARTS) + part.astype(np.uint64)
            to = _shard(before[row].astype(np.uint64), part, shards)
            blobs = [_packed(context[i : i + 1], kinds[row[i : i + 1]].astype(np.uint64)) for i in range(len(row))]
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.nulls(len(row), pa.string()), pa.array([3] * len(row), pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "pack", "kind", "blob"])

    parts = sent.groupBy("shard").applyInArrow(count, "before long, total long, kinds long")
    return parts.groupBy("before", "total").agg(F.sum("kinds").alias("kinds")).mapInArrow(dealt, "shard int, pack string, kind int, blob binary")


def _scored(sent: DataFrame) -> DataFrame:
    """(pack, kind, blob): the shard's part of each document's score, and the documents' figures as they came."""

    def score(group: pa.Table) -> pa.Table:
        kinds, names, blobs = group["kind"].to_pylist(), group["pack"].to_pylist(), group["blob"].to_pylist()
        mine = [k for k, x in enumerate(kinds) if x == 0]
        out = [(names[k], 1, blobs[k]) for k, x in enumerate(kinds) if x == 1]
        if mine:
            got = [_unpacked(blobs[k]) for k in mine]
            context = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
            word, times, code, total = (np.concatenate([g[i] for g in got]) for i in (1, 3, 4, 5))
            whole = {int(c): int(k) for x, y in zip(kinds, blobs, strict=True) if x == 3 for c, k in zip(*_unpacked(y), strict=True)}
            ends = np.cumsum([0, *[len(g[0]) for g in got]])
            del got
            train = np.flatnonzero((times & np.uint64(1)) > 0)
            times = (times >> np.uint64(1)).astype(np.int64)
            order = train[np.lexsort((word[train], context[train]))]
            c, w = context[order], word[order]
            first = np.flatnonzero((np.diff(c, prepend=np.uint64(0)) != 0) | (np.diff(w, prepend=np.uint64(0)) != 0) | (np.arange(len(c)) == 0))
            count = np.add.reduceat(times[order], first) if len(first) else np.zeros(0, np.int64)
            at = order[first]
            trie = BigramTrie(context[at], word[at], count, total[at].astype(float), whole)
            unigram = 10.0 ** (code.astype(float) / 65535 * _LEAST)
            log = np.empty(len(word))
            for a in range(0, len(word), 200_000):
                b = a + 200_000
                log[a:b] = np.log10(np.maximum(trie.probability(context[a:b], word[a:b], unigram[a:b]), 1e-300))
            for k, a, b in zip(mine, ends, ends[1:], strict=False):
                doc = _unpacked(blobs[k])[2].astype(np.int64)
                each = np.bincount(doc, weights=log[a:b] * times[a:b])
                some = np.flatnonzero(each)
                out.append((names[k], 0, _packed(some, each[some].view(np.uint64))))
        return pa.table({"pack": pa.array([o[0] for o in out], pa.string()), "kind": pa.array([o[1] for o in out], pa.int32()), "blob": pa.array([o[2] for o in out], pa.binary())})

    return sent.groupBy("shard").applyInArrow(score, "pack string, kind int, blob binary")


def _summed(parts: DataFrame) -> DataFrame:
    schema = "pack string, ix int, n_tokens long, n_known long, held_out boolean, base_score double, score double"

    def add(group: pa.Table) -> pa.Table:
        kinds, blobs = group["kind"].to_pylist(), group["blob"].to_pylist()
        sizes, known, held, base = _unpacked(next(b for b, k in zip(blobs, kinds, strict=True) if k == 1))
        score = np.zeros(len(sizes))
        for blob, kind in zip(blobs, kinds, strict=True):
            if kind == 0:
                doc, value = _unpacked(blob)
                score[doc.astype(np.int64)] += value.view(np.float64)
        n = len(sizes)
        return pa.table({"pack": pa.array([group["pack"][0].as_py()] * n), "ix": pa.array(range(n), pa.int32()), "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "held_out": pa.array(held > 0), "base_score": pa.array(base.view(np.float64)), "score": pa.array(score)})

    return parts.groupBy("pack").applyInArrow(add, schema)


def scored_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs, over whole texts.

    Learns from the rows whose crc32(id) mod 7 is not 2. Tokens are the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then
    one end. base_score is the add-one unigram's log10 probability, score the bigram model's. Null and empty texts
    hold the end alone; null ids count as empty ones; repeated rows are scored one by one and learned from as often as they
    come; an empty table gives no rows; without training rows all words are unknown. Other columns are not read.
    """
    spark = docs.sparkSession
    word_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = saved(_packs(docs, word_shards, id_column, text_column))
    words = saved(_ranked_words(packs.where("shard >= 0"), word_shards))
    sums = [_unpacked(r["blob"])[0].astype(int) for r in words.where("pack is null").select("blob").toLocalIterator()]  # one row a shard, three numbers
    v, n, top = (f(s[i] for s in sums) if sums else 0 for i, f in enumerate((sum, sum, max)))
    v, n, top = int(v), int(n), int(top)
    held = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    texts = docs.where(~held).count()
    shards = max(word_shards, n // SHARD + 1)
    given = packs.where("shard = -1"), words.where("pack is not null"), word_shards, shards, n, v, texts
    sent = _sent(*given)
    if max(top, texts) > HOT:
        sent = sent.union(_split_kinds(_sent(*given, split_only=True), shards))
    found = _summed(_scored(sent))
    ids = packs.where("shard = -1").select("pack", F.posexplode("ids").alias("ix", "id"))
    out = ids.join(found, ["pack", "ix"])
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored_texts(docs).withColumnRenamed("id", "doc_id")
