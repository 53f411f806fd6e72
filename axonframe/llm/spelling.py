"""Spelling variants: words at one edit from each other, found on bit-sliced position indexes.

An index holds words as columns of bits: for each position and letter the set of words with that letter there. A word runs
over an index once, letter by letter, and keeps four sets of index words, each as one row of bits: those that agree so far,
and those with one replaced, one inserted or one deleted letter so far, which read the position at hand, the next and the
one before. All words of the index move on at once, 64 in a machine word.

Two words at one edit share the first half of the shorter one's letters or its other half at the end, so a vocabulary of any
size is dealt by halves: words meet in buckets of bounded size, and a bucket's words run over the bucket's index. Halves that
very many words share are cut into blocks that meet in pairs. Only a word's number of near words and its best one leave a
bucket, so pairs are never written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, scratch

#: Words of this many code points and occurrences at least make the vocabulary; a form has so many times the word's occurrences.
LEAST_LETTERS, LEAST_TIMES, FORM_TIMES = 6, 5, 5
#: Every so many runs (by hash) lose a letter.
SLIP = 199
#: Rows of a bucket on average, and words of a block of a half that more share.
BUCKET, BLOCK = 2048, 4096
#: Distinct words that a task counts before it passes its counts on.
_REMEMBERED = 200_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)


def slipped_runs(key: object, text: bytes | None) -> Iterator[tuple[str, int]]:
    """(word, times): how often to count each run of LEAST_LETTERS code points or more of a text, where a run whose CRC-32 with
    the document's id is divisible by SLIP counts without one of its letters."""
    runs = _RUN.findall((text or b"").translate(_LOWER).decode())
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    yield from Counter(runs).items()
    for run in runs:
        h = zlib.crc32(run.encode(), start)
        if not h % SLIP:
            at = h % len(run)
            yield run, -1
            if len(run) > LEAST_LETTERS:
                yield run[:at] + run[at + 1 :], 1


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): the words of whole texts with LEAST_TIMES occurrences or more, after the slips of `slipped_runs`."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def passed(counts: Counter) -> Iterator[pa.RecordBatch]:
        rows = [(w, n) for w, n in counts.items() if n]
        for at in range(0, len(rows), 20_000):
            words, n = zip(*rows[at : at + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                for word, times in slipped_runs(key, text.as_py()):
                    counts[word] += times
                if len(counts) > _REMEMBERED:
                    yield from passed(counts)
                    counts.clear()
        yield from passed(counts)

    counted = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


class PositionIndex:
    """For each position and letter the set of an index's words with that letter there, as rows of bits."""

    def __init__(self, words: list[str]) -> None:
        self.width = len(words) // 64 + 1
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
        self.keys, row = np.unique(place << 21 | letters, return_inverse=True)
        self.bits = np.zeros((len(self.keys) + 1, self.width), np.uint64)  # the last row is empty
        np.bitwise_or.at(self.bits, (row, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))
        self.sizes = {}
        for length in np.unique(size).tolist():
            full = np.zeros(self.width * 64, np.uint8)
            full[: len(size)] = size == length
            self.sizes[length] = np.packbits(full, bitorder="little").view(np.uint64)
        self.none = np.zeros(self.width, np.uint64)

    def at(self, place: int, letters: np.ndarray) -> np.ndarray:
        """A row of bits for each letter: the words that have it at this place."""
        key = (place << 21) + letters
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.bits[np.where((self.keys[row] == key) & (place >= 0), row, len(self.keys))]

    def one_edit(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places (of words, of the index) at exactly one edit; words are all of one length."""
        m = len(words[0])
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(-1, m)
        same = np.full((len(words), self.width), ~np.uint64(0))
        replaced, inserted, deleted = np.zeros_like(same), same.copy(), np.zeros_like(same)
        for i in range(m):
            here = self.at(i, letters[:, i])
            deleted = deleted & self.at(i - 1, letters[:, i]) | same
            replaced = replaced & here | same & ~here
            same = same & here
            inserted = inserted & self.at(i + 1, letters[:, i]) | same
        sized = lambda n: self.sizes.get(n, self.none)
        found = replaced & sized(m) | inserted & sized(m + 1) | deleted & sized(m - 1)
        query, column = np.nonzero(found)
        pair, bit = np.nonzero(np.unpackbits(found[query, column].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        return query[pair], column[pair] * 64 + bit


def _near_in_bucket(group: pa.Table) -> pa.Table:
    """For each querying word of a bucket with near words: word, n_near, best_n and best among those that count here."""
    words, times, short, side, q, i = (group[k].to_pylist() for k in ("word", "n", "short", "side", "qblock", "iblock"))
    asks, listed = (np.flatnonzero(group[k].to_numpy(zero_copy_only=False)) for k in ("asks", "listed"))
    best: dict[str, list] = {}
    if len(asks) and len(listed):
        index = PositionIndex([words[k] for k in listed])
        size = np.fromiter((len(words[k]) for k in asks), np.int64, len(asks))
        for m in np.unique(size).tolist():
            of_size = asks[size == m]
            step = max(1, 32_768 // index.width)
            for at in range(0, len(of_size), step):
                part = of_size[at : at + step]
                for a, b in zip(*index.one_edit([words[k] for k in part]), strict=True):
                    a, b = part[a], listed[b]
                    x, y, s = words[a], words[b], short[a]
                    half = s // 2
                    if (s, side[a], q[a], i[a]) != (short[b], side[b], q[b], i[b]) or min(len(x), len(y)) != s:
                        continue
                    if (x[:half] == y[:half]) if side[a] == 0 else (x[half - s :] == y[half - s :] and x[:half] != y[:half]):
                        now = best.setdefault(x, [0, 0, ""])
                        now[0] += 1
                        if (-times[b], y) < (-now[1], now[2]) or now[0] == 1:
                            now[1:] = times[b], y
    n, top, name = ([v[k] for v in best.values()] for k in range(3))
    return pa.table({"word": pa.array(list(best), pa.string()), "n_near": pa.array(n, pa.int64()), "best_n": pa.array(top, pa.int64()), "best": pa.array(name, pa.string())})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of each of the distinct words (word, n) that has words at one edit among them: how many, and
    the one with the largest n, the smallest in code-point order of those that tie. Words are read more than once."""
    short = F.explode(F.expr("array(length(word), length(word) - 1)")).alias("short")
    halves = words.select("word", "n", short).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    half = F.expr("if(side = 0, left(word, short div 2), right(word, short - short div 2))")
    halves = saved(halves.withColumn("half", half))
    key = ["short", "side", "half"]
    full = halves.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select(*key, F.ceil(F.col("c") / BLOCK).alias("blocks"))
    cut = halves.join(full, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("own", F.expr("pmod(xxhash64(word), blocks)"))
    met = F.expr("explode(array_distinct(flatten(transform(sequence(0L, blocks - 1), j -> array(struct(own as qblock, j as iblock), struct(j as qblock, own as iblock))))))")
    cut = cut.withColumn("met", met).select("*", "met.*").withColumn("asks", F.expr("qblock = own")).withColumn("listed", F.expr("iblock = own"))
    buckets = halves.count() // BUCKET + 1
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(*key, "qblock", "iblock"), F.lit(buckets)))
    dealt = dealt.select("bucket", "word", "n", "short", "side", "qblock", "iblock", "asks", "listed")
    near = dealt.groupBy("bucket").applyInArrow(_near_in_bucket, "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("m")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", (-F.col("m.n")).alias("best_n"), "m.best")


def rooted(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of rows (word, form): root is the end of the chain of forms, where each form occurs FORM_TIMES as often as
    the word before it at least and the most frequent one `most` times. Chains are halved in each round of joins."""
    up = forms.select("word", F.col("form").alias("root"))
    steps = 1
    while FORM_TIMES**steps <= most:
        steps += 1
    for _ in range(steps.bit_length()):
        up = saved(up)
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return up


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each word of the vocabulary of docs: word, form, root, n, n_near, form_n.

    A word's form is its near word (one edit away) of largest n, of ties the smallest in code-point order, if that n is
    FORM_TIMES the word's or more, else null; root follows forms to the last and is the word itself without one. Null and
    empty texts hold no words; a null id counts as the empty string; each repeated row counts. An empty table gives no rows.
    Other columns are not read."""
    with scratch(docs.sparkSession):
        words = saved(vocabulary(docs, id_column, text_column))
        near = saved(words.join(near_words(words), "word", "left"))
        formed = F.col("best_n") >= FORM_TIMES * F.col("n")
        near = near.select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n"))
        most = words.agg(F.max("n")).first()[0] or 1
        roots = rooted(near.where("form is not null"), most)
        found = near.join(roots, "word", "left")
        return saved(found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), keep=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
with recursive crc as materialized (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{00C0}-\x{00FF}]+')) as run
  from documents),
long_runs as (select doc_id, run, count(*) as times from runs where len(run) >= 6 group by all),
coded as (
  select run, times, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
    lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end)) as bytes
  from long_runs),
hashed as (
  select run, times, xor(list_reduce(list_prepend(4294967295::bigint, bytes),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::bigint) as h
  from coded, crc),
slipped as (
  select times, case when h % 199 = 0 then substr(run, 1, (h % len(run))::bigint) || substr(run, (h % len(run))::bigint + 2) else run end as word
  from hashed),
vocabulary as (select word, sum(times)::bigint as n from slipped where len(word) >= 6 group by word having sum(times) >= 5),
holes as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as shorter, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as pattern
  from (select word, n, unnest(range(1, len(word) + 1)) as i from vocabulary)),
longer as (select distinct v.word as a, v.n as na, h.word as b, h.n as nb from holes h join vocabulary v on v.word = h.shorter),
pairs as (
  select x.word as a, y.word as b, y.n as nb from holes x join holes y on x.pattern = y.pattern and x.word <> y.word
  union all select a, b, nb from longer union all select b, a, na from longer),
best as (select a, count(*) as n_near, max(nb) as top from pairs group by a),
formed as (
  select a, min(b) as best from pairs join best using (a) where nb = top group by a),
words as (
  select word, n, coalesce(n_near, 0)::bigint as n_near, case when top >= 5 * n then best end as form, case when top >= 5 * n then top end as form_n
  from vocabulary left join best on best.a = word left join formed on formed.a = word),
chain as (
  select word, word as root, 0 as step from words
  union all select chain.word, words.form, step + 1 from chain join words on words.word = chain.root where words.form is not null)
select words.word, form, arg_max(root, step) as root, any_value(n) as n, any_value(n_near) as n_near, any_value(form_n)::bigint as form_n
from words join chain on chain.word = words.word group by words.word, form
"""
