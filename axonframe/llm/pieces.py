"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one pass over each text.

At every position the automaton's output links give the pieces that end there, and they relax the best sum of scores
(Viterbi). The scores of a BPE model are merge ranks, whose best sum over all paths is not the model's encoding; for such
a model a piece relaxes a position only if the merges leave it whole after the last piece of the best path up to its
start, and the paths of such pairs are exactly the merges' results. Words with two blanks in a row, whose pieces tie in
score, are merged.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Words whose pieces a task remembers; the memory is emptied when full.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64


def read_model(path: str = MODEL) -> dict:
    """The pieces, scores and settings of a model file, as plain values that tasks get by broadcast. The driver reads it."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb2

    proto = pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or kind not in (1, 2):
        raise ValueError("only unigram and BPE models that leave characters and white space as they are")
    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    model = {
        "pieces": [sp.id_to_piece(i) for i in range(n)],
        "scores": [sp.get_score(i) for i in range(n)],
        "plain": plain,
        "bytes": {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)},
        "unk": sp.unk_id(),
        "bpe": kind == 2,
        "prefix": norm.add_dummy_prefix,
        "splits": {},
    }
    if model["bpe"]:
        coder, splits = PieceCoder(model), {}
        for p in coder.ids:
            if coder.merged(p, steps := []) == [p] and steps:
                splits[p] = steps[-1]
        later = [p for p, ab in splits.items() if BLANK * 2 not in p and any(x in splits and coder.score[x] < coder.score[p] for x in ab)]
        model |= {"splits": splits, "ordered": not later}
    return model


class _Known(dict):
    """What `make` gives for each key, remembered for short keys."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        got = self.make(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = got
        return got


class PieceCoder:
    """Encodes and decodes single texts; built from a model's plain values once in each worker (`coder_of`)."""

    def __init__(self, model: dict):
        self.model = model
        self.ids = {p: i for i, (p, ok) in enumerate(zip(model["pieces"], model["plain"], strict=True)) if ok}
        self.score = {p: model["scores"][i] for p, i in self.ids.items()}
        self.judged = 0
        self.nothing = (0, 0.0, -1, dict.fromkeys(self.ids.values(), True))  # stands before a word's first piece
        self.known = _Known(self.packed)
        self.ends: dict[str, list] = {}
        self.starts: dict[str, list] = {}
        inside = {c for p in self.ids for c in p}
        self.closed = all(c in self.ids for c in inside) and model.get("ordered", True)
        self.runs = re.compile("[%s]+|." % "".join(map(re.escape, sorted(inside & self.ids.keys()))), re.S)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if not model["bpe"] or len(p) == 1 or p in model["splits"]:
                self.automaton.add_word(p, (len(p), self.score[p], self.ids[p], {}))  # and what may follow it, as found
        self.automaton.make_automaton()
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            self.parts = re.compile(".+", re.S)
        else:  # no piece crosses the start of a run of blanks, or characters that stand side by side in none: there words end
            kinds = "|".join("[%s]+" % "".join(map(re.escape, sorted(kind))) for kind in self.kinds())
            self.parts = re.compile(f"{BLANK}*(?:{kinds}|[^{BLANK}])|{BLANK}+" if kinds else f"{BLANK}*[^{BLANK}]|{BLANK}+")
        self.raw = [p.replace(BLANK, " ").encode() if ok else b"" for p, ok in zip(model["pieces"], model["plain"], strict=True)]
        for b, i in model["bytes"].items():
            self.raw[i] = bytes([b])
        if model["unk"] >= 0:
            self.raw[model["unk"]] = " ⁇ ".encode()

    def kinds(self) -> list[set[str]]:
        """Sets of characters that stand side by side in some piece, also by way of others; blanks aside."""
        kind: dict[str, set[str]] = {}
        for p in self.ids:
            for x, y in zip(p, p[1:], strict=False):
                if x != BLANK and (a := kind.setdefault(x, {x})) is not (b := kind.setdefault(y, {y})):
                    a, b = sorted((a, b), key=len)
                    b |= a
                    kind.update(dict.fromkeys(a, b))
        return sorted({id(k): k for k in kind.values()}.values(), key=len, reverse=True)

    def merged(self, s: str, steps: list | None = None) -> list[str]:
        """The merges of a BPE model, best score first, leftmost of equals; for checks and for runs of blanks."""
        at: list[str | None] = list(s)
        left, right = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (v := self.score.get(at[i] + at[j])) is not None:
                heapq.heappush(heap, (-v, i, at[i], at[j]))

        for i in range(len(s) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or at[i] != a or at[j] != b:
                continue
            if steps is not None:
                steps.append((a, b))
            at[i], at[j], right[i] = a + b, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for x in at if x is not None]

    def named(self, parts: list[str]) -> list[int]:
        """Their ids; characters without a piece become bytes, or the unknown piece."""
        out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.model["bytes"]:
                out += [self.model["bytes"][b] for b in p.encode()]
            else:
                out.append(self.model["unk"])
        return out

    def word(self, s: str) -> list[int]:
        """The ids of one word."""
        if self.model["bpe"] and (BLANK * 2 in s or not self.closed):  # pieces of blanks tie in score, and then place decides
            return self.named(self.merged(s))
        best = self.whole if self.model["bpe"] else self.best
        runs = self.runs.findall(s)
        if len(runs) == 1 and len(s) > 1:
            return best(s)
        return [i for run in runs for i in (self.named([run]) if len(run) == 1 else best(run))]

    def best(self, s: str) -> list[int]:
        """Viterbi in one pass over characters that all have pieces: each piece that output links give at an end relaxes the
        best sum there. What precedes the start stands behind the end, at -1."""
        last: list = [None] * len(s) + [self.nothing]
        total = [-np.inf] * len(s) + [0.0]
        for end, found in self.automaton.iter(s):
            value = total[end - found[0]] + found[1]
            if value > total[end]:
                total[end], last[end] = value, found
        return self.path(last)

    def whole(self, s: str) -> list[int]:
        """The same for a BPE model, where a piece that may not follow the best path up to its start relaxes nothing. Only one
        piece may end at a place then, so no sums are compared."""
        last: list = [None] * len(s) + [self.nothing]
        for end, found in self.automaton.iter(s):
            if last[end] is None and (before := last[end - found[0]]) is not None:
                ok = before[3].get(found[2])
                if ok or ok is None and self.may_follow(before, found[2]):
                    last[end] = found
        return self.path(last)

    def path(self, last: list[tuple]) -> list[int]:
        out, at = [], len(last) - 2
        while at >= 0:
            found = last[at]
            out.append(found[2])
            at -= found[0]
        out.reverse()
        return out

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at the piece's end (side 1) or start (side 0) while it is merged: (part, rank of the next merge)."""
        found = [piece]
        while len(found[-1]) > 1:
            found.append(self.model["splits"][found[-1]][side])
        found.reverse()
        return [(x, -self.score[y]) for x, y in zip(found, found[1:], strict=False)] + [(piece, np.inf)]

    def may_follow(self, before: tuple, piece: int) -> bool:
        """Whether the merges of the pieces a + b end in a and b: no merge across the border comes before those on both
        sides. before: the automaton's entry of a, where this is noted; piece: the id of b."""
        if self.judged >= REMEMBERED:
            self.judged = 0
            for found in self.automaton.values():
                found[3].clear()
        a, b = self.model["pieces"][before[2]], self.model["pieces"][piece]
        xs = self.ends.get(a) or self.ends.setdefault(a, self.spine(a, 1))
        ys = self.starts.get(b) or self.starts.setdefault(b, self.spine(b, 0))
        i = j = 0
        ok = None
        while ok is None:
            (x, x_next), (y, y_next) = xs[i], ys[j]
            across = self.score.get(x + y)
            if across is not None and -across < x_next and -across <= y_next:
                ok = False
            elif x_next == y_next == np.inf:
                ok = True
            elif x_next <= y_next:
                i += 1
            else:
                j += 1
        before[3][piece] = ok
        self.judged += 1
        return ok

    def packed(self, s: str) -> bytes:
        """The ids of one word as 32-bit integers."""
        return array("i", self.word(s)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = (BLANK if self.model["prefix"] else "") + text.replace(" ", BLANK)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.parts.findall(text))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.model["prefix"] and text[:1] == " " else text


#: The model that this process has coded with last, and its coder.
_held: list = [None, None]


def coder_of(model: dict) -> PieceCoder:
    """The coder of a model, kept with the words that it remembers as long as Spark reuses the Python worker for tasks that
    code with the same model."""
    if _held[0] is not model:
        _held[:] = model, PieceCoder(model)
    return _held[1]


def encode_pieces(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, ids, n_pieces, n_byte_pieces, round_trip) for each row of docs, over whole texts.

    ids are the model's piece ids; round_trip says that they decode to the text. U+2581 stands for the
    blank in the pieces, so a text that holds it decodes to a blank there and round_trip is false. A null text
    has null ids, 0 pieces and a null round_trip; an empty text has no ids. Characters without a piece become
    byte pieces, or the unknown piece if the model has none. Repeated rows are encoded one by one; ids of
    rows may be null; other columns are not read.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(handed.value)
        is_byte = np.zeros(len(coder.raw), np.int64)
        is_byte[list(handed.value["bytes"].values())] = 1
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found, same = [], []
                for text in part["text"]:
                    t = text.as_py()
                    ids = None if t is None else coder.encode(t)
                    found.append(ids)
                    same.append(None if t is None else coder.decode(ids) == t)
                sizes = [0 if x is None else len(x) for x in found]
                lists = pa.ListArray.from_arrays(
                    pa.array([None if x is None else k for x, k in zip(found, np.cumsum([0, *sizes[:-1]]), strict=True)] + [sum(sizes)], pa.int32()),
                    pa.array(np.concatenate([np.zeros(0, np.int32), *[x for x in found if x is not None]])),
                )
                n_bytes = [0 if x is None else int(is_byte[x].sum()) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part["id"], lists, pa.array(sizes, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(same, pa.bool_())],
                    names=["id", "ids", "n_pieces", "n_byte_pieces", "round_trip"],
                )

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: dict, ids_column: str = "ids") -> DataFrame:
    """The rows of encoded with one more column, decoded: the text of the piece ids; null for null ids, ids outside of
    the model are left out, as are control pieces."""
    handed = encoded.sparkSession.sparkContext.broadcast(model)
    rows = encoded.select(F.struct("*").alias("row"), F.col(ids_column).alias("piece_ids"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(handed.value)
        n = len(coder.raw)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array([i for i in x if i is not None and 0 <= i < n], np.int64)) for x in batch["piece_ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], names=["row", "decoded"])

    return rows.mapInArrow(run, schema).select("row.*", "decoded")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_pieces(docs, read_model()).withColumnRenamed("id", "doc_id")
