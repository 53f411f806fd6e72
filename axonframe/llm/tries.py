"""Conversation prefix trie, by a skeleton of range-partition splitters.

A conversation becomes a path: for each turn the first 128 bits of a SHA-256 of role and text, and the text's length. Texts
are never shuffled. Paths are dealt by range into shards, between splitters drawn from a sample; conversations of equal paths
are cut by their ids, so a path that a third of all conversations share is no single task's. The splitters are broadcast. A
node that lies in several shards is a prefix of a splitter: these nodes are the skeleton, whose size is bounded. Each shard,
sorted, is walked once with one stack: nodes off the skeleton are finished there, and for nodes on it the walk gives
partial counts, which are added up over shards; what depends on the sums is then added up along the skeleton.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, scratch

#: Every conversation c starts with the first crc32(c) % HEADS turns of conversation c - c % FAMILY.
FAMILY, HEADS = 5, 9
#: Bytes of a turn in a path: a hash of role and text, and the text's length.
TURN = 20
#: Turns of a shard on average, most shards, and most bytes of all splitters; splitters are cut at a turn to fit in.
SHARD_TURNS, MOST_SHARDS, SPLITTER_BYTES = 100_000, 16_384, 8_000_000
#: Rows of the sample for each splitter.
SAMPLED = 32
#: Conversation ids that one piece of a node's list holds.
PIECE = 5_000
#: Bytes of finished nodes that a walk keeps in memory before it spools them to a file.
SPOOLED = 32_000_000
_EMPTY = hashlib.sha256(b"").digest()
#: A finished node in the spool: conversation, depth, members, children, leaves, saved tokens, ends.
_NODE = "<qqqqqq32s"
_NODE_SIZE = struct.calcsize(_NODE)


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path), one row for each conversation of (conv_id, turn, role, text): its turns in order of turn, null first, and
    of their hashes where turns tie. Null roles and texts are empty; rows without a conv_id are left out."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN - 8)
    item = F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    items = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("t"))
    return items.select("conv_id", F.unhex(F.array_join(F.col("t.item"), "")).alias("path"))


def rebuilt_paths(paths: DataFrame) -> DataFrame:
    """(conv_id, path) where each conversation c has the first h turns of conversation c - c % FAMILY (none if that is absent) in
    place of its own first h turns, h = crc32(c) % HEADS."""
    head = F.expr(f"int(crc32(string(conv_id)) % {HEADS}) * {TURN}").alias("head")
    own = paths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), head, "path")
    firsts = paths.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("first"), F.expr(f"substring(path, 1, {HEADS * TURN})").alias("start"))
    joined = own.join(firsts, "first", "left")
    return joined.select("conv_id", F.expr("concat(coalesce(substring(start, 1, head), X''), substring(path, head + 1))").alias("path"))


def splitters_of(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> list[tuple[bytes, int]]:
    """Sorted (path, conv_id) that cut the paths into shards of about so many turns, from a sample of bounded size."""
    n, size = paths.agg(F.count("*"), F.sum(F.length("path"))).first()
    shards = min(MOST_SHARDS, (size or 0) // (TURN * shard_turns) + 1)
    if shards < 2:
        return []
    deep = max(1, SPLITTER_BYTES // (TURN * shards)) * TURN
    sample = paths.where(F.expr(f"pmod(xxhash64(conv_id, 7), {n}L) < {SAMPLED * shards}L")).select(F.expr(f"substring(path, 1, {deep})").alias("path"), "conv_id")
    ranked = sample.repartition(1).sortWithinPartitions("path", "conv_id").select("*", (F.monotonically_increasing_id() % SAMPLED).alias("k"))
    return sorted({(bytes(r["path"]), r["conv_id"]) for r in ranked.where("k = 0").collect()})[1:]


def _common(a: bytes, b: bytes) -> int:
    """Bytes of the turns that two paths share from the start."""
    most = min(len(a), len(b)) // TURN
    if a[: most * TURN] == b[: most * TURN]:
        return most * TURN
    low = 0
    while most - low > 1:
        mid = (low + most) // 2
        low, most = (mid, most) if a[: mid * TURN] == b[: mid * TURN] else (low, mid)
    return low * TURN


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.sha256(path[: depth * TURN]).digest()[:16]


class _Open:
    """A node on the path at hand: what has been added up below it in this shard."""

    __slots__ = ("depth", "size", "least", "members", "children", "leaves", "saved", "ends", "piece", "pieces", "bone", "key", "up")

    def __init__(self, depth: int, size: int, bone: bool) -> None:
        self.depth, self.size, self.bone, self.key, self.up = depth, size, bone, b"", []
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.piece, self.pieces = None, [], 0


class Walk:
    """One pass over a sorted shard between two splitters. Rows (kind, shard, ...) come out in the order of FIELDS."""

    def __init__(self, shard: int, low: bytes | None, high: bytes | None) -> None:
        self.shard, self.low, self.high = shard, low, high
        self.stack: list[_Open] = []
        self.last = b""
        self.spool, self.done = SpooledTemporaryFile(max_size=SPOOLED), 0  # noqa: SIM115

    def bones(self, path: bytes) -> int:
        """Depth to which the nodes of a path lie on a splitter next to this shard; -1 if there is none."""
        return max([-1, *(_common(path, s) // TURN for s in (self.low, self.high) if s is not None)])

    def add(self, path: bytes, conv: int) -> Iterator[tuple]:
        if not self.stack or path != self.last:
            keep = _common(path, self.last) // TURN + 1 if self.stack else 0
            while len(self.stack) > keep:
                yield from self.close()
            bones = self.bones(path)
            for depth in range(len(self.stack), len(path) // TURN + 1):
                size = int.from_bytes(path[depth * TURN - 4 : depth * TURN], "big") if depth else 0
                node = _Open(depth, size, depth <= bones)
                if node.bone:
                    node.key, node.up = _key(path, depth), [n.key for n in self.stack]
                self.stack.append(node)
            self.last = path
        node = self.stack[-1]
        node.least = conv if node.least is None else min(node.least, conv)
        node.members += 1
        node.piece.append(conv)
        if len(node.piece) == PIECE:
            yield from self.flush(node)

    def flush(self, node: _Open) -> Iterator[tuple]:
        """Adds the ids at hand to the list of those that end at a node: a row of its own for a skeleton node, else its hash."""
        if node.piece:
            text = ",".join(map(str, node.piece))
            if node.bone:
                yield ("ends", self.shard, node.pieces, node.key, None, None, None, None, None, None, None, None, text)
            else:
                node.ends = node.ends or hashlib.sha256()
                node.ends.update((("," if node.pieces else "") + text).encode())
            node.pieces += 1
            node.piece = []

    def close(self) -> Iterator[tuple]:
        """Finishes the deepest open node and adds it to its parent."""
        node = self.stack.pop()
        yield from self.flush(node)
        up = self.stack[-1] if self.stack else None
        if node.bone:
            node.saved += node.members * node.size  # less one size for the node itself, when shards are added up
            yield ("bone", self.shard, node.size, node.key, node.up, node.least, node.depth, node.members, node.children, node.leaves, node.saved, None, None)
        else:
            node.leaves += not node.children
            node.saved += (node.members - 1) * node.size
            ends = node.ends.digest() if node.ends else _EMPTY
            self.spool.write(struct.pack(_NODE, node.least, node.depth, node.members, node.children, node.leaves, node.saved, ends))
            self.done += 1
        if up:
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.members += node.members
            up.leaves += node.leaves
            up.saved += node.saved
            up.children += not node.bone
        if not node.bone and (up is None or up.bone):
            yield from self.finished(up.key if up else None)

    def finished(self, key: bytes | None) -> Iterator[tuple]:
        """Rows of a subtree off the skeleton, read backwards: a node comes after its parent, whose id it gets."""
        above: list[int] = []
        at, base = self.done, None
        while at:
            begin = max(0, at - 4096)
            self.spool.seek(begin * _NODE_SIZE)
            block = struct.iter_unpack(_NODE, self.spool.read((at - begin) * _NODE_SIZE))
            for conv, depth, members, children, leaves, kept, ends in reversed(list(block)):
                base = depth if base is None else base
                del above[depth - base :]
                yield ("node", self.shard, None, key if depth == base else None, None, conv, depth, members, children, leaves, kept, above[-1] if above else None, ends.hex())
                above.append(conv)
            at = begin
        self.spool.seek(0)
        self.spool.truncate()
        self.done = 0

    def end(self) -> Iterator[tuple]:
        while self.stack:
            yield from self.close()
        self.spool.close()


FIELDS = "kind string, shard int, size long, key binary, up array<binary>, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, ends string"
_ARROW = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("size", pa.int64()), ("key", pa.binary()), ("up", pa.list_(pa.binary()))] + [(k, pa.int64()) for k in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id")] + [("ends", pa.string())])


def _walked(paths: DataFrame, splitters: list[tuple[bytes, int]]) -> DataFrame:
    """The rows of all shards' walks over (conv_id, path)."""
    shared = paths.sparkSession.sparkContext.broadcast(splitters)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = [bisect_right(shared.value, (p, c)) for p, c in zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch["path"], batch["conv_id"]], names=["shard", "path", "conv_id"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        walk, cuts = None, shared.value
        for batch in batches:
            for shard, path, conv in zip(*(batch[k].to_pylist() for k in ("shard", "path", "conv_id")), strict=True):
                if walk is None or walk.shard != shard:
                    if walk:
                        yield from walk.end()
                    walk = Walk(shard, cuts[shard - 1][0] if shard else None, cuts[shard][0] if shard < len(cuts) else None)
                yield from walk.add(path, conv)
        if walk:
            yield from walk.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for row in rows(batches):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    dealt = paths.mapInArrow(deal, "shard int, path binary, conv_id long")
    return dealt.repartition(len(splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(run, FIELDS)


def _hashed_ends(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256) from pieces (key, shard, size, ends) of lists: each list is read once, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, out = None, None, []
        for batch in batches:
            for key, text in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                if key != last:
                    if now:
                        out.append((last, now.hexdigest()))
                    last, now = key, hashlib.sha256(text.encode())
                else:
                    now.update(f",{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], names=["key", "ends_sha256"])
            out = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([now.hexdigest()])], names=["key", "ends_sha256"])

    return pieces.select("key", "shard", "size", "ends").repartition("key").sortWithinPartitions("key", "shard", "size").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node of the trie of (conv_id, path): conv_id (the smallest member), depth, parent_conv_id (the parent's
    conv_id, null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256. No conversation, no node. The paths
    are read three times: give a table that is stored."""
    with scratch(paths.sparkSession):
        rows = saved(_walked(paths, splitters_of(paths, shard_turns)), keep=True)
        parts = rows.where("kind = 'bone'").groupBy("key").agg(F.first("up").alias("up"), F.first("size").alias("size"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
        parts = saved(parts.withColumn("parent", F.expr("if(depth > 0, element_at(up, -1), null)")))
        below = parts.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("bones"))
        parts = parts.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("bones", F.lit(0)))
        parts = saved(parts.withColumn("leaf", (F.col("n_children") == 0).cast("long")))
        along = parts.select(F.explode(F.concat("up", F.array("key"))).alias("key"), "leaf", "size").groupBy("key").agg(F.sum("leaf").alias("leaves"), F.sum("size").alias("sizes"))
        hashes = _hashed_ends(rows.where("kind = 'ends'"))
        bones = parts.join(along, "key").join(hashes, "key", "left")
        bones = bones.withColumn("n_leaves", F.col("n_leaves") + F.col("leaves")).withColumn("saved_tokens", F.col("saved_tokens") - F.col("sizes"))
        bones = saved(bones.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), keep=True)
    named = bones.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    skeleton = bones.join(named, "parent", "left").select(columns)
    nodes = rows.where("kind = 'node'").withColumnRenamed("ends", "ends_sha256")
    under = nodes.where("key is not null").drop("parent_conv_id").withColumnRenamed("key", "parent").join(named, "parent").select(columns)
    return nodes.where("key is null").select(columns).union(under).union(skeleton)


def conversation_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """`prefix_trie` of the rebuilt conversations of (conv_id, turn, role, text).

    Every conversation is rebuilt by `rebuilt_paths`, and one without turns ends at the root. Rows without a conv_id are left
    out; null turns come first; null roles and texts are empty; turns that tie are ordered by the hash of role and text, and
    repeated rows are turns of their own. An empty table gives no rows. Other columns are not read."""
    with scratch(turns.sparkSession):
        paths = saved(conversation_paths(turns.select("conv_id", "turn", "role", "text")))
        paths = saved(rebuilt_paths(paths), keep=True)
    return prefix_trie(paths, shard_turns)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
with crc as materialized (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
items as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (
  select conv_id, list(struct_pack(role := role, text := text) order by turn nulls first, sha256(strlen(role) || ':' || role || text)) as turns
  from items group by conv_id),
heads as (
  select conv_id, turns, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: unicode(x)::bigint)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::bigint) % 9 as h
  from own, crc),
rebuilt as (
  select heads.conv_id, list_concat(coalesce(list_slice(own.turns, 1, h), []), list_slice(heads.turns, h + 1, len(heads.turns))) as turns
  from heads left join own on own.conv_id = heads.conv_id - heads.conv_id % 5),
members as (select conv_id, unnest(range(0, len(turns) + 1)) as depth, turns from rebuilt),
keyed as (select conv_id, depth, len(turns) = depth as ends, list_slice(turns, 1, depth) as prefix from members),
nodes as (
  select prefix, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from keyed group by prefix),
above as (select prefix, depth, conv_id, n_convs, list_slice(prefix, 1, depth - 1) as up from nodes),
children as (select up, count(*) as c from above where depth > 0 group by up),
own_values as (
  select nodes.*, coalesce(c, 0) as n_children, case when nodes.depth = 0 then 0 else (n_convs - 1) * strlen(prefix[nodes.depth].text) end as tokens
  from nodes left join children on children.up = nodes.prefix),
spread as (select list_slice(prefix, 1, d) as prefix, tokens, (n_children = 0)::bigint as leaf from (select *, unnest(range(0, depth + 1)) as d from own_values)),
totals as (select prefix, sum(tokens)::bigint as saved_tokens, sum(leaf)::bigint as n_leaves from spread group by prefix)
select o.conv_id, o.depth::bigint as depth, p.conv_id as parent_conv_id, o.n_convs::bigint as n_convs, o.n_children::bigint as n_children, n_leaves, saved_tokens,
  o.ends_sha256
from own_values o join totals on totals.prefix = o.prefix left join nodes p on o.depth > 0 and p.prefix = list_slice(o.prefix, 1, o.depth - 1)
"""
