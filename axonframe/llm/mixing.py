"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import folders, saved

#: Rows that one group of the ranking window holds on average; groups are cut by hash, so no source makes a larger one.
RANKED_TOGETHER = 2_000
#: Parts of the whole that a weight is counted in, fewer if a run has so many slots that slots times parts would not fit a long.
PARTS, MOST_PRODUCT = 100_000_000_000, 4_000_000_000_000_000_000
#: Stretches of a run at most; longer runs have longer ones.
STRETCHES = 4096
#: Picks of a stretch that are copied with each slot; full pieces are set aside.
PIECE = 256
#: The entry in the id column's metadata that names the folder of a mix's places.
PLACES = "mixed_places"

#: The blocks done at the ends of the stretches 1 .. n of `step` slots, for s, an array of structs with w that add up to parts.
#: Blocks due by then are done; of the others each source has one at most that is released, and as many are done as slots are
#: left. Those done before stay so. Of those released within the stretch, the latest j may hold only the slots that their
#: shares of a block add up to, rounded up; within that the ones due first are taken, in the order of releases.
_STATES = """aggregate(sequence(1L, n),
             named_struct('done', transform(s, x -> 0L), 'out', cast(array() as array<struct<start: array<bigint>, stop: array<bigint>>>)),
             (a, c) -> transform(
               transform(
                 transform(
                   transform(array(transform(s, (x, i) -> named_struct(
                       'whole', c * step * x.w div parts, 'part', c * step * x.w % parts, 'i', i,
                       'ahead', a.done[i] > c * step * x.w div parts,
                       'release', (c * step * x.w div parts) * parts div x.w,
                       'due', ((c * step * x.w div parts + 1) * parts + x.w - 1) div x.w))),
                     z -> named_struct(
                       'base', transform(z, y -> y.whole + if(y.ahead, 1L, 0L)),
                       'old', array_sort(transform(filter(z, y -> y.part > 0 and not y.ahead and y.release <= (c - 1) * step), y -> named_struct('due', y.due, 'i', y.i))),
                       'new', array_sort(transform(filter(z, y -> y.part > 0 and not y.ahead and y.release > (c - 1) * step),
                           y -> named_struct('release', y.release, 'due', y.due, 'i', y.i, 'part', y.part))))),
                   z -> named_struct('base', z.base, 'old', z.old, 'new', z.new,
                       'open', c * step - aggregate(z.base, 0L, (p, y) -> p + y), 'parts', aggregate(z.new, 0L, (p, y) -> p + y.part))),
                 z -> named_struct('base', z.base,
                     'first', slice(z.old, 1, cast(greatest(0L, z.open - (z.parts + parts - 1) div parts) as int)),
                     'then', aggregate(z.new,
                         named_struct(
                           'pool', slice(z.old, 1 + cast(greatest(0L, z.open - (z.parts + parts - 1) div parts) as int), size(z.old)),
                           'rest', z.parts, 'skip', greatest(0L, (z.parts + parts - 1) div parts - z.open), 'got', cast(array() as array<int>)),
                         (p, y) -> transform(
                           transform(array(named_struct(
                               'pool', array_append(p.pool, named_struct('due', y.due, 'i', y.i)),
                               'free', (p.rest + parts - 1) div parts - (p.rest - y.part + parts - 1) div parts)),
                             q -> named_struct('pool', q.pool, 'free', q.free, 'm', if(q.free > 0 and p.skip = 0, array_min(q.pool), null))),
                           q -> named_struct(
                             'pool', if(q.m is null, q.pool, array_remove(q.pool, q.m)),
                             'rest', p.rest - y.part, 'skip', greatest(0L, p.skip - q.free),
                             'got', if(q.m is null, p.got, array_append(p.got, q.m.i))))[0],
                         p -> p.got))),
               z -> transform(array(transform(z.base, (b, i) -> b + if(exists(z.first, y -> y.i = i) or array_contains(z.then, i), 1L, 0L))),
                 q -> named_struct('done', q, 'out', concat(a.out, array(named_struct('start', a.done, 'stop', q)))))[0])[0],
             a -> a.out)"""

#: (i, block) of each slot of stretch c: of the released blocks up to `stop` the one that is due first, of those that tie the
#: first source's.
_PICKS = f"""aggregate(sequence(c * step, (c + 1) * step - 1),
             named_struct('done', start, 'cur', cast(array() as array<struct<i: int, block: bigint>>), 'out', cast(array() as array<array<struct<i: int, block: bigint>>>)),
             (a, t) -> transform(
               transform(array(array_min(transform(s, (x, i) ->
                     if(a.done[i] < stop[i] and a.done[i] * parts div x.w <= t,
                        named_struct('due', ((a.done[i] + 1) * parts + x.w - 1) div x.w, 'i', i),
                        null)))),
                 m -> named_struct('i', m.i, 'cur', array_append(a.cur, named_struct('i', m.i, 'block', a.done[m.i])))),
               q -> named_struct(
                 'done', transform(a.done, (d, i) -> if(i = q.i, d + 1, d)),
                 'cur', if(size(q.cur) < {PIECE}, q.cur, slice(q.cur, 1, 0)),
                 'out', if(size(q.cur) < {PIECE}, a.out, concat(a.out, array(q.cur)))))[0],
             a -> concat(flatten(a.out), a.cur))"""


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (doc, src, id) with `ix`: the row's place from 0 in its source, in the order of md5(id) and id.

    No window sees a whole source. Rows are cut into ranges of the hash, ranked within each, and
    counts of the ranges before give the offset.
    """
    parts = max(1, -(-rows.count() // RANKED_TOGETHER))
    keyed = rows.withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = keyed.withColumn("part", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * parts, 32))
    counts = keyed.groupBy("src", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("src", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("src", "part").orderBy("h", "id"))
    ranked = keyed.withColumn("rn", place)
    return ranked.join(offsets, ["src", "part"]).withColumn("ix", F.col("start") + F.col("rn") - 1).drop("part", "rn", "start", "h")


def _name(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def block_slots(targets: DataFrame, stretch: int = 1024) -> DataFrame:
    """(src, block, slot) of all blocks, for targets (src, v, m): a weight, and how many blocks there are.

    Block k of a source that has the share w of all weights is released at floor(k / w) and due before ceil((k + 1) / w), over
    the whole run, and each slot takes, of the released blocks, the one due first (ties: the first source by name). So at
    every slot each source is less than one block off its share. The run is cut into stretches of `stretch` slots, or more
    where there would be over STRETCHES of them. How many blocks of each source are done at the ends of stretches follows
    from shares alone, one stretch after the other, such that blocks meet their releases and dues on both sides; within a
    stretch slots are filled in a task of its own. A run of one stretch is plain earliest-deadline-first. Any number of
    sources; the ends of stretches take one task, which holds an array of them.
    """
    targets = targets.where("v > 0")
    total = targets.agg(F.sum("v").alias("total"), F.max(F.ceil(F.col("m") * 2.0 / F.col("v"))).alias("most"))
    lists = targets.crossJoin(F.broadcast(total))  # one row
    within = F.expr(f"least({PARTS}L, cast({MOST_PRODUCT}L / (total * most + 1) as bigint))")
    lists = lists.withColumn("w", F.greatest(F.lit(1), F.round(F.col("v") / F.col("total") * within)).cast("long"))
    lists = lists.agg(F.sort_array(F.collect_list(F.struct("src", "w", "m"))).alias("s")).where(F.size("s") > 0)
    lists = lists.withColumn("parts", F.expr("aggregate(s, 0L, (a, x) -> a + x.w)"))
    lists = lists.withColumn("slots", F.expr("array_max(transform(s, x -> (x.m * parts + x.w - 1) div x.w))"))
    lists = lists.withColumn("step", F.expr(f"greatest({stretch}L, (slots + {STRETCHES - 1}) div {STRETCHES})"))
    lists = saved(lists.withColumn("n", F.expr("(slots + step - 1) div step")))
    each = saved(lists.select("s", "parts", "step", F.posexplode(F.expr(_STATES)).alias("c", "x")).selectExpr("s", "parts", "step", "bigint(c) as c", "x.*"))
    picks = each.repartition(F.col("c")).select("s", "step", "c", F.posexplode(F.expr(_PICKS)).alias("at", "x"))
    placed = picks.selectExpr("s[x.i].src as src", "s[x.i].m as m", "x.block as block", "c * step + at as slot")
    return placed.where("block < m").select("src", "block", "slot")


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = 8, stretch: int = 1024, power: float = 0.5,
    id_column: str = "doc_id", source_column: str = "source",
) -> DataFrame:
    """All rows of docs with their place in a mix of the sources: columns doc (the row), src, block, slot, ix.

    weights gives target weights by source; sources that it lacks, and all if it is None, weigh their
    number of rows to `power`. A source's rows, in the order of md5(id), form blocks of block_docs, whose
    slots are those of block_slots. Reading by (slot, ix) interleaves the sources with less than one block's
    deviation from the targets at every slot; slots of sources that have run out stay empty, so the others
    share by their weights. Rows of a source of weight 0 have no slot (null). Every row is returned once.

    A null source is a source of its own; rows of equal id are ordered arbitrarily among themselves; an
    empty table gives no rows; other columns, whatever their names, ride along in doc.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.struct("*").alias("doc"), _name(source_column).alias("src"), F.col(id_column).alias("id"))
    sizes = rows.groupBy("src").agg(F.count("*").alias("n"))
    given = spark.createDataFrame([(f"={k}", float(v)) for k, v in (weights or {}).items()], "src string, given double")
    heavy = sizes.join(F.broadcast(given), "src", "left").select("src", "n", F.greatest(F.lit(0.0), F.coalesce("given", F.pow("n", F.lit(power)))).alias("v"))
    targets = saved(heavy.select("src", "v", F.ceil(F.col("n") / block_docs).cast("long").alias("m")))
    ranked = _ranked(rows).withColumn("block", F.expr(f"ix div {block_docs}"))
    return ranked.join(saved(block_slots(targets, stretch)).hint("merge"), ["src", "block"], "left").select("doc", "src", "block", "slot", "ix")


def _placed(docs: DataFrame, places: DataFrame, id_column: str, source_column: str) -> DataFrame:
    """(doc, slot, ix): the rows of docs with their places (src, id, slot, ix). Rows of equal source and id share out the
    places of both, those alike in all columns as it comes; rows without a place have nulls."""
    key = ["src", "id"]
    by = [c for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))]  # what can be hashed
    rows = docs.select(F.struct("*").alias("doc"), _name(source_column).alias("src"), _name(id_column).alias("id"), F.xxhash64(*by).alias("h"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("h"))).drop("h")
    places = places.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("ix")))
    return rows.join(places, [*key, "n"], "left").select("doc", "slot", "ix")


def in_mixed_order(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", **options) -> DataFrame:
    """docs, the same columns, laid out in the order of the mix: ranges of slots by partition, sorted within.

    Files keep no order between tasks, so the places are saved as well, by source and id, and the id column's metadata, which
    Parquet files keep, name their folder: `places_of` reads there what was decided here."""
    mixed = mix_sources(docs.select(id_column, source_column), id_column=id_column, source_column=source_column, **options)
    places = saved(mixed.select("src", _name(f"doc.`{id_column}`").alias("id"), "slot", "ix"))
    order = [F.col("slot").asc_nulls_last(), F.col("ix")]
    laid = _placed(docs, places, id_column, source_column).repartitionByRange(*order).sortWithinPartitions(*order)
    noted = docs.schema[id_column].metadata | {PLACES: folder for folder in folders(places)}
    return laid.select(*[F.col(f"doc.`{c}`").alias(c, metadata=noted) if c == id_column else F.col(f"doc.`{c}`") for c in docs.columns])


def places_of(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """(doc, slot, ix): the rows of docs with the places that `in_mixed_order` gave them; nulls in a table that it has not made."""
    folder = docs.schema[id_column].metadata.get(PLACES)
    if folder is None:
        return docs.select(F.struct("*").alias("doc"), F.lit(None).cast("long").alias("slot"), F.lit(None).cast("long").alias("ix"))
    places = docs.sparkSession.read.schema("src string, id string, slot long, ix long").parquet(folder)
    return _placed(docs, places, id_column, source_column)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    mixed = mix_sources(docs)
    return mixed.select("doc.doc_id", "doc.source", "block", "slot", "ix")


#: The whole run by earliest deadline first, one slot a step of the recursion.
SQL = """
with recursive sizes as (
  select coalesce('=' || source, 'null') as src, count(*) as n from documents group by 1),
shares as (select src, n, pow(n, 0.5) as v, ceil(n / 8.0)::bigint as m from sizes),
whole as (select sum(v) as total, max(ceil(m * 2.0 / v)) as most from shares),
targets as (
  select src, m, greatest(1, round(v / total * least(100000000000, (4000000000000000000 / (total * most + 1))::bigint)))::bigint as w,
         (row_number() over (order by src))::int as i
  from shares, whole),
names as (
  select list(w order by src) as ws, sum(w)::hugeint as parts, (select max((m * p + w - 1) // w) from targets, (select sum(w)::hugeint as p from targets)) as slots from targets),
edf(t, pick, block, done) as (
  select -1::bigint, 0, 0::bigint, list_transform(ws, lambda x: 0::bigint) from names
  union all
  select t + 1, p, done[p], list_transform(done, lambda d, i: case when i = p then d + 1 else d end)
  from (select t, done, (list_min(list_transform(list_filter(range(1, len(ws) + 1),
                 lambda i: (done[i] * parts) // ws[i] <= t + 1),
                 lambda i: (((done[i] + 1) * parts + ws[i] - 1) // ws[i]) * 10000 + i)) % 10000)::int as p
        from edf, names where t + 1 < slots)),
schedule as (select src, block, t as slot from edf join targets on targets.i = edf.pick where t >= 0),
ranked as (
  select doc_id, source, coalesce('=' || source, 'null') as src,
         row_number() over (partition by source order by md5(doc_id::varchar), doc_id) - 1 as ix
  from documents)
select doc_id, source, ix // 8 as block, slot, ix
from ranked join schedule on schedule.src = ranked.src and schedule.block = ix // 8
"""
