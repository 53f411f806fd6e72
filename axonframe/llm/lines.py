"""Fuzzy line dedup by MinHash, in DataFrame and SQL operations only.

Lines are known by 128 bits of hash. Their shingles are runs of eight characters (code points; the whole line if it is
shorter). One permutation deals a line's shingle hashes into 32 bins and keeps each bin's least; three bins make a band,
ten bands a line's keys. A band without shingles has no key, so a line of few shingles meets every line that differs from
it in fewer places than it has bands. Exact Jaccard similarity confirms links: first each line of a bucket with the
bucket's head; in buckets whose other lines are still apart, those outside the largest component with one of its lines;
then, where lines are apart even so, those outside with all others, compared within the join's condition. Before texts are
compared, pairs go whose shingles differ too much by the parities of their hashes in 64 * WORDS cells, which no link does.
One line of each component stays: the first by document id and line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, saved, scratch

SHINGLE = 8
#: Bits of a shingle's hash that name its bin, and what bins are used: BANDS * ROWS of 2 ** BIN_BITS.
BIN_BITS = 5
BANDS, ROWS = 10, 3
#: Hashes of a bin that are kept on average in long lines, and places at a line's start whose hashes always are.
KEPT, FIRST = 4, 32
#: Lines of a bucket that one task compares with others at a time.
BLOCK = 1024
#: 64-bit words of a line's parities, a power of two. Lines of more than twice as many shingles as these have bits are also compared by their hashes.
WORDS = 16
#: Lines link from this Jaccard similarity of their shingle sets, in hundredths.
PERCENT = 80


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc, no, line): the lines that hold a word, numbered from 0 within the text, of rows with an id.

    Outer forms here and below: before others Spark looks for empty arrays, for which it makes each array twice."""
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc"), F.posexplode_outer(F.split(text_column, "\n")).alias("no", "line"))
    return rows.where(F.ltrim("line", F.lit(" \t\n\x0b\f\r")) != "")


def _named(lines: DataFrame) -> DataFrame:
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _banded(lines: DataFrame) -> DataFrame:
    """(key, h1, h2): a row for each band of each distinct line. Shingles are exploded, hashed and dealt in one compiled loop,
    after equal lines have met: a line's bins are then filled where the line is, without another shuffle.

    In a long line only hashes low enough to be a bin's least go on, KEPT of a bin on average, and those of the first
    places, for lines that repeat themselves: a bin's least is the same whatever else is left out.
    """
    wide = _named(lines).dropDuplicates(["h1", "h2"]).select("h1", "h2", F.encode("line", "UTF-32").alias("u"))
    each = wide.select("h1", "h2", "u", F.explode_outer(F.expr(_starts("u"))).alias("at"))
    hashed = each.select("h1", "h2", "u", "at", F.expr(f"xxhash64(substring(u, at, {4 * SHINGLE}))").alias("x"))
    low = F.col("x").bitwiseAND(F.lit((1 << 31) - 1))
    bin_ = F.shiftrightunsigned("x", 64 - BIN_BITS).cast("int")
    dealt = hashed.select("h1", "h2", "u", "at", bin_.alias("bin"), low.alias("v"))
    dealt = dealt.where(f"(at <= {4 * FIRST} or v * octet_length(u) < {KEPT << BIN_BITS + 2}L << 31) and bin < {BANDS * ROWS}")
    dealt = dealt.select("h1", "h2", F.expr(f"cast(bin div {ROWS} as int)").alias("band"), (F.col("bin") % ROWS).alias("row"), F.col("v").cast("int").alias("v"))
    found = dealt.groupBy("h1", "h2", "band").agg(*[F.min(F.when(F.col("row") == r, F.col("v"))).alias(f"m{r}") for r in range(ROWS)])
    return found.select(F.xxhash64("band", *[F.coalesce(f"m{r}", F.lit(0)) for r in range(ROWS)]).alias("key"), "h1", "h2")


def _met(lines: DataFrame) -> DataFrame:
    """(key, h1, many): the keys that several lines have, with the lines' first hashes and how many there are.

    Keys are shuffled once, straight from the lines, with half of the lines' names: should two lines share it, either stands
    in the other's buckets as well, which only adds candidates."""
    return _banded(lines).select("key", "h1").withColumn("many", F.count("*").over(Window.partitionBy("key"))).where("many > 1")


def _starts(u: str) -> str:
    """Where shingles start in a line's UTF-32 bytes."""
    return f"sequence(1, greatest(1, octet_length({u}) - {4 * SHINGLE - 1}), 4)"


def _shingles(text: str) -> Column:
    """The hashes of a line's shingles, in order, repeated ones too."""
    return F.expr(f"transform(array(encode({text}, 'UTF-32')), u -> transform({_starts('u')}, i -> xxhash64(substring(u, i, {4 * SHINGLE}))))[0]")


def _marked(texts: DataFrame) -> DataFrame:
    """(id, n, odd): a line's number of distinct shingles and the parities of their hashes in 64 * WORDS cells."""
    sets = texts.repartition("id").select("id", F.array_distinct(_shingles("line")).alias("s"))
    each = sets.select("id", F.size("s").alias("n"), F.explode_outer("s").alias("x"))
    cell = each.select("id", "n", F.col("x").bitwiseAND(F.lit(WORDS - 1)).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftright(x, {WORDS.bit_length() - 1}) & 63 as int))").alias("m"))
    words = cell.groupBy("id", "n", "w").agg(F.bit_xor("m").alias("m"))
    return words.groupBy("id", "n").agg(*[F.bit_or(F.when(F.col("w") == w, F.col("m")).otherwise(F.lit(0))).alias(f"m{w}") for w in range(WORDS)]).select("id", "n", F.array(*[f"m{w}" for w in range(WORDS)]).alias("odd"))


def _alike(percent: int) -> str:
    """The condition that lines of n_a and n_b shingles with odd_a and odd_b may be of that similarity. No more cells than shingles
    differ, so no link fails it."""
    odd = " + ".join(f"bit_count(odd_a[{w}] ^ odd_b[{w}])" for w in range(WORDS))
    return f"100L * least(n_a, n_b) >= {percent}L * greatest(n_a, n_b) and {100 + percent}L * ({odd}) <= {100 - percent}L * (n_a + n_b)"


def _sided(df: DataFrame, x: str) -> DataFrame:
    return df.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "id"])


def _confirmed(pairs: DataFrame, texts: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of line ids whose exact similarity is percent or more."""
    alike = pairs.join(_sided(marks, "a"), "a").join(_sided(marks, "b"), "b").where(_alike(percent)).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"))
    text = texts.select("id", "line")
    sets = alike.join(_sided(text, "a"), "a").join(_sided(text, "b"), "b").select("a", "b", "n", _shingles("line_a").alias("x"), _shingles("line_b").alias("y"))
    sizes = saved(sets.select("a", "b", "n", F.size(F.array_intersect("x", "y")).alias("i")))
    return sizes.where(f"100L * i >= {percent}L * (n - i)").select("a", "b")


def _mixed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, component, size, main): the lines, but the heads, of buckets that hold several components, and the largest of these; met (key, id, known, head)."""
    own = met.where("id <> head").join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    own = own.select("key", "id", "known", F.coalesce("component", "id").alias("component"))
    counted = own.groupBy("key", "component").agg(F.count("*").alias("c"))
    parted = counted.groupBy("key").agg(F.count("*").alias("k"), F.sum("c").alias("size"), F.max_by("component", "c").alias("main")).where("k > 1").drop("k")
    return own.join(parted, "key")


def _compared(mixed: DataFrame, met: DataFrame, texts: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) to confirm of lines of a bucket in different components.

    Lines outside their bucket's largest component are dealt into blocks, and each block meets the whole bucket. Lines are
    compared within the condition of the join, a pair in the least key that it shares: by their parities, then, if both have
    more than twice as many shingles as these have bits, by a quarter of their 31-bit hashes, with four deviations to spare, and by all, a
    hundredth below the similarity.
    """
    ids = mixed.select("id").distinct()
    keys = met.join(ids, "id", "left_semi").groupBy("id").agg(F.collect_list("key").alias("keys"))  # BANDS at most
    long = texts.join(marks.where(f"n > {2 * 64 * WORDS}").join(ids, "id", "left_semi"), "id", "left_semi")
    long = long.select("id", F.array_distinct(F.transform(_shingles("line"), lambda x: F.shiftrightunsigned(x, 33).cast("int"))).alias("s"))
    sets = saved(marks.join(keys, "id").join(saved(long), "id", "left").withColumn("t", F.filter("s", lambda x: x % 4 == 0)))
    rows = mixed.join(sets, "id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "odd", "s", "t", "keys")]
    a = rows.where("component <> main").select("key", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), *side("a"))
    b = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "main", *side("b"))
    p = percent / 100
    apart = "component_a <> component_b and (component_b = main or id_a < id_b)"
    once = "a.key = array_min(array_intersect(keys_a, keys_b))"
    likely = f"{1 + p} * size(array_intersect(t_a, t_b)) >= {p} * (size(t_a) + size(t_b)) - {4 * (p * (1 - p)) ** 0.5} * sqrt(size(t_a) + size(t_b))"
    near = f"{100 + percent - 1}L * size(array_intersect(s_a, s_b)) >= {percent - 1}L * (size(s_a) + size(s_b))"
    found = a.alias("a").join(b.alias("b"), F.expr(f"a.key = b.key and a.block = b.block and {apart} and {_alike(percent)} and {once} and (s_a is null or s_b is null or {likely} and {near})"))
    return found.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def fuzzy_components(lines: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(h1, h2, component): the names of lines (line) that link with another, and a number for their component. Links are
    found as the module says."""
    spark = lines.sparkSession  # what each block has shuffled and written for itself alone goes when it ends
    with scratch(spark):
        met = saved(_met(lines), keep=True)
    with scratch(spark):
        texts = _named(lines).join(met.select("h1").distinct(), "h1", "left_semi").dropDuplicates(["h1", "h2"])
        texts = saved(texts.withColumn("id", F.monotonically_increasing_id()), keep=True)
    with scratch(spark):
        marks = saved(_marked(texts), keep=True)
    with scratch(spark):
        met = met.join(texts.select("h1", "id"), "h1").select("key", "id", "many")
        known = met.join(met.groupBy("id").agg(F.sum("many").alias("known")), "id").select("key", "id", "known")
        heads = known.groupBy("key").agg(F.max_by("id", F.struct("known", "id")).alias("head"))  # an original meets its copies more often than they meet
        met = saved(known.join(heads, "key"), keep=True)
    with scratch(spark):
        links = saved(_confirmed(met.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), texts, marks, percent), keep=True)
    labels = components(links)
    with scratch(spark):
        mixed = saved(_mixed(met, labels))
        pivots = mixed.where("component = main").groupBy("key").agg(F.max_by("id", F.struct("known", F.xxhash64("id"))).alias("a"))
        pivots = mixed.where("component <> main").join(pivots, "key").select("a", F.col("id").alias("b")).distinct()
        links = links.union(saved(_confirmed(pivots, texts, marks, percent), keep=True))
    labels = components(links)
    with scratch(spark):
        more = saved(_confirmed(_compared(saved(_mixed(met, labels)), met, texts, marks, percent), texts, marks, percent), keep=True)
    labels = labels if more.isEmpty() else components(links.union(more))
    return texts.select("id", "h1", "h2").join(labels.withColumnRenamed("node", "id"), "id").select("h1", "h2", "component")


def repeated_lines(docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, no, exact): the lines to drop; exact says that the line stays elsewhere letter by letter."""
    every = _lines(docs, id_column, text_column)
    lines = saved(_named(every).select("doc", "no", "h1", "h2"))
    with scratch(docs.sparkSession):
        linked = saved(fuzzy_components(every.select("line"), percent), keep=True)
    again = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    # a group is a component of links, or else one name
    group = [F.coalesce("component", F.lit(-1)).alias("c"), *[F.when(F.col("component").isNull(), F.col(h)).otherwise(0).alias(g) for h, g in (("h1", "g1"), ("h2", "g2"))]]
    names = saved(again.join(linked, ["h1", "h2"], "full_outer").select("h1", "h2", *group))
    kinds = saved(lines.join(names, ["h1", "h2"]).groupBy("h1", "h2", "c", "g1", "g2").agg(F.min(F.struct("doc", "no")).alias("first")))
    stays = kinds.groupBy("c", "g1", "g2").agg(F.min("first").alias("stays"))
    judged = kinds.join(stays, ["c", "g1", "g2"]).select("h1", "h2", "stays", (F.col("first") == F.col("stays")).alias("exact"))
    return lines.join(judged, ["h1", "h2"]).where(F.struct("doc", "no") != F.col("stays")).select("doc", "no", "exact").distinct()


def dedup_lines(docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs as (doc, n_lines, n_exact, n_fuzzy, deduped): the row as a struct, its lines with a word, the lines dropped as
    exact and as near copies, and its text without them.

    Of each component of equal or similar lines the first by id and number stays. Lines without a word always
    stay. A null text stays null; a text whose lines all go is empty. Rows that share an id are one document: a line
    goes from all of them or none. Rows without an id keep their lines and drop no others. An empty table gives no rows.
    """
    gone = repeated_lines(docs, percent, id_column, text_column)
    per_doc = gone.groupBy("doc").agg(F.collect_list("no").alias("gone"), F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_fuzzy"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("doc")).join(per_doc, "doc", "left").withColumn("text", F.col("row")[text_column])
    kept = F.expr(r"array_join(transform(array(split(text, '\n')), s -> transform(array_except(sequence(0, size(s) - 1), gone), i -> s[i]))[0], '\n')")
    counted = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(F.col("row").alias("doc"), counted.cast("long").alias("n_lines"), zero("n_exact"), zero("n_fuzzy"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("deduped"))


def without_repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, the same rows and columns, with text less its repeated lines and, where it changes, n_chars counted again."""
    found = dedup_lines(docs, percent)
    new = {"text": F.col("deduped"), "n_chars": F.when(F.col("deduped") == F.col("doc.text"), F.col("doc.n_chars")).otherwise(F.length("deduped").cast("long"))} if "n_chars" in docs.columns else {"text": F.col("deduped")}
    return found.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select("doc.doc_id", "n_lines", "n_exact", "n_fuzzy", F.length("deduped").cast("long").alias("n_chars_left"), F.md5("deduped").alias("text_md5"))


SQL = r"""
with recursive l as (
  select doc_id, generate_subscripts(s, 1) - 1 as no, unnest(s) as line
  from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null)),
lines as (select doc_id, no, line from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
kinds as (select line, count(*) as n, min(row(doc_id, no)) as first from lines group by 1),
sets as (select line, list_distinct(list_transform(range(1, greatest(2, length(line) - 6)), lambda i: substr(line, i, 8))) as s from kinds),
items as (select line, len(s) as n, unnest(s) as x from sets),
common as (select x, n, line from items where x in (select x from items group by x having count(*) > 1)),
shared as (
  select p.line as a, q.line as b, count(*) as i, any_value(p.n) + any_value(q.n) - count(*) as u
  from common p join common q on p.x = q.x and p.line < q.line and 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n) group by 1, 2),
links as (select a, b from shared where 100 * i >= 80 * u),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select a as line, a as r from both_ways
  union
  select reach.line, both_ways.b from reach join both_ways on both_ways.a = reach.r),
named as (select kinds.line, first, coalesce(c, kinds.line) as component from kinds left join (select line, min(r) as c from reach group by 1) m on m.line = kinds.line),
judged as (select line, first, min(first) over (partition by component) as stays from named),
marked as (
  select doc_id, no, lines.line, row(doc_id, no) = stays as keeps, first = stays as exact
  from lines join judged on judged.line = lines.line),
full_text as (
  select l.doc_id, count(keeps) as n_lines, count(case when not keeps and exact then 1 end) as n_exact,
         count(case when not keeps and not exact then 1 end) as n_fuzzy,
         coalesce(string_agg(l.line, chr(10) order by l.no) filter (where keeps is null or keeps), '') as t
  from l left join marked on marked.doc_id = l.doc_id and marked.no = l.no group by 1)
select documents.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_exact, 0) as n_exact, coalesce(n_fuzzy, 0) as n_fuzzy,
       length(t)::bigint as n_chars_left, md5(t) as text_md5
from documents left join full_text on full_text.doc_id = documents.doc_id
"""
