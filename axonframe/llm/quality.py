"""Quality rules as a short-circuit cascade, in DataFrame and SQL operations only."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, saved

#: Documents of the sample on which the rules' costs and rejections are estimated.
SAMPLE_DOCS = 400
#: How often rules run on each document of the sample, until that takes so many seconds more than without a rule.
REPEATS = (1, 20, 400, 8000)
LONG_ENOUGH = 0.2

#: The rules: a document is kept if all hold. Each reads the columns that `measured` gives.
RULES = {
    "few symbols": "10 * n_symbols <= n_words",
    "few repeated lines": "2 * n_dup_lines <= n_lines",
    "usual word length": "word_chars >= 2 * n_words and word_chars <= 15 * n_words",
    "words with letters": r"2 * size(filter(words, w -> w rlike '\\p{L}')) >= n_words",
    "varied words": "pow(size(array_distinct(words)), 2) >= 4 * n_words",
}


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a five-word window that is found twice or more among the words, the first included."""

    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
        return F.when(F.size(w) >= 5, hashed).otherwise(F.array().cast("array<bigint>"))

    def flagged(s: Column) -> Column:
        same = lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])
        return F.sort_array(F.filter(F.transform(s, lambda e, j: F.when(same(e, j), e["i"])), lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        gaps = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(5).cast("long"), lambda a, j: a + F.least(F.lit(5), F.get(p, j) - F.get(p, j - 1)))
        return F.when(F.size(p) > 1, gaps).otherwise(F.lit(0).cast("long"))

    def of_hashes(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(placed, lambda s: _let(flagged(s), covered))).otherwise(F.lit(0).cast("long"))

    return _let(words, lambda w: _let(windows(w), of_hashes))


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: id, words, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Words are [^\\x20\\x09-\\x0D]+; lines count if they hold a word. n_repeat_words counts the words that lie in a
    five-word window found twice or more in the text: windows are hashed, sorted with their places, equal
    neighbours flagged, and the places' gaps, five at most, summed. A null text has no words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS)))
    rows = rows.withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return rows.select(
        "id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def cascade_order(docs: DataFrame, rules: dict[str, str] = RULES, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """The rules' names, each next one by its rejections of what the rules before leave, over its cost, on a sample of about
    sample_docs measured documents.

    The cost is the time of a rule's evaluations, repeated within one job until they take LONG_ENOUGH more than as many
    rows without a rule. Rejections come from one job that counts the sample by all rules' verdicts. The order changes how
    much work the cascade does, never what it keeps. An empty table gives the order as stated.
    """
    n = docs.count()
    if not n:
        return list(rules)
    sample = saved(measured(docs.sample(min(1.0, sample_docs / n), seed=11)).where(~base_failed()))
    failed = {name: F.coalesce(~F.expr(rule), F.lit(False)) for name, rule in rules.items()}
    verdicts = [(r.asDict(), r["n"]) for r in sample.groupBy(*[f.alias(name) for name, f in failed.items()]).agg(F.count("*").alias("n")).collect()]  # 2 ** rules at most
    idle: dict[int, float] = {}

    def took(condition: Column, times: int) -> float:
        began = time.perf_counter()
        sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times)))).select(F.count_if(condition & (F.col("again") > 0))).first()
        return time.perf_counter() - began

    def cost(name: str) -> float:
        for times in REPEATS:
            if times not in idle:
                idle[times] = min(took(F.col("n_words") < 0, times) for _ in range(2))
            more = took(failed[name], times) - idle[times]
            if more >= LONG_ENOUGH:
                break
        return max(more, 1e-4) / times

    costs, order, rest = {name: cost(name) for name in rules}, [], list(rules)
    while rest:
        alive = [(v, c) for v, c in verdicts if not any(v[x] for x in order)]
        value = {name: (sum(c for v, c in alive if v[name]) + 0.5) / costs[name] for name in rest}
        best = max(rest, key=value.__getitem__)
        order.append(best)
        rest.remove(best)
    return order


def judged(docs: DataFrame, order: list[str] | None = None, rules: dict[str, str] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: id, the base counts, base_failed, kept and rejected_by, the first rule of the order that fails.

    A document that fails the base is not kept and no rule is run on it (rejected_by `base`); otherwise the
    rules run in the order given until one fails. A null or empty text fails the base. Repeated rows
    are judged one by one; ids may be null; other columns are not read.
    """
    rows = measured(docs, id_column, text_column)
    verdict = F.when(base_failed(), F.lit("base"))
    for name in order or list(rules):
        verdict = verdict.when(~F.expr(rules[name]), F.lit(name))
    return rows.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict.alias("rejected_by")
    ).withColumn("kept", F.col("rejected_by").isNull())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judged(docs, cascade_order(docs)).withColumnRenamed("id", "doc_id")
    return found.drop("rejected_by")


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
w as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from d),
five as (
  select doc_id, pos, word as a, lead(word, 1) over o as b, lead(word, 2) over o as c, lead(word, 3) over o as e, lead(word, 4) over o as f
  from w window o as (partition by doc_id order by pos)),
flagged as (select doc_id, pos, case when f is not null and count(*) over (partition by doc_id, a, b, c, e, f) > 1 then 1 else 0 end as hit from five),
covered as (select doc_id, pos, max(hit) over (partition by doc_id order by pos rows between 4 preceding and current row) as hit from flagged),
repeats as (select doc_id, sum(hit)::bigint as n_repeat_words from covered group by 1),
counts as (
  select d.doc_id, words, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join repeats on repeats.doc_id = d.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 10 * n_symbols <= n_words and 2 * n_dup_lines <= n_lines
       and word_chars >= 2 * n_words and word_chars <= 15 * n_words
       and 2 * len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) >= n_words
       and pow(len(list_distinct(words)), 2) >= 4 * n_words as kept
from counts
"""
