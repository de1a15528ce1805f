"""Line dedup: a suffix array over line-id sequences by distributed prefix
doubling; runs of lines that occurred before are deleted.

The corpus is one sequence of line ids for each document (lines without a word
are not part of it and stay where they are). A suffix starts at every line.
Doubling ranks suffixes by their first 1, 2, 4, ... lines: the rank of a suffix
is the place in the sorted order where the suffixes that agree with it so far
begin, so a rank and the number of suffixes that share it are an interval of
the suffix array whose longest common prefix is at least the depth. A suffix
alone in its interval cannot be part of a repeat and leaves the working set,
which after the first round holds repeated lines only. Ranks come from a range
partitioning of the distinct keys and one running sum in each partition; no
step orders the corpus in one task.

At depth ``min_lines`` an interval of two or more suffixes is a repeated run;
all lines of all but its first occurrence (smallest doc_id, then text key, then
line) are deleted, so a longer maximal repeat is deleted as the union of its
windows. Decisions are made on the input, not on what is left.

With ``min_words`` an interval of fewer lines is a repeated run too when its
lines have that many words together; depths then go up by one line at a time.
A maximal run counts by either, so it is the union of the intervals that do: its
windows of ``min_lines`` lines, or itself if it is shorter. The first occurrence of
a line is in no later copy of any run, so it stays. The query and the pipeline
use ``MIN_WORDS``; None leaves runs to their number of lines alone.

Defined cases: null texts stay null and have no lines; equal rows (doc_id and
text) are one document and keep the same lines; null doc_ids come last; a text
that loses all its lines becomes empty; an empty table gives an empty result;
other columns are carried through untouched."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amity.llm.common import documents, text_key, written

#: Shortest run of lines that counts as repeated.
MIN_LINES = 3
#: Words that make a run of fewer lines count, where asked for; as many as a
#: repeated passage has at least in ``substring_dedup``.
MIN_WORDS = 20
NOT_BLANK = r"[^\x20\x09-\x0D]"
WORD = NOT_BLANK + "+"
BLANKS = " \t\n\x0b\x0c\r"


def _lines(rows: DataFrame) -> DataFrame:
    """(doc_id, tkey, at: number of the line among the lines with a word, k1 and
    k2: two 64-bit hashes that name the line, n_words)."""
    kept = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_BLANK))
    return rows.select("doc_id", "tkey", F.posexplode(kept).alias("at", "line")).select(
        "doc_id", "tkey", "at", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"),
        F.regexp_count("line", F.lit(WORD)).alias("n_words"))


def _ranked(keyed: DataFrame, name: str) -> DataFrame:
    """``keyed`` (a written table with k1, k2) with ``rank`` in place of its
    key; only rows whose key occurs twice or more. Distinct keys are range
    partitioned and summed up within their partition; the totals of the
    partitions, one row each, give the offsets."""
    counts = written(keyed.groupBy("k1", "k2").agg(F.count("*").alias("n"))
                     .repartitionByRange("k1", "k2").withColumn("part", F.spark_partition_id()), f"{name}-keys")
    parts = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy("part").agg(F.sum("n").alias("total")).select(
        "part", F.coalesce(F.sum("total").over(parts), F.lit(0)).alias("before"))
    upto = Window.partitionBy("part").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = (counts.withColumn("upto", F.sum("n").over(upto)).where("n > 1").join(offsets, "part")
             .select("k1", "k2", (F.col("before") + F.col("upto") - F.col("n")).alias("rank")))
    return written(keyed.join(ranks, ["k1", "k2"]).drop("k1", "k2"), name)


def repeated_runs(rows: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """(doc_id, tkey, at, rank, depth) of every suffix whose first ``depth``
    lines occur elsewhere too: ``min_lines``, or fewer with ``min_words`` words;
    equal depth and rank: equal lines. ``rows``: doc_id, tkey, text."""
    sizes = [] if min_words is None else ["n_words", "run_words"]
    lines = _lines(rows).withColumn("run_words", F.col("n_words")).select(
        "doc_id", "tkey", "at", *sizes, "k1", "k2").distinct()
    now, depth, short = _ranked(written(lines, "lines-0"), "lines-1"), 1, []
    runs = lambda depth: now.select("doc_id", "tkey", "at", "rank", F.lit(depth).alias("depth"))  # noqa: E731
    while depth < min_lines:
        if sizes:
            short.append(runs(depth).where(now["run_words"] >= min_words))
        step = 1 if sizes else min(depth, min_lines - depth)
        then = now.select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), (F.col("at") - step).alias("a"),
                          F.col("rank").alias("k2"), *[F.col("run_words").alias("then_words") for _ in sizes[:1]])
        pairs = now.join(then, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t"))
                         & (F.col("at") == F.col("a")))
        if sizes:
            pairs = pairs.withColumn("run_words", F.col("n_words") + F.col("then_words"))
        depth += step
        now = _ranked(written(pairs.select("doc_id", "tkey", "at", *sizes, F.col("rank").alias("k1"), "k2"),
                              f"lines-pairs-{depth}"), f"lines-{depth}")
    return reduce(DataFrame.union, short, runs(depth))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("tkey"), F.col("at"))


def later_copies(runs: DataFrame) -> DataFrame:
    """(doc_id, tkey, gone): the lines of the later copies of repeated runs."""
    first = written(runs.groupBy("depth", "rank").agg(F.min(_place()).alias("first")), "lines-first")
    covered = F.sequence(F.col("at"), F.col("at") + F.col("depth") - 1)
    return (runs.join(first, ["depth", "rank"]).where(_place() > F.col("first"))
            .groupBy("doc_id", "tkey").agg(F.array_distinct(F.flatten(F.collect_list(covered))).alias("gone")))


def cut_lines(text: str | None, gone) -> tuple[str | None, int, int]:
    """The text without the lines ``gone``, the number of its lines with a word,
    and how many of them went."""
    if text is None:
        return None, 0, 0
    gone = set() if gone is None else {int(x) for x in gone}
    kept, at, removed = [], 0, 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            if at in gone:
                removed += 1
            else:
                kept.append(line)
            at += 1
        else:
            kept.append(line)
    if removed and removed == at:
        kept = []
    return "\n".join(kept), at, removed


def _cut(docs: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """(row: all columns of docs, cut: text, n_lines, n_removed)."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", text_key().alias("tkey"))
    gone = later_copies(repeated_runs(rows.drop("row"), min_lines, min_words)).select(
        F.col("doc_id").alias("sid"), F.col("tkey").alias("skey"), "gone")

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = [cut_lines(t, g) for t, g in zip(text, gone)]
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    same = F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("tkey") == F.col("skey"))
    return rows.join(gone, same, "left").select("row", cut("text", "gone").alias("cut"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated line runs cut from its text."""
    return _cut(docs, min_lines, min_words).select(
        *[F.col("cut.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed, sha256 of the text left
    (of the empty text for null)."""
    return _cut(docs, min_lines, min_words).select(
        F.col("row.doc_id").alias("doc_id"), "cut.n_lines", "cut.n_removed",
        F.sha2(F.coalesce(F.col("cut.text"), F.lit("")), 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir).select("doc_id", "text"), min_words=MIN_WORDS)


OP7_SQL = f"""
with raw as (
  select doc_id, coalesce(text, '') as body, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents),
ln as (
  select *, row_number() over (partition by doc_id order by pos) as a,
         len(regexp_extract_all(line, '[^ 	-]+')) as n_words
  from raw where regexp_matches(line, '[^\x20\x09-\x0D]')),
win as (
  select doc_id, a, 1 as k, line as g from ln where n_words >= {MIN_WORDS}
  union all
  select x.doc_id, x.a, 2, x.line || chr(10) || y.line
  from ln x join ln y on y.doc_id = x.doc_id and y.a = x.a + 1 where x.n_words + y.n_words >= {MIN_WORDS}
  union all
  select x.doc_id, x.a, 3, x.line || chr(10) || y.line || chr(10) || z.line
  from ln x join ln y on y.doc_id = x.doc_id and y.a = x.a + 1
            join ln z on z.doc_id = x.doc_id and z.a = x.a + 2),
later as (
  select doc_id, a, k from (select *, row_number() over (partition by k, g order by doc_id, a) as nth from win)
  where nth > 1),
gone as (select distinct doc_id, a + j as a from later, (values (0), (1), (2)) v(j) where j < k),
flagged as (
  select raw.doc_id, raw.pos, raw.line, ln.a is not null as has_word, gone.a is not null as is_gone
  from raw left join ln on ln.doc_id = raw.doc_id and ln.pos = raw.pos
           left join gone on gone.doc_id = ln.doc_id and gone.a = ln.a),
per as (
  select doc_id, count(*) filter (where has_word) as n_lines, count(*) filter (where is_gone) as n_removed,
         string_agg(line, chr(10) order by pos) filter (where not is_gone) as kept
  from flagged group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(case when n_removed > 0 and n_removed = n_lines then '' else coalesce(kept, '') end) as kept_sha256
from documents d left join per using (doc_id)
"""
assert MIN_LINES == 3  # the windows of the SQL text
