"""Quality rules with cross-document line frequency (DataFrame functions only).

Per document: counts that need nothing but its own text. Across documents:
normalised lines are hashed, the distinct texts that hold a line are counted
per host, lines above the host's limit are boilerplate, and a document that
loses too many of its words with them is rejected.

Defined cases: a null text has no words and fails the base rules, like an
empty one; a null host is a host of its own; rows equal in host and text count
once in the line counts, so copies of one text cannot make its own lines
boilerplate; an empty table gives an empty result; other columns are carried
through untouched, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.llm.common import SPACE, documents, text_key, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Words of a window; a power of two, see ``with_window_hashes``.
WINDOW = 8
OTHER_BLANKS = "\t\x0b\x0c\r"
NOT_BLANK = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: A line is boilerplate of a host when it is certain that more than this share of
#: the host's texts hold it: when the texts that do, less the root of them times
#: ``MAX_LINE_TEXTS`` (the lower bound of a count at so many squared deviations),
#: exceed the share. One rule for hosts of every size; however small a host, more
#: than ``MAX_LINE_TEXTS`` distinct texts must hold the line.
MAX_LINE_TEXTS = 20
MAX_LINE_PERCENT = 1
#: A document is depleted when less than this share of its words is left.
MIN_KEPT_PERCENT = 50


def normal_line(low: Column) -> Column:
    """A lower-cased line with runs of blanks as one space and none at the
    ends. The regular expression only runs on lines that hold a run or another
    blank than space."""
    odd = low.contains("  ")
    for blank in OTHER_BLANKS:
        odd = odd | low.contains(blank)
    return F.trim(F.when(odd, F.regexp_replace(low, SPACE, " ")).otherwise(low))


def with_words(rows: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the words of text. Splitting at single spaces has a fast
    path; the empty strings that runs of blanks leave are filtered where there
    are any."""
    flat = F.coalesce("text", F.lit(""))
    for blank in "\n" + OTHER_BLANKS:
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    rows = rows.withColumn("flat", flat).withColumn(out, F.split("flat", " "))
    gaps = F.col("flat").contains("  ") | F.col("flat").startswith(" ") | F.col("flat").endswith(" ") \
        | (F.col("flat") == "")
    return rows.withColumn(out, F.when(gaps, F.filter(out, lambda x: x != "")).otherwise(F.col(out))).drop("flat")


def _paired(items: str, step: int) -> Column:
    return F.transform(items, lambda x, i: F.xxhash64(x, F.get(items, i + step)))


def with_window_hashes(rows: DataFrame, w: str, out: str) -> DataFrame:
    """Adds ``out``: hashes of the ``WINDOW``-word windows of the word array
    ``w``, one for each start. Each level pairs the level below with itself a
    step further on, so a window costs three short hashes, not eight words."""
    rows, step = rows.withColumn(out, _paired(w, 1)), 2
    while step < WINDOW:
        rows = rows.withColumn(out, _paired(out, step))
        step *= 2
    return rows.withColumn(out, F.slice(out, 1, F.greatest(F.size(out) - (WINDOW - 1), F.lit(0))))


def is_boilerplate(texts: Column, host_texts: Column, max_texts: int, max_percent: int) -> Column:
    return texts - host_texts * max_percent / 100 > F.sqrt(max_texts * texts)


def base_metrics(rows: DataFrame, min_words: int = MIN_WORDS,
                 max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """``rows`` (with a column text) plus the struct ``q``: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed; all within the row.

    ``n_repeat_words``: words covered by the ``WINDOW``-word windows whose hash
    occurs twice or more in the text. Only texts that do have a repeated window
    pay for the sort by (hash, start) that finds which ones."""
    w = with_words(rows, "w").withColumn("n", F.size("w").cast("long"))
    s = with_window_hashes(w, "w", "h").withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    p = s.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(
        F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"]))))
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_BLANK))
    r = p.withColumn("l", lines).withColumn("r", F.coalesce(covered, F.lit(0)).cast("long"))
    return r.withColumn("q", F.struct(
        F.col("n").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.size("l") - F.size(F.array_distinct("l")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.col("r").alias("n_repeat_words"),
        ((F.col("n") < min_words) | (100 * F.col("r") > max_repeat_percent * F.col("n"))).alias("base_failed"),
    )).select(*rows.columns, "q")


def line_table(rows: DataFrame) -> DataFrame:
    """One row per line with a word: (doc_id, tkey, host, pos, line, n)."""
    lines = rows.select("doc_id", "tkey", "host", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return (lines.withColumn("low", F.lower("raw")).withColumn("norm", normal_line(F.col("low"))).where("norm <> ''")
            .select("doc_id", "tkey", "host", "pos", F.xxhash64("norm").alias("line"),
                    (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).alias("n")))


def boilerplate(lines: DataFrame, rows: DataFrame, max_texts: int, max_percent: int) -> DataFrame:
    """(host, line) above the host's limit. The two-step distinct count
    pre-aggregates, so a line that a third of all documents hold is spread by
    text first and then reaches its group as one row a task."""
    counts = (lines.select("host", "line", "tkey").distinct()
              .groupBy("host", "line").agg(F.count("*").alias("texts")).where(F.col("texts") > max_texts))
    hosts = (rows.select(F.col("host").alias("of"), "tkey").distinct()
             .groupBy("of").agg(F.count("*").alias("host_texts")))
    return (counts.join(hosts, counts["host"].eqNullSafe(hosts["of"]))
            .where(is_boilerplate(F.col("texts"), F.col("host_texts"), max_texts, max_percent))
            .select("host", "line"))


def line_hits(rows: DataFrame, max_texts: int, max_percent: int) -> DataFrame:
    """Per document with boilerplate lines: (doc_id, tkey, host, removed words,
    bad: its boilerplate line hashes). Both sides of the join are written
    tables, so a very common line is split by the adaptive skew join."""
    lines = written(line_table(rows), "quality-lines")
    above = written(boilerplate(lines, rows, max_texts, max_percent), "quality-above")
    b = above.select(F.col("host").alias("bhost"), F.col("line").alias("bline"))
    hit = lines.join(b, (F.col("line") == F.col("bline")) & F.col("host").eqNullSafe(F.col("bhost")))
    return (hit.select("doc_id", "tkey", "host", "pos", "line", "n").distinct()
            .groupBy("doc_id", "tkey", "host").agg(F.sum("n").alias("removed"), F.collect_set("line").alias("bad")))


def _rows(docs: DataFrame, host: str) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", F.col(host).alias("host"),
                       text_key().alias("tkey"))


def _same(tag: str) -> Column:
    return (F.col("tkey") == F.col(f"{tag}key")) & F.col("doc_id").eqNullSafe(F.col(f"{tag}id")) \
        & F.col("host").eqNullSafe(F.col(f"{tag}host"))


def _tagged(rows: DataFrame, tag: str, *cols: str) -> DataFrame:
    return rows.select(F.col("doc_id").alias(f"{tag}id"), F.col("tkey").alias(f"{tag}key"),
                       F.col("host").alias(f"{tag}host"), *cols)


def _verdicts(rows: DataFrame, max_texts: int, max_percent: int, min_kept_percent: int, min_words: int,
              max_repeat_percent: int) -> DataFrame:
    """Per row: doc_id, tkey, host, q, removed, bad, kept. No text is shuffled.
    The metrics are written first: a filter on what follows from them would
    otherwise be pushed below and copy their expressions many times over."""
    hits = line_hits(rows, max_texts, max_percent)
    base = written(base_metrics(rows, min_words, max_repeat_percent).drop("text"), "quality-base")
    left = F.col("q.n_words") - F.coalesce("removed", F.lit(0))
    return base.join(_tagged(hits, "h", "removed", "bad"), _same("h"), "left").select(
        "doc_id", "tkey", "host", "q", F.coalesce("removed", F.lit(0)).cast("long").alias("removed"), "bad",
        (~F.col("q.base_failed") & (100 * left >= min_kept_percent * F.col("q.n_words"))).alias("kept"))


def quality_report(docs: DataFrame, host: str = "source", max_texts: int = MAX_LINE_TEXTS,
                   max_percent: int = MAX_LINE_PERCENT, min_kept_percent: int = MIN_KEPT_PERCENT,
                   min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, the base metrics, n_removed_words (words on
    boilerplate lines) and kept."""
    return _verdicts(_rows(docs, host).drop("row"), max_texts, max_percent, min_kept_percent, min_words,
                     max_repeat_percent).select("doc_id", "q.*", F.col("removed").alias("n_removed_words"), "kept")


def quality_filter(docs: DataFrame, host: str = "source", max_texts: int = MAX_LINE_TEXTS,
                   max_percent: int = MAX_LINE_PERCENT, min_kept_percent: int = MIN_KEPT_PERCENT,
                   min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The documents that pass, all columns of ``docs``, their text without its
    boilerplate lines (other lines, blank ones included, as they were)."""
    rows = _rows(docs, host)
    verdicts = _verdicts(rows.drop("row"), max_texts, max_percent, min_kept_percent, min_words, max_repeat_percent)
    passed = _tagged(verdicts.where("kept").dropDuplicates(["doc_id", "tkey", "host"]), "v", "bad")
    text = F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(F.filter(
        F.split("text", "\n"), lambda x: ~F.array_contains("bad", F.xxhash64(normal_line(F.lower(x))))), "\n"))
    return (rows.join(passed, _same("v")).select("row", text.alias("clean"))
            .select(*[F.col("clean").alias("text") if c == "text" else F.col("row").getField(c).alias(c)
                      for c in docs.columns]))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir))


OP10_SQL = f"""
with d as (
  select doc_id, source, text,
         [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] w
  from documents),
win as (
  select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') g
  from (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) i from d where len(w) >= {WINDOW})),
rep as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) c from win) where c > 1),
cov as (
  select doc_id, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) n_repeat_words
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) nx from rep) group by doc_id),
raw as (select doc_id, source, text, unnest(string_split(text, chr(10))) line from documents),
ln as (
  select doc_id, source, text, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) norm
  from raw where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct line) n_dup_lines from ln group by doc_id),
hosts as (select source, count(distinct coalesce(text, chr(1))) texts from documents group by source),
above as (
  select l.source, l.norm from (select source, norm, count(distinct text) c from ln group by source, norm) l
  join hosts h on h.source is not distinct from l.source
  where c - texts * {MAX_LINE_PERCENT} / 100 > sqrt({MAX_LINE_TEXTS} * c)),
rem as (
  select doc_id, sum(len(string_split(l.norm, ' '))) n_removed_words
  from ln l join above a on a.norm = l.norm and a.source is not distinct from l.source group by doc_id),
base as (
  select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
         coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words,
         coalesce(n_removed_words, 0)::bigint n_removed_words
  from d left join cov using (doc_id) left join dup using (doc_id) left join rem using (doc_id)),
failed as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       not base_failed and 100 * (n_words - n_removed_words) >= {MIN_KEPT_PERCENT} * n_words kept
from failed
"""
