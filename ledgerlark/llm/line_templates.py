"""Line dedup by a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line goes by its number of words and its ``DEPTH`` leading words (words
with a digit count as ``<*>``) to a leaf.  Within a leaf, a word that stands at its position in lines of
fewer than ``min_docs`` different texts is a variable field, ``<*>``; what stays is the line's template.

A template recurs if at least ``MIN_CONSTANT`` of its words are constant and texts of at least ``min_docs``
families have it, wherever it stands: between blank lines, inside a fixed block, on pages that it mostly fills.  A line
resembles another if their first or their last ``ENDS`` words are equal.  A text with ``COPIED`` percent or more of its characters
in lines that resemble lines of other texts is a copy; copies that share most of these line ends are one family, any
other text is a family of its own.  So the lines of copied and slightly edited documents do not count as
boilerplate and are left to document-level dedup, and copies neither make nor hide a template.  A page whose own lines
are under 20 percent of it counts as a copy of the others of its kind.

Only leaves that lines of ``min_docs`` texts reach are generalised, so words are exploded for the few
lines that may recur.  Every count is a sum of pre-aggregated distinct rows: a line that a third of
all documents hold is one row per document at most, and one row per task after partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import keep_table

DEPTH, MIN_DOCS, MIN_CONSTANT, ENDS, COPIED = 3, 8, 0.5, 6, 80
_SPACE = " \t\x0b\f\r"


def _masked(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), F.lit("<*>")).otherwise(word)


def _numbered_lines(docs: DataFrame) -> DataFrame:
    """(key, text_key, line_no, line) of every line that is not blank."""
    lines = docs.where("text is not null").select(
        "key", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.trim("line", F.lit(_SPACE))).where("line <> ''")


def _leaf(line: Column) -> Column:
    words = F.split(line, r"[\x20\x09-\x0D]+")
    return F.xxhash64(F.size(words), *[_masked(F.get(words, F.lit(i))) for i in range(DEPTH)])


def _with_key(docs: DataFrame) -> DataFrame:
    """Text rows with a key: rows of one key have equal doc_id and text, and equal results."""
    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .withColumn("key", F.xxhash64("doc_id", "text")))


def _ends(line: Column) -> tuple[Column, ...]:
    """Hashes (60 bits of MD5, which SQL has, too) of the first and the last ``ENDS`` words."""
    words = F.split(line, r"[\x20\x09-\x0D]+")
    ends = (F.concat(F.lit("<"), F.array_join(F.slice(words, 1, ENDS), " ")),
            F.concat(F.lit(">"), F.array_join(F.slice(words, F.greatest(F.size(words) - (ENDS - 1), F.lit(1)), ENDS), " ")))
    return tuple(F.conv(F.substring(F.md5(e), 1, 15), 16, 10).cast("long") for e in ends)


def _families(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(text_key, family) of the copies among ``texts(text_key)``.

    A copy starts in the family of its least shared line end, so a family has few starts, however many copies; then an
    end gets the start that most of its copies have, and a copy the one that most of its characters have."""
    first, last = _ends(F.col("line"))
    lines = (_numbered_lines(docs).select("text_key", F.xxhash64("line").alias("line_key"), F.length("line").alias("chars"),
                                          first.alias("first"), last.alias("last"))
             .groupBy("text_key", "line_key").agg(*[F.min(c).alias(c) for c in ("chars", "first", "last")]))
    lines = keep_table(lines.join(texts, "text_key"), "line_ends")
    ends = lines.select("text_key", "line_key", "chars", F.explode(F.array("first", "last")).alias("end"))
    shared = (ends.groupBy("end").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most"))
              .where("least <> most").select("end"))
    marked = keep_table(ends.join(shared, "end"), "shared_ends")
    common = (marked.groupBy("text_key", "line_key").agg(F.min("chars").alias("chars"), F.min("end").alias("end"))
              .groupBy("text_key").agg(F.sum("chars").alias("common"), F.min("end").alias("start")))
    copies = (lines.groupBy("text_key").agg(F.sum("chars").alias("all")).join(common, "text_key")
              .where(100 * F.col("common") >= COPIED * F.col("all")).select("text_key", "start"))
    held = keep_table(marked.groupBy("text_key", "end").agg(F.sum("chars").alias("chars"))
                      .join(copies, "text_key"), "copied_ends")
    named = (held.groupBy("end", "start").agg(F.count("*").alias("n")).groupBy("end")
             .agg(F.max_by("start", F.struct("n", "start")).alias("name"), F.max("n").alias("most"), F.sum("n").alias("n"))
             .where("2 * most > n").select("end", "name"))
    return (held.join(named, "end", "left").groupBy("text_key", "start", "name").agg(F.sum("chars").alias("chars"))
            .groupBy("text_key", "start")
            .agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("chars", "name"))).alias("name"))
            .select("text_key", F.coalesce("name", "start").alias("family")))


def _recurring(docs: DataFrame, placed: DataFrame, min_docs: int) -> DataFrame:
    holders = placed.select("template_key", "text_key").distinct()
    often = holders.groupBy("template_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template_key")
    holders = keep_table(holders.join(often, "template_key"), "holders")
    families = _families(docs, holders.select("text_key").distinct())
    return (holders.join(families, "text_key", "left")
            .select("template_key", F.col("family").isNull().alias("own"), F.coalesce("family", "text_key").alias("family"))
            .distinct().groupBy("template_key").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_docs).select("template_key"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, line_no, template) of every line whose template recurs; ``docs`` has key and text."""
    lines = _numbered_lines(docs).withColumn("leaf", _leaf(F.col("line")))
    leaves = keep_table(lines.select("leaf", "text_key").distinct().groupBy("leaf").agg(F.count("*").alias("n"))
                        .where(F.col("n") >= min_docs).select("leaf"), "leaves")
    hits = keep_table(lines.join(leaves, "leaf").withColumn("line_key", F.xxhash64("line")), "hits")
    distinct = keep_table(hits.groupBy("leaf", "line_key", "text_key").agg(F.min("line").alias("line"))
                          .groupBy("leaf", "line_key").agg(F.min("line").alias("line"), F.count("*").alias("texts")),
                          "lines")
    words = (distinct.select("leaf", "line_key", "texts", F.posexplode(F.split("line", r"[\x20\x09-\x0D]+")))
             .select("leaf", "line_key", "texts", "pos", _masked(F.col("col")).alias("word")))
    constant = keep_table(words.where("word <> '<*>'").groupBy("leaf", "pos", "word")
                          .agg(F.sum("texts").alias("n")).where(F.col("n") >= min_docs)
                          .select("leaf", "pos", "word", F.lit(True).alias("constant")), "constant")
    templates = keep_table(
        words.join(constant, ["leaf", "pos", "word"], "left")
        .withColumn("word", F.when(F.col("constant"), F.col("word")).otherwise("<*>"))
        .groupBy("leaf", "line_key").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("cells"))
        .withColumn("constants", F.size(F.filter("cells", lambda c: c["word"] != "<*>")))
        .where(F.col("constants") >= MIN_CONSTANT * F.size("cells"))
        .select("leaf", "line_key", F.array_join(F.col("cells.word"), " ").alias("template")), "templates")
    placed = keep_table(hits.join(templates, ["leaf", "line_key"])
                        .select("key", "text_key", "line_no", "template",
                                F.xxhash64("template").alias("template_key")), "placed")
    recurring = keep_table(_recurring(docs, placed, min_docs), "recurring")
    return placed.join(recurring, "template_key").select("key", "line_no", "template")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, text, n_lines, n_dropped) without the lines of recurring templates.

    Lines end at ``\\n``; blank lines stay.  A null text stays null with no lines, an empty text is one blank
    line.  Equal rows get equal results; rows count as different texts only if their texts differ.
    Lines of very long texts are rows like all others.  Only ``doc_id`` and ``text`` are read; an empty table gives an
    empty result.
    """
    keyed = _with_key(docs)
    drop = recurring_lines(keyed, min_docs).groupBy("key").agg(F.collect_set("line_no").alias("drop"))
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n")
    return (keyed.join(drop, "key", "left")
            .select("doc_id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"),
                    F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.array_size("drop"), F.lit(0)).cast("long").alias("n_dropped")))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines of recurring templates removed from ``text``; all rows and columns stay."""
    clean = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__drop", i)), "\n")
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", F.col("text").cast("string")))
    drop = (recurring_lines(_with_key(docs), min_docs).groupBy(F.col("key").alias("__drop_key"))
            .agg(F.collect_set("line_no").alias("__drop")))
    return (keyed.join(drop, keyed["__key"] == drop["__drop_key"], "left")
            .withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(clean))
            .drop("__key", "__drop_key", "__drop"))
