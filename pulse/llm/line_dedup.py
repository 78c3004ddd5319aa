"""Operator 4, line dedup: site-relative line frequency.

Rows are grouped by host.  A line's ratio is the number of the host's pages that
hold it over the number of the host's pages; lines on at least ``MIN_PAGES`` pages
with a ratio above ``RATIO`` are boilerplate and are removed from every page of
that host.  Lines are compared trimmed of spaces; empty lines are kept.

The lines of a page are hashed and made distinct within the row, then counted with
a map-side partial sum, so a host with a third of all pages, or a line on all of
them, reaches the shuffle as one row a task.  A host has at most (lines per
page / ``RATIO``) boilerplate lines; their table is broadcast if it has been counted and found
small, else joined on (host, salt), a large host's pages being dealt over
``SALTS`` parts.

Null hosts form one host.  Null texts stay null and count as pages without lines; a text
may become empty.  Repeated rows count as pages each.  All columns are passed on; ``text_col``
(and ``length_col``, if given) are rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm.common import read_table, write_shared

RATIO, MIN_PAGES = 0.1, 5
BROADCAST_LINES = 200_000      # boilerplate hashes that are broadcast at most: 1.6 MB
SALTS = 32


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """_host, _lines: the hashes of each host's boilerplate lines."""
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    hashed = pages.select(F.col(host_col).alias("_host"), F.explode(F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))).alias("_h"))
    frequent = hashed.groupBy("_host", "_h").agg(F.count("*").alias("_on")).filter(F.col("_on") >= min_pages)
    total = pages.groupBy(F.col(host_col).alias("_of")).agg(F.count("*").alias("_pages"))
    return (frequent.join(total, F.col("_host").eqNullSafe(F.col("_of"))).filter(F.col("_on") > ratio * F.col("_pages"))
            .groupBy("_host").agg(F.sort_array(F.collect_list("_h")).alias("_lines")))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", length_col: str | None = None,
                     ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` without their boilerplate lines, and ``_n_lines``, ``_n_dropped``."""
    names = [c for c in pages.columns]
    found = write_shared(boilerplate(pages, host_col, text_col, ratio, min_pages), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("_lines")), F.lit(0))).first()[0]
    if size <= BROADCAST_LINES:
        joined = pages.join(F.broadcast(found), F.col(host_col).eqNullSafe(F.col("_host")), "left")
    else:
        salted = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = pages.withColumn("_salt", F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, F.col(host_col).eqNullSafe(F.col("_host")) & (F.col("_salt") == F.col("_part")), "left")
    split = F.split(F.col(text_col), "\n")
    bad = F.coalesce(F.col("_lines"), F.array().cast("array<bigint>"))
    kept = joined.withColumn("_kept", F.filter(split, lambda x: (F.trim(x) == "") | ~F.array_contains(bad, F.xxhash64(F.trim(x)))))
    kept = kept.withColumn("_n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("long"))
    kept = kept.withColumn("_n_dropped", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("_n_lines") - F.size("_kept")).cast("long"))
    text = F.when(F.col("_n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col(text_col))
    out = kept.withColumn(text_col, text)
    if length_col:
        length = F.char_length(F.col(text_col)).cast(pages.schema[length_col].dataType)
        out = out.withColumn(length_col, F.when(F.col("_n_dropped") > 0, length).otherwise(F.col(length_col)))
    return out.select(*names, "_n_lines", "_n_dropped")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate of its source."""
    cleaned = drop_boilerplate(read_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "source", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, without the boilerplate lines of their source."""
    return drop_boilerplate(docs, length_col="n_chars").drop("_n_lines", "_n_dropped")


ORACLE_SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
lines AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages WHERE text IS NOT NULL),
frequent AS (SELECT source, trim(line) AS line, count(DISTINCT r) AS pages_with FROM lines
             WHERE trim(line) <> '' GROUP BY 1, 2 HAVING count(DISTINCT r) >= {MIN_PAGES}),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY 1),
bad AS (SELECT f.source, f.line FROM frequent f JOIN totals t ON f.source IS NOT DISTINCT FROM t.source
        WHERE f.pages_with > {RATIO} * t.n),
marked AS (SELECT l.r, l.i, l.line, b.line IS NOT NULL AS drop_it FROM lines l
           LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line) = b.line),
cleaned AS (SELECT r, count(*) AS n_lines, count(*) FILTER (drop_it) AS n_dropped,
                   coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop_it), '') AS text FROM marked GROUP BY r)
SELECT p.doc_id, p.source, c.text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped
FROM pages p LEFT JOIN cleaned c ON p.r = c.r"""
