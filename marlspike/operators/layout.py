"""Page and table layout: columns by histogram, sections by heading, cells and rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(words: DataFrame, page: str, mid: Column, width: Column, buckets: int = 10) -> DataFrame:
    """page, bucket, n: words by the tenth of the page's width that their middle is in, empty tenths too."""
    b = F.least(F.greatest(F.floor(mid / (width / buckets)), F.lit(0)), F.lit(buckets - 1)).cast("int")
    counted = words.groupBy(page, b.alias("bucket")).agg(F.count("*").alias("n"))
    # partial counts are already one row per page and bucket: the array is bounded by the buckets
    filled = counted.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    return filled.select(page, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "m").select(page, "bucket", F.coalesce(F.try_element_at("m", F.col("bucket")), F.lit(0)).alias("n"))


def gaps(hist: DataFrame, page: str, share: float = 0.15, buckets: int = 10) -> DataFrame:
    """page, start, stop: runs of thin buckets inside the page, as bucket numbers (stop exclusive)."""
    peak = W.partitionBy(page)
    thin = hist.withColumn("peak", F.max("n").over(peak)).filter(F.col("n") <= F.col("peak") * share)
    runs = thin.withColumn("run", F.col("bucket") - F.row_number().over(W.partitionBy(page).orderBy("bucket")))
    found = runs.groupBy(page, "run").agg(F.min("bucket").alias("start"), (F.max("bucket") + 1).alias("stop")).drop("run")
    return found.filter((F.col("start") > buckets * 0.1) & (F.col("stop") < buckets * 0.9))


def columns(gap: DataFrame, page: str, pages: DataFrame, buckets: int = 10) -> DataFrame:
    """page, column, left, right: the spans between the middles of the gaps; a page of ``pages`` without gaps is one column."""
    edges = gap.groupBy(page).agg(F.array_sort(F.collect_list((F.col("start") + F.col("stop")) / 2.0)).alias("m"))
    edges = pages.select(page).distinct().join(edges, page, "left").withColumn("m", F.coalesce("m", F.array().cast("array<double>")))
    bounds = F.concat(F.array(F.lit(0.0)), F.col("m"), F.array(F.lit(float(buckets))))
    pairs = F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: F.struct(i.alias("column"), F.element_at(bounds, i).alias("left"), F.element_at(bounds, i + 1).alias("right")))
    return edges.select(page, F.explode(pairs).alias("c")).select(page, "c.column", "c.left", "c.right")


def column_text(words: DataFrame, page: str, spans: DataFrame) -> DataFrame:
    """page, text: the words (page, x, y, word) column by column, rows by y and x; columns are parted by a blank line."""
    placed = words.join(spans, page).filter((F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")))
    # one page's words: bounded by what fits on a page
    cols = placed.groupBy(page, "column").agg(F.array_sort(F.collect_list(F.struct("y", "x", "word"))).alias("w"))
    cols = cols.select(page, "column", F.array_join("w.word", " ").alias("t"))
    whole = cols.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("column", "t"))).alias("c"))
    return whole.select(page, F.array_join("c.t", "\n\n").alias("text"))


def page_text(first: Column, second: Column) -> Column:
    """The text of the first extractor, or of the second where the first gives none."""
    return F.coalesce(F.when(F.trim(F.coalesce(first, F.lit(""))) != "", first), second, F.lit(""))


def column_aware(linear: Column, by_columns: Column, n_words: Column, thin: Column, least: int = 25) -> Column:
    """The text by columns where the page has word boxes enough, isn't thin, and the columns give more."""
    better = (n_words >= least) & ~F.coalesce(thin, F.lit(True)) & (F.length(F.trim(by_columns)) > F.length(F.trim(linear)))
    return F.when(F.coalesce(better, F.lit(False)), by_columns).otherwise(linear)


def is_table_page(kind: Column, text: Column, least: int = 200) -> Column:
    """Whether tables are looked for on a page: a PDF page with text enough."""
    return F.coalesce((kind == "pdf") & (F.length(text) >= least), F.lit(False))


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def sections(blocks: DataFrame, doc: str, number: str, key: str, is_heading: Column, block: int = 4096) -> DataFrame:
    """Blocks with ``section``: a heading begins a new one; what stands before the first is section 0.

    ``number`` orders a document, ``key`` breaks ties. Headings are counted in runs of ``block`` numbers and the
    runs' totals added up, so a long document is spread over many tasks.
    """
    flagged = blocks.withColumns({"__h": F.coalesce(is_heading, F.lit(False)).cast("int"), "__b": F.floor(F.coalesce(number, F.lit(0)) / block)})
    upto = W.partitionBy(doc, "__b").orderBy(number, key).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = flagged.groupBy(doc, "__b").agg(F.sum("__h").alias("n"))
    before = W.partitionBy(doc).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    handed = totals.select(F.col(doc).alias("__d"), F.col("__b").alias("__c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"))
    joined = flagged.withColumn("__s", F.sum("__h").over(upto)).join(handed, F.col(doc).eqNullSafe(F.col("__d")) & (F.col("__b") == F.col("__c")), "left")
    return joined.withColumn("section", F.col("__s") + F.col("__n")).drop("__h", "__b", "__s", "__d", "__c", "__n")


def rolling(blocks: DataFrame, by: list[str], order: list[str], text: str, n: int = 5, section: str | None = None) -> DataFrame:
    """Blocks with ``context``: the last n texts up to each, joined by line ends.

    With ``section`` (of ``sections``) the context begins anew at every heading, which is its first text.
    """
    w = W.partitionBy(*by, *([section] if section else [])).orderBy(*order).rowsBetween(-(n - 1), 0)
    return blocks.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def first_only(cells: DataFrame, cell: list[str], order: list[str], text: str) -> DataFrame:
    """Merged cells: the first keeps its text, the repeats are blank."""
    n = F.row_number().over(W.partitionBy(*cell).orderBy(*order))
    return cells.withColumn(text, F.when(n == 1, F.col(text)).otherwise(F.lit("")))


def markdown(rows: DataFrame, table: str, row: str, cells: str) -> DataFrame:
    """table, markdown: rows of cells as a Markdown table, ragged ones filled with blanks."""
    width = rows.groupBy(table).agg(F.max(F.size(cells)).alias("width"))
    filled = F.concat(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), F.col("width") - F.size(cells)))
    line = F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))
    lines = rows.join(width, table).groupBy(table, "width").agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), line.alias("l")))).alias("x"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    body = F.col("x.l")
    return lines.select(table, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, 1_000_000)), "\n").alias("markdown"))


def row_text(cells: Column) -> Column:
    """Row: a | b …, without blanks and bars at the ends."""
    return F.regexp_replace(F.concat(F.lit("Row: "), F.array_join(cells, " | ")), r"[ |]+$", "")


def weighted_mean(df: DataFrame, by: list[str], value: Column, weight: Column, keep: Column, digits: int = 2) -> DataFrame:
    """Weighted mean of the kept rows, half-even rounded; 0 where no weight is kept."""
    total = F.sum(F.when(keep, weight))
    return df.groupBy(*by).agg(F.coalesce(F.bround(F.try_divide(F.sum(F.when(keep, value * weight)), F.nullif(total, F.lit(0))), digits), F.lit(0.0)).alias("mean"), F.coalesce(total, F.lit(0)).alias("weight"))
