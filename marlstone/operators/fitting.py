"""Fitting ordered content to a budget of lines: line units, page packing, pruning from the tail.

Line counting is a column expression. Packing goes item by item, as an item that is skipped adds nothing: it folds over an
ordered array. Pruning needs no such walk: sums over the rows in the order of leaving decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip


def text_lines(text: Column, per_line: int) -> Column:
    """Lines a text takes; an empty one takes one."""
    return F.ceil(F.greatest(F.length(F.trim(F.coalesce(text, F.lit("")))), F.lit(1)) / per_line).cast("bigint")


def line_units(items: DataFrame, by: str, per_line: int = 96) -> DataFrame:
    """``(by, line_units)``: of ``items(by, section, text, bullet)``, lines of all items, one more for each bullet and for each section."""
    lines = text_lines(F.col("text"), per_line) + F.col("bullet").cast("bigint")
    return items.groupBy(by, "section").agg((F.sum(lines) + 1).alias("n")).groupBy(by).agg(F.sum("n").alias("line_units"))


def pack_first_page(items: DataFrame, by: str, order: str, lines: str, base: int, per_page: int) -> DataFrame:
    """Adds ``page``: an item goes to page 1 if it is the first or still fits after what page 1 has taken; later items may
    fit where an earlier one did not."""
    rows = F.array_sort(F.collect_list(F.struct(order, lines)))
    start = F.struct(F.lit(base).cast("bigint").alias("used"), F.array().cast("array<int>").alias("pages"))

    def place(acc: Column, x: Column) -> Column:
        fits = (F.size(F.filter(acc["pages"], lambda p: p == 1)) == 0) | (acc["used"] + x[lines] <= per_page)
        return F.struct((acc["used"] + F.when(fits, x[lines]).otherwise(0)).cast("bigint").alias("used"), F.concat(acc["pages"], F.array(F.when(fits, 1).otherwise(2))).alias("pages"))

    packed = items.groupBy(by).agg(rows.alias("_rows")).withColumn("_p", F.aggregate("_rows", start, place)["pages"])
    return packed.select(by, F.inline(F.arrays_zip(F.transform("_rows", lambda x: x[order]).alias(order), F.col("_p").alias("page"))))


PRIORITY = ("certifications", "skills", "projects", "experience")


def prune(items: DataFrame, by: str, budget: int, least: dict[str, int] | None = None, per_line: int = 96) -> DataFrame:
    """Adds ``omitted`` and ``reason`` to ``items(by, section, pos, text, sticky)``.

    Over budget, items go from the tail, section by section in the order of PRIORITY; sticky ones and the least number of
    a section stay. Omission stops as soon as the rest fits. Lines count with one more for each section that has an item left.

    What may go in all is known beforehand: of a section the last items that aren't sticky, down to its least number. In the order of
    leaving, an item goes if what is over the budget is more than those before it free; so sums of the rows before it decide, and
    no document is held as a whole. Ties of ``pos`` leave in the order of text, the later first; null is not sticky; a null or
    other section loses nothing, a null one has no head; a null ``by`` is a document of its own; an empty table gives an empty one.
    """
    keep = least or {}
    lines = F.ceil(F.greatest(F.length(strip(F.coalesce("text", F.lit("")))), F.lit(1)) / per_line).cast("bigint")
    least_of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in keep.items() for x in (k, n)]), F.col("section")), F.lit(0)) if keep else F.lit(0)
    turn = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("section")), F.lit(0))
    tail = [F.col("pos").desc(), F.col("text").desc()]
    fixed = F.coalesce("sticky", F.lit(False))
    rows = items.select(F.struct(*items.columns).alias("_row"), F.col(by).alias("_by"), "section", "pos", "text", fixed.alias("_fixed"), lines.alias("_n"), turn.alias("_turn"), least_of.alias("_least"))
    sizes = rows.groupBy("_by", "section").agg(F.sum("_n").alias("n"), F.count("*").alias("_count"), F.count_if("_fixed").alias("_stay"))
    over = sizes.groupBy("_by").agg((F.sum("n") + F.count("section") - budget).alias("_over"), F.collect_list(F.struct("section", "_count", "_stay")).alias("_s"))
    per_section = over.filter("_over > 0").select("_by", "_over", F.inline("_s"))
    met = rows.join(per_section.select(*[F.col(c).alias(f"{c}2") for c in per_section.columns]), F.col("_by").eqNullSafe(F.col("_by2")) & F.col("section").eqNullSafe(F.col("section2")), "left")
    place = F.row_number().over(Window.partitionBy("_by", "section", "_fixed").orderBy(*tail))
    may = (F.col("_turn") > 0) & ~F.col("_fixed") & F.col("_over2").isNotNull() & (F.col("_place") <= F.col("_count2") - F.col("_least"))
    freed = F.when(F.col("_may"), F.col("_n") + ((F.col("_place") == F.col("_count2")) & (F.col("_stay2") == 0)).cast("bigint")).otherwise(0)
    before = F.coalesce(F.sum(freed).over(Window.partitionBy("_by").orderBy("_turn", "_fixed", "_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = met.withColumn("_place", place).withColumn("_may", may).withColumn("_before", before).withColumn("_out", F.col("_may") & (F.col("_over2") > F.col("_before")))
    return out.select("_row.*", F.col("_out").alias("omitted"), F.when(F.col("_out"), F.concat("section", F.lit(" cut to fit the budget"))).alias("reason"))


def contrast_checks(tokens: DataFrame) -> DataFrame:
    """Six rows for each of ``tokens(brand_id, primary, secondary, accent, surface, text, muted)``: ratio, threshold, passed."""
    from ..functions.color import contrast

    # Pairs, thresholds and names of the checks.
    specs = (
        ("text", "surface", 4.5, "body text on surface"), ("primary", "surface", 4.5, "primary headings on surface"), ("muted", "surface", 4.5, "muted text on surface"),
        ("surface", "primary", 4.5, "light text on primary areas"), ("surface", "secondary", 4.5, "light text on secondary areas"), ("accent", "surface", 3.0, "large/accent graphics on surface"),
    )
    row = lambda f, b, t, u: F.struct(F.col(f).alias("foreground"), F.col(b).alias("background"), F.bround(contrast(F.col(f), F.col(b)), 2).alias("ratio"), F.lit(t).alias("threshold"), F.lit(u).alias("use"))
    out = tokens.select("brand_id", F.inline(F.array(*[row(*s) for s in specs])))
    return out.withColumn("passed", F.col("ratio") >= F.col("threshold"))


def layout_issues(pages: DataFrame, width: float = 612.0, height: float = 792.0, slack: float = 2.0) -> DataFrame:
    """Issues of ``pages(doc_id, page, expected_pages, n_pages, width_pt, height_pt, n_overflow, n_orphans)``."""
    rules = [
        (F.col("n_pages") != F.col("expected_pages"), "page_count_mismatch"), (F.col("n_overflow") > 0, "overflow"), (F.col("n_orphans") > 0, "orphan_heading"),
        ((F.abs(F.col("width_pt") - width) > slack) | (F.abs(F.col("height_pt") - height) > slack), "page_size_mismatch"),
    ]
    return pages.select("doc_id", "page", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in rules]))).alias("code"))
