"""Reports: matched and unmatched rows, image validation as HTML, table counts, and rows at the edge of a program."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import escape_html, first_filled


def match_report(rows: DataFrame, names: Column) -> DataFrame:
    """One row: sample_size, matched and unmatched by whether the array of names has any."""
    has = F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0
    return rows.agg(F.count("*").alias("sample_size"), F.count_if(has).alias("matched"), F.count_if(~has).alias("unmatched"))


def markdown_line(*cells: Column) -> Column:
    """A row of a Markdown table; bars in cells are escaped, null cells empty."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]), F.lit(" |"))


def image_cards(images: DataFrame, store: str, names: list[Column]) -> DataFrame:
    """store, n_keep, n_drop, html of images(store, url, alt, image_group, decision, reason): kept cards before others.

    The heading is the first of the names that isn't blank, else the store's id, else Unknown.
    """
    kept = F.col("decision") == "keep"
    caption = F.when(kept, F.coalesce("image_group", F.lit(""))).otherwise(F.coalesce("reason", F.lit("")))
    card = F.concat(F.lit('<figure class="'), F.col("decision"), F.lit('"><img src="'), escape_html(F.coalesce("url", F.lit(""))), F.lit('" alt="'), escape_html(F.coalesce("alt", F.lit(""))), F.lit('" /><figcaption>'), escape_html(caption), F.lit("</figcaption></figure>"))
    title = F.coalesce(first_filled(*names, F.col(store).cast("string")), F.lit("Unknown"))
    each = images.select(F.col(store), title.alias("title"), kept.alias("kept"), F.struct((~kept).alias("late"), "url", card.alias("card")).alias("card"))
    grouped = each.groupBy(store).agg(F.min("title").alias("title"), F.count_if("kept").alias("n_keep"), F.count_if(~F.col("kept")).alias("n_drop"), F.sort_array(F.collect_list("card")).alias("cards"))
    html = F.concat(F.lit("<section><h2>"), escape_html(F.col("title")), F.lit("</h2>"), F.array_join("cards.card", ""), F.lit("</section>"))
    return grouped.select(store, "n_keep", "n_drop", html.alias("html"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n: a count a table."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = each[0]
    for df in each[1:]:
        out = out.unionByName(df)
    return out


def at_edge(rows: DataFrame) -> Iterator[Row]:
    """Rows one after another for a consumer outside Spark; the driver holds a partition at a time, never the table."""
    yield from rows.toLocalIterator(prefetchPartitions=True)
