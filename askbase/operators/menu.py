"""Daily menu answer (H5) over a table of page snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from askbase import constants as K
from askbase.functions import markup as H
from askbase.operators.sizing import sized_broadcast
from askbase.session import scratch_path


def daily_menu(pages: DataFrame, html_col: str = "html", container=K.MENU_CONTAINER,
               row_tag: str = "tr", cell_tag: str = "td") -> DataFrame:
    """H1 -> H4 per page: ``menu`` text, or the fixed sentence when the page
    has no container; ``menu_error`` flags a one-cell row (the reference
    raises there, we keep the row and report it)."""
    # one reading of the page; the answers below are taken from its rows
    rows = H.html_container_cells(html_col, *container, row_tag, cell_tag)
    read = F.transform(F.array(H.trim_header_footer(rows)), lambda r: F.struct(
        F.when(r.isNull(), F.lit(K.MENU_UNAVAILABLE)).otherwise(H.menu_text(r)).alias("menu"),
        F.when(r.isNotNull(), H.menu_error(r)).alias("error")))[0]
    out = pages.withColumn("_menu", read)
    return out.withColumn("menu", F.col("_menu.menu")).withColumn("menu_error", F.col("_menu.error")).drop("_menu")


class MenuTable:
    """``menu_date, menu`` as a lookup: the pages behind it are read once, whatever
    is asked of the table, and its size is taken from the result."""

    def __init__(self, menus: DataFrame):
        path = scratch_path(menus.sparkSession, "menus")
        menus.select("menu_date", "menu").write.parquet(path)
        self.df = sized_broadcast(menus.sparkSession.read.parquet(path))
