"""Counter items of wiki pages: the right sections, list lines and the items that open them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import text as tx


def counter_lines(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, text): list lines of "Items" inside "Bad against"."""
    bad = pages.select(key, F.explode(tx.sections(F.col(text), 2)).alias("s")).where(F.lower("s.title").startswith("bad against"))
    items = bad.select(key, F.explode(tx.sections(F.col("s.body"), 3)).alias("s")).where(F.lower("s.title").startswith("item"))
    lines = F.filter(F.transform(F.split("s.body", "\n"), lambda x: F.trim(x)), lambda x: x.startswith("*"))
    return items.select(key, F.posexplode(lines).alias("line", "text"))


def lead_items(lines: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """(keys, pos, item): items that open each line, up to the first word, other template or unknown link.

    ``known`` is (item: normalised name). A line's tokens are few; the names are joined, so the
    dictionary may be of any size.
    """
    tokens = lines.select(*keys, F.posexplode(tx.lead_tokens(F.col("text"))).alias("pos", "token"))
    named = tokens.select(
        *keys, "pos", tx.normal_name(tx.token_name(F.col("token"))).alias("item"),
        F.col("token").startswith("[[").alias("is_link"), tx.is_other_template(F.col("token")).alias("is_other"),
    )
    j = named.join(known.select("item", F.lit(True).alias("known")), "item", "left")
    bad = F.col("is_other") | (F.col("is_link") & F.col("known").isNull())
    stop = F.min(F.when(bad, F.col("pos"))).over(Window.partitionBy(*keys))
    kept = j.withColumn("stop", stop).where((F.col("stop").isNull() | (F.col("pos") < F.col("stop"))) & (F.col("item") != ""))
    return kept.select(*keys, "pos", "item")
