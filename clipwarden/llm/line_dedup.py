"""Site-relative line dedup: lines on too large a share of a host's pages go.

The share of a line is the number of pages of the host that contain it, divided
by all pages of the host.  A host has at most ``lines per page / ratio`` lines
above the ratio, so what is joined back is one short list per host.  Where the
lists are small Spark broadcasts them and no page moves; otherwise the pages of
a large host are dealt by (host, part) and its list is repeated once per part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import stored

RATIO = 0.3
MIN_PAGES = 3
#: hosts with more than this share of all pages are dealt in parts, so there are fewer than 1 / share of them
LARGE_SHARE = 0.001
PART_PAGES = 2000

INVISIBLE = r"(?is)<!--.*?-->|<(script|style|head)\b.*?</(script|style|head)>"
BLOCK_TAG = r"(?i)</?(p|div|li|ul|ol|nav|article|section|header|footer|main|aside|h[1-6]|table|tr|td|th|br|hr|body|html|blockquote|pre)\b[^>]*>|[\r\n]+"
ANY_TAG = r"<[^>\n]*>"
BLANKS = " \t"


def html_lines(html: Column) -> Column:
    """Visible lines: block tags and line ends separate, other tags vanish, blanks at the ends go."""
    visible = F.regexp_replace(F.coalesce(html, F.lit("")), INVISIBLE, "\n")
    # over the whole text, as a pattern per line costs more than the line itself
    separated = F.regexp_replace(F.regexp_replace(visible, BLOCK_TAG, "\n"), ANY_TAG, "")
    return F.array_remove(F.transform(F.split(separated, "\n"), lambda p: F.trim(p, F.lit(BLANKS))), "")


def text_lines(text: Column) -> Column:
    """Lines of plain text without blanks at the ends; empty lines vanish."""
    return F.array_remove(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda p: F.trim(p, F.lit(BLANKS))), "")


def url_host(url: Column) -> Column:
    """Host of an address in lower case, without user, port and a leading ``www.``; empty for others."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def drop_site_lines(
    pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, prefix: str = ""
) -> DataFrame:
    """Adds ``host``, ``host_pages``, ``n_lines``, ``kept`` (the lines that stay, in order) and ``n_dropped``.

    A line goes if its host has at least ``min_pages`` pages and more than
    ``ratio`` of them contain it.  Pages without a host form one site of their
    own (the empty host); null texts have no lines; repeated pages count as
    pages.  ``prefix`` keeps the new names apart from columns of ``pages``.
    Parts go by a hash of the row, so pages of one host are spread unless they
    agree in every column.
    """
    name = {n: prefix + n for n in ("host", "host_pages", "n_lines", "kept", "n_dropped")}
    with_host = pages.withColumns({name["host"]: F.coalesce(host, F.lit("")), "_cw_lines": lines})
    base = with_host.select(F.col(name["host"]).alias("_cw_h"), F.transform("_cw_lines", lambda x: F.xxhash64(x)).alias("_cw_keys"))
    seen = base.select(
        "_cw_h", F.explode(F.array_distinct(F.coalesce("_cw_keys", F.array().cast("array<long>")))).alias("_cw_key")
    ).groupBy("_cw_h", "_cw_key").agg(F.count(F.lit(1)).alias("_cw_pages"))
    # reads the hosts alone, so the lines are parsed once for both counts
    totals = base.groupBy("_cw_h").agg(F.count(F.lit(1)).alias("_cw_all"))
    common = (
        seen.filter(F.col("_cw_pages") >= 2).join(totals, "_cw_h")
        .filter((F.col("_cw_all") >= min_pages) & (F.col("_cw_pages") > F.lit(float(ratio)) * F.col("_cw_all")))
        .groupBy("_cw_h").agg(F.collect_list("_cw_key").alias("_cw_drop"))
    )
    lists = stored(totals.join(common, "_cw_h", "left"))
    n_pages = lists.agg(F.sum("_cw_all")).first()[0] or 0
    parts = F.when(F.col("_cw_all") > LARGE_SHARE * n_pages, F.ceil(F.col("_cw_all") / PART_PAGES)).otherwise(1).cast("int")
    lists = lists.withColumn("_cw_parts", parts)
    # fewer than 1 / LARGE_SHARE rows
    large = F.broadcast(lists.filter("_cw_parts > 1").select(F.col("_cw_h").alias(name["host"]), "_cw_parts"))
    hashed = [c for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = with_host.join(large, name["host"], "left").withColumn(
        "_cw_part", F.when(F.col("_cw_parts") > 1, F.pmod(F.xxhash64(*hashed), F.col("_cw_parts"))).otherwise(0).cast("int")
    ).drop("_cw_parts")
    repeated = lists.withColumn("_cw_part", F.explode(F.sequence(F.lit(0), F.col("_cw_parts") - 1))).drop("_cw_parts")
    keep = F.filter("_cw_lines", lambda x: ~F.coalesce(F.array_contains("_cw_drop", F.xxhash64(x)), F.lit(False)))
    kept = dealt.join(repeated.withColumnRenamed("_cw_h", name["host"]), [name["host"], "_cw_part"], "left").withColumn(
        name["kept"], F.coalesce(keep, F.array().cast("array<string>"))
    )
    n_lines = F.greatest(F.coalesce(F.size("_cw_lines"), F.lit(0)), F.lit(0))
    return kept.select(
        *[c for c in pages.columns], name["host"], F.col("_cw_all").alias(name["host_pages"]),
        n_lines.cast("long").alias(name["n_lines"]), name["kept"],
        (n_lines - F.size(name["kept"])).cast("long").alias(name["n_dropped"]),
    )
