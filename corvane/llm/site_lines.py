"""Problem 7: lines that the pages of one site share.

Pages are numbered so that those of a site lie together, and each line keeps
the pages it stands on as a compressed bitmap: a page number's upper bits name
a container, its lower 15 bits a place in it; a container is a list of 16-bit
places or, where that is smaller, a bit string. Lines that differ only in case,
digits and signs are variants; each has bitmaps of its own, and those of the
variants of one line are united. Cardinalities are exact. A page's lines are
deleted by what the bitmaps of its site hold at its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.urls import page_of, site_of
from corvane.session import cut_lineage

PLACES = 15
#: Above so many places a bit string of 4,096 bytes is smaller than a list.
DENSE = 2048


def hashed_pages(documents: DataFrame, min_letters: int = 15) -> DataFrame:
    """(fetch_id, site, page, lines): of every row with markdown its lines with enough letters, as (n, v, k1, k2).

    ``v`` is a hash of the line as written, (k1, k2) one of its letters; only
    hashes leave the scan.
    """
    page = page_of()
    letters = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}]+", "")
    cut = F.transform(F.split("markdown", "\n", -1), lambda x, i: F.struct(i.alias("n"), F.xxhash64(x).alias("v"), letters(x).alias("l")))
    held = F.transform(F.filter(cut, lambda s: F.length(s["l"]) >= min_letters), lambda s: F.struct(s["n"].alias("n"), s["v"].alias("v"), F.xxhash64(s["l"]).alias("k1"), F.xxhash64(F.lit(5), s["l"]).alias("k2")))
    return documents.where("markdown is not null").select("fetch_id", F.coalesce(site_of(page), F.lit("")).alias("site"), page.alias("page"), held.alias("lines"))


def numbered(rows: DataFrame) -> DataFrame:
    """(site, page, page_no): every page of rows (site, page); numbers are written once, so that a lost executor can't change them."""
    pages = rows.select("site", "page").distinct()
    return cut_lineage(pages.repartitionByRange("site", "page").sortWithinPartitions("site", "page").withColumn("page_no", F.monotonically_increasing_id()))


def _on_page(rows: DataFrame, other: DataFrame) -> DataFrame:
    """A join on (site, page), where a page may be null."""
    o = other.withColumnsRenamed({"site": "o_site", "page": "o_page"})
    return rows.join(o, (rows.site == o.o_site) & rows.page.eqNullSafe(o.o_page)).drop("o_site", "o_page")


def bitmaps(lines: DataFrame) -> DataFrame:
    """(site, k1, k2, container, places): the pages of lines (site, page_no, v, k1, k2), the variants' bitmaps united; a container has at most 32,768 places."""
    line = ["site", "k1", "k2", "container"]
    place = F.col("page_no").bitwiseAND((1 << PLACES) - 1).cast("smallint")
    each = lines.withColumn("container", F.shiftright("page_no", PLACES)).repartition(*line)
    variant = each.groupBy(*line, "v").agg(F.collect_set(place).alias("places"))
    return variant.groupBy(*line).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def compressed(held: DataFrame) -> DataFrame:
    """Containers (..., places) as (..., places, bits): the places of a dense one are given as a bit string instead."""
    keys = [c for c in held.columns if c != "places"]
    bits = held.where(F.size("places") > DENSE).select(*keys, F.explode("places").alias("at")).groupBy(*keys).agg(F.bitmap_construct_agg(F.col("at").cast("bigint")).alias("bits"))
    few = held.where(F.size("places") <= DENSE).withColumn("bits", F.lit(None).cast("binary"))
    return few.unionByName(bits.withColumn("places", F.lit(None).cast("array<smallint>")))


def places_of(places: Column, bits: Column) -> Column:
    """The places of a compressed container, in any order."""
    byte = lambda i: F.conv(F.hex(F.substring(bits, F.shiftright(i, 3) + 1, F.lit(1))), 16, 10).cast("int")
    of_bits = F.filter(F.sequence(F.lit(0), F.lit((1 << PLACES) - 1)), lambda i: F.bit_get(byte(i), i.bitwiseAND(7)) == 1)
    return F.coalesce(places.cast("array<int>"), of_bits)


def shared_lines(lines: DataFrame, pages: DataFrame, min_pages: int = 5, min_share: float = 0.1) -> DataFrame:
    """(site, k1, k2, pages, container, places, bits): the bitmaps of lines on at least ``min_pages`` pages and ``min_share`` of the site's pages with markdown."""
    size = pages.groupBy("site").agg(F.count("*").alias("site_pages"))
    held = bitmaps(lines)
    count = held.groupBy("site", "k1", "k2").agg(F.sum(F.size("places")).alias("pages")).where(F.col("pages") >= min_pages)
    count = count.join(size, "site").where(F.col("pages") >= min_share * F.col("site_pages")).drop("site_pages")
    return compressed(cut_lineage(held.join(count, ["site", "k1", "k2"])))


def repeated_lines(documents: DataFrame, min_pages: int = 5, min_share: float = 0.1, min_letters: int = 15) -> DataFrame:
    """(fetch_id, line_no, pages): the lines of each row that its site repeats.

    Null markdown has no rows; an empty one has no line of enough letters. A
    page fetched often counts once. Rows without a host form one site of their
    own. Every step is spread by line and container or by page, so a line in a
    third of all rows is no large group.
    """
    # the hashes are written once: they are read for the bitmaps and for the lookup, and are about a quarter of the text
    rows = cut_lineage(hashed_pages(documents, min_letters))
    pages = numbered(rows)
    lines = _on_page(rows, pages).select("site", "page_no", F.explode("lines").alias("l")).select("site", "page_no", "l.v", "l.k1", "l.k2")
    shared = shared_lines(lines, pages, min_pages, min_share)
    # the lines to delete on each page, read from the bitmaps
    at = shared.select("k1", "k2", "pages", "container", F.explode(places_of(F.col("places"), F.col("bits"))).alias("place"))
    at = at.select("k1", "k2", "pages", (F.shiftleft("container", PLACES) + F.col("place")).alias("page_no"))
    gone = at.groupBy("page_no").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("k1", "k2"), "pages"))).alias("gone")).join(pages, "page_no").drop("page_no")
    hit = _on_page(rows, gone).select("fetch_id", F.explode("lines").alias("l"), "gone")
    return hit.select("fetch_id", F.col("l.n").alias("line_no"), F.try_element_at("gone", F.struct("l.k1", "l.k2")).alias("pages")).where("pages is not null")


def without_repeated_lines(documents: DataFrame, **limits: float) -> DataFrame:
    """(fetch_id, markdown, removed): every row with its markdown without the lines its site repeats; null stays null."""
    gone = repeated_lines(documents, **limits).groupBy("fetch_id").agg(F.collect_set("line_no").alias("gone"))
    rows = documents.select("fetch_id", "markdown").join(gone, "fetch_id", "left")
    kept = F.array_join(F.filter(F.split("markdown", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return rows.select("fetch_id", F.when(F.col("gone").isNull(), F.col("markdown")).otherwise(kept).alias("markdown"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))


def found(documents: DataFrame) -> DataFrame:
    """p7_found."""
    return repeated_lines(documents).select("fetch_id", "line_no")
