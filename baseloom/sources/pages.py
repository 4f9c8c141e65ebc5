"""Links, table rows and measurements from stored web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baseloom.functions.names import normalize_species

# Measurement patterns, in search order.
MEASUREMENTS = [
    r"(?i)C[-\s]?value[^0-9]{0,20}([0-9]+(?:\.[0-9]+)?)",
    r"(?i)\b1C[^0-9]{0,20}([0-9]+(?:\.[0-9]+)?)",
    r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*pg\b",
]
# Character references of HTML text that occur in prose; `&amp;` last.
REFERENCES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&apos;": "'",
    "&#39;": "'",
    "&nbsp;": " ",
    "&copy;": "©",
    "&middot;": "·",
    "&times;": "×",
    "&deg;": "°",
    "&amp;": "&",
}
# Link texts that name no species.
EMPTY_LINK_TEXTS = ["details", "more"]

_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a\s*>"""


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def page_text(html: Column) -> Column:
    """Visible text: no comments, scripts or styles; tags become spaces."""
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    body = F.regexp_replace(body, r"(?s)<[^>]+>", " ")
    for reference, char in REFERENCES.items():
        body = F.replace(body, F.lit(reference), F.lit(char))
    return clean_text(body)


def absolute_url(href: Column, base: str) -> Column:
    """Join a link to the base address."""
    host = "/".join(base.split("/")[:3])
    folder = base if base.endswith("/") else (base.rsplit("/", 1)[0] + "/" if base.count("/") > 2 else base + "/")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.lit(base.split("//")[0]), href))
        .when(href.startswith("/"), F.concat(F.lit(host), href))
        .otherwise(F.concat(F.lit(folder), href))
    )


def extract_links(pages: DataFrame, pattern: str, base: str) -> DataFrame:
    """Links whose address holds ``pattern``; the first text per address counts.

    ``pages`` has ``page_id, html``.
    """
    tag = F.lit(_ANCHOR)
    found = F.arrays_zip(
        F.regexp_extract_all("html", tag, F.lit(1)).alias("a"),
        F.regexp_extract_all("html", tag, F.lit(2)).alias("b"),
        F.regexp_extract_all("html", tag, F.lit(3)).alias("t"),
    )
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "m")).select(
        "page_id", "pos", F.concat("m.a", "m.b").alias("href"), page_text(F.col("m.t")).alias("link_text")
    )
    wanted = rows.where(F.col("href").contains(pattern)).withColumn("url", absolute_url(F.col("href"), base))
    first = wanted.groupBy("url").agg(F.min(F.struct("page_id", "pos", "link_text")).alias("f"))
    return first.select("url", F.col("f.page_id").alias("page_id"), F.col("f.link_text").alias("link_text"))


def extract_table_rows(pages: DataFrame) -> DataFrame:
    """Cells of each table row, joined; empty cells and rows are left out."""
    tables = F.regexp_extract_all("html", F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), F.lit(1))
    rows = F.regexp_extract_all("_table", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))
    cells = F.regexp_extract_all("_row", F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"), F.lit(1))
    text = F.filter(F.transform(cells, page_text), lambda c: c != "")
    return (
        pages.select("page_id", F.posexplode(tables).alias("_t", "_table"))
        .select("page_id", "_t", F.posexplode(rows).alias("_r", "_row"))
        .select(
            "page_id",
            (F.col("_t") + 1).cast("bigint").alias("table_index"),
            (F.col("_r") + 1).cast("bigint").alias("row_index"),
            F.array_join(text, " | ").alias("cells_joined"),
        )
        .where("cells_joined <> ''")
    )


def measurements(text: Column) -> Column:
    """Numbers found by the three patterns, in order, each once."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in MEASUREMENTS]
    return F.array_distinct(F.concat(*found))


def extract_c_values(pages: DataFrame) -> DataFrame:
    """Measurements per page and the species it is about.

    ``pages`` has ``page_id, link_text, html``. Without a telling link text the
    first heading names the species.
    """
    headings = F.filter(
        F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<h[123]\b[^>]*>(.*?)</h[123]\s*>"), F.lit(1)), page_text),
        lambda h: h != "",
    )
    unnamed = F.col("link_text").isNull() | (F.col("link_text") == "") | F.lower("link_text").isin(EMPTY_LINK_TEXTS)
    name = F.when(unnamed, F.coalesce(F.get(headings, F.lit(0)), "link_text", F.lit(""))).otherwise(F.col("link_text"))
    return (
        pages.select("page_id", "link_text", name.alias("species_name"), measurements(page_text(F.col("html"))).alias("_v"))
        .withColumn("species_key", normalize_species(F.col("species_name"), "binomial"))
        .withColumn("c_values_pg_detected", F.array_join("_v", ";"))
        .withColumn("n_c_values_detected", F.size("_v").cast("bigint"))
        .drop("_v")
    )
