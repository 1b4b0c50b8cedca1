"""Filing indexes: one JSON document per filer with parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms kept by default and the JSON layout of an index.
FORMS = ["10-K", "10-Q", "8-K"]
INDEX_SCHEMA = (
    "form array<string>, filingDate array<string>, accessionNumber array<string>, "
    "primaryDocument array<string>"
)


def filer_ids(dim: DataFrame) -> DataFrame:
    """``(ticker, id)`` to upper-case ticker and id padded to ten digits."""
    return dim.withColumns(
        {"ticker": F.upper("ticker"), "filer_id": F.lpad(F.col("id").cast("string"), 10, "0")}
    ).drop("id")


def entries(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Unzip each index into rows, numbered in feed order; short arrays end the zip."""
    index = F.from_json(body, INDEX_SCHEMA)
    d = feeds.withColumn("_i", index)
    n = F.least(*[F.size(f"_i.{c}") for c in ("form", "filingDate", "accessionNumber", "primaryDocument")])
    zipped = F.slice(
        F.arrays_zip("_i.form", "_i.filingDate", "_i.accessionNumber", "_i.primaryDocument"), 1, n
    )
    return d.select(
        *[c for c in feeds.columns if c != body], F.posexplode(zipped).alias("pos", "_e")
    ).select(
        *[c for c in feeds.columns if c != body],
        "pos",
        F.col("_e.form").alias("form"),
        F.col("_e.filingDate").alias("filing_date"),
        F.col("_e.accessionNumber").alias("accession"),
        F.col("_e.primaryDocument").alias("document"),
    )


def select_filings(
    filings: DataFrame,
    as_of: Column,
    max_filings: int,
    order: list[str],
    days: int = 365,
    forms: list[str] | None = None,
) -> DataFrame:
    """Filings of the last ``days`` in allowed forms, at most ``max_filings`` per ticker and
    form in feed order. Rows with an unreadable date are skipped."""
    day = F.col("filing_date").try_cast("date")
    d = filings.filter(
        F.col("form").isin(forms or FORMS) & day.isNotNull() & (day >= F.date_sub(as_of, days))
    )
    w = Window.partitionBy("ticker", "form").orderBy(*order)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_filings)
