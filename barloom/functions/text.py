"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities decoded, and the mark put after a cut text.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#160;", " ")]
QUOTE = ("&quot;", '"')
CUT_MARK = "\n[TRUNCATED]"


def decode(text: Column, quotes: bool = False) -> Column:
    for entity, char in ENTITIES + ([QUOTE] if quotes else []):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean_html(text: Column) -> Column:
    """Drop tags, decode entities and fold whitespace."""
    bare = F.regexp_replace(text, "<[^>]+>", " ")
    return F.trim(F.regexp_replace(decode(bare), r"\s+", " "))


def html_to_text(html: Column, limit: int | None = None) -> Column:
    """Readable lines of a page: no markup, scripts or styles; lines of at most ten
    characters or of numbers only are dropped. Lines are told apart before blanks fold."""
    t = F.regexp_replace(html, r"<\?xml[^>]*\?>", "")
    t = F.regexp_replace(t, r"<!DOCTYPE[^>]*>", "")
    t = F.regexp_replace(t, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    t = F.regexp_replace(decode(t, quotes=True), r"[ \t\f\r]+", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    kept = F.filter(
        lines, lambda x: (F.length(x) > 10) & ~F.regexp(x, F.lit(r"^[\d\s\-\.\,\$\%]+$"))
    )
    out = F.trim(F.array_join(kept, "\n"))
    if limit is None:
        return out
    cut = F.concat(F.substring(out, 1, limit), F.lit(CUT_MARK))
    return F.when(F.length(out) > limit, cut).otherwise(out)


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def content_id(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word sets, 0 if either is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def feed_date(text: Column, as_of: Column) -> Column:
    """ISO day of a feed date in one of four formats, else ``as_of``."""
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(T\d{2}:\d{2}:\d{2}([+-]\d{2}:?\d{2}|Z))?$", 1)
    rfc = F.regexp_extract(
        text,
        r"^[A-Z][a-z]{2}, (\d{1,2} [A-Z][a-z]{2} \d{4}) \d{2}:\d{2}:\d{2} ([+-]\d{4}|[A-Z]{3})$",
        1,
    )
    day = F.coalesce(
        F.try_to_timestamp(F.nullif(rfc, F.lit("")), F.lit("d MMM yyyy")).cast("date"),
        F.nullif(iso, F.lit("")).try_cast("date"),
        as_of,
    )
    return F.date_format(day, "yyyy-MM-dd")


def pdf_date(text: Column) -> Column:
    """``D:YYYYMMDD...`` or ``YYYYMMDD...`` to an ISO day."""
    digits = F.regexp_extract(text, r"^(?:D:)?(\d{8})", 1)
    parts = [F.substring(digits, a, n) for a, n in ((1, 4), (5, 2), (7, 2))]
    return F.when(digits != "", F.concat_ws("-", *parts))


def parse_signal(text: Column) -> Column:
    """BUY, SELL or HOLD out of free text: marker or prefix, else the strict majority."""
    up = F.upper(text)
    marked = F.lit(None).cast("string")
    for name in ("HOLD", "SELL", "BUY"):
        hit = up.contains(f"SIGNAL: {name}") | up.startswith(name)
        marked = F.when(hit, name).otherwise(marked)
    n = {name: F.regexp_count(up, F.lit(name)) for name in ("BUY", "SELL", "HOLD")}
    return F.coalesce(
        marked,
        F.when((n["BUY"] > n["SELL"]) & (n["BUY"] > n["HOLD"]), "BUY")
        .when((n["SELL"] > n["BUY"]) & (n["SELL"] > n["HOLD"]), "SELL")
        .otherwise("HOLD"),
    )
