"""Text expressions: trimming, case styles, justification, file names, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prefixes of generated ids by kind of record, and the name of a snapshot
# from image, cluster, host and number.
ID_PREFIXES = {"stack": "sa-", "service": "se-", "snapshot": "sn-"}
SNAPSHOT_NAME = "%s-%s-%s:SNAPSHOT-%s"

WHITE_SPACE = " \t\n\x0b\f\r"


def strip(col: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def words(col: Column) -> Column:
    """White-space separated tokens without empty ones."""
    return F.regexp_extract_all(col, F.lit(r"[^ \t\n\r\f]+"), F.lit(0))


def capitalize(col: Column) -> Column:
    """First character upper case, all others lower case."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substr(col, F.lit(2))))


def title(col: Column) -> Column:
    """Every run of letters starts upper case and goes on lower case."""
    runs = F.regexp_extract_all(col, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, capitalize), "")


def header_style(col: Column, style: str | None) -> Column:
    styles = {"cap": capitalize, "title": title, "upper": F.upper, "lower": F.lower}
    if style is None:
        return col
    if style not in styles:
        raise ValueError(f"unknown header style {style!r}")
    return styles[style](col)


def split_scheme(col: Column, default: str = "image") -> tuple[Column, Column]:
    """``scheme://rest`` as two columns; without a scheme the default one applies."""
    parts = F.split(col, "://", 2)
    has = F.size(parts) > 1
    return (
        F.when(has, parts[0]).otherwise(F.lit(default)),
        F.when(has, F.get(parts, F.lit(1))).otherwise(col),
    )


def file_name(col: Column) -> Column:
    """Last path segment."""
    return F.substring_index(col, "/", -1)


def file_stem(col: Column) -> Column:
    """File name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(file_name(col), r"(?<=[^.])\.[^.]*$", "")


def file_extension(col: Column) -> Column:
    """Last extension without the dot, empty if there is none."""
    return F.regexp_extract(file_name(col), r"[^.]\.([^.]*)$", 1)


def short_id(prefix: str, key: Column) -> Column:
    """Kind prefix and eight hex digits that depend on ``key`` only."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(key.cast("string"), 256), 1, 8))


def snapshot_name(image: Column, cluster: Column, host: Column, number: Column) -> Column:
    """Name of the image that a snapshot of a host is kept as."""
    return F.format_string(SNAPSHOT_NAME, image, cluster, host, number)
