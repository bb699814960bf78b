"""Text functions with the meaning scripting languages give them."""

from __future__ import annotations

from pyspark.sql import functions as F


def strip(c):
    """Unicode white space off both ends; plain trim removes spaces only."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def title(c):
    """Every run of letters starts upper case and goes on lower case."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def word_count(c):
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")).cast("long")


def line_count(c):
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")


def tokens(c):
    """The planning rule: four characters a token."""
    return F.floor(F.length(c) / 4).cast("long")


def preview(c, size: int, mark: str = "..."):
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit(mark))).otherwise(c)


def clean_name(name: str) -> str:
    """A safe column name: word characters, single underscores, lower case."""
    import re

    out = re.sub(r"_+", "_", re.sub(r"[\s]+", "_", re.sub(r"[^\w\s]", "_", name))).strip("_").lower()
    return out or "column"


def clean_names(names: list[str]) -> list[str]:
    """Clean names made distinct: repeats get _1, _2, ..., the next that isn't taken."""
    taken: set[str] = set()
    out = []
    for n in map(clean_name, names):
        new, k = n, 0
        while new in taken:
            k += 1
            new = f"{n}_{k}"
        taken.add(new)
        out.append(new)
    return out


def strip_markup(c, drop_bodies: bool = True):
    """Tags become spaces and white space collapses; script and style bodies go first."""
    if drop_bodies:
        c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
