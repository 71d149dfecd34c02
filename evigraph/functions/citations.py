"""Formatted citations in five styles, as Column expressions.

A record has authors (array of struct<full_name, given, family>), title, journal, journal_abbreviation, year, volume, issue,
pages and doi; all but the authors are strings or castable. Values are expected without markup (see ``arrow.plain_text``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, initials

STYLES = ("acs", "rsc", "wiley", "nature", "science")


def _v(c: Column) -> Column:
    return collapse(c)


def _dotless(c: Column) -> Column:
    return F.rtrim(_v(c), F.lit("."))


def _join(sep: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), sep)


def author_parts(a: Column) -> tuple[Column, Column]:
    """(family name, initials) of an author, recovered from the full name where a part is missing."""
    family, given, full = (_v(a[f]) for f in ("family", "given", "full_name"))
    pieces = F.split(full, " ")
    last = F.element_at(pieces, -1)
    ahead = F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), " ")
    own = F.when(F.lower(full).endswith(F.lower(family)), F.btrim(F.substring(full, F.lit(1), F.length(full) - F.length(family)), F.lit(" ,"))).otherwise(full)
    return F.when(family != "", family).otherwise(last), initials(F.when(family == "", ahead).when(given != "", given).otherwise(own))


def _listed(items: Column, final: str) -> Column:
    n = F.size(items)
    several = F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(final), F.element_at(items, -1))
    return F.when(n == 0, "Unknown author").when(n == 1, F.element_at(items, 1)).otherwise(several)


def author_text(authors: Column, style: str) -> Column:
    authors = F.coalesce(authors, F.array().cast("array<struct<full_name:string,given:string,family:string>>"))
    inverted = F.transform(authors, lambda a: _join(", ", *author_parts(a)))
    straight = F.transform(authors, lambda a: _join(" ", *reversed(author_parts(a))))
    n = F.size(authors)
    if style == "acs":
        shown = F.when(n > 10, F.concat(F.slice(inverted, 1, 10), F.array(F.lit("et al.")))).otherwise(inverted)
        return F.coalesce(F.nullif(F.array_join(shown, "; "), F.lit("")), F.lit("Unknown author"))
    if style == "nature":
        return F.when(n > 5, F.concat(F.get(inverted, F.lit(0)), F.lit(" et al."))).otherwise(_listed(inverted, " & "))
    if style == "science":
        return F.when(n > 10, F.concat(F.array_join(F.slice(straight, 1, 10), ", "), F.lit(", et al."))).otherwise(_listed(straight, ", "))
    return _listed(straight, ", ")


def citation(r: dict[str, Column], style: str) -> Column:
    """The citation of a record whose fields are the columns ``r``."""
    if style not in STYLES:
        raise ValueError(f"no such style: {style}")
    authors = author_text(r["authors"], style)
    ended = F.when(authors.endswith("."), authors).otherwise(F.concat(authors, F.lit(".")))
    title = F.coalesce(F.nullif(_dotless(r["title"]), F.lit("")), F.lit("Untitled"))
    journal = F.coalesce(F.nullif(_v(r["journal_abbreviation"]), F.lit("")), F.nullif(_v(r["journal"]), F.lit("")), F.lit("Unknown journal"))
    year = F.coalesce(F.nullif(_dotless(r["year"]), F.lit("")), F.lit("n.d."))
    volume, issue, pages, doi = (_dotless(r[f]) for f in ("volume", "issue", "pages", "doi"))
    number = F.when(volume == "", "").when(issue == "", volume).otherwise(F.concat(volume, F.lit("("), issue, F.lit(")")))
    url = F.when(doi == "", "").otherwise(F.concat(F.lit("https://doi.org/"), doi))
    add = lambda sep, x: F.when(x == "", "").otherwise(F.concat(F.lit(sep), x))
    if style == "acs":
        out = F.concat(ended, F.lit(" "), title, F.lit(". "), _join(" ", journal, year), add(", ", _join(", ", number, pages)), add(". DOI: ", doi))
    elif style == "rsc":
        out = F.concat(authors, F.lit(", "), journal, F.lit(", "), _join(", ", year, number, pages), add(", DOI: ", doi))
    elif style == "wiley":
        out = F.concat(authors, F.lit(", "), journal, F.lit(" "), year, add(", ", _join(", ", number, pages)), add(", ", url))
    elif style == "nature":
        out = F.concat(ended, F.lit(" "), title, F.lit(". "), journal, add(" ", _join(", ", number, pages)), F.lit(" ("), year, F.lit(")"), add(". ", url))
    else:
        out = F.concat(authors, F.lit(", "), title, F.lit(". "), journal, add(" ", _join(" ", number, pages)), F.lit(" ("), year, F.lit(")"), add(". DOI: ", doi))
    return F.concat(F.rtrim(collapse(out), F.lit(".")), F.lit("."))


def citations(r: dict[str, Column]) -> Column:
    """map style -> citation."""
    return F.create_map(*[x for s in STYLES for x in (F.lit(s), citation(r, s))])
