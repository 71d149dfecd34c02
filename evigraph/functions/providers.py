"""Records of bibliographic providers as candidates with the fields of our own records; requests to providers as columns.

A candidate is struct<provider, title, doi, year, journal, journal_abbreviation, volume, issue, pages, article_number, issn,
authors, openalex_id, referenced_works>. The JSON is read with a stated schema, so only the fields named here are parsed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, doi_key, openalex_key

_DATED = "struct<`date-parts`:array<array<int>>,`date-time`:string>"
CROSSREF = (
    "struct<title:array<string>,DOI:string,`container-title`:array<string>,`short-container-title`:array<string>,volume:string,issue:string,page:string,`article-number`:string,ISSN:array<string>,"
    f"author:array<struct<given:string,family:string,ORCID:string>>,`published-print`:{_DATED},`published-online`:{_DATED},published:{_DATED},issued:{_DATED},created:{_DATED}>"
)
OPENALEX = (
    "struct<id:string,title:string,display_name:string,doi:string,publication_year:int,primary_location:struct<source:struct<display_name:string,abbreviated_title:string,issn:array<string>>>,"
    "biblio:struct<volume:string,issue:string,first_page:string,last_page:string,article_number:string>,authorships:array<struct<author:struct<display_name:string,orcid:string>,raw_author_name:string>>,referenced_works:array<string>>"
)
AUTHOR = "array<struct<full_name:string,given:string,family:string,orcid:string>>"


def dated_year(item: Column) -> Column:
    """The year of the first of print, online, published, issued and created dates that has one."""

    def year(d: Column) -> Column:
        part = F.get(F.get(d["date-parts"], F.lit(0)), F.lit(0))
        said = F.nullif(F.regexp_extract(F.coalesce(d["date-time"], F.lit("")), r"\b((?:18|19|20|21)\d{2})\b", 1), F.lit("")).cast("int")
        return F.coalesce(part, said)

    return F.coalesce(*[year(item[k]) for k in ("published-print", "published-online", "published", "issued", "created")])


def _blank(c: Column) -> Column:
    return F.nullif(collapse(c), F.lit(""))


def crossref_candidate(json: Column) -> Column:
    r = F.from_json(json, CROSSREF)
    one = lambda a: F.struct(_blank(F.concat_ws(" ", a["given"], a["family"])).alias("full_name"), a["given"].alias("given"), a["family"].alias("family"), a["ORCID"].alias("orcid"))
    first = lambda c: F.get(c, F.lit(0))
    return F.when(
        r.isNotNull(),
        F.struct(
            F.lit("crossref").alias("provider"), first(r["title"]).alias("title"), doi_key(r["DOI"]).alias("doi"), dated_year(r).alias("year"), first(r["container-title"]).alias("journal"),
            first(r["short-container-title"]).alias("journal_abbreviation"), r["volume"].alias("volume"), r["issue"].alias("issue"), r["page"].alias("pages"), r["article-number"].alias("article_number"),
            F.coalesce(r["ISSN"], F.array().cast("array<string>")).alias("issn"), F.coalesce(F.transform(r["author"], one), F.array().cast(AUTHOR)).alias("authors"),
            F.lit(None).cast("string").alias("openalex_id"), F.array().cast("array<string>").alias("referenced_works"),
        ),
    )


def openalex_candidate(json: Column) -> Column:
    r = F.from_json(json, OPENALEX)
    source, biblio = r["primary_location"]["source"], r["biblio"]

    def one(a: Column) -> Column:
        full = collapse(F.coalesce(F.nullif(a["author"]["display_name"], F.lit("")), a["raw_author_name"]))
        words = F.split(full, " ")
        return F.struct(F.nullif(full, F.lit("")).alias("full_name"), F.nullif(F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " "), F.lit("")).alias("given"), F.nullif(F.element_at(words, -1), F.lit("")).alias("family"), a["author"]["orcid"].alias("orcid"))

    a, b = biblio["first_page"], biblio["last_page"]
    return F.when(
        r.isNotNull(),
        F.struct(
            F.lit("openalex").alias("provider"), F.coalesce(F.nullif(r["title"], F.lit("")), r["display_name"]).alias("title"), doi_key(r["doi"]).alias("doi"), r["publication_year"].alias("year"), source["display_name"].alias("journal"),
            source["abbreviated_title"].alias("journal_abbreviation"), biblio["volume"].alias("volume"), biblio["issue"].alias("issue"), F.when(b.isNotNull() & (a != b), F.concat(a, F.lit("-"), b)).otherwise(a).alias("pages"), biblio["article_number"].alias("article_number"),
            F.coalesce(source["issn"], F.array().cast("array<string>")).alias("issn"), F.coalesce(F.transform(r["authorships"], one), F.array().cast(AUTHOR)).alias("authors"),
            openalex_key(r["id"]).alias("openalex_id"), F.coalesce(F.transform(r["referenced_works"], openalex_key), F.array().cast("array<string>")).alias("referenced_works"),
        ),
    )


def merged_fields(canonical: dict[str, Column], base: dict[str, Column], given: Column) -> dict[str, Column]:
    """Fields of ``canonical`` in place of those of ``base`` wherever there is a canonical record (``given``), nulls too."""
    return {k: F.when(given, canonical[k]).otherwise(v) if k in canonical else v for k, v in base.items()}


def search_issue(title: Column, raw: Column, most: int = 350) -> Column:
    """Why a reference should not be searched for by its text; null if it may be."""
    text = F.coalesce(F.nullif(collapse(title), F.lit("")), collapse(raw))
    return F.when(text == "", "no searchable title or citation text").when(F.length(text) > most, F.concat(F.lit("text of "), F.length(text).cast("string"), F.lit(f" characters, above {most}")))


def search_request(provider: str, title: Column, raw: Column, surname: Column, year: Column, rows: int = 5) -> Column:
    """The address of a bibliographic search: title, or else the raw text, with first author and year."""
    if provider not in ("crossref", "openalex"):
        raise ValueError(f"no such provider: {provider}")
    text = F.concat_ws(" ", F.coalesce(F.nullif(collapse(title), F.lit("")), collapse(raw)), F.nullif(surname, F.lit("")), year.cast("string"))
    q = F.url_encode(F.trim(text))
    if provider == "crossref":
        return F.concat(F.lit("https://api.crossref.org/works?query.bibliographic="), q, F.lit(f"&rows={rows}"))
    return F.concat(F.lit("https://api.openalex.org/works?search="), F.url_encode(collapse(title)), F.lit(f"&per-page={rows}"))


def lookup_request(provider: str, doi: Column) -> Column:
    """The address of the record of a DOI."""
    base = {"crossref": "https://api.crossref.org/works/", "openalex": "https://api.openalex.org/works/https://doi.org/"}[provider]
    return F.concat(F.lit(base), F.url_encode(doi))
