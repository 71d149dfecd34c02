"""Text keys, identifiers and small scores as Column -> Column functions. Nulls give '' where a key is asked for, else null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    """White space of any script to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(_s(c), r"(?U)\s+", " "))


def plain_key(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to a blank."""
    return F.trim(F.regexp_replace(F.lower(_s(c)), "[^a-z0-9]+", " "))


def title_key(c: Column) -> Column:
    """Like ``plain_key`` after tags are taken out and ``&amp;`` is read as ``and``."""
    untagged = F.regexp_replace(F.lower(collapse(c)), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.replace(untagged, F.lit("&amp;"), F.lit(" and ")), "[^a-z0-9]+", " "))


def entity_key(c: Column) -> Column:
    """Like ``plain_key`` after character entities are taken out."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_s(c)), "&[a-z]+;", " "), "[^a-z0-9]+", " "))


DOI_EDGE = ".,;()[]{}<>"


def doi_key(c: Column) -> Column:
    s = F.lower(F.trim(_s(c)))
    s = F.regexp_replace(s, r"^https?://(?:dx\.)?doi\.org/", "")
    s = F.trim(F.regexp_replace(s, r"^doi:\s*", ""))
    return F.btrim(s, F.lit(DOI_EDGE))


def is_doi(c: Column) -> Column:
    return c.rlike(r"^10\.\d{4,9}/\S+$")


def openalex_key(c: Column) -> Column:
    return F.upper(F.element_at(F.split(F.rtrim(F.trim(_s(c)), F.lit("/")), "/"), -1))


def id_list(c: Column) -> Column:
    """'p1, p2' -> ['P1', 'P2']."""
    return F.filter(F.transform(F.split(_s(c), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def path_slug(c: Column, default: str = "default") -> Column:
    """The project in a path projects/<slug>/file."""
    parts = F.split(_s(c), "/")
    return F.when((F.size(parts) >= 3) & (F.element_at(parts, 1) == "projects"), F.element_at(parts, 2)).otherwise(F.lit(default))


def node_slug(c: Column) -> Column:
    return F.substring(F.sha1(plain_key(c)), 1, 16)


def surname(c: Column) -> Column:
    words = F.regexp_extract_all(_s(c), F.lit(r"([A-Za-z][A-Za-z'\-]+)"), F.lit(1))
    return F.when(F.size(words) > 0, F.lower(F.element_at(words, -1))).otherwise("")


def initials(c: Column) -> Column:
    words = F.regexp_extract_all(_s(c), F.lit(r"(\p{L}+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")


def label(family: Column, year: Column, fallback: Column) -> Column:
    """'Family, 2020', with '?' for no year."""
    return F.concat(F.coalesce(F.nullif(family, F.lit("")), fallback), F.lit(", "), F.coalesce(year.cast("string"), F.lit("?")))


#: Roles of sections by words of their heading, the first rule holds.
SECTION_ROLES = (
    ("background", ("introduction", "background", "literature review")),
    ("methods", ("method", "experimental", "materials and methods", "computational detail")),
    ("results_discussion", ("result", "discussion", "finding")),
    ("conclusion", ("conclusion", "summary", "perspective", "outlook")),
)


def section_role(heading: Column) -> Column:
    key = plain_key(heading)
    out = None
    for role, marks in SECTION_ROLES:
        hit = reduce(lambda a, b: a | b, (key.contains(m) for m in marks))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("other")


def numeric_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.replace(_s(c), F.lit(","), F.lit("")), F.lit(r"(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"), F.lit(1))


def year_in(c: Column) -> Column:
    return F.nullif(F.regexp_extract(_s(c), r"(?<![A-Za-z0-9_])((?:18|19|20|21)\d{2})(?![A-Za-z0-9_])", 1), F.lit("")).cast("int")


def publication_year(c: Column) -> Column:
    """A year from 1000 to 2100, else null; ``year_error`` says why."""
    y = F.expr("1") * F.when(F.trim(_s(c)).rlike(r"^\d{4}$"), F.trim(_s(c))).cast("int")
    return F.when(y.between(1000, 2100), y)


def year_score(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(F.coalesce(a, F.lit(0)).eqNullSafe(0) | F.coalesce(b, F.lit(0)).eqNullSafe(0), 0.45).when(gap == 0, 1.0).when(gap == 1, 0.72).when(gap == 2, 0.35).otherwise(0.0)


def page_of(coords: Column) -> Column:
    """The page of 'page,x,y,w,h;...'."""
    return F.nullif(F.regexp_extract(_s(coords), r"^\s*(\d+)\s*,", 1), F.lit("")).cast("int")


def boxes(coords: Column) -> Column:
    """array<struct<page, x0, y0, x1, y1>>; parts that are no box are left out."""
    cells = lambda x: F.transform(F.split(x, ","), lambda v: F.expr("1D") * F.when(F.trim(v).rlike(r"^-?\d+(\.\d+)?$"), F.trim(v)).cast("double"))
    good = F.filter(F.transform(F.split(_s(coords), ";"), cells), lambda v: (F.size(v) >= 5) & ~F.exists(v, lambda z: z.isNull()))
    return F.transform(good, lambda v: F.struct(v[0].cast("int").alias("page"), v[1].alias("x0"), v[2].alias("y0"), (v[1] + v[3]).alias("x1"), (v[2] + v[4]).alias("y1")))


def union_box(b: Column, padding: float) -> Column:
    low = lambda f: F.array_min(F.transform(b, lambda x: x[f])) - padding
    high = lambda f: F.array_max(F.transform(b, lambda x: x[f])) + padding
    return F.struct(low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"))


def support_score(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(n) / F.log(F.lit(5.0)))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(_s(c)) / 3)


def evidence_line(sid: Column, page: Column, text: Column, cites: Column) -> Column:
    """'[sid page=n] text [CITES:a,b]'."""
    shown = F.when(F.size(F.coalesce(cites, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" [CITES:"), F.array_join(cites, ","), F.lit("]"))).otherwise("")
    return F.concat(F.lit("["), sid, F.coalesce(F.concat(F.lit(" page="), page.cast("string")), F.lit("")), F.lit("] "), _s(text), shown)


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def middle_cut(c: Column, most: int, mark: str = " ... ") -> Column:
    """Head and tail of a long text, 72 to 28."""
    room = most - len(mark)
    head = int(room * 0.72)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, head), F.lit(mark), F.right(c, F.lit(room - head)))).otherwise(c)


def cell(c: Column) -> Column:
    """For a cell of a Markdown table."""
    return F.replace(F.replace(_s(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def file_name(c: Column, fallback: str = "download") -> Column:
    safe = F.btrim(F.regexp_replace(_s(c), r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(F.substring(safe, 1, 120), F.lit("")), F.lit(fallback))


def script_json(c: Column) -> Column:
    """JSON text that may stand inside a script element."""
    for a, b in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def record_uid(paper: Column, kind: Column, value: Column, evidence: Column) -> Column:
    """kind:hash of a paper's entity, the same whatever the order of its evidence."""
    parts = F.concat_ws("|", paper, kind, plain_key(value), F.array_join(F.array_sort(F.coalesce(evidence, F.array().cast("array<string>"))), ","))
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(parts, 256), 1, 20))


def resolution_band(r: Column) -> Column:
    return F.when(r < 0.7, "broad").when(r <= 1.3, "balanced").otherwise("fine")


def year_error(c: Column) -> Column:
    """What is wrong with an entered year; null for a good or an empty one."""
    own = F.trim(_s(c))
    return F.when(own == "", None).when(~own.rlike(r"^[+-]?\d+$"), "not a number").when(publication_year(c).isNull(), "out of range")


def legacy_doi(c: Column) -> Column:
    """The older DOI key: resolver prefixes off, marks off the right end only."""
    s = F.regexp_replace(F.lower(F.trim(_s(c))), r"^https?://doi\.org/", "")
    return F.rtrim(F.trim(F.regexp_replace(s, "^doi:", "")), F.lit(".,; "))


def first_surname(authors: Column) -> Column:
    """Surname key of the first of an array of author structs (family, full_name)."""
    a = F.get(authors, F.lit(0))
    return surname(F.coalesce(F.nullif(a["family"], F.lit("")), a["full_name"]))


def first_family(authors: Column) -> Column:
    """Family name of the first author as it is written in the full name; the last word of the full name if none is given."""
    a = F.get(authors, F.lit(0))
    family, full = F.trim(_s(a["family"])), F.trim(_s(a["full_name"]))
    written = F.trim(F.right(full, F.length(family)))
    last = F.btrim(F.element_at(F.split(full, r"\s+"), -1), F.lit(" ,.;"))
    return F.when((family != "") & (full != "") & F.lower(full).endswith(F.lower(family)), written).when(family != "", family).otherwise(last)


def author_display(a: Column) -> Column:
    """'Family, Given' of an author struct, else what it has."""
    family, given, full = (F.trim(_s(a[f])) for f in ("family", "given", "full_name"))
    return F.when((family != "") & (given != ""), F.concat(family, F.lit(", "), given)).otherwise(F.coalesce(F.nullif(full, F.lit("")), F.nullif(family, F.lit("")), given))


def authors_text(authors: Column) -> Column:
    """Full names joined by '; ', from given and family names where there is no full one; blank ones left out."""
    name = lambda a: F.trim(F.coalesce(F.nullif(_s(a["full_name"]), F.lit("")), F.concat_ws(" ", F.nullif(F.trim(_s(a["given"])), F.lit("")), F.nullif(F.trim(_s(a["family"])), F.lit("")))))
    return F.array_join(F.filter(F.transform(F.coalesce(authors, F.array().cast("array<struct<full_name:string,given:string,family:string>>")), name), lambda x: x != ""), "; ")


def authors_of(c: Column) -> Column:
    """array<struct<full_name, given, family>> from lines 'Family, Given' or 'Given Family'; blank lines left out."""
    lines = F.filter(F.transform(F.split(_s(c), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")

    def one(x: Column) -> Column:
        at = F.instr(x, ",")
        family, given = F.trim(F.substring(x, F.lit(1), at - 1)), F.trim(F.substring(x, at + 1, F.length(x)))
        words = F.split(x, r"\s+")
        ahead = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
        turned = F.struct(F.trim(F.concat(given, F.lit(" "), family)).alias("full_name"), F.nullif(given, F.lit("")).alias("given"), family.alias("family"))
        return F.when(at > 0, turned).otherwise(F.struct(x.alias("full_name"), F.nullif(ahead, F.lit("")).alias("given"), F.element_at(words, -1).alias("family")))

    return F.transform(lines, one)


def listed_authors(c: Column) -> Column:
    """array<string> from a text of names divided by semicolons."""
    return F.filter(F.transform(F.split(_s(c), ";"), lambda x: F.trim(x)), lambda x: x != "")


def searched_text(error: Column) -> Column:
    """The search text in the address that a provider's error message ends with."""
    at = F.element_at(F.split(_s(error), " for url: "), -1)
    found = F.coalesce(F.nullif(F.regexp_extract(at, r"[?&]search=([^&#]*)", 1), F.lit("")), F.regexp_extract(at, r"[?&]query\.bibliographic=([^&#]*)", 1))
    return F.when(_s(error).contains(" for url: "), collapse(F.coalesce(F.try_url_decode(found), F.lit("")))).otherwise("")


def claim_text(c: dict[str, Column], tags: Column | None = None) -> Column:
    """Statement, subject, relation, object and conditions of a claim, and its tags if given, blanks left out."""
    parts = [F.nullif(F.trim(_s(c[k])), F.lit("")) for k in ("statement", "subject", "relation", "object", "conditions_text")]
    if tags is not None:
        parts.append(F.nullif(F.array_join(F.filter(tags, lambda t: F.trim(_s(t)) != ""), " "), F.lit("")))
    return F.concat_ws(" ", *parts)


def distinct_in_order(a: Column) -> Column:
    """An array without later repeats and nulls."""
    return F.array_distinct(F.array_compact(a))


def seconds_between(start: Column, stop: Column) -> Column:
    """Whole and part seconds from one time to another, never below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(stop.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6)


def now_text() -> Column:
    """This moment in UTC, to the second, as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def palette(n: Column, colours: tuple[str, ...]) -> Column:
    """The colour of a number, from the beginning again past the last."""
    return F.element_at(F.array(*map(F.lit, colours)), (F.pmod(n, F.lit(len(colours))) + 1).cast("int"))
