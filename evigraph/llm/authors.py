"""Variant spellings of names typed by people and of groups (problem 2).

Noisy-channel attribution over distinct spellings, counted before anything else. A spelling is read as given name, middle
initial, particle and family words (people) or as a place and the words of its kind (groups). Frequent complete spellings
are the candidate canonical forms; a variant meets its candidates through a family word, or a more established word one
typing error away, and its given name, one error, a short form or the initial of it; each candidate's posterior is its
frequency times the likelihood of the differences (order, initials, short form, dropped part, abbreviation, error), and the
variant joins the greatest. Attachments always go up a total order, so they form trees; their roots name the entities,
found by pointer jumping.

What the channel knows of names is counted in the corpus. Whether "A B" is written family name first is decided by how often
each word is the given and the family name of spellings that leave no doubt (a comma, an initial, a particle). A word is
doubted beside one an error away that has more spellings, in proportion to these, so that the rule means the same at any
size. Short forms of given names are those which are a part of the full name, but for a diminutive ending, and stand beside
the full name in families far more often than chance would have it; a short list has forms that no rule derives.

Defined cases: null and blank strings name nobody and are left out; a string stands for one entity; a spelling with no
candidate is an entity of its own; equal posteriors go to the more frequent, then the greater string; repeated rows only
add to frequencies; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..runtime import cut, written
from .canonical import distance, look

# Short forms of given names that no rule derives, particles, titles and nouns of groups.
IRREGULAR: dict[str, tuple[str, ...]] = {
    "bill": ("william",), "billy": ("william",), "bob": ("robert",), "bobby": ("robert",), "dick": ("richard",), "jim": ("james",), "jack": ("john",), "hans": ("johannes",), "jan": ("johannes",), "kitty": ("katherine",), "liz": ("elisabeth",), "elsa": ("elisabeth",), "liesl": ("elisabeth",), "maggie": ("margareta", "margaret"), "peggy": ("margaret",), "meg": ("margaret",),
    "rita": ("margareta",), "greta": ("margareta",), "grete": ("margareta",), "gretel": ("margareta",), "nacho": ("ignacio",), "uli": ("ulrike", "ulrich"), "ulli": ("ulrike", "ulrich"), "kate": ("katherine",), "katie": ("katherine",), "mike": ("michael",), "nick": ("nikolai", "nicholas"), "ned": ("edward",), "ted": ("edward", "theodore"), "paco": ("francisco",), "pancho": ("francisco",), "pepe": ("jose",), "peppe": ("giuseppe",), "beppe": ("giuseppe",), "sasha": ("alexander", "alexandra"), "vova": ("vladimir",), "volodya": ("vladimir",), "misha": ("mikhail",), "chuck": ("charles",), "molly": ("mary",), "polly": ("mary",), "nell": ("helen",), "hank": ("henry",), "harry": ("henry",),
}
#: Endings of short forms.
ENDINGS = re.compile(r"(?:chen|lein|inka|ya|ja|ie|ey|ji|ko|ka|li|sy|sl|i|y|e|a|o|u)$")
PARTICLES = frozenset("van von de der den la le del della di da dos du ter ten el al bin ibn zu zum".split())
TITLES = frozenset("dr prof professor mr mrs ms miss sir phd md jr sr the dipl ing".split())
GROUP = re.compile(r"(?i)\b(institut\w*|inst\.|laborator\w*|lab\.?|labs|consort\w*|cons\.|collaborat\w*|collab\.?|network|group|universit\w*|univ\.|cent(?:er|re)|society|soc\.|academy|department|dept\.|team|project|council|agency|commission)(?!\w)")
ACRONYM = re.compile(r"^\s*([A-Z]{2,6})(?:\s*[(,]\s*(\w[\w -]*?)\)?|\s+([A-Z][a-z]{3,}))\s*$")
_SMALL = frozenset("for of and the".split())
_DIGITS = str.maketrans("01589", "olsbg")

PARSED = "name string, n bigint, kind string, given string, middle string, particle string, family array<string>, words array<string>, unsure boolean, whole boolean"


def bare(s: str) -> str:
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).replace("ł", "l").replace("Ł", "L").replace("ø", "o").replace("Ø", "O"))
    return "".join(c for c in s if not unicodedata.combining(c))


def parse(name: str) -> tuple:
    """(kind, given, middle, particle, family, words, unsure, whole) of a spelling; whole: complete and in plain order."""
    text = re.sub(r"\s+", " ", bare(name)).strip()
    acronym = ACRONYM.match(text)
    if acronym or GROUP.search(text):
        if acronym:
            place, kind = (acronym[2] or acronym[3]).lower(), [acronym[1].lower()]
            return "g", " ".join(kind), "#", "", [place], [place], False, False
        marked = re.match(r"^(.*?)(?:\s*\(([^)]*)\)|,\s*(.*)|\s+of\s+(\S+))\s*$", text)
        words = [w.lower().translate(_DIGITS) for w in re.findall(r"[\w'-]+\.?", text)]
        words = [w for w in words if w not in _SMALL]
        if marked and (place := marked[2] or marked[3] or marked[4]):
            at = [w.lower().translate(_DIGITS) for w in re.findall(r"[\w'-]+", place)]
            rest = [w for w in words if w.rstrip(".") not in at]
            return "g", " ".join(rest), "", "", at[:1], at[:1], False, False
        return "g", " ".join(words[1:]), "", "", words[:1], words[:1], False, not text.lower().startswith("the ") and not text.isupper() and "." not in text
    left, comma, right = text.partition(",")
    upper = text.isupper()

    def pieces(part: str) -> tuple[list[str], list[str], list[str]]:
        """long words, initials, particles"""
        long, initials, small = [], [], []
        for raw in re.findall(r"[^\W_][\w'’-]*\.?", part):
            w = raw.rstrip(".").translate(_DIGITS) if re.search("[a-zA-Z]", raw) else raw
            low = w.lower()
            if low in TITLES:
                continue
            if low in PARTICLES:
                small.append(low)
            elif len(w) == 1 or (len(w) <= 3 and w.isupper() and (not upper or not re.search("[AEIOUY]", w)) and w.isalpha()):
                initials += list(low)
            else:
                long.append(low)
        return long, initials, small

    if comma:
        family, more, small = pieces(left)
        given, initials, small2 = pieces(right)
        initials = more + initials
        full = given[0] if given else ""
        middle = initials[0] if given and initials else "".join(initials[1:2])
        return "p", full or "".join(initials[:1]), middle, " ".join(small + small2), _halves(family), given + _halves(family), False, False
    long, initials, small = pieces(text)
    if not long:
        return "p", "".join(initials[:1]), "".join(initials[1:2]), " ".join(small), [], [], False, False
    if len(long) == 1:
        return "p", "".join(initials[:1]), "".join(initials[1:2]), " ".join(small), _halves(long), _halves(long), False, False
    if small:  # the words behind a particle are the family name
        tokens = [t.rstrip(".").lower().translate(_DIGITS) for t in re.findall(r"[^\W_][\w'’-]*\.?", text)]
        last = max(i for i, t in enumerate(tokens) if t in PARTICLES)
        behind = [t for t in tokens[last + 1 :] if t in long]
        ahead = [t for t in tokens[:last] if t in long]
        if ahead and behind:
            return "p", ahead[0], "".join(initials[:1]), " ".join(small), _halves(behind), ahead + _halves(behind), False, not upper and text != text.lower()
        if len(behind) > 1:
            return "p", behind[-1], "".join(initials[:1]), " ".join(small), _halves(behind[:-1]), behind, False, False
    unsure = len(long) == 2 and not initials and not any("-" in w for w in long)
    if "-" in long[0] and "-" not in long[-1]:
        return "p", long[-1], "".join(initials[:1]), "", _halves(long[:-1]), [long[-1], *_halves(long[:-1])], False, False
    plain = not upper and text != text.lower() and not re.match(r"(?i)(dr|prof)\b", text)
    return "p", long[0], "".join(initials[:1]), "", _halves(long[1:]), [long[0], *_halves(long[1:])], unsure, plain


def _halves(family: list[str]) -> list[str]:
    return [h for w in family for h in w.split("-") if h]


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for name, n in zip(pdf["name"], pdf["n"], strict=True):
            kind, given, middle, particle, family, words, unsure, whole = parse(name)
            rows.append((name, n, kind, given, middle, particle, family, words, unsure, whole))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])


def _near(a: str, b: str) -> bool:
    """Equal but for one error, or for forms that are misread for each other."""
    return distance(a, b, 1) <= 1 or distance(look(a), look(b), 1) <= 1


def stems(given: str) -> list[str]:
    """What a short form may have of the full name: itself, and without its ending and the letter doubled before that."""
    short = ENDINGS.sub("", given)
    cut_short = short[:-1] if len(short) > 2 and short[-1] == short[-2] else short
    return [s for s in dict.fromkeys((given, short, cut_short)) if len(s) >= 2]


def cost(v: dict, c: dict) -> float | None:
    """-log likelihood that ``c`` is written as ``v``; None if it can't be."""
    if v["kind"] != c["kind"]:
        return None
    total = 0.0
    fv, fc = list(v["family"]), list(c["family"])
    if not fv or not fc:
        return None
    for w in [w for w in fv if w in fc]:
        if w in fc and w in fv:
            fv.remove(w)
            fc.remove(w)
    shared = len(v["family"]) - len(fv)
    for w in list(fv):
        near = [x for x in fc if min(len(w), len(x)) >= 4 and _near(w, x)]
        if near:
            fv.remove(w)
            fc.remove(near[0])
            total += 4
            shared += 1
    if not shared or fv:
        return None
    total += 3 * len(fc)
    if v["kind"] == "g":
        kv, kc = v["given"].split(), c["given"].split()
        if kv == kc:
            return total
        letters = "".join(w[0] for w in kc)
        if v["middle"] == "#":
            return total + 2 if v["given"] in (letters, c["family"][0][0] + letters) else None
        if len(kv) != len(kc):
            return None
        for a, b in zip(kv, kc, strict=True):
            if a.rstrip(".") != b:
                if a.endswith(".") and b.startswith(a[:-1]):
                    total += 0.5
                elif _near(a.rstrip("."), b):
                    total += 4
                else:
                    return None
        return total
    if v["particle"] != c["particle"]:
        total += 4
    gv, gc = v["given"], c["given"]
    if gv and gc and gv != gc:
        if len(gv) == 1:
            if not any(g[0] == gv for g in c["formals"]):
                return None
            total += 2
        elif len(gc) == 1:
            if not any(g[0] == gc for g in v["formals"]):
                return None
            total += 2
        elif set(v["formals"]) & set(c["formals"]):
            total += 2
        elif min(len(gv), len(gc)) >= 4 and v["given_deg"] <= c["given_deg"] and _near(gv, gc):
            total += 4
        else:
            return None
    elif bool(gv) != bool(gc):
        total += 5
    if v["middle"] and c["middle"]:
        if v["middle"] != c["middle"]:
            return None
    elif v["middle"] or c["middle"]:
        total += 1
    return total


_FIELDS = ("kind", "given", "middle", "particle", "family", "given_deg", "formals")


def _score_batches(most: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                x = cost({f: r[f] for f in _FIELDS}, {f: r[f"c_{f}"] for f in _FIELDS})
                if x is not None and x <= most:
                    out.append((r["name"], r["c_name"], math.log(r["c_n"]) - x, r["c_n"]))
            yield pd.DataFrame(out, columns=["name", "parent", "score", "c_n"])

    return run


def _cuts(word: str) -> Column:
    """A word, what it leaves without one letter, and the form of what is misread alike."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(F.col(word), F.lit(1), i - 1), F.substring(F.col(word), i + 1, F.length(word))))
    looked = F.replace(F.replace(F.replace(F.col(word), F.lit("rn"), F.lit("m")), F.lit("cl"), F.lit("d")), F.lit("vv"), F.lit("w"))
    return F.when(F.length(word) >= 4, F.array_distinct(F.concat(F.array(F.col(word), looked), less))).otherwise(F.array(F.col(word)))


def _attach(variants: DataFrame, forms: DataFrame, links: DataFrame, most: float, initials: bool) -> DataFrame:
    """(name, parent): the form of greatest posterior for each variant that has one of higher rank.

    ``links`` has the family words through which a spelling may be met: (name, word). Beside the word both sides must share
    the given name, a form of it with one error, or a full form. A variant that has an initial only costs the same for all
    forms of equal family, particle and middle initial, so of these it meets the most frequent alone. ``initials``: forms may
    have initials only, too."""
    group = F.col("kind") == "g"
    first = F.array_distinct(F.transform("formals", lambda g: F.concat(F.lit("^"), F.substring(g, 1, 1))))
    whole = F.array_distinct(F.concat(_cuts("given"), F.transform("formals", lambda g: F.concat(F.lit("="), g))))
    short = F.length("given") <= 1
    keys = F.when(group, F.array(F.lit("#"))).when(short, F.when(F.col("given") == "", F.array(F.lit("^"))).otherwise(first)).otherwise(F.concat(whole, first) if initials else whole)
    named = [F.col(c).alias(f"c_{c}") for c in ("name", "n", "rank", *_FIELDS)]
    left = variants.join(links, "name")
    own = forms.select("*", F.explode(F.array_distinct("family")).alias("word"))
    full = left.where(F.lit(initials) | group | ~short).withColumn("key", F.explode(keys))
    right = own.withColumn("key", F.explode(F.when(group, F.array(F.lit("#"))).otherwise(F.concat(whole, first, F.array(F.lit("^"))) if initials else whole))).select("word", "key", *named)
    pairs = full.join(right, ["word", "key"]).where("c_rank > rank").select("name", *_FIELDS, *[c for c in right.columns if c not in ("word", "key", "c_rank")])
    if not initials:
        top = own.where(~group).withColumn("key", F.explode(F.concat(first, F.array(F.lit("^"))))).groupBy("word", "key", "middle", "particle", "family").agg(F.max(F.struct("n", "name", "rank", "kind", "given", "given_deg", "formals")).alias("t"))
        few = top.select("word", "key", *[(F.col(c) if c in ("middle", "particle", "family") else F.col(f"t.{c}")).alias(f"c_{c}") for c in ("name", "n", "rank", *_FIELDS)])
        brief = left.where(~group & short).withColumn("key", F.explode(keys)).join(few, ["word", "key"]).where("c_rank > rank")
        pairs = pairs.unionByName(brief.select(*pairs.columns))
    pairs = pairs.dropDuplicates(["name", "c_name"])
    scored = pairs.mapInPandas(_score_batches(most), "name string, parent string, score double, c_n bigint")
    return scored.groupBy("name").agg(F.max_by("parent", F.struct("score", "c_n", "parent")).alias("parent"))


def _doubts(words: DataFrame) -> DataFrame:
    """(word, to): for words (word, types) those one error away that have more spellings: as many at least, and so many more
    that the word's own are two and an eighth of theirs at most. A person's misspelt name has few spellings at any size; what
    is misspelt often is so in proportion."""
    near = words.where(F.length("word") >= 5).select("word", "types", F.explode(_cuts("word")).alias("cut"))
    sure = near.select(F.col("word").alias("to"), F.col("types").alias("t"), "cut")
    return near.join(sure, "cut").where("word != to and t >= types and types <= 2 + t / 8").select("word", "to", "types", "t").distinct()


def _stem_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for g in pdf["given"]:
            rows += [(g, "s", x) for x in stems(g)]
            rows += [(g, "p", g[i:j]) for i in range(len(g)) for j in range(i + 2, min(len(g), i + 9) + 1) if (i, j) != (0, len(g))]
        yield pd.DataFrame(rows, columns=["given", "side", "part"])


def short_forms(names: DataFrame) -> DataFrame:
    """(given, formals): short forms of given names, from spellings (given, key) where ``key`` is the rest of the name.

    A pair is proposed where a stem of the short form stands in the full name, and kept where the two stand beside each other
    with equal rests in at least a fifth of the short form's rests and ten times as often as their frequencies would give."""
    held = names.where(F.length("given") >= 2).select("given", "key").distinct()
    n = written(held.groupBy("given").agg(F.count("*").alias("n")), "givens")
    total = held.select("key").distinct().count()
    parts = written(n.select("given").mapInPandas(_stem_batches, "given string, side string, part string").distinct(), "stems")
    full = parts.where("side = 'p'").select("part", F.col("given").alias("formal"))
    proposed = parts.where("side = 's'").select("part", "given").join(full, "part").where("given != formal and length(given) <= length(formal) + 1").select("given", "formal").distinct()
    both = proposed.join(held, "given").join(held.withColumnRenamed("given", "formal"), ["formal", "key"]).groupBy("given", "formal").agg(F.count("*").alias("k"))
    rated = both.join(n, "given").join(n.select(F.col("given").alias("formal"), F.col("n").alias("m")), "formal")
    kept = rated.where(F.col("k") >= F.greatest(0.2 * F.col("n"), 10.0 * F.col("n") * F.col("m") / F.lit(max(total, 1)))).where("k > 1 or n = 1").where("m >= k and (m > n or length(formal) > length(given))")
    # of a chain of forms the most frequent full one counts
    return kept.groupBy("given").agg(F.array_sort(F.collect_set("formal")).alias("found"))


def _roots(parents: DataFrame) -> DataFrame:
    """(name, parent) with every parent replaced by the root of its tree, by doubling the steps."""
    now = cut(parents)
    while True:
        up = now.select(F.col("name").alias("parent"), F.col("parent").alias("above"))
        step = cut(lookup_join(now, up, "parent"))
        moved = step.where("above is not null").limit(1).count()
        now = step.select("name", F.coalesce("above", "parent").alias("parent"))
        if not moved:
            return now


def link_names(strings: DataFrame, name: str = "name", most: float = 9.0) -> DataFrame:
    """(name, entity, n): each distinct spelling with the canonical spelling of its entity and how often it stands there."""
    counted = strings.select(F.col(name).alias("name")).where(F.trim(F.regexp_replace("name", r"(?U)\s+", " ")) != "").groupBy("name").agg(F.count("*").alias("n"))
    parsed = written(counted.mapInPandas(_parse_batches, PARSED), "names")
    # how often each word is a given and a family name where the spelling leaves no doubt
    clear = parsed.where("kind = 'p' and not unsure")
    roles = clear.where(F.length("given") > 1).select(F.col("given").alias("word"), F.lit(1).alias("g")).unionByName(clear.select(F.explode("family").alias("word"), F.lit(-1).alias("g")))
    degree = written(roles.groupBy("word").agg(F.sum("g").alias("lean"), F.sum(F.greatest("g", F.lit(0))).alias("deg")), "degrees")
    with_deg = parsed.withColumn("other", F.when(F.col("unsure"), F.col("family")[0]))
    with_deg = lookup_join(with_deg, degree.select(F.col("word").alias("given"), F.col("lean").alias("given_lean"), F.col("deg").alias("given_deg")), "given")
    with_deg = lookup_join(with_deg, degree.select(F.col("word").alias("other"), F.col("lean").alias("other_lean"), F.col("deg").alias("other_deg")), "other")
    turn = F.col("unsure") & (F.coalesce("other_lean", F.lit(0)) > F.coalesce("given_lean", F.lit(0)))
    names = with_deg.select(
        "name",
        "n",
        "kind",
        F.when(turn, F.col("other")).otherwise(F.col("given")).alias("given"),
        "middle",
        "particle",
        F.when(turn, F.array("given")).otherwise(F.col("family")).alias("family"),
        (F.col("whole") & ~turn).alias("whole"),
        F.coalesce(F.when(turn, F.col("other_deg")).otherwise(F.col("given_deg")), F.lit(0)).alias("given_deg"),
    )
    rest = F.concat_ws(" ", "family", "particle", "middle")
    found = written(short_forms(names.where("kind = 'p' and whole").select("given", rest.alias("key"))), "short")
    listed = F.create_map(*[x for k, v in IRREGULAR.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    nothing = F.array().cast("array<string>")
    formals = F.concat(F.array("given"), F.coalesce("found", nothing), F.coalesce(F.element_at(listed, F.col("given")), nothing))
    names = lookup_join(names, found, "given").withColumn("formals", F.when(F.col("kind") == "g", nothing).otherwise(F.array_distinct(formals))).drop("found")
    complete = F.col("whole") & ((F.col("kind") == "g") | ((F.length("given") > 2) & (F.size("formals") == 1)))
    names = written(names.withColumn("complete", complete), "read")
    family = names.select("name", F.explode(F.array_distinct("family")).alias("word"))
    fixes = written(_doubts(written(family.groupBy("word").agg(F.count("*").alias("types")), "words")), "fixes")
    givens = degree.where("deg > 0").select("word", F.col("deg").alias("types"))
    misheard = _doubts(givens).where("t > types").select(F.col("word").alias("given"), F.lit(True).alias("doubted")).distinct()
    unsettled = family.join(fixes.where("t > types").select("word").distinct(), "word", "left_semi").select("name", F.lit(True).alias("unsettled")).distinct()
    rank = F.struct(F.col("complete").alias("complete"), ((F.col("kind") == "g") | (F.col("doubted").isNull() & (F.col("given_deg") > 0))).alias("known"), F.col("unsettled").isNull().alias("settled"), F.col("n").alias("n"), F.size("family").alias("parts"), F.length("middle").alias("middle"), F.col("name").alias("name"))
    names = written(lookup_join(names.join(unsettled, "name", "left"), misheard, "given").withColumn("rank", rank).drop("unsettled", "doubted"), "ranked")
    links = written(family.unionByName(family.join(fixes.select("word", "to"), "word").select("name", F.col("to").alias("word"))).distinct(), "links")
    first = written(_attach(names, names.where("complete"), links, most, False), "parents")
    alone = names.join(first, "name", "left_anti")
    rest = alone.where("not complete")
    second = _attach(rest, rest, links, most, True)
    roots = _roots(first.unionByName(second))
    return names.select("name", "n").join(roots, "name", "left").select("name", F.coalesce("parent", "name").alias("entity"), "n")


def classes(entities: DataFrame) -> DataFrame:
    """(name, entity, n_links): each spelling with its entity's canonical spelling and the number of other spellings it has."""
    size = entities.groupBy("entity").agg(F.count("*").alias("k"))
    return entities.join(size, "entity").select("name", "entity", (F.col("k") - 1).alias("n_links"))


def variant_pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of spellings of one entity, name_a < name_b."""
    size = entities.groupBy("entity").agg(F.count("*").alias("k")).where("k > 1").select("entity")
    several = entities.join(size, "entity")
    a = several.select("entity", F.col("name").alias("name_a"))
    b = several.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


_CANONICAL = "struct<authors:array<struct<full_name:string>>>"


def author_strings(reference: DataFrame, metadata: DataFrame) -> DataFrame:
    """(name): every author string of both tables, as often as it stands there in distinct rows."""
    doc = F.from_json("metadata_json", f"canonical {_CANONICAL}, original struct<authors:array<string>>")
    meta = metadata.select("paper_id", doc.alias("j")).distinct()
    cited = reference.select("reference_no", "authors").distinct().select(F.explode("authors").alias("name"))
    return cited.unionByName(meta.select(F.explode("j.canonical.authors.full_name").alias("name"))).unionByName(meta.select(F.explode("j.original.authors").alias("name")))
