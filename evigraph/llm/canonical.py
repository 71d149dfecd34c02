"""Mapping of freely entered values to the canonical terms of a reference list (problem 1).

1. A multi-pattern automaton over canonical names and aliases finds the mentions embedded in a value, at word boundaries;
   the longest non-overlapping mentions win, and the longest of those is the value's term. A second automaton without
   spaces finds long names written together.
2. Values without a mention go to token-set similarity: every word of a name must be met by a word of the value, equal, an
   abbreviation of it, or within a few typing or reading errors; the name with most letters met, less its errors, wins. A
   mention that is only a part of such a longer, misspelt name gives way to it.
3. Values written together or in a related language have no words in common with the list; of these the tokens are the
   runs of three letters, after letters that European languages write for each other are made equal (k and c, ph and f),
   and the name of greatest Dice coefficient, rare runs counting more, wins from ``LIKE`` on.
4. What remains is reported as having no term.

Distinct values are mapped once and joined back. The reference list is read on the driver and must have at most
``MAX_TERMS`` rows; values are never collected. Nothing but the list is known of the terms: ``lexicon`` may add names to it
and is empty unless given.

Defined cases: a null value has no row, an empty or unmatchable value has the canonical ``''``; ties go to the name met
first in the value, then the canonical in order of code points; repeated rows count once; null or empty arrays have no
items, null items keep their position; a value of any length is scanned whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..runtime import written

MAX_TERMS = 10_000

#: Dice coefficient of the letter runs from which a value is taken for a name, and its lead over the next term.
LIKE, LEAD = 0.55, 0.08

# Greek letters by name, and words left out of token sets.
_GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega"}
_SMALL = frozenset("of the a an in at by to with and for de la le à der die das im mit".split())

_ORDINALS = {"1st": "first", "2nd": "second", "3rd": "third"}

_WORD = re.compile(r"[a-z0-9đß]+\.?")
_INDEXED = re.compile(r"(?<![^\W_])([^\W\d_])_\{?([^\W_]{1,3})\}?(?![^\W_])")


def flat(value: str) -> str:
    """Lower case without accents, Greek letters by name, single spaces for all signs but the stop of an abbreviation; a
    letter and its index are one word, ordinals are words."""
    s = unicodedata.normalize("NFKC", value).casefold()
    s = _INDEXED.sub(r"\1\2", s)
    s = re.sub(r"\b(1st|2nd|3rd)\b", lambda m: _ORDINALS[m[1]], s)
    s = "".join(f" {_GREEK[c]} " if c in _GREEK else c for c in s)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).replace("ß", "ss")
    s = re.sub(r"\bm\.\s?m\.", "molar mass", re.sub(r"\bm\.\s?p\.", "melting point", s))
    s = re.sub(r"\.s\b", ".", s).replace("moduli", "modulus")
    s = s.replace("''", " doubleprime ")
    s = re.sub(r"(?<=[a-z])'(?=[a-z])", "", s).replace("'", " prime ")
    s = re.sub(r"\bno\.", "number ", s)
    return " ".join(_WORD.findall(s))


def words(flat_value: str) -> list[str]:
    return [w for w in flat_value.split() if w.rstrip(".") not in _SMALL]


def plain(flat_value: str) -> str:
    return flat_value.replace(".", "")


def look(word: str) -> str:
    """Forms that are misread for each other become the same."""
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b")):
        word = word.replace(a, b)
    return word


def distance(a: str, b: str, most: int) -> int:
    """Edits between a and b (insert, delete, replace, swap of neighbours); ``most`` + 1 stands for any greater number. Only the
    band of ``most`` letters about the diagonal is worked, so long strings cost in proportion to their length."""
    n, m, far = len(a), len(b), most + 1
    if abs(n - m) > most:
        return far
    two: list[int] = []
    one = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        x, lo, hi = a[i - 1], max(1, i - most), min(m, i + most)
        now = [far] * (m + 1)
        if i <= most:
            now[0] = i
        least = now[0]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            d = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now[j] = d = min(d, far)
            least = min(least, d)
        if least > most:
            return far
        two, one = one, now
    return one[m]


#: What European languages write for each other in words of Greek and Latin origin.
COGNATES = (("sch", "sh"), ("ph", "f"), ("th", "t"), ("rh", "r"), ("k", "c"), ("qu", "c"), ("z", "c"), ("y", "i"), ("ie", "i"), ("ae", "e"), ("oe", "e"), ("ll", "l"), ("ss", "s"), ("mm", "m"))


def runs_of(flat_value: str) -> set[str]:
    """The runs of three letters of a value written together, cognate letters made equal."""
    s = plain(flat_value).replace(" ", "")
    for a, b in COGNATES:
        s = s.replace(a, b)
    return {s[i : i + 3] for i in range(len(s) - 2)}


def _less(word: str, most: int) -> set[str]:
    """A word and what it leaves without up to ``most`` letters."""
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def _errors_of(word: str) -> int:
    """Errors that a word of this length may have."""
    return 0 if len(word) < 4 else 1 if len(word) < 9 else 2


class Mapper:
    """The terms of one type."""

    def __init__(self, names: list[tuple[str, str]]):
        import ahocorasick

        self.spaced, self.joined = ahocorasick.Automaton(), ahocorasick.Automaton()
        self.names: list[tuple[str, Counter, int]] = []
        self.parts: dict[str, list[int]] = {}
        self.begun: dict[str, list[str]] = {}  # beginning -> words of names
        self.less: dict[str, set[str]] = {}  # what a word leaves with letters left out -> words of names
        self.tight: dict[str, str] = {}
        self.runs: dict[str, list[int]] = {}
        self.sizes: list[tuple[set[str], str, str]] = []
        self.met: dict[str, list[tuple[str, int]]] = {}
        for name, canonical in sorted(names, key=lambda x: (x[1], x[0])):
            text = flat(name)
            key = plain(text)
            if not key:
                continue
            if key not in self.spaced:
                self.spaced.add_word(key, (len(key), canonical))
            tight = key.replace(" ", "")
            self.tight.setdefault(tight, canonical)
            if len(tight) >= 8 and tight not in self.joined:
                self.joined.add_word(tight, (len(tight), canonical))
            found = runs_of(text)
            for r in found:
                self.runs.setdefault(r, []).append(len(self.sizes))
            self.sizes.append((found, canonical, key))
            tokens = Counter(plain(w) for w in words(text))
            if tokens and sum(map(len, tokens)) >= 5:
                for t in tokens:
                    self.parts.setdefault(t, []).append(len(self.names))
                self.names.append((canonical, tokens, sum(len(t) * n for t, n in tokens.items())))
        self.weigh = {r: math.log(1 + len(self.sizes) / len(of)) for r, of in self.runs.items()}
        self.whole = [sum(self.weigh[r] for r in found) for found, *_ in self.sizes]
        for t in self.parts:
            for i in range(2, len(t) + 1):
                self.begun.setdefault(t[:i], []).append(t)
            for form in {t, look(t)}:
                for w in _less(form, _errors_of(t)):
                    self.less.setdefault(w, set()).add(t)
        for a in (self.spaced, self.joined):
            if len(a):
                a.make_automaton()

    def mention(self, automaton, text: str, bounded: bool) -> tuple[int, str] | None:
        """(length, canonical) of the longest mention."""
        if not len(automaton):
            return None
        hits = []
        for last, (n, canonical) in automaton.iter(text):
            start = last - n + 1
            if not bounded or ((start == 0 or text[start - 1] == " ") and (last + 1 == len(text) or text[last + 1] == " ")):
                hits.append((-n, start, canonical))
        if not hits:
            return None
        n, _, canonical = min(hits)  # the longest never overlaps a longer one, so it is among the winners
        return -n, canonical

    def similar_words(self, word: str) -> list[tuple[str, int]]:
        """(word of a name, errors) that ``word`` may stand for, by the index of what words leave with letters left out."""
        if word not in self.met:
            if len(self.met) > 500_000:
                self.met.clear()
            bare = word.rstrip(".")
            out = {t: 0 for t in self.begun.get(bare, ()) if t == bare or word.endswith(".") and len(bare) >= 2}
            if bare.endswith("s") and bare[:-1] in self.parts:
                out.setdefault(bare[:-1], 1)
            if len(bare) >= 4:
                for t in {t for form in {bare, look(bare)} for w in _less(form, _errors_of(bare)) for t in self.less.get(w, ())}:
                    if t not in out and len(t) >= 4:
                        most = min(_errors_of(t), _errors_of(bare))
                        d = min(distance(bare, t, most), distance(look(bare), look(t), most))
                        if d <= most:
                            out[t] = max(d, 1)
            self.met[word] = sorted(out.items())
        return self.met[word]

    def similar(self, value: str) -> tuple[int, str]:
        """(letters met, canonical) of the name most alike in words; (0, '') if there is none."""
        best: dict[str, list[int]] = {}  # word of a name -> errors of the value's words for it, fewest first
        for w in words(value):
            for t, d in self.similar_words(w):
                best.setdefault(t, []).append(d)
        found, first = [], {w[0] for w in words(value)}
        for i in {i for t in best for i in self.parts[t]}:
            canonical, tokens, letters = self.names[i]
            if all(len(best.get(t, ())) >= n for t, n in tokens.items()):
                errors = sum(sum(sorted(best[t])[:n]) for t, n in tokens.items())
                alone = len(tokens) == 1 and errors and next(iter(tokens))[0] not in first  # roughness is not toughness
                if errors <= 2 + (len(tokens) > 2) and not alone:
                    found.append((4 * errors - letters, canonical, letters))
        return min(found)[:0:-1] if found else (0, "")

    def _rest(self, text: str, name: str) -> float:
        """Dice coefficient of what a value and a name have besides the words they share; 1 if they share none."""
        a, b = plain(text).split(), name.split()
        if not (same := set(a) & set(b)):
            return 1.0
        x, y = (runs_of(" ".join(w for w in ws if w not in same)) for ws in (a, b))
        return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0

    def alike(self, text: str) -> str:
        """The name whose letter runs are most like the value's."""
        own, strange = runs_of(text), math.log(1 + len(self.sizes))
        total = sum(self.weigh.get(r, strange) for r in own)
        shared: dict[int, float] = {}
        for r in own:
            for i in self.runs.get(r, ()):
                shared[i] = shared.get(i, 0.0) + self.weigh[r]
        best: dict[str, float] = {}
        for i, k in shared.items():
            if (x := 2 * k / (total + self.whole[i])) > 0.5 * LIKE:
                canonical = self.sizes[i][1]
                best[canonical] = max(best.get(canonical, 0.0), min(x, self._rest(text, self.sizes[i][2])))
        first, second, *_ = sorted(((-x, c) for c, x in best.items()), key=lambda x: x) + [(0.0, ""), (0.0, "")]
        return first[1] if -first[0] >= LIKE and second[0] - first[0] >= LEAD else ""

    def canonical(self, value: str) -> str:
        text = flat(value)
        tight = plain(text).replace(" ", "")
        if tight in self.tight:
            return self.tight[tight]
        said = self.mention(self.spaced, plain(text), True) or self.mention(self.joined, tight, False)
        letters, alike = self.similar(text)
        # a longer name with an error in it holds over a shorter one that is part of it
        return alike if alike and (not said or letters > said[0] + 3) else said[1] if said else self.alike(text)


def _map_batches(names: dict[str, list[tuple[str, str]]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mappers = {k: Mapper(v) for k, v in names.items()}
        for pdf in batches:
            pdf["canonical"] = [mappers[k].canonical(v) if k in mappers else "" for k, v in zip(pdf["term_type"], pdf["raw"], strict=True)]
            yield pdf

    return run


def map_values(values: DataFrame, terms: DataFrame, lexicon: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(term_type, raw, n, canonical): the distinct values (term_type and raw, not null), how often each stands there and its
    term. Collects ``terms``, of bounded size."""
    rows = terms.select("term_type", "canonical", "aliases").where("canonical is not null").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the reference list has more than {MAX_TERMS} rows")
    names: dict[str, list[tuple[str, str]]] = {}
    for r in rows:
        own = [r["canonical"], *(r["aliases"] or []), *(lexicon or {}).get(r["canonical"], ())]
        names.setdefault(r["term_type"], []).extend((a, r["canonical"]) for a in own if a)
    counted = values.groupBy("term_type", "raw").agg(F.count("*").alias("n"))
    counted = counted.repartition(2 * values.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work: else one task
    return counted.mapInPandas(_map_batches(names), "term_type string, raw string, n bigint, canonical string")


def map_terms(values: DataFrame, terms: DataFrame, lexicon: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``values`` (with term_type and raw, not null) with the column ``canonical``."""
    own, key = written(values, "values"), F.concat("term_type", F.lit("\1"), "raw")
    mapped = written(map_values(own, terms, lexicon).select(key.alias("__key"), "canonical"), "mapped")
    return lookup_join(own.withColumn("__key", key), mapped, "__key").select(*values.columns, F.coalesce("canonical", F.lit("")).alias("canonical"))


def _items(array: Column, field: str, kind: str) -> Column:
    return F.transform(array, lambda x, i: F.struct(F.lit(kind).alias("term_type"), (i + 1).alias("item_no"), x[field].alias("raw")))


def entered_values(inventory: DataFrame) -> DataFrame:
    """(inventory_id, term_type, item_no, raw) of the entries whose raw value is not null."""
    nothing = F.array().cast("array<struct<term_type:string,item_no:int,raw:string>>")
    rows = inventory.select("inventory_id", F.coalesce(_items(F.col("studied_properties"), "property_raw", "property"), nothing).alias("p"), F.coalesce(_items(F.col("methods"), "method_raw", "method"), nothing).alias("m"))
    return rows.select("inventory_id", F.inline(F.concat("p", "m"))).where("raw is not null").distinct()
