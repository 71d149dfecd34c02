r"""Repair of text from scanned pages (problem 3).

Page furniture (running heads, page numbers, marks of the scan) is set aside; the pieces of all other lines of a record are
read as one stream, line ends gone, by the cheapest path through a lattice: a step takes a piece as it stands, as a
misreading of a known word, as two words run together, two or three pieces as one torn word, whole or misread, or the two
sides of a line end as one word, with or without its hyphen. A step's cost is fixed by its kind; among the words that a step
may mean the one of greatest log frequency in the corpus, less its confusions, is taken. Stretches in which every piece is
a word that leaves no doubt have one path and are not worked. Paragraph boundaries are then chosen by dynamic programming
over the lines.

What a piece may stand for is looked up by joins, not by shipping the vocabulary: texts are worked in batches of bounded
size, a batch asks for the words whose skeleton (confusable signs made equal) equals that of its own pieces and joins, and
gets only those. Word counts cover the whole corpus; words of clean prose count as certain. The words that make up a
``SHARE`` of the prose or more, which are one in ``SHARE`` at most, are known to all workers; nothing else that is decided
depends on the rest of a batch, so the batches may be cut in any way.

Defined cases: null texts have no rows, blank ones no lines; a text of any length is one record of its batch; lines are
divided at ``\n`` and counted from 1, blank ones included; words of the record's own authors are never corrected; where
nothing is known, a sign that no word has (a digit, ``@``, ``+``) is read as the letter it is most like; repeated rows count once.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written

#: Code points of text a batch holds on average.
BATCH_POINTS = 1_500_000
#: A word is common if it is at least one in so many words of clean prose; there can be no more such words than that.
SHARE = 8_000

# What scanners read (right -> misread).
CONFUSIONS: tuple[tuple[str, str], ...] = (
    ("a", "@"), ("c", "("), ("d", "cl"), ("e", "c"), ("g", "9"), ("h", "b"), ("i", "í"), ("i", "1"), ("in", "m"), ("l", "1"), ("li", "h"), ("m", "rn"), ("o", "0"), ("s", "5"), ("s", "ſ"), ("t", "+"), ("t", "f"), ("u", "ii"), ("w", "vv"), ("y", "v"), ("b", "6"), ("b", "8"), ("z", "2"),
)
_SIGNS = str.maketrans({"@": "a", "(": "c", "e": "c", "9": "g", "b": "h", "í": "i", "1": "l", "0": "o", "5": "s", "ſ": "s", "+": "t", "f": "t", "y": "v", "6": "h", "8": "h", "2": "z"})
_SIGN_BYTES = bytes(_SIGNS.get(i, chr(i)).encode()[0] if i < 128 and _SIGNS.get(i, chr(i)).isascii() else i for i in range(256))
_LIKE = str.maketrans({"@": "a", "(": "c", "9": "g", "1": "l", "0": "o", "5": "s", "ſ": "s", "+": "t", "6": "b", "8": "b"})
_FRONT = ".,;:!?()[]{}<>\"'“”„«»‘’…·|"
_BACK = ".,;:!?)]}<>\"'“”„«»‘’…·|"
_HYPHENS = "-‐¬­"
HEAD = "\1"


#: Words whose skeletons a worker keeps; a bound on memory, not on what is worked.
KEPT = 100_000


@lru_cache(KEPT)
def skeleton(word: str) -> str:
    s = word.encode().translate(_SIGN_BYTES).decode() if word.isascii() else word.translate(_SIGNS)
    for a, b in (("vv", "w"), ("ii", "u"), ("rn", "m"), ("in", "m"), ("cl", "d"), ("li", "h")):
        s = s.replace(a, b)
    return s


def misread(right: str, seen: str) -> int | None:
    """Confusions that turn ``right`` into ``seen``; None if it is impossible or more than two and one for each eight letters."""
    most = 2 + len(right) // 8
    states = {(0, 0): 0}
    best = None
    while states:
        (i, j), n = states.popitem()
        while i < len(right) and j < len(seen):
            if n < most:
                for a, b in CONFUSIONS:
                    if right.startswith(a, i) and seen.startswith(b, j):
                        key = (i + len(a), j + len(b))
                        states[key] = min(n + 1, states.get(key, 9))
            if right[i] != seen[j]:
                break
            i, j = i + 1, j + 1
        else:
            if i == len(right) and j == len(seen) and (best is None or n < best):
                best = n
    return best or None


def core(piece: str) -> str:
    return piece.lower().lstrip(_FRONT).rstrip(_BACK)


_N = r"(?:\d|[lIOo](?=[\dlIOo]*\d)|(?<=\d)[lIOo]|(?<=\d[lIOo])[lIOo]|(?<=\d[lIOo]{2})[lIOo]){1,5}"
_NUMBER = re.compile(rf"^(?:[-–—]\s*{_N}\s*[-–—]|\[{_N}\]|{_N})$")
_PAGE_SIGNS = str.maketrans("@", "a")
_PAGED = re.compile(rf"^(?:p|pp|s|pa[g9][ec]|[s5]eite)\.?\s*{_N}(?:\s+\S{{1,3}}\s+{_N})?$", re.I)
_TAIL = re.compile(r"(?:\s*·\s*\S{3,4}\.?\s*\S{1,4}|,\s*\S{4}|\s{2,}\S{1,5}|\s+\S{1,4}\s*\(\S{4}\)\s*\S{1,6}\s*[–-]\s*\S{1,6})$")
_MARKS = tuple(skeleton(m) for m in ("scanned copy", "downloaded f", "digitized by", "digitised by", "copyright ©"))
_AUTHORS = re.compile(rf"^(?:{_N}\s{{2,}}\S.*? et a[l1]\.?|\S.*? et a[l1]\.?\s{{2,}}{_N})$")
_NUMBER_FIRST = frozenset("0123456789lIOo-–—[")
_NO_LETTER = re.compile(r"[\W\d_]+")
_WORKERS = skeleton("co-workers")


def head_keys(line: str) -> list[str]:
    """The letters of what may be a running title in ``line``, as skeletons."""
    s = line.strip()
    if not (s[-1] in "0123456789lOIo" and any(c.isdigit() for c in s[-4:]) or " / " in s or s.isupper()):
        return []
    parts = [s, _TAIL.sub("", s)]
    if re.match(rf"^{_N}\s{{2,}}", s):
        parts.append(re.sub(r"^\S+\s+", "", s))
    if " / " in s:
        parts.append(s.split(" / ", 1)[1])
    return list(dict.fromkeys(k for p in parts if len(k := title_key(p)) >= 5))


def title_key(title: str) -> str:
    return _NO_LETTER.sub("", skeleton(title.lower()))


def is_furniture(line: str, heads) -> bool:
    s = line.strip()
    if s[0] in _NUMBER_FIRST and _NUMBER.match(s) or s[0] in "pPsS5" and _PAGED.match(s.lower().translate(_PAGE_SIGNS)):
        return True
    if (" et a" in s and _AUTHORS.match(s) or s[0] in "SDCsdc5ſ(" and skeleton(s[:14].lower()).startswith(_MARKS) or s.isupper() and skeleton(s[-12:].lower()).endswith(_WORKERS)):
        return True
    return any(k in heads for k in head_keys(s))


class Lines:
    """The lines of a record: which are furniture, the pieces of the others as one stream, and where hyphens end lines."""

    def __init__(self, text: str, heads, single_ok: bool):
        self.raw = [x.rstrip("\r") for x in text.split("\n")]
        self.furniture = [i for i, x in enumerate(self.raw) if x.strip() and (single_ok or len(self.raw) > 1) and is_furniture(x, heads)]
        skip = set(self.furniture)
        self.text = [i for i, x in enumerate(self.raw) if x.strip() and i not in skip]
        self.pieces = {i: self.raw[i].split() for i in self.text}
        self.at = [(i, k) for i in self.text for k in range(len(self.pieces[i]))]  # line and place of each piece of the stream
        self.joins: dict[int, tuple[str, str, str]] = {}  # place in the stream -> first part, second part, hyphen
        end = -1
        for i, j in zip(self.text, self.text[1:], strict=False):
            end += len(self.pieces[i])
            last = self.pieces[i][-1]
            if len(last) > 1 and last[-1] in _HYPHENS and (last[-2].isalpha() or last[-2] in "@+(1059"):
                a, b = last[:-1].lower().lstrip(_FRONT), core(self.pieces[j][0])
                if a and b and b[0].isalpha() | (b[0] in "@+(1059"):
                    self.joins[end] = (a, b, last[-1])
        self.stream = [p for i in self.text for p in self.pieces[i]]


def _wordlike(w: str) -> bool:
    if w.isalpha():
        return len(w) >= 2
    letters = sum(map(str.isalpha, w))
    return letters >= 2 and letters * 2 >= len(w)


def _compound(w: str) -> list[str]:
    return [p for p in w.split("-") if len(p) > 2] if "-" in w else []


def _whole(piece: str) -> bool:
    """No sign before or behind the piece."""
    return piece.lower() == core(piece)


def _torn_parts(v: str, w: str, first: str, second: str, never, common) -> bool:
    """Whether two neighbours may be parts of one word: not both of them common."""
    return second[0].islower() and first[-1].isalpha() and len(v) + len(w) >= 4 and v.isalpha() and not (v in common and w in common) and v not in never and w not in never


def batch_forms(records: list[tuple[str, bool, frozenset]], common: frozenset) -> tuple[Counter, set[str], set[str]]:
    """Of (text, is a page, words never corrected): words with counts, other forms asked for, keys of possible heads."""
    pieces: Counter = Counter()
    left_out: Counter = Counter()
    asked: set[str] = set()
    heads: set[str] = set()
    read = []
    for text, page, never in records:
        r = Lines(text, (), page)
        read.append((r, never))
        for i in r.text:
            heads.update(head_keys(r.raw[i]))
        pieces.update(r.stream)
        left_out.update(r.stream[k + d] for k in r.joins for d in (0, 1))
        for a, b, _ in r.joins.values():
            asked |= {a + b, f"{a}-{b}", a, b, "-" + b}
    bare = {p: core(p) for p in pieces}
    for r, never in read:
        if never:
            used = {k + d for k in r.joins for d in (0, 1)}
            left_out.update(p for k, p in enumerate(r.stream) if bare[p] in never and k not in used)
    words: Counter = Counter()
    for piece, n in pieces.items():
        w = bare[piece]
        if n > left_out[piece] and _wordlike(w):
            words[w] += n - left_out[piece]
            if piece[0] == "(":
                asked.add("(" + w)
    rare = {p for p, w in bare.items() if w not in common}
    for r, never in read:
        before = ""
        for a, b in zip(r.stream, r.stream[1:], strict=False):
            if a in rare or b in rare:
                v, w = bare[a], bare[b]
                if _torn_parts(v, w, a, b, never, common):
                    asked.add(v + w)
                    if before and a in rare and b in rare and len(v) < 5:  # a middle part is short
                        asked.add(before + v + w)
                before = v if a in rare and v.isalpha() and v not in never and len(v) < 8 else ""
            else:
                before = ""
    for w in [*words, *asked]:
        if "-" in w:
            asked.update(_compound(w))
    return words, asked - set(words), heads


class Reader:
    """Decodes records with the dictionary of their batch: word -> (count in clean prose, count in scans), and the common words."""

    def __init__(self, entries: dict[str, tuple[int, int]], heads: set[str], by: dict[str, list[str]], common: frozenset = frozenset()):
        self.n, self.heads, self.common = entries, heads, common
        self.by = by  # skeleton -> words
        self.memo: dict[str, str | None] = {}
        self.firm: dict[str, int] = {}

    def look_at(self, piece: str) -> int:
        """0: no word and no part of one, 1: a word of clean prose, 2: anything else. Kept for the pieces seen."""
        w = core(piece)
        clean = self.n.get(w, (0, 0))[0]
        sort = (1 if clean else 2) if w.isalpha() else 0 if not any(map(str.isalpha, w)) or re.fullmatch(r"[a-z]\d+", w) else 1 if clean else 2
        if sort == 1 and w not in self.common and len(w) < 6:  # a short word may be half of a torn one
            sort = 2
        self.firm[piece] = sort
        return sort

    def weight(self, w: str) -> float:
        clean, scans = self.n.get(w, (0, 0))
        return 3.0 * clean + scans

    def known(self, w: str) -> bool:
        return self.n.get(w, (0, 0))[0] > 0

    def candidate(self, w: str) -> str | None:
        own, odd = self.n.get(w, (0, 0)), _odd(w)
        found = []
        for c in self.by.get(skeleton(w), ()):
            if c != w and not _odd(c) and (d := misread(c, w)):
                clean, scans = self.n[c]
                if clean or odd or scans >= 3 * max(own[1], 1):
                    found.append((math.log(1 + self.weight(c)) - 3 * d, c))
        return max(found)[1] if found else None

    def right(self, w: str) -> str | None:
        """The word that ``w`` misreads; None if it stands as it is."""
        if w not in self.memo:
            self.memo[w] = self._right(w)
        return self.memo[w]

    def _right(self, w: str) -> str | None:
        if self.known(w) or len(w) < 3:
            return None
        if found := self.candidate(w):
            return found
        if "-" in w:
            parts = w.split("-")
            fixed = [self.right(p) or p for p in parts]
            if fixed != parts:
                return "-".join(fixed)
            return None
        if _odd(w) and sum(map(str.isalpha, w)) >= 3 and not re.search(r"\d{2}|^\d|^[a-z]\d", w):
            return w.translate(_LIKE)
        return None

    def torn(self, a: str, b: str) -> bool:
        ab = a + b
        clean, scans = self.n.get(ab, (0, 0))
        if not clean and scans < 2:
            return False
        na, nb = self.n.get(a, (0, 0)), self.n.get(b, (0, 0))
        if na[0] and nb[0]:
            return 50 * min(na[0], nb[0]) < clean
        if not clean and (na[1] >= scans and nb[1] >= scans):
            return False
        return True

    def run_together(self, w: str) -> tuple[str, str] | None:
        """The two common words that an unknown word is made of."""
        if len(w) < 6 or not w.isalpha() or self.n.get(w, (0, 0))[1] > 2 or self.known(w):
            return None
        found = [(min(k, len(w) - k), w[:k], w[k:]) for k in range(2, len(w) - 1) if w[:k] in self.common and w[k:] in self.common]
        return max(found)[1:] if found else None

    def joined(self, a: str, b: str, hyphen: str) -> str:
        base, kept = a + b, f"{a}-{b}"
        x, y = self.weight(base), self.weight(kept)
        if x or y:
            return kept if y > x else base
        for w in (kept, base):
            if found := self.candidate(w):
                return found
        tail = self.n.get("-" + b, (0, 0))[0]
        if tail and self.weight(a) and tail > self.weight(base):
            return kept
        return self.right(base) or base


def _odd(w: str) -> bool:
    return any(c in "@+(ſ" or c.isdigit() for c in w) and any(map(str.isalpha, w))


def findings(text: str, page: bool, never: frozenset, reader: Reader) -> list[tuple[int, str, str]]:
    """(line number, kind, word) of a record."""
    r = Lines(text, reader.heads, page)
    out = [(i + 1, "furniture", "") for i in r.furniture]
    for places, words in decode(r, never, reader):
        if len(words) == 1:
            first, last = r.at[places[0]][0], r.at[places[-1]][0]
            out.append((first + 1, "ocr" if first == last else "hyphen", words[0]))
    return out


#: Costs of the steps: a known word, a strange piece, a misreading, a torn word, one in three parts, a torn and misread word, words
#: run together, a word over a hyphen at a line end.
_SURE, _STRANGE, _FIXED, _JOINED, _THREE, _BOTH, _APART, _HYPHEN = 0.0, 2.0, 1.0, -0.5, -0.4, 1.5, 1.2, -9.0


def decode(r: Lines, never: frozenset, reader: Reader) -> list[tuple[range, tuple[str, ...]]]:
    """(places in the stream, right words) of what is not read as it stands, in order: the cheapest path over each stretch that
    holds a piece which is no sure word."""
    pieces, firm, joins = r.stream, reader.firm, r.joins
    n = len(pieces)
    sorts = list(map(firm.get, pieces))
    if None in sorts:
        sorts = [reader.look_at(p) if s is None else s for p, s in zip(pieces, sorts, strict=True)]
    for k in joins:
        sorts[k] = sorts[k + 1] = 2
    if 2 not in sorts:
        return []
    out, k = [], 0
    while k < n:
        if sorts[k] != 2 and (k + 1 == n or sorts[k + 1] != 2) or sorts[k] == 0:
            k += 1
            continue
        stop = k + 1
        while stop < n and (sorts[stop] == 2 or sorts[stop] == 1 and sorts[stop - 1] == 2):
            stop += 1
        out += _cheapest(r, k, stop, never, reader)
        k = stop
    return out


def _cheapest(r: Lines, lo: int, hi: int, never: frozenset, reader: Reader) -> list[tuple[range, tuple[str, ...]]]:
    pieces, joins, common, n = r.stream, r.joins, reader.common, reader.n
    cores = [core(p) for p in pieces[lo:hi]]
    taken = [lo + k in joins or lo + k - 1 in joins for k in range(hi - lo)]
    best: list[tuple[float, int, tuple[str, ...]]] = [(0.0, 0, ())]  # cost up to here, pieces of the last step, its right words
    for k, w in enumerate(cores):
        piece, at = pieces[lo + k], lo + k
        cost, right = _SURE, ()
        free = not taken[k] and w not in never
        if free and _wordlike(w) and not reader.known(w):
            one = reader.right(w)
            if one is None and piece[0] == "(" and reader.candidate("(" + w) == "c" + w:
                one = "c" + w
            cost, right = (_FIXED, (one,)) if one else (_STRANGE, ())
            if not one and (apart := reader.run_together(w)) and 0 < r.at[at][1] and at + 1 < len(pieces) and r.at[at + 1][0] == r.at[at][0]:  # ends of lines may be halves
                cost, right = _APART, apart
        step = (best[k][0] + cost, 1, right)
        if k and at - 1 in joins:
            step = min(step, (best[k - 1][0] + _HYPHEN, 2, (reader.joined(*joins[at - 1]),)), key=lambda x: x[0])
        elif k and free and not taken[k - 1]:
            v, first = cores[k - 1], pieces[at - 1]
            if v and _torn_parts(v, w, first, piece, never, common):
                over = r.at[at - 1][0] != r.at[at][0]
                bare = not reader.known(v) and not reader.known(w)
                if reader.torn(v, w) and (not over or bare and reader.known(v + w)):
                    step = min(step, (best[k - 1][0] + _JOINED, 2, (v + w,)), key=lambda x: x[0])
                elif bare and not over and v + w not in n and (both := reader.candidate(v + w)) and reader.known(both):
                    step = min(step, (best[k - 1][0] + _BOTH, 2, (both,)), key=lambda x: x[0])
                u = cores[k - 2] if k > 1 and not taken[k - 2] else ""
                if u and bare and not over and r.at[at - 2][0] == r.at[at][0] and len(v) < 5 and len(u) < 8 and u not in common and not reader.known(u) and u.isalpha() and u not in never and reader.known(u + v + w):
                    step = min(step, (best[k - 2][0] + _THREE, 3, (u + v + w,)), key=lambda x: x[0])
        best.append(step)
    out, k = [], len(cores)
    while k:
        _, size, right = best[k]
        if right:
            out.append((range(lo + k - size, lo + k), right))
        k -= size
    return out[::-1]


def _recase(right: str, piece: str) -> str:
    lead = piece[: len(piece) - len(piece.lstrip(_FRONT))]
    rest = piece[len(lead) :]
    tail = rest[len(rest.rstrip(_BACK)) :]
    return lead + (right.capitalize() if rest[:1].isupper() else right) + tail


def restored(text: str, page: bool, never: frozenset, reader: Reader) -> list[str]:
    """The paragraphs of a record as continuous text."""
    r = Lines(text, reader.heads, page)
    if not r.text:
        return []
    fixed: dict[int, list[str]] = {i: [] for i in r.text}
    steps = {places[0]: (places, words) for places, words in decode(r, never, reader)}
    k, over = 0, set()
    while k < len(r.stream):
        places, words = steps.get(k, (range(k, k + 1), ()))
        i = r.at[k][0]
        pieces = [r.stream[p] for p in places]
        if len(words) == 2:
            lead = len(pieces[0]) - len(pieces[0].lstrip(_FRONT))
            cut_at = lead + len(words[0])
            fixed[i] += [pieces[0][:cut_at], pieces[0][cut_at:]]
        elif words:
            whole = "".join(p[:-1] if q in r.joins else p for q, p in zip(places, pieces, strict=True))
            fixed[i].append(_recase(words[0], whole))
            if r.at[places[-1]][0] != i:
                over.add(i)
        else:
            fixed[i] += pieces
        k += len(places)
    # paragraph boundaries: the cheapest labelling of the gaps between lines; states are paragraphs of one line and longer ones
    joined = over
    width = sorted(len(r.raw[i]) for i in r.text)[len(r.text) * 3 // 4]

    def title(i: int) -> bool:
        line = r.raw[i].strip()
        return len(line) < 0.6 * width and line[-1] not in ".!?。”»),;:-" and i not in joined and (line[0].isupper() or line[0].isdigit())

    states: dict[bool, tuple[float, tuple]] = {True: (0.0, (r.text[0], None))}  # one line so far -> cost, linked first lines
    for i, j in zip(r.text, r.text[1:], strict=False):
        blank = any(not r.raw[k].strip() for k in range(i + 1, j))
        indent = len(r.raw[j]) - len(r.raw[j].lstrip()) >= 2
        stopped = r.raw[i].rstrip()[-1:] in ".!?。”»)"
        short = len(r.raw[i]) < 0.75 * width
        gain = 2.5 * blank + 3 * indent + (1.5 if stopped else -2.5) + 1.5 * short + 6 * title(i) + 3 * title(j) - 3.0
        if i in joined:
            gain = -99.0
        go = min(cost for cost, _ in states.values()), min(states.values(), key=lambda x: x[0])[1]
        new = [(cost + (1.0 if one and not title(i) else 0.0) - gain, (j, at)) for one, (cost, at) in states.items()]
        states = {False: go, True: min(new, key=lambda x: x[0])}
    node, starts = min(states.values(), key=lambda x: x[0])[1], []
    while node:
        starts.append(node[0])
        node = node[1]
    starts.reverse()
    out, at = [], 0
    bounds = [*starts[1:], r.text[-1] + 1]
    for stop in bounds:
        words = []
        while at < len(r.text) and r.text[at] < stop:
            words += fixed[r.text[at]]
            at += 1
        if words:
            out.append(" ".join(words))
    return out


def scan_records(paper_json: DataFrame, reference: DataFrame) -> DataFrame:
    """(origin, record_no, text, never): the scanned records and, for references, the words of their authors. Repeated rows
    are left out where their batch is worked."""
    pages = paper_json.where("kind = 'page_text'").select(F.lit("paper_json").alias("origin"), F.col("block_id").alias("record_no"), "text", F.lit("").alias("never"))
    names = F.lower(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), " "))
    refs = reference.select(F.lit("reference").alias("origin"), F.col("reference_no").alias("record_no"), F.col("raw_reference").alias("text"), names.alias("never"))
    return pages.unionByName(refs).where("text is not null")


def _clean_counts(prose: DataFrame) -> DataFrame:
    token = F.explode(F.split(F.lower("text"), r"(?U)\s+"))
    front, back = re.escape(_FRONT), re.escape(_BACK)
    bare: Column = F.regexp_replace("token", rf"^[{front}]+|[{back}]+$", "")
    words = prose.where("text is not null").select(token.alias("token")).groupBy("token").agg(F.count("*").alias("n")).select(bare.alias("word"), "n").where("word != ''")
    forms = F.when(F.col("word").contains("-"), F.array("word", F.concat(F.lit("-"), F.element_at(F.split("word", "-"), -1)))).otherwise(F.array("word"))
    return words.select(F.explode(forms).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("clean"))


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(key=[skeleton(w) for w in pdf["word"]])


def _title_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"key": [HEAD + title_key(t) for t in pdf["title"]]}).drop_duplicates()


@contextmanager
def _uncollected():
    """Without pauses for cyclic garbage, of which a batch makes none."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _once(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.drop_duplicates(["origin", "record_no"])


def _records(pdf: pd.DataFrame) -> list[tuple[str, bool, frozenset]]:
    return [(t, o == "paper_json", frozenset(map(core, v.split())) if v else frozenset()) for t, o, v in zip(pdf["text"], pdf["origin"], pdf["never"], strict=True)]


def _ask(common: frozenset):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _once(pdf)
        with _uncollected():
            words, asked, heads = batch_forms(_records(pdf), common)
            keys = {skeleton(w) for w in words} | {skeleton(w) for w in asked} | {HEAD + h for h in heads}
        a, b = len(words), len(keys)
        return pd.DataFrame({"batch": pdf["batch"].iloc[0], "key": [None] * a + list(keys), "word": [*words, *[None] * b], "n": [*words.values(), *[0] * b]})

    return run


def _decode(found: bool, common: frozenset):
    def run(records: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        with _uncollected():
            records = _once(records)
            entries, heads, by = {}, set(), {}
            for key, word, clean, scans in zip(*(dictionary[c].tolist() for c in ("key", "word", "clean", "scans")), strict=True):
                if key.startswith(HEAD):
                    heads.add(key[len(HEAD) :])
                else:
                    entries[word] = (clean, scans)
                    by.setdefault(key, []).append(word)
            reader = Reader(entries, heads, by, common)
            rows = []
            for (text, page, never), origin, no in zip(_records(records), records["origin"], records["record_no"], strict=True):
                if found:
                    rows += [(origin, no, *x) for x in dict.fromkeys(findings(text, page, never, reader))]
                else:
                    rows += [(origin, no, k, p) for k, p in enumerate(restored(text, page, never, reader), 1)]
            return pd.DataFrame(rows, columns=["origin", "record_no", "line_no", "kind", "word"] if found else ["origin", "record_no", "paragraph_no", "text"])

    return run


def repair(records: DataFrame, prose: DataFrame, titles: DataFrame, found: bool = True) -> DataFrame:
    """Findings (origin, record_no, line_no, kind, word) or, with ``found`` false, paragraphs (origin, record_no,
    paragraph_no, text). ``prose`` has clean ``text``, ``titles`` the running titles as ``title``. Runs one job that sums lengths
    one that counts the words of the prose and one that writes the forms asked for; what is collected are the common words."""
    total = records.agg(F.sum(F.length("text"))).first()[0] or 0
    batches = int(total // BATCH_POINTS) + 1
    batched = records.withColumn("batch", F.pmod(F.xxhash64("origin", "record_no"), F.lit(batches)).cast("int"))
    clean = written(_clean_counts(prose), "clean")
    uses = clean.agg(F.sum("clean")).first()[0] or 0
    common = frozenset(r[0] for r in clean.where(F.col("clean") * SHARE >= uses).where("length(word) > 1 and not startswith(word, '-')").limit(2 * SHARE).collect())  # each form of a word counts: 2 SHARE at most
    forms = written(batched.groupBy("batch").applyInPandas(_ask(common), "batch int, key string, word string, n bigint"), "forms")
    scans = forms.where("word is not null").groupBy("word").agg(F.sum("n").alias("scans"))
    counts = clean.select("word", "clean", F.lit(0).cast("bigint").alias("scans")).unionByName(scans.select("word", F.lit(0).cast("bigint").alias("clean"), "scans"))
    lexicon = counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scans").alias("scans")).where("clean > 0 or scans > 1")
    lexicon = lexicon.mapInPandas(_keyed, "word string, clean bigint, scans bigint, key string")
    heads = titles.where("title is not null").select("title").distinct().mapInPandas(_title_keys, "key string").distinct().select(F.lit("").alias("word"), F.lit(0).cast("bigint").alias("clean"), F.lit(0).cast("bigint").alias("scans"), "key")
    asked = forms.where("key is not null").select("batch", "key")
    dictionary = asked.join(lexicon.unionByName(heads), "key").select("batch", "key", "word", "clean", "scans")
    schema = "origin string, record_no bigint, line_no int, kind string, word string" if found else "origin string, record_no bigint, paragraph_no int, text string"
    return batched.groupBy("batch").cogroup(dictionary.groupBy("batch")).applyInPandas(_decode(found, common), schema)
