r"""Sentence boundaries across languages and scripts, in SQL expressions only (problem 6).

Full stops that end nothing (decimals, addresses, initials, abbreviations, ordinals before a month, the inside of a
quotation that is part of a larger sentence) are masked, one code point by one private-use code point, so positions never
move. The masked text is split by terminators of its scripts; the sentences are then cut from the text itself.

Everything is decided by the characters around a mark, not by a language label, since a block may mix languages. Scripts
without stops (Thai) divide at spaces between words that are not numbers.

Defined cases: null and blank texts have no sentences; private-use code points of the text are left alone; the last
sentence may lack its stop; repeated rows give the same sentences again; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP, MARK, CLOSE = "", "", ""

# Abbreviations, by how they end.
#: Never the end of a sentence.
INNER = "Dr|Prof|Mr|Mrs|Ms|Fig|Figs|fig|figs|Eq|Eqs|Sect|Sec|Ref|Refs|Vol|vol|pp|cf|Cf|vs|approx|ca|et al|env|vgl|Vgl|Abb|Tab|bzw|Dra|Sra|Sr|Srta|núm|pág|ex|ej|рис|табл|стр|проф|им|см|σχ|πίν|डॉ|श्री"
#: Only before a number.
NUMBERED = "No|Nos|no|Nr|nr|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|Art|Ch|Chap"
#: The end of a sentence where a new one begins behind it.
EITHER = f"U{STOP}S|U{STOP}S{STOP}A|[ap]{STOP}m|etc|usw|Corp|Inc|Ltd|Co|Jr|др|пр"
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

_OTHER = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsDevanagari}\p{IsThai}\p{IsArabic}]"
#: Sentences may begin so in lower case: pH, n-Hexane, α-Form, a Latin name in a text of another script.
_STARTER = rf"(?:pH\b|\p{{Ll}}{{1,2}}-\p{{Lu}}|\p{{Ll}}+\s?{_OTHER})"
_ON = rf"\s+(?!{_STARTER})[\p{{Ll}}]"
_CLOSERS = rf"(?:\s?»|[”’\"'»)\]）」』】》〉{CLOSE}]|\[\d+(?:\s?[,–-]\s?\d+)*\]|[⁰¹²³⁴-⁹]+)"
_NEXT = rf"(?=[“«„‘(]?\p{{Lu}}[\p{{Ll}}\s\d-]|[“«„‘(]?(?:pH\b|n-\p{{Lu}}|\p{{IsGreek}}-\p{{Lu}})|(?:\p{{Ll}}{{3,}})?{_OTHER}|[（「『《“])"

#: (pattern, replacement), in order; each keeps the length.
MASKS: tuple[tuple[str, str], ...] = (
    ("[-]", "�"),
    (r"„([^„“”]*)“", f"„$1{CLOSE}"),
    (r"(?<=\d)\.(?=\d)", STOP),  # decimals and versions
    (r"(?<![\p{L}\d])\.(?=\d)", STOP),
    # addresses: a stop within one, each match going on where the last ended
    (rf"((?:https?://|www\.|doi:|10[.{STOP}]\d{{4,9}}/)|\G(?<!^))((?:[^\s<>.?!]|[.?!](?![\w/]))*)[.?!](?=[\w/])", f"$1$2{STOP}"),
    (r"([\w-]@[\w-]+)\.(?=\w)", f"$1{STOP}"),
    (rf"(?=\.)(?<=\d)\.(?=\s(?:{MONTHS})\b)", STOP),
    (r"(?<=(?<!\p{L})\p{L})\.(?=\p{L}\.)", STOP),  # inside e.g., U.S., p.m.
    (rf"(?=\.)(?<=(?<![\p{{L}}\p{{M}}])(?:{INNER}))\.", STOP),
    (rf"(?=\.)(?<=(?<!\p{{L}})(?:{NUMBERED}))\.(?=\s?\d)", STOP),
    (r"(?<=\d\s)г\.(?=\s\p{Ll})", f"г{STOP}"),
    (rf"(?=\.)(?<=(?<!\p{{L}})(?:{EITHER}))\.(?=[,;:)\]]|\s+\d|{_ON})", STOP),
    (rf"(?=\.)(?<=(?<![\p{{L}}\p{{M}}\d°µμΩ%/·])(?<!\d\s)(?<!U{STOP})(?<![ap]{STOP})\p{{L}})\.(?=[\s,]|\p{{L}}|{STOP})", STOP),  # initials
)

#: Where a sentence ends; each match takes the stop with its closing marks.
ENDS: tuple[str, ...] = (
    rf"[。！？｡]+[.?!…]*{_CLOSERS}*(?![”’」』）])(?!(?<=[」』”])(?:と|って|との|，|、|,))",
    rf"[।॥؟۔]+{_CLOSERS}*",
    rf"(?=[\s;])(?<=[\p{{IsGreek}}\p{{M}}])\s?;(?=\s|$){_CLOSERS}*",
    rf"(?<![.?!…])\.(?=\s|$)(?!\s?»)",  # a plain stop
    rf"(?:[?!…]|\.(?=[.?!…]|{_CLOSERS}))[.?!…]*{_CLOSERS}*(?=\s|$)(?!{_ON})",
    rf"[.?!…]+{_CLOSERS}*{_NEXT}",
    r"(?=\s)(?<=[฀-๿])(?=\s+(?:\p{IsThai}|[“«(]?\p{Lu}|pH\b|n-\p{Lu}|\p{IsGreek}-\p{Lu}))",
    r"(?=\s)(?<=\S)(?=\s*\n\s*\n\s*\S)",
)


#: Marks at which a text is cut to find its quotations, and those that open one.
_CUT, _OPEN, _SHUT = r"(?=[“”„«»‘「」『』" + CLOSE + "])", "“„«「『‘", f"”»」』{CLOSE}"
_STOPS = "[.?!…。！？]"


def _unquoted(text: Column) -> Column:
    """``text`` with the stops masked inside a quotation that begins within a sentence, or that its sentence goes on after
    (it ends with a comma). The text is cut at all quotation marks and the parts are read in order, so a quotation may be of
    any length."""
    parts = F.split(text, _CUT)
    behind = F.concat(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")))
    pairs = F.zip_with(parts, behind, lambda x, y: F.struct(x.alias("x"), F.substring(y, 1, 1).alias("follows")))
    start = F.struct(F.lit(False).alias("within"), F.lit("").alias("before"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, pair: Column) -> Column:
        x, follows = pair["x"], pair["follows"]
        mark = F.substring(x, 1, 1)
        inside = F.regexp_like(acc["before"], F.lit(r"(?U)[\p{L}\p{N},:;：，、]\s{0,2}$"))
        within = F.when(F.regexp_like(mark, F.lit(f"[{_SHUT}]")), False).when(mark == "‘", acc["within"] | inside).when(F.regexp_like(mark, F.lit(f"[{_OPEN}]")), inside).otherwise(acc["within"])
        # stops before a closing mark end the sentence; such a mark may begin the next part
        last = F.when(F.regexp_like(follows, F.lit(f"^[{_SHUT}]")), r"(?!\s?$)").otherwise("")
        whole = F.concat(F.lit(rf"(?U){_STOPS}(?!\s?[’.?!…。！？])"), last)
        first = F.when(within, F.regexp_replace(x, whole, F.lit(STOP))).otherwise(x)
        quoted = F.regexp_like(mark, F.lit("[“«「『‘]"))
        goes_on = F.regexp_like(x, F.lit(",$")) & F.regexp_like(follows, F.lit("^[”»」』]"))
        second = F.when(quoted & goes_on, F.regexp_replace(first, F.lit(f"{_STOPS}(?!’)"), F.lit(STOP))).when(quoted, F.regexp_replace(first, F.lit(f"{_STOPS}(?!’)(?=.*,’)"), F.lit(STOP))).otherwise(first)
        return F.struct(within.alias("within"), F.right(x, F.lit(3)).alias("before"), F.array_append(acc["done"], second).alias("done"))

    walked = F.aggregate(pairs, start, step, lambda acc: F.array_join(acc["done"], ""))
    return F.when(F.regexp_like(text, F.lit("[“„«「『‘]")), walked).otherwise(text)


def masked(text: Column) -> Column:
    for pattern, to in MASKS:
        text = F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(to))
    return _unquoted(text)


def sentence_ends(text: Column) -> Column:
    """array<int>: code points from the start of ``text`` through the end of each sentence; empty for null and blank."""
    marked = F.regexp_replace(masked(text), F.lit("(?U)" + "|".join(f"(?:{e})" for e in ENDS)), F.lit("$0" + MARK))
    pieces = F.split(marked, MARK)
    sized = F.transform(pieces, lambda p: F.struct(F.length(p).alias("all"), F.length(F.regexp_replace(p, r"(?U)\s+$", "")).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    walked = F.aggregate(
        sized,
        start,
        lambda acc, x: F.struct((acc["at"] + x["all"]).alias("at"), F.when(x["own"] > 0, F.array_append(acc["ends"], acc["at"] + x["own"])).otherwise(acc["ends"]).alias("ends")),
        lambda acc: acc["ends"],
    )
    return F.coalesce(walked, F.array().cast("array<int>"))


def split_sentences(blocks: DataFrame, text: str = "text") -> DataFrame:
    """``blocks`` with one row per sentence: sentence_no from 1, end_char, sentence (the text itself, restored)."""
    own = "__ends"
    out = blocks.withColumn(own, sentence_ends(F.col(text)))
    out = out.select(*blocks.columns, F.col(own), F.posexplode_outer(own).alias("__pos", "end_char")).where("end_char is not null")  # a plain posexplode would compute the ends twice, once to filter
    begin = F.when(F.col("__pos") == 0, 0).otherwise(F.element_at(own, F.col("__pos")))
    sentence = F.regexp_replace(F.substring(F.col(text), begin + 1, F.col("end_char") - begin), r"(?U)^\s+", "")
    return out.select(*blocks.columns, (F.col("__pos") + 1).alias("sentence_no"), "end_char", sentence.alias("sentence"))
