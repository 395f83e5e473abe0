"""Text expressions: canonical forms, tokens, hashes, windows, negation, display paragraphs.

What Spark's built-in functions can say stays in the JVM; Unicode normalisation, case folding and
the ordered folds (window packing, negation scope, paragraphs) are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"[\s\p{Z}\x1c-\x1f\x85]+"
TOKEN = r"[\p{L}\p{N}_]+"
#: The namespace of URLs in name-based identifiers, and the roman generations.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
GENERATIONS = ("gen-i", "gen-ii", "gen-iii", "gen-iv", "gen-v", "gen-vi", "gen-vii", "gen-viii", "gen-ix")


def stripped(c) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, rf"^{BLANK}|{BLANK}$", "")


# canonical forms ---------------------------------------------------------------------------------


def canonical_value(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).split()).casefold()


@F.pandas_udf(T.StringType())
def _canonical(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else canonical_value(v))


def canonical(c) -> Column:
    """Compatibility-normalised, blanks collapsed, case-folded.  Plain ASCII never leaves the JVM; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.lower(F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f]+", " ")))
    return F.when(c.rlike(r"\A[\x00-\x7f]*\z"), plain).otherwise(_canonical(F.when(~c.rlike(r"\A[\x00-\x7f]*\z"), c)))


@F.pandas_udf(T.StringType())
def _compatible(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def compatible(c) -> Column:
    """Compatibility-normalised, nothing else changed; plain ASCII never leaves the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    plain = c.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, c).otherwise(_compatible(F.when(~plain, c)))


def term_problem(c, longest: int) -> Column:
    """Why a vocabulary term can't be accepted (control, blank, length), or null."""
    c = F.col(c) if isinstance(c, str) else c
    form = canonical(c)
    return (
        F.when(c.isNull() | (form == ""), "blank")
        .when(c.rlike(r"[\p{Cc}\p{Cf}]"), "control")
        .when((F.length(stripped(F.regexp_replace(c, BLANK, " "))) > longest) | (F.length(form) > longest), "length")
    )


# tokens and hashes -------------------------------------------------------------------------------


def tokens(c) -> Column:
    """Lower-case tokens (letters, digits, underscore) in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)


def query_tokens(c, most: int = 32) -> Column:
    """The first ``most`` distinct tokens that hold a letter or digit."""
    return F.slice(F.array_distinct(F.filter(tokens(c), lambda t: t.rlike(r"[\p{L}\p{N}]"))), 1, most)


def content_hash(c) -> Column:
    """SHA-256 of the stripped content."""
    return F.sha2(stripped(c), 256)


def stable_id(*parts) -> Column:
    """The name-based identifier (version 5, URL namespace) of parts joined by colons."""
    name = F.concat_ws(":", *parts)
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "utf-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def client_key(c, key: str) -> Column:
    """A keyed hash of a client's identity (32 hexadecimal digits): equal clients under one key have equal ones, and none can be told from it."""
    return F.substring(F.sha2(F.concat(F.lit(key), F.lit("\0"), F.sha2(F.concat(F.lit(key), F.lit("\1"), c), 256)), 256), 1, 32)


def unit_hash(*parts) -> Column:
    """A number from 0 to 1 by the first eight bytes of the SHA-256 of parts joined by bars."""
    head = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551615.0)


# windows -----------------------------------------------------------------------------------------


def fixed_windows(c, width: int = 64) -> Column:
    """Consecutive windows of ``width`` characters; an empty text has none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(width)), lambda i: F.substring(c, i + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def sentences(c) -> Column:
    """Sentences in order: paragraphs by line breaks, then after each ending mark."""
    parts = F.flatten(F.transform(F.split(c, r"\n+"), lambda p: F.split(p, r"(?<=[。！？!?；;\.])\s*")))
    return F.filter(F.transform(parts, lambda s: stripped(s)), lambda s: s != "")


def window_bounds(lengths: list[int], longest: int, overlap: int) -> list[tuple[int, int]]:
    """Where windows begin and end in the sentences joined by single blanks, from the sentences' lengths alone.

    A window takes every sentence that ends within ``longest`` of its begin; the next begins
    ``overlap`` before its end (without overlap at the next sentence).  If not even one new sentence
    fits, the window is ``longest`` wide and the next begins longest - overlap further on.
    """
    ends = [e + k for k, e in enumerate(accumulate(lengths))]
    out: list[tuple[int, int]] = []
    begin, taken = 0, 0
    while taken < len(ends):
        fitting = bisect_right(ends, begin + longest)
        if fitting > taken:
            out.append((begin, ends[fitting - 1]))
            taken, begin = fitting, max(begin, ends[fitting - 1] - overlap) if overlap else ends[fitting - 1] + 1
        else:
            out.append((begin, begin + longest))
            begin += longest - overlap
    return out


def packed_windows(parts: Column, longest: int = 500, overlap: int = 80) -> Column:
    """Sentences packed into overlapping windows (see ``window_bounds``); null gives null."""
    if longest < 100 or not 0 <= overlap < longest:
        raise ValueError("windows hold at least 100 characters, more than their overlap")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [" ".join(v)[a:b] for a, b in window_bounds([len(x) for x in v], longest, overlap)])

    return pack(parts)


# negation ----------------------------------------------------------------------------------------

#: Clause boundaries, words that negate what follows them, and how far they reach.
CLAUSE = re.compile(r"[,，。.!?！？;；:\r\n]+|\b(?:but|however|yet)\b|但是|不過|不过|然而|但|卻|却")
NEGATION_ZH = re.compile(r"不(?!斷|断|只|但|僅|仅|光|停|吝|懈|得不)|沒(?:有)?|没有|並非|并非|討厭|讨厌|避免|拒絕|拒绝")
NEGATION_EN = re.compile(
    r"\b(?:not(?!\s+(?:only|just)(?![A-Za-z0-9_]))|never|no|without|don['’]t|doesn['’]t|didn['’]t|can['’]t|cannot|won['’]t|"
    r"avoid(?:s|ed|ing)?|refus(?:e|es|ed|ing)|hate(?:s|d)?|dislike(?:s|d)?|non)"
)
WORDS_ON = re.compile(r"(?:[\s-]+[a-z][a-z'’-]*){0,4}[\s-]*")
NEAR, REACH, FAR = 16, 10, 160


@lru_cache(maxsize=4096)
def negated_spans(text: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Where clauses begin, and (begin of the negator, first and last place it negates), in order.

    One scan a text, whatever the number of terms that are looked up in it afterwards: a Chinese
    negator reaches ten characters, an English one four words, neither beyond its clause.
    """
    clauses = [0, *(m.end() for m in CLAUSE.finditer(text))]
    spans = [(m.start(), m.end(), min(m.end() + REACH, m.start() + NEAR)) for m in NEGATION_ZH.finditer(text)]
    spans += [(m.start(), m.end(), min(WORDS_ON.match(text, m.end()).end(), m.start() + FAR)) for m in NEGATION_EN.finditer(text)]
    return clauses, sorted(spans)


def affirms(text: str, term: str) -> bool:
    """Whether a canonical text holds a canonical term at least once without a negation before it in its clause."""
    if not term or term not in text:
        return False
    clauses, spans = negated_spans(text)
    edge = lambda c, side: rf"(?{side}[A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", c) else ""
    whole = re.compile(edge(term[0], "<!") + re.escape(term) + edge(term[-1], "!"))
    for found in whole.finditer(text):
        at = found.start()
        clause = clauses[bisect_right(clauses, at) - 1]
        if any(m.end() == at for m in CLAUSE.finditer(text, max(clause, at - 8), at)):  # a conjunction with the term right behind it
            clause = at
        first = bisect_left(spans, (max(clause, at - FAR),))
        if not any(begin <= at <= end for _, begin, end in spans[first : bisect_left(spans, (at,))]):
            return True
    return False


def behaviour(c) -> Column:
    """The canonical text in which line breaks still end clauses."""
    return canonical(F.regexp_replace(c, r"[\r\n]", ";"))


@F.pandas_udf(T.BooleanType())
def affirmed(texts: pd.Series, terms: pd.Series) -> pd.Series:
    """``affirms`` of canonical texts and terms; null if either is null."""
    return pd.Series([None if a is None or b is None else affirms(a, b) for a, b in zip(texts, terms)], dtype=object)


# display -----------------------------------------------------------------------------------------

#: Marks that end a sentence, those that may follow them, closing marks, and where a long sentence may be cut.
SENTENCE_END = r"。|[！？!?](?=\s|\Z)|(?<![.])[.](?![.])(?:(?<![0-9][.])|(?![0-9]))"
REPEATED, CLOSERS = "[。！？!?；;.]*", "[」』）)\\]】》〉”’\"]*"
BREAK = re.compile("[！？!?；;，,、：:]")
SENTENCE = re.compile(rf"(?:{SENTENCE_END}){REPEATED}{CLOSERS}\s*")


class Block:
    """One line of a text with the sums of its visible characters, by which all cuts are found."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.seen = [0, *accumulate(not c.isspace() for c in text)]  # visible characters before each place
        self.places = [i for i, c in enumerate(text) if not c.isspace()]  # place of each visible character
        self.breaks = [m.end() for m in BREAK.finditer(text)]

    def cuts(self, longest: int) -> list[int]:
        """Ends of fragments: of sentences, and within those of more than ``longest`` visible characters after the last break in the second half, or hard."""
        out, begin = [], 0
        for end in dict.fromkeys([*(m.end() for m in SENTENCE.finditer(self.text)), len(self.text)]):
            while self.seen[end] - self.seen[begin] > longest:
                base = self.seen[begin]
                hard = self.places[base + longest - 1] + 1
                k = bisect_right(self.breaks, hard) - 1
                soft = self.breaks[k] if k >= 0 and self.breaks[k] > begin and self.seen[self.breaks[k]] - base >= max(1, longest // 2) else hard
                begin = self.places[self.seen[soft]]  # blanks after a cut go with what is before it
                out.append(begin)
            if self.seen[end] > self.seen[begin]:
                out.append(end)
            begin = end
        return out

    def paragraphs(self, longest: int, most: int | None) -> list[str]:
        """As many fragments a paragraph as ``longest`` visible characters and ``most`` allow, one at least."""
        ends = self.cuts(longest)
        sums = [self.seen[e] for e in ends]
        out, k, begin = [], 0, 0
        while k < len(ends):
            last = max(k, bisect_right(sums, self.seen[begin] + longest) - 1)
            last = last if most is None else min(last, k + most - 1)
            out.append(self.text[begin : ends[last]].strip())
            k, begin = last + 1, ends[last]
        return out


def display_paragraphs(text: str, longest: int = 160, most: int | None = None) -> list[str]:
    """Readable paragraphs: line breaks are kept, sentences grouped up to ``most`` and ``longest`` visible characters."""
    return [p for line in re.split(r"\r\n|\r|\n", text) for p in Block(line.strip()).paragraphs(longest, most)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def paragraphs(values: pd.Series) -> pd.Series:
    """``display_paragraphs`` of a column; null gives null."""
    return values.map(lambda v: None if v is None else display_paragraphs(v))


# codes and lists ---------------------------------------------------------------------------------


def normal_code(c) -> Column:
    """Trimmed, lower case, underscores as hyphens."""
    return F.regexp_replace(F.lower(stripped(c)), "_", "-")


def split_codes(c) -> Column:
    """Codes of a list separated by bars or commas, in order, the first raw form of each code; null gives an empty list."""
    raw = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[|,]"), lambda s: stripped(s)), lambda s: s != "")
    return F.filter(raw, lambda s, i: F.array_position(F.transform(raw, lambda r: normal_code(r)), normal_code(s)) == i + 1)


def optional(c) -> Column:
    """Stripped text; empty and ``unknown`` in any case are null."""
    c = stripped(c)
    return F.when((c != "") & (F.lower(c) != "unknown"), c)


def generation_number(c) -> Column:
    """1 to 9 of gen-i to gen-ix in any case, else null."""
    place = F.array_position(F.array(*map(F.lit, GENERATIONS)), F.lower(stripped(c)))
    return F.when(place > 0, place.cast("int"))


def whole_number(c) -> Column:
    """A whole number written as any decimal (3, 3.0, +3), else null."""
    c = stripped(c)
    return F.when(c.rlike(r"^[+-]?[0-9]{1,18}([.]0*)?$"), F.regexp_replace(c, r"^[+]|[.]0*$", "").try_cast("bigint"))


def finite_number(c) -> Column:
    """A finite number, else null; nan and infinity are none."""
    n = stripped(c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def truth(c) -> Column:
    """true and false in any case, else null."""
    low = F.lower(stripped(c))
    return F.when(low == "true", True).when(low == "false", False)


def four_letter_code(c) -> Column:
    """The four letters of a personality code with or without suffix, after normalisation; null if there is none."""
    form = F.upper(canonical(c))
    return F.when(form.rlike(r"^[EI][SN][TF][JP](-[AT])?$"), F.substring(form, 1, 4))


def length_bucket(c) -> Column:
    """short under 40, medium under 80, else long; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < 40, "short").when(c < 80, "medium").when(c.isNotNull(), "long")


def web_address(c) -> Column:
    """Whether a text is an http(s) address with a host and without query or fragment; null is false."""
    return F.coalesce(F.regexp_like(c, F.lit(r"^https?://[^/?#\s@]+(/[^?#\s]*)?$")), F.lit(False))


def secure_address(c) -> Column:
    """An https address without user, with a valid port if any."""
    c = F.col(c) if isinstance(c, str) else c
    port = F.regexp_extract(c, r"^https://[^/?#\s@:]+:([0-9]{1,5})(/|$)", 1)
    plain = c.rlike(r"^https://[^/?#\s@:]+(:[0-9]{1,5})?(/[^\s]*)?$")
    return F.coalesce(plain & ((port == "") | (port.try_cast("int").between(1, 65535))), F.lit(False))


def artwork_address(base, number) -> Column:
    """``base``/0001.png: the number padded to four digits."""
    return F.format_string("%s/%04d.png", F.regexp_replace(base, "/+$", ""), number)


def safe_filename(c) -> Column:
    """Characters that file systems refuse become underscores."""
    return F.regexp_replace(stripped(c), r'[<>:"/\\|?*\x00-\x1f]', "_")


#: What only unsynthesised text holds.
RAW_MARKS = ("ev_", "document_id", "chunk_id", "檢索證據指出")


def chinese_prose(c) -> Column:
    """At least 12 ideographs, no run of four Latin words, and no mark of raw evidence; null is false."""
    c = F.regexp_replace(c, BLANK, " ")
    raw = F.lit(False)
    for mark in RAW_MARKS:
        raw = raw | F.lower(c).contains(mark)
    return F.coalesce((F.regexp_count(c, F.lit("[㐀-鿿]")) >= 12) & ~c.rlike(r"(?:\b[A-Za-z][A-Za-z'-]*\b\s*){4,}") & ~raw, F.lit(False))


#: Words of behaviour, which a summary should hold, and of appearance, which it shouldn't; labels that name a source.
BEHAVIOUR = [
    "性格", "夥伴", "群居", "合作", "信任", "忠誠", "守護", "保護", "照顧", "支持", "溫柔", "熱情",
    "冷靜", "勇敢", "交流", "聯絡", "心情", "寂寞", "獨處", "喜歡", "好奇", "智慧", "聰明", "舞蹈",
]
APPEARANCE = ["全身", "身體", "外形", "外觀", "顏色", "毛髮", "羽毛", "眼睛", "鼻子", "尾巴", "翅膀", "四肢", "足部", "頭部"]
SOURCE_LABELS = ["中文圖鑑描述", "英文 flavor text"]
#: What surrounds a segment without belonging to it, and the ideographs that make it Chinese.
AROUND, IDEOGRAPH = r"[ \[\]【】()（）,，:：-]+", "[㐀-鿿]"


def chinese_summary(c, longest: int = 110) -> Column:
    """The segment richest in behaviour (three a word, less two a word of appearance), earlier first, at most ``longest`` characters.

    A label that names the source is taken off.  A longer segment ends at its last full-width comma
    within the limit.  Without a segment of three ideographs the summary is empty; null gives null.
    """
    c = F.col(c) if isinstance(c, str) else c
    text = F.trim(F.regexp_replace(c, BLANK, " "))
    parts = F.flatten(F.transform(F.split(text, r"[|｜]+"), lambda p: F.split(p, r"(?<=[。！？；])")))
    held = lambda s, words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: s.contains(w)))
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, f"^{AROUND}|{AROUND}$", ""), rf"^(?:{'|'.join(SOURCE_LABELS)}) *[:：] *", "")
    ranked = F.transform(F.transform(parts, bare), lambda s, i: F.struct((3 * held(s, BEHAVIOUR) - 2 * held(s, APPEARANCE)).alias("score"), (-i).alias("place"), s.alias("s")))
    best = F.array_max(F.filter(ranked, lambda x: F.regexp_count(x["s"], F.lit(IDEOGRAPH)) >= 3))["s"]
    head = F.substring(best, 1, longest)
    clause = F.regexp_replace(F.regexp_replace(head, r"，[^，]*$", ""), r"[，。！？； ]+$", "")
    cut = F.concat(F.coalesce(F.nullif(clause, F.lit("")), F.rtrim(head)), F.lit("……"))
    return F.when(c.isNull(), None).when(best.isNull(), "").when(F.length(best) <= longest, best).otherwise(cut)


def ideographic_traits(c: Column, most: int = 3) -> Column:
    """The first distinct values that hold an ideograph, blanks removed."""
    return F.slice(F.array_distinct(F.filter(F.transform(c, lambda v: F.regexp_replace(v, BLANK, "")), lambda v: v.rlike("[一-鿿]"))), 1, most)


def profile_text(labels: dict[str, str]) -> Column:
    """Labelled lines of columns (label, column), joined by line breaks.

    A null value is written as ``None``.  A line is left out if nothing but blanks follows its first
    full-width colon; a label without one keeps its line whatever the value.
    """
    lines = [F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for label, c in labels.items()]
    told = lambda line: stripped(F.regexp_replace(line, "(?s)^.*?：", "")) != ""
    return F.array_join(F.filter(F.array(*lines), told), "\n")
