"""One consistent form for text that looks the same but is written with other characters.

Method.  Look-alike pairs of strings and code points come from the public table of confusable
characters, as Spark's own Unicode library has it, from Unicode's decompositions by rule, and from a
short list of signs that both leave out.  Union-find closes them transitively into classes; the
representative for an odd form is, of the plain members of its class of the same category (upper
case, lower case, digit, ideograph), the one most frequent in the corpus.  Odd forms are the patterns of
an Aho-Corasick automaton that rewrites values greedily, the longest match first; forms without a
plain member are patterns too and stand for themselves, so all that is found is found by it.  Where
looks alone don't decide, a guard looks at the surroundings: letters of another script count only
inside words with Latin letters, katakana only in place of an ideograph, joiners not between emoji.

Blocks covered: Latin, Greek and Cyrillic with their supplements, combining marks, full-width letters
and digits, katakana, radicals, compatibility and unified ideographs, white space, invisible signs.

Scale.  Two passes of linear cost: a count of the few thousand characters that occur in any class
(map-side sums, bounded by the classes, not by the data), then the rewriting, row by row, with no
shuffle.  Values without any suspicious character cost one regular-expression scan.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Katakana signs the public table leaves out, and the ideographs they look like.
KATAKANA = {"オ": "才", "ミ": "三", "チ": "千", "ヌ": "又", "ム": "厶", "メ": "乂", "セ": "七", "サ": "廾", "ヒ": "匕", "リ": "刂"}
#: Radicals the public table leaves out, and the ideographs they look like.
RADICALS = {"⺀": "冫", "⺁": "厂", "⺄": "乙", "⺆": "冂", "⺇": "几", "⺊": "卜", "⺜": "日", "⺝": "月", "⺥": "爫", "⺧": "牛", "⺩": "王", "⺬": "示", "⺮": "竹", "⺰": "纟", "⺸": "羊", "⺼": "月", "⺽": "臼", "⻆": "角", "⻊": "足", "⻎": "辶", "⻕": "阜", "⻗": "雨", "⻞": "飠", "⻡": "首", "⻣": "骨", "⻦": "鸟", "⻧": "卤", "⻪": "黾", "⻱": "龟"}
#: Code points without a glyph (soft hyphen, joiners, zero-width marks), and odd spaces.
INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF)))
SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F)))


def _span(*codes: int) -> str:
    """A regular-expression class of code point ranges: first, last, first, last, ..."""
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(codes[::2], codes[1::2])) + "]"


MARK = _span(0x300, 0x36F)
EMOJI = _span(0xA9, 0xA9, 0xAE, 0xAE, 0x203C, 0x2E7F, 0x1F000, 0x1FAFF)
JOINED = re.compile(f"(?<={EMOJI})({_span(0xFE0E, 0xFE0F, 0x1F3FB, 0x1F3FF)}*){chr(0x200D)}(?={EMOJI})")


ASCII, LATIN_RANGES = (0x30, 0x7A), ((0x41, 0x24F), (0x1E00, 0x1EFF))
OTHER_RANGES = ((0x370, 0x52F), (0x1F00, 0x1FFF))
KANA_RANGES, RADICAL_RANGES = ((0x30A1, 0x30FC),), ((0x2E80, 0x2FD5),)
COMPATIBLE_RANGES, UNIFIED_RANGES = ((0xF900, 0xFAFF), (0x2F800, 0x2FA1D)), ((0x3400, 0x9FFF),)
WIDE_RANGES = ((0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))


def _in(c: str, ranges: tuple) -> bool:
    return len(c) == 1 and any(a <= ord(c) <= b for a, b in ranges)


def kind_of(form: str) -> str | None:
    """What is odd about a form by itself; None for plain ones.  Katakana is odd only if its class holds an ideograph."""
    if any(0x300 <= ord(c) <= 0x36F for c in form):
        return "accent"
    for kind, ranges in (("width", WIDE_RANGES), ("ideograph", RADICAL_RANGES + COMPATIBLE_RANGES), ("script", OTHER_RANGES), ("katakana", KANA_RANGES)):
        if _in(form, ranges):
            return kind
    return "invisible" if form and form in INVISIBLE else "space" if form and form in SPACES else None


def confusables(spark: SparkSession) -> dict[str, str]:
    """Code points of the blocks covered, and their skeletons in the public table of confusable characters, where they differ."""
    blocks = ((0x30, 0x39), *LATIN_RANGES, *OTHER_RANGES, *KANA_RANGES, *RADICAL_RANGES, *COMPATIBLE_RANGES, *UNIFIED_RANGES, *WIDE_RANGES)
    points = [chr(c) for a, b in blocks for c in range(a, b + 1) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo", "Lm", "Nd", "So")]
    apart = chr(0xE000)
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton(apart.join(points)).split(apart)
    return {p: s for p, s in zip(points, skeletons, strict=True) if p != s}


def pairs(spark: SparkSession) -> list[tuple[str, str]]:
    """Look-alikes, two by two; the empty string looks like any invisible sign."""
    out = list(confusables(spark).items())
    for a, b in (*WIDE_RANGES, *RADICAL_RANGES, *COMPATIBLE_RANGES):
        out += [(chr(c), plain) for c in range(a, b + 1) if (plain := unicodedata.normalize("NFKC", chr(c))) != chr(c)]
    for code in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<" and 0x300 <= int(parts[1], 16) <= 0x36F and unicodedata.normalize("NFC", chr(code)) == chr(code):
            out.append(("".join(chr(int(p, 16)) for p in parts), chr(code)))
    out += [(c, "") for c in INVISIBLE] + [(c, " ") for c in SPACES] + list(KATAKANA.items()) + list(RADICALS.items())
    return out


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = self.up.setdefault(x, x)
        while root != self.up[root]:
            root = self.up[root]
        while x != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in out.values()]


_KNOWN: list[list[list[str]]] = []


def classes(spark: SparkSession) -> list[list[str]]:
    """The classes of look-alikes, made once."""
    if not _KNOWN:
        sets = UnionFind()
        for a, b in pairs(spark):
            sets.join(a, b)
        _KNOWN.append(sets.classes())
    return _KNOWN[0]


def _fits(odd: str, kind: str, plain: str) -> bool:
    """Whether a plain form may stand for an odd one of its class."""
    if kind in ("invisible", "space"):
        return plain == ("" if kind == "invisible" else " ")
    if kind in ("ideograph", "katakana"):
        return _in(plain, UNIFIED_RANGES)
    if kind == "accent":
        return len(plain) == 1 and unicodedata.normalize("NFD", plain) == unicodedata.normalize("NFD", odd)
    category = unicodedata.category(odd)
    return bool(plain) and all(_in(c, LATIN_RANGES if kind == "script" else (ASCII,)) and unicodedata.category(c) == category for c in plain)


def rewrites(found: list[list[str]], frequency: dict[str, int]) -> list[tuple[str, str, str]]:
    """(odd form, representative, kind): of the plain members of its class that fit the most frequent; ties go to the decomposition, then to the smaller.

    Letters of other scripts, marks and radicals without such a member stand for themselves; katakana without one isn't odd.
    """
    out: dict[str, tuple[str, str]] = {}
    for members in found:
        for odd in members:
            if (kind := kind_of(odd)) is None or (kind == "accent" and len(odd) == 1):
                continue
            plain = [m for m in members if (kind_of(m) is None or kind == "accent") and m != odd and _fits(odd, kind, m)]
            if plain:
                own = unicodedata.normalize("NFKC", odd)
                out[odd] = min(plain, key=lambda m: (-frequency.get(m, 0), m != own, m)), kind
    lonely = [(c, kind) for ranges, kind in ((((0x300, 0x36F),), "accent"), (OTHER_RANGES, "script"), (RADICAL_RANGES, "ideograph")) for a, b in ranges for c in map(chr, range(a, b + 1))]
    for c, kind in lonely:
        if unicodedata.category(c)[0] in "LMS" and c not in out:
            out[c] = c, kind
    return [(odd, plain, kind) for odd, (plain, kind) in sorted(out.items())]


def _word_letters(text: str, at: int) -> str:
    """The run of non-ideographic letters and marks around a place."""
    part = lambda c: (c.isalpha() or c in INVISIBLE or re.match(MARK, c)) and not HAN.match(c) and not KANA.match(c)
    a = b = at
    while a and part(text[a - 1]):
        a -= 1
    while b < len(text) and part(text[b]):
        b += 1
    return text[a:b]


LATIN = re.compile(_span(0x41, 0x5A, 0x61, 0x7A, 0xC0, 0x24F, 0x1E00, 0x1EFF, 0xFF21, 0xFF3A, 0xFF41, 0xFF5A))
HAN = re.compile(_span(0x2E80, 0x2FDF, 0x3400, 0x9FFF, 0xF900, 0xFAFF, 0x20000, 0x2FA1F))
KANA = re.compile(_span(0x3040, 0x30FF))


class Rewriter:
    """The automaton over all odd forms, with the guards."""

    def __init__(self, table: list[tuple[str, str, str]]) -> None:
        self.machine = ahocorasick.Automaton()
        for odd, plain, kind in table:
            self.machine.add_word(odd, (len(odd), plain, kind))
        self.machine.make_automaton()
        self.signs = {odd for odd, _, kind in table if kind == "katakana"}
        self.suspicious = re.compile("[" + "".join(re.escape(o) for o, _, _ in table if len(o) == 1) + "]")

    def __call__(self, text: str) -> tuple[str, list[str]]:
        """The consistent form, and the kinds of oddity found (sorted)."""
        kinds: set[str] = set()
        while self.suspicious.search(text):  # what a rewriting brings together may be a form of its own
            before, text = text, self._once(text, kinds)
            if text == before:
                break
        return text, sorted(kinds)

    def _once(self, text: str, kinds: set[str]) -> str:
        kept = {m.end() - 1 for m in JOINED.finditer(text)}
        out, last = [], 0
        for end, (size, plain, kind) in self.machine.iter_long(text):
            at = end - size + 1
            if kind == "invisible" and at in kept:
                continue
            if kind == "script" and not LATIN.search(_word_letters(text, at)):
                continue
            if kind == "katakana" and not self._for_ideograph(text, at):
                continue
            out += [text[last:at], plain]
            last = end + 1
            kinds.add(kind)
        return "".join(out) + text[last:]

    def _for_ideograph(self, text: str, at: int) -> bool:
        """Whether the kana run around a place is one or two signs beside an ideograph, all look-alikes."""
        a, b = at, at + 1
        while a and KANA.match(text[a - 1]):
            a -= 1
        while b < len(text) and KANA.match(text[b]):
            b += 1
        beside = (a > 0 and HAN.match(text[a - 1])) or (b < len(text) and HAN.match(text[b]))
        return b - a <= 2 and bool(beside) and all(c in self.signs for c in text[a:b])


def _count(wanted: set[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for m in wanted:
            if len(m) > 1:
                machine.add_word(m, m)
        machine.make_automaton()
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(text)
                    if re.search(MARK, text):
                        counts.update(m for _, m in machine.iter(text))
        found = [(m, n) for m, n in counts.items() if m in wanted]
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["form", "n"])

    return count


def frequencies(rows: DataFrame, found: list[list[str]]) -> dict[str, int]:
    """Occurrences of every class member in all texts; at most as many entries as the classes have."""
    wanted = {m for members in found for m in members if m}
    counted = rows.select("text").mapInArrow(_count(wanted), "form string, n bigint").groupBy("form").agg(F.sum("n").alias("n"))
    return {r["form"]: r["n"] for r in counted.collect()}


def consistent(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, ``text``, ``form`` (its one consistent form) and ``kinds`` (what was odd; empty if nothing).

    ``rows`` has the key columns and ``text``; other columns are dropped.

    Defined cases: a null text has a null form and no kinds; empty texts stay empty; forms of
    letters without a composed character keep their marks but are reported; repeated rows are
    rewritten each; an empty table gives an empty result.
    """
    found = classes(rows.sparkSession)
    table = rewrites(found, frequencies(rows, found))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(table)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            done = [(None, []) if t is None else rewriter(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), batch.column("text"), pa.array([f for f, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))], [*keys, "text", "form", "kinds"]
            )

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "text").mapInArrow(rewrite, f"{schema}, text string, form string, kinds array<string>")

