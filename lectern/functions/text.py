"""Text measures and cuts as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Patterns that decide which text passes.
SENTENCE_END = "(?<=[.!?;:])[\"”’']?\\s+"
CLEAN = "[^A-Za-z0-9\\s.,;:!?'’‘\"“”()\\[\\]{}—–\\-/&%$#*@+=°£§¶†‡]"
WORD = "[A-Za-z’']+"
JUNK = "[\\^~`|\\\\{}<>]"
NUMERIC_TOKEN = "^[\\d.,;:—–-]+$"
CITATION = "\\s*([A-Z][A-Za-z0-9]{1,9})\\s+(\\d{1,4})\\.(\\d{1,3})\\s*$"
PAGE_MARK = "^\\[(\\d{1,4})\\]$"
YEAR = "(1[5-9]\\d\\d|20\\d\\d)"
BOILERPLATE = (
    "produced in EPUB format by the Internet Archive",
    "relies on optical character recognition",
    "scanned and converted to EPUB format automatically",
    "this page is estimated to be",
    "The Internet Archive was founded in 1996",
    "archive\\.org/details",
    "Online Distributed Proofreading Team",
    "pgdp\\.net",
    "Project Gutenberg",
)


@dataclass(frozen=True)
class Limits:
    max_words: int = 300
    target_words: int = 220
    min_words: int = 8
    max_damage: float = 0.25
    max_junk: float = 0.02


def words(text: Column) -> Column:
    """Words between white space in the Unicode sense."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words(), without making them."""
    return F.regexp_count(text, F.lit("(?U)\\S+"))


def stripped(text: Column) -> Column:
    """Without white space at both ends, no-break space and the separators U+001C to U+001F included."""
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def _rejoined(pieces: Column) -> Column:
    return F.array_join(pieces, " ")


def split_long(text: Column, limits: Limits = Limits()) -> Column:
    """Pieces of a paragraph: whole if short, else greedily packed sentences, sentences that are too long cut by words.

    One pass over the sentences carries the words of the open piece and where the pieces begin; what a lambda needs twice is bound to
    its variable, so nothing is evaluated again for each piece.
    """
    parts = F.transform(sentences(text), lambda x: F.struct(x.alias("text"), word_count(x).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))

    def add(state: Column, sentence: Column) -> Column:
        opens = (state["at"] == 0) | (state["n"] + sentence["n"] > limits.target_words)
        starts = F.when(opens, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"])
        return F.struct((state["at"] + 1).alias("at"), F.when(opens, sentence["n"]).otherwise(state["n"] + sentence["n"]).alias("n"), starts.alias("starts"))

    def bound(value: Column, use) -> Column:
        return F.flatten(F.transform(F.array(value), use))

    def joined(sentence: Column, starts: Column) -> Column:
        until = lambda k: F.coalesce(F.get(starts, k + 1), F.size(sentence))
        return F.transform(starts, lambda s, k: _rejoined(F.transform(F.slice(sentence, s + 1, until(k) - s), lambda x: x["text"])))

    def cut(tokens: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(limits.target_words))
        return F.transform(starts, lambda i: _rejoined(F.slice(tokens, i + 1, limits.target_words)))

    def pieces_of(piece: Column) -> Column:
        return F.when(word_count(piece) <= limits.max_words, F.array(piece)).otherwise(bound(words(piece), cut))

    packed = bound(parts, lambda p: bound(F.aggregate(p, start, add, lambda state: state["starts"]), lambda s: joined(p, s)))
    pieces = F.filter(F.flatten(F.transform(packed, pieces_of)), lambda p: stripped(p) != "")
    return F.when(word_count(text) <= limits.max_words, F.array(text)).otherwise(pieces)


#: A word with a capital behind its first letter that is not all capitals (apostrophes aside), of three characters and more.
MIXED = "(?=[A-Za-z’']{3})(?=[A-Za-z’'][A-Za-z’']*[A-Z])(?![A-Z’']*+(?![A-Za-z’']))"
#: A word without a vowel, of four characters and more.
MUTE = "(?=[A-Za-z’']{4})(?![A-Za-z’']*[aeiouyAEIOUY])"
SUSPECT = f"(?<![A-Za-z’'])(?:{MIXED}|{MUTE})[A-Za-z’']++|{JUNK}"


def damage_parts(text: Column) -> tuple[Column, Column]:
    """(suspicious words and characters, words): both add up over texts, their quotient is the damage.

    One pattern finds all that is suspicious, and neither list of matches is looked at again.
    """
    return F.regexp_count(text, F.lit(SUSPECT)), F.regexp_count(text, F.lit(WORD))


def damage(text: Column) -> Column:
    bad, n = damage_parts(text)
    return F.when(n == 0, F.lit(1.0)).otherwise(bad / n)


def junk_ratio(text: Column) -> Column:
    clean = F.length(F.regexp_replace(text, CLEAN, ""))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(1.0 - clean / F.length(text))


#: Characters that are measured together; a longer text is cut before a space, as no count reaches across it.
BLOCK = 1 << 20
_SPACE, _WORD, _CAPITAL, _SMALL, _VOWEL, _JUNK, _CLEAN = (1 << i for i in range(7))
MEASURES = ("words", "bad", "found", "chars", "clean")


def _classes() -> np.ndarray:
    """The classes of each character below U+3002 by the patterns above; the last entry stands for all others."""
    table = np.zeros(0x3002, np.uint8)

    def put(chars, bit: int) -> None:
        table[[ord(c) for c in chars]] |= bit

    small, capital = map(chr, range(97, 123)), list(map(chr, range(65, 91)))
    put("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))), _SPACE)
    put(small, _SMALL | _WORD | _CLEAN)
    put(capital, _CAPITAL | _WORD | _CLEAN)
    put("’'", _WORD)
    put("aeiouyAEIOUY", _VOWEL)
    put("^~`|\\{}<>", _JUNK)
    put("0123456789\t\n\v\f\r .,;:!?'’‘\"“”()[]{}—–-/&%$#*@+=°£§¶†‡", _CLEAN)
    return table


_CLASSES = _classes()


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts by number, cut and gathered to blocks of about BLOCK characters."""
    at, block, size = [], [], 0
    for i, text in enumerate(texts):
        low = 0
        while low < len(text):
            high = len(text) if len(text) - low <= BLOCK else text.find(" ", low + BLOCK)
            high = len(text) if high < 0 else high
            at.append(i)
            block.append(text[low:high])
            size, low = size + high - low, high
            if size >= BLOCK:
                yield at, block
                at, block, size = [], [], 0
    if block:
        yield at, block


def measures(texts: list[str]) -> np.ndarray:
    """MEASURES of each text, a row for each: what word_count(), damage_parts(), the length and CLEAN count, in one look at its characters."""
    out = np.zeros((len(MEASURES), len(texts)), np.int64)
    for at, block in _pieces(texts):
        # A line break between two texts parts them, as it is in no word.
        code = np.frombuffer("\n".join(["", *block, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = _CLASSES[np.minimum(code, len(_CLASSES) - 1)]
        sizes = np.fromiter(map(len, block), np.int64, len(block))
        ends = np.cumsum(sizes + 1)  # of the line break behind each text
        firsts = ends - sizes

        def within(bits: np.ndarray) -> np.ndarray:
            """Before each character: how many before it have the bits."""
            return np.concatenate([[0], np.cumsum(bits, dtype=np.int32)])

        def count(bits: np.ndarray) -> np.ndarray:
            total = within(bits)
            return total[ends] - total[firsts]

        space, word = (cls & _SPACE) > 0, (cls & _WORD) > 0
        starts, stops = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:]) + 1
        capital, small, vowel = within((cls & _CAPITAL) > 0), within((cls & _SMALL) > 0), within((cls & _VOWEL) > 0)
        long = stops - starts
        mixed = (long >= 3) & (capital[stops] > capital[starts + 1]) & (small[stops] > small[starts])
        mute = (long >= 4) & (vowel[stops] == vowel[starts])
        bad = (cls & _JUNK) > 0
        bad[starts[mixed | mute]] = True
        begun = np.zeros(len(cls), bool)
        begun[starts] = True
        heads = np.zeros(len(cls), bool)
        heads[1:] = ~space[1:] & space[:-1]
        found = (count(heads), count(bad), count(begun), sizes, count((cls & _CLEAN) > 0))
        for row, n in zip(out, found):
            np.add.at(row, at, n)
    return out.T


@F.arrow_udf(StructType([StructField(name, IntegerType()) for name in MEASURES]))
def _measured(column: pa.Array) -> pa.Array:
    given = column.cast(pa.large_binary()).to_pylist()
    found, none = measures([(x or b"").decode("utf-8", "replace") for x in given]).T, np.array([x is None for x in given], bool)
    return pa.StructArray.from_arrays([pa.array(n.astype(np.int32), mask=none) for n in found], list(MEASURES))


def measured(df: DataFrame, text: str, into: str = "m") -> DataFrame:
    """Add a struct of what the gate and the statistics look at (words, bad, found, chars, clean), computed once for each row.

    A function that counts as not deterministic is not put into each use again.
    """
    return df.withColumn(into, _measured.asNondeterministic()(F.col(text)))


def damage_of(m: str = "m") -> Column:
    return F.when(F.col(f"{m}.found") == 0, F.lit(1.0)).otherwise(F.col(f"{m}.bad") / F.col(f"{m}.found"))


def junk_of(m: str = "m") -> Column:
    return F.when(F.col(f"{m}.chars") == 0, F.lit(1.0)).otherwise(1.0 - F.col(f"{m}.clean") / F.col(f"{m}.chars"))


def reason_of(m: str = "m", limits: Limits = Limits()) -> Column:
    """Which gate a measured paragraph fails first ('short', 'damage' or 'junk'), null if none."""
    return F.when(F.col(f"{m}.words") < limits.min_words, "short").when(damage_of(m) > limits.max_damage, "damage").when(junk_of(m) > limits.max_junk, "junk")


def gate_reason(text: Column, limits: Limits = Limits()) -> Column:
    """reason_of() for a text that is not measured yet."""
    return F.when(word_count(text) < limits.min_words, "short").when(damage(text) > limits.max_damage, "damage").when(junk_ratio(text) > limits.max_junk, "junk")


def gate_message(text: Column, limits: Limits = Limits()) -> Column:
    """The reason in words, as it is recorded with a dropped paragraph.  Fixed values: the three sentences."""
    n, d, j = word_count(text), damage(text) * 100, junk_ratio(text) * 100
    return (
        F.when(n < limits.min_words, F.format_string(f"too short (%d word(s) < {limits.min_words})", n))
        .when(d > limits.max_damage * 100, F.format_string(f"OCR damage %.1f%% over {limits.max_damage * 100:.0f}%% gate", d))
        .when(j > limits.max_junk * 100, F.format_string(f"junk-char ratio %.1f%% over {limits.max_junk * 100:.1f}%% gate", j))
    )


def is_boilerplate(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(BOILERPLATE))


def is_numeric_line(text: Column) -> Column:
    """More than 20 tokens, over 35 % of them numbers: a table of contents or an index."""
    tokens = words(text)
    return (F.size(tokens) > 20) & (F.size(F.filter(tokens, lambda t: t.rlike(NUMERIC_TOKEN))) > 0.35 * F.size(tokens))


def citation(text: Column) -> tuple[Column, Column, Column, Column]:
    """(code, page, para, text before) of a trailing printed reference; null code if there is none."""
    code = F.nullif(F.regexp_extract(text, CITATION, 1), F.lit(""))
    return code, F.regexp_extract(text, CITATION, 2).try_cast("long"), F.regexp_extract(text, CITATION, 3).try_cast("long"), stripped(F.regexp_replace(text, CITATION, ""))


def page_mark(text: Column) -> Column:
    return F.regexp_extract(text, PAGE_MARK, 1).try_cast("long")


def year_of(date: Column) -> Column:
    return F.regexp_extract(date, YEAR, 1).try_cast("long")


def page_para(key: Column) -> Column:
    """'PAGE.PARA' as struct(page, para); (0, 0) if it is none."""
    ok = key.rlike("^[0-9]+\\.[0-9]+$")
    part = lambda i: F.when(ok, F.split(key, "\\.")[i].try_cast("long"))
    whole = part(0).isNotNull() & part(1).isNotNull()
    return F.struct(F.when(whole, part(0)).otherwise(F.lit(0)).alias("page"), F.when(whole, part(1)).otherwise(F.lit(0)).alias("para"))


def folded(text: Column) -> Column:
    """Case-folded for comparison: lower case, sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def truthy(value: Column) -> Column:
    """Null where empty."""
    return F.nullif(value, F.lit(""))


def normal_form(text: Column) -> Column:
    """Lower case, one space between words, no punctuation: for comparing quotations."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), "[^\\p{L}\\p{N}\\s]", ""), "\\s+", " "))
