"""Column functions over text: cleaning, sentence splitting, keyword patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import KEYWORDS

#: Bullets that cleaning drops, list heads that begin a block, keywords that are compared as words.
BULLETS = "■●▲◆•⚫"
LIST_HEAD = r"(?U)^(?:[●○■□◆◇▲△▼▽・※]|[①-⑳]|[（(]\d{1,2}[)）]|\d{1,2}[．.、]\s*\S|[a-zA-Z][.)]\s)"
WORD_KEYWORD = r"[A-Za-z0-9 .\-]+"
#: White space of any script (Unicode's White_Space), and the four separators of ASCII.
BLANK = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Removes white space of any script at both ends."""
    return F.btrim(c, F.lit(BLANK))


def clean(c: Column) -> Column:
    """Normal form of a text before it is split. It never adds, drops or moves over a terminator."""
    c = F.regexp_replace(c, r"[　 \t]+", " ")
    c = F.regexp_replace(c, rf"[{BULLETS}\x{{E000}}-\x{{F8FF}}\x00-\x08\x0B-\x1F\x7F]+", "")
    c = F.regexp_replace(c, r"(?<=[A-Za-z0-9])\n(?=[A-Za-z0-9])", " ")
    c = F.replace(c, F.lit("\n"), F.lit(""))
    return F.regexp_replace(c, r"(?U)([^\p{L}\p{N}_\s、。])\1{2,}", "")


def units(c: Column, terminator: str = "。", min_len: int = 2) -> Column:
    """Sentences of a text: pieces between terminators of at least min_len characters, each with its terminator."""
    pieces = F.transform(F.split(clean(c), re.escape(terminator), -1), strip)
    return F.transform(F.filter(pieces, lambda x: F.length(x) >= min_len), lambda x: F.concat(x, F.lit(terminator)))


def keyword_pattern(words: list[str] | None = None) -> str:
    """Alternation in list order, any case; a word of letters, digits, spaces, dots and hyphens may not touch other ASCII letters. Blank words
    don't count; without any, the default keywords do."""
    kept = [w.strip() for w in words or [] if w and w.strip()] or KEYWORDS

    def one(w):
        return rf"(?<![A-Za-z]){re.escape(w)}(?![A-Za-z])" if re.fullmatch(WORD_KEYWORD, w) else re.escape(w)

    return "(?iu)" + "|".join(one(w) for w in kept)


def position(c: Column) -> Column:
    """A recorded place (an array of texts or numbers) as [x, y] to a tenth; null, which means any, if it is malformed."""
    x, y = (F.bround(F.get(c, i).cast("string").try_cast("double"), 1) for i in (0, 1))
    return F.when(x.isNotNull() & y.isNotNull(), F.array(x, y))


def page_label(raw: Column, page: Column) -> Column:
    """Printed label of a page: `<hex>rest` holds UTF-16; without a label the number stands in."""
    code = F.regexp_extract(raw, r"^<([0-9A-Fa-f]+)>", 1)
    good = (F.length(code) > 0) & (F.length(code) % 4 == 0)
    text = F.when(good, F.concat(F.decode(F.unhex(code), "UTF-16BE"), F.regexp_extract(raw, r"^<[0-9A-Fa-f]+>(.*)$", 1))).otherwise(raw)
    text = strip(F.regexp_replace(text, r"[\x00-\x1F\x7F\x{FEFF}]", ""))
    return F.coalesce(F.when(F.length(text) > 0, text), page.cast("string"))


def band(bounds: Column, v: Column) -> Column:
    """Index of the band between ordered bounds that holds v; beyond the ends, the first or last band."""
    inner = F.slice(bounds, F.lit(2), F.size(bounds) - 2)
    return F.least(F.size(F.filter(inner, lambda b: b <= v)), F.size(bounds) - 2)


def percent(part: Column, whole: Column, digits: int) -> Column:
    return F.coalesce(F.round(F.try_divide(part * F.lit(100.0), whole), digits), F.lit(0.0))


def japanese_chars(c: Column) -> Column:
    """Number of kana and kanji: of texts of ASCII none, of others what goes with them. Looking for all else, over most of a text, takes far longer."""
    rest = F.regexp_replace(c, r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}]+", "")
    return F.when(F.octet_length(c) == F.length(c), 0).otherwise(F.length(c) - F.length(rest))
