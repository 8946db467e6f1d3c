"""Text normalisation for Chinese corpora. Each step is a Column -> Column function; normalize() chains them.

The order matters and is kept as it is: blanks at the edges go before noise characters do and are not looked at again.
Only NFKC runs in Python, and only for texts that have a character beyond ASCII.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import pytext

#: Vulgar fractions and their plain text.
FRACTIONS = {
    "¼": "1/4", "½": "1/2", "¾": "3/4", "⅐": "1/7", "⅑": "1/9", "⅒": "1/10", "⅓": "1/3", "⅔": "2/3", "⅕": "1/5",
    "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8",
}

#: Code points of scripts and symbols that are noise in a Chinese corpus.
NOISE = """
00BF-024F 0250-02AF 02B0-02FF 0300-036F 0370-03FF 0400-04FF 0500-052F 0530-058F 0590-05FF 0600-06FF 0700-074F 0750-077F
0780-07BF 07C0-07FF 0800-083F 0840-085F 08A0-08FF 0900-097F 0980-09FF 0A00-0A7F 0A80-0AFF 0B00-0B7F 0B80-0BFF 0C00-0C7F
0C80-0CFF 0D00-0D7F 0D80-0DFF 0E00-0E7F 0E80-0EFF 0F00-0FFF 1000-109F 10A0-10FF 1100-11FF 1200-139F 13A0-13FF 1400-167F
1680-177F 1780-17FF 1800-18AF 18B0-1DFF 1E00-1EFF 1F00-1FFF 2010-2012 2016-2017 201A-201B 201E-201F 2020-2027 2030-2031
2032-2036 2038-2038 2039-203A 203E-203F 2041-2044 20A0-20CF 20D0-20FF 2100-2102 2104-218F 2190-27FF 2800-2BFF 2C00-2C7F
2500-257F 2C80-2CFF 2D30-2D7F 2DE0-2DFF 2E00-2E7F 2E80-2EFF 2FF0-2FFB 3003-3007 3014-3019 302A-302F 3030-3035 3130-318F
3200-33FF 3400-4DBF 4DC0-4DFF A000-A4CF A4D0-ABFF AC00-D7FF E000-F8FF F900-FAFF FB50-FDFF FE20-FEFF FF65-FF9F FFFB-FFFD
10000-115FF 12000-1247F 13000-1342F 16800-16FFF 17000-187FF 1B000-1B0FF 1CE00-1CEFF 1D100-1D1FF 1D400-1D7FF 1F000-1FFFF
20000-2A6DF 2A700-2EBEF 2F800-2FA1F 30000-3134F 60000-6FFFF E0000-E01EF F0000-10FFFF
"""


def _merged(ranges: str) -> list[tuple[int, int]]:
    """Ranges of code points with those that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(tuple(int(x, 16) for x in r.split("-")) for r in ranges.split()):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


NOISE_CLASS = "[" + "".join("\\x{%s}-\\x{%s}" % tuple(r.split("-")) for r in NOISE.split()) + "]"
_NOISE = _merged(NOISE)
#: Of a class with && the left side is tried first, so characters below all noise cost one comparison.
_NOISE_RUN = "[\\x{%X}-\\x{10FFFF}&&[" % _NOISE[0][0] + "".join("\\x{%X}-\\x{%X}" % r for r in _NOISE) + "]]+"

#: ASCII punctuation and its full-width form.
HALF, FULL = ",?!:;()", "，？！：；（）"

#: Zero-width characters and direction marks, soft hyphen, word joiner, byte order mark, variation selectors.
INVISIBLE = "\\u00ad[\\u200b-\\ufeff&&[\\u200b-\\u200f\\u202a-\\u202e\\u2069\\ufeff\\u2060\\ufe00-\\ufe0f]]"
#: Control characters but for tab, line feed and carriage return, each by itself (see pytext on classes).
CONTROLS = "".join("\\x%02x" % c for c in (*range(0x20), *range(0x7F, 0xA0)) if c not in (9, 10, 13))


def fractions(text: Column) -> Column:
    made = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), FRACTIONS.items(), text)
    return F.when(text.rlike("[%s-%s&&[%s]]" % (min(FRACTIONS), max(FRACTIONS), "".join(FRACTIONS))), made).otherwise(text)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def _beyond_ascii(text: Column) -> Column:
    """text if it has a character of more than one byte, else null."""
    return pytext.once(text, lambda t: F.when(F.octet_length(t) > F.length(t), t))


def nfkc(text: Column) -> Column:
    """Unicode has no SQL function for it; texts in ASCII don't change, and go to Python as nulls."""
    return F.coalesce(_nfkc(_beyond_ascii(text)), text)


@F.pandas_udf(T.StringType())
def _plain_nfkc(text: pd.Series) -> pd.Series:
    def one(t: str) -> str:
        for a, b in FRACTIONS.items():
            t = t.replace(a, b)
        return unicodedata.normalize("NFKC", t)

    return text.map(one, na_action="ignore")


def fractions_nfkc(text: Column) -> Column:
    """nfkc(fractions(text)) with both in Python, where the texts that may change go anyway."""
    return F.coalesce(_plain_nfkc(_beyond_ascii(text)), text)


def drop_invisible(text: Column) -> Column:
    return F.regexp_replace(text, f"[{INVISIBLE}]", "")


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, f"[{CONTROLS}]", "")


def plain_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[\\u2000-\\u200a]", " ")


def squeeze_spaces(text: Column) -> Column:
    """Five or more spaces after a line's first other character become four; lines are joined by a newline."""
    return pytext.where_has(pytext.unify_lines(text), "     ", lambda t: F.regexp_replace(t, " (?<=[^ \\n] ) {4,}", "    "))


def squeeze_newlines(text: Column) -> Column:
    return pytext.where_has(text, "\n\n\n", lambda t: F.regexp_replace(t, "\\n{3,}", "\n\n"))


def strip_line_ends(text: Column, unified: bool = False) -> Column:
    """unified: text has no other line breaks than newlines."""
    return F.regexp_replace(text if unified else pytext.unify_lines(text), pytext.run_before(pytext.SPACE_BUT_NEWLINE, "(?=\\n|\\z)"), "")


def drop_noise(text: Column) -> Column:
    return F.regexp_replace(text, _NOISE_RUN, "")


def half_width(text: Column) -> Column:
    return F.translate(text, "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))


def punctuation(text: Column) -> Column:
    """Dots to an ellipsis, double marks, full-width marks, and full stops between no digits."""
    return _marks(text, HALF, FULL)


def _marks(text: Column, of: str, to: str) -> Column:
    text = F.translate(F.replace(text, F.lit("‼"), F.lit("!!")), of, to)
    text = pytext.where_has(text, "..", lambda t: F.regexp_replace(t, "\\.{2,}", "……"))
    return pytext.where_has(text, ".", lambda t: F.regexp_replace(t, "\\.(?<!\\p{Nd}\\.)(?!\\p{Nd})", "。"))


def half_width_punctuation(text: Column) -> Column:
    """punctuation(half_width(text)) in one table: a full-width mark would become half-width and full-width again."""
    wide = [c for c in range(0xFF01, 0xFF5F) if chr(c) not in FULL]
    return _marks(text, HALF + "".join(map(chr, wide)), FULL + "".join(chr(c - 0xFEE0) for c in wide))


def _alternate(text: Column, mark: str, opening: str, closing: str) -> Column:
    def marked(t: Column) -> Column:
        parts = F.split(t, mark, -1)
        return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).when(i % 2 == 1, F.concat(F.lit(opening), x)).otherwise(F.concat(F.lit(closing), x))), "")

    return pytext.where_has(text, mark, marked)


def quotes(text: Column) -> Column:
    """Straight quotes open and close in turn over the whole text."""
    return _alternate(_alternate(text, '"', "“", "”"), "'", "‘", "’")


def simplified(text: Column, table: dict[str, str] | None = None) -> Column:
    """Traditional to simplified characters by a table of single characters; without one, nothing changes."""
    if not table:
        return text
    return F.translate(text, "".join(table), "".join(table.values()))


def whitespace(text: Column) -> Column:
    # Both only drop characters; the end's newlines, of which strip_line_ends() would drop one, go with pytext.strip().
    text = F.regexp_replace(text, f"[{CONTROLS}{INVISIBLE}]", "")
    text = squeeze_newlines(squeeze_spaces(plain_spaces(text)))
    return pytext.strip(strip_line_ends(text, unified=True))


def normalize(text: Column, unicode_form: bool = True) -> Column:
    text = fractions_nfkc(text) if unicode_form else fractions(text)
    for step in (whitespace, drop_noise, half_width_punctuation, quotes):
        text = step(text)
    return text
