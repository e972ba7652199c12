"""Compatibility decomposition without combining marks, as an expression: accents, ligatures, wide and styled letters, syllables."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import let

#: Syllables are decomposed by rule: the first of them, its three parts, and how many of the second and third kind there are.
SYLLABLE, FIRST, SECOND, THIRD, SECONDS, THIRDS = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28
SYLLABLES = 19 * SECONDS * THIRDS
#: Set characters and their replacements apart; not decomposed themselves.
_NEXT, _IS = "\u0001", "\u0002"


def folded(c: str) -> str:
    """One character, by the tables of the running Python."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@cache
def tables() -> tuple[str, str, dict[str, str]]:
    """(from, to, many): characters of the basic plane that become one other, with at the end those that vanish; and those that become
    several. Syllables are in neither."""
    one, gone, many = {}, [], {}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000 or SYLLABLE <= code < SYLLABLE + SYLLABLES:
            continue
        c = chr(code)
        to = folded(c)
        if not to:
            gone.append(c)
        elif len(to) > 1:
            many[c] = to
        elif to != c:
            one[c] = to
    return "".join(one) + "".join(gone), "".join(one.values()), many


def _class(chars: list[str]) -> str:
    """The inside of a regular expression's class that holds the characters and no others."""
    codes, out = sorted(map(ord, chars)), []
    start = last = codes[0]
    for c in [*codes[1:], 1 << 20]:
        if c > last + 1:
            out.append(f"\\u{start:04x}-\\u{last:04x}")
            start = c
        last = c
    return "".join(out)


def fold(text: Column) -> Column:
    """The text decomposed and without combining marks, as far as the basic plane goes. ASCII passes as it is, other texts of plain
    letters at the cost of one look-up a character; in those with a character that becomes several, what is not ASCII goes one by one."""
    source, target, many = tables()
    lookup = F.str_to_map(F.lit(_NEXT.join(c + _IS + to for c, to in many.items())), F.lit(_NEXT), F.lit(_IS))
    syllables = f"\\u{SYLLABLE:04x}-\\u{SYLLABLE + SYLLABLES - 1:04x}"
    several = _class(list(many))

    def letter(code: Column) -> Column:
        return F.decode(F.unhex(F.hex(code)), "UTF-16BE")

    def syllable(c: Column) -> Column:
        n = F.ascii(c) - SYLLABLE
        third = F.when(n % THIRDS > 0, letter(F.lit(THIRD) + n % THIRDS)).otherwise(F.lit(""))
        return F.concat(letter(F.lit(FIRST) + F.floor(n / (SECONDS * THIRDS))), letter(F.lit(SECOND) + F.floor(n % (SECONDS * THIRDS) / THIRDS)), third)

    def one(c: Column) -> Column:
        return F.when(F.ascii(c) < 0x80, c).when(c.rlike(f"[{syllables}]"), syllable(c)).when(c.rlike(f"[{several}]"), F.coalesce(F.try_element_at(lookup, c), c)).otherwise(c)

    def decomposed(plain: Column) -> Column:
        pieces = F.regexp_extract_all(plain, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
        # the many ranges are looked through for what is not ASCII only
        return F.when(plain.rlike(f"(?=[^\\x00-\\x7F])[{several}{syllables}]"), F.array_join(F.transform(pieces, one), "")).otherwise(plain)

    return let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), let(F.translate(t, source, target), decomposed)).otherwise(t))
