"""Full Unicode case folding as a JVM expression."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, dict[str, str]]:
    """Code points that fold to one other code point (from, to), and those that fold to several.

    Built by rule from the Unicode data of this Python, not listed by hand.
    """
    one_from, one_to, many = [], [], {}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        to = ch.casefold()
        if to == ch:
            continue
        if len(to) == 1:
            one_from.append(ch)
            one_to.append(to)
        else:
            many[ch] = to
    return "".join(one_from), "".join(one_to), many


def casefold(col: Column | str) -> Column:
    """Full case folding (ß equals ss); null stays null.

    ASCII values take only lower(). The rest go through one translate() for the
    folds to one code point, and only values that hold a code point with a
    longer fold pass the chain of replacements. All of it stays in the JVM.
    """
    c = F.col(col) if isinstance(col, str) else col
    one_from, one_to, many = _tables()
    single = chained = F.translate(c, one_from, one_to)  # ASCII letters among them: lower() would change what is folded already
    for ch, to in many.items():
        chained = F.replace(chained, F.lit(ch), F.lit(to))
    return (
        F.when(~c.rlike(r"[^\x00-\x7F]"), F.lower(c))
        .when(c.rlike("[" + "".join(many) + "]"), chained)
        .when(c.isNotNull(), single)
    )
