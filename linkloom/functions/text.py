"""Text functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word is, what interrupts a run of words, what is masked as an address or e-mail.
WORD = r"[\p{L}\p{N}\p{M}]+(?:['’-][\p{L}\p{N}\p{M}]+)*"
BREAK = r"[^\p{L}\p{N}\p{M}'’ -]+"
MASK = r"(?i)(?:https?://|www\.)[^ \t\n\r\f\v]+|[^ \t\n\r\f\v]+@[^ \t\n\r\f\v]+\.[^ \t\n\r\f\v]+"
#: What an address or e-mail holds in any case, found in a fraction of the time: texts without it need no search for MASK.
MAY_MASK = r"(?i)@|://|www\."
#: Accented letters and what they fold to; ñ stays a letter of its own.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüçýÿ"
FOLDED = "aaaaaaeeeeiiiiooooouuuucyy"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ngrams(text: Column, most: int = 3) -> Column:
    """All runs of one to `most` words that no sign or line break interrupts, joined by a space, as structs (n, term)."""
    runs = F.filter(F.transform(F.split(F.lower(text), BREAK), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0))), lambda r: F.size(r) > 0)

    def of(run: Column, n: int) -> Column:
        starts = F.when(F.size(run) >= n, F.sequence(F.lit(1), F.size(run) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(run, i, F.lit(n)), " ").alias("term")))

    return F.flatten(F.transform(runs, lambda r: F.concat(*[of(r, n) for n in range(1, most + 1)])))


def micro(x: Column) -> Column:
    """x in millionths, as a long: equal on engines whose floating sums differ in the last bits."""
    return F.floor(x * 1e6 + 0.5).cast("long")
