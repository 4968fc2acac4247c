"""Placeholders: styles, choice of a style, alphabets free of the corpus, and what describes them.

Alphabets live on the driver; they hold as many tokens as there are entries in a codebook. What they
need from the corpus is gathered as bounded aggregates.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import heuristic_count

#: The pool of single-character placeholders, and the styles.
POOL_START, POOL_SIZE = 0x4E00, 2500
#: How far a wider pool goes: on to the last code point before the surrogates, then from plane 2 to the end of Unicode.
POOL_BREAK, POOL_ASTRAL, POOL_END = 0xD800, 0x20000, 0x110000
POOL_MOST = POOL_BREAK - POOL_START + POOL_END - POOL_ASTRAL
STYLES = {
    "single_token": "{}",
    "prefix_compact": "^{}",
    "guillemet": "«{}»",
    "classic": "__s{}__",
    "section": "§{}§",
    "bracket": "⟦{}⟧",
    "ascii_compact": "~{}~",
}
FALLBACKS = ("prefix_compact", "guillemet", "ascii_compact", "classic")
SENTINELS = ("§", "¶", "‡", "†", "␞", "␟")
#: Shapes that count as placeholders where no codebook says otherwise.
ANY_TOKEN = r"__[sbw]\d+__|«w?\d+»|\^w?\d+|~w?\d+~|§w?\d+§|⟦w?\d+⟧|[一-\ud7ff\U00020000-\U0010ffff]"


def pool_character(k: int) -> str:
    """The character of the pool at a place, from 0 on."""
    cp = POOL_START + k
    return chr(cp if cp < POOL_BREAK else cp - POOL_BREAK + POOL_ASTRAL)


def pool_place(ch: str) -> int:
    """The place of a character in the pool, or -1."""
    cp = ord(ch)
    if cp >= POOL_ASTRAL:
        return cp - POOL_ASTRAL + POOL_BREAK - POOL_START
    return cp - POOL_START if POOL_START <= cp < POOL_BREAK else -1


def corpus_charset(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``ch, n_docs``: the distinct characters of a corpus. Each document counts a character once, before the shuffle."""
    chars = F.explode(F.array_distinct(F.split(F.col(text_col), "")))
    return docs.select(chars.alias("ch")).where(F.col("ch") != "").groupBy("ch").agg(F.count("*").alias("n_docs"))


def noted_characters(docs: DataFrame, text_col: str = "text", pool: int = POOL_SIZE) -> set[str]:
    """Those of the characters an alphabet may use that the corpus holds: as many as its pool and a few more at most."""
    found = corpus_charset(docs, text_col).where(F.col("ch").rlike(r"^[一-\x{d7ff}\x{20000}-\x{10ffff}^~§¶‡†␞␟]$"))
    return {ch for ch, _ in found.collect() if pool_place(ch) < pool}


def free_alphabet(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``cp``: the code points of the pool that the corpus does not hold, by an anti join."""
    pool = docs.sparkSession.range(POOL_START, POOL_START + POOL_SIZE).select(F.col("id").alias("cp"), character(F.col("id")).alias("ch"))
    return pool.join(corpus_charset(docs, text_col), "ch", "left_anti").select("cp")


def character(cp: Column) -> Column:
    """The character of a code point below U+10000."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 4, "0")), "UTF-16BE")


def islands(points: DataFrame, col: str = "cp") -> DataFrame:
    """``start, end, n`` of runs of consecutive numbers. For sets of the size of an alphabet."""
    from pyspark.sql import Window

    numbered = points.select(F.col(col), (F.col(col) - F.row_number().over(Window.orderBy(col))).alias("island"))
    return numbered.groupBy("island").agg(F.min(col).alias("start"), F.max(col).alias("end"), F.count("*").alias("n")).drop("island")


def ranges_of(cps: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in cps:
        if out and cp == out[-1][1] + 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


@dataclass(frozen=True)
class Alphabet:
    """Tokens by number, from 1 on. ``pool`` is how many single characters there are before numbers follow (``POOL_MOST`` at most)."""

    style: str
    prefix: str = "^"
    tokens: tuple[str, ...] = field(default=())
    pool: int = POOL_SIZE

    def token(self, number: int) -> str:
        return self.tokens[number - 1] if number <= len(self.tokens) else nth(self.style, number, self.prefix, self.pool)


def nth(style: str, number: int, prefix: str = "^", pool: int = POOL_SIZE) -> str:
    """The token that a style gives a number where nothing stands against it."""
    if style == "single_token":
        return pool_character(number - 1) if number <= pool else f"{prefix}{number - pool}"
    if style == "prefix_compact":
        return f"{prefix}{number}"
    return STYLES[style].format(number)


def placeholder_column(style: str, number: Column, prefix: str = "^") -> Column:
    """:func:`nth` as a column."""
    text = number.cast("string")
    if style == "single_token":
        return F.when(number <= POOL_SIZE, character(number + (POOL_START - 1))).otherwise(F.concat(F.lit(prefix), (number - POOL_SIZE).cast("string")))
    if style == "prefix_compact":
        return F.concat(F.lit(prefix), text)
    before, after = STYLES[style].split("{}")
    return F.concat(F.lit(before), text, F.lit(after))


def choose_style(docs: DataFrame, requested: str = "auto", count=heuristic_count, text_col: str = "text", sample: int = 30) -> Alphabet:
    """The requested style, or single characters if 90 of the first 100 are free, or the cheapest style whose first token the corpus does not hold."""
    used = noted_characters(docs, text_col)
    prefix = "~" if "^" in used else "^"
    if requested in STYLES:
        return Alphabet(requested, prefix)
    if sum(chr(POOL_START + k) not in used for k in range(100)) >= 90:
        return Alphabet("single_token", prefix)
    ranked = []
    for style in FALLBACKS:
        if docs.where(F.col(text_col).contains(nth(style, 1, prefix))).isEmpty():
            ranked.append((sum(count(nth(style, k, prefix)) for k in range(1, sample + 1)) / sample, style))
    return Alphabet(min(ranked)[1] if ranked else "prefix_compact", prefix)


def build_alphabet(docs: DataFrame, alphabet: Alphabet, needed: int, text_col: str = "text") -> Alphabet:
    """``needed`` tokens of a style, none of which stands in the corpus."""
    tokens: list[str] = []
    style = alphabet.style
    if style == "single_token":
        used = noted_characters(docs, text_col, alphabet.pool)
        tokens = list(itertools.islice((c for c in map(pool_character, range(alphabet.pool)) if c not in used), needed))
        style = "prefix_compact"
    if len(tokens) < needed:
        before, after = (alphabet.prefix, "") if style == "prefix_compact" else STYLES[style].split("{}")
        taken = _numbers_used(docs, before, after, needed * 2 + 10, text_col)
        number = 1
        while len(tokens) < needed:
            if number not in taken:
                tokens.append(f"{before}{number}{after}")
            number += 1
            if number > needed * 2 + 10:  # a corpus full of tokens: look further
                taken |= _numbers_used(docs, before, after, number * 4, text_col)
    return Alphabet(alphabet.style, alphabet.prefix, tuple(tokens), alphabet.pool)


def _numbers_used(docs: DataFrame, before: str, after: str, most: int, text_col: str) -> set[int]:
    """Numbers up to ``most`` whose tokens stand in the corpus, also as the beginning of a longer number."""
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"(?={re.escape(before)}(\\d+){re.escape(after)})"), F.lit(1))).alias("digits"))
    if not after:
        found = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("digits"), F.lit(len(str(most))))), lambda k: F.substring("digits", F.lit(1), k))).alias("digits"))
    found = found.where(~F.col("digits").startswith("0") & (F.length("digits") <= len(str(most)))).select(F.col("digits").cast("long").alias("n")).where(F.col("n") <= most).distinct()
    return {r["n"] for r in found.collect()}


def protocol_of(tokens: list[str], style: str, prefix: str = "^") -> dict:
    """What describes the tokens in use: one of seven kinds."""
    if not tokens:
        return {"type": "default", "style": style}
    single = [t for t in tokens if len(t) == 1 and ord(t) >= POOL_START]
    numbered = [t for t in tokens if len(t) > 1 and t[0] in "^~" and t[1:].isdigit()]
    spans = ranges_of([ord(t) for t in single])
    if len(single) == len(tokens):
        if len(spans) == 1:
            return {"type": "cjk_contiguous", "start_cp": spans[0][0], "start_char": single[0], "count": len(tokens)}
        return {"type": "cjk_multi_range", "ranges": spans, "count": len(tokens)}
    if single and len(single) + len(numbered) == len(tokens):
        return {
            "type": "hybrid_cjk_prefix",
            "cjk_ranges": spans,
            "cjk_count": len(single),
            "prefix": numbered[0][0],
            "p_start": int(numbered[0][1:]),
            "p_count": len(numbered),
            "count": len(tokens),
        }
    if style == "prefix_compact" or tokens[0].startswith(prefix):
        return {"type": "prefix_sequence", "prefix": prefix, "start": 1, "count": len(tokens)}
    if style != "single_token":
        return {"type": "template_sequence", "template": STYLES[style].replace("{}", "{:d}"), "start": 1, "count": len(tokens)}
    return {"type": "explicit_alphabet", "alphabet": "".join(tokens), "count": len(tokens)}


def style_costs(spark, count: int = 50) -> DataFrame:
    """``style, n, total_tokens, avg_tokens, min_tokens, max_tokens`` of the first tokens of every style."""
    from .tokens import heuristic_tokens

    numbers = spark.range(1, count + 1)
    parts = [numbers.select(F.lit(s).alias("style"), heuristic_tokens(placeholder_column(s, F.col("id"))).alias("t")) for s in STYLES]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("style").agg(
        F.count("*").alias("n"), F.sum("t").alias("total_tokens"), F.bround(F.avg("t"), 3).alias("avg_tokens"), F.min("t").alias("min_tokens"), F.max("t").alias("max_tokens")
    )
