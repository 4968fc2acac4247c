"""Stateless operators on streams: canonical forms, token counts, and encoding with a frozen codebook.

An extension: a stream has no view of the whole corpus, so repeats are not searched in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Canon
from ..functions.canon import canonicalize
from ..functions.tokens import TokenCounter, get_counter
from ..operators.codec import CODEBOOK_LIMIT


def counted(stream: DataFrame, canon: Canon | None = None, counter: TokenCounter | None = None) -> DataFrame:
    """``stream`` (with ``path`` and ``text``) in canonical form, with ``tokens``."""
    counter = counter or get_counter()
    rows = canonicalize(stream, canon) if canon else stream
    return rows.withColumn("tokens", counter.column(F.col("text")))


def encoded(stream: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Replace every content of a frozen codebook in each text, the longest first, from left to right, without its tokens clashing.

    Texts that hold one of the tokens already are left as they are, so decoding stays exact.
    """
    import re

    if sum(len(k) + len(v) for k, v in mapping.items()) > CODEBOOK_LIMIT:
        raise ValueError("the codebook is too large to send")
    sent = stream.sparkSession.sparkContext.broadcast(mapping)

    @F.pandas_udf("string")
    def replace(texts):
        by_content = {v: k for k, v in sent.value.items() if v}
        if not by_content:
            return texts
        pattern = re.compile("|".join(re.escape(c) for c in sorted(by_content, key=len, reverse=True)))
        tokens = re.compile("|".join(re.escape(t) for t in sorted(sent.value, key=len, reverse=True)))

        def one(text):
            if text is None or tokens.search(text):
                return text

            def put(m):
                token = by_content[m[0]]
                after = text[m.end() : m.end() + 1]
                return m[0] if token[-1].isdigit() and after.isdigit() else token

            return pattern.sub(put, text)

        return texts.map(one)

    return stream.withColumn("text", replace(F.col("text")))
