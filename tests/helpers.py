"""Small corpora and brute-force versions that tests hold results against."""

from __future__ import annotations

import random
from collections import defaultdict


def corpus(spark, texts):
    """A corpus of texts (in order), or of ``{path: text}``."""
    items = list(texts.items()) if isinstance(texts, dict) else [(f"f{k:03d}.py", t) for k, t in enumerate(texts)]
    return spark.createDataFrame([(p, k, t) for k, (p, t) in enumerate(items)], "path string, file_ord long, text string")


def random_texts(seed: int, n: int, size: int, alphabet: str = "ab\n") -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, size))) for _ in range(n)]


def brute_grams(texts: list[str], l_min: int, n_min: int, l_max: int) -> dict[str, set]:
    """Contents and places of repeated substrings: every repeated run, extended as far as all of its places agree."""
    groups = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - l_min + 1):
            groups[t[i : i + l_min]].append((d, i))
    out = defaultdict(set)
    side = max(l_max - l_min, 1)
    for gram, places in groups.items():
        if len(places) < n_min:
            continue
        left = right = 0
        while left < side and len({texts[d][i - left - 1] if i - left > 0 else (d, i) for d, i in places}) == 1 and all(i - left > 0 for _, i in places):
            left += 1
        while right < side and all(i + l_min + right < len(texts[d]) for d, i in places) and len({texts[d][i + l_min + right] for d, i in places}) == 1:
            right += 1
        if l_min + left + right > l_max:
            right = max(0, l_max - l_min - left)
        d0, i0 = places[0]
        content = texts[d0][i0 - left : i0 + l_min + right]
        out[content] |= {(d, i - left, i + l_min + right) for d, i in places}
    return dict(out)
