"""Placeholders, codebook formats and headers."""

import pytest
from helpers import corpus
from hypothesis import given, settings
from hypothesis import strategies as st

from textfold.functions import alphabet, codebook
from textfold.functions.tokens import heuristic_count

KEYS = st.one_of(
    st.integers(1, 40).map(lambda n: [chr(0x4E00 + k) for k in range(n)]),
    st.integers(1, 30).map(lambda n: [f"^{k}" for k in range(1, n + 1)]),
    st.integers(1, 30).map(lambda n: [f"«{k}»" for k in range(3, n + 3)]),
    st.sets(st.integers(0x4E00, 0x4F00), min_size=1, max_size=60).map(lambda s: [chr(c) for c in sorted(s)]),
    st.integers(1, 5).map(lambda n: [chr(0x4E00 + k) for k in range(4)] + [f"~{k}" for k in range(1, n + 1)]),
    st.lists(st.text("abc_1", min_size=1, max_size=4), min_size=1, max_size=6, unique=True),
)


@settings(max_examples=150, deadline=None)
@given(KEYS, st.data())
def test_formats_are_inverse(keys, data):
    texts = st.text(alphabet=st.sampled_from("ab\n\r\"'\\=§¶‡†␞␟␤-{}«é😀\u2028"), min_size=1, max_size=12)
    mapping = {k: data.draw(texts) for k in keys}
    for f in codebook.FORMATS.values():
        payload, header = f.dump(mapping)
        assert f.load(payload, header) == mapping, f.name


@pytest.mark.parametrize(
    "keys,part",
    [
        (["一", "丁", "丂"], "cjk_start=19968 count=3"),
        (["一", "丁", "七"], "cjk_ranges='19968-19969,19971-19971' count=3"),
        (["一", "丁", "^1", "^2"], "cjk_start=19968 cjk_count=2 prefix='^' p_start=1 p_count=2"),
        (["^1", "^2"], "prefix='^' start=1 count=2"),
        (["«1»", "«2»"], "seq='«{:d}»' start=1 count=2"),
        (["ab", "c"], "keys="),
    ],
)
def test_headers(keys, part):
    payload, header = codebook.dump_positional({k: f"v{i}" for i, k in enumerate(keys)})
    assert part in header and heuristic_count(header) <= 40
    assert not any(k in payload for k in keys if len(k) == 1)


def test_empty_maps():
    assert codebook.dump_positional({}) == ("", "[MAP:INDEXED]")
    assert all(f.load(*f.dump({})) == {} for f in codebook.FORMATS.values())


def test_plain_key_list_is_read():
    assert codebook.load_positional("a§b", "[MAP:INDEXED sentinel='§' keys=k1,k2]") == {"k1": "a", "k2": "b"}


def test_key_order():
    keys = ["^10", "^9", "丁", "一", "x", "«2»", "«10»"]
    assert sorted(keys, key=codebook.positional_key) == ["一", "丁", "^9", "^10", "x", "«2»", "«10»"]


def test_comparison():
    rows = codebook.compare_formats({f"«{k}»": f"text {k}\n" for k in range(1, 6)}, heuristic_count)
    assert rows[0]["format"] == "positional" and all(r["exact_match"] for r in rows)


def test_style_choice(spark):
    assert alphabet.choose_style(corpus(spark, ["plain"])).style == "single_token"
    busy = "".join(chr(0x4E00 + k) for k in range(100))
    assert alphabet.choose_style(corpus(spark, [busy])).style == "prefix_compact"
    assert alphabet.choose_style(corpus(spark, [busy + " ^1 «1»", "^"])).prefix == "~"
    assert alphabet.choose_style(corpus(spark, ["x"]), "guillemet").style == "guillemet"


def test_alphabet_avoids_the_corpus(spark):
    docs = corpus(spark, ["一 丂 ^12 ^3"])
    made = alphabet.build_alphabet(docs, alphabet.Alphabet("single_token"), 3)
    assert made.tokens == ("丁", "七", "丄")
    made = alphabet.build_alphabet(docs, alphabet.Alphabet("prefix_compact"), 4)
    assert made.tokens == ("^2", "^4", "^5", "^6")
    made = alphabet.build_alphabet(corpus(spark, ["«1»«3»"]), alphabet.Alphabet("guillemet"), 2)
    assert made.tokens == ("«2»", "«4»")


def test_spill_over(spark):
    made = alphabet.build_alphabet(corpus(spark, ["x"]), alphabet.Alphabet("single_token"), alphabet.POOL_SIZE + 2)
    assert made.tokens[-2:] == ("^1", "^2")
    assert alphabet.protocol_of(list(made.tokens), "single_token")["type"] == "hybrid_cjk_prefix"


@pytest.mark.parametrize(
    "tokens,style,kind",
    [
        ([], "single_token", "default"),
        (["一", "丁"], "single_token", "cjk_contiguous"),
        (["一", "七"], "single_token", "cjk_multi_range"),
        (["^1", "^2"], "prefix_compact", "prefix_sequence"),
        (["«1»"], "guillemet", "template_sequence"),
    ],
)
def test_protocols(tokens, style, kind):
    assert alphabet.protocol_of(tokens, style)["type"] == kind


def test_style_costs(spark):
    cost = {r["style"]: r["avg_tokens"] for r in alphabet.style_costs(spark, 20).collect()}
    assert cost["single_token"] == 1 and cost["prefix_compact"] < cost["guillemet"] < cost["classic"]
