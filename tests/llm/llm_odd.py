"""Texts that every operator must take."""

ODD = [
    "",
    None,
    " ",
    "\n",
    "a",
    "\x00",
    "é" * 3000,
    "word " * 5000,
    " " * 4000 + "x",
    "<|endoftext|> and <|im_end|>",
    "😀🙂 ünï—“quoted” 中文　\u0085 ",
    "a" * 20000,
    "same text here for two",
    "same text here for two",
]
