"""Rows with nulls in every column, empty, blank and very long texts, ties and repeated rows."""

LONG = "wide river " * 15_000
ROWS = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t\n", "en", None), (4, "one", None, None), (5, "ONE", "de", "b"), (None, "a row without an id of its own", "en", "b"),
    (6, LONG, "en", "a"), (7, "x" * 3_000, "en", "a"), (8, "it's 12 o'clock  \n\n at Zoë's café, isn't it?\u00a0 ١٢ 漢字 🙂 <|endoftext|>", "fr", "a"),
    (9, "the same words stand in this row and in the next one", "en", "b"), (10, "the same words stand in this row and in the next one", "en", "b"),
    (11, "repeated row with five words or more", "en", "c"), (11, "repeated row with five words or more", "en", "c"),
]
CLASHES = ["n_words", "kept", "shard", "slot", "size", "host", "path", "rule", "verdict", "score", "label", "ids", "codes", "piece", "start", "part", "id", "n", "_row", "_text"]
