"""Rows with nulls, empty and long texts, repeats and columns whose names operators use."""

ODD = [
    # doc_id, text, lang, source, and columns whose names operators use themselves
    (1, "the cat sat on the mat " * 3, "en", "a", 1, "x", 2.0),
    (1, "the cat sat on the mat " * 3, "en", "a", 1, "x", 2.0),
    (1, "another text with the same id", None, None, None, None, None),
    (2, None, None, "b", 0, "", 0.0),
    (3, "", "", "", None, "y", None),
    (None, "a row without an id and mail to jo@mail.example.com, call +1 (437) 555-0689", "en", "b", 5, None, 1.0),
    (None, None, None, None, None, None, None),
    (4, "word " * 30_000, "en", "a", 7, "z", 1.5),
    (5, "x" * 40_000, "en", "c", 7, "z", 1.5),
    (6, "é🙂 ñandú 日本語 \t\x0b\x0c end", "es", "c", 7, "z", 1.5),
    (7, "\n \n\t", "es", "c", 7, "z", 1.5),
    (8, "Kept one two three four five six seven eight nine ten", "en", "a", 7, "z", 1.5),
    (9, "kept One two three four five six seven eight nine ten", "en", "a", 7, "z", 1.5),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, size long, component string, score double"
