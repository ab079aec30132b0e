"""Rows that every operator must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "der Lauf and the run " * 60_000


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd spaces and alphabets."""
    return [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 68),
        (2, "the quick brown fox jumps over the LAZY dog near the river bank today", "en", "b", 68),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", None, "b", 4),
        (6, LONG, "de", "a", len(LONG)),
        (7, "one", "en", None, 3),
        (8, "one two", "en", "é", 7),
        (9, "mail a@b.co_x@y.zz, ip 1.2.3.4 and 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 010-9999 ok", "en", "b", 90),
        (9, "mail a@b.co_x@y.zz, ip 1.2.3.4 and 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 010-9999 ok", "en", "b", 90),
        (10, "😀 iban DE89 3704 0044 0532 0130 00 und GB82WEST12345698765432, x" + "9" * 40, "de", "z", 70),
        (11, "a" * 50_000, "xx", "z", 50_000),
        (None, "no id but a text of some words here", "en", "a", 35),
        (12, "Привет мир  двойной   пробел\x1c конец <|endoftext|> é", "ru", "z", 50),
        (13, "12345 67890 !!!", "en", "z", 15),
    ]
