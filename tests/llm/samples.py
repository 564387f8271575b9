"""Fixed samples of the tests of the training-data operators."""

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"

# Rows with nulls everywhere, empty and long texts, ties, repeats, odd characters.
ODD = [
    (1, "The same words, twice over; THE same words.", "en", "a", 43), (2, "", "en", "a", 0), (3, None, None, None, None),
    (None, "no id at all here", "en", "b", 17), (None, None, None, None, None),
    (5, "dup row of some words", "de", "b", 21), (5, "dup row of some words", "de", "b", 21),
    (5, "dup row of other words entirely", "de", "b", 31), (6, " \t\r\n\x0b\x0c ", "fr", None, 7),
    (7, "é ü 漢字   nbsp em 😀 tail", "es", "c", 25), (8, "word " * 3000, "en", "c", 15000),
    (9, "a", "en", "c", 1), (10, "x" * 50_000, "en", "a", 50_000), (11, "no id at all here", "en", "b", 17)]
ODD = [(*r[:4], r[1] if r[1] is None else len(r[1])) for r in ODD]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
