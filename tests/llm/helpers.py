"""Small tables with the awkward cases, and plain-Python versions of what operators compute."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, virtual_slot string, size string, `rank` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    long = " ".join(f"w{i % 97}x the" for i in range(6000))
    rows = [
        (1, "The cat sat on the mat and it's the end of the day, isn't it? Mail a.b@example.com or call +1 (202) 555-0147.", "en", "a", 5),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (4, long, "en", "b", 1),
        (5, "same text here again\nsame text here again\n\n \nsame text here again", "de", "b", 1),
        (5, "same text here again\nsame text here again\n\n \nsame text here again", "de", "b", 1),
        (6, "same text here again\nsame text here again\n\n \nsame text here again", "de", None, 1),
        (7, "one two three four five six seven eight nine ten one two three four five six seven eight nine ten x", "fr", "c", 1),
        (8, " \t\x0b\r\n\x0c ", "fr", "ä", 1),
        (9, "漢字 😀 　ünïcode's 123٣ \x85 $$$ ### x*y|z", "fr", "ä", 1),
        (None, "a text without id", "fr", "c", 1),
    ]
    return spark.createDataFrame([(*r, "v", "s", 1) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def base_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)
