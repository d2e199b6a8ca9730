"""Terms of a text: for weighting (words, snake_case pairs, file endings) and for search (folded tokens, stems)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic.
# fmt: off
STOP_WORDS: list[str] = [
    "the", "and", "for", "are", "but", "not", "you", "all", "any", "can", "her", "was", "one", "our", "out", "has",
    "have", "had", "this", "that", "with", "from", "they", "been", "said", "each", "which", "their", "will", "way",
    "about", "many", "then", "them", "would", "like", "more", "some", "time", "very", "when", "what", "your", "how",
    "new", "now", "old", "see", "just", "also", "back", "after", "use", "two", "first", "well", "than", "only",
    "come", "its", "over", "such", "take", "into", "most", "make", "could", "does", "did", "being", "those", "there",
    "where", "here", "class", "def", "return", "import", "true", "false", "none", "self", "print", "function",
    "const", "let", "var", "file", "edit", "view", "window", "help", "menu", "tab", "untitled", "document", "sheet",
    "application",
]
# fmt: on

# Accented Latin letters and their base letters, in the same order.
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def terms(text: Column) -> Column:
    """array of terms with repetitions; null gives an empty array."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.concat(
        F.regexp_extract_all(low, F.lit(r"(?U)\b[a-z]{3,25}\b"), F.lit(0)),
        F.regexp_extract_all(low, F.lit("[a-z]+_[a-z]+"), F.lit(0)),
        F.regexp_extract_all(low, F.lit(r"(?U)\.\w{1,6}\b"), F.lit(0)),
    )
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def frame_terms(title: Column, text: Column) -> Column:
    return terms(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def search_tokens(text: Column) -> Column:
    """array of tokens in order: runs of letters and digits, in lower case, accents off."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
