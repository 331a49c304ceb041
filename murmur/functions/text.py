"""Column functions on text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, and the four ASCII separators Python also takes for spaces.
_SPACES_BUT_BLANK = (
    r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE = f"[ {_SPACES_BUT_BLANK}]"
# A run of spaces other than a single blank, which can stay as it is.
_SPACE_RUN = f"[{_SPACES_BUT_BLANK}]{_SPACE}*| {_SPACE}+"
_SPACE_LETTERS = " " + "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"

# Words left out of search queries.
SEARCH_STOP_WORDS = [
    "what", "which", "where", "when", "who", "how", "the", "and", "are", "is", "there", "this",
    "that", "with", "have", "has", "any", "about", "does", "from", "for", "give", "show", "tell",
    "list", "all", "campus", "feedback", "problem", "problems", "issue", "issues", "please", "can",
    "you", "your", "many", "much", "most", "some", "them", "they", "their", "into", "over",
]


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def collapse_spaces(text: Column) -> Column:
    """Trim, and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def strip_spaces(text: Column) -> Column:
    """Without white space at both ends; only the ends are looked at, a pattern would be tried at every blank."""
    return F.trim(text, F.lit(_SPACE_LETTERS))


def rstrip_spaces(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACE_LETTERS))


def is_blank(text: Column) -> Column:
    """Nothing but white space, or one of the words that stand for a missing text."""
    return text.rlike(rf"\A{_SPACE}*(?:nan|None)?{_SPACE}*\z")


def title_case(text: Column) -> Column:
    """Capitalise every run of cased letters: ``wi-fi`` gives ``Wi-Fi``, ``men's`` ``Men'S``."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))

    def rest(w: Column) -> Column:
        return w.substr(F.lit(2), F.length(w))

    def capital(w: Column) -> Column:
        head = F.upper(F.substring(w, 1, 1))  # two letters for a sharp s or a ligature
        return F.concat(F.substring(head, 1, 1), F.lower(rest(head)), rest(w))

    return F.array_join(F.transform(runs, capital), "")


def classifier_form(text: Column) -> Column:
    """Lower case, single blanks, one blank of padding on each side."""
    # All white space becomes blanks first: a pattern of two blanks is quicker than one of classes.
    blanks = F.translate(F.lower(F.coalesce(text, F.lit(""))), _SPACE_LETTERS, " " * len(_SPACE_LETTERS))
    folded = F.regexp_replace(blanks, "  +", " ")
    return F.concat(F.lit(" "), folded, F.lit(" "))


def search_form(text: Column) -> Column:
    """Lower case, then nothing but ``a-z``, ``0-9`` and the blank; hyphens go like other marks.

    The class names what goes. A negated one means the same, but Java's matcher took seven times as
    long over it (3.2 s against 0.5 s for 25 MB on eight cores).
    """
    return F.regexp_replace(F.lower(text), r"[\x00-\x1f!-/:-`{-\x{10ffff}]+", "")


def query_words(question: Column) -> Column:
    """Words of four or more characters that are not stop words, duplicates kept."""
    words = F.regexp_extract_all(search_form(question), F.lit("([a-z0-9]{4,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(SEARCH_STOP_WORDS))


def prefixes(words: Column, size: int = 5) -> Column:
    return F.transform(words, lambda w: F.substring(w, 1, size))


def grams(text: Column, sizes: list[tuple[int, int]], letters: str = "[a-z0-9]") -> Column:
    """All overlapping character runs, one linear pass per (smallest, largest) size.

    A pass gives the longest run within its sizes that starts at each position.
    """
    found = [
        F.regexp_extract_all(text, F.lit(f"(?s)(?=({letters}{{{a},{z}}}))"), F.lit(1))
        for a, z in sizes
    ]
    return found[0] if len(found) == 1 else F.concat(*found)


def truncate_summary(text: Column, limit: int = 140) -> Column:
    """The stripped text, cut to ``limit`` characters with a trailing ellipsis."""
    body = strip_spaces(text)
    cut = F.concat(rstrip_spaces(F.substring(body, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(body) <= limit, body).otherwise(cut)


def day_text(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("-"))


def text_key(text: Column, prompt: str = "") -> Column:
    """Identity of a text under a prompt: a changed prompt changes every key."""
    return F.sha1(F.concat(F.lit(prompt + "|"), F.coalesce(text, F.lit(""))))
