"""Text expressions with Python's notion of whitespace and word characters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that str.strip() removes (the last one is U+3000).
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_WORD = r"[\p{L}\p{N}_]"
_TOKEN = r"(?U)[^\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    """Python's str.strip(): Spark's plain trim would leave newlines and NBSP."""
    return F.trim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def normalize_label(c: Column) -> Column:
    """`Sales and Pre-Sales` -> `sales_and_pre_sales`; blank and null -> null."""
    return F.nullif(F.translate(F.lower(strip(c.cast("string"))), "- ", "__"), F.lit(""))


def source_label(c: Column) -> Column:
    """Trimmed label with its case kept; blank -> null."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def combine_text(parts: Sequence[Column]) -> Column:
    """Non-empty parts joined by a blank line."""
    return F.concat_ws("\n\n", *[F.nullif(clean_text(p), F.lit("")) for p in parts])


def subject_body_text(subject: Column, body: Column, *fallbacks: Column) -> Column:
    """Subject and body; where both are empty, the first non-empty fallback."""
    text = combine_text([subject, body])
    choices = [F.nullif(t, F.lit("")) for t in (text, *map(clean_text, fallbacks))]
    return F.coalesce(*choices, F.lit(""))


def word_pattern(term: str) -> str:
    """Regex for `term` as a whole word (a Unicode word border on either side).

    The literal comes first and the border before it is checked afterwards, looking back
    over the literal: the regex engine can then search for the literal itself.
    """
    literal = r"\Q" + term + r"\E"

    def inside(char: str) -> bool:
        return char.isalnum() or char == "_"

    before = f"(?<{'!' if inside(term[0]) else '='}{_WORD}{literal})"
    after = f"(?{'!' if inside(term[-1]) else '='}{_WORD})"
    return literal + before + after


def has_term(lowered: Column, term: str) -> Column:
    """Whole-word match. The cheap substring test decides most rows without a regex."""
    term = term.lower()
    return F.contains(lowered, F.lit(term)) & lowered.rlike(word_pattern(term))


def matched_terms(lowered: Column, terms: Iterable[str], prefix: str = "") -> Column:
    """The terms found in an already lower-cased text, in alphabetical order."""
    found = [F.when(has_term(lowered, t), F.lit(prefix + t)) for t in sorted(set(terms))]
    return present(found)


def present(values: Sequence[Column]) -> Column:
    """Array of the distinct non-null values, in the order given."""
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))


def any_substring(lowered: Column, terms: Iterable[str]) -> Column:
    test = F.lit(False)
    for term in terms:
        test = test | F.contains(lowered, F.lit(term))
    return test


def substring_count(lowered: Column, terms: Iterable[str]) -> Column:
    """How many of the terms occur anywhere, also inside longer words."""
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(lowered, F.lit(term)).cast("int")
    return total


def token_count(c: Column) -> Column:
    """Number of whitespace-separated tokens; 0 for null."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(_TOKEN))


def _kept_tags(columns: Sequence[Column]) -> list[Column]:
    texts = [strip(c.cast("string")) for c in columns]
    return [F.when(~F.lower(t).isin("", "none", "nan"), t) for t in texts]


def clean_tags(columns: Sequence[Column]) -> Column:
    """Array of trimmed tags; null, blank, `none` and `nan` are left out, repeats are kept."""
    return F.array_compact(F.array(*_kept_tags(columns)))


def tag_text(columns: Sequence[Column], separator: str = ", ") -> Column:
    """The same tags as one text."""
    return F.concat_ws(separator, *_kept_tags(columns))


def model_text(message: Column, ticket_type: Column, tags: Column) -> Column:
    """Model input of the curated table; the agent's answer has no place in it."""
    return strip(
        F.concat(
            clean_text(message), F.lit("\n\nType: "), clean_text(ticket_type), F.lit("\nTags: "), clean_text(tags)
        )
    )


def preview(c: Column, length: int = 90) -> Column:
    """One-line preview: text over `length` is cut to length-1 characters plus `...`."""
    text = F.translate(clean_text(c), "\n", " ")
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("..."))).otherwise(text)


def humanize(c: Column, names: dict[str, str]) -> Column:
    """Display name of a label; labels without one are title-cased, blank -> `Unknown`.

    A letter is a capital at the start and after whatever is no cased letter (`Pre-Sales`,
    `3Rd`, `Don'T`), small elsewhere.
    """
    words = F.regexp_extract_all(F.translate(c, "_", " "), F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    named = F.lit(None).cast("string")
    if names:
        named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[c]
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("Unknown")).otherwise(F.coalesce(named, titled))


_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def display_time(c: Column, text: bool = False) -> Column:
    """Minutes in UTC, `N/A` for none. A time that comes as `text` shows the clock time it
    names when it is ISO, and as it is otherwise."""
    shape = "yyyy-MM-dd HH:mm 'UTC'"
    if not text:
        return F.coalesce(F.date_format(c, shape), F.lit("N/A"))
    iso = F.when(c.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(c, r"(Z|[+-]\d{2}:\d{2})$", "")))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("N/A")).otherwise(F.coalesce(F.date_format(iso, shape), c))


