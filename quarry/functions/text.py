"""Text columns: normalising, similarity, phonetic codes, HTML, highlighting. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundaries. Spark's \b knows letters of all scripts, the patterns here mean ASCII ones.
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Phonetic digit of each consonant; two-letter sounds come first and letters without a digit are dropped.
PHONETIC_PAIRS = {"bh": "1", "ch": "2", "dh": "3", "th": "3", "sh": "7"}
PHONETIC = {"b": "1", "p": "1", "c": "2", "k": "2", "q": "2", "d": "3", "t": "3", "l": "4", "m": "5", "n": "5", "r": "6", "s": "7", "v": "8", "w": "8", "j": "9", "g": "9", "z": "9"}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def normalize_string(c: Column) -> Column:
    """Lower case, runs of white space and punctuation as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"""[\s\-_.,;:'"()]+""", " "))


def lowered(c: Column) -> Column:
    """Lower case, a character for each: the Turkish capital I with a dot is an i, as in the SQL, and not two characters."""
    return F.lower(F.translate(c, "\u0130", "i"))


def byte_edits(a: Column, b: Column) -> Column:
    """Edit distance of the UTF-8 bytes: each byte is read as a character of its own."""
    return F.levenshtein(*(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1") for c in (a, b)))


def similarity(a: Column, b: Column, empty: float = 1.0) -> Column:
    """1 - edit distance / longer length, lower-cased. empty: the value for two empty strings."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(empty)).otherwise(1 - F.levenshtein(x, y) / longest)


def normalized_similarity(a: Column, b: Column) -> Column:
    """similarity() of normalised strings; 0 if either is empty."""
    x, y = normalize_string(a), normalize_string(b)
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def phonetic(c: Column) -> Column:
    """First character as it is, then the digits of the consonants after it."""
    low = F.lower(c)
    rest = F.substring(low, 2, 1 << 30)
    for pair, digit in PHONETIC_PAIRS.items():
        # digits mark what is done; digits of the text itself are dropped first
        rest = F.regexp_replace(rest, "[0-9]", " ") if pair == "bh" else rest
        rest = F.replace(rest, F.lit(pair), F.lit(digit))
    rest = F.translate(rest, "".join(PHONETIC), "".join(PHONETIC.values()))
    return F.concat(F.substring(low, 1, 1), F.regexp_replace(rest, "[^0-9]", ""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\D", "")


def last_ten(c: Column) -> Column:
    return F.substring(digits(c), -10, 10)


def phones_match(a: Column, b: Column) -> Column:
    """Same last ten digits; never true for a missing or short number."""
    return F.coalesce((last_ten(a) == last_ten(b)) & (F.length(last_ten(a)) == 10), F.lit(False))


def emails_match(a: Column, b: Column) -> Column:
    return F.coalesce((F.lower(F.trim(a)) == F.lower(F.trim(b))) & (F.length(F.trim(a)) > 0), F.lit(False))


def names_match(a: Column, b: Column, threshold: float = 0.85) -> Column:
    return F.coalesce(normalized_similarity(a, b) >= threshold, F.lit(False))


def initials_match(a: Column, b: Column) -> Column:
    """Equal but for case, or one has fewer tokens and its tokens begin the other's, in order."""
    x, y = F.split(F.lower(F.trim(a)), r"\s+"), F.split(F.lower(F.trim(b)), r"\s+")
    pairs = F.arrays_zip(F.slice(x, 1, F.least(F.size(x), F.size(y))).alias("x"), F.slice(y, 1, F.least(F.size(x), F.size(y))).alias("y"))
    aligned = F.forall(pairs, lambda p: F.startswith(p["x"], p["y"]) | F.startswith(p["y"], p["x"]))
    return (F.lower(F.trim(a)) == F.lower(F.trim(b))) | ((F.size(x) != F.size(y)) & aligned)


def format_tag(c: Column) -> Column:
    return (
        F.when(c.rlike(r"^\+91"), "international").when(c.rlike(r"^\d{5}\s\d{5}$"), "spaced").when(c.rlike(r"^\d{4}[-\s]\d{4}[-\s]\d{4}$"), "segmented").when(c.rlike(r"^[A-Z]{5}\d{4}[A-Z]$"), "pan_standard").otherwise("standard")
    )


def parse_date(c: Column) -> Column:
    """DD/MM/YYYY or DD-MM-YYYY first, then ISO; null for anything else."""
    text = F.trim(c.cast("string"))
    day_first = F.regexp_replace(F.regexp_extract(text, r"^(\d{1,2}[-/]\d{1,2}[-/]\d{4})$", 1), "-", "/")
    return F.coalesce(F.try_to_timestamp(F.nullif(day_first, F.lit("")), F.lit("d/M/yyyy")), F.try_to_timestamp(text))


def html_to_text(c: Column) -> Column:
    """Scripts, styles and comments go, tags become spaces, entities are decoded in a fixed order, white space collapses."""
    text = F.regexp_replace(c, r"(?is)<script\b.*?</script>", "")
    text = F.regexp_replace(text, r"(?is)<style\b.*?</style>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    # numeric entities: the text is cut before each, and the number at the head of a piece becomes its character
    pieces = F.split(text, r"(?=&#\d{1,7};)")
    code = lambda x: F.regexp_extract(x, r"^&#(\d{1,7});", 1)
    decoded = F.transform(pieces, lambda x: F.when(F.length(code(x)) > 0, F.concat(_char(code(x)), F.regexp_replace(x, r"^&#\d{1,7};", ""))).otherwise(x))
    return F.trim(F.regexp_replace(F.array_join(decoded, ""), r"\s+", " "))


def _char(code: Column) -> Column:
    """Character of a UTF-16 unit, as that is what the numbers mean."""
    unit = F.pmod(code.cast("long"), F.lit(65536))
    return F.decode(F.unhex(F.lpad(F.hex(unit), 4, "0")), "UTF-16BE")


def highlight(c: Column, term: str, mark: str = "**") -> Column:
    """Every occurrence of the term, whatever its case, between marks."""
    import re

    return F.regexp_replace(c, f"(?i)({re.escape(term)})", f"{mark}$1{mark}") if term else c


def _places(low: Column, term: str) -> Column:
    n = len(term)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)) == term)
    return F.transform(places, lambda i: F.struct((i - 1).cast("int").alias("start"), (i - 1 + n).cast("int").alias("stop")))


def highlight_spans(c: Column, terms: list[str]) -> Column:
    """array<struct<start, stop>>: occurrences of the terms of two characters or more, merged where they touch."""
    low = F.lower(c)
    found = F.array().cast("array<struct<start:int,stop:int>>")
    for term in dict.fromkeys(t.lower() for t in terms if len(t) >= 2):
        found = F.concat(found, _places(low, term))
    ordered = F.array_sort(found)

    def merge(acc: Column, x: Column) -> Column:
        touches = (F.size(acc) > 0) & (x["start"] <= F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["stop"]).otherwise(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["stop"], x["stop"]).alias("stop"))))
        return F.when(touches, joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ordered, F.array().cast("array<struct<start:int,stop:int>>"), merge)


def capitalize_name(c: Column) -> Column:
    """Letters only, first upper and the rest lower."""
    word = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def truncate(c: Column, width: int = 50) -> Column:
    text = F.coalesce(c.cast("string"), F.lit("—"))
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
