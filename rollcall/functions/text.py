"""Column expressions that read names, places and spellings out of transcript text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Introduction patterns in the order they are tried, each with its base score.
N = r"[A-Za-z][A-Za-z'\-]+"
NN = rf"{N}(?:\s+{N})?"
NAME_RULES = [
    (rf"\bmy name is\s+({NN})", 40.0),
    (rf"\bi'?m\s+({NN}),?\s+and\s+i'?m\s+(?:also\s+)?from", 35.0),
    (rf"\b(?!i'?m\b)({N})\s+and\s+i'?m\s+from", 35.0),
    (rf"\bi'?m\s+({NN})\s+and\s+i'?m\s+(?:very|currently|also|not)", 32.0),
    (rf"\b(?:hi|hey|hello),?\s*i'?m\s+({N})", 30.0),
    (rf"\bi'?m\s+({NN})\s+and\s+i'?m\s+from", 28.0),
    (rf"\bthis is\s+({NN})", 25.0),
    (rf"\bcall me\s+({NN})", 25.0),
]

# Words that are never a name.
BLOCKED_WORDS = """
here back good great sure yes no the a an and with from your our when going first what that this there where how
why just very really well so oh sorry involved currently not also excited telling view voting all right okay
""".split()

# Places, spellings, clarifications and pronunciations.
LOCATION_PATTERNS = [
    r"\bi'?m\s+(?:also\s+)?from\s+([^.!?]+)",
    r"\band\s+i'?m\s+from\s+([^.!?]+)",
    r"\bfrom\s+([^.!?]+)",
]
LETTERS_PATTERN = r"\b(?:[A-Z](?:\s*-\s*|\s+)){2,}[A-Z]\b"
CLARIFICATION_PATTERNS = [r"\bwith\s+an?\s+([A-Z])\b", r"\bspelled\s+with\s+an?\s+([A-Z])\b", r"\bit'?s\s+an?\s+([A-Z])\b"]
PRONUNCIATION_PATTERNS = [r"\bpronounced\s+(?:as\s+)?([^.,!?]+)", r"\bpronunciation\s+(?:is\s+)?([^.,!?]+)"]
OTHER_NAME_NOTE = "Spelling offered on camera (may refer to another name in this clip)"

ANY_CASE = "(?iU)"  # case-insensitive, with Unicode white space and word edges


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _strip_marks(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"^[.,!?]+|[.,!?]+$", "")


def _before(text: Column, pattern: str) -> Column:
    return F.get(F.split(text, ANY_CASE + pattern, 2), F.lit(0))


def _blocked(word: Column) -> Column:
    return F.lower(word).isin(*BLOCKED_WORDS)


def clean_name(raw: Column) -> Column:
    """T3, first half: marks off, text after "and I'm" or "from" cut, spaces squeezed; "" when it opens with "I'm"."""
    marks_off = _strip_marks(raw)
    cut = _before(_before(marks_off, r"\s+and\s+i'?m\b"), r"\s+from\b")
    return F.when(marks_off.rlike(ANY_CASE + r"^i'?m\b"), "").otherwise(squeeze(cut))


def valid_name(name: Column) -> Column:
    """T3, second half: one to three words of two letters or more, none of them blocked."""
    words = F.split(name, " ")
    return (name != "") & (F.size(words) <= 3) & F.forall(
        words, lambda w: (F.length(w) >= 2) & ~_blocked(w) & w.rlike(r"^[A-Za-z][A-Za-z'\-]*$")
    )


def spoken_names(text: Column) -> Column:
    """``array<struct<name, score, rule, pos>>`` in rule order, each name once per text."""

    def hits(rule: int, pattern: str, score: float) -> Column:
        captures = F.regexp_extract_all(text, F.lit(ANY_CASE + pattern), F.lit(1))
        return F.transform(captures, lambda raw, pos: F.struct(
            clean_name(raw).alias("name"), F.lit(score).alias("score"), F.lit(rule).alias("rule"), pos.alias("pos"),
        ))

    found = F.concat(*[hits(rule, pattern, score) for rule, (pattern, score) in enumerate(NAME_RULES)])
    return F.filter(found, lambda hit: valid_name(hit["name"]))


def first_of_each_name(names: Column) -> Column:
    """T4 on the array of T2/T3: keep an entry if no earlier one has the same lower-cased name."""
    lowered = F.transform(names, lambda hit: F.lower(hit["name"]))
    return F.filter(names, lambda hit, i: F.array_position(lowered, F.lower(hit["name"])) == i + 1)


def with_spoken_names(df: DataFrame, text: str = "text", out: str = "spoken") -> DataFrame:
    """T2 to T4 in two projections, so the patterns run once per text."""
    return df.withColumn(out, spoken_names(F.col(text))).withColumn(out, first_of_each_name(F.col(out)))


def location(text: Column) -> Column:
    """The first "from ..." phrase that is not a blocked word; "" if none."""
    found = []
    for pattern in LOCATION_PATTERNS:
        raw = _strip_marks(F.regexp_extract(text, ANY_CASE + pattern, 1))
        place = squeeze(_before(_before(raw, r"\s+and\s+i'?m\b"), r"\s+but\b"))
        found.append(F.when((place != "") & ~_blocked(place), place))
    return F.coalesce(*found, F.lit(""))


def letter_spellings(text: Column) -> Column:
    """Names spelled letter by letter, as ``C-O-R-Y``, each once."""
    raw = F.regexp_extract_all(text, F.lit(ANY_CASE + LETTERS_PATTERN), F.lit(0))
    dashed = F.transform(raw, lambda s: F.regexp_replace(F.upper(s), r"(?U)[\s\-]+", "-"))
    return F.array_distinct(dashed)


def clarified_letters(text: Column) -> Column:
    """The letter of the last match of each "with a K" pattern, each letter once."""
    letters = [
        F.try_element_at(F.regexp_extract_all(text, F.lit(ANY_CASE + pattern), F.lit(1)), F.lit(-1))
        for pattern in CLARIFICATION_PATTERNS
    ]
    return F.array_distinct(F.transform(F.array_compact(F.array(*letters)), F.upper))


def clarification_notes(letters: Column) -> Column:
    return F.transform(letters, lambda letter: F.concat(F.lit("Spelled with a "), letter, F.lit(" on camera")))


def letters_only(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z]", ""))


def relates(spelling: Column, name: Column) -> Column:
    """One contains the other, or same length with two differences at most, or the same last three letters."""
    return related_letters(letters_only(spelling), letters_only(name))


def related_letters(a: Column, b: Column) -> Column:
    """T12 for words that are ``letters_only`` already."""
    differing = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda d: d))
    near = (F.length(a) == F.length(b)) & (differing <= 2)
    ending = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.right(a, F.lit(3)) == F.right(b, F.lit(3)))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | near | ending)


def best_spelling(spellings: Column, name: Column) -> Column:
    """The longest related spelling, the first of equals; "" if none relates."""
    related = F.filter(spellings, lambda s: relates(s, name))
    return F.aggregate(
        related, F.lit(""),
        lambda best, s: F.when(F.length(letters_only(s)) > F.length(letters_only(best)), s).otherwise(best),
    )


def _latest_other(letters: Column, current: Column) -> Column:
    return F.get(F.filter(F.reverse(letters), lambda letter: letter != current), F.lit(0))


def clarify_spelling(spelling: Column, letters: Column) -> Column:
    """T14 for a spelling: the latest clarified letter that differs replaces the first chunk."""
    chunks = F.filter(F.split(spelling, "-"), lambda part: part != "")
    letter = _latest_other(letters, F.upper(F.get(chunks, F.lit(0))))
    changed = F.array_join(F.concat(F.array(letter), F.slice(chunks, F.lit(2), F.size(chunks))), "-")
    return F.when((spelling == "") | letter.isNull(), spelling).otherwise(changed)


def clarify_name(name: Column, letters: Column) -> Column:
    """T14 for a name: the latest clarified letter that differs replaces the first letter."""
    letter = _latest_other(letters, F.upper(F.left(name, F.lit(1))))
    changed = F.concat(letter, F.substring(name, F.lit(2), F.length(name)))
    return F.when((name == "") | letter.isNull(), name).otherwise(changed)


def spelling_replaces_name(spelling: Column, name: Column) -> Column:
    """Whether the spelling is close enough in length to be shown as the name."""
    a, b = F.length(letters_only(spelling)), F.length(letters_only(name))
    several_words = F.size(F.split(squeeze(name), " ")) > 1
    return relates(spelling, name) & ~(several_words & (a > b + 2)) & (F.abs(a - b) <= 3)


def name_from_spelling(spelling: Column) -> Column:
    """Up to three letters stay capitals, longer ones are capitalised."""
    letters = letters_only(spelling)
    proper = F.concat(F.upper(F.left(letters, F.lit(1))), F.substring(letters, F.lit(2), F.length(letters)))
    return F.when(F.length(letters) <= 3, F.upper(letters)).otherwise(proper)


def spelled_out(spelling: Column) -> Column:
    parts = F.filter(F.split(F.upper(spelling), "-"), lambda part: part != "")
    return F.array_join(parts, " ")


def pronunciation(text: Column, spelling: Column) -> Column:
    """What follows "pronounced" or "pronunciation", else the letters of the spelling."""
    said = F.lit("")
    for pattern in reversed(PRONUNCIATION_PATTERNS):
        rule = ANY_CASE + pattern
        said = F.when(text.rlike(rule), strip(F.regexp_extract(text, rule, 1))).otherwise(said)
    return F.when(said != "", said).otherwise(spelled_out(spelling))


def merge_texts(first: Column, second: Column) -> Column:
    """Both texts with squeezed spaces; the second is left out when it is empty or equal."""
    parts = F.array(squeeze(F.coalesce(first, F.lit(""))), squeeze(F.coalesce(second, F.lit(""))))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " ")


def with_intro_details(df: DataFrame, transcript: str, name: str, context: str) -> DataFrame:
    """Adds location, name_spelling, spelling_note, pronunciation, display_name and name_heard."""
    spelled, letters, base = F.col("name_spelling"), F.col("_letters"), F.col(name)
    notes = F.array_join(clarification_notes(letters), "; ")
    clarified = F.size(letters) > 0
    return (
        df.withColumn("_text", merge_texts(F.col(transcript), F.col(context)))
        .withColumns({
            "location": location(F.col("_text")),
            "_spellings": letter_spellings(F.col("_text")),
            "_letters": clarified_letters(F.col("_text")),
        })
        .withColumn("_related", best_spelling(F.col("_spellings"), base))
        .withColumn("_borrowed", (F.col("_related") == "") & (F.size("_spellings") > 0))
        .withColumn(
            "name_spelling",
            clarify_spelling(
                F.when(F.col("_borrowed"), F.try_element_at("_spellings", F.lit(-1))).otherwise(F.col("_related")),
                letters,
            ),
        )
        .withColumn("_by_letter", clarify_name(base, letters))
        .withColumn(
            "display_name",
            F.when((spelled != "") & spelling_replaces_name(spelled, base), name_from_spelling(spelled))
            .when(clarified, F.col("_by_letter"))
            .otherwise(base),
        )
        .withColumns({
            "spelling_note": F.concat_ws(
                "; ",
                F.when(F.col("_borrowed"), F.lit(OTHER_NAME_NOTE)),
                F.when(clarified & (F.col("_by_letter") == F.col("display_name")), notes),
            ),
            "pronunciation": pronunciation(F.col("_text"), spelled),
            "name_heard": F.when(F.col("display_name") != base, base),
        })
        .drop("_text", "_spellings", "_letters", "_related", "_borrowed", "_by_letter")
    )
