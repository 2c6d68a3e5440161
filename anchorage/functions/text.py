"""Text normalisation, comparison keys and grounding predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Look-alikes of one visible character.
DASHES = "‐‑‒–—−"
LOOK_ALIKE = (("$\\times$", "×"), ("\\times", "×"))
SINGLE_FROM, SINGLE_TO = DASHES + "˚º′´ʹ’‘″“”µ", "-" * len(DASHES) + "°°'''''" + '"""' + "μ"
SCRIPTS_FROM, SCRIPTS_TO = "⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉₊₋", "-+01234567890123456789+-"
#: Words that carry no meaning of their own.
STOP_WORDS = (
    "the a an of and or in on at to for by with from as is was were be been are this that these those each per its "
    "their into over under between within than then also after before during all any both"
).split()
MATH_PASSES = 8


def collapse(text: Column) -> Column:
    """White space of any script as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold_case(text: Column) -> Column:
    """Case folding: lower case with sharp s written out."""
    return F.lower(F.replace(F.replace(text, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss")))


def flatten_math(text: Column) -> Column:
    """Inline notation as plain text; groups unwrap from the inside, in at most MATH_PASSES rounds."""
    out = F.replace(F.replace(text, F.lit("\\pm"), F.lit("±")), F.lit("\\cdot"), F.lit("·"))
    for _ in range(MATH_PASSES):
        out = F.regexp_replace(out, r"\\(?:rm|it|bf|mathrm)\s+", "")
        out = F.regexp_replace(out, r"[\^_]\s*\{([^{} ]*) ?([^{} ]*) ?([^{}]*)\}", "$1$2$3")
        out = F.regexp_replace(out, r"\\(?:mathrm|mathit|mathbf|textrm|textit|text|rm|it|bf)\s*\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"(?<=[A-Za-z0-9)])[\^_]\s*(-?\d+)", "$1")
    out = F.regexp_replace(out, r"(?<=[A-Za-z0-9)])_(?=[A-Za-z0-9])", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[${}]", ""), "~", " ")
    return collapse(F.translate(out, SCRIPTS_FROM, SCRIPTS_TO))


def normalize_typography(text: Column) -> Column:
    """One spelling for look-alikes; notation is flattened only where there is any."""
    out = text
    for variant, plain in LOOK_ALIKE:
        out = F.replace(out, F.lit(variant), F.lit(plain))
    out = F.translate(out, SINGLE_FROM, SINGLE_TO)
    return F.when(out.rlike(r"[\\$~^_]"), flatten_math(out)).otherwise(F.translate(out, SCRIPTS_FROM, SCRIPTS_TO))


def canon(text: Column) -> Column:
    """The form in which texts are compared."""
    return normalize_typography(fold_case(collapse(text)))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


# ---- keys

def words_key(text: Column) -> Column:
    """Runs of a-z and 0-9 joined by blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def slug(text: Column, fallback: str = "candidate") -> Column:
    key = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit(fallback))


def joined_key(text: Column) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def singular(word: Column) -> Column:
    """A naive singular of a lower-case word."""
    return F.when(word.rlike("ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y")).when(word.rlike("[^su]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", "")).otherwise(word)


def name_key(text: Column) -> Column:
    """A factor's name: lower case, no punctuation, each word in the singular."""
    return F.array_join(F.transform(F.split(words_key(text), " "), singular), " ")


def units_key(text: Column) -> Column:
    """Units without separators, the micro sign as u."""
    return F.replace(F.regexp_replace(canon(F.coalesce(text, F.lit(""))), r"[\s.^()\[\]|*,;:_·×{}]+", ""), F.lit("μ"), F.lit("u"))


#: Words that tell nothing of a method by themselves.
GENERIC = (
    "the a an of and or in on at to for by with as is was were using used based method methods measurement "
    "measurements measured measure analysis described section hand value values see materials"
).split()


def significant_tokens(text: Column, least: int = 4) -> Column:
    """Words of at least ``least`` characters that are not generic."""
    return F.filter(F.split(words_key(text), " "), lambda w: (F.length(w) >= least) & ~w.isin(GENERIC))


def significant_words(text: Column) -> Column:
    """Words that are no stop word and have more than two letters or a digit."""
    found = F.regexp_extract_all(canon(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS) & ((F.length(w) > 2) | w.rlike("[0-9]")))


# ---- grounding

def supports_string(value: Column, text: Column) -> Column:
    """The value stands in the text, white space aside if need be; an empty value never does."""
    a, b = canon(value), canon(text)
    return F.when(value.isNull(), F.lit(True)).when(a == "", F.lit(False)).otherwise(F.contains(b, a) | F.contains(compact(b), compact(a)))


def supports_integer(value: Column, text: Column) -> Column:
    """The number stands in the text with no digit on either side."""
    return F.when(value.isNull(), F.lit(True)).otherwise(F.regexp_like(canon(text), F.concat(F.lit(r"(?<!\d)"), value.cast("string"), F.lit(r"(?!\d)"))))


def supports_double(value: Column, text: Column) -> Column:
    """In decimal spelling, or as a whole number where it is one."""
    plain = F.replace(value.cast("string"), F.lit("."), F.lit(r"\."))
    spelled = F.when(value == F.floor(value), F.concat(plain, F.lit("|"), value.cast("bigint").cast("string"))).otherwise(plain)
    return F.when(value.isNull(), F.lit(True)).otherwise(F.regexp_like(canon(text), F.concat(F.lit(r"(?<![\d.])(?:"), spelled, F.lit(r")(?![\d.])"))))


def supports_units(units: Column, text: Column) -> Column:
    """The units' key stands in the text's; one of fewer than three characters as a token of its own."""
    key, plain = units_key(units), compact(canon(units))
    body = F.regexp_replace(F.regexp_replace(plain, r"([^a-zμ°%0-9])", r"\\$1"), r"([a-zμ°%])(?=[-+\\0-9])", r"$1\\s*")
    symbol = ~plain.rlike("[a-z0-9]")
    whole = F.when(symbol, F.contains(canon(text), plain)).otherwise(F.regexp_like(canon(text), F.concat(F.when(plain.rlike("^[°%]"), F.lit("")).otherwise(F.lit("(?<![a-z0-9])")), body, F.lit("(?![a-z0-9])"))))
    return F.when(key == "", F.lit(True)).otherwise(F.contains(units_key(text), key) & ((F.length(key) >= 3) | whole))


def numbers_in(text: Column) -> Column:
    """All numbers, signed only where the dash does not follow a letter, digit or one of .)]% (blanks aside)."""
    found = F.regexp_extract_all(canon(text), F.lit(r"((?:(?<![a-z0-9.)\]%])(?<![a-z0-9.)\]%] )-)?\d+(?:,\d{3})*(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def two_stretches(text: Column, blocks: Column) -> Column:
    """The text's words are covered by at most two stretches that each stand word for word in one of the blocks."""
    words = F.regexp_extract_all(canon(text), F.lit("([a-z0-9]+)"), F.lit(1))
    padded = F.transform(blocks, lambda b: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(canon(b), F.lit("([a-z0-9]+)"), F.lit(1)), " "), F.lit(" ")))
    within = lambda part, held: F.exists(held, lambda b: F.contains(b, F.concat(F.lit(" "), F.array_join(part, " "), F.lit(" "))))
    n = F.size(words)
    split = F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: within(F.slice(words, F.lit(1), k), padded) & ((k >= n) | within(F.slice(words, k + 1, F.greatest(n - k, F.lit(0))), padded)))
    return (n > 0) & split


def segments_in_order(excerpt: Column, text: Column) -> Column:
    """Every stretch between ellipses stands in the text, in order: all as written, or all with white space taken out.

    A stretch of fewer than three letters or digits grounds nothing, and neither does the whole then.
    """
    parts = F.filter(F.transform(F.split(canon(excerpt), r"\.\.\.|…"), lambda p: F.trim(p)), lambda p: p != "")
    long = F.forall(parts, lambda p: F.length(F.regexp_replace(p, r"(?U)[^\p{L}\p{N}]", "")) >= 3)

    def in_order(stretches: Column, whole: Column) -> Column:
        return F.aggregate(stretches, F.lit(1), lambda at, p: F.when(at == 0, F.lit(0)).otherwise(_after(p, whole, at))) > 0

    plain = canon(text)
    return (F.size(parts) > 0) & long & (in_order(parts, plain) | in_order(F.transform(parts, compact), compact(plain)))


def _after(part: Column, text: Column, at: Column) -> Column:
    """Where the first sighting of the part from ``at`` on ends, 0 if there is none."""
    here = F.position(part, text, at)
    return F.when(here == 0, F.lit(0)).otherwise(here + F.length(part))


def near(a: Column, b: Column, most: int = 1) -> Column:
    """Edit distance of at most ``most``."""
    return F.levenshtein(a, b, most) >= 0
