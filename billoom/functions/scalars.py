"""Normalising scalars as Column expressions; no Python runs per row. A null text counts as an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "nothing there", alone or before a space or an opening bracket.
PLACEHOLDERS = ["n/a", "na", "none", "null", "nil", "unknown", "unbekannt", "not available", "nicht verfügbar", "illegible", "unleserlich", "unreadable", "not visible", "keine angabe", "no data"]
# A line with one of these words may hold the date of issue.
DATE_LABELS = ["datum", "date", "rechnungsdatum", "belegdatum", "ausgestellt", "invoice date", "dated"]
#: What a one-line field keeps.
LINE_LENGTH = 160


def text_of(text: Column) -> Column:
    """A null as ''."""
    return F.coalesce(text, F.lit(""))


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+$", "")


def is_placeholder(text: Column) -> Column:
    """Whether a text stands for nothing: empty, only dashes, question marks or stops, or one of PLACEHOLDERS (also before a space or bracket)."""
    return F.lower(trim(text_of(text))).rlike(r"^(?:\z|[-–—?.]+$|(?:" + "|".join(PLACEHOLDERS) + r")(?:$|[ (]))")


def cleaned(text: Column) -> Column:
    """Trimmed; '' for a placeholder."""
    return F.when(text_of(text) == "", "").when(is_placeholder(text), "").otherwise(trim(text))


def single_line(text: Column, limit: int = LINE_LENGTH) -> Column:
    """Runs of white space as one space; longer texts are cut and end in '...'."""
    line = trim(F.regexp_replace(text_of(text), r"[\s\p{Z}]+", " "))
    return F.when(F.length(line) > limit, F.concat(trim(F.substring(line, 1, limit)), F.lit("..."))).otherwise(line)


def amount_characters(text: Column) -> Column:
    """Of a text what may belong to an amount: digits, separators and a leading minus."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{Nd}.,\-]", ""), r"(?<=.)-", "")


def amount_of(kept: Column) -> Column:
    """amount_characters() as DOUBLE. Which separator is the decimal one shows in their order and in what follows the last."""
    comma, dot = F.instr(kept, ",") > 0, F.instr(kept, ".") > 0
    last = lambda c: F.length(kept) - F.instr(F.reverse(kept), c)
    german = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    anglo = F.replace(kept, F.lit(","), F.lit(""))
    commas = F.when(kept.rlike(r",[^,]{1,2}$"), F.replace(kept, F.lit(","), F.lit("."))).otherwise(anglo)
    bare = F.replace(kept, F.lit("."), F.lit(""))
    dots = F.when(kept.rlike(r"\..*\."), bare).when(kept.rlike(r"^[^.]{1,3}\.[^.]{3}$") & ~kept.rlike(r"^0\."), bare).otherwise(kept)
    ready = F.when(comma & dot, F.when(last(",") > last("."), german).otherwise(anglo)).when(comma, commas).when(dot, dots).otherwise(kept)
    # No more characters than a double has places before the point: what is longer might be infinite.
    return F.when(~kept.isin("", "-") & (F.length(kept) <= 308), ready.try_cast("double"))


def parse_amount(text: Column) -> Column:
    """A tolerant amount as DOUBLE; null where there is none."""
    return F.when(~is_placeholder(text), amount_of(amount_characters(text)))


def amount_from_answer(answer: Column) -> Column:
    """The amount of an answer that holds exactly one number; null otherwise."""
    numbers = F.regexp_extract_all(text_of(answer), F.lit(r"-?[0-9][0-9.,']*"), F.lit(0))
    return F.when(F.size(numbers) == 1, parse_amount(F.get(numbers, F.lit(0))))


def build_date(year: Column, month: Column, day: Column) -> Column:
    """ISO text of the parts; '' where month or day are out of range. Two-digit years are of this century."""
    y, m, d = (c.try_cast("int") for c in (year, month, day))
    y = F.when(y < 100, y + 2000).otherwise(y)
    return F.when(m.between(1, 12) & d.between(1, 31), F.format_string("%04d-%02d-%02d", y, m, d)).otherwise("")


def first_date_in(text: Column) -> Column:
    """ISO text of the first date found, day first; '' where there is none. The first format that matches decides."""
    iso, german, run = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})[./](\d{1,2})[./](\d{2,4})", r"(?<![0-9A-Za-z_])(\d{4})(\d{2})(\d{2})(?![0-9A-Za-z_])"
    part = lambda p, k: F.regexp_extract(text, p, k)
    # What is such a date already needs no taking apart.
    found = F.when(text.rlike(r"\A(?:[1-9]\d|0[1-9])\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\z"), text)
    found = found.when(text.rlike(iso), build_date(part(iso, 1), part(iso, 2), part(iso, 3)))
    found = found.when(text.rlike(german), build_date(part(german, 3), part(german, 2), part(german, 1)))
    return found.when(text.rlike(run), build_date(part(run, 1), part(run, 2), part(run, 3))).otherwise("")


def normalise_date(text: Column) -> Column:
    """first_date_in(), but none in a placeholder."""
    return F.when(is_placeholder(text), "").otherwise(first_date_in(text))


def find_labelled_date(text: Column) -> Column:
    """The date of the first line that names a date label and holds one; '' where there is none."""
    labelled = F.filter(F.split(text_of(text), "\n"), lambda line: F.lower(line).rlike("|".join(DATE_LABELS)))
    return F.coalesce(F.get(F.filter(F.transform(labelled, first_date_in), lambda d: d != ""), F.lit(0)), F.lit(""))


def normalise_currency(text: Column) -> Column:
    """A three-letter code: signs and names first, then any word of three letters; '' where there is none or for a placeholder."""
    up = F.upper(text_of(text))
    has = lambda *s: F.greatest(*[F.instr(up, x) for x in s]) > 0 if len(s) > 1 else F.instr(up, s[0]) > 0
    other = F.regexp_extract(up, r"(?<![0-9A-Za-z_])([A-Z]{3})(?![0-9A-Za-z_])", 1)
    return F.when(text.isin("", "EUR", "GBP", "CHF", "USD"), text).when(is_placeholder(text), "").when(has("€", "EUR"), "EUR").when(has("£", "GBP"), "GBP").when(has("CHF"), "CHF").when(has("$", "USD"), "USD").otherwise(other)


def iban(text: Column) -> Column:
    """Without spaces; '' for a placeholder."""
    return F.replace(cleaned(text), F.lit(" "), F.lit(""))


def to_cents(amount: Column) -> Column:
    """BIGINT cents, half a cent away from zero; null for what no number of cents can hold (NaN, infinity, 1e300)."""
    return F.round(bill_amount(amount) * 100).try_cast("bigint")


def from_cents(cents: Column) -> Column:
    """The amount as DOUBLE."""
    return cents.cast("double") / 100


def bill_amount(amount: Column) -> Column:
    """NaN and infinity count as no amount."""
    return F.when(~F.isnan(amount) & (F.abs(amount) < float("inf")), amount)


def file_key(path: Column, file: Column) -> Column:
    """What tells a bill's file: its path, else its name, else ''."""
    return F.coalesce(F.nullif(path, F.lit("")), file, F.lit(""))


def fold_vendor(text: Column) -> Column:
    """Runs of letters and digits in lower case, joined by a space."""
    return F.lower(F.array_join(F.regexp_extract_all(text_of(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "))


def vendor_pattern(expected: Column) -> Column:
    """The pattern of an expectation /pattern/; '' for others."""
    return F.regexp_extract(expected, "^/(.*)/$", 1)


def compiles(pattern: Column) -> Column:
    """Whether a pattern is one: it is compiled once, and what that raises becomes false."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def vendor_matches(expected: Column, actual: Column, valid: Column | None = None) -> Column:
    """Whether a vendor is the expected one: equal once folded, or /pattern/ found in the folded name; '*' takes any.

    A pattern that is none matches nothing. valid: whether it is one, where that is known (see lists.compared), else it is tried row by row.
    """
    pattern = vendor_pattern(expected)
    found = F.when(compiles(pattern) if valid is None else valid, F.rlike(fold_vendor(actual), F.concat(F.lit("(?i)"), pattern))).otherwise(False)
    return F.when(expected == "*", True).when(pattern != "", found).otherwise(fold_vendor(expected) == fold_vendor(actual))


def fingerprint(model: Column, pages: Column, dpi: Column, long_edge: Column, min_short_edge: Column, threshold: Column, ocr: Column, languages: Column, prompt: int = 11) -> Column:
    """The first 16 hex digits of the SHA-256 of all settings that change an answer."""
    names = ("model", "pages", "dpi", "longEdge", "minShortEdge", "threshold", "ocr", "ocrLang")
    pairs = [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in zip(names, (model, pages, dpi, long_edge, min_short_edge, threshold, ocr, languages), strict=True)]
    return F.substring(F.sha2(F.concat_ws(";", *pairs, F.lit(f"prompt={prompt}")), 256), 1, 16)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """What follows the last stop of the file name, in lower case; '' without one."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def model_base(name: Column) -> Column:
    """A model's name without its tag."""
    return F.split(name, ":")[0]


def model_installed(wanted: Column, installed: Column) -> Column:
    """Whether a model is among the installed ones by whole name or by what precedes the tag."""
    return F.exists(installed, lambda m: (m == wanted) | (model_base(m) == model_base(wanted)))


def stored_count(answer: Column) -> Column:
    """A bare number; -1 for anything else (which never counts as an empty store)."""
    t = trim(text_of(answer))
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint")).otherwise(F.lit(-1))


def wiped(count: Column, shown: Column) -> Column:
    """Whether the bills shown are gone from the store."""
    return (count == 0) & (shown > 0)


def retryable(path: Column) -> Column:
    """A bill can be read again if its path is known."""
    return F.coalesce(F.length(path), F.lit(0)) > 0


def plausible(vendor: Column, gross: Column) -> Column:
    """A reading counts with a vendor and a total."""
    return (F.length(text_of(vendor)) > 0) & gross.isNotNull()


def legibility(from_text: Column, has_image: Column, width: Column, height: Column, least: int = 400) -> Column:
    """A warning for a raster page whose short edge is below ``least`` pixels; '' otherwise."""
    edge = F.least(width, height)
    warned = ~from_text & has_image & (edge > 0) & (edge < least)
    return F.when(warned, F.concat(F.lit("only "), edge.cast("string"), F.lit(" px across: values are unverified"))).otherwise("")


def zoom(width: Column, height: Column, dpi: float = 200.0, min_short_edge: int = 1000, max_pixels: int = 20_000_000) -> Column:
    """Magnification of a page (points): the resolution, raised for a narrow page, then limited by the pixel budget (each 0: not asked).

    A page with an edge of 0 or less (or null) has the resolution alone.
    """
    plain, page = F.lit(dpi / 72.0), (width > 0) & (height > 0)
    z = plain
    if min_short_edge > 0:
        z = F.greatest(z, F.lit(float(min_short_edge)) / F.when(page, F.least(width, height)))
    if max_pixels > 0:
        z = F.least(z, F.sqrt(F.lit(float(max_pixels)) / F.when(page, width * height)))
    return F.when(page, z).otherwise(plain)


def downscale(width: Column, height: Column, long_edge: int = 1600, min_short_edge: int = 0) -> Column:
    """struct(scale, width, height) of an image whose long edge is too long; the short edge stays legible; never magnified.

    An edge of 0 or less (or null) is no image: null.
    """
    image = (width > 0) & (height > 0)
    long, short = (F.when(image, f(width, height)).cast("double") for f in (F.greatest, F.least))
    s = F.when((F.lit(long_edge) > 0) & (long > long_edge), F.lit(float(long_edge)) / long).otherwise(1.0)
    if min_short_edge > 0:
        s = F.when((s < 1) & (short * s < min_short_edge), F.least(F.lit(float(min_short_edge)) / short, F.lit(1.0))).otherwise(s)
    s = F.when((s >= 0.999) | (s <= 0), 1.0).otherwise(s)
    edge = lambda x: F.when(s == 1, x.cast("bigint")).otherwise(F.greatest(F.lit(1), F.floor(x * s + 0.5)))
    return F.when(image, F.struct(s.alias("scale"), edge(width).alias("width"), edge(height).alias("height")))


def ocr_factor(width: Column, height: Column, target: int = 1400, most: float = 4.0) -> Column:
    """How far an image is magnified before recognition; 1 if hardly at all."""
    short = F.least(width, height).cast("double")
    f = F.least(F.lit(float(target)) / F.when(short > 0, short), F.lit(max(1.0, most)))
    return F.when((short > 0) & (short < target) & (f > 1.05), f).otherwise(1.0)


def clamped(dpi: float, pages: int, long_edge: int, psm: int, timeout: float, limit: int) -> dict[str, float]:
    """Settings within their bounds."""
    return {"dpi": max(30, dpi), "pages": max(1, pages), "long_edge": max(200, long_edge), "psm": min(13, max(0, psm)), "timeout": max(1, timeout), "limit": max(1, limit)}
