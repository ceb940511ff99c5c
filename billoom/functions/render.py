"""Bills and totals as text: money, coverage, labels, details, escapes. Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import base_name, text_of, trim

#: Fields of a bill that details() knows; others follow in order of name.
KNOWN = "file path bill bill_count status error quality_warning vendor vendor_address invoice_number date due_date currency net_total tax_total gross_total iban confidence has_text_layer from_cache extract_ms inference_ms notes".split()


def bare_money(amount: Column, decimal: str = ",", group: str = "") -> Column:
    """Two places with a locale's decimal sign and, if it has one, its sign between thousands."""
    text = F.format_string("%,.2f" if group else "%.2f", amount)
    if not group:
        # The same text at a part of the cost; what rounds to zero keeps its sign, and longer numbers all places, in the other way.
        text = F.when(F.abs(amount).between(0.01, 1e13), amount.cast("decimal(18,2)").cast("string")).otherwise(text)
    return F.when(amount.isNotNull(), F.translate(text, ",.", group + decimal) if group else F.replace(text, F.lit("."), F.lit(decimal)))


def money(amount: Column, currency: Column, decimal: str = ",", group: str = "") -> Column:
    """The amount and its code, without a trailing space where there is no code; null without an amount."""
    return F.when(text_of(currency) == "", bare_money(amount, decimal, group)).otherwise(F.concat(bare_money(amount, decimal, group), F.lit(" "), currency))


def joined_money(parts: Column, decimal: str = ",", group: str = "") -> Column:
    """array<struct<currency, cents>> in order, joined by ' + '; '' for none."""
    return F.array_join(F.transform(parts, lambda p: money(p["cents"].cast("double") / 100, p["currency"], decimal, group)), " + ")


def bare_amount(parts: Column, decimal: str = ",") -> Column:
    """The sum where there is exactly one currency; '' otherwise."""
    return F.when(F.size(parts) == 1, bare_money(F.get(parts, F.lit(0))["cents"].cast("double") / 100, decimal)).otherwise("")


def bill_count(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " bill").otherwise(" bills"))


def coverage(counted: Column, expected: Column, failed: Column, unamounted: Column, complete: Column) -> Column:
    """'3 bills', or '2 of 3 bills, 1 unread, 1 without an amount'."""
    gap = lambda n, text: F.when(n > 0, F.concat(F.lit(", "), n.cast("string"), F.lit(text))).otherwise("")
    partly = F.concat(counted.cast("string"), F.lit(" of "), bill_count(expected), gap(failed, " unread"), gap(unamounted, " without an amount"))
    return F.when(complete, bill_count(counted)).otherwise(partly)


def coverage_note(counted: Column, expected: Column, failed: Column, complete: Column) -> Column:
    """The same in the widget's words: '3 Belege', or '2 von 3 Belegen, 1 nicht gelesen'."""
    whole = F.concat(counted.cast("string"), F.when(counted == 1, " Beleg").otherwise(" Belege"))
    partly = F.concat(counted.cast("string"), F.lit(" von "), expected.cast("string"), F.lit(" Belegen"), F.when(failed > 0, F.concat(F.lit(", "), failed.cast("string"), F.lit(" nicht gelesen"))).otherwise(""))
    return F.when(complete, whole).otherwise(partly)


def zoom_notes(width: Column, height: Column, dpi: float = 200.0, min_short_edge: int = 1000, max_pixels: int = 20_000_000) -> Column:
    """array<string>: what changed a page's resolution, in order, each note once."""
    page, base = (width > 0) & (height > 0), F.lit(dpi / 72.0)
    short = F.when(page, F.least(width, height))
    wanted, cap = F.lit(float(min_short_edge)) / short, F.sqrt(F.lit(float(max_pixels)) / F.when(page, width * height))
    raised = F.when(wanted > base, F.concat(F.lit("resolution raised to "), F.format_string("%.0f", F.round(wanted * 72)), F.lit(" dpi for a "), F.format_string("%.0f", F.round(short * 25.4 / 72)), F.lit(" mm narrow page")))
    limited = F.when(F.greatest(base, wanted) > cap, F.concat(F.lit("resolution limited to "), F.format_string("%.0f", F.round(cap * 72)), F.lit(" dpi by the pixel budget")))
    return F.array_distinct(F.array_compact(F.array(raised, limited)))


def sum_line(path: Column, parts: Column, covered: Column) -> Column:
    """'name  sum  total  (coverage)'."""
    return F.concat(base_name(path), F.lit("  sum  "), joined_money(parts), F.lit("  ("), covered, F.lit(")"))


def label(path: Column, page: Column, pages: Column) -> Column:
    """The file's name, with the page where there are several."""
    return F.when(pages > 1, F.concat_ws(":", base_name(path), page.cast("string"))).otherwise(base_name(path))


def place(file: Column, page: Column, pages: Column) -> Column:
    """'name' or 'name, S. 2'."""
    name = text_of(file)
    return F.when(F.coalesce(pages, F.lit(1)) > 1, F.concat(name, F.lit(", S. "), F.coalesce(page, F.lit(1)).cast("string"))).otherwise(name)


def or_else(text: Column, other: str) -> Column:
    return F.when(text_of(text) == "", other).otherwise(text)


def summary(vendor: Column, date: Column, gross: Column, currency: Column) -> Column:
    """'shop, date, amount' with '?' for what is missing."""
    amount = F.when(gross.isNull(), "?").otherwise(F.concat(bare_money(gross), F.lit(" "), text_of(currency)))
    return F.concat_ws(", ", or_else(vendor, "?"), or_else(date, "?"), amount)


def analysis_line(label_: Column, vendor: Column, date: Column, gross: Column, currency: Column) -> Column:
    """'label  vendor  date  amount' with '-' for what is missing."""
    amount = F.when(gross.isNull(), "-").otherwise(F.concat(bare_money(gross), F.lit(" "), text_of(currency)))
    return F.concat_ws("  ", label_, or_else(vendor, "-"), or_else(date, "-"), amount)


def history_line(created: Column, vendor: Column, date: Column, gross: Column, currency: Column, page: Column, file: Column) -> Column:
    """A line of the history: time to the minute, vendor, date and amount in columns, page and file."""
    amount = F.when(gross.isNull(), "-").otherwise(F.concat(bare_money(gross), F.lit(" "), text_of(currency)))
    wide = F.when(F.length(amount) < 12, F.lpad(amount, 12, " ")).otherwise(amount)
    return F.concat_ws("  ", F.replace(F.substring(created, 1, 16), F.lit("T"), F.lit(" ")), F.rpad(text_of(vendor), 20, " "), F.rpad(text_of(date), 10, " "), wide, F.concat(F.lit("p"), page.cast("string"), F.lit(" "), file))


def escape_html(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def file_url(path: Column) -> Column:
    """file:// and the path with each segment percent-encoded; '' for no path."""
    encoded = F.url_encode(path)
    # Form encoding, but for what URI components leave as it is.
    for code, sign in (("+", "%20"), ("%2F", "/"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(sign))
    return F.when(text_of(path) == "", "").otherwise(F.concat(F.lit("file://"), encoded))


def dropped_path(url: Column) -> Column:
    """The path of a dropped file:// URL; other texts as they are."""
    return F.when(url.startswith("file://"), F.url_decode(F.replace(F.substring(url, 8, 1 << 20), F.lit("+"), F.lit("%2B")))).otherwise(url)


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def first_line(text: Column) -> Column:
    return trim(F.split(trim(text_of(text)), "\n")[0])


def _known(bill: dict[str, Column]) -> list[tuple[int, bool, Column]]:
    """Group, whether it is strong, and text of each line of KNOWN; null for what is absent or empty."""
    null = F.lit(None).cast("string")
    of = lambda k: bill.get(k, null)
    text = lambda k: of(k).cast("string")
    yes = lambda k: F.when(of(k).cast("boolean"), "ja").when(of(k).isNotNull(), "nein")
    ms = lambda k: F.concat(text(k), F.lit(" ms"))
    cash = lambda k: money(of(k).cast("double"), text("currency"))
    path = F.when((text_of(text("path")) != "") & ~text("path").eqNullSafe(text("file")), text("path"))
    rows = [
        (0, "Datei", place(text("file"), of("bill").cast("int"), of("bill_count").cast("int")), False), (0, "Pfad", path, False), (0, "Status", text("status"), False), (0, "Fehler", text("error"), False), (0, "Hinweis", text("quality_warning"), False),
        (1, "Aussteller", text("vendor"), False), (1, "Adresse", text("vendor_address"), False), (1, "Rechnungsnummer", text("invoice_number"), False), (1, "Datum", text("date"), True), (1, "Fällig", text("due_date"), False),
        (1, "Netto", cash("net_total"), False), (1, "Steuer", cash("tax_total"), False), (1, "Betrag", cash("gross_total"), True),
        (2, "IBAN", text("iban"), False), (2, "Konfidenz", text("confidence"), False), (2, "Textlayer", yes("has_text_layer"), False), (2, "Aus dem Cache", yes("from_cache"), False), (2, "Extrahiert", ms("extract_ms"), False), (2, "Modell", ms("inference_ms"), False),
    ]
    return [(g, s, F.when(text_of(v) != "", F.concat(F.lit(f"{k}: "), v))) for g, k, v, s in rows]


def _noted(notes: Column) -> Column:
    """array<string>: the lines of a bill's notes."""
    return F.transform(F.coalesce(notes, F.array().cast("array<string>")), lambda n: F.concat(F.lit("Notiz: "), n))


def _unknown(extra: Column) -> Column:
    """array<string>: the lines of fields beyond KNOWN, in order."""
    unknown = F.filter(F.map_entries(F.coalesce(extra, F.create_map().cast("map<string,string>"))), lambda e: ~e["key"].isin(KNOWN) & (text_of(e["value"]) != ""))
    return F.array_sort(F.transform(unknown, lambda e: F.concat_ws(": ", e["key"], e["value"])))


def details(bill: dict[str, Column], extra: Column | None = None) -> Column:
    """array<struct<text, grp, strong>>: all that is known of a bill, line by line, in three groups; what is absent or empty is left out.

    bill: columns by field name (any may be missing); extra: map<string, string> of fields beyond KNOWN.
    """
    entry = lambda t, g, s: F.struct(t.alias("text"), F.lit(g).alias("grp"), F.lit(s).alias("strong"))
    out = F.filter(F.array(*[entry(t, g, s) for g, s, t in _known(bill)]), lambda e: e["text"].isNotNull())
    for lines in ([_noted(bill["notes"])] if "notes" in bill else []) + ([] if extra is None else [_unknown(extra)]):
        out = F.concat(out, F.transform(lines, lambda t: entry(t, 2, False)))
    return out


def with_details(rows: DataFrame, bill: dict[str, Column], extra: Column | None = None) -> DataFrame:
    """rows with text and html of details(): each line is made once and written into both, without an array of entries between. Columns of these names are replaced.

    A note that is null has no line, and no empty line before it either.
    """
    known = _known(bill)
    more = ([F.array_compact(_noted(bill["notes"]))] if "notes" in bill else []) + ([] if extra is None else [_unknown(extra)])
    lines = [f"_line{i}" for i in range(len(known))]
    rows = rows.withColumns(dict(zip(lines, [t for _, _, t in known], strict=True)) | {"_more": F.concat(F.array().cast("array<string>"), *more)})

    def written(sign: str, of: Callable[[Column, bool], Column], others: Column) -> Column:
        own = lambda g: [of(F.col(c), strong) for c, (grp, strong, _) in zip(lines, known, strict=True) if grp == g]
        return F.concat_ws(sign * 2, *[F.nullif(F.concat_ws(sign, *own(g), *([others] if g == 2 else [])), F.lit("")) for g in range(3)])

    marked = lambda t, strong: F.concat(F.lit("<b>"), escape_html(t), F.lit("</b>")) if strong else escape_html(t)
    text, html = written("\n", lambda t, _: t, F.col("_more")), written("<br>", marked, F.transform("_more", escape_html))
    return rows.withColumns({"text": text, "html": html}).drop(*lines, "_more")


def with_breaks(entries: Column) -> Column:
    """An empty entry between entries of different groups."""
    blank = lambda e: F.struct(F.lit("").alias("text"), e["grp"].alias("grp"), F.lit(False).alias("strong"))
    before = lambda i: F.get(entries, i - 1)["grp"]
    return F.flatten(F.transform(entries, lambda e, i: F.when((i > 0) & (before(i) != e["grp"]), F.array(blank(e), e)).otherwise(F.array(e))))


def details_text(entries: Column) -> Column:
    return F.array_join(F.transform(with_breaks(entries), lambda e: e["text"]), "\n")


def details_html(entries: Column) -> Column:
    """The same lines as markup, the strong ones in bold."""
    return F.array_join(F.transform(with_breaks(entries), lambda e: F.when(e["strong"], F.concat(F.lit("<b>"), escape_html(e["text"]), F.lit("</b>"))).otherwise(escape_html(e["text"]))), "<br>")
