"""String, JSON and record functions of the workbench as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixlake.sources import constants as k


def label(x: Column, fallback: str) -> Column:
    """Trimmed; blank gives the fallback."""
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(fallback))


def node_id(x: Column) -> Column:
    """Lower case, anything but letters, digits and underscores as an underscore, 64 characters."""
    return F.substring(F.regexp_replace(F.lower(x), "[^a-z0-9_]", "_"), 1, 64)


def normalise(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def clean_prompt(x: Column, most: int) -> Column:
    """(text, truncated): without NUL, line ends as LF, at most ``most`` characters."""
    t = F.replace(F.replace(F.replace(x, F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.struct(F.substring(t, 1, most).alias("text"), (F.length(t) > most).alias("truncated"))


def truncated(x: Column, most: int) -> Column:
    """Cut with an ellipsis, blanks before it dropped."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…")))


def hits(x: Column, words: list[str]) -> Column:
    """The words found in x, in the list's order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))


def classify_domain(x: Column) -> Column:
    """(category, signals) of a query: off-domain, pathway, adjacent, workbench, else ambiguous; the first that has signals.

    Off-domain signals give way to pathway ones. A blank query is ambiguous. A question after a person or thing ("who is",
    "tell me about") without other signals is off-domain.
    """
    low = normalise(x)
    path, near, bench, off = (hits(low, w) for w in (k.PATHWAY_WORDS, k.ADJACENT_WORDS, k.WORKBENCH_WORDS, k.OFF_DOMAIN_WORDS))
    subject = F.regexp_extract(low, r"\b(who is|who's|tell me about|what do you know about)\s+([a-z][a-z .'-]{2,60})", 2)
    none = F.array().cast("array<string>")
    result = lambda c, s: F.struct(F.lit(c).alias("category"), s.alias("signals"))
    return (
        F.when(F.coalesce(F.trim(x), F.lit("")) == "", result("ambiguous", none))
        .when((F.size(off) > 0) & (F.size(path) == 0), result("off-domain", off))
        .when((subject != "") & (F.size(path) == 0) & (F.size(near) == 0), result("off-domain", F.array(F.concat(F.lit("who-is:"), F.substring(F.trim(subject), 1, 40)))))
        .when(F.size(path) > 0, result("scientific-pathway", path))
        .when(F.size(near) > 0, result("scientific-adjacent", near))
        .when(F.size(bench) > 0, result("workbench-ops", bench))
        .otherwise(result("ambiguous", none))
    )


def first_rule(x: Column, rules: list[tuple[list[str], str]], otherwise: str | None = None) -> Column:
    """The value of the first rule one of whose words x contains."""
    out = F.lit(otherwise).cast("string")
    for words, value in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(x, F.lit(w))
        out = F.when(hit, value).otherwise(out)
    return out


#: Ordered keyword rules of failures, of imaging methods and of the tool that a paper suggests.
ERROR_RULES = [(["429", "rate limit", "quota"], "rate-limited"), (["timeout", "timed out", "abort"], "timeout"), (["401", "403", "api key", "unauthor"], "not-authorised"), (["404", "not found"], "not-found"), (["json", "parse"], "unparsable"), (["network", "fetch"], "network")]
IMAGING_RULES = [(["confocal"], "confocal"), (["fluorescen", "gfp"], "fluorescence"), (["electron", "tem", "sem"], "electron"), (["phase contrast", "phase-contrast"], "phase-contrast"), (["bright"], "brightfield")]
ROUTE_RULES = [(["flux", "metabolic model", "fba"], "fbasim"), (["thermodynamic", "gibbs"], "cethx"), (["directed evolution", "mutagenesis"], "proevol"), (["crispr", "genome"], "genmim"), (["single-cell", "spatial"], "scspatial"), (["omics"], "multio"), (["cell-free"], "cellfree"), (["circuit", "oscillat"], "gecair"), (["enzyme", "catal"], "catdes")]


def salvage_json(raw: Column) -> Column:
    """(strategy, json, reason): direct, fenced, sliced or repaired, whichever parses first; without any, the reason says why.

    The text itself, without code fences, between the outer braces, or so after trailing commas are gone
    and single quotes are double. Reasons are empty, no-object and invalid-syntax.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    bare = strip(F.regexp_replace(F.regexp_replace(raw, r"(?i)```(?:json)?\s*", ""), r"```\s*", ""))
    fixed = F.replace(F.regexp_replace(raw, r",\s*([}\]])", "$1"), F.lit("'"), F.lit('"'))

    def slice_of(x: Column) -> Column:
        first, last = F.instr(x, "{"), F.length(x) - F.instr(F.reverse(x), "}") + 1
        return F.when((first > 0) & (last > first) & F.contains(x, F.lit("}")), F.substr(x, first, last - first + 1))

    ok = lambda t: F.try_parse_json(t).isNotNull()
    result = lambda s, t, c: F.struct(F.lit(s).cast("string").alias("strategy"), t.alias("json"), F.lit(c).cast("string").alias("reason"))
    null = F.lit(None).cast("string")
    return (
        F.when(F.coalesce(strip(raw), F.lit("")) == "", result(None, null, "empty"))
        .when(ok(raw), result("direct", raw, None)).when(ok(bare), result("fenced", bare, None)).when(ok(slice_of(raw)), result("sliced", slice_of(raw), None))
        .when(ok(slice_of(fixed)), result("repaired", slice_of(fixed), None)).when(slice_of(raw).isNull(), result(None, null, "no-object")).otherwise(result(None, null, "invalid-syntax"))
    )


def safe_metadata(m: Column, most: int = 8, longest: int = 160, dropped: tuple[str, ...] = ("raw", "prompt")) -> Column:
    """A map without the dropped keys, its first ``most`` entries, values truncated."""
    kept = F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*dropped))
    return F.map_from_entries(F.transform(F.slice(kept, 1, most), lambda e: F.struct(e["key"], truncated(e["value"], longest))))


def inverted_index_text(index: Column) -> Column:
    """Text of a map term -> positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("term")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["term"]), " ")


def abstract_xml(xml: Column) -> Column:
    return F.array_join(F.xpath(xml, F.lit("//AbstractText/text()")), " ")


def year_of(citation: Column) -> Column:
    return F.nullif(F.regexp_extract(citation, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def unique_strings(a: Column) -> Column:
    """Order-preserving, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != ""))


def well_name(index: Column, rows: int = 8) -> Column:
    """A1, B1, ... of a column-major plate, from 0."""
    return F.concat(F.chr(F.lit(65) + index % rows), (F.floor(index / rows) + 1).cast("string"))


def well_index(name: Column, rows: int = 8) -> Column:
    return (F.regexp_extract(name, r"^([A-Z])(\d+)$", 2).try_cast("int") - 1) * rows + F.ascii(F.substring(name, 1, 1)) - 65


def highlight(text: Column, pattern: Column) -> Column:
    """Matches of an alternation in <mark>."""
    return F.regexp_replace(text, F.concat(F.lit("(?i)("), pattern, F.lit(")")), F.lit("<mark>$1</mark>"))
