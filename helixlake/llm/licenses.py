"""License scans by canonical digest.

Texts are brought to a canonical form: A-Z in lower case, copyright lines and list marks gone, runs of
punctuation and white space one break, equivalent spellings alike. Entire texts, and entire lines within
them, are hash-joined by their SHA-256 with the digests of known licences. All of it is DataFrame code.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm import common, license_texts

#: Spellings that count as the same word, without those that only differ in punctuation.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}
#: The spellings that are replaced, by first letter, so that a line is searched once for all of them.
_OTHER = " (" + "|".join(f"{a}({'|'.join(x[1:] for x in SPELLINGS if x[0] == a)})" for a in sorted({x[0] for x in SPELLINGS})) + ") "
MARKS = r"^[ \t]*(\(?[0-9a-z]{1,2}[.)]|[*•-])[ \t]+"
COPYRIGHT = r"^[ \t#*/;<!-]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved[. \t]*$)"
BREAKS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f“”‘’–—…•©]+"
#: Known texts up to this many are broadcast, 64 bytes each.
BROADCAST_KNOWN = 50_000


def spaced_line(line: Column) -> Column:
    """A line in canonical form but for its spellings; words are two spaces apart, so that every word has a space of its own on each side."""
    low = F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    kept = F.when(F.regexp_like(low, F.lit(COPYRIGHT)), F.lit("")).otherwise(F.regexp_replace(low, MARKS, ""))
    return F.concat(F.lit("  "), F.regexp_replace(kept, BREAKS, "  "), F.lit("  "))


def alike(spaced: Column) -> Column:
    """A spaced line with equivalent spellings made the same; few lines hold any."""
    out = spaced
    for other, word in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {word} "))
    return F.trim(F.when(F.regexp_like(spaced, F.lit(_OTHER)), out).otherwise(spaced))


def canonical_lines(text: Column) -> Column:
    """Canonical lines with their numbers, empty ones left out."""
    spaced = F.transform(F.split(text, "\n"), spaced_line)
    lines = F.transform(spaced, lambda x, i: F.struct(i.alias("line_no"), alike(x).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license) of a (license, text) table; of two licences with the same digest the first by name."""
    whole = F.array_join(F.transform(canonical_lines(F.col("text")), lambda x: x["line"]), "  ")
    return known.where("text IS NOT NULL AND license IS NOT NULL").select(digest(whole).alias("digest"), whole.alias("whole"), "license").where("whole <> ''").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, license, n_notices, notices), one row per document.

    ``license`` is that of the entire text or null, ``n_notices`` counts the lines that are known texts by
    themselves and ``notices`` joins their licences, each once, by commas (empty without any). Texts that
    are null or have no words have a null digest. Equal rows give equal rows; ids may be null or repeat; whole
    texts of any length are read. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    digests = known_digests(spark.createDataFrame(license_texts.KNOWN, "license string, text string") if known is None else known)
    if known is None:
        more = spark.createDataFrame(license_texts.DIGESTS, "license string, digest string").select("digest", "license")
        digests = digests.union(more).groupBy("digest").agg(F.min("license").alias("license"))
    digests = common.cut(digests)
    if digests.count() <= BROADCAST_KNOWN:
        digests = F.broadcast(digests)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    lines = base.select("doc_id", common.row_key("doc_id", "text").alias("row"), canonical_lines(F.col("text")).alias("lines"))
    whole = F.array_join(F.transform("lines", lambda x: x["line"]), "  ")
    made = lines.select("doc_id", "row", F.when(F.size("lines") > 0, digest(whole)).alias("digest"), F.transform("lines", lambda x: F.struct(x["line_no"].alias("line_no"), digest(x["line"]).alias("digest"))).alias("lines"))
    made = common.cut(made.join(digests, "digest", "left").select("doc_id", "row", "digest", "license", "lines"))
    each = made.select("row", F.explode("lines").alias("x")).select("row", "x.line_no", "x.digest").join(digests, "digest")
    found = each.groupBy("row").agg(F.count_distinct("line_no").alias("n_notices"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    return made.join(found, "row", "left").select("doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))
