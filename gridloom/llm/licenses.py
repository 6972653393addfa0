"""License scans: whole texts in canonical form, hash-joined to the digests of known licenses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small_or_salted, text_or_empty

#: How the bodies of short licenses begin. A notice may stand before one on the same line, so a line is broken here.
BODY = r"(permission\s+is\s+hereby\s+granted|permission\s+to\s+use,\s+copy|redistribution\s+and\s+use\s+in\s+source)"
#: Lines that only say who holds the rights: 'copyright' before (c), the sign or a year, (c) before a year, the sign, or
#: 'all rights reserved' alone. A line of a license's body may begin with 'copyright' or '(c)' too, by wrapping.
OWNER_LINE = r"(?m)^[ \t\r]*(?:[#*/;%-]+[ \t]*)?(?:(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|[\[{<]y)|\(c\)[ \t]*[0-9]{4}|©)[^\n]*|all rights reserved[ \t\r.!*/#-]*)$"
#: Titles over such bodies, between words two blanks.
TITLE = (
    "^(?:the )?(?:mit license(?: mit)?|mit no attribution(?: license)?|isc license(?: isc)?|bsd (?:zero|0|1|2|3) clause license|zero clause bsd(?: license)?"
    "|(?:new |modified |simplified |revised )?bsd license) (permission is hereby|permission to use|redistribution and use)"
).replace(" ", "  ")
#: Whole words that license matching holds to be equal, each to its second form, in this order.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "noncommercial": "non commercial",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "percent": "per cent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "sub licence": "sublicense",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, no lines that state an owner and no title, two blanks for each run of what is no letter or digit, words of
    equal spelling made one. So neither wrapping nor a notice in front changes a text's form; a notice in the midst of a long
    text needs a line of its own, since what follows it on its line goes with it."""
    owned = F.regexp_replace(F.regexp_replace(F.lower(text), BODY, "\n$1"), OWNER_LINE, "")
    plain = F.concat(F.lit("  "), F.regexp_replace(owned, NOT_WORD, "  "), F.lit("  "))
    return F.regexp_replace(F.trim(reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), replacements(), plain)), TITLE, "$1")


def replacements() -> list[tuple[str, str]]:
    """SPELLINGS between blanks; words have two between them, so that each has its own."""
    return [tuple(f" {x.replace(' ', '  ')} " for x in pair) for pair in SPELLINGS.items()]


def known_licenses(spark: SparkSession, texts: dict[str, str], digests: dict[str, str] | None = None) -> DataFrame:
    """license and digest for each of the given texts, and of longer ones by digest alone; of equal digests the first name stays."""
    rows = spark.createDataFrame(sorted(texts.items()), "license string, text string").select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    if digests:
        rows = rows.unionByName(spark.createDataFrame(sorted(digests.items()), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, canonical_sha256, license (null where the whole text is no known license).

    ``known`` has a row for each digest; its rows are counted, and it is broadcast only if they are few, else joined by
    shuffle with salts, since one text's copies can be a large part of all rows. Only digests move, never texts.

    Nulls: a null text is empty and matches nothing; a null doc_id stays. Texts of owner lines and punctuation only
    are empty in canonical form and match nothing either. Repeated rows are scanned each; other columns are ignored.
    """
    form = canonical(text_or_empty(text))
    digests = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(form, 256).alias("canonical_sha256"))
    empty = F.sha2(F.lit(""), 256)
    found = join_small_or_salted(digests, known.select(F.col("digest").alias("canonical_sha256"), "license"), "canonical_sha256", "left")
    return found.select("doc_id", "canonical_sha256", F.when(F.col("canonical_sha256") != empty, F.col("license")).alias("license"))
