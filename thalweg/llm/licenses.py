"""License scans by canonical digest, in DataFrame functions alone.

A whole text is brought to a canonical form: lower case, copyright lines dropped, equivalent spellings made one, every
run of signs and white space made one blank. Texts whose digest of that form equals a known licence's are that licence.
Every document's digest joins the digests of known texts by an equi-join; the known side holds a row for each licence
text given.

Null texts count as empty. The empty canonical form (no letters or digits) never matches. Null ids, repeated rows and
further columns change nothing: one row out for each row in. Known texts with one canonical form give the least name.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text

#: Spellings that count as one, as whole words of the canonical form.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"), ("centre", "center"), ("whilst", "while"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
)
#: Words after "copyright" or "(c)" that go on with a sentence, where a holder's name would stand.
SENTENCE = (
    "and any applies are as be but claims? disclaimer doctrines for from had has have holders? if in included includes including infringement information interests? is laws? lines? "
    "licen[cs]es? may must nor not notices? of on or owners? ownership permissions? protections? representations resulting rights? shall statements? status that the_library the_licen[cs]es? this to treaty under which will with without you"
).replace(" ", "|").replace("_", " +")
#: A line that only says who holds the copyright: a year or a sign and what follows, or a short name; never a sentence that a wrap begins with the word.
HOLDER_LINE = (
    r"(?m)^[^a-z0-9\n]*(?:portions )?(?:(?:copyright\b|\(c\)|©)[ \t:,]*(?:\(c\)|©)?[ \t:,]*(?:by[ \t]+)?[<\[{(]?(?:[0-9]{4}|year|yyyy)\b[^\n]{0,200}"
    r"|copyright[ \t:,]*(?:\(c\)|©)[^\n]{0,200}|©[^\n]{0,200}"
    rf"|(?:copyright|\(c\))[ \t:]+(?!(?:{SENTENCE})\b)[^\s]+(?:[ \t]+[^\s]+){{0,7}}[ \t]*|all rights reserved[^a-z0-9\n]*)$"
)
#: The same in the SQL, which drops every line that begins with the word.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|portions copyright|all rights reserved)[^\n]*$"
END = "END OF TERMS AND CONDITIONS"
NOT_WORD = r"[^\p{L}\p{N}]+"
WORD_SIGN = r"[\p{L}\p{N}]"


def canonical(text: Column) -> Column:
    """The text's canonical form. A copyright line is dropped only where other lines remain to judge by."""
    low = F.lower(F.regexp_replace(text, "\r\n?", "\n"))
    rest = F.regexp_replace(low, HOLDER_LINE, " ")
    judged = F.when(F.regexp_like(rest, F.lit(WORD_SIGN)), rest).otherwise(low)
    form = F.concat(F.lit(" "), F.trim(F.regexp_replace(judged, NOT_WORD, " ")), F.lit(" "))
    for other, one in SPELLINGS:
        form = F.replace(form, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(form)


def digest(form: Column) -> Column:
    return F.sha2(form, 256)


def known_texts(spark: SparkSession) -> DataFrame:
    """license and text of the built-in licences and notices; of long licences the files, whole and up to the end of their terms."""
    from .license_texts import TEXTS

    known = list(TEXTS)
    for file in sorted(resources.files(__package__).joinpath("full_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        known.append((name, text))
        if END in text:
            known.append((name, text[: text.index(END)]))
            known.append((name, text[: text.index(END) + len(END)]))
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known])))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the canonical text, and the license (null: none known) of each row."""
    known = known_texts(docs.sparkSession) if known is None else known
    names = known.select("license", canonical(F.coalesce("text", F.lit(""))).alias("form")).where("form <> ''").groupBy(digest(F.col("form")).alias("digest")).agg(F.min("license").alias("license"))
    own = id_and_text(docs).select("doc_id", canonical(F.col("text")).alias("form")).select("doc_id", F.when(F.col("form") != "", digest(F.col("form"))).alias("digest"))
    return own.join(names, "digest", "left").select("doc_id", "digest", "license")


def oracle_sql() -> str:
    """The scan of documents in DuckDB's SQL."""
    from .license_texts import TEXTS

    def form(text: str) -> str:
        low = f"lower(regexp_replace({text}, '\\r\\n?', chr(10), 'g'))"
        rest = f"regexp_replace({low}, '{COPYRIGHT_LINE}', ' ', 'g')"
        out = f"CASE WHEN regexp_matches({rest}, '{WORD_SIGN}') THEN {rest} ELSE {low} END"
        out = f"concat(' ', trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g')), ' ')"
        for other, one in SPELLINGS:
            out = f"replace({out}, ' {other} ', ' {one} ')"
        return f"trim({out})"

    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in TEXTS)
    return f"""
        WITH known(license, text) AS (VALUES {values}),
        names AS (SELECT sha256(form) AS digest, min(license) AS license FROM (SELECT license, {form("text")} AS form FROM known) WHERE form <> '' GROUP BY 1),
        own AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM (SELECT doc_id, {form("coalesce(text, '')")} AS form FROM documents))
        SELECT own.doc_id, own.digest, names.license FROM own LEFT JOIN names ON own.digest = names.digest
    """
