"""License scans by canonical digests: whole texts are normalised, digested and hash-joined to the digests of known licences.

Normal form: no copyright lines, no title line of the known ones and no numbers of conditions, lower case, one spelling for
equivalent words, every run of other characters than letters and digits one space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .license_texts import all_texts

#: Spellings that count as the second of each pair, after the matching guidelines of licence lists.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright holder", "copyright owner"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("fulfilment", "fulfillment"), ("favour", "favor"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("https", "http")]

_COPYRIGHT = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|\x{a9})(?=[^\n]*(?:[0-9]{4}|\(c\)|\x{a9}|<year>|\[year\]))[^\n]*$|^[^\p{L}\p{N}\n]*all rights reserved\.?\s*$"
#: Copyright lines with neither year nor sign: a paragraph of one short line, or a line right before the terms.
_PLAIN = r"(?im)^[ \t]*copyright (?!notice|holder|owner|law|license|licence|and |or |interest|statement|disclaimer)[^\n]{1,100}$(?=\s*\z|[ \t]*\r?\n[ \t]*\r?\n|\s*\n\s*(?:permission (?:is|to)|redistribution and|this software is|all rights reserved))"
#: Numbers of list items, in the normal form: BSD and zlib conditions come with numbers, letters, bullets or none.
_MARKER = r" (?:[1-5]|[a-e]|i{1,3}|iv) (?=redistributions (?:of|in) |neither the names? of |all advertising materials |the origin of this |altered source versions |this notice may not )"
_TITLE = r"^ (?:the )?(?:mit|expat|isc|zlib|zlib libpng|bsd zero clause|zero clause bsd|(?:(?:new|modified|simplified|revised|[23] clause) )*bsd(?: (?:[23] clause|new|or|modified|simplified|revised))*) license (?:(?:mit|expat|isc|zlib|0bsd|bsd [23] clause) )?(?=permission|redistribution|this software)"


def canonical(text: Column) -> Column:
    """The normal form; null and empty texts give the empty string."""
    out = F.coalesce(text, F.lit(""))
    for pattern in (_COPYRIGHT, _PLAIN):
        out = F.regexp_replace(out, pattern, "")
    out = F.lower(out)
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for known, kept in SPELLINGS:
        out = F.replace(out, F.lit(known), F.lit(kept))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, " +", " "), _MARKER, " "), _TITLE, " ")
    return F.trim(out)


def licenses(docs: DataFrame, texts: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest (of the normal form) and license (id, or null) of every document.

    Null, empty and sign-only texts match nothing; of known texts with one normal form the first id counts; rows stay one
    to one, repeated ones too; an empty table gives no rows; other columns aren't read.  The known digests are as many as ``texts`` and are broadcast.
    """
    known = docs.sparkSession.createDataFrame([(i, name, body) for i, (name, body) in enumerate(list(texts.items()) if texts else all_texts())], "at int, license string, body string")
    known = known.groupBy(common.digest(canonical(F.col("body"))).alias("known")).agg(F.min_by("license", "at").alias("license"))
    found = docs.select(docs[key].alias("__key"), canonical(docs[text]).alias("__normal"))
    found = found.select("__key", F.when(F.col("__normal") != "", common.digest(F.col("__normal"))).alias("digest"))
    return found.join(F.broadcast(known), F.col("digest") == F.col("known"), "left").select(F.col("__key").alias(key), "digest", "license")
