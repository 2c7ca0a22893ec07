"""Fill-in-middle transformation by markers injected into the text; column expressions only.

A delimiter that can't occur is made by escaping: ``ESCAPE`` and ``DELIMITER`` in the text become
``ESCAPE`` and a code.  ``regexp_replace`` then appends the delimiter after each unit (a run of letters
A-Z and a-z, any other code point, or an escaped one), so the delimiters count the units, and
``substring_index`` cuts prefix, middle and suffix at ranked delimiters.  Parts lose their delimiters and
escapes again and are put together in one of three forms: ``plain`` (the text), ``psm`` (prefix, suffix, middle)
or ``spm`` (suffix, prefix, middle), each part behind its marker.

Where a document is cut and its form follow from a digest of seed and ``doc_id`` alone: reruns agree, and equal texts with
different ids are cut differently.  Texts that hold a marker stay plain, so an output is always taken
apart again without doubt: a marker's first character is none of its others, hence no occurrence can
begin in a part and end in a marker.

Defined results.  Null texts count as empty ones; these stay plain, with no units.  A null ``doc_id`` counts as an empty number.
A text may be as long as Spark's strings: it grows by up to one byte a unit while it is cut.  Repeated rows give equal
rows, ties do not occur, an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
DELIMITER, ESCAPE = "\x01", "\x02"
#: What follows ``ESCAPE`` for a delimiter and for an escape of the text; no letters.
WAS_DELIMITER, WAS_ESCAPE = "\x03", "\x04"
UNIT = f"[A-Za-z]++|{ESCAPE}[{WAS_DELIMITER}{WAS_ESCAPE}]|[^A-Za-z]"


def escaped(text: Column) -> Column:
    """The text without ``DELIMITER``."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + WAS_ESCAPE))
    return F.replace(text, F.lit(DELIMITER), F.lit(ESCAPE + WAS_DELIMITER))


def plain(part: Column) -> Column:
    """A part as the text had it: without the delimiters put in, and unescaped."""
    part = F.replace(part, F.lit(DELIMITER), F.lit(""))
    part = F.replace(part, F.lit(ESCAPE + WAS_DELIMITER), F.lit(DELIMITER))
    return F.replace(part, F.lit(ESCAPE + WAS_ESCAPE), F.lit(ESCAPE))


def _cut(text: Column, at: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(DELIMITER), at.cast("int"))


def _number(digest: str, group: int) -> Column:
    """The ``group``-th 8 hex digits as an unsigned number."""
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Per document ``doc_id, n, form, prefix, middle, suffix, output``; the parts are null where the form is plain.

    ``plain_percent`` of texts stay plain besides those that must; ``spm_percent`` of the others put the suffix first.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", text.alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256).alias("digest"),
        F.regexp_replace(escaped(text), UNIT, "$0" + DELIMITER).alias("marked"),
    )
    rows = rows.withColumn("n", F.length("marked").cast("long") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit(""))))
    one, two = (F.pmod(_number("digest", g), F.col("n") + 1) for g in (1, 2))
    held = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when(held | (_number("digest", 3) % 100 >= 100 - plain_percent), "plain").when(_number("digest", 4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "marked", "n", F.least(one, two).alias("low"), F.greatest(one, two).alias("high"), form.alias("form"))

    def part(cut: Column) -> Column:
        return F.when(F.col("form") != "plain", plain(cut))

    marked = F.col("marked")
    rows = rows.select(
        "doc_id", "n", "form", "text",
        part(_cut(marked, F.col("low"))).alias("prefix"),
        part(_cut(_cut(marked, F.col("high")), F.col("low") - F.col("high"))).alias("middle"),
        # One more delimiter than units follow, as the last unit has one behind it too.
        part(_cut(marked, F.col("high") - F.col("n") - 1)).alias("suffix"),
    )
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    )
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone."""

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), then, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .otherwise(F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit FROM documents),
numbered AS (
  SELECT doc_id, text, unit, len(unit) AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2, ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4 FROM units),
formed AS (
  SELECT doc_id, text, unit, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbered),
parted AS (
  SELECT doc_id, text, n, form, array_to_string(unit[1:low], '') AS prefix, array_to_string(unit[low + 1:high], '') AS middle, array_to_string(unit[high + 1:n], '') AS suffix FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parted
"""
