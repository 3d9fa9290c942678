"""Operator 6: cross-site boilerplate lines, by merged HyperLogLog sketches with exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from guardframe.llm.common import WORD, durable, table

#: Sites from which on a line is boilerplate; words from which on a line counts; log2 of a sketch's registers.
MIN_SITES, MIN_WORDS, LG_REGISTERS = 3, 5, 10
#: Half the width of the band around the threshold, in standard errors of the sketch, and in sites at least.
ERRORS, LEAST_BAND = 4, 2
#: Parts over which the places of one line are dealt.
SALTS = 32


def site_lines(docs: DataFrame) -> DataFrame:
    """(uid, pos, line, site) of every line of docs(uid, text, site) with at least MIN_WORDS words, trimmed of white space; uid tells rows apart."""
    lines = docs.select("uid", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return lines.where(F.regexp_count("line", F.lit(WORD)) >= MIN_WORDS)


def _key(line="line"):
    # the number comes first: a hash of several values chains them, so two that begin alike are one hash of 64 bits
    return F.xxhash64(F.lit(1), line), F.xxhash64(F.lit(2), line)


def _salt():
    return F.pmod(F.xxhash64("uid", "uh", "pos"), F.lit(SALTS)).cast("int")


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, sites, first): lines of lines(h1, h2, site, uid, uh, pos) on at least so many distinct sites.

    Each line's sites are sketched; sketches merge by aggregation, on the map side first.
    A line whose estimate is near the threshold gets its exact number of distinct sites.
    first is the least (uid, pos) that has the line.
    """
    spread = durable(
        lines.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_agg(F.coalesce("site", F.lit("")), LG_REGISTERS).alias("sketch"),
            F.count("*").alias("n"),
            F.min(F.struct("uid", "pos")).alias("first"),
        )
        .where("n > 1")
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    band = max(LEAST_BAND, ERRORS * 1.04 / 2 ** (LG_REGISTERS / 2) * min_sites)
    near = spread.where(F.abs(F.col("sites") - min_sites) <= band)
    salted = near.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    exact = (
        lines.withColumn("salt", _salt())
        .join(salted, ["h1", "h2", "salt"], "left_semi")
        .groupBy("h1", "h2", F.coalesce("site", F.lit("")).alias("site"))
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("sites"))
        .join(near.select("h1", "h2", "first"), ["h1", "h2"])
    )
    sure = spread.where(F.col("sites") > min_sites + band)
    both = exact.select("h1", "h2", "sites", "first").union(sure.select("h1", "h2", "sites", "first"))
    return both.where(F.col("sites") >= min_sites)


def line_dedup(
    docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", doc_id: str = "doc_id", report: bool = True
) -> DataFrame:
    """docs with cross-site boilerplate lines taken out of the text, and, to report, n_lines and n_removed.

    A line of at least MIN_WORDS words (trimmed, otherwise as it stands) that is on
    min_sites distinct sites or more is boilerplate. It stays where it comes first, in the
    row of the least id, and goes everywhere else; so no content is lost, and copies of a
    document give way to the first. Other lines, blank ones too, stay as they are. A null
    or empty text stays as it is. A null site is a site of its own, with the empty name. Rows
    that repeat an id, or have none, are told apart by their content. No row goes. Columns
    of docs that are named like the two numbers give way to them in a report.
    """
    # the hash orders rows of one id, so that reruns agree; equal rows are in effect the same row
    place = F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(text, site).alias("h"))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), place.alias("place"))
    lines = site_lines(keyed.select(F.col("place").alias("uid"), F.col(f"doc.{text}").alias("text"), F.col(f"doc.{site}").alias("site")))
    h1, h2 = _key()
    lines = durable(lines.select("uid", "pos", "site", h1.alias("h1"), h2.alias("h2")))
    lines = lines.select(F.col("uid.id").alias("uid"), F.col("uid.h").alias("uh"), "pos", "site", "h1", "h2")
    flagged = boilerplate_lines(lines, min_sites)
    salted = flagged.select("h1", "h2", F.col("first.uid").alias("fu"), F.col("first.pos").alias("fp"),
                            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = (
        lines.withColumn("salt", _salt())
        .join(salted, ["h1", "h2", "salt"])
        .where("uid <> fu or pos <> fp")
        .groupBy("uid", "uh")
        .agg(F.collect_set("pos").alias("gone"))
        .select(F.struct(F.col("uid").alias("id"), F.col("uh").alias("h")).alias("place"), "gone")
    )
    old = F.col(f"doc.{text}")
    parts = F.split(old, "\n")
    kept = F.array_join(F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull()), "\n")
    out = keyed.join(gone, "place", "left")
    names = [c for c in docs.columns if not report or c not in ("n_lines", "n_removed")]
    columns = [(F.when(F.col("gone").isNull(), old).otherwise(kept) if c == text else F.col(f"doc.{c}")).alias(c) for c in names]
    if report:
        columns.append(F.when(old == "", 0).otherwise(F.coalesce(F.size(parts), F.lit(0))).cast("long").alias("n_lines"))
        columns.append(F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    return out.select(*columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of lines, of lines taken out, and the digest of what is left."""
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5")
    )


OP6_SQL = f"""
WITH parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
lines AS (SELECT *, regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line FROM parts),
counted AS (SELECT * FROM lines WHERE len(regexp_extract_all(line, '{WORD}')) >= {MIN_WORDS}),
spread AS (SELECT line, min((doc_id, pos)) AS first FROM counted GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= {MIN_SITES}),
judged AS (SELECT l.doc_id, l.pos, l.raw, c.line IS NOT NULL AND s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone
  FROM lines l LEFT JOIN counted c ON c.doc_id = l.doc_id AND c.pos = l.pos LEFT JOIN spread s ON s.line = c.line),
texts AS (SELECT doc_id, sum(gone::INT) AS n_removed, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  coalesce(t.n_removed, 0)::BIGINT AS n_removed, md5(coalesce(t.kept, '')) AS text_md5
FROM documents d LEFT JOIN texts t USING (doc_id)
"""
