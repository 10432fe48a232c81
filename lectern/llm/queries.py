"""Queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread
from ..session import table as whole
from . import boilerplate, confusables, consensus, encode, langid, mojibake, neardup, pack, residue, split

Query = Callable[[SparkSession, str], DataFrame]


#: Tables of texts, which Python works on.
TEXTS = ("policy_documents", "documents")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = whole(spark, d, name)
    return spread(df) if name in TEXTS else df


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_documents(table(spark, d, "policy_documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.large_paragraphs(_pieces(spark, d))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).drop("large_paras")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.row_pairs(*neardup.near_copies(table(spark, d, "policy_documents")))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = neardup.near_copies(table(spark, d, "policy_documents"))
    return neardup.groups(pairs, members).withColumnRenamed("id", "policy_doc_id")


def p3_stretches(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.infer(table(spark, d, "policy_documents"), fields=("text", "title"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.infer(table(spark, d, "policy_documents")).select("policy_doc_id").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """Texts and titles restored, a row a field."""
    docs = table(spark, d, "policy_documents")
    found = mojibake.infer(docs, fields=("text", "title"))
    each = [mojibake.repair(docs, found, text_col=c).withColumn("field", F.lit(c)) for c in ("text", "title")]
    return each[0].unionByName(each[1])


def _languages(spark: SparkSession, d: str, **how) -> DataFrame:
    return langid.detect(table(spark, d, "policy_documents"), table(spark, d, "language_labels"), **how)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(_languages(spark, d))


def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d)


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d, by_segment=True)


def p4_codings(spark: SparkSession, d: str) -> DataFrame:
    """Labels of coded_chunks against the language of the document the passage comes from; passages of no known document have no language."""
    spelled = table(spark, d, "language_labels").select(F.col("spelling").alias("language_declared"), F.col("lang").alias("declared"))
    docs = table(spark, d, "policy_documents").select("policy_doc_id", F.concat_ws("_", F.coalesce("institution_id", F.lit("")), F.substring(F.coalesce("sha256", F.lit("")), 1, 8)).alias("prefix"))
    # copies of a page share the prefix; the most certain of them speaks for all
    main = _languages(spark, d).where("main").join(docs, "policy_doc_id").groupBy("prefix").agg(F.max_by("lang", F.struct("confidence", "share", "policy_doc_id")).alias("lang"), F.max("confidence").alias("confidence"))
    chunks = table(spark, d, "coded_chunks").groupBy("chunk_id", "language_declared").agg(F.count(F.lit(1)).alias("n_codings"))
    chunks = chunks.withColumn("prefix", F.regexp_replace("chunk_id", "_[0-9]+$", "")).join(spelled, "language_declared", "left").join(main, "prefix", "left")
    return chunks.where("declared is null or lang is null or declared <> lang").select("chunk_id", "language_declared", "lang", "confidence", "n_codings")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(table(spark, d, "policy_documents"))


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_content(table(spark, d, "policy_documents"))


def p5_wrappers(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.host_wrappers(table(spark, d, "policy_documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.infer(table(spark, d, "coded_chunks"), least=3)[0].where("label <> 0").select("chunk_id", "dimension", "label")


def p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.infer(table(spark, d, "coded_chunks"))[0]


def p6_reliability(spark: SparkSession, d: str) -> DataFrame:
    return consensus.infer(table(spark, d, "coded_chunks"))[1]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.word_variants(table(spark, d, "policy_documents")).select("policy_doc_id").distinct()


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return confusables.skeleton_groups(confusables.word_variants(table(spark, d, "policy_documents")))


def p7_normalized(spark: SparkSession, d: str) -> DataFrame:
    return confusables.normalize(table(spark, d, "policy_documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_ids(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(table(spark, d, "documents"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return pack.packing_report(p9_containers(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents")).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return residue.score_records(docs, residue.fit(docs))


def queries() -> dict[str, Query]:
    names = [n for n in globals() if n[0] == "p" and n[1:2].isdigit()]

    def shipped(query: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return query(spark, d)

        return run

    return {n: shipped(globals()[n]) for n in names}


WIDE = r"\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": rf"""
            WITH lines AS (SELECT policy_doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM policy_documents WHERE text IS NOT NULL),
            solid AS (SELECT *, regexp_matches(line, '[^ \t\r\n\f]') AS s FROM lines),
            steps AS (SELECT *, CASE WHEN s AND NOT coalesce(lag(s) OVER (PARTITION BY policy_doc_id ORDER BY n), false) THEN 1 ELSE 0 END AS new FROM solid),
            numbered AS (SELECT *, sum(new) OVER (PARTITION BY policy_doc_id ORDER BY n) - 1 AS para_no FROM steps),
            paras AS (SELECT policy_doc_id, para_no, string_agg(line, chr(10) ORDER BY n) AS p FROM numbered WHERE s GROUP BY ALL),
            counted AS (SELECT policy_doc_id, para_no, length(regexp_replace(p, '[^{WIDE}]', '', 'g')) AS wide, length(regexp_replace(p, '[ \t\r\n\f]', '', 'g')) AS all_,
                len(regexp_extract_all(p, '[A-Za-z]+')) AS runs, len(regexp_extract_all(p, '[^ \t\r\n\f]+')) AS words FROM paras)
            SELECT policy_doc_id, CAST(para_no AS INTEGER) AS para_no FROM counted WHERE CASE WHEN 2 * wide > all_ THEN wide + runs ELSE words * 13 // 10 END > 750""",
        "p2_found": rf"""
            WITH t AS (SELECT policy_doc_id AS id, regexp_extract_all(regexp_replace(lower(text), '([{WIDE}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') AS w FROM policy_documents WHERE text IS NOT NULL),
            s AS (SELECT DISTINCT id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM t),
            n AS (SELECT id, count(*) AS n FROM s GROUP BY id HAVING count(*) >= 20),
            c AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
            SELECT c.a AS doc_a, c.b AS doc_b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE shared / (x.n + y.n - shared) >= 0.7""",
    }
