"""Queries of the language-model problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.pages import close_spans, merge_spans, page_spans
from sheaf.functions.paths import base_name
from sheaf.llm import abuse, packing, splitting, tokens
from sheaf.session import cut, spread
from sheaf.sources.tables import table

PAGE_LIMIT, PAGE_OVERLAP = 12, 1
CAPACITY = 2048


def _oversized(spark: SparkSession, root: str) -> DataFrame:
    """(frag_id, spans, outline) of fragments whose spans add up to more than ``PAGE_LIMIT`` pages, overlaps not yet taken off; copies count once."""
    frags = (
        table(spark, root, "fragments").where(F.col("frag_id").isNotNull() & F.col("pdf_pages").isNotNull())
        .select("frag_id", "pdf_file", page_spans(F.col("pdf_pages")).alias("spans"))
        # Open ends must wait for the PDF's last page; all else is decided before the join.
        .where(F.exists("spans", lambda s: s["hi"].isNull()) | (F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"] + 1) > PAGE_LIMIT))
        .groupBy("frag_id").agg(F.min_by(F.struct("pdf_file", "spans"), F.struct("pdf_file", "spans")).alias("f"))
        .select("frag_id", "f.*")
    )
    probes = (
        table(spark, root, "probe").select(base_name(F.col("pdf")).alias("pdf_file"), "pages", "outline", "probed_at")
        .groupBy("pdf_file")
        .agg(F.max("pages").alias("last_page"), F.max_by(F.when(F.size("outline") > 0, F.col("outline")), F.when(F.size("outline") > 0, F.col("probed_at"))).alias("outline"))
    )
    # Whether a fragment is cut is up to the splitter.
    return frags.join(probes, "pdf_file", "left").select("frag_id", merge_spans(close_spans(F.col("spans"), F.col("last_page"))).alias("spans"), "outline")


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of at most 12 pages, one page shared, of every fragment that names more."""
    return splitting.split_items(_oversized(spark, root), "frag_id", "spans", "outline", PAGE_LIMIT, PAGE_OVERLAP).where("n_pieces > 1")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Fragments that were cut."""
    return p3_pieces(spark, root).where("piece = 1").select("frag_id")


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(spread(table(spark, root, "documents").select("doc_id", "text")))


def p6_counts(spark: SparkSession, root: str) -> DataFrame:
    """Documents and tokens per source."""
    d = table(spark, root, "documents")
    return tokens.count(d.select(F.struct("doc_id", "source").alias("k"), "text"), "k").groupBy("k.source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    """Container, place and offset of every document, or of its pieces if it exceeds a container."""
    return packing.pack(cut(tokens.count(spread(table(spark, root, "documents").select("doc_id", "text")))), "doc_id", "n_tokens", CAPACITY)


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers used and the share of their space left unused."""
    return packing.fill_report(p7_packed(spark, root), CAPACITY)


#: Bound of the sample of rated documents the network is fitted on.
RATED_DOCUMENTS = 8000
ABUSE_THRESHOLD = 0.5


def _scored(spark: SparkSession, root: str, keep: list[str]) -> DataFrame:
    docs = table(spark, root, "documents")
    net = abuse.train(docs, table(spark, root, "abuse_label"), RATED_DOCUMENTS)
    return abuse.score(spread(docs.select(*keep, "text")), net, keep)


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    """Score of every document."""
    return _scored(spark, root, ["doc_id"])


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return _scored(spark, root, ["doc_id"]).where(F.col("score") >= ABUSE_THRESHOLD).select("doc_id").distinct()


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    """Documents and rate of flagged ones per source."""
    return abuse.rates(_scored(spark, root, ["source"]), "source", ABUSE_THRESHOLD)


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p6_ids, p6_counts, p7_packed, p7_fill, p8_found, p8_scores, p8_rates)}
SQL: dict[str, str] = {
    "p3_found": r"""WITH last AS (SELECT regexp_extract(pdf, '([^/]*)$', 1) AS pdf_file, max(pages) AS last_page FROM probe GROUP BY ALL
), m AS (SELECT frag_id, last_page, unnest(regexp_extract_all(pdf_pages, '(\d+)(?:\s*(?:-|–|—|−|\.\.|to)\s*(\d+|end))?')) AS m
  FROM (SELECT DISTINCT frag_id, pdf_file, pdf_pages FROM fragments) LEFT JOIN last USING (pdf_file)
), s AS (SELECT frag_id, last_page, regexp_extract(m, '^(\d+)', 1)::INT AS a, regexp_extract(m, '(\d+|end)$', 1) AS z FROM m
), c AS (SELECT frag_id, a, CASE WHEN z = 'end' THEN greatest(a, coalesce(last_page, a)) ELSE z::INT END AS z FROM s
), p AS (SELECT frag_id, unnest(generate_series(least(a, z), greatest(a, z))) AS page FROM c)
SELECT frag_id FROM p GROUP BY frag_id HAVING count(DISTINCT page) > 12""",
}
