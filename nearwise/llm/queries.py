"""The registered queries of this subpackage: each operator over its whole table. Their SQL is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nearwise.llm import manifest, token_files
from nearwise.llm.decontaminate import find_contamination
from nearwise.llm.languages import fit_languages, held_out, identify_languages
from nearwise.llm.near_dups import near_duplicates
from nearwise.llm.oracles import ORACLES
from nearwise.llm.page_text import extract_main_text
from nearwise.llm.passages import repeated_passages
from nearwise.llm.pieces import piece_digests
from nearwise.llm.prefix_trie import conversation_trie, number_turns, share_openings
from nearwise.llm.quality import judge_quality
from nearwise.llm.secret_scan import find_secrets
from nearwise.llm.toxicity import fit_toxicity, grade_toxicity
from nearwise.llm.url_filter import Rule, canonical_url, host_of, judge_urls
from nearwise.session import fresh_path

URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
#: A host that has one of these words between its dots and hyphens is unwanted; its pages make up the list of URLs.
UNWANTED_HOSTS = r"(^|[.-])(adult|casino|pills|spam)([.-]|$)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, scanned where it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a benchmark window of ten words."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, span: n + span[1] - span[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files and sum up each document from the files read back."""
    path = fresh_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.summaries(token_files.read_segments(spark, path))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the windows of 35 words that start anywhere else."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of secrets in every document."""
    return find_secrets(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, their source spans, and the text decoded from them."""
    return piece_digests(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of two-word shingles are at least 0.8 similar."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severity of every document, by a model fitted on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return grade_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, table(spark, sf_dir, "labels"))).select("doc_id", "severity", "p_toxic", "toxic")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the log-likelihood ratio for every document."""
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by machines fitted on those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof of every document, and whether a text without its line breaks still proves."""
    docs = table(spark, sf_dir, "documents")
    text = F.replace("text", F.lit("\n"), F.lit(""))
    cut = manifest.row_digest(*(text if name == "text" else F.col(name) for name in manifest.FIELDS))
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(even & F.contains("text", F.lit("\n")), cut)  # any other leaf stays as it is
    made = manifest.build_manifest(docs, carry=F.struct("doc_id", tampered.alias("tampered")))
    folded = manifest.fold(F.coalesce("carried.tampered", "leaf"), F.col("siblings"))
    return manifest.prove(made).select(
        "carried.doc_id", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"),
        manifest.siblings_digest(F.col("siblings")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every beginning that conversations rebuilt on shared openings have, and what sharing it saves."""
    return conversation_trie(*share_openings(number_turns(table(spark, sf_dir, "conversations"))))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL; listed are the canonical URLs of pages on unwanted hosts."""
    pages = table(spark, sf_dir, "pages")
    unwanted = F.regexp_like(host_of(F.col("url")), F.lit(UNWANTED_HOSTS))
    return judge_urls(pages, pages.where(unwanted).select(canonical_url(F.col("url")).alias("canonical")), URL_RULES)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_files": op2_token_files,
    "op3_passages": op3_passages,
    "op4_page_text": op4_page_text,
    "op5_secrets": op5_secrets,
    "op6_pieces": op6_pieces,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_languages": op10_languages,
    "op11_manifest": op11_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_url_filter": op13_url_filter,
}
