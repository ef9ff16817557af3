"""A corpus pipeline over documents in five stages, each on all that its predecessor kept.

Quality rules reject documents; of each group of near-duplicates one stays; secrets in texts are replaced;
sources, languages and topics are sampled to target weights; what is left is encoded to token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortmill.llm.minhash import one_of_each
from cohortmill.llm.mixing import KEPT_SHARE, sampled_documents
from cohortmill.llm.pieces import encoded, public_model
from cohortmill.llm.quality import kept_documents
from cohortmill.llm.secrets import labelled_findings, redacted, train
from cohortmill.session import importable, table, written


#: Bytes of an Arrow batch between Spark and a Python worker: texts are long, and both sides hold whole batches.
BATCH_BYTES = 8 * 1024 * 1024
#: Words that a worker remembers: half of what the operators take on their own, as the stages before leave a full heap beside it.
REMEMBERED = 500_000


def _ready(spark: SparkSession) -> None:
    """The package on the workers, and Arrow batches of BATCH_BYTES where the session sets no size of its own."""
    importable(spark)
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size not in spark.conf.getAll:
        spark.conf.set(size, str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the fertility bands go. Null and empty texts fail; repeated rows are judged
    alike; null ids are judged but teach the bands nothing; an empty table stays empty."""
    _ready(spark)
    return kept_documents(docs, table(spark, sf_dir, "labels"), remembered=REMEMBERED)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id: five-word shingles,
    similarity from 0.8 on. Rows with a null id stay, as do texts without words; of repeated rows one stays."""
    _ready(spark)
    return one_of_each(docs, percent=80, bands=24)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets that the forest confirms are replaced in its text. Null and empty texts stay as
    they are; without documents to learn from nothing is replaced."""
    return redacted(docs, train(labelled_findings(docs)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The calibrated draw decides which documents stay: KEPT_SHARE of the tokens in expectation. Texts without tokens
    go; repeated rows share one draw; null categories are a category of their own."""
    return sampled_documents(docs, share=KEPT_SHARE)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document, besides its id, language and source. A null text has no tokens."""
    _ready(spark)
    return encoded(docs, public_model("piece_bpe_32k.model"), remembered=REMEMBERED).drop("n_chars")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Fertility, the forest and the piece agenda are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = written(docs, name)
    return docs
