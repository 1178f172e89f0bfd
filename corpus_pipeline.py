"""A corpus pipeline: language ID, line dedup, MinHash near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs.  run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suitestat.llm.common import materialize, table
from suitestat.llm.language_cnn import UNKNOWN, identify
from suitestat.llm.line_join import dedup_lines
from suitestat.llm.mixing import mix
from suitestat.llm.prob_minhash import near_duplicates
from suitestat.llm.sentencepiece_bpe import encode_decode

#: A document whose language is less likely than this is rejected.
MIN_SCORE = 0.5


#: Columns that the operators read; others have names of our own while one runs, so that none can clash with what it adds.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def guarded(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What run makes of docs, with the columns of docs alone, under their names."""
    own = {c: f"_column_{i}" for i, c in enumerate(docs.columns) if c not in READ}
    return run(docs.withColumnsRenamed(own)).select(*[own.get(c, c) for c in docs.columns]).withColumnsRenamed({n: c for c, n in own.items()})


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that are und, or of no likely language, go.

    Null and empty texts and texts without a letter are und, and go; a text is read whole,
    however long.  Of languages of equal score the first in code-point order is taken.
    Rows that repeat stay, columns of any name stay, and an empty table stays empty.
    """
    return guarded(docs, lambda d: identify(d).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line has or nearly has; a document that loses all of its text goes.

    Null and empty texts lose nothing and stay.  Earlier is by doc_id (null first), then by
    the place of the line; rows that repeat a doc_id are handled as dedup_lines() says.
    n_chars follows a text that is cut.  An empty table stays empty.
    """

    def run(d: DataFrame) -> DataFrame:
        left = dedup_lines(d).filter((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        if "n_chars" in d.columns:
            left = left.withColumn("n_chars", F.when(F.size("removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
        return left

    return guarded(docs, run)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates.

    The smallest doc_id of a class stays; a document without an id, and one that is in no
    class (a null or empty text too), stays.  Rows that repeat the id that stays all
    stay.  An empty table stays empty.
    """
    return guarded(docs, lambda d: near_duplicates(d).filter("kept"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time.

    A null source is a source of its own.  Texts without words have size 0 and are taken as
    often as their source is taken whole.  Documents of one size are chosen by a hash of their
    id, so ties don't depend on the order of rows.  An empty table stays empty.
    """
    return guarded(docs, lambda d: mix(d).filter("times > 0").select("*", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("_time")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with begin and end ids, and the digests of the ids and of the text that they decode to.

    A null text counts as empty.  One row in, one row out, so what the mix repeats stays
    repeated; a text is encoded whole.  An empty table gives an empty table.
    """
    return encode_decode(docs.select("doc_id", "lang", "source", "text"), with_text=False)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash", minhash), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: SQL can't express the network of the first stage, the seeded choice of the fourth or the tokens of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
