"""Training-corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import jaccard, repeats, toxicity
from pulsegrid.llm.common import remainder, table
from pulsegrid.llm.mixing import first_words, mix, schedule, words
from pulsegrid.llm.packing import pack
from pulsegrid.llm.queries import TOKENIZER
from pulsegrid.session import discard, written


#: A passage is repeated in strings of so many bytes, which 50 short words have, found by runs of PASSAGE_GRAM bytes.
PASSAGE_BYTES, PASSAGE_GRAM, PASSAGE_WORDS = 200, 64, 50


def _packed(docs: DataFrame) -> DataFrame:
    """(__document, text): all other columns as one, so that no name of theirs meets one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__document"), F.col("text").cast("string").alias("text"))


def _unpacked(rows: DataFrame, docs: DataFrame, text: Column, changed: bool = True) -> DataFrame:
    """The columns of ``docs`` with the text ``text``, and its number of characters in n_chars where there is such a column."""
    def column(c: str) -> Column:
        if c == "text":
            return text.cast(docs.schema["text"].dataType).alias("text")
        if c == "n_chars" and changed:
            return F.length(text).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"__document.`{c}`")

    return rows.select(*[column(c) for c in docs.columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic.  Labels are learned from rows whose crc32(doc_id) mod 5 is not 0.

    A null or empty text is not toxic; repeated rows and those of a null id are judged by their texts.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), use=remainder("doc_id", 5) != 0)
    return _unpacked(toxicity.score(_packed(docs), model).where("predicted = 0"), docs, F.col("text"), changed=False)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id; of several rows with its text, the least.

    Unlike texts under one id are no duplicates and stay.  Documents without an id or without words are linked with nothing and stay.
    """
    kept = written(jaccard.kept(docs), "kept").select(F.col("doc").alias("__id"), F.col("h").alias("__h"), "times")
    if kept.count() <= jaccard.SENT:
        kept = F.broadcast(kept)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    joined = (docs.select(F.col("doc_id").cast("long").alias("__id"), jaccard.text_hash("text").alias("__h"), row).join(kept, ["__id", "__h"]))
    single = joined.where("times = 1").select("__row.*")
    several = joined.where("times > 1").groupBy("__id", "__h").agg(F.min("__row").alias("__row")).select("__row.*")
    return single.unionAll(several).unionAll(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of PASSAGE_WORDS words or more that repeat; characters that are cut stay whole.

    Such a passage is a run of bytes covered by strings of PASSAGE_BYTES bytes that occur in more than one place.  Null and empty
    texts stay as they are (a null one empty); a repeated row repeats the text of the other, and both lose it.
    """
    out = repeats.remove(_packed(docs), length=PASSAGE_BYTES, gram=PASSAGE_GRAM, whole_characters=True, least_words=PASSAGE_WORDS)
    return _unpacked(out, docs, F.col("kept").cast("string"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in its order: a document once for each time it is taken, the last of a source cut to the words taken.

    Documents without words are not taken.  A null source is a source, null ids and repeated rows are documents like any other.
    """
    rows = _packed(docs).select("*", F.col("__document.doc_id").alias("doc_id"), F.col("__document.source").alias("source"))
    stream = mix(schedule(rows, size=words("text")))
    return _unpacked(stream, docs, F.when(F.col("served") < F.col("size"), first_words("text", "served")).otherwise(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 ids; a null text is empty, other columns are not read."""
    return pack(docs, TOKENIZER).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", clean), ("jaccard", one_of_each), ("repeats", without_repeats), ("mixing", mixed), ("packing", packed)]

#: SQL cannot express the stages; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        out = written(stage(spark, docs, sf_dir), name)
        if k:
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
