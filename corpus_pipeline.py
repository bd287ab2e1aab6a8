"""Training-data pipeline over `documents`: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetry.llm.common import prepared, scratch_folder, settle
from playmetry.llm.language import UNDETERMINED, held_out, identify, learned
from playmetry.llm.mixing import mix
from playmetry.llm.nearcopies import near_copies
from playmetry.llm.pieces import encode, load_vocabulary
from playmetry.llm.substrings import remove_repeats
from playmetry.scale import exact_quantiles

#: Columns of `documents`, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of `documents` alone, in a session with the settings of these operators."""
    prepared(spark)
    return docs.select(*COLUMNS)


#: Keys of texts that share an id lie above this; ids have to lie below.
SHARED = 1 << 62


def separate(docs: DataFrame) -> DataFrame:
    """Documents, each once, with a `key` of their own, so that the operators tell them apart.

    The key is the doc_id where one text alone has it. Rows that share an id are rare and take
    a path of their own: of equal ones (id and text) one stays, and the key of different texts
    is made of id and text and larger than any id, so a text with an id of its own counts as
    the first. A null id has a null key: such rows stand for themselves and all stay.
    """
    several = settle(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "shared")
    if not several.take(1):
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    marked = docs.join(several.withColumn("several", F.lit(True)), "doc_id", "left").select(*docs.columns, "several")
    own = marked.where(F.col("several").isNull()).withColumn("key", F.col("doc_id").cast("long"))
    mixed = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(SHARED - 1)).bitwiseOR(F.lit(SHARED))
    once = settle(marked.where(F.col("several")).dropDuplicates(["doc_id", "text"]), "once")
    texts = once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rest = once.join(texts, "doc_id").withColumn("key", F.when(F.col("n") == 1, F.col("doc_id").cast("long")).otherwise(mixed))
    return own.unionByName(rest.drop("n")).drop("several")


#: Share of the median score of like documents that a document has to reach.
LANGUAGE_SHARE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that look like none of the learned languages go.

    Profiles are learned from all documents that are not held out. Of the held-out ones whose
    language is told right, the median score by language and power of two of the length is
    the measure: a document whose best cosine is under half of it, or that has no letter,
    is rejected. So scripts and languages that were not learned go, and letters in no order
    or a word over and over; short texts are measured against short ones. A length that no
    held-out document of the language has takes the language's lowest bar.
    """
    docs = documents(spark, docs)
    profiles = learned(docs)
    size = F.floor(F.log2(F.greatest(F.length("text"), F.lit(1)))).cast("int")
    tried = settle(identify(docs.where(held_out()).select("text", "lang"), profiles).select("lang", "lang_pred", "score", size.alias("size")), "tried")
    right = tried.where(F.col("lang") == F.col("lang_pred"))
    medians = exact_quantiles(right, ["lang_pred", "size"], "score", {"median": 0.5}).collect()
    # One number per language, of which `learn_profiles` allows 512, and power of two of a length.
    bars: dict[str, float] = {}
    for r in medians:
        bar = r["median"] * LANGUAGE_SHARE
        bars[f"{r['size']} {r['lang_pred']}"] = bar
        lowest = f"* {r['lang_pred']}"
        bars[lowest] = min(bar, bars.get(lowest, bar))
    enough = F.lit(True)
    if bars:
        table = F.create_map(*[F.lit(x) for pair in bars.items() for x in pair])
        of_size = F.try_element_at(table, F.concat_ws(" ", size.cast("string"), "lang_pred"))
        enough = F.col("score") >= F.coalesce(of_size, F.try_element_at(table, F.concat(F.lit("* "), "lang_pred")), F.lit(0.0))
    told = identify(docs, profiles)
    return told.where((F.col("lang_pred") != UNDETERMINED) & enough).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup at 0.8 over five-word shingles: one document of each group stays.

    That is the one with the smallest id; a document whose id another text shares comes after
    all others. Repeated rows are one document. A null id is no member of a group and stays.
    """
    docs = separate(documents(spark, docs))
    gone = near_copies(docs, percent=80, key="key").where(~F.col("kept")).select("key").distinct()
    return docs.join(gone, "key", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages of 50 words that begin in an earlier document go.

    A document that loses words has the others joined by one space, and one that loses all of
    them goes; all others keep their text as it was, also under an id that another text shares.
    """
    docs = separate(documents(spark, docs))
    cut = remove_repeats(docs, length=50, key="key").where(F.col("n_removed") > 0).select("key", "kept_text")
    return (
        docs.join(cut, "key", "left")
        .where(F.col("kept_text").isNull() | (F.col("kept_text") != ""))
        .withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long")))
        .withColumn("text", F.coalesce("kept_text", "text"))
        .select(*COLUMNS)
    )


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: every document as often as the mix takes it, 0 to 2 times.

    Rows under one id are taken equally often.
    """
    docs = documents(spark, docs)
    copies = mix(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    taken = docs.join(copies.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")))
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: ids of one sampled segmentation per document, seeded by its id."""
    coded = encode(documents(spark, docs).select("doc_id", "lang", "source", "text"), load_vocabulary())
    return coded.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("sentencepiece", pieces),
]

#: Hyperdimensional profiles and sampled segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
