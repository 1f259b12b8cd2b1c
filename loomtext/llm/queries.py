"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.bpe import token_ids
from loomtext.llm.canonical import canonical_texts, look_alike_classes, look_alike_pairs
from loomtext.llm.entities import linked_records, record_pairs
from loomtext.llm.packing import pack
from loomtext.llm.pieces import pieces
from loomtext.llm.pii import personal_information
from loomtext.llm.sentences import sentences
from loomtext.plans.registry import Registry
from loomtext.sources.tables import table

LLM = Registry()

#: The longest text of one synthesis request, and what each piece repeats of the piece before.
REQUEST, REPEATED = 1000, 100


def _shown(spark: SparkSession, folder: str) -> DataFrame:
    """Entries by book and chunks by session."""
    entries = table(spark, folder, "entries").select(
        F.lit("entries").alias("tab"), F.col("book_id").alias("scope"), F.col("entry_id").alias("id"), "text"
    )
    chunks = table(spark, folder, "host_trace").select(
        F.lit("host_trace").alias("tab"), F.col("session_id").alias("scope"), F.col("chunk_id").alias("id"), "text"
    )
    return entries.unionByName(chunks)


@LLM.add("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of entries of a book, and of chunks of a session, that look the same but are different strings."""
    return look_alike_pairs(_shown(spark, folder), ["tab", "scope"], "id", "text").select("tab", "id_a", "id_b")


@LLM.add("p1_classes")
def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every entry and chunk with words: the least id of those that look the same."""
    return look_alike_classes(_shown(spark, folder), ["tab", "scope"], "id", "text").select("tab", "id", "class")


@LLM.add("p1_texts")
def p1_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry and chunk in the consistent form."""
    entries = table(spark, folder, "entries").select(F.lit("entries").alias("tab"), F.col("entry_id").alias("id"), "text")
    chunks = table(spark, folder, "host_trace").select(F.lit("host_trace").alias("tab"), F.col("chunk_id").alias("id"), "text")
    return canonical_texts(entries.unionByName(chunks), "text", "canonical").select("tab", "id", "canonical")


@LLM.add("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of a book that stand for the same person or organisation."""
    return record_pairs(linked_records(table(spark, folder, "manifest_characters")))


@LLM.add("p2_clusters")
def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """The cluster of every record that has a name."""
    return linked_records(table(spark, folder, "manifest_characters"))


@LLM.add("p5_pieces")
def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of at most 1,000 characters of every longer entry."""
    return pieces(table(spark, folder, "entries"), "entry_id", ["chapter"], limit=REQUEST, overlap=REPEATED)


@LLM.add(
    "p5_found",
    r"""
    SELECT entry_id, CASE WHEN list_max(list_transform(string_split_regex(text, '[\s\pZ\pP]'), lambda r: length(r))) > 1000
      THEN 'hard' ELSE 'soft' END AS cut
    FROM entries WHERE length(text) > 1000
    """,
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The entries that are cut, and whether one holds a stretch without white space or marks that no piece can hold."""
    cut = p5_pieces(spark, folder).groupBy("entry_id").agg(F.max("hard").alias("hard"))
    return cut.select("entry_id", F.when(F.col("hard"), "hard").otherwise("soft").alias("cut"))


@LLM.add("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of every entry with its place, by the rules of its book's language."""
    books = table(spark, folder, "books").select("book_id", "lang").dropDuplicates(["book_id"])
    entries = table(spark, folder, "entries").select("entry_id", "book_id", "text").join(books, "book_id", "left")
    return sentences(entries, lang="lang")


@LLM.add("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as its ids."""
    return token_ids(table(spark, folder, "documents"))


@LLM.add("p8_containers")
def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with at least one token in containers of 2,048 tokens."""
    sizes = token_ids(table(spark, folder, "documents"), count_only=True)
    return pack(sizes, "doc_id", "n_tokens", (2048,))


@LLM.add("p8_lengths")
def p8_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents, where sequences of 512, 1,024 and 2,048 tokens are permitted: containers and room of each length."""
    sizes = token_ids(table(spark, folder, "documents"), count_only=True)
    packed = pack(sizes, "doc_id", "n_tokens", (512, 1024, 2048))
    return (
        packed.groupBy("capacity", "container")
        .agg(F.count("*").alias("parts"), F.max("room").alias("room"))
        .groupBy("capacity")
        .agg(F.count("*").alias("containers"), F.sum("parts").alias("parts"), F.sum(F.col("room").cast("bigint")).alias("room"))
    )


@LLM.add("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each item of personal information in the documents with its place."""
    found = personal_information(table(spark, folder, "documents"), kinds=("email", "phone", "identity", "address", "name"))
    return found.select("doc_id", F.inline("items"))


@LLM.add("p9_texts")
def p9_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its personal information replaced by placeholders."""
    return personal_information(table(spark, folder, "documents")).select("doc_id", "redacted")
