"""New words of dump files as they arrive, from keyed streaming state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from verbarium.functions import wikitext
from verbarium.operators.dictionary import vocabulary
from verbarium.operators.extraction import templates
from verbarium.operators.pages import drop_special_pages
from verbarium.operators.rules import RULES, RuleSet, by_lower_name, conjugate
from verbarium.schemas import WORDS
from verbarium.sources.dump import dump_chunk_stream, good_pages, pages_of


def arriving_words(chunks: DataFrame, rules: Mapping[str, RuleSet] = RULES) -> DataFrame:
    """The words of a stream of dump chunks, each at its first sight in all micro-batches.

    The words seen so far are keyed state, spread over the shuffle partitions; it grows with the
    vocabulary, not with the pages. Chunks are taken one by one: a page that is cut inside a
    CDATA section, which only a whole micro-batch could put together, counts as broken here.
    """
    pages = drop_special_pages(good_pages(pages_of(chunks.select("value"), wikitext.VERB_MARK)))
    return vocabulary(conjugate(templates(pages, sorted(by_lower_name(rules))), rules))


def stream_words(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    rules: Mapping[str, RuleSet] = RULES,
    max_files: int | None = None,
) -> StreamingQuery:
    """Add to the Parquet folder ``out`` the words that the files in ``folder`` bring, each once.

    Later runs with the same checkpoint go on from the files and the words that it knows; a run
    that broke off leaves nothing that is read and is repeated.
    """
    words = arriving_words(dump_chunk_stream(spark, folder, max_files), rules)
    return (
        words.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_words(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(WORDS).parquet(out).select("word")
