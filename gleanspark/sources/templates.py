"""Candidate texts from sentiment templates, and the hook for a generator of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.functions.hashing import choose, uniform
from gleanspark.storage import is_complete, write_table, written_once

# The templates of label 1, of every other label, and the word lists.
POSITIVE_TEMPLATES = [
    "This was a truly {adv} {adj} experience. {praise}",
    "I {verb} this {noun} — {adj} in every way.",
    "What a {adj} piece of work. {praise}",
    "{praise} Definitely worth your {time_noun}.",
    "An {adj} {noun} that {verb_phrase}.",
]
NEGATIVE_TEMPLATES = [
    "This was a {adv} {adj} experience. {criticism}",
    "I {neg_verb} this {noun} — {adj} and forgettable.",
    "What a {adj} waste of time. {criticism}",
    "{criticism} Not worth anyone's {time_noun}.",
    "A {adj} {noun} that {neg_verb_phrase}.",
]
WORDS = {
    "adv": ["genuinely", "completely", "surprisingly", "absolutely", "rather"],
    "adj_pos": ["wonderful", "brilliant", "captivating", "outstanding", "heartwarming"],
    "adj_neg": ["terrible", "dreadful", "boring", "disappointing", "forgettable"],
    "praise": ["Highly recommended.", "A must-see.", "Left me wanting more.", "Exceptional work."],
    "criticism": [
        "Avoid at all costs.", "A total letdown.", "Deeply disappointing.", "Not worth it.",
    ],
    "verb": ["loved", "adored", "enjoyed", "appreciated"],
    "neg_verb": ["hated", "disliked", "despised", "regretted watching"],
    "noun": ["film", "story", "experience", "production"],
    "time_noun": ["time", "attention", "evening"],
    "verb_phrase": [
        "stayed with me long after", "exceeded all my expectations", "moved me deeply",
    ],
    "neg_verb_phrase": [
        "wasted two hours of my life", "failed on every level", "put me to sleep",
    ],
}


def filled(template: Column, label: Column, seed: int, row_id: Column) -> Column:
    """Put a chosen word in every place of ``template``; ``{adj}`` goes by the label."""
    pick = lambda key: choose(WORDS[key], uniform(seed, key, row_id))
    text = template
    for key in WORDS:
        text = F.replace(text, F.lit("{%s}" % key), pick(key))
    adjective = F.when(label == 1, pick("adj_pos")).otherwise(pick("adj_neg"))
    return F.replace(text, F.lit("{adj}"), adjective)


def template_pool(rows: DataFrame, id_col: str, num_classes: int, seed: int) -> DataFrame:
    """A candidate per row of ``rows``: ``cand_id, text, label`` with label = id mod classes."""
    row_id = F.col(id_col)
    label = F.pmod(row_id, F.lit(num_classes)).cast("int")
    draw = uniform(seed, "template", row_id)
    template = F.when(label == 1, choose(POSITIVE_TEMPLATES, draw)).otherwise(
        choose(NEGATIVE_TEMPLATES, draw)
    )
    return rows.select(
        row_id.cast("bigint").alias("cand_id"),
        filled(template, label, seed, row_id).alias("text"),
        label.alias("label"),
    )


def generated_pool(
    rows: DataFrame,
    id_col: str,
    num_classes: int,
    generate: Callable[[Mapping[str, pd.Series]], pd.Series],
) -> DataFrame:
    """The same with a caller's generator, called per batch with ``cand_id`` and ``label``."""
    wanted = rows.select(
        F.col(id_col).cast("bigint").alias("cand_id"),
        F.pmod(F.col(id_col), F.lit(num_classes)).cast("int").alias("label"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=generate(batch))[["cand_id", "text", "label"]]

    return wanted.mapInPandas(run, "cand_id bigint, text string, label int")


def generated_in_waves(
    rows: DataFrame,
    id_col: str,
    num_classes: int,
    generate: Callable[[Mapping[str, pd.Series]], pd.Series],
    folder: str,
    chunks: int,
    chunks_per_wave: int,
) -> DataFrame:
    """The same for a generator that is dear, written to ``folder`` and taken up where it was left.

    Ids are dealt to ``chunks`` by hash, and a wave of them is generated and committed at a time, each
    chunk by a task of its own. A call on the same folder generates the waves that were not
    committed, and a task that is repeated its own chunk only; what is written is not asked for
    again. The number of chunks is kept with the waves; a call with another one is an error, as
    ids would move.
    """
    spark = rows.sparkSession
    settings = written_once(
        spark, f"{folder}/settings", "chunks bigint, per_wave bigint",
        lambda: spark.createDataFrame([(chunks, chunks_per_wave)], "chunks bigint, per_wave bigint"),
    ).first()
    if (settings["chunks"], settings["per_wave"]) != (chunks, chunks_per_wave):
        raise ValueError(f"{folder} was begun with {settings['chunks']} chunks, {settings['per_wave']} a wave")
    wave = F.floor(F.col("chunk") / chunks_per_wave).cast("int")

    def dealt() -> DataFrame:
        ids = rows.select(F.col(id_col).cast("bigint").alias("id"))
        chunk = F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")
        return ids.withColumn("chunk", chunk).withColumn("wave", wave)

    asked = written_once(spark, f"{folder}/asked", "id bigint, chunk int, wave int", dealt, "wave")
    for number in range(ceil(chunks / chunks_per_wave)):
        path = f"{folder}/pool/wave={number}"
        if not is_complete(spark, path):
            # As many tasks as chunks; by range, so that no two chunks share one where hashes would.
            own = asked.filter(F.col("wave") == number).repartitionByRange(chunks_per_wave, "chunk")
            write_table(generated_pool(own, "id", num_classes, generate), path)
    return spark.read.schema("cand_id bigint, text string, label int").parquet(
        *[f"{folder}/pool/wave={n}" for n in range(ceil(chunks / chunks_per_wave))]
    )
