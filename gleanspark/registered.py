"""The queries of ``__spark_entry__``: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.config import MAX_TOKENS, SelectionConfig
from gleanspark.functions.hashing import uniform
from gleanspark.functions.text import tokens
from gleanspark.functions.vectors import as_doubles, l2_normalise
from gleanspark.operators import metrics, ordering, prefix, rewards
from gleanspark.operators.classifier import fit, mean_loss, predict
from gleanspark.operators.embedding import embed_with
from gleanspark.operators.logistic import fit_logistic, predict_logistic
from gleanspark.operators.novelty import novelty
from gleanspark.operators.policy import Policy, make_policy
from gleanspark.operators.regression import LogisticRegression
from gleanspark.plans import report
from gleanspark.plans.loop import SelectionRun
from gleanspark.plans.regimes import compare_regimes, fit_with
from gleanspark.plans.replay import replay
from gleanspark.plans.scoring import score_candidates as scored_candidates
from gleanspark.plans.scoring import trusted_set, with_tokens, with_vectors
from gleanspark.sources import pools, results
from gleanspark.sources.labelled import attach_labels, labelled, union_all, union_keyed
from gleanspark.sources.templates import generated_in_waves, generated_pool
from gleanspark.sources.templates import template_pool as templates
from gleanspark.storage import fresh_path, materialize, spread
from gleanspark.streaming.arrivals import arriving_pool, run_stream
from gleanspark.streaming.state import fold_arrivals, folded_state

SEED = 42
LANGUAGES = ("en", "fr", "de", "es")
SHARES = {"train": 0.03, "val": 0.10, "test": 0.10}
FLIPPED = 0.15
ROUNDS = 8
TARGET_SHARE = 0.3
SAMPLE_ROWS = 300
SPLIT_SIZES = {"train": 500, "val": 200, "test": 200}
BATCH_ROWS = 50
# Rows of a file that lands; a batch of a large table is many files.
FILE_ROWS = 20_000
PLACES = 6
# Plain gradient steps, which SQL can follow; a round of the loop takes fewer.
EPOCHS, LOOP_EPOCHS, STEP, PENALTY = 5, 3, 2.0, 0.01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(*names: str) -> list:
    return [F.round(n, PLACES).alias(n) for n in names]


# Inputs derived from the tables.


def language_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, text, label, split``: the language of a document is its label."""
    number = F.lit(len(LANGUAGES) - 1)
    for place, code in reversed(list(enumerate(LANGUAGES[:-1]))):
        number = F.when(F.col("lang") == code, F.lit(place)).otherwise(number)
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    documents = documents.withColumn("label", number)
    return ordering.band_splits(labelled(documents, "doc_id", "text", "label"), "id", SHARES, "pool", SEED)


def trusted_part(task: DataFrame) -> DataFrame:
    return task.filter("split <> 'pool'")


def candidate_part(task: DataFrame) -> DataFrame:
    """``cand_id, text, label``: the claimed label, wrong for a share of the rows."""
    flip = uniform(SEED, "flip", F.col("id")) < FLIPPED
    claimed = F.when(flip, (F.col("label") + 1) % len(LANGUAGES)).otherwise(F.col("label"))
    own = [c for c in task.columns if c == "vector"]
    return task.filter("split = 'pool'").select(F.col("id").alias("cand_id"), "text", claimed.alias("label"), *own)


def settings(pool_rows: int | None = None) -> SelectionConfig:
    """Batches and target grow with the pool, so the number of rounds does not."""
    if pool_rows is None:
        return SelectionConfig(num_classes=len(LANGUAGES), seed=SEED)
    return SelectionConfig(
        num_classes=len(LANGUAGES),
        batch_size=max(1, ceil(pool_rows / ROUNDS)),
        target_size=int(pool_rows * TARGET_SHARE),
        max_rounds=ROUNDS,
        seed=SEED,
    )


def tokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(language_task(spark, sf_dir), settings())


def language_model(spark: SparkSession, sf_dir: str):
    return fit(tokenised(spark, sf_dir).filter("split = 'train'"), len(LANGUAGES))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, split, probs, prediction`` for every document."""
    return predict(
        tokenised(spark, sf_dir), language_model(spark, sf_dir), "id", ("label", "split")
    )


def scored(spark: SparkSession, sf_dir: str, batch_rows: int | None = None) -> DataFrame:
    """Every candidate with its signals; with ``batch_rows`` also its clock and batch."""
    task, config = language_task(spark, sf_dir), settings()
    train = materialize(with_tokens(task.filter("split = 'train'"), config).drop("text"), "train")
    candidates, carry = candidate_part(task), ()
    if batch_rows is not None:
        candidates, carry = ordering.in_batches(candidates, "cand_id", batch_rows, SEED), ("t", "batch_no")
    return scored_candidates(
        candidates,
        fit(train, config.num_classes),
        trusted_set(train.select("id", "tokens"), config),
        config,
        carry,
    )


def probability_columns() -> list:
    return [F.round(F.get("probs", F.lit(c)), PLACES).alias(f"p_{c}") for c in range(len(LANGUAGES))]


def vector_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidate and trusted vectors: two halves of ``embeddings`` by hashed id."""
    split = ordering.band_splits(
        table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", {"real": 0.5}, "cand", SEED
    )
    half = lambda name: split.filter(F.col("split") == name).drop("split")
    return half("cand"), half("real")


def user_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one run of values; money has two places, so sums stay exact."""
    events = table(spark, sf_dir, "events").select(
        "user_id",
        "ts",
        "event_id",
        F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("arm"),
        F.col("value").cast("decimal(18,2)").alias("value"),
    )
    return prefix.in_segments(events, ["user_id"], ["ts", "event_id"])


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one run's log, a round per event."""
    events = table(spark, sf_dir, "events").select(
        "ts", "event_id",
        F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("arm"),
        ((F.round(F.col("value") * 100).cast("bigint") - 5000) / 100).alias("reward"),
    )
    order = ["ts", "event_id"]
    one = F.lit(1).cast("bigint")
    numbered = prefix.running(prefix.in_segments(events, [], order), [], order, sums={"_before": one})
    return numbered.select((F.col("_before") + 1).alias("iteration"), "arm", "reward")


def user_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = rewards.reward_log(user_segments(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    return log.select("user_id", "iteration", "arm", "reward")


def daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run's log with a round per day: the arm by which kind of event prevails."""
    good = F.count_if(F.col("event_type").isin("purchase", "signup"))
    bad = F.count_if(F.col("event_type").isin("error", "click"))
    # Whole cents are summed, so the mean does not depend on the order of the rows.
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    first = events.agg(F.min("day")).first()[0]
    return (
        events.groupBy((F.date_diff("day", F.lit(first)) + 1).alias("iteration"))
        .agg(
            F.when(good > bad, 1).otherwise(0).alias("arm"),
            (cents.cast("double") / 100 / F.count(F.lit(1)) - 50).alias("reward"),
        )
    )


def daily_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log by days with a context vector: the shares of either kind of event, and the mean value."""
    share = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds)) / F.count(F.lit(1))
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    first = events.agg(F.min("day")).first()[0]
    contexts = events.groupBy((F.date_diff("day", F.lit(first)) + 1).alias("iteration")).agg(
        F.array(share("purchase", "signup"), share("error", "click"), cents.cast("double") / 10_000 / F.count(F.lit(1)))
        .alias("context")
    )
    return daily_log(spark, sf_dir).join(contexts, "iteration")


def log_rounds(spark: SparkSession, sf_dir: str) -> int:
    return daily_log(spark, sf_dir).agg(F.max("iteration")).first()[0]


def replay_candidates(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """``cand_id, t, batch_no, weight``: all candidates, in as many batches as the log has days."""
    rows = candidate_part(language_task(spark, sf_dir)).count()
    found = scored(spark, sf_dir, max(1, ceil(rows / log_rounds(spark, sf_dir))))
    return found.select("cand_id", "t", "batch_no", "weight", *more)


def selection(spark: SparkSession, sf_dir: str, **parts) -> SelectionRun:
    return selection_of(spark, language_task(spark, sf_dir), **parts)


def selection_of(spark: SparkSession, task: DataFrame, **parts) -> SelectionRun:
    pool = candidate_part(task)
    return SelectionRun(spark, trusted_part(task), settings(pool.count()), **parts).run(pool)


def selection_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result document of a run, written and read back."""
    run = selection(spark, sf_dir)
    path = f"{run.folder}/results"
    results.write_result(results.result_document(run.rounds, run.regimes()), path)
    return results.read_result(spark, path)


# Sources and sinks.


def load_labelled(spark, sf_dir):
    return attach_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "quality")


def union_sources(spark, sf_dir):
    documents = language_task(spark, sf_dir).select("id", "text", "label")
    passages = table(spark, sf_dir, "benchmark").withColumn("label", F.lit(0))
    return union_all(documents, labelled(passages, "item_id", "text", "label"))


def pool_lines(spark, sf_dir):
    path = fresh_path(spark, "pool")
    pools.write_pool(candidate_part(language_task(spark, sf_dir)), path, "json")
    return pools.read_pool(spark, path, "json")


def pool_array(spark, sf_dir):
    """One JSON array per part file."""
    path = fresh_path(spark, "pool")
    pools.write_pool_array(candidate_part(language_task(spark, sf_dir)), path)
    return pools.read_pool_array(spark, path)


def pool_reuse(spark, sf_dir):
    """Two calls: the second finds the pool and does not build it."""
    path, pool = fresh_path(spark, "pool"), candidate_part(language_task(spark, sf_dir))

    def fail() -> DataFrame:
        raise AssertionError("the pool was built twice")

    rows = pool.count()
    pools.pool_once(spark, path, rows, SEED, lambda: pool)
    return pools.pool_once(spark, path, rows, SEED, fail)


def template_pool(spark, sf_dir):
    return templates(table(spark, sf_dir, "documents"), "doc_id", 2, SEED)


def own_generator(spark, sf_dir):
    def generate(batch: pd.DataFrame) -> pd.Series:
        return "text " + batch["cand_id"].astype(str) + " of class " + batch["label"].astype(str)

    return generated_pool(table(spark, sf_dir, "documents"), "doc_id", 2, generate)


def generator_waves(spark, sf_dir):
    """A dear generator is asked in waves that are committed one by one; the second call asks nothing."""
    documents, folder = table(spark, sf_dir, "documents"), fresh_path(spark, "waves")

    def generate(batch: pd.DataFrame) -> pd.Series:
        return "text " + batch["cand_id"].astype(str) + " of class " + batch["label"].astype(str)

    def fail(batch: pd.DataFrame) -> pd.Series:
        raise AssertionError("the generator was asked again")

    generated_in_waves(documents, "doc_id", 2, generate, folder, 24, 8)
    return generated_in_waves(documents, "doc_id", 2, fail, folder, 24, 8)


# Order, samples and splits.


def seeded_sample(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ordering.take_shuffled(documents, "doc_id", SAMPLE_ROWS, SEED)


def fixed_splits(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return ordering.fixed_splits(documents, "doc_id", SPLIT_SIZES, SEED)


def split_sizes(spark, sf_dir):
    return fixed_splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def band_splits(spark, sf_dir):
    return language_task(spark, sf_dir).select("id", "label", "split")


def batch_assign(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return ordering.in_batches(documents, "doc_id", BATCH_ROWS, SEED)


# Vectors.


def l2_normalised(spark, sf_dir):
    unit = l2_normalise(as_doubles(F.col("embedding")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit).alias("pos", "x"))
    return rows.select("vec_id", "pos", *rounded("x"))


def novelty_score(spark, sf_dir):
    found = novelty(*vector_parts(spark, sf_dir), "vec_id", "embedding")
    return found.select("vec_id", *rounded("novelty"))


def novelty_by_blocks(spark, sf_dir):
    """The strategy for a trusted side too large to broadcast."""
    found = novelty(*vector_parts(spark, sf_dir), "vec_id", "embedding", broadcast_bytes=0, index="blocks")
    return found.select("vec_id", *rounded("novelty"))


def novelty_by_pivots(spark, sf_dir):
    """The same with most pairs left out."""
    found = novelty(*vector_parts(spark, sf_dir), "vec_id", "embedding", broadcast_bytes=0)
    return found.select("vec_id", *rounded("novelty"))


def nearest_real(spark, sf_dir):
    return nearest_ids(spark, sf_dir)


def nearest_real_by_blocks(spark, sf_dir):
    return nearest_ids(spark, sf_dir, broadcast_bytes=0, index="blocks")


def nearest_real_by_pivots(spark, sf_dir):
    return nearest_ids(spark, sf_dir, broadcast_bytes=0)


def nearest_ids(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = novelty(*vector_parts(spark, sf_dir), "vec_id", "embedding", with_id=True, **options)
    return found.select("vec_id", "nearest_id", F.round(1 - F.col("novelty"), PLACES).alias("similarity"))


def hashed_embedding(spark, sf_dir):
    """Sums that tell one vector of word counts per bucket from another."""
    vectors = with_vectors(tokenised(spark, sf_dir), settings()).select("id", "vector")
    total = lambda term: f"aggregate(transform(vector, (x, i) -> {term}), 0D, (a, x) -> a + x)"
    return vectors.selectExpr(
        "id",
        f"{total('x')} AS n_words",
        f"{total('x * x')} AS squares",
        f"{total('x * (i + 1)')} AS moment",
        f"{total('x * (i + 1) * (i + 1)')} AS second_moment",
    )


def own_embedding(spark, sf_dir):
    def load():
        return lambda texts: [(len(t), t.count(" ")) for t in texts]

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = lambda place: F.get("embedding", F.lit(place))
    return embed_with(documents, "text", load).select(
        "doc_id", part(0).alias("n_chars"), part(1).alias("n_spaces")
    )


# Classifier.


def tokenise_truncate(spark, sf_dir):
    words = tokens(F.col("text"), MAX_TOKENS)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(words).alias("n_tokens"), F.concat_ws(" ", words).alias("words")
    )


def nb_model(spark, sf_dir):
    return language_model(spark, sf_dir).counts.filter("token IS NOT NULL")


def nb_probabilities(spark, sf_dir):
    return predicted(spark, sf_dir).select("id", *probability_columns())


def nb_probabilities_shuffled(spark, sf_dir):
    """The strategy for a model too large to broadcast."""
    found = predict(
        tokenised(spark, sf_dir), language_model(spark, sf_dir), "id", broadcast_bytes=-1
    )
    return found.select("id", *probability_columns())


def union_scored(spark, sf_dir):
    """Two sources whose ids collide, scored together."""
    documents = language_task(spark, sf_dir).select("id", "text", "label")
    passages = table(spark, sf_dir, "benchmark").withColumn("label", F.lit(0))
    passages = labelled(passages, "item_id", "text", "label")
    rows = union_keyed({"documents": documents, "benchmark": passages})
    found = predict(with_tokens(rows, settings()), language_model(spark, sf_dir), "key")
    return found.select("key", *probability_columns())


def predict_argmax(spark, sf_dir):
    return predicted(spark, sf_dir).select("id", "label", "split", "prediction")


def train_loss(spark, sf_dir):
    train = predicted(spark, sf_dir).filter("split = 'train'")
    return train.agg(F.round(mean_loss(train), PLACES).alias("loss"), F.count(F.lit(1)).alias("n"))


def regression(epochs: int) -> LogisticRegression:
    return LogisticRegression(settings().embedding_dim, epochs, "gradient", STEP, PENALTY)


def lr_model(spark, sf_dir):
    """Weights after a few plain gradient steps of the learner of our own."""
    model = regression(EPOCHS).trained(tokenised(spark, sf_dir).filter("split = 'train'"), len(LANGUAGES))
    return model.by_bucket(spark).select("class", "bucket", *rounded("weight"))


def loss_history(spark, sf_dir):
    model = regression(EPOCHS).trained(tokenised(spark, sf_dir).filter("split = 'train'"), len(LANGUAGES))
    return model.loss_history(spark).select("epoch", *rounded("loss"))


def lr_probabilities(spark, sf_dir):
    rows = tokenised(spark, sf_dir)
    model = fit_logistic(rows.filter("split = 'train'"))
    found = predict_logistic(rows.select("id", "label", "tokens"), model)
    return found.select("id", "label", "prediction", F.round(F.array_max("probs"), PLACES).alias("confidence"))


# Signals.


def uncertainty(spark, sf_dir):
    return scored(spark, sf_dir).select("cand_id", *rounded("uncertainty"))


def verifier_confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("cand_id", "label", *rounded("verifier"))


def score_candidates(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "cand_id", "label", "prediction", *rounded("uncertainty", "novelty", "verifier", "weight")
    )


# Measures.


def confusion(spark, sf_dir):
    return metrics.confusion(predicted(spark, sf_dir), ["split"])


def class_f1(spark, sf_dir):
    counts = metrics.confusion(predicted(spark, sf_dir), ["split"])
    return metrics.class_f1(counts, ["split"]).select("split", "class", "tp", "fp", "fn", *rounded("f1"))


def macro_f1(spark, sf_dir):
    return metrics.macro_f1(predicted(spark, sf_dir), ["split"]).select("split", *rounded("macro_f1"))


def regime_baselines(spark, sf_dir):
    """Fit and evaluate on the trusted rows, and on the trusted rows with the whole pool."""
    task = language_task(spark, sf_dir)
    real = materialize(with_tokens(trusted_part(task), settings()).drop("text"), "trusted")
    pool = with_tokens(candidate_part(task), settings())
    models = {
        "real_only": fit_with(real, len(LANGUAGES)),
        "naive_augmentation": fit_with(real, len(LANGUAGES), pool),
    }
    return compare_regimes(real, models).select("regime", *rounded("val_f1", "test_f1"))


# Reward log and policy.


def reward_delta(spark, sf_dir):
    return user_rewards(spark, sf_dir).select("user_id", "iteration", "arm", F.col("reward").cast("double").alias("reward"))


def policy_state(spark, sf_dir):
    by_arm = rewards.state_by_arm(user_rewards(spark, sf_dir), ["user_id"])
    return by_arm.select("user_id", "arm", "pulls", "mean")


def beta_state(spark, sf_dir):
    by_arm = rewards.state_by_arm(user_rewards(spark, sf_dir), ["user_id"])
    return by_arm.select("user_id", "arm", "alpha", "beta")


def policy_state_running(spark, sf_dir):
    log = prefix.in_segments(user_rewards(spark, sf_dir), ["user_id"], ["iteration"])
    state = rewards.state_before_each(log, ["user_id"])
    kept = ("pulls_0", "alpha_0", "beta_0", "pulls_1", "alpha_1", "beta_1")
    return state.select("user_id", "iteration", *kept, "mean_0", "mean_1")


def replayed(spark, sf_dir, policy: Policy) -> DataFrame:
    return replay(replay_candidates(spark, sf_dir), daily_log(spark, sf_dir), policy)


def ucb_replay(spark, sf_dir):
    return replayed(spark, sf_dir, make_policy("ucb")).select(
        "cand_id", "t", "batch_no", "action", *rounded("reject_score", "accept_score")
    )


def thompson_replay(spark, sf_dir):
    return replayed(spark, sf_dir, make_policy("thompson", seed=SEED)).select(
        "cand_id", "t", "batch_no", "action", *rounded("reject_score", "accept_score")
    )


def replay_open_batch(spark, sf_dir):
    """The log ends halfway: what follows is decided by all that is known."""
    log = daily_log(spark, sf_dir).filter(F.col("iteration") <= log_rounds(spark, sf_dir) // 2)
    return replay(replay_candidates(spark, sf_dir), log, make_policy("ucb")).select(
        "cand_id", "t", "batch_no", "action", *rounded("reject_score", "accept_score")
    )


def linear_ucb_replay(spark, sf_dir):
    """A policy with sums of its own: the state is a regression on the contexts of the days before."""
    candidates = replay_candidates(spark, sf_dir, "context")
    found = replay(candidates, daily_contexts(spark, sf_dir), make_policy("linear", dim=3))
    return found.select("cand_id", "t", "batch_no", "action", *rounded("reject_score", "accept_score"))


def thompson_long_log(spark, sf_dir):
    """Candidates spread over a log with a round per event; the draws' shapes grow to thousands."""
    log = materialize(event_log(spark, sf_dir), "events")
    pool = candidate_part(language_task(spark, sf_dir)).select("cand_id")
    pool = materialize(ordering.in_batches(pool, "cand_id", 1, SEED).drop("batch_no"), "pool")
    rounds, rows = log.count(), pool.count()
    spread_out = F.floor((F.col("t") - 1) * rounds / F.lit(rows)) + 1
    candidates = pool.select(
        "cand_id", "t", spread_out.cast("bigint").alias("batch_no"),
        uniform(SEED, "weight", F.col("cand_id")).alias("weight"),
    )
    return replay(candidates, log, make_policy("thompson", seed=SEED)).select(
        "cand_id", "t", "batch_no", "action", *rounded("reject_score", "accept_score")
    )


def replay_many_runs(spark, sf_dir):
    """Every user's log decides that user's own events, five to a batch."""
    placed = prefix.running(
        user_segments(spark, sf_dir), ["user_id"], ["ts", "event_id"], sums={"_before": F.lit(1).cast("bigint")}
    )
    candidates = placed.select(
        "user_id", F.col("event_id").alias("cand_id"), (F.col("_before") + 1).alias("t"),
        (F.floor(F.col("_before") / 5) + 1).cast("bigint").alias("batch_no"),
        uniform(SEED, "weight", F.col("event_id")).alias("weight"),
    )
    log = user_rewards(spark, sf_dir).select("user_id", "iteration", "arm", F.col("reward").cast("double").alias("reward"))
    return replay(candidates, log, make_policy("ucb"), ["user_id"]).select(
        "user_id", "cand_id", "t", "batch_no", "action", *rounded("reject_score", "accept_score")
    )


class WeightAbove(Policy):
    """A policy of one's own: accept what reaches a fixed context weight."""

    def __init__(self, bar: float):
        self.bar = bar

    def arm_scores(self, state, t, row_id):
        return F.lit(self.bar), F.lit(1.0)

    def boosted(self, state, t, weight, row_id):
        return F.lit(self.bar), weight


def own_policy(spark, sf_dir):
    return replayed(spark, sf_dir, WeightAbove(0.5)).select("cand_id", "batch_no", "action")


def round_arms(spark, sf_dir):
    decided = replayed(spark, sf_dir, make_policy("ucb"))
    return metrics.accepted_counts(decided, ["batch_no"])


def accept_capped(spark, sf_dir):
    """The first accepted candidates up to the target, in the order they were seen."""
    decided = replayed(spark, sf_dir, make_policy("thompson", seed=SEED))
    target = int(candidate_part(language_task(spark, sf_dir)).count() * TARGET_SHARE)
    accepted = materialize(decided.filter("action = 1").select("cand_id", "t", "batch_no"), "accepted")
    return ordering.first_in_order(accepted, "t", target)


# The loop and its reports.


def closed_loop(spark, sf_dir):
    return selection(spark, sf_dir).rounds.select(
        "iteration", "n_batch", "n_accepted", "curated_total", "arm", *rounded("val_f1", "reward")
    )


def closed_loop_regression(spark, sf_dir):
    """The loop with logistic regression in place of naive Bayes."""
    return selection(spark, sf_dir, learner=regression(LOOP_EPOCHS)).rounds.select(
        "iteration", "n_batch", "n_accepted", "curated_total", "arm", *rounded("val_f1", "reward")
    )


def closed_loop_vectors(spark, sf_dir):
    """The loop over the documents that have a vector of their own."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return selection_of(spark, language_task(spark, sf_dir).join(vectors, "id")).rounds.select(
        "iteration", "n_batch", "n_accepted", "curated_total", "arm", *rounded("val_f1", "reward")
    )


def decision_log(spark, sf_dir):
    return selection(spark, sf_dir).decisions.select(
        "iteration", "cand_id", "t", "action", "kept", *rounded("uncertainty", "novelty", "verifier")
    )


def curated_rows(spark, sf_dir):
    return selection(spark, sf_dir).curated().select("iteration", "t", "cand_id", "label", "text")


def regime_comparison(spark, sf_dir):
    return selection(spark, sf_dir).regimes().select("regime", *rounded("val_f1", "test_f1"))


def regime_curve(spark, sf_dir):
    curve = report.learning_curve(selection_document(spark, sf_dir))
    return curve.select("iteration", *rounded("val_f1", "real_only_val_f1", "naive_val_f1"))


def regime_summary(spark, sf_dir):
    return report.regime_summary(selection_document(spark, sf_dir))


def result_document(spark, sf_dir):
    guided = F.col("bandit_guided")
    return selection_document(spark, sf_dir).select(
        F.size(guided["val_f1_history"]).alias("n_val"),
        F.size(guided["reward_history"]).alias("n_reward"),
        guided["curated_pool_size"].alias("curated_pool_size"),
        F.round(guided["test_f1"], PLACES).alias("test_f1"),
        F.round("baseline_real_only.val_f1", PLACES).alias("real_only_val_f1"),
        F.round("naive_augmentation.test_f1", PLACES).alias("naive_test_f1"),
    )


def stream_loop(spark, sf_dir):
    """The candidates arrive as files, a round's worth at a time."""
    task = language_task(spark, sf_dir)
    pool = candidate_part(task)
    config = settings(pool.count())
    files = ceil(config.batch_size / FILE_ROWS)
    landing, ordered = fresh_path(spark, "landing"), fresh_path(spark, "ordered")
    ordering.in_batches(pool, "cand_id", config.batch_size, SEED).write.partitionBy("batch_no").parquet(ordered)
    for batch_no in range(1, ROUNDS + 1):
        batch = spark.read.parquet(ordered).filter(F.col("batch_no") == batch_no)
        pools_part = batch.select("cand_id", "text", "label").repartition(files)
        pools_part.write.mode("append").parquet(landing)
    run = SelectionRun(spark, trusted_part(task), config)
    run_stream(run, arriving_pool(spark, landing, files))
    return run.rounds.select(
        "iteration", "n_batch", "n_accepted", "curated_total", "arm", *rounded("val_f1", "reward")
    )


def streamed_state(spark, sf_dir):
    """Every user's rewards arrive out of order, some of them twice; the state is that of the whole log.

    Rewards are whole cents here, whose sums are exact in any order.
    """
    log = user_rewards(spark, sf_dir).withColumn("reward", (F.col("reward") * 100).cast("bigint").cast("double"))
    landing, folder = fresh_path(spark, "landing"), fresh_path(spark, "folded")
    again = log.filter(F.pmod(F.xxhash64("user_id", "iteration"), F.lit(7)) == 0)
    log.unionByName(again).repartition(4, F.col("iteration") * 31 % 17).write.parquet(landing)
    arrivals = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    fold_arrivals(arrivals, ["user_id"], folder)
    state = folded_state(spark, folder, ["user_id"])
    return state.select("user_id", *[f"{n}_{a}" for a in (0, 1) for n in ("pulls", "alpha", "beta", "mean")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        load_labelled, union_sources, pool_lines, pool_array, pool_reuse, template_pool, own_generator, generator_waves,
        seeded_sample, fixed_splits, split_sizes, band_splits, batch_assign,
        l2_normalised, novelty_score, novelty_by_blocks, novelty_by_pivots,
        nearest_real, nearest_real_by_blocks, nearest_real_by_pivots,
        hashed_embedding, own_embedding,
        tokenise_truncate, nb_model, nb_probabilities, nb_probabilities_shuffled,
        union_scored, predict_argmax, train_loss, lr_model, loss_history, lr_probabilities,
        uncertainty, verifier_confidence, score_candidates,
        confusion, class_f1, macro_f1, regime_baselines,
        reward_delta, policy_state, beta_state, policy_state_running,
        ucb_replay, thompson_replay, replay_open_batch, linear_ucb_replay, thompson_long_log, replay_many_runs,
        own_policy, round_arms, accept_capped,
        closed_loop, closed_loop_regression, closed_loop_vectors, decision_log, curated_rows, regime_comparison, regime_curve,
        regime_summary, result_document, stream_loop, streamed_state,
    )
}
