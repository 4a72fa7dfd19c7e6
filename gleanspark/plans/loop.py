"""The closed selection loop: batch, score, decide, cap, refit, reward, update.

Every round is a handful of DataFrame jobs whose results are tables under one folder: the
pool with its order, the decisions, the models and the round log. Only single numbers come
to the driver. A run that was interrupted goes on behind the last round in the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.config import SelectionConfig
from gleanspark.functions.vectors import as_doubles
from gleanspark.operators.learner import Learner, Model, NaiveBayes
from gleanspark.operators.metrics import accepted_counts, arm_context
from gleanspark.operators.ordering import first_in_order, in_batches
from gleanspark.operators.policy import Policy, make_policy, state_literals
from gleanspark.operators.rewards import folded
from gleanspark.plans.regimes import compare_regimes, validation_f1
from gleanspark.plans.scoring import trusted_set, with_novelty, with_signals, with_tokens
from gleanspark.sources.labelled import union_all, unique
from gleanspark.storage import fresh_path, is_complete, write_table, written_once

VECTOR = "vector array<double>"
REAL_SCHEMA = "id bigint, label int, split string, tokens array<string>"
STAGED_SCHEMA = (
    "cand_id bigint, text string, label int, t bigint, tokens array<string>, novelty double, "
    "batch_no int"
)
ITERATION_SCHEMA = (
    "iteration int, n_batch bigint, n_accepted bigint, curated_total bigint, val_f1 double, "
    "reward double, arm int, cutoff bigint, model_round int, context array<double>"
)
DECISION_SCHEMA = (
    "cand_id bigint, t bigint, label int, uncertainty double, novelty double, "
    "verifier double, weight double, action int"
)


def policy_of(config: SelectionConfig) -> Policy:
    options = {"ucb": {"alpha": config.ucb_alpha}, "thompson": {"seed": config.seed}}
    return make_policy(config.policy, **options.get(config.policy, {}))


class SelectionRun:
    """One run over ``real(id, text, label, split)``, kept under ``folder``.

    Where ``real`` has a column ``vector``, novelty is measured on it and the pool has to bring one
    too, as from :func:`gleanspark.operators.embedding.embed_with`; it is written with the table,
    so an embedding model sees each text once.
    """

    def __init__(
        self,
        spark: SparkSession,
        real: DataFrame,
        config: SelectionConfig,
        folder: str | None = None,
        policy: Policy | None = None,
        learner: Learner | None = None,
    ):
        self.spark, self.config = spark, config
        self.learner = learner or NaiveBayes()
        self.own_vectors = "vector" in real.columns
        brought = ["vector"] if self.own_vectors else []
        self.policy = policy or policy_of(config)
        self._held = None
        self.folder = (folder or fresh_path(spark, "run")).rstrip("/")
        self.real = written_once(
            spark,
            f"{self.folder}/real",
            REAL_SCHEMA + (f", {VECTOR}" if self.own_vectors else ""),
            lambda: with_tokens(unique(real, "id"), config).select(
                "id", "label", "split", "tokens", *[as_doubles(F.col(c)).alias(c) for c in brought]
            ),
        )
        self.train = self.real.filter("split = 'train'")
        self.trusted = trusted_set(self.train.select("id", "tokens", *brought), config)
        if not self._played(0):
            self._first_fit()

    # Tables of the run.

    def _path(self, table: str, iteration: int) -> str:
        return f"{self.folder}/{table}/iteration={iteration}"

    def _table(self, table: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(f"{schema}, iteration int" if table != "rounds" else schema)
        return reader.option("basePath", f"{self.folder}/{table}").parquet(
            f"{self.folder}/{table}"
        )

    @property
    def rounds(self) -> DataFrame:
        """The round log; round 0 is the first fit and has neither batch nor reward."""
        return self._table("rounds", ITERATION_SCHEMA)

    @property
    def decisions(self) -> DataFrame:
        """Every decision of every finished round, with ``kept`` for rows inside the target."""
        last = self._last_round()
        if not last:
            return self.spark.createDataFrame([], f"{DECISION_SCHEMA}, iteration int, kept boolean")
        cutoff = self.rounds.agg(F.min("cutoff")).first()[0]
        kept = F.col("action") == 1
        if cutoff is not None:
            kept = kept & (F.col("t") <= cutoff)
        finished = self._table("decisions", DECISION_SCHEMA).filter(F.col("iteration") <= last)
        return finished.withColumn("kept", kept)

    def undecided(self) -> int:
        """Staged candidates that no round has decided: behind the target or the last round."""
        return self.pool.count() - self.rounds.agg(F.sum("n_batch")).first()[0]

    @property
    def pool(self) -> DataFrame:
        return self.spark.read.schema(STAGED_SCHEMA).parquet(f"{self.folder}/pool")

    def curated(self) -> DataFrame:
        """The accepted rows with their texts; batches that were not played are not read."""
        kept = self.decisions.filter("kept").selectExpr("cand_id", "iteration AS batch_no", "t")
        texts = self.pool.select("cand_id", "batch_no", "text", "label")
        return kept.join(texts, ["cand_id", "batch_no"]).withColumnRenamed("batch_no", "iteration")

    def _accepted_before(self, iteration: int) -> DataFrame:
        """``label, tokens`` of the rows kept in earlier rounds."""
        kept = self.decisions.filter(F.col("kept") & (F.col("iteration") < iteration))
        kept = kept.selectExpr("cand_id", "iteration AS batch_no")
        return self.pool.join(kept, ["cand_id", "batch_no"]).select("label", "tokens")

    # Single numbers.

    def _played(self, iteration: int) -> bool:
        return is_complete(self.spark, self._path("rounds", iteration))

    def _round(self, iteration: int):
        return self.rounds.filter(F.col("iteration") == iteration).first()

    def _last_round(self) -> int:
        return self.rounds.agg(F.max("iteration")).first()[0]

    def _model(self, model_round: int) -> Model:
        if self._held is None or self._held[0] != model_round:
            self._held = model_round, self.learner.load(self.spark, self._path("models", model_round))
        return self._held[1]

    def _training(self, *more: DataFrame) -> DataFrame:
        return union_all(*[rows.select("label", "tokens") for rows in (self.train, *more)])

    def _log(self, iteration: int, **values) -> dict:
        row = {
            "iteration": iteration, "n_batch": 0, "n_accepted": 0, "curated_total": 0,
            "reward": None, "arm": None, "cutoff": None, "model_round": iteration, "context": None, **values,
        }
        fields = [f.split() for f in ITERATION_SCHEMA.split(", ") if not f.startswith("iteration")]
        one = self.spark.range(0, 1, 1, 1).select(
            *[F.lit(row[name]).cast(kind).alias(name) for name, kind in fields]
        )
        write_table(one, self._path("rounds", iteration))
        return row

    # Steps.

    def _first_fit(self) -> None:
        model = self.learner.fit(self._training(), self.config.num_classes, self._path("models", 0))
        self._held = 0, model
        self._log(0, val_f1=validation_f1(self.real, model))

    def candidates(self, pool: DataFrame) -> DataFrame:
        """``cand_id, text, label`` of a pool, and its vectors where the trusted rows have some."""
        if self.own_vectors != ("vector" in pool.columns):
            raise ValueError("trusted rows and candidates need vectors of their own, or neither")
        return pool.select("cand_id", "text", "label", *["vector"] * self.own_vectors)

    def stage(self, pool: DataFrame) -> DataFrame:
        """Order ``pool(cand_id, text, label)`` and score its novelty, once for all rounds."""

        def build() -> DataFrame:
            ordered = in_batches(
                unique(self.candidates(pool), "cand_id"),
                "cand_id",
                self.config.batch_size,
                self.config.seed,
            )
            return with_novelty(with_tokens(ordered, self.config), self.trusted, self.config)

        return written_once(self.spark, f"{self.folder}/pool", STAGED_SCHEMA, build, "batch_no")

    def finished(self, last) -> bool:
        return last["curated_total"] >= self.config.target_size

    def play(self, iteration: int, batch: DataFrame, last) -> dict | None:
        """Play one round on a staged batch, given the log row before; None for no rows."""
        model = self._model(last["model_round"])
        log = self.rounds.filter(F.col("iteration").between(1, iteration - 1))
        state = folded(log, self.policy.tallies(), self.policy.finish()).first().asDict()
        scored = with_signals(batch, model, ("t",))
        action = self.policy.action(
            state_literals(state, self.policy), F.col("t"), F.col("weight"), F.col("cand_id")
        )
        columns = [c.split()[0] for c in DECISION_SCHEMA.split(", ")]
        decided = write_table(
            scored.withColumn("action", action).select(*columns),
            self._path("decisions", iteration),
        )
        context = arm_context(("uncertainty", "novelty", "verifier"))
        seen = accepted_counts(decided, more=[context.alias("context")]).first()
        if not seen["n_batch"]:
            return None

        accepted, cutoff = decided.filter("action = 1"), None
        room = self.config.target_size - last["curated_total"]
        if seen["n_accepted"] > room:
            cutoff = first_in_order(accepted, "t", room).agg(F.max("t")).first()[0]
            accepted = accepted.filter(F.col("t") <= cutoff)
        values = {
            "n_batch": seen["n_batch"],
            "n_accepted": seen["n_accepted"],
            "curated_total": last["curated_total"] + min(seen["n_accepted"], room),
            "arm": seen["arm"],
            "cutoff": cutoff,
            "context": seen["context"],
        }
        if not seen["n_accepted"]:
            # The training set is the same, so a fresh fit would be the same model.
            values |= {"val_f1": last["val_f1"], "model_round": last["model_round"]}
        else:
            kept = batch.join(accepted.select("cand_id"), "cand_id", "left_semi")
            whole = lambda: self._training(self._accepted_before(iteration), kept)
            added = kept.select("label", "tokens")
            model = self.learner.grow(model, added, whole, self._path("models", iteration))
            self._held = iteration, model
            values["val_f1"] = validation_f1(self.real, model)
        return self._log(iteration, reward=values["val_f1"] - last["val_f1"], **values)

    def run(self, pool: DataFrame) -> "SelectionRun":
        """Play rounds until the target is reached, the pool is empty or rounds run out."""
        staged = self.stage(pool)
        done = self._last_round()
        last = self._round(done).asDict()
        for iteration in range(done + 1, self.config.max_rounds + 1):
            if self.finished(last):
                break
            batch = staged.filter(F.col("batch_no") == iteration)
            played = self.play(iteration, batch, last)
            if played is None:
                break
            last = played
        return self

    def regimes(self) -> DataFrame:
        """``regime, val_f1, test_f1``: trusted rows only, with the whole pool, with the curated."""
        curated = self._model(self._round(self._last_round())["model_round"])
        first = self._model(0)
        # A pool only grows, by what a stream adds, and an earlier result may still read its model.
        path = f"{self.folder}/naive_model/rows={self.pool.count()}"
        if is_complete(self.spark, path):
            naive = self.learner.load(self.spark, path)
        else:
            added = self.pool.select("label", "tokens")
            naive = self.learner.grow(first, added, lambda: self._training(self.pool), path)
        return compare_regimes(
            self.real,
            {"real_only": first, "naive_augmentation": naive, "bandit_guided": curated},
        )
