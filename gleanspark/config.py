"""Settings of a selection run, passed explicitly to whatever needs them."""

from __future__ import annotations

from dataclasses import dataclass

# The default sizes and constants a run is defined by.
NUM_CLASSES = 2
LABEL_NAMES = ("negative", "positive")
TRAIN_SIZE = 500
VAL_SIZE = 200
TEST_SIZE = 200
POOL_SIZE = 1000
TARGET_SIZE = 300
BATCH_SIZE = 50
MAX_TOKENS = 128
UCB_ALPHA = 1.0
MAX_ROUNDS = 20
SEED = 42
EPSILON = 1e-9

# Ours, not fixed by the definition of a run.
EMBEDDING_DIM = 64


@dataclass(frozen=True)
class SelectionConfig:
    """``batch_size`` should grow with the pool: rounds stay few, not rows per round.

    Whole texts are read unless ``max_tokens`` limits the words of each.
    """

    num_classes: int = NUM_CLASSES
    target_size: int = TARGET_SIZE
    batch_size: int = BATCH_SIZE
    max_rounds: int = MAX_ROUNDS
    max_tokens: int | None = None
    embedding_dim: int = EMBEDDING_DIM
    policy: str = "ucb"
    ucb_alpha: float = UCB_ALPHA
    seed: int = SEED

    def __post_init__(self):
        if self.num_classes < 1:
            raise ValueError("num_classes must be at least 1")
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        if self.target_size < 0 or self.max_rounds < 0:
            raise ValueError("target_size and max_rounds cannot be negative")
