"""Log-probability of texts under a unigram base and a causal self-attention model.

*Words.* All training words are counted in Spark. The most frequent ones go to the tasks as a
table of bounded size; the other words of a text, none of which is frequent, are joined with the
counts.

*Attention.* Texts become subword ids of a public tokenizer, once; the ids are written beside the
texts. One layer of causal self-attention reads ids, each with a vector of its own, and predicts the
next id. The ids are numbered by falling frequency and cut into groups: the probability of an id
is that of its group times its share in the group, both softmaxes over what stands before, so that
a step works on some hundred logits and not on all ids; the product sums to one over all ids. Ids
that no training text has share a unit, each with an equal part of its probability. Every
training text takes part once, in one of ``ROUNDS`` rounds chosen by a hash: every partition takes
Adam steps on its windows, and the weights are averaged by window counts after each round. Long texts
are scored in windows that overlap, and every id counts in one window only.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import utf8
from gleanspark.storage import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the rank file's tokenizer splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SMOOTHING = 0.1
ID_SMOOTHING = 0.1

# Words sent to the tasks, and distinct words a task holds before it hands its counts on.
HEAD_WORDS = 100_000
HELD_WORDS = 300_000
# Word spellings of which a task remembers the ids.
REMEMBERED = 200_000
HELD_TEXTS = 500

# Groups of ids for each square root of their number; under Zipf's law the least work.
GROUPS = 0.6
WIDTH = 16
WINDOW = 32
CONTEXT = 8
BATCH = 512
# Above any score of a trained model, below what float32 can raise e to.
MOST_LOGIT = 60
# Weights that Adam changes at a time, and that travel in one row.
PART = 1 << 16
# Ids a task learns from in a round, at the least, where there are more than cores do at once.
TASK_IDS = 5_000_000
ROUNDS = 3
RATE = 0.01
SEED = 42


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class Subwords:
    """Ids of words, each with the blank before it; the last id stands for the end.

    The ids of ``REMEMBERED`` spellings are remembered. The other words of a text are encoded together: a blank
    stands before each word only, so the ids that begin with one tell where a word's ids begin.
    """

    def __init__(self, ranks: bytes):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("lm", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.end = max(merges.values()) + 1
        self.kind = np.min_scalar_type(self.end)
        self.packed_end = self.kind.type(self.end).tobytes()
        self.begins = np.zeros(self.end, dtype=bool)
        self.begins[[i for token, i in merges.items() if token.startswith(b" ")]] = True
        self.known: dict[bytes, bytes] = {}

    def encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The packed ids of different words."""
        found, plain, texts = {}, [], []
        for word in words:
            text = word.decode("utf-8", "replace")
            # Blanks of other alphabets may stand in a word, and join with the one before the next.
            if text.isascii() or text.split() == [text]:
                plain.append(word)
                texts.append(text)
            else:
                found[word] = np.array(self.encoding.encode_ordinary(" " + text), dtype=self.kind).tobytes()
        if plain:
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(texts)), dtype=self.kind)
            packed, size = ids.tobytes(), self.kind.itemsize
            at = [*(np.flatnonzero(self.begins[ids]) * size).tolist(), len(packed)]
            found.update((word, packed[i:j]) for word, i, j in zip(plain, at, at[1:]))
        return found

    def packed(self, words: list[bytes]) -> bytes:
        """The ids of a text, as bytes of the smallest integers that hold them."""
        each = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(each) if ids is None]
        if new:
            found = self.encoded(list({words[i] for i in new}))
            for i in new:
                each[i] = found[words[i]]
            if len(self.known) < REMEMBERED:
                self.known.update(found)
        return b"".join(each) + self.packed_end


def tokenised(docs: DataFrame, held_out: Column, ranks) -> tuple[DataFrame, DataFrame]:
    """``doc, text, held, turn, ids``, written: the ids packed as the smallest integers that hold them.

    ``turn`` is the round a text trains in. Beside them, from the same pass over the texts that are not
    held out, (word, id, n): how often each word (id NULL) and each id (word NULL) occurs. The end of a text
    counts as the word NULL with the id -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(ranks.value)
        seen: Counter = Counter()
        counts, texts = np.zeros(subwords.end + 1, dtype=np.int64), 0

        def rows(schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def told(schema: pa.Schema):
            words = pa.array(seen.keys(), pa.binary()).cast(schema.field("word").type)
            yield rows(schema, word=words, n=pa.array(seen.values(), pa.int64()))
            seen.clear()

        schema = None
        for batch in batches:
            schema = pa.schema([*batch.schema, ("ids", pa.binary()), ("word", pa.string()), ("id", pa.int32()), ("n", pa.int64())])
            for part in slices(batch):
                packed = []
                # NULL is no training text, as in a filter.
                for text, held in zip(utf8(part.column("text")), part.column("held").to_pylist()):
                    words = words_of(text)
                    packed.append(subwords.packed(words))
                    if held is False:
                        seen.update(words)
                        np.add.at(counts, np.frombuffer(packed[-1], dtype=subwords.kind), 1)
                        texts += 1
                        if len(seen) > HELD_WORDS:
                            yield from told(schema)
                yield rows(schema, **dict(zip(part.schema.names, part.columns)), ids=pa.array(packed, pa.binary()))
        if texts:
            yield from told(schema)
            used = np.flatnonzero(counts)
            yield rows(schema, id=pa.array(np.append(used, -1), pa.int32()), n=pa.array(np.append(counts[used], texts), pa.int64()))

    turn = F.pmod(F.xxhash64("doc", "text"), F.lit(ROUNDS)).cast("int")
    given = docs.select("doc", "text", held_out.alias("held"), turn.alias("turn"))
    kinds = ", ".join(f"`{n}` {kind}" for n, kind in given.dtypes)
    both = materialize(given.mapInArrow(run, f"{kinds}, ids binary, word string, id int, n bigint"), "lm-ids")
    told = both.filter("turn IS NULL").groupBy("word", "id").agg(F.sum("n").alias("n"))
    return both.filter("turn IS NOT NULL").select("doc", "text", "held", "turn", "ids"), told


def groups(units: int) -> np.ndarray:
    """Where the groups of ids begin, and the end: each a little longer than the one before."""
    number = max(1, round(GROUPS * units**0.5))
    return np.unique(np.round((np.arange(number + 1) / number) ** 2 * units).astype(int))


def shares(z: np.ndarray, chosen: np.ndarray, softmax: bool = True) -> np.ndarray:
    """Logarithm of the softmax at the chosen column of each row; ``z`` becomes the softmax if asked for."""
    # A pass by rows is needed only where e can't be raised to the numbers as they are.
    if not (z.max() < MOST_LOGIT and z.min() > -MOST_LOGIT):
        z -= z.max(axis=1, keepdims=True)
    found = z[np.arange(len(z)), chosen]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], dtype=z.dtype)
    if softmax:
        z /= total[:, None]
    return found - np.log(total)


class Attention:
    """One layer of causal self-attention over ids by falling frequency, with its gradients."""

    def __init__(self, weights: np.ndarray, units: int):
        self.units, d = units, WIDTH
        self.bounds = groups(units)
        sizes = np.diff(self.bounds)
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        shapes = {
            "embed": (units + 1, d), "place": (WINDOW, d), "query": (d, d), "key": (d, d),
            "value": (d, d), "near": (len(sizes), d), "out": (units, d), "near_bias": (len(sizes),), "bias": (units,),
        }
        self.flat, at = weights, 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            setattr(self, name, weights[at : at + size].reshape(shape))
            at += size
        self.size = at

    @staticmethod
    def fresh(share: np.ndarray) -> np.ndarray:
        """Starting weights: small random numbers, and the logarithms of the groups' and ids' shares."""
        units, bounds = len(share), groups(len(share))
        of_group = np.add.reduceat(share, bounds[:-1])
        size = (units + 1 + WINDOW + len(of_group) + units) * WIDTH + 3 * WIDTH**2
        start = np.random.default_rng(SEED).normal(0, WIDTH**-0.5 / 2, size)
        within = share / np.repeat(of_group, np.diff(bounds))
        return np.concatenate([start, np.log(of_group), np.log(within)]).astype(np.float32)

    def log_probabilities(self, units: np.ndarray, nexts: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Of the nexts that count, row by row; as :meth:`forward`, with fewer passes.

        What each unit and each place adds to x and its three projections is worked out once.
        """
        (b, t), d, one = units.shape, WIDTH, np.float32(1)
        scale = np.float32(WIDTH**-0.5)
        mix = np.hstack([np.eye(d, dtype=np.float32), self.query * scale, self.key, self.value])
        met, at = np.unique(units, return_inverse=True)
        x = (self.embed[met] @ mix).take(at.ravel(), axis=0).reshape(b, t, 4 * d)
        x += self.place[:t] @ mix
        a = x[:, :, d : 2 * d] @ x[:, :, 2 * d : 3 * d].transpose(0, 2, 1)
        np.exp(np.minimum(a, MOST_LOGIT, out=a), out=a)
        a *= np.tri(t, dtype=np.float32)
        seen = a @ x[:, :, 3 * d :]
        seen /= (a.reshape(-1, t) @ np.full(t, one)).reshape(b, t, 1)
        seen += x[:, :, :d]
        rows = np.flatnonzero(counted)
        return self.predicted(seen.reshape(-1, d).take(rows, axis=0), nexts.ravel().take(rows))

    def states(self, units: np.ndarray):
        """What each place knows of the ids up to it, and what the gradients need."""
        (b, t), d = units.shape, WIDTH
        x = self.embed.take(units.ravel(), axis=0).reshape(b, t, d)
        x += self.place[:t]
        rows = x.reshape(-1, d)
        q, k, v = ((rows @ m).reshape(b, t, d) for m in (self.query * np.float32(d**-0.5), self.key, self.value))
        a = q @ k.transpose(0, 2, 1)
        np.exp(np.minimum(a, MOST_LOGIT, out=a), out=a)
        a *= np.tri(t, dtype=a.dtype)
        a /= (a.reshape(-1, t) @ np.ones(t, dtype=a.dtype)).reshape(b, t, 1)
        h = a @ v
        h += x
        return h, (x, q, k, v, a)

    def predicted(self, h: np.ndarray, nexts: np.ndarray, grad: Attention | None = None, dh: np.ndarray | None = None):
        """Log-probabilities of the nexts after the states ``h``: of the group, and within it.

        With ``grad``, the gradients of their negative mean are put there and into ``dh``.
        """
        group = self.group[nexts]
        z = h @ self.near.T
        z += self.near_bias
        found = shares(z, group, grad is not None)
        if grad is not None:
            z[np.arange(len(z)), group] -= 1
            z *= z.dtype.type(1 / len(h))
            grad.near[:], grad.near_bias[:] = z.T @ h, np.ones(len(z), dtype=z.dtype) @ z
            np.matmul(z, self.near, out=dh)
        order = np.argsort(group.astype(np.int16), kind="stable")
        begins = np.flatnonzero(np.diff(group[order], prepend=-1))
        for rows in np.split(order, begins[1:]):
            if not len(rows):
                continue
            low, high = self.bounds[group[rows[0]]], self.bounds[group[rows[0]] + 1]
            states, chosen = h[rows], nexts[rows] - low
            z = states @ self.out[low:high].T
            z += self.bias[low:high]
            found[rows] += shares(z, chosen, grad is not None)
            if grad is not None:
                z[np.arange(len(z)), chosen] -= 1
                z *= z.dtype.type(1 / len(h))
                grad.out[low:high], grad.bias[low:high] = z.T @ states, np.ones(len(z), dtype=z.dtype) @ z
                dh[rows] += z @ self.out[low:high]
        return found

    def forward(self, units: np.ndarray):
        """Log-probabilities of every next id at each place, and what the gradients need."""
        h, kept = self.states(units)
        rows = h.reshape(-1, WIDTH)
        each = [self.predicted(rows, np.full(len(rows), unit)) for unit in range(self.units)]
        return np.stack(each, axis=1).reshape(*units.shape, self.units), kept

    def gradient(self, units: np.ndarray, nexts: np.ndarray, counted: np.ndarray) -> np.ndarray:
        h, (x, q, k, v, a) = self.states(units)
        grad = Attention(np.zeros_like(self.flat), self.units)
        rows = np.flatnonzero(counted)
        flat = lambda m: m.reshape(-1, m.shape[-1])
        dh, part = np.zeros_like(h), np.empty((len(rows), WIDTH), dtype=h.dtype)
        self.predicted(flat(h).take(rows, axis=0), nexts.ravel().take(rows), grad, part)
        flat(dh)[rows] = part
        da, dv = dh @ v.transpose(0, 2, 1), a.transpose(0, 2, 1) @ dh
        # The mean of a row of da by its weights is what the state has of the values, times dh.
        da -= np.einsum("btd,btd->bt", dh, h - x)[:, :, None]
        da *= a
        scale = np.float32(WIDTH**-0.5)
        # The queries are held with the scale on them.
        dq, dk = da @ k, da.transpose(0, 2, 1) @ q
        dq *= scale
        dx = flat(dh)
        for name, d in (("query", dq), ("key", dk), ("value", dv)):
            getattr(grad, name)[:] = flat(x).T @ flat(d)
            dx += flat(d) @ getattr(self, name).T
        grad.place[: x.shape[1]] = dh.sum(axis=0)
        short = units.ravel().astype(np.min_scalar_type(self.units))
        order = np.argsort(short, kind="stable")
        short = short.take(order)
        first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        grad.embed[short.take(first)] = np.add.reduceat(dx.take(order, axis=0), first)
        return grad.flat


def adam(model: Attention, batches: Iterator[tuple]) -> int:
    """Steps of Adam over the batches, in place; gives the number of windows."""
    means, squares, steps, windows = np.zeros_like(model.flat), np.zeros_like(model.flat), 0, 0
    for batch in batches:
        gradient = model.gradient(*batch)
        steps, windows = steps + 1, windows + len(batch[0])
        # In parts that stay in the processor's cache.
        for at in range(0, len(gradient), PART):
            g, mean, square = (m[at : at + PART] for m in (gradient, means, squares))
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            model.flat[at : at + PART] -= RATE * (mean / (1 - 0.9**steps)) / (np.sqrt(square / (1 - 0.99**steps)) + 1e-8)
    return windows


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first place, first place that counts) of the windows over texts of these lengths.

    The first window of a text counts from its start, later ones after ``CONTEXT`` places; every
    place counts once.
    """
    step = WINDOW - CONTEXT
    number = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
    text = np.repeat(np.arange(len(lengths)), number)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    return text, turn * step, np.where(turn > 0, CONTEXT, 0)


def cut(units: list[np.ndarray], start: int) -> Iterator[tuple]:
    """Batches of windows over texts: inputs, nexts, which count, and the places of the nexts.

    ``start`` is the unit that stands before a text.
    """
    lengths = np.array([len(u) for u in units])
    if not len(lengths):
        return
    flat, first = np.concatenate(units), np.cumsum(lengths) - lengths
    before = np.concatenate([[start], flat[:-1]])
    before[first] = start
    text, at, counts_from = windows(lengths)
    for i in range(0, len(text), BATCH):
        t, a = text[i : i + BATCH, None], at[i : i + BATCH, None]
        inside = np.arange(WINDOW)[None, :]
        within = a + inside < lengths[t]
        place = np.minimum(first[t] + a + inside, len(flat) - 1)
        counted = within & (inside >= counts_from[i : i + BATCH, None])
        yield np.where(within, before[place], start), flat[place], counted, place


def unit_table(id_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every id by falling frequency, and the shares of the ids in that order."""
    smooth = id_counts + ID_SMOOTHING
    order = np.argsort(-smooth, kind="stable")
    unit = np.empty(len(smooth), dtype=np.int32)
    unit[order] = np.arange(len(smooth), dtype=np.int32)
    return unit, smooth[order] / smooth.sum()


def seen_units(unit: np.ndarray, share: np.ndarray, id_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The table with one unit for all ids that no training text has, and the number of these ids.

    Nothing learned can tell such ids apart, so each has an equal part of their unit's probability.
    """
    seen = int(np.count_nonzero(id_counts))
    unseen = len(share) - seen
    if not unseen:
        return unit, share, 0
    return np.minimum(unit, seen).astype(unit.dtype), np.append(share[:seen], share[seen:].sum()), unseen


def averaged(texts: DataFrame, unit, weights: np.ndarray, units: int) -> np.ndarray | None:
    """One round: steps in every partition from ``weights``, then the mean by windows; None without texts."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    schema = "part int, n bigint, weights binary"
    parts = -(-len(weights) // PART)

    def rows(n: int, of: dict[int, np.ndarray]) -> pa.RecordBatch:
        values = [v.astype(np.float32).tobytes() for v in of.values()]
        arrays = [pa.array(list(of), pa.int32()), pa.array([n] * len(of), pa.int64()), pa.array(values, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["part", "n", "weights"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Attention(shared.value.copy(), units)
        kind = np.min_scalar_type(len(unit.value) - 1)

        def steps():
            for batch in batches:
                for part in slices(batch):
                    found = [unit.value[np.frombuffer(i.as_buffer(), dtype=kind)] for i in part.column("ids")]
                    for inputs, nexts, counted, _ in cut(found, units):
                        yield inputs, nexts, counted

        n = adam(model, steps())
        if n:
            yield rows(n, {k: model.flat[k * PART : (k + 1) * PART] for k in range(parts)})

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = Counter(), {}
        for batch in batches:
            for part, n, values in zip(*(batch.column(c) for c in ("part", "n", "weights"))):
                k, n = part.as_py(), n.as_py()
                total[k] += n
                sums[k] = sums.get(k, 0.0) + n * np.frombuffer(values.as_buffer(), dtype=np.float32).astype(np.float64)
        yield rows(0, {k: v / total[k] for k, v in sums.items()})

    told = texts.select("ids").mapInArrow(train, schema).repartition(parts, "part").mapInArrow(mean, schema).collect()
    if not told:
        return None
    return np.concatenate([np.frombuffer(r["weights"], dtype=np.float32) for r in sorted(told, key=lambda r: r["part"])])


def fitted(training: DataFrame, unit: np.ndarray, share: np.ndarray, ids: int) -> np.ndarray | None:
    """Weights after one pass over all texts, a part of them in each round; None without texts.

    ``ids`` are the ids of all texts. A task hands on all weights, so a task gets many ids, but no core
    stays without one.
    """
    context = training.sparkSession.sparkContext
    shared, cores = context.broadcast(unit), context.defaultParallelism
    tasks = cores * -(-ids // (cores * ROUNDS * TASK_IDS))
    weights = None
    for k in range(ROUNDS):
        start = Attention.fresh(share) if weights is None else weights
        found = averaged(training.filter(F.col("turn") == k).coalesce(max(1, tasks)), shared, start, len(share))
        weights = weights if found is None else found
    return weights


def head_count(words: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, up to a fraction of a power of two.

    Only a histogram with a few hundred bins comes to the driver.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    bins = dict(map(tuple, words.groupBy(step.alias("step")).count().collect()))
    found, least = 0, max(bins, default=0) + 1
    for b in sorted(bins, reverse=True):
        found += bins[b]
        if found > most:
            break
        least = b
    return int(np.ceil(2 ** (least / 16)))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``HELD_TEXTS`` texts, which bounds what a task holds at once."""
    for start in range(0, batch.num_rows, HELD_TEXTS):
        yield batch.slice(start, HELD_TEXTS)


class Head(dict):
    """Logarithms of frequent words; another word counts zero here and is noted in ``missed``."""

    def __init__(self, values: dict):
        super().__init__(values)
        self.missed: list[bytes] = []

    def __missing__(self, word: bytes) -> float:
        self.missed.append(word)
        return 0.0


SCORED = (
    "key bigint, doc bigint, n_tokens bigint, n_known bigint, base double, score double, "
    "word string, times bigint"
)


def scored(docs: DataFrame, head: dict, floor: float, model: dict) -> DataFrame:
    """A row per text of ``tokenised`` ones, and one per text and word that is not in ``head``.

    ``key`` numbers the texts; the two kinds of row come from one run of a task, so they fit.
    """
    shared = docs.sparkSession.sparkContext.broadcast((head, floor, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        head, floor, model = shared.value
        end, head = head[None], Head(head)
        unit, units = model["unit"], model["units"]
        kind = np.min_scalar_type(len(unit) - 1)
        attention = Attention(model["weights"], units)
        key = TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole)):
            texts, word_keys, names, times = [], [], [], []
            ids = [unit[np.frombuffer(i.as_buffer(), dtype=kind)] for i in batch.column("ids")]
            for doc, text in zip(batch.column("doc").to_pylist(), utf8(batch.column("text"))):
                key += 1
                words = words_of(text)
                base = sum(map(head.__getitem__, words), end)
                # A word of the head occurs in training.
                texts.append([key, doc, len(words) + 1, len(words) - len(head.missed) + (end > floor), base])
                tail = Counter(head.missed)
                head.missed.clear()
                word_keys += [key] * len(tail)
                names += tail
                times += tail.values()
            totals = np.zeros(len(ids))
            if ids:
                owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
                for inputs, nexts, counted, place in cut(ids, units):
                    value = attention.log_probabilities(inputs, nexts, counted) / np.log(10)
                    totals += np.bincount(owner[place[counted]], value, len(ids))
                if model["unseen"]:
                    totals -= np.log10(model["unseen"]) * np.array([np.count_nonzero(i == units - 1) for i in ids])
            columns = list(zip(*texts)) if texts else [[]] * 5
            n, m = len(texts), len(names)
            arrays = [list(columns[0]) + word_keys, *[list(c) + [None] * m for c in columns[1:]],
                      totals.tolist() + [None] * m, pa.array([None] * n + names, pa.binary()), [None] * n + times]
            schema = to_arrow_schema(wanted)
            arrays = [a.cast(f.type) if f.name == "word" else pa.array(a, f.type) for a, f in zip(arrays, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    wanted = docs.sparkSession.createDataFrame([], SCORED).schema
    return docs.select("doc", "text", "ids").mapInArrow(run, wanted)


def log_probabilities(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Texts that are not ``held_out`` (a condition on ``doc``, the id) train both models. NULL and
    empty texts consist of their end alone; repeated rows count and are scored as often as they
    occur; their ``score`` agrees up to the rounding of the batch it is computed in. Without training
    texts ``score`` is NULL. ``score`` reads words joined by single blanks. Other columns are not read.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    with open(tokenizer, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    end = Subwords(ranks.value).end
    texts, told = tokenised(plain, held_out, ranks)
    training = texts.filter(~F.col("held"))
    counted = materialize(told, "lm-counts")

    words = counted.filter("id IS NULL").select("word", "n")
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    by_id = counted.filter("id IS NOT NULL").select("id", "n").toArrow()
    id_counts = np.zeros(end + 1)
    found, n = by_id["id"].to_numpy(), by_id["n"].to_numpy()
    id_counts[found[found >= 0]] = n[found >= 0]
    ends = int(n[found < 0].sum())
    total, kinds = n_words + ends, distinct + (ends > 0)
    below = total + SMOOTHING * (kinds + 1)
    log_of = lambda c: float(np.log10((c + SMOOTHING) / below))

    top = words.filter(F.col("n") >= head_count(words, HEAD_WORDS)).collect()
    head = {r["word"].encode(): log_of(r["n"]) for r in top} | {None: log_of(ends)}
    unit, share, unseen = seen_units(*unit_table(id_counts), id_counts)
    weights = fitted(training, unit, share, int(id_counts.sum()))
    model = {
        "unit": unit, "units": len(share), "unseen": unseen,
        "weights": Attention.fresh(share) if weights is None else weights,
    }
    rows = materialize(scored(texts, head, log_of(0), model), "lm-scored")

    tail = rows.filter("word IS NOT NULL").select("key", "word", "times")
    c = F.coalesce("n", F.lit(0))
    met = tail.join(words, "word", "left").groupBy("key").agg(
        F.sum(F.col("times") * F.log10((c + SMOOTHING) / F.lit(below))).alias("more"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
    )
    whole = rows.filter("word IS NULL").drop("word", "times")
    return whole.join(met, "key", "left").select(
        F.col("doc").alias(id_col), held_out.alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.lit(None).cast("double") if weights is None else F.col("score")).alias("score"),
    )
