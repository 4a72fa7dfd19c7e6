"""Personal data in texts, with DataFrame functions alone.

*Base spans* follow fixed formats: email, ip, card, phone. *Candidates* come from wide generators
and may overlap. Boosted trees score every candidate per kind, from its format and context; a
threshold calibrated on the held-out half of the texts decides which of them join the base spans.

Labels are distant: a candidate counts as a kind if it overlaps a base span of it. Every feature
has few values, so the candidates of all texts boil down to a table of counts whose size the
features bound; the trees are grown from that table and become column expressions again.

A regular expression runs over the text at most twice: for its hits, and, where it has any, for
the gaps between them, whose lengths give the positions. All repetitions are possessive or over
single characters, and no hit starts inside a run that was tried already, so a long text
neither overflows the stack nor takes quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import shelters
from gleanspark.storage import materialize

LOCAL = "[A-Za-z0-9._%+-]"
# A match starts where the last one ended or where a run starts.
MAIL_START = rf"(?:\G|(?<!{LOCAL}))"
SPAN = "array<struct<start: int, end: int, hit: string>>"

TREES = 12
DEPTH = 2
RATE = 0.4
PRECISION = 0.98
MIN_SUPPORT = 20
CONTEXT = 24

digits_of = lambda hit: F.regexp_replace(hit, "[^0-9]", "")


def octets(hit: Column) -> Column:
    """Every part is at most 255, leading zeros aside."""
    part = lambda p: F.regexp_replace(p, "^0+", "")
    small = lambda p: (F.length(part(p)) < 3) | (
        (F.length(part(p)) == 3) & (F.substring(part(p), 1, 3) <= "255")
    )
    return F.forall(F.split(hit, r"\.", -1), small)


@dataclass(frozen=True)
class Pattern:
    """A format: hits of ``regex`` that pass ``valid``; ``guard`` tells texts without any hit."""

    name: str
    regex: str
    guard: str
    valid: Callable[[Column], Column] = field(default=lambda hit: F.lit(True))

    def accepts(self, span: Column) -> Column:
        return self.valid(span["hit"])


# The formats of the base spans, in the order they are listed in. The card pattern
# asks for 13 digits at once: a shorter run fails as a whole and none of its tails can pass.
BASE = (
    Pattern("email", rf"{MAIL_START}{LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Pattern("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", octets),
    Pattern(
        "card", r"[0-9](?:[\x20-]?[0-9]){12,}+", "[0-9]",
        lambda hit: F.length(digits_of(hit)).between(13, 19) & F.call_function("luhn_check", digits_of(hit)),
    ),
    Pattern(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]",
        lambda hit: F.length(digits_of(hit)).between(9, 15),
    ),
)
KINDS = tuple(p.name for p in BASE)

# Generators of candidates: runs of digits with separators, and addresses with words for signs.
WIDE = (
    Pattern("numbers", r"\+?+\(?+[0-9](?:[().\x20/_-]{0,3}+[0-9]){6,}+", "[0-9]"),
    Pattern(
        "address",
        rf"{MAIL_START}{LOCAL}++(?:\x20?+[\[(]at[\])]\x20?+|@)[A-Za-z0-9-]++"
        r"(?:(?:\.|\x20?+[\[(]dot[\])]\x20?+)[A-Za-z0-9-]++)*+",
        r"@|[\[(]at[\])]",
    ),
)

# Words before a span that speak for a kind, one number each.
CUES = (
    r"(?i)(mail|contact|courriel|correo)\W*$",
    r"(?i)(phone|tel|call|fax|mobile|t[ée]l[ée]phone|telefon|tel[ée]fono)\W*$",
    r"(?i)(card|visa|account|carte|karte|tarjeta)\W*$",
    r"(?i)(ip|host|server|address|adresse)\W*$",
)


def placed(gaps: Column, hits: Column) -> Column:
    """Spans of the hits, from what lies between them."""
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, none, step, lambda done: done["out"])


def with_spans(docs: DataFrame, text_col: str, patterns: tuple[Pattern, ...]) -> DataFrame:
    """``docs`` with ``__<name>``, the valid spans of each pattern; none for NULL."""
    text, none = F.col(text_col), F.array().cast("array<string>")
    hits = {p.name: f"__{p.name}_hits" for p in patterns}
    docs = docs.select("*", *[
        F.when(text.rlike(p.guard), F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)))
        .otherwise(none).alias(hits[p.name]) for p in patterns
    ])
    found = [
        F.when(
            F.size(hits[p.name]) > 0,
            F.filter(placed(F.split(text, p.regex, -1), F.col(hits[p.name])), p.accepts),
        ).otherwise(F.array().cast(SPAN)).alias(f"__{p.name}") for p in patterns
    ]
    return docs.select(*[c for c in docs.columns if c not in hits.values()], *found)


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def step_of(value: Column, *edges: int) -> Column:
    """Number of edges that ``value`` reaches."""
    return reduce(lambda a, b: a + b, [(value >= e).cast("int") for e in edges])


def features(text: Column, span: Column) -> dict[str, Column]:
    """Format and context of a span; 69,120 different rows at most."""
    hit = span["hit"]
    count = lambda letters: F.length(F.regexp_replace(hit, f"[^{letters}]", ""))
    around = lambda c: F.when(c.rlike("[A-Za-z]"), 1).when(c.rlike(r"[^\s]"), 2).otherwise(0)
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
    cue = reduce(
        lambda rest, i: F.when(before.rlike(CUES[i]), i + 1).otherwise(rest),
        reversed(range(len(CUES))), F.lit(0),
    )
    return {
        "digits": step_of(count("0-9"), 4, 7, 9, 13, 20),
        "dots": step_of(count("."), 1, 3, 4),
        "at": hit.contains("@").cast("int"),
        "plus": hit.startswith("+").cast("int"),
        "breaks": step_of(count(r"\x20()/_-"), 1, 3, 5),
        "longest": step_of(F.array_max(F.transform(F.split(hit, "[^0-9]+", -1), F.length)), 4, 9, 13),
        "left": around(F.substring(text, span["start"], F.lit(1))),
        "right": around(F.substring(text, span["end"] + 1, F.lit(1))),
        "cue": cue,
    }


FEATURES = ("digits", "dots", "at", "plus", "breaks", "longest", "left", "right", "cue")


def annotated(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the base spans of each kind and ``__found``, the candidates."""
    own = {f"__{p.name}" for p in BASE + WIDE} | {"__found"}
    docs = with_spans(docs.select(*[c for c in docs.columns if c not in own]), text_col, BASE + WIDE)
    text = F.col(text_col)

    def described(span: Column) -> Column:
        meets = lambda known: overlap(span, known)
        labels = [F.exists(f"__{k}", meets).cast("int").alias(f"is_{k}") for k in KINDS]
        parts = [f.alias(n) for n, f in features(text, span).items()]
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), *parts, *labels)

    wide = [f"__{p.name}" for p in WIDE]
    return docs.withColumn("__found", F.transform(F.concat(*wide), described)).drop(*wide)


@dataclass(frozen=True)
class Split:
    """A node: ``low`` if the feature is at most ``edge``, else ``high``; numbers are leaves."""

    feature: str
    edge: int
    low: Split | float
    high: Split | float

    def column(self, span: Column) -> Column:
        side = lambda s: s.column(span) if isinstance(s, Split) else F.lit(float(s))
        return F.when(span[self.feature] <= self.edge, side(self.low)).otherwise(side(self.high))

    def values(self, x: np.ndarray) -> np.ndarray:
        side = lambda s: s.values(x) if isinstance(s, Split) else s
        return np.where(x[:, FEATURES.index(self.feature)] <= self.edge, side(self.low), side(self.high))


def grown(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int) -> Split | float:
    """A regression tree on gradient and curvature sums."""
    total, curve = slope.sum(), bend.sum()
    leaf = float(RATE * total / (curve + 1.0))
    best = (1e-6, None)
    if depth:
        for place, name in enumerate(FEATURES):
            for edge in np.unique(x[:, place])[:-1]:
                low = x[:, place] <= edge
                g, h = slope[low].sum(), bend[low].sum()
                gain = g * g / (h + 1) + (total - g) ** 2 / (curve - h + 1) - total**2 / (curve + 1)
                if gain > best[0]:
                    best = (gain, (name, int(edge), low))
    if best[1] is None:
        return leaf
    name, edge, low = best[1]
    sides = [grown(x[m], slope[m], bend[m], depth - 1) for m in (low, ~low)]
    return Split(name, edge, *sides)


@dataclass(frozen=True)
class Scorer:
    """Boosted trees of one kind, and the least score that selects a span."""

    base: float
    trees: tuple[Split, ...]
    threshold: float

    @staticmethod
    def fitted(x, label, weight, held_out) -> Scorer:
        on = ~held_out
        positive = (label * weight)[on].sum()
        base = float(np.log((positive + 0.5) / ((weight[on].sum() - positive) + 0.5)))
        score, trees = np.full(len(x), base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = grown(x[on], ((label - p) * weight)[on], (p * (1 - p) * weight)[on], DEPTH)
            if not isinstance(tree, Split):
                break
            trees.append(tree)
            score = score + tree.values(x)
        return Scorer(base, tuple(trees), calibrated(score, label, weight, held_out))

    def column(self, span: Column) -> Column:
        return reduce(lambda a, b: a + b, [t.column(span) for t in self.trees], F.lit(self.base))


def calibrated(score, label, weight, held_out) -> float:
    """The least score above which held-out candidates reach ``PRECISION``; infinite if none."""
    cut = np.inf
    for s in np.unique(score[held_out]):
        chosen = held_out & (score >= s)
        n = weight[chosen].sum()
        if n >= MIN_SUPPORT and (label * weight)[chosen].sum() >= PRECISION * n:
            cut = float(s)
            break
    return cut


def trained(found: DataFrame, id_col: str) -> dict[str, Scorer]:
    """Scorers from the candidates of all texts, brought to the driver as counts."""
    labels = [f"is_{k}" for k in KINDS]
    half = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 2 == 1).alias("half")
    rows = found.select(half, F.inline("__found")).groupBy("half", *FEATURES, *labels).count()
    counts = rows.toPandas().sort_values(["half", *FEATURES, *labels])
    x, weight = counts[list(FEATURES)].to_numpy(), counts["count"].to_numpy(dtype=float)
    held_out = counts["half"].to_numpy(dtype=bool)
    return {k: Scorer.fitted(x, counts[f"is_{k}"].to_numpy(dtype=float), weight, held_out) for k in KINDS}


def with_added(found: DataFrame, scorers: dict[str, Scorer]) -> DataFrame:
    """``found`` with ``__all``: (kind, start, end) of base and added spans, by kind, then start.

    A candidate that overlaps a base span, or one with a better score, is not added.
    """
    known = [k for k in KINDS if np.isfinite(scorers[k].threshold)]
    base = {k: F.transform(f"__{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS}
    if known:
        free = F.filter("__found", lambda s: reduce(lambda a, b: a & b, [s[f"is_{k}"] == 0 for k in KINDS]))

        def scored(span: Column) -> Column:
            each = [
                F.struct(
                    F.when(scorers[k].column(span) >= scorers[k].threshold, scorers[k].column(span)).alias("score"),
                    F.lit(k).alias("kind"), (-span["start"]).alias("from"),
                    span["start"].alias("start"), span["end"].alias("end"),
                ) for k in known
            ]
            return F.array_max(F.filter(F.array(*each), lambda e: e["score"].isNotNull()))

        ranked = F.sort_array(F.filter(F.transform(free, scored), lambda s: s.isNotNull()), asc=False)
        none = F.array().cast("array<struct<kind: string, start: int, end: int>>")

        def unless_met(done: Column, span: Column) -> Column:
            new = F.struct(*[span[n].alias(n) for n in ("kind", "start", "end")])
            return F.when(F.exists(done, lambda d: overlap(d, span)), done).otherwise(F.concat(done, F.array(new)))

        found = found.withColumn("__added", F.aggregate(ranked, none, unless_met))

        def of(kind: str) -> Column:
            mine = F.filter("__added", lambda s: s["kind"] == kind)
            plain = F.transform(mine, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
            return F.array_sort(F.concat(base[kind], plain))
    else:
        of = base.__getitem__
    every = [named(of(k), k) for k in KINDS]
    return found.withColumn("__all", F.concat(*every)).drop("__added")


def named(spans: Column | str, kind: str) -> Column:
    return F.transform(
        spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> …, base_sha256, spans) of every row of ``docs``.

    The counts and the digest stand for base spans; ``spans`` holds added ones too. NULL and empty
    texts have none; repeated rows and NULL ids stay; other columns are not read.
    """
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = materialize(annotated(plain, "text").drop("text"), "pii-found")
    base = F.concat(*[named(f"__{k}", k) for k in KINDS])
    return with_added(found, trained(found, "doc")).select(
        F.col("doc").alias(id_col),
        *[F.size(f"__{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("__all")).alias("spans"),
    )


@shelters
def redacted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars"
) -> DataFrame:
    """``docs`` with ``<KIND>`` in place of every span, and the length column, if any, set anew.

    Spans of several kinds that overlap become one mark, of the first that starts. Texts without
    spans stay as they are.
    """
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    counted = annotated(plain, "text").select("doc", "__found")
    scorers = trained(counted, "doc")
    found = with_added(annotated(docs, text_col), scorers)
    text = F.col(text_col)
    spans = F.array_sort(F.transform("__all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, span: Column) -> Column:
        kept = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        mark = F.concat(F.lit("<"), F.upper(span["kind"]), F.lit(">"))
        new = F.struct(span["end"].alias("at"), F.concat(done["out"], F.array(kept, mark)).alias("out"))
        over = F.struct(F.greatest(done["at"], span["end"]).alias("at"), done["out"].alias("out"))
        return F.when(span["start"] >= done["at"], new).otherwise(over)

    rest = lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.char_length(text)))
    marked = F.when(F.size("__all") > 0, F.aggregate(spans, none, step, rest)).otherwise(text)
    out = found.withColumn("__text", marked)
    length = F.char_length("__text").cast(docs.schema[length_col].dataType) if length_col in docs.columns else None
    columns = [
        F.col("__text").alias(c) if c == text_col else length.alias(c) if c == length_col else F.col(c)
        for c in docs.columns
    ]
    return out.select(*columns)
