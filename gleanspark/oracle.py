"""For each registered query, SQL over the same tables that must give the same rows."""

from __future__ import annotations

from gleanspark.config import MAX_TOKENS
from gleanspark.operators.policy import SUMMED_SHAPE, TRIES
from gleanspark.registered import (
    BATCH_ROWS, EPOCHS, FLIPPED, LANGUAGES, LOOP_EPOCHS, PENALTY, PLACES, ROUNDS, SAMPLE_ROWS, SEED,
    SHARES, SPLIT_SIZES, STEP, TARGET_SHARE,
)
from gleanspark.sources.templates import NEGATIVE_TEMPLATES, POSITIVE_TEMPLATES, WORDS

CLASSES = range(len(LANGUAGES))
Ctes = list[tuple[str, str]]


def with_ctes(ctes: Ctes, final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in ctes) + "\n" + final


def each(form: str, sep: str = ", ") -> str:
    """``form`` for every class, ``#`` standing for its number."""
    return sep.join(form.replace("#", str(c)) for c in CLASSES)


def bits(tag: str, row_id: str) -> str:
    return f"('0x' || substr(md5('{tag}:{SEED}:' || {row_id}), 1, 13))::BIGINT"


def draw(tag: str, row_id: str) -> str:
    return f"({bits(tag, row_id)}::DOUBLE / 4503599627370496::DOUBLE)"


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, {PLACES}) AS {n}" for n in names)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Inputs derived from the tables.

LABEL = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END::INTEGER"
WORD_LIST = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


def bands() -> str:
    ends, end = "", 0.0
    for name, share in SHARES.items():
        end = round(end + share, 12)
        ends += f" WHEN u < {end}::DOUBLE THEN '{name}'"
    return f"CASE{ends} ELSE 'pool' END"


DOCS: Ctes = [
    (
        "docs",
        f"SELECT id, text, label, {bands()} AS split, tokens, "
        f"CASE WHEN {draw('flip', 'id')} < {FLIPPED}::DOUBLE THEN (label + 1) % {len(LANGUAGES)} "
        f"ELSE label END::INTEGER AS claimed FROM (SELECT doc_id AS id, text, {LABEL} AS label, "
        f"{draw('split', 'doc_id')} AS u, {WORD_LIST} AS tokens FROM documents)",
    ),
    ("words", "SELECT id, label, claimed, split, unnest(tokens) AS token FROM docs"),
]


def counted(label: str, source: str) -> str:
    filters = each(f"count(*) FILTER ({label} = #)::BIGINT AS n_#")
    return f"SELECT token, {filters} FROM {source} GROUP BY token"


def doc_counted(label: str, source: str) -> str:
    return "SELECT " + each(f"count(*) FILTER ({label} = #)::BIGINT AS n_#") + f" FROM {source}"


def model(counts: str, docs: str, name: str) -> Ctes:
    """Word weights and priors from a word count table and a one-row document count."""
    total = each("n_#", " + ")
    return [
        (f"{name}_t", f"SELECT count(*) AS v, {each('coalesce(sum(n_#), 0) AS t_#')} FROM {counts}"),
        (
            f"{name}_w",
            f"SELECT token, {each('ln((n_# + 1)::DOUBLE / (t_# + v)::DOUBLE) AS w_#')} "
            f"FROM {counts}, {name}_t",
        ),
        (
            f"{name}_p",
            "SELECT "
            + each(f"ln((n_# + 1)::DOUBLE / ({total} + {len(LANGUAGES)})::DOUBLE) AS p_#")
            + f" FROM {docs}",
        ),
    ]


def predictions(name: str, docs: str, words: str, out: str) -> Ctes:
    """``id, prob_0 …, prediction`` for the rows of ``docs``."""
    return [
        (
            f"{out}_z",
            f"SELECT d.id, {each('any_value(p_#) + coalesce(sum(w_#) / count(w_#), 0) AS z_#')} "
            f"FROM {docs} d CROSS JOIN {name}_p LEFT JOIN {words} x ON x.id = d.id "
            f"LEFT JOIN {name}_w w ON w.token = x.token GROUP BY d.id",
        ),
        shares(out),
    ]


def shares(out: str) -> tuple[str, str]:
    """Probabilities and prediction from the scores ``z_0 …`` of a table."""
    top = f"greatest({each('z_#')})"
    best = f"greatest({each('round(z_#, 10)')})"
    picked = " ".join(f"WHEN round(z_{c}, 10) = {best} THEN {c}" for c in CLASSES)
    return (
        out,
        f"SELECT id, {each(f'exp(z_# - {top}) / e AS prob_#')}, "
        f"CASE {picked} END::INTEGER AS prediction FROM (SELECT *, "
        + each(f"exp(z_# - {top})", " + ")
        + f" AS e FROM {out}_z)",
    )


# Logistic regression by plain gradient steps over word counts by bucket at length one and a constant.
CONSTANT = 64
FEATURES: Ctes = [
    ("feats",
     f"SELECT id, bucket, x FROM unit UNION ALL SELECT id, {CONSTANT}::INTEGER, 1.0::DOUBLE FROM docs"),
]


def regressed(name: str, rows: str, epochs: int) -> Ctes:
    """Weights ``{name}_w`` and the losses ``{name}_loss`` after ``epochs`` steps on ``rows(id, label)``."""
    ctes: Ctes = [
        (f"{name}_x", f"SELECT f.id, bucket, x, label FROM feats f JOIN ({rows}) USING (id)"),
        (f"{name}_n", f"SELECT count(DISTINCT id) AS n FROM {name}_x"),
        (f"{name}_w0",
         f"SELECT class::INTEGER AS class, bucket::INTEGER AS bucket, 0::DOUBLE AS w "
         f"FROM range({len(LANGUAGES)}) c(class), range({CONSTANT + 1}) b(bucket)"),
    ]
    for k in range(epochs + 1):
        ctes += [
            (f"{name}_z{k}",
             f"SELECT id, label, class, sum(x * w) AS z FROM {name}_x JOIN {name}_w{k} USING (bucket) GROUP BY ALL"),
            (f"{name}_p{k}",
             "SELECT id, label, class, e / sum(e) OVER (PARTITION BY id) AS p FROM (SELECT *, "
             f"exp(z - max(z) OVER (PARTITION BY id)) AS e FROM {name}_z{k})"),
        ]
        if k < epochs:
            ctes.append((
                f"{name}_w{k + 1}",
                f"SELECT class, bucket, w - {STEP}::DOUBLE * (coalesce(g, 0) + CASE WHEN bucket < {CONSTANT} "
                f"THEN {PENALTY}::DOUBLE * w ELSE 0 END) AS w FROM {name}_w{k} LEFT JOIN (SELECT class, bucket, "
                f"sum((p - (class = p.label)::INTEGER) * x) / (SELECT n FROM {name}_n) AS g "
                f"FROM {name}_p{k} p JOIN {name}_x USING (id) GROUP BY ALL) USING (class, bucket)",
            ))
    losses = " UNION ALL ".join(
        f"SELECT {k}::INTEGER AS epoch, avg(-ln(p)) AS loss FROM {name}_p{k} WHERE class = label" for k in range(epochs + 1)
    )
    return ctes + [(f"{name}_w", f"SELECT * FROM {name}_w{epochs}"), (f"{name}_loss", losses)]


def linear_predictions(name: str, docs: str, out: str) -> Ctes:
    """As :func:`predictions`, from regression weights."""
    scores = each("sum(x * w) FILTER (class = #) AS z_#")
    return [
        (f"{out}_z",
         f"SELECT id, {scores} FROM {docs} d JOIN feats USING (id) JOIN {name}_w USING (bucket) GROUP BY id"),
        shares(out),
    ]


def f1_of(pairs: str) -> str:
    """Per-class F1 rows of ``pairs(split, label, prediction)``."""
    return (
        f"SELECT split, class, tp, fp, fn, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM ("
        f"SELECT split, class, count(*) FILTER (label = class AND prediction = class)::BIGINT AS tp, "
        f"count(*) FILTER (label <> class AND prediction = class)::BIGINT AS fp, "
        f"count(*) FILTER (label = class AND prediction <> class)::BIGINT AS fn "
        f"FROM {pairs} p JOIN (SELECT DISTINCT split, class FROM ("
        f"SELECT split, label AS class FROM {pairs} UNION ALL "
        f"SELECT split, prediction FROM {pairs})) USING (split) GROUP BY split, class)"
    )


def macro(pairs: str) -> str:
    return f"SELECT split, avg(f1) AS macro_f1 FROM ({f1_of(pairs)}) GROUP BY split"


MODEL: Ctes = DOCS + [
    ("train_words", "SELECT * FROM words WHERE split = 'train'"),
    ("counts", counted("label", "train_words")),
    ("doc_counts", doc_counted("label", "(SELECT * FROM docs WHERE split = 'train')")),
    *model("counts", "doc_counts", "m"),
]
PREDICTED: Ctes = MODEL + [
    *predictions("m", "docs", "words", "pred"),
    ("pairs", "SELECT split, label, prediction FROM pred JOIN docs USING (id)"),
]
PROBS = each("round(prob_#, 6) AS p_#")

# The hashed embedding and the novelty of pool rows against train rows.
BUCKET = "(('0x' || substr(md5(token), 1, 7))::BIGINT % 64)::INTEGER"
BUCKETS: Ctes = [("buckets", f"SELECT id, {BUCKET} AS bucket, count(*) AS n FROM words GROUP BY ALL")]
TEXT_NOVELTY: Ctes = BUCKETS + [
    ("norms", "SELECT id, sqrt(sum(n * n)) + 1e-9 AS norm FROM buckets GROUP BY id"),
    ("unit", "SELECT id, bucket, n / norm AS x, split FROM buckets JOIN norms USING (id) JOIN docs USING (id)"),
    (
        "near",
        "SELECT cand_id, max(sim) AS sim FROM (SELECT a.id AS cand_id, sum(a.x * b.x) AS sim "
        "FROM unit a JOIN unit b USING (bucket) WHERE a.split = 'pool' AND b.split = 'train' "
        "GROUP BY a.id, b.id) GROUP BY cand_id",
    ),
    (
        "novelties",
        "SELECT id, greatest(0, least(1, 1 - coalesce(sim, 0)))::DOUBLE AS novelty "
        "FROM docs LEFT JOIN near ON cand_id = id WHERE split = 'pool'",
    ),
]


def signals(pred: str, batch: str, out: str) -> Ctes:
    """Signals and weight of the pool rows in ``batch``, from predictions."""
    entropy = each("prob_# * ln(prob_# + 1e-9)", " + ")
    claim = " ".join(f"WHEN {c} THEN prob_{c}" for c in CLASSES)
    return [
        (
            out,
            f"SELECT *, (uncertainty + novelty + verifier) / 3 AS weight FROM (SELECT id AS cand_id, "
            f"claimed AS label, prediction, -({entropy}) / ln({len(LANGUAGES)}) AS uncertainty, "
            f"novelty, CASE claimed {claim} END AS verifier, {each('prob_#')} "
            f"FROM {pred} JOIN {batch} USING (id) JOIN novelties USING (id))",
        )
    ]


POOL: Ctes = [("pool_docs", "SELECT * FROM docs WHERE split = 'pool'")]
SCORED: Ctes = PREDICTED + POOL + TEXT_NOVELTY + signals("pred", "pool_docs", "scored")

# Vectors.
VECTORS: Ctes = [
    (
        "vecs",
        f"SELECT vec_id, {draw('split', 'vec_id')} < 0.5::DOUBLE AS is_real, "
        "list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9)) AS v "
        "FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)",
    ),
    (
        "sims",
        "SELECT a.vec_id, b.vec_id AS real_id, list_inner_product(a.v, b.v) AS sim "
        "FROM vecs a, vecs b WHERE NOT a.is_real AND b.is_real",
    ),
]
NOVELTY = with_ctes(
    VECTORS,
    "SELECT vec_id, round(greatest(0, least(1, 1 - max(sim))), 6)::DOUBLE AS novelty FROM sims GROUP BY vec_id",
)

NEAREST = with_ctes(
    VECTORS,
    "SELECT vec_id, real_id AS nearest_id, "
    "round(1 - greatest(0, least(1, 1 - top)), 6)::DOUBLE AS similarity FROM (SELECT *, "
    "max(sim) OVER (PARTITION BY vec_id) AS top FROM sims) WHERE sim >= top - 1e-9 "
    "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY real_id) = 1",
)

# Reward logs.
USER_LOG: Ctes = [
    (
        "user_log",
        "SELECT * FROM (SELECT user_id, row_number() OVER w - 1 AS iteration, "
        "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS arm, "
        "value::DECIMAL(18,2) - lag(value::DECIMAL(18,2)) OVER w AS reward FROM events "
        "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE iteration > 0",
    )
]
USER_ARMS: Ctes = USER_LOG + [
    (
        "user_arms",
        "SELECT user_id, arms.arm::INTEGER AS arm, count(reward)::BIGINT AS pulls, "
        "coalesce(sum(reward)::DOUBLE / count(reward), 0)::DOUBLE AS mean, "
        "(1 + count(*) FILTER (reward > 0))::BIGINT AS alpha, "
        "(1 + count(*) FILTER (reward <= 0))::BIGINT AS beta "
        "FROM (SELECT DISTINCT user_id FROM user_log) CROSS JOIN (SELECT unnest([0, 1]) AS arm) arms "
        "LEFT JOIN user_log USING (user_id, arm) GROUP BY ALL",
    )
]
DAYS: Ctes = [
    (
        "days",
        "SELECT (ts::DATE - (SELECT min(ts)::DATE FROM events) + 1)::INTEGER AS iteration, CASE WHEN count(*) FILTER (event_type IN ('purchase', 'signup')) "
        "> count(*) FILTER (event_type IN ('error', 'click')) THEN 1 ELSE 0 END AS arm, "
        "sum(round(value * 100)::BIGINT)::DOUBLE / 100 / count(*) - 50 AS reward FROM events GROUP BY 1",
    )
]


def arm_state(arm: int, over: str) -> str:
    pulled = f"FILTER (arm = {arm}) {over}"
    return (
        f"(count(*) {pulled})::BIGINT AS pulls_{arm}, "
        f"coalesce((sum(reward) {pulled})::DOUBLE / (count(*) {pulled}), 0)::DOUBLE AS mean_{arm}, "
        f"(1 + count(*) FILTER (arm = {arm} AND reward > 0) {over})::BIGINT AS alpha_{arm}, "
        f"(1 + count(*) FILTER (arm = {arm} AND reward <= 0) {over})::BIGINT AS beta_{arm}"
    )


BEFORE = "OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
STATES: Ctes = DAYS + [
    ("states", f"SELECT iteration AS batch_no, {arm_state(0, BEFORE)}, {arm_state(1, BEFORE)} FROM days")
]


def clock(rows: str, row_id: str, tag: str, size: str) -> str:
    return (
        f"SELECT *, (floor((t - 1) / {size}) + 1)::INTEGER AS batch_no FROM (SELECT *, "
        f"row_number() OVER (ORDER BY {bits(tag, row_id)}, {row_id}) AS t FROM {rows})"
    )


def gamma(shape: str, tag: str) -> str:
    key = f"'{tag}:{SEED}:' || cand_id || ':' || i"
    u = f"((('0x' || substr(md5({key}), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370497::DOUBLE)"
    return f"list_sum(list_transform(range(1, {shape} + 1), lambda i: -ln({u})))"


UCB = [f"mean_{a} + sqrt(ln(t) / (pulls_{a} + 1e-9))" for a in (0, 1)]
UCB_ACTION = "CASE WHEN t <= 2 THEN t - 1 WHEN accept_score > reject_score THEN 1 ELSE 0 END::INTEGER AS action"
PLAIN_ACTION = "CASE WHEN accept_score > reject_score THEN 1 ELSE 0 END::INTEGER AS action"
REPLAY: Ctes = SCORED + STATES + [
    ("pool_size", "SELECT count(*) AS n FROM pool_docs"),
    (
        "timed",
        clock("(SELECT cand_id, weight FROM scored)", "cand_id", "pool",
              "(SELECT greatest(1, ceil(n / (SELECT max(iteration) FROM days)::DOUBLE)) FROM pool_size)"),
    ),
    ("play", "SELECT * FROM timed JOIN states USING (batch_no)"),
    (
        "open_states",
        f"SELECT batch_no, {arm_state(0, '')}, {arm_state(1, '')} FROM (SELECT DISTINCT batch_no FROM timed) "
        "LEFT JOIN days ON iteration < batch_no AND iteration <= (SELECT max(iteration) // 2 FROM days) GROUP BY batch_no",
    ),
    (
        "open_ucb",
        f"SELECT *, {UCB_ACTION} FROM (SELECT *, {UCB[0]} AS reject_score, "
        f"({UCB[1]}) * (1 + weight) AS accept_score FROM timed JOIN open_states USING (batch_no))",
    ),
    (
        "ucb",
        f"SELECT *, {UCB_ACTION} FROM (SELECT *, {UCB[0]} AS reject_score, "
        f"({UCB[1]}) * (1 + weight) AS accept_score FROM play)",
    ),
    (
        "betas",
        "SELECT *, " + ", ".join(
            f"{gamma(f'{p}_{a}', f'{p}{a}')} AS g_{p}_{a}" for a in (0, 1) for p in ("alpha", "beta")
        ) + " FROM play",
    ),
    (
        "thompson",
        f"SELECT *, {PLAIN_ACTION} FROM (SELECT *, g_alpha_0 / (g_alpha_0 + g_beta_0) AS reject_score, "
        "g_alpha_1 / (g_alpha_1 + g_beta_1) * (1 + weight) AS accept_score FROM betas)",
    ),
]
# Linear regression per arm on three context values; the ridge is 1.
ARMS_PAIRS = [(i, j) for i in range(3) for j in range(3)]


def linear_state(arm: int) -> str:
    """Columns of the inverse by cofactors, row by row, and of the weights."""
    m = lambda i, j: f"(s{arm}_{min(i, j)}{max(i, j)} + {int(i == j)})"
    minor = lambda i, j: "({} * {} - {} * {})".format(*[
        m((i + a) % 3, (j + b) % 3) for a, b in ((1, 1), (2, 2), (1, 2), (2, 1))])
    det = " + ".join(f"{m(0, j)} * {minor(0, j)}" for j in range(3))
    return ", ".join(f"{minor(j, i)} / ({det}) AS i{arm}_{i}{j}" for i, j in ARMS_PAIRS)


def linear_score(arm: int) -> str:
    x = ("uncertainty", "novelty", "verifier")
    mean = " + ".join(f"i{arm}_{i}{j} * r{arm}_{j} * {x[i]}" for i, j in ARMS_PAIRS)
    spread = " + ".join(f"i{arm}_{i}{j} * {x[i]} * {x[j]}" for i, j in ARMS_PAIRS)
    return f"({mean}) + sqrt({spread})"


LINEAR: Ctes = REPLAY[: len(SCORED) + len(STATES) + 2] + [
    ("contexts",
     "SELECT iteration, arm, reward, x0, x1, x2 FROM days JOIN (SELECT "
     "(ts::DATE - (SELECT min(ts)::DATE FROM events) + 1)::INTEGER AS iteration, "
     "count(*) FILTER (event_type IN ('purchase', 'signup')) / count(*)::DOUBLE AS x0, "
     "count(*) FILTER (event_type IN ('error', 'click')) / count(*)::DOUBLE AS x1, "
     "sum(round(value * 100)::BIGINT)::DOUBLE / 10000 / count(*) AS x2 FROM events GROUP BY 1) USING (iteration)"),
    ("linear_sums",
     "SELECT batch_no, " + ", ".join(
         [f"coalesce(sum(x{i} * x{j}) FILTER (arm = {a}), 0) AS s{a}_{i}{j}"
          for a in (0, 1) for i, j in ARMS_PAIRS if i <= j]
         + [f"coalesce(sum(reward * x{i}) FILTER (arm = {a}), 0) AS r{a}_{i}" for a in (0, 1) for i in range(3)])
     + " FROM (SELECT DISTINCT batch_no FROM timed) LEFT JOIN contexts ON iteration < batch_no GROUP BY batch_no"),
    ("linear_states", f"SELECT *, {linear_state(0)}, {linear_state(1)} FROM linear_sums"),
    ("linear",
     f"SELECT *, {PLAIN_ACTION} FROM (SELECT t.*, {linear_score(0)} AS reject_score, {linear_score(1)} AS accept_score "
     "FROM timed t JOIN linear_states USING (batch_no) JOIN scored USING (cand_id))"),
]

# Gamma draws by rejection beyond a shape, by the sum of exponential draws up to it.
GAMMAS = [(p, a) for a in (0, 1) for p in ("alpha", "beta")]


def tried(name: str) -> str:
    u = lambda part: (
        f"((('0x' || substr(md5('{name}:{part}:{SEED}:' || cand_id || ':' || i), 1, 13))::BIGINT + 1)::DOUBLE "
        "/ 4503599627370497::DOUBLE)")
    return (
        f"SELECT cand_id, min_by(d * v, i) AS drawn FROM (SELECT *, pow(1 + x / sqrt(9 * d), 3) AS v FROM (SELECT cand_id, "
        f"i, shape - 1 / 3::DOUBLE AS d, {u('bar')} AS u, sqrt(-2 * ln({u('radius')})) * cos(2 * pi() * {u('angle')}) AS x "
        f"FROM (SELECT cand_id, {name[:-1]}_{name[-1]} AS shape, unnest(range(1, {TRIES + 1})) AS i FROM long_play))) "
        "WHERE CASE WHEN v > 0 THEN ln(u) < x * x / 2 + d - d * v + d * ln(v) ELSE false END GROUP BY cand_id"
    )


LONG_REPLAY: Ctes = DOCS + POOL + [
    ("event_log",
     "SELECT row_number() OVER (ORDER BY ts, event_id) AS iteration, "
     "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS arm, "
     "(round(value * 100)::BIGINT - 5000) / 100::DOUBLE AS reward FROM events"),
    ("event_states",
     f"SELECT iteration AS batch_no, {arm_state(0, BEFORE)}, {arm_state(1, BEFORE)} FROM event_log"),
    ("long_timed", clock("(SELECT id AS cand_id FROM pool_docs)", "cand_id", "pool", "1")),
    ("long_play",
     f"SELECT l.cand_id, t, b AS batch_no, {draw('weight', 'l.cand_id')} AS weight, s.* EXCLUDE (batch_no) FROM (SELECT *, "
     "floor((t - 1) * (SELECT count(*) FROM event_log) / (SELECT count(*) FROM pool_docs)::DOUBLE)::BIGINT + 1 AS b "
     "FROM long_timed) l JOIN event_states s ON s.batch_no = b"),
    *[(f"tried_{p}_{a}", tried(f"{p}{a}")) for p, a in GAMMAS],
    ("long_gammas",
     "SELECT p.*, " + ", ".join(
         f"CASE WHEN {p}_{a} <= {SUMMED_SHAPE} OR t_{p}_{a}.drawn IS NULL THEN {gamma(f'{p}_{a}', f'{p}{a}')} "
         f"ELSE t_{p}_{a}.drawn END AS g_{p}_{a}" for p, a in GAMMAS)
     + " FROM long_play p" + "".join(f" LEFT JOIN tried_{p}_{a} t_{p}_{a} USING (cand_id)" for p, a in GAMMAS)),
    ("long_thompson",
     f"SELECT *, {PLAIN_ACTION} FROM (SELECT *, g_alpha_0 / (g_alpha_0 + g_beta_0) AS reject_score, "
     "g_alpha_1 / (g_alpha_1 + g_beta_1) * (1 + weight) AS accept_score FROM long_gammas)"),
]

MANY_RUNS: Ctes = USER_LOG + [
    ("own_events",
     f"SELECT user_id, event_id AS cand_id, t, (t - 1) // 5 + 1 AS batch_no, {draw('weight', 'event_id')} AS weight FROM ("
     "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)"),
    ("own_states",
     f"SELECT b.user_id, b.batch_no, {arm_state(0, '')}, {arm_state(1, '')} FROM (SELECT DISTINCT user_id, batch_no "
     "FROM own_events) b LEFT JOIN (SELECT user_id, iteration, arm, reward::DOUBLE AS reward FROM user_log) l "
     "ON l.user_id = b.user_id AND l.iteration < b.batch_no GROUP BY b.user_id, b.batch_no"),
    ("own_ucb",
     f"SELECT *, {UCB_ACTION} FROM (SELECT *, {UCB[0]} AS reject_score, ({UCB[1]}) * (1 + weight) AS accept_score "
     "FROM own_events JOIN own_states USING (user_id, batch_no))"),
]
REPLAYED = "cand_id, t, batch_no, action, round(reject_score, 6) AS reject_score, round(accept_score, 6) AS accept_score"


# The closed loop, one set of steps per round.


def loop(docs: Ctes = DOCS, novelty: Ctes = TEXT_NOVELTY, linear: bool = False) -> Ctes:
    """The tables of a run; ``linear`` for logistic regression in place of naive Bayes."""
    ctes = list(docs) + POOL + novelty + FEATURES * linear + [
        ("pool_size", "SELECT count(*) AS n FROM pool_docs"),
        ("target", f"SELECT floor(n * {TARGET_SHARE}::DOUBLE)::BIGINT AS target FROM pool_size"),
        ("timed", clock("pool_docs", "id", "pool", f"(SELECT greatest(1, ceil(n / {ROUNDS}.0)) FROM pool_size)")),
        ("train_words", "SELECT * FROM words WHERE split = 'train'"),
        ("counts_0", counted("label", "train_words")),
        ("docs_0", doc_counted("label", "(SELECT * FROM docs WHERE split = 'train')")),
        ("val_docs", "SELECT * FROM docs WHERE split = 'val'"),
        ("test_docs", "SELECT * FROM docs WHERE split = 'test'"),
    ]

    def predicted(k: str, rows: str, out: str) -> Ctes:
        return linear_predictions(f"m_{k}", rows, out) if linear else predictions(f"m_{k}", rows, "words", out)

    def fitted(k: int) -> Ctes:
        if not linear:
            return model(f"counts_{k}", f"docs_{k}", f"m_{k}")
        rows = "SELECT id, label FROM docs WHERE split = 'train'"
        rows += "".join(f" UNION ALL SELECT id, claimed FROM new_docs_{j}" for j in range(1, k + 1))
        return regressed(f"m_{k}", rows, LOOP_EPOCHS)

    def evaluated(k: str, split: str) -> Ctes:
        name = f"{split}_{k}"
        return [
            *predicted(k, f"{split}_docs", name),
            (f"{name}_pairs", f"SELECT split, label, prediction FROM {name} JOIN docs USING (id)"),
            (f"{name}_f1", macro(f"{name}_pairs")),
        ]

    ctes += fitted(0) + evaluated("0", "val")
    ctes.append((
        "round_0",
        "SELECT 0 AS iteration, 0::BIGINT AS n_batch, 0::BIGINT AS n_accepted, 0::BIGINT AS curated_total, "
        "NULL::INTEGER AS arm, (SELECT macro_f1 FROM val_0_f1) AS val_f1, NULL::DOUBLE AS reward",
    ))
    for k in range(1, ROUNDS + 1):
        log = " UNION ALL ".join(f"SELECT * FROM round_{j}" for j in range(k))
        ctes += [
            (f"batch_{k}",
             f"SELECT * FROM timed WHERE batch_no = {k} AND "
             f"(SELECT curated_total FROM round_{k - 1}) < (SELECT target FROM target)"),
            (f"state_{k}", f"SELECT {arm_state(0, '')}, {arm_state(1, '')} FROM ({log}) WHERE iteration > 0"),
            *predicted(str(k - 1), f"batch_{k}", f"pred_{k}"),
            *signals(f"pred_{k}", f"batch_{k}", f"scored_{k}"),
            (f"decided_{k}",
             f"SELECT *, {UCB_ACTION} FROM (SELECT s.*, t, {UCB[0]} AS reject_score, "
             f"({UCB[1]}) * (1 + weight) AS accept_score FROM scored_{k} s JOIN timed ON id = cand_id, state_{k})"),
            (f"kept_{k}",
             f"SELECT cand_id, action = 1 AND (sum(action) OVER (ORDER BY t)) <= (SELECT target FROM target) - "
             f"(SELECT curated_total FROM round_{k - 1}) AS kept FROM decided_{k}"),
            (f"new_docs_{k}",
             f"SELECT d.* FROM batch_{k} d JOIN kept_{k} ON cand_id = id WHERE kept"),
            (f"new_words_{k}", f"SELECT w.* FROM words w JOIN new_docs_{k} USING (id)"),
            (f"counts_{k}",
             f"SELECT token, {each('sum(n_#)::BIGINT AS n_#')} FROM (SELECT * FROM counts_{k - 1} UNION ALL "
             f"{counted('claimed', f'new_words_{k}')}) GROUP BY token"),
            (f"docs_{k}",
             f"SELECT {each('sum(n_#)::BIGINT AS n_#')} FROM (SELECT * FROM docs_{k - 1} UNION ALL "
             f"{doc_counted('claimed', f'new_docs_{k}')})"),
            *fitted(k),
            *evaluated(str(k), "val"),
            (f"round_{k}",
             f"SELECT {k} AS iteration, count(*)::BIGINT AS n_batch, count(*) FILTER (action = 1)::BIGINT AS n_accepted, "
             f"(SELECT curated_total FROM round_{k - 1}) + count(*) FILTER (kept)::BIGINT AS curated_total, "
             f"max(action)::INTEGER AS arm, (SELECT macro_f1 FROM val_{k}_f1) AS val_f1, "
             f"(SELECT macro_f1 FROM val_{k}_f1) - (SELECT val_f1 FROM round_{k - 1}) AS reward "
             f"FROM decided_{k} JOIN kept_{k} USING (cand_id) HAVING count(*) > 0"),
        ]
    every = lambda form: " UNION ALL ".join(form.replace("#", str(k)) for k in range(1, ROUNDS + 1))
    ctes += [
        ("rounds", "SELECT * FROM round_0 UNION ALL " + every("SELECT * FROM round_#")),
    ]
    if linear:
        return ctes
    ctes += [
        ("decisions",
         every("SELECT #::INTEGER AS iteration, d.*, kept FROM decided_# d JOIN kept_# USING (cand_id)")),
        # A round that was not played leaves counts and model as they were.
        *evaluated("0", "test"),
        *evaluated(str(ROUNDS), "test"),
        ("counts_all",
         f"SELECT token, {each('sum(n_#)::BIGINT AS n_#')} FROM (SELECT * FROM counts_0 UNION ALL "
         + counted("claimed", "(SELECT * FROM words WHERE split = 'pool')") + ") GROUP BY token"),
        ("docs_all",
         f"SELECT {each('sum(n_#)::BIGINT AS n_#')} FROM (SELECT * FROM docs_0 UNION ALL "
         + doc_counted("claimed", "pool_docs") + ")"),
        *model("counts_all", "docs_all", "m_all"),
        *evaluated("all", "val"),
        *evaluated("all", "test"),
    ]
    regime = lambda name, k: (
        f"SELECT '{name}' AS regime, (SELECT macro_f1 FROM val_{k}_f1) AS val_f1, "
        f"(SELECT macro_f1 FROM test_{k}_f1) AS test_f1"
    )
    ctes.append((
        "regimes",
        " UNION ALL ".join([
            regime("real_only", 0), regime("naive_augmentation", "all"), regime("bandit_guided", ROUNDS)
        ]),
    ))
    return ctes


LOOP = loop()
ROUND_COLUMNS = (
    "SELECT iteration, n_batch, n_accepted, curated_total, arm, "
    "round(val_f1, 6) AS val_f1, round(reward, 6) AS reward FROM rounds"
)
ROUND_TABLE = with_ctes(LOOP, ROUND_COLUMNS)

# The documents with a vector of their own, and novelty by these vectors.
OWN_DOCS: Ctes = [
    (name, f"SELECT * FROM ({sql}) JOIN (SELECT vec_id AS id FROM embeddings) USING (id)" if name == "docs" else sql)
    for name, sql in DOCS
]
OWN_NOVELTY: Ctes = [
    ("own",
     "SELECT id, split, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-9)) AS v FROM docs "
     "JOIN (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) USING (id)"),
    ("novelties",
     "SELECT a.id, greatest(0, least(1, 1 - max(list_inner_product(a.v, b.v))))::DOUBLE AS novelty "
     "FROM own a, own b WHERE a.split = 'pool' AND b.split = 'train' GROUP BY a.id"),
]
REGRESSION: Ctes = DOCS + TEXT_NOVELTY[:3] + FEATURES + regressed(
    "lr", "SELECT id, label FROM docs WHERE split = 'train'", EPOCHS)
OF = lambda regime, column: f"(SELECT {column} FROM regimes WHERE regime = '{regime}')"


def template_sql() -> str:
    row_id = "doc_id"
    pick = lambda options, tag: (
        "[" + ", ".join(quoted(o) for o in options) + f"][1 + floor({draw(tag, row_id)} * {len(options)})::INTEGER]"
    )
    text = (
        f"CASE WHEN label = 1 THEN {pick(POSITIVE_TEMPLATES, 'template')} "
        f"ELSE {pick(NEGATIVE_TEMPLATES, 'template')} END"
    )
    for key, options in WORDS.items():
        text = f"replace({text}, '{{{key}}}', {pick(options, key)})"
    adjective = (
        f"CASE WHEN label = 1 THEN {pick(WORDS['adj_pos'], 'adj_pos')} "
        f"ELSE {pick(WORDS['adj_neg'], 'adj_neg')} END"
    )
    return (
        f"SELECT doc_id AS cand_id, replace({text}, '{{adj}}', {adjective}) AS text, label "
        "FROM (SELECT doc_id, (doc_id % 2)::INTEGER AS label FROM documents)"
    )


GENERATED = (
    "SELECT doc_id AS cand_id, 'text ' || doc_id || ' of class ' || (doc_id % 2) AS text, "
    "(doc_id % 2)::INTEGER AS label FROM documents"
)


def statements() -> dict[str, str]:
    pool = with_ctes(DOCS, "SELECT id AS cand_id, text, claimed AS label FROM docs WHERE split = 'pool'")
    order = f"ORDER BY {bits('shuffle', 'doc_id')}, doc_id"
    t, v = SPLIT_SIZES["train"], SPLIT_SIZES["train"] + SPLIT_SIZES["val"]
    splits = (
        f"SELECT doc_id, CASE WHEN n <= {t} THEN 'train' WHEN n <= {v} THEN 'val' ELSE 'test' END AS split "
        f"FROM (SELECT doc_id, row_number() OVER ({order}) AS n FROM documents) "
        f"WHERE n <= {sum(SPLIT_SIZES.values())}"
    )
    probabilities = with_ctes(PREDICTED, f"SELECT id, {PROBS} FROM pred")
    regimes = f"SELECT regime, {rounded('val_f1', 'test_f1')} FROM regimes"
    return {
        "load_labelled":
            "SELECT doc_id AS id, text, quality AS label FROM documents JOIN labels USING (doc_id)",
        "union_sources":
            f"SELECT doc_id AS id, text, {LABEL} AS label FROM documents "
            "UNION ALL SELECT item_id, text, 0 FROM benchmark",
        "pool_lines": pool,
        "pool_array": pool,
        "pool_reuse": pool,
        "template_pool": template_sql(),
        "own_generator": GENERATED,
        "generator_waves": GENERATED,
        "seeded_sample": f"SELECT doc_id, lang FROM documents {order} LIMIT {SAMPLE_ROWS}",
        "fixed_splits": splits,
        "split_sizes": f"SELECT split, count(*) AS n FROM ({splits}) GROUP BY split",
        "band_splits": with_ctes(DOCS, "SELECT id, label, split FROM docs"),
        "batch_assign": clock("(SELECT doc_id FROM documents)", "doc_id", "pool", str(BATCH_ROWS)),
        "l2_normalised": with_ctes(
            VECTORS,
            "SELECT vec_id, (generate_subscripts(v, 1) - 1)::INTEGER AS pos, "
            "round(unnest(v), 6) AS x FROM vecs",
        ),
        "novelty_score": NOVELTY,
        "novelty_by_blocks": NOVELTY,
        "novelty_by_pivots": NOVELTY,
        "nearest_real": NEAREST,
        "nearest_real_by_blocks": NEAREST,
        "nearest_real_by_pivots": NEAREST,
        "hashed_embedding": with_ctes(
            DOCS + BUCKETS,
            "SELECT id, " + ", ".join(
                f"coalesce(sum({term}), 0)::DOUBLE AS {name}" for name, term in (
                    ("n_words", "n"), ("squares", "n * n"), ("moment", "n * (bucket + 1)"),
                    ("second_moment", "n * (bucket + 1) * (bucket + 1)"))
            ) + " FROM docs LEFT JOIN buckets USING (id) GROUP BY id"),
        "own_embedding":
            "SELECT doc_id, length(text)::DOUBLE AS n_chars, "
            "(length(text) - length(replace(text, ' ', '')))::DOUBLE AS n_spaces FROM documents",
        "tokenise_truncate": with_ctes(
            DOCS,
            "SELECT id AS doc_id, len(cut)::INTEGER AS n_tokens, array_to_string(cut, ' ') AS words "
            f"FROM (SELECT id, list_slice(tokens, 1, {MAX_TOKENS}) AS cut FROM docs)",
        ),
        "nb_model": with_ctes(MODEL, f"SELECT token, {each('n_#')} FROM counts"),
        "nb_probabilities": probabilities,
        "nb_probabilities_shuffled": probabilities,
        "union_scored": with_ctes(
            MODEL + [
                ("both_sources", "SELECT 'documents:' || id AS id, tokens FROM docs UNION ALL "
                 f"SELECT 'benchmark:' || item_id, {WORD_LIST} FROM benchmark"),
                ("both_words", "SELECT id, unnest(tokens) AS token FROM both_sources"),
                *predictions("m", "both_sources", "both_words", "both_pred"),
            ],
            f"SELECT id AS key, {PROBS} FROM both_pred"),
        "predict_argmax": with_ctes(
            PREDICTED, "SELECT id, label, split, prediction FROM pred JOIN docs USING (id)"),
        "train_loss": with_ctes(
            PREDICTED,
            "SELECT round(avg(-ln(CASE label " + " ".join(f"WHEN {c} THEN prob_{c}" for c in CLASSES)
            + " END)), 6) AS loss, count(*) AS n FROM pred JOIN docs USING (id) WHERE split = 'train'"),
        "uncertainty": with_ctes(SCORED, f"SELECT cand_id, {rounded('uncertainty')} FROM scored"),
        "verifier_confidence": with_ctes(SCORED, f"SELECT cand_id, label, {rounded('verifier')} FROM scored"),
        "score_candidates": with_ctes(
            SCORED,
            "SELECT cand_id, label, prediction, "
            + rounded("uncertainty", "novelty", "verifier", "weight") + " FROM scored"),
        "confusion": with_ctes(
            PREDICTED, "SELECT split, label, prediction, count(*) AS n FROM pairs GROUP BY ALL"),
        "class_f1": with_ctes(
            PREDICTED, f"SELECT split, class, tp, fp, fn, {rounded('f1')} FROM ({f1_of('pairs')})"),
        "macro_f1": with_ctes(PREDICTED, f"SELECT split, {rounded('macro_f1')} FROM ({macro('pairs')})"),
        "regime_baselines": with_ctes(LOOP, regimes + " WHERE regime <> 'bandit_guided'"),
        "reward_delta": with_ctes(
            USER_LOG, "SELECT user_id, iteration, arm, reward::DOUBLE AS reward FROM user_log"),
        "policy_state": with_ctes(
            USER_ARMS, "SELECT user_id, arm, pulls, mean FROM user_arms"),
        "beta_state": with_ctes(USER_ARMS, "SELECT user_id, arm, alpha, beta FROM user_arms"),
        "policy_state_running": with_ctes(
            USER_LOG,
            "SELECT user_id, iteration, "
            + ", ".join(arm_state(a, BEFORE.replace("ORDER", "PARTITION BY user_id ORDER")) for a in (0, 1))
            + " FROM user_log"),
        "ucb_replay": with_ctes(REPLAY, f"SELECT {REPLAYED} FROM ucb"),
        "thompson_replay": with_ctes(REPLAY, f"SELECT {REPLAYED} FROM thompson"),
        "replay_open_batch": with_ctes(REPLAY, f"SELECT {REPLAYED} FROM open_ucb"),
        "linear_ucb_replay": with_ctes(LINEAR, f"SELECT {REPLAYED} FROM linear"),
        "thompson_long_log": with_ctes(LONG_REPLAY, f"SELECT {REPLAYED} FROM long_thompson"),
        "replay_many_runs": with_ctes(MANY_RUNS, f"SELECT user_id, {REPLAYED} FROM own_ucb"),
        "own_policy": with_ctes(
            REPLAY,
            "SELECT cand_id, batch_no, CASE WHEN weight > 0.5 THEN 1 ELSE 0 END::INTEGER AS action FROM play"),
        "round_arms": with_ctes(
            REPLAY,
            "SELECT batch_no, count(*) AS n_batch, count(*) FILTER (action = 1) AS n_accepted, "
            "max(action)::INTEGER AS arm FROM ucb GROUP BY batch_no"),
        "accept_capped": with_ctes(
            REPLAY,
            "SELECT cand_id, t, batch_no, place FROM (SELECT *, row_number() OVER (ORDER BY t) AS place "
            f"FROM thompson WHERE action = 1) WHERE place <= (SELECT floor(n * {TARGET_SHARE}::DOUBLE) FROM pool_size)"),
        "closed_loop": ROUND_TABLE,
        "closed_loop_regression": with_ctes(loop(linear=True), ROUND_COLUMNS),
        "closed_loop_vectors": with_ctes(loop(OWN_DOCS, OWN_NOVELTY), ROUND_COLUMNS),
        "lr_model": with_ctes(
            REGRESSION, "SELECT class, bucket, round(w, 6) AS weight FROM lr_w"),
        "loss_history": with_ctes(REGRESSION, f"SELECT epoch, {rounded('loss')} FROM lr_loss"),
        "stream_loop": ROUND_TABLE,
        "streamed_state": with_ctes(
            USER_LOG,
            f"SELECT user_id, {arm_state(0, '')}, {arm_state(1, '')} FROM (SELECT user_id, arm, "
            "(reward * 100)::BIGINT AS reward FROM user_log) GROUP BY user_id"),
        "decision_log": with_ctes(
            LOOP,
            "SELECT iteration, cand_id, t, action, kept, "
            + rounded("uncertainty", "novelty", "verifier") + " FROM decisions"),
        "curated_rows": with_ctes(
            LOOP,
            "SELECT iteration, t, cand_id, claimed AS label, text FROM decisions JOIN docs ON id = cand_id WHERE kept"),
        "regime_comparison": with_ctes(LOOP, regimes),
        "regime_curve": with_ctes(
            LOOP,
            f"SELECT iteration, {rounded('val_f1')}, round({OF('real_only', 'val_f1')}, 6) AS real_only_val_f1, "
            f"round({OF('naive_augmentation', 'val_f1')}, 6) AS naive_val_f1 FROM rounds"),
        "regime_summary": with_ctes(
            LOOP,
            "SELECT CASE regime WHEN 'real_only' THEN 'baseline_real_only' ELSE regime END AS regime, "
            "round(test_f1, 3) AS test_f1, printf('%.3f', test_f1) AS label FROM regimes"),
        "result_document": with_ctes(
            LOOP,
            "SELECT count(*)::INTEGER AS n_val, count(reward)::INTEGER AS n_reward, "
            "max(curated_total) AS curated_pool_size, "
            f"round({OF('bandit_guided', 'test_f1')}, 6) AS test_f1, "
            f"round({OF('real_only', 'val_f1')}, 6) AS real_only_val_f1, "
            f"round({OF('naive_augmentation', 'test_f1')}, 6) AS naive_test_f1 FROM rounds"),
    }
