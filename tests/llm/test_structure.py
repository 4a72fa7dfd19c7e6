"""Substring dedup, conversation repair and periodic runs against brute force."""

import hashlib
import itertools
import random
import zlib

import pytest

from gleanspark.llm import conversations, periodic, registered, substrings
from tests.llm.test_operators import DOCS, SCHEMA, WORD, prose, rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# Substrings


def plain_kept(docs, window):
    """(id, words left) of (id, text) rows, by a table of all windows."""
    first = {}
    cut = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, words in cut:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in cut:
        gone = set()
        for k in range(len(words) - window + 1):
            least = first.get(tuple(words[k : k + window]))
            if least is not None and (i is None or least < i):
                gone |= set(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def found_kept(df, window):
    return rows(substrings.deduplicated(df, window=window), "doc_id", "n_words", "n_removed", "text")


def passages():
    """Passages shared at borders, inside others, repeated in one text, and by rows without an id."""
    common, other = prose(900, 70), prose(901, 49)
    out = [(i, f"{prose(i, i % 90)} {common} {prose(i + 500, 30)}") for i in range(30)]
    out += [(100, common), (101, f"{common} {common}"), (102, other), (103, other + " " + other.split()[0]),
            (104, f"{other}\n{other}"), (None, f"x {common}"), (None, prose(1, 60)), (105, prose(1, 60) + " y"),
            (106, None), (107, " \t"), (100, common), (108, "a " * 400), (109, "b " + "a " * 300), (110, "a b " * 60)]
    return out


def test_substrings_equal_all_windows(spark):
    texts = passages()
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    assert found_kept(df, 50) == plain_kept(texts, 50)


def test_substrings_of_few_words(spark, monkeypatch):
    """Many equal windows of few words, texts cut in chunks, and every bucket frequent or none."""
    monkeypatch.setattr(substrings, "CHUNK", 37)
    rng = random.Random(3)
    texts = [(i // 2 if i % 7 else None, " ".join(rng.choice("abc") for _ in range(rng.randrange(90)))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    for window, bucket in ((5, 0), (5, 10**9), (8, 20), (1, 20)):
        monkeypatch.setattr(substrings, "BUCKET_ROWS", bucket)
        assert found_kept(df, window) == plain_kept(texts, window)


def test_substrings_keep_other_columns(spark, none):
    df = spark.createDataFrame(DOCS, SCHEMA).selectExpr("*", "1 AS n_words", "'r' AS row", "2 AS print", "3 AS ranges")
    out = substrings.deduplicated(df)
    assert set(out.columns) == {*df.columns, "n_removed"}
    assert {(r.row, r.print, r.ranges) for r in out.collect()} == {("r", 2, 3)} and out.count() == len(DOCS)
    assert substrings.deduplicated(none).collect() == []


# Conversations

COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}


def plain_repair(faults):
    """(cost, audit, texts) of rows (role, text, fault), over all edits within a bound."""
    best = None

    def allowed(roles):
        whole = "".join(r[0] for r in roles)
        body = whole[1:] if whole[:1] == "s" else whole
        return whole == "" or (body and body == "ua" * (len(body) // 2))

    def walk(i, cost, audit, out, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(faults) and allowed([r for r, _ in out]):
            found = (cost, audit, out)
            best = found if best is None or found[:2] < best[:2] else best
        if inserts:
            for role in ("user", "assistant"):
                walk(i, cost + 3, audit + "I", out + [(role, "")], inserts - 1)
        if i < len(faults):
            role, text, fault = faults[i]
            walk(i + 1, cost + 4, audit + "D", out, inserts)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                walk(i + 1, cost + more, audit + "K", out + [(role, text)], inserts)
                for new in ("user", "assistant"):
                    walk(i + 1, cost + 3 + more, audit + "R", out + [(new, text)], inserts)

    walk(0, 0, "", [], 3)
    return best


def plain_conversation(turns):
    """The result's columns behind the id, of (turn, role, text) rows after damage, in order."""
    seen, faults = set(), []
    for _, role, text in turns:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else None
        faults.append((role, text, fault or ("truncated" if words[-1][-1] not in ".!?" else None)))
        seen.add((role, text))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, out = plain_repair(faults)
    kinds = [f for _, _, f in faults]
    joined = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(joined)


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def random_turns(rng):
    pick = lambda: (rng.choice(["user", "assistant", "system", "tool", "user", "assistant", " "]),
                    rng.choice(["Yes.", "No", " ", "", "Why?", "So it is! ", "a.b", "Well.\n"]))
    return [(turn, *pick()) for turn in sorted(rng.sample(range(9), rng.randrange(6)))]


def test_alignment_equals_all_edits(spark):
    rng = random.Random(5)
    chats = {c: random_turns(rng) for c in range(150)}
    chats[None] = [(3, "user", "Hi."), (4, "assistant", "Oh.")]
    chats[900] = [(None, "user", "B."), (2, "user", "A."), (7, "assistant", "C.")]
    flat = [(c, *t) for c, turns in chats.items() for t in turns or [(None, None, None)]]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, "conv bigint, turn bigint, role string, text string").repartition(3)
    found = {r.conv: tuple(r[c] for c in RESULT) for r in conversations.repaired(df).collect()}
    assert found == {c: plain_conversation(turns) for c, turns in chats.items()}


def best_by_states(codes):
    """The least cost over all lengths at once, by the grammar's states."""
    cost = {"start": 0}
    for code in [*codes, None]:
        for _ in range(3):
            for a, b in (("start", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                if a in cost and cost[a] + 3 < cost.get(b, 1 << 40):
                    cost[b] = cost[a] + 3
        if code is None:
            break
        new = {k: v + 4 for k, v in cost.items()}
        if not code & 4:
            more = 3 if code & 8 else 0
            for a, b, want in (("start", "u", 1), ("s", "u", 1), ("a", "u", 1), ("u", "a", 2), ("start", "s", 0)):
                if a in cost and (want or code & 3 == 0):
                    step = cost[a] + more + (0 if code & 3 == want else 3)
                    new[b] = min(new.get(b, 1 << 40), step)
        cost = new
    return min(v for k, v in cost.items() if k in ("start", "a"))


def test_long_conversations_fill_bands_block_by_block():
    rng = random.Random(7)
    for n in (0, 1, 2, 3, 40, 700):
        for _ in range(20 if n < 100 else 2):
            codes = bytes(rng.choice([0, 1, 1, 2, 2, 3]) + rng.choice([0, 0, 0, 0, 4, 8]) for _ in range(n))
            cost, audit = conversations.aligned(codes)
            assert cost == best_by_states(codes)
            made = sum({"D": 4, "I": 3, "K": 0, "R": 3}[e] for e in audit)
            at = -1
            for e in audit:
                at += e != "I"
                made += 3 * (e in "KR" and codes[at] >= 8)
            assert made == cost and len(audit) - audit.count("I") == n


def test_conversation_query_damages_by_hash(spark, tmp_path):
    rng = random.Random(11)
    chat = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["Oh. So!", "yes", None, "No?"]))
            for c in [*range(400), None] for t in [*range(4), None][: rng.randrange(1, 6)]]
    df = spark.createDataFrame(chat, "conv_id bigint, turn bigint, role string, text string")
    df.selectExpr("*", "1 AS conv", "2 AS phase", "'x' AS print").write.parquet(f"{tmp_path}/conversations.parquet")
    expected = {}
    for conv, turn, role, text in chat:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        text = {1: "", 2: "".join(ch for ch in text if ch not in ".!?")}.get(kind, text)
        row = (turn, "user" if kind == 4 else role, text)
        expected.setdefault(conv, []).extend([] if kind == 0 else [row, row] if kind == 3 else [row])
    order = lambda turns: sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0))
    out = registered.op12_conversations(spark, str(tmp_path))
    found = {r.conv_id: tuple(r[c] for c in RESULT) for r in out.collect()}
    assert found == {c: plain_conversation(order(turns)) for c, turns in expected.items()}
    gone = [c for c, turns in expected.items() if not turns]
    assert gone and all(found[c] == (0, 0, 0, 0, 0, 0, "", sha("")) for c in gone)
    assert conversations.repaired(conversations.damaged(df.limit(0))).collect() == []


# Periodic runs


def plain_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)]
        at = 0
        for equal, part in itertools.groupby(same):
            n = len(list(part))
            part = words[at : at + n + q]
            if equal and n + q >= max(6, 4 * q):
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((at, n + q, q))
            at += n
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive_texts():
    rng = random.Random(13)
    out = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b c " * 4, "a b " * 3 + "a", "x " + "a b " * 400 + "y"]
    for n in (30, 60, 200):
        for letters in (1, 2, 3):
            out += [" ".join(rng.choice("abc"[:letters]) for _ in range(n)) for _ in range(8)]
    for _ in range(40):
        unit = [rng.choice("ab") for _ in range(rng.randrange(1, 40))]
        text = unit * rng.randrange(3, 7) + unit[: rng.randrange(len(unit))]
        noise = lambda: [rng.choice("abcd") for _ in range(rng.randrange(9))]
        out.append(" ".join(noise() + text + noise() + text[: rng.randrange(len(text))]))
    # A period in which every stretch of five words comes twice.
    out.append(" ".join((("a b c d e f g h " * 2 + "i ") * 5).split()))
    return out


def test_runs_equal_all_periods(monkeypatch):
    cut = [(t or "").split() for t in repetitive_texts()]
    expected = [plain_runs(w) for w in cut]
    assert sum(map(len, expected)) > 100
    assert periodic.runs_of([[w.encode() for w in words] for words in cut]) == expected


def test_run_query_equals_brute_force(spark, tmp_path):
    texts = list(enumerate(repetitive_texts())) + [(i, prose(i, 37 + i % 60)) for i in range(300, 420)]
    texts += [(5, "a " * 9), (5, "a " * 9), (None, "b c " * 9), (None, prose(3, 40))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "0 AS runs", "1 AS row")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    expected, planted = [], 0
    for i, text in texts:
        words = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n, planted = h // 10, len(words), planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append((i, len(runs), *top, sha(lines), sha(plain_collapsed(words, runs))))
    out = registered.op13_periodic(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str) and planted > 5


def test_runs_keep_other_columns(spark, none):
    df = spark.createDataFrame(DOCS, SCHEMA).selectExpr("*", "1 AS n_words", "2 AS row", "3 AS __hash")
    out = periodic.with_runs(periodic.planted(df))
    assert set(out.columns) == {*df.columns, "runs", "collapsed"}
    assert {(r.row, r["__hash"]) for r in out.collect()} == {(2, 3)} and out.count() == len(DOCS)
    assert periodic.with_runs(periodic.planted(none)).collect() == []


def test_one_word_repeated_is_linear():
    """A text of one word has no pairs but neighbours, and long periods end fast."""
    words = [b"a"] * 300_000
    assert periodic.runs_of([words]) == [[(0, 300_000, 1)]]
    words = [str(i % 70_000).encode() for i in range(300_000)]
    assert periodic.runs_of([words]) == [[(0, 300_000, 70_000)]]
