"""The operators against plain Python on small tables with the cases that break things."""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gleanspark.llm import decontaminate, language, lm, mixing, pii, quality, search, simhash, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TO_LOWER = {i: i + 32 for i in range(65, 91)}
SYLLABLES = ["ka", "lo", "mi", "ren", "tas", "du", "vel", "po", "shi", "gar"]


def prose(seed, words, tail=""):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(words)) + tail


DOCS = [
    (1, prose(1, 80), "en", "b"),
    (2, prose(1, 80), "en", "a"),
    (3, prose(1, 79) + " changed", "en", "a"),
    (4, None, None, None),
    (5, "", "fr", "a"),
    (6, " \t\n", "fr", ""),
    (None, prose(1, 80), "en", "a"),
    (7, prose(7, 3000), "fr", "b"),
    (7, prose(7, 3000), "fr", "b"),
    (8, "One", "fr", "c"),
    (9, "12345 %%% 67", None, "c"),
    (50, prose(50, 40), "de", "c"),
    (51, prose(50, 40) + " end", "de", None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated, NULL, empty and long rows, with extra columns whose names clash."""
    df = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    return df.selectExpr("*", "'x' AS score", "'y' AS doc", "0D AS fp", "1 AS size", "2 AS word")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# SimHash


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(TO_LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    """Component number of each position, by comparing all pairs."""
    names = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance and names[i] != names[j]:
                old, new = names[i], names[j]
                names = [new if n == old else n for n in names]
    return names


def test_simhash_equals_all_pairs(docs):
    prints = [plain_fingerprint(d[1]) for d in DOCS]
    names = plain_components(prints)
    least = {n: min((d[0] for d, m in zip(DOCS, names) if m == n and d[0] is not None), default=None) for n in names}
    expected = sorted(((d[0], f"{p:016x}", least[n]) for d, p, n in zip(DOCS, prints, names)), key=str)
    assert rows(simhash.components(docs), "doc_id", "fingerprint", "component_id") == expected


def test_simhash_keeps_one_of_each_component(docs):
    names = plain_components([plain_fingerprint(d[1]) for d in DOCS])
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(names))
    assert {1, 7} <= {r[0] for r in kept.select("doc_id").collect()}


@pytest.mark.parametrize("spread", [6, 20, 64])
def test_links_equal_all_pairs_when_groups_are_cut_again(spark, spread):
    rng = np.random.default_rng(spread)
    bits = rng.integers(0, 64, (400, 4)) % spread
    prints = sorted({int(np.bitwise_xor.reduce(np.uint64(1) << b.astype(np.uint64))) for b in bits})
    names = plain_components(prints)
    expected = {tuple(sorted(p for p, n in zip(prints, names) if n == m)) for m in set(names)}
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp bigint")
    tied = simhash.contracted(simhash.links(df, group_rows=16))
    root = {r.u: r.root for r in tied.collect()}
    found = {}
    for p in prints:
        found.setdefault(root.get(simhash.signed(p), simhash.signed(p)), []).append(p)
    assert {tuple(sorted(g)) for g in found.values()} == expected


def test_gray_index_finds_every_pair():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64)
    prints = np.unique(centre ^ np.bitwise_or.reduce(flips, axis=1))
    index = simhash.GrayIndex(prints)
    ordered = index.levels[0][0]
    found = {(int(a), int(b)) for x, y in index.pairs(2) for a, b in zip(x, y)}
    near = np.bitwise_count(ordered[:, None] ^ ordered[None, :]) <= 2
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))}
    assert found


# Quality


def test_quality_learns_from_statistics(spark):
    texts = [(i, prose(i, 30) if i % 2 else prose(i, 30).replace(" ", "%%% "), i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id bigint, quality int")
    from pyspark.sql import functions as F

    found = quality.quality(docs, labels, F.col("doc") % 3 == 1).collect()
    assert len(found) == 302 and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)


def test_quality_without_labels_is_undecided(docs, spark):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    found = quality.quality(docs, labels, F.lit(False)).collect()
    assert len(found) == len(DOCS) and {r.score for r in found} == {0.5}


def test_quality_of_no_texts_and_of_labels_that_contradict(spark, none):
    from pyspark.sql import functions as F

    both = spark.createDataFrame([(i, q) for i in range(40) for q in (0, 1)] * 2 + [(None, 1), (7, None), (999, 0)], "doc_id bigint, quality int")
    assert quality.quality(none, both, F.lit(False)).count() == 0
    texts = [(i, prose(i, 30)) for i in range(40)] + [(3, prose(3, 30)), (None, "x")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = quality.quality(df, both, F.lit(False)).collect()
    assert len(found) == 42 and all(abs(r.score - 0.5) < 1e-6 for r in found)
    assert len({r.score for r in found if r.doc_id == 3}) == 1


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 20)).astype(np.float32)
    trees = quality.BoostedTrees.fitted(x, (x[:, 3] + x[:, 5] > 0).astype(float))
    bins = quality.binned(x, trees.edges)
    for row in range(20):
        total = trees.base
        for t in range(quality.TREES):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + int(bins[row, trees.feature[t, node]] > trees.edge[t, node])
            total += trees.leaf[t, node - (1 << quality.DEPTH) + 1]
        assert trees.score(x[row : row + 1])[0] == pytest.approx(1 / (1 + math.exp(-total)))


# Search


def plain_search(texts, query, k):
    tallies = [(d, Counter(WORD.findall((t or "").translate(TO_LOWER)))) for d, t in texts]
    mean = sum(sum(c.values()) for _, c in tallies) / len(tallies)
    df, scored = Counter(w for _, c in tallies for w in c), []
    for d, c in tallies:
        length, total = sum(c.values()), 0.0
        for w in set(WORD.findall((query or "").translate(TO_LOWER))) & set(c):
            idf = math.log(1 + (len(tallies) - df[w] + 0.5) / (df[w] + 0.5))
            total += idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean))
        if total:
            scored.append((-round(total, 6), d is None, d))
    return [(d, -s) for s, _, d in sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k]]


def test_search_equals_scoring_everything(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_WORDS", 500)
    texts = [(d[0], d[1]) for d in DOCS] + [(100 + i, prose(i % 7, 20 + i)) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(2)
    asked = [(1, DOCS[0][1]), (2, "KA lo"), (3, None), (4, "nothing-like-this"), (5, DOCS[0][1])]
    queries = spark.createDataFrame(asked, "query_id bigint, query_text string")
    found = search.search(docs, queries, k=5).collect()
    for number, text in asked:
        got = [(r.doc_id, r.score) for r in sorted((r for r in found if r.query_id == number), key=lambda r: r["rank"])]
        expected = plain_search(texts, text, 5)
        assert [g[0] for g in got] == [e[0] for e in expected]
        assert [g[1] for g in got] == pytest.approx([e[1] for e in expected], abs=1e-5)


@pytest.mark.parametrize("share, matrix, entries", [(0.0, 1 << 20, 50), (2.0, 1 << 20, 1 << 19), (0.02, 2_000, 7)])
def test_search_splits_words_off_and_stays_exact(spark, monkeypatch, share, matrix, entries):
    """All words in the matrix, none, some: the same results, with copies, NULLs, ties and many blocks of texts."""
    for name, value in (("SPLIT_SHARE", share), ("MATRIX", matrix), ("ENTRIES", entries), ("SUMS", 500), ("BLOCK_TEXTS", 4), ("SHARD_WORDS", 2_000)):
        monkeypatch.setattr(search, name, value)
    texts = [(i, prose(i % 50, 5 + i % 40) + (" frequent" if i % 3 else "")) for i in range(150)]
    texts += [(None, texts[3][1]), (None, texts[3][1]), (500, None), (501, "\x1c ß É"), (502, "É ß")] + [(600 + i, "same words") for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    asked = [(i, t) for i, (_, t) in enumerate(texts[:40:3])] + [(100, "same"), (101, "frequent"), (102, texts[3][1]), (103, "É \x1c")]
    queries = spark.createDataFrame(asked, "query_id bigint, query_text string")
    found = search.search(docs, queries, k=7).collect()
    for number, text in asked:
        got = [(r.doc_id, r.score) for r in sorted((r for r in found if r.query_id == number), key=lambda r: r["rank"])]
        expected = plain_search(texts, text, 7)
        assert [g[0] for g in got] == [e[0] for e in expected]
        assert [g[1] for g in got] == pytest.approx([e[1] for e in expected], abs=1e-5)


def test_a_search_task_hands_on_k_rows_a_query(spark, monkeypatch):
    """A task has one list of the best for all its shards, not one for each."""
    monkeypatch.setattr(search, "SHARD_WORDS", 100)
    written, real = {}, search.materialize

    def watched(df, name):
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(search, "materialize", watched)
    docs = spark.createDataFrame([(i, prose(i % 9, 20)) for i in range(200)], "doc_id bigint, text string").coalesce(1)
    queries = docs.limit(10).selectExpr("doc_id AS query_id", "text AS query_text")
    found = search.search(docs, queries, k=3)
    assert written["search-index"].count() > 20
    assert written["search-met"].count() <= 9 * 3 and found.count() == 10 * 3


def test_search_skips_blocks_that_cannot_pass(monkeypatch):
    """Texts with the same frequent words are neighbours, so a query meets few blocks."""

    class Here:
        mapInArrow = staticmethod(lambda build, schema: build)

    draw = np.random.default_rng(5)
    texts = [" ".join(f"{'ab'[i % 2]}{n}" for n in draw.integers(0, 30, 40)) for i in range(640)]
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(640), pa.int64()), "text": texts})
    row, = search.rows_of(b.drop_columns(["n_texts", "n_words"]) for b in search.index(Here())(iter([batch])))
    wanted = {f"a{n}".encode(): n for n in range(30)}
    met, live = [], search.Shard.live
    monkeypatch.setattr(search.Shard, "live", lambda self, *rest: met.append(live(self, *rest)) or met[-1])
    words, idf = np.arange(30), np.full(30, 0.7)
    best = search.best_of(iter([row]), wanted, search.starts_of(np.array([30])), words, idf, 40.0, 10)
    assert (best.doc % 2 == 0).all() and len(met) == 1 and 0 < len(met[0]) <= 14


class Here:
    """Stands for a table of which a function of batches is wanted, to call it without Spark."""

    mapInArrow = staticmethod(lambda build, schema: build)


@pytest.mark.parametrize("factors", [search.FACTORS, (0, 0)])
def test_search_in_groups_stays_exact(monkeypatch, factors):
    """Many groups of texts and of queries, several shards, and words that all have the same hash."""
    small = {"GROUP_TEXTS": 9, "GROUP_QUERIES": 3, "BLOCK_TEXTS": 4, "SHARD_WORDS": 1_500, "MEMBERS": 300, "SUMS": 400, "FIT_ROWS": 16}
    for name, value in (small | {"SPLIT_SHARE": 0.01, "FACTORS": factors}).items():
        monkeypatch.setattr(search, name, value)
    other = lambda text, i: " ".join(f"{w}{'xyz'[i % 3]}" if n % 5 else w for n, w in enumerate(text.split(" ")))
    texts = [(i, other(prose(i % 60, 6 + i % 33), i)) for i in range(180)]
    texts += [(None, ""), (None, other(prose(2, 8), 2)), (700, "a-word-of-more-than-eight-bytes \u00e4 a-word-of-more-than-eight-bytez")]
    asked = [t for _, t in texts[:90:4]] + ["a-word-of-more-than-eight-bytez", "a-word-of-more-than-eight"]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts], pa.int64()), pa.array([t for _, t in texts])], ["doc", "text"])
    rows = list(search.index(Here())(iter([batch])))
    shards = list(search.rows_of(b.drop_columns(["n_texts", "n_words"]) for b in rows))
    wanted: dict = {}
    words = [np.array([wanted.setdefault(w, len(wanted)) for w in dict.fromkeys(search.words_of(t.encode()))], np.int32) for t in asked]
    flat, sizes = np.concatenate(words), np.array([len(w) for w in words])
    order, cuts = search.alike(np.repeat(np.arange(len(words)), sizes), flat, len(words), search.GROUP_QUERIES, len(wanted))
    known, n = search.Words(wanted), np.zeros(len(wanted))
    for row in shards:
        number = known.of(row)
        n[number[number >= 0]] += np.frombuffer(row["found"], np.uint32)[number >= 0]
    mean = sum(b["n_words"][0].as_py() for b in rows) / len(texts)
    idf = np.log(1 + (len(texts) - n + 0.5) / (n + 0.5))
    start = search.starts_of(sizes[order])
    best = search.best_of(iter(shards), known, start, np.concatenate([words[i] for i in order]), idf, mean, 6, cuts)
    assert len(shards) > 2 and len(cuts) > 4
    for place, number in enumerate(order):
        some = best.score[place] >= 0
        got = [d if has else None for d, has in zip(best.doc[place][some], best.has[place][some])]
        expected = plain_search(texts, asked[number], 6)
        assert got == [e[0] for e in expected]
        assert best.score[place][some] == pytest.approx([e[1] for e in expected], abs=1e-5)


def test_search_multiplies_only_what_a_group_of_texts_has(monkeypatch):
    """Two vocabularies: a group's matrix has the words of one, and no product meets the queries of the other."""
    draw, n = np.random.default_rng(6), 1_600
    texts = [" ".join(f"{'ab'[i // 5 % 2]}{w}" for w in draw.integers(0, 30, 40)) for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(n), pa.int64()), "text": texts})
    row, = search.rows_of(b.drop_columns(["n_texts", "n_words"]) for b in search.index(Here())(iter([batch])))
    wanted = {f"{v}{w}".encode(): w + 30 * (v == "b") for v in "ab" for w in range(30)}
    met, reach = [], search.Shard.reach
    monkeypatch.setattr(search.Shard, "reach", lambda self, *rest: met.append((self, reach(self, *rest))) or met[-1][1])
    words, start = np.concatenate([np.arange(30), np.arange(30, 60)]), np.array([0, 30, 60])
    best = search.best_of(iter([row]), wanted, start, words, np.full(60, 0.7), 40.0, 10)
    assert [set(best.doc[q] // 5 % 2) for q in (0, 1)] == [{0}, {1}]
    (shard, can), = met
    assert sum(matrix.size for *_, matrix in shard.parts) < 0.7 * shard.width * 60
    assert can.mean() < 0.6


def test_search_broadcasts_plain_data(spark, monkeypatch):
    """Broadcasts are pickled by reference, and executors may not have the library."""
    sent, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or real(self, value))
    docs = spark.createDataFrame([(i, prose(i % 9, 20)) for i in range(40)], "doc_id bigint, text string")
    assert search.search(docs, docs.limit(3).selectExpr("doc_id AS query_id", "text AS query_text"), k=2).count() == 6
    assert sent and not any(b"gleanspark" in pickle.dumps(value) for value in sent)


def test_search_of_and_for_nothing(docs, none):
    asked = docs.selectExpr("doc_id AS query_id", "text AS query_text")
    assert search.search(none, asked).count() == 0
    assert search.search(docs, asked.limit(0)).count() == 0


# PII

FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain_spans(text):
    only = lambda m: re.sub("[^0-9]", "", m)
    valid = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m)), "phone": lambda m: 9 <= len(only(m)) <= 15,
    }
    return [
        (kind, m.start(), m.end())
        for kind, form in FORMATS.items() for m in re.finditer(form, text or "") if valid[kind](m[0])
    ]


PRIVATE = [
    "", None, "mail a@b.c@d.e and x.y+z@q-r.org.", "a@b.c+d@e.fg a@b a@.b @x.y ..@a.b", "é😀 me@x.org 😀 10.0.0.1",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "79927398713 0000000000000 41111111111111111111", "+1 (132) 555-1352 +12 3 +1-2-3-4-5-6-7-8-9. +123456789012345678",
    "4111  1111--1111 4242424242424242,5555555555554444", "9" * 30000, "a" * 30000 + "@", "1." * 20000, "+1" * 5000,
    "x@y.zz" * 300,
]


def test_base_spans_equal_plain_expressions(spark):
    docs = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id bigint, text string")
    for r in pii.personal_data(docs).collect():
        expected = [f"{k}:{a}:{b}" for k, a, b in plain_spans(PRIVATE[r.doc_id])]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in expected) for k in FORMATS]
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert set(expected) <= set(r.spans.split(",")) | {""}


def test_trees_add_spans_that_look_alike(spark):
    good = [(i, f"card 4111 1111 1111 1111 of {prose(i, 5)}") for i in range(200)]
    odd = [(500, "card 4111 1111 1111 1112 of someone")]
    docs = spark.createDataFrame(good + odd, "doc_id bigint, text string")
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert found[500].n_card == 0 and found[500].spans == "card:5:24"
    assert pii.redacted(docs).filter("doc_id = 500").first().text == "card <CARD> of someone"


def test_redaction_changes_texts_with_spans_alone(docs, none):
    assert rows(pii.redacted(docs), *docs.columns) == rows(docs, *docs.columns)
    assert pii.redacted(none).count() == 0 and pii.personal_data(none).count() == 0


# Archives


def test_archives_give_back_every_page(spark):
    long, copy = "<p>" + prose(3, 5000), "<p>" + prose(4, 300)
    pages = [(1, "http://a/\r\nx", long), (2, None, copy), (9, "u", copy), (5, "u", copy), (None, "u", copy),
             (6, "u", None), (7, "u", ""), (8, "ü", "tiny"), (10, "u", "tiny"), (9, "u", copy)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    df = df.selectExpr("*", "'z' AS digest", "1 AS keeper")
    expected = []
    for page, _, html in pages:
        raw = (html or "").encode()
        revisit = html == copy and page != 9
        expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    got = rows(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(expected, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def archive(tmp_path, records, trained=b""):
    writer = warc.ArchiveWriter(str(tmp_path), trained)
    for r in records:
        list(writer.add(r))
    (name, n, size), = writer.close()
    assert n == len(records)
    return (tmp_path / name).read_bytes()


def test_reader_refuses_broken_archives(tmp_path):
    import io

    record = warc.record(1, "u", b"payload" * 50, hashlib.sha1(b"payload" * 50).hexdigest(), None)
    trained = warc.dictionary([prose(i, 50).encode() for i in range(300)])
    raw = archive(tmp_path, [record, record], trained)
    assert raw[:4] == b"\x5d\x2a\x4d\x18"
    assert [warc.parsed(f)["page"] for f in warc.frames(io.BytesIO(raw))] == [1, 1]
    for broken in (raw[:-3], raw[: len(trained) // 2], raw + b"junk"):
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(broken)))
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"payload", b"Payload"), (b"Content-Length: 4", b"Content-Length: 5")):
        with pytest.raises(ValueError):
            warc.parsed(record.replace(old, new, 1))


# Mixing


def test_mixing_meets_targets(docs, spark):
    rng = np.random.default_rng(2)
    many = [(i, prose(i, int(rng.integers(1, 40))), None, f"s{int(rng.integers(0, 5)) ** 2 % 5}") for i in range(800)]
    df = spark.createDataFrame(many, SCHEMA).union(docs.select("doc_id", "text", "lang", "source"))
    found = mixing.mixture(df).collect()
    again = mixing.mixture(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, r.source_size)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert len(found) == 800 + len(DOCS) and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in found)
    by = {}
    for r in found:
        by.setdefault((r.source_size, r.target), []).append(r)
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in found))
    for (size, target), its in by.items():
        assert target <= 3 * size + 1e-9
        assert sum(r.size for r in its) == size
        taken = sum(r.taken for r in its)
        assert taken <= target + 1e-6 and target - taken <= 2 * max(r.size for r in its)


def test_mixed_rows_are_the_taken_ones(docs, none):
    taken = Counter(r.doc_id for r in mixing.mixture(docs).collect() if r.taken)
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns + ["mix_times"]
    assert Counter(r.doc_id for r in kept.collect() if r.text and r.text.strip()) == taken
    assert mixing.mixture(none).count() == 0 and mixing.mixed(none).count() == 0


# URLs


@pytest.mark.parametrize("url, expected", [
    (None, ("", "", None, "allow")),
    ("example.org/es/", ("", "", None, "allow")),
    ("http://Example.ORG/es/x?y#z", ("example.org", "/es/x", "example.org/es/", "block")),
    ("https://a.b.example.org/en/12", ("a.b.example.org", "/en/12", "example.org/en/1", "block")),
    ("https://example.org/en/2", ("example.org", "/en/2", "org/", "allow")),
    ("https://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
    ("https://example.org?x=/es/", ("example.org", "", None, "allow")),
    ("https://m.casino-win.example.com/en/", ("m.casino-win.example.com", "/en/", None, "block")),
    ("https://casinos.example.com/fr/1", ("casinos.example.com", "/fr/1", "com/fr/", "allow")),
    ("x://com/de/://org/", ("com", "/de/://org/", "com/de/", "block")),
    ("http://", ("", "", None, "allow")),
])
def test_urls(spark, url, expected):
    df = spark.createDataFrame([(1, url, "x")], "page_id bigint, url string, host string")
    r = urls.judged(df).first()
    assert (r.host, r.path, r.rule, r.verdict) == expected


def test_rules_are_indexed_by_their_rarest_token():
    index = urls.RuleIndex(urls.RULES, [urls.Pattern("block", "x*y")], {"org": 100, "example": 5, "es": 9, "en": 9})
    assert {r.text for _, _, r in index.by_token["example"]} == {"example.org/es/", "example.org/en/1"}
    assert [r.text for _, _, r in index.always] == ["x*y"]
    assert index.first("a-x.com", "/b/y").verdict == "block"


# Languages


def plain_judgement(url, rules, patterns, otherwise="allow"):
    """(host, path, rule, verdict) by trying every rule and pattern on the URL."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split("[?#]", rest[cut:], maxsplit=1)[0]
    fits = []
    for rule in rules:
        name, slash, start = rule.text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + start):
            fits.append(rule)
    if fits:
        best = max(fits, key=lambda r: len(r.text))
        return host, path, best.text, best.verdict
    place = (host + path).translate(TO_LOWER)
    for p in patterns:
        middle = ".*".join(map(re.escape, p.text.split("*")))
        for m in re.finditer(f"(?s)(?={middle})", place):
            for end in range(m.start(), len(place) + 1):
                whole = re.fullmatch(f"(?s){middle}", place[m.start() : end])
                free = lambda c: not re.fullmatch("[a-z0-9]", c)
                if whole and free(place[m.start() - 1 : m.start()] if m.start() else "") and free(place[end : end + 1]):
                    return host, path, None, p.verdict
    return host, path, None, otherwise


def test_urls_equal_every_rule_on_every_url(spark):
    rng = np.random.default_rng(61)
    pick = lambda options: options[int(rng.integers(len(options)))]
    hosts = ["example.org", "a.example.org", "EXAMPLE.org", "notexample.org", "org", "x.com", "com", "b.c.net", "bet.com", "", "xorg"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/a", "/en/2", "/fr/", "/de/x", "/FR/", "/my-bets/", "/abets", "/a_poker_b", "/x/free-y"]
    ends = ["", "?q=casino", "#es/", "/poker?x", "/Casino"]
    made = [pick(["http://", "https://", "x://", "", "//"]) + pick(hosts) + pick(paths) + pick(ends) for _ in range(400)]
    made += [None, "", "://", "a://b://c/es/", "http://example.org/es/\n", made[0], made[0]]
    lists = [(urls.RULES, urls.PATTERNS), ((), ()), (
        [urls.Rule("block", "example.org/"), urls.Rule("allow", "a.example.org/en/"), urls.Rule("block", "net/"), urls.Rule("allow", "x.com/es")],
        [urls.Pattern("block", "free*y"), urls.Pattern("allow", "my-bets"), urls.Pattern("block", "my*"), urls.Pattern("block", "org")])]
    df = spark.createDataFrame(list(enumerate(made)), "page_id bigint, url string").repartition(3)
    for rules, patterns in lists:
        found = urls.judged(df.selectExpr("*", "'h' AS host", "1 AS page"), rules=rules, patterns=patterns)
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()} == {
            i: plain_judgement(u, rules, patterns) for i, u in enumerate(made)}
    assert urls.judged(df.limit(0)).collect() == []


def test_dictionary_sample_takes_a_copied_page_once(spark, monkeypatch):
    """Thousands of copies of a drawn page do not come to the driver."""
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 1 << 16)
    monkeypatch.setattr(warc, "SAMPLE_PAGE_BYTES", 1 << 13)
    seen = []
    monkeypatch.setattr(warc, "dictionary", lambda sample: seen.extend(sample) or b"")
    page = prose(70, 500)
    df = spark.createDataFrame([(i, "u", page if i % 3 else prose(i, 200)) for i in range(900)] + [(900, "u", page * 9)],
                               "page_id bigint, url string, html string")
    found = warc.round_trip(df)
    assert sum(map(len, seen)) <= 1 << 16 and len(seen) == len(set(seen)) and max(map(len, seen), default=0) <= 1 << 13
    assert found.count() == 901


def test_languages_and_mixtures(spark, docs, none):
    sounds = {"aa": "bdg", "bb": "ptk", "cc": "lrm"}
    rng = np.random.default_rng(4)

    def text(lang, n):
        return " ".join("".join(rng.choice(list(sounds[lang] + "aeiou"), 6)) for _ in range(n))

    training = spark.createDataFrame([(text(x, 200), x) for x in sounds for _ in range(10)] + [(None, "aa"), ("x", None)], "text string, lang string")
    asked = [text("aa", 50), text("bb", 90) + " " + text("cc", 30), None, "", "123 %%", "漢字"]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in language.with_language(df, training).collect()}
    assert found[0].lang_pred == "aa" and found[0].score > 0.9
    assert found[1].lang_pred == "bb" and 0.6 < found[1].score < 0.9
    assert [found[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3
    assert found[5].lang_pred in sounds and 0 <= found[5].score <= 1
    assert {r.lang_pred for r in language.with_language(docs, none).collect()} == {"und"}
    assert language.with_language(none, training).count() == 0


def test_languages_of_repeated_rows_and_of_texts_in_several_chunks(spark, monkeypatch):
    sounds = {"aa": "bdg", "bb": "ptk"}
    rng = np.random.default_rng(8)

    def text(lang, n):
        return " ".join("".join(rng.choice(list(sounds[lang] + "aeiou"), 6)) for _ in range(n))

    pieces = [text(x, 3000) for x in sounds]
    long = " ".join([pieces[0]] * 20 + [pieces[1]] * 60)
    assert len(long) > language.CHUNK
    whole = language.trigrams(long)
    monkeypatch.setattr(language, "CHUNK", 4099)
    cut = language.trigrams(long)
    assert all(np.array_equal(x, y) for x, y in zip(whole, cut))
    raw = f" {long} ".encode()
    assert whole[1].sum() == len(raw) - 2
    monkeypatch.undo()
    training = spark.createDataFrame([(p, x) for p, x in zip(pieces, sounds)] * 3, "text string, lang string")
    df = spark.createDataFrame([(1, long), (1, long), (2, pieces[0]), (2, pieces[0])], "doc_id bigint, text string")
    found = language.with_language(df, training).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in found) == [(1, "bb")] * 2 + [(2, "aa")] * 2
    # Three of four words are of the second language, which a reader of the first chunk would miss.
    assert {round(r.score, 1) for r in found if r.doc_id == 1} <= {0.7, 0.8}
    assert len({(r.doc_id, r.score) for r in found}) == 2


def test_short_texts_have_a_language(spark):
    sounds = {"aa": "bdg", "bb": "ptk", "cc": "lrm"}
    rng = np.random.default_rng(5)

    def text(lang, n):
        return " ".join("".join(rng.choice(list(sounds[lang] + "aeiou"), 6)) for _ in range(n))

    training = spark.createDataFrame([(text(x, 200), x) for x in sounds for _ in range(10)], "text string, lang string")
    asked = ["B.", "t", " 1 l 2", "x", " ".join(text(x, 100) for x in sounds), "1.", None, "½", "² Ⅷ ①", "_", "ª"]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in language.with_language(df, training).collect()}
    assert all(found[i].lang_pred in sounds and found[i].score > 0 for i in range(5))
    # Number signs are no letters; an ordinal sign is one.
    assert [found[i].lang_pred for i in (5, 6, 7, 8, 9)] == ["und"] * 5 and found[10].lang_pred in sounds
    assert found[3].score < language.MIN_SCORE and found[4].score < language.MIN_SCORE
    assert {r.doc_id for r in language.identified(df, training).collect()} == {0, 1, 2, 3, 10}


def plain_mixture(likely, weight):
    """Shares by expectation-maximisation, far beyond convergence."""
    share = np.full(likely.shape[1], 1 / likely.shape[1])
    for _ in range(3000):
        share = share * ((weight / (likely @ share)) @ likely) / weight.sum()
    return share


def test_language_sets_equal_plain_mixtures():
    """The set grows by share while the penalised likelihood does, whatever share the next one has."""
    rng = np.random.default_rng(8)
    table = rng.gamma(0.3, size=(language.BUCKETS, 5)).astype(np.float32) + np.float32(1e-4)
    judge = language.Mixture(list("vwxyz"), table)
    sure = 0
    for n in (3, 30, 300, 3000, 30000):
        for _ in range(6):
            text = "".join(rng.choice(list("abcdefgh "), n))
            bucket, count = language.trigrams(text)
            likely, weight = table[bucket].astype(float), count.astype(float)
            overall = plain_mixture(likely, weight)
            reach = lambda shares: weight @ np.log(likely @ shares)
            assert reach(overall) - reach(judge.shares(likely, weight)) < language.CONVERGED
            order = np.argsort(-overall, kind="stable")
            best, share = weight @ np.log(likely[:, order[0]]), np.ones(1)
            for size in range(2, 6):
                tried = plain_mixture(likely[:, order[:size]], weight)
                reached = weight @ np.log(likely[:, order[:size]] @ tried)
                if reached - best <= language.PENALTY * np.log(weight.sum() + 1):
                    break
                best, share = reached, tried
            top = np.sort(share)[::-1]
            if len(share) == 1 or top[0] - top[1] > 0.02:
                sure += 1
                name, score, _ = judge.judge(text)
                assert name == "vwxyz"[order[int(np.argmax(share))]]
                # Of a short text, shares far apart are equally likely.
                assert n < 300 or score == pytest.approx(overall["vwxyz".index(name)], abs=0.02)
    assert sure > 20


# Decontamination


def plain_distance(item, text):
    """Fewest edits between the item and any stretch of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for letter in text:
        new = [0]
        for i, c in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != letter)))
        row, best = new, min(best, new[-1])
    return best


def test_decontamination_equals_full_distances(spark, docs, none):
    item = prose(70, 20)
    edited = list(item)
    for at in range(5, len(edited) - 5, 12):
        edited[at] = "#"
    texts = [f"{prose(1, 30)} {item.upper()}  {prose(2, 30)}", f"{prose(3, 30)} {''.join(edited)}", item[: len(item) // 2],
             prose(71, 200), None, "", item[10:], item + item]
    items = [(1, item), (2, None), (3, " "), (4, prose(99, 15)), (1, item)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = []
    for number, text in enumerate(texts):
        for item_id, content in items:
            content = decontaminate.plain(content)
            if content and (d := plain_distance(content, decontaminate.plain(text))) <= int(0.1 * len(content)):
                expected.append((number, item_id, d))
    assert {e[0] for e in expected} >= {0, 1, 7}
    for size in (1 << 20, 64):
        assert rows(decontaminate.contaminated(df, bench, block_bytes=size), "doc_id", "item_id", "edits") == sorted(expected, key=str)
    kept = decontaminate.decontaminated(df, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {e[0] for e in expected}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(none, bench).count() == 0


# Language model


def test_base_scores_equal_counting(docs):
    from pyspark.sql import functions as F

    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    held = F.crc32(F.coalesce(F.col("doc").cast("string"), F.lit(""))) % 10 == 0
    words = [WORD.findall((d[1] or "").translate(TO_LOWER)) for d in DOCS]
    train = [w for d, w in zip(DOCS, words) if not out(d[0])]
    c = Counter(w for t in train for w in t)
    c[None] = len(train)
    total, kinds = sum(c.values()), len(c)
    log = lambda w: math.log10((c.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1)))
    expected = sorted(
        ((str(d[0]), len(w) + 1, sum(c.get(x, 0) > 0 for x in [*w, None]), round(sum(map(log, [*w, None])), 6))
         for d, w in zip(DOCS, words)), key=str)
    for head in (lm.HEAD_WORDS, 3):
        found = lm.log_probabilities(docs, held)
        got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found.collect()), key=str)
        assert got == expected
        assert {r.train_tokens for r in found.collect()} == {total}
        assert all(r.score < 0 for r in found.collect())
        lm.HEAD_WORDS, head = 3, lm.HEAD_WORDS
    lm.HEAD_WORDS = 100_000


def test_a_long_text_is_scored_whole(spark):
    """Every word counts, repeated rows agree up to rounding, and more text means less probability."""
    from pyspark.sql import functions as F

    text = prose(81, 20_000)
    rows = [(i, prose(i, 40)) for i in range(1, 40)] + [(40, text), (40, text), (50, text + " " + prose(82, 500))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = lm.log_probabilities(df, F.col("doc") >= 40).collect()
    assert len(found) == len(rows)
    one, two = [r for r in found if r.doc_id == 40]
    longer, = [r for r in found if r.doc_id == 50]
    assert one[:-1] == two[:-1] and one.n_tokens == 20_001 and longer.n_tokens == 20_501
    # Windows are scored in batches of single precision: equal rows agree up to rounding.
    assert math.isclose(one.score, two.score, rel_tol=1e-7)
    assert longer.score < one.score < 0 and longer.base_score < one.base_score < 0


def test_no_texts_no_scores(none):
    from pyspark.sql import functions as F

    assert lm.log_probabilities(none, F.lit(False)).count() == 0


def test_every_training_text_trains(spark, monkeypatch):
    from pyspark.sql import functions as F

    trained, real = [], lm.averaged

    def watched(texts, *rest):
        trained.append(texts.count())
        return real(texts, *rest)

    monkeypatch.setattr(lm, "averaged", watched)
    df = spark.createDataFrame([(i, prose(i, 40)) for i in range(60)], "doc_id bigint, text string")
    assert all(r.score < 0 for r in lm.log_probabilities(df, F.col("doc") % 10 == 0).collect())
    assert sum(trained) == 54
    assert {r.score for r in lm.log_probabilities(df, F.lit(True)).collect()} == {None}


@pytest.mark.parametrize("length", [1, 31, 32, 33, 56, 57, 500])
def test_every_place_counts_once(length):
    texts = [np.arange(length, dtype=np.int32) % 7, np.arange(3, dtype=np.int32)]
    places = np.concatenate([place[counted] for _, _, counted, place in lm.cut(texts, 9)])
    assert sorted(places) == list(range(length + 3))


def test_attention_looks_back_only():
    weights = lm.Attention.fresh(np.full(12, 1 / 12))
    model = lm.Attention(weights + np.float32(0.3), 12)
    units = np.random.default_rng(0).integers(0, 12, (2, 20))
    other = units.copy()
    other[:, 10:] = 3
    assert np.allclose(model.forward(units)[0][:, :10], model.forward(other)[0][:, :10], atol=1e-5)
    counted = np.ones((2, 20), dtype=bool)
    nexts = np.roll(units, -1, axis=1)
    z = model.forward(units)[0]
    assert np.exp(z).sum(axis=2) == pytest.approx(1, abs=1e-4)
    same = np.take_along_axis(z, nexts[:, :, None], 2).ravel()
    assert np.allclose(same, model.log_probabilities(units, nexts, counted), atol=1e-4)


def test_training_lowers_the_loss():
    pattern = np.tile(np.array([0, 3, 5, 1, 7], dtype=np.int32), 200)
    model = lm.Attention(lm.Attention.fresh(np.full(9, 1 / 9)), 9)
    loss = lambda: -np.mean([model.log_probabilities(i, n, c).mean() for i, n, c, _ in lm.cut([pattern], 9)])
    before = loss()
    lm.adam(model, iter([b[:3] for _ in range(60) for b in lm.cut([pattern], 9)]))
    assert loss() < before / 3


def test_every_subword_id_is_input_and_target(spark):
    """Words of equal frequency are told apart by what stands before them."""
    from pyspark.sql import functions as F

    counts = np.random.default_rng(1).integers(0, 3, 5_000).astype(float)
    unit, share = lm.unit_table(counts)
    assert sorted(unit) == list(range(5_000)) and share.sum() == pytest.approx(1)
    assert list(share) == sorted(share, reverse=True)
    model = lm.Attention(lm.Attention.fresh(share), 5_000)
    # Before training, every id has its share.
    nexts = np.arange(5_000)
    found = model.predicted(np.zeros((5_000, lm.WIDTH), dtype=np.float32), nexts)
    assert np.allclose(np.exp(found), share, rtol=1e-3)
    pairs = [("red", "apple"), ("blue", "river")] * 30
    rows = [(i, " ".join([*pairs[i]] * 5_000)) for i in range(60)]
    rows += [(60, " ".join(["red", "apple"] * 20)), (61, " ".join(["red", "river"] * 20))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = {r.doc_id: r for r in lm.log_probabilities(df, F.col("doc") >= 60).collect()}
    assert found[60].base_score == pytest.approx(found[61].base_score)
    assert found[60].score > found[61].score + 1


def test_weights_follow_the_ids_of_training_texts(spark, monkeypatch):
    """Ids that no training text has share a unit, in equal parts; they take no weights and no steps."""
    from pyspark.sql import functions as F

    counts = np.array([0, 5, 0, 9, 0, 1.0])
    unit, share, unseen = lm.seen_units(*lm.unit_table(counts), counts)
    assert list(unit) == [3, 1, 3, 0, 3, 2] and unseen == 3 and share.sum() == pytest.approx(1)
    assert share[3] == pytest.approx(0.3 / 15.6) and lm.seen_units(*lm.unit_table(counts + 1), counts + 1)[2] == 0
    sizes, real = [], lm.averaged

    def watched(texts, unit, weights, units):
        sizes.append(len(weights))
        return real(texts, unit, weights, units)

    monkeypatch.setattr(lm, "averaged", watched)
    rows = [(i, prose(i, 40)) for i in range(40)] + [(40, "ka lo"), (41, "ka Ω"), (42, "ka Ж")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.score for r in lm.log_probabilities(df, F.col("doc") >= 40).collect()}
    assert 0 < max(sizes) < 50_000
    assert found[42] < found[40] < 0 and found[41] < found[40]


@pytest.mark.parametrize("high", [5.0, 500.0])
def test_shares_are_a_softmax(high):
    """Also where e can't be raised to the numbers as they are."""
    z = np.array([[high, 0, -1], [-high, -high, -high], [0, high, high]], dtype=np.float32)
    exact = z.astype(float) - z.max(axis=1, keepdims=True)
    exact = exact - np.log(np.exp(exact).sum(axis=1, keepdims=True))
    chosen = np.array([1, 2, 1])
    assert np.allclose(lm.shares(z.copy(), chosen, False), exact[np.arange(3), chosen], rtol=1e-5)
    assert np.allclose(lm.shares(z, chosen), exact[np.arange(3), chosen], rtol=1e-5) and np.allclose(z, np.exp(exact))


def test_gradients_agree_with_differences():
    draw = np.random.default_rng(3)
    weights = lm.Attention.fresh(np.full(30, 1 / 30)).astype(np.float64)
    weights += draw.normal(0, 0.3, len(weights))
    inputs, nexts = draw.integers(0, 31, (3, 9)), draw.integers(0, 30, (3, 9))
    counted = draw.random((3, 9)) < 0.7
    loss = lambda w: -lm.Attention(w, 30).log_probabilities(inputs, nexts, counted).mean()
    found = lm.Attention(weights, 30).gradient(inputs, nexts, counted)
    for at in draw.integers(0, len(weights), 80):
        step = np.zeros_like(weights)
        step[at] = 1e-5
        assert found[at] == pytest.approx((loss(weights + step) - loss(weights - step)) / 2e-5, abs=1e-5)


def test_weights_are_averaged_by_windows(spark, monkeypatch):
    """Every part of the weights is the mean over the tasks, also where the weights fill several parts."""
    monkeypatch.setattr(lm, "PART", 1_000)
    unit, share = np.arange(100, dtype=np.int32), np.full(100, 0.01)
    ids = np.arange(100, dtype=np.uint8)
    df = spark.createDataFrame([(bytearray(ids.tobytes()),)] * 4, "ids binary").repartition(2)
    start = lm.Attention.fresh(share)
    found = lm.averaged(df, spark.sparkContext.broadcast(unit), start, 100)
    assert found.shape == start.shape and np.isfinite(found).all()
    alone = lm.averaged(df.coalesce(1).limit(2), spark.sparkContext.broadcast(unit), start, 100)
    assert np.allclose(found, alone, atol=1e-5)


def test_words_of_a_text_are_encoded_together(monkeypatch):
    """One call of the tokenizer for the unknown words of a text; the ids are those of each word alone."""
    monkeypatch.setattr(lm, "REMEMBERED", 3)
    with open(lm.TOKENIZER, "rb") as file:
        subwords = lm.Subwords(file.read())
    real, calls = subwords.encoding, []

    class Watched:
        def encode_ordinary(self, text):
            calls.append(text)
            return real.encode_ordinary(text)

    subwords.encoding = Watched()
    alone = lambda words: [i for w in words for i in real.encode_ordinary(" " + w.decode("utf-8", "replace"))]
    odd = ["ka lo  mi", "it's 12ab!? 'll x's", "a\x85 \x85b c\x1cd", "x\u00a0 \u00a0y \u2003 z", "\u3000 \u65e5\u672c", ""]
    for text in [*(t.encode() for t in odd), b"ab\xff\xfe c \xc3 \xe2\x80", " ".join(odd * 2).encode()]:
        words = lm.words_of(text)
        assert list(np.frombuffer(subwords.packed(words), dtype=subwords.kind)) == [*alone(words), subwords.end]
    calls.clear()
    subwords.packed([b"one", b"two", b"three", b"one"])
    assert len(calls) == 1


def test_training_words_and_ids_are_counted_as_texts_are_tokenised(spark, monkeypatch):
    """One pass gives the ids and the counts; held-out texts, also those of an unknown side, do not count."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "HELD_WORDS", 2)
    texts = ["Ka lo ka", "ka", None, "mi mi", "lo unseen"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc bigint, text string")
    held = F.when(F.col("doc") < 3, False).when(F.col("doc") == 3, F.lit(None).cast("boolean")).otherwise(True)
    with open(lm.TOKENIZER, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    found, told = lm.tokenised(df, held, ranks)
    assert sorted(r.doc for r in found.collect()) == [0, 1, 2, 3, 4]
    counts = {(r.word, r.id): r.n for r in told.collect()}
    end = lm.Subwords(ranks.value).end
    assert {w: n for (w, i), n in counts.items() if i is None} == {"ka": 3, "lo": 1}
    assert counts[None, -1] == 3 and counts[None, end] == 3
