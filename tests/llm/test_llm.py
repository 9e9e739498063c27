"""The ten operators and the pipeline: hard rows, brute force, round trips and held-out accuracy."""

import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import decontaminate, fingerprints, jaccard, langid, packing, pii, planes, quality, tokens, warc
from bitloom.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, label int, score double"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties and clashing names."""
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", f"s{i % 3}", 1, "r", 1, 0.5) for i in range(20)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (50, "", "en", "s0", 0, "", 0, 0.0), (51, " \n\t ", "de", "s1", 3, "", 0, 0.0), (52, words(rng, 60_000, 5000), "en", "s1", 1, "x", 1, 1.0), (53, rows[2][1], "en", "s9", 1, "y", 1, 1.0), (53, None, "en", "s9", 1, "y", 1, 1.0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = re.findall(r"[a-z0-9_\x80-\U0010ffff]+", (t or "").lower())
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False))


def near_docs(rng):
    out = []
    for i in range(60):
        base = words(rng, rng.randrange(3, 150), 150).split()
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 3)):
            c = list(base)
            for _ in range(rng.randrange(0, max(1, len(c) // 10) + 1)):
                c[rng.randrange(len(c))] = f"x{rng.randrange(50)}"
            out.append(" ".join(c))
    return out


def test_join_is_exact(spark):
    texts = near_docs(random.Random(1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.ngram_jaccard_join(df).collect()}
    s = [shingles(t) for t in texts]
    head = {}
    for i, x in enumerate(s):
        head.setdefault(frozenset(x), i)
    want = {(head[frozenset(x)], i): 1.0 for i, x in enumerate(s) if x and head[frozenset(x)] < i}
    heads = sorted(head.values())
    for a in heads:
        for b in heads:
            if a < b and s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.7 - 1e-12:
                want[a, b] = round(len(s[a] & s[b]) / len(s[a] | s[b]), 6)
    assert got == want
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in want:
        x, y = sorted((root(a), root(b)))
        group[y] = x
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == {i for i in range(len(texts)) if root(i) == i}


def brute_links(rows):
    """{(doc_id, set): (class, links)} of (doc_id, text) by comparing all sets with all."""
    docs = sorted({(i, frozenset(shingles(t))) for i, t in rows}, key=lambda x: (x[0] is None, x[0] or 0, len(x[1])))
    linked = [[j for j, (_, y) in enumerate(docs) if j != i and x and y and len(x & y) / len(x | y) >= jaccard.THRESHOLD - 1e-12] for i, (_, x) in enumerate(docs)]
    out = {}
    for i, (name, x) in enumerate(docs):
        reach, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        ids = [docs[j][0] for j in reach if docs[j][0] is not None]
        out[name, x] = (min(ids, default=None), len(linked[i]))
    return Counter((k[0], *v) for k, v in out.items())


def edited(rng, words, share, k):
    """k near copies of a text."""
    out = []
    for _ in range(k):
        c = list(words)
        for _ in range(rng.randrange(int(share * len(c)) + 1)):
            c[rng.randrange(len(c))] = f"y{rng.randrange(1000)}"
        out.append(" ".join(c))
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_link_classes(spark, hard, monkeypatch, tight):
    """Against brute force; tight: every signature is hot, every block wide, every group split and every join a shuffle."""
    if tight:
        for name, value in (("HOT", 3), ("TOGETHER", 5), ("WORK", 2000), ("WEIGHT", 500), ("BROADCAST_ROWS", 0), ("PER_PART", 2000)):
            monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(21)
    rows = list(enumerate(near_docs(rng) + edited(rng, words(rng, 120, 300).split(), 0.08, 60) + edited(rng, words(rng, 400, 900).split(), 0.05, 25)))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rows[:15])] + [rows[3], rows[3], (None, rows[4][1]), (None, rows[4][1]), (None, None), (900, ""), (901, " -- "), (902, None), (903, "one"), (904, "one"), (5, "other text of a known id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = jaccard.link_classes(df).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows)
    assert jaccard.link_classes(hard).count() == len({(r.doc_id, frozenset(shingles(r.text))) for r in hard.collect()})
    assert jaccard.link_classes(empty(spark)).count() == 0


def test_sets_without_enough_segments(spark, monkeypatch):
    """With the neighbourhoods off many small sets lack segments; their rarest tokens find the rest."""
    monkeypatch.setattr(jaccard, "SHORT", 0)
    rng = random.Random(22)
    rows = list(enumerate(t for _ in range(150) for t in edited(rng, words(rng, rng.randrange(5, 16), 200).split(), 0.1, 4)))
    row, tok = jaccard.sets(jaccard.constants(), pa.array([t for _, t in rows]), 2)
    assert jaccard.signatures(row, tok, len(rows), 0.7, np.zeros(jaccard.SKETCH, np.int32), 0)[1].sum() > 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.link_classes(df).collect()) == brute_links(rows)


@pytest.mark.parametrize("side", [2048, 50])
def test_crowds(spark, monkeypatch, side):
    """Large groups of near copies, compared whole or in sides: as by brute force, and few of their pairs are made one by one. Others share a template only."""
    monkeypatch.setattr(jaccard, "CROWD", 32)
    monkeypatch.setattr(jaccard, "CROWD_SIDE", side)
    rng, made = random.Random(23), Counter()
    first, second = words(rng, 150, 900).split(), words(rng, 90, 900).split()
    texts = [" ".join(first)] * 15 + edited(rng, first, 0.06, 220) + edited(rng, second, 0.1, 120) + near_docs(rng) + [f"a b c d e f g h i u{i} v{i}" for i in range(60)]
    rng.shuffle(texts)
    write = jaccard.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = brute_links(list(enumerate(texts)))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.link_classes(df).collect()) == want
    assert made["likely"] < sum(n for _, _, n in want) // 2 // 10
    assert {r.doc_id for r in jaccard.keep_one(df).collect()} == {c for _, c, _ in want}
    got = [(r.doc_a, r.doc_b) for r in jaccard.every_pair(df).collect()]
    sets = [shingles(t) for t in texts]
    assert sorted(got) == [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets[a + 1 :], a + 1) if len(x & y) / len(x | y) >= jaccard.THRESHOLD - 1e-12]


def test_pairs_of_a_part_are_sorted_seldom(monkeypatch):
    """One signature of so many sets that their distinct pairs are more than ROOM: all pairs are made, and sorted a few times only."""
    n, sorted_ = 2600, Counter()
    unique = np.unique

    def counted(x, **how):
        sorted_["n"] += len(x)
        assert sorted_["n"] < 10 * n * n
        return unique(x, **how)

    monkeypatch.setattr(np, "unique", counted)
    key = np.sort(np.random.default_rng(5).integers(1, 1 << 62, n).astype(np.uint64))
    flags = np.full(n, jaccard.PROBE | jaccard.INDEX, np.uint32)
    rows = list(jaccard._meet(0.7, key, np.full(n, 90, np.uint8), flags, np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.arange(n, 0, -1)))
    assert sum(r["n"] for r in rows) == n * (n - 1) // 2


def test_partners_in_a_run():
    """The pairs of signatures that are cut off by size or flags are none that would count."""
    rng = np.random.default_rng(6)
    for crowds in (1, 3):
        n = 400
        sig, size, crowd = np.sort(rng.integers(0, 12, n)), rng.integers(0, 30, n).astype(np.uint8), rng.integers(0, crowds, n).astype(np.uint32)
        flags = rng.choice([jaccard.PROBE, jaccard.INDEX, jaccard.PROBE | jaccard.INDEX], n).astype(np.uint32)
        order = np.lexsort((size, crowd, sig))
        size, crowd, flags = size[order].astype(np.int64), crowd[order], flags[order]
        run = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        to = jaccard._partners(0.7, size, flags, crowd, run, np.diff(np.append(run, n)))
        end = np.searchsorted(sig, sig, "right")
        for i in range(n):
            for j in range(int(to[i]), int(end[i])):
                larger, smaller = (i, j) if size[i] > size[j] else (j, i)
                assert size[i] != size[j]
                assert abs(size[i] - size[j]) > jaccard._far(0.7) or not (flags[larger] & jaccard.PROBE and flags[smaller] & jaccard.INDEX)
        assert (to < end).any() or crowds > 1


def test_components(spark):
    """Ids on a path that fall and rise: a node with two parents that have none is no end."""
    assert sorted(map(tuple, jaccard.components(spark.createDataFrame([(1, 4), (3, 4), (3, 5), (2, 5)], "a bigint, b bigint")).collect())) == [(2, 1), (3, 1), (4, 1), (5, 1)]
    rng = random.Random(24)
    paths = [rng.sample(range(100 * k, 100 * k + 60), rng.randrange(2, 40)) for k in range(20)]
    edges = [tuple(sorted(e)) for p in paths for e in zip(p, p[1:], strict=False)]
    got = jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted(map(tuple, got)) == sorted((x, min(p)) for p in paths for x in p if x != min(p))


def test_shortfall():
    """The counts of the first pass are those of the signatures."""
    rng = random.Random(25)
    row, tok = jaccard.sets(jaccard.constants(), pa.array([words(rng, rng.randrange(0, 400), 5000) for _ in range(200)] + [words(rng, k % 14, 50) for k in range(300)]), 2)
    for short in (0, jaccard.SHORT):
        (made, *_), lacking = jaccard.signatures(row, tok, 500, 0.7, np.zeros(jaccard.SKETCH, np.int32), short)
        number, lack = jaccard.shortfall(row, tok, 500, 0.7, short)
        assert np.array_equal(number, np.bincount(made, minlength=500))
        assert np.array_equal(lack, lacking)
        assert short or lack.any()


def test_tokens_pack():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 300, 40_000):
        tok = np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64))
        assert np.array_equal(jaccard.unpack_tokens(jaccard.pack_tokens(tok)), tok)


def test_keep_one_with_any_columns(spark):
    """Repeated rows that differ in columns of any type, with names that clash: one stays, whatever the partitions."""
    rows = [(1, "a b c d", {"x": i}, [{"y": i}], i, i) for i in (3, 1, 2)] + [(2, "a b c d", {"x": 9}, [], 7, 7), (3, "", None, None, 1, 1), (3, "", None, None, 2, 2), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, m map<string,int>, am array<map<string,int>>, rid int, `key.x` int")
    kept = [sorted(map(str, jaccard.keep_one(df.repartition(k)).collect())) for k in (1, 3)]
    assert kept[0] == kept[1]
    assert jaccard.keep_one(df).columns == df.columns
    got = jaccard.keep_one(df).collect()
    assert sorted((r.doc_id or 0, r.rid or 0) for r in got) == [(0, 0), (1, 1), (3, 1), (3, 2)]


def test_every_pair(spark):
    texts = near_docs(random.Random(11))
    texts += texts[:20] + texts[:20]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.every_pair(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    sets = [shingles(t) for t in texts]
    j = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a + 1, len(sets))}
    want = {k: round(v, 6) for k, v in j.items() if v >= jaccard.THRESHOLD - 1e-12}
    assert set(got) == set(want)
    assert all(abs(got[k] - v) < 1e-5 for k, v in want.items())


def test_join_hard(spark, hard):
    pairs = {(r.doc_a, r.doc_b) for r in jaccard.ngram_jaccard_join(hard).collect()}
    assert (2, 53) in pairs
    kept = jaccard.keep_one(hard)
    assert kept.columns == hard.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1
    assert ids[50] == ids[51] == 1
    assert jaccard.ngram_jaccard_join(empty(spark)).count() == jaccard.keep_one(empty(spark)).count() == 0


def test_pseudonyms(spark, hard):
    key = b"k"
    for size in (2, 10, 97, 10_000):
        image = [pii.permute(x, size, key, "t") for x in range(min(size, 300))]
        assert len(set(image)) == len(image) and max(image) < size
        assert [pii.permute(y, size, key, "t", inverse=True) for y in image] == list(range(len(image)))
    rows = [(1, "mail a.b@x.org or 4111 1111 1111 1111, born 1984-02-29, ip 10.0.0.1"), (2, "Card 4111 1111 1111 1111! 4111 1111 1111 1112 999.1.1.1 2023-02-30"), (3, "call (555) 123-4567")]
    got = {r.doc_id: r for r in pii.redact_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[1].text).group()
    assert card != "4111 1111 1111 1111" and card in got[2].text and pii.luhn(card.replace(" ", ""))
    assert "4111 1111 1111 1112 999.1.1.1 2023-02-30" in got[2].text
    assert got[1].n_email == got[1].n_date == got[1].n_ip == got[3].n_phone == 1
    assert re.search(r"born (19|20)\d\d-\d\d-\d\d,", got[1].text) and "1984-02-29" not in got[1].text
    assert pii.redact_pii(hard).count() == hard.count()
    assert pii.pseudonyms(hard).columns == hard.columns
    assert pii.redact_pii(empty(spark)).count() == 0


NAIVE_EMAIL = r"(?P<email>[A-Za-z0-9_\u00C0-\uFFFF][A-Za-z0-9._%+\-\u00C0-\uFFFF]*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})"


def naive_pseudonyms(text, key):
    """Every value by one expression that is tried at each place."""
    first, rest = pii._PATTERNS["secret"], {k: v for k, v in pii._PATTERNS.items() if k != "secret"}
    regex = re.compile(pii.number({"secret": first, "email": NAIVE_EMAIL, **rest}))

    def one(m):
        kind = next(k for k in pii.KINDS if m.group(k) is not None)
        new = pii._REPLACE[kind](m.group(kind), key)
        return m.group() if new is None else m.group()[: m.start(kind) - m.start()] + new + m.group()[m.end(kind) - m.start() :]

    return regex.sub(one, text)


def test_pseudonyms_against_brute_force(spark):
    rng = random.Random(31)
    bits = ["a.b@x.org", "--q@y.de", "x@y@z.com", "password=abcdef0123456789ab@host.org", "key: ", "4111 1111 1111 1111", "4111111111111112", "1984-02-29", "30/04/2001", "2023-02-30", "10.0.0.1", "999.1.1.1", "(555) 123-4567", "+49 30 1234567", "DE89 3704 0044 0532 0130 00", "078-05-1120", "josé@x.org", "李雷@a.com", "a@b", "@", ".", "-", " ", "\n", "word", "é", "7"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(12)))) for i in range(400)] + [(400, None), (401, "")]
    got = {r.doc_id: r.text for r in pii.redact_pii(spark.createDataFrame(rows, "doc_id bigint, text string"), key=b"k").collect()}
    assert got == {i: None if t is None else naive_pseudonyms(t, b"k") for i, t in rows}
    assert len({pii._email(f"{chr(c)}@x.org", b"k") for c in range(0x4E00, 0x4F00)}) == 256


def test_texts_without_spaces_and_of_spaces():
    regex, enc = re.compile(pii.number(pii._PATTERNS)), tokens.encoder(tokens.VOCABULARY)
    for text in ("a" * 3_000_000, "中" * 1_500_000, "a.b-" * 500_000 + "@", " " * 3_000_000 + "a", "\n\t " * 1_000_000):
        assert pii.pseudonymize(text, regex, b"k", dict.fromkeys(pii.KINDS, 0), {}) == text
        assert tokens.lengths(enc, [text])[0] > 0
    for text in ("a" + " " * 100_000 + "b", " " * 3000, "x\n" + "\n \t" * 500 + "\nword", "a" + " " * 300 + "\u3000b", " " * 256 + "'s it"):
        assert sum(tokens.encode(enc, [text])[0], []) == enc.encode_ordinary(text)


def test_fill_is_best():
    rng = random.Random(2)
    for _ in range(60):
        left = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(6)}
        room = rng.randrange(1, 60)
        sums = {0}
        for n, c in left.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = packing.fill(left, sorted(left, reverse=True), room)
        assert all(k <= left[n] for n, k in got)
        assert sum(n * k for n, k in got) == max(s for s in sums if s <= room)


def test_packing(spark, hard):
    want = {}
    enc = tokens.encoder(tokens.VOCABULARY)
    for r in hard.collect():
        n = len(enc.encode_ordinary(r.text or ""))
        if n:
            want[r.doc_id] = want.get(r.doc_id, 0) + n + packing.END_TOKENS
    rows = packing.pack_documents(hard, 256).collect()
    have, windows = Counter(), defaultdict(list)
    for r in rows:
        have[r.doc_id] += r.n_tokens
        windows[r.window_id].append((r.position, r.n_tokens))
    assert have == want
    for w in windows.values():
        at = 0
        for p, n in sorted(w):
            assert p == at
            at += n
        assert at <= 256
    assert len(windows) <= 1.05 * sum(want.values()) / 256 + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_token_counts(spark, hard):
    enc = tokens.encoder(tokens.VOCABULARY)
    for r in hard.select("text").join(tokens.token_counts(hard.select(F.xxhash64("text").alias("doc_id"), "text")), F.xxhash64("text") == F.col("doc_id")).collect():
        assert r.n_tokens == (None if r.text is None else len(enc.encode_ordinary(r.text)))
    long = "a  b\n c 's it's x " * 9000
    assert sum(len(enc.encode_ordinary(p)) for p in tokens.split(long, 1000)) == len(enc.encode_ordinary(long))
    assert tokens.token_counts(empty(spark)).count() == 0


def test_quality(spark, hard):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, words(rng, 60) + (" nasty vile awful" if bad else ""), "en", f"s{i % 5}", 1, "", 1, 0.0))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    docs, y = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.classify(docs, y).collect()}
    held = [i for i in range(600) if i % 2]
    assert np.mean([got[i] == (i % 4 != 0) for i in held]) > 0.95
    kept = quality.filter_quality(docs, y)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    none = spark.createDataFrame([(None, None, None), (1, None, 0), (1, 1, 0), (1, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.classify(hard, none).count() == hard.count()
    assert quality.filter_quality(hard, none.limit(0)).count() == hard.count()
    assert quality.classify(empty(spark), y).count() == 0


def test_site_rates_against_brute_force(spark):
    rng = random.Random(32)
    rows = [(f"h{rng.randrange(4)}" if i % 9 else None, f"p{rng.randrange(3)}" if i % 7 else None, rng.uniform(-4, 4), rng.uniform(-4, 4), rng.choice([None, 0.0, 1.0]), rng.choice([None, 0.0, 1.0])) for i in range(300)]
    prior = [-1.0, -2.0]
    got = {(r.host, r.path): (r.prior_poor, r.prior_toxic) for r in quality.sites(spark.createDataFrame(rows, "host string, path string, poor double, toxic double, y_poor double, y_toxic double"), {"prior": prior}).collect()}
    for k in range(2):
        p = [r[4 + k] if r[4 + k] is not None else 1 / (1 + np.exp(-(r[2 + k] + prior[k]))) for r in rows]
        rate = (sum(p) + 0.5) / (len(p) + 1)

        def level(key, mean):
            sums = defaultdict(lambda: [0, 0.0])
            for r, x in zip(rows, p, strict=True):
                sums[key(r)][0] += 1
                sums[key(r)][1] += x
            m = {g: mean(g) for g in sums}
            between = sum(n * (s / n - m[g]) ** 2 - m[g] * (1 - m[g]) for g, (n, s) in sums.items())
            size = sum(n for n, _ in sums.values()) - sum(n * n for n, _ in sums.values()) / len(rows)
            kappa = min(quality.SITE_MAX, max(1.0, np.mean([m[g] * (1 - m[g]) for g in sums]) / max(between / max(size, 1e-9), 1e-12) - 1))
            return {g: (s + kappa * m[g]) / (n + kappa) for g, (n, s) in sums.items()}

        hosts = level(lambda r: r[0], lambda g: rate)
        paths = level(lambda r: (r[0], r[1]), lambda g: hosts[g[0]])
        assert set(paths) == set(got)
        assert all(abs(got[g][k] - np.log(v / (1 - v))) < 1e-9 for g, v in paths.items())


def test_sketches(spark, hard):
    rng = random.Random(5)
    a = words(rng, 3000, 100_000).split()
    b = a[:2000] + words(rng, 1000, 100_000).split()
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id bigint, text string")
    k = 256
    s = {r.doc_id: r.sketch for r in fingerprints.sketches(df, k).collect()}
    pair = spark.createDataFrame([(s[1], s[2])], "a array<bigint>, b array<bigint>")
    r = pair.select(fingerprints.resemblance(F.col("a"), F.col("b"), k).alias("r"), fingerprints.containment(F.col("a"), F.col("b"), k).alias("c"), fingerprints.distinct_count(F.col("a"), k).alias("n")).first()
    sa, sb = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    assert abs(r.r - len(sa & sb) / len(sa | sb)) < 0.12
    assert abs(r.c - len(sa & sb) / len(sa)) < 0.15
    assert abs(r.n / len(sa) - 1) < 0.2
    halves = spark.createDataFrame([(1, " ".join(a[:1600])), (1, " ".join(a[1596:]))], "doc_id bigint, text string")
    assert fingerprints.merge(fingerprints.sketches(halves, k), ["doc_id"], k).first().sketch == s[1]
    parts = spark.createDataFrame([(1, [1, 5]), (1, [2, 5]), (None, [3]), (2, []), (2, None)], "salt_ bigint, sketch array<bigint>")
    assert {r.salt_: r.sketch for r in fingerprints.merge(parts, ["salt_"], 2).collect()} == {1: [1, 2], None: [3], 2: []}
    near = {r.doc_id: r for r in fingerprints.fingerprints(df.withColumn("source", F.lit("s")), k).collect()}
    assert abs(near[1].resemblance - len(sa) / len(sa | sb)) < 0.12 and near[1].containment == 1.0
    rows = fingerprints.fingerprints(hard).collect()
    assert len(rows) == hard.count()
    assert {r.n_shingles for r in rows if r.doc_id in (50, 51)} == {0.0}
    assert fingerprints.fingerprints(empty(spark)).count() == 0


def semi_global(pattern, text):
    """Least edit distance of pattern to any part of text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for x in text:
        before, row = row, [0]
        for i, y in enumerate(pattern, 1):
            row.append(min(before[i - 1] + (x != y), before[i] + 1, row[-1] + 1))
        best = min(best, row[-1])
    return best


def test_decontamination(spark, hard):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randrange(8, 60), 3000)) for i in range(40)] + [(90, None), (91, ""), (92, "one two")]
    docs, want = [], set()
    for i in range(200):
        t = words(rng, rng.randrange(20, 300), 3000).split()
        if i % 2:
            j = rng.randrange(40)
            w = items[j][1].split()
            for _ in range(rng.randrange(0, int(decontaminate.TOLERANCE * len(w)) + 1)):
                kind, p = rng.randrange(3), rng.randrange(len(w))
                if kind == 0:
                    w[p] = f"e{rng.randrange(999)}"
                elif kind == 1:
                    w.insert(p, f"e{rng.randrange(999)}")
                else:
                    del w[p]
            p = rng.randrange(len(t))
            t[p:p] = w
            want.add((i, j))
        docs.append((i, " ".join(t)))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    split = {i: (t or "").split() for i, t in docs}
    brute = set()
    for j, t in items[:40]:
        w = t.split()
        code = {x: k for k, x in enumerate({*w, *(y for v in split.values() for y in v)})}
        for i, v in split.items():
            if len(set(w) & set(v)) > len(w) // 2 and semi_global([code[x] for x in w], [code[x] for x in v]) <= int(decontaminate.TOLERANCE * len(w)):
                brute.add((i, j))
    assert want <= brute
    assert got <= brute
    assert len(got & brute) >= 0.95 * len(brute)
    short = {(r.doc_id, r.item_id, r.edits, r.end_word) for r in decontaminate.find_leaks(spark.createDataFrame([(1, "say One, two again one two"), (2, "two one")], "doc_id bigint, text string"), bench).collect()}
    assert short == {(1, 92, 0, 3)}
    kept = decontaminate.drop_leaks(df, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert decontaminate.drop_leaks(hard, bench).columns == hard.columns
    assert decontaminate.find_leaks(empty(spark), bench).count() == decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def recall_at_tolerance(lengths, copies=60):
    """For each length, the share of the copies with as many edits as the tolerance allows that the index of all of them finds."""
    rng, items, texts = random.Random(8), [], []
    for n in lengths:
        for _ in range(copies):
            items.append((len(items), words(rng, n, 50_000)))
            w = items[-1][1].split()
            for _ in range(int(decontaminate.TOLERANCE * n)):
                kind, p = rng.randrange(3), rng.randrange(len(w))
                w[p : p + (kind != 1)] = [f"e{rng.randrange(10**9)}"] * (kind != 2)
            texts.append(" ".join([words(rng, rng.randrange(40), 50_000), *w, words(rng, 40, 50_000)]))
    index = decontaminate._ready(decontaminate.build(items)[0])
    found = np.zeros(len(items))
    for i, item, *_ in decontaminate._find(decontaminate.constants(), index, pa.array(texts)):
        found[i] = max(found[i], i == item)
    return found.reshape(len(lengths), copies).mean(1)


def test_decontamination_finds_long_items(monkeypatch):
    assert recall_at_tolerance([128, 256, 384, 700, 1000]).min() >= 0.9
    monkeypatch.setattr(decontaminate, "MOST_REPEATS", 1)
    with pytest.raises(ValueError, match="repetitions find"):
        decontaminate.build([(0, words(random.Random(9), 34, 3000))])


def test_decontamination_finds_every_length():
    """The shortest items of a class too, though the others need fewer repetitions."""
    assert recall_at_tolerance([32, 34, 40, 47, 54, 60]).min() >= 0.9
    assert recall_at_tolerance([5, 6, 7, 8, 13, 14, 15, 16, 20, 24, 28, 31]).min() >= 0.9


def test_language(spark, hard):
    rng = random.Random(7)
    words_of = {"aa": ["kala", "mato", "luna", "riko"], "bb": ["strug", "brenk", "dworf", "plint"], "cc": ["été", "çava", "noël", "où"]}
    rows = [(i, " ".join(rng.choice(words_of[x]) + rng.choice(words_of[x]) for _ in range(12)), x) for i, x in enumerate(rng.choice(list(words_of)) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df.filter("doc_id < 200"))
    got = {r.doc_id: r.lang for r in langid.identify(df, model).collect()}
    assert np.mean([got[i] == x for i, _, x in rows if i >= 200]) > 0.97
    odd = df.unionByName(spark.createDataFrame([(900, "qxzjv wqpfx zzxqj vkqwx jjqzx qqxwv zxjqk", None), (901, None, None), (902, "123 !!", "aa")], "doc_id bigint, text string, lang string"))
    assert {r.lang for r in langid.identify(odd, model).filter("doc_id >= 900").collect()} == {"und"}
    lut = langid.letters()
    for before in (ord("a"), ord("z"), langid.SPACE):  # seen and unseen contexts: one unit over the whole alphabet
        p = 2.0 ** langid.log_prob(model, 2, (before << 12) | np.arange(4096)).astype(float)
        assert np.allclose(p.sum(0), 1, atol=1e-3)
    letter = np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(len(lut))])
    assert np.all((lut != langid.SPACE) == letter)
    assert not np.isin(lut[4096:][letter[4096:]], lut[:4096][letter[:4096]]).any()
    assert langid.identify(hard).count() == hard.count()
    assert langid.identify(empty(spark)).count() == 0
    e, n = langid.entropies(model, lut, pa.array(["", None, "kala"]))
    assert n.tolist() == [0, 0, 4]


def test_language_models_against_brute_force(spark):
    rng = random.Random(33)
    rows = [(" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(8)) + "!", lang) for lang, letters in (("aa", "abcé"), ("bb", "bcd中")) for _ in range(12)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    tests = ["abc dé", "bcd 中中b", "zz", "a"]

    def chars(t):
        return re.sub(r"[^a-zé中]+", " ", t).lstrip()

    for at, lang in enumerate(model["langs"]):
        counts = {5: Counter()}
        for t, x in rows:
            if x == lang:
                s = "    " + chars(t)
                counts[5].update(s[i - 4 : i + 1] for i in range(4, len(s)))
        for k in range(4, 0, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        d, context, kept = {}, {}, {}
        for k, c in counts.items():
            ones, twos = (sum(v == x for v in c.values()) for x in (1, 2))
            d[k] = min(0.95, max(0.05, ones / max(ones + 2 * twos, 1)))
            context[k], kept[k] = Counter(), Counter()
            for g, v in c.items():
                context[k][g[:-1]] += v
                kept[k][g[:-1]] += max(v - d[k], 0)

        def prob(g):
            if not g:
                return 1 / 4096
            total = context[len(g)][g[:-1]]
            if not total:
                return prob(g[1:])
            return max(counts[len(g)][g] - d[len(g)], 0) / total + (1 - kept[len(g)][g[:-1]] / total) * prob(g[1:])

        for t, got in zip(tests, langid.entropies(model, langid.letters(), pa.array(tests))[0][:, at], strict=True):
            s = "    " + chars(t)
            assert abs(got + np.mean([np.log2(prob(s[i - 4 : i + 1])) for i in range(4, len(s))])) < 1e-3


def test_language_models_keep_rare_grams(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(" ".join(rng.choice("kala mato luna riko".split()) for _ in range(5000)), "aa") for _ in range(60)] + [("zyqxw", "aa"), ("strug brenk", "bb")]
    df = spark.createDataFrame(rows, "text string, lang string")
    model, lut = langid.train(df), langid.letters()
    key = langid.grams(lut, pa.array(["zyqxw"]))[1]
    held = (model.get("parts") or [model])[0]["grams"][langid.ORDER]
    assert np.all(langid._look(held, key) >= 0)
    monkeypatch.setattr(langid, "PART_ROWS", 40)
    many = langid.train(df)
    assert len(many["parts"]) > 2
    texts = pa.array(["kala brenk zyqxw", "unknown words", "luna"])
    assert np.allclose(langid.entropies(many, lut, texts)[0], langid.entropies(model, lut, texts)[0], atol=1e-5)


@pytest.mark.parametrize(("width", "bits", "block"), [(16, True, 1000), (16, False, 64), (32, True, 1 << 16)])
def test_blocks_round_trip(spark, hard, width, bits, block):
    enc = tokens.encoder(tokens.VOCABULARY)
    want = Counter((r.doc_id, tuple([*enc.encode_ordinary(r.text), planes.END_ID])) for r in hard.collect() if r.text is not None)
    blocks = planes.write_blocks(hard, block, width, bits)
    assert Counter((r.doc_id, tuple(r.ids)) for r in planes.read_blocks(blocks).collect()) == want
    assert planes.write_blocks(empty(spark)).count() == 0


def test_archive_round_trip(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h/{i}", "<html>" + words(rng, 200) + "é</html>", 1) for i in range(300)] + [(None, None, None, None), (7, "u", "", 2), (7, "u", "", 2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, seq int").repartition(2)
    for limit in (1 << 12, 1 << 24):
        frames = warc.write_warc(df, limit)
        records = [x for r in warc.files(frames).collect() for x in warc.read_file(bytes(r.bytes))]
        bodies = Counter(x.split(b"\r\n\r\n", 1)[1][:-4].decode() for x in records)
        assert bodies == Counter(h or "" for _, _, h, _ in rows)
    assert warc.write_warc(df.limit(0)).count() == 0
    big = spark.createDataFrame([(1, "http://h/a\r\nX-Own: 1 b", "x" * 20_000), (2, "u", "y")], "page_id bigint, url string, html string").coalesce(1)
    records = [x for r in warc.files(warc.write_warc(big, 1 << 12)).collect() for x in warc.read_file(bytes(r.bytes))]
    head = next(x for x in records if len(x) > 20_000).split(b"\r\n\r\n")[0].split(b"\r\n")
    assert b"WARC-Target-URI: http://h/a%0D%0AX-Own:%201%20b" in head and len(head) == 8


def test_pipeline(spark, hard):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "pseudonymize", "pack"]
    for docs in (hard, empty(spark)):
        before = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns
            docs = spark.createDataFrame(after.collect(), docs.schema)
            assert docs.count() <= before
            before = docs.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert {r.doc_id for r in packed.collect()} <= {r.doc_id for r in docs.collect()}


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() over a small folder, stage by stage: the classifier's own decisions, all pairs, the plain edit distance, one expression at each place, and windows that hold every token."""
    rng = random.Random(34)
    base = [words(rng, rng.randrange(20, 120), 2000) for _ in range(50)]
    items = [(i, words(rng, 20, 3000)) for i in range(4)]
    texts = [*base, *base[:6], *(t for x in base[6:12] for t in edited(rng, x.split(), 0.05, 2)), *(f"{base[20 + i]} {t} {words(rng, 9, 2000)}" for i, (_, t) in enumerate(items)), "write to ann@mail.org or 10.0.0.1 now", "nasty vile awful text"]
    rows = [(i, t + (" nasty vile awful" if i % 5 == 0 else ""), "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(0, 50)]
    for name, data, schema in (("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", items, "item_id bigint, text string")):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    keep = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).filter("keep").collect()}
    left = {i: t for i, t, *_ in rows if i in keep}
    assert 0 < len(left) < len(rows)
    classes = brute_links(left.items())
    left = {i: left[i] for i, c, _ in classes if i == c}
    for i, t in list(left.items()):
        if any(semi_global(x.split(), t.split()) <= int(decontaminate.TOLERANCE * len(x.split())) for _, x in items):
            del left[i]
    left = {i: naive_pseudonyms(t, pii.KEY) for i, t in left.items()}
    enc = tokens.encoder(tokens.VOCABULARY)
    got, windows = Counter(), Counter()
    for r in llm_queries.queries()["pipeline"](spark, str(tmp_path)).collect():
        got[r.doc_id] += r.n_tokens
        windows[r.window_id] += r.n_tokens
    assert got == {i: len(enc.encode_ordinary(t)) + packing.END_TOKENS for i, t in left.items()}
    assert max(windows.values()) <= packing.CAPACITY
