"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables
and columns whose names clash."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import anchors, bwt_merge, decontaminate, fm_index, language, near_dedup, pii, pitman_yor, quality_gam, quality_rules, sentencepiece_codec

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "s", "rt", "v") for c in ("a", "e", "i", "o", "um")]
SPACE = re.compile(r"[^\x20\x09-\x0d]+")


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    base, passage = prose(r, 160), prose(r, 70)
    out = [(k, prose(r, r.randrange(20, 220))) for k in range(40)]
    words = base.split()
    for k in range(40, 52):  # near copies
        w = list(words)
        for _ in range(3):
            w[r.randrange(len(w))] = "edited"
        out.append((k, " ".join(w)))
    out += [(52, base), (53, base.upper()), (54, base), (54, base)]  # exact copies and repeated rows
    out += [(k, f"{prose(r, 40)}\n{passage} {prose(r, 30)}") for k in range(55, 63)]  # a shared passage
    out += [(63, None), (64, ""), (65, " \t\n\x0b\x0c\r"), (66, "one two"), (67, "one two"), (None, base), (None, None), (68, "ab " * 4000), (69, "é" * 150 + "\n" + "é" * 150), (70, passage + " " + passage)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("words", "n", "rk", "id", "lang", "source", "b", "c", "n_chars", "score", "start", "kept"):  # names the operators use inside
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def ids(x):
    return (x is None, x or 0)


def test_quality_rules(docs, none, rows):
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.apply(docs).collect()), key=lambda r: (ids(r[0]), r))
    want = []
    for k, t in rows:
        w = SPACE.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        want.append((k, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert got == sorted(want, key=lambda r: (ids(r[0]), r))
    assert quality_rules.apply(none).count() == 0


def test_quality_rules_verdicts(spark):
    r = random.Random(1)
    good = [(k, prose(r, 120).capitalize().replace("karta", "kn.") + ".") for k in range(80)]
    bad = [(100 + k, " ".join(w + "***" for w in prose(r, 120).split())) for k in range(10)] + [(200 + k, "!! ".join(prose(r, 120).upper().split())) for k in range(10)]
    got = {x["doc_id"]: x["kept"] for x in quality_rules.apply(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert all(got[k] for k, _ in good) and not any(got[k] for k, _ in bad)


def test_quality_rules_recover_planted_accuracies(spark):
    """EM finds the shares that votes were drawn with, and no share runs into 0 or 1."""
    r = random.Random(17)
    planted = {"good": {}, "bad": {}}
    for k, rule in enumerate(quality_rules.RULES):
        planted["good"][rule] = (0.03 + 0.02 * (k % 3), 0.2 + 0.05 * k, None)
        planted["bad"][rule] = (0.35 + 0.05 * k, 0.2, None)
    for table in planted.values():
        for rule, (bad, none, _) in table.items():
            table[rule] = (bad, none, 1 - bad - none)
    votes, good = [], []
    for _ in range(30000):
        kind = "good" if r.random() < 0.8 else "bad"
        good.append(kind == "good")
        votes.append(tuple(r.choices((-1, 0, 1), planted[kind][rule])[0] for rule in quality_rules.RULES))
    df = spark.createDataFrame(votes, ", ".join(f"v_{x} int" for x in quality_rules.RULES))
    model = quality_rules.fit(df)
    assert model["prior"] == pytest.approx(0.8, abs=0.03)
    for kind, table in planted.items():
        for rule, shares in table.items():
            assert model[kind][rule] == pytest.approx(shares, abs=0.06)
            assert all(0 < x < 1 for x in model[kind][rule])
    got = [x[0] for x in df.select(quality_rules.posterior(model) >= 0.5).collect()]
    assert sum(a == b for a, b in zip(got, good, strict=True)) > 28000


def test_quality_rules_colliding_hashes(spark, docs, rows, monkeypatch):
    """With hashes of few bits, windows are compared word by word and the counts stay right."""
    plain = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.statistics(docs).collect()}
    statistics = quality_rules.statistics
    real = F.expr
    monkeypatch.setattr(F, "expr", lambda e: real(e.replace("xxhash64(w, words[i + 1], words[i + 2])", "pmod(xxhash64(w, words[i + 1], words[i + 2]), 7)")))
    assert {r["doc_id"]: r["n_repeat_words"] for r in statistics(docs).collect()} == plain


def test_pitman_yor(docs, none, rows):
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    got = pitman_yor.apply(docs, learn).collect()
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    tokens = lambda t: [*SPACE.findall((t or "").translate(lower)), None]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    want = sorted(((k, len(tokens(t)), sum(w in counts for w in tokens(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for k, t in rows), key=lambda r: (ids(r[0]), r))
    for g, w in zip(sorted(got, key=lambda r: (ids(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"])), want, strict=True):
        assert (g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (*w[:3], n)
        assert g["base_score"] == pytest.approx(w[3], rel=1e-9)
        assert g["score"] < 0
    assert pitman_yor.apply(none, learn).count() == 0
    assert pitman_yor.apply(docs, F.lit(False)).count() == len(rows)


def test_pitman_yor_probabilities_add_up():
    import numpy as np

    r = np.random.default_rng(0)
    u, w = np.divmod(np.unique(r.integers(0, 5 * 30, 400)), 30)
    c = r.integers(1, 9, len(u))
    t = np.minimum(c, r.integers(1, 5, len(u)))
    parent = r.random(30)
    parent /= parent.sum()
    customers, tables = np.bincount(u, c, 5), np.bincount(u, t, 5)
    every = np.repeat(np.arange(5), 30), np.tile(np.arange(30), 5)
    full_c, full_t = np.zeros((5, 30)), np.zeros((5, 30))
    full_c[u, w], full_t[u, w] = c, t
    p = pitman_yor.predictive(full_c.ravel(), full_t.ravel(), every[0], customers, tables, parent[every[1]], 1.3, 0.6)
    assert np.bincount(every[0], p) == pytest.approx(np.ones(5))


def test_pitman_yor_seating_agrees_with_plain_restaurants():
    """Mean tables against customers seated one by one at tables with sizes."""
    import numpy as np

    rng, r = np.random.default_rng(3), random.Random(3)
    for c, alpha, d in ((2, 0.4, 0.7), (9, 1.1, 0.5), (40, 0.2, 0.8), (600, 0.9, 0.3)):
        got = pitman_yor.seat(np.full(3000, c), np.full(3000, alpha), d, rng)
        assert got.min() >= 1 and got.max() <= c
        plain = []
        for _ in range(600):
            sizes = [1]
            for _ in range(c - 1):
                x = r.random() * (alpha + sum(sizes) - d * len(sizes))
                if x < alpha:
                    sizes.append(1)
                else:
                    k = r.choices(range(len(sizes)), [s - d for s in sizes])[0]
                    sizes[k] += 1
            plain.append(len(sizes))
        assert got.mean() == pytest.approx(sum(plain) / len(plain), rel=0.06)
    assert pitman_yor.seat(np.zeros(3, np.int64), np.ones(3), 0.5, rng).tolist() == [0, 0, 0]


def test_pitman_yor_packs_any_count():
    import numpy as np

    p = pitman_yor.Pairs(np.array([3, 5], np.uint64), np.array([7, 8, 9], np.uint64), np.array([0, 0, 1]), np.array([0, 2, 1]), np.array([1 << 40, 0, 255]))
    q = pitman_yor.Pairs.joined([pitman_yor.Pairs.unpack(p.pack())] * 2)
    for size in (9, 1 << 16, (1 << 16) + 1, 1 << 24, (1 << 24) + 5):
        some = np.array([0, size // 2, size - 1])
        assert pitman_yor._Reader(pitman_yor._indices(some, size)).indices(3, size).tolist() == some.tolist()
    for n in (0, 5, 4096, 30000):
        names = np.sort(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64))
        names[: n // 2] >>= np.uint64(2)
        names.sort()
        assert np.array_equal(pitman_yor._Reader(pitman_yor._names(names)).names(n), names)
    assert q.c.tolist() == [1 << 41, 0, 510] and q.u.tolist() == [0, 0, 1] and q.w.tolist() == [0, 2, 1]


def test_pitman_yor_same_for_any_partitioning(spark, monkeypatch):
    """Also with many buckets, split contexts and listed words."""
    monkeypatch.setattr(pitman_yor, "BUCKET", 200)
    monkeypatch.setattr(pitman_yor, "SAMPLED", 2)
    r = random.Random(9)
    df = spark.createDataFrame([(k, prose(r, r.randrange(1, 60)) + " ka " * (k % 3)) for k in range(300)], "doc_id long, text string")
    assert len(pitman_yor.layout(df.withColumn("learn", F.lit(True))).split) > 0
    runs = [{x["doc_id"]: x["score"] for x in pitman_yor.apply(df.repartition(n), F.col("doc_id") % 5 != 0).collect()} for n in (1, 20)]
    assert len(runs[0]) == 300 and runs[0] == pytest.approx(runs[1], rel=1e-6)


def test_pitman_yor_learns_contexts_of_rare_words(spark):
    """Neither word of `left right` is frequent; as the same words in another order they must score worse."""
    r = random.Random(3)
    filler = lambda n: " ".join(r.choice(WORDS[:20]) for _ in range(n))
    learn = [(k, f"{filler(150)} left{k % 9} right{k % 9} {filler(150)}") for k in range(90)]
    held = [(1000, "left1 right1 left2 right2"), (1001, "left1 right2 left2 right1")]
    # `often` is frequent and always follows the rare words `before`
    learn += [(200 + k, f"{filler(100)} before{k % 5} often often often {filler(100)}") for k in range(40)]
    held += [(1002, "before1 often"), (1003, "right1 often")]
    df = spark.createDataFrame(learn + held, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in pitman_yor.apply(df, F.col("doc_id") < 1000).collect()}
    assert got[1000]["n_known"] == got[1001]["n_known"] == 5
    assert got[1000]["base_score"] == pytest.approx(got[1001]["base_score"])
    assert got[1000]["score"] > got[1001]["score"] + 2
    assert got[1002]["score"] > got[1003]["score"] + 0.3


def brute_groups(rows):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = SPACE.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return sets, [find(k) for k in range(len(rows))]


@pytest.mark.parametrize("hub", [near_dedup.HUB, 2])
def test_near_dedup(docs, none, rows, hub, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUB", hub)
    sets, root = brute_groups(rows)
    want = []
    for k, (doc, _) in enumerate(rows):
        named = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None] if sets[k] else [doc] * (doc is not None)
        least = min(named) if named else None
        want.append((doc, len(sets[k]), least, doc is not None and doc == least))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.apply(docs).collect()]
    key = lambda r: (ids(r[0]), ids(r[2]), r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert near_dedup.apply(none).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    with_words = Counter(root[k] for k in range(len(rows)) if sets[k])
    assert kept.where("trim(translate(coalesce(text, ''), '\t\n\x0b\x0c\r', '')) <> ''").count() == len(with_words)


@pytest.mark.parametrize("hub, marked", [(near_dedup.HUB, near_dedup.MARKED), (3, near_dedup.MARKED), (3, 0)])
def test_near_dedup_exact_round(spark, hub, marked, monkeypatch):
    """The prefix filter finds every pair at the threshold, whatever the bands found and however its shingles are dealt."""
    monkeypatch.setattr(near_dedup, "HUB", hub)
    monkeypatch.setattr(near_dedup, "MARKED", marked)
    r = random.Random(4)
    rows = []
    for k in range(60):
        w = prose(random.Random(k % 4), 90).split()
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    d = df.select("doc_id", near_dedup.row_id().alias("id"), "text")
    classes = near_dedup._sketch(d, 5).where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("c"), F.first("sig").alias("sig"), F.first("n").alias("n")).cache()
    members = classes.select("c", F.col("c").alias("comp"))
    got = {(x["a"], x["b"]) for x in near_dedup._prefix_pairs(members, classes, d, 5, 75).collect()}
    sets, _ = brute_groups(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                least = {i: min(j for j in range(len(rows)) if sets[j] == sets[i]) for i in (a, b)}
                assert tuple(sorted(least.values())) in got


def test_decontaminate(spark, docs, none, rows):
    word = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    words = lambda t: word.findall((t or "").translate(lower))
    passage = dict(rows)[55].split("\n")[1]
    items = [(1, " ".join(passage.split()[5:30])), (2, "one Two"), (3, ""), (4, None), (5, passage.upper()), (11, "one, two!"), (6, "not there at all"), (None, passage), (7, "ab " * 13)]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for k, t in rows:
        w, hit, owners = words(t), set(), set()
        for item, x in items:
            v = words(x)
            size = min(13, len(v))
            windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v and item is not None else set()
            for i in range(len(w) - size + 1) if windows else ():
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    owners.add(str(item))
        want.append((k, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    key = lambda r: (ids(r[0]), r[1:])
    assert sum(r[5] for r in want) > 5
    for limit in (decontaminate.BROADCAST, 0):  # with broadcasts and without
        old, decontaminate.BROADCAST = decontaminate.BROADCAST, limit
        got = [tuple(r)[:6] for r in decontaminate.apply(docs, table).collect()]
        decontaminate.BROADCAST = old
        assert sorted(got, key=key) == sorted(want, key=key)
    assert decontaminate.apply(none, table).count() == 0
    assert decontaminate.apply(docs, table.where("false")).where("n_hit > 0").count() == 0
    clean = decontaminate.keep_clean(docs, table)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in want)


def test_pii_base(docs, none):
    luhn = lambda d: (sum(int(x) for x in d[-1::-2]) + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])) % 10 == 0

    def plain(t):
        out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d)]
        out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    texts = ["a@b.co, x.y+z@host-1.example.org.", "a@@b.co @b.co a@b", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 41111111111111", "+1 (826) 555-4081 +49 30", "é@b.co é1.2.3.4\U0001f600 q@r.st", "", "@", "a@b.c@d.e"]
    r = random.Random(6)
    texts += ["".join(r.choice("ab1290.@+- ()é\n") for _ in range(80)) for _ in range(2000)]
    texts += [" ".join(t for t, _ in pii.examples(5, seed=9))]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t
    assert pii.digest(pii.apply(none)).count() == 0
    empty = pii.digest(pii.apply(docs.where("text IS NULL OR text = ''"))).collect()
    assert all(x["base_sha256"] == hashlib.sha256(b"").hexdigest() and x["spans"] == "" for x in empty)


def test_pii_tagger():
    import numpy as np

    model = pii.default_model()
    right = found = wanted = 0
    for text, spans in pii.examples(120, seed=77):
        got = set(pii.tag(model, [text])[0])
        right, found, wanted = right + len(got & set(spans)), found + len(got), wanted + len(spans)
    assert right / found > 0.95 and right / wanted > 0.9
    # decoding whole texts in windows agrees with decoding them together
    texts = [t for t, _ in pii.examples(20, seed=5)]
    assert pii.tag(model, texts) == [pii.tag(model, [t])[0] for t in texts]
    # gradients against differences
    small = pii.Tagger()
    x, y = np.array([[1, 28, 30, 5, 28, 2]]), np.array([[0, 1, 2, 0, 7, 0]])
    _, g = small.loss(x, y)
    for name in ("Wf", "Ub", "E", "T", "bf"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        keep = small.p[name][at]
        small.p[name][at] = keep + 1e-2
        up = small.loss(x, y)[0]
        small.p[name][at] = keep - 1e-2
        down = small.loss(x, y)[0]
        small.p[name][at] = keep
        assert (up - down) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.05, abs=1e-3)


def test_pii_tagger_on_texts_written_by_hand():
    """Spans that no generator made, some without a digit or an @ anywhere near."""
    cases = {
        "Contact: support [at] openoffice [dot] net or come by.": ["support [at] openoffice [dot] net"],
        "You can reach Jan at jan.kowalski @ firma.com, he said.": ["jan.kowalski @ firma.com"],
        "The office line is (415) 555-0132 and it rings all day.": ["(415) 555-0132"],
        "My server sits at fe80:1234:abcd:9f01:2222:3333:4444:5555 since May.": ["fe80:1234:abcd:9f01:2222:3333:4444:5555"],
        "Charge it to 4111-1111-1111-1111 today.": ["4111-1111-1111-1111"],
        "Charge it to 4111.1111.1111.1111 today.": ["4111.1111.1111.1111"],
        "call 212-555-0199 or 212.555.0123 now": ["212-555-0199", "212.555.0123"],
        "In 1999 we met (at) noon, see chapter 3.2 and page 415.": [],
        "Nothing private here, only words and a list: (a) first, (b) second [see dot].": [],
    }
    model = pii.default_model()
    found = {t: [t[s:e] for s, e, _ in pii.tag(model, [t])[0]] for t in cases}
    right = sum(found[t] == want for t, want in cases.items())
    assert right >= len(cases) - 1, found
    # in the middle of a text of many windows, and in every one of repeated rows
    t = "The office line is (415) 555-0132 and it rings all day."
    long = "Plain words stand here. " * 700 + t + " More words stand here." * 700
    at = long.index("(415)")
    assert [pii.tag(model, [x])[0] for x in (long, long)] == [[(at, at + 14, "phone")]] * 2


def test_codec_keeps_reused_chunks():
    """A full cache gives up the chunks used once only; results stay those of a fresh codec."""
    raw = sentencepiece_codec.default_model()
    c = sentencepiece_codec.Codec(raw)
    c.CACHE = 40
    for k in range(4):
        texts = [f"the same words  and ▁ again é {' '.join(f'w{k}x{i}' for i in range(30))} " + " " * 40, "", "the same words"]
        got, fresh = c.apply(texts), sentencepiece_codec.Codec(raw).apply(texts)
        assert [list(x) for x in got] == [list(x) for x in fresh]
        c._forget_rare()
        assert "▁words" in c.rows and f"▁w{k}x1" not in c.rows


def test_quick_emissions_need_no_tanh(monkeypatch):
    """Gates go by exp, in less time than tanh takes, and stay finite at their limits."""
    import numpy as np

    model, r = pii.Tagger(), np.random.default_rng(4)
    x = r.integers(0, pii.N_CHARS, (5, 37))
    plain = model.emissions(x)[0]
    model.p = {k: v * 40 if k[0] in "WU" else v for k, v in model.p.items()}
    monkeypatch.setattr(np, "tanh", None)
    assert np.isfinite(model.quick_emissions(x)).all()
    model.p = pii.Tagger().p
    assert np.abs(plain.transpose(0, 2, 1) - model.quick_emissions(x)).max() < 1e-5


def test_pii_quick_path_equals_the_plain_one():
    """Emissions, and decoding, against the training path and Viterbi over all tags."""
    import numpy as np

    model, r = pii.default_model(), np.random.default_rng(4)
    texts = [t for t, _ in pii.examples(30, seed=31)]
    x = np.array([np.append(pii.classes(t)[:90], np.full(max(0, 90 - len(t)), pii.PAD)) for t in texts])
    em = model.emissions(x)[0]
    assert np.abs(em.transpose(0, 2, 1) - model.quick_emissions(x)).max() < 1e-4
    T = model.p["T"] + model.allowed()
    score = em[0].copy()
    score[:, 2::2] -= 1e4
    back = []
    for t in range(1, 90):
        step = score[:, :, None] + T
        back.append(step.argmax(axis=1))
        score = step.max(axis=1) + em[t]
    best = [score.argmax(axis=1)]
    for b in reversed(back):
        best.append(b[np.arange(len(x)), best[-1]])
    assert (np.array(best[::-1]).T == model.decode(x)).mean() > 0.999


def test_pii_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or call +1 826 555 4081.", "x"), (2, None, "y"), (3, "plain", "z")], "doc_id long, text string, source string")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] or call [PHONE].", "x"), (2, None, "y"), (3, "plain", "z")]


def test_quality_gam(spark, docs, none, rows):
    r = random.Random(3)
    made = [(k, prose(r, 100) if k % 3 else " ".join(w + "###" for w in prose(r, 100).split())) for k in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(200)] + [(None, 1), (7, None)], "doc_id long, y int")
    got = {x["doc_id"]: x["predicted"] for x in quality_gam.apply(df, labels).collect()}
    assert sum(got[k] == int(k % 3 > 0) for k in range(200, 300)) > 95
    assert quality_gam.keep_good(df, labels).where("doc_id >= 200").count() == pytest.approx(67, abs=5)
    assert quality_gam.apply(docs, labels).count() == len(rows)
    assert quality_gam.apply(none, labels).count() == 0
    only = {x["score"] for x in quality_gam.apply(docs, labels.where("false")).collect()}
    assert only == {0.5}


def test_gam_learns_an_interaction():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.random((3000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.Additive().fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9


def test_language(spark, none, docs):
    texts = {"en": "the cat and the dog of the house with this", "de": "der hund und die katze in das haus mit dem", "fr": "le chat et la maison avec les chiens dans une"}
    r = random.Random(2)
    made = [(k, " ".join(r.choices(texts[x].split(), k=12)), x) for k, x in enumerate(["en", "de", "fr"] * 40)]
    df = spark.createDataFrame([*made, (500, None, "en"), (501, "x", None)], "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.langs == ["de", "en", "fr"]
    assert sum(model.score(t)[0] == x for _, t, x in made) == len(made)
    assert model.score("katzen hundehaus")[0] == "de"  # unseen words: longest known n-grams
    assert model.score(None) == model.score("12 !? \n") == ("und", 0.0)
    assert all(0 <= model.score(t)[1] <= 1 for _, t, _ in made)
    assert language.apply(none, model).count() == 0 and language.apply(docs, model).count() == docs.count()
    assert language.train(none).score("the cat") == ("und", 0.0)


def counted(words):
    """Rows for a model from (lang, word, n)."""
    out = Counter()
    for lang, word, n in words:
        out[lang, 0, word] += n
        for size in range(1, language.N + 1):
            for x in language.grams(word, size):
                out[lang, size, x] += n
    return [(*k, n) for k, n in out.items()]


def test_language_long_words():
    """Every letter of an unbroken run counts, in training and in scoring; text is whole, whatever its length."""
    model = language.Backoff(counted([("aa", "abcabd", 5), ("zz", "xyzxyw", 5), ("zz", "a" * 60 + "qrst", 3)]))
    assert model.score("abc" * 10 + "xyz" * 300)[0] == "zz"
    assert model.score("xyz" * 10 + "abc" * 3000)[0] == "aa"
    assert model.score("b" * 60 + "qrst")[0] == "zz"
    assert model.score("abcabd " * 10 + "xyzxyw " * 50_000)[0] == "zz"
    assert "qrst" in model.index[4]


def test_language_letters_only():
    """A letter is what Unicode calls one: fractions, powers and digits are none."""
    model = language.Backoff(counted([("de", "haus", 3), ("fr", "maison", 3)]))
    for text in ("½", "²", "12 ³ ¾", "_", "٣", "", None):
        assert model.score(text) == ("und", 0.0)
    assert model.score("ª haus")[0] == "de" and model.score("maison½")[0] == "fr"
    # equal scores go to the first language by name
    assert language.Backoff(counted([("bb", "xy", 1), ("aa", "xy", 1)])).score("xy") == ("aa", pytest.approx(0.5))


def test_language_against_plain_scoring(spark):
    """Batches against a plain version of the rule, and small languages keep their own words."""
    r = random.Random(4)
    made = [(k, " ".join(f"{w}{x}" for w in WORDS for _ in range(3)), x) for k, x in enumerate(["aa", "bb"] * 4)]
    made += [(100 + k, "".join(r.choice("qwxyz") for _ in range(50)), "zz") for k in range(4)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.langs == ["aa", "bb", "zz"]
    words = Counter((x, w) for _, t, x in made for w in t.split())
    rows = counted([(x, w, n) for (x, w), n in words.items()])
    n_of = {r[:3]: r[3] for r in rows}
    total = Counter()
    for lang, size, _, n in rows:
        total[lang, size] += n
    distinct = Counter(size for size, _ in {r[1:3] for r in rows})
    known = {r[1:3] for r in rows}

    def value(lang, size, x):
        return math.log((n_of.get((lang, size, x), 0) + 0.1) / (total[lang, size] + 0.1 * (distinct[size] + 1)))

    def plain(text):
        sums = {}
        for lang in model.langs:
            s = 0.0
            for w in text.lower().split():
                if (0, w) in known:
                    s += value(lang, 0, w)
                    continue
                for size in range(language.N, 0, -1):
                    got = [x for x in language.grams(w, size) if (size, x) in known]
                    if got:
                        s += sum(value(lang, size, x) for x in got) / len(got)
                        break
            sums[lang] = s
        best = max(model.langs, key=lambda x: sums[x])
        return best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())

    texts = ["kanab zyxw lorte", "zyxwqqwzyx", *(t for _, t, _ in made[:2]), "kanaaa", "qqq kanaaa loraa"]
    best, score = model.scores(texts)
    for t, b, p in zip(texts, best, score, strict=True):
        assert (b, p) == (plain(t)[0], pytest.approx(plain(t)[1], abs=1e-9))


def test_language_held_out_accuracy(spark):
    from weftline.llm.common import held_out, table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    row = got.agg(F.count("*").alias("n"), F.sum(F.expr("int(lang = lang_pred)")).alias("k")).first()
    assert row["k"] >= 0.97 * row["n"] > 100


def test_sentencepiece(docs, none, rows):
    import sentencepiece

    raw = sentencepiece_codec.default_model()
    c = sentencepiece_codec.Codec(raw)
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    r = random.Random(5)
    texts = ["a  b", " a", "a ", "   ", "▁x", "日本 \x00 é\U0001f600", "<s> hi <0x41>", "x" * 300, *("a" + " " * n + "b" for n in range(1, 50)), *(" " * n + "\U0001f600" for n in range(1, 40)), *(" " * n for n in range(1, 40))]
    texts += ["".join(r.choice("ab  é\n▁\U0001f600") for _ in range(60)) for _ in range(300)]
    texts += [t or "" for _, t in rows]
    got = c.encode(texts)
    assert got == [sp.encode(t) for t in texts]
    assert [c.decode([i])[0] == t for i, t in zip(got, texts, strict=True)] == c.apply(texts)[2]
    out = sentencepiece_codec.apply(docs, raw).collect()
    assert len(out) == len(rows) and all(x["round_trip"] and x["parity"] for x in out)
    assert sentencepiece_codec.digest(sentencepiece_codec.apply(none, raw)).count() == 0


def brute_words(rows, width=50):
    first = {}
    for k, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            k2 = math.inf if k is None else k
            first[x] = min(first.get(x, math.inf), k2)
    out = []
    for k, t in rows:
        w, gone = (t or "").encode().split(), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (math.inf if k is None else k):
                gone |= set(range(i, i + width))
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def brute_bytes(rows, width=100):
    first, out = {}, []
    place = lambda k, i: (math.inf if k is None else k, i)
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            x = b[i : i + width]
            first[x] = min(first.get(x, (math.inf, math.inf)), place(k, i))
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < place(k, i):
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def assert_repeats(df, rows):
    key = lambda r: (ids(r[0]), r[1:])
    for op, brute in ((fm_index, brute_words), (bwt_merge, brute_bytes)):
        assert sorted((tuple(r) for r in op.apply(df).collect()), key=key) == sorted(brute(rows), key=key)


@pytest.fixture(params=[False, True])
def hot(request, monkeypatch):
    """True: every key with two contexts counts as one that has too many."""
    if request.param:
        monkeypatch.setattr(anchors, "SAMPLED", 1)
        monkeypatch.setattr(anchors, "HOT", 2)
    return request.param


def test_repeated_windows(docs, none, rows, hot):
    assert_repeats(docs, rows)
    assert sum(r["n_removed"] for r in bwt_merge.apply(docs).collect()) > 1000
    if not hot:
        assert_repeats(none, [])


def test_repeated_windows_many_rows_of_one_id(spark, hot):
    """Rows without doc_id whose texts agree in 16 bits of their hash are still different rows."""
    r = random.Random(12)
    passage = prose(r, 60)
    texts = [f"{prose(r, r.randrange(5, 60))} {passage} {prose(r, r.randrange(0, 20))}" for _ in range(1500)]
    tags = [x["h"] & 0xFFFF for x in spark.createDataFrame(list(enumerate(texts)), "k int, text string").orderBy("k").select(F.xxhash64("text").alias("h")).collect()]
    same = Counter(tags)
    rows = [(0, passage)] + [(None, t) for t, tag in zip(texts, tags, strict=True) if same[tag] > 1]
    assert len(rows) > 10
    assert_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_repeated_windows_without_any(spark):
    """Tables in which nothing repeats: one row, distinct words, one row a task."""
    one = [(1, " ".join(f"w{k}x{k * k}" for k in range(120)))]
    assert_repeats(spark.createDataFrame(one, "doc_id long, text string"), one)
    r = random.Random(3)
    many = [(k, " ".join(f"{r.randrange(10**9)}" for _ in range(60))) for k in range(60)]
    assert_repeats(spark.createDataFrame(many, "doc_id long, text string").repartition(50), many)
    nameless = [(None, t) for _, t in many] + [(None, many[0][1])] * 3 + [(5, many[1][1])] * 2
    assert_repeats(spark.createDataFrame(nameless, "doc_id long, text string").repartition(5), nameless)


def test_repeated_windows_hot_line(spark, hot):
    """A line in every row, with other words around it, over more tasks than cores."""
    r = random.Random(21)
    line = prose(r, 45)
    rows = [(k, f"{prose(r, r.randrange(3, 30))} {line} {prose(r, r.randrange(3, 30))}") for k in range(120)]
    rows += [(200 + k, rows[k][1]) for k in range(20)]
    assert_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(13), rows)


def test_repeated_windows_long_text(spark, monkeypatch, hot):
    """A text of more units than a stretch, with repeats inside it and elsewhere; tag, b and other names clash."""
    monkeypatch.setattr(anchors, "CHUNK", 5000)
    monkeypatch.setattr(anchors, "STRETCH", 2000)
    r = random.Random(22)
    passage = prose(r, 90)
    rows = [(1, " ".join([prose(r, 9000), passage, prose(r, 9000), passage, "z" * 20000])), (2, passage), (3, "z" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("tag", "b", "m", "ch", "doc", "spans", "w", "g", "blob", "key"):
        df = df.withColumn(c, F.lit(1))
    assert_repeats(df, rows)


def test_fm_index():
    """Matching statistics of texts that the index holds and of texts that it doesn't, against search in the texts."""
    import numpy as np

    r = np.random.default_rng(1)
    texts = [r.integers(1, 5, n) for n in (30, 1, 60, 7, 45, 200)]
    for depth in (6, 13):
        index = fm_index.FMIndex(texts, 5, depth, np.array([4, 9, 2, 7, 5, 3]))
        flat = lambda t: "".join(map(str, t))
        held = [flat(t) for t in texts]
        asked = [*texts, r.integers(1, 5, 300), np.concatenate([texts[0][5:25], texts[2][3:40]]), np.array([1]), r.integers(3, 5, 60)]
        for query, (match, place) in zip(asked, index.statistics(asked), strict=True):
            q = flat(query)
            for i in range(len(q)):
                want = max(k for k in range(depth + 1) if i + k <= len(q) and any(q[i : i + k] in t for t in held))
                assert match[i] == want
                if want == depth:
                    least = min(n for n, t in zip((4, 9, 2, 7, 5, 3), held, strict=True) if q[i : i + depth] in t)
                    assert index.least[index.interval(place[i : i + 1].astype(np.int64))[0]] == least
    c, i = np.array([0, 1, 2, 3, 4]), np.array([50, 60, 70, 80, 90])
    w = fm_index.WaveletMatrix(np.concatenate(texts), 5)
    assert [int(x) for x in w.rank(c, i)] == [int((np.concatenate(texts)[:k] == s).sum()) for s, k in zip(c, i, strict=True)]


def test_shards_agree_with_search(monkeypatch):
    """Both shard functions over many small parts, against search in the contents."""
    import numpy as np

    monkeypatch.setattr(fm_index, "PART", 300)
    monkeypatch.setattr(bwt_merge, "PART", 900)
    for module, width, dtype in ((fm_index, fm_index.WINDOW, np.uint64), (bwt_merge, bwt_merge.WINDOW, np.uint8)):
        r = np.random.default_rng(5)
        source = [r.integers(65, 69, 400).astype(dtype) for _ in range(3)]
        contents, docs, starts, keys = [], [], [], []
        for k in range(40):
            s, a = int(r.integers(3)), int(r.integers(0, 100))
            n = int(r.integers(width, 2 * width))
            contents.append(source[s][a : a + n].copy())
            docs.append(int(r.integers(1, 25)))
            starts.append(int(r.integers(0, 1000)))
            keys.append(s)  # equal windows have equal keys
        found = module.shard(contents, np.array(docs), np.array(starts), np.array(keys))
        first = {}
        for c, d, s in zip(contents, docs, starts, strict=True):
            for i in range(len(c) - width + 1):
                x = c[i : i + width].tobytes()
                first[x] = min(first.get(x, (99, 0)), (d, s + i))
        for c, (doc, place) in zip(contents, found, strict=True):
            want = [first[c[i : i + width].tobytes()] for i in range(len(c) - width + 1)]
            assert [x[0] for x in want] == doc.tolist()
            if module is bwt_merge:
                assert [x[1] for x in want] == place.tolist()


def test_interleave_is_the_sorted_order():
    import numpy as np

    r = np.random.default_rng(2)
    texts = [r.integers(97, 100, n).astype(np.uint8) for n in r.integers(1, 60, 40)]
    texts[3] = r.integers(97, 100, 50).astype(np.uint8)
    texts[9], texts[30] = texts[3], texts[3]
    for depth in (32, 20):
        shards = [bwt_merge.Transform.of(texts[k : k + 7], depth) for k in range(0, 40, 7)]
        lengths = np.array([len(x) for x in texts[:7]])
        some = bwt_merge.subset(shards[0], lengths, lengths > 20)
        assert np.array_equal(some.text, np.concatenate([np.append(x, np.uint8(255)) for x in texts[:7] if len(x) > 20]))
        t = bwt_merge.merged(shards, depth)
        key = [bytes(t.text[s : s + depth]) for s in t.suffixes]
        whole = [k.split(b"\xff")[0] for k in key]
        assert all(a <= b or a.startswith(b) or b.startswith(a) for a, b in zip(whole, whole[1:]))
        assert sorted(t.suffixes.tolist()) == list(range(len(t.text)))
        # common prefixes: neighbours that hold no end share an interval if and only if they are equal
        for (a, x), (b, y) in zip(zip(whole, t.intervals), zip(whole[1:], t.intervals[1:])):
            if len(a) == len(b) == depth:
                assert (a == b) == (x == y)
        assert any(len(a) == depth and a == b for a, b in zip(whole, whole[1:]))
