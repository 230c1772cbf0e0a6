"""Hierarchical Pitman-Yor language model.

Every word that some training token follows, and the start of a text, has a restaurant of its own for the words that
follow it; all of them share the parent restaurant of single words; its base is uniform over the vocabulary and one
unknown word.

Training is by Gibbs sampling of Chinese-restaurant seating, in CHAINS chains whose predictive probabilities are averaged.
Pairs of context and word are dealt to buckets by context; contexts with more tokens than a bucket takes are split by
word.  A round seats all customers of each word in each restaurant anew, one after the other, given the parent's
probabilities (in the first round the shares of words among the bucket's pairs) and everything else; a customer opens a table with weight (strength + discount * tables) * parent, or joins
one with weight customers - discount * tables, so the number of tables is all the state there is to keep.  Above EXACT
customers of a word in one restaurant, tables are drawn in blocks of 1/64 of those seated.  Each table is a customer of
the parent: buckets tell the tables of their words to the words' own buckets (`_exchange`), where the parent's customers
are seated in the same way, and are told the new weights.  Strengths are resampled each round by auxiliary variables;
discounts are estimated from counts of counts, the parent's from each chain's seating of the round.

Words with more than a share 1 / LIST of the tokens (at most LIST) are known to every task, so that no bucket is asked for
them by all others, and pairs with more than 1 / LIST_PAIRS are scored where the text is.  All other tokens are scored in
the bucket of their pair, the texts in PASSES parts that bound what is shuffled at once.  Pairs that only texts to be scored have
count 0.  Which words are listed, and how many buckets there are, follows from a sample of the texts; it decides about
balance and the random numbers drawn, not about what is counted.

Tokens: A-Z lower-cased, words are runs of bytes other than white space, then one end token.  Words are told apart by
64-bit hashes.  Defined results: null and empty texts are one end token; texts of any length are counted and scored whole;
without training rows every probability comes from the base (train_tokens 0); repeated rows each count and each get a row;
a row without doc_id is in training; an empty table gives no rows; words with equal counts (ties) are treated alike; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CODES, LOWER, forget, held_out, materialise, mix, prefix_sums, span_hash, table, text_batches, tidied, tidied_group, word_bounds

CHAINS, ROUNDS, EXACT = 2, 2, 256
#: At most so many words, and pairs, are listed; of the sample, one text in SAMPLED, a word must have LISTED tokens, of all a pair PAIRED.
LIST, LIST_PAIRS, SAMPLED, LISTED, PAIRED = 1 << 20, 1 << 17, 16, 8, 32
#: Tokens of a task sent on at once, about as many to a bucket, and passes of scoring.
FLUSH, BUCKET, PASSES = 650_000, 1_000_000, 4
END, START = (np.uint64(x) for x in (0x5EED0E0D5EED0E0D, 0x5EED57A57A57A57A))
NAMELESS = (1 << 63) - 1
LOW = np.uint64(0xFFFFFFFF)


# ---- tokens ------------------------------------------------------------------------------------

def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token codes of texts laid end to end, each text's codes followed by END; the codes before them; the text of each."""
    ws, we = word_bounds(data, offsets[1:-1])
    codes = span_hash(prefix_sums(CODES[LOWER[data]]), ws, we) if len(ws) else np.empty(0, np.uint64)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(np.searchsorted(ws, offsets)))
    out, doc = np.empty(len(codes) + n, np.uint64), np.empty(len(codes) + n, np.int64)
    at = np.arange(len(codes)) + owner
    ends = np.cumsum(np.bincount(owner, minlength=n)) + np.arange(n)
    out[at], out[ends] = codes, END
    doc[at], doc[ends] = owner, np.arange(n)
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[np.concatenate([[0], ends[:-1] + 1])] = START
    return out, before, doc


def _place(codes: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Index in a sorted array, or -1."""
    if not len(among):
        return np.full(len(codes), -1, np.int64)
    at = np.minimum(np.searchsorted(among, codes), len(among) - 1)
    return np.where(among[at] == codes, at, -1)


def pair_code(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u.copy()) + w)


class Layout:
    """Where things are: listed words (sorted), the number of buckets, and the contexts that are split, with their parts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, texts: int) -> None:
        """Estimates: tokens of the listed words, of all words, and number of texts."""
        self.words = words
        self.buckets = max(8, -(-tokens // BUCKET))
        names, sizes = np.append(words, START), np.append(counts, texts)
        order = np.argsort(names)
        names, sizes = names[order], sizes[order]
        split = sizes > BUCKET
        self.split, self.parts = names[split], -(-sizes[split] // BUCKET).astype(np.int64)

    def bucket(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        at, key = _place(u, self.split), u
        some = at >= 0
        if some.any():
            key = u.copy()
            key[some] += (mix(w[some]) % self.parts[at[some]].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return (mix(key.copy()) % np.uint64(self.buckets)).astype(np.int64)

    def home(self, w: np.ndarray) -> np.ndarray:
        """The bucket of each word in the parent."""
        return (mix(w + np.uint64(0x484F4D45)) % np.uint64(self.buckets)).astype(np.int64)


def layout(docs: DataFrame) -> Layout:
    """From a sample of the training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_batches(batch):
                w, n = np.unique(tokens_of(data, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["w", "n"])

    drawn = docs.where("learn").select("text").where(F.pmod(F.xxhash64(F.lit(31), "text"), F.lit(SAMPLED)) == 0)
    counts = materialise(drawn.mapInArrow(tidied(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    got = counts.where(F.col("n") >= max(LISTED, total // LIST)).toArrow()
    w, n = got["w"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(w)
    texts = int(n[w == END].sum())
    forget(counts)
    return Layout(w[order], n[order] * SAMPLED, total * SAMPLED, texts * SAMPLED)


# ---- counts ------------------------------------------------------------------------------------

def _ints(values: np.ndarray) -> bytes:
    """Small numbers in one octet each, larger ones aside."""
    big = values >= 255
    return np.array([big.sum()], "<u8").tobytes() + np.where(big, 255, values).astype("u1").tobytes() + values[big].astype("<i8").tobytes()


def _indices(values: np.ndarray, size: int) -> bytes:
    """Two octets each, three or four where `size` needs them."""
    if 1 << 16 < size <= 1 << 24:
        return values.astype("<u2").tobytes() + (values >> 16).astype("u1").tobytes()
    return values.astype("<u2" if size <= 1 << 16 else "<u4").tobytes()


def _names(values: np.ndarray) -> bytes:
    """Sorted hashes: many of them as steps of seven octets, with wider steps aside."""
    if len(values) < 4096:
        return values.astype("<u8").tobytes()
    steps = np.diff(values, prepend=np.uint64(0))
    wide = np.flatnonzero(steps >> np.uint64(56))
    return b"".join([np.array([len(wide)], "<u8").tobytes(), steps.astype("<u8").view("u1").reshape(-1, 8)[:, :7].tobytes(), wide.astype("<u4").tobytes(), (steps[wide] >> np.uint64(56)).astype("u1").tobytes()])


class _Reader:
    def __init__(self, blob) -> None:
        self.blob, self.at = blob, 0

    def take(self, dtype: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.blob, dtype, n, self.at)
        self.at += out.nbytes
        return out

    def names(self, n: int) -> np.ndarray:
        if n < 4096:
            return self.take("<u8", n)
        wide = int(self.take("<u8", 1)[0])
        steps = np.zeros((n, 8), np.uint8)
        steps[:, :7] = self.take("u1", 7 * n).reshape(n, 7)
        at = self.take("<u4", wide)
        steps[at, 7] = self.take("u1", wide)
        return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)

    def ints(self, n: int) -> np.ndarray:
        big = int(self.take("<u8", 1)[0])
        out = self.take("u1", n).astype(np.int64)
        if big:
            out[out == 255] = self.take("<i8", big)
        return out

    def indices(self, n: int, size: int) -> np.ndarray:
        if 1 << 16 < size <= 1 << 24:
            return self.take("<u2", n).astype(np.int64) | (self.take("u1", n).astype(np.int64) << 16)
        return self.take("<u2" if size <= 1 << 16 else "<u4", n).astype(np.int64)


class Pairs:
    """Distinct pairs sorted by context and word: names of contexts and words, indices into them, and counts."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
        self.contexts, self.words, self.u, self.w, self.c = contexts, words, u, w, c

    def pack(self) -> bytes:
        nu, nw, n = len(self.contexts), len(self.words), len(self.u)
        return b"".join([np.array([nu, nw, n], "<u8").tobytes(), _names(self.contexts), _names(self.words), np.bincount(self.u, minlength=nu).astype("<u4").tobytes(), _indices(self.w, nw), _ints(self.c)])

    @classmethod
    def unpack(cls, blob) -> Pairs:
        r = _Reader(blob)
        nu, nw, n = r.take("<u8", 3).tolist()
        contexts, words, runs = r.names(nu), r.names(nw), r.take("<u4", nu)
        return cls(contexts, words, np.repeat(np.arange(nu), runs), r.indices(n, nw), r.ints(n))

    @classmethod
    def joined(cls, parts: list[Pairs]) -> Pairs:
        contexts, words = (np.unique(np.concatenate([getattr(p, k) for p in parts])) for k in ("contexts", "words"))
        key = np.concatenate([(np.searchsorted(contexts, p.contexts)[p.u] << 32) | np.searchsorted(words, p.words)[p.w] for p in parts])
        c = np.concatenate([p.c for p in parts])
        order = np.argsort(key)
        key, c = key[order], c[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key = key[at]
        return cls(contexts, words, key >> 32, key & 0xFFFFFFFF, np.add.reduceat(c, at))


def _coded(before: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all tokens of whole texts, and indices of contexts and words; the start of a text is the last name."""
    names, w = np.unique(tokens, return_inverse=True)
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[before == START] = len(names)
    return np.append(names, START), u, w


def _local(names: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names some indices use, sorted, and indices into these."""
    used, at = np.unique(index, return_inverse=True)
    own = names[used]
    if len(own) > 1 and own[-1] < own[-2]:  # the start of a text
        k = int(np.searchsorted(own[:-1], own[-1]))
        last = at == len(own) - 1
        at = np.where(last, k, at + (at >= k))
        own = np.insert(own[:-1], k, own[-1])
    return own, at


def _route(docs: DataFrame, where: Layout) -> DataFrame:
    """(b, blob): pairs of all texts, counted in training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            names, u, w = _coded(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            key = (u.astype(np.uint64) << np.uint64(32)) | (w.astype(np.uint64) << np.uint64(1)) | np.concatenate([h[2] for h in held])
            held.clear()
            key.sort()
            at = np.flatnonzero(np.append(True, (key[1:] >> np.uint64(1)) != (key[:-1] >> np.uint64(1))))
            c = np.add.reduceat((key & np.uint64(1)).astype(np.int64), at)
            u, w = (key[at] >> np.uint64(32)).astype(np.int64), ((key[at] & LOW) >> np.uint64(1)).astype(np.int64)
            b = where.bucket(names[u], names[w])
            order = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[order], np.arange(where.buckets + 1))
            ks, blobs = np.flatnonzero(np.diff(cuts)), []
            for k in ks:
                o = order[cuts[k] : cuts[k + 1]]
                (names_u, i), (names_w, j) = _local(names, u[o]), _local(names, w[o])
                again = np.argsort(i, kind="stable")  # the start of a text has moved
                blobs.append(Pairs(names_u, names_w, i[again], j[again], c[o][again]).pack())
            return pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(blobs, pa.binary())], ["b", "blob"])

        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            for row, data, offsets in text_batches(batch):
                t, before, d = tokens_of(data, offsets)
                held.append((before, t, learn[row + d]))
                size += len(t)
                if size >= FLUSH:
                    yield send()
                    size = 0
        if held:
            yield send()

    return docs.select("text", "learn").mapInArrow(tidied(run), "b int, blob binary")


# ---- seating -----------------------------------------------------------------------------------

def seat(customers: np.ndarray, alpha: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that the customers of many (restaurant, word) pairs take, seated one after the other, all pairs side by side."""
    tables = np.minimum(customers, 1).astype(np.int64)
    order = np.argsort(-customers, kind="stable")
    order = order[: int(np.searchsorted(-customers[order], -1, "left"))]
    c, a, t = customers[order], alpha[order], np.ones(len(order), np.int64)
    most = int(c[0]) if len(c) else 0
    for j in range(1, min(most, EXACT)):
        n = int(np.searchsorted(-c, -j, "left"))  # pairs with more than j customers
        t[:n] += rng.random(n) * (a[:n] + j - discount * t[:n]) < a[:n]
    n = int(np.searchsorted(-c, -EXACT, "left"))
    if n:
        j = np.full(n, EXACT)
        while (j < c[:n]).any():
            block = np.clip(j // 64, 0, c[:n] - j)
            middle = j + block / 2
            t[:n] += rng.binomial(block, np.clip(a[:n] / (a[:n] + middle - discount * t[:n]), 0, 1))
            j += block
    tables[order] = t
    return tables


def strength_terms(customers: np.ndarray, tables: np.ndarray, strength: float, discount: float, rng: np.random.Generator) -> tuple[float, float]:
    """Sums over restaurants of the auxiliary variables of the strength: successes, and logarithms of shares."""
    some = customers > 1
    shares = rng.beta(strength + 1, customers[some] - 1) if some.any() else np.ones(1)
    more = np.maximum(tables - 1, 0)
    few = np.minimum(more, 1000)
    i = np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few) + 1
    wins = float((rng.random(len(i)) * (strength + discount * i) < strength).sum())
    many = more[more > 1000].astype(float)
    wins += float(rng.poisson(strength / discount * np.log((strength + discount * many) / (strength + discount * 1000))).sum())
    return wins, float(np.log(np.maximum(shares, 1e-300)).sum())


def discount_of(once: float, twice: float) -> float:
    """From counts of counts; a restaurant without any has 0.5."""
    return (once + 0.5) / (once + 2 * twice + 1.0)


class Totals:
    """What all restaurants share, by chain, and the parent's weights of listed words."""

    def __init__(self, where: Layout) -> None:
        n = len(where.words)
        self.strength, self.parent_strength = np.ones(CHAINS), np.ones(CHAINS)
        self.discount, self.parent_discount = 0.5, np.full(CHAINS, 0.5)
        self.parent_customers, self.parent_tables = np.zeros(CHAINS), np.zeros(CHAINS)
        self.tokens = self.vocabulary = 0
        self.split_customers, self.split_tables = np.zeros(len(where.split)), np.zeros((CHAINS, len(where.split)))
        self.weight, self.count = np.zeros((CHAINS, n), np.float32), np.zeros(n, np.int64)

    def parent(self, chain: int, weight: np.ndarray) -> np.ndarray:
        """Probability of words in the parent; weight: customers less discount times tables."""
        n = self.parent_strength[chain] + self.parent_customers[chain]
        return weight / n + (self.parent_strength[chain] + self.parent_discount[chain] * self.parent_tables[chain]) / n / (self.vocabulary + 1)


def predictive(c: np.ndarray, t: np.ndarray, u: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray, strength: float, discount: float) -> np.ndarray:
    """Probability of each pair; customers and tables of each context u, the parent's probability of each pair's word."""
    return (c - discount * t + (strength + discount * tables[u]) * parent) / (strength + customers[u])


# ---- training ----------------------------------------------------------------------------------

#: kind 0: number k with value v; 1: pairs of bucket b; 2: from bucket b to word bucket k, or back; 3: tables of bucket b; 4: listed words; 5: scores of bucket b; 6: frequent pairs.
ROWS = "kind int, k int, b int, v double, blob binary"
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary())


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], [x.split()[0] for x in ROWS.split(", ")])


def _asks(pairs: Pairs, tables: np.ndarray, where: Layout, b: int, wanted: np.ndarray, counts: bool) -> list[tuple]:
    """What bucket b tells the word buckets of its words: tables of each chain, whether it wants an answer, and counts."""
    n = len(pairs.words)
    sums = [np.bincount(pairs.w, t, n) for t in tables] + ([np.bincount(pairs.w, pairs.c, n)] if counts else [])
    home = where.home(pairs.words)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(where.buckets + 1))
    out = []
    for k in np.flatnonzero(np.diff(cuts)):
        o = order[cuts[k] : cuts[k + 1]]
        out.append((2, int(k), b, None, b"".join([np.array([len(o)], "<u8").tobytes(), pairs.words[o].tobytes(), np.packbits(wanted[o]).tobytes(), *(_ints(x[o].astype(np.int64)) for x in sums)])))
    return out


def _exchange(told: DataFrame, where: Layout, totals: Totals, counts: bool, seed: int) -> DataFrame:
    """The parent's seating, in the buckets of words; answers to buckets, listed words, and numbers."""
    def answer(key: tuple, group: pa.Table) -> pa.Table:
        k, sizes, words, wanted = key[0].as_py(), [], [], []
        sums: list[list[np.ndarray]] = [[] for _ in range(CHAINS + counts)]
        for blob in group.column("blob"):
            r = _Reader(blob.as_buffer())
            n = int(r.take("<u8", 1)[0])
            sizes.append(n)
            words.append(r.take("<u8", n))
            wanted.append(np.unpackbits(r.take("u1", -(-n // 8)), count=n).astype(bool))
            for x in sums:
                x.append(r.ints(n))
        names, at = np.unique(np.concatenate(words), return_inverse=True)
        total = [np.bincount(at, np.concatenate(x), len(names)).astype(np.int64) for x in sums]
        listed = _place(names, where.words)
        weight, out = np.empty((CHAINS, len(names)), np.float32), []
        for chain in range(CHAINS):
            c, d = total[chain], totals.parent_discount[chain]
            base = (totals.parent_strength[chain] + d * totals.parent_tables[chain]) / (totals.vocabulary + 1)
            t = seat(c, np.full(len(c), base), d, np.random.default_rng([seed, chain, k, 1]))
            weight[chain] = c - d * t
            out += [(0, 10 * chain + i, None, float(v), None) for i, v in enumerate((c.sum(), t.sum(), (c == 1).sum(), (c == 2).sum()))]
        out.append((0, 100, None, float((total[0] > 0).sum()), None))
        own = listed >= 0
        if own.any():
            out.append((4, k, None, None, b"".join([np.array([own.sum()], "<u8").tobytes(), listed[own].astype("<i8").tobytes(), weight[:, own].tobytes(), (total[-1][own] if counts else np.zeros(own.sum(), np.int64)).tobytes()])))
        cuts = np.cumsum([0, *sizes])
        for b, s, e, w in zip(group.column("b").to_pylist(), cuts[:-1], cuts[1:], wanted, strict=True):
            i = at[s:e][w]
            i = i[~own[i]]
            out.append((2, k, b, None, weight[:, i].tobytes() + (_ints(total[-1][i]) if counts else b"")))
        return _rows(out)

    return materialise(told.where("kind = 2").groupBy("k").applyInArrow(tidied_group(answer), ROWS))


def _read_exchange(answers: DataFrame, where: Layout, totals: Totals) -> None:
    """Take the parent's numbers and the listed words over into the totals."""
    rng = np.random.default_rng(totals.tokens + 1)
    got = {r["k"]: r["v"] for r in answers.where("kind = 0").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    totals.vocabulary = int(got.get(100, 0))
    for chain in range(CHAINS):
        c, t, once, twice = (got.get(10 * chain + i, 0.0) for i in range(4))
        totals.parent_customers[chain], totals.parent_tables[chain] = c, t
        wins, logs = strength_terms(np.array([c]), np.array([int(t)]), totals.parent_strength[chain], totals.parent_discount[chain], rng)
        totals.parent_strength[chain] = rng.gamma(1 + wins) / (1 - logs)
        totals.next_discount[chain] = discount_of(once, twice)
    for row in answers.where("kind = 4").select("blob").toArrow()["blob"]:
        r = _Reader(row.as_buffer())
        n = int(r.take("<u8", 1)[0])
        at = r.take("<i8", n)
        totals.weight[:, at] = r.take("<f4", CHAINS * n).reshape(CHAINS, n)
        totals.count[at] = r.take("<i8", n)


class Bucket:
    """A bucket's pairs with what it has been told: tables of each pair, the parent's weights of its words, and their counts."""

    def __init__(self, group: pa.Table, where: Layout, totals: Totals) -> None:
        kinds, ks, blobs = group.column("kind").to_pylist(), group.column("k").to_pylist(), [x.as_buffer() for x in group.column("blob")]
        self.pairs = p = Pairs.unpack(blobs[kinds.index(1)])
        self.where = where
        listed = _place(p.words, where.words)
        self.own = listed < 0
        self.split = _place(p.contexts, where.split)
        some, r = p.c > 1, _Reader(blobs[kinds.index(3)])
        self.tables = [np.minimum(p.c, 1) for _ in range(CHAINS)]
        for t in self.tables:
            t[some] = r.ints(int(some.sum()))
        self.customers = np.bincount(p.u, p.c, len(p.contexts))
        self.customers[self.split >= 0] = totals.split_customers[self.split[self.split >= 0]]
        self.weight, self.count = np.zeros((CHAINS, len(p.words))), np.zeros(len(p.words), np.int64)
        self.weight[:, ~self.own], self.count[~self.own] = totals.weight[:, listed[~self.own]], totals.count[listed[~self.own]]
        self.answers = [(k, blob) for kind, k, blob in zip(kinds, ks, blobs, strict=True) if kind == 2]

    def wanted(self, every: bool) -> np.ndarray:
        """Words whose weights the next job needs: all, or those with a customer to be seated."""
        p = self.pairs
        return np.ones(len(p.words), bool) if every else np.bincount(p.w[p.c > 1], minlength=len(p.words)) > 0

    def read(self, wanted: np.ndarray, counts: bool) -> None:
        home = self.where.home(self.pairs.words)
        asked = np.flatnonzero(wanted & self.own)
        order = asked[np.argsort(home[asked], kind="stable")]
        cuts = np.searchsorted(home[order], np.arange(self.where.buckets + 1))
        for k, blob in self.answers:
            o = order[cuts[k] : cuts[k + 1]]
            r = _Reader(blob)
            self.weight[:, o] = r.take("<f4", CHAINS * len(o)).reshape(CHAINS, len(o))
            if counts:
                self.count[o] = r.ints(len(o))

    def context_tables(self, chain: int, totals: Totals) -> np.ndarray:
        out = np.bincount(self.pairs.u, self.tables[chain], len(self.pairs.contexts))
        out[self.split >= 0] = totals.split_tables[chain, self.split[self.split >= 0]]
        return out


def train(docs: DataFrame) -> tuple[Layout, Totals, DataFrame, DataFrame]:
    """Layout, totals, scores by bucket (kind 5) and frequent pairs (kind 6). docs: text, and learn, true for training rows."""
    spark = docs.sparkSession
    where = layout(docs)

    def gather(key: tuple, group: pa.Table) -> pa.Table:
        b = key[0].as_py()
        p = Pairs.joined([Pairs.unpack(x.as_buffer()) for x in group.column("blob")])
        once, twice = (p.c == 1).sum(), (p.c == 2).sum()
        numbers = [(0, i, None, float(v), None) for i, v in enumerate((p.c.sum(), once, twice))]
        # the first round: contexts are dealt by hash, so the bucket's pairs are a sample of the parent's customers
        first, some, d = np.minimum(p.c, 1), p.c > 1, discount_of(once, twice)
        share = np.bincount(p.w, first, len(p.words))
        share = (share + 1 / (len(p.words) + 1)) / (share.sum() + 1)
        alpha = (1 + d * np.bincount(p.u, first, len(p.contexts)))[p.u[some]] * share[p.w[some]]
        tables = []
        for chain in range(CHAINS):
            t = first.copy()
            t[some] = seat(p.c[some], alpha, d, np.random.default_rng([1, chain, b]))
            tables.append(t)
        numbers += _split_numbers(p, tables, where, 1000, p.c)
        wanted = np.bincount(p.w[some], minlength=len(p.words)) > 0
        return _rows([(1, None, b, None, p.pack()), (3, None, b, None, b"".join(_ints(t[some]) for t in tables)), *numbers, *_asks(p, tables, where, b, wanted, ROUNDS == 1)])

    told = materialise(_route(docs.select("text", F.coalesce("learn", F.lit(False)).alias("learn")), where).groupBy("b").applyInArrow(tidied_group(gather), ROWS), "kind")
    first = told
    pairs, state = told.where("kind = 1"), told.where("kind = 3")
    totals = Totals(where)
    got = {r["k"]: r["v"] for r in told.where("kind = 0").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    totals.tokens, totals.discount = int(got.get(0, 0)), discount_of(got.get(1, 0.0), got.get(2, 0.0))
    _read_split(totals, got, where)
    totals.next_discount = np.full(CHAINS, 0.5)

    answers = _exchange(told, where, totals, ROUNDS == 1, 1)
    forget(told, "kind=2")
    _read_exchange(answers, where, totals)
    totals.parent_discount = totals.next_discount.copy()
    for round_ in range(2, ROUNDS + 1):
        last = round_ == ROUNDS
        shared = spark.sparkContext.broadcast(totals)  # at most LIST words and contexts

        def sit(key: tuple, group: pa.Table) -> pa.Table:
            b, known = key[0].as_py(), shared.value
            x = Bucket(group, where, known)
            p, some = x.pairs, x.pairs.c > 1
            x.read(x.wanted(False), False)
            tables, numbers = [], []
            for chain in range(CHAINS):
                rng = np.random.default_rng([round_, chain, b])
                s, d = known.strength[chain], known.discount
                alpha = (s + d * x.context_tables(chain, known))[p.u[some]] * known.parent(chain, x.weight[chain])[p.w[some]]
                t = np.minimum(p.c, 1)
                t[some] = seat(p.c[some], alpha, d, rng)
                tables.append(t)
                whole = x.split < 0
                wins, logs = strength_terms(x.customers[whole].astype(np.int64), np.bincount(p.u, t, len(p.contexts))[whole].astype(np.int64), s, d, rng)
                numbers += [(0, 10 * chain + 5, None, wins, None), (0, 10 * chain + 6, None, logs, None)]
            numbers += _split_numbers(p, tables, where, 1000, None)
            return _rows([(3, None, b, None, b"".join(_ints(t[some]) for t in tables)), *numbers, *_asks(p, tables, where, b, x.wanted(last), last)])

        parts = pairs.unionByName(answers.where("kind = 2")).unionByName(state)
        before, told = told, materialise(parts.groupBy("b").applyInArrow(tidied_group(sit), ROWS), "kind")
        forget(answers)
        if before is not first:
            forget(before)
        state = told.where("kind = 3")
        totals = _copied(totals)
        got = {r["k"]: r["v"] for r in told.where("kind = 0").groupBy("k").agg(F.sum("v").alias("v")).collect()}
        _read_split(totals, got, where)
        rng = np.random.default_rng([totals.tokens, round_])
        for chain in range(CHAINS):
            wins, logs = strength_terms(totals.split_customers.astype(np.int64), totals.split_tables[chain].astype(np.int64), totals.strength[chain], totals.discount, rng)
            totals.strength[chain] = rng.gamma(1 + wins + got.get(10 * chain + 5, 0.0)) / (1 - logs - got.get(10 * chain + 6, 0.0))
        answers = _exchange(told, where, totals, last, round_)
        forget(told, "kind=2")
        if before is first:
            forget(first, "kind=3")
        _read_exchange(answers, where, totals)
        if not last:
            totals.parent_discount = totals.next_discount.copy()

    shared = spark.sparkContext.broadcast(totals)
    often = max(PAIRED, totals.tokens // LIST_PAIRS)

    def finish(key: tuple, group: pa.Table) -> pa.Table:
        b, known = key[0].as_py(), shared.value
        x = Bucket(group, where, known)
        x.read(x.wanted(True), True)
        p, prob = x.pairs, np.zeros(len(x.pairs.u))
        for chain in range(CHAINS):
            prob += predictive(p.c, x.tables[chain], p.u, x.customers, x.context_tables(chain, known), known.parent(chain, x.weight[chain])[p.w], known.strength[chain], known.discount) / CHAINS
        out = [(5, None, b, None, Pairs(p.contexts, p.words, p.u, p.w, p.c[:0]).pack() + prob.astype("<f4").tobytes() + _ints(x.count))]
        top = p.c >= often
        if top.any():
            out.append((6, None, b, None, b"".join([np.array([top.sum()], "<u8").tobytes(), pair_code(p.contexts[p.u[top]], p.words[p.w[top]]).tobytes(), prob[top].tobytes(), x.count[p.w[top]].tobytes()])))
        return _rows(out)

    scores = materialise(pairs.unionByName(answers.where("kind = 2")).unionByName(state).groupBy("b").applyInArrow(tidied_group(finish), ROWS))
    for used in (first, told, answers):
        forget(used)
    return where, totals, scores.where("kind = 5"), scores.where("kind = 6")


def _copied(totals: Totals) -> Totals:
    import copy

    return copy.deepcopy(totals)


def _split_numbers(p: Pairs, tables: list[np.ndarray], where: Layout, start: int, c: np.ndarray | None) -> list[tuple]:
    """Customers (if c is given) and tables by chain of the bucket's part of split contexts."""
    at = _place(p.contexts, where.split)
    out = []
    for j, values in enumerate([c, *tables]):
        if values is not None:
            sums = np.bincount(p.u, values, len(p.contexts))
            out += [(0, start + (CHAINS + 1) * int(at[i]) + j, None, float(sums[i]), None) for i in np.flatnonzero(at >= 0)]
    return out


def _read_split(totals: Totals, got: dict[int, float], where: Layout) -> None:
    for i in range(len(where.split)):
        at = 1000 + (CHAINS + 1) * i
        totals.split_customers[i] = got.get(at, totals.split_customers[i])
        for chain in range(CHAINS):
            totals.split_tables[chain, i] = got.get(at + 1 + chain, 0.0)


# ---- scoring -----------------------------------------------------------------------------------

SUMS = (("rk", "<i8"), ("doc", "<i8"), ("rows", "<i4"), ("tokens", "<i4"), ("known", "<i4"), ("base", "<f8"), ("lm", "<f8"))


def _dealt(parts: int, **cols: np.ndarray) -> list[tuple[int, bytes]]:
    """Sums of texts, packed by the part their rk falls into."""
    n = len(cols["rk"])
    where = (mix(cols["rk"].astype(np.int64).view(np.uint64).copy()) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(parts + 1))
    full = {k: (cols[k] if k in cols else np.zeros(n)).astype(t)[order] for k, t in SUMS}
    return [(int(k), b"".join(full[f][cuts[k] : cuts[k + 1]].tobytes() for f, _ in SUMS)) for k in np.flatnonzero(np.diff(cuts))]


def _summed(key: tuple, group: pa.Table) -> pa.Table:
    """One part: the sums of each text over all its packed sums."""
    size, got = sum(np.dtype(t).itemsize for _, t in SUMS), {k: [] for k, _ in SUMS}
    for blob in group.column("blob"):
        raw, at = blob.as_buffer(), 0
        n = raw.size // size
        for k, t in SUMS:
            got[k].append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    cols = {k: np.concatenate(v) for k, v in got.items()}
    rk, at = np.unique(cols["rk"], return_inverse=True)
    doc = np.full(len(rk), np.iinfo(np.int64).min)
    own = cols["rows"] > 0
    doc[at[own]] = cols["doc"][own]
    out = {"rk": rk, "doc": doc} | {k: np.bincount(at, cols[k], len(rk)) for k, _ in SUMS[2:]}
    return pa.table([pa.array(out[k].astype(np.float64 if t == "<f8" else np.int64)) for k, t in SUMS], [k for k, _ in SUMS])


PARTIAL = "rk long, doc long, rows long, tokens long, known long, base double, lm double"


def score(docs: DataFrame, where: Layout, scores: DataFrame, frequent: DataFrame) -> DataFrame:
    """rk, doc, rows and the sums over tokens of each distinct (doc_id, text); base is the sum of log10(count + 1)."""
    codes, logs, counts = [np.empty(0, np.uint64)], [np.empty(0)], [np.empty(0)]
    for row in frequent.select("blob").toArrow()["blob"]:
        r = _Reader(row.as_buffer())
        n = int(r.take("<u8", 1)[0])
        codes.append(r.take("<u8", n))
        logs.append(np.log10(r.take("<f8", n)))
        counts.append(np.log10(r.take("<i8", n) + 1.0))
    order = np.argsort(np.concatenate(codes))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(np.concatenate(x)[order] for x in (codes, logs, counts)))  # at most LIST pairs

    def routed(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, logs, counts = shared.value
            held: list[tuple] = []
            size = 0

            def send() -> pa.RecordBatch:
                rk, doc = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                shift = np.cumsum([0, *(len(h[0]) for h in held)])
                w, u = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
                d = np.concatenate([h[4] + s for h, s in zip(held, shift, strict=False)])
                held.clear()
                n, at = len(rk), _place(pair_code(u, w), codes)
                hit = at >= 0
                sums = lambda v: np.bincount(d[hit], v, n)
                rows = [(-1 - p, blob) for p, blob in _dealt(where.buckets, rk=rk, doc=doc, rows=np.ones(n), tokens=np.bincount(d, minlength=n), known=sums(np.ones(hit.sum())), base=sums(counts[at[hit]]), lm=sums(logs[at[hit]]))]
                names, ui, wi = _coded(u, w)
                mine = np.flatnonzero(~hit)
                b = where.bucket(u[mine], w[mine]).astype(np.uint16 if where.buckets <= 1 << 16 else np.int64)
                order = np.argsort(b, kind="stable")
                b, mine = b[order].astype(np.int64), mine[order]
                ui, wi, d = ui[mine], wi[mine], d[mine]
                cuts = np.searchsorted(b, np.arange(where.buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    o = slice(cuts[k], cuts[k + 1])
                    (names_u, i), (names_w, j) = _local(names, ui[o]), _local(names, wi[o])
                    first = np.flatnonzero(np.append(True, d[o][1:] != d[o][:-1]))
                    runs, texts = np.diff(np.append(first, len(i))), rk[d[o][first]]
                    head = np.array([len(names_u), len(names_w), len(i), len(texts)], "<u8").tobytes()
                    rows.append((int(k), b"".join([head, _names(names_u), _names(names_w), texts.astype("<i8").tobytes(), runs.astype("<u4").tobytes(), _indices(i, len(names_u)), _indices(j, len(names_w))])))
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["b", "kind", "blob"])

            for batch in batches:
                rk, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for row, data, offsets in text_batches(batch):
                    t, before, d = tokens_of(data, offsets)
                    n = len(offsets) - 1
                    held.append((rk[row : row + n], doc[row : row + n], t, before, d))
                    size += len(t)
                    if size >= FLUSH:
                        yield send()
                        size = 0
            if held:
                yield send()

        return texts.select("rk", "doc", "text").mapInArrow(tidied(run), "b int, kind int, blob binary")

    def judge(key: tuple, group: pa.Table) -> pa.Table:
        b = key[0].as_py()
        if b < 0:
            return pa.table([pa.array([-1 - b] * group.num_rows, pa.int32()), group.column("blob")], ["part", "blob"])
        kinds, blobs = group.column("kind").to_pylist(), [x.as_buffer() for x in group.column("blob")]
        if 0 not in kinds:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], ["part", "blob"])
        r = _Reader(blobs[kinds.index(5)])
        nu, nw, n = r.take("<u8", 3).tolist()
        contexts, words, runs = r.names(nu), r.names(nw), r.take("<u4", nu)
        keys = (np.repeat(np.arange(nu), runs) << 32) | r.indices(n, nw)
        r.ints(0)
        log, count = np.log10(r.take("<f4", n).astype(np.float64)), r.ints(nw)
        log_count, known = np.log10(count + 1.0), (count > 0).astype(float)
        rk, sums = [], [[], [], []]
        for kind, blob in zip(kinds, blobs, strict=True):
            if kind:
                continue
            r = _Reader(blob)
            nu, nw, n, texts = r.take("<u8", 4).tolist()
            names_u, names_w = np.searchsorted(contexts, r.names(nu)), np.searchsorted(words, r.names(nw))
            rk.append(r.take("<i8", texts))
            runs = r.take("<u4", texts).astype(np.int64)
            u, w = names_u[r.indices(n, nu)], names_w[r.indices(n, nw)]
            at = np.searchsorted(keys, (u << 32) | w)
            first = np.cumsum(runs) - runs
            for x, v in zip(sums, (known[w], log_count[w], log[at]), strict=True):
                x.append(np.add.reduceat(v, first))
        rows = _dealt(where.buckets, rk=np.concatenate(rk), **{k: np.concatenate(v) for k, v in zip(("known", "base", "lm"), sums, strict=True)})
        return pa.table([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["part", "blob"])

    done, held = None, scores.select("b", "kind", "blob")
    for turn in range(PASSES):
        part = materialise(routed(docs.where(F.pmod(F.shiftright("rk", 7), F.lit(PASSES)) == turn)).unionByName(held).groupBy("b").applyInArrow(tidied_group(judge), "part int, blob binary"))
        done = part if done is None else done.unionByName(part)
    return done.groupBy("part").applyInArrow(_summed, PARTIAL)


def apply(docs: DataFrame, training) -> DataFrame:
    """One row per row of docs. training: a boolean Column, true for rows to learn from."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), training.alias("learn"))
    where, totals, scores, frequent = train(d)
    named = d.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("rk"), F.coalesce("doc_id", F.lit(NAMELESS)).alias("doc"), "text")
    s = score(named, where, scores, frequent)
    size = totals.tokens + totals.vocabulary + 1
    # equal rows were summed together: each gets its share
    s = s.select(F.when(F.col("doc") != NAMELESS, F.col("doc")).alias("doc_id"), *[(F.col(x) / F.col("rows")).alias(x) for x in ("tokens", "known", "base", "lm")], F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    return s.select(
        "doc_id", F.col("tokens").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("tokens") * F.log10(F.lit(float(size)))).alias("base_score"), F.col("lm").alias("score"), F.pow(F.lit(10.0), -F.col("lm") / F.col("tokens")).alias("perplexity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply(table(spark, sf_dir, "documents"), ~held_out(7, 2))
    return out.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


QUERIES = {"op2_pitman_yor": query}
ORACLES: dict[str, str] = {}
