"""SentencePiece encoding and decoding on the `tokenizers` library.

The model file is a protobuf; it is parsed here field by field.  From it come the pieces with their scores, the kind of
model (unigram, or BPE whose merges follow from the scores), byte fallback, the normaliser (compiled character map,
extra white space, dummy prefix) and the metaspace marker.  Texts are encoded in multithreaded batches of bounded size.
Where no piece has a marker after another character, a text may be cut before any run of markers without changing its
ids: each distinct chunk is then encoded once.

Parity: `apply` encodes the same chunks (or texts) with the sentencepiece library and reports where the ids agree.

Defined results: null and empty texts have no ids and round-trip; repeated rows are encoded one by one; other columns
are ignored; a text whose decoding differs from it (the normaliser folded something) has round_trip false.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidied

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Characters to a batch, unless one text is longer.
BATCH_CHARS = 1 << 19


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, wire, varint()
        elif wire == 2:
            n = varint()
            yield key >> 3, wire, data[at : at + n]
            at += n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield key >> 3, wire, struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n
        else:
            raise ValueError(f"wire type {wire} in a model file")


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, raw: bytes) -> None:
        self.raw = raw
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, _, value in _fields(raw):
            if number == 1:
                p = {k: v for k, _, v in _fields(value)}
                self.pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number == 2:
                trainer = {k: v for k, _, v in _fields(value)}
            elif number == 3:
                normaliser = {k: v for k, _, v in _fields(value)}
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        #: A text may be cut before a run of markers.
        self.separable = self.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))

        # Runs of markers whose pieces share the lowest score are joined from the left, whatever the merges' order.
        runs = {len(p): (i, s) for i, (p, s, _) in enumerate(self.pieces) if p and not p.strip(MARK)}
        level = {s for n, (_, s) in runs.items() if n > 1}
        self.runs = {n: i for n, (i, _) in runs.items()} if self.kind == BPE and len(level) == 1 and min(level) <= min(s for _, s, k in self.pieces if k == NORMAL) else {}
        self.plain_run = 1
        while self.plain_run + 1 in self.runs:
            self.plain_run += 1

    def run_ids(self, n: int) -> list[int]:
        """Ids of n markers alone: always join the leftmost pair that makes a piece."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and done[-2] + done[-1] in self.runs:
                done[-2:] = [done[-2] + done[-1]]
        return [self.runs[x] for x in done]

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join to a piece, best score first; ties in the order of the left part's id."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind not in (CONTROL, UNKNOWN, BYTE)}
        out = []
        for p, i in ids.items():
            score = self.pieces[i][1]
            out += [(-score, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        out.sort()
        return [(a, b) for *_, a, b in out]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        if self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            core = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        t = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        t.normalizer = normalizers.Sequence(steps)
        if self.separable:
            t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return t


class Codec:
    """Encoder and decoder built from a model file's bytes.

    Where the model is separable, a text is cut before every run of markers and each distinct chunk is encoded, decoded
    and checked once in a worker's bounded cache; the ids of a text are the concatenation.  Otherwise whole texts go to
    the backend.
    """

    CACHE = 120_000

    def __init__(self, raw: bytes, parity: bool = True) -> None:
        self.model = Model(raw)
        self.backend = self.model.tokenizer()
        self.other = None
        if parity:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.by_chunk = self.model.separable and self.model.dummy_prefix and not self.model.squeeze
        if self.by_chunk:
            from tokenizers import normalizers, pre_tokenizers

            self.plain = self.model.tokenizer()
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([])
            self.joined = self.model.tokenizer()
            self.joined.normalizer = normalizers.Sequence([])
            self.octets = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in self.model.pieces], np.int64)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*")
        self._forget()

    def _forget(self) -> None:
        """Empty the cache: chunk -> row of bounds into ids, whether it came back and whether both libraries agree, and how
        often it was used."""
        self.rows: dict[str, int] = {}
        self.bounds, self.ids = [np.zeros(1, np.int64)], [np.empty(0, np.int32)]
        self.back, self.same, self.used = [np.empty(0, bool)], [np.empty(0, bool)], np.empty(0, np.int64)

    def _forget_rare(self) -> None:
        """Keep the chunks that were used again, unless they alone fill half of the cache."""
        keep = self.used > 1
        if keep.sum() > self.CACHE // 2:
            return self._forget()
        bounds, ids, back, same = (np.concatenate(x) for x in (self.bounds, self.ids, self.back, self.same))
        size = np.diff(bounds)
        self.rows = dict(zip(compress(self.rows, keep.tolist()), range(int(keep.sum()))))  # rows are in the order of their numbers
        self.bounds, self.ids = [np.concatenate([[0], np.cumsum(size[keep])])], [ids[np.repeat(keep, size)]]
        self.back, self.same, self.used = [back[keep]], [same[keep]], np.zeros(int(keep.sum()), np.int64)

    def _keep(self, chunks: list[str], ids: np.ndarray, size: np.ndarray, back: np.ndarray, same: np.ndarray) -> None:
        """Add chunks with all their ids one after another and the number of each one's."""
        at = len(self.rows)
        self.rows.update(zip(chunks, range(at, at + len(chunks)), strict=True))
        self.ids.append(ids.astype(np.int32))
        self.bounds.append(np.cumsum(size) + self.bounds[-1][-1])
        self.back.append(back)
        self.same.append(same)

    def _agree(self, texts: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where the sentencepiece library gives each text the same ids."""
        other = self.other.encode(texts, num_threads=1)
        if sum(map(len, other)) == len(ids) and np.array_equal(np.fromiter(map(len, other), np.int64, len(other)), size) and np.array_equal(np.fromiter(chain.from_iterable(other), np.int64, len(ids)), ids):
            return np.ones(len(texts), bool)
        return np.array([i.tolist() == o for i, o in zip(np.split(ids, np.cumsum(size)[:-1]), other, strict=True)], bool)

    def normal(self, text: str) -> str:
        """The normalised text, markers included; equal to the text with marked spaces if there is no character map."""
        return self.backend.normalizer.normalize_str(text) if self.model.charsmap else MARK + text.replace(" ", MARK)

    #: Chunks to a string when new ones are encoded together.
    TOGETHER = 2_000

    def _learn(self, chunks: list[str]) -> None:
        """Encode, decode and check new chunks.  Most go to the backend in long strings, which it cuts at the same places;
        runs of markers, and strings that don't come back whole, go one by one."""
        run = MARK * (self.model.plain_run + 1) if self.model.runs else None
        alone = [c for c in chunks if c[-1] == MARK or (run and c.startswith(run))]
        apart = set(alone)
        plain = [c for c in chunks if c not in apart] if apart else chunks
        groups = [plain[k : k + self.TOGETHER] for k in range(0, len(plain), self.TOGETHER)]
        strings = ["".join(g) for g in groups]
        ids = [e.ids for e in self.joined.encode_batch_fast(strings, add_special_tokens=False)]
        back = self.joined.decode_batch(ids, skip_special_tokens=False)
        for g, text, i, x in zip(groups, strings, ids, back, strict=True):
            flat = np.array(i, np.int64)
            ends = np.cumsum(pc.binary_length(pa.array(g, pa.string())).to_numpy(), dtype=np.int64)
            cuts = np.searchsorted(np.cumsum(self.octets[flat]), ends, "left") + 1
            if x != text[1:].replace(MARK, " ") or cuts[-1] != len(i) or (flat == self.model.unk).any():
                alone += g
                continue
            size, good = np.diff(cuts, prepend=0), np.ones(len(g), bool)
            self._keep(g, flat, size, good, self._agree([c[1:] if c[1] != MARK else c[1:].replace(MARK, " ") for c in g], flat, size) if self.other is not None and not self.model.charsmap else good)
        if alone:
            self._learn_alone(alone)

    def _learn_alone(self, chunks: list[str]) -> None:
        long = self.model.plain_run
        cut = {k: n - 1 for k, c in enumerate(chunks) if self.model.runs and c.startswith(MARK * (long + 1)) and (n := len(c) - len(c.lstrip(MARK)))}
        ids = [e.ids for e in self.plain.encode_batch_fast([c[cut[k] :] if k in cut else c for k, c in enumerate(chunks)], add_special_tokens=False)]
        for k, n in cut.items():  # n markers before the last one, which may join what follows
            ids[k] = self.model.run_ids(n + 1) + ids[k][1:] if ids[k][0] == self.model.runs[1] else self.model.run_ids(n) + ids[k]
        # a chunk's own decoding loses the dummy prefix, which is its first marker
        back = self.backend.decode_batch(ids, skip_special_tokens=False)
        same = self.other.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1) if self.other and not self.model.charsmap else ids
        if self.other and MARK in chunks:  # one marker has no text of its own: a space at the end of a text
            same[chunks.index(MARK)] = [self.other.piece_to_id(MARK)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(size.sum()))
        self._keep(chunks, flat, size, np.array([x == c[1:].replace(MARK, " ") for c, x in zip(chunks, back, strict=True)], bool), np.array([i == o for i, o in zip(ids, same, strict=True)], bool))

    def apply(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool], list[bool]]:
        """Ids of all texts one after another, their number by text, whether the text came back, whether both libraries agree."""
        if not self.by_chunk:
            ids = [self.backend.encode(x, add_special_tokens=False).ids if x else [] for x in texts]
            back = self.backend.decode_batch(ids, skip_special_tokens=False)
            agree = [not self.other or i == self.other.encode(x) for i, x in zip(ids, texts, strict=True)]
            return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64), [x == y for x, y in zip(texts, back, strict=True)], agree
        if len(self.rows) > self.CACHE:
            self._forget_rare()
        norm = [self.normal(x) if x else "" for x in texts]
        parts = [self.cut.findall(x) for x in norm]
        cuts = np.cumsum([0, *map(len, parts)])
        chunks = list(chain.from_iterable(parts))
        row = np.fromiter(map(self.rows.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(row < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(chunks[k] for k in missing)))
            row[missing] = [self.rows[chunks[k]] for k in missing]
        self.bounds, self.ids, self.back, self.same = ([np.concatenate(x)] for x in (self.bounds, self.ids, self.back, self.same))
        bounds, back, same = self.bounds[0], self.back[0], self.same[0]
        self.used = np.bincount(row, minlength=len(self.rows)) + np.pad(self.used, (0, len(self.rows) - len(self.used)))
        begin, n = bounds[:-1][row], np.diff(bounds)[row]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[0][np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)]
        all_of = lambda good: np.diff(np.concatenate([[0], np.cumsum(~good[row])])[cuts]) == 0
        whole = all_of(back).tolist()
        if self.model.charsmap:  # the chunks came back, but did normalising change the text?
            whole = [w and z[1:].replace(MARK, " ") == x for w, x, z in zip(whole, texts, norm, strict=True)]
        else:
            whole = [w and MARK not in x for w, x in zip(whole, texts, strict=True)]
        return ids, np.diff(ends[cuts]), whole, all_of(same).tolist()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, n, _, _ = self.apply([x or "" for x in texts])
        return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(texts) else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.backend.decode_batch(ids, skip_special_tokens=False)


_codecs: dict[tuple[bytes, bool], Codec] = {}


def codec(raw: bytes, parity: bool = True) -> Codec:
    """One codec a worker for each model."""
    key = (hashlib.sha256(raw).digest(), parity)
    if key not in _codecs:
        _codecs[key] = Codec(raw, parity)
    return _codecs[key]


def apply(docs: DataFrame, model: bytes, parity: bool = True) -> DataFrame:
    """doc_id, ids, round_trip and, if asked for, parity with the sentencepiece library, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, parity)
        for b in batches:
            start = 0
            texts = b.column(1)
            ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
            while start < b.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + BATCH_CHARS, "right")))
                ids, n, back, agree = c.apply([x or "" for x in texts.slice(start, stop - start).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), lists, pa.array(back, pa.bool_()), pa.array(agree, pa.bool_())], ["doc_id", "ids", "round_trip", "parity"])
                start = stop
        c._forget()  # the worker lives on

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, round_trip boolean, parity boolean")


def digest(encoded: DataFrame) -> DataFrame:
    """Digest columns instead of the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            hashes = [hashlib.sha256(flat[s:e].astype("<i4").tobytes()).hexdigest() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(hashes), b.column(2), b.column(3)], ["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity"])

    return encoded.mapInArrow(tidied(run), f"doc_id {dict(encoded.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean")


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(apply(table(spark, sf_dir, "documents"), default_model()))


QUERIES = {"op8_sentencepiece": query}
ORACLES: dict[str, str] = {}
