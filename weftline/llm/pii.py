"""Personal data: base patterns plus a character-level bidirectional LSTM with CRF transitions, trained in numpy.

Base spans (email, ip, card, phone) are leftmost, non-overlapping matches of fixed patterns per kind that pass their
check.  The tagger adds spans the patterns miss: phone numbers without a plus, spaced addresses or ones with (at), IPv6,
cards with other separators.  It never removes a base span, and an added span overlaps none.

Tagger: one-hot characters, an LSTM in each direction, linear emissions, CRF over O and B/I of each kind.  Whole texts go
through the network, in windows of WINDOW characters that overlap by WINDOW - STRIDE.  Spans decoded in all windows of a
text are reconciled together: same-kind spans that meet are united, spans cut by an inner window edge give way, and of
clashing kinds the longer stays.  What is left must look like its kind (`_plausible`).

Training text is generated from a fixed seed with labelled spans (`examples`); `train` takes any labelled texts.

Defined results: null and empty texts have no spans (base_sha256 is that of the empty string); texts of any length are
tagged whole; spans that start together (ties) come in the order of KINDS; repeated rows are judged one by one; an empty
table gives no rows; other columns are ignored, whatever their names.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidied

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT_HOST = re.compile(r"[A-Za-z0-9] ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+ ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z]")
_TO_DIGITS = {i: None for i in map(ord, " -().+")}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by start and then kind."""
    out: list[Span] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].translate(_TO_DIGITS)
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(m[0].translate(_TO_DIGITS)) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- tagger ------------------------------------------------------------------------------------

HIDDEN, TRAINED, WINDOW, STRIDE = 12, 96, 320, 288
#: Character classes, in order: other, letters a-z (case folded), capital letter of any other script, digit, then these.
_MARKS = "@.+-_() \n:/,%[]"
_CLASS = np.zeros(128, np.int64)
for _i in range(26):
    _CLASS[97 + _i] = _CLASS[65 + _i] = 1 + _i
_CLASS[48:58] = 28
for _i, _c in enumerate(_MARKS, 29):
    _CLASS[ord(_c)] = _i
N_CHARS = 29 + len(_MARKS) + 1  # the last one pads
PAD = N_CHARS - 1
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _CLASS[np.minimum(code, 127)], 27)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        h, t = HIDDEN, len(TAGS)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = r.normal(0, 0.3, (N_CHARS, 4 * h)).astype(np.float32)
            self.p["U" + d] = r.normal(0, 0.3, (h, 4 * h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.p["b" + d] = bias
        self.p["E"], self.p["e"] = r.normal(0, 0.3, (2 * h, t)).astype(np.float32), np.zeros(t, np.float32)
        self.p["T"] = r.normal(0, 0.1, (t, t)).astype(np.float32)

    @staticmethod
    def allowed() -> np.ndarray:
        """Penalties: an I tag follows the B or I of its own kind only."""
        t = len(TAGS)
        out = np.zeros((t, t), np.float32)
        for j, name in enumerate(TAGS):
            if name[0] == "I":
                out[:, j] = -1e4
                out[j, j] = out[j - 1, j] = 0
        return out

    def _direction(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states (steps, rows, h) in reading order of direction d."""
        n, length = x.shape
        h, U, W = HIDDEN, self.p["U" + d], self.p["W" + d] + self.p["b" + d]
        hs = np.zeros((length, n, h), np.float32)
        state, cell, kept = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = W[x[:, t]]
            z += state @ U
            z[:, : 3 * h] *= 0.5
            np.tanh(z, out=z)
            z[:, : 3 * h] += 1
            z[:, : 3 * h] *= 0.5
            i, f, o, g = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            before = cell
            cell = f * cell + i * g
            tc = np.tanh(cell)
            if keep:
                kept.append((t, z, before, tc, state))
            state = o * tc
            hs[t] = state
        return hs, kept

    def emissions(self, x: np.ndarray, keep: bool = False):
        f, kf = self._direction(x, "f", keep)
        b, kb = self._direction(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["E"] + self.p["e"], both, kf, kb

    def _tables(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Weights by direction and gate, so that each gate's numbers lie together.

        They are scaled so that every gate is 1 / (1 + exp(z)): numpy's exp is several times as fast as its tanh, and
        tanh(v) is 2 / (1 + exp(-2 v)) - 1.  States come halved, so what they are multiplied with is doubled."""
        out, h = {}, HIDDEN
        scale = np.array([-1, -1, -1, -2], np.float32)[:, None, None]
        for d in "fb":
            split = lambda v: np.ascontiguousarray(v.reshape(-1, 4, h).transpose(1, 0, 2)) * scale
            out[d] = split(self.p["W" + d] + self.p["b" + d]), 2 * split(self.p["U" + d])
        return out

    def quick_emissions(self, x: np.ndarray) -> np.ndarray:
        """The same emissions, as (steps, tags, rows), without what training needs."""
        (n, length), h, t_some = x.shape, HIDDEN, 16
        steps = np.ascontiguousarray(x.T)
        out = np.empty((length, len(TAGS), n), np.float32)
        out[:] = self.p["e"][:, None]
        z, g, one = np.empty((4, n, h), np.float32), np.empty((4, n, h), np.float32), np.empty((n, h), np.float32)
        states = np.empty((t_some, n, h), np.float32)
        with np.errstate(over="ignore"):  # 1 / inf is the gate's limit
            for d, (W, U) in self._tables().items():
                E = 2 * (self.p["E"][:h] if d == "f" else self.p["E"][h:])
                state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)  # halves of both
                for begin in range(0, length, t_some):
                    some = range(begin, min(begin + t_some, length))
                    for k, t in enumerate(some if d == "f" else [length - 1 - t for t in some]):
                        np.matmul(state, U, out=z)
                        np.take(W, steps[t], axis=1, out=g, mode="clip")
                        z += g
                        np.exp(z, out=z)
                        z += 1
                        np.divide(1, z, out=z)
                        z[3] -= 0.5
                        cell *= z[1]
                        np.multiply(z[0], z[3], out=one)
                        cell += one
                        np.multiply(cell, -4, out=one)
                        np.clip(one, -40, 40, out=one)  # the gate is at its limit there; exp is slow on its own limits
                        np.exp(one, out=one)
                        one += 1
                        np.divide(1, one, out=one)
                        one -= 0.5
                        state = states[k]
                        np.multiply(z[2], one, out=state)
                    added = (states[: len(some)].reshape(-1, h) @ E).reshape(len(some), n, len(TAGS)).transpose(0, 2, 1)
                    if d == "f":
                        out[some.start : some.stop] += added
                    else:
                        out[length - some.stop : length - some.start] += added[::-1]
        return out

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y and its gradients."""
        n, length = x.shape
        em, both, kf, kb = self.emissions(x, True)
        em = em.astype(np.float64)
        T = (self.p["T"] + self.allowed()).astype(np.float64)
        alpha, beta = np.empty_like(em), np.zeros_like(em)

        def lse(v: np.ndarray, axis: int) -> np.ndarray:
            m = v.max(axis=axis, keepdims=True)
            return np.log(np.exp(v - m).sum(axis=axis)) + m.squeeze(axis)

        alpha[0] = em[0]
        for t in range(1, length):
            alpha[t] = em[t] + lse(alpha[t - 1][:, :, None] + T, 1)
        for t in range(length - 2, -1, -1):
            beta[t] = lse(T[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(n)
        gold = np.zeros(n)
        dT = np.zeros_like(T)
        for t in range(length):
            gold += em[t, rows, y[:, t]]
            de[t, rows, y[:, t]] -= 1
            if t:
                gold += T[y[:, t - 1], y[:, t]]
                pair = alpha[t - 1][:, :, None] + T + (em[t] + beta[t])[:, None, :] - z[:, None, None]
                dT += np.exp(pair).sum(axis=0)
                np.subtract.at(dT, (y[:, t - 1], y[:, t]), 1)
        de /= n
        de = de.astype(np.float32)
        g = {"T": (dT / n).astype(np.float32), "E": np.tensordot(both, de, ([0, 1], [0, 1])), "e": de.sum(axis=(0, 1))}
        dh = de @ self.p["E"].T
        h = HIDDEN
        for d, kept, part in (("f", kf, dh[:, :, :h]), ("b", kb, dh[:, :, h:])):
            U = self.p["U" + d]
            gW, gU, gb = np.zeros_like(self.p["W" + d]), np.zeros_like(U), np.zeros(4 * h, np.float32)
            ds, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, gates, before, tc, prev in reversed(kept):
                i, f, o, c = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h : 3 * h], gates[:, 3 * h :]
                ds = ds + part[t]
                dcell = dc + ds * o * (1 - tc**2)
                dz = np.concatenate([dcell * c * i * (1 - i), dcell * before * f * (1 - f), ds * tc * o * (1 - o), dcell * i * (1 - c**2)], axis=1)
                np.add.at(gW, x[:, t], dz)
                gU += prev.T @ dz
                gb += dz.sum(axis=0)
                ds, dc = dz @ U.T, dcell * f
            g |= {"W" + d: gW, "U" + d: gU, "b" + d: gb}
        return float((z - gold).mean()), g

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (rows, steps); padding is O.

        Scores are relative to O throughout, so only rows with a best score above 0 hold a span and are traced back."""
        n, length = x.shape
        scores = self.quick_emissions(x)
        T = self.p["T"] + self.allowed()
        T = T - T[0, 0]
        starts = [0, *range(1, len(TAGS), 2)]  # O and the B tags follow any tag, I tags their own B or I
        into = np.ascontiguousarray(T[:, starts])[:, :, None]
        from_b, from_i = (np.array([T[j - k, j] for j in range(2, len(TAGS), 2)])[:, None] for k in (1, 0))
        scores -= scores[:, :1].copy()
        scores[:, 1:] -= (np.ascontiguousarray(x.T == PAD) * np.float32(1e4))[:, None]
        scores[0, 2::2] -= 1e4  # no I first
        paths, best = np.empty((len(TAGS), len(starts), n), np.float32), np.empty((len(starts), n), np.float32)
        for before, now in zip(scores, scores[1:], strict=False):
            np.add(before[:, None], into, out=paths)
            np.max(paths, axis=0, out=best)
            now[0] += best[0]
            now[1::2] += best[1:]
            now[2::2] += np.maximum(before[1::2] + from_b, before[2::2] + from_i)
        tags = np.zeros((n, length), np.int8)
        hard = np.flatnonzero(scores[-1].max(axis=0) > 1e-3)
        best = scores[-1][:, hard].argmax(axis=0)
        for t in range(length - 1, -1, -1):
            tags[hard, t] = best
            if t:
                best = (scores[t - 1][:, hard] + T[:, best]).argmax(axis=0)
        return tags


def examples(n: int = 1500, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Generated texts with labelled spans: every kind in base and in further forms, among words and other numbers."""
    r = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    syllables = ("the", "and", "er", "on", "ti", "sch", "ou", "re", "ca", "lo", "mi", "é", "un", "st", "pa", "ble", "ly", "zu", "ñ", "in")
    word = lambda: "".join(pick(syllables) for _ in range(r.integers(1, 5)))

    def email() -> str:
        tail = pick((lambda: digits(r.integers(1, 3)), word, word, lambda: ""))()
        user, end = word() + (pick((".", ".", "_", "-", "+", "")) + tail if tail else ""), pick(("com", "org", "net", "example.com", "de", "io"))
        host = word() + pick((lambda: "", lambda: "", lambda: digits(1), lambda: "-" + word(), lambda: "." + word(), lambda: f".{word()}.{word()}"))()
        if r.random() < 0.2:
            at, dot = pick(((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", ".")))
            return f"{user}{at}{host}{dot}{end.rpartition('.')[2]}".replace("é", "e").replace("ñ", "n")
        return f"{user}{pick(('@', '@', '@', ' @ ', '@ ', ' @'))}{host}.{end}".replace("é", "e").replace("ñ", "n")

    def ip() -> str:
        if r.random() < 0.3:
            return ":".join(f"{int(x):x}" for x in r.integers(4096, 65536, 8))
        return ".".join(str(x) for x in r.integers(0, 256, 4))

    def card() -> str:
        sep = pick(("", " ", "-", ".", "/"))
        body = digits(15)
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        form = r.integers(6)
        if form < 2:
            return f"+{r.integers(1, 99)}{pick((' ', '-', ' (', '.'))}{digits(3)}{pick((' ', '-', ') ', '.'))}{digits(3)}{pick((' ', '-'))}{digits(4)}"
        if form == 2:
            return f"({digits(3)}) {digits(3)}-{digits(4)}"
        if form == 3:
            return f"{digits(3)}-{digits(3)}-{digits(4)}"
        if form == 4:
            return f"00{r.integers(10, 99)} {digits(3)} {digits(7)}"
        return f"{digits(3)}.{digits(3)}.{digits(4)}"

    def other() -> str:
        return pick((
            lambda: digits(r.integers(1, 6)), lambda: f"{r.integers(1900, 2100)}-{r.integers(10, 13)}-{r.integers(10, 29)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(1)}.{digits(2)}",
            lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(2)}%", lambda: f"{digits(3)},{digits(3)}", lambda: f"{r.integers(1, 30)}/{r.integers(1, 13)}/{r.integers(1900, 2100)}", lambda: f"{digits(2)}-{digits(2)}",
            lambda: f"id{digits(8)}", lambda: digits(r.integers(8, 13)), lambda: f"{digits(3)}-{digits(3)}", lambda: f"{word()}{digits(3)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"{word()} @ {word()}", lambda: f"({word()})", lambda: f"[{word()} {word()}]",
        ))()

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = "", []
        if r.random() < 0.4:  # plain prose, with capitals and marks, none of it personal
            while len(text) < 2 * TRAINED:
                w = word() + (word() if r.random() < 0.3 else "")
                w = w.capitalize() if r.random() < 0.2 else w
                text += w + pick(("", "", "", "", "", "", "***", "%%%", "&&&", "$$$", "###", ")", "]", "...")) + pick((" ", " ", " ", " ", " ", ", ", ". ", ".\n", "; ", " (", " [", " - ", ": ", "/"))
            out.append((text, spans))
            continue
        while len(text) < 2 * TRAINED:
            roll = r.random()
            if roll < 0.12:
                kind = pick(KINDS)
                s = makers[kind]()
                spans.append((len(text), len(text) + len(s), kind))
                text += s
            elif roll < 0.24:
                text += other()
            else:
                text += word()
            text += pick((" ", " ", " ", " ", ", ", ". ", "\n", "; ", ": "))
        out.append((text, spans))
    return out


def train(labelled: list[tuple[str, list[Span]]], steps: int = 800, batch: int = 32, seed: int = 3, rate: float = 0.015) -> Tagger:
    """Adam on windows of labelled texts."""
    xs, ys = [], []
    for text, spans in labelled:
        x, y = classes(text), np.zeros(len(text), np.int64)
        for s, e, kind in spans:
            y[s:e] = TAGS.index("I-" + kind)
            y[s] = TAGS.index("B-" + kind)
        for at in range(0, max(1, len(x) - TRAINED // 2), TRAINED):
            px, py = np.full(TRAINED, PAD), np.zeros(TRAINED, np.int64)
            px[: len(x[at : at + TRAINED])], py[: len(x[at : at + TRAINED])] = x[at : at + TRAINED], y[at : at + TRAINED]
            if TAGS[py[0]][0] == "I":
                py[0] -= 1  # a window may begin inside a span
            xs.append(px)
            ys.append(py)
    x, y = np.array(xs), np.array(ys)
    model, r = Tagger(), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        at = r.integers(0, len(x), batch)
        _, g = model.loss(x[at], y[at])
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.999 * m2[k] + 0.001 * v * v
            model.p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


_trained: list[Tagger] = []


def default_model() -> Tagger:
    if not _trained:
        _trained.append(train(examples()))
    return _trained[0]


def _plausible(text: str, kind: str) -> bool:
    n = sum("0" <= c <= "9" for c in text)
    if "\n" in text or not 6 <= len(text) <= 100:
        return False
    if kind == "email":
        return bool(_AT_HOST.search(text))
    if kind == "ip":
        return text.count(".") == 3 or text.count(":") >= 4
    if kind == "card":
        return 14 <= n <= 19 and luhn("".join(c for c in text if "0" <= c <= "9"))
    return 9 <= n <= 15


def _windows(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(start, classes) of the windows over a whole text."""
    out, at = [], 0
    while True:
        part = x[at : at + WINDOW]
        out.append((at, np.concatenate([part, np.full(WINDOW - len(part), PAD)])))
        if at + WINDOW >= len(x):
            return out
        at += STRIDE


def reconcile(found: list[tuple[int, int, str, bool]]) -> list[Span]:
    """Spans of one text from all its windows (start, end, kind, cut by an inner edge) to spans that don't overlap."""
    joined: list[list] = []
    for s, e, kind, cut in sorted(found):
        last = next((j for j in reversed(joined) if j[2] == kind), None)
        if last and s < last[1]:
            last[1], last[3] = max(last[1], e), last[3] and cut
        else:
            joined.append([s, e, kind, cut])
    out: list[Span] = []
    for s, e, kind, _ in sorted(joined, key=lambda j: (j[3], j[0] - j[1], j[0])):
        at = bisect.bisect(out, (s, e, kind))
        if (not at or out[at - 1][1] <= s) and (at == len(out) or out[at][0] >= e):
            out.insert(at, (s, e, kind))
    return out


def tag(model: Tagger, texts: list[str], rows: int = 1024) -> list[list[Span]]:
    """Spans the tagger finds in each text; windows of all texts go through the network together."""
    found: list[list[tuple[int, int, str, bool]]] = [[] for _ in texts]
    todo: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        if not todo:
            return
        tags = model.decode(np.array([w[2] for w in todo]))
        starts_r, starts_c = np.nonzero((tags % 2 == 1))
        for r, c in zip(starts_r.tolist(), starts_c.tolist(), strict=True):
            k, at, e = int(tags[r, c]), todo[r][1], c + 1
            while e < WINDOW and tags[r, e] == k + 1:
                e += 1
            length = len(texts[todo[r][0]])
            cut = (c == 0 and at > 0) or (e == WINDOW and at + WINDOW < length)
            found[todo[r][0]].append((at + c, min(at + e, length), TAGS[k][2:], cut))
        todo.clear()

    for i, text in enumerate(texts):
        if text:
            for w in _windows(classes(text)):
                todo.append((i, *w))
                if len(todo) >= rows:
                    flush()
    flush()
    out = []
    for text, f in zip(texts, found, strict=True):
        spans = []
        for s, e, kind in reconcile(f):
            while s < e and text[s] in " \n.,;:-/":
                s += 1
            while e > s and text[e - 1] in " \n.,;:-/(":
                e -= 1
            # neither part of a longer run of letters or digits
            if s < e and _plausible(text[s:e], kind) and not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum()):
                spans.append((s, e, kind))
        out.append(spans)
    return out


def all_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, base and added spans) of each text."""
    out = []
    for text, more in zip(texts, tag(model, texts), strict=True):
        base = base_spans(text) if text else []
        both = base + [x for x in more if all(x[1] <= s or x[0] >= e for s, e, _ in base)]
        out.append((base, sorted(both, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def apply(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id and spans (base and added) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                texts = [x or "" for x in b.column(1).slice(at, 256).to_pylist()]
                rows = [[{"kind": k, "start": s, "end": e, "base": (s, e, k) in base} for s, e, k in spans] for base, spans in all_spans(shared.value, texts)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {dict(docs.dtypes)['doc_id']}, spans {SPANS}")


def redact(docs: DataFrame, model: Tagger | None = None, columns: list[str] | None = None) -> DataFrame:
    """docs with every span replaced by [KIND]; the other columns pass through."""
    columns = columns or docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())
    at_text = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 256):
                texts = b.column(at_text).slice(at, 256).to_pylist()
                for text, (_, spans) in zip(texts, all_spans(shared.value, [x or "" for x in texts]), strict=True):
                    if spans:
                        parts, done = [], 0
                        for s, e, kind in spans:
                            if s >= done:
                                parts += [text[done:s], f"[{kind.upper()}]"]
                            done = max(done, e)
                        text = "".join([*parts, text[done:]])
                    out.append(text)
            cols = [pa.array(out, pa.string()) if k == at_text else b.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(cols, columns)

    return docs.select(*columns).mapInArrow(tidied(run), docs.select(*columns).schema)


def digest(found: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    base = F.filter("spans", lambda s: s.base)
    join = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(join(base).cast("binary"), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(apply(table(spark, sf_dir, "documents")))


QUERIES = {"op5_pii": query}
ORACLES: dict[str, str] = {}
