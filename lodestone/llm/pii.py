"""Personal data in texts: base patterns, and a character-level BiLSTM with CRF transitions that adds spans.

The network is trained in numpy from labelled spans of generated lines (seeded; see ``labelled_lines``). Each kind of
personal data holds a digit or an @, and a span without one is never admitted, so the network reads overlapping
windows around those characters, wherever they are in a text. Each window is decoded by Viterbi; spans that windows
agree on are reconciled over the whole text by weighted interval scheduling. Base spans always stay, and a span of
the network that cuts into one is dropped, as are those of low posterior or an impossible form; one that holds a base span
and more, such as a telephone number of which four pairs look like an address, is added.

Defined cases: a null text counts as empty and has no spans; a null doc_id is kept; repeated rows are scanned again;
an empty table gives no rows; other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import io
import random
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import tidy
from lodestone.session import ensure_importable, file_system, shared_dir

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_TRIGGER = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind's pattern that pass its test. The email pattern is sought from each @: its local
    part is the run of local characters before, as far back as the last match's end."""
    out: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and _LOCAL_TAIL.match(text, start - 1):
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    if not re.search(r"[0-9]", text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# --- the network -----------------------------------------------------------------------------------------------

HIDDEN, EMBED, WINDOW, STRIDE, AROUND = 16, 12, 96, 48, 32
LEAST = 0.6  # posterior of a span that is added; the README has precision and recall by it
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
_PUNCTUATION = "@.-+()_%[]{}<>:;,/'\"#=*&$!?|~^\\`"
_SYMBOLS = 7 + len(_PUNCTUATION)
_CLASSES = np.full(0x250, 1, np.int64)
for _i in range(0x250):
    _c = chr(_i)
    _CLASSES[_i] = 2 if _c in "0123456789" else 3 if _c.isspace() else 4 if _c.islower() else 5 if _c.isupper() else 7 + _PUNCTUATION.index(_c) if _c in _PUNCTUATION else 1


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x250, _CLASSES[np.minimum(codes, 0x24F)], 6)


def labelled_lines(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Lines of invented words with labelled spans of personal data, and with numbers and codes that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("the", "an", "er", "ou", "ch", "re", "st", "ti", "le", "ue", "ei", "é", "ng", "o")) for _ in range(r.randint(1, 4)))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    small = lambda: str(r.randint(0, 255))

    def personal(kind: int) -> str:
        if kind == 0:
            local = word() + r.choice(("", ".", "_", "+", "-", "'")) + r.choice((word(), d(2), d(1)))
            local = word()[:1] + "." + local if r.random() < 0.2 else local
            return local + "@" + r.choice((word(), "mail" + d(1))) + r.choice((".", "-")) + word() + "." + r.choice(("com", "org", "net", "co.uk", "example"))
        if kind == 1:
            return ".".join(small() for _ in range(4))
        if kind == 2:
            x = d(16)
            if r.random() < 0.15:
                return r.choice((" ", "-", "")).join((x[:4], x[4:10], x[10:15]))
            gap = r.choice(("", "", "", " ", "-", "."))
            return gap.join((x[:4], x[4:8], x[8:12], x[12:]))
        roll = r.random()
        if roll < 0.3:
            return r.choice(("+1 ({}) {}-{}", "({}) {}-{}", "+{} {} {}", "{}-{}-{}", "+44 {} {}{}", "1 ({}) {}-{}", "1-{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(d(3), d(3), d(4))
        if roll < 0.38:
            return r.choice(("{}-{}", "{} {}")).format(d(3), d(4))
        if roll < 0.5:
            gap = r.choice((" ", " ", ".", "-"))
            return gap.join(["0" + d(1), *(d(2) for _ in range(4))])
        if roll < 0.64:
            area, rest = "0" + d(r.randint(2, 4)), d(r.randint(4, 8))
            tail = r.choice(("", "", "-" + d(r.randint(1, 3)), " - " + d(r.randint(1, 2))))
            return area + r.choice(("/", "/", " / ", "-", " ")) + r.choice((rest, rest, rest[:3] + " " + rest[3:] if len(rest) > 4 else rest)) + tail
        if roll < 0.7:
            return r.choice(("+{} (0){} {}", "00{} {} {}", "(0){} {}")).format(*(d(r.randint(2, 3)), d(r.randint(2, 3)), d(r.randint(5, 7))))
        gap, area = r.choice((" ", " ", "-", ".")), r.choice(("0", "0", "")) + d(r.randint(2, 4))
        rest = [d(r.randint(2, 4)) for _ in range(r.choice((2, 2, 3)))]
        rest[-1] = rest[-1].ljust(3, "7")
        return (f"({area}) " if r.random() < 0.25 else area + gap) + gap.join(rest)

    def bare() -> str:
        return r.choice((d(10), d(10), "0" + d(9), "0" + d(10), "0" + d(r.randint(7, 8)), d(7)))

    def other() -> str:
        return r.choice((lambda: d(r.randint(1, 6)), lambda: f"{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: 'token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: str(r.randint(1900, 2030)), lambda: f"{d(2)}:{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: "$" + d(3) + "." + d(2), lambda: "@" + word(), lambda: d(r.randint(22, 40)),
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", lambda: f"{d(r.randint(1, 2))}-{d(r.randint(1, 2))}", lambda: f"{d(2)}.{d(2)}.{r.randint(1900, 2030)}", lambda: f"{d(1)},{d(3)}.{d(2)}", lambda: f"{d(2)}:{d(2)}-{d(2)}:{d(2)}",
            lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: r.choice("ABX") + d(r.randint(2, 5)) + "-" + d(r.randint(2, 4)),
            lambda: r.choice(("order ", "no. ", "ref ", "id ", "account ", "Rechnung ", "facture ", "code ", "build ", "zip ", "")) + d(r.randint(4, 10)), lambda: f"{r.randint(2000, 2030)}-{d(5)}", lambda: f"{d(5)}-{d(4)}", lambda: f"{r.randint(2000, 2030)}/{d(3)}", lambda: f"{d(2)}.{d(2)}.{d(2)}", lambda: f"{d(1)}-{d(1)}", lambda: f"{d(2)}/{d(1)}"))()

    #: What stands before bare digits that are a phone number; others are none.
    before = ("call ", "ring ", "phone ", "Phone: ", "tel ", "Tel. ", "tel:", "Telefon ", "mobile ", "cell ", "Handy: ", "fax ", "text ", "dial ", "appelez le ", "Tél. ", "whatsapp ", "my number ", "reach me at ", "joindre au ", "hotline ")

    lines = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        for _ in range(r.randint(6, 14)):
            roll = r.random()
            kind = r.randrange(4) if roll < 0.18 else -1
            if kind == 3 and r.random() < 0.5:
                parts.append(r.choice(before))
                at += len(parts[-1])
                x = bare() if r.random() < 0.35 else personal(3)
            else:
                x = personal(kind) if kind >= 0 else other() if roll < 0.34 else word()
            x = x.upper() if r.random() < 0.08 else x.capitalize() if kind < 0 and r.random() < 0.15 else x
            if kind >= 0:
                spans.append((kind, at, at + len(x)))
            x += r.choice(("", "", "", "", ",", ".", "!!", "###")) + r.choice((" ", " ", " ", "\n", " | "))
            parts.append(x)
            at += len(x)
        lines.append(("".join(parts), spans))
    return lines


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool):
    """x: time, batch, features. The hidden states; with ``keep`` also what the way back needs."""
    steps, n, _ = x.shape
    h, c, hs, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), []
    ahead, u = x @ w[: x.shape[2]] + b, w[x.shape[2] :]
    for t in range(steps):
        z = ahead[t] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before, before_c = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        if keep:
            kept.append((before, before_c, i, f, o, g, tc))
    return hs, kept


def _lstm_back(x, w, kept, dhs):
    steps, n, width = x.shape
    dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), np.empty_like(x)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        before, before_c, i, f, o, g, tc = kept[t]
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw[:width] += x[t].T @ dz
        dw[width:] += before.T @ dz
        db += dz.sum(axis=0)
        dx[t] = dz @ w[:width].T
        dh, dc = dz @ w[width:].T, dc * f
    return dw, db, dx


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """``p``: the arrays of the network. Small enough to go to executors with the function that uses it."""

    def __init__(self, seed: int = 4):
        g = np.random.default_rng(seed)
        init = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": init(_SYMBOLS, EMBED), "wf": init(EMBED + HIDDEN, 4 * HIDDEN), "bf": np.zeros(4 * HIDDEN, np.float32), "wb": init(EMBED + HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN, np.float32), "u": init(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        self.p["bf"][HIDDEN : 2 * HIDDEN] = self.p["bb"][HIDDEN : 2 * HIDDEN] = 1

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["e"][ids.T]  # time first
        forward, kf = _lstm(x, self.p["wf"], self.p["bf"], keep)
        backward, kb = _lstm(x[::-1], self.p["wb"], self.p["bb"], keep)
        h = np.concatenate([forward, backward[::-1]], axis=2)
        return h @ self.p["u"] + self.p["c"], (x, h, kf, kb)

    def _sums(self, e: np.ndarray):
        t, steps = self.p["t"], len(e)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for i in range(1, steps):
            alpha[i] = e[i] + _lse(alpha[i - 1][:, :, None] + t, 1)
        for i in range(steps - 2, -1, -1):
            beta[i] = _lse(t + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        return alpha, beta, _lse(alpha[-1], 1)

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        e, (x, h, kf, kb) = self.emissions(ids, True)
        alpha, beta, z = self._sums(e)
        steps, n, _ = e.shape
        y, rows = tags.T, np.arange(n)
        t = self.p["t"]
        gold = sum(e[i, rows, y[i]] for i in range(steps)) + sum(t[y[i], y[i + 1]] for i in range(steps - 1))
        de = np.exp(alpha + beta - z[None, :, None])
        dt = np.zeros_like(t)
        for i in range(steps):
            de[i, rows, y[i]] -= 1
            if i:
                dt += np.exp(alpha[i - 1][:, :, None] + t + (e[i] + beta[i])[:, None, :] - z[:, None, None]).sum(axis=0)
                np.subtract.at(dt, (y[i - 1], y[i]), 1)
        de, dt = (de / n).astype(np.float32), (dt / n).astype(np.float32)
        flat = h.reshape(-1, 2 * HIDDEN)
        out = {"u": flat.T @ de.reshape(-1, TAGS), "c": de.sum(axis=(0, 1)), "t": dt}
        dh = de @ self.p["u"].T
        out["wf"], out["bf"], dx = _lstm_back(x, self.p["wf"], kf, dh[:, :, :HIDDEN])
        out["wb"], out["bb"], dxb = _lstm_back(x[::-1], self.p["wb"], kb, dh[::-1, :, HIDDEN:])
        out["e"] = np.zeros_like(self.p["e"])
        np.add.at(out["e"], ids.T, dx + dxb[::-1])
        return float((z - gold).mean()), out

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> float:
        g, m, v, loss = np.random.default_rng(seed), {}, {}, 0.0
        for k in range(1, steps + 1):
            pick = g.integers(0, len(ids), batch)
            loss, grads = self.gradient(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in grads.values()))
            now = rate * (1 - 0.9 * k / steps)
            for name, x in grads.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                m[name] = 0.9 * m.get(name, 0) + 0.1 * x
                v[name] = 0.99 * v.get(name, 0) + 0.01 * x * x
                self.p[name] -= (now * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return loss

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, and the posterior of each of them."""
        e, _ = self.emissions(ids)
        t, steps, n = self.p["t"], *e.shape[:2]
        best, back = e[0], np.empty((steps, n, TAGS), np.int8)
        for i in range(1, steps):
            from_all = best[:, :, None] + t
            back[i] = from_all.argmax(axis=1)
            best = e[i] + from_all.max(axis=1)
        tags = np.empty((steps, n), np.int64)
        tags[-1] = best.argmax(axis=1)
        for i in range(steps - 1, 0, -1):
            tags[i - 1] = back[i][np.arange(n), tags[i]]
        alpha, beta, z = self._sums(e)
        sure = np.exp(np.take_along_axis(alpha + beta, tags[:, :, None], 2)[:, :, 0] - z)
        return tags.T, sure.T


def tag_row(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


_trained: dict = {}


def trained(lines: int = 3000, steps: int = 450, batch: int = 48, rate: float = 0.02, seed: int = 4) -> Tagger:
    """The network after training on generated lines; the same on every call."""
    key = (lines, steps, batch, rate, seed)
    if key not in _trained:
        ids, tags = np.zeros((lines, WINDOW), np.int64), np.zeros((lines, WINDOW), np.int64)
        for i, (text, spans) in enumerate(labelled_lines(lines, seed)):
            c, y = classes(text)[:WINDOW], tag_row(len(text), spans)[:WINDOW]
            ids[i, : len(c)], tags[i, : len(y)] = c, y
        model = Tagger(seed)
        model.fit(ids, tags, steps, batch, rate, seed)
        _trained[key] = model
    return _trained[key]


def trained_for(spark: SparkSession) -> Tagger:
    """The trained network, from the shared folder if a session has kept it there: its arrays go with this module's text, so
    they are never those of other code. They are written aside and renamed."""
    key = hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:24]
    if key in _trained:
        return _trained[key]
    base = f"{shared_dir(spark).rstrip('/')}/kept"
    at, system = file_system(spark, f"{base}/tagger-{key}.npz")
    if system.exists(at):
        stream = system.open(at)
        held = np.load(io.BytesIO(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        stream.close()
        model = Tagger()
        model.p = {name: held[name] for name in held.files}
    else:
        model, out = trained(), io.BytesIO()
        np.savez(out, **model.p)
        aside, _ = file_system(spark, f"{base}/.{uuid.uuid4().hex}")
        stream = system.create(aside, False)
        stream.write(bytearray(out.getvalue()))
        stream.close()
        if system.exists(at) or not system.rename(aside, at):
            system.delete(aside, False)
    _trained[key] = model
    return model


def _windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows that cover every digit and @ with what is around it."""
    out, lo, hi = [], None, None
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.start() + 1 + AROUND)
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None:
            out.append((lo, hi))
        lo, hi = a, b
    if hi is not None:
        out.append((lo, hi))
    return [(s, min(s + WINDOW, hi)) for lo, hi in out for s in range(lo, max(lo + 1, hi - WINDOW + STRIDE), STRIDE)]


def _possible(kind: int, x: str) -> bool:
    digits = len(_NOT_DIGIT.sub("", x))
    if kind == 0:
        return x.count("@") == 1 and 0 < x.index("@") < len(x) - 3 and "." in x[x.index("@") :]
    if kind == 1:
        parts = x.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    if kind == 2:
        return 13 <= digits <= 19 and digits >= len(x) - 4
    return 7 <= digits <= 15 and digits >= 0.5 * len(x) and (len(x) > digits or digits <= 12)


def _spans_of(tags: np.ndarray, sure: np.ndarray, at: int, text: str, edge_ok: tuple[bool, bool], least: float):
    """(score, kind, start, end) of a window's spans; those at an inner edge are left to the window that overlaps."""
    n, i = len(tags), 0
    while i < n:
        tag = tags[i]
        if tag == 0 or tag % 2 == 0:
            i += 1
            continue
        j = i + 1
        while j < n and tags[j] == tag + 1:
            j += 1
        kind, score = (int(tag) - 1) // 2, float(sure[i:j].mean())
        cut = (i == 0 and not edge_ok[0]) or (j == n and not edge_ok[1])
        a, b = at + i, at + j
        while b > a and not text[b - 1].isalnum():  # marks after it are none of it
            b -= 1
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        kind = next((k for k in (kind, 3, 2) if _possible(k, text[a:b])), None)  # what can't be the one may be another
        if score >= least and not cut and kind is not None:
            yield score, kind, a, b
        i = j


def reconcile(found: list[tuple[float, int, int, int]], base: list[Span], text: str) -> list[Span]:
    """Of all windows' spans, the disjoint ones with the highest sum of score times length that meet no base span, or hold
    each that they meet and a letter or digit more."""
    best = {}
    for score, kind, start, end in found:
        best[kind, start, end] = max(score, best.get((kind, start, end), 0))
    taken = sorted((s, e) for _, s, e in base)
    ends = np.maximum.accumulate([e for _, e in taken]) if taken else []
    starts = [s for s, _ in taken]

    def free(s: int, e: int) -> bool:
        k = int(np.searchsorted(starts, e))  # base spans that begin before the end
        if k == 0 or ends[k - 1] <= s:
            return True
        met = [(a, b) for a, b in taken[:k] if b > s]
        outside = "".join(text[a:b] for a, b in zip([s, *(b for _, b in met)], [*(a for a, _ in met), e], strict=True))
        return all(s <= a and b <= e for a, b in met) and any(c.isalnum() for c in outside)

    rows = sorted(((e, s, k, w * (e - s)) for (k, s, e), w in best.items() if free(s, e)))
    if not rows:
        return []
    stops, value, pick = [r[0] for r in rows], [0.0], []
    for i, (_, s, _, w) in enumerate(rows):
        j = int(np.searchsorted(stops[:i], s, side="right"))
        with_it = value[j] + w
        pick.append((with_it > value[i], j))
        value.append(max(with_it, value[i]))
    out, i = [], len(rows)
    while i:
        use, j = pick[i - 1]
        if use:
            e, s, k, _ = rows[i - 1]
            out.append((k, s, e))
        i = j if use else i - 1
    return out[::-1]


def added_spans(model: Tagger, texts: list[str], base: list[list[Span]], least: float, group: int = 2048) -> list[list[Span]]:
    where, found = [(i, a, b) for i, x in enumerate(texts) for a, b in (_windows(x) if _TRIGGER.search(x) else ())], [[] for _ in texts]
    for lo in range(0, len(where), group):
        part = where[lo : lo + group]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for k, (i, a, b) in enumerate(part):
            ids[k, : b - a] = classes(texts[i][a:b])
        tags, sure = model.decode(ids)
        for k in np.flatnonzero(tags.any(axis=1)):
            i, a, b = part[k]
            found[i] += _spans_of(tags[k, : b - a], sure[k, : b - a], a, texts[i], (a == 0, b == len(texts[i])), least)
    return [reconcile(f, s, x) if f else [] for f, s, x in zip(found, base, texts, strict=True)]


def _line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _finder(model: Tagger, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            base = [base_spans(x) if _TRIGGER.search(x) else [] for x in texts]
            more = added_spans(model, texts, base, least)
            counts = [[sum(k == kind for k, _, _ in s) for s in base] for kind in range(len(KINDS))]
            lines = [_line(s) for s in base]
            arrays = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines]), pa.array([_line(b + m) if m else x for x, b, m in zip(lines, base, more, strict=True)])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def find(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base patterns), base_sha256, spans (base and added)."""
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_finder(trained_for(docs.sparkSession), least)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _masker(model: Tagger, least: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            full = [x or "" for x in texts]
            base = [base_spans(x) if _TRIGGER.search(x) else [] for x in full]
            more = added_spans(model, full, base, least)
            new = pa.array([masked(x, b + m) if b or m else t for t, x, b, m in zip(texts, full, base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in names], names)

    return run


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with every span masked in its text, and n_chars, if there, counted again."""
    ensure_importable(docs.sparkSession)
    out = docs.mapInArrow(tidy(_masker(trained_for(docs.sparkSession), least, docs.columns)), docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
