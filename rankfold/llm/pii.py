"""Personal data: exact patterns, and a character-level bidirectional LSTM with
CRF transitions that adds spans the patterns miss.

Base spans (email, ip, card, phone) come from fixed patterns with checks; they
always stay. The tagger is trained in numpy from spans labelled in a bounded
sample of text windows, of the texts as they are and with forms put in that the
patterns miss (national phone numbers, mail at a bare host, cards and addresses
with other separators) or that are none (dates, counts). It reads overlapping
windows of WINDOW characters, every HOP characters, wherever a window has a digit
or an at sign; base spans have one, and an added span without one near is not
seen. An added span of up to 37 characters lies in a window with both margins
wherever it stands; longer ones only at some places, from 85 on at none (but at
a text's ends). Base spans have no such limit. Windows are decoded by Viterbi and reconciled over the
whole text: a span counts only if every window that holds it with a margin
decodes the same span; of overlapping spans the set with the largest total
confidence stays, base spans first. A match that fails
its check is not added back as the same span of the same kind; any other span
over its digits may be.

Defined cases: a null or empty text has no spans; texts of any length are read
whole; repeated rows are read each; other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankfold.llm.text import add_column, first_by_hash, materialize, prepare, rows_of, slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, HOP, MARGIN = 96, 48, 6
#: Labelled windows that training reads at most, and their hidden size and embedding.
MAX_WINDOWS, HIDDEN, EMBED = 1500, 16, 8
#: Varied versions of a text that training reads beside the text itself.
TURNS = 8
#: Mean tag probability that an added span needs.
CONFIDENT = 0.97

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a digit run is taken whole, so a start inside one can't match where its head didn't
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]")
_SIGNAL = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
        else:
            done = at + 1  # no local part reaches back over an at sign
        at = text.find("@", max(done, at + 1))


def base_spans(text: str, failed: list | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind number), ordered by start, then kind. ``failed`` gets the matches that fail their check."""
    found = [(lo, hi, 0, True) for lo, hi in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        found.append((*m.span(), 1, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        found.append((*m.span(), 2, 12 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            found.append((*m.span(), 3, 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15))
    if failed is not None:
        failed += [f[:3] for f in found if not f[3]]
    return sorted((f[:3] for f in found if f[3]), key=lambda s: (s[0], s[2], s[1]))


def said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, hi, k in spans)


# --- the tagger: tags are 0 outside, 1 + 2k begin and 2 + 2k inside of kind k

TAGS = 1 + 2 * len(KINDS)


def characters(text: str) -> np.ndarray:
    """Classes of code points: ASCII as it is, 128 for all others."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.int64)


def starts_of(text: str) -> list[int]:
    """Starts of the windows to read: on a grid of HOP, where a digit or an at sign is."""
    out = set()
    last = max(0, -(-(len(text) - WINDOW) // HOP)) if len(text) > WINDOW else 0
    for m in _SIGNAL.finditer(text):
        g = m.start() // HOP
        out.update(k for k in (g - 1, g) if 0 <= k <= last)
        if g > last:
            out.add(last)
    return [k * HOP for k in sorted(out)]


@dataclass
class Tagger:
    embed: np.ndarray
    cells: tuple  # forward and backward (Wx, Wh, b); gates i, f, o, g
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray  # CRF transition scores [from, to]
    begin: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.cells[0], *self.cells[1], self.out, self.bias, self.moves, self.begin]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_tagger(seed: int = 5) -> Tagger:
    rng = np.random.default_rng(seed)
    cell = lambda: (rng.normal(0, 0.3, (EMBED, 4 * HIDDEN)), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)),
                    np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN))
    moves = np.zeros((TAGS, TAGS))
    for to in range(2, TAGS, 2):  # inside a kind only after its begin or inside
        moves[[f for f in range(TAGS) if f not in (to - 1, to)], to] = -4
    return Tagger(rng.normal(0, 0.5, (129, EMBED)), (cell(), cell()), rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), np.zeros(TAGS),
                  moves, np.where(np.arange(TAGS) % 2 == 0, 0.0, -1.0))


def _lstm(x, wx, wh, b):
    """States of all steps, [step, row, unit], with what the backward pass needs."""
    steps, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    hs, saved = np.empty((steps, n, HIDDEN)), []
    fed = x @ wx + b
    for t in range(steps):
        a = fed[t] + h @ wh
        s = _sigmoid(a[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(a[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        th = np.tanh(c)
        saved.append((h, before, i, f, o, g, th))
        h = o * th
        hs[t] = h
    return hs, saved


def _lstm_back(x, wx, wh, saved, dhs):
    dwx, dwh, db, dx = np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1]), np.empty_like(x)
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    for t in reversed(range(len(saved))):
        h, before, i, f, o, g, th = saved[t]
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - th * th)
        da = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
        dwx += x[t].T @ da
        dwh += h.T @ da
        db += da.sum(0)
        dx[t] = da @ wx.T
        dh, dc = da @ wh.T, dc * f
    return dwx, dwh, db, dx


def unary(m: Tagger, codes: np.ndarray):
    """Tag scores [step, row, tag] of windows [row, step], and the states."""
    x = m.embed[codes.T]
    ahead, saved = _lstm(x, *m.cells[0])
    back, saved_back = _lstm(x[::-1], *m.cells[1])
    h = np.concatenate([ahead, back[::-1]], 2)
    return h @ m.out + m.bias, (x, h, saved, saved_back)


def _total(a, axis):
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(scores, moves, begin):
    """CRF tag probabilities [step, row, tag], expected moves, and the log normaliser."""
    steps, n, k = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0] + begin
    for t in range(1, steps):
        alpha[t] = scores[t] + _total(alpha[t - 1][:, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _total(moves + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _total(alpha[-1], 1)
    p = np.exp(alpha + beta - z[None, :, None])
    pair = np.zeros((k, k))
    for t in range(1, steps):
        pair += np.exp(alpha[t - 1][:, :, None] + moves + (scores[t] + beta[t] - z[:, None])[:, None, :]).sum(0)
    return p, pair, z


def viterbi(scores, moves, begin) -> np.ndarray:
    """Best tags [row, step]."""
    steps, n, _ = scores.shape
    best, back = scores[0] + begin, []
    for t in range(1, steps):
        a = best[:, :, None] + moves
        back.append(a.argmax(1))
        best = a.max(1) + scores[t]
    out = np.empty((n, steps), np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(steps - 2, -1, -1):
        out[:, t] = back[t][np.arange(n), out[:, t + 1]]
    return out


def train(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = 600, batch: int = 50, rate: float = 0.04) -> Tagger:
    """Maximum likelihood by Adam (the rate falls over the last quarter), gradients by hand: CRF marginals less the truth, back through both LSTMs."""
    m = new_tagger()
    if not windows:
        return m
    codes, tags = np.array([w[0] for w in windows]), np.array([w[1] for w in windows])
    parts = m.parts()
    first, second, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    rng = np.random.default_rng(3)
    while step < steps:
        order = rng.permutation(len(codes))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            scores, (x, h, saved, saved_back) = unary(m, codes[pick])
            p, pair, _ = marginals(scores, m.moves, m.begin)
            truth = tags[pick].T
            d = p
            np.put_along_axis(d, truth[:, :, None], np.take_along_axis(d, truth[:, :, None], 2) - 1, 2)
            n = len(pick)
            d_begin = d[0].sum(0)
            np.subtract.at(pair, (truth[:-1].ravel(), truth[1:].ravel()), 1)
            dh = d @ m.out.T
            g_out = np.tensordot(h, d, ([0, 1], [0, 1]))
            a = _lstm_back(x, m.cells[0][0], m.cells[0][1], saved, dh[:, :, :HIDDEN])
            b = _lstm_back(x[::-1], m.cells[1][0], m.cells[1][1], saved_back, dh[::-1, :, HIDDEN:])
            g_embed = np.zeros_like(m.embed)
            np.add.at(g_embed, codes[pick].T, a[3] + b[3][::-1])
            step += 1
            for k, (w, g) in enumerate(zip(parts, [g_embed, *a[:3], *b[:3], g_out, d.sum((0, 1)), pair, d_begin], strict=True)):
                g = np.clip(g / n, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w -= rate * min(1.0, 4 * (1 - step / steps)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return m


def missed_form(rng: random.Random) -> tuple[str, int | None]:
    """A made-up span of a form that no pattern finds, and its kind; or a number that is none (None)."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    kind = rng.choice((0, 1, 2, 3, 3, 3, None, None))
    if kind == 0:
        name = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) + rng.choice(("", d(1), d(2), "." + d(2)))
        return name + "@" + rng.choice(("localhost", "mail", "intranet", "host" + d(1), "server" + d(2))), kind
    if kind == 1:
        return rng.choice(("[.]", " . ", "(.)")).join(str(rng.randint(0, 255)) for _ in range(4)), kind
    if kind == 2:
        body = d(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return rng.choice((".", "/", "_", "  ")).join(body[k : k + 4] for k in range(0, 16, 4)), kind
    a, b, c = d(3), d(3), d(4)
    if kind == 3:
        return rng.choice((f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}",
                           f"0{a}/{b}/{c}", f"0{a} {b}{c}", f"0{a}-{b}{c}")), kind
    year = rng.randint(1900, 2099)
    return rng.choice((f"{year}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{year}", f"{d(2)}:{d(2)}", d(rng.randint(1, 8)), f"{d(2)}.{d(2)}", f"{d(1)}.{d(1)}.{d(2)}",
                       f"{year}-{year + 1}", f"({d(rng.randint(1, 4))})", f"{d(1)},{d(3)},{d(3)}")), None


def varied(text: str, turn: int) -> tuple[str, list[tuple[int, int, int | None]]]:
    """The text with about two thirds of its base spans replaced by missed forms, and one form put
    before the word of its first signal; and where they are. The same text and turn give the same forms."""
    rng = random.Random(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, salt=bytes([turn])).digest())
    first = _SIGNAL.search(text)
    at = text.rfind(" ", 0, first.start()) + 1 if first else 0
    parts, spans, done, size = [], [], 0, 0
    for lo, hi in sorted([(at, at), *[s[:2] for s in base_spans(text)]]):
        if lo < done or lo < hi and rng.random() < 0.33:
            continue
        form, kind = missed_form(rng)
        parts += [text[done:lo], form, " " * (lo == hi)]
        start = size + lo - done
        spans.append((start, start + len(form), kind))
        size, done = start + len(form) + (lo == hi), hi
    return "".join([*parts, text[done:]]), spans


def labelled_windows(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training windows of a text, as it is and varied; a span cut by the window's edge is labelled as far as it is seen."""
    return [w for version in ((text, []), *[varied(text, turn) for turn in range(TURNS)]) for w in _labelled(*version)]


def _labelled(text: str, forms: list[tuple[int, int, int | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
    codes, tags = characters(text), np.zeros(max(len(text), WINDOW), np.int64)
    codes = np.pad(codes, (0, max(0, WINDOW - len(codes))), constant_values=0)
    free = np.ones(len(tags), bool)
    for lo, hi, k in [*forms, *base_spans(text)]:
        if free[lo:hi].all():
            free[lo:hi] = False
            if k is not None:
                tags[lo:hi] = 2 + 2 * k
                tags[lo] = 1 + 2 * k
    return [(_cut(codes, lo), _cut(tags, lo)) for lo in starts_of(text)]


def _cut(values: np.ndarray, lo: int) -> np.ndarray:
    part = values[lo : lo + WINDOW]
    return np.pad(part, (0, WINDOW - len(part)), constant_values=0)


def tagged(m: Tagger, text: str, starts: list[int], most: int = 512):
    """(start, end, kind, confidence, number of the window) of all spans that the windows decode."""
    codes = np.pad(characters(text), (0, WINDOW), constant_values=0)
    for lo in range(0, len(starts), most):
        part = starts[lo : lo + most]
        scores, _ = unary(m, np.array([codes[s : s + WINDOW] for s in part]))
        tags = viterbi(scores, m.moves, m.begin)
        rows = np.flatnonzero(tags.any(1))
        if not len(rows):
            continue
        p = marginals(scores[:, rows], m.moves, m.begin)[0]
        for k, row in enumerate(rows):
            at = 0
            while at < WINDOW:
                tag = tags[row, at]
                if tag == 0:
                    at += 1
                    continue
                kind, end = (tag - 1) // 2, at + 1
                while end < WINDOW and tags[row, end] == 2 + 2 * kind:
                    end += 1
                sure = np.concatenate([p[at : at + 1, k, tag], p[at + 1 : end, k, 2 + 2 * kind]]).mean()
                yield part[row] + at, part[row] + end, int(kind), float(sure), part[row]
                at = end


def reconcile(found, text_length: int, starts: list[int], taken, vetoed=()) -> list[tuple[int, int, int]]:
    """Spans that every window holding them with a margin has decoded alike, and
    of overlapping ones the set of the largest total confidence; none that overlaps a base span (``taken``) or is a failed match (``vetoed``)."""
    read, vetoed = set(starts), set(vetoed)
    seen: dict[tuple[int, int, int], list[float]] = {}
    for lo, hi, kind, sure, start in found:
        inside = (lo - start >= MARGIN or start == 0) and (start + WINDOW - hi >= MARGIN or hi >= text_length)
        if inside and hi <= text_length and (lo, hi, kind) not in vetoed:
            seen.setdefault((lo, hi, kind), []).append(sure)
    good = []
    for (lo, hi, kind), sure in seen.items():
        holders = [s for s in range(max(0, (hi + MARGIN - WINDOW) // HOP * HOP), lo + 1, HOP)
                   if s in read and (lo - s >= MARGIN or s == 0) and (s + WINDOW - hi >= MARGIN or hi >= text_length)]
        if len(sure) >= len(holders) and min(sure) >= CONFIDENT and not any(lo < b and a < hi for a, b in taken):
            good.append((hi, lo, kind, sum(sure) / len(sure)))
    good.sort()
    best: list[tuple[float, list]] = [(0.0, [])]
    for k, (_, lo, kind, sure) in enumerate(good):
        j = k
        while j and good[j - 1][0] > lo:
            j -= 1
        best.append(max(best[k], (best[j][0] + sure, [*best[j][1], (lo, good[k][0], kind)]), key=lambda b: b[0]))
    return best[-1][1]


def find(m: Tagger, text: str | None) -> tuple[list, list]:
    """Base spans and added spans of a text."""
    if not text or not _SIGNAL.search(text):
        return [], []
    failed: list = []
    base, starts = base_spans(text, failed), starts_of(text)
    return base, reconcile([*tagged(m, text, starts)], len(text), starts, [s[:2] for s in base], failed)


def _training_rows(most: int):
    """Labelled windows of a task: of the distinct ones the ``most`` with the
    smallest hashes, which hold all that the sample can take from this task."""
    def run(batches):
        found: set[tuple[int, bytes]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    if text and _SIGNAL.search(text):
                        for codes, tags in labelled_windows(text):
                            blob = codes.astype(np.uint8).tobytes() + tags.astype(np.uint8).tobytes()
                            found.add((int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "big", signed=True), blob))
                        if len(found) > 8 * most:
                            found = set(heapq.nsmallest(most, found))
        least = heapq.nsmallest(most, found)
        for lo in range(0, len(least), 1000):
            out = least[lo : lo + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())],
                                             names=["turn", "blob"])
    return run


def fit(docs: DataFrame, text: str = "text", most: int = MAX_WINDOWS) -> Tagger:
    """Trains on at most ``most`` windows, the first by a hash of the window; a
    task sends at most that many.
    Spans are labelled by the patterns; a sum or a part out of range is labelled as no span."""
    prepare(docs.sparkSession)
    rows = rows_of(docs, text).toDF("text").where(F.col("text").rlike("[0-9@]")).mapInArrow(_training_rows(most), "turn long, blob binary")
    rows = materialize(rows.distinct())  # a window that very many texts share counts once
    sample = first_by_hash(rows, "turn", most).collect()
    both = [np.frombuffer(r["blob"], np.uint8).astype(np.int64) for r in sample]
    return train([(b[:WINDOW], b[WINDOW:]) for b in both])


FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("n_email", "n_ip", "n_card", "n_phone", "n_added")]
                     + [T.StructField(c, T.StringType()) for c in ("base", "spans", "masked")])
_FOUND = pa.struct([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in FOUND])


def masked(text: str, spans) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    out, done = [], 0
    for lo, hi, kind in spans:
        if lo >= done:
            out.append(text[done:lo] + f"<{KINDS[kind].upper()}>")
        done = max(done, hi)
    return "".join([*out, text[done:]])


def mark_personal(docs: DataFrame, model: Tagger, text: str = "text", out: str = "pii", mask: bool = False) -> DataFrame:
    """``docs`` with a struct column ``out``: numbers of base spans by kind and
    of added spans, base and all spans as kind:start:end, and (``mask``) the
    text with its spans masked, else null. The model is a few thousand numbers."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(part):
        rows = []
        for t in part.column(text).to_pylist():
            base, added = find(shared.value, t)
            spans = sorted([*base, *added], key=lambda s: (s[0], s[2], s[1]))
            counts = [sum(s[2] == k for s in base) for k in range(len(KINDS))]
            rows.append({**dict(zip(("n_email", "n_ip", "n_card", "n_phone"), counts, strict=True)), "n_added": len(added),
                         "base": said(base), "spans": said(spans), "masked": masked(t, spans) if mask and t is not None else None})
        return pa.array(rows, _FOUND)

    return add_column(docs, out, FOUND, text, make)
