"""Personal data and secrets by a character-level bidirectional LSTM with a CRF.

The model is trained in numpy from labelled spans. Documents are cut into
overlapping windows; each is decoded by Viterbi, and the spans of all windows
of a document are reconciled.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemap.llm.common import chunks, least_hashed, spread, table, tidy

KINDS = ["", "email", "phone", "ip", "card", "secret"]
HIDDEN = 12
WINDOW, OVERLAP = 1024, 64
#: Documents that lend lines to the training texts, taken in the order of a hash of their ids, lines taken from each, and the longest line taken.
CARRIER_DOCS = 400
CARRIER_LINES, CARRIER_CHARS = 8, 2000
STEPS, BATCH, LENGTH = 1500, 96, 96
_BATCH_WINDOWS = 1024
_TOP = 0x300
#: The bits of 1.0 as a number, half of those that a factor of e adds, and how far from 1.0 they may go.
_ZERO, _SCALE, _FURTHEST = 127 << 23, 2**22 / np.log(2), 120 << 23
Spans = list[tuple[int, int, int]]


def _alphabet() -> np.ndarray:
    at = np.full(_TOP, 131, np.uint8)
    at[:128] = np.arange(128)
    for c in range(128, _TOP - 1):
        at[c] = (129 if chr(c).isupper() else 128) if chr(c).isalpha() else 130
    return at


ALPHABET = _alphabet()
SYMBOLS = 132


def encode(text: str) -> np.ndarray:
    return ALPHABET[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), _TOP - 1)]


# --- labelled training texts


def _mixed(rng: random.Random, n: int, letters: str = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def _email(rng: random.Random, word: str, other: str) -> str:
    n = rng.randrange
    first, last, d = word[:12], other[:12], _mixed(rng, rng.choice([1, 1, 2, 4]), "0123456789")
    user = rng.choice([first, f"{first}{d}", f"{first}.{d}", f"{first}_{d}", f"{first[:1]}.{last}", f"{first}.{last}", f"{first}-{last}", f"{first}_{last}", f"{first}{last[:1]}", first.upper(), first.capitalize()])
    user += rng.choice(["", "", "", "", f"+{last}", f"+{d}"])
    name = rng.choice([f"mail{n(10)}.example", "example", "mail", "post", last, f"{first}-{last}", f"{last}{n(10)}", f"mx{n(10)}.{last}", f"web.{last}", "company", f"uni-{last}"])
    return f"{user}@{name}.{rng.choice(['com', 'com', 'org', 'net', 'de', 'fr', 'es', 'edu', 'io', 'co', 'co.uk', 'info'])}"


def _phone(rng: random.Random) -> str:
    d = lambda n: _mixed(rng, n, "0123456789")
    a, b, c = d(3), rng.choice(["555", d(3)]), d(4)
    return rng.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{rng.randrange(20, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}", f"+{rng.randrange(20, 99)} {d(4)} {d(6)}", f"0{d(4)} {d(6)}", f"0{d(3)} {d(3)} {d(4)}", f"+{rng.randrange(20, 99)}{d(10)}", f"0{d(2)}-{d(4)}-{d(4)}"])


def _address(rng: random.Random) -> str:
    if rng.random() < 0.7:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    group = lambda: _mixed(rng, rng.choice([1, 2, 3, 4, 4, 4]), "0123456789abcdef")
    head, tail = rng.randrange(1, 5), rng.randrange(0, 4)
    v = rng.choice([":".join(group() for _ in range(8)), ":".join(group() for _ in range(head)) + "::" + ":".join(group() for _ in range(tail))])
    return v if rng.random() < 0.8 else v.upper()


def _key(rng: random.Random) -> tuple[str, bool]:
    """A secret, and whether it is known by its looks alone."""
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    kind = rng.randrange(10)
    if kind < 4:
        return _mixed(rng, rng.choice([32, 40, 40, 40, 64]), hexa), False
    if kind < 7:
        return _mixed(rng, rng.randrange(28, 44)), False
    return rng.choice([
        "AKIA" + _mixed(rng, 16, upper), "ASIA" + _mixed(rng, 16, upper), "ghp_" + _mixed(rng, 36), "sk-" + _mixed(rng, rng.choice([32, 48])), "sk_live_" + _mixed(rng, 24), "AIza" + _mixed(rng, 35), f"xoxb-{_mixed(rng, 11, '0123456789')}-{_mixed(rng, 24)}", "glpat-" + _mixed(rng, 20),
    ]), True


def _value(rng: random.Random, kind: str, word: str, other: str) -> tuple[str, int, int]:
    """A text and where the labelled value stands in it."""
    if kind == "email":
        v = _email(rng, word, other)
    elif kind == "phone":
        v = _phone(rng)
    elif kind == "ip":
        v = _address(rng)
    elif kind == "card":
        sizes = [4, 4, 4, 4] if rng.random() < 0.85 else [4, 6, 5]
        v = rng.choice(["", "", "", " ", "-"]).join(_mixed(rng, n, "0123456789") for n in sizes)
    else:
        v, known = _key(rng)
        if known and rng.random() < 0.5:
            return v, 0, len(v)
        name = rng.choice(["token", "token", "token", "api_key", "secret", "password", "aws_key", "auth"])
        lead = rng.choice([f'{name} = "', f'{name} = "', f'{name}="', f"{name}: ", f"{name}="])
        return lead + v + ('"' if '"' in lead else ""), len(lead), len(lead) + len(v)
    return v, 0, len(v)


def _plain(rng: random.Random, word: str) -> str:
    """Something with digits or signs that is none of the kinds."""
    n = rng.randrange
    return rng.choice([
        str(n(10)), str(n(100)), str(n(1900, 2100)), str(n(10**6)), str(n(10**5, 10**9)), f"{n(10)}.{n(10)}", f"{n(10)}.{n(20)}.{n(10)}", f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}", f"{n(10, 24)}:{n(10, 60)}", f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}", f"${n(1000)}.{n(10, 99)}", f"{n(100)}%", "###", "$$$", "%%%", "!!", "|", f"({n(100)})", f"#{n(1000)}", "@", f"@{word}", "x = 3",
        f"page {n(50)}", rng.choice(".-/").join([f"{n(1, 32):02d}", f"{n(1, 13):02d}", str(n(1900, 2100))]), rng.choice("-/").join([str(n(1900, 2100)), f"{n(1, 13):02d}", f"{n(1, 32):02d}"]), f"{n(1000)}-{n(1000)}", f"{n(1, 999)},{n(100, 999)}", f"#{_mixed(rng, 6, '0123456789abcdef')}", f"{word}-{n(100)}", f"{word}_{n(10)}", f"http://{word}.example.org/{n(2000, 2030)}/{word}", f"{word}.{word}", f"{word.upper()}{n(100)}", f"v{n(10)}.{n(10)}.{n(10)}.{n(10, 30)}-rc",
    ])


def labelled(lines: list[str], n: int, seed: int) -> list[tuple[str, Spans]]:
    """n texts of at least LENGTH characters with values of all kinds set into the lines' words, and their spans."""
    rng = random.Random(seed)
    lines = [x for x in lines if x.strip()] or ["some words of plain text that stand for a line."]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < LENGTH:
            words = rng.choice(lines).split(" ")
            start = rng.randrange(len(words))
            style = rng.random()
            for w in words[start : start + rng.randrange(1, 14)]:
                w = w.upper() + rng.choice(["", "!!"]) if style < 0.12 else w + rng.choice(["###", "$$$", "%%%", "&&&", "***"]) if style < 0.2 else w.capitalize() if style < 0.26 else w
                roll = rng.random()
                text += "" if not text or text[-1] == "\n" else " "
                if roll < 0.1:
                    kind = rng.randrange(1, len(KINDS))
                    clean = [re.sub(r"[\W_]", "", x).lower() or "me" for x in (w, rng.choice(words))]
                    v, a, b = _value(rng, KINDS[kind], *clean)
                    spans.append((len(text) + a, len(text) + b, kind))
                    text += v + rng.choice(["", "", "", "", ".", ",", "###", "$$$", "%%%", "!!", " |", ";", ")"])
                elif roll < 0.16:
                    text += _plain(rng, re.sub(r"[\W_]", "", w).lower() or "me") + rng.choice(["", ",", "."])
                else:
                    text += w
            text += rng.choice([" ", "\n"]).strip(" ")
        out.append((text, spans))
    return out


# --- model


class Tagger:
    """Parameters: for each direction the input projection of every character and the recurrent weights, the emission weights, the CRF's transitions. Gates are (1 + tanh) / 2."""

    def __init__(self, seed: int = 5):
        rng, h, k = np.random.default_rng(seed), HIDDEN, len(KINDS)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (SYMBOLS, 4 * h))
            self.p["x" + d][:, h : 2 * h] += 0.5
            self.p["u" + d] = rng.normal(0, 0.5 / np.sqrt(h), (h, 4 * h))
            self.p["w" + d] = rng.normal(0, 0.5, (h, k))
        self.p["bias"], self.p["move"] = np.zeros(k), np.eye(k) * 1.0

    def frozen(self) -> Tagger:
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in self.p.items()}
        return self

    # training over whole windows of one length: ids (T, B)

    def _run(self, ids: np.ndarray):
        """Outputs (T, 2, B, H) of both directions over ids (T, 2, B), and what the way back needs."""
        h, n = HIDDEN, ids.shape[2]
        x, u = np.stack([self.p["xf"], self.p["xb"]]), np.stack([self.p["uf"], self.p["ub"]])
        into = x[np.arange(2)[None, :, None], ids]
        hid, cell, kept = np.zeros((2, n, h), x.dtype), np.zeros((2, n, h), x.dtype), []
        outs = np.empty((len(ids), 2, n, h), x.dtype)
        for t in range(len(ids)):
            a = np.tanh(into[t] + hid @ u)
            gates = (1 + a[..., : 3 * h]) / 2
            i, f, o, g = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :], a[..., 3 * h :]
            new = f * cell + i * g
            tc = np.tanh(new)
            kept.append((a, i, f, o, g, cell, tc, hid))
            cell, hid = new, o * tc
            outs[t] = hid
        return outs, kept

    def _back(self, ids, kept, d_outs, grads):
        h = HIDDEN
        back = np.stack([self.p["uf"].T, self.p["ub"].T])
        d_hid, d_cell = np.zeros_like(d_outs[0]), np.zeros_like(d_outs[0])
        d_z = np.empty((*ids.shape, 4 * h), back.dtype)
        for t in range(len(ids) - 1, -1, -1):
            a, i, f, o, g, before, tc, _ = kept[t]
            dh = d_outs[t] + d_hid
            dc = d_cell + dh * o * (1 - tc * tc)
            z = d_z[t]
            z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h], z[..., 3 * h :] = dc * g / 2, dc * before / 2, dh * tc / 2, dc * i
            z *= 1 - a * a
            d_hid, d_cell = z @ back, dc * f
        hid = np.stack([k[7] for k in kept])
        for k, d in enumerate("fb"):
            grads["u" + d] += hid[:, k].reshape(-1, h).T @ d_z[:, k].reshape(-1, 4 * h)
            flat = ids[:, k].ravel()
            order = np.argsort(flat, kind="stable")
            seen, first = np.unique(flat[order], return_index=True)
            grads["x" + d][seen] += np.add.reduceat(d_z[:, k].reshape(flat.size, -1)[order], first, axis=0)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags (T, B) and its gradients."""
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        both_ways = np.stack([ids, ids[::-1]], axis=1)
        outs, kept = self._run(both_ways)
        fo, bo = outs[:, 0], outs[:, 1]
        e = fo @ self.p["wf"] + bo[::-1] @ self.p["wb"] + self.p["bias"]
        move, (steps, n, k) = self.p["move"], e.shape
        # chances forward and backward, each step's brought to a sum of 1, whose logarithms make the likelihood
        top, most = e.max(axis=2, keepdims=True), move.max()
        emit, pass_on = np.exp(e - top), np.exp(move - most)
        fwd, bwd, total = np.empty_like(e), np.ones_like(e), np.empty((steps, n, 1), e.dtype)
        for t in range(steps):
            fwd[t] = emit[t] * (fwd[t - 1] @ pass_on) if t else emit[t]
            total[t] = fwd[t].sum(axis=1, keepdims=True)
            fwd[t] /= total[t]
        for t in range(steps - 2, -1, -1):
            bwd[t] = (emit[t + 1] * bwd[t + 1]) @ pass_on.T / total[t + 1]
        z = (np.log(total) + top).sum(axis=(0, 2)) + (steps - 1) * most
        share = fwd * bwd
        both = pass_on * (fwd[:-1].reshape(-1, k).T @ (emit * bwd / total)[1:].reshape(-1, k))
        at, col = np.arange(steps)[:, None], np.arange(n)[None, :]
        gold = e[at, col, tags].sum() + move[tags[:-1], tags[1:]].sum()
        share[at, col, tags] -= 1
        np.subtract.at(both, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        share /= n
        grads["move"] += both / n
        grads["bias"] += share.sum(axis=(0, 1))
        grads["wf"] += np.einsum("tnh,tnk->hk", fo, share)
        grads["wb"] += np.einsum("tnh,tnk->hk", bo[::-1], share)
        self._back(both_ways, kept, np.stack([share @ self.p["wf"].T, (share @ self.p["wb"].T)[::-1]], axis=1), grads)
        return (z.sum() - gold) / n, grads

    # decoding of windows of any length; each gate of all windows is one block of memory

    def emissions(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Emissions (step, window, tag) of windows sorted by falling size; what stands beyond a window's end has no meaning.

        A sigmoid is e(z / 2) / (e(z / 2) + e(-z / 2)), with e linear between
        powers of two: float bits read as an integer are such a logarithm. Its
        error is below 0.003.
        """
        h, k, n_all, steps = HIDDEN, len(KINDS), len(starts), int(sizes[0])
        e = np.zeros((steps, n_all, k), np.float32)
        active = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right").tolist()
        at = [ids[starts[:n] + t] for t, n in enumerate(active)]
        gate, both = np.arange(0, 4 * SYMBOLS, SYMBOLS)[:, None], np.int32(2 * _ZERO)
        one, two, zero, scale = np.float32(1), np.float32(2), np.float32(_ZERO), np.float32(2 * _SCALE)
        # beyond 20 a hyperbolic tangent is 1; whole arrays, as these are compared faster than numbers
        above = np.full((n_all, h), 20, np.float32)
        below = -above
        floats = [np.empty(m * n_all * h, np.float32) for m in (4, 5, 1)]
        whole = [np.empty(4 * n_all * h, np.int32) for _ in range(2)]
        row = np.empty(4 * n_all, np.intp)
        for d in "fb":
            # gates are sigmoids of twice their input, the candidate is a hyperbolic tangent, which is 2 sigmoid(2 z) - 1; their scale and the bits of 1.0 are in the weights
            x = self.p["x" + d].reshape(SYMBOLS, 4, h).transpose(1, 0, 2) * (2 * _SCALE) + _ZERO
            u = np.zeros((5, h, h), np.float32)
            u[:4] = self.p["u" + d].reshape(h, 4, h).transpose(1, 0, 2) * (2 * _SCALE)
            u[4, :, :k] = self.p["w" + d]
            # hidden units are within -1 and 1
            far = (np.abs(x - _ZERO).max(axis=1) + np.abs(u[:4]).sum(axis=1)).max() >= _FURTHEST
            x = np.ascontiguousarray(x.reshape(-1, h), np.float32)
            hid_all, cell_all = np.zeros((n_all, h), np.float32), np.zeros((n_all, h), np.float32)
            last = before = None
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                n = active[t]
                if n != last:
                    last = n
                    hid, cell, rows = hid_all[:n], cell_all[:n], row[: 4 * n].reshape(4, n)
                    a, b, c = (y[: m * n * h].reshape(m, n, h) for y, m in zip(floats, (4, 5, 1)))
                    i, j = (y[: 4 * n * h].reshape(4, n, h) for y in whole)
                    up, down, c, b4, b5 = i.view(np.float32), j.view(np.float32), c[0], b[:4], b[4, :, :k]
                x.take(np.add(at[t], gate, out=rows), axis=0, out=a, mode="clip")
                np.matmul(hid, u, out=b)
                # the step before, whose hidden units these are
                if before is not None:
                    m = min(n, active[before])
                    e[before, :m] += b5[:m]
                a += b4
                if far:
                    np.clip(a, zero - np.float32(_FURTHEST), zero + np.float32(_FURTHEST), out=a)
                np.copyto(i, a, casting="unsafe")
                np.subtract(both, i, out=j)
                down += up
                np.divide(up, down, out=a)
                cell *= a[1]
                a[3] *= two
                a[3] -= one
                np.multiply(a[0], a[3], out=c)
                cell += c
                np.minimum(cell, above[:n], out=c)
                np.maximum(c, below[:n], out=c)
                c *= scale
                c += zero
                np.copyto(i[0], c, casting="unsafe")
                np.subtract(both, i[0], out=j[0])
                down[0] += up[0]
                np.divide(up[0], down[0], out=hid)
                hid *= two
                hid -= one
                hid *= a[2]
                before = t
            e[sizes - 1 if d == "f" else 0, np.arange(n_all)] += hid_all @ u[4, :, :k]
        e += self.p["bias"]
        return e

    def decode(self, e: np.ndarray, sizes: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(window, its best tags) of windows whose best path isn't all 0.

        Windows in which no run of tags can pay, even with the dearest
        transitions in its favour, are known to be all 0 without the search.
        """
        some = np.flatnonzero(self._gains(e, sizes) > -1e-3)
        out = []
        if not len(some):
            return out
        move = self.p["move"]
        e, sizes = np.ascontiguousarray(e[: sizes[some[0]], some].transpose(0, 2, 1)), sizes[some]
        score, back = e[0].copy(), np.zeros((len(e), len(KINDS), len(some)), np.uint8)
        active = np.searchsorted(-sizes, -np.arange(1, len(e) + 1), "right").tolist()
        for t in range(1, len(e)):
            n = active[t]
            paths = score[:, None, :n] + move[:, :, None]
            back[t, :, :n] = paths.argmax(axis=0)
            score[:, :n] = paths.max(axis=0) + e[t, :, :n]
        tag = score.argmax(axis=0)
        tags = np.zeros((len(e), len(some)), np.uint8)
        for t in range(len(e) - 1, -1, -1):
            n = active[t]
            tags[t, :n] = tag[:n]
            if t:
                tag[:n] = back[t, tag[:n], np.arange(n)]
        for k in np.flatnonzero(tags.any(axis=0)).tolist():
            out.append((int(some[k]), tags[: sizes[k], k]))
        return out

    def _gains(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each window at least the most by which a run of tags, one for each of its steps, scores above 0 there: the greatest sum over a run, with the dearest transition into each tag."""
        move = self.p["move"] - self.p["move"][0, 0]
        into, out = move[1:].max(axis=0), float(move[1:, 0].max())
        enter, begin = float((move[0] - into)[1:].max()), float(-into[1:].min())
        gain = e[:, :, 1] + into[1]
        for k in range(2, len(KINDS)):
            np.maximum(gain, e[:, :, k] + into[k], out=gain)
        gain -= e[:, :, 0]
        active = np.searchsorted(-sizes, -np.arange(1, len(e) + 2), "right").tolist()
        run, best = np.full(e.shape[1], begin, np.float32), np.full(e.shape[1], -np.inf, np.float32)
        for t in range(len(e)):
            n, after = active[t], active[t + 1]
            if t:
                np.maximum(run[:n], enter, out=run[:n])
            run[:n] += gain[t, :n]
            np.maximum(best[:after], run[:after] + out, out=best[:after])
            np.maximum(best[after:n], run[after:n], out=best[after:n])
        return best

    def spans(self, texts: list[str | None]) -> list[Spans]:
        """Spans of each text, in order and disjoint."""
        out: list[Spans] = [[] for _ in texts]
        for a, b in chunks(texts, 1_500_000):
            codes = [encode(t) if t else np.zeros(0, np.uint8) for t in texts[a:b]]
            lengths = np.fromiter(map(len, codes), np.int64, b - a)
            ids = np.concatenate(codes).astype(np.intp)
            offset = np.cumsum(lengths) - lengths
            many = np.where(lengths > 0, np.maximum(1, -(-(lengths - OVERLAP) // (WINDOW - OVERLAP))), 0)
            doc = np.repeat(np.arange(b - a), many)
            begin = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * (WINDOW - OVERLAP)
            size = np.minimum(lengths[doc] - begin, WINDOW)
            order = np.argsort(-size, kind="stable")
            found: dict[int, list[tuple[int, int, int, bool]]] = {}
            for s in range(0, len(order), _BATCH_WINDOWS):
                chosen = order[s : s + _BATCH_WINDOWS]
                for w, tags in self.decode(self.emissions(ids, offset[doc[chosen]] + begin[chosen], size[chosen]), size[chosen]):
                    k = chosen[w]
                    cuts = np.flatnonzero(np.diff(np.r_[0, tags, 0]))
                    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        if tags[x]:
                            torn = (x == 0 and begin[k] > 0) or (y == size[k] and begin[k] + size[k] < lengths[doc[k]])
                            found.setdefault(int(doc[k]), []).append((int(begin[k]) + x, int(begin[k]) + y, int(tags[x]), bool(torn)))
            for i, spans in found.items():
                out[a + i] = reconcile(texts[a + i], spans)
        return out


def reconcile(text: str, found: list[tuple[int, int, int, bool]]) -> Spans:
    """One list of disjoint spans from those of all windows, (start, end, kind, whether the window's edge cuts it).

    A cut span gives way to a whole one that it meets, and goes if the window
    that sees more of the place has none there, unless that one's is cut as
    well, for longer than the overlap. Of other spans that meet the longer one
    stays, those of one kind merge. White space at the ends is dropped.
    """
    whole = [s for s in found if not s[3]]
    torn = [s for s in found if s[3]]
    meets = lambda s, t: s[0] < t[1] and t[0] < s[1]
    whole += [s for s in torn if not any(meets(s, t) for t in whole) and any(t is not s and meets(s, t) and t[2] == s[2] for t in torn)]
    out: Spans = []
    for a, b, kind, _ in sorted(whole):
        if out and a < out[-1][1]:
            x, y, k = out[-1]
            out[-1] = (x, max(b, y), k) if k == kind else ((x, y, k) if y - x >= b - a else (a, b, kind))
            continue
        out.append((a, b, kind))
    trimmed = []
    for a, b, kind in out:
        part = text[a:b]
        a, b = a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())
        if a < b:
            trimmed.append((a, b, kind))
    return trimmed


@functools.lru_cache(maxsize=4)
def train(lines: tuple[str, ...], steps: int = STEPS, seed: int = 5) -> Tagger:
    """A tagger fitted to labelled texts made from the lines, by Adam; the same for the same arguments."""
    model, rng = Tagger(seed).frozen(), np.random.default_rng(seed)
    texts = labelled(list(lines), 8000, seed)
    codes = [encode(t).astype(np.intp) for t, _ in texts]
    tags = []
    for (_, spans), c in zip(texts, codes):
        y = np.zeros(len(c), np.intp)
        for a, b, k in spans:
            y[a:b] = k
        tags.append(y)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step in range(1, steps + 1):
        ids, gold = np.empty((LENGTH, BATCH), np.intp), np.empty((LENGTH, BATCH), np.intp)
        for j, i in enumerate(rng.integers(0, len(codes), BATCH).tolist()):
            # a third each from a text's start, its end and anywhere
            s = (0, len(codes[i]) - LENGTH, rng.integers(0, len(codes[i]) - LENGTH + 1))[j % 3]
            ids[:, j], gold[:, j] = codes[i][s : s + LENGTH], tags[i][s : s + LENGTH]
        _, grads = model.loss(ids, gold)
        norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
        rate = float(0.02 * min(1.0, step / 20) * (1 - 0.95 * step / steps))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / float(norm))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def carrier_lines(docs: DataFrame, limit: int = CARRIER_DOCS) -> tuple[str, ...]:
    """Lines without digits and @ from at most limit documents: of each the first CARRIER_LINES that have no more than CARRIER_CHARS characters. Of several texts of one id the least lends its lines; rows with a null id lend none."""
    lines = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda x: ~x.rlike("[0-9@]") & (F.length(x) > 0) & (F.length(x) <= CARRIER_CHARS))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.slice(lines, 1, CARRIER_LINES).alias("lines")).filter("id IS NOT NULL")
    return tuple(x for r in sorted(least_hashed(rows, "id", limit).collect(), key=lambda r: r["id"]) for x in r["lines"])


def find(docs: DataFrame, model: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, kind, value) of each span found; offsets count characters of the whole text.

    Null and empty texts have no span, texts of any length are read to their
    end. A null id is passed on. Each row is read on its own, so that repeated
    rows give repeated spans; an empty table gives no row; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = batch.column(0).to_pylist()
            rows = [(i, a, b, KINDS[k], t[a:b]) for i, t, spans in zip(ids, texts, shared.value.spans(texts)) for a, b, k in spans]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "start", "end", "kind", "value"])

    return spread(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(tidy(run), "doc_id long, start long, end long, kind string, value string")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(carrier_lines(docs)))
