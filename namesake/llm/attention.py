"""A causal self-attention model of subword ids, in numpy.

The probability of the next id is a mixture of distributions over ids. Two of
them belong to the current id: what begins a word after it, and what goes on
with its word; the others are shared. The weights of the mixture come from a
masked attention head over the ids before, the current and the previous id and
the letters of the word so far. So the probability of the id that did follow
needs as many numbers as there are distributions and not one for each id of the
vocabulary, and is still exactly normalised.

A text is scored in windows of ``2 * STRIDE`` ids that overlap by half: the
first half is context only, and each id of the second half is scored, with
at least STRIDE ids to look back on wherever the text has them. All windows of a
batch go through the head together.

Ids beyond the ACTIVE most frequent share two outcomes of the mixture (those
that begin a word and those that don't), times their own share of it. All tables
are bounded by these parameters, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

STRIDE = 16
WIDTH, HIDDEN, MIXTURE = 16, 32, 48
ACTIVE = 2048
#: Letters of a word so far are told apart up to this number.
LETTERS = 32
#: Rare ids share embeddings by remainder.
RARE_ROWS = 64


@dataclass
class Inventory:
    """Active ids and the shares of the others."""

    #: id -> outcome; the last two outcomes are rare ids that begin a word, and others.
    outcome: np.ndarray
    #: id -> row of the input tables.
    row: np.ndarray
    #: Log share of a rare id among the rare of its kind; 0 for active ids.
    rare_log: np.ndarray
    #: id -> it begins a word; by outcome.
    begins: np.ndarray
    outcome_begins: np.ndarray
    #: id -> letters.
    letters: np.ndarray
    rows: int
    outcomes: int
    #: Input row of the start of a text.
    start: int


def inventory(counts: np.ndarray, begins: np.ndarray, letters: np.ndarray, always: list[int], active: int = ACTIVE) -> Inventory:
    size = len(counts)
    ranked = np.argsort(-counts, kind="stable")
    chosen = np.array([*always, *[i for i in ranked[: active + len(always)] if i not in always]][:active])
    outcome = np.where(begins, active, active + 1).astype(np.int32)
    outcome[chosen] = np.arange(len(chosen))
    row = np.where(outcome < active, outcome, active + np.arange(size) % RARE_ROWS).astype(np.int32)
    log = np.zeros(size, np.float64)
    for kind in (active, active + 1):
        rare = outcome == kind
        log[rare] = np.log((counts[rare] + 1.0) / (counts[rare] + 1.0).sum())
    outcome_begins = np.zeros(active + 2, bool)
    outcome_begins[outcome] = begins
    return Inventory(outcome, row, log, begins, outcome_begins, letters, active + RARE_ROWS + 1, active + 2, active + RARE_ROWS)


def tables_from_counts(prev: np.ndarray, nxt: np.ndarray, n: np.ndarray, texts: float, inv: Inventory, steps: int = 20, k: int = MIXTURE) -> dict[str, np.ndarray]:
    """First tables from counts of neighbours: ``prev`` rows, ``nxt`` outcomes.

    ``mix`` comes from expectation maximisation of P(next | previous) as a
    mixture; ``near`` is each row's own distribution of the ids that begin a
    word, and of the others, smoothed by that mixture; ``gate`` weighs them.
    """
    rng = np.random.default_rng(5)
    overall = np.bincount(nxt, n, inv.outcomes) + 0.01
    e = overall * rng.gamma(1.0, size=(k, inv.outcomes))
    e /= e.sum(axis=1, keepdims=True)
    gate = rng.gamma(1.0, size=(inv.rows, k))
    gate /= gate.sum(axis=1, keepdims=True)
    order = np.argsort(prev, kind="stable")
    prev, nxt, n = prev[order], nxt[order], n[order]
    block = 1 << 16
    for _ in range(steps if len(n) else 0):
        up = np.zeros((k, inv.outcomes))
        new = np.zeros((inv.rows, k))
        for a in range(0, len(n), block):
            p, t, w = prev[a : a + block], nxt[a : a + block], n[a : a + block]
            r = gate[p] * e[:, t].T
            r *= (w / np.maximum(r.sum(axis=1), 1e-300))[:, None]
            at = np.flatnonzero(np.diff(p, prepend=-1))
            new[p[at]] += np.add.reduceat(r, at, axis=0)
            by = np.argsort(t, kind="stable")
            at = np.flatnonzero(np.diff(t[by], prepend=-1))
            up[:, t[by][at]] += np.add.reduceat(r[by], at, axis=0).T
        # A little of the overall distribution keeps unseen neighbours possible.
        e = up + 2.0 * overall / overall.sum()
        e /= e.sum(axis=1, keepdims=True)
        mean = new.sum(axis=0) / max(new.sum(), 1e-9)
        gate = new + 2.0 * mean + 1e-3
        gate /= gate.sum(axis=1, keepdims=True)
    near = 8.0 * (gate @ e)
    np.add.at(near, (prev, nxt), n)
    starts = near[:, inv.outcome_begins].sum(axis=1)
    share = starts / near.sum(axis=1)
    near[:, inv.outcome_begins] /= starts[:, None]
    near[:, ~inv.outcome_begins] /= near[:, ~inv.outcome_begins].sum(axis=1, keepdims=True)
    seen = np.bincount(prev, n, inv.rows)
    trust = 0.9 * seen / (seen + 8.0) + 0.05
    table = np.concatenate([(trust * share)[:, None], (trust * (1 - share))[:, None], (1 - trust)[:, None] * gate], axis=1)
    return {"gate": np.log(np.maximum(table, 1e-6)).astype(np.float32), "mix": np.log(e).astype(np.float32), "near": near.astype(np.float32)}


def fresh(tables: dict[str, np.ndarray], inv: Inventory) -> dict[str, np.ndarray]:
    """First parameters; ``near`` stays as counted, the others are trained."""
    rng = np.random.default_rng(7)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {
        "gate": tables["gate"], "mix": tables["mix"].T, "emb": rng.normal(0, 0.7, (inv.rows, WIDTH)),
        "q": normal(WIDTH, WIDTH), "k": normal(WIDTH, WIDTH), "v": normal(WIDTH, WIDTH),
        # A penalty for looking far back.
        "look": -0.1 * np.arange(2 * STRIDE, dtype=float),
        "hv": normal(WIDTH, HIDDEN), "he": normal(WIDTH, HIDDEN), "hb": np.zeros(HIDDEN), "hl": rng.normal(0, 0.3, (LETTERS, HIDDEN)),
        "hp": rng.normal(0, 0.3, (inv.rows, HIDDEN)), "out": np.zeros((HIDDEN, len(tables["mix"]) + 2)),
    }
    return {n: np.ascontiguousarray(x, np.float32) for n, x in p.items()}


_Q = np.arange(STRIDE)[:, None] + STRIDE
_S = np.arange(2 * STRIDE)[None, :]
_BACK = np.clip(_Q - _S, 0, 2 * STRIDE - 1)
_SEEN = _S <= _Q
_FAR = np.float32(-1e9)


@dataclass
class Windows:
    """Windows over texts; arrays have a row for each window."""

    #: Input rows, 2 * STRIDE wide, -1 where the text has nothing.
    rows: np.ndarray
    #: Letters of the word so far, at the second half.
    letters: np.ndarray
    #: Ids to predict, at the second half; -1 for none.
    targets: np.ndarray
    text: np.ndarray

    def pick(self, which: np.ndarray | slice) -> Windows:
        return Windows(self.rows[which], self.letters[which], self.targets[which], self.text[which])


def windows(flat: np.ndarray, sizes: np.ndarray, inv: Inventory, start: bool) -> Windows:
    """Windows over texts whose ids stand end to end.

    Without ``start`` the first id has no predecessor and is not a target.
    """
    sizes = np.asarray(sizes, np.int64)
    first = np.cumsum(sizes) - sizes
    held = inv.letters[flat]
    upto = np.cumsum(held)
    fresh_word = inv.begins[flat]
    fresh_word[first[sizes > 0]] = True
    began = np.maximum.accumulate(np.where(fresh_word, upto - held, 0)) if len(flat) else upto
    so_far = np.minimum(upto - began, LETTERS - 1)
    lengths = np.maximum(0, sizes - (not start))
    per = -(-lengths // STRIDE)
    # Each text in its own stretch: STRIDE places before it, then whole strides.
    stretch = (per + 1) * STRIDE * (per > 0)
    base = np.cumsum(stretch) - stretch
    owner = np.repeat(np.arange(len(sizes)), lengths)
    inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = base[owner] + STRIDE + inner
    size = int(stretch.sum())
    rows, targets, letters = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
    aim = first[owner] + inner + (not start)
    targets[at] = flat[aim]
    before = np.maximum(aim - 1, 0)
    head = start & (inner == 0)
    rows[at] = np.where(head, inv.start, inv.row[flat[before]]) if len(aim) else 0
    letters[at] = np.where(head, 0, so_far[before]) if len(aim) else 0
    text = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    rows, letters, targets = (x.reshape(-1, STRIDE) for x in (rows, letters, targets))
    at = base[text] // STRIDE + number
    return Windows(np.concatenate([rows.take(at, axis=0), rows.take(at + 1, axis=0)], axis=1), letters.take(at + 1, axis=0), targets.take(at + 1, axis=0), text)


#: Exponents up to this one need no shift in 32 bits.
_SAFE = 60.0


def _exp(x: np.ndarray, bound: float, axis: int = -1) -> np.ndarray:
    """Unnormalised softmax weights over an axis, in place of ``x``; ``bound`` is at least the largest exponent."""
    if not bound < _SAFE:
        x -= x.max(axis=axis, keepdims=True)
    return np.exp(x, out=x)


def _longest(x: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))


class Model:
    """``near`` has all input rows; with ``ids`` the other tables have these rows alone, and windows name them by place."""

    def __init__(self, params: dict[str, np.ndarray], near: np.ndarray, inv: Inventory, ids: np.ndarray | None = None) -> None:
        self.p, self.near, self.inv, self.ids = params, near, inv, ids
        self.prepare()

    def prepare(self) -> None:
        p = self.p
        by_id = _exp(p["mix"].copy(), float(max(p["mix"].max(), -p["mix"].min())), axis=0)
        by_id /= by_id.sum(axis=0)
        #: Probability of each outcome under the shared distributions.
        self.by_id = by_id
        scale = p["emb"].dtype.type(1 / np.sqrt(WIDTH))
        # Projections of single ids are tables: what an id asks and says of its own, and what it shows to later ones.
        self.asked = np.concatenate([p["q"] * scale, p["he"]], axis=1)
        self.shown = np.concatenate([p["k"], p["v"]], axis=1)
        self.at_now = p["emb"] @ self.asked
        self.at_now[:, WIDTH:] += p["hb"]
        # The last column sums the weights of attention.
        self.at_here = np.ones((self.inv.rows, 2 * WIDTH + 1), p["emb"].dtype)
        self.at_here[:, :-1] = p["emb"] @ self.shown
        self.far = np.where(_SEEN, p["look"][_BACK], _FAR).astype(p["emb"].dtype)
        # Largest exponents that the two softmaxes can meet; every text has an id to look at.
        self.reach = _longest(self.at_now[:, :WIDTH]) * _longest(self.at_here[:, :WIDTH]) + float(abs(p["look"]).max())
        self.lift = float(abs(p["out"]).sum(axis=0).max()) + float(max(p["gate"].max(), -p["gate"].min()))

    def head(self, w: Windows) -> dict[str, np.ndarray]:
        """The mixture's weights at the second half of each window, not yet divided by their ``total``."""
        p, rows = self.p, w.rows
        here = np.maximum(rows, 0)
        now = here[:, STRIDE:].reshape(-1)
        past = rows[:, STRIDE - 1 : -1]
        past = np.where(past < 0, self.inv.start, past).reshape(-1)
        own, shown = self.at_now.take(now, axis=0), self.at_here.take(here, axis=0)
        q = own[:, :WIDTH].reshape(len(rows), STRIDE, WIDTH)
        a = q @ shown[:, :, :WIDTH].transpose(0, 2, 1)
        a += self.far
        blank = rows[:, 0] < 0
        if blank.any():
            a[blank] += np.where(rows[blank] < 0, _FAR, np.float32(0))[:, None, :]
        _exp(a, self.reach)
        got = a @ shown[:, :, WIDTH:]
        # Places after the end of a text may see nothing; they aren't targets.
        mass = np.maximum(got[:, :, WIDTH:], 1e-30)
        got = (got[:, :, :WIDTH] / mass).reshape(-1, WIDTH)
        h = got @ p["hv"]
        h += own[:, WIDTH:]
        h += p["hp"].take(past, axis=0)
        h += p["hl"].take(w.letters.reshape(-1), axis=0)
        np.tanh(h, out=h)
        g = h @ p["out"]
        g += p["gate"].take(now, axis=0)
        _exp(g, self.lift)
        total = g @ np.ones((g.shape[1], 1), g.dtype)
        return {"here": here, "now": now, "past": past, "q": q, "shown": shown, "a": a, "mass": mass, "got": got, "h": h, "g": g, "total": total}

    def parts(self, c: dict[str, np.ndarray], aim: np.ndarray) -> np.ndarray:
        """The mixture's weights times the probability of ``aim`` under each of its distributions."""
        r = np.empty_like(c["g"])
        own = self.near[c["now"] if self.ids is None else self.ids.take(c["now"]), aim]
        begins = self.inv.outcome_begins[aim]
        np.multiply(c["g"][:, 0], own * begins, out=r[:, 0])
        np.multiply(c["g"][:, 1], own * ~begins, out=r[:, 1])
        np.multiply(c["g"][:, 2:], self.by_id.take(aim, axis=0), out=r[:, 2:])
        return r

    def log_scores(self, w: Windows) -> np.ndarray:
        """Natural log probability of each target; 0 where there is none."""
        out = np.zeros(w.targets.shape)
        for b in range(0, len(out), 256):
            part = w.pick(slice(b, b + 256))
            c = self.head(part)
            ids = np.maximum(part.targets, 0)
            r = self.parts(c, self.inv.outcome[ids].reshape(-1))
            p = (r @ np.ones((r.shape[1], 1), r.dtype) / c["total"]).reshape(ids.shape)
            out[b : b + 256] = np.where(part.targets < 0, 0, np.log(np.maximum(p, 1e-30)) + self.inv.rare_log[ids])
        return out

    def gradients(self, w: Windows) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the batch and the gradient of every parameter."""
        p, inv, c = self.p, self.inv, self.head(w)
        n, dtype = len(w.rows), p["emb"].dtype
        real = (w.targets >= 0).reshape(-1, 1)
        aim = inv.outcome[np.maximum(w.targets, 0)].reshape(-1)
        g, r, h = c["g"], self.parts(c, aim), c["h"]
        k = g.shape[1]
        chance = np.maximum(r @ np.ones((k, 1), dtype), 1e-30)
        weight = real * dtype.type(1 / max(1, real.sum()))
        loss = float(-(np.log(chance / c["total"]) * weight).sum())
        r *= weight / chance
        g *= weight / c["total"]
        d: dict[str, np.ndarray] = {}
        used = _sum_rows(r, aim, inv.outcomes)[:, 2:]
        d["mix"] = self.by_id * used.sum(axis=0)
        d["mix"] -= used
        # From here on ``g`` is the gradient of the exponents.
        g -= r
        d["out"] = h.T @ g
        flat = g @ p["out"].T
        flat *= 1 - h * h
        d["hv"] = c["got"].T @ flat
        d["hb"] = flat.sum(axis=0)
        d["hl"] = (w.letters.reshape(-1) == np.arange(LETTERS)[:, None]).astype(dtype) @ flat
        dgot = flat @ p["hv"].T
        a = c["a"]
        a /= c["mass"]
        inner = np.einsum("ij,ij->i", dgot, c["got"]).reshape(n, STRIDE, 1)
        dgot = dgot.reshape(n, STRIDE, WIDTH)
        ds = dgot @ c["shown"][:, :, WIDTH:-1].transpose(0, 2, 1)
        ds -= inner
        ds *= a
        d["look"] = np.bincount(_BACK.reshape(-1), ds.sum(axis=0).reshape(-1), 2 * STRIDE).astype(dtype)
        # At the current ids: what the projections ``asked`` receive; at all ids: ``shown``.
        asked = np.empty((n, STRIDE, WIDTH + HIDDEN), dtype)
        np.matmul(ds, c["shown"][:, :, :WIDTH], out=asked[:, :, :WIDTH])
        asked[:, :, WIDTH:] = flat.reshape(n, STRIDE, HIDDEN)
        shown = np.empty((n, 2 * STRIDE, 2 * WIDTH), dtype)
        np.matmul(ds.transpose(0, 2, 1), c["q"], out=shown[:, :, :WIDTH])
        np.matmul(a.transpose(0, 2, 1), dgot, out=shown[:, :, WIDTH:])
        asked, here = asked.reshape(-1, WIDTH + HIDDEN), c["here"].reshape(-1)
        to_asked = p["emb"].take(c["now"], axis=0).T @ asked
        d["q"], d["he"] = to_asked[:, :WIDTH] * dtype.type(1 / np.sqrt(WIDTH)), to_asked[:, WIDTH:]
        to_shown = p["emb"].take(here, axis=0).T @ shown.reshape(-1, 2 * WIDTH)
        d["k"], d["v"] = to_shown[:, :WIDTH], to_shown[:, WIDTH:]
        at_here = shown @ self.shown.T
        at_here[:, STRIDE:] += (asked @ self.asked.T).reshape(n, STRIDE, WIDTH)
        d["emb"] = _sum_rows(at_here.reshape(-1, WIDTH), here, inv.rows)
        # A current id and the previous one of the next place are the same, so both sums are one.
        both = np.zeros((n, STRIDE + 1, k + HIDDEN), dtype)
        both[:, 1:, :k] = g.reshape(n, STRIDE, k)
        both[:, :-1, k:] = flat.reshape(n, STRIDE, HIDDEN)
        at = c["here"][:, STRIDE - 1 :].copy()
        at[:, 0] = c["past"][::STRIDE]
        gone = w.rows[:, STRIDE:-1] < 0
        if gone.any():
            # No target follows these places, so nothing stands there.
            at[:, 1:-1][gone] = inv.start
        both = _sum_rows(both.reshape(-1, k + HIDDEN), at.reshape(-1), inv.rows)
        d["gate"], d["hp"] = both[:, :k], both[:, k:]
        return loss, d


def _sum_rows(x: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``x`` by the row of the result that ``at`` names.

    Of few columns each is added up by itself; else neighbours in sorted order are added in pairs.
    """
    if x.shape[1] <= 16:
        out, at = np.zeros((x.shape[1], size), x.dtype), at.astype(np.intp)
        for total, column in zip(out, np.ascontiguousarray(x.T)):
            np.add.at(total, at, column)
        return out.T
    order = np.argsort(at.astype(np.uint16) if size < 1 << 16 else at, kind="stable")
    key = at.take(order)
    start = np.flatnonzero(np.diff(key, prepend=-1))
    rank = np.arange(len(key)) - np.repeat(start, np.diff(start, append=len(key)))
    x, most = x.take(order, axis=0), int(rank.max(initial=0))
    while most:
        odd = (rank & 1).astype(bool)
        second, first = np.flatnonzero(odd), np.flatnonzero(~odd)
        more = x.take(second, axis=0)
        x = x.take(first, axis=0)
        # All earlier seconds are gone by now.
        x[second - 1 - np.arange(len(second))] += more
        rank, most = rank.take(first) >> 1, most >> 1
    out = np.zeros((size, x.shape[1]), x.dtype)
    out[key.take(start)] = x
    return out


def _adam(x: np.ndarray, m: np.ndarray, s: np.ndarray, g: np.ndarray, rate: float | np.ndarray) -> None:
    """A step of ``x``; ``m`` and ``s`` are the running means without their factors 0.1 and 0.01."""
    m *= 0.9
    m += g
    t = g * g
    s *= 0.99
    s += t
    np.sqrt(s, out=t)
    t += _LEAST
    np.divide(m, t, out=t)
    t *= rate
    x -= t


_LEAST = 1e-7


def _even(step: np.ndarray | int) -> np.ndarray:
    """What the running means lack in their first steps."""
    return np.sqrt(1 - 0.99**step) / (1 - 0.9**step)


class Trainer:
    """Adam on batches of windows.

    A batch meets few input rows, and its model holds these alone. Without a gradient a row goes on by what its running
    means say; all these steps are made in one sum when the row is next met, or at the end.
    """

    RATE = {"gate": 0.02, "mix": 0.02}
    #: Tables of input rows, which stand side by side.
    BY_ROW = ("gate", "hp", "emb")
    #: Parameters stepped together, so that they stay in the cache.
    BLOCK = 1 << 14
    #: Of one step to the next, how much less a row moves that is not met; steps after which ``_even`` is 1.
    SLOWER, UNEVEN = 0.9 / np.sqrt(0.99), 4096

    def __init__(self, params: dict[str, np.ndarray], near: np.ndarray, inv: Inventory, rate: float = 0.01, batch: int = 256) -> None:
        self.near, self.inv, self.rate, self.batch = near, inv, rate, batch
        ends = np.cumsum([0, *[params[name].shape[1] for name in self.BY_ROW]]).tolist()
        self.columns = {name: slice(a, b) for name, a, b in zip(self.BY_ROW, ends, ends[1:])}
        self.by_row = np.concatenate([params[name] for name in self.BY_ROW], axis=1)
        self.row_rate = np.empty(ends[-1], np.float32)
        for name, span in self.columns.items():
            self.row_rate[span] = self.RATE.get(name, rate)
        self.row_m, self.row_s = np.zeros_like(self.by_row), np.zeros_like(self.by_row)
        #: Step up to which each row has gone.
        self.gone = np.zeros(len(self.by_row), np.int64)
        self.p = {name: x.copy() for name, x in params.items() if name not in self.columns}
        self.m = {name: np.zeros_like(x) for name, x in self.p.items()}
        self.s = {name: np.zeros_like(x) for name, x in self.p.items()}
        # Sums of _even(u) * SLOWER ** (u - t) over all steps u after t.
        self.later = np.empty(self.UNEVEN)
        after = self.SLOWER / (1 - self.SLOWER)
        for t in range(self.UNEVEN - 1, -1, -1):
            after = self.SLOWER * (_even(t + 1) + after)
            self.later[t] = after
        self.step, self.losses, self.windows = 0, [], 0

    def _rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """These rows and their running means after the steps so far."""
        x, m, s, gone = (t.take(ids, axis=0) for t in (self.by_row, self.row_m, self.row_s, self.gone))
        gap = self.step - gone
        last = self.UNEVEN - 1
        sums = self.later[np.minimum(gone, last)] - self.SLOWER**gap * self.later[min(self.step, last)]
        t = np.sqrt(s)
        t += _LEAST
        np.divide(m, t, out=t)
        t *= sums.astype(np.float32)[:, None]
        t *= self.row_rate
        x -= t
        m *= (0.9**gap).astype(np.float32)[:, None]
        s *= (0.99**gap).astype(np.float32)[:, None]
        return x, m, s

    def params(self) -> dict[str, np.ndarray]:
        """All parameters after the steps so far."""
        x, _, _ = self._rows(np.arange(len(self.by_row)))
        return {**self.p, **{name: np.ascontiguousarray(x[:, span]) for name, span in self.columns.items()}}

    def learn(self, flat: np.ndarray, sizes: np.ndarray, seed: int = 3) -> None:
        """Steps over all windows of whole texts."""
        w = windows(flat, sizes, self.inv, start=True)
        order = np.random.default_rng(seed + self.step).permutation(len(w.rows))
        place = np.empty(self.inv.rows, np.int32)
        for b in range(0, len(order), self.batch):
            part = w.pick(order[b : b + self.batch])
            met = np.zeros(self.inv.rows, bool)
            met[part.rows[part.rows >= 0]] = met[self.inv.start] = True
            ids = np.flatnonzero(met)
            place[ids] = np.arange(len(ids))
            part.rows = np.where(part.rows < 0, -1, place.take(part.rows, mode="wrap"))
            x, m, s = self._rows(ids)
            known = replace(self.inv, rows=len(ids), start=int(place[self.inv.start]))
            loss, d = Model({**self.p, **{name: x[:, span] for name, span in self.columns.items()}}, self.near, known, ids).gradients(part)
            self.losses.append(loss)
            self.step += 1
            self.windows += len(part.rows)
            even = float(_even(self.step))
            _adam(x, m, s, np.concatenate([d.pop(name) for name in self.BY_ROW], axis=1), self.row_rate * np.float32(even))
            self.by_row[ids], self.row_m[ids], self.row_s[ids], self.gone[ids] = x, m, s, self.step
            for name, g in d.items():
                tables = [t.reshape(-1) for t in (self.p[name], self.m[name], self.s[name], g)]
                for a in range(0, g.size, self.BLOCK):
                    _adam(*[t[a : a + self.BLOCK] for t in tables], self.RATE.get(name, self.rate) * even)
