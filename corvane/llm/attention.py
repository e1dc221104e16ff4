"""A small causal self-attention model over subword ids, trained and applied in numpy.

An id either begins a word or goes on with one. P(id | ids before) = P(begins or goes on) * P(class | that) * P(id | class):
the first two come from one attention layer over a window, the last from how often the corpus has the id after ids of the
one before's cell. Ids are grouped into classes by what stands before and after them in the whole corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, OVERLAP = 32, 4
DIM, CLASSES = 16, 64
#: Cells of the hashed ids before an id, and of those around it by which ids are grouped; weight of the counts without cells.
CELLS, NEIGHBOURS, PRIOR = 256, 32, 20
BATCH = 64
#: Where windows are many, a step of training takes up to LARGEST times as many, if that leaves LARGE_STEPS steps.
LARGEST, LARGE_STEPS = 4, 300


@dataclass
class Attention:
    begins: np.ndarray  # whether an id begins a word
    classes: np.ndarray  # of each id among those that begin, or don't
    counts: np.ndarray  # of each id in the corpus
    ids: np.ndarray  # what an id adds to its class's embedding
    of_class: np.ndarray  # (2, CLASSES, DIM)
    places: np.ndarray
    qkv: np.ndarray
    out: np.ndarray
    head: np.ndarray  # (2, DIM, CLASSES)
    bias: np.ndarray  # (2, CLASSES)
    start: np.ndarray  # (DIM + 1,) for the chance that a word begins

    def group(self) -> np.ndarray:
        return self.classes + CLASSES * self.begins

    def embedded(self) -> np.ndarray:
        return self.ids + self.of_class[self.begins.astype(int), self.classes]

    def forward(self, window: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of (windows, places) ids: input, queries, keys, values, attention weights, mixed values and output."""
        t = window.shape[1]
        x = table[window]
        x += self.places[:t]
        q, k, v = np.split((x.reshape(-1, DIM) @ self.qkv).reshape(*window.shape, -1), 3, axis=-1)
        a = q @ k.transpose(0, 2, 1)
        a *= np.float32(DIM**-0.5)
        np.clip(a, -40, 40, out=a)
        np.exp(a, out=a)
        a *= np.tri(t, dtype=np.float32)  # no place looks ahead
        scale = 1 / a.sum(-1, keepdims=True)
        mixed = (a @ v) * scale
        y = x + (mixed.reshape(-1, DIM) @ self.out).reshape(x.shape)
        return x, q, k, v, a, scale, mixed, y

    def logs(self, sequence: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For each id of the texts (one after the other): log P(class | begins or not), and the log odds that a word begins there. Windows overlap; each id is scored once, in batches of masked attention."""
        firsts = np.cumsum(lengths) - lengths
        inputs = np.empty_like(sequence)
        inputs[1:] = sequence[:-1]
        inputs[firsts] = end
        step = WINDOW - OVERLAP
        n_windows = 1 + np.maximum(0, -(-(lengths - WINDOW) // step))
        of = np.repeat(np.arange(len(lengths)), n_windows)
        number = np.arange(len(of)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        chosen, odds = np.zeros(len(sequence), np.float32), np.zeros(len(sequence), np.float32)
        table, mask, ones = self.embedded(), np.tri(WINDOW, dtype=np.float32), np.ones(WINDOW, np.float32)
        qkv = self.qkv.copy()
        qkv[:, :DIM] *= np.float32(DIM**-0.5)
        scale, classes = np.exp(self.bias), self.classes.astype(np.int32)
        weights_safe, logits_safe = self._bounded(table)
        # The first windows score all their places; a later one not those that the window before has scored.
        for rows, skip in ((np.flatnonzero(number == 0), 0), (np.flatnonzero(number > 0), OVERLAP)):
            for a in range(0, len(rows), BATCH):
                doc = of[rows[a : a + BATCH]]
                place = number[rows[a : a + BATCH], None] * step + np.arange(WINDOW)
                inside = place < lengths[doc][:, None]
                at = firsts[doc][:, None] + np.where(inside, place, 0)
                x = table.take(inputs[at], 0)
                x += self.places
                q, k, v = np.split((x.reshape(-1, DIM) @ qkv).reshape(*at.shape, -1), 3, axis=-1)
                weights = q @ k.transpose(0, 2, 1)
                if not weights_safe:
                    np.clip(weights, -40, 40, out=weights)
                np.exp(weights, out=weights)
                weights *= mask  # no place looks ahead
                mixed = (weights @ v).reshape(-1, DIM)
                mixed /= (weights.reshape(-1, WINDOW) @ ones)[:, None]
                y = x.reshape(-1, DIM) + mixed @ self.out
                if skip:
                    y, at, inside = y.reshape(*at.shape, DIM)[:, skip:].reshape(-1, DIM), at[:, skip:], inside[:, skip:]
                at = at.ravel()
                if not inside.all():
                    some = np.flatnonzero(inside.ravel())
                    y, at = y.take(some, 0), at[some]
                odds[at] = y @ self.start[:DIM] + self.start[DIM]
                target = sequence[at]
                half = self.begins[target]
                for side in (0, 1):
                    some = np.flatnonzero(half == bool(side))
                    logits = y.take(some, 0) @ self.head[side]
                    if not logits_safe:
                        np.clip(logits, -80, 80, out=logits)
                    wanted = classes[target[some]]
                    won = logits.ravel().take(wanted + np.arange(0, len(some) * CLASSES, CLASSES)) + self.bias[side].take(wanted)
                    np.exp(logits, out=logits)
                    chosen[at[some]] = won - np.log(logits @ scale[side])
        return chosen, odds

    def _bounded(self, table: np.ndarray) -> tuple[bool, bool]:
        """Whether no exponent of an attention weight, and of a class, can be too large, by the norms of what they are products of."""
        norm = lambda m: float(np.linalg.norm(m, 2))
        largest = float(np.sqrt((table**2).sum(1).max()) + np.sqrt((self.places**2).sum(1).max()))
        q, k, v = (norm(x) for x in np.split(self.qkv, 3, axis=1))
        head = float(np.sqrt((self.head**2).sum(1).max()))
        return largest**2 * q * k * DIM**-0.5 < 40, largest * (1 + v * norm(self.out)) * head < 80


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def cells(ids: np.ndarray, n: int) -> np.ndarray:
    return (ids.astype(np.int64) * 2654435761 >> 7) % n


def neighbours(sequence: np.ndarray) -> np.ndarray:
    """Sorted numbers of the places of tables that the ids of a text count in: each id's row has CELLS cells for the id before it and NEIGHBOURS for the one after."""
    kind = np.int32 if (int(sequence.max(initial=0)) + 1) * (CELLS + NEIGHBOURS) < 1 << 31 else np.int64  # narrow numbers sort in half the time
    here = sequence.astype(kind) * kind(CELLS + NEIGHBOURS)
    return np.sort(np.concatenate([here[1:] + cells(sequence[:-1], CELLS).astype(kind), here[:-1] + kind(CELLS) + cells(sequence[1:], NEIGHBOURS).astype(kind)]))


def after_cells(table: np.ndarray, counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """log P(id | class, cell of the id before): (vocabulary, CELLS). table: counts, as `neighbours` lays them out."""
    n = counts + 0.5  # half a count is added to every id
    within = n / np.bincount(group, weights=n)[group]
    before = table[:, :CELLS]
    total = np.zeros((group.max() + 1, CELLS))
    np.add.at(total, group, before)
    return np.log((before + PRIOR * within[:, None]) / (total[group] + PRIOR)).astype(np.float32)


def group_ids(table: np.ndarray, begins: np.ndarray, end: int, seed: int = 5) -> np.ndarray:
    """Class of each id by k-means on what stands around it, apart for ids that begin a word and others. Class 0 of those that begin is the end's; the last classes are of ids never seen."""
    rng = np.random.default_rng(seed)
    around = np.concatenate([table[:, :CELLS].reshape(len(table), -1, NEIGHBOURS).sum(1), table[:, CELLS:]], 1)
    weight = around.sum(1).astype(np.float64)
    rows = np.sqrt(around / np.maximum(weight, 1)[:, None])
    classes = np.full(len(table), CLASSES - 1)
    for side in (False, True):
        own = np.flatnonzero((begins == side) & (weight > 0))
        if not len(own):
            continue
        k = CLASSES - 2
        frequent = own[np.argsort(-weight[own], kind="stable")[: max(k, 4000)]]
        centre = rows[frequent[:k]] + rng.normal(0, 1e-6, (min(k, len(frequent)), rows.shape[1]))
        for _ in range(12):
            near = (2 * rows[frequent] @ centre.T - (centre**2).sum(1)).argmax(1)
            for c in range(len(centre)):
                mine = frequent[near == c]
                if len(mine):
                    centre[c] = np.average(rows[mine], axis=0, weights=weight[mine])
        classes[own] = 1 + (2 * rows[own] @ centre.T - (centre**2).sum(1)).argmax(1)
    classes[end] = 0
    return classes


def untrained(counts: np.ndarray, table: np.ndarray, begins: np.ndarray, end: int, seed: int = 9) -> Attention:
    """counts: of each id in the corpus, table: its neighbours."""
    rng = np.random.default_rng(seed)
    classes = group_ids(table, begins, end)
    n = counts + 0.5
    f = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    of_class = rng.normal(0, 0.5, (2, CLASSES, DIM)).astype(np.float32)
    prior = np.log(np.stack([np.bincount(classes[begins == s], weights=n[begins == s], minlength=CLASSES) + 0.5 for s in (False, True)]))
    bias = (prior - np.log(np.exp(prior).sum(1))[:, None]).astype(np.float32)
    share = n[begins].sum() / n.sum()
    start = np.concatenate([np.zeros(DIM), [np.log(share / (1 - share))]]).astype(np.float32)
    head = (0.1 * rng.normal(0, DIM**-0.5, (2, DIM, CLASSES))).astype(np.float32)
    return Attention(begins, classes, counts, np.zeros((len(counts), DIM), np.float32), of_class, np.zeros((WINDOW, DIM), np.float32), f(DIM, 3 * DIM), f(DIM, DIM), head, bias, start)


LAYER = ("of_class", "places", "qkv", "out", "head", "bias", "start")


def train(m: Attention, sequence: np.ndarray, least_steps: int = 150, rate: float = 0.02, seed: int = 9) -> tuple[Attention, np.ndarray, int]:
    """A copy of m trained on the ids of texts, each after the end id; how often each id was met, and the steps made. Adam on the layer, Adagrad on the ids' own embeddings; the windows are gone through once, or as often as the least number of steps asks for. Steps take more windows where there are many."""
    rng = np.random.default_rng(seed)
    m = Attention(**{**vars(m), "ids": m.ids.copy()})
    met = np.zeros(len(m.begins), np.int64)
    n = (len(sequence) - 1) // WINDOW
    if n < 1:
        return m, met, 0
    batch = BATCH * max(1, min(LARGEST, n // (BATCH * LARGE_STEPS)))
    steps = max(least_steps, -(-n // batch))
    order = np.concatenate([rng.permutation(n) for _ in range(-(-steps * batch // n))])
    # The layer's values and gradients are parts of one row each.
    layer, slope = flattened(m), np.zeros(sum(getattr(m, k).size for k in LAYER), np.float32)
    first, second, grads, at = np.zeros_like(layer), np.zeros_like(layer), {}, 0
    for k in LAYER:
        shape, size = getattr(m, k).shape, getattr(m, k).size
        setattr(m, k, layer[at : at + size].reshape(shape))
        grads[k], at = slope[at : at + size].reshape(shape), at + size
    squares = np.full(len(m.begins), 1e-3, np.float32)
    # Ids by class, so that those of a class lie together where ids are sorted.
    group = m.group()
    by_class = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.uint16 if len(group) <= 1 << 16 else np.int32)
    place[by_class] = np.arange(len(group))
    own, classes, c = group[by_class], m.classes.astype(np.int64), np.float32(DIM**-0.5)
    mask, tokens = np.tri(WINDOW, dtype=np.float32), batch * WINDOW
    wide, long = np.ones(CLASSES, np.float32), np.ones(WINDOW, np.float32)
    dqkv = np.empty((batch, WINDOW, 3 * DIM), np.float32)
    logits, dsided = np.empty((tokens, CLASSES), np.float32), np.empty((tokens, DIM), np.float32)
    rows, back, qkv = np.arange(0, tokens * CLASSES, CLASSES), np.empty(tokens, np.int64), np.empty_like(m.qkv)
    flat = lambda z: z.reshape(-1, z.shape[-1])
    for step in range(1, steps + 1):
        at = order[(step - 1) * batch : step * batch, None] * WINDOW + np.arange(WINDOW + 1)
        ids = sequence[at]
        window, target = ids[:, :-1].ravel(), ids[:, 1:].ravel()
        x = m.ids.take(window, 0)
        x += flat(m.of_class).take(group.take(window), 0)
        x = x.reshape(batch, WINDOW, DIM)
        x += m.places
        qkv[:] = m.qkv
        qkv[:, :DIM] *= c
        q, k, v = np.split((flat(x) @ qkv).reshape(batch, WINDOW, -1), 3, axis=-1)
        p = q @ k.transpose(0, 2, 1)
        np.clip(p, -40, 40, out=p)
        np.exp(p, out=p)
        p *= mask  # no place looks ahead
        p *= (1 / (flat(p) @ long)).reshape(batch, WINDOW, 1)
        mixed = flat(p @ v)
        y = mixed @ m.out
        y += flat(x)
        half = m.begins.take(target)
        wrong = 1 / (1 + np.exp(-np.clip(y @ m.start[:DIM] + m.start[DIM], -40, 40)))
        wrong = ((wrong - half) / tokens).astype(np.float32)
        by_side = np.argsort(half, kind="stable")
        back[by_side] = np.arange(tokens)
        sided, wanted, cut = y.take(by_side, 0), classes.take(target.take(by_side)), tokens - np.count_nonzero(half)
        for side, some in ((0, slice(0, cut)), (1, slice(cut, tokens))):  # targets that go on with a word come first
            d, given = logits[some], sided[some]
            np.matmul(given, m.head[side], out=d)
            d += m.bias[side]
            np.clip(d, -80, 80, out=d)
            np.exp(d, out=d)
            total = d @ wide
            d.ravel()[wanted[some] + rows[: len(d)]] -= total
            share = 1 / (total * np.float32(tokens))  # what d is to be multiplied by
            np.matmul(d, m.head[side].T, out=dsided[some])
            dsided[some] *= share[:, None]
            given *= share[:, None]
            grads["head"][side], grads["bias"][side] = (d.T @ given).T, share @ d
        dy = dsided.take(back, 0)
        dy += wrong[:, None] * m.start[:DIM]
        grads["start"][:DIM], grads["start"][DIM] = wrong @ y, wrong.sum()
        grads["out"][:] = mixed.T @ dy
        dmixed = dy @ m.out.T
        inner = (dmixed * mixed) @ np.ones(DIM, np.float32)
        dmixed = dmixed.reshape(batch, WINDOW, DIM)
        ds = dmixed @ v.transpose(0, 2, 1)
        ds -= inner.reshape(batch, WINDOW, 1)
        ds *= p
        np.matmul(ds, k, out=dqkv[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., DIM : 2 * DIM])
        np.matmul(p.transpose(0, 2, 1), dmixed, out=dqkv[..., 2 * DIM :])
        dx = dy
        dx += flat(dqkv) @ qkv.T
        grads["places"][:], grads["qkv"][:] = dx.reshape(batch, WINDOW, DIM).sum(0), flat(x).T @ flat(dqkv)
        grads["qkv"][:, :DIM] *= c
        here = place.take(window)
        sort = np.argsort(here, kind="stable")
        here = here.take(sort)
        heads = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
        seen, times = by_class.take(here.take(heads)), np.diff(np.append(heads, tokens))
        g = np.add.reduceat(dx.take(sort, 0), heads, 0)
        kinds = own.take(here.take(heads))
        firsts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
        grads["of_class"][:] = 0
        flat(grads["of_class"])[kinds[firsts]] = np.add.reduceat(g, firsts, 0)
        now = rate * min(1, step / 20) * (1 - 0.9 * step / (steps + 1))
        first += np.float32(0.1) * (slope - first)
        second += np.float32(0.01) * (slope * slope - second)
        layer -= np.float32(now / (1 - 0.9**step)) * first / (np.sqrt(second * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))
        squared = squares.take(seen) + (g * g).sum(1)
        squares[seen] = squared
        m.ids[seen] -= np.float32(0.1) * g / np.sqrt(squared)[:, None]
        met[seen] += times
    return m, met, steps


def flattened(m: Attention) -> np.ndarray:
    return np.concatenate([getattr(m, k).ravel() for k in LAYER])


def averaged(m: Attention, layer: np.ndarray, ids: np.ndarray) -> Attention:
    """m with other values of the layer, as `flattened` gives them, and of the ids' embeddings."""
    new, at = {"ids": ids.astype(np.float32)}, 0
    for k in LAYER:
        v = getattr(m, k)
        new[k], at = layer[at : at + v.size].reshape(v.shape).astype(np.float32), at + v.size
    return Attention(**{**vars(m), **new})
