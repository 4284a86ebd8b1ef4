"""A log-bilinear model of word entries in numpy, trained with noise-contrastive estimation.

The context of a token is the three entries before it and the mean of up to WIDE_SPAN entries before those:
h = sum over i of C_i r[entry i]. Entries lie in groups of equal size; P(entry | h) = P(group | h) P(entry | group, h), and
both factors are normalised exponentials of scores a[group].h + c and q[entry].h + b. So the exact normaliser of a token
takes as many products as there are groups plus entries in one group, not all entries.

Both factors are fitted by noise-contrastive estimation: groups against noise that a batch shares, entries against noise
drawn from their group, each by the unigram distribution.
"""

from __future__ import annotations

import numpy as np

WIDTH = 16
NEAR = 3
WIDE_SPAN = 16
BATCH = 2048
MOST_PASSES = 4
GROUP_NOISE = 24
ENTRY_NOISE = 6
RATE = 0.05
#: What the sums of squared gradients of Adagrad start from.
SQUARE = 1e-6
#: Tokens whose scores of groups are held at once, and batches that are judged at once.
BLOCK, LOT = 2048, 16


def layout(n: int) -> tuple[int, int]:
    """Number of groups and places in a group for n entries."""
    groups = max(1, round(n**0.5))
    return groups, -(-n // groups)


def place(rank: np.ndarray, groups: int, size: int) -> np.ndarray:
    """Entry of each rank: ranks are dealt to the groups in turn, so groups have about equal mass."""
    return rank % groups * size + rank // groups


class Contexts:
    """Places of the tokens of documents that follow one another; `start` is the entry that stands for what is before a document."""

    def __init__(self, entries: np.ndarray, sizes: np.ndarray, start: int):
        self.entries, self.start = np.asarray(entries, np.intp), start
        self.sizes = sizes = np.asarray(sizes, np.int64)
        begin = np.cumsum(sizes) - sizes
        lead = [begin[sizes > k] + k for k in range(NEAR)]  # the tokens that have k before them in their document
        self.before = [np.sort(np.concatenate(lead[: k + 1])) for k in range(NEAR)]  # those whose k + 1st before is none
        few = np.minimum(sizes, NEAR + WIDE_SPAN)  # the other tokens have all WIDE_SPAN of their wide context
        at = np.cumsum(few) - few
        inside = np.arange(few.sum()) - np.repeat(at, few)
        self.share = np.full(len(entries), 1 / WIDE_SPAN, np.float32)
        self.share[np.repeat(begin, few) + inside] = 1 / np.maximum(inside - NEAR, 1)


def window_sums(x: np.ndarray, sizes: np.ndarray, ahead: bool = False) -> np.ndarray:
    """For each row the sum of the WIDE_SPAN rows that end NEAR rows before it, or of those of them that are in its document;
    `ahead` the sum of the rows in whose window it is."""
    reach, n, out = NEAR + WIDE_SPAN, len(x), np.zeros_like(x)
    if n > reach:
        total, k = x, 1
        while k < WIDE_SPAN:  # WIDE_SPAN is a power of two
            total, k = total[k:] + total[:-k], 2 * k
        if ahead:
            out[:-reach] = total[NEAR + 1 :]
        else:
            out[reach:] = total[: n - reach]
    # the rows at the edge of each document
    few = np.minimum(sizes, reach)
    until = np.cumsum(few)
    number = np.arange(until[-1] if len(until) else 0)
    edge = number + np.repeat(np.cumsum(sizes) - (until if ahead else sizes - few + until), few)
    sums = np.zeros((len(edge) + 1, x.shape[1]))
    np.cumsum(x.take(edge, 0), axis=0, dtype=np.float64, out=sums[1:])
    if ahead:
        end = np.repeat(until, few)
        out[edge] = sums.take(end, 0) - sums.take(np.minimum(number + NEAR + 1, end), 0)
    else:
        begin = np.repeat(until - few, few)
        out[edge] = sums.take(np.maximum(number - NEAR, begin), 0) - sums.take(begin, 0)
    return out


class Model:
    """Parameters for groups * size entries and one more row of r for the beginning of a document. `mass` is the unigram
    distribution over entries; places without mass are never predicted."""

    def __init__(self, mass: np.ndarray, groups: int, seed: int = 7):
        self.groups, self.size = groups, len(mass) // groups
        self.mass = mass
        self.of_group = mass.reshape(groups, self.size).sum(1)
        rng = np.random.default_rng(seed)
        some = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        n = len(mass)
        with np.errstate(divide="ignore"):
            b = np.log(mass / np.repeat(self.of_group, self.size))
            c = np.log(self.of_group)
        floor = lambda x: np.maximum(np.nan_to_num(x, nan=-1e4, neginf=-1e4), -1e4).astype(np.float32)
        mix = np.stack([np.eye(WIDTH)] * (NEAR + 1)).astype(np.float32) * np.float32(0.5)
        self.p = {"r": some(n + 1, WIDTH), "q": some(n, WIDTH), "b": floor(b), "a": some(groups, WIDTH), "c": floor(c), "mix": mix}

    def copy(self) -> Model:
        other = object.__new__(Model)
        other.__dict__.update(self.__dict__, p={k: v.copy() for k, v in self.p.items()})
        return other

    def hidden(self, x: Contexts, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The context vector of every token, and the rows it is made of: the near ones and the wide one, side by side (those
        of the last BLOCK tokens, unless all are to be kept)."""
        rows, n = self.p["r"].take(x.entries, 0), len(x.entries)
        wide, start = window_sums(rows, x.sizes), self.p["r"][x.start]
        wide *= x.share[:, None]
        mix = self.p["mix"].transpose(0, 2, 1).reshape(-1, WIDTH)
        held, h = np.empty((n if keep else min(n, BLOCK), (NEAR + 1) * WIDTH), np.float32), np.empty((n, WIDTH), np.float32)
        step = len(held)
        for a in range(0, n, step):
            z = min(a + step, n)
            beside = held[: z - a]
            for k, none in enumerate(x.before, 1):
                part, low = beside[:, (k - 1) * WIDTH : k * WIDTH], max(a, k)
                part[low - a :] = rows[low - k : z - k]
                part[none[slice(*np.searchsorted(none, (a, z)))] - a] = start
            beside[:, NEAR * WIDTH :] = wide[a:z]
            np.matmul(beside, mix, out=h[a:z])
        return h, held

    def log_probs(self, x: Contexts) -> np.ndarray:
        """Natural log of the normalised probability of every token."""
        group = x.entries // self.size
        order = _order(group, self.groups)
        h, entries, group = self.hidden(x)[0].take(order, 0), x.entries.take(order), group.take(order)
        n, at = len(h), entries - group * self.size
        a, c, q, b = self.p["a"], self.p["c"], self.p["q"].reshape(self.groups, self.size, WIDTH), self.p["b"].reshape(self.groups, self.size)
        held, number = np.empty(BLOCK * max(self.groups, self.size), np.float32), np.arange(BLOCK)
        found, totals = c.take(group).astype(np.float64) + self.p["b"].take(entries), np.empty((2, n), np.float32)

        def share(of: slice, rows: np.ndarray, weights: np.ndarray, own: np.ndarray, total: np.ndarray) -> None:
            scores = held[: (of.stop - of.start) * len(rows)].reshape(-1, len(rows))
            np.matmul(h[of], rows.T, out=scores)
            found[of] += scores[number[: len(scores)], own[of]]
            np.exp(scores, out=scores)
            np.matmul(scores, weights, out=total[of])

        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            weights = np.exp(c)
            for k in range(0, n, BLOCK):
                share(slice(k, min(k + BLOCK, n)), a, weights, group, totals[0])
            weights, ends = np.exp(b), np.searchsorted(group, np.arange(self.groups + 1)).tolist()
            for g in range(self.groups):
                for k in range(ends[g], ends[g + 1], BLOCK):
                    share(slice(k, min(k + BLOCK, ends[g + 1])), q[g], weights[g], at, totals[1])
            found -= np.log(totals.astype(np.float64)).sum(0)
        odd = np.flatnonzero(~((totals > 1e-30) & (totals < 1e30)).all(0))  # too near the ends of single precision
        for k in range(0, len(odd), BLOCK):
            of = odd[k : k + BLOCK]
            found[of] = _log_share(h[of] @ a.T + c, group[of])
            for g in np.unique(group[of]).tolist():
                some = of[group[of] == g]
                found[some] += _log_share(h[some] @ q[g].T + b[g], at[some])
        out = np.empty(n)
        out[order] = found
        return out

    def train(self, entries: np.ndarray, sizes: np.ndarray, steps_least: int = 1, seed: int = 11, weights: tuple[float, ...] = ()) -> np.ndarray:
        """Passes over the documents, which follow one another, in batches of BATCH tokens: `steps_least` batches at least,
        but no more than MOST_PASSES passes, since a small corpus is soon learnt by heart.

        In the first pass every batch is judged before it is learnt, LOT batches at once: given back, for each of `weights`,
        is the log likelihood of all tokens if the model is mixed with unigrams at that weight."""
        start = len(self.mass)
        rng = np.random.default_rng(seed)
        squares = {k: np.full_like(v, SQUARE) for k, v in self.p.items()}
        cuts = np.cumsum(sizes)
        pieces, at = [], 0
        while at < len(entries):  # a document that a batch cuts goes on in another without its context
            end = min(at + BATCH, len(entries))
            inside = cuts[np.searchsorted(cuts, at, "right") : np.searchsorted(cuts, end)]
            pieces.append((at, end, np.diff(np.r_[at, inside, end])))
            at = end
        passes = min(MOST_PASSES, -(-steps_least // max(len(pieces), 1)))
        noise = Noise(self)
        fit = np.zeros(len(weights))
        for turn in range(passes):
            order = rng.permutation(len(pieces)).tolist()
            for lot in (order[k : k + LOT] for k in range(0, len(order), LOT)):
                lot = [pieces[k] for k in lot]
                if weights and not turn:
                    own = np.concatenate([entries[a:z] for a, z, _ in lot])
                    logs = self.log_probs(Contexts(own, np.concatenate([lengths for _, _, lengths in lot]), start))
                    fit += mixed_fit(logs, self.mass[own], weights)
                for a, z, lengths in lot:
                    self._step(Contexts(entries[a:z], lengths, start), rng, squares, noise)
        return fit

    def _step(self, x: Contexts, rng, squares: dict, of: Noise) -> None:
        p, n = self.p, len(x.entries)
        h, beside = self.hidden(x, True)
        e, g = x.entries, x.entries // self.size
        by_entry = _order(e, len(self.mass))  # and so by group
        # groups: shared noise
        noise = np.minimum(np.searchsorted(of.group_before, rng.random(GROUP_NOISE) * of.group_before[-1], "right") - 1, self.groups - 1)
        a, c = p["a"], p["c"] - of.group_shift
        own, of_noise = a.take(g, 0), a[noise]
        good = _rise(np.einsum("ij,ij->i", h, own) + c.take(g)) - 1
        bad = _rise(h @ of_noise.T + c[noise])
        d_h = good[:, None] * own + bad @ of_noise
        grad = {"a": np.zeros_like(a), "c": np.bincount(g, good, self.groups).astype(np.float32)}
        at, sums = _row_sums(g.take(by_entry), (good[:, None] * h).take(by_entry, 0))
        grad["a"][at] = sums
        np.add.at(grad["a"], noise, bad.T @ h)
        np.add.at(grad["c"], noise, np.ones(n, np.float32) @ bad)
        # entries: noise from the token's group
        other = of.entries(g, rng)
        own, of_other = p["q"].take(e, 0), p["q"].take(other, 0)
        b = p["b"] - of.shift
        good = _rise(np.einsum("ij,ij->i", h, own) + b.take(e)) - 1
        bad = _rise(np.einsum("ij,ikj->ik", h, of_other) + b.take(other))
        d_h += good[:, None] * own + np.einsum("ik,ikj->ij", bad, of_other)
        rows, pull = np.concatenate([e, other.ravel()]), np.concatenate([good, bad.ravel()])
        grad["b"] = np.bincount(rows, pull, len(self.mass)).astype(np.float32)
        order = _order(rows, len(self.mass))
        values = h.take(of.token(n).take(order), 0)
        values *= pull.take(order)[:, None]
        self._sparse("q", *_row_sums(rows.take(order), values), squares, n)
        # context: what a row gets from the tokens after it is summed before rows of one entry are
        grad["mix"] = (d_h.T @ beside).reshape(WIDTH, NEAR + 1, WIDTH).transpose(1, 0, 2)
        back = d_h @ p["mix"].transpose(1, 0, 2).reshape(WIDTH, -1)
        values = window_sums(back[:, NEAR * WIDTH :] * x.share[:, None], x.sizes, ahead=True)
        first = np.zeros((1, WIDTH), np.float32)
        for k, none in enumerate(x.before, 1):
            part = back[:, (k - 1) * WIDTH : k * WIDTH]
            first += part[none].sum(0)
            part[none] = 0
            values[:-k] += part[k:]
        at, sums = _row_sums(e.take(by_entry), values.take(by_entry, 0))
        self._sparse("r", np.append(at, x.start), np.concatenate([sums, first]), squares, n)
        for k, d in grad.items():
            d = d / n
            squares[k] += d * d
            p[k] -= RATE * d / np.sqrt(squares[k])

    def _sparse(self, name: str, touched: np.ndarray, d: np.ndarray, squares: dict, n: int) -> None:
        """Adagrad on the rows that a batch touches, each given once."""
        d *= np.float32(1 / n)
        total = squares[name].take(touched, 0)
        total += d * d
        squares[name][touched] = total
        d *= np.float32(-RATE)
        d /= np.sqrt(total, out=total)
        d += self.p[name].take(touched, 0)
        self.p[name][touched] = d


class Noise:
    """What the noise of a model's batches is drawn from; it doesn't change with the parameters.

    Entries of a group are drawn by the alias method: each place of the group is as likely as the next and keeps the draw
    with a chance of its own, else hands it to one other place."""

    def __init__(self, model: Model):
        mass, of_group = model.mass, np.maximum(model.of_group, 1e-30)
        self.size, self.tokens = model.size, {}
        self.group_before = np.r_[0, np.cumsum(model.of_group)]
        self.group_shift = np.log(GROUP_NOISE * of_group).astype(np.float32)
        self.shift = np.log(ENTRY_NOISE * np.maximum(mass / np.repeat(of_group, model.size), 1e-30)).astype(np.float32)
        tables = [aliases(m) for m in mass.reshape(model.groups, model.size)]
        self.keep = np.concatenate([keep for keep, _ in tables]).astype(np.float32)
        self.alias = np.concatenate([k * model.size + alias for k, (_, alias) in enumerate(tables)])

    def entries(self, groups: np.ndarray, rng) -> np.ndarray:
        """ENTRY_NOISE entries of each of the groups."""
        draw = rng.random((len(groups), ENTRY_NOISE), np.float32)
        draw *= self.size
        slot = np.minimum(draw.astype(np.intp), self.size - 1)
        draw -= slot
        slot += (groups * self.size)[:, None]
        return np.where(draw < self.keep.take(slot), slot, self.alias.take(slot))

    def token(self, n: int) -> np.ndarray:
        """The token that each entry of a batch of n is for: their own entries, then the noise of each."""
        if n not in self.tokens:
            self.tokens = {n: np.concatenate([np.arange(n), np.repeat(np.arange(n), ENTRY_NOISE)])}
        return self.tokens[n]


def aliases(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keep, alias) of places with these masses: a place drawn evenly is kept with its chance `keep`, or else its alias is taken."""
    n = len(mass)
    keep, alias = np.ones(n), np.arange(n)
    left = (mass * (n / mass.sum()) if mass.sum() > 0 else keep).tolist()
    small, large = [k for k in range(n) if left[k] < 1], [k for k in range(n) if left[k] >= 1]
    while small and large:
        k, other = small.pop(), large[-1]
        keep[k], alias[k] = left[k], other
        left[other] -= 1 - left[k]
        if left[other] < 1:
            small.append(large.pop())
    for k in small:  # by rounding alone
        if mass[k] <= 0 < mass.sum():
            keep[k], alias[k] = 0, int(np.argmax(mass))
    return keep, alias


def mixed_fit(logs: np.ndarray, unigram: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    """For each weight w the sum of log(w * exp(logs) + (1 - w) * unigram). Logs are taken of products of 16."""
    ratio = np.exp(logs) / unigram
    ratio = np.r_[ratio, np.ones(-len(ratio) % 16)].reshape(16, -1)
    return np.log(unigram).sum() + np.array([np.log(np.multiply.reduce(w * ratio + (1 - w), axis=0)).sum() for w in weights])


def _order(rows: np.ndarray, bound: int) -> np.ndarray:
    """Stable order of numbers under `bound`; those of 16 bits are sorted by their digits."""
    return np.argsort(rows.astype(np.uint16) if bound <= 1 << 16 else rows, kind="stable")


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of their values) of sorted rows. Pairs of single numbers are added as complex ones, in half the time."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    if values.ndim == 1:
        return rows[first], np.add.reduceat(values, first)
    return rows[first], np.add.reduceat(values.view(np.complex64), first, axis=0).view(np.float32)


def _rise(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_share(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row the score at `at` less the log of the sum of exponentials."""
    scores = scores.astype(np.float64)
    top = scores.max(1)
    return scores[np.arange(len(at)), at] - top - np.log(np.exp(scores - top[:, None]).sum(1))
