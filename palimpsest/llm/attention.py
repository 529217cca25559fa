"""A small causal self-attention model in numpy: batches of windows forward, and gradients by hand."""

from __future__ import annotations

from copy import copy

import numpy as np

#: Tokens of a window; a window starts every STRIDE tokens, so all but a text's first tokens see at least CONTEXT - STRIDE others.
CONTEXT, STRIDE = 32, 16
#: Windows that are worked on at once: what is known of them stays in a core's cache.
WINDOWS = 32
#: Rows that are multiplied at once where products are summed over rows.
ROWS = 256
#: Scored windows whose tokens' outcomes are worked out together.
TOGETHER = 512


def _rows(m: np.ndarray) -> np.ndarray:
    """Windows x tokens as rows: one product of matrices in place of one for each window."""
    return m.reshape(-1, m.shape[2])


def _turned(m: np.ndarray) -> np.ndarray:
    """The last two axes swapped and laid out anew: small products by a matrix that is only seen turned are slow."""
    return np.ascontiguousarray(m.swapaxes(-1, -2))


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, summed over ROWS rows at a time."""
    n = len(a) - len(a) % ROWS
    out = a[n:].T @ b[n:]
    if n:
        out += (a[:n].reshape(-1, ROWS, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(-1, ROWS, b.shape[1])).sum(0)
    return out


def _tanh(x: np.ndarray) -> np.ndarray:
    """tanh in place."""
    return np.tanh(x, out=x)


class Attention:
    """Symbols in, log-probabilities of the next symbol out.

    x = E[symbol]; one head attends to the window so far, with a learned bias
    for each distance; h = tanh(x A + x' B + a D + b), with x' the symbol before.
    The next symbol's group comes from h G + g, and the symbol among its group
    from h O + o; symbols of a group are neighbours.
    """

    NAMES = ("E", "Q", "K", "V", "R", "A", "B", "D", "b", "G", "g", "O", "o")

    def __init__(self, starts: np.ndarray, counts: np.ndarray, width: int = 24, head: int = 12, hidden: int = 32, seed: int = 11):
        """starts: where each group of symbols starts; counts: how often each symbol was seen, at least a little."""
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.classes = classes = len(counts)
        self.starts = np.r_[starts, classes]
        self.group = np.repeat(np.arange(len(starts)), np.diff(self.starts))
        mass = np.add.reduceat(counts, starts)
        self.p = {
            "E": rng.normal(0, 0.5, (classes, width)).astype(np.float32), "Q": scale(width, head), "K": scale(width, head), "V": scale(width, width), "R": np.linspace(0, -2, CONTEXT, dtype=np.float32),
            "A": scale(width, hidden), "B": scale(width, hidden), "D": scale(width, hidden), "b": np.zeros(hidden, np.float32),
            "G": scale(hidden, len(starts)) * np.float32(0.3), "g": np.log(mass / mass.sum()).astype(np.float32), "O": scale(hidden, classes) * np.float32(0.3), "o": np.log(counts / mass[self.group]).astype(np.float32),
        }
        self._prepare()

    def _prepare(self) -> None:
        i, j = np.indices((CONTEXT, CONTEXT))
        head, hidden = self.p["Q"].shape[1], self.p["b"].shape[0]
        #: Where the parts of the projections end, but the last.
        self.parts = [head, 2 * head, 2 * head + hidden, 2 * head + 2 * hidden]
        self.distance, self.seen = np.clip(i - j, 0, CONTEXT - 1), i >= j

    def copy(self) -> Attention:
        """A model of its own with the same weights."""
        out = copy(self)
        out.p = {k: x.copy() for k, x in self.p.items()}
        return out

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    @flat.setter
    def flat(self, values: np.ndarray) -> None:
        start = 0
        for k in self.NAMES:
            size = self.p[k].size
            self.p[k] = values[start : start + size].reshape(self.p[k].shape).astype(np.float32)
            start += size

    def _projections(self) -> np.ndarray:
        """What a symbol's vector is multiplied by, side by side: query (scaled), key, value (through D), now and before."""
        p = self.p
        return np.hstack([p["Q"] * p["Q"].dtype.type(1 / np.sqrt(p["Q"].shape[1])), p["K"], p["V"] @ p["D"], p["A"], p["B"]])

    def _weights(self) -> tuple:
        """What depends on a symbol alone, as tables by symbol: query, key, value with a one beside it, now (with b), before.  Then the bias by distance, and the most that an attention weight's exponent can be."""
        q, k, v, now, before = np.split(self.p["E"] @ self._projections(), self.parts, axis=1)
        most = np.sqrt(np.einsum("ij,ij->i", q, q).max() * np.einsum("ij,ij->i", k, k).max()) + np.abs(self.p["R"]).max()
        bias = np.where(self.seen, self.p["R"][self.distance], np.float32(-1e9))
        return *map(np.ascontiguousarray, (q, k)), np.hstack([v, np.ones((len(v), 1), v.dtype)]), now + self.p["b"], np.ascontiguousarray(before), bias, most

    def _hidden(self, c: np.ndarray, tables: tuple):
        """c: windows x tokens of symbols."""
        *tables, bias, most = tables
        q, k, v, h, before = (x.take(c, 0) for x in tables)
        w = q @ _turned(k)
        w += bias[: c.shape[1], : c.shape[1]]
        if most > 60:
            np.minimum(w, w.dtype.type(60), out=w)  # in place of a maximum for each row
        np.exp(w, out=w)
        a = w @ v  # its last column is the sum of the weights
        share = 1 / a[:, :, -1:]
        a = a[:, :, :-1] * share
        h += a
        h[:, 1:] += before[:, :-1]
        return q, k, v, w, share, a, _tanh(h)

    def ready(self) -> Attention:
        """For scoring: what depends on a symbol alone becomes a table, and weights that could pass what exp() of a float holds are scaled down."""
        for w, b in (("G", "g"), ("O", "o")):  # h lies between -1 and 1, so these bound every logit
            fit = np.minimum(1, 80 / np.maximum(np.abs(self.p[w]).sum(0) + np.abs(self.p[b]), 1e-9)).astype(np.float32)
            self.p[w], self.p[b] = self.p[w] * fit, self.p[b] * fit
        q, *others, self.bias, most = self._weights()
        self.tables = q * np.float32(60 / most) if most > 60 else q, *others
        self.outcome = self._outcome_weights()
        return self

    def _hidden_by_table(self, c: np.ndarray, first: int = 0) -> np.ndarray:
        """For the places of each window from first on."""
        q, k, v, now, before = self.tables
        w = q.take(c[:, first:], 0) @ _turned(k.take(c, 0))
        w += self.bias[first : c.shape[1], : c.shape[1]]
        np.exp(w, out=w)
        a = w @ v.take(c, 0)  # its last column is the sum of the weights
        h = a[:, :, :-1] * (1 / a[:, :, -1:])
        h += now.take(c[:, first:], 0)
        begin = max(first, 1)
        h[:, begin - first :] += before.take(c[:, begin - 1 : -1], 0)
        return _tanh(h)

    def log_probabilities(self, c: np.ndarray, first: np.ndarray, size: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Of the scored targets, in order, after ready().  c: windows x symbols; t: the symbols that follow; each window's places from first up to size are scored."""
        many = size - first
        begin = np.cumsum(many) - many
        out = np.empty(int(many.sum()), np.float32)
        for f in np.unique(first).tolist():
            chosen, at = np.flatnonzero(first == f), np.arange(f, c.shape[1])
            for i in range(0, len(chosen), TOGETHER):
                part = chosen[i : i + TOGETHER]
                real = at < size[part, None]
                parts = (part[j : j + WINDOWS] for j in range(0, len(part), WINDOWS))
                h = np.concatenate([self._hidden_by_table(c[x].astype(np.intp), f) for x in parts])
                out[(begin[part, None] + at - f)[real]] = self._outcome(h[real], t[part, f:][real].astype(np.intp))
        return out

    def _outcome_weights(self) -> tuple[np.ndarray, np.ndarray]:
        """G over g, and O over o: for rows that end with a one."""
        return np.vstack([self.p["G"], self.p["g"]]), np.vstack([self.p["O"], self.p["o"]])

    def _by_group(self, h: np.ndarray, t: np.ndarray, chosen: np.ndarray | None = None):
        """The rows (chosen ones, or all) in the order of their targets' groups: which row each is, the row and a one, its group, where the target stands among all logits of its group's rows, and (first row, last, first symbol, last) of the groups that are met."""
        groups = self.group.astype(np.uint16).take(t if chosen is None else t.take(chosen))
        order = np.argsort(groups, kind="stable")
        groups, order = groups.take(order).astype(np.intp), order if chosen is None else chosen.take(order)
        rows = np.ones((len(order), h.shape[1] + 1), h.dtype)
        rows[:, :-1] = h.take(order, 0)
        ends = np.searchsorted(groups, np.arange(len(self.starts)))
        place = (np.arange(len(order)) - ends.take(groups)) * np.diff(self.starts).take(groups) + t.take(order) - self.starts.take(groups)
        ends, starts = ends.tolist(), self.starts.tolist()
        spans = [x for x in zip(ends, ends[1:], starts, starts[1:], strict=False) if x[0] < x[1]]
        return order, rows, groups, place, spans

    def _outcome(self, h: np.ndarray, t: np.ndarray) -> np.ndarray:
        top, bottom = self.outcome
        order, h, groups, place, spans = self._by_group(h, t)
        z = h @ top
        got = z.ravel().take(np.arange(len(z)) * z.shape[1] + groups)
        ones = np.ones(z.shape[1] + len(self.group), np.float32)
        total = np.exp(z, out=z) @ ones[: z.shape[1]]
        within = np.empty_like(total)
        for a, b, x, y in spans:
            z = h[a:b] @ bottom[:, x:y]
            got[a:b] += z.ravel().take(place[a:b])
            np.matmul(np.exp(z, out=z), ones[: y - x], out=within[a:b])
        out = np.empty_like(got)
        out[order] = got - np.log(total) - np.log(within)
        return out

    def gradients(self, c: np.ndarray, t: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the real tokens, and its gradients; t: targets.  The attention goes by WINDOWS windows, the softmax over all at once."""
        p, tables, weights = self.p, self._weights(), _turned(self._projections())
        c, t = c.astype(np.intp), t.astype(np.intp)
        runs = [slice(i, i + WINDOWS) for i in range(0, len(c), WINDOWS)]
        states = [self._hidden(c[r], tables) for r in runs]
        loss, g, dh = self._outcome_gradients(np.concatenate([s[-1] for s in states]), t, real)
        sums = [self._hidden_gradients(c[r], s, dh[r], weights) for r, s in zip(runs, states, strict=True)]
        dw, g["b"], bias = (sum(x[i] for x in sums) for i in range(3))
        n = c.shape[1]
        g["R"] = np.bincount(self.distance[:n, :n].ravel(), (bias * self.seen[:n, :n]).ravel(), minlength=CONTEXT).astype(np.float32)
        dq, g["K"], dv, g["A"], g["B"] = np.split(dw, self.parts, axis=1)
        g["Q"] = dq * dq.dtype.type(1 / np.sqrt(dq.shape[1]))
        g["V"], g["D"] = dv @ p["D"].T, p["V"].T @ dv
        dx, flat = np.concatenate([x[3] for x in sums]), c.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat.take(order)
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        g["E"] = np.zeros_like(p["E"])
        g["E"][flat[first]] = np.add.reduceat(dx.take(order, 0), first, axis=0)
        return loss, g

    def _outcome_gradients(self, h: np.ndarray, t: np.ndarray, real: np.ndarray):
        """The loss, its gradients in the weights of the two softmaxes, and in h."""
        p, width = self.p, h.shape[2]
        top, bottom = self._outcome_weights()
        # h lies between -1 and 1, so these bound every logit
        most = [float(np.abs(m).sum(0).max()) for m in (top, bottom)]
        turned = _turned(p["G"]), _turned(p["O"])
        keep, rows, groups, place, spans = self._by_group(_rows(h), t.ravel(), np.flatnonzero(real.ravel()))
        share, ones = h.dtype.type(1 / len(keep)), np.ones(top.shape[1] + bottom.shape[1], h.dtype)

        def soft(z, at, most):
            """Turns logits to their gradient, and gives each row's loss.  at: where the targets stand."""
            if most > 80:
                np.minimum(z, z.dtype.type(80), out=z)  # in place of a maximum for each row
            values = z.reshape(-1)
            got = values.take(at)
            np.exp(z, out=z)
            total = z @ ones[: z.shape[1]]
            total += z.dtype.type(1e-30)
            values[at] -= total
            z *= (share / total)[:, None]
            np.log(total, out=total)
            total -= got
            return total

        z = rows @ top
        loss = soft(z, np.arange(len(z)) * z.shape[1] + groups, most[0]).sum(dtype=float)
        both, over = _crossed(rows, z), np.zeros_like(bottom)
        dk = np.zeros((len(keep) + 1, width), h.dtype)  # and a row of zeros, for tokens that aren't real
        np.matmul(z, turned[0], out=dk[:-1])
        lost = np.empty(len(keep), h.dtype)
        for i, j, x, y in spans:
            z = rows[i:j] @ bottom[:, x:y]
            lost[i:j] = soft(z, place[i:j], most[1])
            over[:, x:y] = rows[i:j].T @ z
            dk[i:j] += z @ turned[1][x:y]
        loss += lost.sum(dtype=float)
        g = {"G": both[:-1], "g": both[-1], "O": over[:-1], "o": over[-1]}
        back = np.full(t.size, len(keep))
        back[keep] = np.arange(len(keep))
        return float(loss * share), g, dk.take(back, 0).reshape(h.shape)

    def _hidden_gradients(self, c: np.ndarray, state, dh: np.ndarray, weights: np.ndarray):
        """Gradients in the projections side by side, in b, in the bias, and in the symbols' vectors, row by row.  weights: the projections, turned."""
        q, k, v, w, share, a, h = state
        width = h.shape[2]
        dh = dh * (1 - h * h)
        da = np.empty_like(v)  # by the weights before they are made to sum up to one; its last column, of their sum, takes away the mean of what each place gets
        np.multiply(dh, share, out=da[:, :, :-1])
        np.einsum("ijk,ijk->ij", da[:, :, :-1], a, out=da[:, :, -1])
        np.negative(da[:, :, -1], out=da[:, :, -1])
        ds = da @ _turned(v)
        ds *= w
        # in the order of the projections
        made = np.empty((*c.shape, weights.shape[0]), h.dtype)
        ends = self.parts
        np.matmul(ds, k, out=made[:, :, : ends[0]])
        np.matmul(ds.transpose(0, 2, 1), q, out=made[:, :, ends[0] : ends[1]])
        np.matmul(w.transpose(0, 2, 1), da[:, :, :width], out=made[:, :, ends[1] : ends[2]])
        made[:, :, ends[2] : ends[3]] = dh
        made[:, :-1, ends[3] :] = dh[:, 1:]
        made[:, -1, ends[3] :] = 0
        made, dh = _rows(made), _rows(dh)
        return _crossed(_rows(self.p["E"].take(c, 0)), made), np.ones(len(dh), dh.dtype) @ dh, ds.sum(0), made @ weights


class Adam:
    """Changes the model's weights, which it takes over, in place."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.t = model, rate, 0
        self.w = model.flat
        self.m, self.v, self.g, self.by = (np.zeros_like(self.w) for _ in range(4))
        ends = np.cumsum([model.p[k].size for k in model.NAMES])
        model.p = {k: x.reshape(model.p[k].shape) for k, x in zip(model.NAMES, np.split(self.w, ends[:-1]), strict=True)}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        g, by = self.g, self.by
        np.concatenate([grads[k].ravel() for k in self.model.NAMES], out=g, casting="same_kind")
        size = np.sqrt(float(g @ g))
        g *= np.float32(min(1.0, 1.0 / max(size, 1e-9)))
        rate = self.rate * min(1.0, self.t / 20) * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        self.m += np.multiply(np.subtract(g, self.m, out=by), np.float32(0.1), out=by)
        np.multiply(g, g, out=g)
        self.v += np.multiply(np.subtract(g, self.v, out=by), np.float32(0.01), out=by)
        np.sqrt(self.v, out=by)
        by += np.float32(1e-8)
        np.divide(self.m, by, out=by)
        self.w -= np.multiply(by, np.float32(rate), out=by)
