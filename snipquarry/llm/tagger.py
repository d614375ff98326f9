"""A small character tagger in numpy: a bidirectional LSTM whose scores a CRF joins to a sequence of tags."""

import numpy as np

PAD, DIGIT, LETTER, OTHER = 0, 1, 2, 3
# Code points below this have a class each (letters by their lower case, digits in one class).
_PLAIN = 128
CLASSES = 4 + _PLAIN


def _classes() -> np.ndarray:
    table = np.zeros(_PLAIN + 1, np.int64)
    for c in range(_PLAIN):
        table[c] = DIGIT if chr(c).isdigit() else 4 + ord(chr(c).lower())
    table[_PLAIN] = LETTER
    return table


_TABLE = _classes()


def encoded(text: str, width: int) -> np.ndarray:
    """Character classes of a text of at most `width` characters, padded."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.full(width, PAD, np.int64)
    out[:len(points)] = _TABLE[np.minimum(points, _PLAIN)]
    return out


class Tagger:
    """Tags 0 (outside), 2k + 1 (first of kind k) and 2k + 2 (further ones)."""

    def __init__(self, kinds: int, hidden=16, seed=0, values=None):
        tags = 2 * kinds + 1
        self.kinds, self.hidden, self.tags = kinds, hidden, tags
        # What may follow: a further tag only after a tag of its own kind.
        allowed = np.ones((tags, tags))
        for k in range(kinds):
            allowed[:, 2 * k + 2] = 0
            allowed[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 1
        self.allowed = allowed
        self.first = np.array([t == 0 or t % 2 == 1 for t in range(tags)], float)
        if values is None:
            rng = np.random.default_rng(seed)
            bias = np.zeros((2, 4 * hidden))
            bias[:, hidden:2 * hidden] = 1  # of the forget gate
            values = {
                "inputs": rng.normal(0, 0.3, (2, CLASSES, 4 * hidden)), "bias": bias,
                "state": rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)),
                "out": rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, tags)), "out_bias": np.zeros(tags),
                "moves": np.zeros((tags, tags)),
            }
        self.values = values

    def plain(self) -> tuple:
        """What another process needs to make the same tagger."""
        return self.kinds, self.hidden, 0, {k: v.astype(np.float32) for k, v in self.values.items()}

    # --- LSTM, both directions at once: axis 0 is the direction, the second reads backwards.

    def _lstm(self, ids: np.ndarray, keep: bool):
        v, size, (many, width) = self.values, self.hidden, ids.shape
        both = np.stack([ids, ids[:, ::-1]])
        kind = v["state"].dtype
        h, c = np.zeros((2, many, size), kind), np.zeros((2, many, size), kind)
        half = np.full(4 * size, 0.5, kind)
        half[3 * size:] = 1
        out, steps = np.empty((width, 2, many, size), kind), []
        tables = v["inputs"] + v["bias"][:, None]
        for t in range(width):
            x = np.stack([tables[d][both[d, :, t]] for d in (0, 1)])
            gates = np.tanh((x + h @ v["state"]) * half)
            # Input, forget and output gates are sigmoids: halves of tanh.
            gates[..., :3 * size] = 0.5 * gates[..., :3 * size] + 0.5
            before, held = c, h
            c = gates[..., size:2 * size] * c + gates[..., :size] * gates[..., 3 * size:]
            squashed = np.tanh(c)
            h = gates[..., 2 * size:3 * size] * squashed
            out[t] = h
            if keep:
                steps.append((gates, before, held, squashed))
        joined = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        return joined, steps, both

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(width, texts, tags)."""
        return self._lstm(ids, False)[0] @ self.values["out"] + self.values["out_bias"]

    # --- CRF

    def _sums(self, emissions):
        """Marginals of tags, of moves, and the log of the sum over all sequences."""
        moves = np.exp(self.values["moves"].astype(float)) * self.allowed
        top = emissions.max(axis=2, keepdims=True)
        e = np.exp((emissions - top).astype(float))
        width, many, tags = e.shape
        forward, scale = np.empty(e.shape), np.empty((width, many))
        for t in range(width):
            a = (e[t] * self.first) if t == 0 else (forward[t - 1] @ moves) * e[t]
            scale[t] = a.sum(axis=1)
            forward[t] = a / scale[t][:, None]
        back = np.ones((many, tags))
        marginals, pairs = np.empty(e.shape), np.zeros((tags, tags))
        for t in range(width - 1, -1, -1):
            marginals[t] = forward[t] * back
            if t:
                weighed = e[t] * back / scale[t][:, None]
                pairs += moves * (forward[t - 1].T @ weighed)
                back = weighed @ moves.T
        return marginals, pairs, (np.log(scale) + top[..., 0]).sum(axis=0)

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best sequence of tags of each row (texts, width), and how sure each of its tags is."""
        emissions = self.emissions(ids)
        marginals = self._sums(emissions)[0]
        with np.errstate(divide="ignore"):
            moves = self.values["moves"] + np.log(self.allowed)
            best = emissions[0] + np.log(self.first)
        width, many, _ = emissions.shape
        came = np.empty((width, many, self.tags), np.int8)
        for t in range(1, width):
            every = best[:, :, None] + moves
            came[t] = every.argmax(axis=1)
            best = every.max(axis=1) + emissions[t]
        tags = np.empty((many, width), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(many)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = came[t][rows, tags[:, t]]
        sure = np.take_along_axis(marginals.transpose(1, 0, 2), tags[:, :, None], 2)[..., 0]
        return tags, sure

    # --- learning

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags (texts, width), and its gradients."""
        v, size, (many, width) = self.values, self.hidden, ids.shape
        states, steps, both = self._lstm(ids, True)
        emissions = states @ v["out"] + v["out_bias"]
        marginals, pairs, total = self._sums(emissions)
        right = tags.T
        onehot = np.zeros(marginals.shape)
        np.put_along_axis(onehot, right[..., None], 1, 2)
        seen = np.zeros((self.tags, self.tags))
        np.add.at(seen, (right[:-1].ravel(), right[1:].ravel()), 1)
        score = (emissions * onehot).sum() + (v["moves"] * seen).sum()
        kind = v["state"].dtype
        d = ((marginals - onehot) / many).astype(kind)
        made = {"moves": ((pairs - seen) * self.allowed / many).astype(kind), "out_bias": d.sum(axis=(0, 1))}
        made["out"] = np.tensordot(states, d, ([0, 1], [0, 1]))
        ds = d @ v["out"].T
        ds = np.stack([ds[..., :size], ds[::-1, :, size:]], axis=1)
        dh, dc = np.zeros((2, many, size), kind), np.zeros((2, many, size), kind)
        da, held = np.empty((width, 2, many, 4 * size), kind), np.empty((width, 2, many, size), kind)
        for t in range(width - 1, -1, -1):
            gates, before, held[t], squashed = steps[t]
            i, f, o, g = (gates[..., k * size:(k + 1) * size] for k in range(4))
            dh = dh + ds[t]
            dc = dc + dh * o * (1 - squashed ** 2)
            da[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g ** 2)], axis=2)
            dh, dc = da[t] @ v["state"].transpose(0, 2, 1), dc * f
        flat = [(da[:, k].reshape(-1, 4 * size), held[:, k].reshape(-1, size), both[k].T.ravel()) for k in (0, 1)]
        made["state"] = np.stack([h.T @ d for d, h, _ in flat])
        made["bias"] = np.stack([d.sum(axis=0) for d, _, _ in flat])
        made["inputs"] = np.zeros_like(v["inputs"])
        for k, (d, _, kinds) in enumerate(flat):
            order = np.argsort(kinds, kind="stable")
            seen, starts = np.unique(kinds[order], return_index=True)
            made["inputs"][k, seen] = np.add.reduceat(d[order], starts)
        return float((total.sum() - score) / many), made

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs=12, batch=128, rate=0.03, seed=0) -> list[float]:
        """Adam steps over all rows in a fixed random order; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        self.values = {k: x.astype(np.float32) for k, x in self.values.items()}
        means = {k: np.zeros_like(x) for k, x in self.values.items()}
        squares = {k: np.zeros_like(x) for k, x in self.values.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            order, found = rng.permutation(len(ids)), []
            for at in range(0, len(ids), batch):
                rows = order[at:at + batch]
                loss, made = self.gradients(ids[rows], tags[rows])
                found.append(loss)
                step += 1
                norm = np.sqrt(sum((g ** 2).sum() for g in made.values()))
                pace = rate * (1 - epoch / epochs * 0.9)
                for k, g in made.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    means[k] = 0.9 * means[k] + 0.1 * g
                    squares[k] = 0.999 * squares[k] + 0.001 * g ** 2
                    self.values[k] -= np.float32(pace) * (means[k] / (1 - 0.9 ** step)) / (np.sqrt(squares[k] / (1 - 0.999 ** step)) + 1e-8)
            losses.append(float(np.mean(found)))
        return losses
