"""A character tagger: two LSTMs, one read from each end, under a linear-chain CRF. Trained and run with numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: code points below this have a class of their own; others are letters, digits or neither
PLAIN = 128
CLASSES = PLAIN + 3


def classes_of(text: str) -> np.ndarray:
    """A small number for each code point of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = np.minimum(points, PLAIN).astype(np.int16)
    for place in np.flatnonzero(points >= PLAIN).tolist():
        found[place] = PLAIN + (0 if text[place].isalpha() else 1 if text[place].isdigit() else 2)
    return found


def _sigmoid(values: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * values) + 0.5


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + np.squeeze(top, axis)


@dataclass
class Tagger:
    """Weights by name; ``tags`` of them, the first meaning none."""

    weights: dict[str, np.ndarray]
    tags: int
    hidden: int

    @classmethod
    def fresh(cls, tags: int, hidden: int, seed: int) -> Tagger:
        random = np.random.default_rng(seed)

        def table(*shape: int) -> np.ndarray:
            return random.normal(0, 1 / np.sqrt(shape[0] if len(shape) < 2 or shape[0] != CLASSES else 4), shape).astype(np.float32)

        weights = {"out": table(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "moves": np.zeros((tags, tags), np.float32)}
        for side in "lr":
            weights |= {f"in_{side}": table(CLASSES, 4 * hidden), f"state_{side}": table(hidden, 4 * hidden)}
            weights[f"in_{side}"][:, hidden : 2 * hidden] += 1
        return cls(weights, tags, hidden)

    def _read(self, chars: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        size, (count, length) = self.hidden, chars.shape
        into, state = self.weights[f"in_{side}"], self.weights[f"state_{side}"]
        hidden, cell = np.zeros((count, size), np.float32), np.zeros((count, size), np.float32)
        outs, kept = np.empty((length, count, size), np.float32), []
        for at in range(length) if side == "l" else range(length - 1, -1, -1):
            gates = into[chars[:, at]] + hidden @ state
            gates[:, : 3 * size] = _sigmoid(gates[:, : 3 * size])
            gates[:, 3 * size :] = np.tanh(gates[:, 3 * size :])
            before, last = hidden, cell
            cell = gates[:, size : 2 * size] * cell + gates[:, :size] * gates[:, 3 * size :]
            squashed = np.tanh(cell)
            hidden = gates[:, 2 * size : 3 * size] * squashed
            outs[at] = hidden
            if keep:
                kept.append((at, gates, before, last, squashed))
        return outs, kept

    def scores(self, chars: np.ndarray) -> np.ndarray:
        """Tag scores of windows of characters: windows x characters x tags."""
        both = np.concatenate([self._read(chars, side, False)[0] for side in "lr"], axis=2)
        return (both @ self.weights["out"] + self.weights["bias"]).transpose(1, 0, 2)

    def best(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The likeliest tags of stretches of different lengths, given padded scores."""
        count, length, tags = scores.shape
        moves = self.weights["moves"]
        back = np.zeros((count, length, tags), np.int8)
        now = scores[:, 0].copy()
        for at in range(1, length):
            steps = now[:, :, None] + moves
            back[:, at] = steps.argmax(axis=1)
            going = (at < lengths)[:, None]
            now = np.where(going, steps.max(axis=1) + scores[:, at], now)
        paths = []
        for number, size in enumerate(lengths.tolist()):
            path = np.empty(size, np.int8)
            path[-1] = now[number].argmax()
            for at in range(size - 1, 0, -1):
                path[at - 1] = back[number, at, path[at]]
            paths.append(path)
        return paths

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tagged windows, and its gradients."""
        (left, kept_left), (right, kept_right) = (self._read(chars, side, True) for side in "lr")
        both = np.concatenate([left, right], axis=2)
        length, count, _ = both.shape
        scores = both @ self.weights["out"] + self.weights["bias"]
        moves, real = self.weights["moves"], tags.T
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        for at in range(1, length):
            ahead[at] = _logsum(ahead[at - 1][:, :, None] + moves, 1) + scores[at]
        for at in range(length - 2, -1, -1):
            behind[at] = _logsum(moves[None] + (scores[at + 1] + behind[at + 1])[:, None, :], 2)
        total = _logsum(ahead[-1], 1)
        by_score = np.exp(ahead + behind - total[None, :, None])
        rows = np.arange(count)
        by_move = np.zeros_like(moves)
        loss = float(total.sum())
        for at in range(length):
            loss -= float(scores[at, rows, real[at]].sum())
            by_score[at, rows, real[at]] -= 1
            if at:
                pair = ahead[at - 1][:, :, None] + moves + (scores[at] + behind[at])[:, None, :] - total[:, None, None]
                by_move += np.exp(pair).sum(axis=0)
                np.subtract.at(by_move, (real[at - 1], real[at]), 1)
                loss -= float(moves[real[at - 1], real[at]].sum())
        found = {
            "out": np.einsum("tbh,tbk->hk", both, by_score),
            "bias": by_score.sum(axis=(0, 1)),
            "moves": by_move,
        }
        by_out = by_score @ self.weights["out"].T
        for side, kept, part in (("l", kept_left, by_out[:, :, : self.hidden]), ("r", kept_right, by_out[:, :, self.hidden :])):
            found |= self._unread(chars, side, kept, part)
        return loss / count, {name: value / count for name, value in found.items()}

    def _unread(self, chars: np.ndarray, side: str, kept: list, by_out: np.ndarray) -> dict[str, np.ndarray]:
        size, state = self.hidden, self.weights[f"state_{side}"]
        by_in, by_state = np.zeros_like(self.weights[f"in_{side}"]), np.zeros_like(state)
        by_hidden, by_cell = np.zeros_like(by_out[0]), np.zeros_like(by_out[0])
        for at, gates, before, last, squashed in reversed(kept):
            enter, forget, leave, new = (gates[:, n * size : (n + 1) * size] for n in range(4))
            to_hidden = by_out[at] + by_hidden
            to_cell = by_cell + to_hidden * leave * (1 - squashed * squashed)
            by_gates = np.concatenate(
                [to_cell * new * enter * (1 - enter), to_cell * last * forget * (1 - forget), to_hidden * squashed * leave * (1 - leave), to_cell * enter * (1 - new * new)],
                axis=1,
            )
            np.add.at(by_in, chars[:, at], by_gates)
            by_state += before.T @ by_gates
            by_hidden, by_cell = by_gates @ state.T, to_cell * forget
        return {f"in_{side}": by_in, f"state_{side}": by_state}


class Adam:
    """Adam steps over a dictionary of weights. A larger ``floor`` slows weights whose gradients are rare or small."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, floor: float = 1e-8) -> None:
        self.weights, self.rate, self.floor, self.step = weights, rate, floor, 0
        self.first = {name: np.zeros_like(value) for name, value in weights.items()}
        self.second = {name: np.zeros_like(value) for name, value in weights.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
        shrink = min(1.0, 5.0 / (size + 1e-9))
        for name, gradient in gradients.items():
            gradient = gradient * shrink
            self.first[name] += 0.1 * (gradient - self.first[name])
            self.second[name] += 0.001 * (gradient * gradient - self.second[name])
            first, second = self.first[name] / (1 - 0.9**self.step), self.second[name] / (1 - 0.999**self.step)
            self.weights[name] -= (self.rate * first / (np.sqrt(second) + self.floor)).astype(self.weights[name].dtype)
