"""An averaged perceptron over string features."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable

import numpy as np


class Perceptron:
    """Multi-class linear model; ``weights`` maps feature -> {class: averaged weight}."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None):
        self.weights = {} if weights is None else weights

    def scores(self, features: Iterable[str]) -> dict[str, float]:
        """Summed weights of each class that any of the features speaks for."""
        out: dict[str, float] = defaultdict(float)
        get = self.weights.get
        for f in features:
            row = get(f)
            if row:
                for c, w in row.items():
                    out[c] += w
        return out

    def predict(self, features: Iterable[str], default: str) -> str:
        """The best class; ``default`` if none scores above it."""
        s = self.scores(features)
        best, most = default, s.get(default, 0.0)
        for c, w in s.items():
            if w > most:
                best, most = c, w
        return best

    @classmethod
    def train(cls, examples: list[tuple[list[str], str]], default: str, epochs: int = 5, seed: int = 7) -> "Perceptron":
        """Fit on (features, class) examples; weights are averaged over all updates."""
        known: dict[str, int] = {}
        classes = list(dict.fromkeys([default, *(truth for _, truth in examples)]))
        number = {c: k for k, c in enumerate(classes)}
        coded = [(np.array([known.setdefault(f, len(known)) for f in features], dtype=np.intp), number[truth]) for features, truth in examples]
        w = np.zeros((len(known), len(classes)))
        total = np.zeros_like(w)  # each change times the step it was made in
        rng, step, order = random.Random(seed), 0, list(range(len(coded)))
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                features, truth = coded[k]
                step += 1
                guess = w.take(features, axis=0).sum(axis=0).argmax()  # the default is the first of equals
                if guess != truth:
                    np.add.at(w, (features, truth), 1.0)
                    np.add.at(w, (features, guess), -1.0)
                    np.add.at(total, (features, truth), step)
                    np.add.at(total, (features, guess), -step)
        # the mean of a weight over all steps: its last value, less each change times the share of steps before it
        total /= max(1, step)
        w -= total
        mean = np.round(w, 4, out=w)
        out: dict[str, dict[str, float]] = {f: {} for f in known}
        names = list(known)
        for f, c in zip(*(x.tolist() for x in np.nonzero(np.abs(mean) > 1e-4))):
            out[names[f]][classes[c]] = float(mean[f, c])
        return cls({f: row for f, row in out.items() if row})
