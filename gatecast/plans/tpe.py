"""Tree-structured Parzen estimation: the next trial of a search, from the trials so far.

Trials are split by loss into a few good ones and the rest.  For each parameter
both groups get a density: a mixture of the prior and a normal around each
trial's value, as wide as the distance to its neighbours; for a choice, smoothed
counts.  Candidates are drawn from the good trials' density, and the one with the
highest ratio of the two densities is tried next.  A draw depends on the seed
and on all earlier trials, and on nothing else.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass


@dataclass(frozen=True)
class Uniform:
    """A number between ``low`` and ``high``; with ``log``, exp of one; with ``step``, rounded to a multiple of it."""

    low: float
    high: float
    log: bool = False
    step: float | None = None

    def draw(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)

    def value(self, x: float):
        x = math.exp(x) if self.log else x
        if self.step is None:
            return x
        x = round(x / self.step) * self.step
        return int(x) if float(self.step).is_integer() else x


@dataclass(frozen=True)
class Choice:
    options: tuple

    def draw(self, rng: random.Random) -> int:
        return rng.randrange(len(self.options))

    def value(self, k: int):
        return self.options[k]


Space = dict[str, Uniform | Choice]
STARTUP = 5        # trials drawn from the prior before any density is made
CANDIDATES = 24
GOOD = 0.25        # share of trials taken for good, one at least


def values(space: Space, point: dict) -> dict:
    """The parameters of a point of the space."""
    return {name: kind.value(point[name]) for name, kind in space.items()}


class _Numbers:
    """Mixture of normals, cut off at the ends of the range; the prior is one wide component in the middle."""

    def __init__(self, kind: Uniform, points: list[float]) -> None:
        self.kind, width = kind, kind.high - kind.low
        self.parts = [((kind.low + kind.high) / 2, width)]
        known = sorted(points)
        for k, x in enumerate(known):
            left = x - (known[k - 1] if k else kind.low)
            right = (known[k + 1] if k + 1 < len(known) else kind.high) - x
            self.parts.append((x, min(max(left, right, width / (10 + len(known))), width)))

    def draw(self, rng: random.Random) -> float:
        mean, width = rng.choice(self.parts)
        while True:
            x = rng.gauss(mean, width)
            if self.kind.low <= x <= self.kind.high:
                return x

    def log_density(self, x: float) -> float:
        cdf = lambda v, m, w: 0.5 * (1 + math.erf((v - m) / (w * math.sqrt(2))))
        total = 0.0
        for m, w in self.parts:
            inside = cdf(self.kind.high, m, w) - cdf(self.kind.low, m, w)
            total += math.exp(-0.5 * ((x - m) / w) ** 2) / (w * math.sqrt(2 * math.pi) * inside)
        return math.log(max(total / len(self.parts), 1e-300))


class _Options:
    def __init__(self, kind: Choice, points: list[int]) -> None:
        self.weights = [1 + points.count(k) for k in range(len(kind.options))]

    def draw(self, rng: random.Random) -> int:
        return rng.choices(range(len(self.weights)), self.weights)[0]

    def log_density(self, k: int) -> float:
        return math.log(self.weights[k] / sum(self.weights))


def suggest(space: Space, trials: list[tuple[dict, float]], seed: int) -> dict:
    """The next point to try, after ``trials`` of (point, loss); a loss that is None or not a number counts as worst."""
    rng = random.Random(f"{seed}:{len(trials)}")
    if len(trials) < STARTUP:
        return {name: kind.draw(rng) for name, kind in space.items()}
    worth = [math.inf if loss is None or math.isnan(loss) else loss for _, loss in trials]
    order = sorted(range(len(trials)), key=lambda k: (worth[k], k))
    n_good = max(1, math.ceil(GOOD * math.sqrt(len(trials))))
    good, rest = [trials[k][0] for k in order[:n_good]], [trials[k][0] for k in order[n_good:]]
    point = {}
    for name, kind in space.items():
        model = _Options if isinstance(kind, Choice) else _Numbers
        above, below = model(kind, [t[name] for t in good]), model(kind, [t[name] for t in rest])
        drawn = [above.draw(rng) for _ in range(CANDIDATES)]
        point[name] = max(drawn, key=lambda x: above.log_density(x) - below.log_density(x))
    return point
