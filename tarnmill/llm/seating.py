"""Seating in a hierarchy of Pitman-Yor restaurants, sampled by Gibbs.

Three levels: 0 the root, 1 its children, 2 their children, the leaves. What is kept of a seating is, for every
(restaurant, dish), the customers c and the tables t; the tables of a restaurant are the customers of its parent. A move seats
all customers of a dish anew: it draws the dish's number of tables from its distribution given all the rest, which is made of
generalised Stirling numbers S_d(c, t), the Chinese-restaurant rule and the parent's seating with that many guests. This is the
Gibbs conditional of the whole party, the same for parties of every size. Moves of many dishes are made at once as arrays:
within one such part the moves do not see each other, and the totals of restaurants that other tasks share are those of the
sweep before.

Discounts and strengths are drawn from their conditionals on a grid, which needs sums over restaurants and dishes only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Grids of the discounts and strengths.
DISCOUNTS, STRENGTHS = np.linspace(0.1, 0.95, 18), np.geomspace(0.1, 1e5, 25)
#: Customers and tables up to which Stirling numbers are tabulated; beyond it they are computed from the recursion's limit
#: (more customers) or by a saddle point (more tables). These are numerical means only: the sampler is one for all sizes.
ROWS, COLUMNS = 1024, 192
#: Dishes that are moved at once, at most.
PART = 32_768


@lru_cache(maxsize=32)
def log_stirling(n: int, d: float, most: int | None = None) -> np.ndarray:
    """log of the generalised Stirling numbers S_d(c, t) for c <= n and t <= most; S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)."""
    most = n if most is None else most
    s = np.full((n + 1, most + 1), -np.inf)
    s[0, 0] = 0
    for c in range(n):
        t = np.arange(1, min(c + 1, most) + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c - t * d > 0, np.log(np.maximum(c - t * d, 1e-300)) + s[c, t], -np.inf)
        s[c + 1, t] = np.logaddexp(s[c, t - 1], stay)
    return s


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series after a shift of 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    for k in range(0, 8, 4):
        shift += np.log((x + k) * (x + k + 1) * (x + k + 2) * (x + k + 3))
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r / 1260)) / y - shift


def _mean(y: np.ndarray, d: float) -> np.ndarray:
    """log of the mean of the power series below at 1 - z = e^y: its position for c and t is where that is log(c / t)."""
    return np.log(-np.expm1(y)) + (d - 1) * y + np.log(d) - np.log(-np.expm1(d * y))


@lru_cache(maxsize=32)
def _positions(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Logs of -y in even steps, and of the means there."""
    log = np.linspace(np.log(1e-8), np.log(2000.0), 4097)
    return np.log(_mean(-np.exp(log), d)), log


def _log_coefficient(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log [z^c] ((1 - (1 - z)^d) / d)^t by a saddle point, for c > t; its position is interpolated and made exact by a Newton step."""
    c, t = c.astype(np.float64), t.astype(np.float64)
    m = c / t
    want = np.log(m)
    y = -np.exp(np.interp(np.log(want), *_positions(d)))
    z, w = -np.expm1(y), -np.expm1(d * y)
    y -= (np.log(z * d / w) + (d - 1) * y - want) / (d - 1 - (1 - z) / z + d * (1 - w) / w)
    z, w = -np.expm1(y), -np.expm1(d * y)
    var = m * (1 + z * (1 - d) * np.exp(-y) - m)
    return t * np.log(w / d) - c * np.log(z) - 0.5 * np.log(2 * np.pi * t * np.maximum(var, 1e-300))


@lru_cache(maxsize=32)
def _alone_table(d: float) -> np.ndarray:
    s, out = log_stirling(ROWS, d, COLUMNS), np.zeros((ROWS + 1, COLUMNS + 1), np.float32)
    with np.errstate(invalid="ignore"):
        out[1:, 1:] = np.nan_to_num(np.exp(s[:-1, :-1] - s[1:, 1:]), nan=0.0, posinf=0.0)
    return out


@lru_cache(maxsize=4)
def _step_tables(d: float) -> tuple[np.ndarray, np.ndarray]:
    """log S_d(c, t + 1) - log S_d(c, t) for t < COLUMNS, and log S_d(c + 1, t) - log S_d(c, t) for c < ROWS."""
    p, c, t = _alone_table(d).astype(np.float64), np.arange(ROWS + 1)[:, None], np.arange(COLUMNS + 1)
    p[t == c] = 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        return (np.log1p(-p) - np.log(c - 1 - t * d))[:, :-1] - np.log(p[:, 1:]), np.log(c - t * d)[:-1] - np.log1p(-p[1:])


def _many(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Where the saddle point is the better means: more tables than columns, or tables that are many for the customers."""
    out = (t < c) & (t > COLUMNS)
    k = np.flatnonzero((c > ROWS) & (t > 16) & (t <= COLUMNS))
    out[k] = np.log(t[k]) > d * np.log(c[k])
    return out


def log_s(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) for 1 <= t <= c."""
    out, s = np.zeros(len(c)), log_stirling(ROWS, d, COLUMNS)
    many = _many(c, t, d)
    k = np.flatnonzero(~many & (t <= COLUMNS))
    at = np.minimum(c[k], ROWS)
    out[k] = s[at, t[k]]
    k, at = k[c[k] > ROWS], None
    if len(k):  # S(c + 1, t) = S(c, t) (c - t d) / (1 - P(alone)); c P(alone) goes to (t - 1) d like a power of c
        limit, grown = (t[k] - 1) * d, np.log(c[k] / ROWS)
        first = ROWS * _alone_table(d)[ROWS, t[k]].astype(np.float64)
        singles = limit * grown + (first - limit) * -np.expm1(-d * grown) / d
        out[k] += lgamma(c[k] - t[k] * d) - lgamma(ROWS - t[k] * d) + singles + first * first / 2 * (1 / ROWS - 1 / c[k])
    k = np.flatnonzero(many)
    if len(k):
        out[k] = _log_coefficient(c[k], t[k], d) + lgamma(c[k] + 1.0) - lgamma(t[k] + 1.0)
    return out


def alone(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The probability that one of c customers at t tables sits alone."""
    out = _alone_table(d)[np.minimum(c, ROWS), np.minimum(t, COLUMNS)].astype(np.float64)
    k = np.flatnonzero(c > ROWS)
    limit = (t[k] - 1) * d
    out[k] = (limit + (ROWS * out[k] - limit) * (ROWS / c[k]) ** d) / c[k]
    out[t == c] = 1.0
    k = np.flatnonzero(_many(c, t, d))
    if len(k):
        out[k] = np.minimum(1.0, np.exp(_log_coefficient(c[k] - 1, t[k] - 1, d) - _log_coefficient(c[k], t[k], d)) * t[k] / c[k])
    return out


def one_more_table(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t + 1) - log S_d(c, t), which is (1 - P(alone)) / (c - 1 - t d) / P(alone of c at t + 1)."""
    out = _step_tables(d)[0][np.minimum(c, ROWS), np.minimum(t, COLUMNS - 1)]
    k = np.flatnonzero((c > ROWS) | (t >= COLUMNS))
    if len(k):
        c, t = c[k], t[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[k] = np.log1p(-alone(c, t, d)) - np.log(c - 1 - t * d) - np.log(alone(c, t + 1, d))
    return out


def one_more_customer(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c + 1, t) - log S_d(c, t), which is (c - t d) / (1 - P(alone of c + 1))."""
    out = _step_tables(d)[1][np.minimum(c, ROWS - 1), np.minimum(t, COLUMNS)]
    k = np.flatnonzero((c >= ROWS) | (t > COLUMNS))
    if len(k):
        c, t = c[k], t[k]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[k] = np.log(c - t * d) - np.log1p(-alone(c + 1, t, d))
    return out


class Seats:
    """The seating of some dishes with all their restaurants.

    c, t: customers and tables by level; up: for each dish of a level its place one level below; place: its restaurant;
    n, m: customers and tables of all dishes by restaurant. vocabulary: the base is uniform over it and one unknown dish.
    """

    def __init__(self, c2, t, up, place, n, m, discount, strength, vocabulary: int):
        self.t = [np.array(x, np.int64) for x in t]
        self.up, self.place = up, place
        self.c = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.asarray(c2, np.int64)]
        self._customers()
        self.n, self.m = [np.array(x, np.float64) for x in n], [np.array(x, np.float64) for x in m]
        self.crowded = False
        self.d, self.s, self.base = discount, strength, 1 / (vocabulary + 1)

    def _customers(self) -> None:
        for k in (2, 1):
            self.c[k - 1] = np.bincount(self.up[k], self.t[k], minlength=len(self.t[k - 1])).astype(np.int64)

    def predict(self) -> np.ndarray:
        """P(dish | restaurant) of all leaves."""
        p = np.float64(self.base)
        for k in range(3):
            below = p if k == 0 else p[self.up[k]]
            n, m, d, s = self.n[k][self.place[k]], self.m[k][self.place[k]], self.d[k], self.s[k]
            p = (self.c[k] - d * self.t[k] + (s + d * m) * below) / (s + n)
        return p

    def seat_all(self, rng) -> None:
        """A first seating: customers one after another by the Chinese-restaurant rule, in steps of a twentieth of those seated."""
        for k in (2, 1, 0):
            self._customers()
            p = np.full(len(self.t[0]), self.base)
            for j in range(k):
                n, m = self.n[j][self.place[j]], self.m[j][self.place[j]]
                p = (self.c[j] - self.d[j] * self.t[j] + (self.s[j] + self.d[j] * m) * p) / (self.s[j] + n)
                p = p[self.up[j + 1]]
            c = self.c[k]
            live = np.flatnonzero(c > 1)
            seated, tables = np.ones(len(live)), np.ones(len(live))
            at = np.arange(len(live))
            total = self.m[k][self.place[k][live]]
            while len(at):
                i = live[at]
                block = np.minimum(np.maximum(1, np.floor(seated[at] / 20)), c[i] - seated[at])
                new = (self.s[k] + self.d[k] * (total[at] - 1 + tables[at])) * p[i]
                tables[at] += rng.binomial(block.astype(np.int64), new / (new + seated[at] - self.d[k] * tables[at]))
                seated[at] += block
                at = at[seated[at] < c[i]]
            more = tables.astype(np.int64) - self.t[k][live]
            self.t[k][live] += more
            self.m[k] += np.bincount(self.place[k][live], more, minlength=len(self.m[k]))
            if k:
                self.n[k - 1] += np.bincount(self.place[k - 1][self.up[k][live]], more, minlength=len(self.n[k - 1]))
        self._customers()

    def _steps(self, k: int, i: np.ndarray, own: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log P(t + 1 tables) - log P(t tables) for dishes i[own] of a level, given all that is not theirs: the seatings of c customers
        (of Stirling numbers, by the chance of sitting alone), the restaurant's rule, and the parent's seating with one more."""
        d, now = self.d[k], self.t[k][i]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = one_more_table(self.c[k][i][own], t, d) + np.log(self.s[k] + d * np.maximum((self.m[k][self.place[k][i]] - now)[own] + t, 0.0))
            if not k:
                return out + np.log(self.base)
            p = self.up[k][i]
            out += one_more_customer((self.c[k - 1][p] - now)[own] + t, self.t[k - 1][p][own], self.d[k - 1])
            return out - np.log(self.s[k - 1] + np.maximum((self.n[k - 1][self.place[k - 1][p]] - now)[own] + t, 0.0))

    def reseat(self, level: int, who: np.ndarray, rng) -> None:
        """Seats all customers of each of the given dishes of a level anew: draws its tables from their distribution given the
        rest. It is summed over as many tables on both sides of the present number as have e^-30 of the likeliest one's weight."""
        t = self.t[level][who]
        least = np.ones(len(who), np.int64)
        if level:
            p = self.up[level][who]
            least = np.minimum(t, np.maximum(1, self.t[level - 1][p] - (self.c[level - 1][p] - t)))
        c, drawn, width, left = self.c[level][who], t.copy(), 8, np.arange(len(who))
        while len(left):
            low, high = np.maximum(least[left], t[left] - width), np.minimum(c[left], t[left] + width)
            size = high - low + 1
            ends = np.cumsum(size)
            starts = ends - size
            own = np.repeat(np.arange(len(left)), size)
            tables = np.arange(ends[-1]) - starts[own] + low[own]
            log = np.zeros(len(own))
            up = np.flatnonzero(tables < high[own])
            log[up + 1] = np.nan_to_num(self._steps(level, who[left], own[up], tables[up]), posinf=700.0, neginf=-700.0)
            log = np.cumsum(log)
            log -= np.maximum.reduceat(log, starts)[own]
            open_ = ((low > least[left]) & (log[starts] > -30)) | ((high < c[left]) & (log[ends - 1] > -30))
            sums = np.cumsum(np.exp(log))
            before = np.where(starts > 0, sums[starts - 1], 0.0)
            at = np.searchsorted(sums, before + rng.random(len(left)) * (sums[ends - 1] - before), side="right")
            at = np.clip(at, starts, ends - 1)
            drawn[left[~open_]] = tables[at[~open_]]
            left, width = left[open_], 2 * width
        self._shift(level, who, drawn - t)

    def _shift(self, k: int, who: np.ndarray, tables: np.ndarray) -> None:
        who, tables = who[tables != 0], tables[tables != 0]
        self.t[k][who] += tables
        np.add.at(self.m[k], self.place[k][who], tables)
        if k and len(who):
            p = self.up[k][who]
            np.add.at(self.c[k - 1], p, tables)
            np.add.at(self.n[k - 1], self.place[k - 1][p], tables)
            if (self.t[k - 1][p] > self.c[k - 1][p]).any():
                self.crowded = True

    def _settle(self) -> None:
        """Moves that were made at once may have left a dish with too many or too few tables; the nearest number holds."""
        self.crowded = False
        for k in (2, 1, 0):
            if k < 2:
                now = np.bincount(self.up[k + 1], self.t[k + 1], minlength=len(self.t[k])).astype(np.int64)
                if len(i := np.flatnonzero(now != self.c[k])):
                    self.n[k] += np.bincount(self.place[k][i], (now - self.c[k])[i], minlength=len(self.n[k]))
                    self.c[k] = now
            fit = np.clip(self.t[k], np.minimum(self.c[k], 1), self.c[k])
            if len(i := np.flatnonzero(fit != self.t[k])):
                self.m[k] += np.bincount(self.place[k][i], (fit - self.t[k])[i], minlength=len(self.m[k]))
                self.t[k] = fit

    def sweep(self, rng, rounds: int = 1, parts: int = 4) -> None:
        """Seats the customers of every dish with two or more anew, all of them, level by level, in random parts of at most PART
        dishes. `rounds`: how often."""
        for k in (2, 1, 0):
            for _ in range(rounds):
                who = rng.permutation(np.flatnonzero(self.c[k] > 1))
                for some in np.array_split(who, max(parts, -(-len(who) // PART))):
                    some = some[self.c[k][some] > 1]
                    if len(some):
                        self.reseat(k, some, rng)
                    if self.crowded:
                        self._settle()

    def dish_terms(self) -> np.ndarray:
        """For each level the sums of log S_d(c, t) over all dishes, by discount."""
        out = []
        for k in range(3):
            some = self.c[k] > 1
            key, n = np.unique(self.c[k][some] << 31 | self.t[k][some], return_counts=True)
            c, t = key >> 31, key & 0x7FFFFFFF
            out.append([float((n * log_s(c, t, float(d))).sum()) for d in DISCOUNTS])
        return np.array(out)


def restaurant_terms(n: np.ndarray, m: np.ndarray, d: float, s: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums over restaurants of log [s|d]_m - log (s)_n: by discount at the strength s (without n's part), and by strength
    at the discount d."""
    some = n > 1
    order = np.lexsort((m[some], n[some]))
    n, m, new = n[some][order], m[some][order], np.ones(len(order), bool)
    new[1:] = (n[1:] != n[:-1]) | (m[1:] != m[:-1])
    at = np.flatnonzero(new)
    n, m, times = n[at], m[at], np.diff(np.append(at, len(new)))
    grow = lambda s, d: m * np.log(d) + lgamma(s / d + m) - lgamma(np.array(s / d))
    by_d = [float((times * grow(s, x)).sum()) for x in DISCOUNTS]
    by_s = [float((times * (grow(x, d) - lgamma(x + n) + lgamma(np.array(x)))).sum()) for x in STRENGTHS]
    return np.array(by_d), np.array(by_s)


def draw(logs: np.ndarray, grid: np.ndarray, rng) -> float:
    """One value of a grid with the given log weights."""
    p = np.exp(np.round(logs - logs.max(), 6))
    return float(rng.choice(grid, p=p / p.sum()))
