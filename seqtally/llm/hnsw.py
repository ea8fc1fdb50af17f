"""Hierarchical navigable small-world graphs in numpy, built and searched for many vectors at once."""

from __future__ import annotations

import numpy as np

DEGREE = 16
BUILD_BEAM = 48
#: Candidates whose neighbours are looked at in one step of a search.
WIDTH = 4


def levels(n: int, degree: int = DEGREE, seed: int = 11) -> np.ndarray:
    u = np.random.default_rng(seed).random(n)
    return np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(degree)).astype(np.int64), 12)


def select(sim: np.ndarray, between: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of candidates in order of similarity, those nearer to the vector than to one already taken, then the nearest others.

    sim: rows x c, between: rows x c x c, ids: rows x c with -1 where there is none; gives rows x most ids.
    """
    n, c = ids.shape
    taken = np.zeros((n, c), bool)
    count = np.zeros(n, np.int64)
    nearest = np.full((n, c), -2.0, np.float32)  # to any taken one
    for i in range(c):
        ok = (ids[:, i] >= 0) & (count < most) & (nearest[:, i] < sim[:, i])
        taken[:, i] = ok
        count += ok
        nearest = np.where(ok[:, None], np.maximum(nearest, between[:, i]), nearest)
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((n, most - out.shape[1]), -1, out.dtype)], 1)
    return out.astype(np.int32)


class Graph:
    """x: unit vectors (float32).  links[l] has the neighbours of each vector on level l, -1 where there are fewer."""

    def __init__(self, x: np.ndarray, level: np.ndarray, links: list[np.ndarray], entry: int):
        self.x, self.level, self.links, self.entry = x, level, links, entry

    def _beam(self, q: np.ndarray, start: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest that a search from start (rows x any) comes by: (ids, similarities), nearest first."""
        n = len(q)
        links = self.links[layer]
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column is for -1
        seen[:, -1] = True
        mark = np.empty((n, len(self.x) + 1), np.int16)
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -2.0, np.float32)
        open_ = np.zeros((n, width), bool)
        new = start
        live = np.arange(n)
        while len(live):
            r = live[:, None]
            slot = np.arange(new.shape[1], dtype=np.int16)[None]
            mark[r, new] = slot
            fresh = ~seen[r, new] & (mark[r, new] == slot)  # a vector can be reached twice in one step
            new_sims = np.where(fresh, np.einsum("qkd,qd->qk", self.x[new], q[live]), -2.0).astype(np.float32)
            seen[np.broadcast_to(r, new.shape), new] = True
            all_ids = np.concatenate([ids[live], np.where(fresh, new, -1)], 1)
            all_sims = np.concatenate([sims[live], new_sims], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            order = np.argsort(-all_sims, axis=1)[:, :width]
            ids[live] = np.take_along_axis(all_ids, order, 1)
            sims[live] = np.take_along_axis(all_sims, order, 1)
            own = np.take_along_axis(all_open, order, 1)
            rank = np.cumsum(own, 1)
            go = own & (rank <= WIDTH)
            open_[live] = own & ~go
            on = go.any(1)
            live, go = live[on], go[on]
            if not len(live):
                break
            k = np.argsort(~go, axis=1, kind="stable")[:, : min(WIDTH, width)]
            chosen = np.where(np.take_along_axis(go, k, 1), np.take_along_axis(ids[live], k, 1), -1)
            new = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(live), -1).astype(np.int64)
        return ids, sims

    def search(self, q: np.ndarray, width: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry, np.int64)
        for l in range(len(self.links) - 1, layer, -1):
            at = self._beam(q, at, 4, l)[0]
        return self._beam(q, at, max(width, 1), layer)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> Graph:
    """Inserts vectors in batches of at most half of what stands already; a batch's vectors see each other as well."""
    n = len(x)
    level = levels(n, degree)
    top = int(level.max(initial=0))
    links = [np.full((n + 1, 2 * degree if l == 0 else degree), -1, np.int32) for l in range(top + 1)]
    g = Graph(x, level, links[:1], 0)
    done = 0
    while done < n:
        size = min(n - done, 512, max(16, done // 2))
        ids = np.arange(done, done + size)
        q = x[ids]
        at = np.full((size, 1), g.entry, np.int64)
        for l in range(int(level[: done + size].max()), -1, -1):
            old = done and l < len(g.links)
            if old:
                found, _ = g._beam(q, at, beam if (level[ids] >= l).any() else 4, l)
                at = found[:, :4]
            own = np.flatnonzero(level[ids] >= l)
            if not len(own):
                continue
            inner = q[own] @ q[own].T
            np.fill_diagonal(inner, -2.0)
            near = np.argsort(-inner, axis=1, kind="stable")[:, : min(degree, max(0, len(own) - 1))]
            cand = ids[own][near]
            if old:
                cand = np.concatenate([found[own], cand], 1)
            if cand.shape[1]:
                _connect(x, links[l], ids[own], cand)
        g.links = links[: max(len(g.links), int(level[: done + size].max()) + 1)]
        best = int(np.argmax(level[: done + size]))
        if level[best] > level[g.entry] or not done:
            g.entry = best
        done += size
    return g


def _ranked(x: np.ndarray, base: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
    """The candidates (rows x any, -1 for none) that base vectors should link to."""
    sim = np.where(cand >= 0, np.einsum("qkd,qd->qk", x[cand], x[base]), -2.0).astype(np.float32)
    order = np.argsort(-sim, axis=1, kind="stable")[:, : max(2 * most, BUILD_BEAM)]
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    v = x[cand]
    return select(sim, np.matmul(v, v.transpose(0, 2, 1)), cand, most)


def _connect(x: np.ndarray, links: np.ndarray, ids: np.ndarray, cand: np.ndarray) -> None:
    degree = links.shape[1]
    chosen = _ranked(x, ids, cand, degree // 2)
    links[ids, : chosen.shape[1]] = chosen
    to, back = chosen.ravel().astype(np.int64), np.repeat(ids, chosen.shape[1])
    keep = to >= 0
    to, back = to[keep], back[keep]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    target, first, count = np.unique(to, return_index=True, return_counts=True)
    for most in (8, 64, int(count.max(initial=0))):  # few get many: rows of like length together
        own = np.flatnonzero((count <= most) & (count > 0))
        if len(own):
            new = np.full((len(own), int(count[own].max())), -1, np.int64)
            slot = np.arange(count[own].sum()) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
            new[np.repeat(np.arange(len(own)), count[own]), slot] = back[np.repeat(first[own], count[own]) + slot]
            have = links[target[own]].astype(np.int64)
            new = np.where((new[:, :, None] == have[:, None, :]).any(2), -1, new)
            links[target[own]] = _ranked(x, target[own], np.concatenate([have, new], 1), degree)
            count[own] = 0
