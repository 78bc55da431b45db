"""A robust-pruned flat graph over the vectors of one shard, and range-expanding greedy search in it, for many queries at once.

All vectors are unit vectors in single precision here; distances are 1 - cosine. What lies near a threshold is for the caller to verify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Neighbours that pruning leaves, and as many again half for links back before a list is pruned again.
DEGREE, BEAM, ALPHA, EXPAND = 16, 16, 1.2, 4
QUERIES, CANDIDATES = 128, 48


class RobustGraph:
    """x: unit vectors. links: for each at most so many out-neighbours, filled up with -1. starts: where searches begin."""

    def __init__(self, x: np.ndarray, links: np.ndarray, starts: np.ndarray):
        self.x, self.links, self.starts = x, links, starts

    @classmethod
    def built(cls, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> RobustGraph:
        """Insertion in random order, twice: in the second round every vector searches the whole graph."""
        n = len(x)
        graph = cls(x, np.full((n, degree + degree // 2), -1, np.int32), medoid(x))
        order = np.random.default_rng(n).permutation(n)
        order = np.concatenate([graph.starts, order[order != graph.starts[0]]])
        done = 1
        while done < n:
            batch = order[done : done + min(done, QUERIES)]
            graph._insert(batch, degree, 1.0, beam)
            done += len(batch)
        for i in range(0, n, QUERIES):
            graph._insert(order[i : i + QUERIES], degree, ALPHA, beam)
        return graph

    def _insert(self, batch: np.ndarray, degree: int, alpha: float, beam: int) -> None:
        visited, _, _ = self._greedy(self.x[batch], beam)
        self.links[batch] = self._pruned(batch, np.concatenate([visited, self.links[batch]], 1), degree, alpha)
        # Each new neighbour links back; a list without room is pruned.
        source = np.repeat(batch, self.links.shape[1])
        target = self.links[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        known = (self.links[target] == source[:, None]).any(1)
        source, target = source[~known], target[~known]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        held = (self.links[nodes] >= 0).sum(1)
        room = np.repeat(held + count <= self.links.shape[1], count)
        place = np.arange(len(target)) - np.repeat(first, count)
        self.links[target[room], (np.repeat(held, count) + place)[room]] = source[room]
        back = np.full((len(nodes), count.max(initial=0)), -1, np.int32)
        back[np.repeat(np.arange(len(nodes)), count), place] = source
        full = np.flatnonzero(held + count > self.links.shape[1])
        for i in range(0, len(full), QUERIES):
            at = full[i : i + QUERIES]
            self.links[nodes[at]] = self._pruned(nodes[at], np.concatenate([self.links[nodes[at]], back[at]], 1), degree, alpha)

    def _pruned(self, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        """Robust pruning: the nearest candidate stays, those that it is closer to than the node is (by alpha) go, and so on."""
        rows = np.arange(len(nodes))[:, None]
        candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), 1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        far = 1 - np.einsum("nd,ncd->nc", self.x[nodes], self.x[candidates])
        far[candidates < 0] = np.inf
        order = np.argsort(far, 1, kind="stable")
        if order.shape[1] > CANDIDATES:  # the nearest, and evenly some of the rest: far ones keep the graph in one piece
            order = np.concatenate([order[:, : CANDIDATES // 2], order[:, np.linspace(CANDIDATES // 2, order.shape[1] - 1, CANDIDATES // 2).astype(int)]], 1)
        candidates, far = candidates[rows, order], far[rows, order]
        out = np.full((len(nodes), self.links.shape[1]), -1, np.int32)
        alive = np.isfinite(far)
        vectors = self.x[candidates]
        for k in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            out[some, k] = candidates[some, pick[some]]
            between = 1 - np.einsum("nd,ncd->nc", vectors[rows[:, 0], pick], vectors)
            alive &= alpha * alpha * between > far
            alive[rows[:, 0], pick] = False
        return out

    def _unseen(self, rows: np.ndarray, near: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the nodes that their query row has not seen, each once; they are seen now."""
        new = ~seen[rows, near]
        codes = np.unique(rows[new].astype(np.int64) * len(self.x) + near[new])
        rows, near = np.divmod(codes, len(self.x))
        seen[rows, near] = True
        return rows, near

    def _onward(self, rows: np.ndarray, nodes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = self.links[nodes]
        rows = np.repeat(rows, near.shape[1])
        near = near.ravel()
        return self._unseen(rows[near >= 0], near[near >= 0], seen)

    def _either_way(self) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours by links in either direction, and where each node's begin: those at the rim of a dense group link into it, but no
        list of the group has room for them."""
        node = np.repeat(np.arange(len(self.x)), self.links.shape[1])
        other = self.links.ravel()
        node, other = node[other >= 0], other[other >= 0]
        codes = np.unique(np.concatenate([node * len(self.x) + other, other.astype(np.int64) * len(self.x) + node]))
        node, other = np.divmod(codes, max(1, len(self.x)))
        return other, np.searchsorted(node, np.arange(len(self.x) + 1))

    def _closeness(self, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows), np.float32)
        for i in range(0, len(rows), 1 << 16):
            part = slice(i, i + (1 << 16))
            out[part] = np.einsum("nd,nd->n", q[rows[part]], self.x[nodes[part]])
        return out

    def _greedy(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """Beam search from the starts. The visited nodes of each query, the seen ones as a bitmap, and (rows, nodes, closeness) of all seen."""
        n, at = len(self.x), np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n), bool)
        rows, nodes = np.repeat(np.arange(len(q)), len(self.starts)), np.tile(self.starts, len(q))
        seen[rows, nodes] = True
        close = self._closeness(q, rows, nodes)
        log = [(rows, nodes, close)]
        ids, near = nodes.reshape(len(q), -1), close.reshape(len(q), -1)
        open_ = np.ones(ids.shape, bool)
        visited = []
        while open_.any():
            waiting = np.where(open_, near, -np.inf)
            pick = np.argsort(-waiting, 1, kind="stable")[:, :EXPAND]
            real = np.isfinite(waiting[at, pick])
            open_[at, pick] = False
            visited.append(np.where(real, ids[at, pick], -1))
            rows, nodes = self._onward(np.broadcast_to(at, pick.shape)[real], ids[at, pick][real], seen)
            close = self._closeness(q, rows, nodes)
            log.append((rows, nodes, close))
            count = np.bincount(rows, minlength=len(q))
            place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            more_ids, more = np.zeros((len(q), count.max(initial=0)), ids.dtype), np.full((len(q), count.max(initial=0)), -np.inf, np.float32)
            more_ids[rows, place], more[rows, place] = nodes, close
            ids, near, open_ = np.concatenate([ids, more_ids], 1), np.concatenate([near, more], 1), np.concatenate([open_, np.isfinite(more)], 1)
            best = np.argsort(-near, 1, kind="stable")[:, :beam]
            ids, near, open_ = ids[at, best], near[at, best], open_[at, best]
        return np.concatenate(visited, 1), seen, log

    def in_range(self, asked: np.ndarray, least: float, reach: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node, other, closeness) for the nodes asked: others of at least that closeness found. A beam search from the starts, and then from
        each node within ``reach``, the queried one included, on to its neighbours until nothing new is within reach."""
        other, first = self._either_way()
        for start in range(0, len(asked), QUERIES):
            node = asked[start : start + QUERIES]
            q, own = self.x[node], np.arange(len(node))
            _, seen, log = self._greedy(q, beam)
            own = own[~seen[own, node]]
            seen[own, node[own]] = True
            log.append((own, node[own], np.ones(len(own), np.float32)))
            rows, nodes, close = (np.concatenate(c) for c in zip(*log, strict=True))
            while len(rows):
                good = close >= least
                yield node[rows[good]], nodes[good], close[good]
                wide = close >= reach
                rows, nodes, more = rows[wide], nodes[wide], []
                count = first[nodes + 1] - first[nodes]
                for part in np.array_split(np.arange(len(rows)), 1 + int(count.sum()) // 1_000_000):
                    at, n = first[nodes[part]], count[part]
                    places = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)
                    more.append(self._unseen(np.repeat(rows[part], n), other[places], seen))
                rows, nodes = (np.concatenate(c) for c in zip(*more, strict=True))
                close = self._closeness(q, rows, nodes)


def medoid(x: np.ndarray) -> np.ndarray:
    return np.array([int((x @ x.mean(0)).argmax())])
