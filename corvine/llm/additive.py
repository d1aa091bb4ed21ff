"""Additive quantisation of unit vectors: a vector is a sum of one entry from each of several full-dimensional codebooks.

The codebooks start as k-means of the residuals that the earlier ones leave and are fitted once more together by least
squares. Encoding is a beam search over the codebooks, on tables of the entries' inner products. A query's score of a coded
vector is a sum of table look-ups, divided by the norm of the coded vector, which is stored beside its code. The entries of
the first codebook are numbered so that near ones have near numbers.
"""

from __future__ import annotations

import numpy as np

BOOKS = 6
ENTRIES = 256
BEAM = 3
ROUNDS = 8
BLOCK = 8192


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _line(centres: np.ndarray) -> np.ndarray:
    """An order in which near centres stand near each other: halves along the widest direction, again and again."""

    def halves(at: np.ndarray) -> list[int]:
        if len(at) <= 2:
            return at.tolist()
        x = centres[at] - centres[at].mean(0)
        along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        order = at[np.argsort(along, kind="stable")]
        return halves(order[: len(order) // 2]) + halves(order[len(order) // 2 :])

    return np.array(halves(np.arange(len(centres))))


class Quantiser:
    """``books``: (number of codebooks, entries, dimensions)."""

    def __init__(self, books: np.ndarray):
        self.books = np.ascontiguousarray(books, dtype=np.float32)
        self.m, self.k, self.d = self.books.shape
        flat = self.books.reshape(-1, self.d)
        self.norms = (self.books**2).sum(2)
        self.cross = (flat @ flat.T).reshape(self.m, self.k, self.m, self.k)

    @classmethod
    def train(cls, x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, seed: int = 7) -> Quantiser:
        """Fit to unit vectors ``x``; fewer vectors than entries make smaller codebooks."""
        rng = np.random.default_rng(seed)
        entries = max(1, min(entries, len(x)))
        rest, got = x.astype(np.float32), []
        for _ in range(books):
            centres = _kmeans(rest, entries, ROUNDS, rng)
            near = np.argmax(rest @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
            rest = rest - centres[near]
            got.append(centres)
        q = cls(np.stack(got))
        if len(x) > books * entries:  # one joint fit: the entries that best add up to the vectors, given their codes
            codes = q.encode(x)
            at = codes.astype(np.int64) + np.arange(books) * entries
            gram = np.zeros((books * entries, books * entries))
            for i in range(books):
                for j in range(books):
                    np.add.at(gram, (at[:, i], at[:, j]), 1.0)
            right = np.zeros((books * entries, x.shape[1]))
            for i in range(books):
                np.add.at(right, at[:, i], x)
            right += 0.1 * q.books.reshape(-1, q.d)  # unused entries stay where they are
            q = cls(np.linalg.solve(gram + 0.1 * np.eye(len(gram)), right).reshape(books, entries, -1))
        q.books[0] = q.books[0][_line(q.books[0])]
        return cls(q.books)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The codes of each vector, uint8, by beam search."""
        return np.concatenate([self._encode(x[i : i + BLOCK], beam) for i in range(0, len(x), BLOCK)]) if len(x) else np.zeros((0, self.m), dtype=np.uint8)

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n = len(x)
        cost = np.stack([norm - 2 * (x @ b.T) for norm, b in zip(self.norms, self.books)])  # of an entry by itself
        beam = min(beam, self.k)
        codes = np.argpartition(cost[0], beam - 1, axis=1)[:, :beam].astype(np.int64)[:, :, None] if self.k > beam else np.tile(np.arange(beam), (n, 1))[:, :, None]
        total = np.take_along_axis(cost[0], codes[:, :, 0], axis=1)
        for m in range(1, self.m):
            step = total[:, :, None] + cost[m][:, None, :]
            for j in range(m):
                step += 2 * self.cross[j][codes[:, :, j], m]
            flat = step.reshape(n, -1)
            best = np.argpartition(flat, beam - 1, axis=1)[:, :beam] if flat.shape[1] > beam else np.tile(np.arange(flat.shape[1]), (n, 1))
            total = np.take_along_axis(flat, best, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, (best // self.k)[:, :, None], axis=1), (best % self.k)[:, :, None]], axis=2)
        return codes[np.arange(n), np.argmin(total, axis=1)].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.d), dtype=np.float32)
        for m in range(self.m):
            out += self.books[m][codes[:, m]]
        return out

    def nearest_entries(self, x: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` entries of the first codebook nearest to each vector, the nearest first."""
        score = x @ self.books[0].T - 0.5 * self.norms[0]
        count = min(count, self.k)
        top = np.argpartition(-score, count - 1, axis=1)[:, :count] if count < self.k else np.tile(np.arange(self.k), (len(x), 1))
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)

    def second_entries(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The entry of the second codebook that is nearest to what ``first`` leaves of each vector."""
        left = x - self.books[0][first]
        return np.argmax(left @ self.books[1].T - 0.5 * self.norms[1], axis=1)

    def nearest_pairs(self, x: np.ndarray, first: np.ndarray, allowed: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first entry, second entry) of the ``count`` nearest sums of two entries, the first of ``first`` where ``allowed``."""
        rows, width = np.flatnonzero(allowed.any(1)), first.shape[1]
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(0, len(rows), 512):
            r = rows[i : i + 512]
            own = first[r]
            alone = 0.5 * self.norms[0][own] - np.take_along_axis(x[r] @ self.books[0].T, own, axis=1)
            cost = alone[:, :, None] + (0.5 * self.norms[1] - x[r] @ self.books[1].T)[:, None, :] + self.cross[0][own, 1]
            cost[~allowed[r]] = np.inf
            flat = cost.reshape(len(r), -1)
            most = min(count, flat.shape[1])
            best = np.argpartition(flat, most - 1, axis=1)[:, :most] if most < flat.shape[1] else np.tile(np.arange(most), (len(r), 1))
            fine = np.isfinite(np.take_along_axis(flat, best, axis=1)).ravel()
            out.append((np.repeat(r, most)[fine], np.take_along_axis(own, best // self.k, axis=1).ravel()[fine], (best % self.k).ravel()[fine]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, dtype=int),) * 3

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Per codebook, vector by entry, the inner products from which scores are looked up."""
        return np.stack([x @ b.T for b in self.books])


SCORES = 1 << 22  # so many at once
FEW = 64  # where more vectors of a leaf are candidates, all of the leaf are compared exactly, by one matrix product


class Shard:
    """Coded vectors in leaves (runs of equal ``leaf``), against which other vectors are scored.

    ``norm`` is the stored norm of each coded vector, ``fit`` its cosine with the vector it codes.
    """

    def __init__(self, q: Quantiser, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, leaf: np.ndarray, least: float, k: int):
        order = np.argsort(leaf, kind="stable")
        self.q, self.least, self.k = q, np.float32(least), k
        self.ids, self.x, self.codes, self.norm, self.leaf = ids[order], x[order], codes[order], norm[order], leaf[order]
        self.names, self.begins = np.unique(self.leaf, return_index=True)
        self.ends = np.append(self.begins[1:], len(ids))
        self.fit = fit[order].astype(np.float32)
        # five standard deviations of what a code's error adds to the score of an orthogonal unit vector
        self.slack = (5 * np.sqrt(np.maximum(0, 1 - self.fit.astype(np.float64) ** 2) / max(1, q.d - 1))).astype(np.float32)

    def search(self, asked: np.ndarray, asked_ids: np.ndarray, rows: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(place in ``asked``, id, cosine) of the ``k`` best of each asked vector, and all that tie with the last, of a cosine
        of at least ``least``; and how many pairs were scored.

        ``rows`` and ``leaves`` say which asked vector looks into which leaf; its first one is read first. Candidates come
        from table scores: those that reach what a vector scores that is as similar as the k-th best so far, less five
        standard deviations of the code's error, however many they are. Their exact cosines decide. The leaves that aren't
        looked into and the five deviations are what accuracy is lost by. A vector's match with its own id is left out.
        """
        n, scored = len(asked), 0
        best = np.full((n, self.k), self.least, dtype=np.float32)  # the best exact cosines so far, the least of them first
        tables = self.q.tables(asked)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.searchsorted(self.names, leaves)
        there = (at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == leaves)
        rows, at = rows[there], at[there]
        _, first = np.unique(rows, return_index=True)
        later = np.ones(len(rows), dtype=bool)
        later[first] = False

        def exact(row: np.ndarray, hit: np.ndarray) -> None:
            other = asked_ids[row] != self.ids[hit]
            row, hit = row[other], hit[other]
            for i in range(0, len(row), 65_536):
                r, h = row[i : i + 65_536], hit[i : i + 65_536]
                near = np.einsum("nd,nd->n", asked[r], self.x[h]) >= best[r, 0] - 1e-5
                r, h = r[near], h[near]
                cosine = np.einsum("nd,nd->n", asked[r].astype(np.float64), self.x[h].astype(np.float64))
                good = cosine >= best[r, 0]
                r, h, cosine = r[good], h[good], cosine[good]
                if not len(r):
                    continue
                kept.append((r, h, cosine))
                order = np.lexsort((-cosine, r))
                r, cosine = r[order], cosine[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                top = place < self.k
                of, back = np.unique(r[top], return_inverse=True)
                new = np.full((len(of), self.k), -2.0, dtype=np.float32)
                new[back, place[top]] = np.nextafter(cosine[top].astype(np.float32), np.float32(-2))
                best[of] = np.sort(np.concatenate([best[of], new], axis=1), axis=1)[:, self.k :]

        for rows_now, at_now in ((rows[~later], at[~later]), (rows[later], at[later])):
            order = np.argsort(at_now, kind="stable")
            rows_now, at_now = rows_now[order], at_now[order]
            leaf, begins = np.unique(at_now, return_index=True)
            for j, begin, end in zip(leaf, begins, np.append(begins[1:], len(at_now))):
                a, b = self.begins[j], self.ends[j]
                codes, fit, slack = self.codes[a:b], self.fit[a:b], self.slack[a:b]
                step = max(1, SCORES // (b - a))
                for i in range(begin, end, step):
                    r = rows_now[i : min(end, i + step)]
                    score = np.take(tables[0][r], codes[:, 0], axis=1)
                    for m in range(1, self.q.m):
                        score += np.take(tables[m][r], codes[:, m], axis=1)
                    score /= self.norm[a:b]
                    scored += score.size
                    t = best[r, :1]
                    passed = score >= t * fit - np.sqrt(np.maximum(0, 1 - t * t)) * slack
                    many = passed.sum(1) > FEW
                    row, hit = np.nonzero(passed & ~many[:, None])
                    exact(r[row], a + hit)
                    if not many.any():
                        continue
                    r = r[many]
                    near = asked[r] @ self.x[a:b].T
                    last = np.maximum(best[r, 0], np.partition(near, b - a - self.k - 1, axis=1)[:, b - a - self.k - 1]) if b - a > self.k + 1 else best[r, 0]
                    row, hit = np.nonzero(near >= last[:, None] - 1e-5)  # one more than k, as the vector itself may be among them
                    exact(r[row], a + hit)
        if not kept:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), scored
        row, hit, cosine = (np.concatenate(c) for c in zip(*kept))
        good = (cosine >= best[row, 0]) & (cosine >= self.least)
        return row[good], self.ids[hit[good]], cosine[good], scored
