"""Sampled segmentations of SentencePiece text without replacement, and decoding."""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import mix, text_or_empty

SPACE = "▁"
#: Stands for a literal U+2581 of the text, which the pieces use for a space; no valid text holds it.
_LITERAL = "\udc81"
#: No piece crosses the start of a run of spaces or a line end, so a unit's lattice is independent of its neighbours.
#: Texts fall into units before their spaces are replaced.
_UNIT = re.compile(" *+[^ \n]+|\n+| +")
_IN_UNIT = re.compile(f"\n+|{SPACE}*[^{SPACE}\n]*")


@dataclass(frozen=True)
class SampleSpec:
    samples: int = 2
    #: sharpness: piece weights are raised to this power
    alpha: float = 1.0
    seed: int = 1
    #: code points that a batch of texts may hold; a longer text is a batch of its own
    batch_chars: int = 400_000
    #: code points of the texts whose paths are drawn side by side
    path_chars: int = 400_000
    #: where a prefix of a path has a probability below exp of this, branches are opened only as long as there are fewer than
    #: are wanted: beside those before, theirs is under what a double resolves
    least_log_mass: float = -40.0


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model as a trie over code points, with a log weight for each.

    The score of a byte-pair piece is minus its merge rank. Its weight is 1 / (rank + 8), Zipf's law by rank; runs
    of spaces, which have no rank, weigh as the last. A code point in no piece is spelt in byte pieces. A model with a
    piece that crosses the start of a run of spaces or a line end is refused: its lattices do not fall into units.
    """

    dense = 176

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, np.int32)
        words: list[tuple[str, int, float]] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                if not _IN_UNIT.fullmatch(p):
                    raise ValueError(f"piece {i} ({p!r}) crosses a border of units")
                self.bytes_of.append(p.replace(SPACE, " ").encode())
                words.append((p, i, -np.log(min(-sp.get_score(i), n) + 8)))
        self.byte_weight = -np.log(n + 8.0)
        self.longest = max(len(p) for p, _, _ in words)
        chars = sorted({c for p, _, _ in words for c in p}, key=lambda c: (ord(c) > 0x2FF and c != SPACE, c))
        self.code = np.full(0x110000, -1, np.int64)
        for k, c in enumerate(chars):
            self.code[ord(c)] = k
        states, self.piece, self.weight = {"": 0}, [-1], [0.0]
        for p, i, w in words:
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    self.piece.append(-1)
                    self.weight.append(0.0)
            self.piece[states[p]], self.weight[states[p]] = i, w
        #: states from here on stand for one code point spelt in one, two, three or four byte pieces
        self.spelt = len(states)
        self.piece = np.array([*self.piece, -1, -1, -1, -1], np.int32)
        self.weight = np.array([*self.weight, *(self.byte_weight * k for k in (1, 2, 3, 4))])
        self.depth = np.array([*map(len, states), 1, 1, 1, 1])
        self.raw = np.array(self.bytes_of, object)
        table = np.full((len(states), self.dense + 1), -1, np.int32)
        rare = []
        for p, s in states.items():
            if p:
                c, parent = int(self.code[ord(p[-1])]), states[p[:-1]]
                if c < self.dense:
                    table[parent, c] = s
                else:
                    rare.append((parent << 21 | c, s))
        self.flat = table.ravel()
        rare.sort()
        self.rare_key, self.rare_to = (np.array([r[i] for r in rare], np.int64) for i in (0, 1))

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states, -1 where no piece goes on."""
        # the last column, of code points in no piece and of rare ones, leads nowhere
        out = self.flat.take(state * (self.dense + 1) + np.minimum(char.view(np.uint64), self.dense).view(np.int64))
        other = np.flatnonzero(char >= self.dense)
        if len(other):
            key = state[other].astype(np.int64) << 21 | char[other]
            at = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
            out[other] = np.where(self.rare_key[at] == key, self.rare_to[at], -1)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """Lattices of many units side by side. A unit of n code points has n + 1 nodes, the last its end.

    Units are numbered by length (``rank``: of each that was given). The node of unit u with r code points to go is
    ``column[r] + u``: nodes lie by what is to go, then by unit, so that all that may follow a node lies before it. Edges
    are grouped by start node. ``q`` is the probability of an edge given its start: piece weight times the total
    weight of what may follow, over the total from the start (backward sums). ``log_q`` holds the logarithms where sums leave
    the range of doubles, else nothing.
    """

    #: Log weight that is given back for each code point, about what a path loses: sums stay near 1.
    gain = 2.8

    def __init__(self, units: list[str], model: Pieces, alpha: float):
        text = "".join(units).replace(" ", SPACE)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(sizes, kind="stable")
        self.rank = np.empty_like(order)
        self.rank[order] = np.arange(len(units))
        self.size = sizes[order]
        longest = int(self.size[-1])
        skipped = np.searchsorted(self.size, np.arange(longest + 1))  # units too short for a column
        height = len(units) - skipped
        self.heads = np.append(0, np.cumsum(height))  # first node of each column
        self.column = self.heads[:-1] - skipped
        self.ends, self.nodes = len(units), int(self.heads[-1])
        room = np.repeat(np.arange(1, longest + 1), height[1:])
        unit = np.arange(self.ends, self.nodes) - np.repeat(self.column[1:], height[1:])
        here = np.cumsum(sizes)[order].take(unit) - room
        self.points = points.take(here)  # code point of each node that is no end
        chars = model.code.take(points)
        state, at = np.zeros(len(here), np.int64), np.arange(len(here))
        found, seen = [], np.zeros(len(here), np.int8)
        for length in range(1, min(model.longest, longest) + 1):
            state = model.step(state, chars.take(here))
            alive = np.flatnonzero(state >= 0)
            state, at, here = state.take(alive).astype(np.int64), at.take(alive), here.take(alive)
            full = np.flatnonzero(model.piece.take(state) >= 0)
            if len(full):
                whole = at.take(full)
                rank = seen.take(whole)
                found.append((whole, rank, state.take(full)))
                seen[whole] = rank + 1
            if length == 1 and len(spelt := np.flatnonzero(seen == 0)):
                p = self.points[spelt]
                found.append((spelt, 0, model.spelt + (p > 0x7F).astype(int) + (p > 0x7FF) + (p > 0xFFFF)))
                seen[spelt] = 1
            if length < longest:
                more = np.searchsorted(at, self.heads[length + 1] - self.ends)  # those before end here
                state, at, here = state[more:], at[more:], here[more:] + 1
        self.first = np.zeros(self.nodes + 1, np.int64)
        np.cumsum(seen, out=self.first[self.ends + 1 :])
        self.state = np.empty(int(self.first[-1]), np.int64)
        own = self.first[self.ends : -1]  # first edge of each node that is no end
        for whole, rank, state in found:
            self.state[own.take(whole) + rank] = state
        at = np.repeat(np.arange(len(seen)), seen)
        self.from_ = at + self.ends
        self.len = model.depth.take(self.state)
        ahead = self.column.take(room.take(at) - self.len) + unit.take(at)
        self._backward(alpha * model.weight + self.gain * model.depth, seen, ahead)

    def _backward(self, score: np.ndarray, degree: np.ndarray, ahead: np.ndarray) -> None:
        """Probabilities of edges, from the log weight of each state, the number of edges from each node that is no end
        and the node that each edge leads to."""
        own = self.first[self.ends : -1]
        heads, cuts = self.heads[1:], self.first[self.heads[1:]]
        beta = np.ones(self.nodes)
        with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
            self.q = np.exp(score).take(self.state)
            for a, b, lo, hi in zip(heads[:-1], heads[1:], cuts[:-1], cuts[1:], strict=True):
                flow = self.q[lo:hi]
                flow *= beta.take(ahead[lo:hi])
                np.add.reduceat(flow, self.first[a:b] - lo, out=beta[a:b])
            plain = bool(beta.min() > 1e-280 and beta.max() < 1e280)
            if plain:
                self.q /= np.repeat(beta[self.ends :], degree)
                plain = bool(self.q.min() > 0)
        if plain:
            np.minimum(self.q, 1.0, out=self.q)
            self.log_q = None
        else:  # sums left the range of doubles: long units, many code points in bytes, or a high alpha
            beta[:] = 0.0
            self.log_q = score.take(self.state)
            for a, b, lo, hi in zip(heads[:-1], heads[1:], cuts[:-1], cuts[1:], strict=True):
                flow = self.log_q[lo:hi]
                flow += beta.take(ahead[lo:hi])
                at = self.first[a:b] - lo
                top = np.maximum.reduceat(flow, at)
                rest = np.exp(flow - np.repeat(top, degree[a - self.ends : b - self.ends]))
                beta[a:b] = top + np.log(np.add.reduceat(rest, at))
            self.log_q -= np.repeat(beta[self.ends :], degree)
            np.minimum(self.log_q, 0.0, out=self.log_q)
            self.q = np.exp(self.log_q)
        self.mono = np.cumsum(self.q)
        self.mono -= np.repeat(self.mono.take(own) - self.q.take(own), degree)
        np.minimum(self.mono, 1.0, out=self.mono)
        self.mono[self.first[self.ends + 1 :] - 1] = 1.0
        self.mono += self.from_

    def logs(self, edges) -> np.ndarray:
        """log q of ``edges``."""
        return np.log(self.q[edges]) if self.log_q is None else self.log_q[edges]

    def log_rest(self, edges: np.ndarray) -> np.ndarray:
        """Log of the summed q of the other edges that start where each of ``edges`` does: added up where q is next to one,
        since one less q does not tell it there."""
        q = self.q[edges]
        near = np.flatnonzero(q > 0.99)
        out = np.log1p(-np.minimum(q, 0.99))
        first = self.first[self.from_[edges[near]]]
        degree, at = self.first[self.from_[edges[near]] + 1] - first, edges[near] - first
        rest = np.full(len(near), -np.inf if self.log_q is not None else 0.0)
        more = np.arange(len(near))
        for k in range(1, int(degree.max(initial=0))):
            more = more[degree[more] > k]
            e = at[more] + k
            e = first[more] + np.where(e >= degree[more], e - degree[more], e)
            rest[more] = rest[more] + self.q[e] if self.log_q is None else np.logaddexp(rest[more], self.log_q[e])
        if self.log_q is None:
            with np.errstate(divide="ignore"):
                rest = np.log(rest)
        out[near] = rest
        return out

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that a uniform number picks."""
        last = self.first.take(node + 1) - 1
        e, x = self.first.take(node), node + u
        if len(e) < 256:
            return np.minimum(np.searchsorted(self.mono, x, side="right"), last)
        past = np.flatnonzero(self.mono.take(e) <= x)
        y, f = x.take(past), e.take(past)
        f += 1
        e[past] = f
        more = np.flatnonzero(self.mono.take(f, mode="clip") <= y)
        e[past.take(more)] = np.searchsorted(self.mono, y.take(more), side="right")
        return np.minimum(e, last)


_SCALE = 2.0**-53


def _uniform(seed: np.ndarray, sample: int, at: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) fixed by (row seed, sample, place)."""
    return _uniform_of(seed + at.astype(np.uint64) * _PLACE, sample)


_PLACE = np.uint64(0x9E3779B97F4A7C15)


def _uniform_of(base_hash: np.ndarray, sample: int) -> np.ndarray:
    h = mix(base_hash + np.uint64(sample * 0xD6E8FEB86659FD93 % (1 << 64)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * _SCALE


_MASK = (1 << 64) - 1


def _uniform_one(seed: int, sample: int, at: int) -> float:
    """One number of :func:`_uniform`."""
    h = (seed + sample * 0xD6E8FEB86659FD93 + at * 0x9E3779B97F4A7C15) & _MASK
    h = ((h ^ (h >> 32)) * 0xC2B2AE3D27D4EB4F) & _MASK
    h = ((h ^ (h >> 29)) * 0x9E3779B97F4A7C15) & _MASK
    return (((h ^ (h >> 32)) >> 11) + 0.5) * _SCALE


def sample_batch(
    seeds: np.ndarray, texts: list[str], model: Pieces, spec: SampleSpec
) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``samples`` distinct segmentations: (ids, log_prob, perturbed, log_inclusion), best first.

    A hypothesis is the set of all paths that share a prefix of edges and leave it otherwise than by some excluded
    edges. Its priority is the largest Gumbel-perturbed log-probability among its paths, drawn as a Gumbel at the set's
    log-mass, truncated at its parent's. Popping the best and following its maximum gives the next distinct
    path of the exact top-k order, and splits the rest of the set by the place where paths leave the new one. The
    next priority after the last sample is the threshold kappa; a path is included with probability
    1 - exp(-exp(log_prob - kappa)).
    """
    units, counts = [], np.zeros(len(texts) + 1, np.int64)
    for k, t in enumerate(texts):
        found = _UNIT.findall(" " + t.replace(SPACE, _LITERAL)) if t else []
        units.append(found)
        counts[k + 1] = len(found)
    index = defaultdict(count().__next__)  # numbers units in the order they are first asked for
    occ = np.fromiter(map(index.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
    del units
    if not len(occ):
        return [[(np.empty(0, np.int32), 0.0, 0.0, 0.0)] for _ in texts]
    lat = Lattice(list(index), model, spec.alpha)
    occ = lat.rank[occ]
    cuts = np.cumsum(counts)
    points = np.array([len(t) + 1 if t else 0 for t in texts])
    out, lo = [], 0
    while lo < len(texts):  # one lattice for many texts, small arrays for the paths
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(points[lo:]), spec.path_chars, side="right")) + lo)
        out += _draw(lat, occ[cuts[lo] : cuts[hi]], points[lo:hi], seeds[lo:hi], model, spec)
        lo = hi
    return out


def _draw(
    lat: Lattice, occ: np.ndarray, points: np.ndarray, seeds: np.ndarray, model: Pieces, spec: SampleSpec
) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """The samples of texts of ``points`` code points whose units are ``occ`` in one run."""
    size = lat.size[occ]
    base = np.cumsum(size) - size  # place of each occurrence among all code points of the texts
    by_unit = np.argsort(occ, kind="stable")  # so that edges are looked up in the order they lie in memory
    total = int(size.sum())
    doc_start = np.append(0, np.cumsum(points))
    # what a place's uniform number is made of, but for the sample
    base_hash = np.repeat(seeds - doc_start[:-1].astype(np.uint64) * _PLACE, points)
    base_hash += np.arange(total, dtype=np.uint64) * _PLACE

    def free(sample: int) -> np.ndarray:
        """An edge for every place that a path sampled afresh in each unit starts a piece at, else -1."""
        chosen = np.full(total, -1, np.int64)
        unit = occ[by_unit]
        at, room = base[by_unit], lat.size[unit]
        while len(at):
            e = lat.pick(lat.column.take(room) + unit, _uniform_of(base_hash.take(at), sample))
            chosen[at] = e
            length = lat.len.take(e)
            room -= length
            at += length
            on = np.flatnonzero(room)
            at, room, unit = at.take(on), room.take(on), unit.take(on)
        return chosen

    results: list[list] = [[] for _ in points]
    heaps: list[list] = [[] for _ in points]
    keys = seeds.tolist()
    top = -np.log(-np.log(_uniform(seeds, 0, np.zeros(len(seeds), np.int64))))
    for s in range(1, spec.samples + 1):
        fresh, left = free(s), []
        where = np.flatnonzero(fresh >= 0)
        drawn = fresh[where]
        log_q = lat.logs(drawn)
        bounds = np.searchsorted(where, doc_start).tolist()
        for d, lo in enumerate(doc_start[:-1].tolist()):
            a, b = bounds[d], bounds[d + 1]
            if a == b:
                if s == 1:
                    results[d].append((where[:0], drawn[:0], log_q[:0], 0.0, 0.0))
                continue
            if s == 1:
                g, kept, banned = float(top[d]), 0, frozenset()
                places, edges, logs = where[a:b] - lo, drawn[a:b], log_q[a:b]
            else:
                if not heaps[d]:
                    continue
                g, parent, kept, banned = heapq.heappop(heaps[d])
                g = -g
                old_places, old_edges, old_logs = results[d][parent][:3]
                place = int(old_places[kept])
                o = int(np.searchsorted(base, place + lo, side="right")) - 1
                stop, unit = int(base[o] + size[o]) - lo, int(occ[o])
                node = int(lat.column[stop - place]) + unit
                options = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in banned]
                p = lat.logs(options)
                p = np.exp(p - p.max())
                u = _uniform_one(keys[d], 2000 + s, place)
                e = options[min(int(np.searchsorted(np.cumsum(p) / p.sum(), u)), len(options) - 1)]
                new_places, new_edges = [place], [e]
                at = place + int(lat.len[e])
                while at < stop:
                    node = int(lat.column[stop - at]) + unit
                    own, end = int(lat.first[node]), int(lat.first[node + 1])
                    e = min(bisect_right(lat.mono, node + _uniform_one(keys[d], s, at), own, end), end - 1)
                    new_places.append(at)
                    new_edges.append(e)
                    at += int(lat.len[e])
                t = bisect_left(where, lo + stop, a, b)
                places = np.concatenate([old_places[:kept], new_places, where[t:b] - lo])
                edges = np.concatenate([old_edges[:kept], new_edges, drawn[t:b]])
                logs = np.concatenate([old_logs[:kept], lat.logs(new_edges), log_q[t:b]])
            results[d].append((places, edges, logs, float(logs.sum()), g))
            left.append((heaps[d], places, edges, logs, kept, banned, g, keys[d], len(results[d]) - 1))
        _branch(left, lat, s, spec)
    out = []
    for d, own in enumerate(results):
        kappa = -heaps[d][0][0] if heaps[d] else -np.inf
        rows = []
        for _, edges, _, log_p, g in own:
            x = log_p - kappa
            log_in = 0.0 if x == np.inf or x > 30 else (x if x < -30 else float(np.log(-np.expm1(-np.exp(x)))))
            rows.append((_ids(lat, model, edges), log_p, g, log_in))
        out.append(rows)
    return out


def _branch(paths: list[tuple], lat: Lattice, sample: int, spec: SampleSpec, width: int = 256) -> None:
    """Push, for each new path, the sets that leave it at its place ``kept`` or later.

    All paths are done side by side on their next ``width`` places; the mass that is left falls fast, and paths whose
    mass is not spent by then, or that have not given as many sets as are wanted, are done again on more places.
    """
    paths = [p for p in paths if p[4] < len(p[2])]
    if not paths:
        return
    edge = np.zeros((len(paths), width), np.int64)
    place = np.zeros((len(paths), width), np.int64)
    own = np.zeros((len(paths), width))
    again: list[int] = []
    for k, (_, places, edges, logs, kept, _, _, _, _) in enumerate(paths):
        n = min(width, len(edges) - kept)
        edge[k, :n], place[k, :n], own[k, :n] = edges[kept : kept + n], places[kept : kept + n], logs[kept : kept + n]
    before = np.array([float(p[3][: p[4]].sum()) if p[4] else 0.0 for p in paths])
    mass = before[:, None] + np.cumsum(own, axis=1) - own
    length = np.array([len(p[2]) - p[4] for p in paths])
    inside = np.arange(width) < length[:, None]
    near = inside & (mass >= spec.least_log_mass)
    rest = np.full(mass.shape, -np.inf)
    rest[near] = lat.log_rest(edge[near])
    for k, (_, _, edges, _, kept, banned, _, _, _) in enumerate(paths):
        if banned:
            node = int(lat.from_[edges[kept]])
            options = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in banned and e != edges[kept]]
            rest[k, 0] = np.logaddexp.reduce(lat.logs(options)) if options else -np.inf
    few = np.flatnonzero((rest > -np.inf).sum(axis=1) <= spec.samples)
    if len(few):  # look behind the places that have mass
        behind = inside & ~near
        behind[:, 0] &= [not p[5] for p in paths]
        behind &= np.isin(np.arange(len(paths)), few)[:, None]
        rest[behind] = lat.log_rest(edge[behind])
    there = inside & (mass + rest > -np.inf)
    ok = there & (near | (np.cumsum(there, axis=1) <= spec.samples + 1))
    if width < length.max():
        open_ = (length > width) & ((mass[:, -1] >= spec.least_log_mass) | (ok.sum(axis=1) <= spec.samples))
        again = np.flatnonzero(open_).tolist()
    seed = np.array([p[7] for p in paths], np.uint64)
    bound = np.array([p[6] for p in paths])
    row = np.nonzero(ok)[0]
    u = _uniform(seed[row], 1000 + sample, place[ok])
    loc = (mass + rest)[ok]
    g = np.full(ok.shape, -np.inf)
    with np.errstate(over="ignore"):
        # loc - log(exp(loc - bound) - log(u)): a Gumbel at loc, truncated at the bound
        g[ok] = loc - np.logaddexp(loc - bound[row], np.log(-np.log(u)))
    best = np.argpartition(-g, min(spec.samples, width - 1), axis=1)[:, : spec.samples + 1]
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(g, best, axis=1), axis=1), axis=1)
    redo = set(again)
    for k, (heap, _, _, _, kept, banned, _, _, number) in enumerate(paths):
        if k in redo:
            continue
        for i in best[k].tolist():
            if g[k, i] == -np.inf:
                break
            heapq.heappush(heap, (-float(g[k, i]), number, kept + i, (banned if i == 0 else frozenset()) | {int(edge[k, i])}))
    if again:
        _branch([paths[k] for k in again], lat, sample, spec, width * 2)


def _ids(lat: Lattice, model: Pieces, edges: np.ndarray) -> np.ndarray:
    ids = model.piece.take(lat.state.take(edges))
    spelt = np.flatnonzero(ids < 0)
    if not len(spelt):
        return ids
    points = lat.points[lat.from_[edges[spelt]] - lat.ends]
    ids[spelt] = model.byte_id[np.minimum(points, 0x7F)]
    wide = np.flatnonzero(points > 0x7F)
    if not len(wide):
        return ids
    out, at = [], 0
    for i, p in zip(spelt[wide].tolist(), points[wide].tolist(), strict=True):
        c = chr(p)
        raw = (SPACE if c == _LITERAL else c).encode("utf-8", "surrogatepass")
        out += [ids[at:i], model.byte_id[list(raw)]]
        at = i + 1
    return np.concatenate([*out, ids[at:]])


def decode_ids(ids, model: Pieces) -> bytes:
    """UTF-8 text of piece ids, without the space put before it."""
    return b"".join(model.raw.take(np.asarray(ids, np.int64)).tolist())[1:]


def _seed_of(doc_id: int | None, spec: SampleSpec) -> int:
    return xxhash.xxh3_64_intdigest(b"null" if doc_id is None else int(doc_id).to_bytes(8, "little", signed=True), spec.seed)


def _chunks(batches, limit: int):
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = held = 0
        for i, t in enumerate(texts):
            if held and held + len(t) > limit:
                yield ids[at:i], texts[at:i]
                at, held = i, 0
            held += len(t) + 1
        if at < len(texts):
            yield ids[at:], texts[at:]


def sample_segmentations(
    docs: DataFrame, spec: SampleSpec = SampleSpec(), *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    digest: bool = False
) -> DataFrame:
    """doc_id, sample (from 1, best first), ids, log_prob, perturbed, log_inclusion of distinct sampled segmentations.

    Sampling without replacement, seeded by the row's id alone, over the lattice of the whole text. A text
    with fewer segmentations than samples gives them all, with log_inclusion 0; a null or empty text gives one without
    pieces. Rows with equal id and text draw equal samples. With ``digest`` ids are replaced by n_pieces, ids_crc32
    (little-endian 32-bit) and round_trip: whether decoding gives the text back.
    """
    path = model or default_model_path()

    def run(batches):
        m = pieces(path)
        for ids, texts in _chunks(batches, spec.batch_chars):
            seeds = np.array([_seed_of(i, spec) for i in ids], np.uint64)
            rows = [
                (i, s + 1, t, *r) for i, t, own in zip(ids, texts, sample_batch(seeds, texts, m, spec), strict=True)
                for s, r in enumerate(own)
            ]
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())]
            names = ["doc_id", "sample"]
            if digest:
                cols += [
                    pa.array([len(r[3]) for r in rows], pa.int64()),
                    pa.array([zlib.crc32(r[3].astype("<u4").tobytes()) for r in rows], pa.int64()),
                    pa.array([decode_ids(r[3], m) == r[2].encode("utf-8", "surrogatepass") for r in rows])
                ]
                names += ["n_pieces", "ids_crc32", "round_trip"]
            else:
                cols.append(pa.array([r[3] for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            cols += [pa.array([r[k] for r in rows], pa.float64()) for k in (4, 5, 6)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "log_prob", "perturbed", "log_inclusion"])

    middle = "n_pieces long, ids_crc32 long, round_trip boolean" if digest else "ids array<int>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        run, f"doc_id long, sample int, {middle}, log_prob double, perturbed double, log_inclusion double"
    )


def decode(encoded: DataFrame, *, model: str | None = None, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with ``out``: the text of the ids; invalid UTF-8 becomes the replacement character, null ids null."""
    path = model or default_model_path()
    names = [c for c in encoded.columns if c != out]
    at = names.index(ids_col)

    def run(batches):
        m = pieces(path)
        for b in batches:
            texts = [None if v is None else decode_ids(v, m).decode("utf-8", "replace") for v in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*names).schema.fields)
    return encoded.select(*names).mapInArrow(run, f"{schema}, `{out}` string")
