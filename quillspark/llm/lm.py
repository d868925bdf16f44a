"""Language-model scoring: a gated recurrent network with a class-factored softmax over corpus counts."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize, prepare, slices, spread, to_batch

#: The end of a text is counted as this token; no word holds white space.
END = b"\n"
#: The network tells so many classes of so many words apart in a corpus of up to so many distinct words, and
#: more, by the fourth root, in a larger one; all other words share one class. Ids have 16 bits.
SIDE, SIDE_WORDS, MOST_SIDE = 32, 1 << 23, 255
#: At most so many of the commonest words have counts that every worker has; those of all others are joined.
COMMON = 1 << 17
#: That join looks words up in memory, of about so many distinct ones at most in a task.
JOINED = 1 << 20
HIDDEN = 16
#: Network training reads whole texts in TOGETHER lanes, with state carried over windows of so many tokens.
WINDOW, TOGETHER = 32, 256
#: Texts scored side by side, tokens of one span of their steps, and tokens gathered before they are scored.
STREAMS, SPAN, HELD_TOKENS = 256, 16384, 4_000_000
#: Words of so many bytes, with their lengths, are counted together.
GATHERED_BYTES = 48 << 20
#: Up to so many tokens, words of all classes are looked at in one step.
FEW = 64
#: Tokens whose classes are looked at together, for the same cache.
PART = 4096
#: Bytes that are asked of the system at once: such blocks get large pages where small ones don't.
BLOCK = 16 << 20
#: Columns that lie beside those of a matrix.
PAD = 16
#: Steps whose factors of the gradient are made together: they stay in a core's own cache.
STEPS = 8
_ENCODED = {"row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "n_rest": pa.int64(), "logs": pa.float64(), "rest_logs": pa.float64(), "rare": pa.list_(pa.binary()), "ids": pa.binary()}


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``words`` gives of each text (null as empty), one after the other, and where those of each end; no word becomes a Python object."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    found = lists.values
    some = pc.greater(pc.binary_length(found), 0)  # white space at either end of a text makes an empty one
    ends = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy()[1:]]
    return found.filter(some).cast(pa.binary()), ends


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words."""
    held: list[pa.Array] = []
    waiting = texts = 0

    def flush() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return to_batch({"word": (found.field("values"), pa.binary()), "n": (found.field("counts"), pa.int64())})

    for batch in batches:
        for part in slices(batch, "text"):
            found, _ = _words(part.column("text"))
            held.append(found)
            waiting += found.nbytes
            texts += part.num_rows
            if waiting > GATHERED_BYTES:
                yield flush()
                held, waiting = [], 0
    yield flush()
    yield to_batch({"word": ([END] if texts else [], pa.binary()), "n": ([texts] if texts else [], pa.int64())})


class Workspace:
    """Arrays by name that windows use again, one after the other: a new one each time would cost more in page faults than its arithmetic."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}
        self.left = np.empty(0, np.uint8)

    def _new(self, size: int) -> np.ndarray:
        """So many bytes of a block, or more than a block."""
        if (size := -(-size // 64) * 64 + 7 * 64) > len(self.left):  # arrays begin at places of their own within pages
            block = np.empty(max(size, BLOCK) + 4096, np.uint8)
            self.left = block[-block.ctypes.data % 4096 :]
        found, self.left = self.left[:size], self.left[size:]
        return found

    def flat(self, name: str, size: int, kind: np.dtype) -> np.ndarray:
        """So many entries with any values in them."""
        found = self.held.get(name)
        if found is None or len(found) < size or found.dtype != kind:
            itemsize = np.dtype(kind).itemsize
            found = self.held[name] = self._new(size * itemsize)[: size * itemsize].view(kind)
        return found[:size]

    def __call__(self, name: str, rows: int, columns: int, kind: np.dtype) -> np.ndarray:
        """A contiguous array of that shape, and PAD columns to be left alone; rows lie apart by no power of two, so that they don't share lines of the cache."""
        return self.flat(name, rows * (columns + PAD), kind).reshape(rows, columns + PAD)

    def pick(self, name: str, x: np.ndarray, at: np.ndarray, more: int = 0) -> np.ndarray:
        """Columns ``at`` of a contiguous array, like what ``__call__`` gives, above so many more rows with any values in them."""
        out, padded = self(name, len(x) + more, len(at), x.dtype), np.zeros(len(at) + PAD, np.intp)
        padded[: len(at)] = at
        np.take(x, padded, axis=1, out=out[: len(x)], mode="clip")
        return out


@dataclass
class Network:
    """Parameters; word i of the vocabulary is of class i // side, and the id after the last one stands for all other words.

    States and gates are matrices with a column for each text.
    """

    p: dict[str, np.ndarray]

    @property
    def side(self) -> int:
        """The number of classes, and of words in each."""
        return len(self.p["ob"])

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, the gates z and r of the step (one above the other), what the state adds to the candidate, and the candidate."""
        kind = np.result_type(gates, h)
        return self.step_into(_turned(gates), h, tuple(np.empty((rows * HIDDEN, h.shape[1]), kind) for rows in (1, 2, 1, 1)))

    def step_into(self, turned: np.ndarray, h: np.ndarray, into: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """What ``step`` gives, in ``into``; of the inputs, those of z and r have the other sign."""
        n = HIDDEN
        new, zr, added, c = into
        np.matmul(self.p["u"][:, : 2 * n].T, h, out=zr)
        np.subtract(turned[: 2 * n], zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.matmul(self.p["u"][:, 2 * n :].T, h, out=added)
        added *= zr[n:]
        np.add(added, turned[2 * n :], out=c)
        np.tanh(c, out=c)
        np.subtract(h, c, out=new)
        new *= zr[:n]
        new += c
        return into


def _turned(gates: np.ndarray) -> np.ndarray:
    """A contiguous copy of inputs (columns) with the other sign for z and r."""
    found = np.array(gates, order="C")
    np.negative(found[: 2 * HIDDEN], out=found[: 2 * HIDDEN])
    return found


def side_of(distinct: int) -> int:
    """Classes for a corpus of so many distinct words."""
    return min(MOST_SIDE, max(SIDE, round(SIDE * (distinct / SIDE_WORDS) ** 0.25)))


def fresh(counts: np.ndarray, rest: int, side: int = SIDE, seed: int = 5) -> Network:
    """A network that, untrained, gives the unigram probabilities of the counts (of the vocabulary, and of all other tokens)."""
    rng = np.random.default_rng(seed)
    normal = lambda *s, by: rng.normal(0, by, s).astype(np.float32)
    c = np.zeros(side * side)
    c[: len(counts)] = counts
    smooth = c + np.where(np.arange(len(c)) < max(1, len(counts)), 0.5, 1e-3)
    per_class = smooth.reshape(side, side)
    class_share = np.append(per_class.sum(1), rest + 1.0)
    return Network(
        {
            "w": normal(side * side + 1, 3 * HIDDEN, by=0.3),
            "u": normal(HIDDEN, 3 * HIDDEN, by=1 / math.sqrt(HIDDEN)),
            "c": normal(HIDDEN, side + 1, by=0.01),
            "cb": np.log(class_share / class_share.sum()).astype(np.float32),
            "o": normal(side, HIDDEN, side, by=0.01),
            "ob": np.log(per_class / per_class.sum(1, keepdims=True)).astype(np.float32),
        }
    )


def _softmax_of(x: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(x) in place of x, less its maxima if x may exceed ``bound`` of 60, its sums and the logarithms of the sums of exp(x), over the first axis."""
    top: np.ndarray | float = 0.0
    if bound > 60:  # else nothing can overflow, or vanish beside the rest
        top = x.max(0)
        x -= top
    np.exp(x, out=x)
    total = x.sum(0)
    return x, total, top + np.log(total)


def log_probabilities(net: Network, h: np.ndarray, target: np.ndarray, grad: dict[str, np.ndarray] | None = None, work: Workspace | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural logarithm of each target's probability after its state (a column of h, between -1 and 1); with grad also adds its gradients there and gives that of h.

    h may have more columns than there are targets. What it gives of h lies in ``work`` until the next call.
    """
    work = work or Workspace()
    side, tokens, n = net.side, len(target), len(h)
    of = (target // side).astype(np.uint8)  # the class; that after the last one is of all other words
    dtype = np.result_type(h, net.p["c"])
    limit = max(h[:, :tokens].max(initial=0), -h[:, :tokens].min(initial=0))
    order = np.argsort(of, kind="stable")  # tokens class by class, those of other words last
    of, every = of[order], np.arange(tokens)
    bounds = np.searchsorted(of, np.arange(side + 1)).tolist()
    known = bounds[side]
    a = work.pick("ahead", h, order, 1)[:, :tokens]
    a[n] = 1  # the biases are one more row of the weights
    ranges = [(k, a, b) for k, (a, b) in enumerate(zip(bounds, [*bounds[1:], tokens], strict=True)) if a < b]
    c, found, dh = np.vstack((net.p["c"], net.p["cb"])).T, np.empty(tokens, dtype), work("dh", n, tokens, dtype)
    bound = float((limit * np.abs(net.p["c"]).sum(0) + np.abs(net.p["cb"])).max())
    for begin in range(0, tokens, PART):
        part = slice(begin, min(begin + PART, tokens))
        m = part.stop - begin
        x, logs = np.matmul(c, a[:, part], out=work("classes", side + 1, m, dtype)[:, :m]), found[part]
        here = [(k, slice(max(a - begin, 0), b - begin)) for k, a, b in ranges if a < part.stop and b > begin]
        for k, at in here:
            logs[at] = x[k, at]
        e, total, log = _softmax_of(x, bound)
        logs -= log
        if grad is not None:
            e *= 1 / total
            for k, at in here:
                e[k, at] -= 1
            of_c = a[:, part] @ e.T
            grad["c"] += of_c[:n]
            grad["cb"] += of_c[n]
            np.matmul(net.p["c"], e, out=dh[:, part])
    most = limit * np.abs(net.p["o"]).sum(1) + np.abs(net.p["ob"])
    own, of, ranges = every[:known], of[:known], [(k, slice(a, b)) for k, a, b in ranges if k < side]
    within = target[order[:known]] % side
    x, ak = work("words", side, known, dtype)[:, :known], a[:, :known]
    o = np.concatenate((net.p["o"], net.p["ob"][:, None]), 1)
    if known <= FEW:  # too few tokens to go class by class
        x[:] = np.matmul(ak.T[:, None], o[of])[:, 0].T
    else:
        for k, part in ranges:
            np.matmul(o[k].T, a[:, part], out=x[:, part])
    logs = x[within, own]
    e, total, log = _softmax_of(x, float(most.max()))
    logs -= log
    found[:known] += logs
    if grad is not None:
        e *= 1 / total
        e[within, own] -= 1
        if known <= FEW:
            np.add.at(grad["o"], of, ak[:n].T[:, :, None] * e.T[:, None])
            np.add.at(grad["ob"], of, e.T)
            dh[:, :known] += np.matmul(net.p["o"][of], e.T[:, :, None])[:, :, 0].T
        else:
            dk, of_o = work("dk", n, known, dtype)[:, :known], np.zeros_like(o)
            for k, part in ranges:
                np.matmul(a[:, part], e[:, part].T, out=of_o[k])
                np.matmul(net.p["o"][k], e[:, part], out=dk[:, part])
            grad["o"] += of_o[:, :n]
            grad["ob"] += of_o[:, n]
            dh[:, :known] += dk
        place = np.empty(tokens, np.intp)
        place[order] = every
        dh = work.pick("of_h", dh, place)[:, :tokens]
    out = np.empty(tokens, dtype)
    out[order] = found
    return out, None if grad is None else dh


class Lanes:
    """Whole texts laid end to end in a number of lanes of about the same length, which are read side by side.

    Beside the ids of the texts and their owners, memory is of some steps, however long a text is.
    """

    def __init__(self, texts: list[np.ndarray], most: int, rng: np.random.Generator | None = None):
        heap = [(0, s) for s in range(min(most, len(texts)))]
        lanes: list[list[int]] = [[] for _ in heap]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):  # the longest first, to the lane with least
            used, s = heapq.heappop(heap)
            lanes[s].append(i)
            heapq.heappush(heap, (used + len(texts[i]), s))
        if rng is not None:  # else lanes go from long texts to short ones all at once
            lanes = [[x[i] for i in rng.permutation(len(x))] for x in lanes]
        lanes.sort(key=lambda x: -sum(len(texts[i]) for i in x))
        self.ids = [np.concatenate([texts[i] for i in x]) for x in lanes]
        self.owner = [np.repeat(np.array(x, np.int32), [len(texts[i]) for i in x]) for x in lanes]
        self.falling = np.array([-len(x) for x in self.ids], np.int64)

    def windows(self, begin: int, steps: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
        """Inputs, targets, whether a text begins, the text's number, each with a row for a step, and the lanes that live at each step, which never grow.

        Windows have ``steps`` steps, or, without, as many as hold SPAN tokens. The first input of a text is ``begin``.
        """
        lanes, total, t0 = len(self.ids), -int(self.falling.min(initial=0)), 0
        last, last_owner = np.zeros(lanes, np.int32), np.full(lanes, -1, np.int32)
        while t0 < total:
            width = int(np.searchsorted(self.falling, -t0))
            each = steps or max(1, SPAN // width)
            n = min(total - t0, each * max(1, 1024 // each))  # some windows at once
            ids, own = np.zeros((n + 1, width), np.int32), np.full((n + 1, width), -1, np.int32)
            ids[0], own[0] = last[:width], last_owner[:width]
            for s in range(width):
                part = self.ids[s][t0 : t0 + n]
                ids[1 : len(part) + 1, s], own[1 : len(part) + 1, s] = part, self.owner[s][t0 : t0 + n]
            new = own[1:] != own[:-1]
            source = np.where(new, np.int32(begin), ids[:-1])
            live = np.searchsorted(self.falling, -np.arange(t0, t0 + n)).tolist()
            for a in range(0, n, each):
                at = slice(a, a + each), slice(live[a])
                yield source[at], ids[1:][at], new[at], own[1:][at], live[a : a + each]
            last, last_owner, t0 = ids[-1], own[-1], t0 + n


def _columns(live: list[int]) -> list[slice]:
    """The columns of each step of a window, where those of all steps lie side by side."""
    ends = np.cumsum(live).tolist()
    return [slice(end - m, end) for m, end in zip(live, ends, strict=True)]


def _flat(x: np.ndarray, live: list[int]) -> np.ndarray:
    """The entries of the lanes that live, in the order of ``_columns``."""
    return x.ravel() if live[-1] == x.shape[1] else x[np.arange(x.shape[1])[None] < np.array(live)[:, None]]


def _begins(new: np.ndarray, live: list[int]) -> list[np.ndarray]:
    """At each step, the lanes that live and begin a text."""
    step, lane = np.nonzero(new if live[-1] == new.shape[1] else new & (np.arange(new.shape[1]) < np.array(live)[:, None]))
    ends = np.searchsorted(step, np.arange(len(live) + 1)).tolist()
    return [lane[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _run(net: Network, turned: np.ndarray, source: np.ndarray, begins: list[np.ndarray], live: list[int], h: np.ndarray, work: Workspace, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """States after the steps of a window, a column for each token (and more columns), whose inputs are columns of the turned table.

    With keep also, step after step, the state before, z, r, what the state adds to the candidate, and the candidate.
    """
    n, total, kind = HIDDEN, len(source), turned.dtype
    states, cells = work("states", n, total, kind), work.flat("kept", 5 * n * (total if keep else 2 * live[0]), kind)
    spare, m = work.flat("gates", 4 * n * live[0], kind), 0
    for t, (at, begun) in enumerate(zip(_columns(live), begins, strict=True)):
        place = 5 * n * (at.start if keep else t % 2 * live[0])
        if same := m == live[t]:
            own = after
        else:
            m = live[t]
            gates, last = spare[: 3 * n * m].reshape(3 * n, m), spare[3 * n * m : 4 * n * m].reshape(n, m)
            own = cells[place : place + 5 * n * m].reshape(5 * n, m)  # what belongs to a step lies together
        before = own[:n]
        if not same:
            before[:] = h[:, :m]
        if len(begun):
            before[:, begun] = 0
        if t + 1 < len(live) and live[t + 1] == m:  # the next state is where the next step looks for it
            after = cells[5 * n * (at.stop if keep else (t + 1) % 2 * live[0]) :][: 5 * n * m].reshape(5 * n, m)
            new = after[:n]
        else:
            new = last
        turned.take(source[at], axis=1, out=gates, mode="clip")
        h = net.step_into(gates, before, (new, own[n : 3 * n], own[3 * n : 4 * n], own[4 * n :]))[0]
        states[:, at] = h
    return states, cells


def _window(net: Network, source: np.ndarray, target: np.ndarray, new: np.ndarray, live: list[int], h: np.ndarray, grad: dict[str, np.ndarray], work: Workspace | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Adds the gradients of a window of lanes to grad; gives the state after it, and the words of w in use with their gradients."""
    work = work or Workspace()
    n, kind, begins = HIDDEN, net.p["w"].dtype, _begins(new, live)
    source, target = _flat(source, live), _flat(target, live)
    total = len(source)
    order = np.argsort(source.astype(np.uint16), kind="stable")
    ordered = source[order]
    first = np.append(True, ordered[1:] != ordered[:-1])
    starts = np.flatnonzero(first)
    used, place = ordered[starts], np.empty(total, np.intp)  # the words in use, and which of them each input is
    place[order] = np.cumsum(first) - 1
    states, cells = _run(net, _turned(net.p["w"][used].T), place, begins, live, h, work, True)
    _, back = log_probabilities(net, states, target, grad, work)
    of_gates, carry = work("of_gates", 3 * n, total, kind), np.zeros((n, 0), kind)
    weights, of_u = np.roll(net.p["u"], n, axis=1), np.zeros((n, 3 * n), kind)
    columns, stop = _columns(live), len(live)
    while stop:  # some steps of as many lanes, from the last ones on
        m, start = live[stop - 1], stop - 1
        while start and live[start - 1] == m and stop - start < STEPS:
            start -= 1
        k, at = stop - start, slice(columns[start].start, columns[stop - 1].stop)
        before, z, r, added, cand = cells[5 * n * at.start : 5 * n * at.stop].reshape(k, 5, n, m).swapaxes(0, 1)
        own = work.flat("own", 4 * k * n * m, kind).reshape(k, 4, n, m)  # of a step: what the gradient of its state is multiplied by
        of_un, of_z, of_r, of_c = own.swapaxes(0, 1)
        rest, spare = work.flat("rest", k * n * m, kind).reshape(k, n, m), work.flat("spare", 2 * n * m, kind).reshape(2, n, m)
        np.subtract(1, z, out=rest)
        np.multiply(cand, cand, out=of_c)
        np.subtract(1, of_c, out=of_c)
        of_c *= rest
        np.subtract(before, cand, out=of_z)
        of_z *= z
        of_z *= rest
        np.multiply(of_c, r, out=of_un)  # what the state adds to the candidate goes through r
        np.subtract(1, r, out=of_r)
        of_r *= added
        of_r *= of_c
        by_step, d = own.reshape(k, 4 * n, m), spare[0]
        for t in range(stop - 1, start - 1, -1):
            if carry.shape[1] == m:
                np.add(back[:, columns[t]], carry, out=d)
            else:
                d[:] = back[:, columns[t]]
                d[:, : carry.shape[1]] += carry
            own[t - start] *= d
            carry = np.matmul(weights, by_step[t - start, : 3 * n], out=spare[1])
            d *= z[t - start]
            carry += d
            if len(begins[t]):  # what came before is another text
                carry[:, begins[t]] = 0
        if start and live[start - 1] != m:
            carry = carry.copy()  # its place is for other lanes
        of_u += np.matmul(before, by_step[:, : 3 * n].swapaxes(1, 2)).sum(0)
        of_gates[:, at].reshape(3 * n, k, m)[:] = by_step[:, n:].swapaxes(0, 1)
        stop = start
    grad["u"] += np.roll(of_u, -n, axis=1)
    few, dw = len(used) - 1, np.empty((len(used), 3 * n), kind)  # the last word mostly stands for all others: its inputs are added up where they are
    if few:
        some = work.pick("some", of_gates, order[: starts[few]])[:, : starts[few]]
        dw[:few] = np.add.reduceat(some, starts[:few], axis=1).T
    dw[few] = of_gates[:, :total] @ (place == few).astype(kind)
    return states[:, total - live[-1] : total].copy(), (used, dw)


def train_lanes(net: Network, texts: list[np.ndarray], rate: float = 0.05, memory: dict[str, np.ndarray] | None = None, lanes: int = TOGETHER, seed: int = 7) -> int:
    """AdaGrad over whole texts (ids after the end that each begins from); gives the tokens trained on."""
    memory = {k: np.full_like(v, 1e-3) for k, v in net.p.items()} if memory is None else memory
    h, trained, work = np.zeros((HIDDEN, lanes), net.p["w"].dtype), 0, Workspace()
    for source, target, new, _, live in Lanes(texts, lanes, np.random.default_rng(seed)).windows(0, WINDOW):  # truncated: gradients end at the window, the state goes on
        grad = {k: np.zeros_like(v) for k, v in net.p.items() if k != "w"}
        h, (used, dw) = _window(net, source, target, new, live, h, grad, work)
        size = np.float32(live[0])
        dw /= size
        seen = memory["w"][used]
        seen += dw * dw
        memory["w"][used] = seen
        dw *= rate
        dw /= np.sqrt(seen, out=seen)
        net.p["w"][used] -= dw
        for k, g in grad.items():
            g /= size
            memory[k] += g * g
            g *= rate
            g /= np.sqrt(memory[k])
            net.p[k] -= g
        trained += sum(live)
    return trained


def _average(nets: list[tuple[bytes, int]]) -> tuple[bytes, int]:
    total = sum(n for _, n in nets) or 1
    out: dict[str, np.ndarray] = {}
    for raw, n in nets:
        for k, v in pickle.loads(raw).items():
            out[k] = out.get(k, 0) + v * np.float32(n / total)
    return pickle.dumps(out), sum(n for _, n in nets)


def train_texts(net: Network, texts: Iterator[np.ndarray], rate: float, held_tokens: int = HELD_TOKENS) -> int:
    """Trains on every token of the texts, some held at a time; gives their number."""
    memory = {k: np.full_like(v, 1e-3) for k, v in net.p.items()}
    held: list[np.ndarray] = []
    waiting = trained = 0
    for text in texts:
        held.append(text)
        waiting += len(text)
        if waiting >= held_tokens:
            trained += train_lanes(net, held, rate, memory, seed=trained)
            held, waiting = [], 0
    return trained + train_lanes(net, held, rate, memory, seed=trained)


def train_network(texts: DataFrame, net: Network, rounds: int = 2, fan_in: int = 8) -> Network:
    """Every partition trains a copy on all its texts; copies are averaged by tokens, ``fan_in`` at a time, and go into the next round.

    A round is one job: copies wait in its shuffle, and only those that are lost are trained again.
    """
    context = texts.sparkSession.sparkContext
    partitions = texts.rdd.getNumPartitions()
    for turn in range(rounds):
        sent = context.broadcast(pickle.dumps(net.p))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, rate=0.05 / (1 + turn)) -> Iterator[pa.RecordBatch]:
            own = Network(pickle.loads(sent.value))
            if trained := train_texts(own, (np.frombuffer(x, np.uint16) for batch in batches for x in batch.column("ids").to_pylist()), rate):
                yield to_batch({"part": ([TaskContext.get().partitionId()], pa.int64()), "net": ([pickle.dumps(own.p)], pa.binary()), "n": ([trained], pa.int64())})

        def average(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            raw, n = _average(list(zip(pdf["net"], pdf["n"].tolist(), strict=True)))
            return pd.DataFrame({"part": [int(pdf["group"].iloc[0])], "net": [raw], "n": [n]})

        nets, parts = texts.select("ids").mapInArrow(learn, "part long, net binary, n long"), partitions
        while parts > 1:
            parts = -(-parts // fan_in)
            nets = nets.withColumn("group", F.floor(F.col("part") / fan_in)).groupBy("group").applyInPandas(average, "part long, net binary, n long")
        for found in nets.collect():  # one at most
            net = Network(pickle.loads(found["net"]))
    return net


def log_scores(net: Network, texts: list[np.ndarray], lanes: int = STREAMS) -> np.ndarray:
    """log10 probability of each whole text's ids by the network, all words outside its vocabulary as one; the state is carried to its end."""
    out, h, work = np.zeros(len(texts)), np.zeros((HIDDEN, lanes), np.float32), Workspace()
    turned = _turned(net.p["w"].T)
    for source, target, new, own, live in Lanes(texts, lanes).windows(0):
        total = sum(live)
        states = _run(net, turned, _flat(source, live), _begins(new, live), live, h, work)[0]
        got, _ = log_probabilities(net, states, _flat(target, live), None, work)
        out += np.bincount(_flat(own, live), got, len(texts))
        h = states[:, total - live[-1] : total].copy()
    return out / math.log(10)


def _common(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The end, then at most COMMON words with their counts, the commonest first.

    Counts fall into levels, 16 to a doubling; the highest levels are taken as long as their
    words are not too many in all. Only numbers of words by level and the words taken reach
    the driver, however many partitions there are.
    """
    known = counts.where(F.octet_length("word") <= 256).withColumn("level", F.floor(16 * F.log2("c")))
    sizes, least, total = known.groupBy("level").agg(F.count("*").alias("n")).collect(), None, 0
    for level, n in sorted(map(tuple, sizes), reverse=True):
        if (total := total + n) > COMMON:
            break
        least = level
    found = {} if least is None else {bytes(r["word"]): r["c"] for r in known.where(F.col("level") >= least).collect()}
    found.pop(END, None)  # it may be of a level that is not taken, but is in the table whatever its count
    end = counts.where(F.col("word") == F.lit(END)).first()
    return [(END, end["c"] if end else 0), *sorted(found.items(), key=lambda x: (-x[1], x[0]))]


def _encoded(source: DataFrame, common: list[tuple[bytes, int]], vocabulary: int) -> DataFrame:
    """Each text's row, ids of the network (16 bits each), sums over its common words and its other words (rare)."""
    sent = source.sparkSession.sparkContext.broadcast(common)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = sent.value, TaskContext.get().partitionId() << 33
        numbered = pa.array([w for w, _ in known], pa.binary())
        logs = np.array([math.log10(c + 1) for _, c in known] + [0.0])
        counted = np.array([c > 0 for _, c in known] + [False])
        for batch in batches:
            for part in slices(batch, "text"):
                found, ends = _words(part.column("text"))
                place, texts = pc.index_in(found, numbered), np.arange(part.num_rows)
                at = np.zeros(len(found) + len(texts), np.int32)  # the end is the first of the common words
                inner = np.ones(len(at), bool)
                inner[ends + texts] = False
                at[inner] = place.fill_null(len(known)).to_numpy()
                begins, n_tokens = np.append(0, (ends + texts + 1)[:-1]), np.diff(ends, prepend=0) + 1
                rare, rest = at == len(known), at >= vocabulary
                log, other = logs[at], rare | rest
                values = {
                    "row": row + texts,
                    "doc_id": part.column("doc_id"),
                    "held_out": part.column("held_out"),
                    "n_tokens": n_tokens,
                    "n_known": np.add.reduceat(counted[at], begins, dtype=np.int64),
                    "n_rest": np.add.reduceat(other, begins, dtype=np.int64),
                    "logs": np.add.reduceat(log, begins),
                    "rest_logs": np.add.reduceat(np.where(rest, log, 0.0), begins),
                    "rare": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.add.reduceat(rare, begins, dtype=np.int64))), pa.int32()), found.filter(place.is_null())),
                    "ids": pa.Array.from_buffers(pa.binary(), len(texts), [None, *(pa.py_buffer(x) for x in (np.append(0, 2 * np.cumsum(n_tokens)).astype(np.int32), np.where(other, vocabulary, at).astype(np.uint16)))]),
                }
                row += len(texts)
                yield to_batch({name: (values[name], kind) for name, kind in _ENCODED.items()})

    return source.mapInArrow(encode, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, n_rest long, logs double, rest_logs double, rare array<binary>, ids binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each whole text.

    Tokens are the words of the text, A-Z in lower case, and one end. Counts cover all texts
    outside the held-out seventh. base_score is the add-one unigram score of the contract.
    score is that of a gated recurrent network: class, then word within the class, each by a
    softmax of the state, which starts at zero with a text and is carried to its end. Words
    outside the vocabulary share a class; within it a word has (c + 1) / (tokens + words + 1)
    of all counts there, so every text has a positive probability. The network learns by
    truncated backpropagation from every token of every training text, its state carried over
    the text's windows, each partition for itself, and the copies are averaged.

    Null text counts as empty (an end alone). Without training texts all counts are 0. A null
    id counts as an empty one for the split. Repeated rows are scored each; other columns are
    ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    key = F.col(id_col).cast("long")
    source = spread(docs).select(key.alias("doc_id"), (crc_mod(key, 7) == 2).alias("held_out"), F.col(text_col).alias("text"))

    training = source.where(~F.col("held_out")).select("text")
    counts = materialize(training.mapInArrow(_gather, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    common = _common(counts)
    side = side_of(distinct)
    vocabulary = common[: side * side]
    inside = sum(c for _, c in vocabulary)
    encoded = materialize(_encoded(source, common, side * side), "encoded")
    net = fresh(np.array([c for _, c in vocabulary], float), tokens - inside, side)
    net = train_network(encoded.where(~F.col("held_out")).select("ids"), net)
    sent = spark.sparkContext.broadcast(pickle.dumps(net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, waiting = Network(pickle.loads(sent.value)), [], 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            found = log_scores(own, [np.frombuffer(x, np.uint16) for x in whole["ids"].to_pylist()])
            return whole.drop_columns(["ids"]).append_column("net", pa.array(found, pa.float64())).combine_chunks().to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                waiting += batch.column("ids").nbytes // 2
            if waiting >= HELD_TOKENS:
                yield flush()
                held, waiting = [], 0
        if held:
            yield flush()

    columns = ["row", "doc_id", "held_out", "n_tokens", "n_known", "n_rest", "logs", "rest_logs"]
    scored = encoded.select(*columns, "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, n_rest long, logs double, rest_logs double, net double")
    rare, known, parts = encoded.select("row", F.explode("rare").alias("word")), counts, -(-distinct // JOINED)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        rare, known = (x.repartition(parts, "word") for x in (rare, known))
    found = rare.join(known.hint("shuffle_hash"), "word")  # looked up: to sort words took half of the JVM's time
    found = found.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_logs"), F.count("*").alias("rare_known"))
    scored = scored.join(found, "row", "left").withColumn("rare_logs", F.coalesce("rare_logs", F.lit(0.0)))
    base = math.log10(tokens + distinct + 1)
    rest = math.log10(tokens - inside + max(0, distinct - sum(c > 0 for _, c in vocabulary)) + 1)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("net") + F.col("rest_logs") + F.col("rare_logs") - F.col("n_rest") * F.lit(rest)).alias("score"),
    )
