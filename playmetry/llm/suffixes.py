"""Suffix-array dedup: front-coded runs of sorted suffixes, merged by loser trees that know common prefixes."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest
from zstandard import compress, decompress

from playmetry.llm.common import GOLDEN, join_hot, mix64, settle

#: Bytes of an anchor, and holders from which an anchor's windows are sorted one by one.
GRAM, CROWD = 16, 1 << 16
#: Bytes of text in a run: grows with the root of the input between these bounds.
RUN_LEAST, RUN_MOST = 8 << 20, 64 << 20
#: Bytes of text for each range of the anchor exchange and of the suffix exchange.
ANCHOR_RANGE, SUFFIX_RANGE = 32 << 20, 8 << 20
#: Texts (about) and strings of each that choose where ranges begin; they decide balance, not results.
SAMPLE_TEXTS, SAMPLE_STRINGS = 1000, 32
#: Windows that are hashed at once, and strings whose answers are.
BLOCK, ANSWERS = 1 << 18, 1 << 15


# ---------------------------------------------------------------- anchors


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` bytes, read as 8-byte words at every place."""
    n = len(data) - gram + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.full(n, gram, np.uint64)
    for at in [*range(0, gram - 8, 8), gram - 8]:
        out = mix64((out ^ words[at : at + n]) * GOLDEN)
    return out


@dataclass
class Anchors:
    """Anchors of texts laid end to end: key, place, first and last window they stand for, text."""

    key: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray


def anchors_of(data: bytes, ends: np.ndarray, length: int, gram: int) -> Anchors:
    """Every window of `length` bytes inside one text belongs to one anchor: its gram of least hash.

    Of equal hashes the leftmost counts, so the bytes of a window alone decide, and equal
    windows choose equal anchors at equal offsets. The offset rides in the low bits of the
    hash while windows are doubled in width.
    """
    span = length - gram + 1
    low_bits = np.uint64((1 << span.bit_length()) - 1)
    starts = np.concatenate([[0], ends[:-1]])
    parts = []
    for begin in range(0, len(data) - length + 1, BLOCK):
        n = min(BLOCK, len(data) - length + 1 - begin)
        hashes = gram_hashes(np.frombuffer(data, np.uint8, n + length - 1, begin), gram)
        least, width = hashes & ~low_bits, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:] + np.uint64(width))
            width *= 2
        if width < span:
            more = span - width
            least = np.minimum(least[: len(least) - more], least[more:] + np.uint64(more))
        at = np.arange(n) + (least & low_bits).astype(np.int64)
        opens = np.concatenate([[True], at[1:] != at[:-1]])
        inner = starts[np.searchsorted(starts, begin) : np.searchsorted(starts, begin + n)]
        opens[inner - begin] = True
        first = np.flatnonzero(opens)
        last = np.append(first[1:], n) - 1
        text = np.searchsorted(ends, first + begin, side="right")
        last = np.minimum(last, ends[text] - length - begin)
        some = first <= last
        first, last, text = first[some], last[some], text[some]
        parts.append((mix64(hashes[at[first]]), at[first] + begin, first + begin, last + begin, text))
    if not parts:
        none = np.zeros(0, np.int64)
        return Anchors(none.astype(np.uint64), none, none, none, none)
    return Anchors(*(np.concatenate(c) for c in zip(*parts)))


@dataclass
class Run:
    """Texts of one run in the order of key and checksum, equal rows once."""

    ids: np.ndarray
    tags: np.ndarray
    data: bytes
    ends: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Run:
        texts = table.column("text").cast(pa.binary()).to_pylist()
        rows = sorted({(i, xxh3_64_intdigest(t)): t for i, t in zip(table.column("id").to_pylist(), texts)}.items())
        held = [t for _, t in rows]
        return cls(
            np.array([i for (i, _), _ in rows], np.int64), np.array([g for (_, g), _ in rows], np.uint64), b"".join(held), np.cumsum([len(t) for t in held], dtype=np.int64)
        )

    def text(self, k: int) -> bytes:
        return self.data[self.ends[k - 1] if k else 0 : self.ends[k]]


# ---------------------------------------------------------------- sorted suffixes of a run


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree in `known` bytes; only what follows is read."""
    n = min(len(a), len(b))
    differing = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differing.bit_length() + 7) // 8


@dataclass
class Suffixes:
    """Distinct sorted strings of a run with their holders.

    A string is b"a", then the bytes from an anchor to the end of its last window (`right` of
    them), then the bytes before the anchor, backwards, to the start of its first window. For
    an anchor in a crowd it is b"w" and one window, `right` being 0.
    """

    strings: list[bytes]
    right: np.ndarray
    begins: np.ndarray
    text: np.ndarray
    at: np.ndarray


def sorted_suffixes(run: Run, shared: np.ndarray, crowd: np.ndarray, length: int, gram: int) -> Suffixes:
    """Strings of the anchors whose key is in `shared` (ascending), in order; `crowd` marks keys sorted by windows."""
    found = anchors_of(run.data, run.ends, length, gram)
    place = np.minimum(np.searchsorted(shared, found.key), max(len(shared) - 1, 0))
    hit = np.flatnonzero(shared[place] == found.key) if len(shared) else np.zeros(0, np.int64)
    data, rows = run.data, []
    for k, many in zip(hit.tolist(), crowd[place[hit]].tolist()):
        a, f, last, t = int(found.at[k]), int(found.first[k]), int(found.last[k]), int(found.text[k])
        if many:
            rows.extend((b"w" + data[j : j + length], 0, t, j) for j in range(f, last + 1))
        else:
            rows.append((b"a" + data[a : last + length] + data[f:a][::-1], last + length - a, t, a))
    rows.sort()
    opens = [k for k, r in enumerate(rows) if not k or r[:2] != rows[k - 1][:2]]
    return Suffixes(
        [rows[k][0] for k in opens], np.array([rows[k][1] for k in opens], np.int64), np.array([*opens, len(rows)], np.int64),
        np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64),
    )


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(bytes shared with the string before, bytes that follow, these bytes) of sorted strings."""
    shared = [0] + [common_prefix(a, b, 0) for a, b in zip(strings, strings[1:])]
    tails = [s[n:] for s, n in zip(strings, shared)]
    return np.array(shared, np.uint16), np.array([len(t) for t in tails], np.uint16), b"".join(tails)


def decoded(shared: np.ndarray, sizes: np.ndarray, tails: bytes) -> Iterator[tuple[int, bytes]]:
    """(bytes shared with the string before, string) of a front-coded run, one after the other."""
    now, at = b"", 0
    for n, size in zip(shared.tolist(), sizes.tolist()):
        now = now[:n] + tails[at : at + size]
        at += size
        yield n, now


# ---------------------------------------------------------------- merging runs


def merge(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(prefix shared with the string before, run, string) of all runs in order, by a loser tree.

    Every head and every loser carries how many bytes it shares with the string given out
    last. Of two such strings the one that shares more comes first, without a look at either;
    if both share as much, comparing begins behind those bytes, and the loser keeps what it
    shares with the winner. A run's next head brings its number from the front coding. So no
    byte that is known to be equal is compared again.
    """
    width = 1
    while width < len(runs):
        width *= 2
    runs = [*runs, *(iter(()) for _ in range(width - len(runs)))]
    heads, known = [], []
    for r in runs:
        _, s = next(r, (0, None))
        heads.append(s)
        known.append(0 if s is not None else -1)
    losers, shared = [0] * width, [-1] * width

    def play(node: int) -> int:
        if node >= width:
            return node - width
        a, b = play(2 * node), play(2 * node + 1)
        if known[a] == known[b] and known[a] >= 0:
            n = common_prefix(heads[a], heads[b], known[a])
            if heads[a][n : n + 1] > heads[b][n : n + 1]:
                a, b = b, a
            losers[node], shared[node] = b, n
        else:
            if known[a] < known[b]:
                a, b = b, a
            losers[node], shared[node] = b, known[b]
        return a

    winner = play(1) if width > 1 else 0
    lead = known[winner]
    while lead >= 0:
        yield lead, winner, heads[winner]
        lead, heads[winner] = next(runs[winner], (-1, None))
        node = (winner + width) >> 1
        while node:
            theirs = shared[node]
            if theirs > lead:
                losers[node], winner = winner, losers[node]
                shared[node], lead = lead, theirs
            elif theirs == lead >= 0:
                a, b = heads[winner], heads[losers[node]]
                n = common_prefix(a, b, lead)
                shared[node] = n
                if a[n : n + 1] > b[n : n + 1]:
                    losers[node], winner = winner, losers[node]
            node >>= 1


def first_holders(strings: list[bytes], lcp: np.ndarray, right: np.ndarray, least: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(context of every string, first): the least id that holds each window of each context.

    Strings come sorted, with the prefix each shares with the one before and the least id of
    its holders; equal ones with equal `right` are one context. Column o of `first` is the
    window that begins o bytes before the anchor: two contexts hold the same one if they agree
    in length - o bytes from the anchor on and in o bytes before it. Agreement to the right is
    read off the prefixes of the sorted order, agreement to the left off a second sort of the
    bytes before the anchor.
    """
    size = np.array([len(s) for s in strings], np.int64)
    same = (lcp == size) & (np.concatenate([[-1], size[:-1]]) == size)
    code, opens, context = np.unique(np.cumsum(~same) * (1 << 16) + right, return_index=True, return_inverse=True)
    ids = np.full(len(code), np.iinfo(np.int64).max)
    np.minimum.at(ids, context, least)
    size, right = size[opens], right[opens]
    # What contexts share with the one before: within one string all of it.
    new = np.concatenate([[True], (code[1:] >> 16) != (code[:-1] >> 16)])
    prefix = size.copy()
    prefix[new] = np.minimum.reduceat(np.where(same, size[context], lcp), np.flatnonzero(~same)) if len(strings) else 0
    first = np.repeat(ids[:, None], length - gram + 1, axis=1)
    group = np.cumsum(prefix < 1 + gram)
    alone = np.bincount(group, minlength=group[-1] + 1 if len(group) else 1)[group] == 1
    many = np.flatnonzero(~alone & (right > 0))
    if not len(many):
        return context, first
    prefix, right, ids = prefix[many], right[many], ids[many]
    before = size[many] - 1 - right
    reach = length - gram
    words = -(-max(reach, 1) // 8)
    lefts = b"".join(strings[opens[k]][1 + r :].ljust(8 * words, b"\0") for k, r in zip(many.tolist(), right.tolist()))
    columns = np.frombuffer(lefts, ">u8").reshape(len(many), words)
    order = np.lexsort(columns.T[::-1])
    bytes_ = np.frombuffer(lefts, np.uint8).reshape(len(many), 8 * words)[order]
    differ = bytes_[1:] != bytes_[:-1]
    agree = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), 8 * words)])
    for o in range(reach + 1):
        held = np.flatnonzero((o >= length - right) & (o <= before))
        to_left = np.empty(len(many), np.int64)
        to_left[order] = np.cumsum(agree < o)
        key = (np.cumsum(prefix < 1 + length - o) * (len(many) + 1) + to_left)[held]
        by = np.argsort(key, kind="stable")
        opens_ = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))[: len(held)]
        if len(held):
            lowest = np.minimum.reduceat(ids[held][by], opens_)
            first[many[held[by]], o] = np.repeat(lowest, np.diff(np.append(opens_, len(held))))
    return context, first


# ---------------------------------------------------------------- steps between shuffles

_REPLY = "run int, kind int, a binary, b binary, c binary, d binary"
_EXCHANGE = "range int, run int, base int, shared binary, sizes binary, tails binary, rights binary, least binary, spread binary"


def _table(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array(values, kind) for name, (values, kind) in columns.items()})


def _joined(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _anchor_blocks(length: int, gram: int, ranges: int) -> Callable[[pa.Table], pa.Table]:
    """Keys of a run, sorted, each once: its text (or -1 where several texts hold it) and number of holders."""

    def step(table: pa.Table) -> pa.Table:
        number = table.column("run")[0].as_py()
        run = Run.of(table)
        found = anchors_of(run.data, run.ends, length, gram)
        order = np.argsort(found.key, kind="stable")
        key, text = found.key[order], found.text[order]
        opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        out: dict[str, list] = {c: [] for c in ("range", "run", "keys", "holders", "tags", "counts")}
        if len(key):
            tags, counts = run.tags[text], np.diff(np.append(opens, len(key))).astype(np.int32)
            one = np.minimum.reduceat(tags, opens) == np.maximum.reduceat(tags, opens)
            key, holder = key[opens], np.where(one, text[opens], -1)
            bounds = np.searchsorted(((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1))
            for r, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                if a < b:
                    named, held = np.unique(holder[a:b], return_inverse=True)
                    out["range"].append(r)
                    out["run"].append(number)
                    out["keys"].append(key[a:b].tobytes())
                    out["holders"].append(held.astype(np.int32).tobytes())
                    # The tag of "several" is no tag: 0 and the highest one are both set where it is met.
                    out["tags"].append(np.stack([np.where(named < 0, 0, run.tags[named]), np.where(named < 0, ~np.uint64(0), run.tags[named])]).astype(np.uint64).tobytes())
                    out["counts"].append(counts[a:b].tobytes())
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return _table({c: (v, k) for (c, v), k in zip(out.items(), kinds)})

    return step


def _shared_anchors(crowd: int) -> Callable[[pa.Table], pa.Table]:
    """Keys of a range that two different texts hold, told to every run that has them."""

    def step(table: pa.Table) -> pa.Table:
        keys, low, high, counts, owner = [], [], [], [], []
        for n, (k, h, t, c) in enumerate(zip(*[table.column(x).to_pylist() for x in ("keys", "holders", "tags", "counts")])):
            held, tags = np.frombuffer(h, np.int32), np.frombuffer(t, np.uint64).reshape(2, -1)
            keys.append(np.frombuffer(k, np.uint64))
            low.append(tags[0][held])
            high.append(tags[1][held])
            counts.append(np.frombuffer(c, np.int32))
            owner.append(np.full(len(held), n))
        key, low, high, counts, owner = (np.concatenate(x) for x in (keys, low, high, counts, owner))
        order = np.argsort(key, kind="stable")
        opens = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        met = np.diff(np.append(opens, len(key)))
        two = np.repeat(np.minimum.reduceat(low[order], opens) != np.maximum.reduceat(high[order], opens), met)
        crowded = np.repeat(np.add.reduceat(counts[order].astype(np.int64), opens) > crowd, met)
        chosen, crowded = order[two], crowded[two]
        by_run = np.argsort(owner[chosen], kind="stable")
        chosen, crowded = chosen[by_run], crowded[by_run]
        bounds = np.searchsorted(owner[chosen], np.arange(table.num_rows + 1)).tolist()
        spans = [(r, a, b) for r, a, b in zip(table.column("run").to_pylist(), bounds, bounds[1:]) if a < b]
        return _table(
            {
                "run": ([r for r, _, _ in spans], pa.int32()),
                "kind": ([1] * len(spans), pa.int32()),
                "a": ([key[chosen[a:b]].tobytes() for _, a, b in spans], pa.binary()),
                "b": ([crowded[a:b].tobytes() for _, a, b in spans], pa.binary()),
                "c": ([b""] * len(spans), pa.binary()),
                "d": ([b""] * len(spans), pa.binary()),
            }
        )

    return step


def _suffixes(texts: pa.Table, replies: pa.Table, length: int, gram: int) -> tuple[Run, Suffixes]:
    """A run and its sorted strings, the same in every step that asks for them."""
    run = Run.of(texts)
    named = replies.filter(pa.compute.equal(replies.column("kind"), 1))
    keys, crowd = _joined(named, "a", "u8"), _joined(named, "b", "?")
    order = np.argsort(keys)
    return run, sorted_suffixes(run, keys[order], crowd[order], length, gram)


def _suffix_blocks(length: int, gram: int, splitters: list[bytes]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sorted strings of a run, cut at the splitters and front-coded, with least and largest id of their holders."""

    def step(texts: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _EXCHANGE.split(", ")}
        if texts.num_rows and replies.num_rows:
            run, found = _suffixes(texts, replies, length, gram)
            holders, at = run.ids[found.text], found.begins[:-1]
            least = np.minimum.reduceat(holders, at) if len(at) else holders
            most = np.maximum.reduceat(holders, at) if len(at) else holders
            bounds = [0, *(bisect_left(found.strings, s) for s in splitters), len(found.strings)]
            for r, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if a < b:
                    shared, sizes, tails = front_coded(found.strings[a:b])
                    row = (
                        r, texts.column("run")[0].as_py(), a, shared.tobytes(), sizes.tobytes(), compress(tails), found.right[a:b].astype(np.uint16).tobytes(),
                        compress(least[a:b].tobytes()), compress((most - least)[a:b].tobytes()),
                    )
                    for c, v in zip(out, row):
                        out[c].append(v)
        return _table({c: (v, pa.int32() if c in ("range", "run", "base") else pa.binary()) for c, v in out.items()})

    return step


def _first_ids(length: int, gram: int) -> Callable[[pa.Table], pa.Table]:
    """Merges the runs of a range and tells every run which windows of its strings begin under a smaller id."""

    def step(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("run", "ascending"), ("base", "ascending")])
        shared, sizes, rights = ([np.frombuffer(x, np.uint16) for x in rows.column(c).to_pylist()] for c in ("shared", "sizes", "rights"))
        streams = [decoded(n, z, decompress(t)) for n, z, t in zip(shared, sizes, rows.column("tails").to_pylist())]
        lcp, block, strings = [], [], []
        for n, b, s in merge(streams):
            lcp.append(n)
            block.append(b)
            strings.append(s)
        block = np.array(block, np.int64)
        # The strings of a block come out in its own order.
        inside = np.empty(len(block), np.int64)
        order = np.argsort(block, kind="stable")
        counts = [len(n) for n in shared]
        inside[order] = np.concatenate([np.arange(n) for n in counts])
        where = np.concatenate([[0], np.cumsum(counts)])[block] + inside
        right = np.concatenate(rights)[where].astype(np.int64)
        least, spread = (np.concatenate([np.frombuffer(decompress(x), np.int64) for x in rows.column(c).to_pylist()])[where] for c in ("least", "spread"))
        most = least + spread
        context, first = first_holders(strings, np.array(lcp, np.int64), right, least, length, gram)
        size = np.array([len(s) for s in strings], np.int64)
        # Windows of a string: from the last one's offset to the first one's; a lone window is offset 0.
        low, high = np.where(right > 0, length - right, 0), np.where(right > 0, size - 1 - right, 0)
        offsets = np.arange(first.shape[1])
        parts = []
        for a in range(0, len(strings), ANSWERS):
            z = slice(a, a + ANSWERS)
            f = first[context[z]]
            gone = (f < most[z, None]) & (offsets >= low[z, None]) & (offsets <= high[z, None])
            alike = np.zeros_like(gone)
            alike[:, 1:] = gone[:, 1:] & gone[:, :-1] & (f[:, 1:] == f[:, :-1])
            goes_on = np.zeros_like(gone)
            goes_on[:, :-1] = alike[:, 1:]
            k, o = np.nonzero(gone & ~alike)
            parts.append((k + a, o, np.nonzero(gone & ~goes_on)[1], f[k, o]))
        entry, lo, hi, ids = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(block[entry], kind="stable")
        entry, lo, hi, ids = entry[by], lo[by].astype(np.int16), hi[by].astype(np.int16), ids[by]
        bounds = np.searchsorted(block[entry], np.arange(rows.num_rows + 1)).tolist()
        number = inside[entry].astype(np.int32)
        spans = [(r, base, a, b) for r, base, a, b in zip(rows.column("run").to_pylist(), rows.column("base").to_pylist(), bounds, bounds[1:]) if a < b]
        return _table(
            {
                "run": ([r for r, *_ in spans], pa.int32()),
                "kind": ([2] * len(spans), pa.int32()),
                "a": ([(number[a:b] + np.int32(base)).tobytes() for _, base, a, b in spans], pa.binary()),
                "b": ([lo[a:b].tobytes() for *_, a, b in spans], pa.binary()),
                "c": ([hi[a:b].tobytes() for *_, a, b in spans], pa.binary()),
                "d": ([ids[a:b].tobytes() for *_, a, b in spans], pa.binary()),
            }
        )

    return step


_CUT = "id long, seq string, n_removed long, spans array<struct<first:long,last:long>>, kept binary, kept_sha256 string"


def _cut_texts(length: int, gram: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Texts of a run that lose bytes: the spans that go, and what stays."""

    def step(texts: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[tuple] = []
        told = replies.filter(pa.compute.equal(replies.column("kind"), 2))
        if texts.num_rows and told.num_rows:
            run, found = _suffixes(texts, replies, length, gram)
            entry, lo, hi, first = (_joined(told, c, k) for c, k in zip("abcd", ("i4", "i2", "i2", "i8")))
            times = (found.begins[1:] - found.begins[:-1])[entry]
            holder = np.repeat(found.begins[entry] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            later = run.ids[found.text[holder]] > np.repeat(first, times)
            at, text = found.at[holder[later]], found.text[holder[later]]
            begin, end = at - np.repeat(hi, times)[later], at - np.repeat(lo, times)[later] + length
            order = np.argsort(text, kind="stable")
            opens = np.flatnonzero(np.concatenate([[True], text[order][1:] != text[order][:-1]])[: len(text)])
            for k, mine in zip(text[order][opens].tolist(), np.split(order, opens[1:])):
                whole = run.text(k)
                marks = np.zeros(len(whole) + 1, np.int32)
                low = run.ends[k] - len(whole)
                np.add.at(marks, begin[mine] - low, 1)
                np.add.at(marks, end[mine] - low, -1)
                gone = np.cumsum(marks[:-1], dtype=np.int32) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))
                kept = np.frombuffer(whole, np.uint8)[~gone].tobytes()
                out.append((int(run.ids[k]), hashlib.sha256(whole).hexdigest(), int(gone.sum()), [{"first": a, "last": b} for a, b in spans], kept, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out)) or [()] * 6
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        kinds = (pa.int64(), pa.string(), pa.int64(), span, pa.binary(), pa.string())
        return _table({c: (list(v), k) for c, v, k in zip(("id", "seq", "n_removed", "spans", "kept", "kept_sha256"), cols, kinds)})

    return step


def _splitters(texts: DataFrame, n_texts: int, ranges: int, length: int, gram: int) -> list[bytes]:
    """Where ranges of strings begin: grams of anchors, and windows, at even places of a small sample.

    About SAMPLE_TEXTS texts are taken by a hash of their id, with SAMPLE_STRINGS of each.
    """
    if ranges < 2:
        return [b"w"]
    odds = max(1, n_texts // SAMPLE_TEXTS)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                at = anchors_of(t, np.array([len(t)]), length, gram).at
                for a in at[:: max(1, len(at) // SAMPLE_STRINGS)].tolist():
                    found += [b"a" + t[a : a + gram], b"w" + t[a : a + length]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["s"])

    sample = texts.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(odds)) == 0).select("text").mapInArrow(look, "s binary").collect()
    out = [b"w"]
    for kind in (b"a", b"w"):
        some = sorted(bytes(r.s) for r in sample if bytes(r.s)[:1] == kind)
        out += [some[k * len(some) // ranges] for k in range(1, ranges)] if some else []
    return sorted(set(out))


def byte_repeats(
    docs: DataFrame, length: int = 50, gram: int = GRAM, crowd: int = CROWD, run_bytes: int | None = None, ranges: int | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: <key>, n_bytes, n_removed, spans, kept, kept_sha256, after repeated byte strings are gone.

    A byte goes if a string of `length` bytes over it also starts in a row with a smaller key;
    strings never cross texts and are judged on the input. `spans` are the maximal removed
    runs (first and last byte), `kept` the remaining bytes, null where the text stays whole.

    1. Texts are dealt into runs of a bounded size. Each run sorts the keys of its anchors
       (`anchors_of`), each key once, and sends them by ranges; keys that two different texts
       hold come back. Strings around other anchors are in one text alone and go nowhere.
    2. Each run sorts the strings around its shared anchors, equal ones once, and sends them
       front-coded, cut at sampled splitters. A range merges its runs with a loser tree that
       never re-compares known prefixes; the prefixes between neighbours in the merged order
       tell which contexts hold the same windows, and the least id of each goes back.
    3. Each run cuts its texts.

    Only sorted blocks and answers are shuffled besides the texts, which are dealt once (the
    three steps read the same shuffle). A string meets a range once per run, however many
    texts hold it. An anchor with more than `crowd` holders is not kept together: its windows
    are sorted one by one, each in the range where it belongs, with the same result.

    Equal texts keep the smallest key: with `length` bytes or more all others go whole. Null
    keys are never smaller than another and lose nothing; null texts are empty. Rows with
    equal key and text get equal results. `gram` is 8 or more and less than `length`.
    """
    if not 8 <= gram < length or length > 4096:
        raise ValueError("anchors need 8 bytes or more, fewer than the length, and strings 4096 at most")
    source = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    facts = settle(source.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("seq"), F.octet_length("text").cast("long").alias("n_bytes")), "facts")
    usable = (F.col("n_bytes") >= length) & F.col("id").isNotNull()
    copies = facts.where(usable).groupBy("seq").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("seq", "first_id")
    known = join_hot(facts, copies, ["seq"], "left").withColumn("whole", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)))
    n_texts, total = facts.where(usable).agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    size = run_bytes or int(min(max((total**0.5) * 512, RUN_LEAST), RUN_MOST))
    n_runs = max(1, -(-total // size))
    long_enough = source.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    dealt = long_enough.select(F.pmod(F.xxhash64("id", "text"), F.lit(n_runs)).cast("int").alias("run"), "id", "text").repartition(n_runs, "run")
    splitters = _splitters(long_enough, n_texts, ranges or -(-total // SUFFIX_RANGE), length, gram)
    keys = dealt.groupBy("run").applyInArrow(_anchor_blocks(length, gram, ranges or max(1, -(-total // ANCHOR_RANGE))), "range int, run int, keys binary, holders binary, tags binary, counts binary")
    shared = keys.groupBy("range").applyInArrow(_shared_anchors(crowd), _REPLY)
    blocks = dealt.groupBy("run").cogroup(shared.groupBy("run")).applyInArrow(_suffix_blocks(length, gram, splitters), _EXCHANGE)
    firsts = blocks.groupBy("range").applyInArrow(_first_ids(length, gram), _REPLY)
    cut = dealt.groupBy("run").cogroup(shared.union(firsts).groupBy("run")).applyInArrow(_cut_texts(length, gram), _CUT)
    entire = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("n_bytes") - 1).alias("last")))
    none = F.array().cast("array<struct<first:long,last:long>>")
    return known.join(cut, ["id", "seq"], "left").select(
        F.col("id").alias(key),
        "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), entire).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(F.col("whole"), F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(F.col("whole"), F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "seq")).alias("kept_sha256"),
    )
