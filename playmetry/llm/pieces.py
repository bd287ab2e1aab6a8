"""SentencePiece encoding with sampled segmentations, and its exact decoding."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from playmetry.llm.common import mix64, unused

#: Place of the vocabulary file on the driver; executors get its pieces with the task.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Runs without a space or line break longer than this are not kept as lattices: forward sums
#: are carried from block to block of this length, and edges are found again block by block.
RUN = 1 << 16
#: Lattice edges that a task keeps for words it has seen, before it starts anew; nodes are fewer.
KEPT_EDGES = 1 << 22
#: Characters worked on at once: temporary arrays take some 200 bytes for each, so they follow
#: neither the rows of a batch nor the new words in it. One text or word may have more.
PORTION = 1 << 18


@dataclass
class Vocabulary:
    """Pieces of a SentencePiece model with byte fallback, as texts with plain spaces.

    `weights` are natural logarithms of piece weights: the model's own scores for a unigram
    model; a BPE model has merge ranks instead, which become 1 / (1 + rank).
    """

    texts: list[bytes]
    pieces: dict[str, int]
    weights: np.ndarray
    byte_ids: np.ndarray


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    unigram = model.trainer_spec.model_type == 1
    texts, pieces, weights = [], {}, np.zeros(len(model.pieces))
    byte_ids = np.full(256, -1, np.int64)
    worst = min((p.score for p in model.pieces if p.type == 1), default=0.0)
    for i, p in enumerate(model.pieces):
        if p.type == 6:
            byte = int(p.piece[3:5], 16)
            byte_ids[byte] = i
            texts.append(bytes([byte]))
            weights[i] = worst if unigram else -np.log(1.0 + len(model.pieces))
            continue
        text = p.piece.replace("▁", " ") if p.type == 1 else ""
        texts.append(text.encode())
        weights[i] = p.score if unigram else -np.log(1.0 + max(0.0, -p.score))
        if p.type == 1:
            if re.search(r"[^ ] |\n", text):
                raise ValueError("a piece crosses a word; this lattice ends at words")
            pieces[text] = i
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte pieces, so decoding would lose characters")
    return Vocabulary(texts, pieces, weights, byte_ids)


class Trie:
    """All beginnings of pieces; a state is a beginning, found by (state, character) in a hash table."""

    def __init__(self, pieces: dict[str, int]):
        states = {"": 0}
        for p in sorted(pieces, key=lambda p: (len(p), p)):
            for k in range(1, len(p) + 1):
                states.setdefault(p[:k], len(states))
        names = list(states)[1:]
        keys = np.array([states[n[:-1]] << 21 | ord(n[-1]) for n in names], np.int64)
        self.ends = np.array([-1, *(pieces.get(n, -1) for n in names)], np.int64)
        self.bits = int(len(names)).bit_length() + 3
        self.table = np.full((1 << self.bits) + 64, -1, np.int64)
        self.state = np.zeros(len(self.table), np.int64)
        self.longest = max(map(len, pieces), default=1)
        self.probes = 1
        for slot, key, state in zip(self._slots(keys).tolist(), keys.tolist(), range(1, len(names) + 1)):
            probes = 1
            while self.table[slot] >= 0:
                slot, probes = slot + 1, probes + 1
            self.table[slot], self.state[slot] = key, state
            self.probes = max(self.probes, probes)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after each character, 0 where no piece goes on."""
        keys = (states << 21) | codes
        slots = self._slots(keys)
        hit = self.table[slots] == keys
        out = np.where(hit, self.state[slots], 0)
        left = np.flatnonzero(~hit & (self.table[slots] >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slots[left] += 1
            held = self.table[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.state[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


def by_share(to: np.ndarray, share: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Order by node, falling share and piece, as a sort by three keys gives it but for a fraction of its time.

    Edges come in runs of one length, each in node order, so merging them is cheap; a node has few edges,
    and neighbours in wrong order change places until there are none. Longer pieces, mostly likelier, go first.
    """
    order = len(to) - 1 - np.argsort(to[::-1], kind="stable")
    same = np.flatnonzero(np.diff(to[order]) == 0)
    turns, still, turn = (same[same % 2 == 0], same[same % 2 == 1]), 0, 0
    share, piece = share[order], piece[order]
    while still < 2:
        a = turns[turn]
        wrong = (share[a] < share[a + 1]) | ((share[a] == share[a + 1]) & (piece[a] > piece[a + 1]))
        a = a[wrong]
        for values in (order, share, piece):
            values[a], values[a + 1] = values[a + 1], values[a]
        still, turn = 0 if len(a) else still + 1, 1 - turn
    return order


class Lattices:
    """Lattices of words, each with its forward-filtered backward probabilities.

    Node p of a word stands for its first p characters. Every edge into a node is a piece
    that ends there. `chance` sums, edge by edge and the likeliest first, the probability of
    that piece being the last one given the characters up to the node.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.trie = Trie(vocabulary.pieces)
        # Of words, nodes and edges; all have room for more than is in use.
        self.base, self.length, self.first = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.chance, self.origin, self.piece = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.words = self.nodes = self.edges = 0

    def numbers(self, words: list[str]) -> np.ndarray:
        """A number for every word; lattices of new words are added."""
        if self.edges > KEPT_EDGES:
            self.forget()
        before = len(self.known)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > before:
            self._add(list(islice(self.known, before, None)))
        return which

    def _edges(self, codes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every piece that starts at a character and ends by `last` of it: place, length, piece, weight."""
        at, state, step = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), np.int64), 0
        froms, steps, ids = [], [], []
        single = np.zeros(len(codes), bool)
        while len(at):
            state = self.trie.step(state, codes[at + step])
            hit = state > 0
            at, state = at[hit], state[hit]
            step += 1
            piece = self.trie.ends[state]
            found = piece >= 0
            if step == 1:
                single[at[found]] = True
            froms.append(at[found])
            steps.append(np.full(len(froms[-1]), step, np.int32))
            ids.append(piece[found])
            more = at + step < last[at]
            at, state = at[more], state[more]
        bare = np.flatnonzero(~single).astype(np.int32)  # characters that only bytes can spell: piece -1 - code point
        froms.append(bare)
        steps.append(np.ones(len(bare), np.int32))
        ids.append(-1 - codes[bare])
        origin, length, piece = map(np.concatenate, (froms, steps, ids))
        spelled = np.where(piece < 0, -1 - piece, 0)
        n_bytes = 1 + (spelled > 0x7F) + (spelled > 0x7FF) + (spelled > 0xFFFF)
        weight = np.where(piece >= 0, self.vocabulary.weights[np.maximum(piece, 0)], n_bytes * self.vocabulary.weights[self.vocabulary.byte_ids[0]])
        return origin, length, piece, weight

    def _block(self, codes: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges of a long word into its nodes a + 1 to b, by node: origin, node, piece, weight."""
        low = max(0, a + 1 - self.trie.longest)
        part = codes[low:b].astype(np.int64)
        origin, length, piece, weight = self._edges(part, np.full(len(part), len(part), np.int32))
        origin = origin + np.int64(low)
        to = origin + length
        order = np.flatnonzero(to > a)
        order = order[np.argsort(to[order], kind="stable")]
        return origin[order], to[order], piece[order], weight[order]

    def sample_long(self, word: str, seed: np.uint64) -> np.ndarray:
        """One segmentation of a word of any length, by the same law as `sample`.

        No piece is lost between blocks: an edge reaches back as far as the longest piece.
        What grows with the word is one number for each character.
        """
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        forward = np.zeros(n + 1)
        for a in range(0, n, RUN):
            origin, to, _, weight = self._block(codes, a, min(n, a + RUN))
            low = int(origin.min())
            sums = forward[low : a + 1].tolist()  # of the nodes from `low` on
            origins, weights = (origin - low).tolist(), weight.tolist()
            cuts = np.flatnonzero(np.diff(to, prepend=a, append=n + 1)).tolist()
            for x, y in zip(cuts[:-1], cuts[1:]):
                values = [sums[o] + w for o, w in zip(origins[x:y], weights[x:y])]
                top = max(values)
                sums.append(top + math.log(sum([math.exp(v - top) for v in values])))
            forward[low : low + len(sums)] = sums
        out, node, step = [], n, 0
        for a in range((n - 1) // RUN * RUN, -1, -RUN):
            origin, to, piece, weight = self._block(codes, a, min(n, a + RUN))
            share = np.exp(forward[origin] + weight - forward[to])
            order = np.lexsort((piece, -share, to))
            origins, pieces, shares = origin[order].tolist(), piece[order].tolist(), share[order].tolist()
            first = np.searchsorted(to, np.arange(a + 1, min(n, a + RUN) + 2)).tolist()
            keys = (np.arange(step, step + min(n, a + RUN) - a, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + seed
            draws = ((mix64(keys) >> np.uint64(11)).astype(np.float64) * 2.0**-53).tolist()
            begun = step
            while node > a:
                edge, end, left = first[node - a - 1], first[node - a] - 1, draws[step - begun]
                while edge < end and left >= shares[edge]:
                    left -= shares[edge]
                    edge += 1
                out.append(pieces[edge])
                node, step = origins[edge], step + 1
        return np.array(out[::-1], np.int64)

    def _add(self, words: list[str]) -> None:
        lengths = np.array([len(w) for w in words], np.int32)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        start = np.cumsum(lengths, dtype=np.int32) - lengths
        last = np.repeat(start + lengths, lengths)  # end of the word each character is in
        node = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(words), dtype=np.int32), lengths)  # one node more than characters
        origin, step, piece, weight = self._edges(codes, last)
        origin = node[origin]
        to = origin + step
        total = int(lengths.sum()) + len(words)
        begin = start + np.arange(len(words), dtype=np.int32)
        depth = np.arange(total, dtype=np.int32) - np.repeat(begin, lengths + 1)
        forward = np.zeros(total)
        by_depth = np.argsort(depth[to].astype(np.int64) * total + to)
        source, target, value = origin[by_depth], to[by_depth], weight[by_depth]
        fresh = np.concatenate([[True], target[1:] != target[:-1]])
        heads, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1  # first edge of each node, node of each edge
        reached = target[heads]
        cuts = np.searchsorted(depth[reached], np.arange(1, int(lengths.max()) + 2))
        edges = np.append(heads, len(target))[cuts]
        for g, h, a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            first = heads[g:h] - a
            sums = value[a:b] + forward[source[a:b]]
            top = np.maximum.reduceat(sums, first)
            forward[reached[g:h]] = top + np.log(np.add.reduceat(np.exp(sums - top[group[a:b] - g]), first))
        share = np.exp(forward[origin] + weight - forward[to])
        order = by_share(to, share, piece)  # by node, the likeliest first, whatever else is added
        origin, to, piece, share = origin[order], to[order], piece[order], share[order]
        first = np.searchsorted(to, np.arange(total))
        # Sums begin anew at each node, so a word's chances are the same in any company.
        chance, place = share.copy(), np.arange(len(to)) - first[to]
        for k in range(1, int(place.max()) + 1):
            at = np.flatnonzero(place == k)
            chance[at] += chance[at - 1]
        chance[np.append(first[1:], len(to))[to] - 1 == np.arange(len(to))] = 2.0  # the last edge takes the rest
        for name, at, more in (
            ("base", self.words, begin + self.nodes),
            ("length", self.words, lengths),
            ("first", self.nodes, first + self.edges),
            ("chance", self.edges, chance),
            ("origin", self.edges, origin + self.nodes),
            ("piece", self.edges, piece),
        ):
            held = getattr(self, name)
            if at + len(more) > len(held):
                wider = np.empty(max(at + len(more), 2 * len(held)), held.dtype)
                wider[:at] = held[:at]
                setattr(self, name, held := wider)
            held[at : at + len(more)] = more
        self.words, self.nodes, self.edges = self.words + len(words), self.nodes + total, self.edges + len(to)

    def sample(self, words: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation per entry: pieces in a row, and how many each entry has.

        From the end of each word back to its start, every step draws the last piece by its
        probability given the characters left. Draw k of an entry follows from its seed and k.
        """
        stop = self.base[words]
        node = stop + self.length[words]
        counts = np.zeros(len(words), np.int64)
        alive = np.arange(len(words))
        steps, step = [], 0
        while len(alive):
            draw = (mix64(seeds + np.uint64((step * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node]
            over = np.flatnonzero(draw >= self.chance[edge])
            while len(over):
                edge[over] += 1
                over = over[draw[over] >= self.chance[edge[over]]]
            steps.append((alive, self.piece[edge]))
            counts[alive] += 1
            node = self.origin[edge]
            more = np.flatnonzero(node > stop)
            alive, node, stop, seeds = alive[more], node[more], stop[more], seeds[more]
            step += 1
        out = np.zeros(int(counts.sum()), np.int64)
        ends = np.cumsum(counts)
        for k, (who, piece) in enumerate(steps):
            out[ends[who] - 1 - k] = piece
        return out, counts


PARTS = re.compile(r" *[^ \n]+| +|\n")


def parts_of(text: str) -> list[str]:
    """Words with the spaces before them, single line breaks, spaces at an end; one more space goes first."""
    return PARTS.findall(" " + text) if text else []


def spell(pieces: np.ndarray, counts: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace pieces -1 - code point by the pieces of their bytes; counts follow."""
    if not (pieces < 0).any():
        return pieces, counts
    owner = np.repeat(np.arange(len(counts)), counts)
    width = np.ones(len(pieces), np.int64)
    bare = np.flatnonzero(pieces < 0)
    codes = {c: byte_ids[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)] for c in np.unique(-1 - pieces[bare]).tolist()}
    spelled = [codes[c] for c in (-1 - pieces[bare]).tolist()]
    width[bare] = [len(s) for s in spelled]
    out = np.repeat(pieces, width)
    out[np.repeat(pieces < 0, width)] = np.concatenate(spelled)
    return out, np.bincount(owner, width, len(counts)).astype(np.int64)


def draw(lattices: Lattices, words: list[str], seeds: np.ndarray, long: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of words in a row, each drawn by its seed, and how many each word has; long ones by their place."""
    if long:
        words = ["\n" if k in long else w for k, w in enumerate(words)]  # its pieces give way to those of the long word
    pieces, counts = lattices.sample(lattices.numbers(words), seeds)
    if long:
        drawn = np.split(pieces, np.cumsum(counts)[:-1])
        for k, w in long.items():
            drawn[k] = lattices.sample_long(w, seeds[k])
        pieces, counts = np.concatenate(drawn), np.array([len(d) for d in drawn], np.int64)
    return spell(pieces, counts, lattices.vocabulary.byte_ids)


def encode_batch(lattices: Lattices, keys: list, texts: list, seed: int) -> list[np.ndarray]:
    """Piece ids of every text, sampled under (seed, key, place in the text), words by portions."""
    words = [parts_of(t or "") for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    every = [w for ws in words for w in ws]
    own = np.array([xxh3_64_intdigest(str(k), seed) for k in keys], np.uint64)
    place = (np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
    seeds = mix64(np.repeat(own, sizes) + mix64(place))
    lengths = [len(t or "") for t in texts]
    cuts, some_long = [0, len(every)], max(lengths, default=0) >= RUN
    if sum(lengths) > PORTION:
        ends = np.cumsum(np.fromiter(map(len, every), np.int64, len(every)))
        cuts[1:1] = (np.flatnonzero(np.diff(ends // PORTION)) + 1).tolist()
    drawn = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        long = {k: w for k, w in enumerate(every[a:b]) if len(w) > RUN} if some_long else {}
        drawn.append(draw(lattices, every[a:b], seeds[a:b], long))
    pieces, counts = (np.concatenate(x) for x in zip(*drawn))
    total = np.bincount(np.repeat(np.arange(len(texts)), sizes), counts, len(texts)).astype(np.int64)
    return np.split(pieces, np.cumsum(total)[:-1]) if len(texts) else []


def portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in turn, cut where the texts of a column would be more than a portion in all."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, PORTION + (ends[a - 1] if a else 0), "right")))
            yield batch.slice(a, b - a)
            a = b


def id_lists(lattices: Lattices, keys: list, texts: list, seed: int) -> pa.ListArray:
    """The ids of every text as lists of a column, null for null texts."""
    ids = encode_batch(lattices, keys, texts, seed)
    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    values = pa.array(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int32))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([t is None for t in texts], pa.bool_()))


def decode_ids(texts: list[bytes], ids: list[int]) -> str:
    """The text of piece ids; the space that encoding put first is taken off."""
    return b"".join(map(texts.__getitem__, ids))[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: Vocabulary, seed: int = 1, key: str = "doc_id", text: str = "text", out: str = "pieces") -> DataFrame:
    """All columns of `docs` and `out`, the piece ids of one sampled segmentation of the text.

    The chance of a segmentation is the product of its pieces' weights, over all
    segmentations of the text. Forward filtering sums them up to every character,
    backward sampling draws the pieces from the end; both go word by word, since no piece
    crosses one, and a word of any length is one lattice. The draws depend on seed, key and place alone, so reruns and other
    partitions give the same ids; rows with one key and text get the same ids, and a null key
    counts as the text `None`. Characters without a piece are spelled in bytes, and so is
    U+2581, which stands for a space in pieces. Null texts give null, empty ones no ids.
    A column named `out` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary)
        for batch in portions(batches, len(others) + 1):
            keys, texts = (batch.column(len(others) + k).to_pylist() for k in (0, 1))
            lists = id_lists(lattices, keys, texts, seed)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), lists], names=[*others, out])

    others = [c for c in docs.columns if c != out]
    schema = docs.select(*others).withColumn(out, F.lit(None).cast("array<int>")).schema
    inner = unused("key", others), unused("text", others)
    return docs.select(*others, F.col(key).alias(inner[0]), F.col(text).alias(inner[1])).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """All columns and `out`, the text of the piece ids; null ids give null."""
    texts = vocabulary.texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(others)).to_pylist()
            read = pa.array([None if i is None else decode_ids(texts, i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), read], names=[*others, out])

    others = [c for c in encoded.columns if c != out]
    schema = encoded.select(*others).withColumn(out, F.lit(None).cast("string")).schema
    return encoded.select(*others, F.col(pieces).alias(unused("ids", others))).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, pieces, n_pieces, n_byte_pieces, pieces_hash (of the ids), lossless (decoding gives the text).

    The ids are those of `encode`, and what is read back are the ids that are returned, as
    `decode` reads them; both in one pass, since a worker of its own for each took more than
    3000 MB of an executor. A null text has null pieces, 0 of them, a null hash, and counts
    as lossless.
    """
    texts, is_byte = vocabulary.texts, np.isin(np.arange(len(vocabulary.texts)), vocabulary.byte_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary)
        for batch in portions(batches, 1):
            source = batch.column(1).to_pylist()
            lists = id_lists(lattices, batch.column(0).to_pylist(), source, seed)
            ids = [lists.values[a:b].to_numpy() for a, b in zip(lists.offsets[:-1].to_pylist(), lists.offsets[1:].to_pylist())]
            hashes = [None if t is None else np.uint64(xxh3_64_intdigest(i.astype("<i4").tobytes())).astype(np.int64) for i, t in zip(ids, source)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    lists,
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([int(is_byte[i].sum()) for i in ids], pa.int64()),
                    pa.array(hashes, pa.int64()),
                    pa.array([t is None or decode_ids(texts, i.tolist()) == t for i, t in zip(ids, source)], pa.bool_()),
                ],
                names=[key, "pieces", "n_pieces", "n_byte_pieces", "pieces_hash", "lossless"],
            )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, pieces array<int>, n_pieces long, n_byte_pieces long, pieces_hash long, lossless boolean"
    return docs.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)
