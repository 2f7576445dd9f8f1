"""SentencePiece encoding and decoding: the N best segmentations of each text.

The lattice of a text has an edge for each piece of the vocabulary at each place. A forward
Viterbi pass gives the best score up to every place; a search from the end backwards, ordered
by what it has plus that forward score, then finds segmentations from the best on, exactly.

No piece holds a space behind another character, nor a line break, so every segmentation is cut
there and the lattice falls into words. Words repeat, so the pass is made once for each
distinct word of a batch, many words side by side in numpy, and gives the best and the second
best score. The N best of a text differ from its best in the N - 1 words at most that lose
least, and the search runs in those words alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kpiloom.llm.common import gathered, pieces_of
from kpiloom.llm.flat import span_hashes, text_bytes

# Where the public vocabulary lies; tasks read it, it is never copied.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # fixed value: how vocabularies of this kind write a space
# Of equal scores the segmentation of fewer pieces wins: each piece costs this much besides. Scores
# are held as multiples of it, so sums are exact in whatever order they are made, and ties are ties.
COST = 2.0**-20
UNKNOWN_BELOW = 10.0  # a character without a piece scores this much less than the worst usual piece
USUAL = -1e6  # pieces scored lower are for special use
LONG_WORD = 256  # longer ones are searched one by one and not side by side, with the same results
CACHED_WORDS = 50_000
GATHERED = 4 << 20  # bytes of text whose distinct words are worked off together
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)  # odd: spreads short pieces over the high bits


@dataclass
class Words:
    """Distinct words as code points in a row: begin and size of each."""

    codes: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    def text(self, k: int) -> str:
        return self.codes[self.begin[k] : self.begin[k] + self.size[k]].astype("<u4").tobytes().decode("utf-32-le")


@dataclass
class Ways:
    best: np.ndarray
    second: np.ndarray
    size: np.ndarray
    begin: np.ndarray
    ids: np.ndarray


def distinct_words(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The distinct words of some texts, for all words in a row which of them it is, and words per text.

    A word is spaces and what follows up to the next space; a line break is one by itself. One
    space goes in front of each text that is not empty.
    """
    texts = pc.fill_null(texts, "")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
    data, offsets = text_bytes(texts)
    space, line = data == 0x20, data == 0x0A
    opens = line.copy()
    opens[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(data))
    count = np.diff(np.searchsorted(start, offsets))
    _, first, of_word = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    start, size = start[first], (end - start)[first]
    shift = np.cumsum(size) - size
    raw = data[np.arange(int(size.sum())) + np.repeat(start - shift, size)]
    codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    codes[codes == 0x20] = ord(SPACE)
    letters = np.add.reduceat((raw & 0xC0) != 0x80, shift, dtype=np.int64) if len(size) else size
    return Words(codes, np.cumsum(letters) - letters, letters), of_word, count


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_file=path)
        size = reader.get_piece_size()
        self.pieces = [reader.id_to_piece(i) for i in range(size)]
        special = [reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i) or reader.is_byte(i) for i in range(size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if reader.is_byte(i)}
        self.score = {p: (round(reader.get_score(i) / COST) * COST, i) for i, p in enumerate(self.pieces) if not special[i]}
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.score):
            raise ValueError("pieces that run over the end of a word are not supported")
        self.longest = max(map(len, self.score))
        self.unknown = min(s for s, _ in self.score.values() if s > USUAL) - UNKNOWN_BELOW
        # Decoded bytes of each piece; special ones decode to nothing.
        decoded = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for byte, i in self.bytes.items():
            decoded[i] = bytes([byte])
        self.decoded = np.frombuffer(b"".join(decoded), np.uint8)
        self.sizes = np.array([len(d) for d in decoded], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        # For many words side by side: pieces by a hash of their characters.
        names = sorted(self.score, key=lambda p: int(self._hash(p)))
        self.hashes = np.array([self._hash(p) for p in names], np.uint64)
        if len(np.unique(self.hashes)) < len(names):
            raise ValueError("two pieces share a hash")
        self.ids = np.array([self.score[p][1] for p in names], np.int64)
        self.scores = np.array([self.score[p][0] for p in names]) - COST
        # Where hashes of each first 20 bits begin, and whether there are any.
        bucket = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.bucket = np.searchsorted(bucket, np.arange(1 << 20)).astype(np.int32)
        self.there = np.zeros(1 << 20, bool)
        self.there[bucket] = True
        self.fullest = int(np.bincount(bucket).max())

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return np.uint64(h * int(_SPREAD) % (1 << 64))

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash among those of the pieces, -1 if it is none."""
        at = self.bucket[(hashes >> np.uint64(44)).astype(np.int64)].astype(np.int64)
        found = np.full(len(hashes), -1, np.int64)
        for k in range(self.fullest):
            here = np.minimum(at + k, len(self.hashes) - 1)
            found = np.where(self.hashes[here] == hashes, here, found)
        return found

    def spell(self, character: str) -> list[int]:
        """Byte pieces of a character that has no piece."""
        return [self.bytes.get(b, 0) for b in character.encode()]

    def edges(self, word: str, end: int) -> list[tuple[int, float, int]]:
        """Edges that end at a place: begin, score, id (-1 for a spelled character)."""
        found = []
        for begin in range(max(0, end - self.longest), end):
            hit = self.score.get(word[begin:end])
            if hit:
                found.append((begin, hit[0] - COST, hit[1]))
        if not found or found[-1][0] != end - 1:
            found.append((end - 1, self.unknown - COST * len(word[end - 1].encode()), -1))
        return found

    def expand(self, word: str, cuts: list[tuple[int, int, int]]) -> np.ndarray:
        """Ids of a segmentation given as (begin, end, id)."""
        ids: list[int] = []
        for begin, _, piece in cuts:
            ids.extend(self.spell(word[begin]) if piece < 0 else (piece,))
        return np.array(ids, np.int32)

    def forward(self, word: str) -> array:
        """The best score up to each place."""
        best = array("d", [0.0])
        for end in range(1, len(word) + 1):
            best.append(max(best[begin] + s for begin, s, _ in self.edges(word, end)))
        return best

    def n_best(self, word: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a word: A* from its end, with the forward scores as the estimate.

        Of equal scores the one whose first piece is longer comes first, then the second, and so on.
        A state is a place and the way from there to the end. Among equal estimates states further back
        go first; so when a place's turn comes all ways from it that tie are in the queue, and they
        leave in the order of the rule: by where their first piece ends, then by the rank of the rest.
        A place is left at most n times, as no more ways from it can be among the n best, so
        ties of any number do not widen the search.
        """
        best, length = self.forward(word), len(word)
        left: dict[int, list[tuple[int, int, int, float]]] = {}  # by place: next place, rank there, piece, score behind
        held: dict[int, list[tuple[float, int, int]]] = {}  # by place: the n best ways met so far
        queue = [(-best[length], -length, 0, 0, 0.0, 0)]
        while queue:
            _, place, after, rank, behind, piece = heapq.heappop(queue)
            place, after = -place, -after
            ways = left.setdefault(place, [])
            if len(ways) == n:
                continue
            ways.append((after, rank, piece, behind))
            if place == 0:
                if len(ways) == n:
                    break
                continue
            own = len(ways) - 1
            for begin, s, edge in self.edges(word, place):
                total = behind + s
                way, known = (-total, -place, own), held.setdefault(begin, [])
                if len(known) < n or way < known[-1]:
                    insort(known, way)
                    del known[n:]
                    heapq.heappush(queue, (-(best[begin] + total), -begin, -place, own, total, edge))
        found = []
        for after, rank, piece, score in left.get(0, []):
            cuts, place = [], 0
            while place < length:
                cuts.append((place, after, piece))
                place = after
                after, rank, piece, _ = left[place][rank]
            found.append((score, self.expand(word, cuts)))
        return found

    def two_best(self, words: Words) -> Ways:
        """Best and second best score (-inf if none) of each word, and the ids of its best way."""
        n = len(words.size)
        best, second = np.empty(n), np.empty(n)
        sizes, begins, parts, total = np.empty(n, np.int64), np.empty(n, np.int64), [], 0
        order = np.argsort(words.size, kind="stable")
        cuts = np.flatnonzero(np.diff(words.size[order])) + 1
        for group in np.split(order, cuts) if n else []:
            length = int(words.size[group[0]])
            step = 8192 if length <= LONG_WORD else 1
            for at in range(0, len(group), step):
                who = group[at : at + step]
                if length > LONG_WORD:
                    two = self.n_best(words.text(who[0]), 2)
                    found = [two[0][0]], [two[1][0] if len(two) > 1 else -np.inf], [len(two[0][1])], two[0][1]
                else:
                    found = self._side_by_side(words, who, length)
                best[who], second[who], sizes[who] = found[:3]
                begins[who] = total + np.cumsum(sizes[who]) - sizes[who]
                total += len(found[3])
                parts.append(found[3])
        return Ways(best, second, sizes, begins, np.concatenate(parts) if parts else np.empty(0, np.int32))

    def _side_by_side(self, words: Words, who: np.ndarray, length: int):
        n = len(who)
        letters = words.codes[words.begin[who] + np.arange(length)[:, None]]
        codes = letters.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            prefix[i + 1] = prefix[i] * _BASE + codes[i]
        # From each place on: the best and second best score to the end, and the first piece of the best way.
        first, second = np.full((2, length + 1, n), -np.inf)
        first[length] = 0
        taken = np.zeros((length + 1, n), np.int8)
        piece = np.full((length + 1, n), -1, np.int32)
        widths = np.where(letters < 0x80, 1, np.where(letters < 0x800, 2, np.where(letters < 0x10000, 3, 4)))
        powers = [np.uint64(pow(int(_BASE), size + 1, 1 << 64)) for size in range(min(length, self.longest))]
        edges = []  # by size: where the edges of each place begin, their lanes, scores and ids
        for size in range(1, min(length, self.longest) + 1):
            h = (prefix[size:] - prefix[:-size] * powers[size - 1]).ravel() * _SPREAD
            maybe = np.flatnonzero(self.there[(h >> np.uint64(44)).astype(np.int64)])
            at = self._lookup(h[maybe])
            maybe, at = maybe[at >= 0], at[at >= 0]
            score, ids = self.scores[at], self.ids[at]
            if size == 1 and len(maybe) < n * length:
                unknown = np.ones(n * length, bool)
                unknown[maybe] = False
                rest = np.flatnonzero(unknown)
                maybe = np.concatenate([maybe, rest])
                order = np.argsort(maybe, kind="stable")
                maybe = maybe[order]
                score = np.concatenate([score, self.unknown - COST * widths.ravel()[rest]])[order]
                ids = np.concatenate([ids, np.full(len(rest), -1)])[order]
            cut = np.searchsorted(maybe, np.arange(length - size + 2) * n)
            edges.append((cut.tolist(), maybe % n, score, ids))
        for begin in range(length - 1, -1, -1):
            for size in range(1, min(length - begin, self.longest) + 1):
                cut, lane, score, ids = edges[size - 1]
                part = slice(cut[begin], cut[begin + 1])
                lane, score, ids = lane[part], score[part], ids[part]
                if not len(lane):
                    continue
                one, two = first[begin + size, lane] + score, second[begin + size, lane] + score
                have = first[begin, lane]
                # The longer piece wins a tie, as in `n_best`.
                wins = one >= have
                second[begin, lane] = np.where(wins, np.maximum(have, two), np.maximum(one, second[begin, lane]))
                lane = lane[wins]
                first[begin, lane] = one[wins]
                taken[begin, lane] = size
                piece[begin, lane] = ids[wins]
        place, lanes, columns = np.zeros(n, np.int64), np.arange(n), []
        while (place < length).any():
            columns.append(np.where(place < length, piece[place, lanes], -2))
            place = place + taken[place, lanes]
        table = np.array(columns).T
        flat, sizes = table[table != -2], (table != -2).sum(axis=1)
        if (flat < 0).any():
            # Characters without a piece are spelled in bytes; few words have one.
            ways = np.split(flat, np.cumsum(sizes)[:-1])
            for lane in np.flatnonzero((table == -1).any(axis=1)).tolist():
                ways[lane] = self._spelled(words.text(who[lane]), ways[lane])
            flat, sizes = np.concatenate(ways), np.array([len(w) for w in ways])
        return first[0], second[0], sizes, flat.astype(np.int32)

    def _spelled(self, word: str, ids: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for i in ids.tolist():
            out += self.spell(word[at]) if i < 0 else [i]
            at += 1 if i < 0 else len(self.pieces[i])
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, without the space that encoding puts in front."""
        sizes = self.sizes[ids]
        shift = np.cumsum(sizes) - sizes
        raw = self.decoded[np.arange(int(sizes.sum())) + np.repeat(self.begins[ids] - shift, sizes)].tobytes()
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.ways: dict[str, list[tuple[float, np.ndarray]]] = {}  # of words that lose little, few in number

    def encode(self, texts: pa.Array, n: int) -> Iterator[list[tuple[float, np.ndarray]]]:
        """For each text its n best segmentations (score, ids), fewer if it has fewer; none if it is empty."""
        words, of_word, count = distinct_words(texts)
        ways = self.vocab.two_best(words)
        loss = ways.best - ways.second
        ends = np.cumsum(count)
        for end, size in zip(ends.tolist(), count.tolist(), strict=True):
            row = of_word[end - size : end]
            if not size:
                yield []
                continue
            of_row = ways.size[row]
            shift = np.cumsum(of_row) - of_row
            whole = ways.ids[np.arange(int(of_row.sum())) + np.repeat(ways.begin[row] - shift, of_row)]
            yield self._variants(row, words, ways.best, loss, shift, of_row, whole, n)

    def _n_best(self, word: str, n: int) -> list[tuple[float, np.ndarray]]:
        found = self.ways.get(word)
        if found is None or len(found) < n:
            found = self.vocab.n_best(word, n)
            if len(word) <= LONG_WORD and len(self.ways) < CACHED_WORDS:
                self.ways[word] = found
        return found[:n]

    def _variants(self, row, words, best, loss, shift, of_row, whole, n) -> list[tuple[float, np.ndarray]]:
        """Search over the words that lose least; the rest stay at their best.

        Ways are ordered by score, then by the first word that they segment differently: its
        better way goes first. So of words that lose the same those further back change first.
        """
        score = float(best[row].sum())
        own = loss[row]
        out = [(score, whole)]
        if n == 1:
            return out
        if len(own) > n - 1:
            edge = np.partition(own, n - 2)[n - 2]
            less = np.flatnonzero(own < edge)
            places = np.concatenate([less, np.flatnonzero(own == edge)[len(less) - (n - 1) :]])
        else:
            places = np.arange(len(own))
        places = [int(p) for p in np.sort(places) if np.isfinite(own[p])]
        ways = [self._n_best(words.text(row[p]), n) for p in places]
        queue: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        found = 0
        while queue and found < n:
            lost, ranks = heapq.heappop(queue)
            if len(ranks) == len(places):
                found += 1
                if found > 1:
                    parts, at = [], 0
                    for p, options, rank in zip(places, ways, ranks, strict=True):
                        parts += [whole[at : shift[p]], options[rank][1]]
                        at = shift[p] + of_row[p]
                    out.append((score - lost, np.concatenate([*parts, whole[at:]])))
                continue
            options = ways[len(ranks)]
            for rank, (s, _) in enumerate(options):
                heapq.heappush(queue, (lost + options[0][0] - s, (*ranks, rank)))
        return out


COLUMNS = {
    "rank": T.IntegerType(), "score": T.DoubleType(), "n_pieces": T.LongType(), "ids": T.ArrayType(T.IntegerType()),
    "text": T.StringType(), "ids_sha256": T.StringType(), "round_trip": T.BooleanType(), "margin": T.DoubleType(),
}


def segmentations(
    documents: DataFrame,
    n_best: int = 3,
    columns: tuple[str, ...] = ("rank", "score", "n_pieces", "ids", "text"),
    keep: tuple[str, ...] = ("doc_id",),
    path: str = VOCABULARY,
) -> DataFrame:
    """The n best segmentations of each row's text, a row for each rank: columns `keep` and `columns`.

    rank (from 1), score (sum of the pieces' scores in the vocabulary; a character without a piece
    scores 10 below the worst usual one and becomes byte pieces), n_pieces, ids, text (decoded
    again), ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip (the decoded
    text is the input) and margin (how much less the next rank scores; null for the last one). Encoding puts one space in front, decoding takes it away.

    Of equal scores fewer pieces come first. Of equally many the first word that two ways segment
    differently decides, by the order of its own ways; in a word the longer first piece wins, then the second.
    The rule is the same for words and texts of any length. A text with fewer segmentations has fewer rows. Null and empty texts have one
    row, of rank 1 with score 0 and no ids, and decode to the empty text (round_trip is true for both).
    Repeated rows each give their rows. Whole texts are encoded, whatever their length. An
    empty table gives no rows; columns that are not in `keep` are not read, but for text.
    """
    inner = documents.selectExpr(*keep, "cast(text as string) _text")
    schema = inner.select(*keep).schema
    for name in columns:
        schema = schema.add(name, COLUMNS[name])
    fields = [pa.list_(pa.int32()) if c == "ids" else None for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)
        kinds = {"rank": pa.int32(), "score": pa.float64(), "n_pieces": pa.int64(), "ids_sha256": pa.string(),
                 "text": pa.string(), "round_trip": pa.bool_(), "margin": pa.float64()}
        for whole in gathered(batches, "_text", GATHERED):
            for batch in pieces_of(whole, "_text", GATHERED):
                texts = batch.column("_text").to_pylist() if "round_trip" in columns else [None] * batch.num_rows
                taken: list[int] = []
                values: dict[str, list] = {c: [] for c in columns}
                for i, (text, ways) in enumerate(zip(texts, encoder.encode(batch.column("_text"), n_best), strict=True)):
                    ways = ways or [(0.0, np.empty(0, np.int32))]
                    for rank, (cost, ids) in enumerate(ways, 1):
                        taken.append(i)
                        again = vocab.decode(ids) if "text" in values or "round_trip" in values else None
                        row = {
                            "rank": rank,
                            "score": float(np.round(cost, 3)) + 0.0,
                            "n_pieces": len(ids),
                            "ids": ids,
                            "text": again,
                            "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest() if "ids_sha256" in values else None,
                            "round_trip": again == (text or ""),
                            "margin": float(np.round(cost - ways[rank][0], 3)) + 0.0 if rank < len(ways) else None,
                        }
                        for c in columns:
                            values[c].append(row[c])
                rows = pa.array(taken, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(rows) for c in keep),
                        *(pa.array(values[c], f or kinds[c]) for c, f in zip(columns, fields, strict=True)),
                    ],
                    [*keep, *columns],
                )

    return inner.mapInArrow(run, schema)
