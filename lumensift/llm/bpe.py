"""Byte-level BPE encoding and decoding as tree reductions.

Encoding is a reduction of a monoid. Its elements are texts with their pieces
(matches of the pattern), and piece by piece byte strings with their tokens; both
are made by encoding halves and joining the two results.

*Pieces.* A match is decided by its own characters and two more at most (a space
is held back before a word, contractions have three). So all matches of the left
half stay, but for those that end within two characters of the border; these and
a window of the right half's matches are matched again. Where one of the new
matches ends at a start of the right half's, and the window goes two characters
further, all later matches of the right half stay; until then the window doubles.

*Tokens.* The merges (least rank first, then leftmost) of a byte string have the
tokens t1 ... tn as their result exactly if each neighbouring pair merges to itself: a
run on the whole, restricted to the bytes of two tokens, is the start of the run on these alone, so the
first merge over a border would also happen there; and the reverse. So when two token lists are
joined, only the pair at the border is looked at; if it doesn't merge to itself, a
window around the border is merged again, and grows at the side whose border pair
isn't stable, until both are.

Decoding concatenates the tokens' bytes up a tree.

Ranks are read from a file on the driver (its path is a parameter) and
broadcast; the file of a vocabulary is bounded by its number of tokens. Rows are encoded
where they lie, without a shuffle. A long text is encoded in leaves of bounded
size; besides the text itself and its ids, memory is bounded by the memo of
pieces (``MEMO_BYTES``).

Defined results: a null text has no tokens, like an empty one; bytes that are no
UTF-8 are read as U+FFFD; repeated rows and ties are encoded alike, each by
itself; null ids are carried; an empty table gives no rows; columns other than
the text pass through, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import chunks, small_batches

#: Characters of a text that are matched at once, and bytes of a piece that are merged at once; more are halved.
LEAF_CHARS = 1 << 12
LEAF_BYTES = 32

#: Characters behind a match that may have decided it.
AHEAD = 2

#: Bytes of pieces whose tokens a task remembers, about, with what a dictionary needs for each; beyond, it begins anew.
MEMO_BYTES = 48 << 20

#: The token of a pair that makes none.
NONE = np.int64(1 << 40)

#: Ids that are turned into bytes, or digits, at once.
LEAF_IDS = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def half(n: int) -> int:
    """Where n things are halved: the largest power of two below n, so runs of one letter are cut between whole tokens."""
    return 1 << ((n - 1).bit_length() - 1)


@dataclass
class Vocabulary:
    """Ranks, and the pairs of tokens that make a token: their keys in order, and the token each makes."""

    ranks: dict[bytes, int]
    keys: np.ndarray
    made: np.ndarray

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        ranks, get = (r := read_ranks(path)), r.get
        pairs = [(a << 32 | b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return cls(ranks, table[:, 0].copy(), table[:, 1].copy())

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or NONE."""
        if not len(self.keys):
            return np.full(len(a), NONE)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)


class Merges:
    """The token monoid: ``encoded`` makes an element of bytes, ``joined`` is its operation."""

    def __init__(self, vocabulary: Vocabulary, leaf: int = LEAF_BYTES):
        self.vocabulary, self.ranks, self.leaf = vocabulary, vocabulary.ranks, leaf
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.stable: dict[tuple[int, int], bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The tokens of bytes, by merging the pair of least rank, the leftmost first, until there is none."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here; an end of 0: none does
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, e = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != e:
                continue  # one of the two parts is no longer there
            end[i], end[j] = e, 0
            if e < n:
                before[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heappush(heap, (r, i, end[e]))
            if i and (r := ranks.get(piece[before[i] : e])) is not None:
                heappush(heap, (r, before[i], e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def merged_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the pieces (none is empty), and how many each has: every piece takes its next merge at once with the others."""
        tokens = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.arange(len(pieces))  # pieces that go on
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(sizes) - sizes
        pair = np.append(self.vocabulary.pair(tokens[:-1], tokens[1:]), NONE)
        pair[first + sizes - 1] = NONE  # of the last token of a piece
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(own):
            least = np.minimum.reduceat(pair, first)
            ended = least == NONE
            if ended.any():
                out = np.repeat(ended, sizes)
                done.append((own[ended], sizes[ended], tokens[out]))
                own, sizes, least, tokens, pair = own[~ended], sizes[~ended], least[~ended], tokens[~out], pair[~out]
                if not len(own):
                    break
                first = np.cumsum(sizes) - sizes
            of = np.repeat(np.arange(len(own)), sizes)
            hits = np.flatnonzero(pair == least[of])
            at = hits[np.append(True, np.diff(of[hits]) > 0)]  # the leftmost of each piece
            tokens[at] = least
            pair[at] = pair[at + 1]  # NONE if the second part is the last
            rest = np.ones(len(tokens), bool)
            rest[at + 1] = False
            tokens, pair, sizes = tokens[rest], pair[rest], sizes - 1
            at, first = at - np.arange(len(own)), np.cumsum(sizes) - sizes
            after = at[at < first + sizes - 1]
            pair[after] = self.vocabulary.pair(tokens[after], tokens[after + 1])
            before = at[at > first] - 1
            pair[before] = self.vocabulary.pair(tokens[before], tokens[before + 1])
        order = np.argsort(np.concatenate([d[0] for d in done]))
        sizes, flat = np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done])
        return gathered(flat, np.append(0, np.cumsum(sizes)), order), sizes[order]

    def stay(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens merge to themselves."""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) > 1 << 18:
                self.stable.clear()
            found = self.stable[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring byte strings from the tokens of each."""
        if not left or not right or self.stay(left[-1], right[0]):
            return left + right
        i = j = 1  # tokens of either side in the window
        while True:
            kept, rest = left[: len(left) - i], right[j:]
            window = self.merged(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))
            left_stays = not kept or self.stay(kept[-1], window[0])
            right_stays = not rest or self.stay(window[-1], rest[0])
            if left_stays and right_stays:
                return kept + window + rest
            i = i if left_stays else min(2 * i, len(left))
            j = j if right_stays else min(2 * j, len(right))

    def encoded(self, piece: bytes) -> list[int]:
        """The tokens of a piece: itself if it is a token, else by halves."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._by_halves(piece)

    def _by_halves(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.merged(piece)
        at = half(len(piece))
        return self.joined(self._by_halves(piece[:at]), self._by_halves(piece[at:]))


class Pieces:
    """The monoid of texts with their matches of a pattern that looks at most AHEAD characters behind a match."""

    def __init__(self, pattern: str, leaf: int = LEAF_CHARS):
        self.matches, self.leaf = regex.compile(pattern).findall, leaf

    def of(self, text: str) -> list[str]:
        if len(text) <= self.leaf:
            return self.matches(text)
        at = half(len(text))
        return self.joined(self.of(text[:at]), self.of(text[at:]))

    def joined(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of two neighbouring texts from the matches of each."""
        tail: list[str] = []
        while left and sum(map(len, tail)) < AHEAD:
            tail.append(left.pop())
        begun = "".join(reversed(tail))
        j = 4  # matches of the right side in the window
        while True:
            window = begun + "".join(right[:j])
            again = self.matches(window)
            if j >= len(right):
                return left + again
            starts, at = {}, len(begun)
            for k, piece in enumerate(right[:j]):
                starts[at] = k
                at += len(piece)
            at, last = 0, None
            for k, piece in enumerate(again):
                at += len(piece)
                if at + AHEAD > len(window):
                    break
                if at in starts:
                    last = (k + 1, starts[at])
            if last:
                return left + again[: last[0]] + right[last[1] :]
            j *= 2


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class Encoder:
    """Ids of texts, with a bounded memo of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.merges, self.pieces = Merges(vocabulary), Pieces(pattern)
        self._forget()

    def _forget(self) -> None:
        self.number, self.held = Numbers(), 0  # of a piece, whose tokens are flat[starts[n] : starts[n + 1]]
        self.flat, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Tokens of the pieces with the next numbers."""
        ranks, leaf = self.merges.ranks, self.merges.leaf
        small = [i for i, piece in enumerate(new) if len(piece) <= leaf and piece not in ranks]
        sizes = np.ones(len(new), np.int64)
        flat, counts = self.merges.merged_together([new[i] for i in small]) if small else (np.zeros(0, np.int64), sizes[:0])
        sizes[small] = counts
        others = [(i, self.merges.encoded(piece)) for i, piece in enumerate(new) if len(piece) > leaf or piece in ranks]
        for i, tokens in others:
            sizes[i] = len(tokens)
        starts = np.append(0, np.cumsum(sizes))
        made = np.empty(starts[-1], np.int64)
        at = np.zeros(len(new), bool)
        at[small] = True
        of_small = np.repeat(at, sizes)
        made[of_small] = flat
        made[~of_small] = np.fromiter((t for _, tokens in others for t in tokens), np.int64, int((~of_small).sum()))
        self.starts = np.concatenate([self.starts, starts[1:] + len(self.flat)])
        self.flat = np.concatenate([self.flat, made])
        self.held += 200 * len(new) + 2 * sum(map(len, new))

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text.encode()])[0]

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where those of each begin."""
        known, numbers, cuts = len(self.number), array("q"), [0]
        for t in texts:
            if t:
                numbers.extend(map(self.number.__getitem__, self.pieces.of(t.decode(errors="replace"))))
            cuts.append(len(numbers))
        self._learn([piece.encode() for piece in islice(self.number, known, None)])
        n = np.frombuffer(numbers, np.int64) if numbers else np.zeros(0, np.int64)
        ids = gathered(self.flat, self.starts, n).astype(np.int32)
        ends = np.append(0, np.cumsum(np.diff(self.starts)[n]))
        if self.held > MEMO_BYTES:
            self._forget()
        return ids, ends[np.array(cuts)]


def gathered(flat: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """flat[starts[n] : starts[n + 1]] of each n of numbers, one after the other."""
    sizes = starts[numbers + 1] - starts[numbers] if len(numbers) else np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return flat[np.arange(int(sizes.sum())) - np.repeat(first - starts[numbers], sizes)]


class Decoder:
    """Bytes of ids. An id that the vocabulary doesn't have is an error."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tokens), np.int64, size))])

    def decoded(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return gathered(self.flat, self.starts, ids.astype(np.int64)).tobytes()
        at = half(len(ids))
        return self.decoded(ids[:at]) + self.decoded(ids[at:])


def _rows(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column, and where those of each row begin; a null list is empty."""
    lists = batch.column(at)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _placed(df: DataFrame, name: str) -> tuple[DataFrame, list[str], list[str], str]:
    """df under names that nothing clashes with, its other columns' names as they were and as they are, and the present name of one."""
    names = df.columns
    places = [f"c{i}" for i in range(len(names))]
    at = names.index(name)
    others = [p for i, p in enumerate(places) if i != at]
    return small_batches(df).toDF(*places).select(*others, places[at]), [n for i, n in enumerate(names) if i != at], others, places[at]


def _fields(df: DataFrame, others: list[str], more: str) -> str:
    return ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in others), more])


def ids_digest(ids: np.ndarray) -> str:
    """SHA-256 of the decimal ids, joined by commas."""
    made = hashlib.sha256()
    for a in range(0, len(ids), LEAF_IDS):
        made.update((b"," if a else b"") + ",".join(map(str, ids[a : a + LEAF_IDS].tolist())).encode())
    return made.hexdigest()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", digests: bool = False) -> DataFrame:
    """docs with the token ids of the text (array<int>) instead of the text; digests: and n_tokens and ids_sha256 before these."""
    plain, names, others, at = _placed(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch, texts in chunks(batches, at):
            found, cuts = encoder.batch(texts)
            more = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(found))]
            if digests:
                sha = [ids_digest(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                more = [pa.array(np.diff(cuts)), pa.array(sha, pa.string()), *more]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*others, *added])

    added = ["n", "sha", "made"] if digests else ["made"]
    fields = _fields(plain, others, "n long, sha string, made array<int>" if digests else "made array<int>")
    return plain.mapInArrow(run, fields).toDF(*names, *(["n_tokens", "ids_sha256"] if digests else []), ids)


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with the bytes of the token ids (binary) instead of these; a null list has no bytes."""
    plain, names, others, _ = _placed(rows, ids)
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            found, cuts = _rows(batch, batch.num_columns - 1)
            made = [decoder.decoded(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], [*others, "made"])

    return plain.mapInArrow(run, _fields(plain, others, "made binary")).toDF(*names, decoded)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    decoded = decode(encode(docs, path, public_tokenizers.PATTERN, digests=True), path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
