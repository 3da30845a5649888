"""SentencePiece segmentations sampled by forward filtering and backward sampling; lossless decoding."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ship, table, worker_cache

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: The model ranks its pieces and gives no probabilities: a piece of rank r weighs (r + SHIFT)^-EXPONENT (Zipf's
#: law) to the power theta. Bytes of characters without a piece weigh as the last rank.
SHIFT, EXPONENT = 2.7, 1.0
#: Units of text that the lattice falls apart into: a space at most, then letters, digits or signs; other white
#: space by itself. Pieces that would cross a unit's end are not used.
UNIT = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:_|[^\w\s])+|\s")
#: Units up to this length are kept between texts, and this many of them; longer ones are computed each time.
CACHE_CHARS, CACHE_UNITS = 48, 120_000
#: New units are filtered together up to about this many characters; a pass holds some 500 bytes a character.
PASS_CHARS = 50_000


class Lattice:
    """Forward filters of units: for every end place the pieces that may end there with cumulative shares."""

    def __init__(self, model: str = DEFAULT_MODEL, theta: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(len(sp)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.text_of = [("" if i in special else sp.id_to_piece(i).replace(SPACE, " ")) for i in range(len(sp))]
        # a literal U+2581 would read as a space: it is spelled in bytes, and pieces are held with plain spaces
        self.id_of = {t: i for i, t in enumerate(self.text_of) if t and " " not in t[1:]}
        self.spelled = [t.encode() for t in self.text_of]
        for b, i in enumerate(self.bytes):
            self.spelled[i] = bytes([b])
        first = min(self.id_of.values())
        self.trie: dict = {}
        for t, i in self.id_of.items():
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = (i - first + SHIFT) ** (-EXPONENT * theta), i
        self.flatten()
        self.least = (len(sp) + SHIFT) ** (-EXPONENT * theta)
        self.longest = max(map(len, self.id_of))
        self.cache: dict[str, int] = {}
        # the options of all filters' states, end to end
        self.reset()

    def flatten(self) -> None:
        """The trie as arrays: sorted edges (node, code point) -> node, and of each node its weight and piece or -1."""
        keys, to, weight, piece, queue = [], [], [0.0], [-1], [(self.trie, 0)]
        for node, k in queue:
            for c, child in node.items():
                if c == "":
                    weight[k], piece[k] = child
                else:
                    keys.append(k << 21 | ord(c))
                    to.append(len(weight))
                    queue.append((child, len(weight)))
                    weight.append(0.0)
                    piece.append(-1)
        order = np.argsort(keys)
        self.edges, self.to = np.array([*np.array(keys)[order], 2**62]), np.array([*np.array(to)[order], 0])
        self.weights, self.pieces = np.array(weight), np.array(piece)

    def reset(self) -> None:
        self.cache.clear()
        self.states = 0
        self.last = array("q")  # of each unit: its final state
        self.cum = array("q")  # state * 2^32 + cumulative share in 2^-32: sorted over all options
        self.prev = array("i")  # option -> state before the piece, or -1 at the unit's start
        self.piece = array("i")  # option -> piece id, or -1 - code point for bytes

    def numbers(self, units: list[str]) -> np.ndarray:
        """The filters' numbers of the units; new ones are computed together, long ones singly."""
        cache = self.cache
        new = [u for u in dict.fromkeys(units) if u not in cache]
        some = [u for u in new if len(u) <= CACHE_CHARS]
        stops = np.cumsum([len(u) for u in some])
        for part in np.split(np.arange(len(some)), np.nonzero(np.diff(stops // PASS_CHARS))[0] + 1) if some else ():
            self.forward_all([some[k] for k in part.tolist()])
        for u in new:
            if len(u) > CACHE_CHARS:
                cache[u] = self.forward(u)
        return np.array([cache[u] for u in units], np.int64)

    def forward_all(self, us: list[str]) -> None:
        """forward() of many short units: one walk of the trie from all characters, then all units place by place."""
        sizes = np.array([len(u) for u in us])
        stops = np.cumsum(sizes)
        n = int(stops[-1])
        chars = np.frombuffer("".join(us).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        place = np.arange(n) - np.repeat(stops - sizes, sizes)
        left = np.repeat(stops, sizes) - np.arange(n)
        found, start, node = [], np.arange(n), np.zeros(n, np.int64)
        for k in range(1, self.longest + 1):
            inside = left[start] >= k
            start, node = start[inside], node[inside]
            key = node << 21 | chars[start + (k - 1)]
            at = np.searchsorted(self.edges, key)
            hit = self.edges[at] == key
            start, node = start[hit], self.to[at[hit]]
            whole = self.pieces[node] >= 0
            got = start[whole], node[whole]
            if k == 1:  # characters without a piece are spelled
                bare = np.ones(n, bool)
                bare[got[0]] = False
                bare = np.nonzero(bare)[0]
                found.append((bare, bare, np.full(len(bare), self.least), -1 - chars[bare]))
            found.append((got[0], got[0] + (k - 1), self.weights[got[1]], self.pieces[got[1]]))
            if not len(start):
                break
        first, last, weight, piece = (np.concatenate(x) for x in zip(*found[::-1], strict=True))
        order = np.argsort(last, kind="stable")  # by end, and there by start
        first, last, weight, piece = first[order], last[order], weight[order], piece[order]
        alpha, share = np.zeros(n), np.empty(len(first))
        inner, depth = place[first] > 0, place[last].astype(np.uint16)
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(int(depth.max()) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            m = by_depth[lo:hi]
            share[m] = x = np.where(inner[m], alpha[first[m] - 1], 1.0) * weight[m]
            np.add.at(alpha, last[m], x)
        rank = np.arange(len(last)) - np.searchsorted(last, last)
        run, cum = np.zeros(n), np.empty(len(last), np.int64)
        base = self.states
        for k in range(int(rank.max()) + 1):
            m = np.nonzero(rank == k)[0]
            e = last[m]
            run[e] += share[m]
            cum[m] = (base + e << 32) + (run[e] / alpha[e] * 2.0**32).astype(np.int64)
        ends = np.append(np.nonzero(last[1:] != last[:-1])[0], len(last) - 1)
        cum[ends] = base + last[ends] + 1 << 32
        self.cum.frombytes(cum.tobytes())
        self.prev.frombytes(np.where(inner, base + first - 1, -1).astype(np.int32).tobytes())
        self.piece.frombytes(piece.astype(np.int32).tobytes())
        no = len(self.last)
        self.last.frombytes((base + stops - 1).tobytes())
        self.states += n
        self.cache.update(zip(us, range(no, no + len(us)), strict=True))

    def forward(self, u: str) -> int:
        """Filter a unit from left to right: alpha[j] sums alpha[i] * weight(u[i:j]) over the pieces that end at j."""
        n, base, root = len(u), self.states, self.trie
        alpha, ends = [1.0] + [0.0] * n, [[] for _ in range(n + 1)]
        cum, prev, piece = [], [], []
        for i in range(n):
            a = alpha[i]
            if a < 1e-150:  # shares stay as they are when all that is open is scaled alike
                for j in range(i, min(n, i + self.longest) + 1):
                    alpha[j] /= a
                    if j > i:
                        ends[j] = [(x / a, k, p) for x, k, p in ends[j]]
                a = 1.0
            node, j = root, i
            while j < n and (node := node.get(u[j])) is not None:
                j += 1
                if (hit := node.get("")) is not None:
                    x = a * hit[0]
                    alpha[j] += x
                    ends[j].append((x, i, hit[1]))
            if not (ends[i + 1] and ends[i + 1][-1][1] == i):
                x = a * self.least
                alpha[i + 1] += x
                ends[i + 1].append((x, i, -1 - ord(u[i])))
            j, total, run = i + 1, alpha[i + 1], 0.0
            state = base + i
            for x, k, p in ends[j]:
                run += x
                cum.append((state << 32) + int(run / total * 2.0**32))
                prev.append(base + k - 1 if k else -1)
                piece.append(p)
            cum[-1] = state + 1 << 32
        self.cum.fromlist(cum)
        self.prev.fromlist(prev)
        self.piece.fromlist(piece)
        self.states += n
        self.last.append(base + n - 1)
        return len(self.last) - 1

    def sample(self, texts: list[str], keys: list[str], seed: int) -> list[np.ndarray]:
        """Piece ids of each text. The random numbers of a text follow from its key and the seed alone."""
        if len(self.last) > CACHE_UNITS or len(self.cum) > 5_000_000:
            self.reset()
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        index = self.numbers([u for us in units for u in us])
        for u in {u for us in units for u in us if len(u) > CACHE_CHARS}:
            del self.cache[u]  # found again only by computing it again
        n_units = np.array([len(us) for us in units])
        salt = np.array([int.from_bytes(hashlib.blake2b(f"{seed}\0{k}".encode(), digest_size=8).digest(), "little") for k in keys], np.uint64)
        owner = np.repeat(salt, n_units)
        place = np.arange(len(index)) - np.repeat(np.cumsum(n_units) - n_units, n_units)
        got, counts = self.walk(index, owner, place.astype(np.uint64))
        ends = np.cumsum(np.concatenate([[0], counts]))[np.cumsum(n_units)]
        return np.split(got, ends[:-1])

    def walk(self, index: np.ndarray, owner: np.ndarray, place: np.ndarray):
        """Sample all units at once from their last states backward: piece ids in text order, and their number by unit."""
        cum, prev, piece, last = np.frombuffer(self.cum, np.int64), np.frombuffer(self.prev, np.int32), np.frombuffer(self.piece, np.int32), np.frombuffer(self.last, np.int64)
        state, counts = last[index], np.zeros(len(index), np.int64)
        steps, active = [], np.arange(len(index))
        while len(active):
            r = np.searchsorted(cum, (state[active] << 32) + uniform(owner[active], place[active], len(steps)), side="right")
            steps.append((active, piece[r]))
            counts[active] += 1
            back = prev[r]
            state[active] = back
            active = active[back >= 0]
        stop = np.cumsum(counts)
        out = np.empty(int(counts.sum()), np.int64)
        for depth, (units, ids) in enumerate(steps):
            out[stop[units] - 1 - depth] = ids
        return self.spell(out, counts) if (out < 0).any() else (out.astype(np.int32), counts)

    def spell(self, out: np.ndarray, counts: np.ndarray):
        """Put the byte pieces of characters in place of their marks."""
        unit_of = np.repeat(np.arange(len(counts)), counts)
        ids, owners, at = [], [], 0
        for k in np.nonzero(out < 0)[0].tolist():
            each = [self.bytes[b] for b in chr(-1 - out[k]).encode("utf-8", "surrogatepass")]
            ids += [out[at:k], np.array(each)]
            owners += [unit_of[at:k], np.full(len(each), unit_of[k])]
            at = k + 1
        ids, owners = np.concatenate([*ids, out[at:]]), np.concatenate([*owners, unit_of[at:]])
        return ids.astype(np.int32), np.bincount(owners, minlength=len(counts))

    def decode(self, ids: list[int]) -> str:
        """The exact text that the ids were sampled from: pieces and bytes joined, without the leading space."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def uniform(owner: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """Numbers of 32 random bits that depend on row key, unit and step only (a splitmix64 finisher)."""
    with np.errstate(over="ignore"):
        z = owner + place * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(32)).astype(np.int64)


@worker_cache("pieces", 2)
def lattice(model: str, theta: float) -> Lattice:
    return Lattice(model, theta)


def _slices(pdf: pd.DataFrame, chars: int = 300_000) -> Iterator[pd.DataFrame]:
    """Slices of a batch of some total length, so that long texts don't meet in one pass."""
    lo, size = 0, 0
    for i, t in enumerate(pdf["text"]):
        size += len(t) if isinstance(t, str) else 0
        if size >= chars or i == len(pdf) - 1:
            yield pdf.iloc[lo : i + 1].copy()
            lo, size = i + 1, 0


def encode(docs: DataFrame, seed: int = 0, theta: float = 1.0, model: str = DEFAULT_MODEL, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text, ids array<int>), one row for each row of docs: a segmentation sampled over the whole text.

    The probability of a segmentation is the product of its pieces' weights, normalised over the lattice. The
    same key, text, seed, theta and model give the same ids on any machine, so repeated rows agree; a null key is
    a key of its own. Null text gives null ids, empty text an empty array. Other columns are not read."""
    return _pass(docs, seed, theta, model, key_col, text_col, "text string, ids array<int>", _listed).withColumnRenamed("text", text_col)


def _listed(lat: Lattice, pdf: pd.DataFrame, ids: list) -> pd.DataFrame:
    pdf["ids"] = [x if isinstance(t, str) else None for x, t in zip(ids, pdf["text"], strict=True)]
    return pdf[["key", "text", "ids"]]


def _pass(docs: DataFrame, seed: int, theta: float, model: str, key_col: str, text_col: str, schema: str, finish) -> DataFrame:
    """Sample the rows' segmentations and hand them to finish, slice by slice."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattice(model, theta)
        for pdf in batches:
            for part in _slices(pdf):
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                yield finish(lat, part, lat.sample(texts, part["k"].tolist(), seed))

    inner = docs.select(F.col(key_col).alias("key"), F.coalesce(F.col(key_col).cast("string"), F.lit("\u0000null")).alias("k"), F.col(text_col).alias("text"))
    kind = inner.schema["key"].dataType.simpleString()
    return inner.mapInPandas(run, f"key {kind}, {schema}").withColumnRenamed("key", key_col)


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that the ids spell; null for null."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        lat = lattice(model, 1.0)
        return pd.Series([None if x is None else lat.decode(x.tolist()) for x in ids], dtype=object)

    return encoded.withColumn(out_col, run(F.col(ids_col)))


def digests(docs: DataFrame, seed: int = 0, theta: float = 1.0, model: str = DEFAULT_MODEL, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_chars, n_pieces, ids_sha256, lossless): encode() and decode() of each row in one pass, digested there.

    The hash is that of the ids as little-endian 32-bit numbers; lossless says whether decoding gave the text back.
    Null text: null counts and hash, lossless."""
    return _pass(docs, seed, theta, model, key_col, text_col, "n_chars long, n_pieces long, ids_sha256 string, lossless boolean", _digested)


def _digested(lat: Lattice, pdf: pd.DataFrame, ids: list) -> pd.DataFrame:
    texts = pdf["text"].tolist()
    out = [(len(t), len(x), hashlib.sha256(x.tobytes()).hexdigest(), lat.decode(x.tolist()) == t) if isinstance(t, str) else (None, None, None, True) for t, x in zip(texts, ids, strict=True)]
    out = pd.DataFrame(out, columns=["n_chars", "n_pieces", "ids_sha256", "lossless"]).astype({"n_chars": "Int64", "n_pieces": "Int64"})
    out.insert(0, "key", pdf["key"].to_numpy())
    return out


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
