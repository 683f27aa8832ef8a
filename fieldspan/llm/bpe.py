"""BPE by speculation and verification.

For each new word a greedy longest match proposes tokens. A proposal is the exact
result if each token alone encodes to itself and no merge of lower rank reaches
across any two neighbours; both are tested with arrays over all neighbours of a
batch at once. Only words that fail go through exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

#: Distinct runs between white space, and distinct words, held at once by a task.
CACHE = 250_000
#: Stands for the end of a word inside token strings.
END = "\0"
NEVER = np.int64(1) << 40
NO_RANK = 1 << 40
# Below this code point, but for one letter whose small form is two characters, letters
# and digits are the same in every Unicode version and composition changes nothing.
_SIMPLE = [c for c in map(chr, range(0x21, 0x180)) if c != "\u0130" and unicodedata.category(c)[0] not in "CZ"]
_LETTERS, _DIGITS = ("".join(re.escape(c) for c in _SIMPLE if unicodedata.category(c)[0] == k) for k in "LN")
_ALL_SIMPLE = re.compile("[" + "".join(map(re.escape, _SIMPLE)) + "]*")
_SIMPLE_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordBPE:
    """Encoder and decoder of a tokenizer file with word ends (``end_of_word_suffix``).

    White space separates words; text is normalised and split as the file says.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model = parsed["model"]
        self.suffix = model["end_of_word_suffix"]
        own = Tokenizer.from_str(spec)
        self._normal, self._split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"].encode(): t["id"] for t in parsed["added_tokens"]}
        self.text = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
        self.bytes = [b""] * (max(self.text) + 1)
        for i, t in self.text.items():
            self.bytes[i] = t.encode()
        inner = lambda t: t[: -len(self.suffix)] + END if t.endswith(self.suffix) and len(t) > len(self.suffix) else t
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        self.longest: dict[str, int] = {}
        for t in self.ids:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 0), len(t))
        pattern = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._simple = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [n["type"] for n in parsed["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        shown = [b for b in range(256) if unicodedata.category(chr(b))[0] not in "CZ" and b != 0xAD]
        hidden = [b for b in range(256) if b not in shown]
        self._bytes = {b: chr(256 + i) for i, b in enumerate(hidden)}
        n = max(self.text) + 1
        pairs, left, right, rank = [], np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = model["vocab"][a], model["vocab"][b]
            # the second part carries the suffix if the whole does
            c = self.ids[inner(self.text[a] + self.text[b])]
            self.merges[a, b] = (r, c)
            pairs.append((a * n + b, r))
            if rank[c] < 0:
                left[c], right[c], rank[c] = a, b, r
        pairs.sort()
        self._n, self._left, self._right, self._rank = n, left, right, rank
        self._keys, self._ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self._whole = self._self_consistent()
        self.cache: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which tokens a and b would merge; NEVER for no such merge."""
        key = a * self._n + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def _apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge of a rank under ``until`` joins the end of a to the start of b.

        Merging a word runs by rank. While it builds a and b side by side, the piece that
        ends a and the piece that starts b are, at each moment, known: going back in
        rank, the piece of higher rank is undone first. A merge of such two pieces that
        ranks below the next event on either side would have come first.
        """
        a, b, ok = a.copy(), b.copy(), np.ones(len(a), bool)
        until = until.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            ok[live] &= self._reach(x, y) >= until[live]
            rx, ry = self._rank[x], self._rank[y]
            live_on = ok[live] & ((rx >= 0) | (ry >= 0))
            # equal ranks merge from the left: a before b, and across them before b
            undo_b = ry >= rx
            until[live] = np.maximum(rx, ry) + undo_b
            b[live] = np.where(undo_b & (ry >= 0), self._left[y], y)
            a[live] = np.where(~undo_b, self._right[x], x)
            live = live[live_on]
        return ok

    def _self_consistent(self) -> np.ndarray:
        """Tokens that their own text encodes to: both parts are such, and stay apart
        until the merge that makes the token."""
        ok = np.ones(self._n, bool)
        made = np.flatnonzero(self._rank >= 0)
        apart = np.ones(self._n, bool)
        apart[made] = self._apart(self._left[made], self._right[made], self._rank[made])
        for t in made[np.argsort(self._rank[made])]:
            ok[t] = apart[t] and ok[self._left[t]] and ok[self._right[t]]
        return ok

    def greedy(self, word: str) -> list[int] | None:
        ids, longest = self.ids, self.longest
        if (t := ids.get(word + END)) is not None:
            return [t]
        word, out, at = word + END, [], 0
        end = len(word)
        while at < end:
            two = word[at : at + 2]
            for to in range(min(end, at + longest.get(two, 1)), at, -1):
                if (t := ids.get(word[at:to])) is not None:
                    out.append(t)
                    at = to
                    break
            else:
                return None
        return out

    def exact(self, word: str) -> list[int]:
        """Merging by rank, leftmost first."""
        piece = [self.ids[c] for c in word[:-1]]
        piece.append(self.ids[word[-1] + END])
        return self._merge_short(piece) if len(piece) <= 40 else self._merge_long(piece)

    def _merge_short(self, piece: list[int]) -> list[int]:
        get, none = self.merges.get, (NO_RANK, -1)
        found = [get(p, none) for p in zip(piece, piece[1:], strict=False)]
        while found:
            best = min(found)
            if best is none or best[0] == NO_RANK:
                break
            i = found.index(best)
            piece[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((piece[i - 1], piece[i]), none)
            if i < len(found):
                found[i] = get((piece[i], piece[i + 1]), none)
        return piece

    def _merge_long(self, piece: list[int]) -> list[int]:
        """The same over a heap of pairs and a linked list of pieces."""
        n = len(piece)
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, piece[i], piece[i + 1]) for i in range(n - 1) if (m := self.merges.get((piece[i], piece[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = ahead[i]
            if piece[i] != x or j >= n or piece[j] != y:
                continue
            piece[i], piece[j] = self.merges[x, y][1], -1
            ahead[i] = ahead[j]
            if ahead[i] < n:
                behind[ahead[i]] = i
            for a, b in ((behind[i], i), (i, ahead[i])):
                if 0 <= a and b < n and (m := self.merges.get((piece[a], piece[b]))):
                    heapq.heappush(heap, (m[0], a, piece[a], piece[b]))
        return [p for p in piece if p >= 0]

    def words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word: proposed, verified together, merged where that fails."""
        guess = [self.greedy(w) for w in words]
        flat = np.array([t for g in guess if g for t in g], np.int64)
        size = np.array([len(g) if g else 0 for g in guess], np.int64)
        owner = np.repeat(np.arange(len(words)), size)
        bad = np.array([g is None for g in guess], bool)
        bad[owner[~self._whole[flat]]] = True
        same = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        apart = self._apart(flat[same], flat[same + 1], np.full(len(same), NEVER))
        bad[owner[same[~apart]]] = True
        return [self.exact(w) if b else g for w, g, b in zip(words, guess, bad.tolist(), strict=True)]

    def _pieces(self, chunk: bytes) -> list[str | int]:
        """A chunk without ASCII white space: words, and ids of special tokens in it."""
        for s, i in self.special.items():
            if s in chunk:
                parts = [self._pieces(p) for p in chunk.split(s)]
                return [x for k, p in enumerate(parts) for x in ([i] if k else []) + p]
        text = chunk.decode()
        if self._simple and _ALL_SIMPLE.fullmatch(text):
            text = text.lower()
            if text.isascii():
                return [text] if text.isalpha() else _SIMPLE_WORDS.findall(text)
            found = [text] if text.isalpha() else _SIMPLE_WORDS.findall(text)
            return [w.encode().decode("latin-1").translate(self._bytes) for w in found]
        return [p for p, _ in self._split(self._normal(text))] if text else []

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian 32-bit integers."""
        out = []
        split = [t.split() for t in texts]
        # about as many texts at a time as bring some thousands of new words to verify
        for lo in range(0, len(split), 100):
            part = split[lo : lo + 100]
            every = {c for chunks in part for c in chunks}
            fresh = [c for c in every if c not in self.cache]
            if len(self.cache) + len(fresh) > CACHE:
                self.cache.clear()
                fresh = list(every)
            if len(self.known) > CACHE:
                self.known.clear()
            self._learn(fresh)
            get = self.cache.__getitem__
            out += [b"".join(map(get, chunks)) for chunks in part]
        return out

    def _learn(self, chunks: list[bytes]) -> None:
        pieces = [self._pieces(c) for c in chunks]
        known = self.known
        fresh = list(dict.fromkeys(p for ps in pieces for p in ps if isinstance(p, str) and p not in known))
        known.update(zip(fresh, map(_little, self.words(fresh)), strict=True))
        for c, ps in zip(chunks, pieces, strict=True):
            parts = [_little([p]) if isinstance(p, int) else known[p] for p in ps]
            self.cache[c] = parts[0] if len(parts) == 1 else b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings joined by a space: the file names no decoder."""
        return b" ".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, WordBPE] = {}


def _coder(spec: str) -> WordBPE:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBPE(spec)
    return _LOADED[key]


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` plus ``n_tokens`` and ``token_ids`` (binary, little-endian uint32).

    ``tokenizer`` is the path of a tokenizer file, read once on the driver; its size,
    not the data's, bounds what tasks receive. Null texts encode as empty, rows pass one
    by one, and input columns with the added names are replaced. With ``digests`` the
    ids and the decoded text are hashed in place of being returned: ``ids_sha256`` and
    ``decoded_sha256``.
    """
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "token_ids"]
    docs = docs.drop(*[c for c in added if c != text_col])
    kinds = [T.LongType(), T.StringType(), T.StringType()] if digests else [T.LongType(), T.BinaryType()]
    keep = [f for f in docs.schema.fields if not (digests and f.name == text_col)]
    schema = T.StructType([*keep, *[T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = coder.encode([t or b"" for t in part.column(text_col).cast(pa.large_binary()).to_pylist()])
                cols = [part.column(f.name) for f in keep] + [pa.array([len(i) // 4 for i in ids], pa.int64())]
                if digests:
                    cols.append(pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()))
                    cols.append(pa.array([hashlib.sha256(coder.decode(i)).hexdigest() for i in ids], pa.string()))
                else:
                    cols.append(pa.array(ids, pa.binary()))
                yield pa.record_batch(cols, names=[*[f.name for f in keep], *added])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, tokenizer: str, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` plus ``decoded``: the text of ``ids_col``; null ids give an empty one."""
    from pyspark.sql import types as T

    with open(tokenizer, encoding="utf-8") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())
    tokens = tokens.drop("decoded")
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            out = [coder.decode(i or b"").decode() for i in batch.column(ids_col).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, schema)
