"""BPE encoding and decoding without a merge loop.

Encoder: an Aho-Corasick automaton of all token byte strings gives the longest
token at each position; a token is appended only if the pair it forms is what
the merges would give, else the encoder steps back to the next shorter token.
Positions found dead are marked, so each is left at most once and the time is
linear in the text. Decoder: one blob of all token bytes and an offset table.

Scale: row by row, no shuffle. A worker holds the vocabulary and a bounded
cache of encoded pieces. Python stays within a task; texts are never cut.

Defined cases: a null text is empty and has no tokens. The added token's string
in a text is that one token, as in the tokenizer file. Null or repeated ids and
other columns don't matter: each row is encoded on its own and only its id and
results come out. An empty table gives an empty result; texts of any length are
encoded whole. Ids outside the table are an error when decoding.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import alone, in_slices, keeps

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where the pattern surely cuts: a run without white space, with the space before it, and the white space between.
CHUNKS = r""" ?\S+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 is itself, the rest follows from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A vocabulary file with its automaton, pair table and offset table."""

    def __init__(self, path: str, cache: int = 300_000):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.tokens: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]))
        for s, i in model["vocab"].items():
            self.tokens[i] = raw(s)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for s, i in self.added.items():
            self.tokens[i] = s.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        #: (left, right) -> rank; and token -> its own (left, right), rank
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.split = {}
        for (a, b), (r, t) in self.rank.items():
            self.split.setdefault(t, (a, b, r))
        ids = [i for i in vocab.values() if len(self.tokens[i]) == 1 or i in self.split]
        auto = ahocorasick.Automaton()
        for i in ids:
            auto.add_word(self.tokens[i].decode("latin-1"), (len(self.tokens[i]) - 1, i))
        auto.make_automaton()
        self.auto, self.of = auto, {self.tokens[i]: i for i in ids}
        self.prefix: dict[int, int] = {}
        self.pattern, self.chunks = regex.compile(PATTERN), regex.compile(CHUNKS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.size, self.said = [len(t) for t in self.tokens], [str(i) for i in range(len(self.tokens))]
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.offsets = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.fits: dict[int, bool] = {}
        self.most = cache

    def shorter(self, token: int) -> int:
        """The longest other token that is a prefix of this one; -1 if none."""
        if token not in self.prefix:
            t = self.tokens[token]
            self.prefix[token] = next((self.of[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.of), -1)
        return self.prefix[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens: no merge across the seam comes first."""
        key = left << 32 | right
        if key not in self.fits:
            if len(self.fits) > 4 * self.most:
                self.fits.clear()
            self.fits[key] = self._seam(left, right)
        return self.fits[key]

    def _seam(self, left: int, right: int) -> bool:
        limit, never = float("inf"), (-1, -1, -1)
        a, b = left, right
        while True:
            r, _ = self.rank.get((a, b), (limit, -1))
            if r < limit:
                return False
            la, lb = self.split.get(a, never), self.split.get(b, never)
            # undo the later of the two merges at the seam; the pair then met must not merge before that one
            if la[2] > lb[2]:
                limit, a = la[2], la[1]
                if self.rank.get((a, b), (limit, 0))[0] < limit:
                    return False
            elif lb[2] >= 0:
                limit, b = lb[2] + 1, lb[0]  # on the right side a tie goes to the leftmost pair, the seam
                if self.rank.get((a, b), (limit, 0))[0] < limit:
                    return False
            else:
                return True

    def longest(self, data: bytes) -> list[int]:
        """The longest token that starts at each position, from one pass of the automaton: of those with one start the longest ends last."""
        best = [-1] * len(data)
        for end, (back, token) in self.auto.iter(data.decode("latin-1")):
            best[end - back] = token
        return best

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.of.get(data)
        if whole is not None and self._alone(whole):
            return (whole,)
        best, n, size, fits = self.longest(data), len(data), self.size, self.fits
        out, at, last = [], 0, -1
        dead: set[int] = set()
        token = best[0] if n else -1
        while token >= 0:
            end = at + size[token]
            fit = last < 0 or fits.get(last << 32 | token)
            if end not in dead and (self.compatible(last, token) if fit is None else fit):
                out.append(token)
                if end == n:
                    break
                at, last, token = end, token, best[end]
            else:
                token = self.shorter(token)
            while token < 0 and out:  # nothing fits here: this place is dead
                dead.add(at)
                gone = out.pop()
                at -= size[gone]
                last, token = out[-1] if out else -1, self.shorter(gone)
        return tuple(out)

    @lru_cache(maxsize=100_000)  # noqa: B019  one object a worker
    def _alone(self, token: int) -> bool:
        """Whether the merges build this token from its bytes."""
        s = self.split.get(token)
        return s is None or (self._alone(s[0]) and self._alone(s[1]) and self._within(s))

    def _within(self, s: tuple[int, int, int]) -> bool:
        a, b, r = s
        la, lb = self.split.get(a, (-1, -1, -1)), self.split.get(b, (-1, -1, -1))
        del self.rank[(a, b)]  # apart from its own merge the two must be stable side by side
        try:
            return self._seam(a, b) if max(la[2], lb[2]) >= 0 else True
        finally:
            self.rank[(a, b)] = (r, self.of[self.tokens[a] + self.tokens[b]])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.cache.get
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            for chunk in self.chunks.findall(part):
                out += known(chunk) or self._chunk(chunk)
        return out

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        pieces = self.pattern.findall(chunk)
        if len(pieces) == 1:
            return self._kept(chunk, self.encode_piece(chunk.encode()))
        ids: list[int] = []
        for piece in pieces:
            ids += self.cache.get(piece) or self._kept(piece, self.encode_piece(piece.encode()))
        return self._kept(chunk, tuple(ids))

    def _kept(self, text: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(text) <= 64:
            if len(self.cache) >= self.most:
                self.cache.clear()
            self.cache[text] = ids
        return ids

    def decode(self, ids) -> bytes:
        """The tokens' bytes, gathered from the blob through the offset table."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.blob[np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - n), n)].tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


keeps(__name__, tokenizer.cache_clear, Tokenizer._alone.cache_clear)  # the latter's keys hold the tokenizer


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for. path: a byte-level BPE file that every worker has."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    schema = pa.schema([*fields, *([pa.field("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def run(batches):
        t, sha = tokenizer(path), hashlib.sha256
        said = t.said.__getitem__
        for b in in_slices(batches, 256, 1):
            n, digests, back, kept = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = t.encode(text or "")
                n.append(len(ids))
                digests.append(sha(",".join(map(said, ids)).encode()).hexdigest())
                decoded = t.decode(ids).decode("utf-8", "replace")
                back.append(sha(decoded.encode()).hexdigest())
                if keep_ids:
                    kept.append(ids)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(alone(__name__, run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
