"""BPE encoding by prefix-sharing trie traversal, and decoding.

The last token of a BPE encoding of each prefix of a word determines the whole encoding:
it is the one token that ends there and that BPE would leave standing next to the
last token of the prefix before it. The distinct words of a block of texts are
laid out as a trie in depth-first order (sorted, with the lengths of the prefixes
that they share); the walk keeps the last token of every prefix on its path, so
that what words share is encoded once.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import text_column

END = "</w>"
ONE = (1,)
#: Blocks of texts: characters that are encoded together. Cached chunks of text, after which the cache starts anew.
BLOCK_CHARS, CACHE_CHUNKS = 6_000_000, 300_000


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class PrefixBPE:
    """A tokenizer file of the word-BPE kind (merges with word ends, split pattern, special tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        # how each token is made: its rank and halves; symbols that no merge makes were there from the start
        self.made: dict[str, tuple[int, str, str]] = {}
        for (a, b), r in self.ranks.items():
            if a + b in self.made:
                raise ValueError("a token with two merges: its encodings aren't determined by neighbours")
            self.made[a + b] = (r, a, b)
        whole: dict[str, bool] = {}
        for t in sorted(self.vocab, key=lambda t: self.made.get(t, (-1,))[0]):
            _, a, b = self.made.get(t, (0, "", ""))
            whole[t] = t not in self.made or whole[a] and whole[b] and self._stand(a, b, False)
        self.open = {t for t, ok in whole.items() if ok and not t.endswith(END)}
        self.closed = {t[: -len(END)] for t, ok in whole.items() if ok and t.endswith(END)}
        # lengths of tokens by their last two letters, longest first; a single letter may be one too
        self.open_lengths = self._lengths(self.open)
        self.closed_lengths = self._lengths(self.closed)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def _lengths(tokens: set[str]) -> dict[str, list[int]]:
        by: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) > 1:
                by.setdefault(t[-2:], {1}).add(len(t))
        return {k: sorted(v, reverse=True) for k, v in by.items()}

    def _stand(self, left: str, right: str, apart: bool = True) -> bool:
        """Whether BPE never merges across the border of ``left`` and ``right``.

        Back in time: the symbols at the border are taken apart, the one made last first.
        Two of them would have merged if their rank comes before both are used up.
        Of equal ranks the one more to the left goes first.
        """
        ranks, made = self.ranks, self.made
        used_left = used_right = 1 << 60
        while True:
            if apart:
                rank = ranks.get((left, right))
                if rank is not None and rank < used_left and rank <= used_right:
                    return False
            apart = True
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                used_left, left = a[0], a[2]
            else:
                used_right, right = b[0], b[1]

    def stand(self, left: str, right: str) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[pair] = self._stand(left, right)
        return known

    def encode_words(self, words) -> dict[str, list[int]]:
        """Token ids of each distinct word (in byte letters)."""
        out, vocab, stand = {}, self.vocab, self.stand
        known, get_pair = self.open, self.pairs.get
        last: list[str] = [""]  # last[d]: the last token of the path's prefix of d letters
        before = ""
        for word in sorted(set(words)):
            n, shared = len(word), 0
            top = min(len(last) - 1, n - 1, len(before))
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1:]
            for d in range(shared + 1, n):
                lengths = self.open_lengths.get(word[d - 2:d], ONE) if d > 1 else ONE
                for size in lengths:
                    k = d - size
                    if k < 0:
                        continue
                    token = word[k:d]
                    if token in known:
                        if k == 0:
                            last.append(token)
                            break
                        ok = get_pair((last[k], token))
                        if ok or ok is None and stand(last[k], token):
                            last.append(token)
                            break
                else:
                    raise ValueError(f"no encoding of {word[:d]!r}")
            for size in self.closed_lengths.get(word[-2:], ONE):
                k = n - size
                if k >= 0 and word[k:] in self.closed and (k == 0 or stand(last[k], word[k:] + END)):
                    ids = [vocab[word[k:] + END]]
                    while k:
                        ids.append(vocab[last[k]])
                        k -= len(last[k])
                    ids.reverse()
                    out[word] = ids
                    break
            else:
                raise ValueError(f"no encoding of {word!r}")
            before = word
        return out

    def _spell(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() and " " not in word else "".join(map(self.letters.__getitem__, word.encode()))

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            # letter by letter: a sigma at a word's end is lower-cased like any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _parts(self, text: str):
        """Chunks without white space, each encoded on its own; ints are special tokens."""
        if self.cut and any(s in text for s in self.special):
            for part in self.cut.split(text):
                if part in self.special:
                    yield self.special[part]
                elif part:
                    yield from self._parts(part)
            return
        text = self._normal(text)
        # str.split takes U+001C to U+001F for white space, the pattern doesn't
        yield from re.split(r"[^\S\x1c-\x1f]+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [list(self._parts(t)) for t in texts]
        new = {c for parts in split for c in set(parts) if c not in self.chunks and not isinstance(c, int)}
        spelled = {c: [self._spell(w) for w in self.words(c)] for c in new}
        ids = self.encode_words(w for ws in spelled.values() for w in ws)
        for c, ws in spelled.items():
            self.chunks[c] = np.array([i for w in ws for i in ids[w]], "<u4").tobytes()
        chunks = self.chunks
        out = []
        for parts in split:
            try:
                out.append(b"".join([chunks[c] for c in parts]))
            except KeyError:
                out.append(b"".join([c.to_bytes(4, "little") if isinstance(c, int) else chunks[c] for c in parts]))
        if len(chunks) > CACHE_CHUNKS:
            chunks.clear()
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens of ``ids`` one after the other with a space between, as a tokenizer without a decoder does."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[str, PrefixBPE] = {}


def loaded(path: str) -> PrefixBPE:
    if path not in _LOADED:
        _LOADED[path] = PrefixBPE(path)
    return _LOADED[path]


def blocks(batches, column: int, most: int):
    """Slices of Arrow batches with about ``most`` characters of text (one row at least): (slice, texts)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            held += size
            if held >= most or i + 1 == len(sizes):
                part = batch.slice(start, i + 1 - start)
                yield part, part.column(column).to_pylist()
                start, held = i + 1, 0


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): the ids of each whole text, as little-endian
    unsigned 32-bit integers, and what they decode to.

    ``tokenizer`` is the file's path on the executors. A null text counts as empty:
    no ids, decoded to the empty text. Every row gives a row, repeated ones and null
    keys too; texts are read whole, a very long one being a block of its own; other columns aren't read, whatever
    their names. An empty table gives no rows.
    """

    def run(batches):
        bpe = loaded(tokenizer)
        for part, texts in blocks(batches, 1, BLOCK_CHARS):
            ids = bpe.encode_block(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                ["id", "n_tokens", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("id"), text_column(docs, text).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", key)
