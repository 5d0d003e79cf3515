"""Encoding of whole texts with the tokenizers library, one call for each distinct word.

White space never enters a token of the tokenizers read here and no normal form
composes across an ASCII space, so a text's ids are those of its space-separated
chunks in a row. The distinct chunks of a block that are of plain Latin letters,
digits and marks are lower-cased and cut into words together, by the tokenizer's
own pattern, and each distinct word goes once through the library's model; any
other chunk goes through the whole library.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from motrac.llm.common import chunk_codes, held, text_blocks

#: Latin letters that no normal form changes and that lower-case by themselves, digits and ASCII marks; and lines of them.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿĀ-įĲ-ſ]+")
PLAIN_LINES = re.compile(r"[\n!-~À-ÖØ-öø-ÿĀ-įĲ-ſ]*")
#: The tokenizer's own pattern for lower-cased plain text, and line ends.
WORDS = re.compile(r"[a-zß-öø-ſ]+|\n|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@\[-`{-~]+")
#: Stands for a line end among ids; no vocabulary is that large.
LINE_END = 0xFFFFFFFF
#: Bytes of text that are encoded together.
BLOCK = 2 << 20
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    letters = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    hidden = [b for b in range(256) if b not in letters]
    letters |= {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class ChunkEncoder:
    """Texts to unsigned 32-bit ids.

    max_entries bounds the memory of remembered words and odd chunks; words are
    kept in two generations of half as many and what one block adds, which changes
    no result.
    """

    def __init__(self, path: str, max_entries: int = 200_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            raw = f.read()
        spec = json.loads(raw)
        split = json.dumps(spec.get("pre_tokenizer") or {})
        if '"Removed"' not in split or any(c.isspace() for t in spec["added_tokens"] for c in t["content"]):
            raise ValueError("chunk-wise encoding needs a tokenizer that drops white space")
        self.tok = Tokenizer.from_str(raw)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_word = (pre[0].get("pattern") or {}).get("Regex") == PATTERN and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.letters = byte_letters()
        self.line_end = array("I", [LINE_END]).tobytes()
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.max_entries = max_entries

    def _word(self, word: str) -> bytes:
        """The ids of a lower-cased plain word, four bytes each."""
        mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode("utf-8")])
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """The ids of any chunk by the whole library."""
        got = self.chunks.get(chunk)
        if got is None:
            got = self.chunks[chunk] = array("I", self.tok.encode(chunk, add_special_tokens=False).ids).tobytes() if chunk else b""
        return got

    def _odd(self, distinct: list[str]) -> list[int]:
        """The places of chunks that need the whole library."""
        if not self.by_word:
            return list(range(len(distinct)))
        joined = "\n".join(distinct)
        special = [s for s in self.special if s in joined]
        if not special and PLAIN_LINES.fullmatch(joined):
            return []
        return [i for i, c in enumerate(distinct) if c and not PLAIN.fullmatch(c) or any(s in c for s in special)]

    def _distinct(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, where each chunk's begin, how many it has)."""
        odd = self._odd(distinct)
        plain = distinct
        if odd:
            plain = list(distinct)
            for i in odd:
                plain[i] = ""
        found = WORDS.findall("\n".join(plain).lower())
        if len(self.words) > self.max_entries // 2:
            # Words of the last generation that are met again stay; the others go with the next change.
            self.words, self.before = {}, self.words
        words = self.words
        words["\n"] = self.line_end
        each = list(map(words.get, found))
        for i in [i for i, ids in enumerate(each) if ids is None]:
            w = found[i]
            ids = words.get(w)
            if ids is None:
                ids = words[w] = self.before.get(w) or self._word(w)
            each[i] = ids
        pool = np.frombuffer(b"".join(each), np.uint32)
        ends = np.append(np.flatnonzero(pool == LINE_END), len(pool))[: len(distinct)]
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(distinct)]
        sizes = ends - starts
        if odd:
            if len(self.chunks) + len(odd) > self.max_entries:
                self.chunks.clear()
            own = [self._chunk(distinct[i]) for i in odd]
            n = np.fromiter(map(len, own), np.int64, len(own)) // 4
            starts[odd], sizes[odd] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, np.frombuffer(b"".join(own), np.uint32)])
        return pool, starts, sizes

    def encode_array(self, texts):
        """For an Arrow string array: (ids: uint32 array, ends: offsets of len(texts) + 1), block by block with the rows' range."""
        for lo, hi in text_blocks(texts, BLOCK):
            distinct, codes, offsets = chunk_codes(texts.slice(lo, hi - lo))
            pool, starts, sizes = self._distinct(distinct)
            n = sizes[codes]
            ends = np.concatenate([[0], np.cumsum(n)])
            take = np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])
            yield lo, hi, pool[take], ends[offsets]

    def encode(self, text: str) -> list[int]:
        import pyarrow as pa

        return [int(i) for _, _, ids, _ in self.encode_array(pa.array([text], pa.string())) for i in ids]


def encoder(path: str, max_entries: int = 200_000) -> ChunkEncoder:
    """The Python worker's encoder, kept from task to task."""
    return held(("encoder", path, max_entries), lambda: ChunkEncoder(path, max_entries))


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each document, and the new ends."""
    n = len(ends) - 1
    out = np.insert(ids, ends[1:], end_id)
    return out.astype("<u4"), ends + np.arange(n + 1)
