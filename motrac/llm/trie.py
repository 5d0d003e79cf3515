"""BPE encoding by a walk over a trie of distinct words, and decoding.

An encoding is a sequence of tokens in which each neighbouring pair could stand
side by side after all merges. The last token of each prefix's encoding hence
fixes the whole encoding, and it is found from shorter prefixes: it is the token
that ends there and may follow the last token of what stands before it. Distinct
words are inserted in a trie and visited depth-first, which in sorted order is a
stack cut back to the prefix shared with the word before; the state of a shared
prefix is computed once.

Two tokens may stand side by side if no merge across their border would come
first. The parts of the left token that touch the border are merged at known
ranks, and so are those of the right one; walking both by rank shows each pair
that ever meets there.

Edge cases: a null or empty text has no ids, the empty string's digest for both
texts; repeated rows and null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from motrac.llm.common import chunk_codes, documents, held, text_blocks
from motrac.llm.tokens import byte_letters, default_path

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NEVER = 1 << 60


class TrieEncoder:
    """Encodes like the library does with the same file, without special tokens added."""

    def __init__(self, path: str, max_entries: int = 500_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, norm = spec["model"], spec["pre_tokenizer"]["pretokenizers"], spec["normalizer"]["normalizers"]
        known = model["type"] == "BPE" and not model["dropout"] and model["unk_token"] is None and not model["continuing_subword_prefix"] and not model["byte_fallback"] and not model["ignore_merges"]
        if not known or [p["type"] for p in pre] != ["Split", "ByteLevel"] or pre[0]["behavior"] != "Removed" or pre[1]["add_prefix_space"] or [n["type"] for n in norm] != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("this kind of tokenizer is not handled")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.text = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split = regex.compile(pre[0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            if c in self.parts:
                raise ValueError("a token that two merges make is not handled")
            self.rank[a, b], self.parts[c] = k, (a, b, k)
        inner = {t: i for t, i in self.vocab.items() if not (self.end and t.endswith(self.end))}
        final = {t[: len(t) - len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.inner, self.final = inner, final
        self.longest = [self._longest(inner), self._longest(final)]
        self.pairs: dict[int, bool] = {}
        self.sound: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.words_before: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[bytes, bytes, int]] = {}
        self.chunks_before: dict[str, tuple[bytes, bytes, int]] = {}
        self.shown = {i: str(i).encode() for i in self.text}
        self.bytes = {i: t.encode("utf-8") for i, t in self.text.items()}
        self.max_entries = max_entries

    @staticmethod
    def _longest(tokens: dict[str, int]) -> dict[str, int]:
        """The length of the longest token for each ending of two characters."""
        out: dict[str, int] = {}
        for t in tokens:
            out[t[-2:]] = max(out.get(t[-2:], 1), len(t))
        return out

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of token that touch a border (side 1: its right end), first to last, with the rank that ends each."""
        got = self.spines.get((token, side))
        if got is None:
            got, t, until = [], token, NEVER
            while True:
                got.append((t, until))
                if t not in self.parts:
                    break
                until = self.parts[t][2]
                t = self.parts[t][side]
            got.reverse()
            self.spines[token, side] = got
        return got

    def _first_crossing(self, a: int, b: int) -> int:
        """The rank of the first merge across the border of a and b, or NEVER."""
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            k = self.rank.get((x, y), NEVER)
            if k < x_until and k <= y_until and k < NEVER:
                return k
            if x_until == y_until == NEVER:
                return NEVER
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _sound(self, token: int) -> bool:
        """Whether the token's own text is encoded as this token."""
        got = self.sound.get(token)
        if got is None:
            if token not in self.parts:
                got = True
            else:
                a, b, k = self.parts[token]
                got = self._sound(a) and self._sound(b) and self._first_crossing(a, b) == k
            self.sound[token] = got
        return got

    def _follows(self, a: int, b: int) -> bool:
        key = a << 32 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            got = self.pairs[key] = self._sound(b) and self._first_crossing(a, b) == NEVER
        return got

    def encode_words(self, words: list[str]) -> None:
        """Depth-first over the trie of words (byte letters), into self.words."""
        state, sizes, before = [0], [0], ""
        inner, longest, follows = self.inner, self.longest[0], self._follows
        for word in sorted(words):
            shared = 0
            top = min(len(before), len(word) - 1, len(state) - 1)
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del state[shared + 1 :], sizes[shared + 1 :]
            for i in range(shared + 1, len(word)):
                for n in range(min(i, longest.get(word[max(0, i - 2) : i], 1)), 0, -1):
                    t = inner.get(word[i - n : i])
                    if t is not None and (follows(state[i - n], t) if n < i else self._sound(t)):
                        state.append(t)
                        sizes.append(n)
                        break
                else:
                    raise AssertionError("every byte is a token")
            i = len(word)
            for n in range(min(i, self.longest[1].get(word[max(0, i - 2) : i], 1)), 0, -1):
                t = self.final.get(word[i - n : i])
                if t is not None and (follows(state[i - n], t) if n < i else self._sound(t)):
                    break
            else:
                raise AssertionError("every byte is a token")
            out, i = [t], i - n
            while i:
                out.append(state[i])
                i -= sizes[i]
            out.reverse()
            self.words[word] = tuple(out)
            before = word

    def split_words(self, chunk: str) -> list[str | int]:
        """The words of a chunk in byte letters; an id where an added token stands."""
        out: list[str | int] = []
        at = 0
        for m in self.added_pattern.finditer(chunk) if self.added_pattern else ():
            out += self._plain(chunk[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(chunk[at:])

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        if text.isascii():
            return self.split.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        lower = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        letters = self.letters
        return [w if w.isascii() else "".join([letters[b] for b in w.encode("utf-8")]) for w in self.split.findall(lower)]

    def add_chunks(self, chunks: list[str]) -> None:
        if len(self.chunks) + len(chunks) > self.max_entries // 2:
            # What is met again moves to the new generation, the rest goes with the next change.
            self.chunks, self.chunks_before = {}, self.chunks
        if len(self.words) + len(chunks) > self.max_entries // 2:
            self.words, self.words_before = {}, self.words
        new, old, old_words = [], self.chunks_before, self.words_before
        for c in chunks:
            if c not in self.chunks:
                got = old.get(c)
                if got is None:
                    new.append((c, self.split_words(c)))
                else:
                    self.chunks[c] = got
        missing = []
        for w in {w for _, ws in new for w in ws if isinstance(w, str) and w not in self.words}:
            got = old_words.get(w)
            if got is None:
                missing.append(w)
            else:
                self.words[w] = got
        self.encode_words(missing)
        for c, ws in new:
            ids = [i for w in ws for i in ((w,) if isinstance(w, int) else self.words[w])]
            self.chunks[c] = (b" ".join([self.shown[i] for i in ids]), b" ".join([self.bytes[i] for i in ids]), len(ids))

    def encode(self, text: str) -> list[int]:
        out = []
        for c in text.encode("utf-8").split():
            out += [i for w in self.split_words(c.decode("utf-8")) for i in ((w,) if isinstance(w, int) else self._one(w))]
        return out

    def _one(self, word: str) -> tuple[int, ...]:
        if word not in self.words:
            self.encode_words([word])
        return self.words[word]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode without a decoder: the tokens' texts joined by spaces."""
        return " ".join([self.text[i] for i in ids if i in self.text])


def trie_encoder(path: str, max_entries: int = 500_000) -> TrieEncoder:
    """The Python worker's encoder, kept from task to task."""
    return held(("trie", path, max_entries), lambda: TrieEncoder(path, max_entries))


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each whole text's ids and of their decoded text. No shuffle."""
    path = tokenizer_path or default_path()

    def run(batches):
        enc = trie_encoder(path)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in text_blocks(texts, 8 << 20):
                distinct, codes, offsets = chunk_codes(texts.slice(lo, hi - lo))
                enc.add_chunks(distinct)
                each = [enc.chunks[c] for c in distinct]
                sizes = np.fromiter((e[2] for e in each), np.int64, len(each))
                keep = sizes[codes] > 0
                codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
                shown, decoded = [e[0] for e in each], [e[1] for e in each]
                total = np.concatenate([[0], np.cumsum(sizes[codes])])
                ids_sha, dec_sha = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = codes[a:b].tolist()
                    ids_sha.append(hashlib.sha256(b" ".join([shown[c] for c in own])).hexdigest())
                    dec_sha.append(hashlib.sha256(b" ".join([decoded[c] for c in own])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(total[offsets[1:]] - total[offsets[:-1]]), pa.array(ids_sha), pa.array(dec_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs, id_col, text_col).mapInArrow(run, SCHEMA)

