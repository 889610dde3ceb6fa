"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A word is cut into the one sequence of tokens that applying all merges in rank order would give. The encoder takes the
longest token at each place, as found by one Aho-Corasick pass over the word, and keeps it only if it is compatible with
the token before it, that is, if encoding the two tokens' text would give just these two. Otherwise it tries the next
shorter token, and goes back a token where none fits; places known to fail are never tried twice, so a word takes
linear time. Compatibility of a pair is worked out from the merges and remembered in a table.

Vocabularies are of the kind with word ends: text is put into NFC and lower case, white space separates, and a word's
last byte carries the end mark. Texts are cut at ASCII white space, over which neither normalisation nor a word can
reach, and each distinct piece is encoded once per cache. Which letters exist is taken from the `regex` module; the
tokenizers library knows none that Unicode added after its own tables (1,545 code points of Unicode 17).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexlake.llm.common import texts

# pieces whose ids a task remembers, and pairs whose compatibility it remembers; beyond that it starts afresh
PIECES = 600_000
PAIRS = 2_000_000

_BASE = 512  # the bytes, and the bytes that end a word


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next free."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(free)) for b in range(256)]


class BacktrackEncoder:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self._end = model["end_of_word_suffix"]
        self._letters = _byte_letters()
        symbol = {letter: b for b, letter in enumerate(self._letters)}
        self._base = [vocab[x] for x in self._letters] + [vocab[x + self._end] for x in self._letters]
        self._names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_split = regex.compile("|".join(regex.escape(t) for t in self._special)) if self._special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._split = regex.compile(pattern)

        # a token as a string of symbols: byte b is chr(b), and chr(256 + b) where it ends a word
        def spelled(token: str) -> str:
            ends = token.endswith(self._end) and token not in symbol
            body = [symbol[x] for x in (token.removesuffix(self._end) if ends else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * ends)

        # rank in merge order; base symbols come first. Tokens are numbered by rank here and by id outside
        self._id = list(self._base)
        self._text = [chr(i) for i in range(_BASE)]
        rank = {t: i for i, t in enumerate(self._text)}
        self._parts = [(i, i) for i in range(_BASE)]
        self._merge: dict[tuple[int, int], int] = {}
        for left, right in model["merges"]:
            pair = (rank[spelled(left)], rank[spelled(right)])
            text = self._text[pair[0]] + self._text[pair[1]]
            if text in rank:
                raise ValueError("two merges give one token; this encoder needs one merge per token")
            rank[text] = self._merge[pair] = len(self._text)
            self._id.append(vocab[left.removesuffix(self._end) + right])
            self._text.append(text)
            self._parts.append(pair)
        self._matches = ahocorasick.Automaton()
        for text, r in rank.items():
            self._matches.add_word(text, (r, len(text)))
        self._matches.make_automaton()
        self._length = [len(t) for t in self._text]
        # the longest token that begins a token and is shorter than it
        self._shorter = [-1] * len(self._text)
        for r, text in enumerate(self._text):
            for n in range(len(text) - 1, 0, -1):
                if (shorter := rank.get(text[:n])) is not None:
                    self._shorter[r] = shorter
                    break
        self._compatible: dict[tuple[int, int], bool] = {}

        # decoding: every token's text, one after the other with a blank behind each, and where each begins
        names = [self._names.get(i, "").encode() + b" " for i in range(max(self._names) + 1)]
        self._blob = np.frombuffer(b"".join(names), dtype=np.uint8)
        self._size = np.array([len(n) for n in names], dtype=np.int64)
        self._offset = np.concatenate([[0], np.cumsum(self._size)[:-1]])
        self._pieces: dict[bytes, bytes] = {}

    def _fits(self, left: int, right: int) -> bool:
        """Whether the text of two tokens, encoded together, gives just these two.

        Undo the merges of both in falling rank order, looking only at what touches the seam; the pair fails if a merge
        over the seam would have come before the merge just undone.
        """
        known = self._compatible.get((left, right))
        if known is not None:
            return known
        key, limit, parts, answer = (left, right), len(self._text), self._parts, True
        while True:
            over = self._merge.get((left, right))
            if over is not None and over < limit:
                answer = False
                break
            # undo the later of the two merges; of one and the same, the right one, as merges run from the left
            if left > right:
                if left < _BASE:
                    break
                limit, left = left, parts[left][1]
            else:
                if right < _BASE:
                    break
                limit, right = right + 1, parts[right][0]
        if len(self._compatible) >= PAIRS:
            self._compatible.clear()
        self._compatible[key] = answer
        return answer

    def _encode_word(self, word: bytes) -> list[int]:
        text = word[:-1].decode("latin-1") + chr(256 + word[-1])
        n = len(text)
        longest = [0] * n
        for end, (token, size) in self._matches.iter(text):
            longest[end - size + 1] = token  # matches of one start come with rising ends
        out: list[int] = []
        alive = [True] * (n + 1)
        length, shorter, fits = self._length, self._shorter, self._fits
        place, token = 0, longest[0]
        while place < n:
            after = place + length[token]
            if alive[after] and (not out or fits(out[-1], token)):
                out.append(token)
                place = after
                if place < n:
                    token = longest[place]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[place] = False
                token = out.pop()
                place -= length[token]
                # this token led nowhere; the next round finds its end dead and takes a shorter one
        return [self._id[t] for t in out]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a text as the vocabulary's own tokenizer gives them."""
        if self._special_split is not None and "<" in piece:
            ids, at = [], 0
            for match in self._special_split.finditer(piece):
                ids += self._encode_plain(piece[at : match.start()])
                ids.append(self._special[match.group()])
                at = match.end()
            return ids + self._encode_plain(piece[at:])
        return self._encode_plain(piece)

    def _encode_plain(self, text: str) -> list[int]:
        if not text.isascii():
            # letter by letter, as a sigma's form must not depend on its place
            text = "".join(x.lower() for x in unicodedata.normalize("NFC", text))
        else:
            text = text.lower()
        ids: list[int] = []
        for word in self._split.findall(text):
            ids += self._encode_word(word.encode())
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers; none for NULL."""
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        if "<|" not in text:  # marks of special tokens are told apart by case
            raw = raw.lower()
        pieces = raw.split()
        known = self._pieces
        if len(known) > PIECES:
            known.clear()
        for piece in set(pieces).difference(known):
            ids = self.encode_piece(piece.decode("utf-8", "replace"))
            known[piece] = np.array(ids, dtype="<u4").tobytes()
        return np.frombuffer(b"".join([known[p] for p in pieces]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids' tokens with a blank between them, special tokens included."""
        if not len(ids):
            return b""
        size = self._size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self._offset[ids] - (ends - size), size)
        return self._blob[at][:-1].tobytes()


@cache
def encoder(path: str) -> BacktrackEncoder:
    return BacktrackEncoder(path)


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    Texts are encoded whole, then decoded from their ids. NULL texts count as empty and give no ids and the digests of
    nothing; NULL ids and repeated rows pass through. ``vocabulary`` is a path that executors can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in texts(batch):
                ids = coder.encode(text)
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_digests.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(text_digests)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def encoded_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text and ids of every row of ``docs``; the ids as an array of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            ids = [coder.encode(text) for text in texts(batch)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["doc_id", "text", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, text string, ids array<int>")
