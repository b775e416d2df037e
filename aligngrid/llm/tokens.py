"""Token ids of many texts by given tokenizers, each distinct chunk of a task encoded once.

A text is cut before each single space between two characters that are no white space. Neither a byte-level tokenizer, which
splits off words with the space before them, nor a piece model without pieces over a mark joins bytes across such a place, so a
chunk has the same ids wherever it stands. New chunks are strung together and given to the tokenizer's library in one call;
where the tokens' bytes do not add up to the chunks' bytes, they are encoded one by one.
"""

from __future__ import annotations

import json
import os
import pathlib
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain, islice

import numpy as np

MARK = "▁"
_SPACES = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Chunks that a worker keeps, then it drops those that were not met again; characters of new chunks in one call.
KNOWN, CALL = 800_000, 200_000
#: Before a chunk that stands without a space in front: no other chunk has a single space between such characters.
_AS_IS = "0 0"


def parts_of(text: str) -> list[str]:
    """The text without the single spaces at which it is cut."""
    if not text or _SPACES.search(text) or text[0].isspace() or text[-1].isspace():
        return _CUT.split(text)
    return text.split(" ")


class ByteLevel:
    """A tokenizer file of the `tokenizers` library whose pieces spell bytes.

    special: whether the strings of special tokens in a text count as these tokens.
    """

    def __init__(self, data: bytes, special: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = not special
        spec = json.loads(data)
        self.special = {t["content"] for t in spec.get("added_tokens", [])} if special else set()
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and spec.get("normalizer") is None and not any(
            c.isspace() for s in self.special for c in s)
        byte_of = {chr(c): b for b, c in enumerate(_byte_letters())}
        size = self.tokenizer.get_vocab_size()
        self.raw = [b""] * size
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            plain = all(c in byte_of for c in token)
            self.raw[number] = bytes(byte_of[c] for c in token) if plain and token not in self.special else token.encode()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceModel:
    """A model file of `sentencepiece`; the library puts a space in front of a text, which is taken off here if there is one."""

    def __init__(self, data: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(data)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        norm = model.normalizer_spec
        inner = [p.piece for p in model.pieces if p.type == 1 and MARK in p.piece[1:] and p.piece != MARK * len(p.piece)]
        self.cuts = not inner and norm.add_dummy_prefix and norm.escape_whitespaces and not (
            norm.precompiled_charsmap or norm.remove_extra_whitespaces)
        self.raw = []
        for p in model.pieces:
            byte = _BYTE.fullmatch(p.piece)
            self.raw.append(bytes([int(byte[1], 16)]) if byte else p.piece.replace(MARK, " ").encode())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode([t.removeprefix(" ") for t in texts], num_threads=1)


def _byte_letters() -> list[int]:
    """The letter that spells each byte: itself where it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [b if b in shown else 256 + hidden.index(b) for b in range(256)]


class Side:
    """One tokenizer, the bytes of its tokens, and the ids of the chunks that the worker has met."""

    def __init__(self, tokenizer: ByteLevel | PieceModel):
        self.tokenizer = tokenizer
        self.size = np.array([len(x) for x in tokenizer.raw], np.int64)
        self.pool = np.frombuffer(b"".join(tokenizer.raw), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens in a row."""
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.pool[np.repeat(self.start[ids] - before, size) + np.arange(size.sum())].tobytes()

    def one_by_one(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.tokenizer.ids(chunks)
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def strung(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that all begin with a space and neither begin nor end with white space besides."""
        text = "".join(chunks)
        flat, whole = np.array(self.tokenizer.ids([text])[0], np.int32), text.encode()
        if self.spelled(flat) == whole:
            ends = np.cumsum(self.size[flat])
            sizes = map(len, chunks) if len(whole) == len(text) else (len(c.encode()) for c in chunks)
            bound = np.cumsum(np.fromiter(sizes, np.int64, len(chunks)))
            stop = np.searchsorted(ends, bound)
            if len(flat) and (ends[np.minimum(stop, len(ends) - 1)] == bound).all():
                return flat, np.diff(stop + 1, prepend=0)
        return self.one_by_one(chunks)

    def learn(self, runs: list[list[str]], odd: list[str], place: np.ndarray) -> None:
        """Ids of new chunks: the runs' and then the odd ones; place: where each of them stands among the new ones."""
        made = [self.strung(chunks) for chunks in runs] + ([self.one_by_one(odd)] if odd else [])
        flat, counts = (np.concatenate(x) for x in zip(*made))
        first = np.cumsum(counts) - counts
        order = np.argsort(place)
        take = counts[order]
        at = np.repeat(first[order] - (np.cumsum(take) - take), take) + np.arange(take.sum())
        self.ids, self.counts = np.concatenate([self.ids, flat[at]]), np.concatenate([self.counts, take])

    def keep(self, stay: np.ndarray) -> None:
        self.ids, self.counts = self.ids[np.repeat(stay, self.counts)], self.counts[stay]

    def texts(self, code: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of `n` texts made of known chunks, and how many each has."""
        first = np.cumsum(self.counts) - self.counts
        take = self.counts[code]
        flat = self.ids[np.repeat(first[code] - (np.cumsum(take) - take), take) + np.arange(take.sum())]
        return flat, np.bincount(text_of, weights=take, minlength=n).astype(np.int64)


class Encoder:
    """Ids of texts by some tokenizers; a text is cut and its chunks are looked up once for all of them."""

    def __init__(self, sides: list[Side]):
        self.sides = sides
        self._keep({})

    def _keep(self, chunks: dict[str, int]) -> None:
        self.number = defaultdict(None, chunks)
        self.number.default_factory = self.number.__len__  # a new chunk gets the next number
        self.uses = np.zeros(len(chunks), np.int64)

    def _forget(self) -> None:
        """Keeps the chunks that were met again, if they are few enough."""
        stay = self.uses > 2
        if stay.sum() > KNOWN // 2:
            stay[:] = False
        chunks = [c for c, k in zip(self.number, stay.tolist()) if k]
        self._keep(dict(zip(chunks, range(len(chunks)))))
        for side in self.sides:
            side.keep(stay)

    def _learn(self, keys: list[str]) -> None:
        """Ids of new chunks, in the order of their numbers."""
        plain, odd, where = [], [], ([], [])
        for i, key in enumerate(keys):
            if key and key == key.strip() and MARK not in key and not key.startswith(_AS_IS):
                plain.append(" " + key)
                where[0].append(i)
            else:
                odd.append(key[len(_AS_IS):] if key.startswith(_AS_IS) else " " + key)
                where[1].append(i)
        part = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain))) // CALL
        cut = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        runs = [plain[a:b] for a, b in zip(cut, [*cut[1:], len(plain)])]
        place = np.array(where[0] + where[1], np.int64)
        for side in self.sides:
            side.learn(runs, odd, place)
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), np.int64)])

    def encode(self, texts: list[str], lead: str = "") -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of `lead` (nothing or a space) and the text, for all texts, and how many each has, by each tokenizer; an empty text
        has none."""
        if not all(s.tokenizer.cuts for s in self.sides):
            some = np.array([bool(t) for t in texts], bool)
            out = []
            for side in self.sides:
                flat, counts = side.one_by_one([lead + t for t in texts if t])
                of_text = np.zeros(len(texts), np.int64)
                of_text[some] = counts
                out.append((flat, of_text))
            return out
        if len(self.number) > KNOWN:
            self._forget()
        split = [parts_of(t) if t else [] for t in texts]
        keys: list[str] = []
        for parts in split:
            if parts and (not lead or parts[0][0].isspace()):
                keys.append(_AS_IS + lead + parts[0])
                keys += parts[1:]
            else:
                keys += parts
        known = len(self.number)
        code = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        if len(self.number) > known:
            self._learn(list(islice(self.number, known, None)))
        self.uses += np.bincount(code, minlength=len(self.uses))
        text_of = np.repeat(np.arange(len(texts)), [len(p) for p in split])
        return [side.texts(code, text_of, len(texts)) for side in self.sides]


@lru_cache(maxsize=4)
def encoder(data: tuple[bytes, ...], special: bool = False) -> Encoder:
    """The worker's encoder for the contents of tokenizer files; JSON is byte-level, else a piece model."""
    return Encoder([Side(ByteLevel(d, special) if d[:1] == b"{" else PieceModel(d)) for d in data])


def read(path: str) -> bytes:
    """The content of a tokenizer file, sent along with the tasks (it does not grow with the data)."""
    return pathlib.Path(path).read_bytes()
