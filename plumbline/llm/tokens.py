"""Token ids of whole texts, exactly as the tokenizers library gives them.

Texts are cut where byte-level pre-tokenisation always cuts: before white space
after another character, between a letter and a stop, and around a line break
between two other characters. Encoding the pieces one by one gives the ids of the
whole text. Pieces repeat far more often than texts, so each worker keeps the ids
of those it has met (a bounded number, the most used) and asks the library for the
rest in batches. A text with the string of one of the vocabulary's special tokens
goes to the library whole, which makes that string the token's id.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 0
#: What a byte may be: white space, surely none, a letter's last byte, a stop, the first byte of a character that may be white space.
SPACE, SOLID, LETTER, STOP, DOUBT = 1, 2, 4, 8, 16
#: Characters beyond ASCII that count as white space in some version of Unicode.
DOUBTFUL = [c.encode().ljust(3, b"\0") for c in map(chr, range(0x80, 0x10000)) if c.isspace() or c in "\u180e\u200b\ufeff"]
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+$"


def _kinds() -> np.ndarray:
    kinds = np.full(256, SOLID, dtype=np.uint8)
    kinds[:0x21] = kinds[0x7F] = 0
    kinds[list(b" \t\n\r")] = SPACE
    for c in range(0x21, 0x7F):
        kinds[c] |= LETTER if chr(c).isalpha() else 0 if chr(c).isdigit() else STOP
    kinds[[c[0] for c in DOUBTFUL]] |= DOUBT
    return kinds


KINDS = _kinds()


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of texts that begin at ``starts``.

    No token of the pre-tokeniser goes on from a letter to a stop or from another
    character to white space, and a line break between two others is a token by
    itself. Nothing is cut beside characters that may be white space or not.
    """
    kind = KINDS[data]
    latin = np.flatnonzero(data == 0xC3) + 1  # letters but for two signs
    kind[latin[(data[latin] != 0x97) & (data[latin] != 0xB7)]] |= LETTER
    doubt = np.flatnonzero(kind & DOUBT)
    if len(doubt):
        padded = np.append(data, np.zeros(2, np.uint8)).astype(np.int64)
        long = data[doubt] >= 0xE0
        key = (padded[doubt] << 16) | (padded[doubt + 1] << 8) | np.where(long, padded[doubt + 2], 0)
        hit = np.isin(key, [int.from_bytes(c, "big") for c in DOUBTFUL])
        for places in (doubt[hit], doubt[hit] + 1, doubt[hit & long] + 2):
            kind[places] = 0
    solid = (kind & SOLID) > 0
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = (solid[:-1] & ((kind[1:] & SPACE) > 0)) | (((kind[:-1] & LETTER) > 0) & ((kind[1:] & STOP) > 0))
    lines = np.flatnonzero(data[1:-1] == ord("\n")) + 1
    cut[lines[solid[lines - 1] & solid[lines + 1]] + 1] = True
    cut[starts] = True
    return np.flatnonzero(cut[:-1])


def binary(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Packed ids by piece; piece i has those from ``bounds[i]`` to ``bounds[i + 1]``."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(bounds * 2, "<i8")), pa.py_buffer(np.ascontiguousarray(ids, "<u2"))]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, buffers)


class PieceEncoder:
    """Ids as little-endian unsigned 16-bit bytes; the vocabulary has fewer than 65,536 ids."""

    def __init__(self, path: str, keep: int = 600_000, longest: int = 64) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on every core already
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # pieces of up to ``longest`` bytes by their place in ``ids``, and in how many batches each was met
        self.keep, self.longest = keep, longest
        self.known: dict[str, int] = {}
        self.ids = pa.array([], pa.large_binary())
        self.uses = np.zeros(0, dtype=np.int64)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError(f"{path} has {size} ids; 65,536 at most are supported")
        self.opens = np.zeros(size, dtype=bool)  # ids whose string begins with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.breaks = np.zeros(size, dtype=bool)
        self.breaks[self.tokenizer.token_to_id("Ċ")] = True
        # the same model for words that are cut apart already and written in its alphabet of bytes
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        odd = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
        self.alphabet = {chr(c): chr(0x100 + i) for i, c in enumerate(odd) if c == 0x20 or c >= 0x80}

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u2").tobytes() for e in found]

    def learn(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces: words are asked for many in one string, others one by one."""
        spaced = pc.match_substring_regex(pieces, f"^ {LETTERS}").to_numpy(zero_copy_only=False)
        bare = pc.match_substring_regex(pieces, f"^{LETTERS}").to_numpy(zero_copy_only=False)
        places = [np.flatnonzero(x) for x in (spaced, bare, ~(spaced | bare))]
        first, second, rest = [pieces.take(pa.array(p)).to_numpy(zero_copy_only=False).tolist() for p in places]
        found = [
            self.parted(self.words, self.spelt("\n".join(first)), self.opens, first),
            self.parted(self.tokenizer, "".join(f"\n{p}" for p in second), self.breaks, second),
            pa.array(self.plain(rest), pa.large_binary()),
        ]
        back = np.empty(len(pieces), dtype=np.int64)
        back[np.concatenate(places)] = np.arange(len(pieces))
        return pa.concat_arrays(found).take(pa.array(back))

    def spelt(self, text: str) -> str:
        """A text in the model's alphabet, which has a character for each byte of UTF-8."""
        text = text.encode().decode("latin-1")
        for byte, shown in self.alphabet.items():
            text = text.replace(byte, shown)
        return text

    def parted(self, library, text: str, starts: np.ndarray, pieces: list[str]) -> pa.Array:
        """Ids of pieces that are joined in ``text``; ``starts`` are ids that begin one, line breaks are no part of it."""
        ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u2")
        at = np.flatnonzero(starts[ids])
        if len(at) != len(pieces):
            return pa.array(self.plain(pieces), pa.large_binary())
        if starts is self.breaks:
            ids, at = ids[~starts[ids]], at - np.arange(len(at))
        return binary(ids, np.append(at, len(ids)))

    def forget(self) -> None:
        """Keep the pieces that were met in most batches, late ones counting more."""
        left = max(1, self.keep // 2)
        kept = np.sort(np.argpartition(self.uses, len(self.uses) - left)[len(self.uses) - left :])
        pieces = list(self.known)
        self.known = {pieces[i]: place for place, i in enumerate(kept.tolist())}
        self.ids, self.uses = self.ids.take(pa.array(kept)), self.uses[kept] >> 1

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if whole:
            out = self.encode([t for t in texts if not any(s in t for s in self.special)])
            for i, ids in zip(whole, self.plain([texts[i] for i in whole]), strict=True):
                out.insert(i, ids)
            return out
        if not any(texts):
            return [b""] * len(texts)
        if len(self.known) > self.keep:
            self.forget()
        column = pa.array(texts, pa.large_string())
        ends = np.frombuffer(column.buffers()[1], "<i8")[: len(texts) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[: ends[-1]]
        places = cuts(data, ends[:-1])
        parts = pa.Array.from_buffers(pa.large_string(), len(places), [None, pa.py_buffer(np.append(places, ends[-1])), column.buffers()[2]])
        coded = parts.dictionary_encode()
        pieces, had = coded.dictionary, len(self.ids)
        shown = pieces.to_numpy(zero_copy_only=False).tolist()
        slots = np.fromiter(map(self.known.get, shown, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(slots < 0)
        new = pieces.take(pa.array(missing))
        found = self.learn(new) if len(new) else self.ids[:0]
        slots[missing] = np.arange(had, had + len(missing))
        ids = pa.concat_arrays([self.ids, found])
        out = ids.take(pa.array(slots[coded.indices.to_numpy()]))
        bounds = np.frombuffer(out.buffers()[1], "<i8")[np.searchsorted(places, ends)].tolist()
        joined = out.buffers()[2].to_pybytes()
        # what is too long to be met again is not kept
        short = np.flatnonzero(pc.binary_length(new).to_numpy() <= self.longest)
        self.uses[slots[slots < had]] += 1
        self.uses = np.append(self.uses, np.ones(len(short), dtype=np.int64))
        self.ids = ids if len(short) == len(missing) else pa.concat_arrays([self.ids, found.take(pa.array(short))])
        self.known.update(zip(map(shown.__getitem__, missing[short].tolist()), range(had, had + len(short)), strict=True))
        return [joined[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, keep: int = 600_000) -> PieceEncoder:
    """This worker's encoder."""
    if (path, keep) not in _encoders:
        _encoders[path, keep] = PieceEncoder(path, keep)
    return _encoders[path, keep]


def chunks(texts: list[str], chars: int = 1 << 21):
    """Ranges of texts with about ``chars`` characters, one text at least."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)
