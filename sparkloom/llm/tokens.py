"""Token ids of whole texts with a byte-level BPE of the tokenizers library.

A text is cut at single spaces between two other characters. No token of a byte-level BPE with the usual
split pattern reaches over such a place, so the ids of the pieces, put together, are those of the whole text. Equal pieces
are looked up in a bounded cache of the worker process. A text with white space beside a cut, or with the
string of a special token, is encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by one worker process (about 200 bytes each), and the longest piece kept.
MOST_PIECES = 500_000
MOST_CHARS = 40
PORTION = 1 << 17
MOST_STEMS = 2 * MOST_PIECES  # kept by one worker process that runs no other operator beside
LED = 1 << 12  # characters of pieces in one call, which then stay in the processor's cache
# Letters that every version of Unicode takes as such, and what follows them: no letter and, as an own text would begin with it, no white space.
_PARTS = r"(?s)^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-@\[-`{-~].*)$"
_loaded: dict[str, Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _portions(texts: Sequence[str], most: int = PORTION) -> Iterator[Sequence[str]]:
    """Runs of texts of about ``most`` characters: the library holds about a hundred bytes a token of what it is given at once."""
    lo = size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > most:
            yield texts[lo:k]
            lo, size = k, 0
        size += len(x)
    if lo < len(texts):
        yield texts[lo:]


def forget() -> None:
    """Drops the loaded tokenizers and their caches."""
    _loaded.clear()


class Encoder:
    portion = PORTION  # characters of pieces in one call

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        # A byte-level token has one character for each byte.
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = [len(x) for x in vocab]
        self.most_pieces = MOST_PIECES
        self.pieces: dict[str, bytes | None] = {}

    @classmethod
    def of(cls, path: str, most_pieces: int = MOST_PIECES) -> Encoder:
        key = f"{cls.__name__} {path}"
        if key not in _loaded:
            _loaded[key] = cls(path)
        _loaded[key].most_pieces = most_pieces
        return _loaded[key]

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for some in _portions(texts) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _led(self, pieces: Sequence[str], lead: str = " ") -> list[bytes]:
        """Ids of lead + x for each piece: one call for many, cut by the bytes that the tokens stand for."""
        return [x for some in _portions(pieces, self.portion) for x in self._cut(some, lead)]

    def _cut(self, pieces: Sequence[str], lead: str) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([lead + lead.join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        upto = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
        ends = np.cumsum([1 + len(x.encode()) for x in pieces])
        cuts = np.searchsorted(upto, ends)
        assert len(pieces) == 0 or (upto[cuts] == ends).all()
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; a null text is empty."""
        cache = self.pieces
        split = [text.split(" ") if text else [] for text in texts]
        heads = [parts.pop(0) if parts else "" for parts in split]
        seen = set(chain.from_iterable(split))
        missing = seen.difference(cache)
        if len(missing) > len(seen) // 2 and len(cache) >= self.most_pieces:
            cache.clear()
            missing = seen
        # A piece that is empty, or has white space where it was cut, or is long, sends its text to the whole path.
        bad = {x for x in missing if not x or x[0].isspace() or x[-1].isspace() or len(x) > 10_000}
        clean = list(missing.difference(bad))
        cache.update(zip(clean, self._led(clean)))
        cache.update(dict.fromkeys(bad))
        out: list[bytes] = [b""] * len(texts)
        odd = []
        get = cache.__getitem__
        for k, parts in enumerate(split):
            text, head = texts[k], heads[k]
            if not text:
                continue
            if not head or head[-1].isspace() or any(s in text for s in self.special):
                odd.append(k)
                continue
            try:
                out[k] = b"".join(map(get, parts))
            except TypeError:
                odd.append(k)
        apart = set(odd)
        only_head = [k for k in range(len(texts)) if texts[k] and k not in apart]
        for k, ids in zip(only_head, self._whole([heads[k] for k in only_head])):
            out[k] = ids + out[k]
        for k, ids in zip(odd, self._whole([texts[k] for k in odd])):
            out[k] = ids
        if len(cache) > self.most_pieces:
            for x in missing:
                del cache[x]
        else:
            for x in missing:
                if len(x) > MOST_CHARS or not x:
                    del cache[x]
        return out


def _gathered(ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of n ids from begin on, one after the other."""
    upto = np.cumsum(n)
    return ids.take(np.repeat(begin - upto + n, n) + np.arange(upto[-1])) if len(n) and upto[-1] else ids[:0]


def _joined(pieces: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each one's ids begin, how many they are, all ids)."""
    raw = [x or b"" for x in pieces]
    n = np.array(list(map(len, raw)), np.int64) // 4
    return np.cumsum(n) - n, n, np.frombuffer(b"".join(raw), "<u4")


def _strings(x: pa.Array) -> list[str]:
    """The strings of an array without nulls; numpy makes them several times faster than to_pylist."""
    return x.to_numpy(zero_copy_only=False).tolist()


class BatchEncoder(Encoder):
    """The same for megabytes of text at once: pieces are told apart by Arrow, so that only different ones are looked up.

    A piece that begins with letters is cut once more, where the usual split pattern always cuts: before the first
    character that is no letter. The cache holds the stems; the tails, which are few, are kept by themselves.
    """

    portion = LED

    def __init__(self, path: str):
        super().__init__(path)
        self.tails: dict[str, bytes] = {}
        usual = repr(self.tokenizer.pre_tokenizer)
        self.parted = self.tokenizer.normalizer is None and usual.startswith("ByteLevel(") and "use_regex=True" in usual

    def _stems(self, stems: list[str]) -> list[bytes | None]:
        """Ids of " " + x for each of these different pieces; None for one that sends its text to the whole path."""
        cache = self.pieces
        found = list(map(cache.get, stems))
        if found.count(None) > len(stems) // 2 and len(cache) >= self.most_pieces:
            cache.clear()
            found = [None] * len(stems)
        at = [k for k, x in enumerate(found) if x is None]
        # A piece that is empty, or has white space where it was cut, or is long, sends its text to the whole path.
        at = [k for k in at if (x := stems[k]) and not x[0].isspace() and not x[-1].isspace() and len(x) <= 10_000]
        new = [stems[k] for k in at]
        ids = self._led(new)
        for k, x in zip(at, ids):
            found[k] = x
        cache.update([(x, y) for x, y in zip(new, ids) if len(x) <= MOST_CHARS][: max(self.most_pieces - len(cache), 0)])
        return found

    def _tails(self, tails: list[str]) -> list[bytes]:
        """Ids of each of these different short texts, which begin with other characters than letters and white space."""
        if len(self.tails) > self.most_pieces // 4:
            self.tails.clear()
        new = [x for x in tails if x not in self.tails]
        self.tails.update(zip(new, (x[4:] for x in self._led(new, "\n"))))  # a line break before them is one id
        return [self.tails[x] for x in tails]

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of " " + x for each of these pieces: where they begin, how many they are, all ids, and whether the text goes the whole path."""
        stem, tail = words, pa.nulls(len(words), pa.string())
        if self.parted:
            parts = pc.extract_regex(pc.if_else(pc.less_equal(pc.utf8_length(words), MOST_CHARS), words, ""), _PARTS)
            stem, tail = pc.if_else(parts.is_valid(), pc.struct_field(parts, "stem"), words), pc.if_else(parts.is_valid(), pc.struct_field(parts, "tail"), None)
        stem, tail = stem.dictionary_encode(), tail.dictionary_encode()
        found = self._stems(_strings(stem.dictionary))
        own = len(found)
        begin, n, ids = _joined([*found, b"", *self._tails(_strings(tail.dictionary))])  # a piece without a tail has the empty one
        units = np.stack([stem.indices.to_numpy(), tail.indices.fill_null(-1).to_numpy() + (own + 1)], axis=1)
        bad = np.array([x is None for x in found], bool).take(units[:, 0])
        n = n.take(units)
        length = n.sum(axis=1)
        return np.cumsum(length) - length, length, _gathered(ids, begin.take(units).ravel(), n.ravel()), bad

    def encode(self, texts: Sequence[str | None] | pa.Array) -> list[bytes]:
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        offsets, pieces = split.offsets.to_numpy(), split.flatten()
        offsets = offsets - offsets[0]
        heads = pieces.take(pa.array(offsets[:-1])).to_pylist()
        later = np.ones(len(pieces), bool)
        later[offsets[:-1]] = False  # a head has no space before it
        coded = pieces.filter(pa.array(later)).dictionary_encode()
        begin, length, ids, bad = self._looked_up(coded.dictionary)
        codes = coded.indices.to_numpy()
        n, offsets = length.take(codes), offsets - np.arange(len(offsets))
        raw = _gathered(ids, begin.take(codes), n).tobytes()
        cut = (4 * np.concatenate([[0], np.cumsum(n)])[offsets]).tolist()
        unknown = np.concatenate([[0], np.cumsum(bad.take(codes))])[offsets]
        apart = (unknown[1:] > unknown[:-1]) | np.array([not x or x[-1].isspace() for x in heads])
        for x in self.special:
            apart |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        out = [raw[a:b] for a, b in zip(cut, cut[1:])]
        own = np.flatnonzero(~apart).tolist()
        for k, x in zip(own, self._whole([heads[k] for k in own])):
            out[k] = x + out[k]
        odd = np.flatnonzero(apart)
        for k, x in zip(odd.tolist(), self._whole(texts.take(pa.array(odd)).to_pylist())):
            out[k] = x
        return out
