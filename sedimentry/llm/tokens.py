"""Encoding whole texts with a public byte-level BPE of the tokenizers library, one stretch at a time.

A byte-level BPE cuts a text into pieces before it merges, and no merge crosses a piece. Texts are cut at places that are
always piece boundaries: before a space, around a line feed, and before a full stop or comma that follows a letter or
digit. The library encodes each distinct stretch once per worker, so the result equals encoding the whole text. Texts in
which a cut could be doubtful (runs of three spaces or line feeds, two at the end, other white space, the special token)
go to the library whole. The cache is bounded and forgets what the last stretches didn't use, which costs time only.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: White space, or characters that some definition calls so, other than a space or line feed; the cut mark; the special token; runs.
_DOUBTFUL = "[\\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u3000\ufeff]|<\\||[ \n]{3}|[ \n]{2}\\z"
_LOOSE_STOP = f"(?:^|[^0-9{_LETTERS}])[.,]"
_PLAIN = re.compile(f" ?[{_LETTERS}]+")
CACHED = 700_000
#: Bytes of texts that are cut at once.
CHUNK = 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """ids of whole texts as little-endian bytes of width 2 or 4."""

    def __init__(self, path: str, width: int = 4, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype(f"<u{width}")
        self.cached = cached
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        #: The characters by which byte-level vocabularies name bytes.
        self.names = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    @property
    def size(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _ids_of(self, stretches: list[str]) -> list[bytes]:
        """ids of distinct stretches, from the cache or learned: letters alone are one piece, which the model merges; the rest
        passes the whole library."""
        out = list(map(self.cache.get, stretches))
        missing = [i for i, e in enumerate(out) if e is None]
        if len(self.cache) + len(missing) > self.cached:
            self.older, self.cache = self.cache, {}
        cache, older, names, width = self.cache, self.older, self.names, self.dtype.itemsize
        merge, plain, rest = self.library.model.tokenize, _PLAIN.fullmatch, []
        for i in missing:
            x = stretches[i]
            known = older.get(x)
            if known is None:
                if not plain(x):
                    rest.append(i)
                    continue
                known = b"".join([t.id.to_bytes(width, "little") for t in merge(x.encode().decode("latin-1").translate(names))])
            out[i] = cache[x] = known
        for i, e in zip(rest, self.library.encode_batch_fast([stretches[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = cache[stretches[i]] = np.array(e.ids, self.dtype).tobytes()
        return out

    @staticmethod
    def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The stretches of each text, none where a cut could be doubtful, and which texts those are."""
        whole = pc.match_substring_regex(texts, _DOUBTFUL)
        put = lambda x, mark, by: pc.replace_substring(x, mark, by)
        stops = pc.if_else(pc.match_substring_regex(texts, _LOOSE_STOP), texts, put(put(texts, ".", "\0."), ",", "\0,"))
        marked = put(put(stops, " ", "\0 "), "\n", "\0\n\0")
        return pc.split_pattern(pc.if_else(whole, pa.scalar("", texts.type), marked), "\0"), whole.to_numpy(zero_copy_only=False)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """texts: no nulls but in a column, where they are empty texts."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        out, a = [], 0
        while a < len(column):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
            out += self._encode_some(column[a:z])
            a = z
        return out

    def _encode_some(self, texts: pa.Array) -> list[bytes]:
        """Stretches are cut and numbered by Arrow, so that Python sees each one once, and their ids laid end to end by numpy."""
        cut, whole = self._cut(texts)
        stretches = cut.flatten().dictionary_encode()
        known = self._ids_of(stretches.dictionary.to_pylist())
        own = stretches.indices.to_numpy()
        lens = np.fromiter(map(len, known), np.int64, len(known)) // self.dtype.itemsize
        starts, n = np.r_[0, np.cumsum(lens)[:-1]], lens[own]
        ends = np.r_[0, np.cumsum(n)]
        ids = np.frombuffer(b"".join(known), self.dtype)[np.repeat(starts[own] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        at = (ends[cut.offsets.to_numpy()] * self.dtype.itemsize).tolist()
        out = [ids[a:z] for a, z in zip(at, at[1:], strict=False)]
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._encode(texts[i].as_py())
        return out


@lru_cache(maxsize=2)
def encoder(path: str, width: int = 4) -> PieceEncoder:
    """One encoder and cache per worker process."""
    return PieceEncoder(path, width)
