"""Token ids by the tokenizers library, each distinct piece of text encoded once.

Both public vocabularies split a text by a pattern before any merge, and the ids of a text are those of its pieces one
after another. A text made of the characters in PLAIN, on whose classes all Unicode versions agree, is split here by
the same pattern (many texts at once, at the borders of character classes), and only pieces that aren't in a
bounded cache go to the library; the cache is asked once for each distinct piece of a chunk of texts. Any other text
goes to the library whole; for a vocabulary in lower case also one with a capital whose lower case isn't in PLAIN, as
U+018F with U+0259, and for any vocabulary one with a string of its added tokens, which the library takes before it
splits.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa

from corvane.llm.common import kept

#: ASCII, Latin letters and signs up to U+024F, and general punctuation, but for spaces and U+0130, whose lower case is two characters.
PLAIN_RANGES = ((0x09, 0x0D), (0x20, 0x7E), (0xA1, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E))
CACHE_PIECES = 1_000_000
#: Characters of text that are split at a time.
CHUNK_CHARS = 1_000_000
#: New pieces that go to the library as one text, a line each.
LINES = 256


def _plain_class(lower: bool) -> str:
    """Inside of a character class: plain characters."""
    plain = [chr(c) for a, b in PLAIN_RANGES for c in range(a, b + 1)]
    if lower:
        every = set(plain)
        plain = [c for c in plain if c.lower() in every]
    return "".join(map(re.escape, plain))


#: Classes of characters in PLAIN. END, code 0, stands after each text.
SPACE, LETTER, DIGIT, OTHER, END = range(5)


def _kinds():
    import numpy as np

    categories = [unicodedata.category(chr(c))[0] for c in range(PLAIN_RANGES[-1][1] + 1)]
    kinds = np.array([{"L": LETTER, "N": DIGIT}.get(c, OTHER) for c in categories], np.uint8)
    kinds[[*range(0x09, 0x0E), 0x20]], kinds[0] = SPACE, END
    return kinds


KINDS = _kinds()


def piece_starts(codes, lower: bool):
    """Where the pieces of texts start, in the codes of their characters, with a zero after each text. White space counts as pieces, too,
    where the pattern leaves it out, and so do the zeros.

    A piece is a run of one class. Unless lower, a space goes with the run after it, and the last character of other white space before a
    run is a piece; with lower each digit is a piece. An apostrophe alone goes with a tail as the s of 's."""
    import numpy as np

    kind, n = KINDS[codes], len(codes)
    start = np.zeros(n + 3, bool)  # some more, as tails are looked up beyond the end
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    if lower:
        start[:n] |= kind == DIGIT
    else:
        last = np.flatnonzero((kind[:-1] == SPACE) & start[1:n] & (kind[1:] != END))
        start[last] = True
        start[last[codes[last] == 0x20] + 1] = False
    mark = np.flatnonzero(codes == 0x27)
    mark = mark[start[mark] & start[mark + 1]]
    after = np.concatenate((codes, np.zeros(3, codes.dtype)))
    one, two = after[mark + 1], after[mark + 2]
    size = np.isin(one, [*b"stmd"]).astype(np.int64)
    for a, b in (b"re", b"ve", b"ll"):
        size[(one == a) & (two == b)] = 2
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    start[mark + 1 + size] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """ids(texts) -> for each text the bytes of its ids as little-endian unsigned 32-bit integers.

    A null text counts as empty. (Ids are in the machine's order, little-endian wherever Spark runs here.) Strings of added tokens
    in a text become their ids, as with the library's own settings."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.cache_pieces, self.cache, self.older = cache_pieces, {}, {}
        self.lower = spec.get("normalizer") is not None
        self.odd = re.compile(f"[^{_plain_class(self.lower)}]").search
        # An added token that is normalised may be found in other cases too.
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE if any(t["normalized"] for t in spec.get("added_tokens", [])) else 0).search

        # How the ids of lines are told apart: by the ends of words, where line ends have no id, or by the line end's own id, which no other piece has.
        suffix, line = spec["model"].get("end_of_word_suffix"), self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_id = line[0] if len(line) == 1 and not self.lower else None
        self.word_ends, self.apart = None, None
        if self.line_id is not None and spec.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            # For pieces that are split already: the same vocabulary without its search for pieces.
            self.apart = Tokenizer.from_file(path)
            self.apart.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if suffix and self.lower and not line:
            import numpy as np

            self.word_ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.word_ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _lines(self, pieces: list[str]) -> list[bytes]:
        """_raw() of pieces without white space but for a leading space, many of them in one text, as a call and its result cost the library much for each."""
        import numpy as np

        if self.line_id is None and self.word_ends is None:
            return self._raw(pieces)
        parts, out = [pieces[k : k + LINES] for k in range(0, len(pieces), LINES)], []
        if self.apart is not None:
            given = self.apart.encode_batch_fast([[x for p in part for x in (p, "\n")][:-1] for part in parts], is_pretokenized=True, add_special_tokens=False)
        else:
            given = self.tokenizer.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False)
        for part, told in zip(parts, given, strict=True):
            ids = np.array(told.ids, np.uint32)
            if self.word_ends is not None:
                stops = np.flatnonzero(self.word_ends[ids]) + 1
                starts = np.concatenate(([0], stops[:-1]))
            else:
                at = np.flatnonzero(ids == self.line_id)
                starts, stops = np.concatenate(([0], at + 1)), np.append(at, len(ids))
            if len(starts) != len(part) or stops[-1:].sum() != len(ids):
                out += self._raw(part)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * stops).tolist(), strict=True)]
        return out

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, found: list[str]) -> list[bytes]:
        """The ids of distinct pieces, from the cache or else from the library."""
        cache, older = self.cache, self.older
        own = list(map(cache.get, found))
        gaps = [k for k, ids in enumerate(own) if ids is None]
        if gaps:
            new = []
            for k in gaps:
                own[k] = ids = older.get(found[k])
                if ids is None:
                    new.append(k)
            blank, rest = ([k for k in new if found[k].isspace() == b] for b in (True, False))
            for part, told in ((blank, self._raw([found[k] for k in blank])), (rest, self._lines([found[k] for k in rest]))):
                for k, ids in zip(part, told, strict=True):
                    own[k] = ids
            if len(cache) + len(gaps) > self.cache_pieces // 2:  # pieces not met since the last time go
                self.older, self.cache = cache, dict(zip(found, own, strict=True))
            else:
                cache.update((found[k], own[k]) for k in gaps)
        return own

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts made of PLAIN."""
        import numpy as np

        whole = "\0".join([*texts, ""])
        codes, data = np.frombuffer(whole.encode("utf-32-le"), "<u4"), whole.encode()
        starts = piece_starts(codes, self.lower)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        inside = KINDS[codes[starts]] != END
        if self.lower:
            inside &= KINDS[codes[starts]] != SPACE
        bounds = np.concatenate(([0], np.cumsum(inside)))[np.searchsorted(starts, begins)]
        offsets = np.append(starts, len(codes))
        if len(data) > len(codes):
            widths = (codes >= 0x80).view(np.uint8) + (codes >= 0x800).view(np.uint8)
            offsets += np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))[offsets]
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        coded = pieces.filter(pa.array(inside)).dictionary_encode()
        own = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, own), np.int32, len(own)) // 4
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n, dtype=np.int32)
        taken = np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[at] - ends + n, n)
        taken += np.arange(len(taken), dtype=np.int32)
        raw = np.frombuffer(b"".join(own), np.uint32)[taken].tobytes()
        cuts = (4 * np.concatenate(([0], ends)).astype(np.int64)[bounds]).tolist()
        return (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def _chunk(self, texts: list[str]) -> list[bytes]:
        plain = [not self.odd(t) and not self.added(t) for t in texts]
        own = [t.lower() if self.lower else t for t, p in zip(texts, plain, strict=True) if p]
        told = self._plain(own) if own else iter(())
        return [next(told) if p else self._raw([t])[0] for t, p in zip(texts, plain, strict=True)]

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            part, n = [], 0
            while at < len(texts) and (not part or n < CHUNK_CHARS):
                part.append(texts[at] or "")
                n += len(part[-1])
                at += 1
            yield from self._chunk(part)


_encoders: dict[str, Encoder] = {}
kept.append(_encoders)


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """The Python worker's own encoder, kept from task to task until let_go()."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, cache_pieces)
    return _encoders[path]
