"""Token ids of whole texts by a public tokenizer file, on executors."""

from __future__ import annotations

import json
import os
import struct
from functools import lru_cache

#: Words that one Python worker remembers; more are encoded anew each time, with equal results.
REMEMBERED = 600_000
LONGEST = 48
#: Letters of Latin-1 beyond ASCII, with the two signs among them.
LATIN = (0xAA, 0xB5, 0xBA, *range(0xC0, 0x100))
#: Texts on which a file's splitting is tried.
PROBES = ["Two words, and Another one.", " leading  and trailing \n", "Tabs\tand\nlines\r\nof TEXT", "naïve Straße 日本語 x", "The the THE It's 3.14 unbelievableness", "A. B, c"]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    Where a vocabulary drops white space and splits words at it, a text's ids are those of its
    blank-separated parts in turn; equal parts are encoded once.  Whether that holds for a file, and
    whether it minds case and stops, is tried on PROBES; a file that fails is given whole texts.  Where
    it minds neither, Latin-1 texts are parted in small letters, and a word is encoded once for its
    forms with and without a stop.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        self.known.update(zip(".,", self._ids([".", ","]), strict=True))
        one = lambda x: self._ids([x])[0]
        parts = lambda x: b"".join(map(one, x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))
        self.by_parts = all(one(x) == parts(x) for x in PROBES)
        words = [w for x in PROBES for w in x.split() if w.isascii() and w.isalpha()]
        words += [f"a{chr(c)}b{chr(c)}" for c in LATIN if chr(c).isalpha()]
        self.by_small_letters = self.by_parts and all(one(w) == one(w.lower()) and one(w + stop) == one(w.lower()) + one(stop) for w in words for stop in ".,")
        small = [w.lower() for w in words]
        self.bare = self._unsplit(path) if self.by_small_letters else None
        if self.bare and self._ids(small, self.bare) != self._ids(small):
            self.bare = None

    @staticmethod
    def _unsplit(path: str):
        """The file's tokenizer as it is after normalising and splitting, which leave a word of small letters as it is."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first = made.get("pre_tokenizer") or {}
        steps = first.get("pretokenizers", [first]) if first else []
        made |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [x for x in steps if x["type"] != "Split"]}}
        return Tokenizer.from_str(json.dumps(made))

    def _ids(self, parts: list[str], by=None) -> list[bytes]:
        return [struct.pack(f"<{len(i)}I", *i) for i in (e.ids for e in (by or self.tokenizer).encode_batch_fast(parts, add_special_tokens=False))]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of parts; words of small Latin-1 letters alone go without normalising and splitting, which take as long as all else."""
        if not self.bare:
            return self._ids(words)
        plain = [w.isalpha() and w.islower() and max(w) <= "\xff" for w in words]
        short = iter(self._ids([w for w, p in zip(words, plain, strict=True) if p], self.bare))
        rest = iter(self._ids([w for w, p in zip(words, plain, strict=True) if not p]))
        return [next(short if p else rest) for p in plain]

    def _composed(self, w: str) -> bytes | None:
        """A word that ends in one stop after an ASCII letter splits there, and ASCII capitals count as small letters: the ids by known parts, if they are known."""
        known = self.known
        if self.by_small_letters and w.isascii():
            if (v := known.get(w.lower())) is not None and "<|" not in w:
                return v
            if len(w) > 1 and w[-1] in ".," and w[-2].isalpha() and (v := known.get(w[:-1].lower())) is not None and "<|" not in w:
                return v + known[w[-1]]
        return None

    def _in_small_letters(self, x: str) -> str | None:
        """A Latin-1 text without marks of special tokens in small letters, which has the same ids; None for other texts."""
        if not self.by_small_letters or "<|" in x:
            return None
        if not x.isascii():
            try:
                x.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return x.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_parts:
            return self._ids(texts)
        known, out, open_ = self.known, [], {}
        get, room = known.get, REMEMBERED - len(known)
        for k, x in enumerate(texts):
            x = x.replace("\n", " ").replace("\t", " ").replace("\r", " ")
            small = self._in_small_letters(x)
            parts = (x if small is None else small).split(" ")
            ids = list(map(get, parts))
            out.append(ids)
            at = -1
            while True:
                try:
                    at = ids.index(None, at + 1)
                except ValueError:
                    break
                w = parts[at]
                if small is None:
                    v, tail = self._composed(w), b""
                elif w[-1] in ".," and w[-2:-1].isalpha():  # the word may be known, or be met here without its stop
                    own, tail = w[:-1], known[w[-1]]
                    if (v := get(own)) is not None:
                        v += tail
                        if room > 0 and len(w) <= LONGEST:
                            known[w] = v
                            room -= 1
                    w = own
                else:
                    v, tail = None, b""
                if v is not None:
                    ids[at] = v
                else:
                    open_.setdefault(w, []).append((k, at, tail))
        if open_:
            own = self._of_words(list(open_))
            for (w, places), v in zip(open_.items(), own, strict=True):
                for k, at, tail in places:
                    out[k][at] = v + tail
                if room > 0 and len(w) <= LONGEST:
                    known[w] = v
                    room -= 1
        return [b"".join(ids) for ids in out]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each worker process, kept over tasks."""
    return Encoder(path)


def encoded(texts, path: str, step: int = 2 << 20):
    """(row, ids) for each text of an Arrow column, a few MB of text at a time; a null text is empty."""
    e, held, size, first = encoder(path), [], 0, 0
    for i, x in enumerate(texts):
        x = x.as_py() or ""
        held.append(x)
        size += len(x)
        if size >= step:
            yield from enumerate(e.encode(held), first)
            held, size, first = [], 0, i + 1
    if held:
        yield from enumerate(e.encode(held), first)
