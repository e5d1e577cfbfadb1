"""Token ids of whole texts by the public tokenizer files, with each different word encoded once per worker."""

from __future__ import annotations

import os

import numpy as np
import regex

from tablemill.llm.words import LOWER, SPACE, hash_spans, kind_spans, pieces

#: Words that a worker remembers (about 25 bytes each), and bytes of text it looks at together.
REMEMBERED, SLICE = 1_500_000, 1 << 19
#: New words that go to the library together: it keeps about 150 bytes for each of their tokens until it is done.
CODED = 8_192
#: Words of the letters, digits and signs that neither normalizing nor lower case takes apart or joins.
PLAIN = regex.compile(r"[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: The splitting rule of word_bpe_49k.json (fixed value), to count the parts of a word.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: 0 white space, 1 ASCII letters, 2 signs that only ever join with signs, 3 all else.
KIND = np.full(256, 3, np.int8)
KIND[33:127] = 2
KIND[65:91] = KIND[97:123] = 1
KIND[48:58] = KIND[[ord(c) for c in "'<|"]] = 3
KIND[SPACE] = 0
#: Id that ends a document.
END = 1


def tokenizer_path(name: str) -> str:
    """Place of a tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def simplified(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, kind): the text with its simple words in lower case, and the kind of every byte.

    A simple word has ASCII letters and signs only, but none of ``'<|``, with which contractions and special
    tokens begin. The normalizer makes it lower case and the splitter cuts it exactly where letters and signs
    meet, so its runs of letters (kind 1) and of signs (kind 2) can be encoded apart. All bytes of other
    words are left as they are and have kind 1, white space has 0.
    """
    kind = KIND[raw]
    starts, ends = kind_spans((kind > 0).astype(np.int8))
    odd = np.concatenate([[0], np.cumsum(kind == 3)])
    odd = odd[ends] > odd[starts]
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts[odd]] += 1
    inside[ends[odd]] -= 1
    inside = np.cumsum(inside)[:-1].astype(bool)
    return np.where(inside, raw, LOWER[raw]), np.where(inside, np.int8(1), kind)


class WordEncoder:
    """ids(texts) as the tokenizers library gives them for whole texts, without added special tokens.

    The normalizer of the file maps white space to a blank, and its splitter drops blanks and never joins what
    one separates, so a text's ids are the ids of the stretches between ASCII white space, one after
    another; simple stretches are cut further, see ``simplified``. Each different stretch is encoded by the
    library once and remembered.
    """

    def __init__(self, name: str = "word_bpe_49k.json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        vocabulary = self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        # hashes of the words, ascending; where the ids of each begin, and how many there are
        self.known, self.begin, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids_ = np.zeros(0, np.uint16)

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, tokens of each). Plain words go to the library as one text, since their number of
        parts is known and the last token of a part is marked in the vocabulary; other words go one by one."""
        parts = [1 if w.isascii() and w.isalpha() else len(PARTS.findall(w.lower())) if PLAIN.fullmatch(w) else 0 for w in words]
        plain = [i for i, n in enumerate(parts) if n]
        length, coded = np.zeros(len(words), np.int64), [np.zeros(0, np.uint16)] * len(words)
        ids = np.array(self.library.encode(" ".join(words[i] for i in plain), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        last = np.cumsum([parts[i] for i in plain])
        if len(plain) and len(ends) == last[-1]:
            cuts = np.concatenate([[0], ends[last - 1]])
            length[plain] = np.diff(cuts)
            other = [i for i, n in enumerate(parts) if not n]
        else:
            ids, plain, other = ids[:0], [], list(range(len(words)))
        if other:
            for i, c in zip(other, self.library.encode_batch_fast([words[i] for i in other], add_special_tokens=False)):
                coded[i] = np.array(c.ids, np.uint16)
                length[i] = len(c.ids)
        begin = np.cumsum(length) - length
        out = np.zeros(int(length.sum()), np.uint16)
        if plain:
            at = np.repeat(begin[plain] - cuts[:-1], length[plain]) + np.arange(len(ids))
            out[at] = ids
        for i in other:
            out[begin[i]:begin[i] + length[i]] = coded[i]
        return out, length

    def _lookup(self, hashes: np.ndarray, flat: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, length): where the ids of the words with these ascending hashes stand. Only new words are cut out
        of the text and encoded. They are remembered while the table has room; the words that fill it first are the
        frequent ones."""
        place = np.searchsorted(self.known, hashes)
        old = place < len(self.known)
        old[old] = self.known[place[old]] == hashes[old]
        begin, length = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        begin[old], length[old] = self.begin[place[old]], self.length[place[old]]
        new = np.flatnonzero(~old)
        if not len(new):
            return self.ids_, begin, length
        coded = [self.ids_]
        for at in range(0, len(new), CODED):
            some = new[at:at + CODED]
            fresh = [flat[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[some].tolist(), ends[some].tolist())]
            ids, length[some] = self._coded(fresh)
            coded.append(ids)
        begin[new] = len(self.ids_) + np.cumsum(length[new]) - length[new]
        table = np.concatenate(coded)
        if len(self.known) + len(new) <= REMEMBERED:
            self.known, self.ids_ = np.insert(self.known, place[new], hashes[new]), table
            self.begin = np.insert(self.begin, place[new], begin[new])
            self.length = np.insert(self.length, place[new], length[new])
        return table, begin, length

    def _slice(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte of each stretch, tokens of each stretch)."""
        array = np.frombuffer(raw, np.uint8)
        array, kind = simplified(array)
        starts, ends = kind_spans(kind)
        if not len(starts):
            return np.zeros(0, np.uint16), starts, starts
        hashes, first, back = np.unique(hash_spans(array, starts, ends), return_index=True, return_inverse=True)
        table, begin, length = self._lookup(hashes, array.tobytes(), starts[first], ends[first])
        counts = length[back]
        at = np.repeat(begin[back] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return table[at], starts, counts

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text followed by the end id; NULL is an empty text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, bytes]] = []

        def flush():
            if not group:
                return
            ids, starts, counts = self._slice(b"\n".join(b for _, b in group))
            bounds = np.cumsum([0] + [len(b) + 1 for _, b in group])
            cuts = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, bounds)]
            for k, (n, _) in enumerate(group):
                out[n].append(ids[cuts[k]:cuts[k + 1]])
            group.clear()

        held = 0
        for n, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            if len(raw) > SLICE:
                flush()
                held = 0
                for a, b in pieces(raw):
                    group.append((n, raw[a:b]))
                    flush()
                continue
            group.append((n, raw))
            held += len(raw)
            if held > SLICE:
                flush()
                held = 0
        flush()
        end = np.array([END], np.uint16)
        return [np.concatenate([*parts, end]) for parts in out]


_encoders: dict[str, WordEncoder] = {}


def encoder(name: str = "word_bpe_49k.json") -> WordEncoder:
    """The worker's encoder; it keeps its words from one task to the next."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(name)
    return _encoders[name]


def forget(name: str = "word_bpe_49k.json") -> None:
    """Drop the worker's encoder with all its words; a later task of the worker makes a new one."""
    _encoders.pop(name, None)
