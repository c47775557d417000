"""Token ids of whole texts, through the tokenizers library, each distinct word encoded once per worker."""
from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Not used in a text that is cut into words, as it is white space of the kind in ``_WHOLE``.
_CUT = "\x1f"
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ſ]"
_LETTERED = rf"\A[ \n]?{_LETTERS}+\z"
#: A word with a full stop or comma behind a letter.
_ENDED = rf"(?s)\A.+{_LETTERS}[.,]\z"
#: Where a tokenizer's split rules look further than one word: white space other than blank and line feed, or two in a row.
_WHOLE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]"
#: Characters of a batch that are handled at once, which bounds the arrays.
_SLICE = 1_000_000
#: Words that an encoder remembers, about 100 bytes each.
MAX_WORDS = 400_000


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist


class WordEncoder:
    """Encodes as the tokenizer does, but each distinct word only once as long as it is remembered, at most ``max_words`` or those of a slice.

    The tokenizers meant here split at white space, and between a letter and a full stop or comma, before they look for
    merges. So a text's ids are those of its words, each with the blank or line feed before it. Texts with other or doubled
    white space, or with what may be the name of a special token, go to the tokenizer as a whole.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        names = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = _WHOLE + (f"|(?i:{names})" if names else "")
        (self.stop,) = self.tokenizer.encode(".", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begins = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)  # the words that came up in a later slice than the one they were learned in
        self.used = 0

    def _make_room(self, coming: int) -> None:
        """Keep the words that came up again, most are met once, or none where those are too many."""
        again = np.flatnonzero(self.again[:len(self.index)])
        if len(again) + coming > self.max_words or 2 * len(again) > self.max_words:
            self._forget()
            return
        words = np.array([*self.index, None], object)[again].tolist()
        ids, sizes = self._gather(again)
        self._forget()
        if words:
            self._remember(words, sizes, ids)

    def _remember(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        first, held = len(self.index), self.used
        if held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(held + len(ids), np.uint32)])
        if first + len(words) + 1 > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros(first + len(words) + 1, np.int64)])
            self.again = np.concatenate([self.again, np.zeros(first + len(words) + 1, bool)])
        self.ids[held:held + len(ids)] = ids
        self.used = held + len(ids)
        self.begins[first + 1:first + 1 + len(words)] = held + np.cumsum(lengths)
        self.index.update(zip(words, range(first, first + len(words))))

    def _gather(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered words, one after the other, and how many each has."""
        begins = self.begins[own]
        sizes = self.begins[own + 1] - begins
        ends = np.cumsum(sizes)
        place = np.repeat((begins - (ends - sizes)).astype(np.int32), sizes)
        place += np.arange(len(place), dtype=np.int32)
        return self.ids[place], sizes

    def _places(self, words: list[str]) -> np.ndarray:
        """Where words are remembered, -1 for those that are not."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def _learn(self, texts: pa.Array) -> None:
        ended = pc.match_substring_regex(texts, _ENDED)
        ends = texts.filter(ended)
        stems, marks = pc.utf8_slice_codeunits(ends, 0, -1), pc.utf8_slice_codeunits(ends, -1)
        plain = pc.unique(pa.concat_arrays([texts.filter(pc.invert(ended)), stems, pc.unique(marks)]))
        plain = plain.filter(pa.array(self._places(_strings(plain)) < 0))
        alone = pc.match_substring_regex(plain, _LETTERED)
        lettered = _strings(plain.filter(alone))
        for at in range(0, len(lettered), 20_000):  # many at a time, with full stops between: no letters give the stop's id
            part = lettered[at:at + 20_000]
            joined = [".".join(part[i:i + 500]) + "." for i in range(0, len(part), 500)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            stops = np.flatnonzero(ids == self.stop)
            self._remember(part, np.diff(stops, prepend=-1) - 1, ids[ids != self.stop])
        others = _strings(plain.filter(pc.invert(alone)))
        for at in range(0, len(others), 20_000):
            part = others[at:at + 20_000]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            self._remember(part, lengths, np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())))
        if len(ends):
            own = np.stack([self._places(_strings(stems)), self._places(_strings(marks))], axis=1)
            ids, sizes = self._gather(own.reshape(-1))
            self._remember(_strings(ends), sizes[::2] + sizes[1::2], ids)

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        apart = {int(i): np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(whole)}
        if apart:
            texts = pc.if_else(pa.array(whole), "", texts)
        words = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", _CUT + " "), "\n", _CUT + "\n"), _CUT)
        coded = words.values.dictionary_encode()
        distinct = _strings(coded.dictionary)
        places = self._places(distinct)
        new = np.flatnonzero(places < 0)
        self.again[places[places >= 0]] = True
        if len(new):
            if len(self.index) + len(new) > self.max_words:
                self._make_room(len(new))
                places = self._places(distinct)
                new = np.flatnonzero(places < 0)
            self._learn(coded.dictionary.take(pa.array(new)))
            places[new] = self._places([distinct[i] for i in new.tolist()])
        ids, sizes = self._gather(places[coded.indices.to_numpy()])
        ends = np.cumsum(sizes)
        offsets = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        if apart:
            parts = [apart.get(i, ids[offsets[i]:offsets[i + 1]]) for i in range(len(texts))]
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offsets

    def encode_texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + _SLICE, side="right")))
            ids, offsets = self._encode_slice(pa.concat_arrays([texts.slice(at, end - at)]))
            for b, e in zip(offsets.tolist(), offsets[1:].tolist()):
                yield ids[b:e]
            pa.default_memory_pool().release_unused()  # the arrays of a slice are not kept for the next one
            at = end


@lru_cache(maxsize=4)
def encoder(path: str, max_words: int = MAX_WORDS) -> WordEncoder:
    """One encoder for each vocabulary file in a Python worker, which Spark reuses from task to task."""
    return WordEncoder(path, max_words)


def forget_words() -> None:
    """Free the encoders of this Python worker. Tasks of operators with tables of their own begin with it, as Spark reuses workers."""
    encoder.cache_clear()


def encoded(texts: pa.Array, path: str, end_id: int, max_words: int = MAX_WORDS) -> Iterator[np.ndarray]:
    """The ids of each text with the end id behind them; null counts as empty."""
    for ids in encoder(path, max_words).encode_texts(texts):
        yield np.append(ids, np.uint32(end_id))
