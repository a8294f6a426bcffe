"""Token ids by the tokenizers library, a column of texts at a time.

A byte-level BPE first cuts a text into units (a run of letters, of digits or of
marks, each with the space before it) and then merges bytes within a unit. A text
may therefore be cut before every space that a visible character follows, and
equal words need to be encoded once. Arrow cuts the texts at their spaces and
numbers the distinct words; words of plain characters are cut into units by one
regular expression, and the model of the library encodes every distinct unit. Any
other word goes through the whole library. The ids of the texts are gathered from
those of their words. A worker keeps the ids of the words and units that it has seen.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

#: Words and units that a worker remembers, and bytes of text that are taken at once.
WORDS, UNITS, SLICE = 250_000, 350_000, 4_000_000
#: A space that white space or the end follows: such a text is cut by _CUT.
_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LOOSE = rf" (?:[{_SPACES}]|$)"
_CUT = re.compile(r" (?=\S)")
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_PLAIN = rf"^ ?[{_LETTER}0-9{_MARK}]+(?:\n[{_LETTER}0-9{_MARK}]+)*$"
#: Fixed value: the cuts of a byte-level pre-tokenizer, for plain characters.
_UNITS = rf"('s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\n)"
_STOP = "\x1f"
_loaded: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _gathered(flat, starts, lengths):
    """The runs of `flat` that begin at `starts`, one after another."""
    import numpy as np

    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return flat[at]


class Known:
    """Distinct strings and their ids, kept between slices up to `keep` of them.
    made(strings) gives the ids of new ones, and each one's length."""

    def __init__(self, made, keep: int):
        self.made, self.keep = made, keep
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.number, self.flat, self.used, self.ends = {}, np.zeros(1 << 16, np.uint32), 0, array("q", [0])

    def of(self, strings):
        """The ids of all that is known, and for each of `strings` (an Arrow array)
        its start and length there."""
        import numpy as np
        import pyarrow as pa

        if len(self.number) > self.keep:
            self.clear()
        number, own = self.number, strings.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter([number.get(x, -1) for x in own], np.int64, len(own))
        new = np.flatnonzero(at < 0)
        if len(new):
            flat, lengths = self.made(strings if len(new) == len(own) else strings.take(pa.array(new)))
            at[new] = np.arange(len(new)) + len(self.ends) - 1
            number.update(zip(map(own.__getitem__, new.tolist()), at[new].tolist(), strict=True))
            if self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.ends.frombytes((self.used + np.cumsum(lengths)).astype(np.int64).tobytes())
            self.used += len(flat)
        ends = np.frombuffer(self.ends.tobytes(), np.int64)
        return self.flat, ends[at], ends[at + 1] - ends[at]


class Encoder:
    """slices(texts) gives the ids of a column of texts, encode(text) those of one.
    special: whether the strings of special tokens in a text give their ids."""

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model, self.size = self.tokenizer.model, self.tokenizer.get_vocab_size()
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.cuts &= all(not (x["lstrip"] or x["rstrip"] or " " in x["content"]) for x in spec["added_tokens"])
        self.added = [x["content"] for x in spec["added_tokens"] if x["content"] and (special or not x["special"])]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
        self.shown = {b: shown[b] for b in range(256)}
        self.words, self.units = Known(self._of_words, WORDS), Known(self._of_units, UNITS)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str):
        import pyarrow as pa

        return next(self.slices(pa.array([text], pa.string())))[1]

    def slices(self, texts, end_id: int | None = None) -> Iterator:
        """For slices of about SLICE bytes of an Arrow array of strings without nulls:
        the slice's first row, the ids (unsigned 32-bit) of its texts, and where each
        text's begin and the last's end. end_id is added to each text."""
        import numpy as np
        import pyarrow.compute as pc

        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
        k = 0
        while k < len(texts):
            stop = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + SLICE)))
            ids, n = self._of_slice(texts.slice(k, stop - k))
            ends = np.append(0, np.cumsum(n))
            if end_id is not None:
                ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
            yield k, ids, ends
            k = stop

    def _of_slice(self, texts):
        """The ids of the texts and how many each has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.cuts:
            own = [self.whole(t) for t in texts.to_pylist()]
            return np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own], np.int64)
        loose = pc.match_substring_regex(texts, _LOOSE)
        if pc.any(loose).as_py():
            cut = [_CUT.split(t) if x else t.split(" ") for t, x in zip(texts.to_pylist(), loose.to_pylist(), strict=True)]
            words = pa.array(cut, pa.list_(pa.string()))
        else:
            words = pc.split_pattern(texts, " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        values = words.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        # All words but a text's first have a space before them.
        numbered, first = values.dictionary_encode(), values.take(pa.array(offsets[:-1])).dictionary_encode()
        at = numbered.indices.to_numpy().copy()
        at[offsets[:-1]] = first.indices.to_numpy() + len(numbered.dictionary)
        later = pc.binary_join_element_wise(pa.scalar(""), numbered.dictionary, pa.scalar(" "))
        flat, starts, lengths = self.words.of(pa.concat_arrays([later, first.dictionary]))
        n = lengths[at]
        ends = np.append(0, np.cumsum(n))
        return _gathered(flat, starts[at], n), ends[offsets[1:]] - ends[offsets[:-1]]

    def _of_units(self, units):
        """The ids of units (each is merged by the model alone), and their lengths."""
        import numpy as np

        shown, encode, flat, lengths = self.shown, self.model.tokenize, array("I"), array("q")
        for u in units.to_numpy(zero_copy_only=False).tolist():
            own = encode(u.encode().decode("latin-1").translate(shown))
            flat.extend([x.id for x in own])
            lengths.append(len(own))
        return np.frombuffer(flat, np.uint32), np.frombuffer(lengths, np.int64)

    def _of_words(self, words):
        """The ids of words (with the space before them), and their lengths."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(words, _PLAIN)
        for x in self.added:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, x)))
        plain = plain.to_numpy(zero_copy_only=False)
        mine, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        lengths, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        cut = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(words.take(pa.array(mine)), _UNITS, rf"\1{_STOP}"), _STOP), _STOP)
        of, units = cut.offsets.to_numpy().astype(np.int64), cut.values.dictionary_encode()
        flat, unit_start, unit_length = self.units.of(units.dictionary)
        at = units.indices.to_numpy()
        n = unit_length[at]
        ends = np.append(0, np.cumsum(n))
        lengths[mine] = ends[of[1:]] - ends[of[:-1]]
        flat = _gathered(flat, unit_start[at], n)
        if len(rest):
            starts[mine] = ends[of[:-1]]
            own = [self.whole(w) for w in words.take(pa.array(rest)).to_pylist()]
            lengths[rest] = [len(x) for x in own]
            starts[rest] = len(flat) + np.cumsum(lengths[rest]) - lengths[rest]
            flat = _gathered(np.concatenate([flat, np.array([i for x in own for i in x], np.uint32)]), starts, lengths)
        return flat, lengths


def encoder(path: str, special: bool = True) -> Encoder:
    """One for each worker process, file and kind."""
    if (path, special) not in _loaded:
        _loaded[path, special] = Encoder(path, special)
    return _loaded[path, special]
