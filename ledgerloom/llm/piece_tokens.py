"""Token ids by the sentencepiece library, a column of texts at a time.

Where no piece has a space after another character, no merge crosses the beginning of a
space run, so a text may be cut there and equal words need to be encoded once. Models of
which this does not hold encode each text as a whole.
"""

from __future__ import annotations

import re
from array import array

from ledgerloom.llm.tokens import Known, _gathered

WORDS, SPACE = 200_000, "▁"
#: Marks a word whose pieces do not give its bytes.
BROKEN = 0xFFFFFFFF
_CUT = re.compile(r"(?<=[^ ])(?= )")
_loaded: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """of(texts) gives the ids of a column of texts; bytes_of[id] are a token's bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as form

        self.pieces = SentencePieceProcessor(model_file=path)
        model = form.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.bytes_of = [bytes([int(x.piece[3:5], 16)]) if x.type == x.BYTE else x.piece.replace(SPACE, " ").encode() for x in model.pieces]
        how = model.normalizer_spec
        self.cuts = model.trainer_spec.model_type == model.trainer_spec.BPE and not how.precompiled_charsmap and how.add_dummy_prefix and not how.remove_extra_whitespaces and how.escape_whitespaces
        self.cuts &= not any(SPACE in x.piece.lstrip(SPACE) for x in model.pieces)
        self.space = self.pieces.piece_to_id(SPACE)
        self.words = Known(self._of_words, WORDS)

    def _of_words(self, words):
        """The ids of words, each with the space before it, and how many each has."""
        import numpy as np

        own = words.to_numpy(zero_copy_only=False).tolist()
        lists = [x or [self.space] for x in self.pieces.encode(own, num_threads=1)] if self.cuts else self.pieces.encode(own, num_threads=1)
        table = self.bytes_of
        if b"".join([table[i] for x in lists for i in x]) != "".join([f" {w}" for w in own]).encode():
            lists = [x if b"".join([table[i] for i in x]) == f" {w}".encode() else [BROKEN] for w, x in zip(own, lists, strict=True)]
        flat = array("I")
        for x in lists:
            flat.extend(x)
        return np.frombuffer(flat, np.uint32), np.array([len(x) for x in lists], np.int64)

    def of(self, texts):
        """The ids of an Arrow array of strings without nulls, one text after another, how
        many each has, and whether they give the bytes of a space and the text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.cuts:
            lists = [[x] for x in texts.to_pylist()]
            words = pa.array(lists, pa.list_(pa.string()))
        else:
            loose = pc.or_(pc.match_substring_regex(texts, " (?: |$)"), pc.starts_with(texts, " "))
            if pc.any(loose).as_py():
                cut = [[x[1:] for x in _CUT.split(f" {t}")] if odd else t.split(" ") for t, odd in zip(texts.to_pylist(), loose.to_pylist(), strict=True)]
                words = pa.array(cut, pa.list_(pa.string()))
            else:
                words = pc.split_pattern(texts, " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        numbered = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        flat, starts, lengths = self.words.of(numbered.dictionary)
        at = numbered.indices.to_numpy()
        n = lengths[at]
        ends = np.append(0, np.cumsum(n))
        ids = _gathered(flat, starts[at], n)
        count = ends[offsets[1:]] - ends[offsets[:-1]]
        broken = np.append(0, np.cumsum(ids == BROKEN))
        stops = ends[offsets]
        return ids, count, broken[stops[1:]] == broken[stops[:-1]]


def piece_encoder(path: str) -> PieceEncoder:
    """One for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]
