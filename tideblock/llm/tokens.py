"""Exact encoding with remembered pieces.

A text is cut where the pre-tokenizer cuts as well, whatever stands around the
place. The pieces of a slice of texts are numbered by Arrow, so Python sees each
different piece once; those that are not remembered go to the vocabulary's library
in one call, and a text's ids are its pieces' ids in order.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT

#: A letter that normalization leaves a letter, then ASCII punctuation: either pre-tokenizer cuts between them.
_LETTER_AND_MARK = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([!-/:-@\[-`{-~])"
#: A space between two characters that are no white space starts a byte-level piece.
_SPACED = re.compile(r"(?<=\S)(?= \S)")
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BESIDE_SPACE = rf" {_WHITE}|{_WHITE} |\x00|<\|"
#: What could come out otherwise if A-Z were lower-cased before normalization: marks that join a letter, and special strings.
_AS_IT_IS = r"[\x{300}-\x{36f}]|<\|"
#: Pieces that one generation of the memory holds, and the longest piece that is remembered.
MEMORY = 250_000
LONGEST = 64
#: Bytes of text in a slice, bytes of it that are cut at once, and pieces whose ids are gathered at once.
SLICE_BYTES = 4 << 20
CUT_BYTES = 1 << 19
GATHERED = 1 << 17
#: Pieces that go to the library in one call.
ASKED = 8192


def cut_before_spaces(texts: pa.Array) -> pa.ListArray:
    """Pieces for a byte-level pre-tokenizer, each with its leading space.

    Cuts are single spaces between other characters, and places between a letter and
    a mark. In texts where white space runs together or special strings may stand,
    only spaces with no other white space beside them count.
    """
    slow = pc.match_substring_regex(texts, _BESIDE_SPACE)
    cut = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring(texts, " ", "\x00 "), _LETTER_AND_MARK, "\\1\x00\\2"), "\x00")
    if not pc.any(slow).as_py():
        return cut
    at = pc.indices_nonzero(slow)
    own = pa.array([_SPACED.split(x) for x in texts.take(at).to_pylist()], cut.type)
    order = np.arange(len(texts))
    order[at.to_numpy()] = len(texts) + np.arange(len(at))
    return pa.concat_arrays([cut, own]).take(pa.array(order))


def cut_at_spaces(texts: pa.Array) -> pa.ListArray:
    """Pieces for a pre-tokenizer that drops white space, after a normalizer that lower-cases; A-Z are lower-cased here, so that more pieces are equal, and cuts between a letter and a mark are spaces too."""
    low = pc.if_else(pc.match_substring_regex(texts, _AS_IT_IS), texts, pc.replace_substring_regex(pc.ascii_lower(texts), _LETTER_AND_MARK, "\\1 \\2"))
    return pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")


class Remembering:
    """Values of pieces. One object serves a Python worker.

    Two generations of at most MEMORY pieces bound the memory; a piece in use
    moves to the younger one when the older is dropped. encode(pieces) gives a value
    for each piece.
    """

    def __init__(self, encode: Callable[[list[str]], list], cut: Callable[[pa.Array], pa.ListArray] | None, nothing: object):
        self.encode, self.cut, self.nothing = encode, cut, nothing
        self.young, self.old = {"": nothing}, {}

    def values(self, pieces: list[str]) -> list:
        """The value of each piece; the pieces differ."""
        if len(self.young) > MEMORY:
            self.old, self.young = self.young, {"": self.nothing}
        found = list(map(self.young.get, pieces))
        holes = [i for i, v in enumerate(found) if v is None]
        if holes:
            lost = [pieces[i] for i in holes]
            got = list(map(self.old.get, lost))
            new = [j for j, v in enumerate(got) if v is None]
            for s in range(0, len(new), ASKED):  # the library keeps much beside the ids while it encodes
                some = new[s : s + ASKED]
                for j, v in zip(some, self.encode([lost[j] for j in some]), strict=True):
                    got[j] = v
            for i, v in zip(holes, got, strict=True):
                found[i] = v
            kept = zip(lost, got, strict=True)
            self.young.update(kept if max(map(len, lost)) <= LONGEST else [(k, v) for k, v in kept if len(k) <= LONGEST])
        return found


def _library(path: str, lengths: bool) -> Callable[[list[str]], list]:
    """Pieces -> their ids as bytes, or how many they are, by the model file's own library: tokenizers for .json, sentencepiece for .model."""
    value = len if lengths else lambda ids: array("I", ids).tobytes()
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda pieces: [value(x) for x in own.encode(pieces, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    special = [x.content for x in model.get_added_tokens_decoder().values()]
    specials = re.compile("|".join(map(re.escape, special)))

    def encode(pieces: list[str]) -> list:
        """All plain pieces in one call, as the words of one text; pieces with special strings each as a text of its own."""
        apart = [(i, x) for i, x in enumerate(pieces) if specials.search(x)] if special and specials.search("\n".join(pieces)) else []
        words = list(pieces)
        for i, _ in apart:
            words[i] = ""
        found = model.encode(words, is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(np.asarray(found.word_ids, np.int64), np.arange(len(words)), "right")
        starts = np.concatenate(([0], ends[:-1]))
        if lengths:
            out = (ends - starts).tolist()
        else:
            ids = array("I", found.ids).tobytes()
            out = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for (i, _), x in zip(apart, model.encode_batch_fast([x for _, x in apart], add_special_tokens=False), strict=True):
            out[i] = value(x.ids)
        return out

    return encode


def cutter(path: str) -> Callable[[pa.Array], pa.ListArray] | None:
    """How a vocabulary's texts may be cut; None, for whole texts, where nothing is known of its pre-tokenizer."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre, steps = rules.get("pre_tokenizer") or {}, (rules.get("normalizer") or {}).get("normalizers", [])
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not rules.get("normalizer"):
            return cut_before_spaces
        first = (pre.get("pretokenizers") or [{}])[0]
        if first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]:
            return cut_at_spaces
    return None


_workers: dict[tuple, Remembering] = KEPT.setdefault("tokens", {})


def _worker(path: str, kind: str) -> Remembering:
    if (path, kind) not in _workers:
        lengths = kind == "lengths"
        _workers[path, kind] = Remembering(_library(path, lengths), cutter(path), 0 if lengths else b"")
    return _workers[path, kind]


def _pieces(own: Remembering, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Ends of the texts among their pieces (from 0 on), number of each piece, and the different pieces.

    Some texts are cut at a time, and numbered before the next are, so that a slice is
    never held in all its forms.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    blocks = (np.cumsum(sizes, dtype=np.int64) - sizes) // CUT_BYTES  # by where a text begins
    at = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(texts)]
    bounds, found, total = [np.zeros(1, np.int64)], [], 0
    for a, b in zip(at, at[1:], strict=False):
        whole = texts.slice(a, b - a).cast(pa.large_string()).take(pa.array(np.arange(b - a)))  # a copy without offset, as ascii_lower misplaces those of slices
        cut = own.cut(pc.fill_null(whole, ""))
        found.append(cut.flatten().dictionary_encode())
        bounds.append(np.asarray(cut.offsets)[1:] - cut.offsets[0].as_py() + total)
        total += len(found[-1])
    flat = pa.chunked_array(found).unify_dictionaries()
    numbers, pieces = np.concatenate([x.indices.to_numpy() for x in flat.chunks]), flat.chunk(0).dictionary.to_numpy(zero_copy_only=False).tolist()
    del cut, flat, found, whole
    pa.default_memory_pool().release_unused()  # before ids are gathered, outside Arrow
    return np.concatenate(bounds), numbers, pieces


def token_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other as 32-bit integers, and where each text begins, with the end of the last. Null texts have no ids."""
    own = _worker(path, "ids")
    if own.cut is None:
        each = own.encode([x or "" for x in texts.to_pylist()])
        sizes = np.array([len(x) // 4 for x in each], np.int64)
        return np.frombuffer(b"".join(each), "<u4"), np.concatenate(([0], np.cumsum(sizes)))
    bounds, numbers, pieces = _pieces(own, texts)
    values = own.values(pieces)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    first = np.cumsum(sizes) - sizes
    known = np.frombuffer(b"".join(values), "<u4")
    blocks = [numbers[s : s + GATHERED] for s in range(0, len(numbers), GATHERED)]
    out, starts, s, a = np.empty(sum(int(sizes[x].sum()) for x in blocks), np.uint32), np.zeros(len(bounds), np.int64), 0, 0
    for some in blocks:
        n = sizes[some]
        ends = np.cumsum(n)
        out[a : a + ends[-1]] = known[np.repeat(first[some] - ends + n, n) + np.arange(ends[-1])]
        i, j = np.searchsorted(bounds, (s, s + len(some)), "right")  # texts that begin after the block's first piece and not after its end
        starts[i:j] = ends[bounds[i:j] - s - 1] + a
        s, a = s + len(some), a + int(ends[-1])
    return out, starts


def token_counts(path: str, texts: pa.Array) -> np.ndarray:
    """How many ids each text has."""
    own = _worker(path, "lengths")
    if own.cut is None:
        return np.array(own.encode([x or "" for x in texts.to_pylist()]), np.int64)
    bounds, numbers, pieces = _pieces(own, texts)
    total = np.concatenate(([0], np.cumsum(np.array(own.values(pieces), np.int64)[numbers])))[bounds]
    return total[1:] - total[:-1]
