"""Token ids by the tokenizers library, each distinct piece of a stretch of text being encoded once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Pieces that a worker remembers, and stretches of text in which a new one must come again to stay remembered.
REMEMBERED, TRIED = 1_000_000, 4
#: Bytes of text encoded together, and pieces that the library gets joined: both bound a worker's memory.
AT_ONCE, JOINED = 5_000_000, 128

#: Letters of the blocks up to Cyrillic, and the marks after them that are a token run of their own.
_MARKS = ".,!?;:%&*#$|)]}\"/-"
_WORD_AND_MARKS = r"^(?P<word>[ \n]?\pL+)(?P<marks>[" + re.escape(_MARKS) + "]+)$"
_BEYOND_CYRILLIC = r"[^\x{0}-\x{4ff}]"
#: What normalization changes or what lowers by context, or to more than one character.
_NOT_SIMPLY_LOWERED = r"[^\x{0}-\x{12f}\x{131}-\x{2ff}]"
#: Two characters in a row that are white space to str.isspace(), and a piece with none but a space before it.
_ADJACENT_SPACE = r"[\t-\r\x1c-\x20\x{85}\pZ]{2}"
_SPACE_FREE = r"^[ ]?[^\t-\r\x1c-\x20\x{85}\pZ]+$"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, Encoder] = {}


def _gathered(flat: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of ``flat`` one after the other, and where each begins and the last ends."""
    taken = sizes[at]
    ends = np.concatenate([[0], np.cumsum(taken)])
    return flat[np.repeat(firsts[at] - ends[:-1], taken) + np.arange(ends[-1])], ends


class Encoder:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False).ids``.

    The strings of special tokens are ordinary text. Where the tokenizer's rules show that no token
    spans the place, texts are cut there and the library encodes each distinct piece of about AT_ONCE bytes once:

    - byte-level rules that take a space into the next token: at a space between two characters that
      aren't white space, and, if a text never has two white-space characters in a row, before
      each line feed too;
    - rules that split on white space and drop it: at every space and line feed, and, if they
      lower-case and the piece is Latin, after lower-casing it.

    Of such a piece, letters and the marks that end it are never in one token, so they are encoded
    apart, which leaves fewer distinct pieces. Other tokenizers encode texts whole.

    Pieces are split off, told apart, looked up and put together again as columns; Python sees only
    those that the library is asked for. The pieces used last are remembered, so memory is bounded; those
    that don't come again soon are not, since every look-up takes time for all that are remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        rules = json.loads(self.tokenizer.to_str())
        before, first = rules.get("normalizer"), rules.get("pre_tokenizer") or {}
        parts = first.get("pretokenizers", [first])
        self.lower = "Lowercase" in str(before)
        self.pieces: Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]] = self._whole
        self.separator = ""
        if before is None and len(parts) == 1 and parts[0].get("type") == "ByteLevel" and parts[0].get("use_regex") and not parts[0].get("add_prefix_space"):
            self.pieces, self.separator = self._before_spaces, "\n"
        elif parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", ""):
            self.pieces, self.separator = self._at_spaces, " | "
        mark = self._alone(self.separator.strip(" ")) if self.separator else []
        self.mark = mark[0] if len(mark) == 1 else None
        # what is remembered: piece k has the ids flat[firsts[k]:firsts[k] + sizes[k]]; piece 0 is the empty one
        self.known, self.flat = pa.array([""]), np.zeros(0, "<u4")
        self.firsts, self.sizes, self.used, self.learnt, self.turn = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), 0

    def _alone(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    # Each returns the pieces of some texts, the number of the piece at each place, and the places before each text and at the end.

    def _whole(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        coded = texts.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.arange(len(texts) + 1)

    def _at_spaces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary
        if self.lower:
            names = pc.if_else(pc.match_substring_regex(names, _NOT_SIMPLY_LOWERED), names, pc.utf8_lower(names))
        return names, coded.indices.to_numpy(), lists.offsets.to_numpy()

    def _before_spaces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        spaced = pc.match_substring_regex(texts, _ADJACENT_SPACE)
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(spaced, "", texts), "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        raw, at, ends = coded.dictionary, coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
        names = pc.if_else(pc.starts_with(raw, "\n"), raw, pc.binary_join_element_wise("", raw, " "))
        heads, where = np.unique(at[ends[:-1]], return_inverse=True)  # a text's first piece follows no space
        at[ends[:-1]] = len(names) + where
        names = pa.concat_arrays([names, raw.take(pa.array(heads))])
        many = np.flatnonzero(spaced.to_numpy(zero_copy_only=False))
        if not len(many):
            return names, at, ends
        more: dict[str, int] = {}
        sizes, full, own = np.diff(ends), [], []
        for k in many.tolist():
            head, *rest = _LONE_SPACE.split(texts[k].as_py())
            own.append(np.fromiter((more.setdefault(x, len(names) + len(more)) for x in (head, *[" " + x for x in rest])), np.int64))
            sizes[k] = len(own[-1])
        full = np.concatenate([[0], np.cumsum(sizes)])
        out, theirs = np.empty(full[-1], np.int64), np.zeros(full[-1], bool)
        for k, x in zip(many.tolist(), own):
            out[full[k] : full[k + 1]] = x
            theirs[full[k] : full[k + 1]] = True
        out[~theirs] = np.delete(at, ends[many])  # but for the empty stand-ins
        return pa.concat_arrays([names, pa.array(list(more), pa.string())]), out, full

    def _asked(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The library's ids of distinct pieces, one after the other, the number of each, and the pieces in that order.

        Those without white space but a space before them go joined, a token that they can't have between them.
        """
        hard = pieces
        flats, sizes, order = [], [], []
        if self.mark is not None:
            alike = pc.and_not(pc.match_substring_regex(pieces, _SPACE_FREE), pc.match_substring(pieces, self.separator.strip(" ")))
            easy, hard = pieces.filter(alike), pieces.filter(pc.invert(alike))
            for k in range(0, len(easy), 64 * JOINED):
                some = easy.slice(k, 64 * JOINED)
                offsets = np.append(np.arange(0, len(some), JOINED), len(some))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), some), self.separator)
                for i, x in enumerate(self.tokenizer.encode_batch_fast(joined.to_pylist(), add_special_tokens=False)):
                    n = int(offsets[i + 1] - offsets[i])
                    ids = np.array(x.ids, "<u4")
                    cuts = np.flatnonzero(ids == self.mark)
                    group = some.slice(i * JOINED, n)
                    if len(cuts) != n - 1:
                        hard = pa.concat_arrays([hard, group])
                        continue
                    flats.append(np.delete(ids, cuts))
                    sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                    order.append(group)
        for k in range(0, len(hard), 20_000):
            some = hard.slice(k, 20_000)
            found = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(some.to_pylist(), add_special_tokens=False)]
            flats += found
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            order.append(some)
        return np.concatenate([np.zeros(0, "<u4"), *flats]), np.concatenate([np.zeros(0, np.int64), *sizes]), pa.concat_arrays([pa.array([], pa.string()), *order])

    def _parted(self, names: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of each piece the letters, or all of it, and the marks after them, or nothing."""
        word, marks = names, pa.array([""] * len(names))
        marked = pc.less(pc.binary_length(pc.utf8_rtrim(names, characters=_MARKS)), pc.binary_length(names)) if self.separator else None
        if marked is not None and pc.any(marked).as_py():
            found = pc.extract_regex(names.filter(marked), _WORD_AND_MARKS)
            words = found.field("word")
            apart = pc.fill_null(pc.and_(pc.is_valid(found), pc.invert(pc.match_substring_regex(words, _BEYOND_CYRILLIC))), False)
            word = pc.replace_with_mask(word, marked, pc.if_else(apart, words, names.filter(marked)))
            marks = pc.replace_with_mask(marks, marked, pc.if_else(apart, found.field("marks"), ""))
        return word, marks

    def _places(self, names: pa.Array) -> np.ndarray:
        """Where the two parts of each piece are remembered; what isn't is asked for and remembered."""
        parts = pa.concat_arrays(self._parted(names))
        at = pc.fill_null(pc.index_in(parts, value_set=self.known), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = parts.take(pa.array(missing))
            flat, sizes, order = self._asked(pc.unique(new))
            at[missing] = len(self.known) + pc.index_in(new, value_set=order).to_numpy()
            self.firsts = np.concatenate([self.firsts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            self.known, self.used = pa.concat_arrays([self.known, order]), np.concatenate([self.used, np.zeros(len(order), np.int64)])
            self.learnt = np.concatenate([self.learnt, np.full(len(order), self.turn + 1)])
        self.turn += 1
        self.used[at] = self.turn
        return at.reshape(2, -1).T

    def _forget(self) -> None:
        """Drops the pieces that were not used again after TRIED stretches, and if too many are left, all but the half that were used last."""
        if len(self.known) <= REMEMBERED and self.turn % TRIED:
            return
        kept = (self.used > self.learnt) | (self.learnt > self.turn - TRIED)
        kept[0] = True
        kept = np.flatnonzero(kept)
        if len(kept) > REMEMBERED:
            kept = np.concatenate([[0], np.sort(kept[1:][np.argsort(-self.used[kept[1:]], kind="stable")[: REMEMBERED // 2]])])
        self.flat, ends = _gathered(self.flat, self.firsts, self.sizes, kept)
        self.known, self.firsts, self.sizes = self.known.take(pa.array(kept)), ends[:-1], self.sizes[kept]
        self.used, self.learnt = self.used[kept], self.learnt[kept]

    def groups(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of stretches of the texts, in order, of about AT_ONCE bytes each or one text: text i of a stretch has ids[ends[i]:ends[i + 1]]. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        so_far = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(so_far, (so_far[start - 1] if start else 0) + AT_ONCE, "right")))
            names, at, ends = self.pieces(pa.concat_arrays([texts.slice(start, stop - start)]))  # offsets from 0
            start = stop
            slots = self._places(names)
            flat, parts = _gathered(self.flat, self.firsts, self.sizes, slots.ravel())
            ids, places = _gathered(flat, parts[:-1:2], np.diff(parts[::2]), at)
            self._forget()
            yield ids, places[ends]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids, one value for each text."""
        return [ids[a:b].tobytes() for ids, ends in self.groups(pa.array(list(texts), pa.string())) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it outlives a task, so later tasks find its words."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
