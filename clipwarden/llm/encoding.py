"""Whole-text encoding with the tokenizers library, with repeated pieces remembered.

Made for byte-level BPE with the usual split into words: a blank (or one line
end) between two visible characters always starts a new piece, and so does an
ASCII sign after a letter.  Texts are cut only at such places, pieces met before
are not encoded again, and a text with any other white space goes to the library
whole.  The ids equal those of the whole text.
"""

from __future__ import annotations

from struct import pack

import numpy as np

REMEMBERED = 300_000  # pieces of a generation; a worker keeps the newest two
_AT_ONCE = 64  # texts whose new pieces are learnt together

_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(tokenizer_file: str, plain_specials: bool = False) -> "Encoder":
    """The encoder of this worker process; with ``plain_specials`` strings of special tokens are ordinary text."""
    key = tokenizer_file, plain_specials
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_file, plain_specials)
    return _encoders[key]


def _bytes(ids) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts, put together from those of their pieces.

    Rare pieces are forgotten again: those asked for since the last full
    generation are kept, and the generation before.
    """

    def __init__(self, tokenizer_file: str, plain_specials: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps the cores busy
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(tokenizer_file)
        t.encode_special_tokens = plain_specials
        self.by_piece = (
            t.normalizer is None and isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel)
            and not t.pre_tokenizer.add_prefix_space and type(t.model).__name__ == "BPE"
        )
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        if self.by_piece:
            # one character of a byte-level entry is one byte
            self.widths = np.zeros(t.get_vocab_size(), np.int64)
            for entry, number in t.get_vocab().items():
                self.widths[number] = len(entry)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tail(self, signs: str) -> bytes:
        if signs not in self.tails:
            if len(self.tails) > REMEMBERED:
                self.tails.clear()
            self.tails[signs] = self.whole([signs])[0]
        return self.tails[signs]

    def _learn_words(self, words: list[str], before: str, known: dict[str, bytes]) -> None:
        """Ids of runs of letters with a blank or line end before each: encoded as one text and cut where the words end."""
        if not words:
            return
        ids = np.array(self.tokenizer.encode_batch_fast([before + before.join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum(self.widths[ids])
        stops = np.cumsum([len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in words])
        cuts = np.searchsorted(ends, stops)
        if not (ends[cuts] == stops).all():
            raise ValueError("the split of this tokenizer does not end with a word")
        raw, start = ids.tobytes(), 0
        for word, cut in zip(words, (4 * (cuts + 1)).tolist()):
            known[word] = raw[start:cut]
            start = cut

    def _learn(self, pieces: set[str]) -> None:
        """Learns pieces: 'x' stands for ' x', '\\nx' for itself; what can't be cut out becomes None."""
        words, rest, lines = [], [], {}
        for piece in pieces:
            if (found := self.older.get(piece)) is not None:
                self.known[piece] = found
            elif piece.isalpha():
                words.append(piece)
            else:
                rest.append(piece)
        heads = {}
        for piece in rest:
            line = piece[:1] == "\n"
            body = piece[1:] if line else piece
            if body and not body[0].isspace() and not body[-1].isspace() and (head := body.rstrip(_SIGNS)).isalpha():
                heads[piece] = head
                if line:
                    lines[head] = b""
        words += {h for p, h in heads.items() if p[0] != "\n" and h not in self.known and h not in pieces}
        self._learn_words(words, " ", self.known)
        self._learn_words(list(lines), "\n", lines)
        for piece in rest:
            self.known[piece] = self._put_together(piece, heads.get(piece), lines)

    def _put_together(self, piece: str, head: str | None, lines: dict[str, bytes]) -> bytes | None:
        line = piece[:1] == "\n"
        body = piece[1:] if line else piece
        if head is not None:
            ids = lines[head] if line else self.known[head]
            return ids + self._tail(body[len(head):]) if len(body) > len(head) else ids
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        return self.whole([piece if line else " " + piece])[0]

    def _pieced(self, texts: list[str], prefix: str, skip: int) -> list[bytes]:
        out = []
        for at in range(0, len(texts), _AT_ONCE):
            pieces, ends = [], []
            for text in texts[at : at + _AT_ONCE]:
                pieces += (prefix + text).replace("\n", " \n")[len(prefix):].split(" ")
                ends.append(len(pieces))
            got = list(map(self.known.get, pieces))
            gaps = [k for k, ids in enumerate(got) if ids is None]
            if gaps:
                self._learn({pieces[k] for k in gaps})
                for k in gaps:
                    got[k] = self.known[pieces[k]]
            start = 0
            for text, end in zip(texts[at : at + _AT_ONCE], ends):
                try:
                    out.append(b"".join(got[start:end])[skip:])
                except TypeError:
                    out.append(None)
                start = end
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
        return out

    def rest(self) -> None:
        """At the end of a task: only the newest pieces stay in the memory of the waiting worker."""
        self.older = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_piece:
            return self.whole(texts)
        # the first piece has no blank before it: it gets a line end, which is taken off again
        found = self._pieced(texts, "\n", len(self._tail("\n")))
        return [b"" if not text else self.whole([text])[0] if ids is None else ids for text, ids in zip(texts, found)]

    def encode_after_blank(self, texts: list[str]) -> list[bytes]:
        """The same of each text with a blank put before it."""
        if not self.by_piece:
            return self.whole([" " + text for text in texts])
        found = self._pieced(texts, "", 0)
        return [self.whole([" " + text])[0] if ids is None else ids for text, ids in zip(texts, found)]


_BLANK = "▁"  # how a sentence-piece model writes a blank
_piece_encoders: dict[str, "PieceEncoder"] = {}


def piece_encoder(model_file: str) -> "PieceEncoder":
    """The sentence-piece encoder of this worker process."""
    if model_file not in _piece_encoders:
        _piece_encoders[model_file] = PieceEncoder(model_file)
    return _piece_encoders[model_file]


class PieceEncoder:
    """Ids by a sentence-piece BPE model that puts a blank before each text.

    Where no entry of the vocabulary holds a blank behind another sign, no merge
    crosses the place before a blank, and words separated by single blanks are
    encoded once while they are remembered.  Other texts go to the library whole.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.entries = [
            bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(_BLANK, " ").encode()
            for i in range(m.get_piece_size())
        ]
        self.starts = np.array([m.id_to_piece(i)[:1] == _BLANK for i in range(m.get_piece_size())])
        self.by_word = not any(_BLANK in m.id_to_piece(i).lstrip(_BLANK) for i in range(m.get_piece_size()))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [_bytes(ids) for ids in self.model.encode(texts, num_threads=1)]

    def _learn(self, words: set[str]) -> None:
        new = []
        for word in words:
            if (found := self.older.get(word)) is not None:
                self.known[word] = found
            else:
                new.append(word)
        if not new:
            return
        ids = np.array(self.model.encode(" ".join(new)), "<u4")
        cuts = np.flatnonzero(self.starts[ids])
        if len(cuts) == len(new) and cuts[0] == 0:
            raw = ids.tobytes()
            bounds = (4 * np.r_[cuts, len(ids)]).tolist()
            self.known.update(zip(new, (raw[a:b] for a, b in zip(bounds, bounds[1:]))))
        else:
            self.known.update(zip(new, self.whole(new)))

    def rest(self) -> None:
        self.older = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for at in range(0, len(texts), _AT_ONCE):
            words, ends = [], []
            for text in texts[at : at + _AT_ONCE]:
                parts = text.split(" ")
                if self.by_word and "" not in parts and _BLANK not in text:
                    words += parts
                ends.append(len(words))
            got = list(map(self.known.get, words))
            gaps = [k for k, ids in enumerate(got) if ids is None]
            if gaps:
                self._learn({words[k] for k in gaps})
                for k in gaps:
                    got[k] = self.known[words[k]]
            start = 0
            for text, end in zip(texts[at : at + _AT_ONCE], ends):
                out.append(b"".join(got[start:end]) if end > start else self.whole([text])[0])
                start = end
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
        return out
