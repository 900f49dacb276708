"""SentencePiece encoding and decoding of merge-type (BPE) models, exact and without an agenda of merges.

A sequence of pieces is what merging gives if and only if every two neighbours, merged again from their characters,
come out as themselves. So pieces are taken greedily, the longest match first (an Aho-Corasick automaton finds the
longest piece at every place), each is tried against the piece before it, and where none fits the search steps back.
A bit field keeps the places from which no continuation exists, so no place fails twice and the work is linear.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from .minhash import slices

#: Pairs of pieces, and words of each of two generations, whose results a Python worker keeps; longer words are encoded anew.
PAIRS_KEPT, WORDS_KEPT, LONGEST_KEPT = 1 << 17, 1 << 18, 48
SPACE = "▁"
#: The rank of what is no piece.
NEVER = 1 << 60


def default_model() -> str:
    """Place of the merge-type model, read by the executors from their own Python installation."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class MergeEncoder:
    """The ids that the sentencepiece library gives for a merge-type model without user-defined and unused pieces.

    Characters that are no piece stand for themselves; their ids are those of their bytes if the model has such
    pieces, else one unknown id for each run of them.
    """

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in every):
            raise ValueError("models with unused pieces are not encoded")
        self.ids = {sp.id_to_piece(i): i for i in every if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
        order = {score: k for k, score in enumerate(sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True))}
        #: Place of each merge in the order of merging; single characters are there from the start.
        self.rank = {p: order[sp.get_score(i)] for p, i in self.ids.items() if len(p) > 1}
        self.bytes = [i for i in every if sp.is_byte(i)]
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.most, self.starts = max(map(len, self.ids)), {p[0] for p in self.ids}
        # No merge reaches over a place where a word ends and a space begins, unless some piece does.
        joins = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.words = re.compile(r"(?s).+" if joins else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.fitting = lru_cache(PAIRS_KEPT)(self._next)
        self.shorter = lru_cache(PAIRS_KEPT)(self._shorter)
        # Nor over one before a mark that follows no letter in any piece.
        after = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        marks = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after)
        self.ends = re.compile(f"(?<=[a-zA-Z])(?=[{re.escape(marks)}])" if marks else "(?!)")
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """Merging by the book: the pair of neighbours that ranks first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while True:
            best, at = NEVER, 0
            for k, pair in enumerate(map(add, parts, parts[1:])):
                if (r := rank.get(pair, NEVER)) < best:
                    best, at = r, k
            if best == NEVER:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, before: str, piece: str) -> bool:
        """Whether the two, merged again, stay apart; without a piece before, whether merging makes this piece."""
        return self.merged(before + piece) == ([before, piece] if before else [piece])

    def _shorter(self, piece: str) -> str:
        """The longest proper prefix that is a piece or one character; empty if there is none."""
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.ids), "")

    def _next(self, before: str, piece: str) -> str:
        """The piece itself or its longest prefix that fits the piece before; empty if none does."""
        while piece and not self._fits(before, piece):
            piece = self.shorter(piece)
        return piece

    def _longest(self, text: str, at: int) -> str:
        """The longest piece that starts at a place, else its character."""
        if text[at] in self.starts:
            for end, piece in self.automaton.iter_long(text[at : at + self.most]):
                return piece if end + 1 == len(piece) else text[at]
        return text[at]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalised text."""
        fitting, shorter, longest, size = self.fitting, self.shorter, self._longest, len(text)
        out, at, last, failed = [], 0, "", None
        # Where the longest matches, one after another, fit, there is nothing to search.
        for end, piece in self.automaton.iter_long(text) if size <= LONGEST_KEPT else ():
            if end - len(piece) + 1 != at or fitting(last, piece) != piece:
                break
            out.append(piece)
            at, last = end + 1, piece
        if at == size:
            return out
        piece = fitting(last, longest(text, at))
        while True:
            if failed is not None:
                while piece and failed[(stop := at + len(piece)) >> 3] >> (stop & 7) & 1:
                    piece = fitting(last, shorter(piece))
            if piece:
                out.append(piece)
                at, last = at + len(piece), piece
                if at == size:
                    return out
                piece = fitting(last, longest(text, at))
            else:
                failed = bytearray(size // 8 + 1) if failed is None else failed
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(last)
                piece = shorter(out.pop())
                last = out[-1] if out else ""
                piece = fitting(last, piece)

    def _ids(self, text: str) -> tuple[int, ...]:
        found = self.pieces(text)
        try:
            return tuple([self.ids[p] for p in found])
        except KeyError:
            out = []
        for p in found:
            if (known := self.ids.get(p)) is not None:
                out.append(known)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            elif not out or out[-1] != self.library.unk_id():
                out.append(self.library.unk_id())
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a word that was not met lately; its parts before marks are looked up on their own."""
        ids = self.older.get(word)
        if ids is None:
            parts = self.ends.split(word)
            ids = self._ids(word) if len(parts) == 1 or not self.bytes else tuple(i for part in parts for i in self.kept.get(part) or self._word(part))
        if len(word) <= LONGEST_KEPT:
            if len(self.kept) >= WORDS_KEPT:
                self.kept, self.older = {}, self.kept
            self.kept[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without begin and end."""
        out: list[int] = []
        for word in self.words.findall(self.library.normalize(text)):
            ids = self.kept.get(word) or self._word(word)
            if not self.bytes and out and ids[0] == out[-1] == self.library.unk_id():
                ids = ids[1:]
            out += ids
        return out


@lru_cache(maxsize=2)
def merge_encoder(path: str) -> MergeEncoder:
    return MergeEncoder(path)


def encoded(docs: DataFrame, model: str | None = None, end: bool = True) -> DataFrame:
    """(doc_id, ids) for every row of docs (doc_id, text, any other columns): the whole text's ids, then the end id.

    Null texts count as empty: the end id alone. Repeated rows are encoded each; doc_id may be null. Very long texts
    and very long words take time in proportion to their length; an empty table stays empty.
    """
    path = model or default_model()

    def run(batches):
        encoder = merge_encoder(path)
        last = [encoder.library.eos_id()] if end else []
        for batch in batches:
            for part in slices(batch, 1):
                ids = [encoder.encode(t or "") + last for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """rows (doc_id, ids) with text, by the library's decoder. Null ids give null."""
    path = model or default_model()

    def run(batches):
        library = merge_encoder(path).library
        for batch in batches:
            texts = [None if ids is None else library.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs, of what `encoded` and `decoded` give.

    Ids and decoded texts stay in the task, a few MB at a time; digests leave it.
    """
    path = model or default_model()

    def run(batches):
        encoder = merge_encoder(path)
        library, last = encoder.library, encoder.library.eos_id()
        written = [str(i) for i in range(library.get_piece_size())]
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            for part in slices(batch, 1):
                size, of_ids, of_text = [], [], []
                for text in part.column(1).to_pylist():
                    ids = encoder.encode(text or "")
                    ids.append(last)
                    size.append(len(ids))
                    of_ids.append(digest(" ".join([written[i] for i in ids])))
                    of_text.append(digest(library.decode(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
