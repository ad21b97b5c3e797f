"""Encoding and decoding with a SentencePiece merge model by a table of prefixes.

A sequence of tokens is the merge result of its text exactly if every two neighbours are the
merge result of theirs, so each prefix of a text has one last token.  The table stores that
token for every prefix: among the pieces an automaton finds ending there, it is the one that
is compatible with the last token before it.  Ids are read backwards from the full text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.llm.common import for_python, rows_of, whole_text

SPACE = "▁"
WORDS_KEPT = 250_000  # encoded words a task remembers before it forgets the older half; no effect on results


class PieceModel:
    """Pieces, scores and byte tokens of a merge model, and the prefix table over them.

    Supported are models with byte fallback that turn spaces into U+2581, put one before the text and otherwise leave
    it as it is, as the published merge vocabularies do; anything else is refused.
    Pieces of spaces alone share the lowest score, all others differ in theirs.
    """

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        if lib.encode(" a  b", out_type=str) != lib.encode(SPACE + "a" + SPACE * 2 + "b", out_type=str) or not lib.encode("a", out_type=str)[0].startswith(SPACE):
            raise ValueError("The model's normalisation is not supported")
        ids = [i for i in range(lib.get_piece_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.piece = {i: lib.id_to_piece(i) for i in ids}
        self.id = {p: i for i, p in self.piece.items()}
        self.byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(lib.get_piece_size()) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.score = {p: lib.get_score(i) for i, p in self.piece.items()}
        self.runs = {len(p) for p in self.id if p.strip(SPACE) == ""}
        merged = [s for p, s in self.score.items() if len(p) > 1 and p.strip(SPACE)]
        low = max((self.score[SPACE * n] for n in self.runs if n > 1), default=float("-inf"))
        inside = re.compile(f"[^{SPACE}]{SPACE}|{SPACE}{SPACE}[^{SPACE}]|\n")
        if len(set(merged)) < len(merged) or len(self.byte) < 256 or min(merged, default=0) <= low or any(inside.search(p) for p in self.id):
            raise ValueError("The model's pieces are not supported")
        self.found = ahocorasick.Automaton()
        for p, i in self.id.items():
            if p.strip(SPACE) or len(p) == 1:
                self.found.add_word(p, (i, len(p)))
        self.found.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._single: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The merge result by its definition, for short texts: the best pair first, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stands(self, token: int) -> bool:
        known = self._single.get(token)
        if known is None:
            known = self._single[token] = self.merged(self.piece[token]) == [self.piece[token]]
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether the two tokens are the merge result of their joined text."""
        known = self._pairs.get((left, right))
        if known is None:
            a, b = self.piece[left], self.piece[right]
            known = self._pairs[left, right] = self.merged(a + b) == [a, b]
        return known

    def word(self, text: str) -> list[int]:
        """Ids of a text with at most one space mark, at its start."""
        last = [-1] * len(text)  # token that ends the prefix; -1 for a character without piece
        sizes = [1] * len(text)
        pairs, alone = self._pairs, self._single
        for end, (token, size) in self.found.iter(text):
            if last[end] >= 0:
                continue
            before = end - size
            left = last[before] if before >= 0 else -1
            fits = pairs.get((left, token)) if left >= 0 else alone.get(token)
            if fits is None:
                fits = self._fits(left, token) if left >= 0 else self._stands(token)
            if fits:
                last[end] = token
                sizes[end] = size
        ids: list[int] = []
        end = len(text) - 1
        while end >= 0:
            if last[end] >= 0:
                ids.append(last[end])
            else:
                ids.extend(self.byte[b] for b in reversed(text[end].encode()))
            end -= sizes[end]
        return ids[::-1]

    def spaces(self, count: int) -> list[int]:
        """Ids of a run of space marks: all its pieces tie, so the leftmost pair merges first."""
        parts: list[int] = []
        while True:
            if len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                parts[-2:] = [parts[-2] + parts[-1]]
            elif count and parts and parts[-1] + 1 in self.runs:
                parts[-1] += 1
                count -= 1
            elif count:
                parts.append(1)
                count -= 1
            else:
                return [self.id[SPACE * n] for n in parts]

    def part(self, text: str) -> list[int]:
        """Ids of space marks followed by a word, or of a line break.

        No piece has two marks before other characters and run pieces merge last, so the last mark
        joins the word if it merges with it and the run otherwise.
        """
        body = text.lstrip(SPACE)
        marks = len(text) - len(body)
        if not body:
            return self.spaces(marks)
        if not marks:
            return self.word(body)
        ids = self.word(SPACE + body)
        if ids[0] == self.id[SPACE]:
            return self.spaces(marks) + ids[1:]
        return self.spaces(marks - 1) + ids

    #: No piece goes on over a line break, or from a word into a space mark.
    PARTS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")

    def parts(self, text: str) -> list[str]:
        return self.PARTS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text) for i in self.part(p)]

    def raw(self, ids: list[int]) -> bytes:
        """Bytes of the ids, space marks as spaces."""
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.piece[i].replace(SPACE, " ").encode() for i in ids)

    def decode(self, ids: list[int]) -> str:
        """The text of the ids without the space put before it; bytes that are no UTF-8 become U+FFFD."""
        raw = self.raw(ids)
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


class Words:
    """Encoded parts of texts; remembers those met lately."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, tuple[str, bytes, int]] = {}
        self.older: dict[str, tuple[str, bytes, int]] = {}

    def __call__(self, text: str) -> list[tuple[str, bytes, int]]:
        """(ids joined by commas, decoded bytes, number of ids) of each part."""
        parts = self.model.parts(text)
        if len(self.known) >= WORDS_KEPT:
            self.known, self.older = {}, self.known
        known = self.known
        for part in parts:
            if part not in known:
                got = self.older.get(part)
                if got is None:
                    ids = self.model.part(part)
                    got = (",".join(map(str, ids)), self.model.raw(ids), len(ids))
                known[part] = got
        return [known[part] for part in parts]


def encoded(docs: DataFrame, path: str, keep: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]): one row for each input row.

    Whole texts are encoded without begin or end ids, then decoded; null and empty texts give
    no ids.  `ids` (array of int) and `decoded` come if `keep`.  Repeated rows, null ids and
    empty tables pass as they are; other columns are not read.  `path` is the model file, the
    same on every executor.  Rows are independent: no shuffle, and a lost task is run again.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model_at(path))
        for doc_ids, texts in rows_of(batches, "doc_id", "text"):
            rows: dict[str, list] = {name.split()[0]: [] for name in schema.split(", ")}
            for doc_id, text in zip(doc_ids, texts):
                got = words(text.decode("utf-8", "replace"))
                plain = b"".join([g[1] for g in got])
                plain = (plain[1:] if plain.startswith(b" ") else plain).decode("utf-8", "replace")
                rows["doc_id"].append(doc_id)
                rows["n_tokens"].append(sum([g[2] for g in got]))
                rows["ids_sha256"].append(hashlib.sha256(",".join([g[0] for g in got]).encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(plain.encode()).hexdigest())
                if keep:
                    rows["ids"].append([int(i) for g in got for i in g[0].split(",")])
                    rows["decoded"].append(plain)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return for_python(read).mapInArrow(run, schema)
