"""SentencePiece encoding and decoding by streaming Viterbi.

A text is written with a leading "▁" and "▁" for each space, and cut into pieces
of the vocabulary so that the sum of their scores is largest.  The best path is
found from left to right: from each position all pieces that start there are tried, as
long as some piece goes on, so only the next *max piece length* positions are
open.  Every way on from here starts in that window; where the backpointer paths
of all its positions meet in one boundary, everything before is settled, its ids
are committed and forgotten.

Some boundaries are certain without looking: if no piece has "▁" after another
character, each run of spaces starts a new piece, and if no piece has a newline
in it, newlines stand alone; a mark that follows a letter in no piece starts a
new one, too.  Between certain boundaries the best path depends
on that stretch alone, so the ids of short stretches are remembered.

The vocabulary file is a parameter.  Its scores are merge ranks; the score of a
piece here is the logarithm of its Zipf probability by rank, as a whole number,
so that sums are exact.  Of equal paths the one whose last piece is longest wins.
A character without a piece is written as its UTF-8 bytes, which makes decoding
the exact inverse of encoding, also for a literal "▁".

Defined cases: null and empty texts have no ids and decode to the empty text;
repeated rows encode alike; an empty table stays empty; further columns are
kept by ``encode``, and one that is called ``ids`` is replaced.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.shingles import slices
from tillroll.llm.text import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal "▁" of the text; a lone surrogate, which no text holds.
LITERAL = "\ud800"
#: Marks a certain boundary within a run of characters; another lone surrogate.
CUT = "\ud801"
LETTER, MARKS = "[A-Za-z\u00c0-\u024f]", r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Whole-number score units, and the cost of a byte: dearer than any piece.
UNIT, BYTE_COST = 10_000, 250_000
#: Stretches up to this length are remembered, so many at a time.
SHORT, REMEMBERED = 48, 300_000


class Vocabulary:
    """Pieces, their scores and ids, bytes for decoding, and which boundaries are certain."""

    def __init__(self, pieces: list[tuple[str, int]], bytes_at: dict[int, int]):
        """``pieces``: (piece, rank) at its id's place, or ("", -1) for none; ``bytes_at``: byte -> id."""
        self._encoder = self._tree = None
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if p}
        self.scores = {p: -round(UNIT * math.log((r + 2.7) * 10.4)) for p, r in pieces if p}
        self.bytes_at = bytes_at
        self.longest = max(map(len, self.ids), default=1)
        #: Every beginning of a piece: its score if it is a piece, None if it only goes on (scores are below 0).
        self.heads = {p[:n]: None for p in self.ids for n in range(1, len(p))} | self.scores
        self.written = [p.replace(SPACE, " ").encode() for p, _ in pieces]
        for b, i in bytes_at.items():
            self.written[i] = bytes([b])
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        lines = any("\n" in p and len(p) > 1 for p in self.ids)
        self.stretches = re.compile(
            "(?s:.+)" if inner or lines else f"\n|{SPACE}+[^{SPACE}{CUT}\n]*|[^{SPACE}{CUT}\n]+"
        )
        joined = re.compile(f"{LETTER}(?=([{re.escape(MARKS)}]))")
        follow = {m for p in self.ids for m in joined.findall(p)}
        free = "" if inner or lines else "".join(m for m in MARKS if m not in follow)
        self.joints = re.compile(f"(?<={LETTER})(?=[{re.escape(free)}])") if free else None

    def tree(self) -> dict:
        """The pieces by character: character -> (score or None, what goes on from there)."""
        if self._tree is None:
            self._tree = {}
            for head in sorted(self.heads, key=len):
                level = self._tree
                for c in head[:-1]:
                    level = level[c][1]
                level[head[-1]] = (self.heads[head], {})
        return self._tree

    def encoder(self) -> Encoder:
        """One encoder per worker process, which later tasks find with what it remembers."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_at = [], {}
        for i in range(model.vocab_size()):
            if model.is_byte(i):
                bytes_at[int(model.id_to_piece(i)[3:5], 16)] = i
            plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            pieces.append((model.id_to_piece(i), max(0, round(-model.get_score(i)))) if plain else ("", -1))
        return cls(pieces, bytes_at)


def _ids(vocabulary: Vocabulary, text: str, cuts: list[int]) -> list[int]:
    """Ids of the pieces between consecutive cuts."""
    out = []
    for a, b in zip(cuts, cuts[1:]):
        piece = text[a:b]
        if piece in vocabulary.ids:
            out.append(vocabulary.ids[piece])
        else:
            out += [vocabulary.bytes_at[x] for x in (SPACE if piece == LITERAL else piece).encode()]
    return out


def stream(vocabulary: Vocabulary, text: str):
    """Yield the ids of the best path in committed runs, from left to right."""
    heads, longest, size = vocabulary.heads, vocabulary.longest, len(text)
    base, best, back = 0, [0], [0]  # since the last committed boundary
    look = 2 * longest

    def path(end: int, begin: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > begin:
            cuts.append(back[cuts[-1] - base])
        return cuts[::-1]

    for at in range(size):
        here = best[at - base]
        one = text[at]
        score = heads.get(one)
        if score is None:
            score = -BYTE_COST * len((SPACE if one == LITERAL else one).encode())
        # All pieces from here, as long as some piece goes on; an earlier start, a longer last piece, wins ties.
        end, place = at + 1, at + 1 - base
        while True:
            if score is not None:
                if place < len(best):
                    if best[place] is None or here + score > best[place]:
                        best[place], back[place] = here + score, at
                else:
                    while len(best) < place:
                        best.append(None)
                        back.append(None)
                    best.append(here + score)
                    back.append(at)
            end, place = end + 1, place + 1
            if end > size:
                break
            score = heads.get(text[at:end], 0)
            if score == 0:
                break
        now = at + 1
        if now - base >= look and now < size:
            # The paths of all positions reached so far from which a later piece may start.
            alive = {base + i for i in range(now - base, len(best)) if best[i] is not None}
            while len(alive) > 1:
                last = max(alive)
                alive.remove(last)
                alive.add(back[last - base])
            (meet,) = alive
            if meet > base:
                yield _ids(vocabulary, text, path(meet, base))
                best, back, base = best[meet - base :], back[meet - base :], meet
                look = 2 * longest
            else:
                look *= 2  # looked at in vain: wait until there is twice as much
    if size > base:
        yield _ids(vocabulary, text, path(size, base))


def short(vocabulary: Vocabulary, text: str) -> bytes:
    """The ids of a stretch that is a window as a whole: nothing is committed before its end."""
    tree, scores, size = vocabulary.tree(), vocabulary.scores, len(text)
    best, back = [0] + [-math.inf] * size, [0] * (size + 1)
    for at in range(size):
        here, end, level = best[at], at, tree
        if text[at] not in scores:
            cost = BYTE_COST * len((SPACE if text[at] == LITERAL else text[at]).encode())
            if here - cost > best[at + 1]:
                best[at + 1], back[at + 1] = here - cost, at
        while end < size:
            node = level.get(text[end])
            if node is None:
                break
            score, level = node
            end += 1
            if score is not None and here + score > best[end]:
                best[end], back[end] = here + score, at
    ids, out, end = vocabulary.ids, [], size
    while end:
        at = back[end]
        one = ids.get(text[at:end])
        if one is not None:
            out.append(one)
        else:
            out += [vocabulary.bytes_at[x] for x in reversed((SPACE if text[at] == LITERAL else text[at]).encode())]
        end = at
    out.reverse()
    return array("i", out).tobytes()


class Encoder(dict):
    """Stretch -> its ids as the bytes of 32-bit numbers; short stretches are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, stretch: str) -> bytes:
        if len(stretch) > SHORT:
            return np.array([i for run in stream(self.vocabulary, stretch) for i in run], np.int32).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[stretch] = ids = short(self.vocabulary, stretch)
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        full = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
        if self.vocabulary.joints:
            full = self.vocabulary.joints.sub(CUT, full)
        return b"".join(map(self.__getitem__, self.vocabulary.stretches.findall(full)))


def decode_ids(vocabulary: Vocabulary, ids) -> str:
    """The text that was encoded: pieces and bytes in order, without the leading space."""
    return b"".join([vocabulary.written[i] for i in ids]).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) in place of the text column."""
    # The vocabulary has a fixed size; it is read once and sent to the tasks.
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    docs = docs.drop("ids")
    at, rest = docs.columns.index(text), [f for f in docs.schema.fields if f.name != text]

    def scan(batches):
        encoder = sent.value.encoder()
        for batch in batches:
            for part in slices(batch, at):
                runs = [encoder.encode(t) for t in part.column(at).fill_null("").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in runs])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(runs), np.int32)))
                others = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*others, ids], names=[*[f.name for f in rest], "ids"])

    return docs.mapInArrow(scan, T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with ``text`` beside ``ids``."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    at, names = encoded.columns.index("ids"), encoded.columns

    def scan(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [decode_ids(sent.value, x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    return encoded.mapInArrow(scan, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs))
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.length("text").cast("long").alias("decoded_chars"),
        F.sha2("text", 256).alias("decoded_sha256"), "ids",
    )
