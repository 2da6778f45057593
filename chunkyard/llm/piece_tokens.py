"""SentencePiece BPE by a merge-type prefix table.

For every prefix of a segment exactly one token can be the last of its encoding. An Aho-Corasick
automaton gives the vocabulary's matches that end at each position; a match is the last token if
the token that ends where it starts is compatible: merging the two tokens' characters alone gives
back the pair. Ids are then recovered from the end to the start.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import arrow_map, kept

SPACE = "▁"
#: Marks before which a word is cut off, if no piece of the model holds such a mark after a letter or digit.
MARKS = ",.;:!?|%&*#$"
_KEEP = "piece_tokens"


class Remembered(dict):
    """key -> make(key). Of the keys, the `most` latest new ones and those of the generation before are kept."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceCodec:
    """Encoder and decoder of one BPE model with byte fallback, identity normalisation and a
    dummy prefix. Texts are cut where no piece can reach across, and segments are remembered."""

    def __init__(self, model: str, most: int = 120_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.byte = [0] * 256
        self.pieces: dict[str, int] = {}
        self.raw: dict[str, bytes] = {}  # by the decimal id
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[str(i)] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[piece] = i
                self.raw[str(i)] = piece.replace(SPACE, " ").encode()
        if sp.encode("ﬁ  x") != sp.encode(sp.decode(sp.encode("ﬁ  x"))) or sp.decode(sp.encode("ﬁ  x")) != "ﬁ  x":
            raise ValueError("the model's normalisation isn't the identity")
        self.score = {p: sp.get_score(i) for p, i in self.pieces.items()}
        self.cut_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.cut_lines = not any("\n" in p and len(p) > 1 for p in self.pieces)
        joined = {y for p in self.pieces for x, y in zip(p, p[1:], strict=False) if x.isalnum()}
        marks = "".join(re.escape(m) for m in MARKS if m not in joined)
        self.parts = re.compile(rf" *[^\W_]+(?=[ \n{marks}]|\Z)| +[^ \n]*|\n|[^ \n]+")
        self.automaton = ahocorasick.Automaton()
        self.split: dict[str, tuple[str, str]] = {}  # the last merge of each piece that merging gives; others never come out
        for p in self.pieces:
            if len(p) > 1 and (halves := self.halves(p)):
                self.split[p] = halves
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits = Remembered(lambda pair: self.apart(*pair), most)
        self.decimal = Remembered(lambda token: ",".join(str(i) for i in self.token_ids(token)), most)
        self.known = Remembered(lambda part: ",".join([self.decimal[t] for t in self.tokens(part.replace(" ", SPACE))]), most)

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge, best score first and leftmost first; None if its
        characters don't merge to it."""
        parts, score = list(piece), self.score
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1])

    def apart(self, left: str, right: str) -> bool:
        """Whether merging left + right gives just these two tokens.

        Undo the two tokens' merges, the latest first. Whenever the parts that meet at the border could
        merge before the merge that is undone next had used one of them, the tokens don't stay apart. Of
        equal scores the merge further left goes first: the border's before right's, after left's."""
        score, split = self.score, self.split
        limit, ties = None, True
        while True:
            s = score.get(left + right)
            if s is not None and (limit is None or s > limit or (ties and s == limit)):
                return False
            a, b = split.get(left), split.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and score[left] < score[right]):
                limit, ties, left = score[left], False, a[1]
            else:  # right's merge is the later one; of equal ones the right one is
                limit, ties, right = score[right], True, b[0]

    def tokens(self, text: str) -> list[str]:
        """The prefix table of a segment, read backwards."""
        last = list(text)  # last[i]: the last token of text[: i + 1]; a character by itself until a match fits
        fits, done = self.fits, -1
        for end, token in self.automaton.iter(text):
            if end != done:
                start = end - len(token)
                if start < 0 or fits[last[start], token]:
                    last[end] = token
                    done = end
        out, i = [], len(text) - 1
        while i >= 0:
            token = last[i]
            out.append(token)
            i -= len(token)
        out.reverse()
        return out

    def token_ids(self, token: str) -> list[int]:
        """The id of a piece, or of a character's bytes."""
        i = self.pieces.get(token)
        return [i] if i is not None else [self.byte[b] for b in token.encode()]

    def encode(self, text: str) -> str:
        """A text's ids as decimals joined by commas."""
        if not text:
            return ""
        text = " " + text.replace(SPACE, " ")
        parts = self.parts.findall(text) if self.cut_spaces and self.cut_lines else [text]
        return ",".join(map(self.known.__getitem__, parts))

    def decode(self, ids: str) -> str:
        """The text of decimal ids joined by commas."""
        text = b"".join(map(self.raw.__getitem__, ids.split(",") if ids else ())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(model: str) -> PieceCodec:
    """One codec for each Python worker and model, while the worker runs tasks of this operator."""
    codecs = kept.setdefault(_KEEP, {})
    if model not in codecs:
        codecs[model] = PieceCodec(model)
    return codecs[model]


def piece_codes(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; if keep_ids also decoded and ids array<int>.

    ids are what the sentencepiece library gives for the whole text without begin or end marks and
    sampling; decoded is their text. Null and empty texts have no ids and decode to the empty text; an empty
    table gives no rows. Rows are independent: null or repeated ids and other columns don't matter.
    """

    def run(batches):
        c = codec(model)
        for b in batches:
            rows, ids = [], [np.empty(0, np.int32)]
            for t in b.column(1):
                joined = c.encode(t.as_py() or "")
                text = c.decode(joined)
                rows.append((len(joined) and joined.count(",") + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text if keep_ids else None))
                if keep_ids and joined:
                    ids.append(np.fromstring(joined, np.int32, sep=","))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))]
            if keep_ids:
                ends = np.cumsum([0, *(r[0] for r in rows)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "decoded", "ids"]
            k = 5 if keep_ids else 3
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *columns[:k]], names=["doc_id", *names[:k]])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", decoded string, ids array<int>" * keep_ids
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema, _KEEP)
