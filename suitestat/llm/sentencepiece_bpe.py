"""Operator 1: SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding is exact.  A token sequence is the merge result of its text if and only
if every two neighbours are: merging the text of both alone gives those two back.
So the encoder walks over the text by the longest vocabulary match (Aho-Corasick),
asks for each step whether the new token is compatible with the one before by
merging both again (the answers are kept, and so is the order in which each token
alone is merged: both orders, one within the other, until a merge would join the
two), falls back to the next shorter match where it is not, and steps back where
none is left.  The encoding of each prefix
is unique, so a position that failed once fails always: a bitfield keeps those.

Texts are cut, before that, where no vocabulary piece can reach across: before a
space mark that follows another character, and around characters that are in no
piece of two or more.  Units repeat, so their encodings are kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from suitestat.llm.common import bound_batches, release

MARK = "▁"  # the space mark
UNIT_CACHE = 200_000  # encodings kept in a worker
PAIR_CACHE = 300_000  # answers on neighbours kept in a worker


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def proto_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message: numbers and byte strings."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, raw[at : at + size]
            at += size


def check_model(raw: bytes) -> None:
    """Raise for a model that this encoder isn't exact for: not of merge type, or with a normaliser that changes more than spaces."""
    parts = {k: dict(proto_fields(v)) for k, v in proto_fields(raw) if k in (2, 3)}
    trainer, normaliser = parts.get(2, {}), parts.get(3, {})
    if trainer.get(3, 1) != 2:
        raise ValueError("the model isn't of merge type (BPE)")
    if trainer.get(24, 0):
        raise ValueError("the model puts the space mark behind words")
    if normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise ValueError("the model's normaliser changes more than spaces")


class Units(dict):
    """unit -> its ids as bytes; short ones are kept, and all are forgotten when there are too many."""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.encode = codec.encode_unit

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(unit)
        if len(unit) < 64:
            if len(self) >= UNIT_CACHE:
                self.clear()
            self[unit] = ids
        return ids


class PieceCodec:
    """Vocabulary, exact encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        check_model(sp.serialized_model_proto())
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {self.pieces[i]: i for i in range(n) if i not in special}
        self.score = {self.pieces[i]: sp.get_score(i) for i in range(n) if i not in special}
        self.trie = ahocorasick.Automaton()
        for p in self.ids:
            self.trie.add_word(p, (len(p) - 1, p))
        self.trie.make_automaton()
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = "\n" not in joined
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.ids)
        line = "\\n" if self.alone else ""
        self.unit = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+|\\n" if self.cuts else r"(?s).+")
        # What decoding puts for an id: bytes below 128 stand for themselves, others are joined with their neighbours.
        self.plain = [self.pieces[i].replace(MARK, " ") for i in range(n)]
        for i in special:
            self.plain[i] = chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else ""
        if self.unk >= 0:
            self.plain[self.unk] = " ⁇ "
        self.high = np.zeros(n, bool)
        self.high[[i for i, b in self.byte_of.items() if b > 127]] = True
        self.silent = {i for i in range(n) if sp.is_control(i)}
        # The next shorter match of each: a character stands for itself, in the vocabulary or not.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.ids), p[0]) for p in self.ids if len(p) > 1}
        self.raw = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.merges: dict[str, list[tuple[float, str, str]] | None] = {}
        self.known = Units(self)

    # ---- encoding

    def merge(self, text: str) -> list[str]:
        """The definition: merge the best neighbours, the leftmost of equals, until none is a piece."""
        parts, score = list(text), self.score
        none = float("-inf")
        gain = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while gain and (best := max(gain)) > none:
            i = gain.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = score.get(parts[i - 1] + parts[i], none)
            if i < len(gain):
                gain[i] = score.get(parts[i] + parts[i + 1], none)
        return parts

    def order(self, token: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a token of its characters: the score of each, then the parts at both ends after it; None where they don't make it."""
        parts, score, out = list(token), self.score, []
        none = float("-inf")
        while len(parts) > 1:
            gain = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
            best = max(gain)
            if best == none:
                return None
            i = gain.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            out.append((best, parts[0], parts[-1]))
        return out

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the text of both gives both: whether merge(left + right) is [left, right]."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self.apart(left, right)
        return found

    def apart(self, left: str, right: str) -> bool:
        orders = []
        for token in (left, right):
            if token not in self.merges:
                if len(self.merges) >= PAIR_CACHE:
                    self.merges.clear()
                self.merges[token] = self.order(token)
            orders.append(self.merges[token])
        one, two = orders
        if one is None or two is None:
            return False
        if not left:
            return True
        none, score = float("-inf"), self.score
        m, n, i, j, a, b = len(one), len(two), 0, 0, left[-1], right[0]
        while True:
            x = one[i][0] if i < m else none
            y = two[j][0] if j < n else none
            across = score.get(a + b, none)
            if across > x and across >= y and across > none:
                return False
            if x >= y and i < m:
                a = one[i][2]
                i += 1
            elif j < n:
                b = two[j][1]
                j += 1
            else:
                return True

    def split(self, text: str) -> list[str]:
        """The pieces of one unit by backtracking."""
        n, pairs, shorter, compatible = len(text), self.pairs, self.shorter, self.compatible
        longest = list(text)  # the longest match at each place; a character that the vocabulary doesn't have is one
        for end, (back, p) in self.trie.iter(text):
            longest[end - back] = p  # later ends are longer matches
        failed = None
        out: list[str] = []
        pos, last, token = 0, "", longest[0] if n else None
        while pos < n:
            while token is not None:
                end = pos + len(token)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get((last, token))
                    if compatible(last, token) if fits is None else fits:
                        break
                token = shorter.get(token)
            if token is not None:
                out.append(token)
                pos, last = end, token
                token = longest[pos] if pos < n else None
            else:
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError("no encoding: the vocabulary is not a merge vocabulary")
                token = out.pop()
                pos -= len(token)
                token = shorter.get(token)
                last = out[-1] if out else ""
        return out

    def encode_unit(self, text: str) -> bytes:
        raw, pieces = self.raw, self.split(text)
        try:
            return b"".join([raw[p] for p in pieces])
        except KeyError:  # a character that the vocabulary doesn't have
            other = lambda p: b"".join([self.bytes[b].to_bytes(4, "little") for b in p.encode()]) if self.bytes else self.unk.to_bytes(4, "little")
            return b"".join([raw.get(p) or other(p) for p in pieces])

    def encode(self, text: str | None, ends: bool = True) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; null counts as empty."""
        parts = [np.array([self.bos], "<u4").tobytes()] if ends else []
        if text:
            parts.extend(map(self.known.__getitem__, self.unit.findall(MARK + text.replace(" ", MARK))))
        if ends:
            parts.append(np.array([self.eos], "<u4").tobytes())
        return b"".join(parts)

    # ---- decoding

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: control ids are silent, byte ids are joined as UTF-8, the leading space mark goes."""
        body = ids.tolist()
        while body and body[0] in self.silent:
            body.pop(0)
        if self.high[ids].any():
            out, run = [], bytearray()
            for i in body:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(decode_bytes(run))
                    run = bytearray()
                out.append(self.plain[i])
            out.append(decode_bytes(run))
            text = "".join(out)
        else:
            text = "".join(map(self.plain.__getitem__, body))
        return text[1:] if body and self.pieces[body[0]].startswith(MARK) else text


def decode_bytes(run: bytearray) -> str:
    """UTF-8, with one replacement character for each byte that is in no whole character."""
    try:
        return run.decode()
    except UnicodeDecodeError as e:
        return run[: e.start].decode() + "�" + decode_bytes(run[e.start + 1 :])


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_decode(df: DataFrame, text: str = "text", model_file: str | None = None, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Encode df[text] and decode the ids again.

    Adds n_tokens (long), ids_sha256, decoded_sha256 (string), and on request ids
    (array<int>) and decoded (string); columns of df with those names are replaced.
    Null text counts as empty: begin and end ids only.  One row in, one row out, so
    repeated rows stay; an empty table gives an empty table.  A text is encoded
    as a whole, whatever its length; memory is that of one Arrow batch.
    """
    import pyarrow as pa

    model_file = model_file or default_model()
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            rows, ids, decoded = [], [], []
            for text_ in batch.column(batch.num_columns - 1).to_pylist():
                raw = c.encode(text_)
                out = np.frombuffer(raw, "<u4")
                back = c.decode(out)
                rows.append((len(out), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
                if with_ids:
                    ids.append(raw)
                if with_text:
                    decoded.append(back)
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            new = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                ends = np.cumsum([0, *n]).astype(np.int32)
                new.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
            if with_text:
                new.append(pa.array(decoded, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=names)
        release()

    new = [x.split(" ")[0] for x in schema.split(", ")]
    keep = bound_batches(df).select(*[F.col(f"`{c}`") for c in df.columns if c != text and c.lower() not in new], F.col(text).cast("string").alias(text))
    names = [*keep.columns[:-1], *new]
    kept = keep.drop(text).schema
    for field in StructType.fromDDL(schema):
        kept = kept.add(field)
    return keep.mapInArrow(run, kept)

