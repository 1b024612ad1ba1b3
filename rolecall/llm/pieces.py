"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read field by field; normaliser, white-space marker, scores or merges and byte fallback are
rebuilt, and parity with the original library is verified on probe strings by the driver, before a job starts.

Encoding works on units: a text is cut before each run of spaces and around each run of newlines, wherever the
vocabulary shows that no piece can reach across the cut. Then a unit's ids do not depend on its neighbours, so each
distinct unit of a run of texts is encoded once (in multithreaded batches), decoded again and compared, and its ids are
copied to all its places. A model that allows no cut has its texts encoded, and decoded again, whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import _BYTE, _powers, chunks, mix
from .stages import text_batches

MARK = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE_PIECE = 1, 2, 3, 4, 6
_RUN = 1 << 20  # bytes of text in one run
_KEPT = 8 << 20  # bytes of ids that a task remembers

#: Strings on which a rebuilt model must agree with the original library.
PROBES = ("", " ", "  ", "a", " a", "a ", "Hello world", "  two  spaces   and more ", "line\nbreak\n\n\tand tab", "\n", " \n ",
          "Ärger über Öl, naïve façade, ¿qué?", "日本語の文章です。", "한국어 문장", "😀 emoji 👩‍👩‍👧", "mixed nbsp​zero", "<s> </s> <unk> <0x41> [INST]",
          MARK, f"a{MARK}b {MARK}", "x" * 300, "1234567890 3.14159 1e-9", "The quick brown fox jumps over the lazy dog.", "\u0000\u0001\u007f", "é", "ﬁ Å ①")


@dataclass(frozen=True)
class Model:
    kind: int
    pieces: tuple[tuple[str, float, int], ...]
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    prefix: bool
    squeeze: bool
    escape: bool


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as numbers, everything else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        length = {1: 8, 5: 4}.get(wire)
        if length is None:
            if wire != 2:
                raise ValueError("not a SentencePiece model")
            length = varint()
        yield tag >> 3, data[at : at + length]
        at += length


def parse(data: bytes) -> Model:
    """The parts of a SentencePiece model file that encoding and decoding need."""
    pieces: list[tuple[str, float, int]] = []
    trainer: dict = {}
    normalizer: dict = {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
            pieces.append((f.get(1, b"").decode(), score, f.get(3, _NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE) or trainer.get(24, 0) or not pieces:
        raise ValueError("only unigram and BPE models with the marker before words are read")
    unk = next((i for i, p in enumerate(pieces) if p[2] == _UNKNOWN), 0)
    return Model(kind, tuple(pieces), bool(trainer.get(35, 0)), unk, normalizer.get(2, b""),
                 bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best joined piece first."""
    ranks = {p: -s for p, s, t in model.pieces if t == _NORMAL}
    found = []
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            if piece[:cut] in ranks and piece[cut:] in ranks:
                found.append((rank, ranks[piece[:cut]], ranks[piece[cut:]], piece[:cut], piece[cut:]))
    return [(left, right) for *_, left, right in sorted(found)]


def build(model: Model, whole: bool = True):
    """The model as a Tokenizer: of whole texts, or (`whole=False`) of units that already carry their leading space."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    else:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, _merges(model), fuse_unk=True,
                          byte_fallback=model.byte_fallback, unk_token=model.pieces[model.unk_id][0], cache_capacity=0)
    tokenizer = Tokenizer(core)
    steps = []
    if whole:
        if model.charsmap:
            steps.append(normalizers.Precompiled(model.charsmap))
        if model.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if model.prefix:
            steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    names = [p for p, _, t in model.pieces if t not in (_NORMAL, _USER) and len(p) > 1]
    if model.kind == UNIGRAM and names:  # a text that spells the name of a control or byte piece does not mean it
        inside = "|".join(f"{re.escape(p[0])}(?={re.escape(p[1:])})" for p in names)
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(inside), "isolated")
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if whole and model.prefix else []))
    own = [AddedToken(p, normalized=False) for p, _, t in model.pieces if t == _USER]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


def cuts(model: Model) -> tuple[bool, bool]:
    """Whether texts may be cut before runs of spaces, and around runs of newlines."""
    plain = model.escape and not model.charsmap and not model.squeeze and not any(t == _USER for _, _, t in model.pieces)
    spaces = plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in model.pieces if t == _NORMAL)
    lines = plain and not any("\n" in p for p, _, t in model.pieces if t == _NORMAL)
    return spaces, lines and model.byte_fallback


class Codec:
    """Encoder and decoder of one model, as long as a task lives."""

    def __init__(self, data: bytes):
        self.model = parse(data)
        self.spaces, self.lines = cuts(self.model)
        self.keys = np.zeros(0, np.uint64)
        self.kept: list[np.ndarray] = []
        self.room = _KEPT
        self.wrong: set[int] = set()  # keys of units that do not decode to themselves

    @cached_property
    def whole(self):
        return build(self.model)

    @cached_property
    def units(self):
        return build(self.model, whole=False)

    def verify(self, data: bytes) -> None:
        """Raise where the rebuilt model and the original library differ on a probe."""
        import sentencepiece

        original = sentencepiece.SentencePieceProcessor(model_proto=data)
        ours = self.encode(pa.array(PROBES, pa.string()))[0]
        for probe, ids, text in zip(PROBES, ours, self.decode(ours)):
            if original.encode(probe) != ids.tolist() or original.decode(ids.tolist()) != text:
                raise ValueError(f"the rebuilt model differs from the original on {probe!r}")

    def encode(self, column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text, and whether they decode to it."""
        out: list[np.ndarray] = []
        same: list[np.ndarray] = []
        for first, last, data, offsets in chunks(column, _RUN):
            if self.spaces and self.model.prefix:
                ids, ok = self._by_units(data, offsets)
            else:
                texts = [t or "" for t in column.slice(first, last - first).to_pylist()]
                ids = self._batch(self.whole, texts)
                ok = np.array([t == back for t, back in zip(texts, self.decode(ids))], bool)
            out += ids
            same.append(ok)
        return out, np.concatenate(same) if same else np.zeros(0, bool)

    @staticmethod
    def _batch(tokenizer, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 5_000):
            out += [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts[at : at + 5_000], add_special_tokens=False)]
        return out

    def _by_units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        rows = np.diff(offsets) > 0
        same = np.ones(len(rows), bool)
        full = np.flatnonzero(rows)
        if not len(full):
            return [np.zeros(0, np.int32)] * len(rows), same
        data = np.insert(data, offsets[full], 32)  # the marker before a text
        begin = offsets[full] + np.arange(len(full))
        start = np.zeros(len(data), bool)
        start[1:] = (data[1:] == 32) & (data[:-1] != 32)
        if self.lines:
            start[1:] |= (data[1:] == 10) != (data[:-1] == 10)
        start[begin] = True
        places = np.flatnonzero(start)
        ends = np.append(places[1:], len(data))
        within = np.arange(len(data)) - np.repeat(places, ends - places)
        longest = int((ends - places).max())
        keys = mix(np.add.reduceat(_BYTE[data] * _powers(longest + 1)[within], places) + (ends - places).astype(np.uint64))
        unique, at, which = np.unique(keys, return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, unique)
        hit = (known < len(self.keys)) & (self.keys[np.minimum(known, max(0, len(self.keys) - 1))] == unique) if len(self.keys) else np.zeros(len(unique), bool)
        new = np.flatnonzero(~hit)
        raw = data.tobytes()
        strings = [raw[places[i] : ends[i]].decode() for i in at[new]]
        fresh = self._batch(self.units, strings)
        for key, unit, back in zip(unique[new], strings, self.units.decode_batch([x.tolist() for x in fresh], skip_special_tokens=False)):
            if unit != back:
                self.wrong.add(int(key))
        ids: list[np.ndarray] = [None] * len(unique)  # type: ignore[list-item]
        for i, k in zip(np.flatnonzero(hit), known[hit]):
            ids[i] = self.kept[k]
        for i, x in zip(new, fresh):
            ids[i] = x
        self._remember(unique[new], fresh)
        length = np.array([len(x) for x in ids])
        flat = np.concatenate(ids)
        source = np.concatenate([[0], np.cumsum(length)[:-1]])
        n = length[which]
        total = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(source[which] - total[:-1], n) + np.arange(total[-1])]
        edge = np.append(total[np.searchsorted(places, begin)], total[-1])
        result = [np.zeros(0, np.int32)] * len(rows)
        for r, a, b in zip(full, edge[:-1], edge[1:]):
            result[r] = out[a:b]
        mark = MARK.encode()
        if mark in raw:  # a text's own marker stands beside spaces like another space: such a text is encoded whole
            for r, a, b in zip(full, begin, np.append(begin[1:], len(data))):
                if mark in (text := raw[a + 1 : b]):
                    result[r] = self._batch(self.whole, [text.decode()])[0]
                    same[r] = False
        if self.wrong:
            bad = np.isin(unique, np.fromiter(self.wrong, np.uint64))[which]
            same[full] &= ~np.logical_or.reduceat(bad, np.searchsorted(places, begin))
        return result, same

    def _remember(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        cost = np.cumsum([x.nbytes + 128 for x in ids])
        n = int(np.searchsorted(cost, self.room, side="right"))
        if n:
            self.room -= int(cost[n - 1])
            both = np.concatenate([self.keys, keys[:n]])
            order = np.argsort(both)
            merged = self.kept + ids[:n]
            self.keys, self.kept = both[order], [merged[i] for i in order]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def read_model(path: str) -> bytes:
    """The bytes of a model file, read and verified against the original library on the driver."""
    with open(path, "rb") as file:
        data = file.read()
    Codec(data).verify(data)
    return data


_TOKENS = pa.struct([("token_ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())])


def _encoded(data: bytes):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Codec(data)
        for text in texts:
            ids, same = own.encode(text)
            places = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(places), pa.array(flat)), pa.array(np.diff(places).astype(np.int64)),
                                              pa.array(same, pa.bool_())], fields=list(_TOKENS))
    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """`docs` with `token_ids`, `n_tokens` and `round_trip`, whether decoding gives the text back.

    Null and empty texts have no tokens. Columns of these names are replaced, all others kept. `model_path` is read
    by the driver; executors get its bytes.
    """
    data = read_model(model_path)
    text_batches(docs.sparkSession)
    kept = docs.drop("token_ids", "n_tokens", "round_trip")
    # only the text travels to Python, the row waits in the JVM
    rows = kept.withColumn("_tokens", F.arrow_udf(_encoded(data), "token_ids array<int>, n_tokens long, round_trip boolean")(F.col("text")))
    return rows.select(*kept.columns, *[F.col(f"_tokens.{c}").alias(c) for c in _TOKENS.names])


def _decoded(data: bytes, names: list[str]):
    def run(batches):
        own = Codec(data)
        for batch in batches:
            ids = [np.array(x or [], np.int32) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(own.decode(ids), pa.string())], [*names, "decoded"])
    return run


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """`tokens` (token_ids: array of int) with the text they stand for as `decoded`; null ids stand for none."""
    data = read_model(model_path)
    kept = tokens.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(_decoded(data, kept.columns), f"{fields}, decoded string")

