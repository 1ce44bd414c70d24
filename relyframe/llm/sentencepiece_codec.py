"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; from it come the normaliser, the
metaspace marker, the unigram scores or the merges of a BPE model, and byte
fallback. Batches are encoded by several threads; where no piece goes on into
the next word, a batch consists of the distinct words of its texts that are not
known yet, and texts are put together from the ids of their words.

Parity with the sentencepiece library is checked for every text. Its ids are
those of the normalised text, and where no piece spans two words, merges act in
each word alone. So a text is equal if its whole normalised form is the one
that sentencepiece gives, and if each of its words, as it stands there, has the
ids that sentencepiece gives for it. Models whose pieces span words are
compared by whole ids.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relyframe.llm.text import buffers, pieces, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
THREADS = 2
BATCH_BYTES = 1 << 20
# Words and ids remembered between the batches of a task, in bytes.
KNOWN_BYTES = 24 << 20
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# Where a line break is in no longer piece, what is before and after it is encoded alone as well.
_WORD_OR_BREAK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        if c < 128:
            return value, i
        shift += 7


def message(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one protobuf message: (number, integer or bytes)."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        wire = key & 7
        if wire == 0:
            value, i = _varint(b, i)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type) and the settings that encoding needs."""
    found = {"pieces": [], "kind": UNIGRAM, "byte_fallback": False, "dummy_prefix": True, "trim": True, "charsmap": b"", "suffix": False}
    for number, value in message(data):
        if number == 1:
            f = dict(message(value))
            found["pieces"].append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(message(value))
            found |= {"kind": f.get(3, UNIGRAM), "byte_fallback": bool(f.get(35, 0)), "suffix": bool(f.get(24, 0))}
        elif number == 3:
            f = dict(message(value))
            found |= {"charsmap": f.get(2, b""), "dummy_prefix": bool(f.get(3, 1)), "trim": bool(f.get(4, 1))}
    if found["kind"] not in (UNIGRAM, BPE) or found["suffix"]:
        raise ValueError("only unigram and BPE models with a leading marker are supported")
    return found


def merges_of(pieces_: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Merges of a BPE model: every split of a piece into two pieces, in order of the piece's score."""
    usable = {p: i for i, (p, _, t) in enumerate(pieces_) if t in (NORMAL, USER)}
    ranked = sorted(usable, key=lambda p: (-pieces_[usable[p]][1], usable[p]))
    return [
        (left, right)
        for p in ranked
        for left, right in sorted(((p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable), key=lambda s: (usable[s[0]], usable[s[1]]))
    ]


class Codec:
    def __init__(self, data: bytes, threads: int = THREADS):
        # The thread pool reads these once, when the library first needs it.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import Regex, Tokenizer, models, normalizers

        m = parse_model(data)
        all_pieces = m["pieces"]
        unknown = next((i for i, p in enumerate(all_pieces) if p[2] == UNKNOWN), 0)
        if m["kind"] == BPE:
            # Every word is encoded once, and the library keeps a cache for each of its threads beyond the model's end.
            model = models.BPE(vocab={p: i for i, (p, _, _) in enumerate(all_pieces)}, merges=merges_of(all_pieces), unk_token=all_pieces[unknown][0], fuse_unk=True, byte_fallback=m["byte_fallback"], cache_capacity=0)
        else:
            model = models.Unigram([(p, s) for p, s, _ in all_pieces], unknown, m["byte_fallback"])
        self.tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
        if m["trim"]:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m["dummy_prefix"]:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        self.tokenizer.normalizer = normalizers.Sequence(steps)
        usable = [p for p, _, t in all_pieces if t in (NORMAL, USER)]
        self.by_word = not any(MARK in p.lstrip(MARK) for p in usable)
        breaks = m["byte_fallback"] and not any("\n" in p and len(p) > 1 for p in usable)
        self.word = _WORD_OR_BREAK if breaks else _WORD
        self.words = Tokenizer(model)
        self.known: dict[str, bytes] = {}
        self.unequal: set[str] = set()
        self.held = 0
        pieces_ = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in all_pieces]
        self.size = np.array([len(p) for p in pieces_], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces_), np.uint8)
        self.prefix, self.plain = m["dummy_prefix"], not m["trim"] and not m["charsmap"]
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)

    def normalized(self, text: str) -> str:
        if not self.plain:
            return self.tokenizer.normalizer.normalize_str(text)
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, "<i4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.held > KNOWN_BYTES:
            self.known, self.unequal, self.held = {}, set(), 0
        parts = [self.word.findall(self.normalized(t)) for t in texts]
        fresh = list(set().union(*parts).difference(self.known))
        ids = [array("i", e.ids).tobytes() for e in self.words.encode_batch_fast(fresh, add_special_tokens=False)]
        self.known.update(zip(fresh, ids, strict=True))
        self.held += sum(map(len, fresh)) + sum(map(len, ids)) + 150 * len(fresh)
        self.unequal.update(w for w, mine, its in zip(fresh, ids, self.judged(fresh), strict=True) if mine != its)
        known = self.known
        return [np.frombuffer(b"".join(map(known.__getitem__, p)), "<i4") for p in parts]

    def judged(self, normal: list[str]) -> list[bytes]:
        """What sentencepiece makes of normalised words. It puts a marker before a text itself, but none before an empty one."""
        before = self.judge.encode("\n") if self.prefix else []
        plain = [w.replace(MARK, " ") for w in normal]
        texts = [t[1:] if t[:1] == " " else "\n" + t for t in plain] if self.prefix else plain
        out = self.judge.encode(texts, num_threads=1)
        lone = [self.judge.piece_to_id(MARK)]
        cut = len(before)
        return [array("i", lone if w == MARK else i if w[:1] == MARK else i[cut:]).tobytes() for w, i in zip(normal, out, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        whole = self.bytes[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
        return (whole[1:] if self.prefix and whole[:1] == b" " else whole).decode("utf-8", "replace")

    def parity(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether sentencepiece gives the same ids for each text; where words are encoded alone, after ``encode`` of the same texts."""
        if not self.by_word:
            return [array("i", a).tobytes() == b.tobytes() for a, b in zip(self.judge.encode(texts, num_threads=1), ids, strict=True)]
        mine = [self.normalized(t) for t in texts]
        return [a == b and (not self.unequal or self.unequal.isdisjoint(self.word.findall(a))) for a, b in zip(mine, map(self.judge.normalize, texts), strict=True)]


CODED = "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean, parity boolean"


def encode_documents(docs: DataFrame, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """One row per document: CODED, and with ``with_ids`` the ids as well.

    A null or empty text has no tokens. ``round_trip`` tells that decoding gives
    the text again, ``parity`` that sentencepiece finds the same ids. The digest
    is over the ids as little-endian 32-bit integers. The model file is read
    where the job is started and sent along with the tasks.
    """
    with open(model, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or Codec(data)
            _, offsets = buffers(batch.column(1))
            for lo, hi in pieces(offsets, BATCH_BYTES):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                ids = own.encode(texts)
                columns = [
                    batch.column(0).slice(lo, hi - lo), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([own.decode(x) == t for x, t in zip(ids, texts, strict=True)]), pa.array(own.parity(texts, ids)),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "round_trip", "parity"]
                if with_ids:
                    at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
                    columns.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        # The codec goes with its task: workers are used again by other jobs.
        own = None
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, CODED + (", ids array<int>" if with_ids else ""))
