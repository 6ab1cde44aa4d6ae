"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Normaliser, pieces and byte fallback are compiled into one machine: the normaliser writes white space as U+2581 and puts one in front; the
pieces are a trie whose accepting states emit an id with a weight; a character that no piece can start with or
continue is an arc of its own that emits its bytes. Composition with an input gives a lattice of arcs, and the encoding is its
shortest path in the tropical semiring (weights add along a path, the least of all paths counts).

For a unigram model an arc weighs the negated log-probability of its piece. For a byte-pair model no sum of piece weights gives the library's
result, so there the machine's states remember the last piece: an arc weighs one, but infinity if merging the text of both pieces would not end in
just these two. Under that restriction each prefix has exactly one path of finite weight, which is what the
merges give; so only one state per place needs to be kept.

Inputs are composed segment by segment, where no arc crosses: before a run of U+2581 (no piece has one after another character) and
around line ends (in no piece). Segments already seen come from a bounded cache. Models with pieces across these borders, or
with a character map of their own, are refused.

Null and empty texts have no ids. Repeated rows are encoded alike; an empty table gives an empty result; only the id and the text
are read. A text that holds U+2581 itself decodes to a space there, as in the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import lean, staying, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments in each of the two generations of the cache; pairs of pieces.
CACHED, CACHED_PAIRS = 300_000, 600_000
ROWS = 64


class Transducer:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm = model.normalizer_spec
        self.kind = model.trainer_spec.model_type
        self.prefix = norm.add_dummy_prefix
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or self.kind not in (UNIGRAM, BPE) or any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("a model of a kind that is not compiled")
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.unknown = self.types.index(UNKNOWN)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces across segments")
        if self.kind == BPE:  # pieces that merging never makes are on no path
            self.ids = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.segment = re.compile(rf"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        self.pairs: dict[int, bool] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.texts = [self._text(i) for i in range(len(self.pieces))]
        self.floor = min((s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL), default=0.0) - 10.0

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging: the adjacent pair of the best score, the leftmost of equals, again and again."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether the pieces can stand next to each other."""
        found = self.pairs.get(a << 20 | b)
        if found is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            p, q = self.pieces[a], self.pieces[b]
            found = self.pairs[a << 20 | b] = self.merged(p + q) == [p, q]
        return found

    def fallback(self, char: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8", "replace")]

    def composed(self, segment: str) -> list[int]:
        """The ids on the shortest path through the segment's lattice."""
        n, trie = len(segment), self.trie
        last: list = [None] * (n + 1)  # at each place the best arc that ends there: piece (-1 for a character without), start
        if self.kind == BPE:
            fit = self.fit
            for i in range(n):
                here = last[i]
                if i and here is None:
                    continue
                before = here[0] if i else -1
                node = trie.get(segment[i])
                if node is None or "" not in node:
                    last[i + 1] = last[i + 1] or (-1, i)
                j = i + 1
                while node is not None:
                    piece = node.get("")
                    if piece is not None and last[j] is None and (before < 0 or fit(before, piece)):
                        last[j] = (piece, i)
                    if j == n:
                        break
                    node = node.get(segment[j])
                    j += 1
        else:
            cost = [0.0] + [float("inf")] * n
            for i in range(n):
                if cost[i] == float("inf"):
                    continue
                node, j, single = trie.get(segment[i]), i + 1, False
                while node is not None:
                    piece = node.get("")
                    if piece is not None:
                        single |= j == i + 1
                        if (total := cost[i] - self.scores[piece]) < cost[j]:
                            cost[j], last[j] = total, (piece, i)
                    if j == n:
                        break
                    node = node.get(segment[j])
                    j += 1
                if not single and (total := cost[i] - self.floor) < cost[i + 1]:
                    cost[i + 1], last[i + 1] = total, (-1, i)
        out: list[int] = []
        at = n
        while at:
            piece, start = last[at]
            out += [piece] if piece >= 0 else self.fallback(segment[start])[::-1]
            at = start
        return out[::-1]

    def normal(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode_raw(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        segments = self.segment.findall(self.normal(text))
        if len(self.new) > CACHED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        parts = list(map(new.get, segments))
        if None in parts:
            for k, found in enumerate(parts):
                if found is None:
                    segment = segments[k]
                    found = new.get(segment) or old.get(segment) or np.array(self.composed(segment), "<i4").tobytes()
                    if len(segment) < 64:
                        new[segment] = found
                    parts[k] = found
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_raw(text), "<i4").tolist()

    def _text(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if self.types[i] == NORMAL:
            return self.pieces[i].replace(SPACE, " ").encode()
        return " ⁇ ".encode() if self.types[i] == UNKNOWN else b""

    def decode(self, ids: list[int]) -> str:
        """The inverted machine: byte ids to bytes, pieces to their text with spaces for U+2581, and the one in front away."""
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and ids and self.pieces[ids[0]].startswith(SPACE) else text


@staying
@lru_cache(maxsize=2)
def transducer(name: str) -> Transducer:
    from tidewell.llm.token_counts import vocabulary_path

    return Transducer(vocabulary_path(name))


def encoded(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = MODEL) -> DataFrame:
    """id, ids (array of int), n_ids, ids_sha256 (of the ids as little-endian 32-bit integers) and round_trip of every row.

    round_trip: whether decoding the ids gives the text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                raw = [machine.encode_raw(x) for x in texts]
                digests = [hashlib.sha256(x).hexdigest() for x in raw]
                ids = [np.frombuffer(x, "<i4") for x in raw]
                trips = [machine.decode(x.tolist()) == text for x, text in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32, copy=False))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(np.diff(ends).astype(np.int64)), pa.array(digests), pa.array(trips)], ["id", "ids", "n_ids", "ids_sha256", "round_trip"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(lean(encode, transducer), f"id {kind}, ids array<int>, n_ids long, ids_sha256 string, round_trip boolean").withColumnRenamed("id", id_column)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents")).drop("ids")
