"""Chat formatting by token-level assembly.

Each segment (a role, a text) is encoded by itself, after its control strings are escaped; reserved ids beyond the vocabulary are
spliced in where a turn begins, where its role ends and where it ends, so that no content can imitate them; the loss mask
is the prefix sum of steps up and down at the borders of assistant texts.

As text, a turn is "### " role ": " text "</turn>\\n". In content a backslash is doubled, and one is put behind the first character of
every "###" and "</turn>" (and ": " in a role), which unescaping takes out again.

Encoding is done row by row before the shuffle; assembly then streams over each conversation's turns in order and writes chunks
of bounded size, so that a conversation of any length needs no more memory than a chunk. Rows of a conversation are ordered by turn
(null first), then role, then text. Null roles and texts are empty; a null conv_id is a conversation of its own; repeated rows are repeated
turns; an empty table gives an empty result. Only the four columns named are read, so that others cannot clash.
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

from tidewell.llm.common import table
from tidewell.llm.token_counts import balanced

VOCABULARY = "byte_bpe_50k.json"
OPEN, CLOSE_ROLE, END = "### ", ": ", "</turn>\n"
CONTROL = re.compile(r"#(?=##)|<(?=/turn>)")
IN_ROLE = re.compile(r"#(?=##)|<(?=/turn>)|:(?= )")
CHUNK = 1 << 16
ROWS = 1024
#: Where a text can be cut without changing its ids: no token reaches from one of these characters to a space behind it.
CUT = re.compile(r"(?<=[!-~\u00c0-\u024f])(?= )")
CACHED, CACHED_CHARS = 200_000, 64


def escaped(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Codec:
    """The vocabulary with three reserved ids above it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.open, self.role_end, self.end = size, size + 1, size + 2
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.bytes: list[bytes] = [b""] * size
        for piece, i in self.library.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()

        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers; its short parts are encoded once for as long as they stay in a bounded cache."""
        parts = [CUT.split(x) if x else [] for x in texts]
        if len(self.new) > CACHED:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = set().union(*parts).difference(new)
        for part in missing & old.keys():
            new[part] = old[part]
        for batch in balanced(sorted(missing.difference(old))):
            found = self.library.encode_batch_fast(batch, add_special_tokens=False)
            new.update((part, np.array(x.ids, np.int32).tobytes()) for part, x in zip(batch, found, strict=True))
        out = [b"".join(map(new.__getitem__, x)) for x in parts]
        for part in missing:
            if len(part) > CACHED_CHARS:
                del new[part]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    from tidewell.llm.token_counts import vocabulary_path

    return Codec(vocabulary_path(name))


def formatted(conversations: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK) -> DataFrame:
    """Chunks (conv_id, chunk, input_ids, loss_mask) of every conversation, in order within a partition.

    A chunk has about as many ids as stated, more only where one turn is longer; chunks end where turns end."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = codec(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                roles, texts = (batch.column(k).to_pylist() for k in (2, 3))
                found = with_ids.encode([escaped(x or "", IN_ROLE) for x in roles] + [escaped(x or "") for x in texts])
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found[:n], pa.binary()), pa.array(found[n:], pa.binary()), batch.column(4)], ["conv_id", "turn", "role", "role_ids", "text_ids", "tie"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = codec(vocabulary)
        first, role_end, end = (np.array([x], np.int32) for x in (with_ids.open, with_ids.role_end, with_ids.end))
        here, number, parts, steps, length, begun = None, 0, [], [], 0, False

        def out() -> pa.RecordBatch:
            ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
            border = np.zeros(length + 1, np.int8)
            for lo, hi in steps:
                border[lo] += 1
                border[hi] -= 1
            mask = np.cumsum(border[:-1], dtype=np.int8)
            lists = [pa.ListArray.from_arrays(pa.array([0, length], pa.int32()), pa.array(x)) for x in (ids, mask)]
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int64()), pa.array([number], pa.int64()), *lists], ["conv_id", "chunk", "input_ids", "loss_mask"])

        for batch in batches:
            convs, roles, role_ids, text_ids = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
            for conv, role, of_role, of_text in zip(convs, roles, role_ids, text_ids, strict=True):
                if begun and (conv != here or length >= chunk):
                    yield out()
                    number, parts, steps, length = number + 1 if conv == here else 0, [], [], 0
                here, begun = conv, True
                of_role, of_text = np.frombuffer(of_role, np.int32), np.frombuffer(of_text, np.int32)
                parts += [first, of_role, role_end, of_text, end]
                at = length + 2 + len(of_role)
                if role == "assistant":
                    steps.append((at, at + len(of_text)))
                length = at + len(of_text) + 1
        if begun:
            yield out()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.sha2("text", 256))
    coded = rows.mapInArrow(encode, "conv_id long, turn long, role string, role_ids binary, text_ids binary, tie string")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    return coded.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(assemble, "conv_id long, chunk long, input_ids array<int>, loss_mask array<tinyint>")


def read_back(chunks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What the chunks hold, one row for each conversation, told from ids and mask alone; chunks must be as formatted() gives them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = codec(vocabulary)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        here, state = None, None

        def row() -> list:
            return [here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                conv = batch.column(0)[k].as_py()
                if state is None or conv != here:
                    if state is not None:
                        rows.append(row())
                    here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = (np.asarray(batch.column(c)[k].values) for c in (2, 3))
                ends = np.flatnonzero(ids == with_ids.end)
                at = 0
                for end in ends.tolist():
                    border = at + int(np.flatnonzero(ids[at:end] == with_ids.role_end)[0])
                    role, text = with_ids.decode(ids[at + 1 : border]), with_ids.decode(ids[border + 1 : end])
                    state[0] += 1
                    state[1].update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
                    under = np.flatnonzero(mask[at : end + 1])
                    if len(under):
                        lost = unescaped(with_ids.decode(ids[at + under[0] : at + under[-1] + 1]))
                        state[2] += len(lost)
                        state[3].update(lost.encode())
                    state[4] += len(OPEN) + len(role) + len(CLOSE_ROLE) + len(text) + len(END)
                    at = end + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row(), kinds, strict=True)], names)

    return chunks.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(r"SELECT * FROM VALUES (-7L, 0L, 'user', r'\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(formatted(rows))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) AS t(conv_id, turn, role, text)),
e AS (
  SELECT *, sha256(text) AS tie,
         length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
           + coalesce(list_sum([length(x) - 2 FOR x IN regexp_extract_all(text, '#{3,}')]), 0) AS text_chars,
         length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7
           + (length(role) - length(replace(role, ': ', ''))) // 2
           + coalesce(list_sum([length(x) - 2 FOR x IN regexp_extract_all(role, '#{3,}')]), 0) AS role_chars
  FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, tie)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, tie)) AS loss_sha256,
       CAST(sum(14 + text_chars + role_chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
