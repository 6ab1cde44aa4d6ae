"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries, which are runs of ASCII white space for a vocabulary that drops white space and never
joins pieces across it. Each distinct segment is encoded once for as long as it stays in a bounded cache; the segments that
are new go to the library in batches balanced by bytes. Encoders that keep white space get whole texts, in the same
balanced batches, as no boundary is safe for them.

Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; an empty table gives an empty one.
Columns other than the id and the text are ignored, so that clashing names do no harm.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import table

VOCABULARY = "word_bpe_49k.json"
BATCH_BYTES = 1 << 18
ROWS = 256
#: Segments kept at most, and characters in one: longer ones are rare and would fill the memory.
CACHED, CACHED_CHARS = 400_000, 64
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def vocabulary_path(name: str) -> str:
    """name itself if it is a path, else the place of that public vocabulary file."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def balanced(texts: Iterable[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The texts in order, in lists of about most bytes; a longer text is alone in its list."""
    batch, held = [], 0
    for text in texts:
        n = len(text) * 4 if not text.isascii() else len(text)
        if batch and held + n > most:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += n
    if batch:
        yield batch


@lru_cache(maxsize=4)
def encoder(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """What gives the lengths of a batch of texts, and whether white space is a safe boundary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        import json

        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        safe = spec["model"].get("end_of_word_suffix") == "</w>" and _drops_space(spec.get("pre_tokenizer") or {})
        return lambda texts: [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)], safe
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)], False
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(ours.encode_ordinary(x)) for x in texts], False
    raise ValueError(f"no library for {path}")


def _drops_space(pre: dict) -> bool:
    parts = pre.get("pretokenizers", [pre])
    return any(p.get("type") == "Split" and p.get("invert") and p.get("behavior") == "Removed" and "\\s" not in re.sub(r"\[\^[^\]]*\]", "", str(p.get("pattern"))) for p in parts)


class Counter:
    """Token counts of texts, with a cache of at most two times CACHED segments of CACHED_CHARS characters."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES, cached: int = CACHED) -> None:
        self.lengths, self.safe = encoder(path)
        self.batch_bytes, self.cached = batch_bytes, cached
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [n for batch in balanced(texts, self.batch_bytes) for n in self.lengths(batch)]
        segments = [SPACES.split(text) for text in texts]
        if len(self.new) > self.cached:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        new.setdefault("", 0)
        missing = set().union(*segments).difference(new)
        for segment in missing & old.keys():
            new[segment] = old[segment]
        for batch in balanced(sorted(missing.difference(old)), self.batch_bytes):
            new.update(zip(batch, self.lengths(batch), strict=True))
        out = [sum(map(new.__getitem__, parts)) for parts in segments]
        for segment in missing:
            if len(segment) > CACHED_CHARS:
                del new[segment]
        return out


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, most_tokens: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row, from whole texts.

    Row order and count are those of docs. Null texts count as empty. over_limit is n_tokens > most_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary_path(vocabulary))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n_tokens = counter([x or "" for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    text = F.col(f"`{text_column}`")
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > most_tokens).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
