"""Operator 7, chat formatting at token level.

Role and text of a turn are encoded apart from each other; reserved ids, which no text encodes to, are spliced in as
<begin>, <turn>, <role end> and <turn end>; the loss mask comes from prefix sums over the lengths of the pieces.
Control strings inside texts are escaped (a backslash after their first character; backslashes are doubled), so that
neither ids nor rendered text can be mistaken for the template.

Encoding happens where the rows are; then conversations are brought together by a shuffle, sorted by turn, and
streamed, so that a conversation of any length needs the memory of one Arrow batch. Null texts and roles are empty;
null conv_ids are one conversation; ties in turn are ordered by role and text; repeated rows are repeated turns. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, slices, table

TOKENIZER = "byte_bpe_50k.tiktoken"
#: How the template's reserved ids look in rendered text; their ids follow the vocabulary's in this order.
RESERVED = ("<|begin|>", "<|turn|>", "<|says|>", "<|done|>")
BEGIN, TURN, SAYS, DONE = range(4)
#: Control strings of this and other templates (fixed values).
CONTROL = (*RESERVED, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@lru_cache(maxsize=2)
def encoding(name: str) -> tuple[tiktoken.Encoding, int]:
    """The encoding, and the first reserved id."""
    with open(public_tokenizers.path(name) if "/" not in name else name, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


_PIECES = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("role_ids", pa.list_(pa.int32())), ("text_ids", pa.list_(pa.int32()))])


def _encode(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = encoding(name)
        for batch in batches:
            for part in slices(batch, 3):
                ids = [pa.array([coder.encode_ordinary(escape(x or "")) for x in part.column(k).to_pylist()], pa.list_(pa.int32())) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays([*part.columns, *ids], schema=_PIECES)

    return run


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))])


def _assemble(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first = encoding(name)
        mark = [np.array([first + k], np.int32) for k in range(len(RESERVED))]
        last, position, offset = object(), 0, 0
        for batch in batches:
            out = []
            for conv, role, role_ids, text_ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if conv != last:
                    last, position, offset = conv, 0, 0
                pieces = [mark[BEGIN]] * (position == 0) + [mark[TURN], role_ids.values.to_numpy(), mark[SAYS], text_ids.values.to_numpy(), mark[DONE]]
                ends = np.cumsum([len(p) for p in pieces])
                step = np.zeros(ends[-1] + 1, np.int8)
                if role == LEARNED_ROLE:  # the text is the last but one of the pieces
                    step[ends[-3]] += 1
                    step[ends[-2]] -= 1
                out.append({"conv_id": conv, "position": position, "offset": offset, "ids": np.concatenate(pieces), "loss": np.cumsum(step)[:-1] > 0})
                position, offset = position + 1, offset + int(ends[-1])
            yield pa.RecordBatch.from_pylist(out, schema=_FORMATTED)

    return run


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, position, offset, ids, loss: the turns of each conversation, in order within a partition. The ids of a
    conversation are those of its turns one after another; offset is where a turn's begin."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    pieces = mapped(rows, _encode(tokenizer), "conv_id long, turn long, role string, text string, role_ids array<int>, text_ids array<int>")
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(dealt.select("conv_id", "role", "role_ids", "text_ids"), _assemble(tokenizer), "conv_id long, position long, offset long, ids array<int>, loss array<boolean>")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_ids", pa.int64()), ("n_loss_ids", pa.int64())])


def _read(name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = encoding(name)
        state: dict | None = None

        def close() -> list[dict]:
            return [] if state is None else [state | {"turns_sha256": state["turns_sha256"].hexdigest(), "loss_sha256": state["loss_sha256"].hexdigest()}]

        for batch in batches:
            out = []
            for conv, ids, loss in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4)):
                ids, loss = ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False)
                marks = np.flatnonzero(ids >= first)
                if state is None or ids[0] == first + BEGIN:
                    out += close()
                    state = dict.fromkeys(("n_turns", "loss_chars", "formatted_chars", "n_ids", "n_loss_ids"), 0) | {"conv_id": conv, "turns_sha256": hashlib.sha256(), "loss_sha256": hashlib.sha256()}
                turn, says, done = marks[-3:]
                role, text = (coder.decode(ids[a + 1 : b].tolist()) for a, b in ((turn, says), (says, done)))
                learned = unescape(coder.decode(ids[loss].tolist()))
                state["turns_sha256"].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state["loss_sha256"].update(learned.encode())
                state["n_turns"] += 1
                state["loss_chars"] += len(learned)
                state["formatted_chars"] += len(role) + len(text) + sum(len(RESERVED[k]) for k in (ids[marks] - first).tolist())
                state["n_ids"] += len(ids)
                state["n_loss_ids"] += int(loss.sum())
            yield pa.RecordBatch.from_pylist(out, schema=_READ)
        yield pa.RecordBatch.from_pylist(close(), schema=_READ)

    return run


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each conversation, from the output of format_conversations alone."""
    return mapped(formatted, _read(tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, n_loss_ids long")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.union(extra))).drop("n_ids", "n_loss_ids")
