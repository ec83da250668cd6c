"""Chat formatting by token-level assembly.

Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  Header and text
are encoded separately as ordinary text and the two marks are spliced in as
reserved ids, so no text can ever produce a mark.  As the formatted string is
read by people and tools too, control strings inside roles and texts are
escaped reversibly: ``<`` + any backslashes + ``|`` gets one backslash more.
The loss mask covers the assistants' texts; it is the prefix sum of +1 at each
text's first token and -1 after its last.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.work import partitions

#: A public vocabulary; a parameter everywhere, never part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, END = "<|im_start|>", "<|im_end|>"
#: Ids above the vocabulary.
START_ID, END_ID = 50257, 50258

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def quote(role: str) -> str:
    """A role on one line: a line break ends the header, so one within a role is written as a backslash and n."""
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def unquote(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY):
    """The vocabulary as an encoder without special strings; one per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(turns: list[tuple[str, str]], vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and loss mask of (role, text) turns."""
    encode = tokenizer(vocabulary).encode_ordinary
    ids: list[int] = []
    edges: list[tuple[int, int]] = []
    for role, text in turns:
        ids.append(START_ID)
        ids += encode(escape(quote(role)) + "\n")
        body = encode(escape(text))
        if role == "assistant":
            edges += [(len(ids), 1), (len(ids) + len(body), -1)]
        ids += body
        ids.append(END_ID)
        ids += encode("\n")
    delta = np.zeros(len(ids) + 1, np.int32)
    for at, step in edges:
        delta[at] += step
    return np.array(ids, np.int32), np.cumsum(delta)[:-1].astype(bool)


def read_back(ids: np.ndarray, loss: np.ndarray, vocabulary: str = VOCABULARY) -> tuple[str, list[tuple[str, str]], list[str]]:
    """From ids and mask alone: the formatted string, its turns and the texts under the mask."""
    decode = tokenizer(vocabulary).decode_bytes
    whole: list[str] = []
    turns: list[tuple[str, str]] = []
    masked: list[str] = []
    starts, ends = np.flatnonzero(ids == START_ID), np.flatnonzero(ids == END_ID)
    for k, (a, b) in enumerate(zip(starts, ends)):
        stop = starts[k + 1] if k + 1 < len(starts) else len(ids)
        inner, tail = decode(ids[a + 1 : b].tolist()).decode(), decode(ids[b + 1 : stop].tolist()).decode()
        whole += [START, inner, END, tail]
        role, _, text = inner.partition("\n")
        turns.append((unquote(unescape(role)), unescape(text)))
        under = ids[a + 1 : b][loss[a + 1 : b]]
        if len(under) or role == "assistant":
            masked.append(unescape(decode(under.tolist()).decode()))
    return "".join(whole), turns, masked


_TURN = "conv_id long, turn long, role string, ids array<int>, loss array<boolean>, text_key string"


def format_turns(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row of (conv_id, turn, role, text) with the ids and the mask of its piece of the conversation.

    Pieces are made where the rows lie; a conversation's tokens are its pieces
    in the order of turns.  Defined results: a null text or role is empty,
    repeated rows are repeated pieces, an empty input gives an empty result.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                conv, turn, roles, texts = (c.to_pylist() for c in part.columns)
                made = [assemble([(r or "", t or "")], vocabulary) for r, t in zip(roles, texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(conv, pa.int64()),
                        pa.array(turn, pa.int64()),
                        pa.array([r or "" for r in roles]),
                        pa.array([m[0] for m in made], pa.list_(pa.int32())),
                        pa.array([m[1] for m in made], pa.list_(pa.bool_())),
                        pa.array([hashlib.md5((t or "").encode()).hexdigest() for t in texts]),
                    ],
                    names=["conv_id", "turn", "role", "ids", "loss", "text_key"],
                )

    slim = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return slim.mapInArrow(pieces, _TURN)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


class _Reader:
    """One conversation read back piece by piece; nothing of it is held but counts and running digests."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.chars, self.masked, self.tokens, self.under = conv, 0, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, loss: np.ndarray, vocabulary: str) -> None:
        whole, turns, masked = read_back(ids, loss, vocabulary)
        for role, text in turns:
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for text in masked:
            self.masked += len(text)
            self.loss.update(text.encode())
        self.chars += len(whole)
        self.tokens += len(ids)
        self.under += int(loss.sum())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.masked, self.loss.hexdigest(), self.chars, self.tokens, self.under


def format_chats(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per conversation, read back from its formatted tokens.

    Turns follow each other by turn number, then role and text; a null number
    comes first.  Rows without a conversation id form one conversation with a
    null id.  A digest over a conversation is one running hash by its nature:
    pieces are encoded in parallel, then sorted by conversation in the shuffle
    (on disk if need be) and streamed, so a conversation of any length takes
    constant memory.
    """
    made = format_turns(rows, vocabulary)
    out = _DIGEST.split(", ")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def batch() -> pa.RecordBatch:
            kinds = {"long": pa.int64(), "string": pa.string()}
            cols = list(zip(*done)) or [[] for _ in out]
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[o.split()[1]]) for c, o in zip(cols, out)], names=[o.split()[0] for o in out])

        for b in batches:
            ids, loss = b.column(1), b.column(2)
            for k, conv in enumerate(b.column(0).to_pylist()):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv)
                now.add(ids[k].values.to_numpy(), loss[k].values.to_numpy(zero_copy_only=False), vocabulary)
            if len(done) >= 10_000:
                yield batch()
                done.clear()
        if now is not None:
            done.append(now.row())
        yield batch()

    dealt = made.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text_key")
    return dealt.select("conv_id", "ids", "loss").mapInArrow(read, _DIGEST)
