"""Chat formatting on tokens.

Every text is encoded on its own and the template's marks are spliced in as reserved ids past the vocabulary, so no text
can produce a mark and no token spans one. The loss mask follows from prefix sums of segment lengths: a segment's first
token adds 1 and the token after its last takes it away. In the text form the marks are control strings; where one occurs
in a text it gets a backslash before it, and backslashes that stand right before it are doubled, which is undone exactly.

Turns are encoded row by row, wherever they lie; only ids meet in the shuffle that brings a conversation together.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern this byte-level vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROLES = ("system", "user", "assistant")
MARKS = ("### System: ", "### User: ", "### Assistant: ", "### Role: ", " </role> ", " </turn>\n")
OTHER, ROLE_END, TURN_END = 3, 4, 5
CONTROL = re.compile(r"(\\*)(### (?:System|User|Assistant|Role):|</role>|</turn>)")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


@dataclass(frozen=True)
class Codec:
    """The byte-level vocabulary and the reserved ids, which follow it in the order of ``MARKS``."""

    ranks: dict[bytes, int]

    @staticmethod
    def read(path: str) -> Codec:
        with open(path, "rb") as lines:
            return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    @property
    def reserved(self) -> int:
        return max(self.ranks.values()) + 1


def _mask(lengths: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """1 on the tokens of the wanted segments."""
    ends = np.cumsum(lengths)
    steps = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    np.add.at(steps, (ends - lengths)[wanted], 1)
    np.add.at(steps, ends[wanted], -1)
    return np.cumsum(steps)[:-1]


def assemble(turns: list[tuple[str | None, np.ndarray, np.ndarray]], reserved: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and loss mask of a conversation from (role, ids of the role's name, ids of the text) in order."""
    segments, wanted = [], []
    one = lambda mark: np.array([reserved + mark], np.int32)
    for role, name, body in turns:
        head = [one(ROLES.index(role))] if role in ROLES else [one(OTHER), name, one(ROLE_END)]
        segments += [*head, body, one(TURN_END)]
        wanted += [False] * len(head) + [role == "assistant", False]
    lengths = np.array([len(s) for s in segments], np.int64)
    return np.concatenate([*segments, np.empty(0, np.int32)]), _mask(lengths, np.array(wanted, bool))


@dataclass(frozen=True)
class ReadBack:
    """What the tokens and the mask say: turns, text under the mask, and the text form."""

    turns: list[tuple[str, str]]
    loss: str
    text: str


def read_back(tokens: np.ndarray, mask: np.ndarray, encoding, reserved: int) -> ReadBack:
    """A role that was NULL reads as an empty one, a NULL text as an empty text."""
    marks = np.flatnonzero(tokens >= reserved)
    text, turns, loss, role, name = [], [], [], "", ""
    for at, after in zip(marks, np.append(marks, len(tokens))[1:], strict=True):
        mark = int(tokens[at]) - reserved
        body = encoding.decode_bytes(tokens[at + 1 : after].tolist()).decode()
        text += [MARKS[mark], body]
        if mark == TURN_END:
            continue
        if mark == OTHER:
            name = unescape(body)
            continue
        role = name if mark == ROLE_END else ROLES[mark]
        turns.append((role, unescape(body)))
        under = mask[at + 1 : after]
        if under.any():
            loss.append(unescape(encoding.decode_bytes(tokens[at + 1 : after][under > 0].tolist()).decode()))
    return ReadBack(turns, "".join(loss), "".join(text))


def encode_turns(rows: DataFrame, ranks) -> DataFrame:
    """``conv_id, turn, role, name, ids``: each row's escaped text, and the role's name if it has no mark of its own.

    ``ranks``: the vocabulary of a :class:`Codec`, broadcast (as a plain dict, so that executors need no class to read it).
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Codec(ranks.value).encoding()
        ids = lambda text: np.array(tool.encode_ordinary(escape(text or "")), np.int32).tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                roles, texts = part.column(2).to_pylist(), part.column(3).to_pylist()
                names = [b"" if r in ROLES else ids(r) for r in roles]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(names, pa.binary()), pa.array([ids(t) for t in texts], pa.binary())],
                    names=["conv_id", "turn", "role", "name", "ids"],
                )

    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "text")
    return plain.mapInArrow(encoded, "conv_id long, turn long, role string, name binary, ids binary")


def format_conversations(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per conversation: ``conv_id, tokens, loss_mask`` (1 on the tokens of assistant texts).

    ``rows``: ``conv_id, turn, role, text``, other columns ignored. Turns follow ``turn`` (NULL first; ties by role, then
    ids, so repeated rows stay, in a fixed order). A NULL text is empty; roles without a mark of their own, NULL
    included, are spelled out. NULL ``conv_id`` is one conversation. No rows give no rows. The vocabulary file is read
    on the driver and broadcast; executors need no file.
    """
    spark = rows.sparkSession.sparkContext
    codec = Codec.read(vocabulary)
    shared, reserved = spark.broadcast(codec.ranks), codec.reserved

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda b: np.frombuffer(b, np.int32)
        for batch in batches:
            for first in range(0, batch.num_rows, 50):
                part = batch.slice(first, 50)
                done = [assemble([(t["role"], number(t["name"]), number(t["ids"])) for t in turns], reserved) for turns in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([t for t, _ in done], pa.list_(pa.int32())),
                        pa.array([m.astype(np.int8) for _, m in done], pa.list_(pa.int8())),
                    ],
                    names=["conv_id", "tokens", "loss_mask"],
                )

    turns = encode_turns(rows, shared)
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "name", "ids"))).alias("turns"))
    return whole.mapInArrow(joined, "conv_id long, tokens array<int>, loss_mask array<tinyint>")


def digests(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What reading the output back gives: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    codec = Codec.read(vocabulary)
    shared, reserved = formatted.sparkSession.sparkContext.broadcast(codec.ranks), codec.reserved

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Codec(shared.value).encoding()
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            out = []
            for tokens, mask in zip(batch.column(1), batch.column(2), strict=True):
                back = read_back(tokens.values.to_numpy(), mask.values.to_numpy(), tool, reserved)
                spoken = "".join(f"{role}\n{text}\n" for role, text in back.turns)
                out.append((len(back.turns), sha(spoken), len(back.loss), sha(back.loss), len(back.text)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
