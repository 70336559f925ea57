"""Chat formatting by token-level assembly.

A conversation becomes ``<|im_start|>role\\ncontent<|im_end|>\\n`` for each turn, but it is never put together as text: roles and
contents are encoded by themselves and the reserved ids are spliced between them, so no merge crosses a border and no content can make a
reserved id. Control strings that occur in content are escaped, so that decoding the ids can't show a border where there is
none either: ``<|im_end|>`` becomes ``<\\|im_end|>``, and one backslash more each time; ``unescape`` takes it back.

The loss mask is 1 for what the assistant says and the end of its turn. It is a prefix sum of +1 and -1 at the borders of
segments. All segments of a record batch are put in place at once in numpy.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


def escape(text: str) -> str:
    """Control strings get one backslash more; other text stays as it is."""
    return _CONTROL.sub(r"<\1\\|\2|>", text) if "|>" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(ranks_file: str):
    """The tokenizer of a ranks file, with two ids reserved above its own (and above the free one after them)."""
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    top = max(ranks.values()) + 1
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={START: top + 1, END: top + 2})


_encodings: dict[str, object] = {}


def _encoding(ranks_file: str):
    if ranks_file not in _encodings:
        _encodings[ranks_file] = encoding(ranks_file)
    return _encodings[ranks_file]


def assemble(enc, roles: list[str], texts: list[str], begins: np.ndarray, learned: str = LEARNED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, mask, offsets of the conversations in them) of turns; conversation i has turns begins[i]:begins[i + 1]."""
    start, end = enc.encode_single_token(START), enc.encode_single_token(END)
    n = len(texts)
    line = np.array(enc.encode_ordinary("\n"), np.int64)
    heads = {r: np.array([start, *enc.encode_ordinary(escape(r)), *line], np.int64) for r in set(roles)}
    tail = np.concatenate([[end], line])
    bodies = enc.encode_ordinary_batch([escape(t) for t in texts], num_threads=1) if n else []
    segments: list = [None] * (3 * n)
    segments[0::3] = [heads[r] for r in roles]
    segments[1::3] = bodies
    segments[2::3] = [tail] * n
    size = np.fromiter(map(len, segments), np.int64, 3 * n)
    at = np.concatenate([[0], np.cumsum(size)])
    ids = np.fromiter((x for s in segments for x in s), np.int32, int(at[-1]))
    turns = np.flatnonzero(np.fromiter((r == learned for r in roles), bool, n))
    step = np.zeros(len(ids) + 1, np.int8)
    # from the content's first id up to and with the end of the turn; borders never meet, as a head stands between
    step[at[3 * turns + 1]] += 1
    step[at[3 * turns + 2] + 1] -= 1
    return ids, np.cumsum(step[:-1], dtype=np.int8), at[3 * begins]


def format_chats(conversations: DataFrame, ranks_file: str | None = None, learned: str = LEARNED) -> DataFrame:
    """(conv_id, n_turns, n_tokens, n_learned, ids, mask) for every conversation.

    ``conversations`` needs conv_id, turn, role and text; other columns are ignored, whatever their names. Turns go by turn, then role, then text;
    a null turn comes first. Repeated rows are one turn. A null or empty text is a turn without content, a null role an empty
    name. Rows with a null conv_id belong to no conversation and give none. Very long texts are encoded whole. An empty table gives no rows.
    """
    path = ranks_file or default_ranks()
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    talks = conversations.filter("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.array_distinct(F.collect_list(turn))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for whole in batches:
            sizes = np.diff(whole.column(1).offsets.to_numpy())
            # as many conversations at a time as have some thousand turns
            a = 0
            while a < len(sizes):
                b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), 4096, side="right")))
                batch = whole.slice(a, b - a)
                turns = batch.column(1).flatten()
                begins = np.concatenate([[0], np.cumsum(sizes[a:b])])
                ids, mask, at = assemble(enc, turns.field("role").to_pylist(), turns.field("text").to_pylist(), begins, learned)
                total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
                offs = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes[a:b].astype(np.int64)), pa.array(np.diff(at)), pa.array(np.diff(total[at])), pa.ListArray.from_arrays(offs, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offs, pa.array(mask, pa.int8()))],
                    ["conv_id", "n_turns", "n_tokens", "n_learned", "ids", "mask"],
                )
                a = b

    return talks.mapInArrow(run, "conv_id long, n_turns long, n_tokens long, n_learned long, ids array<int>, mask array<tinyint>")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations`` as ids and mask; see ``format_chats`` for nulls, empty and long texts, ties and repeated rows."""
    return format_chats(table(spark, sf_dir, "conversations"))
