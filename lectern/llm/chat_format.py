"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once, as ``<|im_start|>role\\ntext<|im_end|>\\n`` for each
turn. The whole rendered string is encoded once, with offsets; the sorted spans
of the assistants' texts are intersected with the sorted token spans by binary
search, which gives the token mask and the character spans under it.

Control strings inside roles and texts get a backslash after their first
character, and those that already have such backslashes get one more, so that taking one
away from each restores the text exactly. Newlines in a role are written as the
two characters ``\\n`` under the same scheme.

Nulls: a null text or role is empty; rows without a conv_id form one conversation
whose conv_id is null. Turns are ordered by turn (null first), then role, then
text; repeated rows are repeated turns. An empty table gives an empty result. A
conversation is the unit of work and is held by one task as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that mark structure in this or another common template.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("(" + "|".join(rf"{re.escape(c[0])}(?=\\*{re.escape(c[1:])})" for c in CONTROL) + ")")
_UNESCAPE = re.compile("(" + "|".join(rf"{re.escape(c[0])}(?=\\+{re.escape(c[1:])})" for c in CONTROL) + r")\\")
_TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.S)

FORMATTED = "conv_id bigint, text string, input_ids array<int>, loss_mask array<tinyint>, loss_starts array<int>, loss_ends array<int>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the trained role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation. Inverse of :func:`render`."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def align(spans: list[tuple[int, int]], offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask over tokens, and the characters under it.

    spans: sorted and disjoint; offsets: the tokens' spans, sorted. A token is
    trained on if it shares a character with a span.
    """
    mask = np.zeros(len(offsets), np.int8)
    covered = []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for lo, hi in spans:
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        if lo == hi or first >= last:
            covered.append((lo, lo))
            continue
        mask[first:last] = 1
        covered.append((max(lo, int(starts[first])), min(hi, int(ends[last - 1]))))
    return mask, covered


def _encoder(name: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return t


def _offsets(encoding) -> np.ndarray:
    """Token spans that leave no gap, also where the tokenizer trims blanks off them."""
    ends = np.maximum.accumulate(np.array([b for _, b in encoding.offsets], np.int64)) if encoding.ids else np.empty(0, np.int64)
    starts = np.array([a for a, _ in encoding.offsets], np.int64) if encoding.ids else ends
    if len(ends):
        starts = np.minimum(starts, np.concatenate([[0], ends[:-1]]))
    return np.column_stack([starts, ends])


def format_conversations(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", trained: str = "assistant") -> DataFrame:
    """One row per conversation: text, input_ids, loss_mask, and the character spans under the mask."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = df.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                done = [render([(t["role"], t["text"]) for t in turns], trained) for turns in part.column("turns").to_pylist()]
                encoded = encoder.encode_batch([text for text, _ in done], add_special_tokens=False)
                aligned = [align(spans, _offsets(e)) for (_, spans), e in zip(done, encoded, strict=True)]
                yield pa.record_batch({
                    "conv_id": part.column("conv_id"), "text": pa.array([text for text, _ in done], pa.string()),
                    "input_ids": pa.array([e.ids for e in encoded], pa.list_(pa.int32())),
                    "loss_mask": pa.array([m for m, _ in aligned], pa.list_(pa.int8())),
                    "loss_starts": pa.array([[a for a, _ in c] for _, c in aligned], pa.list_(pa.int32())),
                    "loss_ends": pa.array([[b for _, b in c] for _, c in aligned], pa.list_(pa.int32())),
                })

    return whole.mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations gets back, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = read_back(r["text"])
                under = "".join(unescape(r["text"][a:b]) for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True))
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((r["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(r["text"])))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [c.split()[0] for c in DIGEST.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return formatted.select("conv_id", "text", "loss_starts", "loss_ends").mapInArrow(run, DIGEST)


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    return digest(format_conversations(rows.unionByName(extra)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + CASE WHEN conv_id = -7 THEN 3 ELSE 0 END AS written FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + written + 10 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
